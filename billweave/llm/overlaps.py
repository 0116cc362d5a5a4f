"""Near duplicates by the Jaccard similarity of word shingle sets.

Texts with equal sets are one node.  Candidates share one of BANDS keys, each made of ROWS
minima of the set under hash functions; a pair of similarity s shares none with probability
(1 - s**ROWS)**BANDS, 7 in a million at 0.8.  A candidate pair becomes a link only by the exact
similarity of its sets, so no estimate decides.

Short runs of equal keys give all their pairs.  Long runs first give the pairs with their first
node.  Long runs that verified links leave in several classes are walked with the sets in one
task: every node that is reached is compared with all that are left, so their classes are
those of all pairs.  Such a task holds the sets of one run.

Null and empty texts have the empty set and are equal.  Texts with fewer words than a shingle
have their whole word sequence as the only shingle.  Rows with equal ids get a row each.  Long
texts are hashed whole, eight bytes for each shingle.  An empty table gives no rows.  Only the
id and text columns are read, so other columns may have any name.

`also` names further candidates, such as the classes of another method: texts that share a key
there are candidates like those of a band, and the exact similarity decides as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm import words
from billweave.llm.components import components
from billweave.llm.simhash import hashes_of
from billweave.session import checkpoint

ROWS, BANDS = 5, 30
_SHORT_RUN = 16  # runs up to this length give all pairs
_PIECE = 512  # texts whose sets are made at once
_SHIFTS = np.random.default_rng(11).integers(0, 1 << 64, ROWS * BANDS, np.uint64, endpoint=False)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(hashes_of(text, shingle))


def node_of(held: np.ndarray) -> str:
    """128 bits of a sorted set, in hex digits."""
    return xxhash.xxh3_128_hexdigest(held.tobytes())


def keys_of(held: np.ndarray) -> np.ndarray:
    """The band keys of a set; the empty set has none, because only empty sets are like it."""
    if not len(held):
        return np.zeros(0, np.int64)
    least = np.full(len(_SHIFTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 2048):
        least = np.minimum(least, words.mix(held[None, at : at + 2048] + _SHIFTS[:, None]).min(1))
    digests = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64)


def _pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The texts in pieces: the sets of one piece are in memory at once."""
    for texts in batches:
        for at in range(0, len(texts), _PIECE):
            yield texts.iloc[at : at + _PIECE]


def marks(text, shingle: int):
    """(node, keys) of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _pieces(batches):
            sets = [shingle_set(t, shingle) for t in texts]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "keys": [keys_of(s) for s in sets]})

    return F.pandas_udf(run, "node string, keys array<long>")(text.cast("string"))


def sets(text, shingle: int):
    """(node, held) of a text column: the sorted hashes of its shingles."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _pieces(batches):
            found = [shingle_set(t, shingle) for t in texts]
            yield pd.DataFrame({"node": [node_of(s) for s in found], "held": [s.view(np.int64) for s in found]})

    # a filter on its result would be pushed down as a second call for every text
    once = F.pandas_udf(run, "node string, held array<long>").asNondeterministic()
    return once(text.cast("string"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each key of a sorted stream, if there are several."""
    pieces: list[pd.DataFrame] = []
    for batch in batches:
        key = batch["key"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            if pieces and pieces[0]["key"].iloc[0] != key[low]:
                if sum(map(len, pieces)) > 1:
                    yield pd.concat(pieces)
                pieces = []
            # most keys have one row: those inside a batch are passed over
            if high - low > 1 or low == 0 or high == len(key):
                pieces.append(batch.iloc[low:high])
    if sum(map(len, pieces)) > 1:
        yield pd.concat(pieces)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run in _runs(batches):
        nodes = run["node"].to_numpy()
        if len(nodes) <= _SHORT_RUN:
            a, b = np.triu_indices(len(nodes), 1)
        else:
            a, b = np.zeros(len(nodes) - 1, int), np.arange(1, len(nodes))
        yield pd.DataFrame({"a": nodes[a], "b": nodes[b]})


def walk(held: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links whose classes are those of all pairs of the sets with at least the similarity."""
    _, ids = np.unique(np.concatenate(held), return_inverse=True)
    sizes = np.array([len(h) for h in held])
    ends = np.cumsum(sizes)
    known = np.zeros(ids.max() + 1, np.int32)
    left, found = np.arange(1, len(held)), []
    left_ids, queue = ids[ends[0] :], [0]
    while len(left):
        if not queue:
            queue = [int(left[0])]
            left, left_ids = left[1:], left_ids[sizes[left[0]] :]
            continue
        at = queue.pop()
        own = ids[ends[at] - sizes[at] : ends[at]]
        known[own] = 1
        starts = np.cumsum(sizes[left]) - sizes[left]
        shared = np.add.reduceat(known[left_ids], starts)
        known[own] = 0
        near = shared >= similarity * (sizes[left] + sizes[at] - shared) - 1e-9
        if near.any():
            found += [(at, int(k)) for k in left[near]]
            queue += left[near].tolist()
            left_ids = left_ids[np.repeat(~near, sizes[left])]
            left = left[~near]
    return found


def links(
    distinct: DataFrame, held: Callable[[DataFrame], DataFrame], similarity: float, also: DataFrame | None = None
) -> DataFrame:
    """(a, b) of nodes whose classes are those of all candidate pairs of at least the similarity.

    `distinct` has (node, keys), `also` (key, node) of further keys; `held` gives (node, held) of
    the nodes of a table, the candidates.
    """
    rows = distinct.select(F.explode("keys").alias("key"), "node")
    if also is not None:
        rows = rows.union(also.select("key", "node"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "node")
    pairs = checkpoint(ordered.mapInPandas(_pairs, "a string, b string").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = checkpoint(held(wanted))
    left, right = (own.select(F.col("node").alias(n), F.col("held").alias(f"_{n}")) for n in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    near = shared >= similarity * (F.size("_a") + F.size("_b") - shared) - 1e-9
    found = checkpoint(pairs.join(left, "a").join(right, "b").where(near).select("a", "b"))

    long = rows.groupBy("key").count().where(F.col("count") > _SHORT_RUN).select("key")
    members = rows.join(long, "key").join(components(found), "node", "left")
    members = checkpoint(members.select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = members.groupBy("key").agg(F.min("root").alias("_m"), F.max("root").alias("_n")).where("_m != _n")

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches):
            nodes = run["node"].to_numpy()
            ends = walk([np.asarray(h) for h in run["held"]], similarity)
            yield pd.DataFrame([(nodes[a], nodes[b]) for a, b in ends], columns=["a", "b"])

    whole = members.join(mixed.select("key"), "key").join(own, "node").select("key", "node", "held")
    more = whole.repartition("key").sortWithinPartitions("key", "node").mapInPandas(walked, "a string, b string")
    return found.union(more)


def classes(
    docs: DataFrame,
    shingle: int,
    similarity: float,
    id_col: str = "doc_id",
    text: str = "text",
    also: DataFrame | None = None,
) -> DataFrame:
    """(id, node, component_id) per row: its set and the smallest id reachable by links.

    `also` has (id, key), the key a long: further candidates."""
    marked = docs.select(F.col(id_col), marks(F.col(text), shingle).alias("_m"))
    prints = checkpoint(marked.select(id_col, "_m.*"))
    distinct = checkpoint(prints.groupBy("node").agg(F.min(id_col).alias("_id"), F.first("keys").alias("keys")))

    def held(wanted: DataFrame) -> DataFrame:
        # an id may stand at several texts: those of other nodes are left out again
        ids = distinct.join(wanted, "node").select("_id", F.col("node").alias("_node"))
        texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(ids, "_id")
        got = texts.select("_node", sets(F.col("_text"), shingle).alias("_s")).where("_s.node = _node")
        return got.select("_s.*").dropDuplicates(["node"])

    if also is not None:
        # the empty set takes no part: only empty sets are like it
        spoken = prints.where(F.size("keys") > 0).select(id_col, "node").distinct()
        also = checkpoint(spoken.join(also.select(id_col, "key").distinct(), id_col).select("key", "node").distinct())
    roots = components(links(distinct.select("node", "keys"), held, similarity, also))
    rooted = distinct.select("node", "_id").join(roots, "node", "left")
    rooted = checkpoint(rooted.select("node", "_id", F.coalesce("root", "node").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    return prints.join(named, "node").select(id_col, "node", "component_id")
