"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most `radius` bits are cut into segments, so few that one
segment differs in at most one bit.  Each segment is indexed once per bit with that bit left
out; two fingerprints share such a variant whenever a segment differs in that bit or not at
all.  Equal variants meet in sorted runs of one partition, where candidates are verified on
all bits.  Copies of a fingerprint are one row there.  Runs of many near copies give
the star of each class that verified links make, instead of all pairs: the classes stay the
same.

A fingerprint has one or more lanes of 64 bits.  Further lanes hash the same shingles anew;
each lane is cut into segments of its own and distances count the bits of all lanes, which
tells similarities apart that 64 bits blur.  `within` may be larger than `radius`: all pairs up
to `radius` bits are met by construction, those up to `within` bits if any segment differs in
one bit at most.

Null and empty texts have the fingerprint 0 and link like any other.  Texts with fewer words
than a shingle hash their whole word sequence.  Rows with equal ids get a row each.  Output
columns are those documented; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm import words
from billweave.llm.components import components
from billweave.session import checkpoint

SEED = 42
_SHORT_RUN = 16  # runs up to this length compare all neighbours at once


def hashes_of(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included, A-Z as a-z."""
    spoken = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not spoken:
        return np.zeros(0, "<u8")
    joined = b" ".join(spoken)
    lengths = np.fromiter(map(len, spoken), np.int64, len(spoken))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, len(spoken))
    starts = (ends - lengths)[: len(spoken) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], "<u8")


def prints_of(text: str | None, shingle: int, lanes: int = 1) -> np.ndarray:
    """Unsigned 64-bit SimHashes of the word shingles, repeats included, A-Z as a-z, one a lane."""
    hashes = hashes_of(text, shingle)
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        for lane in range(lanes):
            some = words.mix(part + np.uint64(lane)) if lane else part
            counts[lane] += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The first lane as a number."""
    return int(prints_of(text, shingle)[0])


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, lanes))]


def fingerprints(text, shingle: int, lanes: int = 1):
    """The lanes of the fingerprint of a text column: a struct of signed longs."""
    names = lane_names(lanes)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = np.array([prints_of(t, shingle, lanes) for t in texts], np.uint64).reshape(-1, lanes)
            yield pd.DataFrame(values.view(np.int64), columns=names)

    return F.pandas_udf(run, ", ".join(f"{n} long" for n in names))(text.cast("string"))


def segments(radius: int, lanes: int = 1) -> list[tuple[int, int]]:
    """(first bit, end bit) in each lane of the fewest segments of which one differs in one bit
    at most, when all lanes differ in `radius` bits."""
    n = -(-(radius // 2 + 1) // lanes)
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def variants(prints: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """(key, lanes): each fingerprint under the variants of its segments, one per bit."""
    masks, names = [], lane_names(lanes)
    for low, high in segments(radius, lanes):
        whole = ((1 << high) - 1) ^ ((1 << low) - 1)
        masks += [whole ^ (1 << bit) for bit in range(low, high)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    bit = F.explode(F.sequence(F.lit(0), F.lit(64 * lanes - 1))).alias("bit")
    lane = F.element_at(F.array(*names), (F.floor(F.col("bit") / 64) + 1).cast("int")) if lanes > 1 else F.col("fp")
    left = lane.bitwiseAND(F.element_at(signed, (F.col("bit") % 64 + 1).cast("int")))
    return prints.select(*names, bit).select(F.xxhash64("bit", left).alias("key"), *names)


def _within(fps: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Whether rows of lanes differ in at most `radius` bits."""
    bits = np.bitwise_count(fps ^ other)
    return (bits[:, 0] if bits.shape[1] == 1 else bits.sum(1, dtype=np.int64)) <= radius


def _long_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row numbers) of the classes of one run: every member to the first of its class."""
    left, heads, members = np.arange(len(fps)), [], []
    while len(left):
        head, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = _within(fps[left], fps[queue.pop()], radius)
            found, left = left[near], left[~near]
            queue.extend(found)
            heads.append(np.full(len(found), head))
            members.append(found)
    if not heads:
        return left, left
    return np.concatenate(heads), np.concatenate(members)


def run_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) between the fingerprints of equal keys, or stars of the classes that
    verified links make; the rows are sorted by key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    short = np.repeat(sizes <= _SHORT_RUN, sizes)
    a, b = [], []
    for gap in range(1, int(min(_SHORT_RUN, sizes.max(initial=1)))):
        near = np.flatnonzero((keys[gap:] == keys[:-gap]) & short[gap:])
        near = near[_within(fps[near + gap], fps[near], radius)]
        a.append(near)
        b.append(near + gap)
    for k in np.flatnonzero(sizes > _SHORT_RUN):
        heads, members = _long_run(fps[starts[k] : starts[k] + sizes[k]], radius)
        a.append(heads + starts[k])
        b.append(members + starts[k])
    if not a:
        return starts[:0], starts[:0]
    return np.concatenate(a), np.concatenate(b)


def links(prints: DataFrame, radius: int, lanes: int = 1, within: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints, as nodes, whose classes are those of all links.

    A node is the fingerprint of one lane, or the hash of several lanes.
    """
    names, limit = lane_names(lanes), radius if within is None else within

    ends = [f"{side}{k}" for side in "ab" for k in range(lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps = np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy()])
            fps = np.concatenate([fps, batch[names].to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last run may go on
            if whole:
                yield frame(fps, *run_links(keys[:whole], fps[:whole], limit))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield frame(fps, *run_links(keys, fps, limit))

    def frame(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        pairs = np.unique(np.concatenate([fps[a], fps[b]], axis=1).view(np.int64), axis=0)
        return pd.DataFrame(pairs, columns=ends)

    # 64 rows a lane and fingerprint: small partitions, so that a task sorts little at once
    parts = lanes * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = variants(prints, radius, lanes).repartition(parts, "key").sortWithinPartitions("key")
    found = rows.mapInPandas(run, ", ".join(f"{e} long" for e in ends))
    return found.select(_node(ends[:lanes]).alias("a"), _node(ends[lanes:]).alias("b"))


def _node(names: list[str]):
    return F.xxhash64(*names) if len(names) > 1 else F.col(names[0])


def classes(
    docs: DataFrame,
    shingle: int,
    radius: int,
    id_col: str = "doc_id",
    text: str = "text",
    lanes: int = 1,
    within: int | None = None,
) -> DataFrame:
    """(id, lanes, component_id) per row: its fingerprint and the smallest id reachable by links."""
    names = lane_names(lanes)
    marked = docs.select(F.col(id_col), fingerprints(F.col(text), shingle, lanes).alias("_f"))
    prints = checkpoint(marked.select(id_col, "_f.*"))
    distinct = checkpoint(prints.groupBy(*names).agg(F.min(id_col).alias("_id")))
    roots = components(links(distinct.select(*names), radius, lanes, within))
    rooted = distinct.withColumn("node", _node(names)).join(roots, "node", "left")
    rooted = checkpoint(rooted.select(*names, "_id", F.coalesce("root", "node").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(*names, "component_id")
    return prints.join(named, names).select(id_col, *names, "component_id")


def hexadecimal(fp):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
