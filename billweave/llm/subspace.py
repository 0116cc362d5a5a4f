"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart.  After a rotation the coordinates are cut
into blocks of few dimensions; in one block at least, two linked vectors lie within that
block's share of the squared distance, in proportion to its dimensions.  Every block is
range-joined: its leading coordinates make a grid with cells as wide as the share's root, and
a cell meets itself and its neighbours.  Candidates of the union of the blocks are verified on
the original vectors in double precision.  A pair is counted in the first block in which its
distance keeps the share, so no pair is counted twice and none has to be written out.

The vectors are cut into pieces of some `chunk` vectors, each stored once as one row, and every
two pieces meet in one step, which joins all blocks: a piece's vectors are sorted by cell, so
that a cell finds its neighbours in runs.  Two pieces are what a step holds, whatever the data.
The meetings are a product of two scans of the stored pieces: no vector is copied to a shuffle,
so disk grows with the rows, not with their square.  Equal vectors are one row of the join with
their count.

Vectors that are null, zero, of another length than the most common one or hold null or
non-finite components link with nothing.  Rows with equal ids count each for itself.  Output
columns are those documented; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from billweave.llm import vectors
from billweave.llm.components import components
from billweave.session import checkpoint

BLOCK_DIMS = 8
GRID_DIMS = 2
_TILE, _SLICE = 1024, 20_000
# single precision errs by less: squared distances in a block, and in all of them
_SLACK, _WHOLE_SLACK = 1e-5, 1e-3


class Plan:
    """Blocks, shares and grid of a threshold."""

    def __init__(self, threshold: float, size: int, block_dims: int, grid_dims: int):
        self.threshold = threshold
        self.dims = min(block_dims, size)
        self.n_blocks = size // self.dims
        # a little more than the share, for the rounding of the rotation
        self.share = (2 - 2 * threshold) * self.dims / size * (1 + 1e-9) + 1e-12
        self.width = float(np.sqrt(self.share))
        self.grid = min(grid_dims, self.dims)
        # above the number of cells along a coordinate, and of the neighbours beside them
        self.base = 2 * int(np.ceil(1 / self.width)) + 5

    def cells(self, r: np.ndarray) -> np.ndarray:
        """(row, block, grid coordinate)."""
        blocks = r.reshape(len(r), self.n_blocks, self.dims)[:, :, : self.grid]
        return np.floor(blocks / self.width).astype(np.int64)

    def distances(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Squared distances of row pairs in a block, summed in a fixed order."""
        total = np.zeros(len(a))
        for d in range(block * self.dims, (block + 1) * self.dims):
            gap = a[:, d] - b[:, d]
            total += gap * gap
        return total

    def verified(self, a: Piece, b: Piece, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the linked pairs, each in the first block in which it keeps the share."""
        for block in range(self.n_blocks):
            for x, y in _batches(self.candidates(a.blocks[block], b.blocks[block], same)):
                gap = a.rough[x] - b.rough[y]
                near = np.einsum("ij,ij->i", gap, gap) <= 2 - 2 * self.threshold + _WHOLE_SLACK
                x, y = x[near], y[near]
                near = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= self.threshold
                x, y = x[near], y[near]
                first = self.distances(a.rotated[x], b.rotated[y], block) <= self.share
                for earlier in range(block):
                    first &= self.distances(a.rotated[x], b.rotated[y], earlier) > self.share
                yield x[first], y[first]

    def candidates(self, a: Sorted, b: Sorted, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the pairs of neighbouring cells that may keep the share in a block."""
        limit = np.float32(self.share + _SLACK)
        steps = [s for s in product((-1, 0, 1), repeat=self.grid - 1) if not same or s >= (0,) * len(s)]
        for i, key in enumerate(a.keys):
            own = slice(a.starts[i], a.starts[i + 1])
            for step in steps:
                # the last coordinate of the neighbours is a run of keys; a cell meets itself once
                middle = key + sum(s * self.base ** (self.grid - 1 - d) for d, s in enumerate(step))
                onward = same and not any(step)
                lo, hi = np.searchsorted(b.keys, (middle if onward else middle - 1, middle + 2))
                lo, hi = b.starts[lo], b.starts[hi]
                for s in range(own.start, own.stop, _TILE):
                    tile = slice(s, min(s + _TILE, own.stop))
                    for t in range(max(lo, s) if onward else lo, hi, _TILE):
                        other = slice(t, min(t + _TILE, hi))
                        rough = a.left[tile] @ b.right[other].T
                        x, y = np.divmod(np.flatnonzero(rough.ravel() <= limit), rough.shape[1])
                        x, y = x + s, y + t
                        if onward:
                            x, y = x[x < y], y[x < y]
                        if len(x):
                            yield a.order[x], b.order[y]


class Sorted:
    """A piece's vectors in the order of their cells in one block: `left` times `right` are
    squared distances."""

    def __init__(self, plan: Plan, r: np.ndarray, cells: np.ndarray):
        keys = np.zeros(len(r), np.int64)
        for d in range(plan.grid):
            keys = keys * plan.base + cells[:, d]
        self.order = np.argsort(keys, kind="stable")
        self.keys, starts = np.unique(keys[self.order], return_index=True)
        self.starts = [*starts.tolist(), len(r)]
        x = r[self.order]
        norm, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
        self.left = np.hstack([-2 * x, norm, one]).astype(np.float32)
        self.right = np.hstack([x, one, norm]).astype(np.float32)


class Piece:
    """Stored vectors, made ready to meet others."""

    def __init__(self, plan: Plan, row: dict, kind: str):
        self.number = row["piece"]
        self.reps = np.frombuffer(row["reps"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.unit = vectors.units(np.frombuffer(row["v"], kind).reshape(len(self.reps), -1))
        self.rotated = vectors.rotated(self.unit)
        self.rough = self.rotated.astype(np.float32)
        cells = plan.cells(self.rotated)
        own = self.rotated[:, : plan.n_blocks * plan.dims].reshape(len(cells), plan.n_blocks, plan.dims)
        self.blocks = [Sorted(plan, own[:, k], cells[:, k]) for k in range(plan.n_blocks)]


def _batches(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs, some _SLICE at a time."""
    held, n = [], 0
    for x, y in pairs:
        for s in range(0, len(x), _SLICE):
            held.append((x[s : s + _SLICE], y[s : s + _SLICE]))
            n += len(held[-1][0])
            if n >= _SLICE:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of classes (parent: the smallest known member) along the pairs."""
    while True:
        pa, pb = parent[a], parent[b]
        differ = pa != pb
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(pa, pb)[differ], np.minimum(pa, pb)[differ])
        while (parent != parent[parent]).any():
            parent = parent[parent]


def links(
    vecs: DataFrame, threshold: float, length: int, block_dims: int, grid_dims: int, chunk: int
) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and edges (a, b) that keep the classes, for distinct vectors (rep, n, v)."""
    plan = Plan(threshold, 1 << max(0, length - 1).bit_length(), block_dims, grid_dims)
    kind = "f4" if isinstance(vecs.schema["v"].dataType.elementType, FloatType) else "f8"
    vecs = vecs.where("rep is not null")
    pieces = max(1, -(-vecs.count() // chunk))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        reps, counts = rows["rep"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        v = np.array(rows["v"].tolist(), kind)
        return pd.DataFrame({"piece": [key[0]], "reps": [reps.tobytes()], "counts": [counts.tobytes()], "v": [v.tobytes()]})

    stored = checkpoint(
        vecs.select(F.pmod(F.xxhash64("rep"), F.lit(pieces)).cast("int").alias("piece"), "rep", "n", "v")
        .repartition(pieces, "piece")
        .groupBy("piece")
        .applyInPandas(pack, "piece int, reps binary, counts binary, v binary")
    )
    # one side as `other`, by select: a product of the same table with itself
    other = stored.select(F.struct(*stored.columns).alias("other"))
    pairs = stored.hint("shuffle_replicate_nl").join(other, F.col("piece") <= F.col("other.piece"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            for row in batch.to_dict("records"):
                if last is None or last.number != row["piece"]:
                    last = Piece(plan, row, kind)
                a, same = last, row["other"]["piece"] == row["piece"]
                b = a if same else Piece(plan, row["other"], kind)
                n = a.counts if same else np.concatenate([a.counts, b.counts])
                ids = a.reps if same else np.concatenate([a.reps, b.reps])
                found, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for x, y in plan.verified(a, b, same):
                    y = y if same else y + len(a.reps)
                    found += np.bincount(x, n[y], len(ids)).astype(np.int64)
                    found += np.bincount(y, n[x], len(ids)).astype(np.int64)
                    parent = _merge(parent, x, y)
                own = np.flatnonzero(found)
                yield pd.DataFrame({"rep": ids[own], "links": found[own], "head": ids[parent[own]]})

    met = checkpoint(pairs.mapInPandas(meet, "rep long, links long, head long"))
    return met.groupBy("rep").agg(F.sum("links").alias("links")), met.select(F.col("rep").alias("a"), F.col("head").alias("b"))


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.9,
    block_dims: int = BLOCK_DIMS,
    grid_dims: int = GRID_DIMS,
    chunk: int = 8192,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) per row, for links of cosine >= threshold > 0."""
    rows = rows.select(F.col(id_col), F.col(vector))
    good = vectors.usable(rows, vector)
    vecs = checkpoint(vectors.distinct(good, 1, id_col, vector).select("rep", "n", "v"))
    some = vecs.head()
    degrees, edges = links(vecs, threshold, len(some["v"]) if some else 1, block_dims, grid_dims, chunk)
    known = (
        vecs.join(degrees, "rep", "left")
        .join(components(edges).withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.xxhash64("v").alias("_h"),
            "v",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    out = rows.withColumn("_h", F.xxhash64(vector)).join(known.withColumnRenamed("_h", "_g"), (F.col("_h") == F.col("_g")) & (F.col(vector) == F.col("v")), "left")
    component = F.coalesce("component_id", F.col(id_col)).alias("component_id")
    return out.select(
        id_col,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component,
        (F.col(id_col) == F.coalesce("component_id", F.col(id_col))).alias("kept"),
    )
