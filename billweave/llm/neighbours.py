"""Approximate nearest neighbours by cosine over balanced posting lists.

Index: a bounded sample is split into balanced clusters; their centroids, at most `max_lists`,
and a graph over them are the in-memory part.  Every vector of the table goes to the lists
whose centroid is at most `boundary` times as far as the nearest one, `replicas` at most.
Search: the graph finds the centroids at most `ratio` times as far from the query as the
nearest; all their lists are read, however many they are.  Distances are those of unit
vectors.  The walk expands every centroid within the ratio and stops when none is left.

Lists and the queries that read them are cut into pieces of `chunk` rows that meet pair by
pair, so no task holds a whole list.  Equal vectors are one row with their k + 1 smallest ids:
no more of them can be among k neighbours.  Candidates are scored in double precision on the
original vectors.

Vectors that are null, zero, of another length than the most common one or hold null or
non-finite components take no part.  Ties go to smaller ids.  A query's own id is never among
its neighbours, whatever row holds it; rows with equal ids count once.  An empty table gives
no rows.  Only the id and vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm import vectors
from billweave.session import checkpoint


@dataclass(frozen=True)
class Index:
    """Settings; `sample` bounds the vectors that the centroids are fitted on."""

    sample: int = 20_000
    list_rows: int = 400
    max_lists: int = 4096
    replicas: int = 4
    boundary: float = 1.05
    ratio: float = 1.3
    degree: int = 16
    chunk: int = 8192
    seed: int = 11


def _split(x: np.ndarray, ways: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of `ways` clusters of nearly equal size."""
    centres = x[rng.choice(len(x), ways, replace=False)]
    room = -(-len(x) // ways)
    owner = np.zeros(len(x), np.int64)
    for _ in range(5):
        near = x @ centres.T
        owner[:] = -1
        left = np.full(ways, room)
        # rows that lose most by a second choice choose first
        top = np.sort(near, axis=1)
        regret = top[:, -1] - top[:, -2] if ways > 1 else top[:, -1]
        for i in np.argsort(-regret, kind="stable"):
            for c in np.argsort(-near[i], kind="stable"):
                if left[c]:
                    owner[i] = c
                    left[c] -= 1
                    break
        centres = np.stack([x[owner == c].sum(0) if (owner == c).any() else centres[c] for c in range(ways)])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1)), 1e-12)[:, None]
    return [np.flatnonzero(owner == c) for c in range(ways)]


def centroids(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of balanced clusters, by splitting the largest again and again."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    work, done = [(np.arange(len(x)), lists)], []
    while work:
        rows, want = work.pop()
        if want == 1:
            done.append(rows)
            continue
        ways = min(8, want, len(rows))
        parts = [p for p in _split(x[rows], ways, rng) if len(p)]
        shares = [want // len(parts) + (k < want % len(parts)) for k in range(len(parts))]
        work += [(rows[p], min(max(1, s), len(p))) for p, s in zip(parts, shares)]
    c = np.stack([x[rows].sum(0) for rows in done])
    return c / np.maximum(np.sqrt((c * c).sum(1)), 1e-12)[:, None]


class Graph:
    """Centroids with links to their nearest others, and one ring through all of them."""

    def __init__(self, centres: np.ndarray, degree: int):
        self.centres = centres
        n = len(centres)
        near = np.empty((n, min(degree, n)), np.int64)
        for at in range(0, n, 512):
            near[at : at + 512] = np.argsort(-(centres[at : at + 512] @ centres.T), axis=1, kind="stable")[:, : near.shape[1]]
        ring = (np.arange(n)[:, None] + np.array([1, n - 1, n // 2])) % n
        self.links = np.concatenate([near, ring], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def within(self, x: np.ndarray, ratio: float, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of the centroids at most `ratio` times as far as the nearest found,
        nearest first.  Per row, the nearest unexpanded centroid is expanded until `least` are
        and none within the ratio is left."""
        n, rows = len(self.centres), np.arange(len(x))
        far = np.full((len(x), n), np.inf)  # distance, where known
        far[:, self.entries] = self._distance(x, np.broadcast_to(self.entries, (len(x), len(self.entries))))
        open_ = far.copy()  # the same, where not yet expanded
        live, turn = rows, 0
        while len(live):
            best = open_[live].argmin(1)
            gap = open_[live, best]
            go = np.isfinite(gap) & ((gap <= ratio * far[live].min(1)) | (turn < least))
            live, best = live[go], best[go]
            open_[live, best] = np.inf
            reach = self.links[best]
            new = np.isinf(far[live[:, None], reach])
            gaps = np.where(new, self._distance(x[live], reach), 0)
            r, c = np.broadcast_to(live[:, None], reach.shape)[new], reach[new]
            far[r, c] = open_[r, c] = gaps[new]
            turn += 1
        order = np.argsort(far, axis=1, kind="stable")
        ranked = np.take_along_axis(far, order, 1)
        row, rank = np.nonzero(ranked <= ratio * ranked[:, :1])
        return row, order[row, rank]

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ikj->ik", x, self.centres[at]), 0))


def fit(vecs: DataFrame, s: Index) -> np.ndarray:
    """Centroids from the `sample` vectors with the smallest hashes, in one task."""
    lists = int(min(s.max_lists, max(1, vecs.count() // s.list_rows)))
    sample = vecs.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(s.sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            rows = pd.concat(rows)
            c = centroids(vectors.units(rows.sort_values("rep")["v"]), lists, s.seed)
            yield pd.DataFrame({"size": [c.shape[1]], "centres": [c.astype("<f8").tobytes()]})

    got = sample.repartition(1).mapInPandas(run, "size int, centres binary").head()
    return np.frombuffer(got["centres"], "<f8").reshape(-1, got["size"]) if got else np.zeros((0, 1))


def _to_lists(vecs: DataFrame, graph, ratio: float, replicas: int | None) -> DataFrame:
    """(list, rep, ids, v): the vectors with the lists that they belong to or read."""
    schema = "list int, rep long, ids array<long>, v " + vecs.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024]
                row, lists = graph.value.within(vectors.units(some["v"]), ratio)
                if replicas:
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    row, lists = row[rank < replicas], lists[rank < replicas]
                yield some.iloc[row].assign(list=lists)[["list", "rep", "ids", "v"]]

    return vecs.select("rep", "ids", "v").mapInPandas(run, schema)


def search(
    rows: DataFrame, is_query: Column, k: int, settings: Index = Index(), id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row, nearest first."""
    s, spark = settings, rows.sparkSession
    good = vectors.usable(rows.where(F.col(id_col).isNotNull()), vector)
    vecs = checkpoint(vectors.distinct(good.select(id_col, vector), k + 1, id_col, vector))
    queries = good.where(is_query).select(F.col(id_col).alias("query_id"), F.col(vector).alias("v"), F.xxhash64(vector).alias("_h")).distinct()
    asked = queries.join(vecs.select("rep", F.col("v").alias("_v"), F.xxhash64("v").alias("_g")), (F.col("_h") == F.col("_g")) & (F.col("v") == F.col("_v")))
    asked = checkpoint(asked.select("query_id", "rep"))

    centres = fit(vecs, s)
    graph = spark.sparkContext.broadcast(Graph(centres, s.degree))
    postings = checkpoint(_to_lists(vecs, graph, s.boundary, s.replicas))
    wanted = vecs.join(asked.select("rep").distinct(), "rep")
    reads = checkpoint(_to_lists(wanted, graph, s.ratio, None))

    # one row a list: at most `max_lists`
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("p")).join(
        reads.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list"
    )
    pieces = sizes.select("list", F.ceil(F.col("p") / s.chunk).alias("np"), F.ceil(F.col("q") / s.chunk).alias("nq"))

    def spread(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("rep"), F.col(own))
        partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        df = df.join(F.broadcast(pieces), "list").select("list", "rep", "ids", "v", mine.alias(own), partner.alias(other))
        return df.select("list", "np", "nq", "rep", "ids", "v", F.lit(side).alias("side"))

    met = spread(postings, "np", "nq", 0).union(spread(reads, "nq", "np", 1))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        from_list, asking = rows[rows["side"] == 0], rows[rows["side"] == 1]
        out = []
        if len(from_list) and len(asking):
            p, q = vectors.units(from_list["v"]), vectors.units(asking["v"])
            ids, reps = list(from_list["ids"]), asking["rep"].to_numpy()
            for at in range(0, len(q), 512):
                near = q[at : at + 512] @ p.T
                kth = np.partition(near, -min(k + 1, near.shape[1]), axis=1)[:, -min(k + 1, near.shape[1])]
                a, b = np.nonzero(near >= kth[:, None] - 1e-12)
                score = np.einsum("ij,ij->i", q[at + a], p[b])
                n = np.array([len(ids[j]) for j in b])
                found = pd.DataFrame(
                    {"rep": np.repeat(reps[at + a], n), "vec_id": np.concatenate([ids[j] for j in b]), "score": np.repeat(score, n)}
                ).sort_values(["rep", "score", "vec_id"], ascending=[True, False, True])
                out.append(found.groupby("rep").head(k + 1))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "vec_id": [], "score": []})

    found = met.groupBy("list", "np", "nq").applyInPandas(meet, "rep long, vec_id long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1)
    nearest = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_k", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(checkpoint(nearest), "rep")
        .select("query_id", F.posexplode(others).alias("_at", "_x"))
        .select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))
    )
