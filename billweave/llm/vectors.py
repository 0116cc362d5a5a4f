"""Embeddings as rows that can be compared, and numpy helpers whose results do not depend on
which other rows are handled at the same time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero and has finite components, of the most common
    length (the smaller of equally common ones)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = rows.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    common = kept.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").head()
    return kept.where(F.size(v) == (common["n"] if common else 0))


def distinct(rows: DataFrame, smallest: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rep, ids, n, v): equal vectors as one row, with their `smallest` smallest ids and count.

    Ranks are cut on the map side, so a vector with a third of all rows is no hot group.
    """
    h = F.xxhash64(vector)
    counted = rows.groupBy(h.alias("_h"), F.col(vector).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).alias("rep")
    )
    if smallest == 1:
        return counted.select("rep", F.array("rep").alias("ids"), "n", "v")
    order = Window.partitionBy("_h", "v").orderBy("_id")
    ranked = rows.select(h.alias("_h"), F.col(vector).alias("v"), F.col(id_col).alias("_id"))
    ranked = ranked.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= smallest)
    ids = ranked.groupBy("_h", "v").agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    return counted.join(ids, ["_h", "v"]).select("rep", "ids", "n", "v")


def units(column) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.stack([np.asarray(v, float) for v in column])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotated(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Random signs and a Walsh-Hadamard transform: a rotation made of additions, element by
    element, so that a row's result never depends on its neighbours.  Padded to a power of 2."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x * np.random.default_rng(seed).choice([-1.0, 1.0], x.shape[1])
    half = 1
    while half < size:
        pairs = out.reshape(len(x), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
        half *= 2
    return out / np.sqrt(size)
