"""Mixing sources to weights that change over the training run.

A source's schedule is a piecewise linear weight over training progress 0 to 1.  Its integral
is the source's weight; targets share the wanted words by these weights, stop at
`max_epochs` times the source's size, and pass the excess on to the others by weight (solved
in closed form: the sources fill up in the order of cap by weight).  A source's documents,
in hash order, are read again and again until the target is met; the place of a copy in that
stream is its cumulative demand, and the inverse of the source's integrated schedule turns
demand into training progress, the copy's position.

Running sums go through buckets of the hash, so a source with a third of all rows is summed
in many tasks.  Null texts have size 0, a null source is a source of its own, rows with equal
ids count each for itself, and no rows give no rows.  Long texts are counted whole; other
columns are not read by `mix` and stay in `in_order`, whatever their names.  Equal hashes are
ordered by id and size.  All results are functions of the rows alone: reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.labelled import free_name
from billweave.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 2_000  # rows in a hash bucket, about
Knots = list[tuple[float, float]]  # (progress, weight), from progress 0 to 1


def integral(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def inverse_demand(share: Column, knots: Knots) -> Column:
    """Training progress at which `share` (0 to 1) of a source's demand is met."""
    total, met, out = integral(knots), 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        rest = share * total - met
        slope = (w1 - w0) / (t1 - t0)
        # rest = w0 s + slope s^2 / 2, solved for s in the form that is stable for small slopes
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        step = F.when(root + w0 > 0, 2 * rest / (root + w0)).otherwise(0.0)
        pieces.append((met + area, F.lit(t0) + step))
        met += area
    for upto, place in reversed(pieces):
        out = F.when(share * total <= upto, place).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(totals: DataFrame, weight: Callable[[Column], Column], wanted_share: float, max_epochs: float) -> DataFrame:
    """(source, ..., place, weight, target) for source totals (source, source_size).

    `weight` gets the place of a source in code point order, null last, from 0.  One row per
    source: the windows run over that small table only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    listed = totals.withColumn("place", F.row_number().over(order) - 1)
    listed = listed.withColumn("weight", weight(F.col("place"))).withColumn(
        "_cap", F.lit(float(max_epochs)) * F.col("source_size")
    )
    filling = Window.orderBy(F.col("_cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(float(wanted_share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("_cap").over(filling), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
    # the first source, in filling order, that stays within its cap sets the level of the rest
    ranked = Window.orderBy(F.col("_cap") / F.col("weight"), "place")
    listed = listed.withColumn("_level", level).withColumn("_turn", F.row_number().over(ranked))
    within = F.col("_level") * F.col("weight") <= F.col("_cap")
    listed = listed.withColumn("_level", F.min_by("_level", F.when(within, F.col("_turn"))).over(everything))
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return listed.withColumn("target", target).drop("_cap", "_level", "_turn")


def mix(
    docs: DataFrame,
    schedules: list[Knots],
    wanted_share: float = 1.5,
    max_epochs: int = 2,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: (id, size, source, source_size, target, taken, copies).

    `schedules` repeat over the sources.  `copies` is an array of (epoch, words, position);
    a copy of fewer words than the document is the one in which the target is met.
    """
    sized = checkpoint(
        docs.select(
            F.col(id_col),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit("order"), id_col).alias("_h"),
        )
    )
    buckets = max(1, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    per_bucket = checkpoint(
        sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    totals = per_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    integrals = F.array(*[F.lit(integral(k)) for k in schedules])
    aims = checkpoint(
        targets(totals, lambda p: F.element_at(integrals, p % len(schedules) + 1), wanted_share, max_epochs)
    )
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    offsets = offsets.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    offsets = offsets.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_start", "source_size", "target", "place"
    )
    inside = (
        Window.partitionBy("source", "_bucket").orderBy("_h", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    copies = []
    for epoch in range(max_epochs):
        at = F.col("_start") + F.col("_in") + epoch * F.col("source_size")
        words = F.least("size", F.greatest(F.round("target").cast("long") - at, F.lit(0))).cast("long")
        share = F.when(F.col("target") > 0, at / F.col("target")).otherwise(0.0)
        position = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            position = F.when(F.col("place") % len(schedules) == k, inverse_demand(share, knots)).otherwise(position)
        copies.append(
            F.when(words > 0, F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), position.alias("position")))
        )
    listed = placed.select(
        id_col, "size", "source", "source_size", "target", F.array_compact(F.array(*copies)).alias("copies")
    )
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return listed.select(id_col, "size", "source", "source_size", "target", taken.alias("taken"), "copies")


def by_position(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of a mix in the order of their first use, range-partitioned; unused ones last."""
    first = F.get("copies", F.lit(0))["position"].asc_nulls_last()
    return mixed.repartitionByRange(first, F.col(id_col)).sortWithinPartitions(first, id_col)


def in_order(docs: DataFrame, mixed: DataFrame, use: str = "use", id_col: str = "doc_id") -> DataFrame:
    """The documents in training order, a row for each copy: joined by id, range-partitioned and
    sorted by position.  The column `use` has (position, epoch, words, size) of the copy; its
    name must not be one of docs."""
    if use in docs.columns:
        raise ValueError(f"{use} is a column of the documents")
    key = free_name([*docs.columns, use], "key")
    one = F.struct("copy.position", "copy.epoch", "copy.words", "size").alias(use)
    uses = mixed.select(F.col(id_col).alias(key), "size", F.explode("copies").alias("copy"))
    # rows with equal ids have uses of their own: any of them may stand for the id
    uses = uses.select(key, one)
    uses = uses.groupBy(key, F.col(f"{use}.epoch")).agg(F.min(use).alias(use)).select(key, use)
    joined = docs.join(uses, docs[id_col].eqNullSafe(F.col(key))).drop(key)
    order = [F.col(f"{use}.position"), F.col(f"{use}.epoch"), F.col(id_col)]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order)
