"""A bounded, repeatable sample of labelled documents, streamed through one training task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_OUT_FOLDS = 5


def free_name(taken: list[str], name: str) -> str:
    """A column name that is not taken, whatever its letter case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, epochs: int) -> DataFrame:
    """(y, text) of at most `max_labelled` labelled documents, `epochs` times, in hash order.

    The sample is the labelled ids with the smallest hashes, so it is the same in every
    run and at most `max_labelled` ids are broadcast.  Ids with contradicting labels and
    null labels are left out.  An id that stands at several texts counts once, with the text of
    the smallest hash, so the bound holds for rows as well.  Null texts and other columns, of
    any name, have no effect beyond that a null text is a row without words.
    """
    wanted = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("most"))
        .where("y = most")
        .select(F.col("doc_id").alias("id"), "y", F.xxhash64("doc_id").alias("turn"))
        .orderBy("turn", "id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    chosen = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return (
        texts.join(F.broadcast(wanted), "id")
        .groupBy("id", "y", "turn")
        .agg(chosen)
        .repartition(1)
        .select("y", "one.text", "turn", "one.h", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
        .sortWithinPartitions("epoch", "turn", "h")
        .select("y", "text")
    )


def train_once(rows: DataFrame, fit: Callable[[Iterator[pd.DataFrame]], bytes]) -> bytes:
    """Run `fit` over the ordered rows in one task; its model comes back as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"model": [fit(batches)]})

    got = rows.mapInPandas(run, "model binary").head()
    return bytes(got["model"]) if got else fit(iter([]))  # no row: the model before any update
