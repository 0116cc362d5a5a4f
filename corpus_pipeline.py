"""The corpus pipeline: from raw documents to token ids in training order.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; its result is written
as Parquet and read again as the next stage's docs.  All but the last return the columns of
docs.  Null and empty texts are scored, grouped and mixed like the operators say; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import curriculum, overlaps, quality, simhash, toxicity, transducer
from billweave.llm.labelled import free_name
from billweave.llm.plans import SCHEDULES, table
from billweave.session import run_dir, text_batches

KEEP_QUALITY = 0.3
REJECT_TOXIC = 0.5
# words of a shingle and differing bits of linked fingerprints, as in op7_simhash
PRINT_SHINGLE, PRINT_RADIUS = 3, 3
# words of a shingle; Jaccard similarity of the shingle sets of near duplicates
SHINGLE, SIMILARITY = 5, 0.8
TOKENIZER = "piece_bpe_32k.model"
# rows that go to Python at a time: the workers stay over all stages and keep their largest size
BATCH = 2000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject; all
    documents if no label is usable."""
    text_batches(spark, BATCH)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    score = free_name(docs.columns, "score")
    return quality.with_score(docs, model, out=score).where(F.col(score) >= KEEP_QUALITY).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject; all
    documents if no label is usable."""
    text_batches(spark, BATCH)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    score = free_name(docs.columns, "score")
    return toxicity.with_score(docs, model, out=score).where(F.col(score) < REJECT_TOXIC).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, linked by an exact similarity of 0.8: that
    with the smallest id.

    Candidates are the documents of a class of linked SimHash fingerprints; what those blur,
    the bands of `overlaps` find.  The exact similarity decides on all of them.

    A document is an id and a text, so unlike texts under one id are documents of their own.
    Of rows that repeat both, the one with the smallest other columns stays.  Documents
    without an id stay.
    """
    text_batches(spark, BATCH)
    key = free_name(docs.columns, "key")
    copies = free_name([*docs.columns, key], "copies")
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("h")))
    texts = keyed.select(F.col(key).alias("doc"), "text")
    prints = simhash.classes(texts, PRINT_SHINGLE, PRINT_RADIUS, id_col="doc")
    linked = prints.select("doc", F.xxhash64("component_id").alias("key"))
    found = overlaps.classes(texts, SHINGLE, SIMILARITY, id_col="doc", also=linked)
    kept = found.where("doc = component_id").groupBy(F.col("doc").alias(key)).agg(F.count(F.lit(1)).alias(copies))
    rows = keyed.join(kept, key)
    single = rows.where(F.col(copies) == 1).select(*docs.columns)
    if kept.where(F.col(copies) > 1).limit(1).count():
        whole = F.struct(*[F.col(c) for c in docs.columns])
        repeated = rows.where(F.col(copies) > 1).groupBy(key).agg(F.min(whole).alias("one"))
        single = single.union(repeated.select("one.*"))
    return single.union(docs.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, as often as it takes them.  The copy in
    which a source's target is met is kept if the mix takes half of its words."""
    mixed = curriculum.mix(docs, SCHEDULES)
    use = free_name(docs.columns, "use")
    ordered = curriculum.in_order(docs, mixed, use)
    return ordered.where(2 * F.col(f"{use}.words") >= F.col(f"{use}.size")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, in its order."""
    text_batches(spark, BATCH)
    model = transducer.Transducer(transducer.read_spec(public_tokenizers.path(TOKENIZER)))
    coded = transducer.token_columns(spark, F.col("text"), model, ("n_tokens", "ids"))
    return docs.select("doc_id", coded.alias("_t")).select("doc_id", "_t.n_tokens", "_t.ids")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("token ids", token_stage),
]

#: The models, fingerprints and tokens are not expressible in SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
