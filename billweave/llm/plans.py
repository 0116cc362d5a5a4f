"""The queries op1 to op13 over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import (
    curriculum,
    divergence,
    infill,
    labelled,
    licenses,
    neighbours,
    packing,
    pages,
    quality,
    rans,
    simhash,
    subspace,
    toxicity,
    transducer,
)
from billweave.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _classified(spark: SparkSession, folder: str, operator, threshold: float) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = operator.train(docs, table(spark, folder, "labels"))
    return operator.with_score(docs, model).select(
        "doc_id",
        labelled.held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, quality, 0.3)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, toxicity, 0.5)


#: weights 3, 1, 2 in the mean: the first falls, the second stays, the third rises
SCHEDULES = [[(0.0, 4.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]]


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = curriculum.by_position(curriculum.mix(docs, SCHEDULES))
    first = F.get("copies", F.lit(0))["position"].alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first)


@query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.classes(docs, shingle=3, radius=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("matches")


ORACLES["op10_licenses"] = licenses.oracle()


@query
def op2_rans(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = run_dir(spark, "ids")
    encoder = rans.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), markers=True)
    rans.write(table(spark, folder, "documents").select("doc_id", "text"), path, encoder)
    return rans.read_digests(spark, path)


@query
def op8_subspace(spark: SparkSession, folder: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(rows, F.col("vec_id") % 50 == 0, k=5)


@query
def op5_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select("page_id", "url", pages.extract(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op9_transducer(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = transducer.Transducer(transducer.read_spec(public_tokenizers.path("piece_bpe_32k.model")))
    coded = transducer.token_columns(spark, F.col("text"), model, ("n_tokens", "ids_crc32", "round_trip"))
    return table(spark, folder, "documents").select("doc_id", coded.alias("_t")).select("doc_id", "_t.*")


@query
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    encoder = rans.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), markers=True)
    found = packing.pieces(table(spark, folder, "documents").select("doc_id", "text"), encoder)
    return packing.packed(found)


@query
def op12_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.transform(table(spark, folder, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


ORACLES["op12_infill"] = infill.oracle()


@query
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


ORACLES["op13_divergence"] = divergence.oracle()
