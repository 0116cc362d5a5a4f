"""Writers for records, summaries, charges and collection reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.billing import charge_cells
from ..operators.extract import RECORD_FIELDS, sanitize_records
from ..operators.report import SUMMARY_FIELDS, record_cells, summary_cells


def _csv(df: DataFrame, path: str, compression: str = "none") -> None:
    writer = df.write.mode("overwrite").option("header", "true").option("escape", '"')
    writer.option("emptyValue", "").option("nullValue", "").csv(path, compression=compression)


def write_records_json(records: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines, sanitised; NULL fields are written.

    Field names repeat in each line: "gzip" takes a ninth of the space, and a file is then read
    by one task.
    """
    out = sanitize_records(records.select(*RECORD_FIELDS))
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_records_csv(records: DataFrame, path: str, compression: str = "none") -> None:
    _csv(record_cells(sanitize_records(records.select(*RECORD_FIELDS))), path, compression)


def write_summary_csv(totals: DataFrame, path: str) -> None:
    """Three rows by construction, so one file."""
    _csv(summary_cells(totals).coalesce(1), path)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{f}` string" for f in SUMMARY_FIELDS)
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_charges_csv(charges: DataFrame, path: str) -> None:
    _csv(charge_cells(charges), path)


def write_receipts_csv(candidates: DataFrame, path: str) -> None:
    fields = (
        "event_time",
        "date_time_in_timezone",
        "transaction_id",
        "currency",
        "amount_minor",
        "amount",
        "suggested_filename",
    )
    have = set(candidates.columns)
    _csv(
        candidates.select(
            *[
                F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f)
                if f in have
                else F.lit("").alias(f)
                for f in fields
            ]
        ),
        path,
    )


def write_collection(decisions: DataFrame, path: str) -> None:
    """Saved, rejected and all candidates of a collection run, one folder per decision."""
    stamped = decisions.withColumn("ts", F.current_timestamp())
    stamped.write.mode("overwrite").partitionBy("decision").json(path)


def write_messages_csv(rows: DataFrame, path: str) -> None:
    """Result rows; list cells are joined by "; " with structs as JSON."""
    out = []
    for f in rows.schema.fields:
        kind, col = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith("array<struct"):
            col = F.array_join(F.transform(col, lambda x: F.to_json(x)), "; ")
        elif kind.startswith("array"):
            col = F.array_join(col, "; ")
        elif kind.startswith("struct"):
            col = F.to_json(col)
        out.append(col.alias(f.name))
    _csv(rows.select(*out), path)


def write_control_table(table: DataFrame, folder: str, name: str) -> None:
    """Snapshot laid out by tenant, newest first inside a file, like the tenant indexes."""
    newest = "created_at" if "updated_at" not in table.columns else "updated_at"
    (
        table.repartition("tenant_id", F.pmod(F.xxhash64("id"), F.lit(16)))
        .sortWithinPartitions("tenant_id", F.desc(newest))
        .write.mode("overwrite")
        .partitionBy("tenant_id")
        .parquet(f"{folder}/{name}")
    )
