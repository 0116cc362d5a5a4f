"""Scans: document folders, landed messages, attachments, run manifests, control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as tx
from ..functions.dates import checked_window
from .files import content_of, list_files


def outside_folders(path: Column, folders=R.SKIP_DIRS) -> Column:
    """No directory of the path has one of the names."""
    return ~F.regexp_like(path, F.lit("/(?:" + "|".join(folders) + ")/"))


def has_extension(path: Column, extensions) -> Column:
    """Extension test without case; no extensions means all files."""
    wanted = [("" if e.startswith(".") else ".") + e.lower() for e in extensions]
    if not wanted:
        return F.lit(True)
    return F.lower(tx.file_extension(tx.file_name(path))).isin(*wanted)


def scan_documents(
    spark: SparkSession, root: str, extensions=("pdf",), skip_folders=R.SKIP_DIRS
) -> DataFrame:
    """All files below a folder: path, length, modificationTime, content.

    The content column is read only when it is used.  Spark's reader takes the files it sees;
    those it passes over, with names or folders that start with "_" or ".", come from a listing
    of the folder.
    """
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    passed = list_files(spark, root, skip_folders).join(seen.select("path"), "path", "left_anti")
    files = seen.unionByName(passed.withColumn("content", content_of(F.col("path"))))
    if skip_folders:
        files = files.where(outside_folders(F.col("path"), skip_folders))
    return files.where(has_extension(F.col("path"), extensions))


def select_files(files: DataFrame, wanted: DataFrame, root: Column) -> tuple[DataFrame, DataFrame]:
    """Files named in wanted(name) and the names that do not exist.

    Relative names are taken below root.
    """
    absolute = F.when(
        F.regexp_like("name", F.lit(r"\A(?:/|[A-Za-z][A-Za-z0-9+.\-]*:)")), F.col("name")
    ).otherwise(F.concat(root, F.lit("/"), F.col("name")))
    named = wanted.select("name", absolute.alias("path"))
    found = files.join(named.select("path").distinct(), "path", "left_semi")
    missing = named.join(files.select("path"), "path", "left_anti")
    return found, missing


def scan_messages(
    messages: DataFrame,
    start: str,
    end: str,
    exclude_folders=(),
    page_size: int = 50,
    max_pages: int | None = None,
) -> DataFrame:
    """Messages received in [start, end), newest first, eight columns.

    With max_pages only the first page_size * max_pages of them, for a listing on request.
    """
    lower, upper = checked_window(start, end)
    rows = messages.where((F.col("received") >= lower) & (F.col("received") < upper))
    excluded = [f for f in exclude_folders if f]
    if excluded:
        rows = rows.where(~F.col("parent_folder").isin(*excluded))
    rows = rows.select(
        "message_id",
        "subject",
        "sender",
        "received",
        "has_attachments",
        "web_link",
        "preview",
        "parent_folder",
    ).orderBy(F.desc_nulls_last("received"), "message_id")
    return rows if max_pages is None else rows.limit(page_size * max_pages)


def message_fields(raw: DataFrame) -> DataFrame:
    """Landed mail JSON (nested sender) to the message columns, blanks for missing text."""

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    return raw.select(
        F.col("id").alias("message_id"),
        blank("subject").alias("subject"),
        blank("bodyPreview").alias("preview"),
        blank("from.emailAddress.address").alias("sender"),
        F.col("receivedDateTime").try_cast("timestamp").alias("received"),
        F.col("webLink").alias("web_link"),
        F.coalesce(F.col("hasAttachments"), F.lit(False)).alias("has_attachments"),
        F.col("parentFolderId").alias("parent_folder"),
    )


def header_map(headers: Column) -> Column:
    """Lower-cased header names; the last value of a repeated header wins."""
    pairs = F.transform(
        headers,
        lambda h: F.struct(
            F.lower(F.coalesce(h["name"], F.lit(""))).alias("k"),
            F.coalesce(h["value"], F.lit("")).alias("v"),
        ),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.try_element_at(
                F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), F.lit(-1)
            ),
        ),
    )


def attachment_listing(attachments: DataFrame, with_content: bool = False) -> DataFrame:
    """Attachment metadata; the content column is left out of the scan unless asked for."""
    columns = ["message_id", "attachment_id", "name", "content_type", "size"]
    return attachments.select(*columns, *(["content"] if with_content else []))


def run_manifests(spark: SparkSession, base: str) -> DataFrame:
    """First run_summary.json below invoices_*: path, directory and status."""
    raw = spark.read.option("multiLine", "true").schema(
        "status string, consolidated_dir string"
    ).json(f"{base}/invoices_*/run_summary.json")
    named = raw.select("*", F.input_file_name().alias("summary_path"))
    first = named.agg(F.min(F.struct("summary_path", "status", "consolidated_dir")).alias("r"))
    return first.where("r is not null").select(
        "r.summary_path",
        F.coalesce(
            F.nullif("r.consolidated_dir", F.lit("")),
            F.regexp_replace("r.summary_path", "/[^/]*$", ""),
        ).alias("invoices_dir"),
        F.trim("r.status").alias("status"),
    )


def rule_config(spark: SparkSession, path: str) -> DataFrame:
    """Keyword sets and link rules of a search configuration file: section, name, value, ord.

    A rule file is one small document; it is parsed as one row and exploded.
    """
    schema = (
        "keyword_sets map<string,array<string>>, "
        "attachment_detection map<string,array<string>>, "
        "link_detection struct<url_keywords:array<string>,trusted_providers:array<string>>, "
        "scoring map<string,double>"
    )
    raw = spark.read.option("multiLine", "true").schema(schema).json(path)

    def listed(section: str, column: Column) -> DataFrame:
        return raw.select(F.explode(column).alias("name", "items")).select(
            F.lit(section).alias("section"), "name", F.posexplode("items").alias("ord", "value")
        )

    links = F.create_map(
        F.lit("url_keywords"),
        F.col("link_detection.url_keywords"),
        F.lit("trusted_providers"),
        F.col("link_detection.trusted_providers"),
    )
    weights = raw.select(F.explode("scoring").alias("name", "w")).select(
        F.lit("scoring").alias("section"),
        "name",
        F.lit(0).alias("ord"),
        F.col("w").cast("string").alias("value"),
    )
    return (
        listed("keyword_sets", F.col("keyword_sets"))
        .unionByName(listed("attachment_detection", F.col("attachment_detection")))
        .unionByName(listed("link_detection", links))
        .unionByName(weights)
    )


CONTROL_SCHEMAS = {
    "sessions": "id string, user_id string, email string, display_name string, "
    "tenant_id string, permissions_json string, created_at timestamp, last_seen_at timestamp",
    "provider_configs": "id string, tenant_id string, provider string, state string, "
    "connected boolean, account_email string, health string, last_sync_at timestamp, "
    "scopes_json string, created_at timestamp, updated_at timestamp",
    "collection_jobs": "id string, tenant_id string, status string, providers_json string, "
    "month int, year int, graph_client_id string, graph_authority string, "
    "graph_token_cache_path string, interactive_auth boolean, request_id string, "
    "run_summary_path string, invoices_dir string, retry_of string, error_text string, "
    "started_at timestamp, finished_at timestamp, created_at timestamp, updated_at timestamp",
    "reports": "id string, tenant_id string, status string, input_dir string, "
    "formats_json string, artifacts_json string, totals_json string, error_text string, "
    "started_at timestamp, finished_at timestamp, created_at timestamp, updated_at timestamp",
    "schedules": "id string, tenant_id string, name string, timezone string, cron string, "
    "providers_json string, status string, next_run_at timestamp, last_run_at timestamp, "
    "last_run_status string, created_at timestamp, updated_at timestamp",
    "audit_events": "id string, tenant_id string, action string, entity_type string, "
    "entity_id string, request_id string, message string, created_at timestamp",
}


def control_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A snapshot of a control table, written with its schema and partitioned by tenant."""
    return spark.read.schema(CONTROL_SCHEMAS[name]).parquet(f"{folder}/{name}")
