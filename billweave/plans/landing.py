"""Sinks and sources together: each query writes under the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import billing, relevance as rel, report
from ..operators.extract import RECORD_FIELDS
from ..session import run_dir
from ..sources import files, scan, sinks
from . import views as v
from .control import _CHARGE, charges
from .messages import _FLAGS
from .registry import query
from .reports import _TOTALS_SQL, _money, report_totals

_RECORD_TYPES = {
    **dict.fromkeys(("base_before_vat", "invoice_vat", "invoice_total", "breakdown_sum", "vat_rate"), "double"),
    **dict.fromkeys(("category_confidence", "parse_confidence"), "double"),
    "breakdown_values": "array<double>",
    "reference_numbers": "array<string>",
    "municipal": "boolean",
}
RECORD_SCHEMA = ", ".join(f"{f} {_RECORD_TYPES.get(f, 'string')}" for f in RECORD_FIELDS)


def full_records(spark, folder):
    """Records with all 25 fields; fields that the tables cannot fill are NULL in some rows."""
    inv = v.invoices(spark, folder)
    paid = F.col("invoice_total").isNotNull()
    returned = F.col("invoice_total") < 0
    named = {
        "currency": F.lit("ILS"),
        "breakdown_sum": F.col("base_before_vat"),
        "breakdown_values": F.when(paid, F.array("invoice_vat", "invoice_total")),
        "notes": F.when(returned, 'זיכוי, "החזר"'),
        "vat_rate": F.when(paid, F.lit(17.0)),
        "period_start": F.date_format(F.trunc("day", "month"), "yyyy-MM-dd"),
        "period_end": F.date_format(F.last_day("day"), "yyyy-MM-dd"),
        "period_label": F.date_format("day", "MM/yyyy"),
        "due_date": F.date_format(F.date_add("day", 30), "dd/MM/yyyy"),
        "category": F.when(F.col("suppkey") % 2 == 0, "goods"),
        "category_confidence": F.when(F.col("suppkey") % 2 == 0, F.lit(0.5)),
        "category_rule": F.lit(None).cast("string"),
        "reference_numbers": F.array(F.concat(F.lit("R"), "orderkey"), F.concat(F.lit("S"), "suppkey")),
        "data_source": F.lit("tables"),
        "parse_confidence": F.lit(0.75),
        "municipal": F.col("orderkey") % 2 == 0,
        "duplicate_hash": F.lit(None).cast("string"),
    }
    return inv.select(*[named[f].alias(f) if f in named else F.col(f) for f in RECORD_FIELDS])


_FULL_SQL = f"""{v.INV_SQL}, rec as (
  select source_file, invoice_id, invoice_date, invoice_from, invoice_for, base_before_vat, invoice_vat, invoice_total, 'ILS' as currency,
    base_before_vat as breakdown_sum, case when invoice_total is not null then invoice_vat end as value_1, invoice_total as value_2,
    case when invoice_total < 0 then 'זיכוי, "החזר"' end as notes, case when invoice_total is not null then 17.0 end as vat_rate,
    strftime(date_trunc('month', day), '%Y-%m-%d') as period_start, strftime(last_day(day), '%Y-%m-%d') as period_end,
    strftime(day, '%m/%Y') as period_label, strftime(cast(day + 30 as date), '%d/%m/%Y') as due_date,
    case when suppkey % 2 = 0 then 'goods' end as category, case when suppkey % 2 = 0 then 0.5 end as category_confidence,
    null::varchar as category_rule, 'R' || orderkey as reference_1, 'S' || suppkey as reference_2, 'tables' as data_source,
    0.75 as parse_confidence, orderkey % 2 = 0 as municipal, null::varchar as duplicate_hash from inv)"""
_DOUBLES = ("base_before_vat", "invoice_vat", "invoice_total", "breakdown_sum", "vat_rate", "category_confidence", "parse_confidence")
_PLAIN = [f for f in RECORD_FIELDS if f not in ("breakdown_values", "reference_numbers")]


@query(
    "records_json",
    f"with {_FULL_SQL} select "
    + ", ".join(f"cast({f} as double) as {f}" if f in _DOUBLES else f for f in _PLAIN)
    + ", cast(value_1 as double) as value_1, cast(value_2 as double) as value_2, reference_1, reference_2 from rec",
)
def records_json(spark, folder):
    path = run_dir(spark, "records-json")
    sinks.write_records_json(full_records(spark, folder), path, "gzip")
    back = spark.read.schema(RECORD_SCHEMA).json(path)
    return back.select(
        *_PLAIN,
        F.get("breakdown_values", F.lit(0)).alias("value_1"),
        F.get("breakdown_values", F.lit(1)).alias("value_2"),
        F.get("reference_numbers", F.lit(0)).alias("reference_1"),
        F.get("reference_numbers", F.lit(1)).alias("reference_2"),
    )


def read_cells(spark, path, fields):
    """A CSV folder as text cells, empty for missing ones."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").schema(schema).csv(path)
    return rows.select(*[F.coalesce(f, F.lit("")).alias(f) for f in fields])


def _cell(f: str) -> str:
    if f in _DOUBLES:
        return f"{_money(f)} as {f}"
    if f == "breakdown_values":
        return "case when value_2 is null then '' else '[' || cast(cast(value_1 as double) as varchar) || ',' || cast(cast(value_2 as double) as varchar) || ']' end as breakdown_values"
    if f == "reference_numbers":
        return """'["' || reference_1 || '","' || reference_2 || '"]' as reference_numbers"""
    return f"coalesce(cast({f} as varchar), '') as {f}"


@query("records_csv", f"with {_FULL_SQL} select " + ", ".join(map(_cell, RECORD_FIELDS)) + " from rec")
def records_csv(spark, folder):
    path = run_dir(spark, "records-csv")
    sinks.write_records_csv(full_records(spark, folder), path, "gzip")
    return read_cells(spark, path, RECORD_FIELDS)


@query(
    "summary_csv",
    f"with {v.INV_SQL}, t as ({_TOTALS_SQL}) select metric, "
    + ", ".join(f"{_money(c)} as {c}" for c in ("sum", "abs_sum", "min", "max", "avg"))
    + ", "
    + ", ".join(f"coalesce(cast({c} as varchar), '') as {c}" for c in ("count", "missing", "zero", "negative", "positive"))
    + " from t",
)
def summary_csv(spark, folder):
    path = run_dir(spark, "summary-csv")
    sinks.write_summary_csv(report_totals(spark, folder), path)
    back = sinks.read_summary_csv(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query(
    "net_vat_gross_from_csv",
    f"""with {v.INV_SQL} select cast(round(sum(invoice_total) - sum(invoice_vat), 2) as double) as net_total,
      cast(sum(invoice_vat) as double) as vat_total, cast(sum(invoice_total) as double) as gross_total from inv""",
)
def net_vat_gross_from_csv(spark, folder):
    path = run_dir(spark, "summary-csv")
    sinks.write_summary_csv(report_totals(spark, folder), path)
    return report.net_vat_gross(sinks.read_summary_csv(spark, path))


_CHARGE_CELLS = (*billing.CHARGE_FIELDS, "extra_data_json")


@query(
    "charges_csv",
    f"""select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as event_time, 'purchase' as event_type, cast(user_id as varchar) as actor_name, replace(props, ' ', '') as extra_data_json,
      {", ".join(f"'' as {f}" for f in billing.CHARGE_FIELDS if f not in ("event_time", "event_type", "actor_name"))} from events where {_CHARGE}""",
)
def charges_csv(spark, folder):
    path = run_dir(spark, "charges-csv")
    stamped = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    sinks.write_charges_csv(charges(spark, folder).withColumn("event_time", stamped), path)
    return read_cells(spark, path, _CHARGE_CELLS)


@query(
    "collection_json",
    f"""with {_FLAGS} select message_id, subject, case when not (has_attachments or (not neg and (pos or muni))) then 'skipped'
      when neg and not (pos or muni) then 'negative_context' else 'accepted' end as decision, true as stamped from f""",
)
def collection_json(spark, folder):
    """Decisions in one folder each, with the time of writing."""
    path = run_dir(spark, "collection")
    gated = rel.gate_messages(v.messages(spark, folder), v.TERMS)
    sinks.write_collection(gated.select("message_id", "subject", F.col("gate").alias("decision")), path)
    back = spark.read.schema("message_id string, subject string, ts timestamp, decision string").json(path)
    return back.select("message_id", "subject", "decision", F.col("ts").isNotNull().alias("stamped"))


@query(
    "messages_csv",
    f"""with {v.MSGS_SQL} select message_id, subject, cast(has_attachments as varchar) as has_attachments, parent_folder || '; ' || web_link as places,
      '{{"filename":"' || attachment_name || '"}}' as files from msgs""",
)
def messages_csv(spark, folder):
    """Result rows with list cells; subjects hold quotes, commas and other marks."""
    path = run_dir(spark, "messages-csv")
    rows = v.messages(spark, folder).select(
        "message_id",
        "subject",
        "has_attachments",
        F.array("parent_folder", "web_link").alias("places"),
        F.array(F.struct(F.col("attachment_name").alias("filename"))).alias("files"),
    )
    sinks.write_messages_csv(rows, path)
    return read_cells(spark, path, rows.columns)


@query(
    "control_audit_table",
    f"""with {v.AUDIT_SQL} select id, tenant_id, action, entity_type, entity_id, coalesce(null::varchar, '') as message, created_at from audit""",
)
def control_audit_table(spark, folder):
    """A control table laid out by tenant, read back with its schema."""
    path = run_dir(spark, "control")
    missing = F.lit(None).cast("string")
    events = v.audit_events(spark, folder).select(
        "id",
        "tenant_id",
        "action",
        "entity_type",
        "entity_id",
        missing.alias("request_id"),
        missing.alias("message"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )
    sinks.write_control_table(events, path, "audit_events")
    back = scan.control_table(spark, path, "audit_events")
    return back.select(
        "id", "tenant_id", "action", "entity_type", "entity_id",
        F.coalesce("message", F.lit("")).alias("message"), "created_at",
    )


@query(
    "rule_config_rows",
    """with words as (select r_name as name, n_name as value, row_number() over (partition by r_name order by n_name) - 1 as ord from nation join region on n_regionkey = r_regionkey),
      segments as (select distinct c_mktsegment as value from customer)
    select 'keyword_sets' as section, name, value, cast(ord as integer) as ord from words
    union all select 'link_detection', 'url_keywords', value, cast(row_number() over (order by value) - 1 as integer) from segments
    union all select 'scoring', r_name, cast(cast(r_regionkey as double) as varchar), 0 from region""",
)
def rule_config_rows(spark, folder):
    """A rule file made of nations, market segments and regions, read back as rows."""
    path = run_dir(spark, "rules")
    nations = v.table(spark, folder, "nation").join(
        v.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # a few dozen rows by the definition of the dimension tables
    sets = nations.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    words = sets.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "names"))).alias("keyword_sets"))
    keywords = v.table(spark, folder, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("url_keywords"))
    weight = F.struct("r_name", F.col("r_regionkey").cast("double").alias("w"))
    scores = v.table(spark, folder, "region").agg(F.map_from_entries(F.collect_list(weight)).alias("scoring"))
    config = words.select(
        "keyword_sets",
        F.struct(keywords.scalar().alias("url_keywords")).alias("link_detection"),
        scores.scalar().alias("scoring"),
    )
    config.write.json(path)
    return scan.rule_config(spark, path)


@query(
    "run_manifest",
    """with s as (select s_suppkey, row_number() over (order by s_suppkey) as n from supplier qualify n <= 12)
    select 'invoices_' || lpad(cast(min(n) as varchar), 2, '0') || '_2025' as month, 'success' as status, 'consolidated_1' as folder from s""",
)
def run_manifest(spark, folder):
    """A manifest per month below the folder of a provider run; the first one is found."""
    root = run_dir(spark, "runs")
    number = F.row_number().over(Window.orderBy("s_suppkey"))
    months = v.table(spark, folder, "supplier").select(number.alias("n")).where("n <= 12")
    manifest = F.struct(
        F.when(F.col("n") % 2 == 1, " success ").otherwise("failure").alias("status"),
        F.concat(F.lit("consolidated_"), "n").alias("consolidated_dir"),
    )
    name = F.concat(F.lit("/invoices_"), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_2025/run_summary.json"))
    files.write_files(months.select(name.alias("path"), F.to_json(manifest).alias("content")), root)
    return scan.run_manifests(spark, root).select(
        F.regexp_extract("summary_path", "/(invoices_[^/]*)/", 1).alias("month"), "status", F.col("invoices_dir").alias("folder")
    )


@query(
    "landed_mail",
    """select 'm' || conv_id || '-' || turn as message_id, case when turn % 3 = 0 then '' else string_split(text, chr(10))[1] end as subject, text as preview,
      case role when 'user' then 'u' || conv_id || '@mail.example.com' else '' end as sender, to_timestamp(1704067200 + conv_id * 3600 + turn * 60) at time zone 'UTC' as received,
      turn % 2 = 0 as has_attachments, case role when 'assistant' then 'sent' else 'inbox' end as parent_folder from conversations""",
)
def landed_mail(spark, folder):
    """Messages as the mail service lands them: nested senders, missing fields."""
    path = run_dir(spark, "mail")
    turn = F.col("turn")
    address = F.struct(F.struct(F.concat(F.lit("u"), "conv_id", F.lit("@mail.example.com")).alias("address")).alias("emailAddress"))
    seconds = F.lit(1704067200) + F.col("conv_id") * 3600 + turn * 60
    mail = v.table(spark, folder, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), turn).alias("id"),
        F.when(turn % 3 != 0, F.substring_index("text", "\n", 1)).alias("subject"),
        F.col("text").alias("bodyPreview"),
        F.when(F.col("role") == "user", address).alias("from"),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("receivedDateTime"),
        F.when(turn % 2 == 0, F.lit(True)).alias("hasAttachments"),
        F.when(F.col("role") == "assistant", "sent").otherwise("inbox").alias("parentFolderId"),
        F.lit("w").alias("webLink"),
    )
    mail.write.json(path)
    landed = spark.read.schema(
        "id string, subject string, bodyPreview string, `from` struct<emailAddress: struct<address: string>>, receivedDateTime string, "
        "hasAttachments boolean, parentFolderId string, webLink string"
    ).json(path)
    return scan.message_fields(landed).select(
        "message_id", "subject", "preview", "sender", F.col("received").cast("timestamp_ntz").alias("received"), "has_attachments", "parent_folder"
    )
