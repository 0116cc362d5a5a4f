# -*- coding: utf-8 -*-
"""The given tables seen as invoices, documents, messages, links, charges and audit events.

Each view has a Spark form and, for checking, a SQL form (a list of common table
expressions).  The tables carry no invoice words, so operators that match text get word
lists that occur in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R

# Words that occur in the given texts.
TERMS = R.TermRules(
    latin_pos=("the", "with", "that"),
    raw_pos=("que", "les", "une"),
    latin_neg=("from", "heron"),
    raw_neg=("nicht", "für"),
    municipal=("para", "los", "und"),
    weak=("que", "the"),
    forgiven=("für",),
)
SCORES = R.ScoreRules(
    hebrew=("que", "les", "para", "aux", "nicht", "pour"),
    english=("the", "with", "that", "from", "this", "which", "for"),
    municipal=("une", "los", "with"),
    donation=("la", "in"),
    donation_word="the",
    strict=("therea", "the of", "que la"),
    subject_strong=r"(?:que|und)|(?<![\p{L}\p{N}_])(?:the|with)(?![\p{L}\p{N}_])",
    notice=r"(?:copy|note).{0,20}(?:doc|scan)",
    extensions=(".pdf", ".png"),
    name_hints=("scan",),
    sender_rules=("+@mail.example.com", "-help@desk.example.org"),
    negatives=("ered", "tionth", "eaux"),
    subject_boosts=("^The", "ent"),
    links=R.LinkRules(
        keywords=("the", "page"),
        path_patterns=("/en", "/fr"),
        suffixes=(".html",),
        trusted=("example.com",),
        http_allowed=("example.org",),
        tracking=("spam-farm.example.org",),
        tracking_prefixes=("m.",),
    ),
)
STRATEGIES = (
    ("common_words", ("the", "with")),
    ("romance_words", ("que", "les", "para")),
    ("german_words", ("nicht", "und", "für")),
    ("rare_words", ("heron", "therhe")),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- invoices ---------------------------------------------------------------------------


def priced_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (order, supplier): exact net and VAT sums, first ship date."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    net = price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    vat = net * F.col("l_tax").cast("decimal(4,2)")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.round(F.sum(net), 2).cast("decimal(18,2)").alias("net"),
        F.round(F.sum(vat), 2).cast("decimal(18,2)").alias("vat"),
        F.bool_and(F.col("l_returnflag") == "R").alias("returned"),
        F.min("l_shipdate").cast("date").alias("day"),
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.concat(
            F.lit("inv_"), "l_orderkey", F.lit("_"), "l_suppkey", F.lit(".pdf")
        ).alias("source_file"),
        "net",
        "vat",
        "returned",
        "day",
        "s_name",
        "s_nationkey",
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice records: returned ones negative, some without amounts, some zero."""
    p = priced_invoices(spark, folder)
    missing, zero = F.col("orderkey") % 17 == 0, F.col("orderkey") % 19 == 0

    def amount(value):
        signed = F.when(F.col("returned"), -value).otherwise(value)
        return F.when(missing, None).when(zero, 0).otherwise(signed).cast("double")

    net, vat = F.col("net"), F.col("vat")
    return p.select(
        "orderkey",
        "suppkey",
        "source_file",
        F.col("orderkey").cast("string").alias("invoice_id"),
        F.date_format("day", "dd/MM/yyyy").alias("invoice_date"),
        "day",
        F.when(F.col("orderkey") % 23 == 0, F.lit(None)).otherwise(F.col("s_name")).alias("invoice_from"),
        F.concat(F.lit("Order "), "orderkey").alias("invoice_for"),
        F.when(missing, None).otherwise(net).cast("double").alias("base_before_vat"),
        amount(vat).alias("invoice_vat"),
        amount(net + vat).alias("invoice_total"),
    )


PRICED_SQL = """
priced as (
  select l_orderkey as orderkey, l_suppkey as suppkey,
    'inv_' || l_orderkey || '_' || l_suppkey || '.pdf' as source_file,
    cast(round(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))), 2) as decimal(18,2)) as net,
    cast(round(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) * cast(l_tax as decimal(4,2))), 2) as decimal(18,2)) as vat,
    bool_and(l_returnflag = 'R') as returned, cast(min(l_shipdate) as date) as day,
    s_name, s_nationkey
  from lineitem join supplier on l_suppkey = s_suppkey
  group by l_orderkey, l_suppkey, s_name, s_nationkey)"""
INV_SQL = PRICED_SQL + """,
inv as (
  select orderkey, suppkey, source_file, cast(orderkey as varchar) as invoice_id,
    strftime(day, '%d/%m/%Y') as invoice_date, day,
    case when orderkey % 23 = 0 then null else s_name end as invoice_from,
    'Order ' || orderkey as invoice_for,
    case when orderkey % 17 = 0 then null else net end as base_before_vat,
    case when orderkey % 17 = 0 then null when orderkey % 19 = 0 then 0
      when returned then -vat else vat end as invoice_vat,
    case when orderkey % 17 = 0 then null when orderkey % 19 = 0 then 0
      when returned then -(net + vat) else net + vat end as invoice_total
  from priced)"""


def number_text(column: str):
    return F.col(column).cast("string")


def invoice_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice documents in three layouts: labelled, visual-order and municipal."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    p = priced_invoices(spark, folder).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey"), "left"
    )
    p = p.withColumn("total", F.col("net") + F.col("vat")).withColumn(
        "number", F.concat("orderkey", F.lpad(F.col("suppkey").cast("string"), 6, "0"))
    )
    rate = F.round(F.col("vat") / F.col("net") * 100, 2).cast("decimal(10,2)").cast("string")
    day = F.date_format("day", "dd/MM/yyyy")
    labelled = F.concat_ws(
        "\n",
        F.concat(F.lit("חשבונית מס מספר: "), "number"),
        F.concat(F.lit("תאריך: "), day),
        F.concat(F.lit("מאת "), "s_name"),
        F.concat(F.lit("שירותי אספקה עבור הזמנה "), "orderkey"),
        F.concat(
            F.lit("תקופה: "),
            F.date_format(F.trunc("day", "month"), "dd/MM/yyyy"),
            F.lit(" - "),
            F.date_format(F.last_day("day"), "dd/MM/yyyy"),
        ),
        F.concat(F.lit("לתשלום עד "), F.date_format(F.date_add("day", 30), "dd.MM.yyyy")),
        F.concat(F.lit("PO #: PO-"), "orderkey"),
        F.concat(F.lit('מע"מ '), rate, F.lit("%: "), number_text("vat")),
        F.concat(F.lit('סה"כ כולל מע"מ: '), number_text("total")),
    )
    filler = [F.lit(w) for w in ("פרטי הלקוח", "כתובת למשלוח", "תנאי תשלום", "הערות")]
    visual = F.concat_ws(
        "\n",
        F.concat(F.col("number"), F.lit(" רפסמ תינובשח")),
        F.concat(day, F.lit(" :ךיראת")),
        F.concat(F.col("s_name"), F.lit(" Ltd")),
        *filler,
        F.concat(F.lit("₪ "), number_text("net"), F.lit(' :מ"עמ ינפל')),
        F.concat(F.lit("₪ "), number_text("vat"), F.lit(" :"), rate, F.lit('% מ"עמ')),
        F.concat(F.lit("₪ "), number_text("total"), F.lit(' :םולשתל כ"הס')),
        *filler,
    )
    municipal = F.concat_ws(
        "\n",
        F.concat(F.lit("עיריית "), "n_name"),
        F.concat(F.lit("תאריך הדפסה: "), day),
        F.concat(F.lit("מס׳ מסלקה/שובר/ספח: "), "number"),
        F.lit('ח"שב'),
        number_text("net"),
        number_text("vat"),
        F.lit('סה"'),
    )
    kind = F.col("suppkey") % 3
    return p.select(
        "orderkey",
        "suppkey",
        "source_file",
        F.when(kind == 0, labelled).when(kind == 1, visual).otherwise(municipal).alias("text"),
    )


# What the three layouts say, field by field.
TEXT_SQL = PRICED_SQL + """,
said as (
  select p.*, p.suppkey % 3 as kind, net + vat as total, n_name,
    orderkey || lpad(cast(suppkey as varchar), 6, '0') as number,
    cast(round(cast(vat as decimal(28,10)) / net * 100, 2) as decimal(10,2)) as rate
  from priced p left join nation on s_nationkey = n_nationkey)"""


# --- documents --------------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return document_columns(table(spark, folder, "documents"))


def document_columns(raw: DataFrame) -> DataFrame:
    """path, provider, content and pages (the lines of the text) per document."""
    path = F.concat(
        F.lit("/"),
        "source",
        F.when(F.col("doc_id") % 50 == 7, "/quarantine").when(F.col("doc_id") % 50 == 9, "/_tmp").otherwise(""),
        F.lit("/"),
        "lang",
        F.lit("_"),
        "n_chars",
        F.lit("__"),
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, ".PDF").when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".pdf"),
    )
    return raw.select(
        "doc_id",
        path.alias("path"),
        F.col("lang").alias("provider"),
        "source",
        F.col("text").alias("content"),
        F.split("text", "\n").alias("pages"),
        (F.col("lang") == "en").alias("trusted"),
    )


DOCS_SQL = """
docs as (
  select doc_id,
    '/' || source || case when doc_id % 50 = 7 then '/quarantine' when doc_id % 50 = 9 then '/_tmp' else '' end
      || '/' || lang || '_' || n_chars || '__' || doc_id
      || case when doc_id % 5 = 0 then '.PDF' when doc_id % 11 = 0 then '.txt' else '.pdf' end as path,
    lang as provider, source, text as content, string_split(text, chr(10)) as pages, lang = 'en' as trusted
  from documents)"""


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """pages(doc_id, page_no, text), as a page decoder would land them."""
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text")
    )


# --- messages ---------------------------------------------------------------------------


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return message_columns(table(spark, folder, "conversations"))


def message_columns(raw: DataFrame) -> DataFrame:
    """Conversation turns as mail: the first line is the subject, the text the preview."""
    turn = F.col("turn").cast("string")
    mail = raw.select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), turn).alias("message_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.col("text").alias("preview"),
        F.when(F.col("role") == "user", F.concat(F.lit("User <u"), "conv_id", F.lit("@mail.example.com>")))
        .when(F.col("role") == "assistant", F.lit("Desk <Help@desk.example.org>"))
        .otherwise(F.lit("daemon"))
        .alias("sender"),
        (
            F.lit("2024-01-01").cast("timestamp_ntz")
            + F.make_dt_interval(mins=(F.col("conv_id") * 60 + F.col("turn")).cast("int"))
        ).alias("received"),
        F.concat(F.lit("https://mail.example.com/"), "conv_id").alias("web_link"),
        F.when(F.col("role") == "assistant", "sent").otherwise("inbox").alias("parent_folder"),
        (F.col("turn") % 2 == 0).alias("has_attachments"),
        F.concat(
            F.when(F.col("turn") % 4 == 0, "copy of doc_").otherwise("scan_"),
            "conv_id",
            F.when(F.col("turn") % 3 == 0, ".PDF").otherwise(".txt"),
        ).alias("attachment_name"),
        F.col("text").alias("body"),
    )
    part = F.struct(
        F.when(F.endswith("attachment_name", F.lit(".PDF")), "application/octet-stream")
        .otherwise("text/plain")
        .alias("mime"),
        F.col("attachment_name").alias("filename"),
        F.when(F.col("has_attachments"), F.col("message_id")).alias("attachment_id"),
    )
    return mail.withColumn("parts", F.array(part))


MSGS_SQL = """
msgs as (
  select 'm' || conv_id || '-' || turn as message_id, string_split(text, chr(10))[1] as subject, text as preview,
    case role when 'user' then 'User <u' || conv_id || '@mail.example.com>' when 'assistant' then 'Desk <Help@desk.example.org>' else 'daemon' end as sender,
    make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) as received,
    'https://mail.example.com/' || conv_id as web_link,
    case role when 'assistant' then 'sent' else 'inbox' end as parent_folder,
    turn % 2 = 0 as has_attachments,
    case when turn % 4 = 0 then 'copy of doc_' else 'scan_' end || conv_id || case when turn % 3 = 0 then '.PDF' else '.txt' end as attachment_name,
    text as body
  from conversations)"""


# --- pages and links --------------------------------------------------------------------


def web_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", "html")


# --- charges ----------------------------------------------------------------------------


def charge_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.col("user_id").cast("string").alias("actor_name"),
        "event_type",
        F.col("props").alias("extra_data"),
    )


# --- audit ------------------------------------------------------------------------------

ACTIONS = {
    "signup": "collection.created",
    "view": "collection.started",
    "click": "collection.progress",
    "purchase": "collection.succeeded",
    "error": "collection.failed",
}


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    action = F.element_at(
        F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type")
    )
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("t"), F.col("user_id") % 10).alias("tenant_id"),
        action.alias("action"),
        F.lit("collection_job").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").alias("created_at"),
        F.col("value"),
    )


AUDIT_SQL = """
audit as (
  select cast(event_id as varchar) as id, 't' || (user_id % 10) as tenant_id,
    case event_type when 'signup' then 'collection.created' when 'view' then 'collection.started'
      when 'click' then 'collection.progress' when 'purchase' then 'collection.succeeded'
      when 'error' then 'collection.failed' end as action,
    'collection_job' as entity_type, cast(user_id as varchar) as entity_id, ts as created_at, value
  from events)"""
