"""Report queries over the invoice view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import report
from ..operators.extract import sanitize_records
from . import views as v
from .registry import query

_STATS = """
  select '{m}' as metric, cast(coalesce(round(sum({m}), 2), 0) as double) as sum,
    cast(coalesce(round(sum(abs({m})), 2), 0) as double) as abs_sum,
    count(*) filter (where {m} <> 0) as count, count(*) filter (where {m} is null) as missing,
    count(*) filter (where {m} = 0) as zero, count(*) filter (where {m} < 0) as negative,
    count(*) filter (where {m} > 0) as positive,
    cast(min({m}) filter (where {m} <> 0) as double) as min, cast(max({m}) filter (where {m} <> 0) as double) as max,
    cast(round(cast(sum({m}) as decimal(28,8)) / nullif(count(*) filter (where {m} <> 0), 0), 2) as double) as avg
  from inv"""
_TOTALS_SQL = (
    """
  select 'records' as metric, null::double as sum, null::double as abs_sum, count(*) as count, null::bigint as missing,
    null::bigint as zero, null::bigint as negative, null::bigint as positive, null::double as min, null::double as max, null::double as avg from inv
  union all """
    + _STATS.format(m="invoice_vat")
    + " union all "
    + _STATS.format(m="invoice_total")
)


@query("report_totals", f"with {v.INV_SQL} {_TOTALS_SQL}")
def report_totals(spark, folder):
    return report.report_totals(v.invoices(spark, folder))


@query(
    "net_vat_gross",
    f"""with {v.INV_SQL} select cast(sum(invoice_total) - sum(invoice_vat) as double) as net_total,
      cast(sum(invoice_vat) as double) as vat_total, cast(sum(invoice_total) as double) as gross_total from inv""",
)
def net_vat_gross(spark, folder):
    return report.net_vat_gross(report_totals(spark, folder))


def _money(e: str) -> str:
    return f"coalesce(cast(cast(round(cast({e} as decimal(28,8)), 2) as decimal(28,2)) as varchar), '')"


@query(
    "summary_csv_rows",
    f"with {v.INV_SQL}, t as ({_TOTALS_SQL}) select metric, "
    + ", ".join(f"{_money(c)} as {c}" for c in ("sum", "abs_sum", "min", "max", "avg"))
    + ", "
    + ", ".join(
        f"coalesce(cast({c} as varchar), '') as {c}"
        for c in ("count", "missing", "zero", "negative", "positive")
    )
    + " from t",
)
def summary_csv_rows(spark, folder):
    return report.summary_cells(report_totals(spark, folder))


_VENDOR_SQL = """
  per_vendor as (
    select coalesce(nullif(trim(regexp_replace(invoice_from, '\\s+', ' ', 'g')), ''), 'Unknown Vendor') as vendor,
      count(*) as invoices, cast(sum(base_before_vat) as double) as base_before_vat,
      cast(sum(invoice_vat) as double) as invoice_vat, cast(sum(invoice_total) as double) as invoice_total
    from inv group by 1),
  grand as (
    select null::varchar as vendor, count(*) as invoices, cast(sum(base_before_vat) as double) as base_before_vat,
      cast(sum(invoice_vat) as double) as invoice_vat, cast(sum(invoice_total) as double) as invoice_total from inv)"""


@query(
    "vendor_subtotals",
    f"""with {v.INV_SQL}, {_VENDOR_SQL}
    select vendor, false as is_total, invoices, base_before_vat, invoice_vat, invoice_total from per_vendor
    union all select vendor, true, invoices, base_before_vat, invoice_vat, invoice_total from grand""",
)
def vendor_subtotals(spark, folder):
    return report.vendor_subtotals(v.invoices(spark, folder))


def _feed_sql(subtotals: str) -> str:
    return f"""with {v.INV_SQL}, {_VENDOR_SQL},
  details as (select *, coalesce(nullif(trim(regexp_replace(invoice_from, '\\s+', ' ', 'g')), ''), 'Unknown Vendor') as vendor from inv)
  select 'detail' as row_type, lower(vendor) as vendor_key, vendor, 0 as row_rank, strftime(day, '%Y-%m-%d') as date_key,
    invoice_id, source_file, invoice_from, invoice_for, cast(base_before_vat as double) as base_before_vat,
    cast(invoice_vat as double) as invoice_vat, cast(invoice_total as double) as invoice_total from details
  {subtotals}
  union all select 'grand_total', null, null, 2, null, null, null, null, 'Grand Total', base_before_vat, invoice_vat, invoice_total from grand"""


_SUBTOTAL_ROWS = """union all select 'vendor_subtotal', lower(vendor), vendor, 1, null, null, null, vendor, 'Vendor Subtotal',
    base_before_vat, invoice_vat, invoice_total from per_vendor"""


@query("report_feed", _feed_sql(_SUBTOTAL_ROWS))
def report_feed(spark, folder):
    return report.report_feed(v.invoices(spark, folder))


@query("report_feed_skip_single", _feed_sql(_SUBTOTAL_ROWS + " where invoices > 1"))
def report_feed_skip_single(spark, folder):
    return report.report_feed(v.invoices(spark, folder), skip_single=True)


@query("report_feed_plain", _feed_sql(""))
def report_feed_plain(spark, folder):
    return report.report_feed(v.invoices(spark, folder), vendor_subtotal_rows=False)


@query(
    "report_feed_positions",
    f"""select row_type, vendor, source_file, row_number() over (order by row_rank = 2, vendor_key, vendor, row_rank, date_key nulls first, coalesce(invoice_id, ''), source_file nulls first) as position
    from ({_feed_sql(_SUBTOTAL_ROWS)})""",
)
def report_feed_positions(spark, folder):
    """The place of each row in the report."""
    feed = report.feed_rows(v.invoices(spark, folder)).drop("invoice_from", "invoice_for", *report.AMOUNTS)
    return report.feed_positions(feed).select("row_type", "vendor", "source_file", "position")


@query(
    "report_feed_cells",
    f"""with {v.INV_SQL}
    select 'detail' as row_type, source_file, coalesce(invoice_id, '') as invoice_id, coalesce(invoice_from, '') as invoice_from, invoice_for,
      coalesce(format('{{:,.2f}}', cast(base_before_vat as double)), '') as base_before_vat,
      coalesce(format('{{:,.2f}}', cast(invoice_vat as double)), '') as invoice_vat,
      coalesce(format('{{:,.2f}}', cast(invoice_total as double)), '') as invoice_total from inv""",
)
def report_feed_cells(spark, folder):
    feed = report.report_feed(v.invoices(spark, folder), vendor_subtotal_rows=False)
    return report.feed_cells(feed.where("row_type = 'detail'"))


@query(
    "record_csv_rows",
    f"""with {v.INV_SQL} select source_file, invoice_id, coalesce(invoice_from, '') as invoice_from,
      case when orderkey % 2 = 0 then 'true' else 'false' end as municipal,
      {_money("base_before_vat")} as base_before_vat, {_money("invoice_vat")} as invoice_vat, {_money("invoice_total")} as invoice_total,
      case when orderkey % 17 = 0 then '' else '[' || cast(cast(net as double) as varchar) || ',' || cast(cast(vat as double) as varchar) || ']' end as breakdown_values
      from inv join priced using (orderkey, suppkey, source_file)""",
)
def record_csv_rows(spark, folder):
    inv = v.invoices(spark, folder)
    rows = inv.join(
        v.priced_invoices(spark, folder).select("source_file", "net", "vat"), "source_file"
    ).select(
        "source_file",
        "invoice_id",
        "invoice_from",
        (F.col("orderkey") % 2 == 0).alias("municipal"),
        *report.AMOUNTS,
        F.when(
            F.col("base_before_vat").isNotNull(),
            F.array(F.col("net").cast("double"), F.col("vat").cast("double")),
        ).alias("breakdown_values"),
    )
    return report.record_cells(sanitize_records(rows))


_ITEMS_SQL = """
items as (
  select source_file as id, day as invoice_date, cast(day + 30 as date) as due_date, cast(invoice_total as double) as amount,
    case when orderkey % 7 = 0 then null else 'goods' end as category, 0.5 + (suppkey % 5) * 0.1 as confidence,
    orderkey % 13 = 0 as is_duplicate, invoice_total is null as is_quarantined, coalesce(invoice_total < 0, false) as needs_review
  from inv),
ref as (select cast(max(day) - 45 as date) as d from inv)"""


def review_items(spark, folder):
    inv = v.invoices(spark, folder)
    return inv.select(
        F.col("source_file").alias("id"),
        F.col("day").alias("invoice_date"),
        F.date_add("day", 30).alias("due_date"),
        F.col("invoice_total").alias("amount"),
        F.when(F.col("orderkey") % 7 == 0, F.lit(None)).otherwise("goods").alias("category"),
        (F.lit(0.5).cast("decimal(4,1)") + (F.col("suppkey") % 5) * F.lit(0.1).cast("decimal(4,1)"))
        .cast("double")
        .alias("confidence"),
        (F.col("orderkey") % 13 == 0).alias("is_duplicate"),
        F.col("invoice_total").isNull().alias("is_quarantined"),
        F.coalesce(F.col("invoice_total") < 0, F.lit(False)).alias("needs_review"),
    )


def reference_day(spark, folder):
    """Forty-five days before the last ship date: one scalar read from the table."""
    ship = v.table(spark, folder, "lineitem").agg(F.max("l_shipdate").cast("date").alias("d"))
    return ship.select(F.date_sub("d", 45)).scalar()


_IN_PRESET = {
    "today": "invoice_date = d",
    "yesterday": "invoice_date = d - 1",
    "thisWeek": "invoice_date between d - cast(dayofweek(d) as integer) and d",
    "thisMonth": "invoice_date between date_trunc('month', d) and d",
}


@query(
    "review_summary",
    f"with {v.INV_SQL}, {_ITEMS_SQL} "
    + " union all ".join(
        f"""select '{p}' as preset, count(*) filter (where {c}) as invoices, count(*) filter (where {c} and needs_review) as needs_review,
        count(*) filter (where ({c}) and (is_duplicate or is_quarantined or category is null)) as duplicates_or_suspicious,
        count(*) filter (where {c} and due_date < d) as due_soon_or_overdue,
        coalesce(cast(sum(cast(amount as decimal(18,2))) filter (where {c}) as double), 0) as total_amount from items, ref"""
        for p, c in _IN_PRESET.items()
    ),
)
def review_summary(spark, folder):
    return report.review_summary(review_items(spark, folder), reference_day(spark, folder))


@query(
    "review_order",
    f"""with {v.INV_SQL}, {_ITEMS_SQL}, scored as (select *, case when is_duplicate then 4 when is_quarantined then 3 when due_date < d then 2
      when category is null or confidence < 0.6 then 1 else 0 end as severity from items, ref)
    select id, severity, strftime(due_date, '%Y-%m-%d') as due, due_date < d as is_overdue from scored""",
)
def review_order(spark, folder):
    ordered = report.review_order(review_items(spark, folder), reference_day(spark, folder))
    return ordered.select("id", "severity", dates.iso(F.col("due_date")).alias("due"), "is_overdue")


@query(
    "run_status",
    """with runs as (select strftime(ts, '%Y-%m-%d') as run, event_type as name, max(case when value > 60 then 1 else 0 end) as returncode,
        sum(cast(value as decimal(18,2))) as seconds from events group by 1, 2)
    select run, case when bool_or(returncode <> 0) and bool_or(returncode = 0) then 'partial_failure'
        when bool_or(returncode <> 0) then 'failure' else 'success' end as status,
      coalesce(string_agg(name, ',' order by name) filter (where returncode = 0), '') as ok,
      coalesce(string_agg(name, ',' order by name) filter (where returncode <> 0), '') as failed,
      format('{:02d}h:{:02d}m:{:02d}s', cast(floor(sum(seconds)) as bigint) // 3600, cast(floor(sum(seconds)) as bigint) % 3600 // 60, cast(floor(sum(seconds)) as bigint) % 60) as duration
    from runs group by run""",
)
def run_status(spark, folder):
    results = (
        v.table(spark, folder, "events")
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_type").alias("name"))
        .agg(
            F.max(F.when(F.col("value") > 60, 1).otherwise(0)).alias("returncode"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("duration_seconds"),
        )
    )
    return report.run_summary(results).select(
        "run",
        "status",
        F.array_join("successful_providers", ",").alias("ok"),
        F.array_join("failed_providers", ",").alias("failed"),
        "duration",
    )


@query(
    "provider_aliases",
    """select conv_id, turn, case when turn % 5 = 4 then null when role = 'system' then 'gmail,outlook' else 'outlook,gmail' end as providers,
      case when turn % 5 = 4 then role || '?' else '' end as unknown from conversations""",
)
def provider_aliases(spark, folder):
    c = v.table(spark, folder, "conversations")
    turn, role = F.col("turn"), F.col("role")
    raw = F.concat(
        F.lit(" "), F.upper(role), F.lit(" ,,system, user ,"),
        F.when(turn % 5 == 4, F.concat(role, F.lit("?"))).otherwise("assistant"),
    )
    aliases = {"user": "outlook", "assistant": "outlook", "system": "gmail"}
    found = report.normalize_providers(
        c.select(F.struct("conv_id", "turn").alias("id"), raw.alias("raw")), aliases
    )
    return found.select(
        "id.conv_id",
        "id.turn",
        F.array_join("providers", ",").alias("providers"),
        F.array_join("unknown", ",").alias("unknown"),
    )


@query(
    "threshold_sweep",
    f"""with {v.INV_SQL}, {_ITEMS_SQL}, t as (select unnest([0.5, 0.6, 0.7, 0.85, 0.95]) as threshold)
    select threshold::double as threshold, (select count(*) from items where confidence >= threshold) as rows from t""",
)
def threshold_sweep(spark, folder):
    return report.threshold_sweep(review_items(spark, folder), (0.95, 0.5, 0.6, 0.7, 0.85))


@query(
    "artifact_presence",
    """with wanted as (select o_orderkey as report_id, unnest(case when o_orderkey % 3 = 0 then ['json','csv','zip'] else ['summary_csv','pdf'] end) as format from orders),
      known as (select * from wanted where format in ('json','csv','summary_csv','pdf')),
      produced as (select distinct l_orderkey as report_id, case l_returnflag when 'R' then 'json' when 'A' then 'csv' else 'pdf' end as format from lineitem)
    select k.report_id, k.format, case when p.format is null then null else k.report_id || '.' || k.format end as path, p.format is null as missing
    from known k left join produced p on k.report_id = p.report_id and k.format = p.format""",
)
def artifact_presence(spark, folder):
    requests = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(*[F.lit(x) for x in ("json", "csv", "zip")]))
        .otherwise(F.array(F.lit("summary_csv"), F.lit("pdf")))
        .alias("formats"),
    )
    flag = F.col("l_returnflag")
    produced = (
        v.table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("report_id"),
            F.when(flag == "R", "json").when(flag == "A", "csv").otherwise("pdf").alias("format"),
        )
        .distinct()
        .withColumn("path", F.concat("report_id", F.lit("."), "format"))
    )
    return report.missing_artifacts(requests, produced)


@query(
    "view_integrity",
    """with items as (select o_orderkey as id from orders),
      details as (select l_orderkey as key, min(case when l_linenumber > 6 then l_orderkey + 1 else l_orderkey end) as id from lineitem group by 1),
      views as (select c_mktsegment as view, o_orderkey as id from orders join customer on o_custkey = c_custkey),
      sel as (select view, max(id) + 1 as id from views group by 1),
      listed as (select id, count(*) as n from items group by 1)
    select case when d.key is null then 'item_without_detail' else 'detail_without_item' end as problem, coalesce(l.id, d.key) as id
      from listed l full join details d on l.id = d.key where d.key is null or l.id is null
    union all select 'repeated_item', id from listed where n > 1
    union all select 'detail_key_mismatch', key from details where key <> id
    union all select distinct 'unknown_in_view:' || view, id from views where id not in (select key from details)
    union all select 'selected_not_listed:' || s.view, s.id from sel s where not exists (select 1 from views w where w.view = s.view and w.id = s.id)""",
)
def view_integrity(spark, folder):
    orders = v.table(spark, folder, "orders")
    items = orders.select(F.col("o_orderkey").alias("id"))
    off = F.when(F.col("l_linenumber") > 6, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey"))
    details = (
        v.table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(F.min(off).alias("id"))
    )
    members = orders.join(
        v.table(spark, folder, "customer").select("c_custkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).select(F.col("c_mktsegment").alias("view"), F.col("o_orderkey").alias("id"))
    selected = members.groupBy("view").agg((F.max("id") + 1).alias("id"))
    return report.member_integrity(items, details, members, selected)


@query(
    "view_items",
    """with d as (select l_orderkey as key, count(*) as lines from lineitem group by 1),
      vw as (select case o_orderstatus when 'F' then 'done' else 'open' end as view, unnest([o_orderkey, o_orderkey + 1]) as id, o_orderkey as selected_id, unnest([0, 1]) as pos from orders)
    select view, selected_id, cast(pos as bigint) as pos, id, o_orderpriority as priority, lines from vw join orders on o_orderkey = id join d on d.key = id""",
)
def view_items(spark, folder):
    """Saved views with the fields of their items and details."""
    orders = v.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    views = orders.select(
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("view"),
        key.alias("selected_id"),
        F.array(key, key + 1).alias("invoice_ids"),
    )
    items = orders.select(key.alias("id"), F.col("o_orderpriority").alias("priority"))
    details = (
        v.table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("id", F.col("key"))
    )
    shown = report.view_items(views, items, details)
    return shown.select(
        "view", "selected_id", F.col("pos").cast("bigint").alias("pos"), "id", "priority", "lines"
    )


@query(
    "id_set_difference",
    """(select l_orderkey as id, 'left' as side from lineitem except select o_orderkey, 'left' from orders)
    union all (select o_orderkey, 'right' from orders except select l_orderkey, 'right' from lineitem)""",
)
def id_set_difference(spark, folder):
    left = v.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    right = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return report.set_difference(left, right)


@query(
    "month_windows",
    """select distinct year(o_orderdate) as year, month(o_orderdate) as month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as start_date,
      strftime(date_trunc('month', o_orderdate) + interval 1 month, '%Y-%m-%d') as end_date, strftime(o_orderdate, '%m_%Y') as label from orders""",
)
def month_windows(spark, folder):
    months = (
        v.table(spark, folder, "orders")
        .select(
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.month("o_orderdate").cast("bigint").alias("month"),
        )
        .distinct()
    )
    window = dates.month_window(F.col("year").cast("int"), F.col("month").cast("int"))
    return months.select("year", "month", window.alias("w")).select("year", "month", "w.*")
