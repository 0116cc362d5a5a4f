"""Extraction queries: amount tokens, dates, lines, fields and whole invoice records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import text as tx
from ..operators import extract, fields, report, totals
from . import views as v
from .registry import query

_LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


def amount_spellings(spark, folder):
    """Prices in the spellings amounts come in."""
    li = v.table(spark, folder, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    part = F.col("l_partkey")
    token = (
        F.when(kind == 0, F.format_number(price, 2))
        .when(kind == 1, F.concat(F.lit("-"), price.cast("string")))
        .when(kind == 2, F.concat(F.lit("₪ "), F.replace(price.cast("string"), F.lit("."), F.lit(","))))
        .when(kind == 3, F.concat(F.lpad((part % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((part % 1000).cast("string"), 3, "0")))
        .when(kind == 4, F.concat(F.lit("5"), F.lpad((part % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((part % 1000).cast("string"), 3, "0")))
        .when(kind == 5, F.concat(part.cast("string"), F.lit(",")))
        .when(kind == 6, F.lit("n/a"))
        .otherwise(F.concat(F.floor(price).cast("string"), F.lit(" ש\"ח")))
    )
    return li.select(*_KEYS, token.alias("token"))


_TOKENS = """
  k as (select *, (l_orderkey + l_linenumber) % 8 as kind, cast(l_extendedprice as decimal(18,2)) as price,
      lpad(cast(l_partkey % 100 as varchar), 2, '0') as p2, lpad(cast(l_partkey % 1000 as varchar), 3, '0') as p3 from lineitem)"""


@query(
    "amount_tokens",
    f"""with {_TOKENS}, n as (select {_LI}, kind, case kind when 0 then cast(price as varchar) when 1 then '-' || price when 2 then cast(price as varchar)
        when 3 then p3 || '.' || p2 when 4 then reverse('5' || p2 || '.' || p3) when 5 then l_partkey || '.' when 6 then null else cast(cast(floor(price) as bigint) as varchar) end as normalized from k)
    select {_LI}, normalized, try_cast(normalized as double) as amount, cast(round(cast(try_cast(normalized as double) as decimal(28,8)) * 0.01, 2) as double) as major from n""",
)
def amount_tokens(spark, folder):
    t = amount_spellings(spark, folder)
    token = F.col("token")
    amount = money.parse_number(token)
    return t.select(
        *_KEYS,
        money.normalize_amount_token(token).alias("normalized"),
        amount.alias("amount"),
        money.to_major_units(amount).alias("major"),
    )


@query(
    "amount_selection",
    """with o as (select l_orderkey, l_suppkey, list(distinct l_quantity order by l_quantity) as q, max(l_extendedprice) as p, min(l_linenumber) as n from lineitem group by 1, 2)
    select l_orderkey, l_suppkey, case n % 3 when 0 then cast(cast(p as decimal(18,2)) as double) when 1 then cast(l_suppkey as double) + 0.5 else case when l_suppkey >= 10 then l_suppkey else 7 end end as amount from o""",
)
def amount_selection(spark, folder):
    """Year-like and whole tokens lose against decimals."""
    o = (
        v.table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.max("l_extendedprice").alias("p"), F.min("l_linenumber").alias("n"))
    )
    year, small, supp = F.lit("2019"), F.lit("7"), F.col("l_suppkey").cast("string")
    kind = F.col("n") % 3
    tokens = (
        F.when(kind == 0, F.array(year, small, F.lit("x"), F.col("p").cast("decimal(18,2)").cast("string")))
        .when(kind == 1, F.array(small, F.concat(supp, F.lit(".5")), year))
        .otherwise(F.array(year, small, supp))
    )
    return o.select("l_orderkey", "l_suppkey", money.select_amount(tokens).alias("amount"))


@query(
    "money_rounding",
    f"""select {_LI}, cast(round(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) * 0.5, 2) as double) as rounded,
      format('{{:,.2f}}', cast(round(cast(l_extendedprice as decimal(18,2)), 2) as double)) as shown,
      cast(round(cast(l_extendedprice as decimal(28,8)) * cast(l_tax as decimal(4,2)) / nullif(cast(l_extendedprice as decimal(18,2)), 0) * 100, 2) as double) as vat_rate from lineitem""",
)
def money_rounding(spark, folder):
    li = v.table(spark, folder, "lineitem")
    price, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(4,2)")
    vat = (price * tax).cast("double")
    return li.select(
        *_KEYS,
        money.round_money((price * tax / 2).cast("decimal(28,6)")).alias("rounded"),
        money.money_text(F.col("l_extendedprice")).alias("shown"),
        money.vat_rate_estimate((price + price * tax).cast("double"), vat).alias("vat_rate"),
    )


_DATE_KIND = "o_orderkey % 9"


@query(
    "date_tokens",
    f"""with d as (select o_orderkey, cast(o_orderdate as date) as d, {_DATE_KIND} as kind from orders)
    select o_orderkey, case when kind = 8 then null when kind in (5, 6) then strftime(date_trunc('month', d), '%Y-%m-%d') else strftime(d, '%Y-%m-%d') end as iso,
      kind in (0, 4, 5) as date_like,
      case when kind = 8 then null when kind in (5, 6) then strftime(least(cast(date_trunc('month', d) as date) + 30, last_day(d)), '%Y-%m-%d') else strftime(d, '%Y-%m-%d') end as month_end from d""",
)
def date_tokens(spark, folder):
    d = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 9
    token = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(kind == 2, F.date_format(d, "d.M.yyyy"))
        .when(kind == 3, F.concat(F.date_format(d, "d-"), F.date_format(d, "MMM-yyyy")))
        .when(kind == 4, F.date_format(d, "dd/MM/yy"))
        .when(kind == 5, F.date_format(d, "yyyy.MM"))
        .when(kind == 6, F.date_format(d, "MMMM yyyy"))
        .when(kind == 7, F.date_format(d, " dd,MM,yyyy "))
        .otherwise("31/02/1999")
    )
    return v.table(spark, folder, "orders").select(
        "o_orderkey",
        dates.normalize_date_token(token).alias("iso"),
        dates.is_date_like_token(token).alias("date_like"),
        dates.normalize_date_token(token, 31).alias("month_end"),
    )


_MONTHS_HE = "['ינואר','פברואר','מרץ','אפריל','מאי','יוני','יולי','אוגוסט','ספטמבר','אוקטובר','נובמבר','דצמבר']"


@query(
    "billing_periods",
    f"""with d as (select o_orderkey, o_orderkey % 5 as kind, cast(o_orderdate as date) as d, last_day(o_orderdate) as e, cast(date_trunc('month', o_orderdate) as date) as f from orders),
      n as (select *, cast(f + interval 1 month as date) as nf from d)
    select o_orderkey,
      case kind when 0 then strftime(d, '%Y-%m-%d') when 2 then strftime(f, '%Y-%m-%d') when 3 then strftime(f, '%Y-%m-%d') end as start,
      case kind when 0 then strftime(d + 20, '%Y-%m-%d') when 2 then strftime(e, '%Y-%m-%d') when 3 then strftime(last_day(nf) - 1, '%Y-%m-%d') end as "end",
      case kind when 0 then strftime(d, '%Y-%m-%d') || ' - ' || strftime(d + 20, '%Y-%m-%d')
        when 2 then {_MONTHS_HE}[month(d)] || ' - ' || {_MONTHS_HE}[month(d)]
        when 3 then {_MONTHS_HE}[month(f)] || ' - ' || {_MONTHS_HE}[month(nf)] end as label,
      strftime(d + 10, '%Y-%m-%d') as due, case when kind = 4 then 'PO-' || o_orderkey || '|' || 'A-' || (o_orderkey + 1000) else '' end as refs
    from n""",
)
def billing_periods(spark, folder):
    """Period, due date and references written in the accepted ways.

    The labelled month form reads only the last letter of a month name (its gap is
    greedy), so a written-out month gives no period.
    """
    d = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 5
    due = F.concat(F.lit("לתשלום עד "), F.date_format(F.date_add(d, 10), "dd.MM.yyyy"))
    month_he = dates.month_label_he(d)
    text = (
        F.when(
            kind == 0,
            F.concat(
                F.lit("from "), F.date_format(d, "dd/MM/yyyy"), F.lit(" – "),
                F.date_format(F.date_add(d, 20), "d.M.yyyy"), F.lit("\n"), due,
            ),
        )
        .when(kind == 1, F.concat(due, F.lit("\nBilling: "), F.date_format(d, "MMMM yyyy")))
        .when(kind == 2, F.concat(due, F.lit("\n"), F.date_format(d, "yyyy "), month_he, F.lit("-"), month_he))
        .when(
            kind == 3,
            F.concat(
                F.date_format(F.last_day(F.add_months(F.trunc(d, "month"), 1)), "dd/MM/yyyy"),
                F.lit("- ו"), F.date_format(F.last_day(d), "dd/MM/yyyy"),
                F.lit("- הוראת הקבע בחשבונך\n"), due,
            ),
        )
        .otherwise(
            F.concat(
                F.lit("PO #: PO-"), F.col("o_orderkey"), F.lit("\nAccount Number A-"),
                F.col("o_orderkey") + 1000, F.lit("\npo=PO-"), F.col("o_orderkey"), F.lit("\n"), due,
            )
        )
    )
    rows = v.table(spark, folder, "orders").select("o_orderkey", text.alias("text"))
    return rows.select(
        "o_orderkey",
        dates.period(F.col("text")).alias("p"),
        dates.due_date(F.col("text")).alias("due"),
        F.array_join(dates.reference_numbers(F.col("text")), "|").alias("refs"),
    ).select("o_orderkey", "p.*", "due", "refs")


# --- whole documents --------------------------------------------------------------------

_KIND0, _KIND2 = "kind = 0", "kind = 2"


@query(
    "extracted_totals",
    f"""with {v.TEXT_SQL} select source_file, cast(total as double) as invoice_total, case when {_KIND2} then 0.0 else cast(vat as double) end as invoice_vat,
      case when {_KIND2} then null else cast(net as double) end as base_before_vat, case when {_KIND2} then 0.0 else cast(rate as double) end as vat_rate,
      {_KIND2} as municipal, case when {_KIND2} then cast(total as double) end as breakdown_sum,
      case kind when 0 then 'marker_line' when 1 then 'inline_marker' else 'municipal_block' end as total_rule from said""",
)
def extracted_totals(spark, folder):
    docs = v.invoice_texts(spark, folder).select(
        "source_file", "text", tx.extract_lines(F.col("text")).alias("lines")
    )
    return totals.resolve_totals(docs).select(
        "source_file",
        "invoice_total",
        "invoice_vat",
        "base_before_vat",
        "vat_rate",
        "municipal",
        "breakdown_sum",
        "total_rule",
    )


@query(
    "extracted_identity",
    f"""with {v.TEXT_SQL} select source_file, number as invoice_id, strftime(day, '%d/%m/%Y') as invoice_date,
      case kind when 0 then s_name when 1 then s_name || ' Ltd' else 'עיריית ' || n_name end as invoice_from,
      case kind when 0 then 'שירותי אספקה עבור הזמנה ' || orderkey end as invoice_for from said""",
)
def extracted_identity(spark, folder):
    docs = v.invoice_texts(spark, folder).select(
        "source_file", "text", tx.extract_lines(F.col("text")).alias("lines")
    )
    lines, text = F.col("lines"), F.col("text")
    return docs.select(
        "source_file",
        fields.invoice_id(lines, text).alias("invoice_id"),
        dates.invoice_date(text).alias("invoice_date"),
        fields.invoice_from(lines, text).alias("invoice_from"),
        fields.invoice_for(lines, text).alias("invoice_for"),
    )


_RECORD_SQL = f"""{v.TEXT_SQL},
  rec as (select source_file, number as invoice_id, strftime(day, '%d/%m/%Y') as invoice_date,
      case kind when 0 then s_name when 1 then s_name || ' Ltd' else 'עיריית ' || n_name end as invoice_from,
      case when {_KIND2} then null else cast(net as double) end as base_before_vat, case when {_KIND2} then 0.0 else cast(vat as double) end as invoice_vat,
      cast(total as double) as invoice_total, '₪' as currency,
      case when {_KIND0} then strftime(date_trunc('month', day), '%Y-%m-%d') end as period_start, case when {_KIND0} then strftime(last_day(day), '%Y-%m-%d') end as period_end,
      case when {_KIND0} then strftime(day + 30, '%Y-%m-%d') end as due_date,
      case kind when 0 then 'services' when 2 then 'municipal_tax' end as category, case kind when 0 then 'keyword:שירות' when 2 then 'municipal_flag' end as category_rule,
      case when {_KIND0} then 'PO-' || orderkey else '' end as reference_numbers, 'pdfminer' as data_source,
      cast(round(cast(least(0.99, 0.4 + 0.25 + 0.1 + case when {_KIND2} then 0.15 else 0 end + case when {_KIND0} then 0.05 else 0 end + case when {_KIND0} then 0.05 else 0 end
        + case when kind <> 1 then 0.05 else 0 end) as decimal(10,6)), 4) as double) as parse_confidence, {_KIND2} as municipal from said)"""


def extracted_records(spark, folder):
    return extract.extract_invoices(v.invoice_texts(spark, folder))


@query("extracted_records", f"with {_RECORD_SQL} select * from rec")
def extracted_record_rows(spark, folder):
    records = extracted_records(spark, folder)
    return records.select(
        "source_file",
        "invoice_id",
        "invoice_date",
        "invoice_from",
        "base_before_vat",
        "invoice_vat",
        "invoice_total",
        "currency",
        "period_start",
        "period_end",
        "due_date",
        "category",
        "category_rule",
        F.coalesce(F.array_join("reference_numbers", "|"), F.lit("")).alias("reference_numbers"),
        "data_source",
        F.round(F.col("parse_confidence").cast("decimal(28,10)"), 4).cast("double").alias("parse_confidence"),
        "municipal",
    )


@query(
    "extracted_report",
    f"""with {_RECORD_SQL} select coalesce(category, 'none') as category, count(*) as invoices, cast(sum(cast(invoice_vat as decimal(18,2))) as double) as invoice_vat,
      cast(sum(cast(invoice_total as decimal(18,2))) as double) as invoice_total from rec group by 1""",
)
def extracted_report(spark, folder):
    """From document text to totals per category in one job."""
    records = extracted_records(spark, folder)

    def total(c):
        return F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c)

    return records.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(
        F.count(F.lit(1)).alias("invoices"), total("invoice_vat"), total("invoice_total")
    )


@query(
    "repeated_amounts",
    """with o as (select l_orderkey, cast(round(l_quantity * 2, 2) as double) as a from lineitem),
      c as (select l_orderkey, a, count(*) as n from o group by 1, 2), b as (select l_orderkey, max(a) filter (where a >= 50) as big, max(a) as top,
        max(struct_pack(n := n, a := a)) filter (where n >= 2 and a >= 50) as rep from c group by 1)
    select l_orderkey, coalesce(rep.a, big, top) as amount from b""",
)
def repeated_amounts(spark, folder):
    """The amount an order repeats most."""
    amounts = v.table(spark, folder, "lineitem").select(
        "l_orderkey", (F.col("l_quantity") * 2).alias("a")
    )
    return report.repeated_totals(amounts, "l_orderkey", "a")


@query(
    "repeated_text_amounts",
    f"""select {_LI}, case when l_quantity >= 10 then l_quantity * 5 when l_extendedprice >= 50 then l_extendedprice else greatest(l_extendedprice, l_quantity * 5) end as amount from lineitem""",
)
def repeated_text_amounts(spark, folder):
    """The currency amount a document repeats most."""
    five = (F.col("l_quantity") * 5).cast("decimal(18,2)").cast("string")
    text = F.concat(
        F.lit("₪ "), five, F.lit("\nx ₪"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.lit("\n₪  "), five, F.lit(" 99999999.00"),
    )
    return v.table(spark, folder, "lineitem").select(
        *_KEYS, money.repeated_currency_total(money.shekel_tokens(text)).alias("amount")
    )


@query(
    "numeric_blocks",
    f"""select {_LI}, cast(cast(l_extendedprice as decimal(18,2)) + cast(l_quantity as decimal(18,2)) - l_partkey as double) as block_sum, 3::bigint as lines from lineitem""",
)
def numeric_blocks(spark, folder):
    """Numbers alone on a line between the start and end markers of a block."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    text = F.concat(
        F.lit("99.50\nח\"שב\n"), price, F.lit("\n12.00 ₪\n"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit("\n-"),
        F.col("l_partkey").cast("string"), F.lit("\nסכנה\n12.00"),
    )
    values = totals.numeric_block(tx.extract_lines(text))
    docs = v.table(spark, folder, "lineitem").select(*_KEYS, values.alias("v"))
    return docs.select(
        *_KEYS,
        totals.sum_values(F.col("v")).alias("block_sum"),
        F.size("v").cast("bigint").alias("lines"),
    )


@query(
    "amounts_near_lines",
    f"""with {v.TEXT_SQL} select source_file, case when kind = 1 then cast(net as double) end as net_line, case when kind = 1 then cast(total as double) end as total_inline,
      case when kind = 1 then cast(net as double) || ',' || cast(vat as double) || ',' || cast(total as double) else '' end as near, case when kind = 1 then cast(net as double) end as run_max from said""",
)
def amounts_near_lines(spark, folder):
    """Marker-line lookups: inline, around and nearby amounts; one layout has the markers."""
    docs = v.invoice_texts(spark, folder).select("source_file", tx.merged_text(F.col("text")).alias("whole"))
    docs = docs.select("*", tx.lines_of(F.col("whole")).alias("lines"))
    ls, net, total, above = F.col("lines"), 'מ"עמ ינפל', 'םולשתל כ"הס', "הערות"

    def marked(marker, value):
        return fields.lazily(tx.has(F.col("whole"), marker), value)

    docs = docs.select("*", marked(above, totals.line_values(ls)).alias("values"))
    # the VAT line holds two numbers, so the run after the line above the amounts ends there
    runs = marked(above, totals.runs_after_marker(ls, F.col("values"), above))
    near = marked(net, totals.amounts_near_marker(ls, net))
    return docs.select(
        "source_file",
        marked(net, totals.amount_around_marker(ls, net)).alias("net_line"),
        marked(total, totals.amount_on_marker_lines(ls, total)).alias("total_inline"),
        F.coalesce(F.array_join(F.transform(near, lambda a: a.cast("string")), ","), F.lit("")).alias("near"),
        F.array_max(F.transform(runs, lambda r: F.array_max(r))).alias("run_max"),
    )


_BILLS = """
  bill as (select l_orderkey, l_suppkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as net from lineitem group by 1, 2),
  bills as (select *, cast(round(net * 0.18, 2) as decimal(18,2)) as vat from bill)"""


@query(
    "periodic_bills",
    f"with {_BILLS} select l_orderkey, l_suppkey, cast(net + vat as double) as total, cast(net as double) as base, cast(vat as double) as vat from bills",
)
def periodic_bills(spark, folder):
    """Periodic bills whose amounts are written cents first."""
    bills = (
        v.table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("net"))
        .withColumn("vat", F.round(F.col("net") * F.lit(0.18).cast("decimal(4,2)"), 2).cast("decimal(18,2)"))
    )

    def cents_first(c):
        shown = F.format_number(c, 2)
        return F.concat(
            F.right(shown, F.lit(2)), F.lit(" . "), F.lpad(F.substring_index(shown, ".", 1), 12, "0"), F.lit(" { ")
        )

    page = F.concat(
        F.lit('חשבון תקופתי סה"כ חיובי החשבון לא כולל מע"מ%) '), cents_first(F.col("net")),
        F.lit('מע"מ% 18 '), cents_first(F.col("vat")),
        F.lit('סה"כ חיובים וזיכויים לתקופת החשבון כולל מע"מ '), cents_first(F.col("net") + F.col("vat")),
    )
    found = totals.periodic_bill_override(F.array(F.lit("cover page"), page))
    return bills.select("l_orderkey", "l_suppkey", found.alias("f")).select(
        "l_orderkey", "l_suppkey", "f.total", "f.base", "f.vat"
    )


@query(
    "municipal_page_split",
    f"""with {v.PRICED_SQL}, m as (select * from priced),
      pages as (select orderkey, count(*) over (partition by orderkey) as n, suppkey, net, vat, day, s_name from m)
    select 'doc_' || orderkey || '.pdf' as source_file, case when n >= 2 then '8' || lpad(cast(suppkey as varchar), 9, '0') end as invoice_id,
      case when n >= 2 then s_name end as invoice_for, case when n >= 2 then cast(net - vat as double) else 7.5 end as invoice_total,
      case when n >= 2 then cast(net - vat as double) end as breakdown_sum, case when n >= 2 then 0.0::double else 1.0::double end as invoice_vat
    from pages qualify n >= 2 or row_number() over (partition by orderkey order by suppkey) = 1""",
)
def municipal_page_split(spark, folder):
    """Direct-debit documents: one page per supplier of an order, one record per page."""
    p = v.priced_invoices(spark, folder)
    name = F.concat(F.lit("doc_"), "orderkey", F.lit(".pdf"))
    number = F.concat(F.lit("8"), F.lpad(F.col("suppkey").cast("string"), 9, "0"))
    charged = (F.col("net") - F.col("vat")).cast("double")
    pages = p.select(
        name.alias("source_file"),
        F.col("suppkey").alias("page_no"),
        F.concat_ws(
            "\n",
            F.lit('סה"כ יגבה מהחשבון בש"ח:'),
            "s_name",
            number,
            F.concat(F.col("net").cast("string"), F.lit(" חיוב תקופתי ארנונה")),
            F.concat(F.col("vat").cast("string"), F.lit(" הנחת גביה בבנק")),
        ).alias("text"),
        F.when(F.col("orderkey") % 2 == 0, charged).alias("charged"),
    )
    none = F.lit(None)
    base = p.select(name.alias("source_file")).distinct().select(
        "source_file",
        none.cast("string").alias("invoice_id"),
        none.cast("string").alias("invoice_date"),
        none.cast("string").alias("invoice_for"),
        F.lit(7.5).alias("invoice_total"),
        F.lit(1.0).alias("invoice_vat"),
        none.cast("double").alias("breakdown_sum"),
        none.cast("array<double>").alias("breakdown_values"),
        none.cast("string").alias("notes"),
        none.cast("string").alias("period_start"),
        none.cast("string").alias("period_end"),
        none.cast("array<string>").alias("reference_numbers"),
        F.lit("municipal_tax").alias("category"),
        F.lit("pdfminer").alias("data_source"),
        F.lit(0.5).alias("parse_confidence"),
        F.lit(True).alias("municipal"),
    )
    return extract.split_municipal_pages(base, pages).select(
        "source_file", "invoice_id", "invoice_for", "invoice_total", "breakdown_sum", "invoice_vat"
    )


@query(
    "label_line_amounts",
    """with w as (select l_orderkey as doc_id, max(l_linenumber) as k, max(cast(l_extendedprice as decimal(18,2))) as top from lineitem group by 1)
    select doc_id, 0 as page_no, cast(top as double) as amount from w""",
)
def label_line_amounts(spark, folder):
    """Word boxes: the number printed in pieces on the height of its label."""
    orders = (
        v.table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.max(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("top"))
    )
    whole, cents = F.substring_index("top", ".", 1), F.substring_index("top", ".", -1)

    def word(no, x, y, text, line):
        return F.struct(
            F.lit(no).alias("word_no"), F.lit(x).alias("x0"), F.lit(y).alias("y0"),
            text.alias("text"), F.lit(0).alias("block"), F.lit(line).alias("line"),
        )

    words = F.array(
        word(0, 5.0, 90.0, F.lit("11.11"), 0),
        word(1, 30.0, 100.0, F.lit('סה"כ'), 1),
        word(2, 20.0, 100.2, F.lit("יגבה"), 1),
        word(3, 80.0, 100.4, F.concat(F.lit("."), cents), 2),
        word(4, 70.0, 99.9, whole, 2),
        word(5, 60.0, 120.0, F.lit("22.22"), 3),
    )
    boxes = orders.select("doc_id", F.lit(0).alias("page_no"), F.inline(words))
    return totals.label_amounts(boxes, ("יגבה",))


def paged_documents(spark, folder):
    """Municipal direct-debit documents: a page for each supplier of an order.

    Every page has its text and its word boxes.  On every third order the amount stands on the
    height of the debit label, in two words; on the next one beside the second label word; on
    the last there is no amount but that of the charges.
    """
    nations = v.table(spark, folder, "nation").select("n_nationkey", "n_name")
    p = v.priced_invoices(spark, folder).join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    number = F.concat(F.lit("8"), F.lpad(F.col("suppkey").cast("string"), 9, "0"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("עיריית "), "n_name"),
        F.concat(F.lit("תאריך הדפסה: "), F.date_format("day", "dd/MM/yyyy")),
        F.lit('סה"כ יגבה מהחשבון'),
        "s_name",
        number,
        F.concat(F.col("net").cast("string"), F.lit(" חיוב תקופתי ארנונה")),
        F.concat(F.col("vat").cast("string"), F.lit(" הנחת גביה בבנק")),
    )
    charged = (F.col("net") - F.col("vat") + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(18,2)").cast("string")
    whole, cents = F.substring_index(charged, ".", 1), F.substring_index(charged, ".", -1)
    kind = F.col("orderkey") % 3

    def word(x, y, text, line):
        return F.struct(
            F.lit(x).alias("x0"), F.lit(y).alias("y0"), text.alias("text"), F.lit(0).alias("block"), F.lit(line).alias("line")
        )

    label = F.when(kind == 0, "יגבה").when(kind == 1, "לתשלום").otherwise("אחר")
    words = F.array(
        word(9.0, 80.0, F.lit("11.11"), 0),
        word(5.0, 100.0, label, 1),
        word(70.0, 100.3, F.concat(F.lit("."), cents), 2),
        word(60.0, 99.8, whole, 2),
        word(60.0, 101.0, F.lit("22.22"), 3),
    )
    page = F.struct("suppkey", text.alias("text"), words.alias("words"))
    # an order has a handful of lines
    docs = p.groupBy("orderkey").agg(F.array_sort(F.collect_list(page)).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    return docs.select(
        F.concat(F.lit("doc_"), "orderkey", F.lit(".pdf")).alias("source_file"),
        F.array_join(texts, "\n").alias("text"),
        texts.alias("pages"),
        F.transform("p", lambda x: x["words"]).alias("page_words"),
    )


@query(
    "extracted_page_records",
    f"""with {v.PRICED_SQL}, pages as (select p.*, count(*) over (partition by orderkey) as n, first_value(n_name) over (partition by orderkey order by suppkey) as council
        from priced p left join nation on s_nationkey = n_nationkey)
    select 'doc_' || orderkey || '.pdf' as source_file, '8' || lpad(cast(suppkey as varchar), 9, '0') as invoice_id, strftime(day, '%d/%m/%Y') as invoice_date, 'עיריית ' || council as invoice_from,
      case when n >= 2 then s_name else 'ארנונה' end as invoice_for, cast(case when n < 2 then net when orderkey % 3 = 2 then net - vat else net - vat + 0.5 end as double) as invoice_total,
      0.0::double as invoice_vat, case when n >= 2 then cast(net - vat as double) end as breakdown_sum, true as municipal, 'municipal_tax' as category,
      case when n >= 2 then 'pymupdf' else 'pdfminer' end as data_source, null::varchar as notes from pages""",
)
def extracted_page_records(spark, folder):
    """From paged documents to records: extraction, label amounts and page split in one map stage."""
    return extract.extract_records(paged_documents(spark, folder)).select(
        "source_file", "invoice_id", "invoice_date", "invoice_from", "invoice_for", "invoice_total", "invoice_vat",
        "breakdown_sum", "municipal", "category", "data_source", "notes",
    )


# --- rules by layout ---------------------------------------------------------------------


@query(
    "total_rule_layouts",
    f"""with {v.PRICED_SQL}, k as (select *, cast((orderkey + suppkey) % 9 as integer) as kind, net + vat as total, net + 10 + suppkey % 30 as near from priced)
    select source_file, kind, case when kind in (0, 1) then 'total_with_vat' when kind = 2 then 'currency_amount' when kind in (3, 4, 5) then 'text_pattern'
        when kind = 6 then 'amount_block' when kind = 7 then 'direct_debit' else 'text_pattern' end as total_rule,
      cast(case when kind in (0, 1) then near when kind = 7 then net else total end as double) as invoice_total,
      case when kind = 8 then cast(total as double) end as breakdown_sum, case when kind = 8 then 2 end::integer as breakdown_lines
    from k where net > 60""",
)
def total_rule_layouts(spark, folder):
    """A layout for each rule that finds a total; which rule it was is part of the result."""
    p = v.priced_invoices(spark, folder).where("net > 60")
    net, vat = F.col("net").cast("string"), F.col("vat").cast("string")
    total = (F.col("net") + F.col("vat")).cast("string")
    more = (F.col("net") + F.col("vat") + 100).cast("string")
    near = (F.col("net") + 10 + F.col("suppkey") % 30).cast("string")
    kind = ((F.col("orderkey") + F.col("suppkey")) % 9).cast("int")
    layouts = [
        # a somewhat smaller labelled amount, then the line that includes VAT
        ('סה"כ: ', net, '\nפרטים\nעוד\nועוד\nסה"כ כולל מע"מ: ', near),
        # the three words on three lines
        ('סה"כ ', net, '\nמע"מ\nכולל ', near),
        # a shekel amount well below the labelled one
        ("סה\"כ: ", more, "\nאחר\nאחר\nאחר\nאחר\n₪ ", total),
        # spellings that no marker has: direct, before the words, at a distance
        ("סה'כ: ", total),
        ("שורה\n", total, "\nסה'כ לתשלום"),
        (total, " ש'ח בגין הזמנה\nסה'כ לתשלום"),
        # a run of amounts below another marker, more than 50 above the labelled one
        ('סה"כ\n4.50\nשם\nשם\nסה"כ\n', total, "\n12.00\n13.00"),
        # amounts written from the end, above a line that starts with 4
        ("סה'כ יגבה מהחשבון:\n*\n# ", F.reverse(net), "\n4 תשלומים"),
        # the bill-detail section of the television layout
        ("סה'כ: ", total, "\nןובשחה טוריפ ", net, " ועוד ", vat, " עצבמב לולכ 99.00"),
    ]
    text = F.lit(None).cast("string")
    for k, parts in enumerate(layouts):
        written = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        text = F.when(kind == k, written).otherwise(text)
    docs = p.select("source_file", kind.alias("kind"), text.alias("text"))
    docs = docs.select("*", tx.extract_lines(F.col("text")).alias("lines"))
    return totals.resolve_totals(docs).select(
        "source_file", "kind", "total_rule", "invoice_total", "breakdown_sum", F.size("breakdown_values").alias("breakdown_lines")
    )


_HE = "['ינואר','פברואר','מרץ','אפריל','מאי','יוני','יולי','אוגוסט','ספטמבר','אוקטובר','נובמבר','דצמבר']"


@query(
    "description_layouts",
    f"""with {v.PRICED_SQL}, k as (select *, cast((orderkey + suppkey) % 13 as integer) as kind, {_HE}[month(day)] as he, strftime(day, '%m/%y') as my from priced)
    select source_file, kind, case kind when 0 then 'חניון ' || s_name when 1 then 'חניה' when 2 then 'רב-קו - טעינה' when 3 then 'חוג תנועה ' || he || ' 20' || lpad(cast(suppkey % 100 as varchar), 2, '0')
      when 4 then 'חוג תיאטרון חודש ' || he || ' | חוג חודש ' || he when 5 then 'שירותי תוכן בינלאומיים | ספריות וערוצי פרימיום' when 6 then 'תפעול פנסיוני- שוטף ' || my
      when 7 then 'מנוי ' || s_name || ' | שיחות | גלישה | תוספת' when 8 then orderkey || ' מנויי סלולר | 1 מנוי תמסורת ' || suppkey || ' | תנועות כלליות בחשבון הלקוח'
      when 9 then 'פריט א ' || s_name || ' | פריט ב | פריט ג | פריט ד | פריט ה' when 10 then 'דמי שימוש ' || s_name when 11 then 'תשלום עבור ' || s_name else 'ארנונה לעסקים' end as invoice_for
    from k""",
)
def description_layouts(spark, folder):
    """A layout for each rule that finds what an invoice is for."""
    p = v.priced_invoices(spark, folder)
    kind = ((F.col("orderkey") + F.col("suppkey")) % 13).cast("int")
    name, order, supplier = F.col("s_name"), F.col("orderkey").cast("string"), F.col("suppkey").cast("string")
    he, short = dates.month_label_he(F.col("day")), F.date_format("day", "MM/yy")
    year = F.concat(F.lit("20"), F.lpad((F.col("suppkey") % 100).cast("string"), 2, "0"))
    layouts = [
        ("קבלה\nחניון ", name, " 03-1234567\nסיום"),
        ("קבלה\nפירוט החניות\nסיום",),
        ("קבלה\nטעינת רב-קו\nסיום",),
        ("פירוט ", year, " ", he, " תנועה חוג",),
        ("חוג תיאטרון חודש ", he, "\nחוג חודש ", he, "\n", he, " חודש חוג"),
        ("םיימואלניב ןכות יתוריש\nספריות וערוצי פרימיום",),
        ("Just Simple Ltd\nתיאור\nתפעול\nפנסיוני שוטף\n", short, "\nכמות 1"),
        ("פירוט חיובים וזיכויים לתקופת החשבון\nמנוי ", name, "\n12.5\nשיחות\nגלישה\nתוספת\nחמישי\nסה\"כ 5"),
        ("x\nפירוט חיובים\nוזיכויים לתקופת החשבון ", order, "מנויי סלולר 1מנוי תמסורת ", supplier, " תנועות כלליות בחשבון הלקוח סה\"כ חיובי החשבון"),
        (":םיטרפ\nפריט א ", name, "\nאב\nפריט ב\nפריט ג\nפריט ד\nפריט ה\nפריט ו\nטקמ 5"),
        ("פירוט החיוב: נכס 12\nכתובת: שם\n123 דמי שימוש ", name, "\nאחר"),
        ("שורה\nתשלום עבור ", name, "\nסוף"),
        ("הודעה על ארנונה לעסקים\nסוף",),
    ]
    text = F.lit(None).cast("string")
    for k, parts in enumerate(layouts):
        written = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        text = F.when(kind == k, written).otherwise(text)
    docs = p.select("source_file", kind.alias("kind"), text.alias("text"))
    docs = docs.select("*", tx.extract_lines(F.col("text")).alias("lines"))
    return docs.select("source_file", "kind", fields.invoice_for(F.col("lines"), F.col("text")).alias("invoice_for"))


@query(
    "mismatch_notes",
    f"""select {_LI}, case when abs(l_quantity - l_tax * 100) > 1 then case when l_linenumber % 3 = 1 then 'first; ' else '' end || 'Total differs from breakdown sum' when l_linenumber % 3 = 1 then 'first' when l_linenumber % 3 = 2 then '' end as notes from lineitem""",
)
def mismatch_notes(spark, folder):
    li = v.table(spark, folder, "lineitem")
    third = F.col("l_linenumber") % 3
    notes = F.when(third == 1, "first").when(third == 2, "")
    return li.select(*_KEYS, fields.mismatch_note(notes, F.col("l_quantity"), F.col("l_tax") * 100).alias("notes"))


@query(
    "place_marks",
    f"""with {v.PRICED_SQL}, k as (select *, orderkey % 4 as a, suppkey % 3 as b from priced)
    select source_file, a in (1, 2) and b = 1 as petah_tikva, b = 2 or (b = 0 and a = 3) as transport from k""",
)
def place_marks(spark, folder):
    """A city with a municipal word, and words of public transport in two scripts."""
    p = v.priced_invoices(spark, folder)
    a, b = F.col("orderkey") % 4, F.col("suppkey") % 3
    city = F.when(a == 1, "פתח תקוה").when(a == 2, "הווקת חתפ").otherwise("עיר")
    word = F.when(b == 1, " עירייה").when(b == 2, " רב-קו").when(a == 3, " RavKav").otherwise(" אחר")
    text = F.concat("s_name", F.lit(" "), city, word)
    return p.select("source_file", tx.looks_like_petah_tikva(text).alias("petah_tikva"), tx.has_public_transport_marker(text).alias("transport"))
