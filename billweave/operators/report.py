"""Report totals, subtotals, feeds and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..functions.money import money_text, plain_money_text
from ..session import checkpoint

CENTS = "decimal(38,2)"
METRICS = ("invoice_vat", "invoice_total")
SUMMARY_FIELDS = (
    "metric",
    "sum",
    "abs_sum",
    "count",
    "missing",
    "zero",
    "negative",
    "positive",
    "min",
    "max",
    "avg",
)
AMOUNTS = ("base_before_vat", "invoice_vat", "invoice_total")


def exact(value: Column) -> Column:
    return value.cast("decimal(38,10)")


def cents(value: Column) -> Column:
    return F.round(value, 2).cast("double")


def report_totals(records: DataFrame) -> DataFrame:
    """Totals per metric in one pass; zero amounts are only counted as zero.

    Sums are decimal.  The wide one-row aggregate is turned into rows afterwards, so the
    records are neither duplicated nor shuffled for the unpivot.
    """

    def stats(name: str) -> list[Column]:
        v = exact(F.col(name))
        used = F.when(v != 0, v)
        total = F.coalesce(F.sum(used), F.lit(0).cast("decimal(38,10)"))
        return [
            F.struct(
                F.lit(name).alias("metric"),
                cents(total).alias("sum"),
                cents(F.coalesce(F.sum(F.abs(used)), F.lit(0).cast("decimal(38,10)"))).alias(
                    "abs_sum"
                ),
                F.count(used).alias("count"),
                F.count_if(v.isNull()).alias("missing"),
                F.count_if(v == 0).alias("zero"),
                F.count_if(v < 0).alias("negative"),
                F.count_if(v > 0).alias("positive"),
                cents(F.min(used)).alias("min"),
                cents(F.max(used)).alias("max"),
                cents(F.try_divide(total, F.count(used))).alias("avg"),
            )
        ]

    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    head = F.struct(
        F.lit("records").alias("metric"),
        none.alias("sum"),
        none.alias("abs_sum"),
        F.count(F.lit(1)).alias("count"),
        nothing.alias("missing"),
        nothing.alias("zero"),
        nothing.alias("negative"),
        nothing.alias("positive"),
        none.alias("min"),
        none.alias("max"),
        none.alias("avg"),
    )
    rows = [head] + [s for m in METRICS for s in stats(m)]
    return records.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def net_vat_gross(totals: DataFrame) -> DataFrame:
    """Net, VAT and gross from summary rows; sums that are missing or unreadable count 0."""

    def of(metric: str) -> Column:
        found = F.max(F.when(F.trim("metric") == metric, F.col("sum").try_cast("double")))
        return F.coalesce(found, F.lit(0.0))

    return totals.agg(of("invoice_total").alias("gross_total"), of("invoice_vat").alias("vat_total")).select(
        cents(exact(F.col("gross_total")) - exact(F.col("vat_total"))).alias("net_total"),
        "vat_total",
        "gross_total",
    )


def vendor_name(vendor: Column) -> Column:
    return F.coalesce(
        F.nullif(tx.squeeze(F.coalesce(vendor, F.lit(""))), F.lit("")), F.lit("Unknown Vendor")
    )


def sums(prefix: str = "") -> list[Column]:
    return [F.sum(F.col(a) if prefix else exact(F.col(a))).alias(a) for a in AMOUNTS]


def vendor_subtotals(records: DataFrame) -> DataFrame:
    """Subtotal per vendor and the grand total (is_total).

    Records are first summed per vendor; only that small result is rolled up, so the
    rollup does not expand the records.  A sum of only NULLs is NULL.
    """
    per_vendor = records.groupBy(vendor_name(F.col("invoice_from")).alias("vendor")).agg(
        F.count(F.lit(1)).alias("invoices"), *sums()
    )
    rolled = per_vendor.rollup("vendor").agg(
        F.sum("invoices").alias("invoices"),
        *sums("summed"),
        F.grouping("vendor").cast("boolean").alias("is_total"),
    )
    return rolled.select(
        "vendor", "is_total", "invoices", *[cents(F.col(a)).alias(a) for a in AMOUNTS]
    )


def report_feed(
    records: DataFrame, vendor_subtotal_rows: bool = True, skip_single: bool = False
) -> DataFrame:
    """The rows of feed_rows in report order."""
    return in_report_order(feed_rows(records, vendor_subtotal_rows, skip_single))


def in_report_order(feed: DataFrame) -> DataFrame:
    return feed.orderBy(
        F.col("row_rank") == 2,
        "vendor_key",
        "vendor",
        "row_rank",
        "date_key",
        F.coalesce("invoice_id", F.lit("")),
        "source_file",
    )


def feed_rows(
    records: DataFrame, vendor_subtotal_rows: bool = True, skip_single: bool = False
) -> DataFrame:
    """Detail rows, a subtotal after each vendor and the grand total, in any order.

    Vendors sort without case; a display name is one vendor.  row_rank puts the subtotal
    behind its details and the total last.  The details are written once; the subtotals and
    the sort, which looks at its input twice, read them from there.
    """
    records = checkpoint(
        records.select("source_file", "invoice_id", "invoice_date", "invoice_from", "invoice_for", *AMOUNTS)
    )
    name = vendor_name(F.col("invoice_from"))
    detail = records.select(
        F.lit("detail").alias("row_type"),
        F.lower(name).alias("vendor_key"),
        name.alias("vendor"),
        F.lit(0).alias("row_rank"),
        dates.sort_date(F.col("invoice_date")).alias("date_key"),
        "invoice_id",
        "source_file",
        "invoice_from",
        "invoice_for",
        *[cents(exact(F.col(a))).alias(a) for a in AMOUNTS],
    )
    # one small row per vendor, used for the subtotals and for the total
    per_vendor = checkpoint(vendor_subtotals(records))

    def summary(rows: DataFrame, kind: str, label: str, rank: int, shown: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(
            F.lit(kind).alias("row_type"),
            F.lower("vendor").alias("vendor_key"),
            "vendor",
            F.lit(rank).alias("row_rank"),
            none.alias("date_key"),
            none.alias("invoice_id"),
            none.alias("source_file"),
            shown.alias("invoice_from"),
            F.lit(label).alias("invoice_for"),
            *AMOUNTS,
        )

    feed = detail
    if vendor_subtotal_rows:
        wanted = per_vendor.where("not is_total")
        if skip_single:
            wanted = wanted.where("invoices > 1")
        feed = feed.unionByName(
            summary(wanted, "vendor_subtotal", "Vendor Subtotal", 1, F.col("vendor"))
        )
    feed = feed.unionByName(
        summary(
            per_vendor.where("is_total"), "grand_total", "Grand Total", 2, F.lit(None).cast("string")
        )
    )
    return feed


def feed_positions(feed: DataFrame) -> DataFrame:
    """The feed with the position of each row in report order, from 1.

    The rows are written once in report order, each with its place inside its part; a part's
    offset is the number of rows in the parts before it.
    """
    ordered = in_report_order(feed).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpoint(ordered)
    # the id has the number of the part above 33 bits for the row inside it
    part = F.shiftright("_at", 33).cast("int")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each part: a window over them all is small
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.select(*feed.columns, (F.col("offset") + inside + 1).cast("long").alias("position"))


def feed_cells(feed: DataFrame) -> DataFrame:
    """The feed as printed: money with separators, text squeezed and shortened."""
    shown = ("invoice_id", "invoice_from", "invoice_for")
    return feed.select(
        "row_type",
        "source_file",
        *[tx.display_value(F.col(c)).alias(c) for c in shown],
        *[money_text(F.col(a)).alias(a) for a in AMOUNTS],
    )


def record_cells(records: DataFrame) -> DataFrame:
    """Records as CSV text: two decimals, true/false, JSON lists, empty for NULL."""
    out = []
    for f in records.schema.fields:
        kind, col = f.dataType.simpleString(), F.col(f.name)
        if kind == "double":
            cell = plain_money_text(col)
        elif kind.startswith("array"):
            cell = F.coalesce(F.to_json(col), F.lit(""))
        else:
            cell = F.coalesce(col.cast("string"), F.lit(""))
        out.append(cell.alias(f.name))
    return records.select(*out)


def summary_cells(totals: DataFrame) -> DataFrame:
    out = [F.col("metric")]
    for name in SUMMARY_FIELDS[1:]:
        money = name in ("sum", "abs_sum", "min", "max", "avg")
        cell = plain_money_text(F.col(name)) if money else F.coalesce(
            F.col(name).cast("string"), F.lit("")
        )
        out.append(cell.alias(name))
    return totals.select(*out)


def run_summary(results: DataFrame) -> DataFrame:
    """One manifest row per run from results(run, name, returncode, duration_seconds).

    The providers of a run are a short configured list, so the name lists stay small.
    """
    ok, failed = F.col("returncode") == 0, F.col("returncode") != 0

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("name"))))

    return (
        results.groupBy("run")
        .agg(
            F.max(failed).alias("any_failed"),
            F.max(ok).alias("any_ok"),
            names(ok).alias("successful_providers"),
            names(failed).alias("failed_providers"),
            F.sum("duration_seconds").alias("total_seconds"),
        )
        .select(
            "run",
            F.when(F.col("any_failed") & F.col("any_ok"), "partial_failure")
            .when(F.col("any_failed"), "failure")
            .otherwise("success")
            .alias("status"),
            "successful_providers",
            "failed_providers",
            "total_seconds",
            dates.duration_text(F.col("total_seconds")).alias("duration"),
        )
    )


def normalize_providers(requests: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """requests(id, raw) -> id, providers, unknown: aliases resolved, first-seen order."""
    names = F.filter(
        F.transform(F.split(F.coalesce("raw", F.lit("")), ","), lambda p: F.lower(tx.strip(p))),
        lambda p: p != "",
    )
    table = F.create_map(*[F.lit(x) for item in aliases.items() for x in item])
    resolved = F.transform(names, lambda p: F.try_element_at(table, p))
    default = F.array(F.lit("gmail"), F.lit("outlook"))
    return requests.select(
        "id",
        F.filter(names, lambda p: F.try_element_at(table, p).isNull()).alias("unknown"),
        F.array_distinct(resolved).alias("found"),
    ).select(
        "id",
        F.when(F.size("unknown") > 0, F.lit(None))
        .when(F.size("found") == 0, default)
        .otherwise(F.col("found"))
        .alias("providers"),
        "unknown",
    )


def threshold_sweep(rows: DataFrame, thresholds) -> DataFrame:
    """Rows at or above each threshold, in one pass over the confidences."""
    counts = [
        F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col("confidence") >= float(t)).alias("rows"))
        for t in sorted(thresholds)
    ]
    return rows.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def repeated_totals(amounts: DataFrame, key: str, amount: str) -> DataFrame:
    """Per key the amount of at least 50 seen most often (twice or more), else the largest.

    The relational form of money.repeated_currency_total for amounts that are rows: counted
    per (key, amount) first, so a key with very many amounts is never gathered.
    """
    value = cents(exact(F.col(amount)))
    counted = (
        amounts.where(value > 0)
        .groupBy(key, value.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    large = F.col("v") >= 50
    best = counted.groupBy(key).agg(
        F.max(F.when(large & (F.col("n") >= 2), F.struct("n", "v"))).alias("repeated"),
        F.max(F.when(large, F.col("v"))).alias("large"),
        F.max("v").alias("largest"),
    )
    return best.select(key, F.coalesce("repeated.v", "large", "largest").alias("amount"))


# --- review workspace -------------------------------------------------------------------

PRESETS = ("today", "yesterday", "thisWeek", "thisMonth")


def review_flags(items: DataFrame, reference: Column) -> DataFrame:
    return items.withColumn("is_overdue", F.coalesce(F.col("due_date") < reference, F.lit(False)))


def review_summary(items: DataFrame, reference: Column) -> DataFrame:
    """Summary band per time preset, all presets in one pass.

    items(invoice_date, due_date, amount, category, is_duplicate, is_quarantined,
    needs_review).  Suspicious: duplicate, quarantined or without category.
    """
    flagged = review_flags(items, reference)
    suspicious = F.col("is_duplicate") | F.col("is_quarantined") | F.col("category").isNull()
    rows = []
    for preset in PRESETS:
        within = F.coalesce(
            dates.preset_of(F.col("invoice_date"), reference, preset), F.lit(False)
        )
        rows.append(
            F.struct(
                F.lit(preset).alias("preset"),
                F.count_if(within).alias("invoices"),
                F.count_if(within & F.col("needs_review")).alias("needs_review"),
                F.count_if(within & suspicious).alias("duplicates_or_suspicious"),
                F.count_if(within & F.col("is_overdue")).alias("due_soon_or_overdue"),
                cents(
                    F.coalesce(
                        F.sum(F.when(within, exact(F.col("amount")))),
                        F.lit(0).cast("decimal(38,10)"),
                    )
                ).alias("total_amount"),
            )
        )
    return flagged.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def review_order(items: DataFrame, reference: Column) -> DataFrame:
    """Exception first: severity, then the nearest due date, then the newest invoice."""
    severity = (
        F.when(F.col("is_duplicate"), 4)
        .when(F.col("is_quarantined"), 3)
        .when(F.col("is_overdue"), 2)
        .when(F.col("category").isNull() | (F.col("confidence") < 0.6), 1)
        .otherwise(0)
    )
    return (
        review_flags(items, reference)
        .withColumn("severity", severity)
        .orderBy(F.desc("severity"), F.asc_nulls_last("due_date"), F.desc("invoice_date"))
    )


def view_integrity(items: DataFrame, details: DataFrame, views: DataFrame) -> DataFrame:
    """Problems between list items, details and saved views.

    items(id), details(key, id), views(view, invoice_ids, selected_id) -> problem, id.
    """
    members = views.select("view", F.explode("invoice_ids").alias("id"))
    return member_integrity(
        items, details, members, views.select("view", F.col("selected_id").alias("id"))
    )


def member_integrity(
    items: DataFrame, details: DataFrame, members: DataFrame, selected: DataFrame
) -> DataFrame:
    """The same for views given as rows: members(view, id), selected(view, id).

    Repeats are counted in one grouping of both sides, so a repeated id never multiplies rows
    and no side is sorted for it.  NULL ids of the two sides are not the same.
    """
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    off = (~F.col("id").eqNullSafe(F.col("key"))).cast("long")
    listed = items.select("id", one.alias("n"), none.alias("wrong"))
    keyed = details.select(F.col("key").alias("id"), none.alias("n"), off.alias("wrong"))
    side = F.col("id").isNull() & F.col("n").isNull()
    both = listed.union(keyed).groupBy("id", side.alias("_side"))
    both = both.agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))
    sides = both.select(
        "id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n") > 1, "repeated_item"),
                    F.when(F.col("wrong").isNull(), "item_without_detail"),
                    F.when(F.col("n").isNull(), "detail_without_item"),
                    F.when(F.col("wrong") > 0, "detail_key_mismatch"),
                )
            )
        ).alias("problem"),
    )
    unknown = members.join(keyed.select("id"), "id", "left_anti").distinct()
    unknown = unknown.select("id", F.concat(F.lit("unknown_in_view:"), "view").alias("problem"))
    # the members looked for are few: they are found before anything is kept
    found = members.join(selected, ["view", "id"], "left_semi")
    unlisted = selected.join(found, ["view", "id"], "left_anti").select(
        "id", F.concat(F.lit("selected_not_listed:"), "view").alias("problem")
    )
    return sides.unionByName(unknown).unionByName(unlisted).select("problem", "id")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values on one side only, with the side."""
    only_left = left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("left"))
    only_right = right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def view_items(views: DataFrame, items: DataFrame, details: DataFrame) -> DataFrame:
    """Saved views with the fields of their items and details."""
    members = views.select("view", "selected_id", F.posexplode("invoice_ids").alias("pos", "id"))
    return members.join(items, "id").join(details.drop("id").withColumnRenamed("key", "id"), "id")


def missing_artifacts(requests: DataFrame, produced: DataFrame) -> DataFrame:
    """requests(report_id, formats) against produced(report_id, format, path).

    One row per requested known format, with the path or missing = true.
    """
    known = ("json", "csv", "summary_csv", "pdf")
    wanted = requests.select("report_id", F.explode("formats").alias("format")).where(
        F.col("format").isin(*known)
    )
    return wanted.join(produced, ["report_id", "format"], "left").select(
        "report_id", "format", "path", F.col("path").isNull().alias("missing")
    )
