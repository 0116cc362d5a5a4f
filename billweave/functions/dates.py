"""Date tokens, periods and windows as Column expressions."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import extract, extract_all, first_match, let, matches, strip

LETTERS = "[A-Za-zא-ת]+"
ENGLISH_ABBREVIATIONS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def month_number(name: Column) -> Column:
    """1-12 for a Hebrew or English month name, else NULL."""
    months = F.from_json(F.lit(json.dumps(R.MONTHS)), "map<string,int>")
    return F.try_element_at(months, F.lower(name))


def month_label_he(day: Column) -> Column:
    labels = F.split(F.lit(",".join(R.MONTH_LABELS_HE)), ",")
    return F.element_at(labels, F.month(day))


def date_separators(token: Column) -> Column:
    return F.regexp_replace(strip(token), r"[\\/.,]", "-")


def _rearranged(token: Column, pattern: str, replacement: str) -> Column:
    p = rf"\A{pattern}\z"
    return F.when(
        F.regexp_like(token, F.lit(p)), F.regexp_replace(token, p, replacement)
    ).try_cast("date")


def _in_month(year: Column, month: Column, day: int | None) -> Column:
    # concat, not concat_ws: a missing month must give a missing date
    first = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01")).try_cast("date")
    if not day or day == 1:
        return first
    return F.date_add(first, F.least(F.lit(day), F.day(F.last_day(first))) - 1)


def parse_date_token(token: Column, default_day: int | None = None) -> Column:
    """DATE from the accepted spellings, tried in a fixed order.

    Year first, day first, two-digit years (69-99 are 19xx), month first, English month
    abbreviations, then month-and-year forms that take default_day, cut to the month end.
    """
    return let(date_separators(token), lambda t: _parse_separated(t, default_day))


def _parse_separated(t: Column, default_day: int | None) -> Column:
    d, old, new = r"(\d{1,2})-(\d{1,2})", r"(6[9]|[7-9]\d)", r"([0-5]\d|6[0-8])"
    abbr = rf"(?i)\A(\d{{1,2}})-({ENGLISH_ABBREVIATIONS})-(\d{{4}}|\d\d)\z"
    month = F.lpad(month_number(F.regexp_extract(t, abbr, 2)).cast("string"), 2, "0")
    day = F.lpad(F.regexp_extract(t, abbr, 1), 2, "0")
    named_year = F.regexp_extract(t, abbr, 3)
    full_year = (
        F.when(F.length(named_year) == 4, named_year)
        .when(named_year >= "69", F.concat(F.lit("19"), named_year))
        .otherwise(F.concat(F.lit("20"), named_year))
    )
    written = rf"\A({LETTERS})[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+(\d{{1,4}})\z"
    year_month, month_year = r"\A(\d{4})-(\d{1,2})\z", r"\A(\d{1,2})-(\d{4})\z"

    def in_month(pattern: str, year: int, month_group: int, named: bool = False) -> Column:
        m = F.regexp_extract(t, pattern, month_group)
        return F.when(
            F.regexp_like(t, F.lit(pattern)),
            _in_month(
                F.lpad(F.regexp_extract(t, pattern, year), 4, "0"),
                month_number(m).cast("string") if named else m,
                default_day,
            ),
        )

    return F.coalesce(
        _rearranged(t, r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1-$2-$3"),
        _rearranged(t, d + r"-(\d{4})", "$3-$2-$1"),
        _rearranged(t, f"{d}-{old}", "19$3-$2-$1"),
        _rearranged(t, f"{d}-{new}", "20$3-$2-$1"),
        _rearranged(t, d + r"-(\d{4})", "$3-$1-$2"),
        F.when(
            F.regexp_like(t, F.lit(abbr)),
            F.concat(full_year, F.lit("-"), month, F.lit("-"), day).try_cast("date"),
        ),
        in_month(year_month, 1, 2),
        in_month(month_year, 2, 1),
        in_month(written, 2, 1, named=True),
    )


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def normalize_date_token(token: Column, default_day: int | None = None) -> Column:
    return iso(parse_date_token(token, default_day))


def is_date_like_token(token: Column) -> Column:
    """Digits with one or two separators that form a year-first or two-digit-year date."""
    return let(
        date_separators(token),
        lambda t: F.coalesce(
            _rearranged(t, r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1-$2-$3"),
            _rearranged(t, r"(\d{1,2})-(\d{1,2})-(\d\d)", "20$3-$2-$1"),
            _rearranged(t, r"(\d{4})-(\d{1,2})", "$1-$2-1"),
        ).isNotNull(),
    )


def invoice_date(text: Column) -> Column:
    """dd/MM/yyyy of the labelled date, else of the first date in the text.

    A labelled date that is not a real date gives NULL; the text is then not searched.
    """
    labelled = first_match(text, R.INVOICE_DATE_PATTERNS)
    anywhere = extract(text, f"({R.DATE_TOKEN})")
    return F.date_format(parse_date_token(F.coalesce(labelled, anywhere)), "dd/MM/yyyy")


def due_date(text: Column) -> Column:
    firsts = ("(?=[dpלמת])", "(?=מ)")  # most positions fail at the first character
    tokens = F.array(*[extract(text, f + p, "iu") for f, p in zip(firsts, R.DUE_DATE_PATTERNS)])
    days = F.transform(tokens, lambda t: normalize_date_token(t))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def reference_numbers(text: Column) -> Column:
    """The distinct order, customer and account numbers."""
    firsts = ("(?=p)", "(?=מ)", "(?=[ca])")  # most positions fail at the first character
    found = F.concat(*[extract_all(text, f + p, "iu") for f, p in zip(firsts, R.REFERENCE_PATTERNS)])
    return F.array_distinct(found)


def period(text: Column) -> Column:
    """struct<start, end, label> of the billed period.

    In order: direct-debit dates, a written date range, a Hebrew month pair with a year,
    a labelled month and year.
    """
    debit_dates = F.array_sort(
        F.filter(
            F.transform(
                F.regexp_extract_all(
                    F.regexp_extract(text, "(?d)" + R.PERIOD_AUTOPAY_PATTERN, 0),
                    F.lit(r"(\d{2}/\d{2}/\d{4})"),
                    F.lit(1),
                ),
                lambda d: parse_date_token(d),
            ),
            lambda d: d.isNotNull(),
        )
    )

    def debit(days: Column) -> Column:
        start = F.trunc(F.get(days, F.lit(0)), "month")
        last = F.try_element_at(days, F.lit(-1))
        end = F.when(F.date_sub(last, 1) < start, last).otherwise(F.date_sub(last, 1))
        label = F.concat(month_label_he(start), F.lit(" - "), month_label_he(end))
        return F.when(F.size(days) >= 2, _period(iso(start), iso(end), label))

    def written(sides: Column) -> Column:
        label = F.concat(sides["a"], F.lit(" - "), sides["b"])
        return _period(sides["a"], sides["b"], label)

    def pair(p: Column) -> Column:
        label = F.concat(p["b"], F.lit(" - "), p["a"])
        return F.when(
            p["first"].isNotNull() & p["final"].isNotNull(),
            _period(iso(p["first"]), iso(p["final"]), label),
        )

    def single(p: Column) -> Column:
        label = F.concat(
            F.date_format(p["first"], "yyyy-MM"), F.lit(" ("), p["name"], F.lit(" "),
            p["year"].cast("int").cast("string"), F.lit(")"),
        )
        return F.when(
            p["first"].isNotNull(), _period(iso(p["first"]), iso(F.last_day(p["first"])), label)
        )

    def group(pattern: str, n: int, flags: str = "") -> Column:
        return extract(text, pattern, flags, n)

    def month_of(year: Column, name: Column) -> Column:
        return _in_month(year, month_number(name).cast("string"), None)

    # most positions fail at the first character of the words
    bilingual, labelled = R.PERIOD_BILINGUAL_PATTERN, r"(?=[תחbsm])" + R.PERIOD_MONTH_PATTERN
    nothing = F.lit(None).cast("string")
    return F.coalesce(
        F.when(F.contains(text, F.lit("הוראת הקבע")), let(debit_dates, debit)),
        F.when(
            matches(text, R.PERIOD_RANGE_PATTERN),
            let(
                F.struct(
                    normalize_date_token(group(R.PERIOD_RANGE_PATTERN, 1)).alias("a"),
                    normalize_date_token(group(R.PERIOD_RANGE_PATTERN, 2)).alias("b"),
                ),
                written,
            ),
        ),
        F.when(
            matches(text, bilingual),
            let(
                F.struct(
                    group(bilingual, 2).alias("a"),
                    group(bilingual, 3).alias("b"),
                    month_of(group(bilingual, 1), group(bilingual, 2)).alias("first"),
                    F.last_day(month_of(group(bilingual, 1), group(bilingual, 3))).alias("final"),
                ),
                pair,
            ),
        ),
        F.when(
            matches(text, labelled, "iu"),
            let(
                F.struct(
                    group(labelled, 1, "iu").alias("name"),
                    group(labelled, 2, "iu").alias("year"),
                    month_of(group(labelled, 2, "iu"), group(labelled, 1, "iu")).alias("first"),
                ),
                single,
            ),
        ),
        _period(nothing, nothing, nothing),
    )


def _period(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), label.alias("label"))


def month_window(year: Column, month: Column) -> Column:
    """struct<start_date, end_date, label>: first of the month, first of the next, MM_yyyy."""
    first = F.make_date(year, month, F.lit(1))
    return F.struct(
        iso(first).alias("start_date"),
        iso(F.add_months(first, 1)).alias("end_date"),
        F.date_format(first, "MM_yyyy").alias("label"),
    )


def preset_of(day: Column, reference: Column, preset: str) -> Column:
    """Whether a DATE falls in a preset window that ends on the reference date."""
    lower = {
        "today": reference,
        "yesterday": F.date_sub(reference, 1),
        "thisWeek": F.date_sub(reference, F.dayofweek(reference) - 1),
        "thisMonth": F.trunc(reference, "month"),
    }[preset]
    upper = F.date_sub(reference, 1) if preset == "yesterday" else reference
    return (day >= lower) & (day <= upper)


def checked_window(start: str, end: str) -> tuple[Column, Column]:
    """Timestamps of a half-open window of ISO dates; the end must be after the start."""
    if datetime.fromisoformat(end) <= datetime.fromisoformat(start):
        raise ValueError(f"the window must end after it starts: {start} .. {end}")
    return F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")


def local_date(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone).cast("date")


def utc_epoch(day: Column) -> Column:
    """Epoch seconds of UTC midnight of an ISO date."""
    return F.unix_date(day.cast("date")).cast("long") * 86400


def lenient_timestamp(text: Column) -> Column:
    """ISO dates and date-times; a missing offset means UTC (the session runs in UTC)."""
    # a bare time or year would be cast to a day of its own
    dated = F.when(F.regexp_like(strip(text), F.lit(r"\A\d{4}-\d{2}-\d{2}")), strip(text))
    return dated.try_cast("timestamp")


def duration_text(seconds: Column) -> Column:
    total = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string(
        "%02dh:%02dm:%02ds",
        F.floor(total / 3600),
        F.floor(F.pmod(total, F.lit(3600)) / 60),
        F.pmod(total, F.lit(60)),
    )


def sort_date(value: Column) -> Column:
    """ISO form of dd/MM/yyyy; unparsable text as it is; missing dates last."""
    day = F.when(
        F.regexp_like(value, F.lit(r"\A\d{1,2}/\d{1,2}/\d{4}\z")),
        iso(
            F.regexp_replace(value, r"\A(\d{1,2})/(\d{1,2})/(\d{4})\z", "$3-$2-$1").try_cast("date")
        ),
    )
    return F.coalesce(day, F.nullif(value, F.lit("")), F.lit("9999-12-31"))
