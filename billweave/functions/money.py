"""Amount tokens and money arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import WS, contains_all, extract, extract_all, let, match_spans, whole_runs

NUMBER = r"[\d.,]+"
# A number token with no percent sign within two characters on either side.
# The first test is that of the first character: most positions fail at once.
PLAIN_NUMBER = r"(?s)(?=[\d.,])(?<![\d.,])(?<!%)(?<!%.)([\d.,]++)(?!%)(?!.%)"


def round_money(value: Column) -> Column:
    """Half-up to cents through the shortest decimal text of the double."""
    number = value.cast("double")
    # the double next to a number of cents is that number; adding 0 turns -0.0 into 0.0
    whole = (F.abs(number) < 1e12) & (F.rint(number * 100) / 100 == number)
    spelled = F.round(value.cast("decimal(38,10)"), 2).cast("double")
    return F.when(whole, number + F.lit(0.0)).otherwise(spelled)


def normalize_amount_token(raw: Column) -> Column:
    """Canonical text of an amount token.

    "d.ddd" and "dd.ddd" are visual-order amounts (00.976 is 976.00); longer heads are
    read backwards as a whole.  Commas are thousands marks next to a dot or in pairs,
    and a decimal mark when alone.
    """
    text = F.regexp_replace(amount_text(raw), r"\A-\z", "")
    return F.nullif(text, F.lit(""))


# whole numbers, and numbers with at most two decimals: only their commas are taken out
PLAIN_AMOUNT = r"\A-?(?:\d+|[\d,]*\.\d{0,2})\z"


def amount_text(raw: Column) -> Column:
    return let(
        raw,
        lambda r: F.when(F.regexp_like(r, F.lit(PLAIN_AMOUNT)), F.replace(r, F.lit(","), F.lit(""))).otherwise(
            amount_spelled(r)
        ),
    )


def amount_spelled(raw: Column) -> Column:
    signed = F.regexp_replace(F.regexp_replace(raw, rf"\A{WS}+", ""), r"(?!\A-)[^0-9.,]++", "")
    swapped = F.regexp_replace(signed, r"\A(-?)(\d{1,2})\.(\d{3})\z", "$1$3.$2")
    turned = let(
        swapped,
        lambda t: F.when(
            F.regexp_like(t, F.lit(r"\A-?\d{3,}\.\d{3}\z")),
            F.concat(F.regexp_extract(t, r"\A-?", 0), F.reverse(F.translate(t, "-", ""))),
        ).otherwise(t),
    )
    return F.translate(
        F.regexp_replace(turned, r"\A(-?[^.,]*),([^.,]*)\z", "$1.$2"), ",", ""
    )


def parse_number(raw: Column) -> Column:
    return amount_text(raw).try_cast("double")


def positive_amounts(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, parse_number), lambda v: v > 0)


def select_amount(tokens: Column) -> Column:
    """The best amount among tokens: two decimals, any decimals, at least ten, first.

    Four-digit tokens starting with 20 are years and are ignored.
    """
    parsed = F.transform(
        F.transform(tokens, amount_text),
        lambda t: F.struct(t.alias("t"), t.try_cast("double").alias("v")),
    )
    usable = F.filter(
        parsed, lambda s: s["v"].isNotNull() & ~F.regexp_like(s["t"], F.lit(r"\A20\d\d\z"))
    )
    ranked = F.transform(
        usable,
        lambda s, i: F.struct(
            F.when(F.regexp_like(s["t"], F.lit(r"\.[^.]{2}\z")), 0)
            .when(F.contains(s["t"], F.lit(".")), 1)
            .when(s["v"] >= 10, 2)
            .otherwise(3)
            .alias("rank"),
            i.alias("i"),
            s["v"].alias("v"),
        ),
    )
    return F.array_min(ranked)["v"]


def plain_numbers(line: Column) -> Column:
    """Number tokens of a line that are not percentages."""
    return F.regexp_extract_all(line, F.lit(PLAIN_NUMBER), F.lit(1))


def all_numbers(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1))


def percent_numbers(line: Column) -> Column:
    """Number tokens with a percent sign within two characters on either side."""
    return F.regexp_extract_all(
        line,
        F.lit(r"(?s)(?=[\d.,])((?<![\d.,])(?<=%|%.)[\d.,]++|(?<![\d.,])[\d.,]++(?=%|.%))"),
        F.lit(1),
    )


def amount_from_line_end(line: Column) -> Column:
    """Last plain token with a decimal or thousands mark that parses, else the last one."""

    def pick(tokens: Column) -> Column:
        marked = F.transform(
            F.filter(tokens, lambda t: F.regexp_like(t, F.lit("[.,]"))), parse_number
        )
        return F.coalesce(
            F.try_element_at(F.filter(marked, lambda v: v.isNotNull()), F.lit(-1)),
            parse_number(F.try_element_at(tokens, F.lit(-1))),
        )

    return let(plain_numbers(line), pick)


def line_amount(line: Column) -> Column:
    """The amount of a labelled line, reading tokens from the right; percent only as a last
    resort."""
    tokens = let(
        plain_numbers(line),
        lambda plain: F.when(F.size(plain) > 0, plain).otherwise(all_numbers(line)),
    )
    return select_amount(F.reverse(tokens))


def amount_near_markers(text: Column, patterns, window: int = 120, prefer: str = "max") -> Column:
    """The amount within `window` characters around the first marker that has one.

    Patterns are tried in order; amounts with a decimal mark win over whole numbers.
    """

    def best(tokens: Column) -> Column:
        decimals = F.filter(tokens, lambda t: F.regexp_like(t, F.lit("[.,]")))
        pools = F.transform(F.array(decimals, tokens), positive_amounts)
        extreme = F.array_min if prefer == "min" else F.array_max
        return let(pools, lambda p: F.coalesce(extreme(F.get(p, 0)), extreme(F.get(p, 1))))

    def pick(span: Column) -> Column:
        head_start = F.greatest(span["start"] - window, F.lit(0))
        tail = F.substring(text, span["end"] + 1, F.lit(window))
        head = F.substring(text, head_start + 1, span["start"] - head_start)
        # the separator keeps the last number of one side apart from the first of the other
        return let(all_numbers(F.concat(tail, F.lit(" "), head)), best)

    spans = F.concat(*[match_spans(text, p, "m", 0) for p in patterns])
    return F.get(F.filter(F.transform(spans, pick), lambda v: v.isNotNull()), F.lit(0))


def vat_rate_estimate(total: Column, vat: Column) -> Column:
    base = total - vat
    return F.when((total != 0) & (base > 0), round_money(vat / base * 100))


def explicit_vat_rate(text: Column) -> Column:
    """The last positive VAT percentage in the text, else the last one."""

    def latest(body: Column) -> Column:
        spans = F.concat(*[match_spans(body, p, "iu", 1) for p in R.VAT_RATE_PATTERNS])
        rates = F.transform(
            spans,
            lambda s: F.struct(
                (s["start"] + F.instr(s["hit"], s["value"])).alias("pos"),
                let(parse_number(s["value"]), round_money).alias("rate"),
            ),
        )
        last = let(
            F.filter(rates, lambda s: s["rate"].isNotNull()),
            lambda rs: F.coalesce(
                F.array_max(F.filter(rs, lambda s: s["rate"] > 0)), F.array_max(rs)
            ),
        )
        return last["rate"]

    # most texts name one rate: its place does not matter
    latin = F.regexp_like(text, F.lit("[vV]"))
    nothing = F.array().cast("array<string>")
    named = F.concat(
        *[
            F.when(latin, extract_all(text, p, "iu")).otherwise(nothing)
            if p.startswith("VAT")
            else extract_all(text, whole_runs(p), "iu")
            for p in R.VAT_RATE_PATTERNS
        ]
    )
    rate = let(
        named,
        lambda v: F.when(F.size(v) == 1, let(parse_number(F.get(v, F.lit(0))), round_money)).when(
            F.size(v) > 1, latest(text)
        ),
    )
    return F.when(F.contains(text, F.lit("%")), rate)


def to_major_units(minor: Column) -> Column:
    return F.round(minor.cast("decimal(38,10)") / 100, 2).cast("double")


def money_text(value: Column) -> Column:
    """Cell text with thousands separators and two decimals; empty for NULL."""
    return F.coalesce(F.format_number(F.round(value.cast("decimal(38,10)"), 2), 2), F.lit(""))


def plain_money_text(value: Column) -> Column:
    return F.coalesce(F.round(value.cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string"), F.lit(""))


def shekel_tokens(text: Column) -> Column:
    return extract_all(text, R.SHEKEL_PATTERN)


def first_number(text: Column, patterns, flags: str = "", words=()) -> Column:
    """The first pattern, in order, whose first match is a number.

    words may give, for each pattern, literals without which it does not match: they are
    looked for first, since digit runs make the patterns themselves costly.
    """
    found = [parse_number(extract(text, whole_runs(p), flags)) for p in patterns]
    return F.coalesce(*[F.when(contains_all(text, w), v) for v, w in zip(found, words)], *found[len(words) :])


def repeated_currency_total(tokens: Column) -> Column:
    """The amount of at least 50 seen most often (twice or more), else the largest."""

    def best(amounts: Column) -> Column:
        return let(
            F.array_sort(F.filter(amounts, lambda v: v >= 50)),
            lambda large: F.coalesce(
                most_repeated(large), F.array_max(large), F.array_max(amounts)
            ),
        )

    return let(F.transform(positive_amounts(tokens), round_money), best)


def most_repeated(ordered: Column) -> Column:
    """The value of the longest run (of two or more) in a sorted list; the largest on ties."""
    none = F.lit(None).cast("double")
    start = F.struct(
        none.alias("last"), F.lit(0).alias("n"), F.lit(1).alias("most"), none.alias("best")
    )

    def run(acc: Column, value: Column) -> Column:
        return F.when(acc["last"] == value, acc["n"] + 1).otherwise(1)

    return F.aggregate(
        ordered,
        start,
        lambda acc, v: F.struct(
            v.alias("last"),
            run(acc, v).alias("n"),
            F.greatest(acc["most"], run(acc, v)).alias("most"),
            F.when((run(acc, v) >= 2) & (run(acc, v) >= acc["most"]), v)
            .otherwise(acc["best"])
            .alias("best"),
        ),
    )["best"]
