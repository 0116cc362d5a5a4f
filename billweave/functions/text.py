"""Text predicates and cleaners as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R

# One white-space class and one word class, spelled out so that they are Unicode-aware
# and mean the same in Java and RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
INLINE_SPACE = r"[\t \x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def unicode_pattern(pattern: str, flags: str = "") -> str:
    """A rule pattern with Unicode white space and newline-only line ends."""
    spaced = pattern.replace(r"[\s\S]", "\x00")
    spaced = re.sub(r"(?<=[^\\])\\s(?=[^\[\]]*\])", WS[1:-1].replace("\\", r"\\"), spaced)
    spaced = spaced.replace(r"\s", WS)
    return f"(?d{flags})" + spaced.replace("\x00", r"[\s\S]")


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(and_, conditions, F.lit(True))


def has(text: Column, term: str) -> Column:
    return F.contains(text, F.lit(term))


def contains_any(text: Column, terms) -> Column:
    """True when any of a short, fixed list of literals occurs; the text is read once."""
    return F.regexp_like(text, F.lit("|".join(rf"\Q{t}\E" for t in terms)))


def has_any(text: Column, terms) -> Column:
    """contains_any for a plain column or a bound value: searching a few literals one by one
    is faster than a pattern, but a computed text would be computed for each of them."""
    return any_of([has(text, from_ascii(t)) & has(text, t) if from_ascii(t) != t else has(text, t) for t in terms])


def from_ascii(term: str) -> str:
    """The rest of a term from its first ASCII mark, or the term itself without one.

    Hebrew letters share their first byte, so a search for one stops at every second byte; an
    ASCII mark is seldom, and without the rest the term does not occur.
    """
    at = next((i for i, c in enumerate(term) if c.isascii() and not c.isspace()), 0)
    return term[at:]


# letters by how seldom they are; lower case changes the length of I with a dot, and makes a
# Latin k of the Kelvin sign
RARE_LETTERS = "jqzxvbwfgyphumcdlnrsto" + "ae"


def has_latin(text: Column, terms) -> Column:
    """Whether one of a few lower-case Latin terms occurs in the lower-cased text.

    A text without a rare letter of each term is not lower-cased.
    """
    letters = sorted({min((c for c in t if c in RARE_LETTERS), key=RARE_LETTERS.index) for t in terms})
    possible = has_any(text, [x for c in letters for x in (c, c.upper())])
    return F.when(possible, contains_any(F.lower(text), terms)).otherwise(False)


def contains_all(text: Column, terms) -> Column:
    return all_of([has(text, t) for t in terms])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def count_terms(text: Column, terms) -> Column:
    """How many of the terms occur (each counted once)."""

    def hits(body: Column) -> Column:
        return reduce(lambda a, b: a + b, [has(body, t).cast("int") for t in terms], F.lit(0))

    return let(text, hits)


def lowered(terms) -> tuple:
    return tuple(t.lower() for t in terms)


def extract(text: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """A group of the first match, or NULL when the pattern does not match."""
    return F.get(extract_all(text, pattern, flags, group), F.lit(0))


def extract_all(text: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode_pattern(pattern, flags)), F.lit(group))


def whole_runs(pattern: str) -> str:
    """A pattern that starts with a run of digits, points and commas before white space, tried
    at the start of each run only: from within a run it fails like from its start."""
    head = r"([\d.,]+)\s"
    if not pattern.startswith(head):
        return pattern
    return r"(?=[\d.,])(?<![\d.,])([\d.,]++)\s" + pattern[len(head) :]


def match_spans(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """array<struct<start, end, hit, value>> of the matches, in order (0-based, end open)."""
    p = unicode_pattern(pattern, flags)
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(p), F.lit(0)),
        F.regexp_extract_all(text, F.lit(p), F.lit(group)),
        lambda h, v: F.struct(h.alias("hit"), v.alias("value")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,value:string>>")

    def spans(hits: Column) -> Column:
        steps = F.zip_with(
            F.slice(F.split(text, p), F.lit(1), F.size(hits)),
            hits,
            lambda gap, m: F.struct(
                F.length(gap).alias("gap"), F.length(m["hit"]).alias("size"), m.alias("m")
            ),
        )
        return F.aggregate(
            steps,
            F.struct(F.lit(0).alias("pos"), empty.alias("spans")),
            lambda acc, s: F.struct(
                (acc["pos"] + s["gap"] + s["size"]).alias("pos"),
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["pos"] + s["gap"]).alias("start"),
                        (acc["pos"] + s["gap"] + s["size"]).alias("end"),
                        s["m"]["hit"].alias("hit"),
                        s["m"]["value"].alias("value"),
                    ),
                ).alias("spans"),
            ),
        )["spans"]

    return F.when(F.regexp_like(text, F.lit(p)), let(found, spans)).otherwise(empty)


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_like(text, F.lit(unicode_pattern(pattern, flags)))


# the characters of WS one by one
WS_CHARACTERS = "".join(
    chr(c)
    for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARACTERS))


def squeeze(text: Column) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "))


def whole_word_pattern(term: str, ignore_case: bool = False) -> str:
    """The literal first, its left edge checked afterwards: most positions fail at once."""
    flags = "(?iu)" if ignore_case else ""
    return rf"{flags}\Q{term}\E(?!{WORD})(?<!{WORD}\Q{term}\E)"


def keyword_in_text(text: Column, term: str, ignore_case: bool = False) -> Column:
    """Whole-word test with Unicode word boundaries; empty text or term is false."""
    if not term:
        return F.lit(False)
    found = F.regexp_like(text, F.lit(whole_word_pattern(term, ignore_case)))
    return F.coalesce(found, F.lit(False))


def body_has_negative(text: Column, terms: R.TermRules = R.TermRules()) -> Column:
    """Plain substring test: the Latin terms fire inside longer words too."""
    body = F.coalesce(text, F.lit(""))
    return contains_any(body, terms.raw_neg) | contains_any(F.lower(body), terms.latin_neg)


def body_has_positive(text: Column, terms: R.TermRules = R.TermRules()) -> Column:
    body = F.coalesce(text, F.lit(""))
    return contains_any(body, terms.raw_pos) | contains_any(F.lower(body), terms.latin_pos)


def is_municipal_text(text: Column, terms: R.TermRules = R.TermRules()) -> Column:
    return contains_any(F.coalesce(text, F.lit("")), terms.municipal)


def text_has_amount_hint(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return contains_any(body, R.AMOUNT_SYMBOLS) | any_of(
        [F.regexp_like(body, F.lit(p)) for p in R.AMOUNT_PATTERNS]
    )


def text_has_invoice_id(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return any_of([matches(body, p, "iu") for p in R.INVOICE_ID_PATTERNS])


def has_public_transport_marker(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return has_any(body, R.TRANSPORT_HEBREW) | has_latin(body, R.TRANSPORT_LATIN)


def looks_like_petah_tikva(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return has_any(body, R.PETAH_TIKVA_KEYWORDS) & has_any(body, R.PETAH_TIKVA_MARKERS)


def needs_fallback_text(text: Column) -> Column:
    """Too short, too few Hebrew letters or too many undecoded glyphs."""
    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda body: (F.length(body) < 200)
        | (F.regexp_count(body, F.lit("[א-ת]")) < 15)
        | (F.regexp_count(body, F.lit(r"\(cid:")) > 5),
    )


def vendor_label(text: Column, markers=R.VENDOR_MARKERS) -> Column:
    """The label of the first marker, in rule order, found in the lower-cased text."""
    none = F.lit(None).cast("string")
    return let(
        F.lower(text),
        lambda body: F.coalesce(*[F.when(has(body, m.lower()), F.lit(v)) for m, v in markers], none),
    )


def redact(text: Column) -> Column:
    # every pattern needs one of these; most texts have none of them
    suspect = has(text, ".json") | has(text, ".bin") | F.regexp_like(text, F.lit("(?i)bearer"))
    clean = text
    for pattern, replacement in R.REDACTIONS:
        clean = F.regexp_replace(clean, pattern, replacement)
    return F.when(suspect, clean).otherwise(text)


def compact_marker(line: Column) -> Column:
    """Straight quotes, no blanks: the form in which line markers are compared."""
    return F.translate(line, "״׳ ", "\"'")


def is_total_with_vat_line(line: Column) -> Column:
    compact = compact_marker(line)
    # the cheapest test first: the marks have a quote
    return (
        has_any(line, ('"', "״"))
        & has(compact, R.INCLUDING_MARK)
        & contains_any(compact, R.TOTAL_MARKS)
        & contains_any(compact, R.VAT_MARKS)
    )


def is_vat_percent_line(line: Column) -> Column:
    return has(line, "%") & contains_any(compact_marker(line), R.VAT_MARKS)


def sanitize_filename(name: Column, default: str = "invoice.pdf") -> Column:
    cleaned = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r'[\\/:*?"<>|]+', "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def short_message_tag(message_id: Column, n: int = 8) -> Column:
    cleaned = F.regexp_replace(F.coalesce(message_id, F.lit("")), "[^A-Za-z0-9]", "")
    return F.coalesce(F.nullif(F.right(cleaned, F.lit(n)), F.lit("")), F.lit("msg"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_extension(name: Column) -> Column:
    """The last dot and what follows; a leading dot does not start an extension."""
    return F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)$", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(file_extension(name)))


def stem_key(path: Column) -> Column:
    """File stem without a trailing copy number."""
    return F.regexp_replace(file_stem(path), r"(?s)\A(.*)__\d+\z", "$1")


def tagged_name(name: Column, tag: Column) -> Column:
    """sanitised stem + "__" + tag + extension (".pdf" when there is none)."""
    return let(
        F.struct(sanitize_filename(name).alias("safe"), tag.alias("tag")),
        lambda s: F.concat(
            F.left(s["safe"], F.length(s["safe"]) - F.length(file_extension(s["safe"]))),
            F.lit("__"),
            s["tag"],
            F.coalesce(F.nullif(file_extension(s["safe"]), F.lit("")), F.lit(".pdf")),
        ),
    )


def safe_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}_\-. ()֐-׿]", "_"), F.lit(200))


def display_value(value: Column) -> Column:
    """Report cell text: squeezed, cut to 117 characters and an ellipsis beyond 120."""
    return F.regexp_replace(
        squeeze(F.coalesce(value, F.lit(""))), r"(?s)\A(.{117}).{4,}\z", "$1..."
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(pages: Column) -> Column:
    """SHA-256 of the squeezed text of all pages; blank documents have no fingerprint."""
    text = squeeze(F.array_join(F.filter(pages, lambda p: F.length(p) > 0), " "))
    return F.when(text != "", F.sha2(text, 256))


def extract_lines(text: Column) -> Column:
    """Trimmed, non-empty lines with split decimals put together again.

    Page text often carries "90", ".", "39" (or "90", "39.") on separate lines for the
    amount 39.90.  The three shapes never overlap, so one left-to-right replacement over
    the joined lines does it in linear time, without exploding the document.
    """
    return lines_of(merged_text(text))


def lines_of(merged: Column) -> Column:
    """The lines of a merged text."""
    # "" splits to one empty line
    return F.array_remove(F.split(merged, "\n"), "")


# white space that is neither a blank nor a newline
ODD_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# every shape has a point at the end of a line
SPLIT_DECIMAL = r"(?m)^(?:(-?\d+)\n\.\n(-?\d+)|(-?\d+)\n(-?\d+)\.|(-?\d+)\.\n(-?\d+))$"


def merged_text(text: Column) -> Column:
    """The lines of extract_lines joined by newlines."""

    def broken(body: Column) -> Column:
        spaced = any_of([has(body, x) for x in (" \n", "\n ", "\n\n")]) | F.regexp_like(body, F.lit(ODD_SPACE))
        joined = F.regexp_replace(body, rf"{INLINE_SPACE}*+{LINE_BREAK}{WS}*+", "\n")
        return F.when(spaced, joined).otherwise(body)

    def merged(joined: Column) -> Column:
        split = has(joined, ".\n") | F.endswith(joined, F.lit("."))
        return F.when(split, F.regexp_replace(joined, SPLIT_DECIMAL, "$2$3$6.$1$4$5")).otherwise(joined)

    return let(let(strip(text), broken), merged)


def first_match(text: Column, patterns, flags: str = "m") -> Column:
    """Group 1, trimmed, of the first pattern that matches."""
    return F.coalesce(*[strip(extract(text, p, flags)) for p in patterns])


def button_score(name: Column) -> Column:
    scored = [F.when(contains_any(name, terms), w).otherwise(0) for terms, w in R.BUTTON_SCORES]
    return reduce(lambda a, b: a + b, scored)


def best_button(names: Column) -> Column:
    """The highest-scored invoice button; longer then later text breaks ties."""
    clean = F.transform(names, lambda n: squeeze(F.coalesce(n, F.lit(""))))
    eligible = F.filter(
        clean, lambda n: has(n, R.BUTTON_REQUIRED) & ~contains_any(n, R.BUTTON_EXCLUDED)
    )
    ranked = F.transform(
        eligible,
        lambda n: F.struct(button_score(n).alias("s"), F.length(n).alias("l"), n.alias("n")),
    )
    best = F.array_max(ranked)
    return F.when(best["s"] > 0, best["n"])


def email_parts(name: Column, address: Column) -> Column:
    """Display name, lower-cased address and what follows its first @."""
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.struct(
        F.coalesce(name, F.lit("")).alias("name"),
        low.alias("address"),
        F.when(has(low, "@"), F.substring(low, F.instr(low, "@") + 1, F.length(low)))
        .otherwise("")
        .alias("domain"),
    )


def sender_domain(address: Column) -> Column:
    """Domain of 'Name <a@b>' or 'a@b', lower-cased; '' without an @."""
    raw = F.coalesce(address, F.lit(""))
    inner = F.regexp_extract(raw, "<([^>]+)>", 1)
    email = F.lower(strip(F.when(inner != "", inner).otherwise(raw)))
    return F.when(has(email, "@"), F.substring_index(email, "@", -1)).otherwise("")


def is_trusted_sender(address: Column, domains=R.TRUSTED_SENDER_DOMAINS) -> Column:
    domain = sender_domain(address)
    return (domain != "") & any_of([F.endswith(domain, F.lit(d)) for d in domains])
