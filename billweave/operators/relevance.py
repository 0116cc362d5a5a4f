"""Message and document relevance decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as tx
from ..functions.dates import checked_window
from ..functions.links import within_domain
from ..session import checkpoint
from .dedup import join_hot

# --- messages ---------------------------------------------------------------------------


def message_context(subject: Column, preview: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(preview, F.lit("")))


def should_consider_message(
    subject: Column, preview: Column, terms: R.TermRules = R.TermRules()
) -> Column:
    """No negative term, and a positive or a municipal one."""
    text = message_context(subject, preview)
    return ~tx.body_has_negative(text, terms) & (
        tx.body_has_positive(text, terms) | tx.is_municipal_text(text, terms)
    )


def is_pdf_part(mime: Column, name: Column) -> Column:
    return tx.has(F.lower(F.coalesce(mime, F.lit(""))), "pdf") | F.endswith(
        F.lower(F.coalesce(name, F.lit(""))), F.lit(".pdf")
    )


def has_pdf_attachment(parts: Column) -> Column:
    """parts: array<struct<mime, filename, attachment_id, ...>>, already flattened."""
    return F.coalesce(
        F.exists(
            parts,
            lambda p: (F.coalesce(p["attachment_id"], F.lit("")) != "")
            & is_pdf_part(p["mime"], p["filename"]),
        ),
        F.lit(False),
    )


def prefilter_messages(
    messages: DataFrame,
    terms: R.TermRules = R.TermRules(),
    disabled: bool = False,
    trusted_senders=R.TRUSTED_SENDER_DOMAINS,
) -> DataFrame:
    """Metadata prefilter: trusted sender, relevant words or a PDF part keep a message.

    Adds keep and reason (prefilter_non_invoice for the dropped ones).
    """
    keep = (
        F.lit(True)
        if disabled
        else tx.is_trusted_sender(F.col("sender"), trusted_senders)
        | should_consider_message(F.col("subject"), F.col("preview"), terms)
        | has_pdf_attachment(F.col("parts"))
    )
    return messages.withColumn("keep", keep).withColumn(
        "reason", F.when(~F.col("keep"), "prefilter_non_invoice")
    )


def trusted_document(
    url: Column,
    sender: Column,
    text: Column,
    terms: R.TermRules = R.TermRules(),
    providers=R.TRUSTED_PROVIDERS,
    senders=R.TRUSTED_SENDER_DOMAINS,
) -> Column:
    """Trust hint of a linked document: its host, its sender or a municipal text vouches."""
    hints = (
        within_domain(url, providers),
        tx.is_trusted_sender(sender, senders),
        tx.is_municipal_text(text, terms),
    )
    return tx.any_of([F.coalesce(h, F.lit(False)) for h in hints])


def gate_messages(messages: DataFrame, terms: R.TermRules = R.SECOND_PROVIDER_TERMS) -> DataFrame:
    """Second provider's gate.  gate: skipped, negative_context or accepted."""
    text = message_context(F.col("subject"), F.col("preview"))
    looked_at = F.col("has_attachments") | should_consider_message(
        F.col("subject"), F.col("preview"), terms
    )
    positive = tx.body_has_positive(text, terms) | tx.is_municipal_text(text, terms)
    rejected = tx.body_has_negative(text, terms) & ~positive
    return messages.withColumn(
        "gate",
        F.when(~looked_at, "skipped").when(rejected, "negative_context").otherwise("accepted"),
    ).withColumn("trusted_hint", tx.is_municipal_text(text, terms))


def is_retryable_reason(reason: Column) -> Column:
    return F.regexp_like(F.lower(F.coalesce(reason, F.lit(""))), F.lit("_fail|timeout|rate"))


def unsaved_reason(
    had_attachment: Column, failures: Column, skips: Column, links_found: Column
) -> Column:
    """Why a message gave no document; failures and skips are counts."""
    return (
        F.when(had_attachment & (failures > 0), "attachment_processing_failed")
        .when(had_attachment & (skips > 0), "attachment_skipped")
        .when(had_attachment, "attachment_no_save")
        .when(links_found, "links_no_pdf")
        .otherwise("no_attach_no_pdf_links")
    )


def expanded_query_terms(terms: R.TermRules = R.TermRules(), prefix: str = "ה") -> list[str]:
    """Search terms with the definite-article form added; first-seen order."""
    raw = [v for t in terms.raw_pos for v in ([t] if t.startswith(prefix) else [t, prefix + t])]
    return list(dict.fromkeys(raw + list(terms.latin_pos)))


def search_messages(
    messages: DataFrame,
    start: str,
    end: str,
    terms: R.TermRules = R.TermRules(),
    prefix: str = "ה",
    sent_folder: str | None = "sent",
) -> DataFrame:
    """Landed messages a mailbox search would return: in the half-open window, not sent,
    with a PDF name or a search term in subject or preview.

    The window and folder tests come first; they are plain column predicates that reach
    the scan.
    """
    lower, upper = checked_window(start, end)
    window = (F.col("received") >= lower) & (F.col("received") < upper)
    if sent_folder is not None:
        window = window & (F.col("parent_folder") != sent_folder)
    text = F.lower(message_context(F.col("subject"), F.col("preview")))
    words = [t.lower() for t in expanded_query_terms(terms, prefix)]
    return messages.where(window).where(
        tx.contains_any(text, words) | F.endswith(F.lower(F.col("attachment_name")), F.lit(".pdf"))
    )


# --- documents --------------------------------------------------------------------------


def term_table(terms: R.TermRules) -> list[tuple]:
    """(term, polarity, strength, ignore_case) in the order terms are reported."""
    rows = [(t, "pos", t in terms.weak, True) for t in terms.latin_pos]
    rows += [(t, "pos", t in terms.weak, False) for t in terms.raw_pos]
    rows += [(t, "neg", False, True) for t in terms.latin_neg]
    rows += [(t, "neg", False, False) for t in terms.raw_neg]
    return rows


def page_terms(page: Column, terms: R.TermRules, polarity: str) -> Column:
    """The terms of a polarity found on one page, in table order."""
    hits = [
        F.when(tx.keyword_in_text(page, t, fold), F.lit(t))
        for t, p, _w, fold in term_table(terms)
        if p == polarity
    ]
    found = F.array(*hits) if hits else F.array(F.lit(None).cast("string"))
    return F.filter(found, lambda t: t.isNotNull())


def page_stats(page: Column, terms: R.TermRules = R.TermRules()) -> Column:
    return F.struct(
        page_terms(page, terms, "pos").alias("pos_terms"),
        page_terms(page, terms, "neg").alias("neg_terms"),
        tx.text_has_amount_hint(page).alias("amount_hint"),
        tx.text_has_invoice_id(page).alias("invoice_id_hint"),
    )


def keyword_stats(
    pages: DataFrame,
    terms: R.TermRules = R.TermRules(),
    key: str = "doc_id",
    stop_early: bool = False,
) -> DataFrame:
    """Keyword statistics per document from pages(doc_id, page_no, text).

    A term counts once per page it occurs on.  Terms are matched on the page row, so only
    the small hit lists travel to the aggregation; pages without hits carry empty lists.
    With stop_early pages after the one that brings the positives to three, or the first
    with a negative, do not count (the second provider's rule); see until_decided.
    """
    scanned = pages.select(key, "page_no", page_stats(F.col("text"), terms).alias("s")).select(
        key, "page_no", "s.*"
    )
    if stop_early:
        scanned = until_decided(checkpoint(scanned), key)
    # hints and counts combine before the shuffle; only pages with a hit send their terms
    hit = F.when(
        F.size("pos_terms") + F.size("neg_terms") > 0, F.struct("page_no", "pos_terms", "neg_terms")
    )
    per_doc = scanned.groupBy(key).agg(
        F.array_sort(F.collect_list(hit)).alias("p"),
        F.bool_or("amount_hint").alias("amount_hint"),
        F.bool_or("invoice_id_hint").alias("invoice_id_hint"),
    )
    pos, neg = F.flatten(F.col("p.pos_terms")), F.flatten(F.col("p.neg_terms"))
    listed = per_doc.select("*", pos.alias("pos_terms"), neg.alias("neg_terms"))
    weak = F.size(F.filter("pos_terms", lambda t: t.isin(*terms.weak)))
    return listed.select(
        key,
        F.size("pos_terms").alias("pos_hits"),
        F.size("neg_terms").alias("neg_hits"),
        "pos_terms",
        "neg_terms",
        (F.size("pos_terms") - weak).alias("strong_hits"),
        weak.alias("weak_hits"),
        "amount_hint",
        "invoice_id_hint",
    )


# Pages of a document that are looked at together.
PAGE_RANGE = 64


def until_decided(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pages of each document up to the deciding one: the page that brings the positive
    hits to three, or the first with a negative hit.

    scanned(key, page_no, pos_terms, neg_terms, hints).  Hits are summed by range of pages
    first; running sums over these find the range that decides, and only its pages, at most
    PAGE_RANGE a document, are walked.  The pages of a document never meet in one task.
    """
    counted = scanned.select(
        key,
        "page_no",
        F.floor(F.col("page_no") / PAGE_RANGE).alias("pages"),
        F.size("pos_terms").alias("pos"),
        (F.size("neg_terms") > 0).alias("neg"),
    ).where("pos > 0 or neg")
    ranges = counted.groupBy(key, "pages").agg(F.sum("pos").alias("pos"), F.bool_or("neg").alias("neg"))
    above = W.partitionBy(key).orderBy("pages").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("pos").over(above), F.lit(0)))
    first = ranges.where("neg or before + pos >= 3").groupBy(key).agg(F.min(F.struct("pages", "before")).alias("r"))
    first = first.select(key, "r.pages", "r.before")
    upto = W.partitionBy(key, "pages").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    walked = counted.join(first, [key, "pages"]).withColumn("so_far", F.col("before") + F.sum("pos").over(upto))
    last = walked.where("neg or so_far >= 3").groupBy(key).agg(F.min("page_no").alias("last_page"))
    sizes = scanned.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).join(last, key, "left")
    kept = join_hot(scanned, sizes, key)
    return kept.where(F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page"))).drop("last_page")


def document_stats(
    pages: Column, terms: R.TermRules = R.TermRules(), stop_early: bool = False
) -> Column:
    """The same statistics for documents that carry their pages as an array: no shuffle."""
    scanned = F.transform(pages, lambda p: page_stats(p, terms))
    if stop_early:
        scanned = pages_until_decided(scanned)
    return tx.let(scanned, lambda p: stats_of(p, terms))


def pages_until_decided(scanned: Column) -> Column:
    """The leading pages up to and including the deciding one."""

    def cut(ps: Column) -> Column:
        needed = F.aggregate(
            ps,
            F.struct(F.lit(0).alias("pos"), F.lit(0).alias("pages"), F.lit(False).alias("done")),
            lambda a, p: F.when(a["done"], a).otherwise(
                F.struct(
                    (a["pos"] + F.size(p["pos_terms"])).alias("pos"),
                    (a["pages"] + 1).alias("pages"),
                    (
                        (a["pos"] + F.size(p["pos_terms"]) >= 3) | (F.size(p["neg_terms"]) >= 1)
                    ).alias("done"),
                )
            ),
        )["pages"]
        return F.slice(ps, F.lit(1), needed)

    return tx.let(scanned, cut)


def stats_of(p: Column, terms: R.TermRules) -> Column:
    pos = F.flatten(F.transform(p, lambda x: x["pos_terms"]))
    neg = F.flatten(F.transform(p, lambda x: x["neg_terms"]))

    def build(t: Column) -> Column:
        weak = F.size(F.filter(t["pos"], lambda x: x.isin(*terms.weak)))
        return F.struct(
            F.size(t["pos"]).alias("pos_hits"),
            F.size(t["neg"]).alias("neg_hits"),
            t["pos"].alias("pos_terms"),
            t["neg"].alias("neg_terms"),
            (F.size(t["pos"]) - weak).alias("strong_hits"),
            weak.alias("weak_hits"),
            F.when(F.size(t["p"]) > 0, F.exists(t["p"], lambda x: x["amount_hint"])).alias(
                "amount_hint"
            ),
            F.when(F.size(t["p"]) > 0, F.exists(t["p"], lambda x: x["invoice_id_hint"])).alias(
                "invoice_id_hint"
            ),
        )

    return tx.let(F.struct(pos.alias("pos"), neg.alias("neg"), p.alias("p")), build)


def confidence(pos_hits: Column, neg_hits: Column) -> Column:
    total = pos_hits + neg_hits
    return F.when(total > 0, pos_hits / total).otherwise(F.lit(0.0))


def accept_strict(s: dict[str, Column]) -> Column:
    """At least one positive, no negative; weak words alone need an amount or a number."""
    weak_only = s["strong_hits"] == 0
    hinted = F.coalesce(s["amount_hint"], F.lit(False)) | F.coalesce(
        s["invoice_id_hint"], F.lit(False)
    )
    return (s["pos_hits"] >= 1) & (s["neg_hits"] == 0) & (~weak_only | hinted)


def accept_trusting(s: dict[str, Column], trusted: Column) -> Column:
    """As accept_strict, and trusted sources pass without any hit."""
    return accept_strict(s) | (trusted & (s["pos_hits"] == 0) & (s["neg_hits"] == 0))


def accept_forgiving(
    s: dict[str, Column], trusted: Column, terms: R.TermRules = R.SECOND_PROVIDER_TERMS
) -> Column:
    """Trusted sources are forgiven some negatives and need no positive; no weak rule.

    Only the negatives of `terms`, the second provider's shorter list, stand against a document.
    """
    own = (*terms.raw_neg, *terms.latin_neg)
    serious = F.filter(s["neg_terms"], lambda t: t.isin(*own) & ~(trusted & t.isin(*terms.forgiven)))
    return (F.size(serious) == 0) & ((s["pos_hits"] >= 1) | (trusted & (s["pos_hits"] == 0)))


def assess_documents(
    docs: DataFrame, terms: R.TermRules = R.TermRules(), second: R.TermRules = R.SECOND_PROVIDER_TERMS
) -> DataFrame:
    """docs(…, pages array<string>, trusted) with stats, confidence and the three verdicts.

    `second` has the terms of the forgiving verdict: its negatives are among those of `terms`.
    """
    scanned = docs.withColumn("stats", document_stats(F.col("pages"), terms))
    s = {f: F.col(f"stats.{f}") for f in STAT_FIELDS}
    return scanned.select(
        "*",
        confidence(s["pos_hits"], s["neg_hits"]).alias("confidence"),
        F.when(accept_strict(s), "keep").otherwise("quarantine").alias("disposition"),
        accept_trusting(s, F.col("trusted")).alias("accepted_trusting"),
        accept_forgiving(s, F.col("trusted"), second).alias("accepted_forgiving"),
    )


STAT_FIELDS = (
    "pos_hits",
    "neg_hits",
    "pos_terms",
    "neg_terms",
    "strong_hits",
    "weak_hits",
    "amount_hint",
    "invoice_id_hint",
)


def page_hits(
    pages: Column, latin=R.PAGE_ENGLISH_KEYWORDS, raw=R.PAGE_HEBREW_KEYWORDS
) -> Column:
    """Page-level hits of the page-hit variant: one per language found on a page."""
    hits = F.transform(
        pages,
        lambda p: tx.contains_any(F.lower(p), tx.lowered(latin)).cast("int")
        + tx.contains_any(p, raw).cast("int"),
    )
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h)


def text_score(text: Column, rules: R.ScoreRules = R.ScoreRules()) -> Column:
    """Invoice likelihood of a document text: strict word .5, capped language hits."""

    def score(t: Column) -> Column:
        strict = F.when(tx.contains_any(t, tx.lowered(rules.strict)), 0.5).otherwise(0.0)
        he = F.least(F.lit(0.3), tx.count_terms(t, tx.lowered(rules.hebrew)) * 0.03)
        en = F.least(F.lit(0.2), tx.count_terms(t, tx.lowered(rules.english)) * 0.02)
        return F.least(F.lit(1.0), strict + he + en)

    return F.coalesce(tx.let(F.lower(text), score), F.lit(0.0))


def verify_documents(
    docs: DataFrame, mode: str = "strict", rules: R.ScoreRules = R.ScoreRules(),
    min_bytes: int = R.MIN_PDF_BYTES,
) -> DataFrame:
    """Verdict by size and by the text score of all pages.

    docs(…, content_size, pages array<string>).  Adds text_score, verified and reason.
    """
    threshold = R.VERIFY_THRESHOLDS[mode]
    whole = F.array_join("pages", "\n")
    scored = docs.withColumn(
        "text_score",
        F.round(text_score(whole, rules).cast("decimal(38,10)"), 3).cast("double")
        if threshold > 0
        else F.lit(None).cast("double"),
    )
    big = F.col("content_size") >= min_bytes
    good = F.lit(True) if threshold <= 0 else F.col("text_score") >= threshold
    return scored.withColumn("verified", big & good).withColumn(
        "reason", F.when(~big, "too_small").when(~good, "low_text_score")
    )


def stage_counters(messages: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counters: rows scanned and rows per named condition."""
    counts = [F.count_if(c).cast("bigint").alias(n) for n, c in conditions.items()]
    return messages.agg(F.count(F.lit(1)).alias("scanned"), *counts)


def sum_columns(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
