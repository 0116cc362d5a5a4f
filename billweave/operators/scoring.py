"""Weighted message scoring and multi-strategy search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import links as lk
from ..functions import text as tx


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def round3(value: Column) -> Column:
    return F.round(value.cast("decimal(38,10)"), 3).cast("double")


def message_blob(subject: Column, preview: Column, body: Column) -> Column:
    return F.lower(
        F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (subject, preview, body)])
    )


def language_hits(blob: Column, rules: R.ScoreRules) -> Column:
    """struct<he, en, score> of a lower-cased text."""

    def score(h: Column) -> Column:
        value = h["he"] * F.lit(1.2) * F.lit(0.05) + h["en"] * F.lit(1.0) * F.lit(0.05)
        return F.struct(h["he"], h["en"], F.least(value, F.lit(0.8)).alias("score"))

    hits = F.struct(
        tx.count_terms(blob, tx.lowered(rules.hebrew)).alias("he"),
        tx.count_terms(blob, tx.lowered(rules.english)).alias("en"),
    )
    return tx.let(hits, score)


def prefers_attachment(name: Column, mime: Column, rules: R.ScoreRules = R.ScoreRules()) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return (
        tx.any_of([F.endswith(n, F.lit(e)) for e in rules.extensions])
        | tx.contains_any(n, rules.name_hints)
        | tx.has(F.lower(F.coalesce(mime, F.lit(""))), "pdf")
    )


def sender_delta(address: Column, domain: Column, sender_rules) -> Column:
    """+-0.2 for a domain rule ("+@d"), +-0.25 for an address rule ("-a@d")."""
    delta = F.lit(0.0)
    for rule in (r.strip() for r in sender_rules):
        if not rule:
            continue
        sign = 1.0 if rule.startswith("+") else -1.0
        token = rule[1:].lower()
        by_address = F.when(address == token, 0.25 * sign).otherwise(0.0)
        if token.startswith("@"):
            delta = delta + F.when(domain == token[1:], 0.2 * sign).otherwise(by_address)
        else:
            delta = delta + by_address
    return delta


def score_messages(messages: DataFrame, rules: R.ScoreRules = R.ScoreRules()) -> DataFrame:
    """Evidence and confidence of each message; no shuffle.

    messages(message_id, subject, preview, body, sender_name, sender_address,
    attachments array<struct<name, content_type>>, …).  Adds kept_links, link_score,
    language, matched_attachments, base_confidence, raw_confidence and match_confidence.
    The base is rounded to three places before the bonuses, which are clamped step by step.
    """
    subject = F.coalesce("subject", F.lit(""))
    body = F.coalesce("body", F.lit(""))
    staged = messages.select(
        "*",
        message_blob(subject, F.col("preview"), lk.html_text(body)).alias("_blob"),
        lk.score_links(lk.body_links(body), rules.links).alias("_links"),
        F.filter(
            F.coalesce(
                "attachments", F.array().cast("array<struct<name:string,content_type:string>>")
            ),
            lambda a: prefers_attachment(a["name"], a["content_type"], rules),
        ).alias("matched_attachments"),
        tx.email_parts(F.col("sender_name"), F.col("sender_address")).alias("_sender"),
        F.lower(subject).alias("_subject"),
    )
    hits = F.col("matched_attachments")
    staged = staged.select("*", language_hits(F.col("_blob"), rules).alias("language"))
    staged = staged.select(
        "*",
        round3(
            F.least(
                F.lit(1.0),
                F.col("language.score")
                + F.col("_links.score")
                + F.when(F.size(hits) > 0, 0.25).otherwise(0.0),
            )
        ).alias("base_confidence"),
    )
    s = F.col("_subject")
    strong = F.when(F.regexp_like(s, F.lit(rules.subject_strong)), 0.35).otherwise(0.0)
    donation = F.when(
        tx.has(s, rules.donation_word) & tx.contains_any(s, tx.lowered(rules.donation)), 0.2
    ).otherwise(0.0)
    council = F.when(
        tx.contains_any(s, tx.lowered(rules.municipal))
        & F.exists(
            hits,
            lambda a: (F.lower(a["content_type"]) == "application/pdf")
            & F.regexp_like(F.lower(a["name"]), F.lit(r"\A\d{6,}\.pdf\z")),
        ),
        0.18,
    ).otherwise(0.0)
    notice = F.when(
        F.exists(hits, lambda a: tx.matches(F.coalesce(a["name"], F.lit("")), rules.notice, "iu")),
        -0.25,
    ).otherwise(0.0)
    sender = sender_delta(F.col("_sender.address"), F.col("_sender.domain"), rules.sender_rules)
    words = [w.lower() for w in rules.negatives if w.strip()]
    negative = tx.count_terms(F.col("_blob"), words) * -0.08 if words else F.lit(0.0)
    boosted = (
        F.when(tx.any_of([F.regexp_like("subject", F.lit(p)) for p in rules.subject_boosts]), 0.2)
        .otherwise(0.0)
        if rules.subject_boosts
        else F.lit(0.0)
    )
    conf = F.least(F.lit(1.0), F.col("base_confidence") + strong + donation + council)
    for step in (notice, sender, negative, boosted):
        conf = clamp(conf + step)
    staged = staged.select("*", conf.alias("raw_confidence"))
    return staged.select(
        *messages.columns,
        "language",
        F.col("_links.kept").alias("kept_links"),
        F.col("_links.score").alias("link_score"),
        "matched_attachments",
        "base_confidence",
        "raw_confidence",
        round3(F.col("raw_confidence")).alias("match_confidence"),
    )


def output_rows(scored: DataFrame, explain: bool = False) -> DataFrame:
    """Result rows: sender as 'Name <address>', hit counts, optional evidence struct."""
    sender = tx.email_parts(F.col("sender_name"), F.col("sender_address"))
    shown = F.when(
        sender["address"] != "", F.concat(sender["name"], F.lit(" <"), sender["address"], F.lit(">"))
    ).otherwise(sender["name"])
    attachments = F.transform(
        "matched_attachments",
        lambda a: F.struct(a["name"].alias("name"), a["content_type"].alias("content_type")),
    )
    columns = [
        F.col("message_id"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        shown.alias("sender"),
        F.col("received"),
        F.coalesce(F.col("has_attachments"), F.lit(False)).alias("has_attachments"),
        F.col("match_confidence"),
        F.col("language.he").alias("lang_hits_he"),
        F.col("language.en").alias("lang_hits_en"),
        F.col("kept_links").alias("matched_links"),
        attachments.alias("matched_attachments"),
    ]
    if explain:
        columns.append(
            F.struct(
                F.col("language").alias("language"),
                F.struct(
                    lk.body_links(F.coalesce("body", F.lit(""))).alias("candidates"),
                    F.col("kept_links").alias("kept"),
                    F.col("link_score").alias("score"),
                ).alias("links"),
                F.size("matched_attachments").alias("attachments"),
            ).alias("explanations")
        )
    return scored.select(*columns)


def flatten_list(column: Column, structs: bool = False) -> Column:
    """List cell of a CSV: "; " between items, structs as JSON."""
    return F.array_join(F.transform(column, lambda x: F.to_json(x)) if structs else column, "; ")


def keyword_first_score(
    messages: DataFrame, rules: R.KeywordFirstRules = R.KeywordFirstRules()
) -> DataFrame:
    """The keyword-first model; adds score and hit counts.

    messages(message_id, subject, preview, links array<string>, attachments).
    """
    text = F.lower(
        F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("preview", F.lit("")))
    )
    staged = messages.select(
        "*",
        tx.let(
            text,
            lambda t: F.struct(
                tx.count_terms(t, rules.hebrew).alias("he"),
                tx.count_terms(t, rules.english).alias("en"),
                tx.count_terms(t, rules.context).alias("ctx"),
            ),
        ).alias("hits"),
    )
    h = {k: F.col(f"hits.{k}") for k in ("he", "en", "ctx")}
    weight = h["he"] * R.V2_HEBREW_WEIGHT + h["en"] * R.V2_ENGLISH_WEIGHT
    base = weight / F.when(
        h["he"] + h["en"] + h["ctx"] > 0, F.lit(2.0) + h["ctx"] * 0.15
    ).otherwise(1.0)

    def good(a: Column) -> Column:
        n = F.lower(F.coalesce(a["name"], F.lit("")))
        return tx.contains_any(n, R.V2_NAME_HINTS) | tx.file_extension(n).isin(
            *R.ATTACHMENT_EXTENSIONS
        )

    bonus = F.when(F.exists("attachments", good), R.V2_ATTACHMENT_BONUS).otherwise(0.0) + F.when(
        F.exists("links", lk.is_invoice_link), R.V2_LINK_BONUS
    ).otherwise(0.0)
    return staged.select(
        "*", F.least(F.lit(1.0), base + bonus).alias("match_confidence")
    )


def run_strategies(messages: DataFrame, strategies) -> DataFrame:
    """Each message once per strategy that finds it, tagged with name and rank.

    The scan is read once: the matching strategies of a message are an array that is
    exploded, not a union of filtered scans.
    """
    text = F.lower(
        F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("subject", "preview")])
    )

    def found(t: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        tx.contains_any(t, tx.lowered(words)),
                        F.struct(F.lit(i).alias("rank"), F.lit(name).alias("strategy")),
                    )
                    for i, (name, words) in enumerate(strategies)
                ]
            )
        )

    return messages.withColumn("_s", F.explode(tx.let(text, found))).select(
        *messages.columns, "_s.rank", "_s.strategy"
    )


def first_strategy(found: DataFrame) -> DataFrame:
    """One row per message: the first strategy that found it, by min() and not by a window."""
    rest = [c for c in found.columns if c not in ("message_id", "rank")]
    return (
        found.groupBy("message_id")
        .agg(F.min(F.struct("rank", *rest)).alias("r"))
        .select("message_id", "r.*")
    )


def best_scored(found: DataFrame) -> DataFrame:
    """The highest match_confidence per message; ties keep the first strategy."""
    rest = [c for c in found.columns if c not in ("message_id", "rank", "match_confidence")]
    return (
        found.groupBy("message_id")
        .agg(
            F.max(
                F.struct("match_confidence", (-F.col("rank")).alias("neg_rank"), *rest)
            ).alias("r")
        )
        .select("message_id", (-F.col("r.neg_rank")).alias("rank"), "r.match_confidence",
                *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def strategy_counts(found: DataFrame, final: DataFrame, strategies) -> DataFrame:
    """Raw candidates and final matches per strategy, zero rows included."""
    names = found.sparkSession.createDataFrame(
        [(i, n) for i, (n, _w) in enumerate(strategies)], "ord int, strategy string"
    )
    raw = found.groupBy("strategy").agg(F.count(F.lit(1)).alias("candidates"))
    kept = final.groupBy("strategy").agg(F.count(F.lit(1)).alias("final_matches"))
    return names.join(raw, "strategy", "left").join(kept, "strategy", "left").select(
        "strategy",
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("final_matches", F.lit(0)).alias("final_matches"),
    )


def is_invoice_candidate(
    subject: Column, preview: Column, raw_pattern=R.SUBJECT_HE_PATTERN, latin=R.SUBJECT_EN_PATTERN
) -> Column:
    """Subject or preview matches one of two patterns (the simpler early variant)."""
    s = F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(preview, F.lit("")))
    return tx.matches(s, raw_pattern) | tx.matches(F.lower(s), latin)
