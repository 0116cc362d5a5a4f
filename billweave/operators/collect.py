"""Collection of documents from messages: attachments first, links as a fallback.

The decision about a document depends on what was saved before it.  Instead of walking the
mailbox, the saved set is found with dedup.greedy_keep and every other document is then
explained by comparing its position with that of the saved document it clashes with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .dedup import greedy_keep, join_hot, ordered_keep
from .relevance import is_retryable_reason, unsaved_reason


def position(received: Column, message_id: Column, part: Column) -> Column:
    """Sortable text of (received, message, part number)."""
    return F.concat_ws(
        "|",
        F.date_format(received, "yyyyMMddHHmmssSSSSSS"),
        message_id,
        F.lpad(part.cast("string"), 10, "0"),
    )


def tagged_keys(keys) -> Column:
    """The non-NULL keys of a row, each marked with its kind."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys]))


def decide(candidates: DataFrame, corpus: DataFrame | None, keys: dict[str, str]) -> DataFrame:
    """decision, reason and duplicate_of for candidates.

    candidates(ord, path, digest, verified, key columns).  keys maps a key column to the
    reason given when it is taken, in the order they are checked; the reason of a key that
    is checked after verification starts with "late:".  corpus(path, key columns) holds
    what was saved in earlier runs.  Documents without a digest are empty: errors.

    The keys of a row are handled as (ord, key) pairs, so all kinds of keys share one join
    against the known keys and one against the keys of the saved documents.
    """
    rows = checkpoint(candidates)
    pairs = checkpoint(rows.select("ord", F.explode(tagged_keys(keys)).alias("key")))
    sizes = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    shared = [k for k in keys if corpus is not None and k in corpus.columns]
    if shared:
        known = (
            corpus.select("path", F.explode(tagged_keys(shared)).alias("key"))
            .groupBy("key")
            .agg(F.min("path").alias("known"))
        )
    else:
        known = sizes.select("key", F.lit("").alias("known")).where("false")
    known = checkpoint(sizes.join(known, "key", "left"))
    # heavy keys are found among all keys of the pairs, known or not
    clashes = join_hot(pairs, known, "key").where("known is not null").select("ord").distinct()
    fresh = rows.where(F.col("digest").isNotNull() & F.col("verified")).join(
        clashes, "ord", "left_anti"
    )
    saved = checkpoint(greedy_keep(fresh.select("ord", *keys), tuple(keys), "ord"))
    # every saved row is the only saved one of each of its keys
    holders = (
        rows.join(saved, "ord", "left_semi")
        .select(
            F.col("ord").alias("holder"),
            F.col("path").alias("holder_path"),
            F.explode(tagged_keys(keys)).alias("key"),
        )
    )
    met = join_hot(pairs, known.join(holders, "key", "left"), "key").where("known is not null or holder is not null")
    taken = F.col("known").isNotNull() | (F.col("holder") < F.col("ord"))
    origin = F.coalesce("known", "holder_path")
    kind = F.substring_index("key", ":", 1)
    found = met.groupBy("ord").agg(
        F.max(F.coalesce(F.col("holder") == F.col("ord"), F.lit(False))).alias("is_saved"),
        *[F.max(F.when(taken & (kind == k), origin)).alias(f"origin_{k}") for k in keys],
    )
    early, late, source = F.lit(None), F.lit(None), F.lit(None)
    for key, label in reversed(keys.items()):
        hit = F.col(f"origin_{key}").isNotNull()
        if label.startswith("late:"):
            late = F.when(hit, label.removeprefix("late:")).otherwise(late)
        else:
            early = F.when(hit, label).otherwise(early)
        source = F.when(hit, F.col(f"origin_{key}")).otherwise(source)
    empty = F.col("digest").isNull()
    is_saved = F.coalesce("is_saved", F.lit(False))
    reason = (
        F.when(empty, "attachment_empty")
        .when(is_saved, None)
        .when(early.isNotNull(), early)
        .when(~F.col("verified"), "verify_failed")
        .otherwise(late)
    )
    decision = (
        F.when(empty, "error")
        .when(is_saved, "saved")
        .when(early.isNull() & ~F.col("verified"), "quarantine")
        .otherwise("skip")
    )
    return checkpoint(
        rows.join(found, "ord", "left").select(
            *candidates.columns,
            decision.alias("decision"),
            reason.alias("reason"),
            F.when(decision == "skip", source).alias("duplicate_of"),
        )
    )


def collect_attachments(attachments: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """attachments(ord, message_id, path, digest, fingerprint, verified) with decisions."""
    return decide(
        attachments, corpus, {"digest": "duplicate_hash", "fingerprint": "duplicate_text"}
    )


def collect_links(
    links: DataFrame, attachment_decisions: DataFrame, corpus: DataFrame | None = None
) -> DataFrame:
    """Links of messages without a saved attachment; a message stops at its first saved link.

    links(ord, message_id, path, digest, fingerprint, stem, verified).  What the attachment
    pass saved counts as part of the corpus, for content and text but not for stems.
    """
    saved = attachment_decisions.where("decision = 'saved'")
    rest = links.join(saved.select("message_id").distinct(), "message_id", "left_anti")
    known = saved.select("digest", "fingerprint", F.lit(None).cast("string").alias("stem"), "path")
    if corpus is not None:
        known = known.unionByName(corpus.select("digest", "fingerprint", "stem", "path"))
    keys = {
        "message_id": "not_tried",
        "digest": "duplicate_hash",
        "fingerprint": "duplicate_text",
        "stem": "late:duplicate_stem",
    }
    return decide(rest, known, keys)


# what a document of each kind looks up before it is saved, and what it registers when it is
_ATTACHMENT_KEYS = {"checks": ("digest", "fingerprint"), "registers": ("digest", "fingerprint", "message_id")}
_LINK_KEYS = dict.fromkeys(("checks", "registers"), ("message_id", "digest", "fingerprint", "stem"))


def collect_messages(attachments: DataFrame, links: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Walk the mailbox message by message: the attachments of a message, then its links.

    attachments(place, part, message_id, path, digest, fingerprint, verified) and links, which
    have a stem as well: `place` is a sortable text of the message, `part` the number of the
    document in it.  corpus(path, digest, fingerprint, stem) was saved in earlier runs.

    Links are looked at only in messages without a saved attachment, and a message stops at
    its first saved link: the links after it are not_tried, those of messages with a saved
    attachment are not in the result.  A document is looked up by content, by text, verified,
    and links then by stem; what is saved registers all of its keys at once, so a link stands
    in the way of the attachments of later messages.  Documents without a digest are errors.

    Returns kind, place, part, message_id, path, decision, reason, duplicate_of.
    """
    stem = F.lit(None).cast("string").alias("stem")
    columns = ["place", "part", "message_id", "path", "digest", "fingerprint", "stem", "verified"]
    have = set(attachments.columns)
    first = attachments.select(F.lit("attachment").alias("kind"), *columns[:6], columns[6] if "stem" in have else stem, "verified")
    second = links.select(F.lit("link").alias("kind"), *columns)
    # "attachment" sorts before "link"
    order = F.concat_ws("|", "place", "kind", F.lpad(F.col("part").cast("string"), 10, "0"))
    rows = checkpoint(first.unionByName(second).withColumn("ord", order))

    def roles(role: str) -> Column:
        of = F.when(F.col("kind") == "attachment", F.lit(",".join(_ATTACHMENT_KEYS[role]))).otherwise(",".join(_LINK_KEYS[role]))
        return F.array_contains(F.split(of, ","), F.substring_index("key", ":", 1))

    every = ("message_id", "digest", "fingerprint", "stem")
    pairs = rows.select("ord", "kind", F.explode(tagged_keys(every)).alias("key"))
    pairs = checkpoint(pairs.select("ord", "key", roles("checks").alias("checks"), roles("registers").alias("registers")))
    sizes = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    if corpus is None:
        known = sizes.select("key", F.lit("").alias("known")).where("false")
    else:
        known = corpus.select("path", F.explode(tagged_keys(every[1:])).alias("key")).groupBy("key").agg(F.min("path").alias("known"))
    known = checkpoint(sizes.join(known, "key", "left"))
    clashes = join_hot(pairs.where("checks"), known, "key").where("known is not null").select("ord").distinct()
    open_ = rows.where(F.col("digest").isNotNull() & F.col("verified")).select("ord").join(clashes, "ord", "left_anti")
    saved = checkpoint(ordered_keep(pairs.join(open_, "ord", "left_semi")))

    holders = pairs.where("registers").join(saved, "ord", "left_semi").join(rows.select("ord", "path", "kind"), "ord")
    holders = holders.groupBy("key").agg(F.min(F.struct("ord", "path", "kind")).alias("holder"))
    met = join_hot(pairs.where("checks"), known.join(holders, "key", "left"), "key")
    met = met.where("known is not null or holder is not null")
    taken = F.col("known").isNotNull() | (F.col("holder.ord") < F.col("ord"))
    origin = F.coalesce("known", "holder.path")
    by = F.substring_index("key", ":", 1)
    found = met.groupBy("ord").agg(
        *[F.max(F.when(taken & (by == k), origin)).alias(f"origin_{k}") for k in every],
        F.max(F.when(taken & (by == "message_id"), F.col("holder.kind"))).alias("stopped_by"),
    )
    out = rows.join(found, "ord", "left")
    hit = {k: F.col(f"origin_{k}").isNotNull() for k in every}
    empty = F.col("digest").isNull()
    reason = (
        F.when(hit["message_id"], "not_tried")
        .when(empty, "attachment_empty")
        .when(hit["digest"], "duplicate_hash")
        .when(hit["fingerprint"], "duplicate_text")
        .when(~F.col("verified"), "verify_failed")
        .when(hit["stem"], "duplicate_stem")
    )
    decision = (
        F.when(reason.isNull(), "saved")
        .when(reason == "attachment_empty", "error")
        .when(reason == "verify_failed", "quarantine")
        .otherwise("skip")
    )
    source = F.coalesce(*[F.when(reason == r, F.col(f"origin_{k}")) for k, r in zip(every, _REASONS, strict=True)])
    return checkpoint(
        out.where(~F.coalesce(F.col("stopped_by") == "attachment", F.lit(False))).select(
            "kind", "place", "part", "message_id", "path", decision.alias("decision"), reason.alias("reason"),
            source.alias("duplicate_of"),
        )
    )


_REASONS = ("not_tried", "duplicate_hash", "duplicate_text", "duplicate_stem")


def unsaved_messages(messages: DataFrame, attachments: DataFrame, links: DataFrame) -> DataFrame:
    """Why a message gave nothing: one reason per message without a saved document.

    Decisions are reduced to one row of counts per message before they meet the messages.
    """
    per_attachment = attachments.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("tried"),
        F.count_if(F.expr("decision = 'saved'")).alias("saved"),
        F.count_if(F.expr("decision in ('error', 'quarantine')")).alias("failures"),
        F.count_if(F.expr("decision = 'skip'")).alias("skips"),
    )
    per_link = links.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(F.expr("decision = 'saved'")).alias("saved_links")
    )

    def n(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    return (
        messages.select("message_id")
        .join(per_attachment, "message_id", "left")
        .join(per_link, "message_id", "left")
        .where((n("saved") == 0) & (n("saved_links") == 0))
        .select(
            "message_id",
            unsaved_reason(n("tried") > 0, n("failures"), n("skips"), n("links") > 0).alias("reason"),
        )
    )


def processed_ids(saved: DataFrame, rejected: DataFrame, report: DataFrame) -> DataFrame:
    """Messages not to look at again: saved ones and those with a final reason.

    saved(message_id), rejected(message_id, reason), report(message_id, reject).
    """
    final = rejected.where(~is_retryable_reason(F.col("reason"))).select("message_id")
    reported = report.where(~is_retryable_reason(F.col("reject"))).select("message_id")
    return (
        saved.select("message_id")
        .unionByName(final)
        .unionByName(reported)
        .where("message_id is not null and message_id <> ''")
        .distinct()
    )
