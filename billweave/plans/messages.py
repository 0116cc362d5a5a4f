"""Message queries: relevance, gating, search strategies, scoring, collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import links as lk
from ..functions import text as tx
from ..operators import collect, dedup, scoring
from ..operators import relevance as rel
from ..session import checkpoint
from ..sources import scan
from . import views as v
from .documents import _FP, _STATS_SQL, _STEM, WS, _count, _squeezed
from .pages import _UNESCAPED
from .registry import query


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_CTX = "coalesce(subject, '') || ' ' || coalesce(preview, '')"
_NEG = f"({_any('ctx', v.TERMS.raw_neg)} or {_any('lower(ctx)', v.TERMS.latin_neg)})"
_POS = f"({_any('ctx', v.TERMS.raw_pos)} or {_any('lower(ctx)', v.TERMS.latin_pos)})"
_MUNI = _any("ctx", v.TERMS.municipal)
_FLAGS = f"{v.MSGS_SQL}, c as (select *, {_CTX} as ctx from msgs), f as (select *, {_NEG} as neg, {_POS} as pos, {_MUNI} as muni from c)"
_PDF = "has_attachments and attachment_name like '%.PDF'"


@query(
    "message_relevance",
    f"with {_FLAGS} select message_id, neg as negative, pos as positive, muni as municipal, not neg and (pos or muni) as relevant from f",
)
def message_relevance(spark, folder):
    m = v.messages(spark, folder)
    ctx = rel.message_context(F.col("subject"), F.col("preview"))
    return m.select(
        "message_id",
        tx.body_has_negative(ctx, v.TERMS).alias("negative"),
        tx.body_has_positive(ctx, v.TERMS).alias("positive"),
        tx.is_municipal_text(ctx, v.TERMS).alias("municipal"),
        rel.should_consider_message(F.col("subject"), F.col("preview"), v.TERMS).alias("relevant"),
    )


@query(
    "message_prefilter",
    f"""with {_FLAGS}, k as (select message_id, (not neg and (pos or muni)) or ({_PDF}) or ends_with(sender, '@desk.example.org>') as keep from f)
    select message_id, keep, case when not keep then 'prefilter_non_invoice' end as reason from k""",
)
def message_prefilter(spark, folder):
    m = v.messages(spark, folder)
    kept = rel.prefilter_messages(m, v.TERMS, trusted_senders=("desk.example.org",))
    return kept.select("message_id", "keep", "reason")


@query(
    "document_trust",
    f"""with {_FLAGS} select message_id, has_attachments or muni or ends_with(sender, '@desk.example.org>') as trusted from f""",
)
def document_trust(spark, folder):
    """Links of messages with attachments lead to a trusted host, the others elsewhere."""
    url = F.when(F.col("has_attachments"), F.col("web_link")).otherwise("https://files.example.net/x")
    hint = rel.trusted_document(
        url,
        F.col("sender"),
        rel.message_context(F.col("subject"), F.col("preview")),
        v.TERMS,
        ("mail.example.com",),
        ("desk.example.org",),
    )
    return v.messages(spark, folder).select("message_id", hint.alias("trusted"))


@query(
    "message_gate",
    f"""with {_FLAGS} select message_id, case when not (has_attachments or (not neg and (pos or muni))) then 'skipped'
      when neg and not (pos or muni) then 'negative_context' else 'accepted' end as gate, muni as trusted_hint from f""",
)
def message_gate(spark, folder):
    m = v.messages(spark, folder)
    return rel.gate_messages(m, v.TERMS).select("message_id", "gate", "trusted_hint")


@query(
    "scan_counters",
    f"""with {_FLAGS}, k as (select *, (not neg and (pos or muni)) or ({_PDF}) as keep from f)
    select count(*) as scanned, count(*) filter (where keep) as full_fetch, count(*) filter (where not keep) as prefilter_skipped,
      count(*) filter (where parent_folder = 'sent') as cached_skipped from k""",
)
def scan_counters(spark, folder):
    kept = rel.prefilter_messages(v.messages(spark, folder), v.TERMS)
    return rel.stage_counters(
        kept,
        full_fetch=F.col("keep"),
        prefilter_skipped=~F.col("keep"),
        cached_skipped=F.col("parent_folder") == "sent",
    )


@query(
    "sender_trust",
    f"""with {v.MSGS_SQL}, e as (select message_id, lower(trim(case when regexp_extract(sender, '<([^>]+)>', 1) <> '' then regexp_extract(sender, '<([^>]+)>', 1) else sender end)) as e from msgs),
      d as (select message_id, case when contains(e, '@') then regexp_extract(e, '([^@]*)$', 1) else '' end as domain from e)
    select message_id, domain, domain <> '' and suffix(domain, 'mail.example.com') as trusted from d""",
)
def sender_trust(spark, folder):
    sender = F.col("sender")
    return v.messages(spark, folder).select(
        "message_id",
        tx.sender_domain(sender).alias("domain"),
        tx.is_trusted_sender(sender, ("mail.example.com",)).alias("trusted"),
    )


_WINDOW = "received >= timestamp '2024-01-02' and received < timestamp '2024-01-05'"


@query(
    "message_window",
    f"with {v.MSGS_SQL} select message_id, subject, sender, received, has_attachments, web_link, preview, parent_folder from msgs where {_WINDOW} and parent_folder <> 'sent'",
)
def message_window(spark, folder):
    return scan.scan_messages(
        v.messages(spark, folder), "2024-01-02", "2024-01-05", ["sent", ""], max_pages=None
    )


@query(
    "message_listing",
    f"with {v.MSGS_SQL} select message_id, received, subject from msgs where {_WINDOW} order by received desc, message_id limit 40",
)
def message_listing(spark, folder):
    """The newest two pages of twenty: the cap is what the listing offers."""
    listed = scan.scan_messages(
        v.messages(spark, folder), "2024-01-02", "2024-01-05", page_size=20, max_pages=2
    )
    return listed.select("message_id", "received", "subject")


_SEARCH_WORDS = [w.lower() for w in rel.expanded_query_terms(v.TERMS, "d")]


@query(
    "mailbox_search",
    f"""with {_FLAGS} select message_id from f where {_WINDOW} and parent_folder <> 'sent'
      and ({_any('lower(ctx)', _SEARCH_WORDS)} or lower(attachment_name) like '%.pdf')""",
)
def mailbox_search(spark, folder):
    return rel.search_messages(
        v.messages(spark, folder), "2024-01-02", "2024-01-05", v.TERMS, prefix="d"
    ).select("message_id")


_REASONS = "case when turn % 5 = 0 then 'attach_download_FAIL:x' when turn % 5 = 1 then 'generated' when turn % 5 = 2 then 'links_no_pdf' else 'verify_failed' end"


@query(
    "incremental_skip",
    f"""with {v.MSGS_SQL}, t as (select 'm' || conv_id || '-' || turn as message_id, turn, role, conv_id, {_REASONS} as reason from conversations),
      done as (select message_id from t where role = 'system' union select message_id from t where role = 'user' and not regexp_matches(lower(reason), '_fail|timeout|rate')
        union select message_id from t where role = 'assistant' and conv_id % 2 = 0 and not regexp_matches(lower(reason), '_fail|timeout|rate'))
    select message_id from msgs where message_id not in (select message_id from done)""",
)
def incremental_skip(spark, folder):
    t = v.table(spark, folder, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("message_id"), "conv_id", "turn", "role"
    )
    kind = F.col("turn") % 5
    reason = (
        F.when(kind == 0, "attach_download_FAIL:x")
        .when(kind == 1, "generated")
        .when(kind == 2, "links_no_pdf")
        .otherwise("verify_failed")
    )
    done = collect.processed_ids(
        t.where("role = 'system'"),
        t.where("role = 'user'").withColumn("reason", reason),
        t.where("role = 'assistant' and conv_id % 2 = 0").withColumn("reject", reason),
    )
    m = v.messages(spark, folder).select("message_id")
    return dedup.skip_known(m, done, "message_id")


@query(
    "attachment_listing",
    f"""with {v.MSGS_SQL} select message_id, attachment_name as name, has_attachments and attachment_name like '%.PDF' as has_pdf,
      regexp_matches(lower(attachment_name), '\\.(pdf|png)$') or contains(lower(attachment_name), 'scan') as preferred from msgs""",
)
def attachment_listing(spark, folder):
    m = v.messages(spark, folder).withColumn("part", F.explode("parts"))
    listed = scan.attachment_listing(
        m.select(
            "message_id",
            F.col("part.attachment_id").alias("attachment_id"),
            F.col("part.filename").alias("name"),
            F.col("part.mime").alias("content_type"),
            F.octet_length("body").alias("size"),
            "parts",
            F.col("body").alias("content"),
        ).withColumn("content", F.col("content"))
    )
    preferred = scoring.prefers_attachment(F.col("name"), F.col("content_type"), v.SCORES)
    part = F.array(
        F.struct(
            F.col("content_type").alias("mime"),
            F.col("name").alias("filename"),
            "attachment_id",
        )
    )
    return listed.select(
        "message_id", "name", rel.has_pdf_attachment(part).alias("has_pdf"), preferred.alias("preferred")
    )


# --- scoring ----------------------------------------------------------------------------

_S = v.SCORES


def scored_messages(spark, folder):
    """Conversation turns whose body carries the links of the page with the same number."""
    pages = v.web_pages(spark, folder).select(
        F.col("page_id"), F.array_join(lk.html_links(F.col("html")), " ").alias("hrefs"), "url"
    )
    m = v.messages(spark, folder).withColumn(
        "page_id", F.regexp_extract("message_id", r"m(\d+)-", 1).cast("bigint")
    )
    joined = m.join(pages, "page_id", "left")
    parts = tx.email_parts(F.lit("n"), F.regexp_extract("sender", "<([^>]+)>", 1))
    return joined.select(
        "message_id",
        "subject",
        "preview",
        "received",
        "web_link",
        "has_attachments",
        F.concat_ws(" ", "url", F.lit("&amp; (https://m.example.com/fr/1.html),"), "body").alias("body"),
        F.regexp_extract("sender", r"\A([^<]*?) ?(?:<|\z)", 1).alias("sender_name"),
        parts["address"].alias("sender_address"),
        F.when(
            F.col("has_attachments"),
            F.array(
                F.struct(
                    F.col("attachment_name").alias("name"),
                    F.lit("application/PDF").alias("content_type"),
                )
            ),
        ).alias("attachments"),
    )


_SCORE_MSGS = f"""{v.MSGS_SQL},
  sm as (select message_id, subject, preview, received, web_link, has_attachments, attachment_name, m.conv, url,
      coalesce(url || ' ', '') || '& (https://m.example.com/fr/1.html), ' || body as body, sender,
      lower(regexp_extract(sender, '<([^>]+)>', 1)) as address
    from (select *, cast(regexp_extract(message_id, 'm(\\d+)-', 1) as bigint) as conv from msgs) m left join pages on conv = page_id),
  lt as (select *, lower(subject || chr(10) || preview || chr(10) || regexp_replace(body, '<[^>]+>', ' ', 'g')) as blob, lower(subject) as s from sm),
  urls as (select message_id, unnest(list_distinct([u for u in [coalesce(url, 'https://m.example.com/fr/1.html'), 'https://m.example.com/fr/1.html']])) as u from sm),
  hosts as (select message_id, u, regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') as dom, lower(coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')) as path from urls),
  ev as (select *, dom = 'example.com' or suffix(dom, '.example.com') as trusted, contains(lower(u), 'the') or contains(lower(u), 'page') or contains(path, '/en') or contains(path, '/fr') as word,
      suffix(lower(u), '.html') as suf, prefix(u, 'https://') or (prefix(u, 'http://') and (dom = 'example.org' or suffix(dom, '.example.org'))) as allowed from hosts),
  lk as (select message_id, count(*) filter (where allowed and (trusted or word or suf)) as kept,
      case when bool_or(allowed and trusted) then 0.4::double else 0.0 end + case when bool_or(allowed and suf) then 0.25::double else 0.0 end
      + case when bool_or(allowed and word) then 0.15::double else 0.0 end as ls from ev group by 1),
  h as (select lt.*, kept, least(0.7::double, ls) as link_score, {_count('blob', _S.hebrew)} as he, {_count('blob', _S.english)} as en, {_count('blob', _S.negatives)} as bad from lt join lk using (message_id)),
  b as (select *, cast(round(cast(least(1.0::double, least(he * 1.2::double * 0.05::double + en * 1.0::double * 0.05::double, 0.8::double) + link_score + case when has_attachments then 0.25::double else 0.0 end) as decimal(28,10)), 3) as double) as base from h),
  c1 as (select *, least(1.0::double, base + case when regexp_matches(s, 'que|und|(^|[^\\p{{L}}\\p{{N}}_])(the|with)($|[^\\p{{L}}\\p{{N}}_])') then 0.35::double else 0.0 end
      + case when contains(s, 'the') and (contains(s, 'la') or contains(s, 'in')) then 0.2::double else 0.0 end + 0.0::double) as c from b),
  c2 as (select *, least(1.0::double, greatest(0.0::double, c + case when has_attachments and regexp_matches(lower(attachment_name), '(copy|note).{{0,20}}(doc|scan)') then -0.25::double else 0.0 end)) as d from c1),
  c3 as (select *, least(1.0::double, greatest(0.0::double, d + case when suffix(address, '@mail.example.com') then 0.2::double when address = 'help@desk.example.org' then -0.25::double else 0.0 end)) as e from c2),
  c4 as (select *, least(1.0::double, greatest(0.0::double, e + bad * -0.08::double)) as f from c3),
  c5 as (select *, least(1.0::double, greatest(0.0::double, f + case when regexp_matches(subject, '^The|ent') then 0.2::double else 0.0 end)) as g from c4)"""


@query(
    "message_score",
    f"""with {_SCORE_MSGS} select message_id, cast(he as bigint) as lang_hits_he, cast(en as bigint) as lang_hits_en, kept as n_links, link_score, base as base_confidence,
      cast(round(cast(g as decimal(28,10)), 3) as double) as match_confidence, g >= 0.55 as accepted from c5""",
)
def message_score(spark, folder):
    scored = scoring.score_messages(scored_messages(spark, folder), v.SCORES)
    return scored.select(
        "message_id",
        F.col("language.he").cast("bigint").alias("lang_hits_he"),
        F.col("language.en").cast("bigint").alias("lang_hits_en"),
        F.size("kept_links").cast("bigint").alias("n_links"),
        "link_score",
        "base_confidence",
        "match_confidence",
        (F.col("raw_confidence") >= R.MIN_CONFIDENCE).alias("accepted"),
    )


@query(
    "message_result_rows",
    f"""with {_SCORE_MSGS} select message_id, case when sender = 'daemon' then 'daemon' when prefix(sender, 'Desk') then 'Desk <help@desk.example.org>' else sender end as sender,
      cast(round(cast(g as decimal(28,10)), 3) as double) as match_confidence,
      case when has_attachments then '{{"name":"' || attachment_name || '","content_type":"application/PDF"}}' else '' end as attachments,
      cast(he as bigint) as explained_he from c5""",
)
def message_result_rows(spark, folder):
    scored = scoring.score_messages(scored_messages(spark, folder), v.SCORES)
    rows = scoring.output_rows(scored, explain=True)
    return rows.select(
        "message_id",
        "sender",
        "match_confidence",
        scoring.flatten_list(F.col("matched_attachments"), structs=True).alias("attachments"),
        F.col("explanations.language.he").cast("bigint").alias("explained_he"),
    )




def _keyword_first_sql(words: R.KeywordFirstRules, text: str) -> str:
    return f"""with {v.MSGS_SQL}, t as (select *, {text} as t from (select *, cast(regexp_extract(message_id, 'm(\\d+)-', 1) as bigint) as conv, cast(regexp_extract(message_id, '-(\\d+)', 1) as bigint) as turn from msgs)),
      h as (select *, {_count('t', words.hebrew)} as he, {_count('t', words.english)} as en, {_count('t', words.context)} as ctx from t)
    select message_id, cast(round(cast(least(1.0::double, (he * 1.2::double + en * 1.0::double) / case when he + en + ctx > 0 then 2.0::double + ctx * 0.15::double else 1.0::double end
      + case when has_attachments and attachment_name like '%.PDF' then 0.25::double else 0.0 end + case when conv % 2 = 0 then 0.25::double else 0.0 end) as decimal(28,10)), 6) as double) as match_confidence
    from h"""


def keyword_first_rows(spark, folder):
    m = v.messages(spark, folder)
    even = F.regexp_extract("message_id", r"m(\d+)-", 1).cast("bigint") % 2 == 0
    return m.select(
        "message_id",
        "subject",
        "preview",
        F.when(even, F.array(F.lit("https://a.example.com/q?x=download"), F.lit("http://b/view")))
        .otherwise(F.array(F.lit("http://stripe.com/invoice"), F.lit("https://a.example.com/")))
        .alias("links"),
        F.when(F.col("has_attachments"), F.array(F.struct(F.col("attachment_name").alias("name"))))
        .otherwise(F.array().cast("array<struct<name:string>>"))
        .alias("attachments"),
    )


def keyword_first_result(scored):
    return scored.select(
        "message_id",
        F.round(F.col("match_confidence").cast("decimal(28,10)"), 6).cast("double").alias("match_confidence"),
    )


_WORDS = R.KeywordFirstRules(hebrew=("que", "les", "para"), english=("the", "with"), context=("ing", "ment"))


@query("keyword_first_score", _keyword_first_sql(_WORDS, "lower(subject || chr(10) || preview)"))
def keyword_first_score(spark, folder):
    return keyword_first_result(scoring.keyword_first_score(keyword_first_rows(spark, folder), _WORDS))


_NOTES = ("View bill of the month", "Your receipt: amount due", "חשבונית מס קבלה, סכום לתשלום", "hello", "Statement הורד קובץ")


@query(
    "keyword_first_default",
    _keyword_first_sql(
        R.KeywordFirstRules(),
        "lower(subject || chr(10) || (" + str(list(_NOTES)) + ")[1 + (conv + turn) % 5] || ' ' || preview)",
    ),
)
def keyword_first_default(spark, folder):
    """The model with its own words, on previews that hold some of them."""
    conv = F.regexp_extract("message_id", r"m(\d+)-", 1).cast("bigint")
    turn = F.regexp_extract("message_id", r"-(\d+)", 1).cast("bigint")
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (1 + (conv + turn) % 5).cast("int"))
    rows = keyword_first_rows(spark, folder).withColumn("preview", F.concat(note, F.lit(" "), "preview"))
    return keyword_first_result(scoring.keyword_first_score(rows))


_FOUND = (
    f"{v.MSGS_SQL}, t as (select *, lower(subject || chr(10) || preview) as t from msgs), found as ("
    + " union all ".join(
        f"select message_id, {i} as rank, '{n}' as strategy, cast(length(preview) % {7 + i} as double) as match_confidence from t where {_any('t', tuple(w.lower() for w in ws))}"
        for i, (n, ws) in enumerate(v.STRATEGIES)
    )
    + ")"
)


def found_messages(spark, folder):
    found = scoring.run_strategies(v.messages(spark, folder), v.STRATEGIES)
    conf = F.pmod(F.length("preview"), F.col("rank") + 7).cast("double")
    return found.select("message_id", "rank", "strategy", conf.alias("match_confidence"))


@query(
    "strategy_union",
    f"with {_FOUND}, r as (select *, row_number() over (partition by message_id order by rank) as rn from found) select message_id, rank, strategy from r where rn = 1",
)
def strategy_union(spark, folder):
    found = found_messages(spark, folder).drop("match_confidence")
    return scoring.first_strategy(found).select("message_id", "rank", "strategy")


@query(
    "strategy_best_scored",
    f"with {_FOUND}, r as (select *, row_number() over (partition by message_id order by match_confidence desc, rank) as rn from found) select message_id, rank, strategy, match_confidence from r where rn = 1",
)
def strategy_best_scored(spark, folder):
    return scoring.best_scored(found_messages(spark, folder)).select(
        "message_id", "rank", "strategy", "match_confidence"
    )


@query(
    "strategy_counts",
    f"""with {_FOUND}, s as (select unnest({[n for n, _ in v.STRATEGIES]}) as strategy), r as (select *, row_number() over (partition by message_id order by rank) as rn from found)
    select s.strategy, (select count(*) from found f where f.strategy = s.strategy) as candidates, (select count(*) from r where r.strategy = s.strategy and rn = 1) as final_matches from s""",
)
def strategy_counts(spark, folder):
    found = checkpoint(found_messages(spark, folder))
    return scoring.strategy_counts(found, scoring.first_strategy(found), v.STRATEGIES)


@query(
    "subject_pattern_candidates",
    f"with {v.MSGS_SQL} select message_id, regexp_matches(subject || ' ' || preview, 'que|les{WS}*aux') or regexp_matches(lower(subject || ' ' || preview), 'therea|nting') as candidate from msgs",
)
def subject_pattern_candidates(spark, folder):
    hit = scoring.is_invoice_candidate(
        F.col("subject"), F.col("preview"), r"(?:que|les\s*aux)", r"(?:therea|nting)"
    )
    return v.messages(spark, folder).select("message_id", hit.alias("candidate"))


# --- collection -------------------------------------------------------------------------


def mail_attachments(spark, folder):
    """Documents as attachments: three to a message, verified by the keyword rule."""
    docs = v.documents(spark, folder).where(scan.has_extension(F.col("path"), ["pdf"]))
    assessed = rel.assess_documents(docs, v.TERMS)
    message = F.concat(F.lit("d"), F.lpad(F.floor(F.col("doc_id") / 3).cast("string"), 9, "0"))
    return assessed.select(
        F.concat(message, F.lit("|"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("ord"),
        message.alias("message_id"),
        "path",
        F.when(F.col("content") != "", tx.content_hash(F.col("content"))).alias("digest"),
        tx.fingerprint(F.col("pages")).alias("fingerprint"),
        F.col("accepted_trusting").alias("verified"),
        (F.col("doc_id") % 10 == 0).alias("old"),
    )


def attachment_decisions(spark, folder):
    rows = mail_attachments(spark, folder)
    return collect.collect_attachments(
        rows.where("not old").drop("old"), rows.where("old and digest is not null")
    )


_WALK = f"""{v.DOCS_SQL}, {_STATS_SQL}, {_FP},
  judged as (select d.doc_id, d.path, d.content, d.doc_id % 10 = 0 as old, f.fingerprint, case when d.content <> '' then sha256(d.content) end as digest,
      (c.pos_hits >= 1 and c.neg_hits = 0 and (c.pos_hits > c.weak_hits or c.amount_hint or c.invoice_id_hint)) or (d.trusted and c.pos_hits = 0 and c.neg_hits = 0) as verified
    from docs d join counted c using (doc_id) left join fps f using (doc_id) where lower(d.path) like '%.pdf'),
  corpus as (select * from judged where old and digest is not null),
  kd as (select digest, min(path) as known from corpus group by 1), kf as (select fingerprint, min(path) as known from corpus where fingerprint is not null group by 1),
  cand as (select j.*, kd.known as known_d, kf.known as known_f from judged j left join kd using (digest) left join kf on j.fingerprint = kf.fingerprint where not old),
  steps as (select list({{'d': case when digest is null then [] else [digest] end, 'f': case when fingerprint is null then [] else [fingerprint] end,
      'c': [digest is null, known_d is not null, known_f is not null, not verified], 'out': [path]}} order by doc_id) as l from cand),
  walked as (select list_reduce(l, lambda a, x: case
      when x.c[1] then {{'d': a.d, 'f': a.f, 'c': a.c, 'out': list_append(a.out, x.out[1] || '|error|attachment_empty')}}
      when x.c[2] or list_has_any(a.d, x.d) then {{'d': a.d, 'f': a.f, 'c': a.c, 'out': list_append(a.out, x.out[1] || '|skip|duplicate_hash')}}
      when x.c[3] or list_has_any(a.f, x.f) then {{'d': a.d, 'f': a.f, 'c': a.c, 'out': list_append(a.out, x.out[1] || '|skip|duplicate_text')}}
      when x.c[4] then {{'d': a.d, 'f': a.f, 'c': a.c, 'out': list_append(a.out, x.out[1] || '|quarantine|verify_failed')}}
      else {{'d': list_concat(a.d, x.d), 'f': list_concat(a.f, x.f), 'c': a.c, 'out': list_append(a.out, x.out[1] || '|saved|')}} end,
      {{'d': []::varchar[], 'f': []::varchar[], 'c': []::boolean[], 'out': []::varchar[]}}) as w from steps),
  verdict as (select string_split(o, '|') as p from (select unnest(w.out) as o from walked)),
  decided as (select c.*, p[2] as decision, nullif(p[3], '') as reason from cand c join verdict on p[1] = c.path),
  holders as (select digest, fingerprint, path from decided where decision = 'saved')"""


@query(
    "collection_attachments",
    f"""with {_WALK} select 'd' || lpad(cast(d.doc_id // 3 as varchar), 9, '0') as message_id, d.path, decision, reason,
      case reason when 'duplicate_hash' then coalesce(known_d, hd.path) when 'duplicate_text' then coalesce(known_f, hf.path) end as duplicate_of
    from decided d left join holders hd on d.digest = hd.digest left join holders hf on d.fingerprint = hf.fingerprint""",
)
def collection_attachments(spark, folder):
    return attachment_decisions(spark, folder).select(
        "message_id", "path", "decision", "reason", "duplicate_of"
    )


def walked_mail(spark, folder):
    """Decisions of a walk over the mailbox.  Three documents are the attachments of a message;
    its links lead to two pages and, of its documents, to those that are no PDF."""
    docs = rel.assess_documents(v.documents(spark, folder), v.TERMS).select(
        message_of(F.floor(F.col("doc_id") / 3)).alias("message_id"),
        F.col("doc_id").alias("part"),
        "path",
        F.when(F.col("content") != "", tx.content_hash(F.col("content"))).alias("digest"),
        tx.fingerprint(F.col("pages")).alias("fingerprint"),
        tx.stem_key(F.col("path")).alias("stem"),
        F.col("accepted_trusting").alias("verified"),
    )
    docs = checkpoint(docs)
    text = lk.html_text(F.col("html"))
    pages = v.web_pages(spark, folder).select(
        message_of(F.floor(F.col("page_id") / 2)).alias("message_id"),
        (F.col("page_id") + _PAGE_PART).alias("part"),
        F.col("url").alias("path"),
        tx.content_hash(F.col("html")).alias("digest"),
        tx.fingerprint(F.array(text)).alias("fingerprint"),
        tx.stem_key(lk.path_of(F.col("url"))).alias("stem"),
        (tx.contains_any(text, ("the", "que")) & ~tx.contains_any(text, ("heron",))).alias("verified"),
    )
    pdf = scan.has_extension(F.col("path"), ["pdf"])
    old = F.col("part") % 10 == 0
    linked = docs.where(~pdf).unionByName(pages).withColumn("place", F.col("message_id"))
    attached = docs.where(pdf & ~old).drop("stem").withColumn("place", F.col("message_id"))
    corpus = docs.where(pdf & old & F.col("digest").isNotNull())
    return collect.collect_messages(attached, linked, corpus)


def message_of(number):
    return F.concat(F.lit("d"), F.lpad(number.cast("string"), 9, "0"))


# pages come after the documents of a message
_PAGE_PART = 1_000_000_000

_PAGE_TEXT = _squeezed(_UNESCAPED)
_MAIL_WALK = f"""{v.DOCS_SQL}, {_STATS_SQL}, {_FP},
  judged as (select d.doc_id, d.path, d.content, f.fingerprint, case when d.content <> '' then sha256(d.content) end as digest, {_STEM} as stem, lower(d.path) like '%.pdf' as pdf,
      (c.pos_hits >= 1 and c.neg_hits = 0 and (c.pos_hits > c.weak_hits or c.amount_hint or c.invoice_id_hint)) or (d.trusted and c.pos_hits = 0 and c.neg_hits = 0) as verified
    from docs d join counted c using (doc_id) left join fps f using (doc_id)),
  corpus as (select * from judged where pdf and doc_id % 10 = 0 and digest is not null),
  kd as (select digest, min(path) as known from corpus group by 1), kf as (select fingerprint, min(path) as known from corpus where fingerprint is not null group by 1),
  ks as (select stem, min(path) as known from corpus group by 1),
  page_said as (select page_id, url, html, {_PAGE_TEXT} as t from pages),
  page_path as (select *, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from page_said),
  cand as (
    select case when pdf then 0 else 1 end as kind, 'd' || lpad(cast(doc_id // 3 as varchar), 9, '0') as message_id, doc_id as part, path, digest, fingerprint, stem, verified
      from judged where not pdf or doc_id % 10 <> 0
    union all select 1, 'd' || lpad(cast(page_id // 2 as varchar), 9, '0'), page_id + {_PAGE_PART}, url, sha256(html), case when t <> '' then sha256(t) end,
      {_STEM}, (contains(t, 'the') or contains(t, 'que')) and not contains(t, 'heron') from page_path),
  faced as (select c.*, kd.known as known_d, kf.known as known_f, ks.known as known_s from cand c left join kd using (digest) left join kf on c.fingerprint = kf.fingerprint left join ks on c.stem = ks.stem),
  steps as (select list({{'k': kind, 'm': message_id, 'd': case when digest is null then [] else [digest] end, 'f': case when fingerprint is null then [] else [fingerprint] end, 's': [stem],
      'c': [digest is null, known_d is not null, known_f is not null, not verified, known_s is not null], 'ma': '', 'ml': '', 'out': [kind || '|' || part]}}
      order by message_id, kind, part) as l from faced),
  walked as (select list_reduce(l, lambda a, x: {{
      'k': 0, 'm': '', 'c': a.c,
      'd': case when verdict(a, x) = 'saved|' then list_concat(a.d, x.d) else a.d end,
      'f': case when verdict(a, x) = 'saved|' then list_concat(a.f, x.f) else a.f end,
      's': case when verdict(a, x) = 'saved|' and x.k = 1 then list_concat(a.s, x.s) else a.s end,
      'ma': case when verdict(a, x) = 'saved|' and x.k = 0 then x.m else a.ma end,
      'ml': case when verdict(a, x) = 'saved|' and x.k = 1 then x.m else a.ml end,
      'out': list_append(a.out, x.out[1] || '|' || verdict(a, x))}},
      {{'k': 0, 'm': '', 'd': []::varchar[], 'f': []::varchar[], 's': []::varchar[], 'c': []::boolean[], 'ma': '', 'ml': '', 'out': []::varchar[]}}) as w from steps),
  told as (select string_split(o, '|') as p from (select unnest(w.out) as o from walked)),
  decided as (select f.*, p[3] as decision, nullif(p[4], '') as reason from faced f join told on cast(p[1] as integer) = f.kind and cast(p[2] as bigint) = f.part where p[3] <> 'unseen'),
  holders as (select * from decided where decision = 'saved')"""
#: what the fold says about document x after the documents in a
_VERDICT = """case when x.k = 1 and a.ma = x.m then 'unseen|' when x.k = 1 and a.ml = x.m then 'skip|not_tried' when x.c[1] then 'error|attachment_empty'
      when x.c[2] or list_has_any(a.d, x.d) then 'skip|duplicate_hash' when x.c[3] or list_has_any(a.f, x.f) then 'skip|duplicate_text'
      when x.c[4] then 'quarantine|verify_failed' when x.k = 1 and (x.c[5] or list_has_any(a.s, x.s)) then 'skip|duplicate_stem' else 'saved|' end"""
_MAIL_WALK = _MAIL_WALK.replace("verdict(a, x)", f"({_VERDICT})")


@query(
    "collection_links",
    f"""with {_MAIL_WALK} select message_id, path, decision, reason, case reason when 'not_tried' then hm.path when 'duplicate_hash' then coalesce(known_d, hd.path)
        when 'duplicate_text' then coalesce(known_f, hf.path) when 'duplicate_stem' then coalesce(known_s, hs.path) end as duplicate_of
    from (select * from decided where kind = 1) d left join (select digest, path from holders) hd using (digest) left join (select fingerprint, path from holders) hf on d.fingerprint = hf.fingerprint
      left join (select stem, path from holders where kind = 1) hs on d.stem = hs.stem left join (select message_id, path from holders where kind = 1) hm on d.message_id = hm.message_id""".replace(
        "select message_id, path, decision", "select d.message_id, d.path, decision"
    ),
)
def collection_links(spark, folder):
    links = walked_mail(spark, folder).where("kind = 'link'")
    return links.select("message_id", "path", "decision", "reason", "duplicate_of")


@query(
    "collection_unsaved_reasons",
    f"""with {_MAIL_WALK}, per as (select message_id, count(*) filter (where kind = 0) as tried, count(*) filter (where kind = 0 and decision in ('error', 'quarantine')) as failures,
        count(*) filter (where kind = 0 and decision = 'skip') as skips, count(*) filter (where kind = 1) as links, bool_or(decision = 'saved') as any_saved from decided group by 1)
    select message_id, case when tried > 0 and failures > 0 then 'attachment_processing_failed' when tried > 0 and skips > 0 then 'attachment_skipped' when tried > 0 then 'attachment_no_save'
      when links > 0 then 'links_no_pdf' else 'no_attach_no_pdf_links' end as reason from per where not any_saved""",
)
def collection_unsaved_reasons(spark, folder):
    walked = walked_mail(spark, folder)
    attachments, links = walked.where("kind = 'attachment'"), walked.where("kind = 'link'")
    return collect.unsaved_messages(walked.select("message_id").distinct(), attachments, links)
