"""Document queries: scans, hashes, fingerprints, de-duplication, keyword statistics."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup
from ..operators import relevance as rel
from ..session import checkpoint, run_dir
from ..sources import files, scan
from . import views as v
from .registry import query

_SKIP = "not regexp_matches(path, '/(_tmp|quarantine|duplicates)/')"
# Python-style white space in RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_STEM = r"regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '__\d+$', '')"


def _squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


@query(
    "document_scan",
    f"with {v.DOCS_SQL} select path, provider from docs where {_SKIP} and lower(path) like '%.pdf'",
)
def document_scan(spark, folder):
    docs = v.documents(spark, folder)
    path = F.col("path")
    return docs.where(scan.outside_folders(path) & scan.has_extension(path, ["pdf"])).select(
        "path", "provider"
    )


@query(
    "document_scan_by_extension",
    f"with {v.DOCS_SQL} select path, provider from docs where lower(path) like '%.txt' or lower(path) like '%.tif'",
)
def document_scan_by_extension(spark, folder):
    docs = v.documents(spark, folder)
    return docs.where(scan.has_extension(F.col("path"), [".TXT", "tif"])).select("path", "provider")


_TREE_NAME = r"regexp_replace(path, '([^/]*)$', case when doc_id % 3 = 0 then '_\1' when doc_id % 7 = 0 then '.\1' else '\1' end)"


@query(
    "document_tree",
    f"""with {v.DOCS_SQL}, named as (select content, case when doc_id % 5 = 1 then '/.mail' when doc_id % 5 = 2 then '/_old/deep' else '' end || {_TREE_NAME} as path from docs)
    select path, cast(octet_length(encode(content)) as bigint) as length, sha256(content) as digest from named where {_SKIP} and lower(path) like '%.pdf'""",
)
def document_tree(spark, folder):
    """The documents as files below folders and under names that start with all kinds of
    letters, and what a scan of that folder finds."""
    root, number = run_dir(spark, "tree"), F.col("doc_id")
    start = F.when(number % 3 == 0, "_").when(number % 7 == 0, ".").otherwise("")
    above = F.when(number % 5 == 1, "/.mail").when(number % 5 == 2, "/_old/deep").otherwise("")
    name = F.substring_index("path", "/", -1)
    parents = F.left("path", F.length("path") - F.length(name))
    docs = v.documents(spark, folder)
    files.write_files(docs.select(F.concat(above, parents, start, name).alias("path"), "content"), root)
    found = scan.scan_documents(spark, root)
    return found.select(
        F.regexp_replace("path", "^.*/" + root.rsplit("/", 1)[1], "").alias("path"),
        "length",
        F.sha2("content", 256).alias("digest"),
    )


_WANTED = "(select 'src' || (l_orderkey % 25) || '/en_' || l_linenumber || '__' || l_orderkey || '.pdf' as name from lineitem union select substr(path, 2) from docs where provider = 'en')"


@query(
    "file_selection",
    f"""with {v.DOCS_SQL}, wanted as {_WANTED}
    select name, not exists (select 1 from docs where path = '/' || name) as missing from wanted""",
)
def file_selection(spark, folder):
    docs = v.documents(spark, folder).select("provider", "path")
    lines = v.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    guessed = lines.select(
        F.concat(
            F.lit("src"), F.col("l_orderkey") % 25, F.lit("/en_"), "l_linenumber", F.lit("__"),
            "l_orderkey", F.lit(".pdf"),
        ).alias("name")
    )
    known = docs.where("provider = 'en'").select(F.expr("substring(path, 2)").alias("name"))
    wanted = guessed.union(known).distinct()
    found, missing = scan.select_files(docs, wanted, F.lit(""))
    return missing.select("name", F.lit(True).alias("missing")).unionByName(
        found.select(F.expr("substring(path, 2)").alias("name"), F.lit(False).alias("missing"))
    )


@query(
    "content_hash",
    f"with {v.DOCS_SQL} select doc_id, sha256(content) as digest, {_STEM} as stem from docs",
)
def content_hash(spark, folder):
    return v.documents(spark, folder).select(
        "doc_id", tx.content_hash(F.col("content")).alias("digest"), tx.stem_key(F.col("path")).alias("stem")
    )


_FP = f"""
  paged as (select doc_id, unnest(pages) as page, generate_subscripts(pages, 1) as n from docs),
  running as (select *, sum(length(page)) over (partition by doc_id order by n) - length(page) as before from paged where length(page) > 0),
  joined as (select doc_id, string_agg(page, ' ' order by n) as t from running group by doc_id),
  fps as (select doc_id, case when {_squeezed("t")} <> '' then sha256({_squeezed("t")}) end as fingerprint from joined)"""


@query(
    "corpus_index_scan",
    f"""with {v.DOCS_SQL}, {_FP}, pdf as (select d.path, d.content, f.fingerprint, {_STEM.replace("path", "d.path")} as stem, not regexp_matches(d.path, '/(_tmp|quarantine)/') as hashed,
      {_SKIP.replace("path", "d.path")} as listed from docs d left join fps f using (doc_id) where lower(d.path) like '%.pdf')
    select 'hash' as "index", count(*) filter (where hashed) as files, count(distinct sha256(content)) filter (where hashed) as keys from pdf
    union all select 'stem', count(*) filter (where listed), count(distinct stem) filter (where listed) from pdf
    union all select 'text', count(*) filter (where listed), count(distinct fingerprint) filter (where listed) from pdf""",
)
def corpus_index_scan(spark, folder):
    """Files that each index of a corpus reads and the keys it holds."""
    docs = v.documents(spark, folder).where(scan.has_extension(F.col("path"), ["pdf"]))
    entries = dedup.corpus_indexes(docs)
    return entries.groupBy("index").agg(F.sum("files").alias("files"), F.count("key").alias("keys"))


@query(
    "text_fingerprint",
    f"with {v.DOCS_SQL}, {_FP} select docs.doc_id, fingerprint from docs left join fps using (doc_id)",
)
def text_fingerprint(spark, folder):
    return v.documents(spark, folder).select(
        "doc_id", tx.fingerprint(F.col("pages")).alias("fingerprint")
    )


@query(
    "text_cleanup",
    f"""with {v.DOCS_SQL} select doc_id, {_squeezed("content")} as squeezed,
      regexp_replace(trim(content), '[\\\\/:*?"<>|]+', '_', 'g') as file_name,
      coalesce(nullif(right(regexp_replace(path, '[^A-Za-z0-9]', '', 'g'), 8), ''), 'msg') as tag,
      case when length({_squeezed("content")}) > 120 then left({_squeezed("content")}, 117) || '...' else {_squeezed("content")} end as cell
    from docs""",
)
def text_cleanup(spark, folder):
    text, path = F.col("content"), F.col("path")
    return v.documents(spark, folder).select(
        "doc_id",
        tx.squeeze(text).alias("squeezed"),
        tx.sanitize_filename(text).alias("file_name"),
        tx.short_message_tag(path).alias("tag"),
        tx.display_value(text).alias("cell"),
    )


@query(
    "safe_names",
    f"""with {v.DOCS_SQL} select doc_id, left(regexp_replace(content, '[^\\p{{L}}\\p{{N}}_\\-. ()֐-׿]', '_', 'g'), 200) as safe,
      regexp_replace(regexp_replace(substr(path, 2), '[\\\\/:*?"<>|]+', '_', 'g'), '(\\.[^.]*)$', '__' || provider || '\\1') as tagged from docs""",
)
def safe_names(spark, folder):
    return v.documents(spark, folder).select(
        "doc_id",
        tx.safe_filename(F.col("content")).alias("safe"),
        tx.tagged_name(F.expr("substring(path, 2)"), F.col("provider")).alias("tagged"),
    )


_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_MERGED = (
    f"regexp_replace(regexp_replace(regexp_replace(content, '\\A{WS}+|{WS}+\\z', '', 'g'), '{WS}*{_BREAK}{WS}*', chr(10), 'g'), "
    r"'(?m)^(?:(-?\d+)\n\.\n(-?\d+)|(-?\d+)\n(-?\d+)\.|(-?\d+)\.\n(-?\d+))$', '\2\3\6.\1\4\5', 'g')"
)


@query(
    "line_merge",
    f"""with {v.DOCS_SQL}, m as (select doc_id, {_MERGED} as t from docs)
    select doc_id, case when t = '' then 0 else len(string_split(t, chr(10))) end as n_lines, sha256(t) as digest from m""",
)
def line_merge(spark, folder):
    docs = v.documents(spark, folder).select(
        "doc_id", tx.extract_lines(F.col("content")).alias("lines")
    )
    return docs.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.sha2(F.array_join("lines", "\n"), 256).alias("digest"),
    )


_SPLIT_TEXT = "replace(cast(l_extendedprice as decimal(18,2)), '.', chr(10) || '.' || chr(10))"


@query(
    "split_decimal_lines",
    """with parts as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, cast(floor(l_extendedprice) as bigint) as whole,
        cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) % 100 as cents from lineitem)
      select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
        'total|' || case l_linenumber % 3 when 0 then cents || '.' || whole when 1 then whole || '.' || cents else cents || '.' || whole end || '|end' as merged
      from parts""",
)
def split_decimal_lines(spark, folder):
    """Amounts written over several lines, put together again: three spellings."""
    li = v.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"
    )
    whole = F.floor("l_extendedprice").cast("string")
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint") % 100
    kind = F.col("l_linenumber") % 3
    written = (
        F.when(kind == 0, F.concat_ws("\n", whole, F.lit("."), cents))
        .when(kind == 1, F.concat(whole, F.lit("\n"), cents, F.lit(".")))
        .otherwise(F.concat(whole, F.lit(".\n"), cents))
    )
    text = F.concat(F.lit(" total \r\n"), written, F.lit("\n\n end"))
    return li.select("*", F.array_join(tx.extract_lines(text), "|").alias("merged"))


@query(
    "exact_duplicates",
    f"""with {v.DOCS_SQL}, k as (select path, min(path) over (partition by sha256(content)) as kept_path from docs)
    select path, kept_path from k where path <> kept_path""",
)
def exact_duplicates(spark, folder):
    docs = v.documents(spark, folder).select("path", "content")
    return dedup.exact_duplicates(dedup.index_documents(docs, ("digest",)))


@query(
    "distinct_documents",
    f"with {v.DOCS_SQL} select min(path) as path, sha256(content) as digest from docs group by 2",
)
def distinct_documents(spark, folder):
    docs = v.documents(spark, folder)
    return dedup.keep_first(docs.select("path", tx.content_hash(F.col("content")).alias("digest")))


_GREEDY = f"""
  fps_all as (select docs.*, fingerprint from docs left join fps using (doc_id)),
  scanned as (select path, ['d' || sha256(content), 's' || {_STEM}] || case when fingerprint is null then [] else ['t' || fingerprint] end as keys from fps_all where {_SKIP}),
  walked as (select list_reduce(list({{'keys': keys, 'kept': [path]}} order by path),
    lambda acc, x: case when list_has_any(acc.keys, x.keys) then acc else {{'keys': list_concat(acc.keys, x.keys), 'kept': list_concat(acc.kept, x.kept)}} end) as w from scanned),
  kept as (select unnest(w.kept) as path from walked)"""


def scanned_index(spark, folder):
    docs = v.documents(spark, folder)
    return dedup.index_documents(
        docs.where(scan.outside_folders(F.col("path"))).select("path", "content", "pages")
    )


@query(
    "three_key_dedup",
    f"with {v.DOCS_SQL}, {_FP}, {_GREEDY} select path, path in (select path from kept) as kept from scanned",
)
def three_key_dedup(spark, folder):
    return dedup.dedupe_documents(scanned_index(spark, folder))


@query(
    "three_key_dedup_stats",
    f"""with {v.DOCS_SQL}, {_FP}, {_GREEDY} select count(*) as scanned, (select count(*) from kept) as kept, count(*) - (select count(*) from kept) as moved,
      count(*) - (select count(*) from kept) as removed, 0::bigint as errors, 'hash+stem+text' as dedup_by from scanned""",
)
def three_key_dedup_stats(spark, folder):
    index = scanned_index(spark, folder)
    return dedup.dedupe_stats(index, dedup.dedupe_documents(index))


_SOURCES = """
  sources as (select case provider when 'en' then 1 when 'fr' then 2 else 3 end as source_rank, path, sha256(content) as digest from docs where doc_id % 4 <> 0),
  existing as (select path, sha256(content) as digest from docs where doc_id % 4 = 0)"""


def sources_and_corpus(spark, folder):
    """Sources and corpus out of one hashed index."""
    docs = v.documents(spark, folder).select(
        "doc_id",
        F.when(F.col("provider") == "en", 1)
        .when(F.col("provider") == "fr", 2)
        .otherwise(3)
        .alias("source_rank"),
        "path",
        tx.content_hash(F.col("content")).alias("digest"),
    )
    docs = checkpoint(docs)
    old = F.col("doc_id") % 4 == 0
    return docs.where(~old).drop("doc_id"), docs.where(old).select("path", "digest")


@query(
    "consolidation",
    f"""with {v.DOCS_SQL}, {_SOURCES}, r as (select *, row_number() over (partition by digest order by source_rank, path) as rn from sources where digest not in (select digest from existing))
    select digest, source_rank, path from r where rn = 1""",
)
def consolidation(spark, folder):
    sources, corpus = sources_and_corpus(spark, folder)
    return dedup.consolidate(sources, corpus)


@query(
    "consolidation_stats",
    f"""with {v.DOCS_SQL}, {_SOURCES} select count(distinct digest) filter (where digest not in (select digest from existing)) as copied,
      count(*) - count(distinct digest) filter (where digest not in (select digest from existing)) as duplicates,
      count(distinct source_rank) as sources, (select count(distinct digest) from existing) as existing from sources""",
)
def consolidation_stats(spark, folder):
    sources, corpus = sources_and_corpus(spark, folder)
    return dedup.consolidation_stats(sources, corpus)


@query(
    "hash_lookup",
    f"""with {v.DOCS_SQL}, {_SOURCES}, f as (select digest, min(path) as first_path, max(path) as last_path from existing group by 1)
    select path, first_path as duplicate_of, last_path as duplicate_of_last from sources left join f using (digest)""",
)
def hash_lookup(spark, folder):
    sources, corpus = sources_and_corpus(spark, folder)
    first = dedup.lookup_duplicates(sources, corpus, "digest")
    last = dedup.lookup_duplicates(first.withColumnRenamed("duplicate_of", "first"), corpus, "digest", "last")
    return last.select(
        "path", F.col("first").alias("duplicate_of"), F.col("duplicate_of").alias("duplicate_of_last")
    )


@query(
    "text_lookup",
    f"""with {v.DOCS_SQL}, {_FP}, a as (select docs.*, fingerprint from docs left join fps using (doc_id)),
      f as (select fingerprint, min(path) as duplicate_of from a where doc_id % 4 = 0 and fingerprint is not null group by 1)
    select path, duplicate_of from a left join f using (fingerprint) where doc_id % 4 <> 0""",
)
def text_lookup(spark, folder):
    docs = v.documents(spark, folder).select(
        "doc_id", "path", tx.fingerprint(F.col("pages")).alias("fingerprint")
    )
    docs = checkpoint(docs)
    old = F.col("doc_id") % 4 == 0
    return dedup.lookup_duplicates(docs.where(~old), docs.where(old), "fingerprint").select(
        "path", "duplicate_of"
    )


@query(
    "stem_lookup",
    f"""with {v.DOCS_SQL} select path from docs where doc_id % 4 <> 0 and {_STEM} not in (select {_STEM} from docs where doc_id % 4 = 0)""",
)
def stem_lookup(spark, folder):
    docs = v.documents(spark, folder).select(
        "doc_id", "path", tx.stem_key(F.col("path")).alias("stem")
    )
    old = F.col("doc_id") % 4 == 0
    return dedup.skip_known(docs.where(~old), docs.where(old), "stem").select("path")


@query(
    "unique_output_names",
    f"""with {v.DOCS_SQL}, wanted as (select path, provider as directory, documents.source as s from docs join documents using (doc_id)),
      ranked as (select *, row_number() over (partition by directory, s order by md5(path)) as rn from wanted),
      taken as (select 'en' as directory, 'src3' as s)
    select path, s || case when (directory, s) in (select directory, s from taken) then '__' || (rn + 1) when (directory, s) = ('de', 'src7') and rn > 1 then '__' || (2 * rn - 1) when rn = 1 then '' else '__' || rn end || '.pdf' as output_name from ranked""",
)
def unique_output_names(spark, folder):
    docs = v.documents(spark, folder)
    files = docs.select(F.col("provider").alias("directory"), "path", F.col("source").alias("name"))
    taken = (
        docs.where("provider = 'en' and source = 'src3'")
        .select(F.col("provider").alias("directory"), F.concat("source", F.lit(".pdf")).alias("name"))
        .distinct()
    )
    # every second number of another name
    even = F.concat(F.lit("src7__"), (F.col("doc_id") + 1) * 2, F.lit(".pdf"))
    taken = taken.unionByName(docs.select(F.lit("de").alias("directory"), even.alias("name")))
    return dedup.unique_names(files, taken).select("path", "output_name")


# --- keyword statistics -----------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"


def _word(term: str, fold: bool) -> str:
    flag = "(?i)" if fold else ""
    return f"regexp_matches(page, '{flag}(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])')"


def _terms(polarity: str) -> str:
    rows = [(t, f) for t, p, _w, f in rel.term_table(v.TERMS) if p == polarity]
    return (
        "list_filter(["
        + ", ".join(f"case when {_word(t, f)} then '{t}' end" for t, f in rows)
        + "], lambda t: t is not null)"
    )


_WEAK = ", ".join(f"'{t}'" for t in v.TERMS.weak)
_AMOUNT = (
    r"""(regexp_matches(page, '₪|\$|€|ש"ח|שח|ILS|NIS|USD|EUR')
     or regexp_matches(page, '(^|[^\p{L}\p{N}_])\d{1,3}([.,]\d{3})+[.,]\d{2}($|[^\p{L}\p{N}_])')
     or regexp_matches(page, '(^|[^\p{L}\p{N}_])\d+[.,]\d{2}($|[^\p{L}\p{N}_])'))"""
)
_NUMBER = rf"regexp_matches(page, '(?i)מס.?ר{WS}*חשבונית|חשבונית{WS}*מס.?ר|מס.?ר{WS}*קבלה|receipt{WS}*(no|#)|invoice{WS}*(no|#)')"
_STATS_SQL = f"""
  page_rows as (select doc_id, trusted, unnest(pages) as page, generate_subscripts(pages, 1) as n from docs),
  page_hits as (select doc_id, trusted, n, {_terms('pos')} as pos, {_terms('neg')} as neg, {_AMOUNT} as amount, {_NUMBER} as number from page_rows),
  stats as (select doc_id, any_value(trusted) as trusted, flatten(list(pos order by n)) as pos_terms, flatten(list(neg order by n)) as neg_terms,
    bool_or(amount) as amount_hint, bool_or(number) as invoice_id_hint from page_hits group by doc_id),
  counted as (select *, len(pos_terms) as pos_hits, len(neg_terms) as neg_hits,
    len(list_filter(pos_terms, lambda t: t in ({_WEAK}))) as weak_hits from stats)"""
_STATS_OUT = """doc_id, pos_hits, neg_hits, array_to_string(pos_terms, ',') as pos_terms, array_to_string(neg_terms, ',') as neg_terms,
  pos_hits - weak_hits as strong_hits, weak_hits, amount_hint, invoice_id_hint"""


def _stats_columns(df):
    ints = ("pos_hits", "neg_hits", "strong_hits", "weak_hits")
    return df.select(
        "doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ints],
        F.array_join("pos_terms", ",").alias("pos_terms"),
        F.array_join("neg_terms", ",").alias("neg_terms"),
        "amount_hint",
        "invoice_id_hint",
    )


@query("keyword_stats_by_page", f"with {v.DOCS_SQL}, {_STATS_SQL} select {_STATS_OUT} from counted")
def keyword_stats_by_page(spark, folder):
    pages = v.document_pages(spark, folder)
    return _stats_columns(rel.keyword_stats(pages, v.TERMS))


@query("keyword_stats", f"with {v.DOCS_SQL}, {_STATS_SQL} select {_STATS_OUT} from counted")
def keyword_stats(spark, folder):
    docs = v.documents(spark, folder)
    return _stats_columns(
        docs.select("doc_id", rel.document_stats(F.col("pages"), v.TERMS).alias("s")).select(
            "doc_id", "s.*"
        )
    )


_EARLY_SQL = f"""
  page_rows as (select doc_id, unnest(pages) as page, generate_subscripts(pages, 1) as n from docs),
  page_hits as (select doc_id, n, {_terms('pos')} as pos, {_terms('neg')} as neg, {_AMOUNT} as amount, {_NUMBER} as number from page_rows),
  before as (select *, coalesce(sum(len(pos)) over w, 0) as p, coalesce(sum(len(neg)) over w, 0) as q from page_hits
    window w as (partition by doc_id order by n rows between unbounded preceding and 1 preceding)),
  stats as (select doc_id, flatten(list(pos order by n)) as pos_terms, flatten(list(neg order by n)) as neg_terms,
    bool_or(amount) as amount_hint, bool_or(number) as invoice_id_hint from before where p < 3 and q < 1 group by doc_id),
  counted as (select *, len(pos_terms) as pos_hits, len(neg_terms) as neg_hits,
    len(list_filter(pos_terms, lambda t: t in ({_WEAK}))) as weak_hits from stats)"""


@query("keyword_stats_early_stop", f"with {v.DOCS_SQL}, {_EARLY_SQL} select {_STATS_OUT} from counted")
def keyword_stats_early_stop(spark, folder):
    return _stats_columns(rel.keyword_stats(v.document_pages(spark, folder), v.TERMS, stop_early=True))


@query("keyword_stats_early_stop_in_row", f"with {v.DOCS_SQL}, {_EARLY_SQL} select {_STATS_OUT} from counted")
def keyword_stats_early_stop_in_row(spark, folder):
    """The same for documents that carry their pages."""
    docs = v.documents(spark, folder)
    s = rel.document_stats(F.col("pages"), v.TERMS, stop_early=True)
    return _stats_columns(docs.select("doc_id", s.alias("s")).select("doc_id", "s.*"))


@query(
    "document_disposition",
    f"""with {v.DOCS_SQL}, {_STATS_SQL}, verdicts as (select *,
        pos_hits >= 1 and neg_hits = 0 and (pos_hits > weak_hits or amount_hint or invoice_id_hint) as strict,
        len(list_filter(neg_terms, lambda t: t <> 'heron' and not (trusted and t = 'für'))) as serious from counted)
    select doc_id, case when pos_hits + neg_hits > 0 then pos_hits / (pos_hits + neg_hits) else 0.0 end as confidence,
      case when strict then 'keep' else 'quarantine' end as disposition,
      strict or (trusted and pos_hits = 0 and neg_hits = 0) as accepted_trusting,
      serious = 0 and (pos_hits >= 1 or trusted) as accepted_forgiving from verdicts""",
)
def document_disposition(spark, folder):
    # the second provider has fewer negatives
    second = dataclasses.replace(v.TERMS, latin_neg=("from",))
    return rel.assess_documents(v.documents(spark, folder), v.TERMS, second).select(
        "doc_id", "confidence", "disposition", "accepted_trusting", "accepted_forgiving"
    )


@query(
    "whole_word_match",
    f"""with pages_of as (select doc_id, text as page from documents)
    select doc_id, {_word('the', True)} as the_any_case, {_word('The', False)} as the_exact, {_word('für', False)} as fur, {_word('que', True)} as que from pages_of""",
)
def whole_word_match(spark, folder):
    t = F.col("text")
    return v.table(spark, folder, "documents").select(
        "doc_id",
        tx.keyword_in_text(t, "the", True).alias("the_any_case"),
        tx.keyword_in_text(t, "The").alias("the_exact"),
        tx.keyword_in_text(t, "für").alias("fur"),
        tx.keyword_in_text(t, "que", True).alias("que"),
    )


@query(
    "text_hints",
    f"""with p as (select doc_id, text as page, trim(text) as t from documents) select doc_id, {_AMOUNT} as amount_hint, {_NUMBER} as invoice_id_hint,
      length(regexp_replace(page, '\\A{WS}+|{WS}+\\z', '', 'g')) < 200 or len(regexp_extract_all(page, '[א-ת]')) < 15 as needs_fallback from p""",
)
def text_hints(spark, folder):
    t = F.col("text")
    return v.table(spark, folder, "documents").select(
        "doc_id",
        tx.text_has_amount_hint(t).alias("amount_hint"),
        tx.text_has_invoice_id(t).alias("invoice_id_hint"),
        tx.needs_fallback_text(t).alias("needs_fallback"),
    )


def _count(col: str, words) -> str:
    return "(" + " + ".join(f"(case when contains({col}, '{w}') then 1 else 0 end)" for w in words) + ")"


_SCORE = (
    "least(1.0::double, case when "
    + " or ".join(f"contains(t, '{w}')" for w in v.SCORES.strict)
    + f" then 0.5::double else 0.0 end + least(0.3::double, {_count('t', v.SCORES.hebrew)} * 0.03::double) + least(0.2::double, {_count('t', v.SCORES.english)} * 0.02::double))"
)


@query(
    "document_verification",
    f"""with {v.DOCS_SQL}, lead as (select doc_id, strlen(content) as size, lower(array_to_string(pages, chr(10))) as t from docs),
      s as (select doc_id, size, cast(round(cast({_SCORE} as decimal(28,10)), 3) as double) as text_score from lead)
    select doc_id, text_score, size >= 1500 and text_score >= 0.30 as verified,
      case when size < 1500 then 'too_small' when text_score < 0.30 then 'low_text_score' end as reason from s""",
)
def document_verification(spark, folder):
    docs = v.documents(spark, folder).withColumn("content_size", F.octet_length("content"))
    return rel.verify_documents(docs, "light", v.SCORES, 1500).select(
        "doc_id", "text_score", "verified", "reason"
    )


@query(
    "page_hit_acceptance",
    f"""with {v.DOCS_SQL}, h as (select doc_id, unnest(pages) as page from docs)
    select doc_id, cast(sum(case when contains(lower(page), 'the') or contains(lower(page), 'with') then 1 else 0 end + case when contains(page, 'que') or contains(page, 'für') then 1 else 0 end) as bigint) as hits,
      sum(case when contains(lower(page), 'the') or contains(lower(page), 'with') then 1 else 0 end + case when contains(page, 'que') or contains(page, 'für') then 1 else 0 end) >= 1 as accepted
    from h group by doc_id""",
)
def page_hit_acceptance(spark, folder):
    hits = rel.page_hits(F.col("pages"), ("The", "with"), ("que", "für")).cast("bigint")
    return (
        v.documents(spark, folder)
        .select("doc_id", hits.alias("hits"))
        .withColumn("accepted", F.col("hits") >= 1)
    )


@query(
    "marker_labels",
    """with t as (select doc_id, lower(text) as t, text as raw from documents) select doc_id,
      case when contains(t, 'therhe') then 'A' when contains(t, 'eauon') then 'B' when contains(t, 'the ') then 'C' when contains(t, 'que') then 'D' end as label,
      regexp_replace(raw, '(?i)Bearer\\s+\\S+', '[REDACTED_BEARER_TOKEN]', 'g') = raw as clean from t""",
)
def marker_labels(spark, folder):
    markers = (("Therhe", "A"), ("eauon", "B"), ("the ", "C"), ("que", "D"))
    t = F.col("text")
    return v.table(spark, folder, "documents").select(
        "doc_id", tx.vendor_label(t, markers).alias("label"), (tx.redact(t) == t).alias("clean")
    )


@query(
    "redaction",
    f"""with c as (select l_orderkey, l_suppkey, l_linenumber, l_partkey, case l_linenumber % 4 when 0 then 'Authorization: Bearer k' || l_orderkey || ' ok'
        when 1 then 'use bearer t' || l_partkey || ';' when 2 then '/home/u' || l_suppkey || '/token.json end' else 'at /c/.msal_' || l_orderkey || '.bin, done' end as note from lineitem)
    select l_orderkey, l_suppkey, l_linenumber, l_partkey, case l_linenumber % 4 when 0 then '[REDACTED_AUTH_HEADER] ok' when 1 then 'use [REDACTED_BEARER_TOKEN]'
        when 2 then '[REDACTED_CREDENTIAL_PATH] end' else 'at [REDACTED_TOKEN_CACHE_PATH], done' end as note from c""",
)
def redaction(spark, folder):
    li = v.table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    kind = F.col("l_linenumber") % 4
    note = (
        F.when(kind == 0, F.concat(F.lit("Authorization: Bearer k"), "l_orderkey", F.lit(" ok")))
        .when(kind == 1, F.concat(F.lit("use bearer t"), "l_partkey", F.lit(";")))
        .when(kind == 2, F.concat(F.lit("/home/u"), "l_suppkey", F.lit("/token.json end")))
        .otherwise(F.concat(F.lit("at /c/.msal_"), "l_orderkey", F.lit(".bin, done")))
    )
    return li.withColumn("note", tx.redact(note))
