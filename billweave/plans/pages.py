"""Link queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links as lk
from . import views as v
from .registry import query

_A = r"regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*[\"'']([^\"'']*)[\"'']', 1)"
# First-seen distinct as SQL.
_LINKS = f"""
  a as (select page_id, url, unnest({_A}) as u, generate_subscripts({_A}, 1) as n from pages),
  d as (select page_id, url, u, min(n) as n from a group by 1, 2, 3)"""
_ABS = """case when u = '' then url when regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') then u when prefix(u, '//') then regexp_extract(url, '^[a-z]+:') || u
  when prefix(u, '/') then regexp_extract(url, '^[a-z]+://[^/?#]*') || u else regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || u end"""


@query(
    "page_links",
    f"with {_LINKS} select page_id, cast(count(*) as bigint) as n_links, string_agg(u, ' ' order by n) as links from d group by 1",
)
def page_links(spark, folder):
    found = v.web_pages(spark, folder).select("page_id", lk.html_links(F.col("html")).alias("l"))
    return found.where(F.size("l") > 0).select(
        "page_id", F.size("l").cast("bigint").alias("n_links"), F.array_join("l", " ").alias("links")
    )


@query(
    "page_absolute_links",
    f"with {_LINKS}, r as (select page_id, {_ABS} as target, n from d) select page_id, target, cast(n - 1 as bigint) as pos from r",
)
def page_absolute_links(spark, folder):
    pages = v.web_pages(spark, folder)
    hrefs = lk.found(F.col("html"), lk.ANCHOR_HREF)
    rows = pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "u"))
    firsts = rows.groupBy("page_id", "url", "u").agg(F.min("pos").cast("bigint").alias("pos"))
    return firsts.select("page_id", lk.absolute_url(F.col("url"), F.col("u")).alias("target"), "pos")


@query(
    "url_parts",
    r"""with p as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') as path from pages)
    select page_id, regexp_replace(host, '^www\.', '') as domain, path, suffix(host, 'example.com') or suffix(host, 'g') as loose, host = 'example.org' or suffix(host, '.example.org') as strict,
      prefix(host, 'm.') or host = 'spam-farm.example.org' as tracking, case when regexp_matches(url, '[?&]ref=') then url when contains(url, '#') then regexp_replace(url, '#', case when contains(url, '?') then '&ref=1#' else '?ref=1#' end)
        when contains(url, '?') then url || '&ref=1' else url || '?ref=1' end as tagged from p""",
)
def url_parts(spark, folder):
    url = F.col("url")
    return v.web_pages(spark, folder).select(
        "page_id",
        lk.domain_of(url).alias("domain"),
        lk.path_of(url).alias("path"),
        lk.within_domain(url, ("example.com", "g")).alias("loose"),
        lk.is_trusted_domain(lk.domain_of(url), ("example.org",)).alias("strict"),
        lk.is_tracking_domain(lk.domain_of(url), v.SCORES.links).alias("tracking"),
        lk.with_query_parameter(url, "ref", "1").alias("tagged"),
    )


@query(
    "unwrapped_links",
    """select page_id, case when page_id % 3 = 2 then url else url end as target, url as direct from pages""",
)
def unwrapped_links(spark, folder):
    """Search redirects around the page address lead back to it."""
    url = F.col("url")
    encoded = F.url_encode(url)
    wrapped = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.google.com/url?sa=t&url="), encoded))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://google.com/url?q="), encoded, F.lit("&x=1")))
        .otherwise(url)
    )
    return v.web_pages(spark, folder).select(
        "page_id", lk.normalize_link(wrapped).alias("target"), lk.normalize_link(url).alias("direct")
    )


@query(
    "message_links",
    f"""with {_LINKS}, h as (select page_id, string_agg(u, ' ' order by n) filter (where prefix(u, 'http')) as links from d group by 1)
    select page_id, coalesce(links || ' ', '') || url as links from pages left join h using (page_id)""",
)
def message_links(spark, folder):
    pages = v.web_pages(spark, folder)
    plain = F.concat(F.lit("see "), "url", F.lit(" or ("), "url", F.lit(") now"))
    return pages.select(
        "page_id", F.array_join(lk.message_links(F.col("html"), plain), " ").alias("links")
    )


_T = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_UNESCAPED = _T
for _e, _c in lk.ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query("page_text", f"select page_id, {_UNESCAPED} as text from pages")
def page_text(spark, folder):
    return v.web_pages(spark, folder).select("page_id", lk.html_text(F.col("html")).alias("text"))


@query(
    "link_score",
    f"""with {_LINKS}, x as (select page_id, {_ABS} as u from d),
      h as (select *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') as dom, lower(coalesce(nullif(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')) as path from x),
      e as (select *, dom = 'example.com' or suffix(dom, '.example.com') as trusted, contains(lower(u), 'the') or contains(lower(u), 'page') or contains(path, '/en') or contains(path, '/fr') as word,
        suffix(lower(u), '.html') or contains(lower(u), '?.html') as suf, prefix(lower(u), 'https://') or (prefix(lower(u), 'http://') and (dom = 'example.org' or suffix(dom, '.example.org'))) as allowed from h)
    select page_id, cast(count(distinct u) filter (where allowed and (trusted or word or suf)) as bigint) as kept,
      least(0.7::double, case when bool_or(allowed and trusted) then 0.4::double else 0.0 end + case when bool_or(allowed and suf) then 0.25::double else 0.0 end + case when bool_or(allowed and word) then 0.15::double else 0.0 end) as score
    from e group by 1""",
)
def link_score(spark, folder):
    pages = v.web_pages(spark, folder)
    urls = F.transform(lk.html_links(F.col("html")), lambda u: lk.absolute_url(F.col("url"), u))
    scored = pages.select("page_id", urls.alias("u")).where(F.size("u") > 0)
    scored = scored.select("page_id", lk.score_links(F.col("u"), v.SCORES.links).alias("s"))
    return scored.select("page_id", F.size("s.kept").cast("bigint").alias("kept"), F.col("s.score").alias("score"))


# The pages carry no documents, so each gets offers built from its own address.
def offering_pages(spark, folder):
    path = lk.path_of(F.col("url"))
    extra = F.concat(
        F.lit('<a href="'), path, F.lit('/a.PDF">x</a><iframe src="//cdn.example.com'), path,
        F.lit('/b.pdf"></iframe><embed src="c.pdf"><object data="'), path,
        F.lit('/d.pdf?x=1"></object><button data-url="/get'), path,
        F.lit('">Download now</button><a onclick="location.href=\'/inv'), path,
        F.lit('\'">go</a><script>var u = "https://files.example.com'), path,
        F.lit('/e.pdf"; load("/receipt'), path,
        F.lit('")</script><meta http-equiv="refresh" content="3; url=/next">'),
    )
    return v.web_pages(spark, folder).select("page_id", "url", F.concat("html", extra).alias("html"))


_PARTS = r"""
  b as (select page_id, url, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') as path, regexp_extract(url, '^[a-z]+://[^/?#]*') as root, regexp_extract(url, '^[a-z]+:') as scheme from pages),
  f as (select *, root || regexp_replace(path, '[^/]*$', '') as folder from b)"""


@query(
    "page_pdf_links",
    f"with {_PARTS} select page_id, root || path || '/a.PDF ' || scheme || '//cdn.example.com' || path || '/b.pdf ' || folder || 'c.pdf' as links from f",
)
def page_pdf_links(spark, folder):
    found = offering_pages(spark, folder)
    return found.select(
        "page_id", F.array_join(lk.pdf_links(F.col("html"), F.col("url")), " ").alias("links")
    )


@query(
    "page_pdf_candidates",
    f"""with {_PARTS} select page_id, unnest([{{'url': root || path || '/a.PDF', 'source': 'href'}}, {{'url': scheme || '//cdn.example.com' || path || '/b.pdf', 'source': 'src'}},
      {{'url': folder || 'c.pdf', 'source': 'src'}}, {{'url': root || path || '/d.pdf?x=1', 'source': 'data'}}, {{'url': 'https://files.example.com' || path || '/e.pdf', 'source': 'inline-script'}}], recursive := true) from f""",
)
def page_pdf_candidates(spark, folder):
    found = offering_pages(spark, folder)
    return found.select("page_id", F.inline(lk.pdf_candidates(F.col("html"), F.col("url"))))


@query(
    "page_download_candidates",
    f"""with {_PARTS} select page_id, unnest([{{'url': root || '/get' || path, 'kind': 'attributes'}}, {{'url': root || '/inv' || path, 'kind': 'onclick'}}, {{'url': root || '/next', 'kind': 'meta-refresh'}},
      {{'url': 'https://files.example.com' || path || '/e.pdf', 'kind': 'script-url'}}, {{'url': root || '/receipt' || path, 'kind': 'script-url'}}, {{'url': scheme || '//cdn.example.com' || path || '/b.pdf', 'kind': 'iframe'}}], recursive := true) from f""",
)
def page_download_candidates(spark, folder):
    found = offering_pages(spark, folder)
    return found.select(
        "page_id",
        F.inline(lk.download_candidates(F.col("html"), F.col("url"), ("download now", "הורד"))),
    )


@query(
    "decoded_bodies",
    """select conv_id, turn, case when turn % 2 = 0 then text || chr(10) else '' end as html, text || chr(10) as plain,
      case when turn % 2 = 0 then sha256(text) end as data_url_hash, role as subject from conversations""",
)
def decoded_bodies(spark, folder):
    """Base64url parts, data URLs and repeated headers round-trip."""
    from ..sources.scan import header_map

    c = v.table(spark, folder, "conversations")
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    part = F.struct(
        F.when(F.col("turn") % 2 == 0, "TEXT/html").otherwise("image/png").alias("mime"),
        F.translate(coded, "+/", "-_").alias("data"),
    )
    plain = F.struct(F.lit("text/plain").alias("mime"), F.translate(coded, "+/", "-_").alias("data"))
    bad = F.struct(F.lit("text/plain").alias("mime"), F.lit("###").alias("data"))
    url = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data:application/pdf;base64,"), coded)).otherwise("data:x")
    headers = F.array(
        F.struct(F.lit("Subject").alias("name"), F.lit("old").alias("value")),
        F.struct(F.lit("SUBJECT").alias("name"), F.col("role").alias("value")),
    )
    parts = F.array(part, plain, bad)
    return c.select(
        "conv_id",
        "turn",
        lk.decode_body(parts, "text/html").alias("html"),
        lk.decode_body(parts, "text/plain").alias("plain"),
        F.sha2(lk.decode_data_url(url), 256).alias("data_url_hash"),
        header_map(headers)["subject"].alias("subject"),
    )


@query(
    "bill_viewer_urls",
    "select page_id, 'https://myinvoice.bezeq.co.il/?' || page_id || '&a=1' as url from pages",
)
def bill_viewer_urls(spark, folder):
    messy = F.concat(F.lit(" https://myinvoice.bezeq.co.il//\\?"), "page_id", F.lit("\\&a\\=1 "))
    return v.web_pages(spark, folder).select(
        "page_id", lk.normalize_bill_viewer_url(messy).alias("url")
    )


@query(
    "button_choice",
    "select page_id, case when page_id % 4 = 3 then null else 'חשבונית לחודש ' || page_id || ' קישור' end as best from pages",
)
def button_choice(spark, folder):
    from ..functions.text import best_button

    good = F.concat(F.lit("  חשבונית לחודש  "), "page_id", F.lit(" קישור"))
    names = F.array(
        F.lit("שאלה: חשבונית לחודש קישור כפתור תמיכה"),
        F.lit("חשבון כללי"),
        F.when(F.col("page_id") % 4 == 3, "קישור לחודש").otherwise(good),
        F.lit("חשבונית קישור"),
    )
    names = F.when(F.col("page_id") % 4 == 3, F.slice(names, 1, 3)).otherwise(names)
    return v.web_pages(spark, folder).select("page_id", best_button(names).alias("best"))
