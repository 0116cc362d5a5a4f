"""URL and HTML functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import WS, any_of, contains_any, has, let, lowered, strip

ANCHOR_HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""
AREA_HREF = r"""(?i)<area\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""
TEXT_URL = r"""(?i)https?://[^\t-\r\x1c-\x20\x{85}\p{Z}<>")\]]+"""
BODY_URL = r"""(?i)https?://[^\t-\r\x1c-\x20\x{85}\p{Z}<>"'\]]+"""
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def html_links(html: Column, with_areas: bool = True) -> Column:
    """Distinct link targets in document order, image-map areas after anchors."""
    hrefs = found(html, ANCHOR_HREF)
    if with_areas:
        areas = F.filter(found(html, AREA_HREF), lambda u: u != "")
        hrefs = F.concat(hrefs, areas)
    return F.array_distinct(hrefs)


def text_links(text: Column) -> Column:
    return F.array_distinct(found(text, TEXT_URL, 0))


def body_links(body: Column) -> Column:
    """URLs of an unescaped body without trailing punctuation."""
    urls = found(unescape(body), BODY_URL, 0)
    return F.array_distinct(
        F.transform(urls, lambda u: F.regexp_replace(u, r"""\A[).,\]}>"']+|[).,\]}>"']+\z""", ""))
    )


def unescape(text: Column) -> Column:
    """The named entities of mail and invoice pages, ampersand last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Text of an HTML body: scripts, styles and tags become blanks."""
    body = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>", " ")
    body = F.regexp_replace(body, r"(?is)<style.*?>.*?</style>", " ")
    return unescape(F.regexp_replace(body, r"<[^>]+>", " "))


def host(url: Column) -> Column:
    """Lower-cased host without user and port; '' when there is none."""
    return F.lower(
        F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    )


def domain_of(url: Column) -> Column:
    netloc = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(netloc, r"\Awww\.", ""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)


def query_value(url: Column, key: str) -> Column:
    """First non-empty value of a query parameter, decoded; NULL when absent."""
    raw = F.nullif(F.regexp_extract(query_of(url), rf"(?:\A|&){key}=([^&]*)", 1), F.lit(""))
    return F.try_url_decode(raw)


def normalize_link(url: Column) -> Column:
    """The target of a search-engine redirect, else the URL itself."""
    redirect = host(url).isin("www.google.com", "google.com") & F.startswith(
        path_of(url), F.lit("/url")
    )
    target = F.coalesce(query_value(url, "url"), query_value(url, "q"))
    return F.when(
        redirect & target.isNotNull(), F.coalesce(F.try_url_decode(target), target)
    ).otherwise(url)


def message_links(html: Column, text: Column) -> Column:
    """Distinct http links of a message, HTML part first, redirects unwrapped."""
    urls = F.concat(html_links(html), text_links(text))
    http = F.filter(urls, lambda u: F.startswith(u, F.lit("http")))
    unwrapped = F.transform(http, normalize_link)
    return F.array_distinct(F.filter(unwrapped, lambda u: F.startswith(u, F.lit("http"))))


def normalize_bill_viewer_url(url: Column) -> Column:
    """Undo escaped query separators and repeated slashes before the query."""
    s = strip(F.coalesce(url, F.lit("")))
    for mark in "?&=":
        s = F.replace(s, F.lit("\\" + mark), F.lit(mark))
    return F.regexp_replace(s, r"(://myinvoice\.bezeq\.co\.il)/+(?=\?)", "$1/")


def within_domain(url: Column, domains) -> Column:
    """Plain suffix test on the host, without a dot boundary."""
    h = host(url)
    return any_of([F.endswith(h, F.lit(d)) for d in domains])


def is_trusted_domain(domain: Column, roots) -> Column:
    """Equal to a listed domain or below it."""
    d = F.lower(F.coalesce(domain, F.lit("")))
    return any_of([(d == r) | F.endswith(d, F.lit("." + r)) for r in lowered(roots)])


def is_tracking_domain(domain: Column, rules: R.LinkRules = R.LinkRules()) -> Column:
    return domain.isin(*rules.tracking) | any_of(
        [F.startswith(domain, F.lit(p)) for p in rules.tracking_prefixes]
    )


def link_flags(url: Column, rules: R.LinkRules = R.LinkRules()) -> Column:
    """struct<kept, trusted, word, suffix> evidence of one URL."""
    def evidence(u: Column) -> Column:
        trusted = is_trusted_domain(u["dom"], rules.trusted)
        word = contains_any(u["low"], lowered(rules.keywords)) | contains_any(
            u["path"], lowered(rules.path_patterns)
        )
        suffix = any_of(
            [F.endswith(u["low"], F.lit(s)) | has(u["low"], "?" + s) for s in lowered(rules.suffixes)]
        )
        return F.struct(trusted.alias("trusted"), word.alias("word"), suffix.alias("suffix"))

    def verdict(u: Column) -> Column:
        allowed = F.startswith(u["low"], F.lit("https://")) | (
            F.startswith(u["low"], F.lit("http://"))
            & is_trusted_domain(u["dom"], rules.http_allowed)
        )
        # A tracking link without other evidence has none of the three flags either.
        return let(
            evidence(u),
            lambda e: F.struct(
                (allowed & (e["trusted"] | e["word"] | e["suffix"])).alias("kept"),
                e["trusted"].alias("trusted"),
                e["word"].alias("word"),
                e["suffix"].alias("suffix"),
            ),
        )

    parts = F.struct(
        F.lower(url).alias("low"),
        domain_of(url).alias("dom"),
        F.lower(path_of(url)).alias("path"),
    )
    return let(parts, verdict)


def score_links(urls: Column, rules: R.LinkRules = R.LinkRules()) -> Column:
    """struct<kept array<string>, score double> over the links of a message."""
    flagged = F.transform(
        urls, lambda u: F.struct(u.alias("url"), link_flags(u, rules).alias("f"))
    )

    def outcome(kept: Column) -> Column:
        def any_flag(name: str, weight: float) -> Column:
            return F.when(F.exists(kept, lambda s: s["f"][name]), weight).otherwise(0.0)

        score = any_flag("trusted", 0.4) + any_flag("suffix", 0.25) + any_flag("word", 0.15)
        return F.struct(
            F.array_distinct(F.transform(kept, lambda s: s["url"])).alias("kept"),
            F.least(score, F.lit(0.7)).alias("score"),
        )

    return let(F.filter(flagged, lambda s: s["f"]["kept"]), outcome)


def is_invoice_link(url: Column) -> Column:
    """Link test of the keyword-first model."""
    low, h, path = F.lower(url), F.lower(netloc_of(url)), F.lower(path_of(url))
    return F.startswith(low, F.lit("https://")) & (
        contains_any(h, R.V2_TRUSTED)
        | contains_any(low, R.V2_URL_KEYWORDS)
        | any_of([F.endswith(path, F.lit(s)) for s in R.V2_SUFFIXES])
        | contains_any(path, R.V2_PATH_PATTERNS)
        | contains_any(F.lower(query_of(url)), R.V2_QUERY_WORDS)
    )


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def absolute_url(base: Column, url: Column) -> Column:
    """Resolve absolute, scheme-relative, rooted, query-only and plain relative targets."""
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    root = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"\A([^?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")
    return (
        F.when(url == "", base)
        .when(F.regexp_like(url, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*:")), url)
        .when(F.startswith(url, F.lit("//")), F.concat(scheme, url))
        .when(F.startswith(url, F.lit("/")), F.concat(root, url))
        .when(F.startswith(url, F.lit("?")), F.concat(page, url))
        .when(F.startswith(url, F.lit("#")), F.concat(F.regexp_extract(base, r"\A([^#]*)", 1), url))
        .otherwise(F.concat(root, folder, url))
    )


def pdf_links(html: Column, base: Column) -> Column:
    """Distinct absolute targets of anchors, frames and embeds that end in .pdf."""
    tags = found(html, r"(?i)(<(?:a|iframe|embed)\b[^>]*>)")
    targets = F.transform(
        tags,
        lambda t: F.coalesce(
            F.nullif(F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']([^"']*)["']""", 1), F.lit("")),
            F.regexp_extract(t, r"""(?i)\ssrc\s*=\s*["']([^"']*)["']""", 1),
        ),
    )
    resolved = F.transform(
        F.filter(targets, lambda u: u != ""), lambda u: absolute_url(base, u)
    )
    return F.array_distinct(F.filter(resolved, lambda u: F.endswith(F.lower(u), F.lit(".pdf"))))


ATTRIBUTE_VALUE = r"""(?i)<(?:\w+)\b[^>]*?\s{name}\s*=\s*["']([^"']*)["']"""


def pdf_candidates(html: Column, base: Column) -> Column:
    """array<struct<url, source>> of every PDF mention: five attributes, then raw URLs."""
    parts = []
    for name in ("href", "src", "data", "data-src", "data-href"):
        values = F.filter(
            found(html, ATTRIBUTE_VALUE.format(name=name)), lambda u: has(F.lower(u), ".pdf")
        )
        parts.append(F.transform(values, _candidate(base, name)))
    param = r"""(?i)<param\b[^>]*?\sname\s*=\s*["'](?:src|href)["'][^>]*?\svalue\s*=\s*["']([^"']*)["']"""
    values = F.filter(found(html, param), lambda u: has(F.lower(u), ".pdf"))
    parts.append(F.transform(values, _candidate(base, "param")))
    raw = found(html, r"""(?i)(https?://[^'"\t-\r\x1c-\x20\x{85}\p{Z}>]+\.pdf[^'"\t-\r\x1c-\x20\x{85}\p{Z}>]*)""")
    parts.append(F.transform(raw, _candidate(base, "inline-script")))
    return F.concat(*parts)


def _candidate(base: Column, source: str):
    return lambda u: F.struct(absolute_url(base, u).alias("url"), F.lit(source).alias("source"))


URL_ATTRIBUTES = (
    "href",
    "src",
    "data-url",
    "data-download",
    "data-href",
    "formaction",
    "data-file",
    "data-link",
)


# Fixed value: how an onclick handler names its target.
ONCLICK_TARGET = (
    r"""(?i)(?:window\.open|(?:document\.)?location(?:\.href)?)\s*(?:\(|=)\s*['"]([^'"]+)['"]"""
)


def download_candidates(html: Column, base: Column, phrases) -> Column:
    """array<struct<url, kind>> of places a page offers a download from.

    Tags whose text, title or label has a phrase (8 URL attributes), onclick targets, meta
    refreshes, quoted script URLs with an invoice hint, frames.  Text inside nested tags is
    taken up to the first closing tag of the same element.
    """
    tags = found(html, r"(?is)(<(?:a|button)\b[^>]*>.*?</(?:a|button)>|<input\b[^>]*>)")
    words = lowered(phrases)

    def labelled(t: Column) -> Column:
        label = F.lower(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), f"{WS}+", " "))
        title = F.lower(
            F.concat_ws(
                " ",
                F.regexp_extract(t, r"""(?i)\A<[^>]*?\stitle\s*=\s*["']([^"']*)["']""", 1),
                F.regexp_extract(t, r"""(?i)\A<[^>]*?\saria-label\s*=\s*["']([^"']*)["']""", 1),
            )
        )
        return contains_any(label, words) | contains_any(title, words)

    def attribute(t: Column, name: str) -> Column:
        return F.nullif(
            F.regexp_extract(t, rf"""(?i)\A<[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit("")
        )

    def kinds(column: Column, kind: str) -> Column:
        return F.transform(
            F.filter(column, lambda u: u.isNotNull()),
            lambda u: F.struct(absolute_url(base, u).alias("url"), F.lit(kind).alias("kind")),
        )

    offered = F.flatten(
        F.transform(
            F.filter(tags, labelled), lambda t: F.array(*[attribute(t, a) for a in URL_ATTRIBUTES])
        )
    )
    clicks = F.flatten(
        F.transform(
            tags,
            lambda t: F.regexp_extract_all(
                unescape(F.regexp_extract(t, r"""(?i)\sonclick\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)),
                F.lit(ONCLICK_TARGET),
                F.lit(1),
            ),
        )
    )
    refresh = found(
        html,
        r"""(?i)<meta\b[^>]*?http-equiv\s*=\s*["']refresh["'][^>]*?content\s*=\s*["'][^"']*?url\s*=\s*([^;"']+)""",
    )
    scripts = F.flatten(
        F.transform(
            found(html, r"(?is)<script\b[^>]*>(.*?)</script>"),
            lambda s: F.regexp_extract_all(
                s, F.lit(r"""(?i)['"]((?:https?:)?//[^'"\s<]+|/[^\s'")<>]+)['"]"""), F.lit(1)
            ),
        )
    )
    hinted = F.filter(scripts, lambda u: contains_any(F.lower(u), R.DOWNLOAD_URL_HINTS))
    frames = F.filter(
        found(html, r"""(?i)<iframe\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']"""), lambda u: u != ""
    )
    return F.array_distinct(
        F.concat(
            kinds(offered, "attributes"),
            kinds(clicks, "onclick"),
            kinds(F.transform(refresh, strip), "meta-refresh"),
            kinds(hinted, "script-url"),
            kinds(frames, "iframe"),
        )
    )


def with_query_parameter(url: Column, key: str, value: str) -> Column:
    """Add a query parameter unless it is there already."""
    present = F.regexp_like(query_of(url), F.lit(rf"(?:\A|&){key}=[^&]"))
    fragment = F.regexp_extract(url, r"(#.*)\z", 1)
    body = F.regexp_extract(url, r"\A([^#]*)", 1)
    joint = F.when(F.endswith(body, F.lit("?")), "").when(has(body, "?"), "&").otherwise("?")
    return F.when(present, url).otherwise(
        F.concat(body, joint, F.lit(f"{key}={value}"), fragment)
    )


def decode_data_url(url: Column) -> Column:
    """Bytes of a base64 data URL; NULL when it is not one or is empty."""
    payload = F.regexp_extract(url, r"(?i)\Adata:[^;]+;base64,(.+)", 1)
    return F.when(payload != "", F.nullif(F.try_to_binary(payload, F.lit("base64")), F.lit(b"")))


def decode_body(parts: Column, mime: str) -> Column:
    """Concatenated base64url text parts of one MIME type, a newline after each."""
    wanted = F.filter(
        parts, lambda p: (F.lower(p["mime"]) == mime) & (F.coalesce(p["data"], F.lit("")) != "")
    )
    texts = F.transform(
        wanted,
        lambda p: F.decode(
            F.try_to_binary(F.translate(p["data"], "-_", "+/"), F.lit("base64")), "UTF-8"
        ),
    )
    return F.array_join(
        F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.concat(t, F.lit("\n"))), ""
    )
