"""Operators on documents and pages: brute force, round trips, held-out accuracy, edge cases."""

import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from billweave.llm import curriculum, labelled, licenses, overlaps, pages, quality, rans, simhash, toxicity, transducer
from billweave.session import run_dir

LONG = "wordy " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _h string, rank int"


def docs(spark, texts, ids=None, sources=None):
    rows = [
        (ids[i] if ids else i, t, None, sources[i] if sources else "s", 0, "clash", "clash", 7) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


EDGE = ["", None, LONG, "the same text", "the same text", " \t\n", "é 日本 😀", "x" * 5000]


# ---- classifiers -------------------------------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


@pytest.mark.parametrize("operator, column, settings", [
    (quality, "quality", quality.Ftrl(bits=12, epochs=20)),
    (toxicity, "toxic", toxicity.Fm(bits=12, l1=1.0)),
])
def test_classifier_learns_held_out_rows(spark, operator, column, settings):
    rng = np.random.default_rng(3)
    plain = ["ba", "do", "fi", "gu", "ke", "lo"]
    texts = [" ".join(rng.choice(plain, 30)) + (" vile vile" if i % 2 else "") for i in range(400)]
    d = docs(spark, texts)
    marked = labels(spark, [(i, i % 2, i % 2, "") for i in range(400)] + [(None, 1, 1, ""), (5, None, None, "")])
    model = operator.train(d, marked, column, settings)
    rows = operator.with_score(d, model).withColumn("h", labelled.held_out()).where("h").collect()
    assert len(rows) > 40
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in rows)
    assert set(d.columns) <= set(rows[0].asDict())


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifier_edge_cases(spark, operator):
    d = docs(spark, EDGE)
    model = operator.train(d, labels(spark, [(3, 1, 1, ""), (6, 0, 0, "")]))
    scores = [r["score"] for r in operator.with_score(d, model).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] and scores[3] == scores[4]
    none = operator.train(d, labels(spark, []))
    assert {r["score"] for r in operator.with_score(d, none).collect()} == {0.5}
    assert operator.with_score(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("marked", [[], [(3, None, None, "")], [(99, 1, 1, "")]])
def test_stages_keep_all_documents_without_a_usable_label(spark, marked):
    import corpus_pipeline

    folder = run_dir(spark, "labels")
    labels(spark, marked).write.parquet(f"{folder}/labels.parquet")
    d = docs(spark, EDGE)
    assert corpus_pipeline.quality_stage(spark, d, folder).count() == len(EDGE)
    assert corpus_pipeline.toxicity_stage(spark, d, folder).count() == len(EDGE)


def test_factors_learn_an_interaction():
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = []
    for _ in range(6000):
        a, b = rng.random(2) < 0.5
        rows.append((int(a and b), f"x{'alpha' if a else ''} {'alpha' if a else 'q'} {'omega' if b else 'r'}"))
    frame = pd.DataFrame(rows, columns=["y", "text"])
    s = toxicity.Fm(bits=12, l1=0.1, factor_rate=0.2)
    model = toxicity.fit(iter([frame]), s)
    assert np.abs(model.factors).max() > 0.05
    both, one = model.score(pd.Series(["xalpha alpha omega", "xalpha alpha r"]))
    assert both > 0.5 > one


def test_training_sample_is_bounded_and_repeats(spark):
    d = docs(spark, [f"t{i}" for i in range(50)])
    marked = labels(spark, [(i, i % 2, 0, "") for i in range(50)])
    one = [tuple(r) for r in labelled.training_rows(d, marked, "quality", 7, 2).collect()]
    assert len(one) == 14 and one == [tuple(r) for r in labelled.training_rows(d, marked, "quality", 7, 2).collect()]


# ---- rANS files ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 127, 129, rans.STRETCH + 5, rans.BLOCK_IDS * 2 + 1])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 50_256).astype(np.uint32)
    table, blocks = rans.encode(ids)
    assert (rans.decode(table, blocks) == ids).all()
    last = blocks[-1:]
    assert (rans.decode(table, last) == ids[-last[0]["n_ids"] :]).all()  # a block alone


def test_rans_detects_damage():
    table, blocks = rans.encode(np.arange(1000, dtype=np.uint32))
    raw = bytearray(blocks[0]["payload"])
    raw[3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(table, [blocks[0] | {"payload": bytes(raw)}])


def test_rans_file(spark, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT_IDS", 5000)
    texts = EDGE + ["it's we'll x.y z-", "1a2. b3!", "áb ́.", "<|endoftext|> x", "a  b\tc", "日本。 語\n\n x "]
    ids = [30 - i for i in range(len(texts))]
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    file = public.path("byte_bpe_50k.json")
    path = run_dir(spark, "test-ids")
    rans.write(docs(spark, texts, ids), path, rans.byte_bpe(file))
    got = {r["doc_id"]: r for r in rans.read_digests(spark, path).collect()}
    full = {r["doc_id"]: r["ids"] for r in rans.read(spark, path).collect()}
    t, start = tokenizers.Tokenizer.from_file(file), 0
    t.encode_special_tokens = True
    for doc, text in sorted(zip(ids, texts)):
        own = t.encode(text or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(own, "<u4").tobytes())
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(own), crc)
        assert full[doc] == own
        start += len(own)
    empty = run_dir(spark, "test-ids")
    rans.write(docs(spark, []), empty, rans.byte_bpe(file))
    assert rans.read_digests(spark, empty).count() == 0


def test_rans_query_gives_the_ids_of_the_plain_call(spark):
    from billweave.llm import plans

    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    texts = ["one <|endoftext|> two", "a<|endoftext|>", "<|endoftext|>\n<|endoftext|> b", "<|endoftext| >", "plain. text"]
    folder = run_dir(spark, "documents")
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in plans.op2_rans(spark, folder).collect()}
    t, start = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    for doc, text in enumerate(texts):
        own = t.encode(text, add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(own, "<u4").tobytes())
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(own), crc)
        start += len(own)


# ---- mixing ---------------------------------------------------------------------------------


def filled(sizes, weights, total, cap):
    """Water filling by rounds."""
    target, active = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while True:
        left = total - target[~active].sum()
        share = np.where(active, left * weights / weights[active].sum() if active.any() else 0, target)
        over = active & (share > cap * sizes)
        if not over.any():
            return share
        target[over] = (cap * sizes)[over]
        active &= ~over


def test_mix_targets_and_words(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 400)] + EDGE[:2]
    sources = [str(s) for s in rng.choice(["a", "B", "c", "é"], len(texts), p=[0.7, 0.1, 0.1, 0.1])]
    sources[-1] = None
    sources[-2] = None
    d = docs(spark, texts, None, sources)
    knots = [[(0.0, 4.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]]
    mixed = curriculum.mix(d, knots)
    rows = mixed.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {i: len(re.findall(curriculum.WORD, t or "")) for i, t in enumerate(texts)}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in rows)
    names = sorted(set(filter(None, sources)), key=lambda s: [ord(c) for c in s]) + [None]
    sizes = np.array([sum(size[i] for i, s in enumerate(sources) if s == n) for n in names], float)
    want = filled(sizes, np.array([[3, 1, 2][k % 3] for k in range(len(names))], float), 1.5 * sizes.sum(), 2)
    for n, w in zip(names, want):
        own = [r for r in rows if r["source"] == n]
        assert all(abs(r["target"] - w) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - w) <= 1
    again = curriculum.mix(d.orderBy(F.rand(3)), knots).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    ordered = curriculum.in_order(d, mixed).select("use.position", "use.epoch").collect()
    assert [tuple(r) for r in ordered] == sorted(tuple(r) for r in ordered)


def test_inverse_demand_is_the_inverse(spark):
    knots = [(0.0, 1.0), (0.25, 0.0), (0.75, 4.0), (1.0, 4.0)]
    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    for r in shares.select("s", curriculum.inverse_demand(F.col("s"), knots).alias("t")).collect():
        grid = np.linspace(0, r["t"], 20_001)
        w = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        assert abs(np.trapezoid(w, grid) / curriculum.integral(knots) - r["s"]) < 1e-6


def test_mix_of_nothing(spark):
    knots = [[(0.0, 1.0), (1.0, 1.0)]]
    assert curriculum.mix(docs(spark, []), knots).count() == 0
    assert [r["taken"] for r in curriculum.mix(docs(spark, ["", None]), knots).collect()] == [0, 0]


def test_mix_of_repeated_ids(spark):
    rows = curriculum.mix(docs(spark, ["a b", "a b", "c"], [1, 1, None]), [[(0.0, 1.0), (1.0, 1.0)]]).collect()
    assert sorted(r["size"] for r in rows) == [1, 2, 2]
    assert abs(sum(r["taken"] for r in rows) - 7.5) <= 1


# ---- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "One", "One Two", "a b c d É É  \x0b x", "A" * 50])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text, 3) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [1, 3, 5, 7])
def test_variants_find_every_link(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        at = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(12):  # clouds with distances around the radius, one of them large
            fps.add(at ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False)))
    centre = 0x0123456789ABCDEF
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
    value = dict(zip(signed, fps))
    got = [(value[r["a"]], value[r["b"]]) for r in edges]
    all_links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]
    assert plain_classes(fps, got) == plain_classes(fps, all_links)


@pytest.mark.parametrize("size", [12, 200])
def test_wide_fingerprints_link_within_their_bits(spark, size):
    rng = np.random.default_rng(size)
    rows = set()
    for _ in range(2000 // size):  # chains of small steps, and loose rows
        at = int(rng.integers(0, 1 << 62)) << 64 | int(rng.integers(0, 1 << 62))
        for _ in range(size):
            rows.add(at)
            at ^= sum(1 << int(b) for b in rng.choice(128, rng.integers(0, 30), replace=False))
    low = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(r & low), signed(r >> 64)) for r in rows], "fp long, fp1 long")
    node = {r["n"]: (r["fp"] & low) | (r["fp1"] & low) << 64 for r in table.selectExpr("*", "xxhash64(fp, fp1) as n").collect()}
    got = [(node[r["a"]], node[r["b"]]) for r in simhash.links(table, 15, 2, 21).collect()]
    rows = sorted(rows)

    def met(a, b):
        x = a ^ b
        return x.bit_count() <= 21 and any((x >> 16 * k & 0xFFFF).bit_count() <= 1 for k in range(8))

    all_links = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if met(a, b)]
    assert {(a, b) for a, b in all_links if (a ^ b).bit_count() <= 15}
    assert plain_classes(rows, got) == plain_classes(rows, all_links)


def test_wide_simhash_classes(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 5000)}"
    base = [word() for _ in range(400)]
    near = [word() if i % 60 == 7 else w for i, w in enumerate(base)]  # shingles are 0.85 alike
    texts = EDGE + [" ".join(base), " ".join(near), " ".join(word() for _ in range(400))]
    got = [r["component_id"] for r in simhash.classes(docs(spark, texts), 5, 15, lanes=2, within=21).orderBy("doc_id").collect()]
    n = len(EDGE)
    assert got[n:] == [n, n, n + 2] and got[0] == got[1] == got[5] == 0
    assert simhash.classes(docs(spark, []), 5, 15, lanes=2, within=21).count() == 0


def test_simhash_classes(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = EDGE + [base, base.replace("w7 ", "q "), base.upper(), "other words here entirely"]
    got = {r["doc_id"]: r for r in simhash.classes(docs(spark, texts), 3, 3).collect()}
    assert len(got) == len(texts)
    fps = {i: plain_fingerprint(t, 3) for i, t in enumerate(texts)}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = plain_classes(list(fps), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == fps
    assert simhash.classes(docs(spark, []), 3, 3).count() == 0
    assert simhash.classes(docs(spark, ["a", "a"], [4, 4]), 3, 3).count() == 2


# ---- licences -----------------------------------------------------------------------------------


def plain_scan(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(licenses.WORD, text)
    at, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += own
        base |= {label} if own else set()
    found, best = set(), 0.0
    step = licenses.block_step(licenses.TEMPLATES)
    for k in range(0, len(words), step):
        held = set(words[k : k + 2 * step])
        met = []
        for label, template in licenses.TEMPLATES:
            t = set(licenses.template_tokens(template))
            c = len(t & held) / len(t)
            if c >= licenses.THRESHOLD - 1e-9:
                met.append((label, t, c))
        for label, t, c in met:
            if not any(t < other for _, other, _ in met):
                found.add(label)
                best = max(best, c)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), 1.0 if at else best)


WRAPPED = [
    "w " * n + text
    for n in (0, 13, 21, 40)
    for text in (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. x",
        "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n  http://x",
    )
]


def test_wrapped_notices_and_nested_labels(spark):
    rows = licenses.scan(docs(spark, WRAPPED)).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["mit-grant", "bsd", "apache-2.0"] * 4
    assert all(r["score"] >= 0.9 for r in rows)
    nested = licenses.scan(docs(spark, ["Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0"])).orderBy("doc_id").collect()
    assert [r["labels"] for r in nested] == ["cc-by-nc-4.0", "cc-by-4.0"]


def test_license_scan(spark):
    texts = EDGE + [
        "The MIT License\nmit license, MIT-license. Apache\nLicense",
        "Licensed under CC BY-NC 4.0.",
        "x\nThis work is licensed under the GNU General Public License, version 3. y",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met",
        "License Version Apache the under Licensed 2.0",
        "license license", "general public", "mit\x0blicense mit mit license",
        "x " * 60 + "Licensed under\nCC BY 4.0\n" + "y " * 70 + "Licensed under CC BY-NC\n4.0 z",
        "released word " * 30 + " under " * 40 + "the mit license",
    ] + WRAPPED
    rows = licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert tuple(r)[1:8] == plain_scan(t), t
    assert licenses.scan(docs(spark, [])).count() == 0
    assert licenses.scan(docs(spark, ["mit license"] * 2, [1, 1])).count() == 2


# ---- pages --------------------------------------------------------------------------------------


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body class="has-sidebar"><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><aside>More</aside>
    <article><header><h1>A &amp; B</h1></header><p><b>Caf&eacute;  one<br><p title="a>b">two&nbsp;three</p>
    <form>Name <input></form><div class="comments"><p>First!</p></div><p>x</p></article>
    <div class="ad">Buy</div><footer>&copy; 2020</footer></body></html>"""
    assert pages.main_text(page) == "A & B\nCafé one\ntwo three\nx"


def test_page_without_article():
    long = "This is the story of a man who was in the town and had to go to the sea with all of his friends. " * 3
    page = f"<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h2>Title</h2><p>{long}</p><p>Short line here.</p><p>{long}</p><p>Copyright © x</p><div>qzx vbn klm wrt plk</div>"
    assert pages.main_text(page) == f"Title\n{long.strip()}\nShort line here.\n{long.strip()}"


RUSSIAN = "Сегодня утром жители города вышли на берег реки, чтобы увидеть первый ледоход этой весны. " * 3


@pytest.mark.parametrize("page, text", [
    (f"<nav><a href=1>Меню</a></nav><p>{RUSSIAN}</p><p>{RUSSIAN}</p><footer>Контакты</footer>", f"{RUSSIAN.strip()}\n{RUSSIAN.strip()}"),
    ("<nav>菜单</nav><p>" + "今天早上城里的居民来到河边观看今年春天的第一次流冰" * 2 + "</p><footer>x</footer>", "今天早上城里的居民来到河边观看今年春天的第一次流冰" * 2),
    (f"<div class='no-sidebar'><p>{RUSSIAN}</p></div><div class='sidebar'><p>{RUSSIAN * 3}</p></div>", RUSSIAN.strip()),
    ("<div class='no-sidebar'><main class='has-sidebar'><p>Text of it</p></main></div><div class=ad>Buy</div>", "Text of it"),
    ("<main class='has-sidebar'><p>Short text.</p><div class='comments'><article><p>First one here!</p></article></div></main>", "Short text."),
])
def test_pages_keep_whole_articles(page, text):
    assert pages.main_text(page) == text


def test_short_paragraph_with_a_link_follows_its_neighbours():
    long = "This is the story of a man who was in the town and had to go to the sea with all of his friends. " * 3
    page = f"<p>{long}</p><p>As was said <a href=1>before</a>, he went.</p><p>{long}</p>"
    assert pages.main_text(page) == f"{long.strip()}\nAs was said before, he went.\n{long.strip()}"


GIVEN = "A story that is long enough to be content on its own, told in plain words, as it was told to us. " * 2


@pytest.mark.parametrize("page, text", [
    # mostly links, but between or beside paragraphs of the article
    (f"<article><p>{GIVEN}</p><p>See <a href=1>the long report of the year</a></p><p>{GIVEN}</p></article>", f"{GIVEN.strip()}\nSee the long report of the year\n{GIVEN.strip()}"),
    (f"<article><p>{GIVEN}</p><p><a href=1>The whole report</a></p></article>", f"{GIVEN.strip()}\nThe whole report"),
    # a list of links at the end of the article
    (f"<article><p>{GIVEN}</p><ul>" + "<li><a href=1>Another</a></li>" * 4 + "</ul></article>", GIVEN.strip()),
    # nothing but short blocks
    ("<p>Short text.</p>", "Short text."),
    ("plain text without tags", "plain text without tags"),
    ("<nav><a href=1>Menu</a></nav><p>One line.</p><p>Two lines.</p>", "One line.\nTwo lines."),
    # what is not shown, and who owns it
    (f"<p>{GIVEN}</p><p style='display: none'>{GIVEN}</p><div style='visibility:hidden'><p>No</p></div><p>Copyright 2020 Foo</p>", GIVEN.strip()),
])
def test_pages_decide_links_and_short_blocks(page, text):
    assert pages.main_text(page) == text


def plain_passes(blocks):
    """The two passes for pages without an article, written out block by block."""
    labels = []
    for b in blocks:
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        stop = sum(w in " ".join(pages.STOP_WORDS.values()).split() for w in words) / max(1, len(words))
        if b.boiler or b.linked / len(b.text) > 0.33:
            labels.append("bad")
        elif len(b.text) < 70:
            labels.append("open")
        else:
            labels.append("good" if stop >= 0.3 and len(b.text) > 200 else "leaning")
    if "good" not in labels:
        best = [k for k, x in enumerate(labels) if x == "leaning" and len(blocks[k].text) > 200]
        best = best or [k for k, x in enumerate(labels) if x == "leaning"] or [k for k, x in enumerate(labels) if x == "open"]
        labels = ["good" if k in best else x for k, x in enumerate(labels)]
    out = []
    for k, x in enumerate(labels):
        if x in ("good", "bad"):
            out.append(x)
            continue
        near = sorted((abs(k - j), j > k, y) for j, y in enumerate(labels) if y in ("good", "bad"))
        if not near:
            out.append("good" if x == "leaning" else "bad")
        elif len(near) > 1 and near[0][0] == near[1][0] and near[0][2] != near[1][2]:
            out.append(near[1][2] if x == "leaning" or blocks[k].heading else "bad")
        else:
            out.append(near[0][2])
    return [b.text for b, x in zip(blocks, out) if x == "good"]


def test_two_passes_equal_a_plain_second_version_on_given_pages(spark):
    """The given pages with their article marks taken away."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    given = [r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    bare = [re.sub(r"</?(?:article|main)\b[^>]*>", "", p or "") for p in given]
    changed = 0
    for page in bare:
        text = pages.main_text(page)
        assert text == "\n".join(plain_passes(pages.blocks_of(page)))
        changed += text != pages.main_text(page, pages.Rules(stop_high=2.0))
    assert changed


def test_pages_edge_cases(spark):
    rows = [(1, None), (1, ""), (2, "<p>"), (3, "<!-- open"), (4, "<article>" + "deep <div>" * 3000), (5, "a < b & c")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = [r["t"] for r in df.select("page_id", pages.extract(F.col("html")).alias("t")).collect()]
    assert len(got) == 6 and all(isinstance(t, str) for t in got) and got[0] == got[1] == ""
    assert df.limit(0).select(pages.extract(F.col("html"))).count() == 0


# ---- transducer ---------------------------------------------------------------------------------


def test_unigram_paths_are_least(spark):
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "bb"]
    scores = [0, -2.0, -2.1, -2.3, -2.9, -3.0, -2.8, -3.3, -4.1, -4.4]
    t = transducer.Transducer(transducer.Spec(pieces, scores, 0, None, {0}, False))

    def least(word):
        best = [(0.0, [])] + [None] * len(word)
        for j in range(1, len(word) + 1):
            options = [
                (best[i][0] - scores[pieces.index(word[i:j])], best[i][1] + [pieces.index(word[i:j])])
                for i in range(j)
                if word[i:j] in pieces and best[i]
            ]
            best[j] = min(options, default=None)
        return best[-1]

    rng = np.random.default_rng(2)
    words = sorted({"▁" + "".join(rng.choice(["a", "b"], rng.integers(1, 12))) for _ in range(100)})
    for word, ids in zip(words, t.shortest(words)):
        assert abs(-sum(scores[i] for i in ids) - least(word)[0]) < 1e-9
        assert "".join(pieces[i] for i in ids) == word


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    return transducer.Transducer(transducer.read_spec(public.path("piece_bpe_32k.model")))


def test_bpe_ids_are_those_of_the_library(model):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    letters = list("abcdefghinorst .,\n-éüTS12▁")
    texts = ["", " ", " " * 41, " " * 33 + "x", "  a   b \n c", "a ", "\n\n", "日本語 😀", "<s> <unk> <0x41>", "x" * 400]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, model.encode(texts, {})):
        assert ids.tolist() == library.encode(text), text
        assert model.decode(ids) == text.replace("▁", " ")


def test_token_columns(spark, model):
    column = transducer.token_columns(spark, F.col("text"), model, tuple(transducer.OUTPUTS))
    rows = docs(spark, EDGE).select("doc_id", column.alias("t")).orderBy("doc_id").collect()
    for r, text in zip(rows, EDGE, strict=True):
        assert r["t"]["decoded"] == (text or "") and r["t"]["round_trip"]
        assert r["t"]["n_tokens"] == len(r["t"]["ids"])
        assert r["t"]["ids_crc32"] == zlib.crc32(np.array(r["t"]["ids"], "<u4").tobytes())
    assert docs(spark, []).select(column.alias("t")).count() == 0


# ---- near duplicates by shingle sets -----------------------------------------------------


def plain_similarity(a, b, k=5):
    def held(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    a, b = held(a), held(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_overlap_classes_are_those_of_exact_similarity(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 5000)}"
    texts = list(EDGE)
    for _ in range(12):  # pairs from far above to just below the similarity
        base = [word() for _ in range(200)]
        texts += [" ".join(word() if i % gap == 7 else w for i, w in enumerate(base)) for gap in (999, 66, 52, 40, 33)]
    base = [word() for _ in range(120)]
    for _ in range(40):  # a long run whose members are like the base or a neighbour only
        at = int(rng.integers(0, 110))
        base[at] = word()
        texts.append(" ".join(base))
    got = {r["doc_id"]: r["component_id"] for r in overlaps.classes(docs(spark, texts), 5, 0.8).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    near = [p for p in pairs if plain_similarity(*(texts[i] for i in p)) >= 0.8]
    assert got == plain_classes(range(len(texts)), near)
    assert overlaps.classes(docs(spark, []), 5, 0.8).count() == 0
    assert overlaps.classes(docs(spark, ["a", "a", "b"], [4, 4, 4]), 5, 0.8).count() == 3


def test_walk_gives_the_classes_of_all_pairs():
    rng = np.random.default_rng(2)
    held = [np.unique(rng.integers(0, 12, 10)) for _ in range(60)]
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
    near = [(a, b) for a in range(60) for b in range(a + 1, 60) if like(held[a], held[b])]
    assert plain_classes(range(60), overlaps.walk(held, 0.8)) == plain_classes(range(60), near)


def test_further_candidates_are_checked_by_similarity(spark):
    base = [f"w{i}" for i in range(200)]
    change = lambda n: " ".join(["x" * (i + 1) if i % 9 == 4 and i < 9 * n else w for i, w in enumerate(base)])
    texts = {k: overlaps.shingle_set(t, 5) for k, t in enumerate([change(0), change(2), change(9), change(22)])}
    names = {k: overlaps.node_of(s) for k, s in texts.items()}
    nodes = spark.createDataFrame([(names[k], s.view(np.int64).tolist()) for k, s in texts.items()], "node string, held array<long>")
    bare = nodes.select("node", F.array().cast("array<long>").alias("keys"))  # bands that find nothing
    held = lambda wanted: nodes.join(wanted, "node")
    keyed = lambda pairs: spark.createDataFrame([(k, names[n]) for k, n in pairs], "key long, node string")
    assert overlaps.links(bare, held, 0.8).count() == 0
    found = overlaps.links(bare, held, 0.8, keyed([(1, k) for k in texts])).collect()
    assert {frozenset(r) for r in found} == {frozenset((names[0], names[1]))}
    assert overlaps.links(bare, held, 0.8, keyed([(k, k) for k in texts])).count() == 0


def test_pipeline_takes_candidates_from_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    seen, given = [], []
    prints, near = simhash.classes, overlaps.classes

    def recorded(*a, **k):
        seen.append((a[1:], prints(*a, **k)))
        return seen[-1][1]

    def checked(*a, also=None, **k):
        given.append(also)
        return near(*a, also=also, **k)

    monkeypatch.setattr(corpus_pipeline.simhash, "classes", recorded)
    monkeypatch.setattr(corpus_pipeline.overlaps, "classes", checked)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base, "end"]), "", None, "something else altogether", "", "a b"]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 4, 6]
    assert [a for a, _ in seen] == [(3, 3)] and len(given) == 1
    keys = {r["doc"]["doc_id"]: r["key"] for r in given[0].collect()}
    roots = {r["doc"]["doc_id"]: r["component_id"] for r in seen[0][1].collect()}
    assert len(keys) == 7 and all((keys[a] == keys[b]) == (roots[a] == roots[b]) for a in keys for b in keys)


def test_pipeline_keeps_a_document_of_lower_similarity(spark):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(0, 5000)}"
    texts = []
    for _ in range(30):  # similarities of 0.72: some within 21 of 128 bits
        base = [word() for _ in range(400)]
        texts += [" ".join(base), " ".join(word() if i % 30 == 7 else w for i, w in enumerate(base))]
    assert all(plain_similarity(*texts[i : i + 2]) < 0.8 for i in range(0, 60, 2))
    assert corpus_pipeline.near_duplicate_stage(spark, docs(spark, texts), "").count() == 60


# ---- stages ------------------------------------------------------------------------------

CLASHING = "_id long, _n int, _size long, _words int, _epoch int, _position double, _score double, score double, key string, copies int, use string, h string, Use_ string, doc_id long, text string, source string, lang string"


def clashing(spark, rows):
    """rows (id, text, source) under columns with the names that stages might use inside."""
    full = [(9, 8, 7, 6, 5, 0.4, 0.3, 0.2, "k", 1, "u", "h", "U", i, t, s, "en") for i, t, s in rows]
    return spark.createDataFrame(full, CLASHING)


def test_stages_take_any_column_names(spark):
    import corpus_pipeline

    folder = run_dir(spark, "labels")
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["ba", "do", "fi"], 40)) + (" vile" * 9 if i % 2 else ""), f"s{i % 3}") for i in range(60)]
    labels(spark, [(i, i % 2, i % 2, "") for i in range(60)]).write.parquet(f"{folder}/labels.parquet")
    d = clashing(spark, rows)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, d, folder)
        assert out.columns == d.columns
        kept = out.collect()
        assert kept and all(tuple(r)[:13] == (9, 8, 7, 6, 5, 0.4, 0.3, 0.2, "k", 1, "u", "h", "U") for r in kept)
        assert {(r["doc_id"], r["text"]) for r in kept} <= {r[:2] for r in rows}
        assert stage(spark, clashing(spark, []), folder).count() == 0


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark):
    import corpus_pipeline

    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "s"), (1, other, "s"), (1, one, "s"), (2, one, "t"), (2, other + " more", "t"), (None, one, "s"), (3, None, "s"), (4, "", "s")]
    kept = corpus_pipeline.near_duplicate_stage(spark, clashing(spark, rows), "").collect()
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept)
    assert got == [(0, one), (1, one), (1, other), (3, "")]


def test_training_rows_are_bounded_with_repeated_ids(spark):
    d = docs(spark, ["same id " + str(i) for i in range(500)] + ["x", "y"], [7] * 500 + [8, 8])
    marked = labels(spark, [(7, 1, 0, ""), (8, 0, 0, ""), (7, 1, 0, "")])
    rows = [tuple(r) for r in labelled.training_rows(d, marked, "quality", 10, 2).collect()]
    held = {i for i in (7, 8) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(rows) == 2 * (2 - len(held)) and len(set(rows)) == 2 - len(held)


@pytest.mark.parametrize("column, operator", [("quality", quality), ("toxic", toxicity)])
def test_models_equal_plain_loops(column, operator):
    """The array code against updates written out weight by weight."""
    import math

    import pandas as pd

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["ba", "do", "vile", "group", "fi"], 12)) for _ in range(60)]
    y = [int("vile" in t) for t in texts]
    frame = pd.DataFrame({"y": y, "text": texts})
    if operator is quality:
        s = quality.Ftrl(bits=8, epochs=1)
        model = quality.fit(iter([frame]), s)
        size = 1 << s.bits
        z, n = [0.0] * (size + 1), [0.0] * (size + 1)

        def weight(i):
            l1 = 0.0 if i == size else s.l1
            if abs(z[i]) <= l1:
                return 0.0
            return (math.copysign(l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

        for text, label in zip(texts, y):
            _, buckets, values = quality.features([text.encode()], s.bits)
            x = dict(zip(buckets.tolist(), values.tolist())) | {size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                grown = n[i] + g * g
                z[i] += g - (math.sqrt(grown) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] = grown
        expected = [weight(i) for i in range(size + 1)]
        assert np.allclose(np.append(model.weights, model.bias), expected, atol=1e-9)
    else:
        s = toxicity.Fm(bits=8, l1=0.05, sightings=2, factor_rate=0.2)
        model = toxicity.fit(iter([frame]), s)
        size, k = 1 << s.bits, s.factors
        z, n, seen = [0.0] * size, [0.0] * size, [0] * size
        v = np.random.default_rng(7).normal(0, 0.01, (size, k)).tolist()
        squares = [[1.0] * k for _ in range(size)]
        bias, bias_n = 0.0, 1.0

        def weight(i):
            if abs(z[i]) <= s.l1:
                return 0.0
            return (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

        def pairs(terms, factors):
            return sum(sum(a * b for a, b in zip(factors[i], factors[j])) for x, i in enumerate(terms) for j in terms[x + 1 :])

        for text, label in zip(texts, y):
            terms = toxicity.features([text.encode()], s.bits)[1].tolist()
            w = {i: weight(i) for i in terms}
            for i in terms:
                seen[i] += 1
            paired = [i for i in terms if w[i] != 0 and seen[i] >= s.sightings]
            total = bias + sum(w.values()) + pairs(paired, v)
            g = 1 / (1 + math.exp(-max(-35, min(35, total)))) - label
            for i in terms:
                grown = n[i] + g * g
                z[i] += g - (math.sqrt(grown) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] = grown
            if len(paired) > 1:
                sums = [sum(v[i][f] for i in paired) for f in range(k)]
                for i in paired:
                    for f in range(k):
                        step = g * (sums[f] - v[i][f]) + s.factor_l2 * v[i][f]
                        squares[i][f] += step * step
                        v[i][f] -= s.factor_rate * step / math.sqrt(squares[i][f])
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(bias_n)
        w = [weight(i) for i in range(size)]
        v = [v[i] if w[i] and seen[i] >= s.sightings else [0.0] * k for i in range(size)]
        assert np.abs(model.factors).max() > 0.01
        assert np.allclose(model.weights, w, atol=1e-9) and np.allclose(model.factors, v, atol=1e-9)
        assert abs(model.bias - bias) < 1e-9
        for text, score in zip(texts, model.score(pd.Series(texts))):
            terms = [i for i in toxicity.features([text.encode()], s.bits)[1].tolist() if w[i]]
            total = bias + sum(w[i] for i in terms) + pairs(terms, v)
            assert abs(score - 1 / (1 + math.exp(-max(-35, min(35, total))))) < 1e-9


def test_shingle_sets_are_made_once_for_each_text(spark):
    texts = [" ".join(f"w{i}" for i in range(k)) for k in range(1300)]
    node = overlaps.node_of(overlaps.shingle_set(texts[700], 5))
    got = docs(spark, texts).select("doc_id", overlaps.sets(F.col("text"), 5).alias("s")).where(F.col("s.node") == node)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["doc_id"], len(r["s"]["held"])) for r in got.collect()] == [(700, 696)]


def test_stages_send_few_rows_at_a_time_to_python(spark):
    import corpus_pipeline

    folder, key = run_dir(spark, "labels"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    labels(spark, [(i, i % 2, i % 2, "") for i in range(9)]).write.parquet(f"{folder}/labels.parquet")
    few = docs(spark, [f"w{i} text" for i in range(9)])
    sent = F.pandas_udf(lambda ids: ids * 0 + len(ids), "long")
    held = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "mixing":  # hands no text to Python
                continue
            for before, most in ((10_000, corpus_pipeline.BATCH), (0, corpus_pipeline.BATCH), (100, 100)):
                spark.conf.set(key, str(before))
                stage(spark, few, folder)
                assert spark.range(5000, numPartitions=1).select(sent("id").alias("n")).agg(F.max("n")).head()[0] == most
    finally:
        spark.conf.set(key, held)
