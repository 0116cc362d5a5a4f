"""Set-based de-duplication and collection against reading one document at a time."""

import random

import pytest
from pyspark.sql import functions as F

from billweave.operators import collect, control, dedup


def sequential(rows, n_keys):
    seen, kept = set(), []
    for path, *keys in sorted(rows):
        marks = {(i, k) for i, k in enumerate(keys[:n_keys]) if k is not None}
        if marks & seen:
            continue
        seen |= marks
        kept.append(path)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_keep(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        # a third of all rows share one stem, and one digest is very common
        stem = "hot" if rnd.random() < 0.33 else f"s{rnd.randint(0, 120)}"
        digest = "same" if rnd.random() < 0.3 else f"d{rnd.randint(0, 200)}"
        text = None if rnd.random() < 0.2 else f"t{rnd.randint(0, 200)}"
        rows.append((f"p{i:04d}", digest, stem, text))
    rnd.shuffle(rows)
    index = spark.createDataFrame(rows, "path string, digest string, stem string, fingerprint string")
    got = sorted(r["path"] for r in dedup.greedy_keep(index).collect())
    assert got == sequential(rows, 3)
    verdicts = dedup.dedupe_documents(index)
    assert verdicts.count() == 400 and verdicts.where("kept").count() == len(got)
    stats = dedup.dedupe_stats(index, verdicts).collect()[0]
    assert (stats["scanned"], stats["kept"], stats["moved"]) == (400, len(got), 400 - len(got))


def test_duplicates_do_not_register_keys(spark):
    rows = [("a", "h1", "s1", None), ("b", "h1", "s2", None), ("c", "h2", "s2", None)]
    index = spark.createDataFrame(rows, "path string, digest string, stem string, fingerprint string")
    assert sorted(r[0] for r in dedup.greedy_keep(index).collect()) == ["a", "c"]


def test_rows_without_keys_are_kept(spark):
    rows = [("a", None), ("b", "k"), ("c", "k")]
    df = spark.createDataFrame(rows, "path string, k string")
    kept = sorted(r[0] for r in dedup.greedy_keep(df, ("k",)).collect())
    assert kept == ["a", "b"]


def test_join_hot_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, key string")
    firsts = dedup.first_of_group(df, "key", "id", "first")
    got = dedup.join_hot(df, firsts, "key")
    assert got.count() == 3000
    want = {}
    for i, k in rows:
        want.setdefault(k, i)
    assert {(r["key"], r["first"]) for r in got.select("key", "first").distinct().collect()} == set(want.items())
    left = dedup.join_hot(df, firsts.where("key = 'hot'"), "key", "left")
    assert left.count() == 3000 and left.where("first is not null").count() == 1000


def test_consolidation_is_idempotent(spark):
    rows = [(1, "g/a.pdf", "same"), (2, "o/b.pdf", "same"), (2, "o/c.pdf", "new")]
    sources = spark.createDataFrame(rows, "source_rank int, path string, digest string")
    none = spark.createDataFrame([], "digest string")
    copied = dedup.consolidate(sources, none)
    assert {(r["digest"], r["path"]) for r in copied.collect()} == {("same", "g/a.pdf"), ("new", "o/c.pdf")}
    assert tuple(dedup.consolidation_stats(sources, none).collect()[0]) == (2, 1, 2, 0)
    again = copied.select("digest")
    assert dedup.consolidate(sources, again).isEmpty()
    assert tuple(dedup.consolidation_stats(sources, again).collect()[0]) == (0, 3, 2, 2)


def test_unique_names(spark):
    rows = [("d", f"p{i}", "in:v.pdf") for i in range(6)] + [("d", "q", "other")]
    files = spark.createDataFrame(rows, "directory string, path string, name string")
    taken = spark.createDataFrame([("d", "in_v__2.pdf"), ("d", "in_v__4.pdf")], "directory string, name string")
    names = [r["output_name"] for r in dedup.unique_names(files, taken).collect()]
    assert sorted(names) == ["in_v.pdf", "in_v__3.pdf", "in_v__5.pdf", "in_v__6.pdf", "in_v__7.pdf", "in_v__8.pdf", "other.pdf"]
    tagged = dedup.unique_names(files.withColumn("tag", F.lit("t")), tag="tag")
    assert "in_v__t.pdf" in [r["output_name"] for r in tagged.collect()]


def collect_one_by_one(attachments, links):
    digests, texts, stems, out, done = set(), set(), set(), {}, set()
    for ord_, msg, path, digest, text, verified in sorted(attachments):
        if digest is None:
            out[path] = "attachment_empty"
        elif digest in digests:
            out[path] = "duplicate_hash"
        elif text is not None and text in texts:
            out[path] = "duplicate_text"
        elif not verified:
            out[path] = "verify_failed"
        else:
            out[path] = None
            digests.add(digest)
            texts.add(text)
            done.add(msg)
    for ord_, msg, path, digest, text, stem, verified in sorted(links):
        if msg in done and path not in out:
            if any(a[1] == msg and out[a[2]] is None for a in attachments):
                continue
            out[path] = "not_tried"
        elif digest in digests:
            out[path] = "duplicate_hash"
        elif text is not None and text in texts:
            out[path] = "duplicate_text"
        elif not verified:
            out[path] = "verify_failed"
        elif stem in stems:
            out[path] = "duplicate_stem"
        else:
            out[path] = None
            digests.add(digest)
            texts.add(text)
            stems.add(stem)
            done.add(msg)
    return out


def test_collection(spark):
    rnd = random.Random(3)
    attachments, links = [], []
    for i in range(120):
        digest = None if i % 17 == 0 else f"d{rnd.randint(0, 60)}"
        text = rnd.choice([None, f"t{rnd.randint(0, 60)}"])
        attachments.append((f"{i:05d}", f"m{i // 3}", f"a{i}", digest, text, rnd.random() < 0.6))
    for i in range(160):
        text = rnd.choice([None, f"t{rnd.randint(0, 90)}"])
        links.append(
            (f"{i:05d}", f"m{i // 3}", f"l{i}", f"d{rnd.randint(0, 120)}", text, f"s{rnd.randint(0, 25)}", rnd.random() < 0.6)
        )
    a = spark.createDataFrame(attachments, "ord string, message_id string, path string, digest string, fingerprint string, verified boolean")
    b = spark.createDataFrame(links, "ord string, message_id string, path string, digest string, fingerprint string, stem string, verified boolean")
    first = collect.collect_attachments(a)
    second = collect.collect_links(b, first)
    got = {r["path"]: r["reason"] for r in first.collect() + second.collect()}
    assert got == collect_one_by_one(attachments, links)
    saved = {r["path"] for r in first.collect() + second.collect() if r["decision"] == "saved"}
    assert saved == {p for p, reason in got.items() if reason is None}
    reasons = collect.unsaved_messages(a.select("message_id").union(b.select("message_id")).distinct(), first, second)
    unsaved = {r["message_id"] for r in reasons.collect()}
    owners = {r[2]: r[1] for r in attachments} | {r[2]: r[1] for r in links}
    assert unsaved == {r[1] for r in attachments + links} - {owners[p] for p in saved}


def test_processed_ids(spark):
    saved = spark.createDataFrame([("saved-1",)], "message_id string")
    rejected = spark.createDataFrame([("rej-1", "links_no_pdf"), ("rej-2", "body_fetch_fail:timeout")], "message_id string, reason string")
    report = spark.createDataFrame([("rep-1", None), ("rep-2", "attach_download_fail:boom")], "message_id string, reject string")
    got = {r[0] for r in collect.processed_ids(saved, rejected, report).collect()}
    assert got == {"saved-1", "rej-1", "rep-1"}


def test_retry_chains(spark):
    rows = [("a", ""), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", None), ("y", "x"), ("z", "x")]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in control.retry_origin(spark.createDataFrame(rows, "id string, retry_of string")).collect()}
    assert got["e"] == ("a", 4) and got["c"] == ("a", 2) and got["z"] == ("x", 1) and got["a"] == ("a", 0)


def test_updates(spark):
    now = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b")], "tenant_id string, id string, status string")
    new = spark.createDataFrame([("t", "2", "B"), ("u", "1", "C")], "tenant_id string, id string, status string")
    assert {tuple(r) for r in control.apply_updates(now, new).collect()} == {("t", "1", "a"), ("t", "2", "B")}
    assert [tuple(r) for r in control.not_found(now, new).collect()] == [("u", "1")]


def walk_one_by_one(attachments, links, corpus):
    """The mailbox message by message: attachments in order, then links until one is saved."""
    digests, texts, stems = ({row[i] for row in corpus} for i in (1, 2, 3))
    out = {}

    def look(kind, path, digest, text, stem, verified):
        if digest is None:
            return "attachment_empty"
        if digest in digests:
            return "duplicate_hash"
        if text is not None and text in texts:
            return "duplicate_text"
        if not verified:
            return "verify_failed"
        if kind == "link" and stem in stems:
            return "duplicate_stem"
        digests.add(digest)
        texts.add(text)
        if kind == "link":
            stems.add(stem)
        return None

    for message in sorted({r[0] for r in attachments + links}):
        saved = False
        for _, _, _, path, digest, text, verified in sorted(r for r in attachments if r[0] == message):
            out[path] = look("attachment", path, digest, text, None, verified)
            saved |= out[path] is None
        if not saved:
            for _, _, _, path, digest, text, stem, verified in sorted(r for r in links if r[0] == message):
                out[path] = "not_tried" if saved else look("link", path, digest, text, stem, verified)
                saved |= out[path] is None
    return out


def test_walk_of_the_mailbox(spark):
    rnd = random.Random(9)
    attachments, links = [], []
    for i in range(260):
        # a third of all rows share one content; links and attachments share contents
        digest = None if i % 19 == 0 else "hot" if rnd.random() < 0.33 else f"d{rnd.randint(0, 130)}"
        text = rnd.choice([None, f"t{rnd.randint(0, 130)}"])
        place = f"p{i // 4:04d}"
        if rnd.random() < 0.4:
            attachments.append((place, i, "m" + place, f"a{i}", digest, text, rnd.random() < 0.5))
        else:
            links.append((place, i, "m" + place, f"l{i}", digest, text, f"s{rnd.randint(0, 60)}", rnd.random() < 0.6))
    corpus = [("old1", "d1", "t1", "s1"), ("old0", "d1", None, "s2"), ("old2", "d7", None, "s3")]
    shared = "place string, part long, message_id string, path string, digest string, fingerprint string"
    a = spark.createDataFrame(attachments, shared + ", verified boolean")
    b = spark.createDataFrame(links, shared + ", stem string, verified boolean")
    c = spark.createDataFrame(corpus, "path string, digest string, fingerprint string, stem string")
    walked = collect.collect_messages(a, b, c).collect()
    expected = walk_one_by_one(attachments, links, corpus)
    assert {r["path"]: r["reason"] for r in walked} == expected
    assert len(walked) == len(expected) and len(set(expected.values())) == 7
    saved = {r["path"] for r in walked if r["decision"] == "saved"}
    assert saved == {p for p, reason in expected.items() if reason is None}
    for r in walked:
        if r["decision"] == "skip":
            assert r["duplicate_of"] in saved | {"old0", "old1", "old2"}
    assert {r["duplicate_of"] for r in walked if r["reason"] == "not_tried"} <= {p for p in saved if p[0] == "l"}
    # no attachments, no corpus, nothing at all
    assert {r["path"]: r["reason"] for r in collect.collect_messages(a.limit(0), b).collect()} == walk_one_by_one([], links, [])
    assert collect.collect_messages(a.limit(0), b.limit(0)).count() == 0


def test_free_numbers_of_a_name_with_many_used_ones(spark, monkeypatch):
    monkeypatch.setattr(dedup, "NUMBER_RANGE", 8)
    rnd = random.Random(4)
    taken, files = [], []
    every_second = [2 * i for i in range(1, 60)]
    for d, numbers in (("a", every_second), ("b", rnd.sample(range(1, 90), 50)), ("c", []), ("e", list(range(1, 41)))):
        taken += [(d, "x.pdf" if n == 1 else f"x__{n}.pdf") for n in numbers] + [(d, "other__7.pdf"), (d, "x__0.pdf")]
        files += [(d, f"{d}/{i}", "x.pdf") for i in range(70)]
    wanted = spark.createDataFrame(files, "directory string, path string, name string")
    existing = spark.createDataFrame(taken, "directory string, name string")
    got = dedup.unique_names(wanted, existing).collect()
    assert len(got) == len(files)
    for d in "abce":
        used = {int(n.split("__")[1][:-4]) if "__" in n else 1 for dd, n in taken if dd == d and n.startswith("x")}
        free = [n for n in range(1, 400) if n not in used][:70]
        names = ["x.pdf" if n == 1 else f"x__{n}.pdf" for n in free]
        assert sorted(r["output_name"] for r in got if r["directory"] == d) == sorted(names)
    assert dedup.unique_names(wanted.limit(0), existing).count() == 0


def test_anti_join_keeps_hot_keys_out_of_the_shuffle(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, "known hot" if i % 3 == 0 else "new hot" if i % 3 == 1 else f"k{i}" if i % 2 else None) for i in range(3000)]
        df = spark.createDataFrame(rows, "i int, k string")
        known = spark.createDataFrame([("known hot",), ("k5",), ("k11",), (None,), ("k5",)], "k string")
        left = dedup.skip_known(df, known, "k")
        got = {r["i"] for r in left.collect()}
        assert got == {i for i, k in rows if k not in ("known hot", "k5", "k11")}
        # the rows that a shuffle deals to one task are few: heavy ones stay where they are
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
