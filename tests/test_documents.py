# -*- coding: utf-8 -*-
"""Whole documents to records, the page split, writers and scans."""

import csv
import datetime
import glob
import json

import pytest
from pyspark.sql import functions as F

from billweave.functions import text as tx
from billweave.operators import billing, extract, fields, relevance, report, totals
from billweave.sources import files, scan, sinks


def record(spark, text, **more):
    rows = [("doc.pdf", text, *more.values())]
    schema = "source_file string, text string" + "".join(f", {k} string" for k in more)
    return extract.extract_invoices(spark.createDataFrame(rows, schema)).collect()[0]


def resolved(spark, text, lines=None, block=None):
    df = spark.createDataFrame([(text, lines, block)], "text string, given array<string>, block array<string>")
    df = df.select("text", "block", F.coalesce("given", tx.extract_lines(F.col("text"))).alias("lines"))
    return totals.resolve_totals(df, "text", "lines", "block").collect()[0]


def test_zero_rate_parking_receipt(spark):
    r = record(
        spark,
        "\n".join(
            [
                "14.05.2026",
                "191100662 :חשבונית מס/קבלה מספר",
                "פתח תקווה",
                "חניון היקב+972500000000",
                "פירוט החניות",
                'סה"כ אינו חייב במע"מ:',
                "₪ 16.89",
                'מע"מ: 0.00%',
                "support@pango.co.il",
            ]
        ),
    )
    assert (r.invoice_id, r.invoice_date, r.invoice_from, r.invoice_for) == ("191100662", "14/05/2026", "Pango", "חניון היקב")
    assert (r.invoice_total, r.invoice_vat, r.base_before_vat, r.vat_rate) == (16.89, 0.0, 16.89, 0.0)
    assert r.category == "transportation" and r.category_rule.startswith("vendor:")


def test_municipal_bill(spark):
    r = record(
        spark,
        "\n".join(
            [
                "עיריית פתח תקווה",
                "תאריך הדפסה: 28/08/2025",
                "מס׳ מסלקה/שובר/ספח: 4553051904",
                "חשבון ארנונה תקופתי",
                'ח"שב',
                "6206.60",
                "-43.50",
                "328.30",
                "-2.30",
                "131.30",
                "-0.90",
                'סה"',
                'סה"כ לתשלום בש"ח: 6,619.50',
                "31/10/2025- ו30/09/2025- הוראת הקבע בחשבונך בבנק תחויב בשני תשלומים",
                "2025 אוקטובר-ספטמבר",
            ]
        ),
    )
    assert (r.invoice_id, r.invoice_date, r.invoice_from, r.invoice_for) == ("4553051904", "28/08/2025", "עיריית פתח תקווה", "ארנונה")
    assert (r.invoice_total, r.invoice_vat, r.breakdown_sum) == (6619.5, 0.0, 6619.5)
    assert r.breakdown_values == [6206.6, -43.5, 328.3, -2.3, 131.3, -0.9]
    assert (r.period_start, r.period_end, r.period_label) == ("2025-09-01", "2025-10-30", "ספטמבר - אוקטובר")
    assert r.category == "municipal_tax" and r.municipal and r.notes is None
    assert r.parse_confidence == pytest.approx(0.99)


def test_visual_order_phone_bill(spark):
    r = record(
        spark,
        "\n".join(
            [
                "יול ימר תרושקת",
                "0507953 :סמ תינובשח רפסמ",
                "10/09/2025 :ךיראת",
                "₪ 23.42",
                "₪ 19.85",
                "₪ 3.57",
                "₪ 23.42",
                "18% מ\"עמ",
                'מ"עמ ללוכ תיחכונ תינובשח כ"הס',
            ]
        ),
    )
    assert r.invoice_from == "רמי לוי תקשורת" and r.category == "communication"
    assert (r.invoice_total, r.invoice_vat, r.base_before_vat) == (23.42, 3.57, 19.85)


def test_totals_with_vat_markers(spark):
    lines = ['כ" סה', "₪ 627.12", "₪ 627.12", "₪ 112.88", "₪ 740.00", "₪ 740.00", "₪ 740.00", "₪ 156.78", 'מ" מע  18%', 'מ" מע', "כולל", 'כ" סה']
    r = resolved(spark, "\n".join(lines))
    assert (r.invoice_total, r.invoice_vat, r.base_before_vat, r.vat_rate) == (740.0, 112.88, 627.12, 18.0)


def test_totals_from_text_patterns(spark):
    text = '\n    סה"כ לתשלום 590.00\n    סה"כ מע"מ 90.00\n    ₪ 590.00\n    '
    r = resolved(spark, text, ["line", 'מ"עמ ינפל 500.00', 'לע מ"עמ 90.00'])
    assert (r.invoice_total, r.invoice_vat) == (590.0, 90.0)


def test_municipal_block_replaces_total(spark):
    lines = ["line", 'ח"שב', "100.0", "200.0", "סכנה", 'סה"כ לתשלום 50.0']
    r = resolved(spark, 'ארנונה סה"כ לתשלום 50.0', lines, lines)
    assert (r.invoice_total, r.breakdown_sum, r.total_rule) == (300.0, 300.0, "municipal_block")
    r = resolved(spark, "דרישת תשלום ארנונה", ["noop"], ['ח"שב', "100", "200", 'סה"', "closing"])
    assert r.municipal and (r.invoice_total, r.invoice_vat, r.breakdown_values) == (300.0, 0.0, [100.0, 200.0])


def test_second_reading(spark):
    poor = "קצר"
    good = "\n".join(["מאת חנות הספרים", 'סה"כ לתשלום: 118.00', "x" * 10])
    r = record(spark, poor, fallback_text=good)
    assert (r.invoice_from, r.invoice_total, r.data_source) == ("חנות הספרים", 118.0, "pymupdf")
    r = record(spark, "")
    assert (r.notes, r.data_source, r.invoice_total) == ("extract_text_failed", None, None)


def test_date_tokens_are_not_invoice_numbers(spark):
    assert record(spark, "Date: 2026-05-14\nרפסמ").invoice_id is None


def test_early_stop_over_page_rows_equals_the_walk(spark, monkeypatch):
    import random

    monkeypatch.setattr(relevance, "PAGE_RANGE", 4)
    rnd = random.Random(2)
    words = ["plain"] * 14 + ["invoice", "receipt", "payslip"]
    docs = [(i, [" ".join(rnd.choices(words, k=2)) for _ in range(rnd.randint(1, 60))]) for i in range(80)]
    docs += [(200, ["plain"] * 500 + ["invoice"] * 3 + ["payslip"]), (201, ["plain"] * 30)]
    df = spark.createDataFrame(docs, "doc_id int, pages array<string>")
    terms = relevance.R.TermRules(raw_pos=(), latin_pos=("invoice", "receipt"), raw_neg=(), latin_neg=("payslip",))
    in_row = df.select("doc_id", relevance.document_stats(F.col("pages"), terms, stop_early=True).alias("s")).select("doc_id", "s.*")
    rows = df.select("doc_id", F.posexplode("pages").alias("page_no", "text"))
    got = relevance.keyword_stats(rows, terms, stop_early=True).select(in_row.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, in_row.collect()))
    assert got.where("doc_id = 200").head()["pos_hits"] == 3


def municipal_page(number, label, total, charge, discount):
    lines = [
        "משולם בהוראת קבע",
        'סה"כ יגבה מהחשבון בש"ח:',
        label,
        number,
        "27/02/2026",
        f"{charge:,.2f} חיוב תקופתי ארנונה- 2026 ארנונה",
        f"{discount:,.2f} הנחת גביה בבנק- 2026 ארנונה",
    ]
    words = [("סה\"כ", 10.0), ("יגבה", 20.0), ("מהחשבון", 30.0), ('בש"ח:', 40.0), (f"{total:,.2f}", 80.0)]
    return "\n".join(lines), words


def split(spark, pages, municipal=True):
    docs = [("s.pdf", i, text) for i, (text, _w) in enumerate(pages)]
    words = [("s.pdf", i, n, x, 100.0, t, 0, 0) for i, (_t, ws) in enumerate(pages) for n, (t, x) in enumerate(ws)]
    pages_df = spark.createDataFrame(docs, "source_file string, page_no int, text string")
    words_df = spark.createDataFrame(
        words, "doc_id string, page_no int, word_no int, x0 double, y0 double, text string, block int, line int"
    )
    amounts = totals.label_amounts(words_df, ("יגבה",)).withColumnRenamed("doc_id", "source_file")
    joined = pages_df.join(amounts.withColumnRenamed("amount", "charged"), ["source_file", "page_no"], "left")
    base = extract.extract_invoices(spark.createDataFrame([("s.pdf", "עיריית פתח תקווה ארנונה" if municipal else "shop")], "source_file string, text string"))
    return extract.split_municipal_pages(base, joined).collect()


def test_municipal_page_split(spark):
    pages = [
        municipal_page("10200570020", "גן ילדים/מעון- 39", 5968.8, 6010.9, 42.1),
        municipal_page("10200570021", "קרקע תפוסה- 516", 315.6, 317.8, 2.2),
        municipal_page("10200700015", "חנייה בתעריף קרקע תפוסה- 510", 126.2, 127.1, 0.9),
    ]
    rows = {r.invoice_id: r for r in split(spark, pages)}
    assert len(rows) == 3
    first = rows["10200570020"]
    assert (first.invoice_total, first.breakdown_values, first.invoice_for) == (5968.8, [6010.9, -42.1], "גן ילדים/מעון- 39")
    assert (first.invoice_vat, first.data_source, first.invoice_date) == (0.0, "pymupdf", "27/02/2026")
    assert rows["10200700015"].invoice_total == 126.2


def test_page_split_needs_two_numbers_and_a_municipal_record(spark):
    same = [municipal_page("10200570020", "א- 1", 10.0, 11.0, 1.0), municipal_page("10200570020", "א- 1", 20.0, 21.0, 1.0)]
    rows = split(spark, same)
    assert len(rows) == 1 and rows[0].invoice_id is None
    two = [same[0], municipal_page("10200570021", "ב- 2", 20.0, 21.0, 1.0)]
    assert len(split(spark, two, municipal=False)) == 1


def split_in_row(spark, pages, municipal=True):
    """The same split, over documents that carry pages and word boxes."""
    boxes = [[(x, 100.0, t, 0, 0) for t, x in words] for _text, words in pages]
    head = "עיריית פתח תקווה ארנונה" if municipal else "shop"
    schema = "source_file string, text string, pages array<string>, page_words array<array<struct<x0: double, y0: double, text: string, block: int, line: int>>>"
    return extract.extract_records(spark.createDataFrame([("s.pdf", head, [t for t, _ in pages], boxes)], schema)).collect()


def test_split_in_the_row_equals_the_split_by_joins(spark):
    pages = [
        municipal_page("10200570020", "גן ילדים/מעון- 39", 5968.8, 6010.9, 42.1),
        municipal_page("10200570021", "קרקע תפוסה- 516", 315.6, 317.8, 2.2),
        municipal_page("10200570020", "again- 1", 1.0, 2.0, 1.0),
        ("no label\n12345678901", []),
        municipal_page("10200700015", "חנייה בתעריף קרקע תפוסה- 510", 0.0, 127.1, 0.9),
    ]
    for some, municipal in ((pages, True), (pages[::2], True), ([], True)):
        by_join = {str([r[f] for f in extract.RECORD_FIELDS if f != "parse_confidence"]) for r in split(spark, some, municipal)} if some else None
        in_row = split_in_row(spark, some, municipal)
        got = {str([r[f] for f in extract.RECORD_FIELDS if f != "parse_confidence"]) for r in in_row}
        assert len(got) == len(in_row)
        assert got == by_join if some else len(got) == 1
    total = {r.invoice_id: r.invoice_total for r in split_in_row(spark, pages)}
    assert total == {"10200570020": 5968.8, "10200570021": 315.6, "10200700015": 126.2}


def test_long_vendors_stay_apart_until_they_are_written(spark):
    long = "ספק " + "א" * 130
    docs = [(f"{end}.pdf", f"מאת {long}{end}\nסה\"כ: 100.00") for end in ("ב", "ג")]
    records = extract.extract_invoices(spark.createDataFrame(docs, "source_file string, text string"))
    assert report.vendor_subtotals(records).where("not is_total").count() == 2
    written = {r["invoice_from"] for r in extract.sanitize_records(records.select("invoice_from")).collect()}
    assert written == {long[:117] + "..."}


def test_amount_beside_the_second_label_word(spark):
    page = municipal_page("10200570020", "א- 1", 10.0, 11.0, 1.0)
    other = municipal_page("10200570021", "ב- 2", 20.0, 21.0, 1.0)
    boxes = [[(0.0, 50.0, "לתשלום", 0, 3), (9.0, 50.5, ".75", 0, 4), (8.0, 49.6, "33", 0, 4), (1.0, 51.0, "9", 0, 5)], None]
    schema = "source_file string, text string, pages array<string>, page_words array<array<struct<x0: double, y0: double, text: string, block: int, line: int>>>"
    rows = extract.extract_records(spark.createDataFrame([("s.pdf", "עיריית פתח תקווה ארנונה", [page[0], other[0]], boxes)], schema)).collect()
    assert {r.invoice_id: r.invoice_total for r in rows} == {"10200570020": 33.75, "10200570021": 20.0}


def lines_of(folder):
    out = []
    for name in sorted(glob.glob(f"{folder}/part-*")):
        with open(name, encoding="utf-8") as fh:
            out += fh.read().splitlines()
    return out


def cells_of(folder):
    """Header and data rows; every part file repeats the header."""
    rows = list(csv.reader(lines_of(folder)))
    return [rows[0]] + [r for r in rows if r != rows[0]]


def sample_records(spark):
    base = extract.extract_invoices(spark.createDataFrame([("/private/credentials.json", "x")], "source_file string, text string"))
    return base.select(
        *[c for c in base.columns if c not in ("invoice_from", "invoice_for", "notes", "invoice_vat", "invoice_total", "base_before_vat")],
        F.lit('בזק Bezeq בע"מ').alias("invoice_from"),
        F.lit("חשבונית Invoice bilingual").alias("invoice_for"),
        F.lit("Authorization: Bearer secret-token from /tmp/token.json via /tmp/.msal_token_cache.bin").alias("notes"),
        F.lit(2.005).alias("base_before_vat"),
        F.lit(1.005).alias("invoice_vat"),
        F.lit(3.015).alias("invoice_total"),
    )


def test_writers(spark, tmp_path):
    records = sample_records(spark)
    sinks.write_records_json(records, f"{tmp_path}/json")
    sinks.write_records_csv(records, f"{tmp_path}/csv")
    sinks.write_summary_csv(report.report_totals(records), f"{tmp_path}/summary")
    raw = "\n".join(lines_of(f"{tmp_path}/json"))
    row = json.loads(raw)
    assert (row["base_before_vat"], row["invoice_vat"], row["invoice_total"]) == (2.01, 1.01, 3.02)
    assert "חשבונית Invoice bilingual" in raw and "period_start" in row
    cells = cells_of(f"{tmp_path}/csv")
    assert cells[0] == list(extract.RECORD_FIELDS)
    assert cells[1][cells[0].index("invoice_total")] == "3.02" and cells[1][cells[0].index("municipal")] == "false"
    for secret in ("Authorization", "Bearer secret", "credentials.json", "token.json", ".msal_token_cache.bin"):
        assert secret not in raw and secret not in str(cells)
    summary = cells_of(f"{tmp_path}/summary")
    assert summary[0] == list(report.SUMMARY_FIELDS)
    assert summary[1][:4] == ["records", "", "", "1"]
    assert summary[3][:4] == ["invoice_total", "3.02", "3.02", "1"]
    back = report.net_vat_gross(sinks.read_summary_csv(spark, f"{tmp_path}/summary")).collect()[0]
    assert tuple(back) == (2.01, 1.01, 3.02)


def test_record_queries_write_compressed_files(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries
    from billweave.plans import landing

    monkeypatch.setattr(landing, "run_dir", lambda spark, name: f"{tmp_path}/{name}")
    (tmp_path / "in").mkdir()
    folder = f"{tmp_path}/in"
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"
    day = datetime.date(2024, 3, 5)
    rows = [(k, 1, k % 3, 1, 1.0, 10.0 + k, 0.0, 0.1, "RN"[k % 2], day) for k in range(300)]
    spark.createDataFrame(rows, line).write.parquet(f"{folder}/lineitem.parquet")
    suppliers = [(0, "Bearer abc", 0), (1, "token.json", 0), (2, "plain", 0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    for kind, name in (("json", "records_json"), ("csv", "records_csv")):
        got = [r["invoice_from"] for r in queries()[name](spark, folder).collect()]
        assert len(got) == 300 and {"plain"} < set(got) and not {"Bearer abc", "token.json"} & set(got)
        written = glob.glob(f"{tmp_path}/records-{kind}/part-*")
        assert written and all(f.endswith(f".{kind}.gz") for f in written)


def test_charge_and_message_writers(spark, tmp_path):
    charges = spark.createDataFrame([("t1", "x", '{"a": 1}'), ("t2", "x", "plain")], "event_time string, event_type string, extra_data string")
    sinks.write_charges_csv(charges, f"{tmp_path}/charges")
    cells = cells_of(f"{tmp_path}/charges")
    assert {r[-1] for r in cells} >= {"extra_data_json", '{"a":1}', '"plain"'}
    sinks.write_receipts_csv(billing.receipt_candidates(billing.enrich_charges(charges)), f"{tmp_path}/receipts")
    assert any("suggested_filename" in x for x in lines_of(f"{tmp_path}/receipts"))
    rows = spark.createDataFrame([("m", ["a", "b"], [("n",)])], "id string, links array<string>, files array<struct<name:string>>")
    sinks.write_messages_csv(rows, f"{tmp_path}/messages")
    assert cells_of(f"{tmp_path}/messages")[1] == ["m", "a; b", '{"name":"n"}']
    decided = spark.createDataFrame([("m1", "saved"), ("m2", "skip")], "message_id string, decision string")
    sinks.write_collection(decided, f"{tmp_path}/run")
    assert spark.read.json(f"{tmp_path}/run").where("decision = 'saved' and ts is not null").count() == 1


def test_document_scan(spark, tmp_path):
    for name in ("a.pdf", "sub/b.PDF", "quarantine/c.pdf", "_tmp/d.pdf", "duplicates/e.pdf", "f.txt"):
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"%PDF " + name.encode())
    found = scan.scan_documents(spark, f"{tmp_path}/in")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.pdf", "b.PDF"]
    every = scan.scan_documents(spark, f"{tmp_path}/in", (), ())
    assert every.count() == 6
    wanted = spark.createDataFrame([("a.pdf",), ("missing.pdf",)], "name string")
    root = F.lit(every.select(F.regexp_extract("path", "^(.*/in)/", 1)).first()[0])
    hit, missing = scan.select_files(every.select("path"), wanted, root)
    assert hit.count() == 1 and [r["name"] for r in missing.collect()] == ["missing.pdf"]


def test_document_scan_sees_every_name(spark, tmp_path):
    names = ["_x.pdf", ".y.pdf", "z.pdf", "_in/a.pdf", "_in/deep/_b.pdf", ".dot/c.pdf", "a b/é=1.pdf", "_tmp/_no.pdf", "x/quarantine/.no.pdf", ".z.txt"]
    rows = spark.createDataFrame([("/" + n, n) for n in names], "path string, content string")
    files.write_files(rows, f"{tmp_path}/in")
    found = scan.scan_documents(spark, f"{tmp_path}/in")
    got = {r["path"].split("/in/", 1)[1]: (bytes(r["content"]).decode(), r["length"]) for r in found.collect()}
    assert got == {n: (n, len(n.encode())) for n in names[:7]}
    # contents are not read for a listing
    plan = found.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    assert files.list_files(spark, f"{tmp_path}/in").count() == len(names)
    assert files.list_files(spark, f"{tmp_path}/missing").count() == 0


def test_manifest_rules_and_control_tables(spark, tmp_path):
    for month, folder in (("01_2025", ""), ("02_2025", "/elsewhere")):
        d = tmp_path / f"invoices_{month}"
        d.mkdir()
        (d / "run_summary.json").write_text(json.dumps({"status": " success ", "consolidated_dir": folder}))
    got = scan.run_manifests(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["status"] == "success" and got[0]["invoices_dir"].endswith("invoices_01_2025")
    rules = {
        "keyword_sets": {"english_core": ["invoice", "bill"]},
        "attachment_detection": {"name_hints": ["scan"]},
        "link_detection": {"url_keywords": ["pay"], "trusted_providers": ["a.b"]},
        "scoring": {"he_weight": 1.2},
    }
    (tmp_path / "rules.json").write_text(json.dumps(rules, indent=1))
    rows = {(r["section"], r["name"], r["ord"], r["value"]) for r in scan.rule_config(spark, f"{tmp_path}/rules.json").collect()}
    assert ("keyword_sets", "english_core", 1, "bill") in rows and ("scoring", "he_weight", 0, "1.2") in rows
    assert ("link_detection", "trusted_providers", 0, "a.b") in rows
    table = spark.createDataFrame([("1", "t1"), ("2", "t2")], "id string, tenant_id string").select(
        "id", "tenant_id", F.lit("a").alias("action"), F.lit("e").alias("entity_type"), F.lit("x").alias("entity_id"),
        F.lit("r").alias("request_id"), F.lit(None).cast("string").alias("message"), F.current_timestamp().alias("created_at"),
    )
    sinks.write_control_table(table, str(tmp_path), "audit_events")
    assert scan.control_table(spark, str(tmp_path), "audit_events").where("tenant_id = 't1'").count() == 1


def test_landed_mail(spark, tmp_path):
    mail = [
        {"id": "m1", "subject": None, "bodyPreview": "hi", "from": {"emailAddress": {"address": "a@b.c"}}, "receivedDateTime": "2025-09-01T10:00:00Z", "webLink": "w", "hasAttachments": True, "parentFolderId": "inbox"},
        {"id": "m2", "subject": "s", "bodyPreview": None, "from": None, "receivedDateTime": "2025-09-03T10:00:00Z", "webLink": None, "hasAttachments": None, "parentFolderId": "sent"},
    ]
    (tmp_path / "mail.json").write_text("\n".join(json.dumps(m) for m in mail))
    schema = "id string, subject string, bodyPreview string, `from` struct<emailAddress:struct<name:string,address:string>>, receivedDateTime string, webLink string, hasAttachments boolean, parentFolderId string"
    rows = scan.message_fields(spark.read.schema(schema).json(f"{tmp_path}/mail.json"))
    got = {r["message_id"]: r for r in rows.collect()}
    assert got["m1"]["subject"] == "" and got["m1"]["sender"] == "a@b.c" and got["m2"]["has_attachments"] is False
    listed = scan.scan_messages(rows, "2025-09-01", "2025-09-03", ["sent"]).collect()
    assert [r["message_id"] for r in listed] == ["m1"]


def test_page_split_reads_each_page_once(spark):
    """The filter on what a page says is no copy of the rules: they stand in the plan once."""
    pages = spark.createDataFrame([("d", 1, "x", 1.0)], "source_file string, page_no int, text string, charged double")
    base = spark.createDataFrame(
        [("d", True)], "source_file string, municipal boolean"
    ).select(
        "*",
        *[F.lit(None).cast("string").alias(c) for c in ("invoice_id", "invoice_date", "invoice_for", "notes", "period_start", "period_end", "category", "data_source")],
        *[F.lit(None).cast("double").alias(c) for c in ("invoice_total", "invoice_vat", "breakdown_sum", "parse_confidence")],
        F.lit(None).cast("array<double>").alias("breakdown_values"),
        F.lit(None).cast("array<string>").alias("reference_numbers"),
    )
    plan = extract.split_municipal_pages(base, pages)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert not any("regexp_replace" in x for x in filters)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feed_positions_take_one_sort(spark):
    rows = [(None, None, None, "X", None, 1.0, 1.0, 1.0)] * 2
    rows += [(f"s{i % 7}", str(i % 5), "01/02/2024", f"V{i % 3}", "f", 1.0, 2.0, 3.0) for i in range(40)]
    schema = "source_file string, invoice_id string, invoice_date string, invoice_from string, invoice_for string, base_before_vat double, invoice_vat double, invoice_total double"
    feed = report.feed_rows(spark.createDataFrame(rows, schema))
    placed = report.feed_positions(feed)
    assert plan_of(placed).count("Join ") == 1
    got = sorted(placed.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1, feed.count() + 1))
    names = ("vendor_key", "vendor", "row_rank", "date_key", "invoice_id", "source_file")
    shown = [[r[n] for n in names] for r in got]
    assert shown == [[r[n] for n in names] for r in report.in_report_order(feed).collect()]
    assert got[-1]["row_type"] == "grand_total"


def test_integrity_counts_both_sides_in_one_grouping(spark):
    items = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    details = spark.createDataFrame([(1, 1), (3, 4), (3, 3), (None, None), (4, 4)], "key long, id long")
    members = spark.createDataFrame([("a", 1), ("a", 9), ("a", 9), ("b", None), ("a", 4)], "view string, id long")
    selected = spark.createDataFrame([("a", 1), ("b", 1), ("b", None)], "view string, id long")
    found = report.member_integrity(items, details, members, selected)
    assert "FullOuter" not in plan_of(found)
    assert sorted((r["problem"], r["id"] or 0) for r in found.collect()) == [
        ("detail_key_mismatch", 3), ("detail_without_item", 0), ("detail_without_item", 3), ("detail_without_item", 4),
        ("item_without_detail", 0), ("item_without_detail", 2), ("repeated_item", 1),
        ("selected_not_listed:b", 0), ("selected_not_listed:b", 1), ("unknown_in_view:a", 9), ("unknown_in_view:b", 0),
    ]


def test_description_squeezes_a_text_once(spark):
    df = spark.createDataFrame([("קבלה\nחוג  תנועה", ["קבלה"])], "text string, lines array<string>")
    plan = plan_of(df.select(fields.invoice_for(F.col("lines"), F.col("text")).alias("x")))
    assert plan.count("regexp_replace(text") == 1
