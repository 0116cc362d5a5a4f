"""Values each function must give."""

import pytest
from pyspark.sql import functions as F

from billweave import rules as R
from billweave.functions import dates, links, money, text
from billweave.operators import billing, control, fields, relevance, report, scoring, totals

X = F.col("x")


def one(evaluate, value, *columns, kind="string"):
    return evaluate([(value,)], f"x {kind}", *columns)[0]


def test_amount_tokens(evaluate):
    tokens = ["-1,234.50", "123.456", "00.976", "bad", "1,234", "1,234,567", "", "-", "₪ 12.30", "7.", "1.2.3", None]
    got = evaluate([(t,) for t in tokens], "x string", money.normalize_amount_token(X), money.parse_number(X))
    assert [g[0] for g in got] == [
        "-1234.50", "654.321", "976.00", None, "1.234", "1234567", None, None, "12.30", "7.", "1.2.3", None,
    ]
    assert [g[1] for g in got] == [
        -1234.5, 654.321, 976.0, None, 1.234, 1234567.0, None, None, 12.3, 7.0, None, None,
    ]


def test_select_amount(evaluate):
    lists = [["0020", "12.30", "100", "5.555"], ["2025", "7", "12"], ["7", "8"], ["2025"], [], ["5.555", "3"]]
    got = evaluate([(t,) for t in lists], "x array<string>", money.select_amount(X))
    # 5.555 is read as 555.5
    assert [g[0] for g in got] == [12.3, 12.0, 7.0, None, None, 555.5]


def test_percent_tokens(evaluate):
    got = one(evaluate, "18% 12.50 % 7 a%9 30", money.plain_numbers(X), money.percent_numbers(X))
    # a percent sign within two characters on either side
    assert got == (["30"], ["18", "12.50", "7", "9"])


def test_money_rounding(evaluate):
    values = [2.005, 1.005, 3.015, -2.005, None]
    got = evaluate([(v,) for v in values], "x double", money.round_money(X))
    assert [g[0] for g in got] == [2.01, 1.01, 3.02, -2.01, None]


def test_amount_near_markers(evaluate):
    t = 'טרם 10.00\nסה"כ לתשלום\nעוד שורת 20,25 ו 90'
    got = one(
        evaluate, t,
        money.amount_near_markers(X, [r"סה\"כ"], 40, "max"),
        money.amount_near_markers(X, [r"סה\"כ"], 40, "min"),
        money.amount_near_markers(X, [r"nothing"], 40, "min"),
    )
    assert got == (20.25, 10.0, None)


def test_vat_rate_text(evaluate):
    texts = ['פטור ממע"מ: 0.00%\nסה"כ מע"מ 18%', 'מע"מ: 0.00%', "no rate", "VAT 17 %", '18% מע"מ ו 5% מע"מ']
    got = evaluate([(t,) for t in texts], "x string", money.explicit_vat_rate(X))
    assert [g[0] for g in got] == [18.0, 0.0, None, 17.0, 5.0]


def test_repeated_currency_total(evaluate):
    lists = [["60", "60", "70"], ["60", "60", "80", "80"], ["10", "10", "55"], ["1", "2"], []]
    got = evaluate([(t,) for t in lists], "x array<string>", money.repeated_currency_total(X))
    assert [g[0] for g in got] == [60.0, 80.0, 55.0, 2.0, None]


def test_vat_rate_estimate(evaluate):
    rows = [(118.0, 18.0), (0.0, 0.0), (10.0, 10.0), (None, 1.0)]
    got = evaluate(rows, "a double, b double", money.vat_rate_estimate(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [18.0, None, None, None]


def test_dates(evaluate):
    tokens = [
        "2025-09-01", "1/9/2025", "15.10.25", "05-06-69", "12/31/2024", "3-Feb-2024", "3-feb-70",
        "2025-02", "2/2025", "february 2024", "ינואר 2025", "31/02/2025", "2025-13", "x", "",
    ]
    got = evaluate([(t,) for t in tokens], "x string", dates.normalize_date_token(X), dates.normalize_date_token(X, 31))
    assert [g[0] for g in got] == [
        "2025-09-01", "2025-09-01", "2025-10-15", "1969-06-05", "2024-12-31", "2024-02-03", "1970-02-03",
        "2025-02-01", "2025-02-01", "2024-02-01", "2025-01-01", None, None, None, None,
    ]
    assert got[7][1] == "2025-02-28" and got[9][1] == "2024-02-29"


def test_date_like(evaluate):
    tokens = ["2026-05-14", "14.05.26", "2026-05", "2026-15", "123456", "14/05/2026", None]
    got = evaluate([(t,) for t in tokens], "x string", dates.is_date_like_token(X))
    assert [g[0] for g in got] == [True, True, True, False, False, False, False]


def test_periods(evaluate):
    t = "תקופה: 01/09/2025 - 30/09/2025 לתשלום עד 15.10.2025 PO #12345"
    p, due, refs = one(evaluate, t, dates.period(X), dates.due_date(X), dates.reference_numbers(X))
    assert tuple(p) == ("2025-09-01", "2025-09-30", "2025-09-01 - 2025-09-30")
    assert due == "2025-10-15" and refs == ["12345"]
    t = "31/10/2025- ו30/09/2025- הוראת הקבע בחשבונך\n2025 אוקטובר-ספטמבר"
    assert tuple(one(evaluate, t, dates.period(X))[0]) == ("2025-09-01", "2025-10-30", "ספטמבר - אוקטובר")
    t = "2025 ינואר-פברואר"
    assert tuple(one(evaluate, t, dates.period(X))[0]) == ("2025-01-01", "2025-02-28", "פברואר - ינואר")
    # a range matches even when a side is no date; then there is no label
    assert tuple(one(evaluate, "99/99/2025 - 01/02/2025", dates.period(X))[0]) == (None, "2025-02-01", None)
    assert tuple(one(evaluate, "nothing", dates.period(X))[0]) == (None, None, None)


def test_invoice_date(evaluate):
    texts = ["14.05.2026", "תאריך: 01/09/2025 x", "תאריך: 41/09/2025 01/01/2020", "none", "תאריך מדומה: 01/09/2025"]
    got = evaluate([(t,) for t in texts], "x string", dates.invoice_date(X))
    assert [g[0] for g in got] == ["14/05/2026", "01/09/2025", None, None, "01/09/2025"]


def test_windows_and_durations(evaluate):
    got = one(evaluate, 3725, dates.duration_text(X), kind="long")
    assert got == ("01h:02m:05s",)
    w = one(evaluate, 12, dates.month_window(F.lit(2025), X.cast("int")), kind="int")[0]
    assert tuple(w) == ("2025-12-01", "2026-01-01", "12_2025")
    assert one(evaluate, "2025-01-01", dates.utc_epoch(X)) == (1735689600,)
    keys = evaluate([("03/01/2026",), (None,), ("soon",), ("",)], "x string", dates.sort_date(X))
    assert [k[0] for k in keys] == ["2026-01-03", "9999-12-31", "soon", "9999-12-31"]


def test_lines(evaluate):
    texts = [" line1 \r\n\n line2 ", "90\n.\n39", "90\n39.", "39.\n90", "a\n.\n5", "5\n7.\n12", "", " x y"]
    got = evaluate([(t,) for t in texts], "x string", text.extract_lines(X))
    assert [g[0] for g in got] == [
        ["line1", "line2"], ["39.90"], ["90.39"], ["90.39"], ["a", ".", "5"], ["5.7", "12"], [], ["x", "y"],
    ]


def sequential_merge(lines):
    """Reading the lines one by one."""
    out, i = [], 0
    number = __import__("re").compile(r"-?\d+\Z")
    while i < len(lines):
        x, nxt = lines[i], lines[i + 1] if i + 1 < len(lines) else None
        prev = out[-1] if out else None
        if x == "." and prev and nxt and number.match(prev) and number.match(nxt):
            out[-1] = f"{nxt}.{prev}"
            i += 2
        elif x.endswith(".") and number.match(x[:-1]) and prev and number.match(prev):
            out[-1] = f"{prev}.{x[:-1]}"
            i += 1
        elif x.endswith(".") and number.match(x[:-1]) and nxt and number.match(nxt):
            out.append(f"{nxt}.{x[:-1]}")
            i += 2
        else:
            out.append(x)
            i += 1
    return out


def test_line_merge_against_sequential_reading(evaluate):
    import random

    rnd = random.Random(7)
    docs = [[rnd.choice(["1", "22", ".", "3.", "-4", "5.6", "x", "7."]) for _ in range(rnd.randint(1, 9))] for _ in range(800)]
    got = evaluate([("\n".join(d),) for d in docs], "x string", text.extract_lines(X))
    for d, (lines,) in zip(docs, got):
        assert lines == sequential_merge(d), d


def test_names(evaluate):
    got = one(evaluate, " invoice:2025/06?.pdf ", text.sanitize_filename(X))
    assert got == ("invoice_2025_06_.pdf",)
    assert one(evaluate, "abc-123-XYZ", text.short_message_tag(X, 5)) == ("23XYZ",)
    assert one(evaluate, "--", text.short_message_tag(X)) == ("msg",)
    stems = evaluate([("/a/b__2.pdf",), ("/a/b__x.pdf",), ("c.tar.gz",), (".hidden",)], "x string", text.stem_key(X))
    assert [s[0] for s in stems] == ["b", "b__x", "c.tar", ".hidden"]
    assert one(evaluate, "inv", text.tagged_name(X, F.lit("t1"))) == ("inv__t1.pdf",)
    long = "x" * 130
    assert one(evaluate, long, text.display_value(X)) == ("x" * 117 + "...",)
    assert one(evaluate, "x" * 120, text.display_value(X)) == ("x" * 120,)


def test_hashes(evaluate):
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(evaluate, "abc", text.content_hash(X)) == (digest,)
    long = "abcde " * 4000  # documents that differ only after character 20 000 are kept apart
    pages = [[long, "klmno"], [long, "other"], [long + "  klmno"], ["", "   "], []]
    got = [g[0] for g in evaluate([(p,) for p in pages], "x array<string>", text.fingerprint(X))]
    assert None not in got[:3] and got[0] != got[1] and got[0] == got[2] and got[3:] == [None, None]


def test_whole_words(evaluate):
    rows = ["Invoice ready", "coinvoicex", "החשבונית", "חשבונית מס", "ünvoice invoice_x", "", None]
    got = evaluate([(r,) for r in rows], "x string", text.keyword_in_text(X, "invoice", True), text.keyword_in_text(X, "חשבונית"))
    assert [g[0] for g in got] == [True, False, False, False, False, False, False]
    assert [g[1] for g in got] == [False, False, False, True, False, False, False]


def test_relevance(evaluate):
    subjects = ["חשבונית מס קבלה", "תלוש שכר", "Invoice for an EMPLOYEE", "ארנונה", "hello", None]
    got = evaluate([(s,) for s in subjects], "x string", relevance.should_consider_message(X, F.lit(None).cast("string")))
    assert [g[0] for g in got] == [True, False, False, True, False, False]


def test_hints(evaluate):
    rows = ["", "Total: ₪123", "Amount 1,234.56 due", "no numeric hint here"]
    assert [g[0] for g in evaluate([(r,) for r in rows], "x string", text.text_has_amount_hint(X))] == [False, True, True, False]
    rows = ["", "Invoice # 12345", "מספר חשבונית 42", "hello world"]
    assert [g[0] for g in evaluate([(r,) for r in rows], "x string", text.text_has_invoice_id(X))] == [False, True, True, False]
    glyphs = "א" * 300 + " (cid:1) (cid:2) (cid:3) (cid:4) (cid:5) (cid:6)"
    rows = ["", "a" * 10, glyphs, "א" * 250]
    assert [g[0] for g in evaluate([(r,) for r in rows], "x string", text.needs_fallback_text(X))] == [True, True, True, False]


def test_senders(evaluate):
    rows = ["Rav-Pass by HopOn <Support@ravpass.co.il>", "support@ravpass.co.il", "alerts@example.com", "nobody", None]
    got = evaluate([(r,) for r in rows], "x string", text.sender_domain(X), text.is_trusted_sender(X))
    assert got == [("ravpass.co.il", True), ("ravpass.co.il", True), ("example.com", False), ("", False), ("", False)]


def test_vendors(evaluate):
    rows = ['מ"עב תירוביצ הרובחתל הרבח ןד', "םיכרדב תוחיטבהו הרובחתה דרשמ", "מ\"עב ן'ג-קזב", 'JUST SIMPLE LTD  -  מ" בע', "none"]
    got = [g[0] for g in evaluate([(r,) for r in rows], "x string", text.vendor_label(X))]
    assert got == ['דן חברה לתחבורה ציבורית בע"מ', "משרד התחבורה והבטיחות בדרכים", 'בזק-ג׳ן בע"מ', "JUST SIMPLE LTD", None]
    assert one(evaluate, 'JUST SIMPLE LTD  -  מ" בע', fields.normalize_invoice_for(X)) == ('JUST SIMPLE LTD - בע"מ',)


def test_redaction(evaluate):
    t = "Authorization: Bearer secret-token from /tmp/token.json via /tmp/.msal_token_cache.bin"
    assert one(evaluate, t, text.redact(X)) == ("[REDACTED_AUTH_HEADER] from [REDACTED_CREDENTIAL_PATH] via [REDACTED_TOKEN_CACHE_PATH]",)


def test_button(evaluate):
    names = [
        "פריט ניווט: חשבוניות נבחר",
        "כפתור תמיכה: סימולטור חשבוניות > לחץ לפתיחת קישור תמיכה",
        "כפתור תמיכה: חשבונית נאמן למקור לחודש מרץ 2026 > לחץ לפתיחת קישור תמיכה",
        "שאלה: איך אפשר לשלם את החשבונית?",
    ]
    assert one(evaluate, names, text.best_button(X), kind="array<string>") == (names[2],)
    assert one(evaluate, names[:1], text.best_button(X), kind="array<string>") == (None,)


def test_links(evaluate):
    redirect = "https://www.google.com/url?q=https%3A%2F%2Fexample.com%2Finv.pdf"
    assert one(evaluate, redirect, links.normalize_link(X)) == ("https://example.com/inv.pdf",)
    html = '<a href="https://example.com/doc.pdf">Download</a><a href=\'mailto:test\'>mail</a>'
    plain = f"Visit https://example.com/doc.pdf and {redirect}"
    got = evaluate([(html, plain)], "h string, p string", links.message_links(F.col("h"), F.col("p")))
    assert got[0][0] == ["https://example.com/doc.pdf", "https://example.com/inv.pdf"]
    messy = "https://myinvoice.bezeq.co.il//?/foo\\&bar=1"
    assert one(evaluate, messy, links.normalize_bill_viewer_url(X)) == ("https://myinvoice.bezeq.co.il/?/foo&bar=1",)
    rows = ["https://billing.example.com/doc", "notaurl", "https://evilexample.com"]
    assert [g[0] for g in evaluate([(r,) for r in rows], "x string", links.within_domain(X, ["example.com"]))] == [True, False, True]
    assert one(evaluate, "evilstripe.com", links.is_trusted_domain(X, ["stripe.com"])) == (False,)
    data = "data:application/pdf;base64,JVBERg=="
    rows = [data, "invalid", "data:text/plain;base64,@@@"]
    assert [g[0] for g in evaluate([(r,) for r in rows], "x string", links.decode_data_url(X))] == [b"%PDF", None, None]
    assert one(evaluate, "https://a.b/x?y=1#f", links.with_query_parameter(X, "access_token", "t")) == ("https://a.b/x?y=1&access_token=t#f",)
    kept = "https://a.b/x?access_token=old"
    assert one(evaluate, kept, links.with_query_parameter(X, "access_token", "t")) == (kept,)


def test_link_scores(evaluate):
    urls = ["https://click.news.com/x", "http://stripe.com/a", "https://pay.stripe.com/doc.pdf", "http://www.citypay.co.il/invoice"]
    s = one(evaluate, urls, links.score_links(X), kind="array<string>")[0]
    assert s["kept"] == urls[2:] and s["score"] == pytest.approx(0.7)


def test_retry_and_reasons(evaluate):
    rows = ["attach_download_fail:timeout", "RATE_LIMIT", "links_no_pdf", "generated", None]
    assert [g[0] for g in evaluate([(r,) for r in rows], "x string", relevance.is_retryable_reason(X))] == [True, True, False, True, False]
    rows = [(True, 1, 1, True), (True, 0, 1, True), (True, 0, 0, True), (False, 0, 0, True), (False, 0, 0, False)]
    got = evaluate(rows, "a boolean, f int, s int, l boolean", relevance.unsaved_reason(F.col("a"), F.col("f"), F.col("s"), F.col("l")))
    assert [g[0] for g in got] == ["attachment_processing_failed", "attachment_skipped", "attachment_no_save", "links_no_pdf", "no_attach_no_pdf_links"]


def test_document_stats(evaluate):
    pages = ["Invoice ready for review", "This page mentions payslip salary details.", "Extra invoice page"]
    full, early = one(evaluate, pages, relevance.document_stats(X), relevance.document_stats(X, stop_early=True), kind="array<string>")
    assert (full["pos_hits"], full["neg_hits"], full["neg_terms"]) == (2, 2, ["payslip", "salary"])
    assert (early["pos_hits"], early["neg_hits"]) == (1, 2)
    weak = one(evaluate, ["חשבונית קבלה חשבונית", "מספר חשבונית 12103972"], relevance.document_stats(X), kind="array<string>")[0]
    assert (weak["pos_hits"], weak["weak_hits"], weak["strong_hits"], weak["invoice_id_hint"]) == (3, 3, 0, True)
    none = one(evaluate, [], relevance.document_stats(X), kind="array<string>")[0]
    assert none["amount_hint"] is None and none["pos_hits"] == 0


def test_confidence(evaluate):
    got = evaluate([(3, 1), (0, 0), (1, 0)], "p int, n int", relevance.confidence(F.col("p"), F.col("n")))
    assert [g[0] for g in got] == [0.75, 0.0, 1.0]


def test_marker_amounts(evaluate):
    lines = ["שורה קודמת ₪ 250.00", 'סה"כ לתשלום 17%', "שורה הבאה ₪ 200.00"]
    got = one(
        evaluate, lines,
        totals.amount_around_marker(X, 'סה"כ לתשלום'),
        totals.amount_on_marker_lines(X, 'סה"כ לתשלום'),
        kind="array<string>",
    )
    assert got == (250.0, None)
    lines = ["line 1", 'מ"עמ ינפל 500.00', "line 3 200", "line 4 100"]
    assert one(evaluate, lines, totals.amounts_near_marker(X, 'מ"עמ ינפל'), kind="array<string>")[0] == [500.0, 1.0, 3.0, 200.0, 4.0, 100.0]
    lines = ['ח"שב', "1,000.00", "250", "סכנה", "7"]
    assert one(evaluate, lines, totals.numeric_block(X), kind="array<string>")[0] == [1000.0, 250.0]


def test_periodic_bill(evaluate):
    t = (
        'סה"כ חיובי החשבון לא כולל מע"מ%) 18 ( 42 . 975 { מע"מ% 18 58 . 175 { '
        'סה"כ חיובים וזיכויים לתקופת החשבון כולל מע"מ00 . 1,151 { 00 . 1,151 {סה"כ לתשלום'
    )
    got = one(evaluate, t, totals.periodic_bill_totals(X))[0]
    assert tuple(got) == (1151.0, 975.42, 175.58)


def test_classification(evaluate):
    got = one(evaluate, "חשבונית בזק שירותי אינטרנט", fields.classify(X, F.lit("בזק"), F.lit(False)))[0]
    assert tuple(got) == ("communication", 1.0, "vendor:בזק")
    got = one(evaluate, "office supplies", fields.classify(X, F.lit(None).cast("string"), F.lit(False)))[0]
    assert tuple(got) == (None, None, None)
    got = one(evaluate, "monthly BILL", fields.classify(X, F.lit("x"), F.lit(False)))[0]
    assert got["category"] == "utilities" and got["confidence"] == pytest.approx(0.765)


def test_charges(spark):
    rows = [
        (1, '{"transaction_id":"tx-1","new_value":1600,"currency":"ILS"}'),
        (2, '{"transaction_id":"tx-2","new_value":700.5,"currency":"USD"}'),
        (3, '{"new_value":"700"}'),
        (4, "{broken}"),
        (5, None),
    ]
    got = billing.receipt_candidates(billing.enrich_charges(spark.createDataFrame(rows, "id int, extra_data string"))).orderBy("id").collect()
    assert [(r["transaction_id"], r["amount"], r["currency"], r["suggested_filename"]) for r in got] == [
        ("tx-1", 16.0, "ILS", "Transaction #tx-1.pdf"),
        ("tx-2", 7.01, "USD", "Transaction #tx-2.pdf"),
        (None, None, None, ""),
        (None, None, None, ""),
        (None, None, None, ""),
    ]


def test_job_outcome(evaluate):
    got = evaluate([("success",), (" partial_failure ",)], "x string", control.job_outcome(X))
    assert [tuple(g[0]) for g in got] == [("succeeded", ""), ("failed", "collection summary status=partial_failure")]


def test_report_totals(spark):
    rows = [(100.0, 17.0), (0.0, 0.0), (None, None), (-20.0, -3.0)]
    df = spark.createDataFrame(rows, "invoice_total double, invoice_vat double")
    got = {r["metric"]: r.asDict() for r in report.report_totals(df).collect()}
    assert got["records"]["count"] == 4
    t = got["invoice_total"]
    assert (t["sum"], t["abs_sum"], t["count"], t["missing"], t["zero"], t["negative"], t["positive"], t["avg"], t["min"], t["max"]) == (
        80.0, 120.0, 2, 1, 1, 1, 1, 40.0, -20.0, 100.0,
    )
    empty = {r["metric"]: r for r in report.report_totals(df.where("false")).collect()}
    assert empty["invoice_vat"]["sum"] == 0.0 and empty["invoice_vat"]["avg"] is None
    n = report.net_vat_gross(report.report_totals(df)).collect()[0]
    assert tuple(n) == (66.0, 14.0, 80.0)


def feed_records(spark):
    rows = [
        ("c.pdf", "2001", "03/01/2026", "Vendor  B", "Service C", 70.0, 12.6, 82.6),
        ("b.pdf", "1002", "02/01/2026", "Vendor A", "Service B", 20.0, 3.6, 23.6),
        ("a.pdf", "1001", "01/01/2026", "Vendor A", "Service A", 10.0, 1.8, 11.8),
    ]
    return spark.createDataFrame(
        rows,
        "source_file string, invoice_id string, invoice_date string, invoice_from string, invoice_for string, "
        "base_before_vat double, invoice_vat double, invoice_total double",
    )


def test_report_feed(spark):
    rows = report.report_feed(feed_records(spark)).collect()
    assert [r["row_type"] for r in rows] == ["detail", "detail", "vendor_subtotal", "detail", "vendor_subtotal", "grand_total"]
    assert [r["invoice_id"] for r in rows][:2] == ["1001", "1002"]
    assert rows[2]["invoice_total"] == 35.4 and rows[4]["invoice_total"] == 82.6 and rows[5]["invoice_total"] == 118.0
    skip = report.report_feed(feed_records(spark), skip_single=True).collect()
    assert [r["row_type"] for r in skip] == ["detail", "detail", "vendor_subtotal", "detail", "grand_total"]
    plain = report.report_feed(feed_records(spark), vendor_subtotal_rows=False).collect()
    assert [r["row_type"] for r in plain] == ["detail", "detail", "detail", "grand_total"]


def test_run_status(spark):
    rows = [("1", "gmail", 0, 1.25), ("1", "outlook", 1, 2.5), ("2", "gmail", 0, 1.0), ("3", "gmail", 2, 1.0)]
    got = report.run_summary(spark.createDataFrame(rows, "run string, name string, returncode int, duration_seconds double"))
    by = {r["run"]: r for r in got.collect()}
    assert [by[k]["status"] for k in "123"] == ["partial_failure", "success", "failure"]
    assert by["1"]["successful_providers"] == ["gmail"] and by["1"]["failed_providers"] == ["outlook"]


def test_providers(spark):
    rows = [(1, "Graph, gmail,outlook"), (2, ""), (3, "gmail,imap"), (4, None)]
    got = report.normalize_providers(spark.createDataFrame(rows, "id int, raw string"), R.PROVIDER_ALIASES).orderBy("id").collect()
    assert [r["providers"] for r in got] == [["outlook", "gmail"], ["gmail", "outlook"], None, ["gmail", "outlook"]]
    assert got[2]["unknown"] == ["imap"]


def test_scoring_steps(spark):
    rows = [
        ("a", "Invoice 5", "amount due", "<p>tax invoice</p> https://stripe.com/i.pdf", "N", "x@bezeq.co.il", [("123456.pdf", "application/pdf")]),
        ("b", "hello", None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "message_id string, subject string, preview string, body string, sender_name string, sender_address string, "
        "attachments array<struct<name:string,content_type:string>>",
    )
    got = {r["message_id"]: r for r in scoring.score_messages(df, R.ScoreRules(sender_rules=R.DEFAULT_SENDER_RULES)).collect()}
    a = got["a"]
    # invoice, tax invoice, amount due and their core words: 3 hits; link .4 + .25; attachment .25
    assert a["base_confidence"] == 1.0 and a["match_confidence"] == 1.0 and a["kept_links"] == ["https://stripe.com/i.pdf"]
    assert got["b"]["match_confidence"] == 0.0


def test_descriptions(evaluate):
    def described(t):
        return one(evaluate, t, fields.invoice_for(text.extract_lines(X), X))[0]

    assert described("פירוט 2025 ספטמבר תנועה חוג") == "חוג תנועה ספטמבר 2025"
    assert described("חוג תיאטרון חודש ספטמבר\nאוגוסט חודש תיאטרון חוג") == "חוג תיאטרון חודש ספטמבר | חוג תיאטרון חודש אוגוסט"
    assert described("a םיימואלניב ןכות יתוריש b") == "שירותי תוכן בינלאומיים"
    assert described("JUST SIMPLE LTD\nתיאור\nתפעול\nפנסיוני שוטף 03/25\nכמות") == "תפעול פנסיוני- שוטף 03/25"
    assert described("פירוט חיובים וזיכויים לתקופת החשבון\nשיחות\n12\nגלישה\nסה\"כ 5") == "שיחות | גלישה"
    assert described("פירוט חיובים וזיכויים לתקופת\nהחשבון 5מנויי סלולר 1מנוי תמסורת 01-0 סה\"כ חיובי החשבון") == "5 מנויי סלולר | 1 מנוי תמסורת 01-0"
    assert described("x\n:םיטרפ\nספר\nab\nעטים\nכסה\nלא") == "ספר | עטים"
    assert described("פירוט החיובים לכל נכס:\nתיאור הפעולה\n12 מים וביוב") == "מים וביוב"
    assert described("08:00 - 09:00\nתיקון עבור לקוח") == "תיקון עבור לקוח"
    assert described("www.ravpass.co.il") == "רב-קו - טעינה"
    assert described("קבלה ארנונה לעסקים") == "ארנונה לעסקים"
    assert described("nothing here") is None


def test_city_markers(evaluate):
    rows = ["עיריית פתח תקווה", "פתח תקווה", "רב-קו", "RavKav top-up", "x"]
    got = evaluate([(r,) for r in rows], "x string", text.looks_like_petah_tikva(X), text.has_public_transport_marker(X))
    assert got == [(True, False), (False, False), (False, True), (False, True), (False, False)]


def test_repeated_totals(spark):
    rows = [(1, 60.0), (1, 60.0), (1, 70.0), (2, 10.0), (2, 55.0), (3, 1.0), (3, 2.0), (3, -5.0)]
    got = report.repeated_totals(spark.createDataFrame(rows, "k int, a double"), "k", "a")
    assert {tuple(r) for r in got.collect()} == {(1, 60.0), (2, 55.0), (3, 2.0)}


def test_window_must_end_after_it_starts(spark):
    events = spark.createDataFrame([("2025-07-01 00:00:00",), ("2025-07-02 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("event_time")
    )
    assert billing.events_between(events, "2025-07-01", "2025-07-02").count() == 1
    with pytest.raises(ValueError):
        billing.events_between(events, "2025-07-02", "2025-07-02")


def test_plain_amounts_read_like_all_others(evaluate):
    """The short way for plain tokens gives what the rules give."""
    tokens = ["12", "-12", "1,234.5", "1,234", "12.", ".5", "-", "", "12.345", "123.456", "-1,2.34", ",", "5,", "2024", "1.2.3", None]
    got = evaluate([(t,) for t in tokens], "t string", money.amount_text(F.col("t")), money.amount_spelled(F.col("t")))
    assert [a for a, _ in got] == [b for _, b in got]


def test_white_space_characters_are_those_of_the_class(spark, evaluate):
    every = [chr(c) for c in range(0x3100)]
    got = evaluate([(c,) for c in every], "t string", F.regexp_like(F.col("t"), F.lit(text.WS)))
    assert {c for c, (hit,) in zip(every, got) if hit} == set(text.WS_CHARACTERS)
    t = F.col("t")
    bodies = ["a\tb\n", " 1\n.\n2 ", "x\r\n\r\n y", "3\n4.", "5.\n6", "\u00a0a \u2028 b\x1fc", "", None, "a.\nb", "a\n\nb", "a \nb", "a\n b"]
    joined = F.regexp_replace(F.regexp_replace(t, rf"\A{text.WS}+|{text.WS}+\z", ""), rf"{text.INLINE_SPACE}*+{text.LINE_BREAK}{text.WS}*+", "\n")
    whole = F.regexp_replace(joined, text.SPLIT_DECIMAL, "$2$3$6.$1$4$5")
    got = evaluate([(x,) for x in bodies], "t string", text.merged_text(t), whole)
    assert [a for a, _ in got] == [b for _, b in got]


def test_cents_of_whole_and_of_longer_numbers(evaluate):
    values = [0.1, -0.0, 1.005, 2.675, -2.675, 1e11 + 0.25, 123456.785, 0.285, 1e13 + 0.5, 4.35, None, -19.99, 1e-9]
    rows = [(v,) for v in values]
    slow = F.round(X.cast("double").cast("decimal(38,10)"), 2).cast("double")
    got = evaluate(rows, "x double", money.round_money(X), slow)
    assert [repr(a) for a, _ in got] == [repr(b) for _, b in got]
    assert repr(got[1][0]) == "0.0" and got[2][0] == 1.01


def test_only_suspect_texts_are_cleaned(evaluate):
    texts = ["plain", "a b", "BEARER abc", "x token.json y", "x.msal.a.bin", "a.bin", "b.json", "", None]
    got = [r[0] for r in evaluate([(t,) for t in texts], "x string", text.redact(X))]
    assert got == [
        "plain", "a b", "[REDACTED_BEARER_TOKEN]", "x [REDACTED_CREDENTIAL_PATH] y",
        "[REDACTED_TOKEN_CACHE_PATH]", "a.bin", "b.json", "", None,
    ]


def test_first_position_is_found_in_one_pass_over_the_lines(evaluate):
    lines = F.col("l")
    at = fields.position_of(lines, lambda x: F.contains(x, F.lit("mark")))
    assert at._jc.toString().count("contains") == 1
    rows = [(["a", None, "mark 1", "mark 2"],), (["a", None],), ([],), (None,)]
    assert evaluate(rows, "l array<string>", at) == [(2,), (None,), (None,), (None,)]


def test_literals_are_found_like_in_the_lower_cased_text(evaluate):
    said = F.col("t")
    terms = ("ravpass", "rav kav", "parking")
    rows = [("RavPass",), ("x RAV KAV y",), ("PARKING 1",), ("rav-k",), ("",), ('סה"כ לתשלום',), ('סה״כ "כ',)]
    got = evaluate(rows, "t string", text.has_latin(said, terms), text.has_any(said, ('סה"כ', "מים")), text.vendor_label(said))
    assert [r[0] for r in got] == [True, True, True, False, False, False, False]
    assert [r[1] for r in got] == [False, False, False, False, False, True, False]
    named = [("PANGO receipt",), ("STINGTV and pango",), ("בזק-ג'ן בע\"מ",), ("Just Simple Ltd",), (None,), ("nothing",)]
    got = evaluate(named, "t string", text.vendor_label(said))
    assert [r[0] for r in got] == ["Pango", "Pango", "בזק-ג'ן בע\"מ", "JUST SIMPLE LTD", None, None]


def test_rates_with_one_and_several_names(evaluate):
    rows = [('17.5 % מע"מ',), ('מע"מ 17%\nמע"מ 0%',), ('מע"מ 17%\nvat 18%',), ("מעמ 0%",), ("VAT 1,2.3.4%",), ("17 50%",), (None,)]
    got = evaluate(rows, "t string", money.explicit_vat_rate(F.col("t")))
    assert [r[0] for r in got][:4] == [17.5, 17.0, 18.0, 0.0] and [r[0] for r in got][4:] == [None, None, None]
    numbers = [("5 12.50 סה\"כ מע\"מ",), ("מע 1 סה",), ("8.1 כ\"הס מעמ",)]
    got = evaluate(numbers, "t string", money.first_number(F.col("t"), R.VAT_PATTERNS, "ms", R.VAT_PATTERN_WORDS), money.first_number(F.col("t"), R.VAT_PATTERNS, "ms"))
    assert all(a == b for a, b in got) and got[0] == (12.5, 12.5)
