"""Operator 8 against a brute-force reading of its definition."""

import hashlib
import random
import re

from kpiloom.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), k, list(BASE)[k], m.end()) for k, p in enumerate(BASE.values())
             for m in re.finditer(p, text) if good(list(BASE)[k], m.group())]
    return sorted(found)


def texts(n=400, seed=5):
    rng = random.Random(seed)
    parts = ["a.b@c-d.example.com", "x@y", "@", "a@b.c_x@d.e", "1.2.3.4", "999.1.2.3.4.5", "0001.2.3.255", "1.2.3.4.5.6.7.8",
             "4524132264652876", "4524 1322-6465 2876", "4524  1322", "+1 (269) 555-3296", "+1 ", "+", "12", " ", "-", ".", "é", "\U0001f600",
             "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "\n", "word", "9", "visa ", "4111111111111111", "_", "%", "version "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


def check(spark, rows):
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    assert len(got) == len(rows)
    for key, text in ((r[0], r[1]) for r in rows):
        want, r = brute(text or ""), got[key]
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (text, line, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in BASE]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_equal_brute_force(spark):
    check(spark, [(i, t, 0) for i, t in enumerate([None, "", *texts()])])


def test_long_runs_stay_linear(spark):
    """Counts are known here: the plain patterns themselves are quadratic on such runs."""
    rows = [(0, "a" * 200_000), (1, "1" * 200_000), (2, "1 " * 100_000), (3, "a." * 50_000 + "@b" + ".c" * 20_000),
            (4, "1." * 20_000), (5, "+1" + "-" * 200_000), (6, "A1" * 50_000)]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone)
           for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (int(i == 3), 5000 * (i == 4), 0, 0) for i in range(7)}


def test_added_spans_and_scores(spark):
    rows = [(0, "iban GB82 WEST 1234 5698 7654 32 ok", 0), (1, "GB83WEST12345698765432", 0), (2, "+1 (269) 555-3296 4524132264652876", 0)]
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()}
    assert got[0].spans == "iban:5:32" and got[1].spans == ""
    assert got[2].n_phone == 0 and "phone:0:17" in got[2].spans.split(",")  # the base pattern takes both numbers as one


def test_redact_keeps_columns_and_the_rest_of_the_text(spark):
    df = spark.createDataFrame([(0, "é mail a@b.com, +1 (269) 555-3296!", 99, "x"), (1, None, None, "y"), (2, "plain", 5, None)],
                               "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[0].text == "é mail [EMAIL], [PHONE]!" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2] == (2, "plain", 5, None)


def test_empty_table(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
