"""Operators 6, 7 and 10: SQL of the registered queries on a small table, and edge cases."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from kpiloom.llm import chat, mixing, queries, urlfilter
from kpiloom.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


def test_rotation_renders_each_speaker(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 3, "ann", "x"), (1, 3, "ann", "x"), (2, 0, "system", "only"),
            (None, None, "cy", "q"), (3, 0, None, "n"), (3, 600, "ann", "late")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "cy", None), (3, "ann", 0), (3, "ann", 1)}
    r = got[1, "ann", 0]
    assert r.text == ("<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhé<|im_end|>\n"
                      "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n")
    assert [r.text[int(a):int(b)] for a, b in (s.split(":") for s in r.trained.split(","))] == ["hé<|im_end|>", "x<|im_end|>"]
    assert got[3, "ann", 0].trained == "" and got[3, "ann", 0].text.startswith("<|im_start|>user\nn")
    assert chat.rotate(df.where("false")).count() == 0


def test_lists_hold_as_of_the_fetch(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    events = spark.createDataFrame([("a.com", "spam", "add", day(10)), ("a.com", "spam", "remove", day(20)), ("a.com", "spam", "add", day(300)),
                                    ("x.a.com", "adult", "add", day(0)), ("b.com", "spam", "add", day(5)), ("b.com", "spam", "remove", day(5)),
                                    (None, "spam", "add", day(0)), ("c.com", "spam", "add", None)],
                                   "key string, category string, action string, day date")
    rows = [(1, "http://A.com./p", day(9)), (2, "http://a.com", day(10)), (3, "https://u@a.com:80/", day(19)), (4, "http://a.com", day(20)),
            (5, "http://x.a.com/", day(12)), (6, "http://b.com", day(5)), (7, None, day(5)), (8, "http://a.com", None), (9, "nonsense", day(1)),
            (None, "http://a.com", day(400)), (2, "http://a.com", day(10))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, fetched date, key string")
    got = {r.page_id: (r.n_active, r.blocked, r.entry) for r in urlfilter.judge(df, events, bucket_days=7).collect()}
    assert got == {1: (0, False, None), 2: (1, True, "a.com"), 3: (1, True, "a.com"), 4: (0, False, None), 5: (2, True, "x.a.com"),
                   6: (0, False, None), 7: (0, False, None), 8: (0, False, None), 9: (0, False, None), None: (1, True, "a.com")}
    assert urlfilter.judge(df.where("false"), events).count() == 0
    assert not any(r.blocked for r in urlfilter.judge(df, events.where("false")).collect())


def test_raked_shares_meet_the_targets(spark, docs_of):
    texts = [("a | b " if i % 3 else "plain words here ") * (1 + i % 7) for i in range(300)] + [None, ""]
    docs = docs_of(texts).selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) lang", "if(doc_id < 200, 's0', source) source",
                                     "1 as tokens", "'t' as topic")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    total = sum(r.tokens for r in rows)
    for dim, power in mixing.POWERS.items():
        mass = {}
        for r in rows:
            have, raked = mass.get(r[dim], (0, 0))
            mass[r[dim]] = have + r.tokens / total, raked + r.tokens / total * r.weight
        goal = sum(h ** power for h, _ in mass.values())
        for have, raked in mass.values():
            assert abs(raked - have ** power / goal) < 0.01
    assert abs(sum(r.tokens * r.prob for r in rows) / total - mixing.RATE) < 0.01
    drawn = {r.doc_id for r in rows if r.sampled}
    assert {r.doc_id for r in mixing.sample(docs).collect()} == drawn and mixing.sample(docs).columns == docs.columns
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.sample(docs.where("false")).count() == 0


def test_hosts_and_their_keys(spark):
    urls = ["http://[2001:DB8::1]:80/p", "https://user@[::1]/", "http://a.example.com:8080/x", "http://example.com./", "http://localhost/", "no url", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r.i: (r.h, r.k) for r in df.select("i", urlfilter.host(df.url).alias("h"), urlfilter.lookup_keys(urlfilter.host(df.url)).alias("k")).collect()}
    assert got[0] == ("[2001:db8::1]", ["[2001:db8::1]"]) and got[1][0] == "[::1]"
    assert got[2] == ("a.example.com", ["a.example.com", "example.com"]) and got[3] == ("example.com", ["example.com"])
    assert got[4] == ("localhost", ["localhost"]) and got[5][0] is None and got[6][0] is None


def test_parent_domains_are_listed(spark):
    listed = {r.key for r in queries.list_events(spark, "/root/testdata/sf0.001").select("key").distinct().collect()}
    assert listed and any(k.count(".") == 1 for k in listed)
