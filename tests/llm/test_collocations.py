"""Operator 11 against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kpiloom.llm import collocations as C
from kpiloom.llm import queries
from kpiloom.llm.common import Scratch


def plain(rows, min_count, max_words=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    candidates = {key for key, a in f.items() if a >= min_count and len(key[1]) > 1}
    inside = {}
    for lang, words in candidates:
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, words[i:i + k]
                inside[key] = max(inside.get(key, 0), f[lang, words])
    out = {}
    for lang, words in candidates:
        a = f[lang, words]
        if 100 * inside.get((lang, words), 0) >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                                    for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, n[lang]))
    return sorted((lang, rank, p.decode(), -a, left, right, m, -s) for lang, found in out.items()
                  for rank, (s, a, p, left, right, m) in enumerate(sorted(found)[:top], 1))


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(n=400, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "été", "日本", "x y", "a-b", "\x85", "'s", "Ä", "to", "be"]
    fixed = ["in the  city of new york", "to\tbe or not to be", "the the the the"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 7))))
        rows.append(("".join(p + rng.choice([". ", ", ", "\n", "\r\n", "! ", " ", "?", "\x0b"]) for p in parts), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t.", "en"), ("alone " * 3000, "de")]


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(5)


@pytest.mark.parametrize("min_count,top", [(10, 2000), (25, 7)])
def test_equals_plain_counting(spark, min_count, top):
    rows = made()
    want = plain(rows, min_count, top=top)
    assert len({w[0] for w in want}) == 4 and len(want) > 15
    assert told(C.collocations(frame(spark, rows), min_count=min_count, top=top)) == want


def test_bounds_on_what_a_task_holds_change_nothing(spark, monkeypatch):
    rows = made(150, 5)
    want = plain(rows, 8)
    import kpiloom.llm.collocations as module

    stripes = module.Stripes(1, None)  # small bounds: many chunks, hand-ons and batches in one process
    monkeypatch.setattr(module, "CHUNK_CHARS", 200)
    monkeypatch.setattr(module, "HELD_ENTRIES", 5)
    monkeypatch.setattr(module, "BATCH_ENTRIES", 3)
    got = Counter()

    def take(batches):
        for batch in batches:
            for r in batch.to_pylist():
                assert r["prefix"] == "" and len(r["nexts"]) == len(r["counts"]) > 0
                got.update({(r["lang"], w): n for w, n in zip(r["nexts"], r["counts"])})

    for text, lang in rows:
        for part in module.portions(text or ""):
            stripes.add(lang or "und", [part])
            if stripes.full():
                take(stripes.hand_on())
    take(stripes.hand_on())
    sums = Counter()
    for (lang, _), n in got.items():
        sums[lang] += n
    assert {w[6] for w in want if w[0] == "en"} == {sums["en"]}


def test_phrases_of_one_word_less_and_hot_prefix(spark):
    # one prefix holds most rows and has very many next words
    rows = [(f"the w{i % 700}. the same thing. the same thing", "en") for i in range(1400)]
    assert told(C.collocations(frame(spark, rows))) == plain(rows, 100)


def test_scores_beyond_64_bits(spark):
    counted = [("en", 1, "a", 3 * 10 ** 12), ("en", 1, "b", 10 ** 11 + 7), ("en", 2, "a b", 10 ** 11 + 1)]
    a, left, right, n = 10 ** 11 + 1, 3 * 10 ** 12, 10 ** 11 + 7, 9 * 10 ** 12

    def counts(docs, scratch, *args):
        return (spark.createDataFrame(counted, "lang string, n_words int, phrase string, f long"),
                spark.createDataFrame([("en", n)], "lang string, n long"))

    real, C.phrase_counts = C.phrase_counts, counts
    try:
        got = told(C.collocations(frame(spark, [])))
    finally:
        C.phrase_counts = real
    assert 1000 * a * n > 2 ** 64
    assert got == [("en", 1, "a b", a, left, right, n, 1000 * a * n // (left * right))]


def test_empty_and_short_tables(spark):
    assert told(C.collocations(frame(spark, []))) == []
    assert told(C.collocations(frame(spark, [(None, None), ("one two", "en")]))) == []


def test_rows_add_up():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 4, (500, 3))
    n = rng.integers(1, 9, 500)
    want = Counter()
    for r, c in zip(rows.tolist(), n.tolist()):
        want[tuple(r)] += c
    got, total = C.added_up(rows, n)
    assert dict(zip(map(tuple, got.tolist()), total.tolist())) == want
    one, total = C.added_up(rows[:, :1], n)
    assert one[:, 0].tolist() == [1, 2, 3] and total.sum() == n.sum()


def test_filter_passes_all_it_holds(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([("en", w) for w in words], "lang string, phrase string")
    f = C._filter(df)
    h = np.array([C.phrase_hash("en", [w]) for w in words], np.int64).view(np.uint64)
    assert f.holds(h).all()
    other = np.array([C.phrase_hash("fr", [w]) for w in words], np.int64).view(np.uint64)
    assert f.holds(other).mean() < 0.05


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert told(queries.op11_collocations(spark, sf)) == plain(rows, 100)


def test_a_task_sends_a_row_for_each_block_not_each_prefix(spark):
    rows = [(" ".join(f"p{i % 2000}" for i in range(j * 37, j * 37 + 300)) + ". x  y\tz", lang) for j, lang in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    known = spark.sparkContext.broadcast(C.Filter(np.full(1 << 13, 255, np.uint8)))  # passes all
    for k in (2, 3):
        want = Counter()
        for text, lang in rows:
            for piece in text.split("."):
                words = piece.split()
                want.update((lang, " ".join(words[i:i + k])) for i in range(len(words) - k + 1))
        assert len(want) > 3000
        stripes = C._count(docs, k, known)
        assert stripes.count() <= 2 * 512
        got = C._merge(stripes).collect()
        assert len(got) == len(want) and {(r.lang, r.phrase): r.f for r in got} == want


def test_batches_of_long_phrases_change_nothing(spark, monkeypatch):
    stripes = C.Stripes(2, C.Filter(np.full(1 << 13, 255, np.uint8)))
    text = " ".join("w" * (i % 7 + 1) + str(i % 90) for i in range(2000))
    stripes.add("en", [text])
    monkeypatch.setattr(C, "BATCH_BYTES", 200)
    batches = [C.packed(b) for b in stripes.hand_on()]
    words, got = text.split(), Counter()
    for b in batches:
        for r in b.to_pylist():
            got.update(dict(zip(r["phrases"].split("\n"), r["counts"], strict=True)))
    assert len(batches) > 10 and got == Counter(map(" ".join, zip(words, words[1:])))
