"""Operators 1, 2, 3 and 9: edge cases and comparison with libraries and plain code."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from kpiloom.llm import fingerprint, langid
from kpiloom.llm.bpe import WordBpe, encode_decode
from kpiloom.llm.tokencount import PieceCounter, count_tokens

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "The cat", "The cat", "<|endoftext|> x<|startoftext|>", "ΣΑΣ İ é", "日本 \U0001f600", "x" * 5000, "▁ ▁a", "\x00\u0085"]


def odd_docs(spark):
    """Nulls in every column, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en", 1, "ids") for i, t in enumerate(ODD)] + [(1, "", "en", 1, "ids"), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score string")


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = [*"abcAB 'sStre  \n\t12½ΣσςİßÅéE 你好\U0001f600<|>▁"] + ["<|endoftext|>", "<s>", "</s>", "<0x0A>", "'ll", "the ", "ing"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_the_library():
    own, lib = WordBpe.load(WORD), Tokenizer.from_file(WORD)
    for text in random_texts(3000) + [t for t in ODD if t]:
        want = lib.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_token_counts_equal_the_library():
    own, lib = PieceCounter.load(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for text in random_texts(3000) + [t for t in ODD if t]:
        assert own.count(text) == len(lib.encode(text)), text


def test_other_model_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        WordBpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_and_count_frames(spark):
    docs = odd_docs(spark)
    got = sorted(((r.doc_id is None, r.doc_id, bytes(r.ids), r.decoded) for r in encode_decode(docs, WORD).collect()), key=str)
    assert len(got) == docs.count() and sum(g[2] == b"" for g in got) == 5
    counts = count_tokens(docs, PIECE).collect()
    assert len(counts) == docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in counts if r.doc_id in (0, 1)} == {(0, 0)}
    empty = docs.where("false")
    assert encode_decode(empty, WORD).count() == 0 and count_tokens(empty, PIECE).count() == 0


def language_docs(spark):
    words = {"en": "the of and with this that there house".split(), "de": "der die und nicht schön über Haus".split(),
             "fr": "le la les été où maison dans avec".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(5, 60))), lang) for i, lang in enumerate(["en", "de", "fr"] * 80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language_id_on_held_out_rows(spark):
    docs, rows = language_docs(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].held_out == (r in held) for r in rows)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_learns_nothing_from_held_out_rows(spark):
    docs, rows = language_docs(spark)
    changed = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows], docs.schema)
    key = lambda df: sorted(map(tuple, langid.identify(df).collect()))
    assert key(docs) == key(changed)


def test_language_id_edges(spark):
    got = langid.identify(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2, 3))
    assert langid.identify(odd_docs(spark).where("false")).count() == 0
    unlabelled = odd_docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    docs, _ = language_docs(spark)
    more = docs.unionByName(spark.createDataFrame([(900, "123 !!", "en"), (901, None, "en")], docs.schema))
    assert langid.accept(more).columns == docs.columns
    assert {r.doc_id for r in more.join(langid.accept(more), "doc_id", "left_anti").collect()} == {900, 901}


def test_temperature_flattens_overconfident_scores():
    logits = np.array([[5.0, 0.0]] * 60 + [[5.0, 0.0]] * 40)
    assert langid.fit_temperature(logits, np.array([0] * 60 + [1] * 40)) > 3


def plain_imatch(texts, n_slots=2 ** 24, min_docs=2, max_share=0.05):
    """Fingerprint by text, from sets of words and a loop over every seed and rate."""
    words = lambda t: {w.lower() for w in re.findall(r"\w+", t)}
    hashed = lambda t: {xxhash.xxh64_intdigest(w) for w in words(t)}
    slot = lambda h: h * n_slots >> 64
    df = Counter(s for t in texts for s in {slot(h) for h in hashed(t)})
    band = {s for s, n in df.items() if min_docs <= n <= max(min_docs, int(max_share * len(texts)))}
    seeds = [xxhash.xxh64_intdigest(f"subset {i}") | 1 for i in range(8)]
    full = 2 ** 64 - 1

    def shown(hashes):
        if not hashes:
            return "000000"
        return f"{xxhash.xxh32_intdigest(b''.join(h.to_bytes(8, 'little') for h in hashes)) % 0xFFFFFF + 1:06x}"

    def fingerprint(text):
        terms = hashed(text)
        basis = sorted(h for h in terms if slot(h) in band) or sorted(terms) or [xxhash.xxh64_intdigest("text " + text.lower())]
        value = [{h: (((((h ^ s) * s) & full) >> 29) * 0x9E3779B97F4A7C15 & full) >> 32 for h in basis} for s in seeds]
        out = [shown(basis)]
        for k in range(1, 21):
            out += [shown(sorted((h for h in basis if v[h] <= 2 ** (32 - k)), key=lambda h: (v[h], h))) for v in value]
        return "".join(out)

    return fingerprint


def test_fingerprints_equal_plain_imatch(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)] + ["Été", "ΣΑΣ", "İx", "日本", "a_b"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", ". ", "'", "-"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "...", texts[3], "only once here", "w1" * 4000, " ".join(f"v{i}" for i in range(6000)) + " w1 w2"]
    rows = [(i, t, "en", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edited string, near_next double").repartition(4)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    texts = [t or "" for t in texts]
    plain = plain_imatch(texts)

    def like(a, b):
        if a == b:
            return 1.0
        same = told = 0
        for k in range(20, 0, -1):
            x, y = ([f[6 * (1 + 8 * (k - 1) + i):][:6] for i in range(8)] for f in (a, b))
            pairs = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != ("000000", "000000")]
            same, told = same + sum(p == q for p, q in pairs), told + len(pairs)
            if len(pairs) >= 7.2:
                break
        return same / told if told else 0.0

    for i, t in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(t) // 2
        new = t[:len(t) - half] + following[:half]
        own, changed, nxt = plain(t), plain(new), plain(following)
        r = got[i]
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(t), new, own, changed), i
        assert (r.near_edited, r.near_next) == (like(own, changed), like(own, nxt))


def test_fingerprints(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(60)] + [None, "", "!!!", "x"]
    texts += [texts[0], texts[0]]
    rows = [(i * 3 if i else None, t, 1, "f") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, fingerprint string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for i, (key, text, *_) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        r = got[key]
        assert r.n_chars == len(text or "") and r.edited == fingerprint.edited(text or "", following)
        assert r.near_next == fingerprint.likeness(r.fingerprint, got[order[(i + 1) % len(order)][0]].fingerprint)
    assert got[None].fingerprint == got[rows[-1][0]].fingerprint and got[rows[-2][0]].near_next == 1.0
    assert np.mean([r.near_edited for r in got.values()]) > 3 * np.mean([r.near_next for k, r in got.items() if k and k < 170])
    assert fingerprint.fingerprints(docs.where("false")).count() == 0


@pytest.mark.parametrize("power", [fingerprint.LEAST_SLOTS, fingerprint.MOST_SLOTS])
def test_lexicon_holds_the_slots_of_the_band(spark, monkeypatch, power):
    monkeypatch.setattr(fingerprint, "LEAST_SLOTS", power)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=40)) for _ in range(200)] + [None, "", "w1 W1", "often " * 9]
    texts = [t if i % 3 else f"often {t or ''}" for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    df = Counter(s for t in texts for s in {xxhash.xxh64_intdigest(w.lower()) >> 64 - power for w in re.findall(r"\w+", t or "")})
    for least, share in ((2, 0.05), (0, 1.0), (1, 0.0)):
        lexicon = fingerprint.build_lexicon(docs, least, share)
        assert len(lexicon.bits) == 1 << power - 3
        at = np.flatnonzero(lexicon.bits)
        got = {int(8 * i + k) for i in at for k in range(8) if lexicon.bits[i] >> k & 1}
        assert got == {s for s, n in df.items() if least <= n <= max(least, int(share * len(texts)))} and got
    assert not fingerprint.build_lexicon(docs.where("false")).bits.any()


def test_lexicon_reaches_the_driver_packed(spark):
    """Many terms of the band: the driver holds bytes of the lexicon's size, no object for each part of it."""
    halves = [" ".join(f"t{i}x{j}" for i in range(50_000)) for j in range(4)]
    docs = spark.createDataFrame([(t,) for t in halves * 2], "text string").repartition(4)
    tracemalloc.start()
    try:
        lexicon = fingerprint.build_lexicon(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.unpackbits(lexicon.bits).sum() > 190_000
    assert peak < 5 * len(lexicon.bits)


def test_likeness_does_not_fall_with_length():
    lexicon = fingerprint.Lexicon(np.full(1 << fingerprint.SLOT_BITS - 3, 255, np.uint8))
    rng = np.random.default_rng(8)
    like = {}
    for n in (100, 50_000):
        of_n = []
        for _ in range(8):
            a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
            b = a.copy()
            b[rng.permutation(n)[:n // 20]] += np.uint64(1)
            of_n.append(fingerprint.likeness(lexicon.fingerprint("", a), lexicon.fingerprint("", b)))
        like[n] = np.mean(of_n)
    assert like[50_000] > 0.6 and abs(like[50_000] - like[100]) < 0.25


def test_fingerprints_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(2, "d e f")], "doc_id long, text string")
    got = sorted((r.doc_id, r.edited) for r in fingerprint.fingerprints(docs).collect())
    assert got == [(1, "a ba "), (1, "a ba "), (1, "a bd "), (2, "d ea ")]


def test_accept_with_columns_named_like_its_own(spark):
    docs, rows = language_docs(spark)
    clash = docs.selectExpr("*", "'s' AS score", "1 AS lang_pred")
    kept = langid.accept(clash)
    assert kept.columns == clash.columns and kept.count() == len(rows)
    assert {tuple(r) for r in kept.select("score", "lang_pred").distinct().collect()} == {("s", 1)}
