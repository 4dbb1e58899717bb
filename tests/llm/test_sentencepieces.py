"""Operator 12 against the sentencepiece library."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from kpiloom.llm import queries, sentencepieces
from kpiloom.llm.sentencepieces import PieceCodec, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "The cat", "The cat", "<s> x</s><unk>", "日本 \U0001f600", "x" * 70_000, "ab " * 30_000, "▁ ▁a", "\x00\u0085", "    deep\t\tin"]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


def test_encoding_equals_the_library(codec):
    rng = random.Random(7)
    pool = [*"abcAB 'sStre  \n\t12½ΣσςİßÅéE 你好\U0001f600<|>▁", "<s>", "</s>", "<0x0A>", "the ", "ing", "▁▁▁", "      "]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pool += ["\n", "\n\n", " \n"]
    for text in ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(4000)] + [t for t in ODD if t]:
        want = lib.encode(text)
        got = codec.encode(text)
        assert got.tolist() == want, text
        assert codec.decode(got.tolist()) == lib.decode(want), text


def test_decoding_of_any_ids_equals_the_library(codec):
    rng = random.Random(8)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(6000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_equal_scores_are_joined_from_the_left(codec):
    best = {}
    for piece, place in codec.order.items():
        best.setdefault(place, []).append(piece)
    assert max(map(len, best.values())) > 1  # the model has equal scores
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for n in range(1, 40):
        assert codec.encode(" " * n).tolist() == lib.encode(" " * n)


def test_frame_of_odd_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(1, "", "x", 1), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = encode_decode(docs, MODEL).collect()
    assert len(got) == len(rows) and all(r.agrees for r in got)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in got:
        text = "no id" if r.doc_id is None else (ODD[r.doc_id] or "")
        assert r.ids == lib.encode(text) and r.decoded == lib.decode(lib.encode(text))
    assert encode_decode(docs.where("false"), MODEL).count() == 0


def test_long_texts_share_a_batch(spark, monkeypatch):
    monkeypatch.setattr(sentencepieces, "BATCH_CHARS", 50)
    assert list(sentencepieces._slices(["a" * 30, "b" * 30, "", "c" * 100, "d"])) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(sentencepieces._slices([])) == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        PieceCodec(str(tmp_path / "none.model"))


def test_query_digests(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_places_of_pairs_and_bytes_of_ids_are_known_beforehand(codec):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [lib.id_to_piece(i) for i in range(259, lib.get_piece_size())]
    assert set(codec.joined) >= {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    assert all(place == codec.order.get(pair, sentencepieces.NONE) for pair, place in codec.joined.items())
    assert all(int.from_bytes(codec.packed[p], sys.byteorder) == lib.piece_to_id(p) for p in pieces)


def _pool_texts(seed, n):
    rng = random.Random(seed)
    pool = [*"abcAB 'sStre  \n\t12½ΣσςİßÅéE 你好\U0001f600<|>▁", "<s>", "the ", "ing", "▁▁▁", "tion", " \n", "internationalisation", "你好" * 20]
    return ["".join(rng.choices(pool, k=rng.randint(0, 80))) for _ in range(n)] + [t or "" for t in ODD]


@pytest.mark.parametrize(("words", "chars"), [(400_000, 100_000), (50, 7)])
def test_texts_encoded_together_equal_the_library(monkeypatch, words, chars):
    monkeypatch.setattr(sentencepieces, "WORDS", words)  # a small number: words are dropped and joined again
    monkeypatch.setattr(sentencepieces, "PART_CHARS", chars)
    codec = PieceCodec(MODEL)
    lib = codec.library
    for seed in (1, 2, 1):
        texts = _pool_texts(seed, 700)
        ids, ends = codec.encode_all(texts)
        want = [lib.encode(t) for t in texts]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
        assert codec.decode_all(ids, ends) == [lib.decode(w) for w in want]
    assert [len(x) for x in codec.encode_all([])] == [0, 0]
    assert [x.tolist() for x in codec.encode_all(["", ""])] == [[], [0, 0]]


def test_any_ids_decoded_together_equal_the_library(codec):
    rng = random.Random(9)
    rows = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 9))] for _ in range(4000)]
    ids = np.array([i for r in rows for i in r], np.int32)
    assert codec.decode_all(ids, np.cumsum([len(r) for r in rows])) == [codec.library.decode(r) for r in rows]
    assert codec.decode_all(ids[:0], np.zeros(2, np.int64)) == ["", ""]


def test_new_short_words_are_joined_side_by_side_and_once(monkeypatch):
    codec = PieceCodec(MODEL)
    rng = random.Random(10)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 23))) for _ in range(3000)})
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(3)]
    fresh = {b" " + w.encode() for w in words} - codec.held.keys()  # the probes held some
    seen, new = [], codec._new
    monkeypatch.setattr(codec, "_new", lambda w: (seen.extend(w), new(w))[1])
    monkeypatch.setattr(codec, "_agenda", None)  # no agenda of a single word
    for _ in range(2):
        ids, ends = codec.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [codec.library.encode(t) for t in texts]
    assert sorted(seen) == sorted(fresh)


def test_pair_table_holds_every_pair_and_no_other(codec):
    n = codec.library.get_piece_size() + 1
    pairs = {(codec.ids[p[:k]], codec.ids[p[k:]]): i for p, i in codec.ids.items() for k in range(1, len(p)) if p[:k] in codec.ids and p[k:] in codec.ids}
    table = sentencepieces.PairTable(pairs, n)
    left, right = np.array([*pairs], np.int32).T
    assert table(left, right).tolist() == [*pairs.values()]
    rng = np.random.default_rng(11)
    left, right = rng.integers(0, n, (2, 200_000), np.int32)
    assert table(left, right).tolist() == [pairs.get(p, -1) for p in zip(left.tolist(), right.tolist(), strict=True)]
    assert sentencepieces.PairTable({}, n)(left[:3], right[:3]).tolist() == [-1, -1, -1]


def test_a_model_with_pieces_across_words_takes_whole_texts():
    codec = PieceCodec(MODEL)
    codec.by_words = False
    texts = _pool_texts(3, 200)
    ids, ends = codec.encode_all(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [codec.library.encode(t) for t in texts]
