"""Byte-pair encoding and decoding with a segment tree over pair ranks (operator 2).

The leaves of the tree are the adjacent pairs of a word's symbols, each with
its merge rank and place; a node holds the smaller of its two children, so the
root yields the leftmost pair of the lowest rank. A merge changes three leaves,
each in logarithmic time, until the root says that no pair can be merged.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WordCache, map_rows

#: No mergeable pair.
NONE = 1 << 62
#: Characters that all Unicode versions in use treat alike; texts with others are split into words by the library.
COMMON = "[\x00-\u052f\u2010-\u205e\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class WordBpe:
    """Encoder and decoder for a tokenizers file of lower-cased words with an end-of-word mark.

    The file must hold: BPE with ``end_of_word_suffix``; normaliser NFC, white
    space, lower case; a word pattern that is kept, then byte level; special
    tokens that match as they are. Other files raise ValueError.
    """

    def __init__(self, spec: dict):
        self.spec = spec
        model = spec["model"]
        kinds = [x["type"] for part, steps in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
                 for x in (spec[part] or {}).get(steps, [])]
        if (model["type"], *kinds) != ("BPE", "NFC", "Replace", "Lowercase", "Split", "ByteLevel") or spec["decoder"] or model["unk_token"]:
            raise ValueError("not a lower-cased word BPE file")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = max([*vocab.values(), *special.values()]) + 1
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else m.split(" ") for m in model["merges"]):
            self.rank[vocab[a] * self.width + vocab[b]] = r
            self.made.append(vocab[a + b])
        letters = byte_alphabet()
        self.inner, self.last = {c: vocab[c] for c in letters}, {c: vocab[c + self.suffix] for c in letters}
        self.tokens = [""] * self.width
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.special = {t: np.uint32(i).astype("<u4").tobytes() for t, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.joined = {t[i:i + 2] for t in (x.removesuffix(self.suffix) for x in vocab) for i in range(len(t) - 1)}
        self.letters = letters
        self.common = re.compile(COMMON).fullmatch
        self.library = None
        self.cache = WordCache(self.encode_word, 250_000)
        self.parts = WordCache(self.merge, 200_000)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __reduce__(self):
        return WordBpe, (self.spec,)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split is None or "<" not in text and not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(self.special[part] if part in self.special else self._plain(part) for part in self.split(text))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not self.common(text):
                return self._rare(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is not told apart
        return b"".join(map(self.cache.__getitem__, self.words(text.lower())))

    def _rare(self, text: str) -> bytes:
        """Words of a text whose characters differ between Unicode versions, as the library finds them."""
        if self.library is None:
            self.library = Tokenizer.from_str(json.dumps(self.spec))
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self.encode_shown(word) for word, _ in shown)

    def encode_word(self, word: str) -> bytes:
        letters = self.letters
        return self.encode_shown("".join([letters[b] for b in word.encode()]))

    def encode_shown(self, shown: str) -> bytes:
        """Ids of a word in the byte alphabet; no merge crosses neighbours that no token holds together."""
        joined, start, out = self.joined, 0, b""
        for i in range(1, len(shown)):
            if shown[i - 1:i + 1] not in joined:
                out += self.parts[shown[start:i]]
                start = i
        return out + self.parts[shown[start:] + "\n"]  # the line break stands for the end-of-word mark

    def merge(self, part: str) -> bytes:
        width, rank, made = self.width, self.rank, self.made
        if part[-1] == "\n":
            ids = [self.inner[c] for c in part[:-1]]
            ids[-1] = self.last[part[-2]]
        else:
            ids = [self.inner[c] for c in part]
        n = len(ids)
        size = 1 << max(n - 2, 0).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank.get(ids[i] * width + ids[i + 1])
            if r is not None:
                tree[size + i] = r << 40 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < NONE:
            r, i = tree[1] >> 40, tree[1] & (1 << 40) - 1
            j = after[i]
            k, p = after[j], before[i]
            ids[i], ids[j], after[i] = made[r], -1, k
            if j < n - 1:
                put(j, NONE)
            value = NONE
            if k < n:
                before[k] = i
                r = rank.get(ids[i] * width + ids[k])
                if r is not None:
                    value = r << 40 | i
            put(i, value)
            if p >= 0:
                r = rank.get(ids[p] * width + ids[i])
                put(p, NONE if r is None else r << 40 | p)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by a space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of every whole text.

    Null and empty texts give no ids and an empty decoded text. Null or
    repeated ids and repeated rows give one row each; other columns are
    ignored; an empty table gives an empty result. No shuffle; the vocabulary
    (as large as its file) goes out as one broadcast.
    """
    bpe = docs.sparkSession.sparkContext.broadcast(WordBpe.load(file))

    def rows(source):
        b = bpe.value
        for key, text in source:
            ids = b.encode(text or "")
            yield key, ids, b.decode(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), rows,
                    f"`{id_col}` {kind}, ids binary, decoded string")
