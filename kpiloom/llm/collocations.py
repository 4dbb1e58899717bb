"""Phrase collocation mining with merged stripes (operator 11).

A stripe is the counter of the words that follow one prefix; the stripe of the
empty prefix counts the words. Tasks count stripes over their own texts and
send them packed: one row holds the stripes of a block of prefixes, as lines of
phrases and their counts. Stripes are added up elementwise in the task that
their block is dealt to, and one structure gives all: an
entry is the frequency of a phrase, the entries of the empty prefix add up to
the words of a language, and the largest entry of a stripe tells whether the
prefix is always part of one longer phrase.

Prefixes grow by a word a pass. A pass reads the texts again and counts only
phrases whose first and last words (all but one) were frequent in the pass
before, told by a bit filter of bounded size: what it lets pass wrongly is
counted in full and falls below the threshold, so counts are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_rows, ship_package, small_batches

UNKNOWN = "und"
#: Least frequency and most words of a phrase, and phrases returned for each language.
MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Blocks that stripes are dealt to, and parts that a stripe is split in by its next word: hot words have many, and the
#: empty prefix, which has a vocabulary of them, is split over all blocks.
BLOCKS, PARTS = 512, 8
#: Characters of text that are counted together, and counter entries and words that a task holds before it hands them on.
CHUNK_CHARS, HELD_ENTRIES, HELD_WORDS = 8_000_000, 2_000_000, 1_000_000
#: Counter entries of one Arrow batch, and bytes of their phrases.
BATCH_ENTRIES, BATCH_BYTES = 200_000, 32_000_000
#: Bits of the filter: 16 a frequent phrase, but between these powers of two (32 MB at most).
LEAST_BITS, MOST_BITS = 16, 28

#: Fixed values of the text rule: letters lowered, separators of pieces, white space between words.
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Stands for a separator; no byte of UTF-8.
BREAK = b"\xff"
_table = bytearray(range(256))
for _c in range(65, 91):
    _table[_c] = _c + 32
for _c in SEPARATORS:
    _table[_c] = BREAK[0]
for _c in BLANKS:
    _table[_c] = 32
TABLE = bytes(_table)
_ODD = np.uint64(0x9E3779B97F4A7C15)


find_separator = re.compile("[" + SEPARATORS.decode() + "]").search


def portions(text: str) -> Iterator[str]:
    """A text in parts of about ``CHUNK_CHARS`` characters, cut behind separators, where no phrase crosses."""
    start = 0
    while len(text) - start > CHUNK_CHARS:
        found = find_separator(text, start + CHUNK_CHARS)
        if found is None:
            break
        yield text[start:found.end()]
        start = found.end()
    yield text[start:]


def stirred(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest("lang " + lang)


def grown(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return stirred(h * _ODD + word)


def phrase_hash(lang: str, words: list[str]) -> int:
    h = np.array([seed_of(lang)], np.uint64)
    for w in words:
        h = grown(h, np.array([xxhash.xxh64_intdigest(w.encode())], np.uint64))
    return int(h.astype(np.int64)[0])


class Filter:
    """Frequent phrases by their hashes: two bits each in a table of bounded size."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in (h & self.mask, h >> np.uint64(36) & self.mask):
            at = at.astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


class Words(dict):
    """Words of a task by number; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.names = [BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(word)
        return at

    def numbers(self, texts: list[str]) -> np.ndarray:
        """Numbers of the words of texts, pieces and texts parted by 0."""
        spaced = b" \xff ".join([t.encode() for t in texts]).translate(TABLE).replace(BREAK, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, spaced), np.int64, len(spaced))


def added_up(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word numbers, sorted, and the sums of their counts.

    Rows are numbered column by column, so nothing is told by a hash.
    """
    number = rows[:, 0]
    for k in range(1, rows.shape[1]):
        key = number << 32 | rows[:, k]
        found, first, number = np.unique(key, return_index=True, return_inverse=True)
    if rows.shape[1] == 1:
        found, first, number = np.unique(number, return_index=True, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, number, counts)
    return rows[first], total


class Stripes:
    """Counters of next words by (language, prefix) that a task has collected, of bounded size.

    An entry is a row of word numbers (the prefix, then the next word) with its
    count; entries of chunks are held side by side and added up when they are many.
    """

    def __init__(self, n_words: int, known: Filter | None):
        self.n_words, self.known = n_words, known
        self._clear()

    def _clear(self) -> None:
        self.words, self.hashes, self.held, self.entries = Words(), np.zeros(1, np.uint64), {}, 0

    def add(self, lang: str, texts: list[str]) -> None:
        ids, k = self.words.numbers(texts), self.n_words
        if k == 1:
            counts = np.bincount(ids, minlength=1)
            found = np.flatnonzero(counts[1:]) + 1
            rows, counts = found[:, None], counts[found]
        else:
            at = self._candidates(lang, ids)
            rows = ids[at[:, None] + np.arange(k)]
            rows, counts = added_up(rows, np.ones(len(rows), np.int64)) if len(rows) else (rows, np.empty(0, np.int64))
        if len(rows):
            self.held.setdefault(lang, []).append((rows, counts))
            self.entries += len(rows)

    def _hash_words(self) -> None:
        new = self.words.names[len(self.hashes):]
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])

    def _candidates(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Places of phrases within a piece whose two parts of one word less pass the filter."""
        k, n = self.n_words, len(ids)
        if n < k:
            return np.empty(0, np.int64)
        self._hash_words()
        # the filter is asked once a word for prefixes of one word, else once a place
        word = self.hashes[ids]
        inside = ids > 0
        if k == 2:
            passed = self.known.holds(grown(np.full(len(self.hashes), seed_of(lang), np.uint64), self.hashes))
            good = passed[ids] & inside
        else:
            h = grown(np.full(n, seed_of(lang), np.uint64), word)
            for i in range(1, k - 1):
                h = grown(h[:-1], word[i:])
                inside = inside[:-1] & (ids[i:] > 0)
            at = np.flatnonzero(inside)
            good = np.zeros(len(h), bool)
            good[at[self.known.holds(h[at])]] = True
        return np.flatnonzero(good[:-1] & good[1:])

    def full(self) -> bool:
        """True when entries or words are many, even after equal entries have been added up."""
        if self.entries > HELD_ENTRIES:
            self._add_up()
        return self.entries > HELD_ENTRIES // 2 or len(self.words) > HELD_WORDS

    def _add_up(self) -> None:
        for lang, parts in self.held.items():
            if len(parts) > 1:
                self.held[lang] = [added_up(np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts]))]
        self.entries = sum(len(r) for parts in self.held.values() for r, _ in parts)

    def _blocks(self, rows: np.ndarray) -> np.ndarray:
        """The block of each entry, by its prefix and the part that its next word is in; alike in all tasks."""
        following = self.hashes[rows[:, -1]]
        if rows.shape[1] == 1:
            return (following >> np.uint64(24)) % np.uint64(BLOCKS)
        h = following >> np.uint64(24) & np.uint64(PARTS - 1)
        for column in rows[:, :-1].T:
            h = grown(h, self.hashes[column])
        return (h >> np.uint64(24)) % np.uint64(BLOCKS)

    def hand_on(self):
        """Record batches (lang, prefix, block, nexts, counts), parts of stripes ordered by language and block; empties the counters."""
        self._add_up()
        self._hash_words()
        lengths = np.fromiter(map(len, self.words.names), np.int64, len(self.words))
        names = pa.array([b"", *self.words.names[1:]], pa.binary()).cast(pa.string())
        for lang, [(rows, counts)] in self.held.items():
            block = self._blocks(rows).astype(np.uint16)
            order = np.argsort(block, kind="stable")  # the entries of a prefix lie together already
            rows, counts, block = rows[order], counts[order], block[order]
            new = np.ones(len(rows), bool)
            new[1:] = (block[1:] != block[:-1]) | (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(rows))
            size = np.append(0, np.cumsum((lengths[rows] + 1).sum(axis=1)))
            first = 0
            while first < len(starts):  # whole parts of stripes, about BATCH_ENTRIES entries a batch
                lo = starts[first]
                last = max(first + 1, min(int(np.searchsorted(ends, lo + BATCH_ENTRIES, "right")),
                                          int(np.searchsorted(size[ends], size[lo] + BATCH_BYTES, "right"))))
                hi = ends[last - 1]
                offsets = np.append(starts[first:last], hi).astype(np.int32) - np.int32(lo)
                head = [names.take(pa.array(column)) for column in rows[starts[first:last], :-1].T]
                prefix = pc.binary_join_element_wise(*head, " ") if head else pa.array([""] * (last - first), pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (last - first), pa.string()), prefix, pa.array(block[starts[first:last]], pa.int32()),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(rows[lo:hi, -1]))), pa.ListArray.from_arrays(offsets, pa.array(counts[lo:hi]))],
                    names=["lang", "prefix", "block", "nexts", "counts"])
                first = last
        self._clear()


def packed(stripes: pa.RecordBatch) -> pa.RecordBatch:
    """Stripes of one language, ordered by block, as rows (lang, block, phrases, counts): phrases are lines, in the order of their counts."""
    lang, prefix, block, nexts, counts = stripes.columns
    phrases = nexts.values
    if prefix[0].as_py():
        phrases = pc.binary_join_element_wise(prefix.take(nexts.value_parent_indices()), phrases, " ")
    number = block.to_numpy()
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    offsets = pa.array(np.append(nexts.offsets.to_numpy()[starts], len(phrases)), pa.int32())
    return pa.RecordBatch.from_arrays([
        lang.slice(0, len(starts)), block.take(pa.array(starts)), pc.binary_join(pa.ListArray.from_arrays(offsets, phrases), "\n"),
        pa.ListArray.from_arrays(offsets, counts.values)], names=["lang", "block", "phrases", "counts"])


def _count(docs: DataFrame, n_words: int, known) -> DataFrame:
    """Packed stripes of each task's texts (text, lang)."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        stripes = Stripes(n_words, known.value if known is not None else None)
        waiting: dict[str, list] = {}
        size = 0

        def count():
            for lang, texts in waiting.items():
                stripes.add(lang, texts)
                if stripes.full():
                    yield from map(packed, stripes.hand_on())
            waiting.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in portions(text or ""):
                    waiting.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= CHUNK_CHARS:
                        yield from count()
                        size = 0
        yield from count()
        yield from map(packed, stripes.hand_on())

    return docs.select("text", "lang").mapInArrow(run, "lang string, block int, phrases string, counts array<long>")


def _merge(stripes: DataFrame) -> DataFrame:
    """Packed stripes added up elementwise: rows (lang, phrase, f).

    The parts of one stripe meet by (lang, block) and are added phrase by
    phrase in the same task, which spills if a block is large; no part is held whole.
    """
    entries = stripes.repartition("lang", "block") \
        .select("lang", "block", F.explode(F.arrays_zip(F.split("phrases", "\n").alias("phrase"), F.col("counts").alias("n"))).alias("e"))
    return entries.groupBy("lang", "block", F.col("e.phrase").alias("phrase")).agg(F.sum("e.n").alias("f")).select("lang", "phrase", "f")


def _filter(frequent: DataFrame) -> Filter | None:
    """The filter of frequent phrases; None if there are none. The driver gets 4-byte words of bits, 32 MB of them at most."""
    n = frequent.count()
    if not n:
        return None
    power = min(max((16 * n - 1).bit_length(), LEAST_BITS), MOST_BITS)
    hashed = map_rows(frequent.select("lang", "phrase"), lambda rows: ((phrase_hash(lang, p.split(" ")),) for lang, p in rows), "hash long", flush=5000)
    first, second = (x.bitwiseAND((1 << power) - 1) for x in (F.col("hash"), F.shiftrightunsigned("hash", 36)))
    words = hashed.select(F.explode(F.array(first, second)).alias("bit")) \
        .groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toPandas()
    bits = np.zeros(1 << power - 5, "<u4")
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype("<u4")
    return Filter(bits.view(np.uint8))


def phrase_counts(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, f) of all phrases of at most ``max_words`` words with f >= ``min_count``, and (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    known, counted, totals = None, [], None
    for k in range(1, max_words + 1):
        merged = _merge(_count(texts, k, known))
        if k == 1:
            merged = scratch.put(merged, "vocabulary")
            totals = merged.groupBy("lang").agg(F.sum("f").alias("n"))
        frequent = scratch.put(merged.where(F.col("f") >= min_count), f"words{k}")
        counted.append(frequent.select("lang", F.lit(k).alias("n_words"), "phrase", "f"))
        if known is not None:
            known.destroy()
        found = _filter(frequent) if k < max_words else None
        if found is None:
            break
        known = spark.sparkContext.broadcast(found)
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, subsume_percent: int = 100,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language.

    A-Z are lowered; texts part into pieces at ``[.,;:!?]``, line feeds and
    returns, pieces into words at spaces and tabs. Phrases of 2 to
    ``max_words`` words with a >= ``min_count`` are scored by their worst cut,
    floor(1000 a n / (l r)) in exact decimals (up to 38 digits), the smaller
    cut on ties; those inside a longer one that has at least
    ``subsume_percent`` of their count go. A phrase inside a longer one is
    inside one that is a word longer, at no smaller count, so only those are
    looked at. Null languages are ``und``; null and empty texts have no words;
    repeated rows count each time; the ids play no part; other columns are
    ignored, whatever their names; an empty table gives an empty result. Ties
    in score and a go by the phrase's bytes. Whole texts of any length are
    counted; a task holds about ``CHUNK_CHARS`` of them, or one longer piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    counted, totals = phrase_counts(docs, scratch, min_count, max_words, text_col, lang_col)
    counted = scratch.put(counted, "phrases")
    totals = scratch.put(totals, "totals")
    longer = counted.where("n_words > 2")
    inner = longer.select("lang", "f", F.explode(F.array(
        F.expr("left(phrase, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"),
        F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))).alias("inner"))
    most = inner.groupBy(F.col("lang").alias("lang_"), "inner").agg(F.max("f").alias("longest"))
    candidates = counted.where("n_words > 1").join(most, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inner")), "left") \
        .where(F.col("longest").isNull() | (100 * F.col("longest") < subsume_percent * F.col("f"))) \
        .select("lang", "phrase", "n_words", F.col("f").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))) \
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("tail", F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)"))
    part = lambda p: counted.select(F.col("lang").alias(f"lang_{p}"), F.col("phrase").alias(f"phrase_{p}"), F.col("f").alias(p))
    cut = cut.join(part("l"), (F.col("lang") == F.col("lang_l")) & (F.col("head") == F.col("phrase_l"))) \
        .join(part("r"), (F.col("lang") == F.col("lang_r")) & (F.col("tail") == F.col("phrase_r"))) \
        .join(totals.select(F.col("lang").alias("lang_n"), "n"), F.col("lang") == F.col("lang_n"))
    d = "decimal(19,0)"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {d}) * cast(n as {d})) div (cast(l as {d}) * cast(r as {d}))")
    scored = cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score") \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
