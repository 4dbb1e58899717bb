"""I-Match document fingerprints (operator 3).

Terms within a band of inverse document frequency, distinct and sorted, are
hashed once for each of several randomised subsets of the lexicon. The subsets
keep terms at falling rates: the fullest gives the classic all-or-nothing
fingerprint, sparse ones survive edits, so the share of equal hashes is a
likeness.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import map_rows

#: Document frequencies of the band: at least so many documents, and at most this share of them.
MIN_DOCS, MAX_SHARE = 2, 0.05
#: Lexicon slots that terms are hashed to: one for so many characters of text, which is some four times the distinct
#: terms, but between these powers of two. The bits of the band that are broadcast take 32 MB at most.
CHARS_PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 40, 24, 28
#: Bits of a slot's number in the smallest lexicon.
SLOT_BITS = LEAST_SLOTS
#: Blocks of the lexicon, 2 to this power: a task sends one row for each block in which it has terms, and so does the
#: band. A slot's place in its block must fit 16 bits.
BLOCK_BITS = 12
#: Slots that a task collects before it adds equal ones up.
HELD_SLOTS = 4_000_000
#: Rates at which the subsets keep terms, and subsets of each rate below 1. A seed's subsets are nested: each rate
#: keeps half of the terms of the rate before. Rates go on to 2^-20, so that even very long texts have sparse subsets.
RATES, OF_EACH = (1.0, *(2.0 ** -k for k in range(1, 21))), 8
DIGITS = 6
NONE = "0" * DIGITS

find_terms = re.compile(r"\w+").findall


def term_hash(term: str) -> int:
    """Hash of a lower-cased term."""
    return xxhash.xxh64_intdigest(term.lower())


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def distinct_terms(text: str) -> np.ndarray:
    """Sorted distinct 64-bit term hashes of a text's words.

    ASCII is lowered at once; other words one by one, since the lower case of
    a letter can depend on what stands around the word.
    """
    terms = set(find_terms(text.lower())) if text.isascii() else set(map(str.lower, set(find_terms(text))))
    return distinct(np.frombuffer(b"".join(map(xxhash.xxh64_digest, terms)), ">u8").astype(np.uint64))


def word_start(text: str, at: int) -> int:
    """The start of the word that ``at`` lies in or ends; ``at`` itself between words."""
    while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return at


@dataclass
class Lexicon:
    """Bits of the slots whose terms are in the band, and the subsets' seeds."""

    bits: np.ndarray
    seeds: np.ndarray = field(init=False)
    limits: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)

    def __post_init__(self):
        self.seeds = np.array([term_hash(f"subset {i}") | 1 for i in range(OF_EACH)], np.uint64)[:, None]
        self.limits = np.array([int(r * 2 ** 32) for r in RATES[:0:-1]], np.uint64)  # sparsest first
        self.shift = np.uint64(64 - (8 * len(self.bits) - 1).bit_length())

    def basis(self, text: str, terms: np.ndarray) -> np.ndarray:
        """Terms in the band; without any, all terms; without terms, the text itself as one."""
        slots = (terms >> self.shift).astype(np.int64)
        inside = terms[(self.bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)]
        if len(inside):
            return inside
        return terms if len(terms) else np.array([term_hash("text " + text)], np.uint64)

    def fingerprint(self, text: str, terms: np.ndarray) -> str:
        """Hash of all terms of the basis, then for each rate those of the seeds' subsets.

        A seed draws one value a term. In the order of these values every
        subset is a prefix, so one running hash gives a seed's subsets of all rates.
        """
        h = self.basis(text, terms)
        value = ((h ^ self.seeds) * self.seeds >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        order = np.argsort(value, axis=1, kind="stable")
        columns = []
        for v, o in zip(value, order, strict=True):
            picked = h[o]
            running, start, column = xxhash.xxh32(), 0, []
            for end in np.searchsorted(v[o], self.limits, "right").tolist():
                if end > start:
                    running.update(picked[start:end])
                    start = end
                column.append(shown(running.intdigest()) if end else NONE)
            columns.append(column[::-1])
        return shown(xxhash.xxh32_intdigest(h.tobytes())) + "".join(["".join(rate) for rate in zip(*columns, strict=True)])


def shown(digest: int) -> str:
    return f"{digest % 0xFFFFFF + 1:06x}"


def likeness(a: str, b: str) -> float:
    """Share of equal hashes, 0 to 1; 1 for equal fingerprints.

    Rates are taken from the sparsest up to the first at which most subsets
    hold terms: there a subset has few terms and its equality tells overlap.
    Hashes of subsets without terms in either do not count.
    """
    if a == b:
        return 1.0
    same = told = 0
    for rate in range(len(RATES) - 1, 0, -1):
        first = (1 + (rate - 1) * OF_EACH) * DIGITS
        filled = 0
        for i in range(first, first + OF_EACH * DIGITS, DIGITS):
            x, y = a[i:i + DIGITS], b[i:i + DIGITS]
            if x != NONE or y != NONE:
                filled += 1
                same += x == y
        told += filled
        if filled >= 0.9 * OF_EACH:
            break
    return same / told if told else 0.0


def build_lexicon(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> Lexicon:
    """The band's slots, from the document frequencies of all rows.

    Each task sums its own rows by slot and sends them packed, a row for each
    block; the band's bits are set where a block's rows meet, and the driver
    gets them as bytes, one bit a slot. With fewer than ``min_docs /
    max_share`` documents the upper end is ``min_docs``. Beyond 2 **
    MOST_SLOTS * CHARS_PER_SLOT characters several rare terms share a slot, so
    that terms of one document count as more frequent and stay in the band;
    frequent terms go as before.
    """
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("chars")).first()
    power = min(max((size["chars"] // CHARS_PER_SLOT).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    places = power - BLOCK_BITS
    low, high = max(min_docs, 1), max(min_docs, int(max_share * size["n"]))

    def count(source):
        held, waiting = [], 0
        slots, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def add_up():
            found, place = np.unique(np.concatenate([slots, *held]), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, place[:len(slots)], times)
            total += np.bincount(place[len(slots):], minlength=len(found))
            return found, total

        for (text,) in source:
            terms = distinct_terms(text or "")
            held.append(distinct((terms >> np.uint64(64 - power)).astype(np.int64)))
            waiting += len(terms)
            if waiting >= HELD_SLOTS:
                slots, times = add_up()
                held, waiting = [], 0
        slots, times = add_up()
        blocks, starts = np.unique(slots >> places, return_index=True)
        ends = [*starts[1:].tolist(), len(slots)]
        for block, start, end in zip(blocks.tolist(), starts.tolist(), ends, strict=False):
            yield block, (slots[start:end] & (1 << places) - 1).astype("<u2").tobytes(), times[start:end].astype("<u4").tobytes()

    def in_band(source):
        at, total = None, np.zeros(1 << places, np.int64)

        def packed():
            return np.packbits((total >= low) & (total <= high), bitorder="little").tobytes()

        for block, found, times in source:
            if block != at:
                if at is not None:
                    yield at, packed()
                at = block
                total[:] = 0
            total[np.frombuffer(found, "<u2")] += np.frombuffer(times, "<u4")
        if at is not None:
            yield at, packed()

    counts = map_rows(docs.select("text"), count, "block int, slots binary, times binary")
    band = map_rows(counts.repartition("block").sortWithinPartitions("block"), in_band, "block int, bits binary")
    bits = np.zeros((1 << BLOCK_BITS, 1 << places - 3), np.uint8)
    for block, of_block in band.collect():
        bits[block] = np.frombuffer(of_block, np.uint8)
    return Lexicon(bits.reshape(-1))


def in_order_with_next(docs: DataFrame, key: str, text: str, buckets_per_partition: int = 4) -> DataFrame:
    """Rows (bucket, tail, key, text) dealt by ranges of ``key`` so that each bucket ends with its successor.

    Bucket bounds are quantiles of the key; the first row of each bucket goes
    a second time, as ``tail``, to the bucket before it (that of the first
    bucket to the last one). Texts move once.
    """
    spark = docs.sparkSession
    n = buckets_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.approxQuantile(key, [i / n for i in range(1, n)], max(0.1 / n, 1e-6))
    bounds = np.unique(np.array(bounds, np.float64).astype(np.int64))

    # the key goes as text, so that null and large values stay exact
    @F.pandas_udf(IntegerType())
    def bucket_of(ids):
        values = ids.fillna("").to_numpy()
        known = np.array([v != "" for v in values], bool)
        out = np.zeros(len(values), np.int32)
        out[known] = 1 + np.searchsorted(bounds, np.array([int(v) for v in values[known]], np.int64), "right")
        return pd.Series(out)

    dealt = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), bucket_of(F.col(key).cast("string")).alias("bucket"))
    firsts = (docs.select(F.col(key), bucket_of(F.col(key).cast("string")).alias("bucket"))
              .groupBy("bucket").agg(F.min(key).alias("first")).orderBy("bucket").collect())
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    first_of = {r["bucket"]: r["first"] for r in firsts}

    @F.pandas_udf("array<int>")
    def places(buckets, ids):
        return pd.Series([[b, -1 - before[b]] if (k == "" and first_of[b] is None or k != "" and str(first_of[b]) == k) else [b]
                          for b, k in zip(buckets, ids.fillna(""), strict=True)])

    placed = dealt.withColumn("place", F.explode(places(F.col("bucket"), F.col(key).cast("string"))))
    return placed.select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"),
                         (F.col("place") < 0).alias("tail"), F.col(key), "text") \
        .repartition("bucket").sortWithinPartitions("bucket", "tail", key, "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half (floor) replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the next row by (doc_id, text), null ids first; the
    last row's is the first. Null texts are empty ones; texts without terms in
    the band are hashed over all their terms, those without terms as a whole.
    Repeated rows give one row each (a copy's next row is the copy); a single
    row is its own next; an empty table gives an empty result; other columns
    are ignored.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs))

    def rows(source):
        lex = lexicon.value

        def told(key, text):
            """The text with its fingerprint and the terms of what an edit keeps; its words are hashed once."""
            cut = len(text) - len(text) // 2
            start = word_start(text, cut)
            head = distinct_terms(text[:start])
            own = distinct(np.concatenate([head, distinct_terms(text[start:])]))
            return key, text, lex.fingerprint(text, own), (cut, start, head)

        def out(one, following):
            key, text, own, (cut, start, head) = one
            _, next_text, next_own, _ = following
            new = edited(text, next_text)
            if new == text:
                changed = own
            else:
                changed = lex.fingerprint(new, distinct(np.concatenate([head, distinct_terms(new[start:])])))
            return key, len(text), new, own, changed, likeness(own, changed), likeness(own, next_own)

        held, at = None, None
        for bucket, tail, key, text in source:
            if bucket != at:
                held, at, ended = None, bucket, False
            if ended:
                continue  # more rows of the id that opens the next bucket: the first was its successor
            one = told(key, text)
            if held is not None:
                yield out(held, one)
            held, ended = one, tail

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(in_order_with_next(docs, "doc_id", "text"), rows,
                    f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double", flush=200)
