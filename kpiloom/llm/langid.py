"""Language identification (operator 1).

Sparse multinomial logistic regression on TF-IDF character 1- to 3-grams,
trained by follow-the-regularised-leader with elastic-net penalties and then
calibrated with one temperature on rows kept out of the training.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

#: Slots that the character n-grams are hashed to; bounds the model and the counts sent to the driver.
SLOTS = 1 << 15
#: Most labelled documents of one language that the classifier is fitted on (the stated bound of its sample).
PER_CLASS = 1500
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a whole text's letter n-grams; empty when it has no letters.

    Letters are lower-cased; each run of other characters counts as one space.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = letter_table()[codes]
    if not letters.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    c = np.concatenate(([32], np.where(letters, codes, 32)[keep], [32])).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    hashed = [(x * np.uint32(0xC2B2AE35) ^ x >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(17)
              for x in (c[1:-1] + np.uint32(7), two + np.uint32(77), three + np.uint32(777))]
    counts = np.bincount(np.concatenate(hashed), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, counts[slots]


def tfidf(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[slots]
    size = np.sqrt((x * x).sum())
    return x / size if size else x


@dataclass
class LangModel:
    """Languages, IDF by slot, weights (languages x slots), biases and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        slots, counts = ngrams(text or "")
        if not len(slots) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax((self.weights[:, slots] @ tfidf(slots, counts, self.idf) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, alpha: float = 1.0, beta: float = 1.0,
               l1: float = 0.02, l2: float = 0.1, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after follow-the-regularised-leader over sparse rows, in their order."""
    z, n = np.zeros((n_langs, SLOTS + 1)), np.zeros((n_langs, SLOTS + 1))  # the last column is the bias

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(passes):
        for slots, x, lang in rows:
            at, x = np.append(slots, SLOTS), np.append(x, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            error = softmax(w @ x)
            error[lang] -= 1.0
            g = error[:, None] * x
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[:, at] = more
    w = weights(z, n)
    return w[:, :-1], w[:, -1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Temperature with the least negative log likelihood, by golden-section search over its logarithm.

    The targets are smoothed by one row in all (Platt's prior), so that rows
    without an error do not call for a temperature of zero.
    """
    rows, kinds = logits.shape
    wrong = 1.0 / (rows + 2)
    target = np.full(logits.shape, wrong / max(kinds - 1, 1))
    target[np.arange(rows), truth] = 1.0 - wrong

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> LangModel:
    """Fit on the labelled rows of ``docs`` (doc_id, text, lang) that are not held out.

    The IDF counts cover every such row with letters. The classifier is fitted
    on at most ``per_class`` rows of each language, those of the smallest id
    hash; a fifth of them, by another hash, only sets the temperature. What
    reaches the driver is bounded by ``SLOTS`` counts and ``per_class`` rows of
    n-gram counts for each language, whatever the input.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)

    def count(source):
        df, n = np.zeros(SLOTS, np.int64), 0
        for (text,) in source:
            slots, _ = ngrams(text or "")
            df[slots] += 1
            n += len(slots) > 0
        yield -1, n
        for s in np.flatnonzero(df):
            yield int(s), int(df[s])

    idf, total = np.zeros(SLOTS), 0
    found = map_rows(rows.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    for slot, n in zip(found["slot"], found["n"], strict=True):
        if slot < 0:
            total = n
        else:
            idf[slot] = n
    idf = np.where(idf > 0, np.log((1.0 + total) / (1.0 + idf)) + 1.0, 0.0)
    if not langs:
        return LangModel([], idf, np.zeros((0, SLOTS)), np.zeros(0), 1.0)

    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 1.2 * per_class / sizes[lang] + 1e-9))])
    near = rows.withColumn("h", order).where((F.col("h").cast("double") / 2.0 ** 64 + 0.5) <= share[F.col("lang")])

    def features(source):
        for lang, key, text in source:
            slots, counts = ngrams(text or "")
            if len(slots):
                yield lang, key, slots.astype("<i4").tobytes(), counts.astype("<i4").tobytes()

    sample = map_rows(near.select("lang", "h", "text"), features, "lang string, h long, slots binary, counts binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "slots", "counts"))
    picked = sample.withColumn("r", first).where(F.col("r") <= per_class).drop("r").collect()
    learn, check = [], []
    for r in sorted(picked, key=lambda r: (r["h"], r["lang"], bytes(r["slots"]))):
        slots, counts = np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i4")
        (check if r["h"] % 5 == 0 else learn).append((slots, tfidf(slots, counts, idf), langs.index(r["lang"])))
    weights, bias = train_ftrl(learn or check, len(langs))
    t = 1.0
    if check:
        logits = np.stack([weights[:, s] @ x + bias for s, x, _ in check])
        t = fit_temperature(logits, np.array([y for _, _, y in check]))
    return LangModel(langs, idf, weights, bias, t)


def predict(docs: DataFrame, model: LangModel, keep: list[str], lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred`` and ``score`` (calibrated, 0 to 1; or by other names) from its text alone.

    Null texts, texts without letters and a model without languages give
    ``und`` and 0. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = len(keep)

    def rows(source):
        for row in source:
            yield *row[:at], *held.value.predict(row[at])

    schema = docs.select(*keep).schema
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    text = F.col("text").alias("__text")
    return map_rows(docs.select(*keep, text), rows, f"{head}, `{lang_name}` string, `{score_name}` double")


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    Null ids are never held out (their text is empty). Repeated ids and rows
    give one row each; with no labelled row, or an empty table, nothing is
    learned and every prediction is ``und`` with score 0. Ties between
    languages go to the first by name; other columns are ignored.
    """
    model = fit(docs, per_class)
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, over_chance: float = 1.05, per_class: int = PER_CLASS) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is told; the others go.

    Rejected are texts without letters (null and empty ones too) and those
    whose score is below ``over_chance`` times that of a blind guess among the
    learned languages. With one language or none learned, only the first rule holds.
    """
    model = fit(docs, per_class)
    keep, kinds = docs.columns, len(model.langs)
    if not kinds:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = predict(docs, model, keep, "__lang_pred", "__score")
    least = over_chance / kinds if kinds > 1 else 0.0
    return told.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least)).select(*keep)
