"""Personal data in texts with built-in SQL functions only (operator 8).

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for IBANs), and context words nearby move the score. The base kinds
keep every match that passes its check; the others need ``min_score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban")

# Patterns of the base kinds. A look-behind starts each where its run of
# characters starts (or where the last match ended), and possessive repeats
# keep long runs linear; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Further proposals of the method.
NEAR_PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"

BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Scores of a proposal, and what a passed checksum adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3}
CHECKED = {"card": 0.4, "iban": 0.5}
#: Words that raise the score by ``CONTEXT`` when they stand within ``REACH`` characters, and those that lower it.
WORDS = {"email": "mail|email|contact|write", "ip": "ip|host|server|address", "card": "card|visa|mastercard|credit|pay",
         "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|transfer"}
AGAINST = "version|isbn|order|invoice|serial"
CONTEXT, REACH = 0.1, 40

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,text:string,score:double,base:boolean>"
FOUND = "array<struct<start:int,end:int,text:string,around:string>>"
#: Matches that are appended one by one; blocks of them are appended as a whole.
BLOCK = 200


def find(text: Column, pattern: str, gate: Column) -> Column:
    """All leftmost non-overlapping matches with their code point offsets; none where ``gate`` is false.

    The gaps between matches and the matches themselves alternate, so running
    lengths give the offsets. ``around`` is what stands within ``REACH``
    characters, up to the next match of the pattern on either side.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def pair(gaps: Column) -> Column:
        with_match = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.zip_with(with_match, F.slice(gaps, 2, F.size(gaps)), lambda x, after: F.struct(
            F.length(x["gap"]).alias("skip"), F.length(x["match"]).alias("size"), x["match"].alias("text"),
            F.concat_ws(" ", F.substring(x["gap"], -REACH, REACH), F.substring(after, 1, REACH)).alias("around")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["skip"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["text"].alias("text"), x["around"].alias("around"))
        return F.struct((start + x["size"]).alias("pos"), F.concat(acc["found"], F.array(span)).alias("found"))

    def blocks(parts: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            return F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["pos"].alias("pos"), none.alias("found")), step,
                               lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["found"], r["found"]).alias("found")))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(parts) / BLOCK).cast("int")),
                           F.struct(F.lit(0).alias("pos"), none.alias("found")), block, lambda acc: acc["found"])

    none = F.array().cast(FOUND)
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  evaluates value once
    return F.when(gate, bound(F.split(text, pattern, -1), lambda gaps: bound(pair(gaps), blocks))).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for digit strings whose Luhn sum ends in 0."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + F.when(
        (F.length(number) - i) % 2 == 0, F.substr(number, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(number, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(number, i, F.lit(1)).cast("int") / 5).cast("int")))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """True for IBANs of 15 to 34 characters whose check number is right."""
    plain = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        value = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(value < 65, (acc * 10 + value - 48) % 97).otherwise((acc * 100 + value - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1)


def spans(docs: DataFrame, text_col: str = "text", out: str = "spans", min_score: float = 0.5) -> DataFrame:
    """``docs`` with ``out``: the sorted spans (start, kind_no, end, kind, text, score, base) of every whole text.

    Offsets count code points, ends are exclusive. Null texts count as empty
    and have none. Base spans of all kinds stay whatever their score; added
    ones (IBANs, and phone numbers in a longer run of digits that the base
    pattern drops) stay from ``min_score`` on and only where no base span of
    their kind overlaps. Spans of different kinds may overlap. Repeated rows,
    null ids and other columns pass unchanged; a column named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def scored(kind: str, found: Column, base: bool, passed: Column | None = None) -> Column:
        def span(x: Column) -> Column:
            around = F.lower(x["around"])
            score = F.lit(SCORES[kind] + CHECKED.get(kind, 0.0)) \
                + F.when(around.rlike(rf"\b(?:{WORDS[kind]})\b"), CONTEXT).otherwise(0.0) \
                - F.when(around.rlike(rf"\b(?:{AGAINST})\b"), CONTEXT).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end"),
                            F.lit(kind).alias("kind"), x["text"].alias("text"),
                            F.round(F.least(score, F.lit(1.0)), 3).alias("score"), F.lit(base).alias("base")).cast(SPAN)

        return F.transform(found, span)

    has_digit = text.rlike("[0-9]")
    plus = F.instr(text, "+") > 0
    byte_parts = "^" + r"\.".join([BYTE_PART] * 4) + "$"
    found = docs.select(
        "*",
        find(text, EMAIL, F.instr(text, "@") > 0).alias("__email"),
        F.filter(find(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["text"].rlike(byte_parts)).alias("__ip"),
        F.filter(find(text, CARD, has_digit), lambda x: luhn(digits(x["text"]))).alias("__card"),
        F.filter(find(text, PHONE, plus), lambda x: F.length(digits(x["text"])).between(10, 15)).alias("__phone"),
        find(text, NEAR_PHONE, plus).alias("__near"),
        F.filter(find(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}")), lambda x: mod97(x["text"])).alias("__iban"))
    free = F.filter(F.col("__near"), lambda x: ~F.exists(
        F.col("__phone"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    every = F.concat(scored("email", F.col("__email"), True), scored("ip", F.col("__ip"), True),
                     scored("card", F.col("__card"), True), scored("phone", F.col("__phone"), True),
                     scored("phone", free, False), scored("iban", F.col("__iban"), False))
    kept = F.array_sort(F.filter(every, lambda x: x["base"] | (x["score"] >= min_score)))
    return found.withColumn(out, kept).drop("__email", "__ip", "__card", "__phone", "__near", "__iban")


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans as text of every row."""
    out = spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter(F.col("spans"), lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("spans"), lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first counts.

    Null texts stay null, texts without spans stay as they are; ``n_chars``,
    where there is one, is counted anew.
    """
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"),
                        F.when(x["start"] >= acc["pos"], more).otherwise(acc["out"]).alias("out"))

    new = F.aggregate(F.col("__spans"), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                      lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))
    out = spans(docs, text_col, "__spans")
    out = out.withColumn(text_col, F.when(text.isNull() | (F.size("__spans") == 0), text).otherwise(new)).drop("__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
