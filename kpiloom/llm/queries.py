"""Queries over the test tables: each operator once, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    from .bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_imatch(spark, sf_dir):
    from .fingerprint import fingerprints

    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


def op4_jaccard_join(spark, sf_dir):
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark, sf_dir):
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_perspectives(spark, sf_dir):
    from .chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def captures(spark, sf_dir):
    """The pages as captures; the day of a fetch is derived from the page's id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def list_events(spark, sf_dir):
    """Dated list entries for about half of the pages' hosts and parent domains, derived from their names' hashes."""
    from .urlfilter import host, lookup_keys

    keys = captures(spark, sf_dir).select(F.explode(lookup_keys(host(F.col("url")))).alias("key")).distinct()
    keys = keys.where(F.col("key").contains("."))  # no bare label; example.com and the like are listed
    h = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    event = lambda action, day: F.struct(F.lit(action).alias("action"), F.date_add(start, day.cast("int")).alias("day"))
    add, gone, back = h % 200, h % 200 + 30 + h % 97, h % 200 + 80 + h % 97
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (h % 3 + 1).cast("int"))
    dated = F.concat(F.array(event("add", add)), F.when(h % 4 < 2, F.array(event("remove", gone))).otherwise(F.array()),
                     F.when(h % 8 == 0, F.array(event("add", back))).otherwise(F.array()))
    return keys.where(F.floor(h / 1000) % 2 == 0).select("key", category.alias("category"), F.inline(dated))


def op7_url_filter(spark, sf_dir):
    from .urlfilter import judge

    return judge(captures(spark, sf_dir), list_events(spark, sf_dir))


def op8_pii(spark, sf_dir):
    from .pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op9_token_count(spark, sf_dir):
    from .tokencount import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark, sf_dir):
    from .sentencepieces import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op13_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_imatch, op4_jaccard_join, op5_embedding_dedup, op6_perspectives, op7_url_filter, op8_pii,
                                   op9_token_count, op10_mixing, op11_collocations, op12_sentencepiece,
                                   op13_whitening)}
