"""N-gram Jaccard similarity join by chosen paths (operator 4).

Each document is the set of its word shingles; equal sets are one node. Every
run deals the nodes to buckets by a token that they share with a probability
of their Jaccard similarity (a min-hash), and splits buckets that are too
large by further tokens, each chosen by the bucket's path. Small buckets are
compared by brute force over the sketches, and runs repeat until the target
recall. Nodes that a conservative sketch test leaves together are then compared
exactly, over their whole sets, block by block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordCache, map_groups, map_rows
from .components import components, forest

WORDS, THRESHOLD = 5, 0.8
#: Min-hashes of a set's sketch; the sketch test lets pass what agrees in PASS of them (at 0.8, all but 2 in a million pairs).
SKETCH, PASS = 64, 36
#: Buckets of at most LEAF nodes are compared; larger ones are split, at most DEPTH times in all, and then dealt in blocks.
LEAF, DEPTH = 256, 4
#: Share of the pairs at the threshold that some run must bring together, even in a bucket of the last level.
RECALL = 0.9998
#: Least and most nodes of a block of the exact comparison; a large class has about BLOCKS of them.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 64, 4096, 32

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2 ** 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2 ** 63, SKETCH, dtype=np.uint64)


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is missed with at most ``1 - recall``."""
    return min(SKETCH, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** DEPTH)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(text: str, cache: WordCache, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    Words are lower-cased and separated by white space; a text of fewer than
    ``words`` words is one shingle, one without words has none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    return np.unique(mix(out + np.uint64(n)))


def sketch(s: np.ndarray) -> np.ndarray:
    """Min-hashes of a non-empty set, as 32-bit integers."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, (s[i:i + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def node_of(key: bytes) -> int:
    """The id of a set's node: the first 64 bits of its key."""
    return int.from_bytes(key[:8], "little", signed=True)


def first_paths(low: np.ndarray, runs: int) -> list[int]:
    """The bucket of each run: its token is the run's own min-hash."""
    at = np.arange(runs, dtype=np.uint64)
    return mix(low[:runs].astype(np.uint64) << np.uint64(8) | at).astype(np.int64).tolist()


def next_path(path: int, low: np.ndarray) -> int:
    """The bucket one level below ``path``: its token is the min-hash that the path chooses."""
    chosen = mix(np.array([path], np.int64).astype(np.uint64) + np.uint64(1))
    token = low[int(chosen[0] >> np.uint64(32)) % SKETCH].astype(np.uint64)
    return int(mix(chosen ^ token).astype(np.int64)[0])


def leaf_edges(rows: list[tuple], threshold: float, first: int | None = None) -> list[tuple[int, int]]:
    """Star edges between nodes of a bucket (block pair) that pass the sketch and size tests.

    With ``first``, only the pairs of the first so many rows with all rows are tested.
    """
    node = [r[0] for r in rows]
    low = np.stack([np.frombuffer(r[2], "<u4") for r in rows])
    size = np.array([r[1] for r in rows], np.float64)
    together = np.zeros((len(rows), len(rows)), bool)
    for i in range(min(len(rows) - 1, len(rows) if first is None else first)):
        same = (low[i + 1:] == low[i]).sum(axis=1) >= PASS
        if same.any():
            a, b = size[i], size[i + 1:]
            together[i, i + 1:] = same & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
    if not together.any():
        return []
    n = len(rows)
    return [(node[a % n], node[b % n]) for a, b in forest(together | together.T) if node[a % n] != node[b % n]]


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix (a x b, indices into ``sets``): Jaccard similarity of at least ``threshold``."""
    used = np.unique(np.concatenate([a, b]))
    token = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, [len(sets[i]) for i in used])
    _, column, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    place = np.full(len(sets), -1)
    common = np.zeros((len(a), len(b)), np.float64)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, n_columns, 2048):
        lo, hi = np.searchsorted(column, (first, first + 2048))
        x = []
        for part in (a, b):
            place[:] = -1
            place[part] = np.arange(len(part))
            rows = place[owner[lo:hi]]
            m = np.zeros((len(part), min(2048, n_columns - first)), np.float32)
            m[rows[rows >= 0], column[lo:hi][rows >= 0] - first] = 1.0
            x.append(m)
        common += x[0] @ x[1].T
    size = np.array([len(s) for s in sets], np.float64)
    return common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-9


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, n_links, class_id and kept of every row of ``docs`` (doc_id, text).

    ``n_links`` counts the other rows whose shingle set has a Jaccard
    similarity of at least ``threshold`` with the row's; ``class_id`` is the
    smallest doc_id reachable by links, and a row is kept if it is its own and,
    where several sets of the class have that id, its set has the least key.
    Equal sets are one node with a multiplicity, so copies are not paired.
    Null and empty texts have no shingles and link with nothing; nor do rows
    without an id (class null, kept). Repeated rows link with each other; rows
    of one id with unlike texts do not. An empty table gives an empty result;
    other columns are ignored. Links are exact; pairs are missed only where all
    runs and all chains of similar documents miss them.
    """
    return _told(docs, threshold, words, recall).drop("key", "mark")


def mark(text: str = "text"):
    """Tells apart the texts of one id."""
    return F.xxhash64(text)


def _told(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """``join`` with each row's set key and the mark of its text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    runs = n_runs(threshold, recall)

    def summarise(source):
        cache = WordCache(xxhash.xxh64_intdigest)
        for doc_id, mark, text in source:
            s = shingles(text or "", cache, words) if doc_id is not None else ()
            if len(s):
                low = sketch(s)
                key = set_key(s)
                yield doc_id, mark, len(s), key, node_of(key), low.tobytes(), first_paths(low, runs)
            else:
                yield doc_id, mark, 0, None, None, None, None

    rows = scratch.put(map_rows(docs.select("doc_id", mark().alias("mark"), "text"), summarise,
                                "doc_id long, mark long, n_shingles int, key binary, node long, low binary, paths array<long>"), "rows")
    first = F.min(F.struct("doc_id", "mark"))
    nodes = scratch.put(rows.where("key is not null").groupBy("key").agg(
        F.first("node").alias("node"), first.alias("first"), F.count("*").alias("n"), F.first("n_shingles").alias("size"),
        F.first("low").alias("low"), F.first("paths").alias("paths")).select("*", F.col("first.doc_id").alias("rep")), "nodes")

    near = scratch.put(components(_near_edges(nodes, threshold, scratch), scratch, "near"), "near-classes")

    links, pairs = _verify(docs, nodes, near, threshold, words, scratch)
    classes = scratch.put(components(pairs, scratch, "class"), "classes")
    member = classes.join(nodes.select("node", "rep", "key"), F.col("id") == F.col("node"))
    heads = member.groupBy(F.col("component").alias("__component")).agg(F.min(F.struct("rep", "key")).alias("head"))
    headed = classes.join(heads, F.col("component") == F.col("__component")).select("id", "head")
    done = nodes.select("key", "rep", "node", "n").join(links, "node", "left").join(headed, F.col("node") == F.col("id"), "left") \
        .select(F.col("key").alias("__key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("head.rep", "rep").alias("class"), F.coalesce("head.key", "key").alias("head_key"))
    out = rows.select("doc_id", "mark", "n_shingles", "key").join(done, F.col("key") == F.col("__key"), "left")
    class_id = F.coalesce("class", "doc_id")
    kept = (F.col("doc_id") == class_id) & F.coalesce(F.col("key") == F.col("head_key"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      class_id.alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"), "key", "mark")


def _near_edges(nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join all nodes which the sketch test leaves together in some bucket.

    Rows (path, node) go down level by level; buckets of one node are done, and
    small ones are compared by brute force. In a large bucket every node meets
    the least one first. Of nodes that such edges join already no pair is needed
    any more: a bucket of one such group ends there, a few others are compared
    with all of its nodes, and only a bucket of many groups is split by further
    tokens. So a class of near copies costs its size in each run, not
    its square. Each level's edges are written, so no plan holds two levels.
    """
    low = nodes.select(F.col("node").alias("r"), "size", "low")
    level = nodes.select("node", F.explode("paths").alias("path"))
    tables = []
    for depth in range(1, DEPTH + 1):
        n = level.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("count"), F.min("node").alias("least")).where("count > 1")
        level = scratch.put(level.join(n, F.col("path") == F.col("p")).select("path", "node", "count", "least"), f"level{depth}")
        leaf, large = level.where(F.col("count") <= LEAF), level.where(F.col("count") > LEAF)
        tables.append(scratch.put(_compare_leaves(leaf.select("path", "node", "count"), low, threshold), f"leaf-edges{depth}"))
        if not large.take(1):
            break
        stars = scratch.put(_stars(large, low, threshold), f"star-edges{depth}")
        tables.append(stars)
        # groups: a node goes by the least of its heads' own least heads; coarser groups would only save more
        own = stars.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("g"))
        heads = stars.select("b").distinct().join(own, F.col("b") == F.col("n"), "left").select(F.col("b").alias("h"), F.coalesce("g", "b").alias("g"))
        group = stars.join(heads, F.col("b") == F.col("h")).groupBy(F.col("a").alias("i")).agg(F.min("g").alias("g"))
        told = large.join(group, F.col("node") == F.col("i"), "left").select("path", "node", "count", F.coalesce("g", "node").alias("group"))
        told = scratch.put(told, f"told{depth}")
        main = told.groupBy("path", "group").agg(F.count("*").alias("m")).groupBy(F.col("path").alias("p")) \
            .agg(F.max(F.struct("m", "group")).alias("main"))
        open_ = told.join(main, F.col("path") == F.col("p")).withColumn("few", F.col("count") - F.col("main.m")) \
            .select("path", "node", "count", "few", (F.col("group") != F.col("main.group")).alias("other"))
        open_ = scratch.put(open_.where("few > 0"), f"open{depth}")
        tables.append(scratch.put(_compare_few(open_.where(F.col("few") <= LEAF), low, threshold), f"few-edges{depth}"))
        deeper = open_.where(F.col("few") > LEAF).select("path", "node", "count")
        if not deeper.take(1):
            break
        if depth == DEPTH:
            tables.append(scratch.put(_compare_leaves(deeper, low, threshold), f"block-edges{depth}"))
            break

        def descend(source):
            for path, node, sketch_ in source:
                yield next_path(path, np.frombuffer(sketch_, "<u4")), node

        # written, since the next level counts and joins it
        level = scratch.put(map_rows(deeper.join(low, F.col("node") == F.col("r")).select("path", "node", "low"), descend,
                                     "path long, node long"), f"below{depth}")
    return _all(tables)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _stars(large: DataFrame, low: DataFrame, threshold: float) -> DataFrame:
    """Edges between the nodes of large buckets and the bucket's least node, where the tests pass."""
    heads = large.select(F.col("path").alias("p"), F.col("least").alias("h")).distinct() \
        .join(low, F.col("h") == F.col("r")).select("p", F.col("size").alias("head_size"), F.col("low").alias("head_low"))
    met = large.where("node <> least").join(low, F.col("node") == F.col("r")).join(heads, F.col("path") == F.col("p")) \
        .select("node", "least", "size", "head_size", "low", "head_low")

    def test(source):
        for node, least, size, head_size, a, b in source:
            same = int((np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).sum())
            if same >= PASS and min(size, head_size) >= threshold * max(size, head_size) - 1e-9:
                yield node, least

    return map_rows(met, test, "a long, b long", flush=5000).distinct()


def _compare_few(open_: DataFrame, low: DataFrame, threshold: float) -> DataFrame:
    """Edges between a bucket's few nodes outside its main group and all its nodes, block by block."""
    blocks = F.ceil(F.col("count") / LEAF).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(11)), blocks).cast("int")
    at = F.when(F.col("other"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    dealt = open_.withColumn("block", F.explode(at)).join(low, F.col("node") == F.col("r")).select("path", "block", "other", "node", "size", "low")

    def compare(key, rows):
        few = [r for r in rows if r[0]]
        main = [r for r in rows if not r[0]]
        if few:
            yield from leaf_edges([r[1:] for r in few + main], threshold, len(few))

    return map_groups(dealt, 2, compare, "a long, b long").distinct()


def _compare_leaves(leaf: DataFrame, low: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) inside buckets; a bucket beyond LEAF meets block by block."""
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.transform(every, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = leaf.withColumn("blocks", F.ceil(F.col("count") / LEAF).cast("int")).withColumn("t", F.explode(pair))
    dealt = dealt.join(low, F.col("node") == F.col("r")).select("path", "t.i", "t.j", "node", "size", "low")
    return map_groups(dealt, 3, lambda key, rows: leaf_edges(rows, threshold) if len(rows) > 1 else (), "a long, b long")


def _verify(docs: DataFrame, nodes: DataFrame, near: DataFrame, threshold: float, words: int,
            scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (node, links) and star edges (a, b) among the nodes of each near class, by their whole sets.

    The sets are made again from the texts of the nodes' first documents. A
    class is dealt in blocks, and each pair of blocks is one group of bounded size.
    """
    sizes = near.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("m"))
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("m") / BLOCKS)))
    firsts = nodes.select("node", "n", F.col("key").alias("want"), "first")
    active = near.join(sizes, F.col("component") == F.col("c")).join(firsts, F.col("id") == F.col("node")) \
        .select("component", F.ceil(F.col("m") / block).cast("int").alias("blocks"), "node", "n", "want",
                F.col("first.doc_id").alias("__doc_id"), F.col("first.mark").alias("__mark"))
    texts = docs.select("doc_id", mark().alias("mark"), "text") \
        .join(active, [F.col(c) == F.col(f"__{c}") for c in ("doc_id", "mark")])

    def sets(source):
        cache = WordCache(xxhash.xxh64_intdigest)
        for component, blocks, node, n, want, text in source:
            s = shingles(text or "", cache, words)
            if len(s) and set_key(s) == bytes(want):
                yield component, blocks, node, n, s.tobytes()

    made = map_rows(texts.select("component", "blocks", "node", "n", "want", "text"), sets,
                    "component long, blocks int, node long, n long, items binary", flush=100)
    own = F.pmod(F.xxhash64("node", F.lit(13)), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), own.alias("own")))
    tiles = made.withColumn("t", F.explode(pair)).select("component", "t.i", "t.j", "t.own", "node", "n", "items")

    def compare(key, rows):
        _, i, j = key
        rows = list({r[1]: r for r in rows}.values())  # repeated rows of the first document
        items = [np.frombuffer(r[3], np.uint64) for r in rows]
        node, n = [r[1] for r in rows], np.array([r[2] for r in rows])
        side = np.array([r[0] for r in rows])
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if not len(a) or not len(b):
            return
        linked = exact_links(items, a, b, threshold)
        if i == j:
            np.fill_diagonal(linked, False)
        counts = [(a, linked @ n[b])] + ([(b, linked.T @ n[a])] if i != j else [])
        for index, links in counts:
            for k, c in zip(index.tolist(), links.tolist(), strict=True):
                if c:
                    yield node[k], None, int(c)
        names = [node[k] for k in (*a.tolist(), *b.tolist())]
        for x, y in forest(linked):
            if names[x] != names[y]:
                yield names[x], names[y], 0

    found = scratch.put(map_groups(tiles, 3, compare, "a long, b long, links long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return links, found.where("b is not null").select("a", "b")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """``docs``, all columns, with one document of each class: that of the smallest id.

    Unlike texts under one id are told apart and stay each; of texts of one id
    and one set, that of the least mark stays; of rows with one id and one text
    any one stays. Rows without an id stay.
    """
    kept = _told(docs, **settings).where("kept and doc_id is not null") \
        .groupBy(F.col("doc_id").alias("__kept"), "key").agg(F.min("mark").alias("__kept_mark")).drop("key").distinct()
    known = docs.withColumn("__mark", mark()) \
        .join(kept, (F.col("doc_id") == F.col("__kept")) & (F.col("__mark") == F.col("__kept_mark")), "left_semi") \
        .dropDuplicates(["doc_id", "__mark"])
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))
