"""Operators 4 and 5 against brute force."""

import random
from pathlib import Path

import numpy as np

from kpiloom.llm import embeddings, jaccard
from kpiloom.llm.common import Scratch
from kpiloom.llm.components import components


def classes(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_texts():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(60))  # a passage that many share
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(line + " " + " ".join(word() for _ in range(80)))
    hub = [word() for _ in range(200)]
    for i in range(300):  # one large class, beyond a bucket and a block
        copy = list(hub)
        copy[i % 200] = word()
        out.append(" ".join(copy))
    return out + ["", " ", "one", "ONE", out[0], out[0]]


def test_jaccard_join_equals_brute_force(spark):
    texts = near_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, key string, n int")).collect()}
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
              if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9]
    links = np.bincount([i for i, _ in linked], minlength=len(texts))
    assert [got[i].n_links for i in range(len(texts))] == links.tolist()
    assert [got[i].class_id for i in range(len(texts))] == classes(len(texts), linked)


def copies_nodes(spark, n_copies, n_unlike, scratch):
    """Nodes as ``join`` makes them: near copies of one text, and unlike texts that share one passage."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(90_000)}"
    base, passage = [word() for _ in range(300)], [word() for _ in range(40)]
    texts = []
    for _ in range(n_copies):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = word()
        texts.append(copy)
    texts += [passage + [word() for _ in range(60)] for _ in range(n_unlike)]
    cache, rows = jaccard.WordCache(jaccard.xxhash.xxh64_intdigest), []
    for words in texts:
        s = jaccard.shingles(" ".join(words), cache)
        low = jaccard.sketch(s)
        rows.append((jaccard.node_of(jaccard.set_key(s)), len(s), low.tobytes(), jaccard.first_paths(low, jaccard.n_runs())))
    return scratch.put(spark.createDataFrame(rows, "node long, size int, low binary, paths array<long>"), "nodes"), rows


def test_a_class_of_near_copies_is_not_split(spark):
    scratch = Scratch(spark, "t-near")
    nodes, rows = copies_nodes(spark, 1500, 0, scratch)
    edges = jaccard._near_edges(nodes, 0.8, scratch)
    assert {r.component for r in components(edges, scratch).collect()} == {min(r[0] for r in rows)}
    assert edges.count() < 40 * len(rows)  # linear, where all pairs are 1,124,250
    assert not (Path(scratch.root) / "level2").exists()


def test_large_buckets_of_unlike_texts_go_down(spark):
    scratch = Scratch(spark, "t-unlike")
    nodes, rows = copies_nodes(spark, 400, 1500, scratch)
    got = {r.id: r.component for r in components(jaccard._near_edges(nodes, 0.8, scratch), scratch).collect()}
    copies = [r[0] for r in rows[:400]]
    assert {got[i] for i in copies} == {min(copies)}
    spark.read.parquet(f"{scratch.root}/level2").count()  # the shared passage's buckets were split


def test_jaccard_edges(spark):
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (3, "A b c  d e f", None), (None, "a b c d e f", "x"),
                                  (9, None, None)], kind)
    got = sorted(map(tuple, jaccard.join(docs).collect()), key=str)
    assert got == sorted([(5, 2, 2, 3, False), (5, 2, 2, 3, False), (3, 2, 2, 3, True), (None, 0, 0, None, True), (9, 0, 0, 9, True)], key=str)
    assert sorted(map(tuple, jaccard.keep_first(docs).collect()), key=str) == sorted(
        [(3, "A b c  d e f", None), (None, "a b c d e f", "x"), (9, None, None)], key=str)
    assert jaccard.join(docs.where("false")).count() == 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 900)] + rng.normal(size=(900, 16)) * 0.12, np.repeat(base[:1], 50, axis=0)])
    label = rng.integers(0, 3, len(x))
    rows = [(i, v.tolist(), int(k), "z") for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [[], None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    rows += [(2000 + i, v, 0, "z") for i, v in enumerate(odd)] + [(2100, x[0].tolist(), None, "z"), (None, x[0].tolist(), 0, "z"),
                                                                  (2200, [1.0, 2.0], 0, "z"), (2201, [2.0, 4.0], 0, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string")
    out = embeddings.near_duplicates(df, block=64).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: r for r in out}
    size = np.sqrt((x * x).sum(1))
    near = ((x @ x.T) / (size[:, None] * size[None, :]) >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    want = classes(len(x), zip(*np.nonzero(near), strict=True))
    assert [got[i].component_id for i in range(len(x))] == want
    assert all(got[k].n_links == 0 and got[k].kept for k in (2000, 2001, 2002, 2003, 2004, 2005, 2100, None))
    assert got[2201].component_id == 2200 and got[2200].n_links == 1
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_jaccard_runs_keep_the_recall_on_the_last_level():
    for threshold in (0.8, 0.9):
        assert (1 - threshold ** jaccard.DEPTH) ** jaccard.n_runs(threshold) <= 1 - jaccard.RECALL
    together = lambda low: {p for p in jaccard.first_paths(low, jaccard.n_runs())}
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(4000):  # sketches that agree in each place with probability 0.8, in buckets split to the last level
        a = rng.integers(0, 2 ** 32, jaccard.SKETCH, dtype=np.uint32)
        b = np.where(rng.random(jaccard.SKETCH) < 0.8, a, rng.integers(0, 2 ** 32, jaccard.SKETCH, dtype=np.uint32))
        paths = together(a) & together(b)
        for _ in range(jaccard.DEPTH - 1):
            paths = {jaccard.next_path(p, a) for p in paths} & {jaccard.next_path(p, b) for p in paths}
        missed += not paths
    assert missed <= 4


def test_unlike_texts_of_one_id_both_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (5, a), (7, b + " more"), (7, a + " more"), (7, "c d e f g h"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(docs).collect()))
    assert got == sorted([(5, 36, 2, 5, True), (5, 36, 2, 5, True), (5, 36, 1, 5, True), (7, 37, 1, 5, False), (7, 37, 2, 5, False),
                          (7, 2, 0, 7, True), (8, 0, 0, 8, True), (8, 0, 0, 8, True)])
    kept = sorted(map(tuple, jaccard.keep_first(docs).collect()), key=str)
    assert [k for k in kept if k[0] != 8] == sorted([(5, a), (5, b), (7, "c d e f g h")], key=str)
    assert sum(k[0] == 8 for k in kept) == 1


def low_rank(n, rank, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, 64))
    return x / np.sqrt((x * x).sum(1))[:, None]


def test_one_side_of_each_link_visits_the_other_list():
    for rank in (3, 5, 8):
        x = low_rank(2500, rank)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        assert len(a) > 100
        for n_lists in (7, 71, 300):
            index = embeddings.Index.fit(x, n_lists)
            at = index.encode(x)[0]
            seen = index.visits(x, at, np.arange(len(index.coarse)), embeddings.margin_of(0.93))
            assert (seen[a, at[b]] | seen[b, at[a]]).all(), (rank, n_lists)


def test_links_of_low_rank_vectors_equal_brute_force(spark):
    x = np.concatenate([low_rank(1500, 3), low_rank(1500, 5)])
    label = np.repeat([1, 2], 1500)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))],
                               "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=100, group=200).collect()}
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == classes(len(x), zip(*np.nonzero(near), strict=True))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (160, 499), (499, 500)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert set(got.values()) == {100} and len(got) == 61 + 1 + 80
