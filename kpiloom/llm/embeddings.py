"""Near-duplicate embeddings by inverted lists and product quantisation (operator 5).

Vectors of one label are compared. A coarse codebook deals them to inverted
lists; each is stored with product-quantised residual codes and the error of
its code. A query visits the lists whose bisector it is near to, compares by table
look-ups, keeps what the error bound cannot rule out, and is decided by the
exact cosine in double precision. Of two linked vectors one at least is within
half of their distance, measured across the bisector, so half of it is looked
beyond, a pair that one side alone finds counts for both, and no link is lost.
Where vectors spread in many directions most lists are near; so lists that lie
together share a cell, as many as a label's size asks for, and a vector moves
once to each cell, however many of its lists it visits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows
from .components import components, forest

THRESHOLD = 0.93
#: Most vectors that the codebooks are fitted on (all vectors are indexed), and most inverted lists.
SAMPLE, MAX_LISTS = 20_000, 4096
SUBSPACES, CODES = 8, 64
#: Members of one cell of neighbouring lists, about, and most times that the lists are halved into cells.
GROUP, LEVELS = 1024, 12
#: Members and queries of one tile: larger cells are split into blocks that meet block by block.
BLOCK = 1024
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd centroids; at most as many as there are distinct starting rows."""
    rng = np.random.default_rng(seed)
    centers = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        nearest = np.concatenate([sq_dist(x[i:i + 4096], centers).argmin(axis=1) for i in range(0, len(x), 4096)])
        sums, n = np.zeros_like(centers), np.bincount(nearest, minlength=len(centers))
        np.add.at(sums, nearest, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def sq_dist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T, 0.0)


def halve(centers: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A number of ``LEVELS`` bits for each centroid: bit by bit, the side of its set cut across the widest direction."""
    out = np.zeros(len(centers), np.int64)

    def cut(at, level):
        if len(at) < 2 or level == LEVELS:
            return
        rest = centers[at] - centers[at].mean(axis=0)
        order = at[np.argsort(rest @ np.linalg.svd(rest, full_matrices=False)[2][0], kind="stable")]
        total = np.cumsum(weight[order])
        k = min(max(int(np.searchsorted(total, total[-1] / 2)) + 1, 1), len(at) - 1)
        out[order[k:]] |= 1 << (LEVELS - 1 - level)
        cut(order[:k], level + 1)
        cut(order[k:], level + 1)

    cut(np.arange(len(centers)), 0)
    return out


@dataclass
class Index:
    """Coarse centroids, the centroids of each residual subspace, and the centroids' order by halves."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray
    halves: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, n_lists: int) -> Index:
        dim = sample.shape[1]
        cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        coarse = kmeans(sample, n_lists, 1)
        at = sq_dist(sample, coarse).argmin(1)
        rest = sample - coarse[at]
        return cls(coarse, [kmeans(rest[:, a:b], CODES, 2) for a, b in zip(cuts, cuts[1:])], cuts,
                   halve(coarse, np.bincount(at, minlength=len(coarse)) + 1.0))

    @classmethod
    def flat(cls, dim: int) -> Index:
        """One list, codes that say nothing: for a dimension that the sample lacks."""
        return cls(np.zeros((1, dim)), [np.zeros((1, dim))], np.array([0, dim]), np.zeros(1, np.int64))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and code error of each row."""
        at = sq_dist(x, self.coarse).argmin(1)
        rest = x - self.coarse[at]
        codes = np.stack([sq_dist(rest[:, a:b], book).argmin(1) for a, b, book in self._parts()], axis=1).astype(np.uint8)
        made = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return at, codes, np.sqrt(((rest - made) ** 2).sum(1))

    def _parts(self):
        return zip(self.cuts, self.cuts[1:], self.books, strict=False)

    def within(self, x: np.ndarray, own: np.ndarray, other: np.ndarray, margin: float) -> np.ndarray:
        """Is each row within ``margin`` of the bisector of its own and another centroid; row by row, so always the same."""
        out = np.empty(len(x), bool)
        for i in range(0, len(x), 65536):
            y, a, b = x[i:i + 65536], self.coarse[own[i:i + 65536]], self.coarse[other[i:i + 65536]]
            gap = ((y - b) ** 2).sum(1) - ((y - a) ** 2).sum(1)
            out[i:i + 65536] = gap <= 2 * margin * np.sqrt(((a - b) ** 2).sum(1))
        return out

    def visits(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, margin: float) -> np.ndarray:
        """Boolean matrix (rows x lists): the row's own list, and others whose bisector is ``within`` the margin."""
        home = self.coarse[own]
        over = sq_dist(x, self.coarse[lists]) - ((x - home) ** 2).sum(1)[:, None] \
            - 2 * margin * np.sqrt(sq_dist(home, self.coarse[lists]))
        out = over <= -1e-6
        rows, cols = np.nonzero(np.abs(over) < 1e-6)
        out[rows, cols] = self.within(x[rows], own[rows], lists[cols], margin)
        return out | (own[:, None] == lists[None, :])

    def adc(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows to coded members of a list, by sums of table entries."""
        rest = x - self.coarse[at]
        total = np.zeros((len(x), len(codes)))
        for i, (a, b, book) in enumerate(self._parts()):
            total += sq_dist(rest[:, a:b], book)[:, codes[:, i]]
        return np.sqrt(total)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def margin_of(threshold: float) -> float:
    """How far beyond a bisector a query looks: half of the distance of two vectors at the threshold."""
    return float(np.sqrt(2 - 2 * threshold)) / 2 + SLACK


def pack(v: np.ndarray) -> bytes:
    """The numbers in single precision where that is exact, else in double."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return (single if (single == v).all() else v).tobytes()


def unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, key and vec (packed) of each row; key and vec are null where nothing can link."""
    def rows(source):
        for vec_id, label, x in source:
            v = None
            if vec_id is not None and label is not None and x and None not in x:
                v = np.array(x, np.float64) + 0.0
                size = np.sqrt((v * v).sum())
                if not (np.isfinite(v).all() and 0 < size < np.inf):
                    v = None
            if v is None:
                yield vec_id, label, None, None, None
            else:
                raw = v.tobytes()
                yield vec_id, label, len(v), hashlib.blake2b(raw + str(label).encode(), digest_size=16).digest(), pack(v)

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return map_rows(vectors.select("vec_id", "label", "embedding"), rows,
                    f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, key binary, vec binary")


def fit_indexes(reps: DataFrame, sample: int = SAMPLE) -> dict[int, Index]:
    """An index for each dimension, fitted on at most about ``sample`` vectors of the smallest id hash."""
    n = reps.count()
    share = min(1.0, sample / max(n, 1))
    near = F.xxhash64("rep", F.lit(3)).cast("double") / 2.0 ** 64 + 0.5 <= share
    picked = reps.where(near).select("dim", "vec").limit(2 * sample).toPandas()
    out = {}
    for dim, part in picked.groupby("dim"):
        x = unit(np.stack([unpack(v, int(dim)) for v in part["vec"]]))
        out[int(dim)] = Index.fit(x, max(1, min(MAX_LISTS, int(np.ceil(np.sqrt(n) / 2)), len(x))))
    return out


def linked_tile(members: dict, queries: dict, index: Index, at: int, threshold: float) -> np.ndarray:
    """Boolean matrix (queries x members): cosine of at least ``threshold``, other ids only."""
    radius = np.sqrt(2 - 2 * threshold)
    x, q = members["x"], queries["x"]
    ux, uq = unit(x), unit(q)
    maybe = index.adc(uq, at, members["codes"]) <= radius + members["err"][None, :] + 1e-6
    maybe &= queries["rep"][:, None] != members["rep"][None, :]
    rows, cols = np.nonzero(maybe)
    out = np.zeros(maybe.shape, bool)
    for i in range(0, len(rows), 65536):
        r, c = rows[i:i + 65536], cols[i:i + 65536]
        a, b = q[r], x[c]
        cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        out[r, c] = cosine >= threshold
    return out


def linked_cell(members: dict, queries: dict, index: Index, threshold: float) -> np.ndarray:
    """Boolean matrix (queries x members): links to the members of the lists that a query visits."""
    lists = np.unique(members["list"])
    seen = index.visits(unit(queries["x"]), queries["list"], lists, margin_of(threshold))
    out = np.zeros((len(queries["x"]), len(members["x"])), bool)
    for k, at in enumerate(lists.tolist()):
        r, c = np.flatnonzero(seen[:, k]), np.flatnonzero(members["list"] == at)
        if len(r):
            out[np.ix_(r, c)] = linked_tile({name: v[c] for name, v in members.items()}, {name: v[r] for name, v in queries.items()},
                                            index, at, threshold)
    return out


def unseen(linked: np.ndarray, members: dict, queries: dict, index: Index, threshold: float) -> np.ndarray:
    """Links of each member to queries whose own list it does not visit itself."""
    rows, cols = np.nonzero(linked & (queries["list"][:, None] != members["list"][None, :]))
    out = np.zeros(linked.shape[1], np.int64)
    x = unit(members["x"])
    for i in range(0, len(rows), 65536):
        r, c = rows[i:i + 65536], cols[i:i + 65536]
        far = ~index.within(x[c], members["list"][c], queries["list"][r], margin_of(threshold))
        np.add.at(out, c[far], queries["n"][r[far]])
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK,
                    group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, label, embedding).

    Links are between vectors of one non-null label and one length whose
    cosine is at least ``threshold``. Null, empty or zero vectors and those
    with null or non-finite components link with nothing, nor do rows without
    an id (their component is null and they are kept). Equal vectors of a label
    are one node with a multiplicity; repeated rows link with each other.
    Rows that share an id share their links. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = scratch.put(prepare(vectors), "rows")
    reps = scratch.put(rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("vec").alias("vec")), "reps")
    held = spark.sparkContext.broadcast(fit_indexes(reps))
    label_kind = rows.schema["label"].dataType.simpleString()

    # a label is dealt to as many cells as its size asks for, a power of two
    kinds = scratch.put(reps.groupBy(F.col("label").alias("__label"), F.col("dim").alias("__dim")).agg(
        F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / group)))).cast("int").alias("level")), "levels")
    sized = reps.join(kinds, [F.col(c) == F.col(f"__{c}") for c in ("label", "dim")])

    def deal(source):
        for part in _chunks(source, 1000):
            for dim in {p[2] for p in part}:
                mine = [p for p in part if p[2] == dim]
                index = held.value.get(dim) or Index.flat(dim)
                x = unit(np.stack([unpack(p[3], dim) for p in mine]))
                at, codes, err = index.encode(x)
                seen = index.visits(x, at, np.arange(len(index.coarse)), margin_of(threshold))
                for p, a, c, e, to in zip(mine, at.tolist(), codes, err.tolist(), seen, strict=True):
                    cells = index.halves >> (LEVELS - p[5])
                    yield p[1], dim, int(cells[a]), a, p[0], p[4], p[3], c.tobytes(), e
                    for other in np.unique(cells[to & (cells != cells[a])]).tolist():
                        yield p[1], dim, other, a, p[0], p[4], p[3], None, 0.0

    # a row with codes is a member and a query in its cell, else a query alone
    dealt = scratch.put(map_rows(sized.select("rep", "label", "dim", "vec", "n", "level"), deal,
                                 f"label {label_kind}, dim int, cell int, list int, rep long, n long, vec binary, "
                                 "codes binary, err double"), "dealt")
    member = F.col("codes").isNotNull()
    cell = ["label", "dim", "cell"]
    sizes = dealt.groupBy(*cell).agg(F.count(F.when(member, 1)).alias("m"), F.count("*").alias("q"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.where("m > 0 and q > 1").select(*[F.col(c).alias(f"__{c}") for c in cell], blocks("m").alias("mb"), blocks("q").alias("qb"))
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda i, j, as_member, as_query: F.struct(
        i.alias("i"), j.alias("j"), as_member.alias("as_member"), as_query.alias("as_query"))
    # members of block i meet queries of block j; a member is one row in the tile where it is both
    as_member = F.when(member, F.transform(all_of("qb"), lambda j: tile(own("mb"), j, F.lit(True), j == own("qb")))) \
        .otherwise(F.array())
    as_query = F.transform(F.filter(all_of("mb"), lambda i: ~member | (i != own("mb"))),
                           lambda i: tile(i, own("qb"), F.lit(False), F.lit(True)))
    tiles = dealt.join(sizes, [F.col(c) == F.col(f"__{c}") for c in cell]) \
        .withColumn("tile", F.explode(F.concat(as_member, as_query))) \
        .select(*cell, "list", "rep", "n", "vec", "codes", "err", "tile.*")

    def compare(table: pa.Table) -> pa.Table:
        is_member, is_query = (np.array(table[c].to_pylist(), bool) for c in ("as_member", "as_query"))
        rep, n, home = (table[c].to_numpy() for c in ("rep", "n", "list"))
        dim = table["dim"][0].as_py()
        x = np.stack([unpack(v, dim) for v in table["vec"].to_pylist()])
        found: list[tuple] = []
        if is_member.any() and is_query.any():
            index = held.value.get(dim) or Index.flat(dim)
            members = {"x": x[is_member], "rep": rep[is_member], "list": home[is_member], "err": table["err"].to_numpy()[is_member],
                       "codes": np.stack([np.frombuffer(c, np.uint8) for c, m in zip(table["codes"].to_pylist(), is_member, strict=True) if m])}
            queries = {"x": x[is_query], "rep": rep[is_query], "list": home[is_query], "n": n[is_query]}
            linked = linked_cell(members, queries, index, threshold)
            found = [(int(r), None, int(c)) for r, c in zip(queries["rep"], linked @ n[is_member], strict=True) if c]
            found += [(int(r), None, int(c)) for r, c in zip(members["rep"], unseen(linked, members, queries, index, threshold), strict=True) if c]
            names = np.concatenate([queries["rep"], members["rep"]])
            found += [(int(names[a]), int(names[b]), 0) for a, b in forest(linked)]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64()),
                         "links": pa.array([f[2] for f in found], pa.int64())})

    found = scratch.put(tiles.groupBy(*cell, "i", "j").applyInArrow(compare, "a long, b long, links long"), "found")
    scratch.drop("dealt")
    classes = components(found.where("b is not null").select("a", "b"), scratch)
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    nodes = reps.select("key", "rep", "n").join(links, "rep", "left") \
        .join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left") \
        .select(F.col("key").alias("__key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "key").join(nodes, F.col("key") == F.col("__key"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _chunks(source, size: int):
    part = []
    for row in source:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
