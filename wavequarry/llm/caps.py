"""Embedding near-duplicates by spherical-cap filters.

Equal vectors are one class with a weight, represented by its smallest id (equal by 128 bits of hashes). Filters are the
directions of a random product code: vectors are rotated by random signs and a Hadamard transform and cut in two halves, each
half has a codebook of random unit vectors (a large codebook is itself the sums of two smaller ones, of a quarter each), and
every pair of codewords is a filter. A vector is list-decoded to all filters whose score reaches a threshold (at least to half
as many as is common); how many are common is fitted to random pairs of the least cosine, which have to share one, and
confirmed on other pairs; the fit is made once, on the driver, for each length of vectors. The number of filters grows with
the number of classes, at any size. Each length of vectors has a code and filters of its own.

Filters get no vectors but sketches: the first three eighths of the rotated components, a byte each. Of two sketches the largest
cosine follows that their vectors can have (quantisation and the rest of the norm counted in full), so no pair that shares a
filter and has the least cosine is lost. Pairs whose bound reaches it make groups, and a vector goes once to its group, where
all pairs are compared by exact cosine in double precision. A group of more than ``WIDE`` vectors is dealt in blocks of about as
many, and each pair of blocks is a task of its own. Of groups that would take more rows so than by their filters (many vectors, few of
them linked), the vectors themselves go to the filters, in blocks of about ``BLOCK``; a pair is counted in the smallest filter it shares there.
Tasks return counts and a spanning forest of links, not the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths don't link with each other; rows that repeat an id count once, with the smallest of their embeddings; a null id has no
links and no component; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import components, mixed, parts, schema_of, stored

#: Filters that a vector exceeds commonly, at least; the share of random pairs of the least cosine that share a
#: filter, and the number of pairs; vectors in a block of a filter; filters for each vector of the table; words of a half from which on its
#: codebook is made of two; bits of a filter's number within the code of a length; vectors in a block of a group; in the sketches of a part of the filters.
EXPECTED, RECALL, TRIALS, BLOCK, FILTERS_PER_ROW, LARGE, BITS, WIDE, PART = 8, 0.95, 600, 512, 64, 4096, 46, 4096, 32_768
DECODED = "vec_id long, copies long, unit binary, filters binary"
PACKED = "dim int, part int, ids binary, sketches binary, filters binary, owners binary"
FOUND = "a long, b long, n long"


class ProductCode:
    def __init__(self, dim: int, rows: int, least: float = 0.95, seed: int = 11, fitted: tuple[float, int] | None = None):
        rng = np.random.default_rng(seed)
        self.dim, self.size = dim, max(16, 1 << (max(1, dim - 1)).bit_length())
        half, bits = self.size // 2, max(6, int(np.ceil(np.log2(max(1, FILTERS_PER_ROW * rows)) / 2)))
        self.parts = 2 if 1 << bits > LARGE and half > 1 else 1  # of a half's codebook
        self.words = 1 << bits
        sizes = [1 << bits] if self.parts == 1 else [1 << bits - bits // 2, 1 << bits // 2]
        self.signs = rng.choice([-1.0, 1.0], (2, self.size))
        books = [[rng.normal(size=(n, half // self.parts)) for n in sizes] for _ in range(2)]
        self.books = [[b / np.linalg.norm(b, axis=1, keepdims=True) / np.sqrt(self.parts) for b in pair] for pair in books]
        # a score has about the standard deviation 1/sqrt(size); it is kept as the sum of both halves
        if fitted:
            self.threshold, self.least = fitted
        else:
            self.fit(least, rng)

    def fit(self, least: float, rng: np.random.Generator) -> None:
        """As many filters as random pairs of the least cosine need to share one. Ends where those, and as many other pairs, do; or with all filters."""
        expected = EXPECTED
        while True:
            pairs = [self.pairs(least, rng) for _ in range(2)]
            self.threshold, self.least = -np.inf, min(expected, self.words**2)
            self.threshold = float(np.median([self.best(a, b)[1] for a, b in self.sides(pairs[0][0])]))
            self.least = math.ceil(self.least / 2)
            if expected >= self.words**2 or all(np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(self.decode(u), self.decode(v))]) >= RECALL for u, v in pairs):
                return
            expected = math.ceil(1.3 * expected)

    def pairs(self, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        u, v = rng.normal(size=(2, TRIALS, self.dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v -= (u * v).sum(axis=1, keepdims=True) * u
        return u, least * u + np.sqrt(max(0.0, 1 - least * least)) * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def sides(self, units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The scores of both halves of each unit vector."""
        half, step = self.size // 2, max(1, min(512, (1 << 22) // self.words))
        for i in range(0, len(units), step):
            x = self.rotated(units[i : i + step])
            yield from zip(self.scores(x[:, :half], 0), self.scores(x[:, half:], 1))

    def best(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        """The ``least`` best filters and the score of the last one; they are among the best of both halves."""
        ia, ib = (np.argpartition(-v, self.least)[: self.least] if len(v) > self.least else np.arange(len(v)) for v in (a, b))
        sums = (a[ia][:, None] + b[ib]).ravel()
        best = np.argsort(-sums, kind="stable")[: self.least]
        return ia[best // len(ib)] * self.words + ib[best % len(ib)], float(sums[best[-1]])

    def scores(self, x: np.ndarray, half: int) -> np.ndarray:
        book, width = self.books[half], x.shape[1] // self.parts
        found = x[:, :width] @ book[0].T
        if self.parts == 2:
            found = (found[:, :, None] + (x[:, width:] @ book[1].T)[:, None, :]).reshape(len(x), -1)
        return found

    def rotated(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.size - self.dim)))
        for s in self.signs:
            x, h = x * s, 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
                h *= 2
            x = x / np.sqrt(self.size)
        return x

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the filters of each unit vector."""
        out = []
        for a, b in self.sides(units):
            ia, ib = np.flatnonzero(a >= self.threshold - b.max()), np.flatnonzero(b >= self.threshold - a.max())
            ra, rb = np.nonzero(a[ia][:, None] + b[ib] >= self.threshold)
            found = ia[ra] * self.words + ib[rb]
            out.append(np.sort(found if len(found) >= self.least else self.best(a, b)[0]).astype("<i8"))
        return out


@lru_cache(maxsize=4)
def code_of(dim: int, rows: int, least: float, fitted: tuple[float, int] | None = None) -> ProductCode:
    return ProductCode(dim, rows, least, fitted=fitted)


def units_of(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: it, the rows that have it, and their unit vectors."""
    offsets = np.asarray(col.offsets, dtype=np.int64)
    values, sizes = col.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        x = values[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield dim, at, x / np.linalg.norm(x, axis=1, keepdims=True)


def fits(vectors: DataFrame, least: float) -> tuple[int, dict[int, tuple[float, int]]]:
    """The number of vectors, and the numbers fitted for each length; tasks get these and draw its code from the seed."""
    dims = dict(vectors.groupBy("dim").count().collect())
    rows = sum(dims.values())
    return rows, {dim: (code.threshold, code.least) for dim in dims for code in [code_of(dim, rows, least)]}


def decoded(vectors: DataFrame, rows: int, fitted: dict[int, tuple[float, int]], least: float) -> DataFrame:
    """vectors: vec_id, copies, embedding."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            for dim, at, x in units_of(b.column(2)):
                filters = [f + (dim << BITS) for f in code_of(dim, rows, least, fitted[dim]).decode(x)]
                ids, copies = (b.column(c).take(pa.array(at)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, copies, pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), pa.array([f.astype("<i8").tobytes() for f in filters], pa.binary())], schema=schema_of(DECODED))

    return vectors.select("vec_id", "copies", "embedding").mapInArrow(run, DECODED)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers, first all lowest bytes, then all next ones ..., so that the codec of the shuffle finds the zeros."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def of_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def packed(vectors: DataFrame, rows: int, fitted: dict[int, tuple[float, int]], least: float) -> DataFrame:
    """The filters of vectors (vec_id, embedding), with sketches. A row has what a batch gives to a part of the filters: those of some words of the first half."""
    n = max(parts(vectors.sparkSession), -(-rows // PART))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            every = b.column(0).to_numpy()
            for dim, at, x in units_of(b.column(1)):
                code, out = code_of(dim, rows, least, fitted[dim]), []
                lists, sketch = code.decode(x), np.rint(code.rotated(x)[:, : 3 * code.size // 8] * 127).astype(np.int8)
                filters, owner = np.concatenate(lists), np.repeat(np.arange(len(x)), [len(f) for f in lists])
                part = (mixed((filters // code.words).astype(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int64)
                order = np.lexsort((filters, part))
                for cut in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    own, owners = np.unique(owner[cut], return_inverse=True)
                    out.append((dim, int(part[cut[0]]), planes(every[at[own]]), sketch[own].tobytes(), planes(np.diff(filters[cut], prepend=0)), planes(owners)))
                schema = schema_of(PACKED)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return vectors.select("vec_id", "embedding").mapInArrow(run, PACKED)


def pairs_of(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys, a distance at a time; keys are sorted."""
    at, d = np.arange(len(keys)), 1
    while len(at := (at := at[at + d < len(keys)])[keys[at] == keys[at + d]]):
        yield at, at + d
        d += 1


def reached(n: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Smallest row that links lead to from each of n rows. linked(rows, others) tells which of the others link with any of the rows; a row that was reached is not asked for again."""
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        first, ends, rest = rest[0], rest[:1], rest[1:]
        while len(ends) and len(rest):
            new = []
            for i in range(0, len(ends), BLOCK):
                hit = np.concatenate([linked(ends[i : i + BLOCK], rest[j : j + WIDE]) for j in range(0, len(rest), WIDE)]) if len(rest) else np.empty(0, bool)
                if hit.any():
                    new.append(rest[hit])
                    rest = rest[~hit]
            ends = np.concatenate(new) if new else rest[:0]
            label[ends] = first
    return label


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that the links (a, b) lead to from each of n rows."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def possible(found: pa.Table, least: float) -> Iterator[tuple[int, int]]:
    """Links (id, smaller id) that join the vectors of a part whose sketches allow the least cosine in a filter they share."""
    ids, sketches, filters, owners, n = [], [], [], [], 0
    for row in zip(*(found.column(c).to_pylist() for c in ("ids", "sketches", "filters", "owners"))):
        ids.append(of_planes(row[0]))
        sketches.append(np.frombuffer(row[1], np.int8).reshape(len(ids[-1]), -1))
        filters.append(np.cumsum(of_planes(row[2])))
        owners.append(of_planes(row[3]) + n)
        n += len(ids[-1])
    ids, q, filters, owners = (np.concatenate(x) for x in (ids, sketches, filters, owners))
    q = q.astype(np.float32) / 127
    # u v = (q + e)(q' + e') + the rest; each component of e is at most half a step
    e, norm = np.float32(math.sqrt(q.shape[1]) / 254), np.linalg.norm(q, axis=1)
    rest = np.sqrt(np.clip(1 - np.maximum(0, norm - e) ** 2, 0, 1))
    enough = np.float32(least - float(e) ** 2 - 1e-5)
    order = np.lexsort((ids[owners], filters))
    filters, owners = filters[order], owners[order]
    begin = np.flatnonzero(np.diff(filters, prepend=filters[0] - 1))
    held = np.diff(begin, append=len(filters))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(held > 64):  # of many vectors, each is compared until it is reached
        own = owners[begin[i] : begin[i] + held[i]]
        low = reached(len(own), lambda r, o, own=own: (q[own[r]] @ q[own[o]].T + e * (norm[own[r]][:, None] + norm[own[o]]) + rest[own[r]][:, None] * rest[own[o]] >= enough).any(axis=0))
        links.append((own, own[low]))
    few = np.repeat((held > 1) & (held <= 64), held)
    filters, owners = filters[few], owners[few]
    for x, y in pairs_of(filters):
        for i in range(0, len(x), 1 << 18):
            a, b = owners[x[i : i + (1 << 18)]], owners[y[i : i + (1 << 18)]]
            near = np.einsum("ij,ij->i", q[a], q[b]) + e * (norm[a] + norm[b]) + rest[a] * rest[b] >= enough
            links.append((a[near], b[near]))
    if links:
        by_id = np.argsort(ids)
        rank = np.argsort(by_id)
        low = joined(n, *(rank[np.concatenate(x)] for x in zip(*links)))
        for i in np.flatnonzero(low != np.arange(n)):
            yield int(ids[by_id[i]]), int(ids[by_id[low[i]]])


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(number: int, ids: np.ndarray, copies: np.ndarray, units: np.ndarray, filters: list[np.ndarray], side: np.ndarray, least: float) -> Iterator[tuple]:
    """Counts (a, None, n) of linked vectors and links (a, b, 0) of one task: pairs across both sides, or all pairs where there is one side."""
    close = units @ units.T >= least
    np.fill_diagonal(close, False)
    if side.any():
        close &= side[:, None] != side[None, :]
    own = np.flatnonzero(close.any(axis=1))
    if not len(own):
        return
    close, ids, copies, filters = close[np.ix_(own, own)], ids[own], copies[own], [filters[i] for i in own]
    low = forest(close)
    for i in np.flatnonzero(low != np.arange(len(low))):
        yield int(ids[i]), int(ids[low[i]]), 0
    smaller = [f[f < number] for f in filters]
    every, at, held = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    several = held[at] > 1  # a filter of one vector alone tells nothing of pairs
    if several.any():
        of = np.repeat(np.arange(len(ids)), [len(f) for f in smaller])[several]
        has = np.zeros((len(ids), int((held > 1).sum())), dtype=np.float32)
        has[of, (np.cumsum(held > 1) - 1)[at[several]]] = 1
        close &= has @ has.T == 0
    for i, n in zip(ids, close.astype(np.int64) @ copies):
        if n:
            yield int(i), None, int(n)


def compared(cell: pa.Table, least: float) -> Iterator[tuple]:
    """As ``compare``, of a cell: a pair of blocks of one group, or all of several whole groups (side below 0)."""
    cell = cell.sort_by([("component", "ascending"), ("vec_id", "ascending")]).combine_chunks()
    for _, at, x in units_of(cell.column("embedding").combine_chunks()) if len(cell) else []:
        group, side, ids, copies = (cell.column(c).to_numpy()[at] for c in ("component", "side", "vec_id", "copies"))
        n, links = np.zeros(len(x), dtype=np.int64), []
        if side[0] < 0:
            for a, b in pairs_of(group):
                step = max(1, (1 << 22) // x.shape[1])
                for i in range(0, len(a), step):
                    near = np.einsum("ij,ij->i", x[a[i : i + step]], x[b[i : i + step]]) >= least
                    p, q = a[i : i + step][near], b[i : i + step][near]
                    np.add.at(n, p, copies[q])
                    np.add.at(n, q, copies[p])
                    links.append((p, q))
            low = joined(len(x), *(np.concatenate(p) for p in zip(*links))) if links else np.arange(len(x))
        else:
            for i in range(0, len(x), BLOCK):
                close = x[i : i + BLOCK] @ x.T >= least
                close[np.arange(len(close)), np.arange(i, i + len(close))] = False
                if side.any():
                    close &= side[i : i + BLOCK, None] != side[None, :]
                n[i : i + BLOCK] = close.astype(np.float64) @ copies
            own = np.flatnonzero(n)
            low = np.arange(len(x))
            low[own] = own[reached(len(own), lambda r, o, x=x[own]: (x[r] @ x[o].T >= least).any(axis=0))]
        yield from ((int(ids[i]), int(ids[low[i]]), 0) for i in np.flatnonzero(low != np.arange(len(low))))
        yield from ((int(ids[i]), None, int(n[i])) for i in np.flatnonzero(n))


def near_duplicates(vectors: DataFrame, least: float = 0.95, wide: int = WIDE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, linked where the cosine is at least ``least``."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    # without lambdas, as all vectors are read several times; contains() is null where it finds none and there is a null
    low, high, infinite = F.array_min("embedding"), F.array_max("embedding"), F.lit(float("inf"))
    finite = ~F.array_contains("embedding", F.lit(float("nan")).cast(kind)) & (high < infinite) & (low > -infinite)
    fit = F.coalesce(finite & ((low != 0) | (high != 0)), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fit", fit).withColumn("dim", F.size("embedding"))
    rows = rows.withColumn("h", F.when(F.col("fit"), F.xxhash64("embedding"))).withColumn("k", F.when(F.col("fit"), F.xxhash64(F.lit(1), "embedding")))
    several = stored(rows.where("fit").groupBy("h", "k").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "vector-copies")
    rows = rows.join(several, ["h", "k"], "left").select("vec_id", "embedding", "dim", "fit", F.when(F.col("fit"), F.coalesce("first", "vec_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    classes = rows.where("fit AND vec_id = class_id").select("vec_id", "copies", "dim", "embedding")
    number, fitted = fits(classes, least)

    def near(found: pa.Table) -> pa.Table:
        links = list(possible(found, least))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    groups = components(stored(packed(classes, number, fitted, least).groupBy("dim", "part").applyInArrow(near, "a long, b long"), "possible-links"))
    links = stored(grouped_links(classes, stored(groups, "groups"), number, fitted, least, wide), "cap-links")
    counts = links.where("n > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n_links"))
    linked = counts.join(components(links.where("n = 0").select("a", "b")).withColumnRenamed("id", "class_id"), "class_id", "left")
    # a vector's links: its own copies, and those of the classes that its class links with
    out = rows.select("vec_id", "class_id", "copies", "fit").join(linked, "class_id", "left")
    component = F.coalesce("component", "class_id", "vec_id")
    n_links = F.when(F.col("fit"), F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def grouped_links(classes: DataFrame, groups: DataFrame, number: int, fitted: dict[int, tuple[float, int]], least: float, wide: int) -> DataFrame:
    """FOUND of classes (vec_id, copies, embedding) that are in groups (id, component)."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / wide).cast("int")
    many = stored(sizes.where(F.col("m") > wide).withColumn("blocks", blocks), "large-groups")
    sparse = many.limit(0).select("component")
    if not many.isEmpty():
        # what a group takes by its filters: a row for each of their vectors that shares it, and each block of them
        inside = groups.join(many, "component").select(F.col("id").alias("vec_id"), "component")
        found = stored(decoded(classes.join(inside.select("vec_id"), "vec_id"), number, fitted, least), "decoded")
        by_filter = listed(found).join(inside, "vec_id").groupBy("component", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = by_filter.groupBy("component").agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("rows"))
        sparse = stored(many.join(rows, "component").where("rows < m * blocks").select("component"), "sparse-groups")
    whole = groups.join(sizes.where(F.col("m") <= wide), "component")
    buckets = max(1, whole.count() // WIDE)
    key = F.when(F.col("m") <= BLOCK, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    whole = whole.select("id", "component", key.alias("cell"), F.when(F.col("m") <= BLOCK, -1).otherwise(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("m") <= BLOCK, -1).otherwise(0).alias("side"))
    own = F.pmod(F.xxhash64("id", "component"), F.col("blocks")).cast("int")
    large = groups.join(many.join(sparse, "component", "left_anti"), "component").withColumn("own", own)
    large = large.select("id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("id", "component", F.col("component").alias("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    cells = classes.join(whole.unionByName(large).withColumnRenamed("id", "vec_id"), "vec_id")

    def run(cell: pa.Table) -> pa.Table:
        schema, out = schema_of(FOUND), list(compared(cell, least))
        return pa.Table.from_arrays([pa.array([x[c] for x in out], t.type) for c, t in enumerate(schema)], schema=schema)

    links = cells.select("cell", "i", "j", "component", "side", "vec_id", "copies", "embedding").groupBy("cell", "i", "j").applyInArrow(run, FOUND)
    if sparse.isEmpty():
        return links
    few = groups.join(sparse, "component").select(F.col("id").alias("vec_id"))
    return links.unionByName(filtered_links(found.join(few, "vec_id"), least))


def filtered_links(found: DataFrame, least: float) -> DataFrame:
    """FOUND of DECODED vectors: each filter compares those that it holds."""
    members = stored(listed(found), "members")
    shared = members.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = members.join(shared, "filter")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec_id", "filter"), blocks).cast("int")
    cells = member.withColumn("blocks", blocks).withColumn("own", own).select("filter", "vec_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), ((F.col("own") != F.col("other")) & (F.col("own") > F.col("other"))).cast("int").alias("side"), "vec_id")
    dealt = cells.join(found, "vec_id").select("filter", "i", "j", "side", "vec_id", "copies", "unit", "filters")
    dealt = dealt.repartition(parts(found.sparkSession), "filter", "i", "j").sortWithinPartitions("filter", "i", "j", "side", "vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple]:
            if len(held) < 2:
                return []
            ids, side, copies = (np.array([h[c] for h in held], dtype=np.int64) for c in (0, 1, 2))
            units = np.stack([np.frombuffer(h[3], dtype="<f8") for h in held])
            return list(compare(key[0], ids, copies, units, [np.frombuffer(h[4], dtype="<i8") for h in held], side if key[1] != key[2] else np.zeros(len(side), dtype=int), least))

        out: list[tuple] = []
        schema = schema_of(FOUND)
        for b in batches:
            f, i, j, side, ids, copies, units, filters = (c.to_pylist() for c in b.columns)
            for row in range(len(f)):
                if key != (new := (f[row], i[row], j[row])):
                    out += done()
                    key, held = new, []
                held.append((ids[row], side[row], copies[row], units[row], filters[row]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out = []
        out += done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(run, FOUND)


def listed(found: DataFrame) -> DataFrame:
    """Rows (filter, vec_id)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, dtype="<i8") for x in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else [], pa.int64()), pa.array(ids, pa.int64())], names=["filter", "vec_id"])

    return found.select("vec_id", "filters").mapInArrow(run, "filter long, vec_id long")
