"""Exact Jaccard self-join of 5-word shingle sets by signature trees, reported as components.

1. Equal sets are one class, represented by its smallest id.
2. Shingles are ordered by hash. Linked sets share at least ``l`` shingles of their prefixes of n - t + l (t: the least
   overlap of a set of n with any other). Counting the shared prefix shingles of every class, under a hash of its set that all
   its members have, leaves the few that can link at all; a map task joins what repeats in its own rows beforehand.
3. Each shingle of the least prefixes of those sets, the rarest shingles first, is the root of a signature tree: two sets
   that link are below a common root. Below it lie blocks of about ``BLOCK`` sets, bulk-loaded by size and least shingle into
   nodes that carry the OR of their sets' bitmaps, ranges of sizes and least bitmap counts.
4. First traversal, of the rarest and the commonest root of each set only: every block against itself and against the
   root's first block, so the work is linear in a root's sets. The dual traversal drops node pairs whose greatest possible
   overlap is too small and proposes for each set the partner of the greatest possible overlap before it. Those are
   verified and give components, which join most groups of copies.
5. Where a root still holds several components, its hub, the set with the most links so far, is tried against the sets of
   other components: a group whose members are near one original and less near each other is joined in linear work.
6. Second traversal, of all roots that hold several components even then: sets of a large component have blocks of their
   own, and no block meets another one of its own component. The dual traversal also drops node pairs that are one
   component already, and all pairs that are left and were not tried yet are verified.

Only pairs that meet below a root are verified, by intersecting the whole sets, so links are exact (shingles are told
apart by 64-bit hashes).

Defined cases: null, empty and blank texts have no shingles and link with nothing; rows without an id link with nothing and
have no component; repeated ids are one node; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavequarry.llm.shared import components, parts, schema_of, stored
from wavequarry.llm.wordsets import sets_of

#: Share of a set by which the counted prefix is longer than the least one; bits of a signature; sets in a block; children
#: of a node; pairs of one set that a task verifies; shingles that a map task joins at once; pairs of bitmaps that are compared at once.
EXTRA, BITS, BLOCK, FAN, PAIRS, JOINED, AT_ONCE = 0.15, 4096, 256, 4, 1024, 600_000, 4096
NONE = np.iinfo(np.int64).min
SETS = "doc_id long, n long, h1 long, h2 long"
OWNED = "token long, owner long, n long"
PAIR = "a long, b long"
FULL = "doc_id long, n long, low long, signature binary, tokens binary"


def least_overlap(n: int) -> int:
    return -(-3 * n // 4)


def extra(n: int) -> int:
    return int(EXTRA * n)


def batched(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = schema_of(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def hashes(s: np.ndarray) -> tuple[int, int]:
    """h1, h2 of a set; h2 is odd, so it is never NONE."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63) | 1


def set_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for number, s in zip(b.column(0).to_pylist(), sets_of(b.column(1))):
                rows.append((number, len(s), *hashes(s)))
            if rows:
                yield batched(rows, SETS)

    return docs.mapInArrow(run, SETS)


def shared_counts(docs: DataFrame) -> DataFrame:
    """h2, c: how many of the counted prefix shingles of a class occur in that of another one, whichever members are read. A shingle
    counts again in each map task that joins it beforehand, which lets too many pass and none too few."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, seen, size = [], [], set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tokens, owners, seen, size
            if not tokens:
                return
            token = np.concatenate(tokens)
            owner = np.repeat(np.array(owners, dtype=np.int64), [len(t) for t in tokens])
            tokens, owners, seen, size = [], [], set(), 0
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[starts, len(token)])
            here, n = np.unique(owner[np.repeat(count > 1, count)], return_counts=True)
            # what repeats here is counted here; for other tasks it is one row that stands for several classes
            token, owner = np.r_[token[starts].view(np.int64), here], np.r_[np.where(count > 1, NONE, owner[starts]), here]
            n = np.r_[np.zeros(len(starts), dtype=np.int64), n]
            del order, starts, count
            for i in range(0, len(token), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (token, owner, n)], names=["token", "owner", "n"])

        for b in batches:
            for number, s in zip(b.column(0).to_pylist(), sets_of(b.column(1))):
                if number is None or not len(s) or (key := hashes(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                tokens.append(s[: n - least_overlap(n) + 1 + extra(n)])
                owners.append(key[1])
                size += len(tokens[-1])
                if size > JOINED:
                    yield from flush()
        yield from flush()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last shingle so far, which the next batch may go on with

        def shared(token: np.ndarray, owner: np.ndarray) -> None:
            new = np.r_[True, token[1:] != token[:-1]]
            distinct = new | np.r_[True, owner[1:] != owner[:-1]]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(token)]
            several = np.repeat(owner[starts] != owner[ends - 1], ends - starts)
            found.append(np.unique(owner[several & distinct & (owner != NONE)], return_counts=True))

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], names=["h2", "c"])
            found.clear()
            return batch

        for b in batches:
            token, owner, n = (c.to_numpy() for c in b.columns)
            if (n > 0).any():
                found.append((owner[n > 0], n[n > 0]))
                token, owner = token[n == 0], owner[n == 0]
            if len(token):
                cut = int(np.searchsorted(token, token[-1]))
                if cut or held and held[0][0][0] != token[-1]:
                    shared(np.concatenate([*(h[0] for h in held), token[:cut]]), np.concatenate([*(h[1] for h in held), owner[:cut]]))
                    held.clear()
                held.append((token[cut:], owner[cut:]))
            if sum(len(f[0]) for f in found) > 100_000:
                yield done()
        if held:
            shared(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        if found:
            yield done()

    dealt = docs.mapInArrow(deal, OWNED).repartition(parts(docs.sparkSession), "token").sortWithinPartitions("token", "owner")
    return dealt.mapInArrow(count, "h2 long, c long").groupBy("h2").agg(F.sum("c").alias("c"))


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for number, s in zip(b.column(0).to_pylist(), sets_of(b.column(1))):
                bits = np.zeros(BITS // 8, dtype=np.uint8)
                at = np.unique((s >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
                np.bitwise_or.at(bits, at // 8, np.left_shift(1, at % 8).astype(np.uint8))
                rows.append((number, len(s), int(s[0] >> np.uint64(1)) if len(s) else 0, bits.tobytes(), s.tobytes()))
                size += len(s)
                if size > 1_000_000:
                    yield batched(rows, FULL)
                    rows, size = [], 0
            if rows:
                yield batched(rows, FULL)

    return docs.mapInArrow(run, FULL)


def listed(sets: DataFrame) -> DataFrame:
    """Rows (token, doc_id, n, outer) of the least prefixes in the order of how many of the sets have a shingle, then its
    hash; outer: whether it is the first or the last of the set's.

    Shingles of a single set come first; they take part of the prefix and are no root. So a set with more of them than
    the least overlap leaves over is below no root at all, and shingles of common passages come last.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, dtype="<i8") for x in b.column(2).to_pylist()]
            if lists:
                sizes = [len(x) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.repeat(b.column(1).to_numpy(), sizes))], names=["token", "doc_id", "n"])

    every = sets.select("doc_id", "n", "tokens").mapInArrow(run, "token long, doc_id long, n long")
    counts = every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = every.join(counts, "token").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    prefix = F.expr("n - cast(ceil(0.75D * n) as int) + 1") - (F.col("n") - F.size("common"))
    roots = common.where(prefix > 0).select("doc_id", "n", F.slice("common", F.lit(1), prefix.cast("int")).alias("roots"))
    return roots.select(F.posexplode("roots").alias("k", "c"), "doc_id", "n", F.size("roots").alias("last")).select("c.token", "doc_id", "n", ((F.col("k") == 0) | (F.col("k") == F.col("last") - 1)).alias("outer"))


def with_tokens(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the shingles of the set ``side``. A set with many pairs is dealt to several tasks, some of its pairs to each."""
    counts = pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("blocks"))
    dealt = sets.select("doc_id", F.col("tokens").alias(f"{side}_tokens")).join(counts, F.col("doc_id") == F.col("id")).select("id", f"{side}_tokens", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    many = counts.where("blocks > 1")
    numbered = pairs.join(many, F.col(side) == F.col("id"), "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(other), "blocks")).otherwise(0).cast("int")).drop("id", "blocks")
    return numbered.join(dealt.hint("merge"), (numbered[side] == dealt["id"]) & (numbered["block"] == dealt["block"])).drop("id", "block", "blocks")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    both = with_tokens(with_tokens(pairs, sets, "a", "b"), sets, "b", "a")
    return both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long")


class Tree:
    """Levels of nodes over sets in order of size: OR of bitmaps, ranges of sizes, least bitmap count, component (-1: several)."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, groups: np.ndarray):
        count = np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, count, groups)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, count, group = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            same = np.minimum.reduceat(group, at) == np.maximum.reduceat(group, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(count, at), np.where(same, group[at], -1)))


def counted(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, both) -> np.ndarray:
    """Bits in both(a[i], b[j]) of each pair, a bounded number of pairs at once."""
    parts_ = [np.bitwise_count(both(a[i[k : k + AT_ONCE]], b[j[k : k + AT_ONCE]])).sum(axis=1, dtype=np.int64) for k in range(0, len(i), AT_ONCE)]
    return np.concatenate(parts_) if parts_ else np.empty(0, dtype=np.int64)


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether some set below node i of a can overlap enough with one below node j of b."""
    common = counted(a[0], i, b[0], j, np.bitwise_and)
    # bits that a set has and no set of the other node has stand for shingles of its own
    most = np.minimum(a[2][i] - np.maximum(0, a[3][i] - common), b[2][j] - np.maximum(0, b[3][j] - common))
    fits = 7 * most >= 3 * (a[1][i] + b[1][j])
    near = (4 * a[2][i] >= 3 * b[1][j]) & (4 * b[2][j] >= 3 * a[1][i])
    apart = (a[4][i] != b[4][j]) | (a[4][i] == -1)
    return fits & near & apart


def dual(x: Tree, y: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may link and lie in different components."""
    p, q = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        keep = possible(x.levels[p], i, y.levels[q], j)
        i, j = i[keep], j[keep]
        if p == q == 0 or not len(i):
            return i, j
        if p >= q:
            i, j, p = np.repeat(i * FAN, FAN) + np.tile(np.arange(FAN), len(i)), np.repeat(j, FAN), p - 1
            keep = i < len(x.levels[p][0])
            i, j = i[keep], j[keep]
        if q > p:
            j, i, q = np.repeat(j * FAN, FAN) + np.tile(np.arange(FAN), len(j)), np.repeat(i, FAN), q - 1
            keep = j < len(y.levels[q][0])
            i, j = i[keep], j[keep]
        if same and p == q:
            keep = i <= j
            i, j = i[keep], j[keep]


def nearest(x: Tree, y: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the leaf pairs, for each j the one with the greatest share of common bits."""
    a, b = x.levels[0][0], y.levels[0][0]
    share = counted(a, i, b, j, np.bitwise_and) / np.maximum(1, counted(a, i, b, j, np.bitwise_or))
    order = np.lexsort((i, -share, j))
    i, j = i[order], j[order]
    first = np.r_[True, j[1:] != j[:-1]][: len(j)]
    return i[first], j[first]


def tree_pairs(cells: DataFrame, first: bool) -> DataFrame:
    """Pairs (a, b), a > b, that the trees propose. cells: token, i, j (two blocks below one root), side, doc_id, n, low, signature,
    component. first: of each set of block j only the nearest partner, within a block among those before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], set()

        def done() -> None:
            if len(held) < 2:
                return
            side, ids, sizes, low, groups = (np.array([h[c] for h in held], dtype=np.int64) for c in (0, 1, 2, 3, 5))
            bitmaps = np.stack([np.frombuffer(h[4], dtype="<u8") for h in held])
            # near sets lie together: by size in steps of an eighth, then by their least shingle
            order = np.lexsort((ids, low, np.floor(np.log(sizes) / np.log(1.125))))
            same = key[1] == key[2]
            halves = [order, order] if same else [order[side[order] == s] for s in (0, 1)]
            if not len(halves[0]) or not len(halves[1]):
                return
            one = Tree(sizes[halves[0]], bitmaps[halves[0]], groups[halves[0]])
            two = one if same else Tree(sizes[halves[1]], bitmaps[halves[1]], groups[halves[1]])
            i, j = dual(one, two, same)
            if same:
                i, j = i[i < j], j[i < j]
            if first:
                i, j = nearest(one, two, i, j)
            a, b = ids[halves[0]][i], ids[halves[1]][j]
            out.update((max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y)

        for b in batches:
            token, i, j, *rest = (c.to_pylist() for c in b.columns)
            for row, values in enumerate(zip(*rest)):
                if key != (new := (token[row], i[row], j[row])):
                    done()
                    key, held = new, []
                    if len(out) > 20_000:
                        yield batched(sorted(out), PAIR)
                        out = set()
                held.append(values)
        done()
        if out:
            yield batched(sorted(out), PAIR)

    return cells.select("token", "i", "j", "side", "doc_id", "n", "low", "signature", "component").mapInArrow(run, PAIR).distinct()


def own_block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "token"), blocks).cast("int")


def first_cells(members: DataFrame) -> DataFrame:
    """token, i, j, side, doc_id of the first traversal: each block of a root with itself and with the root's first block."""
    outer = members.where("outer").select("token", "doc_id")
    blocks = outer.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = outer.join(blocks, "token").withColumn("own", own_block(F.col("blocks")))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    zero, own = F.lit(0), F.col("own")
    others = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda j: cell(zero, j, 0)))
    of_first = F.concat(F.array(cell(zero, zero, 0)), F.coalesce(others, F.slice(F.array(cell(zero, zero, 0)), 1, 0)))
    return rows.select("token", "doc_id", F.explode(F.when(own == 0, of_first).otherwise(F.array(cell(own, own, 0), cell(zero, own, 1)))).alias("cell")).select("token", "cell.*", "doc_id")


def second_cells(members: DataFrame) -> DataFrame:
    """token, i, j, side, doc_id, component of the second traversal. members: token, doc_id, n, component.

    A part of a root is the sets of one component that fills a block, or all its other sets; i and j number the blocks
    of all parts. Blocks meet where their sizes can link, but not within a part of one component.
    """
    each = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most"))
    named = stored(each.withColumn("part", F.when(F.col("c") >= BLOCK, F.col("component"))), "root-parts")
    sizes = named.groupBy("token", "part").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"), F.min("least").alias("least"), F.max("most").alias("most"))
    # few rows a root: one for each of its large components and one for all the rest
    at = Window.partitionBy("token").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("begin", F.coalesce(F.sum("blocks").over(at), F.lit(0)).cast("int")), "root-blocks")
    left, right = (sizes.select("token", *[F.col(c).alias(f"{side}_{c}") for c in sizes.columns[1:]]) for side in "xy")
    fits = (4 * F.col("x_most") >= 3 * F.col("y_least")) & (4 * F.col("y_most") >= 3 * F.col("x_least"))
    meets = left.join(right, "token").where(fits & ((F.col("x_begin") < F.col("y_begin")) | (F.col("x_begin") == F.col("y_begin")) & F.col("x_part").isNull()))
    # what the sets of a part do: the blocks of other parts that each of its own blocks meets, and on which side
    does = meets.select("token", F.explode(F.array(F.struct(F.col("x_begin").alias("begin"), F.lit(0).alias("side"), F.col("y_begin").alias("from"), F.col("y_blocks").alias("n")), F.struct(F.col("y_begin").alias("begin"), F.lit(1).alias("side"), F.col("x_begin").alias("from"), F.col("x_blocks").alias("n")))).alias("d")).select("token", "d.*").distinct()
    rows = members.join(named.select("token", "component", "part"), ["token", "component"]).join(sizes.select(F.col("token").alias("t"), F.col("part").alias("p"), "blocks", "begin"), (F.col("token") == F.col("t")) & F.col("part").eqNullSafe(F.col("p")))
    rows = rows.select("token", "doc_id", "component", "begin", (own_block(F.col("blocks")) + F.col("begin")).alias("own"))
    rows = rows.join(does, ["token", "begin"]).select("token", "doc_id", "component", "own", "begin", "from", "side", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("other"))
    inside = F.col("begin") == F.col("from")  # both sides of a part that meets itself come from its own rows: once as they are
    rows = rows.where(~inside | (F.col("side") == 0))
    i = F.when(inside, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    j = F.when(inside, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    return rows.select("token", i.alias("i"), j.alias("j"), F.when(inside, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"), "doc_id", "component")


def components_of_roots(members: DataFrame, groups: DataFrame) -> DataFrame:
    """token, doc_id, n, component below the roots that hold several components."""
    now = members.join(groups, members["doc_id"] == groups["id"], "left").select("token", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    now = stored(now, "root-components")
    open_ = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return stored(now.join(open_, "token"), "open-roots")


def hub_pairs(open_: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of each root's hub and the sets of other components below the root whose sizes fit."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    linked_ = open_.join(degrees, open_["doc_id"] == degrees["id"])
    hubs = linked_.groupBy("token").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"), "n", "component")).alias("hub"))
    hubs = hubs.select("token", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("m"), F.col("hub.component").alias("of"))
    meets = open_.join(hubs, "token").where("component <> of AND 4 * n >= 3 * m AND 4 * m >= 3 * n")
    return meets.select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b")).distinct()


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(set_rows(rows), "sets")
    classes = stored(sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id")).where("class_id IS NOT NULL"), "classes")

    # the counted prefixes of two linked sets share as many shingles as the smaller set must, and that is at least 3/4 as large
    need = F.floor(F.floor((3 * F.col("n") + 3) / 4) * EXTRA) + 1
    able = shared_counts(rows).join(classes, "h2").where(F.col("c") >= need).select(F.col("class_id").alias("doc_id"))
    able = stored(able, "able")
    full = stored(full_sets(rows.join(able.hint("merge"), "doc_id", "left_semi")), "full-sets")
    members = stored(listed(full), "roots")

    def proposed(cells: DataFrame, first: bool) -> DataFrame:
        filled = cells.join(full.select("doc_id", "n", "low", "signature"), "doc_id").repartition(parts(docs.sparkSession), "token", "i", "j")
        return tree_pairs(filled.sortWithinPartitions("token", "i", "j", "side", "doc_id"), first)

    # in the first traversal every set is a component of its own
    pairs = stored(proposed(first_cells(members).withColumn("component", F.col("doc_id")), True), "first-pairs")
    links = stored(linked(pairs, full), "first-links")
    groups = stored(components(links), "first-components")
    tried = stored(hub_pairs(components_of_roots(members, groups), links).join(pairs, ["a", "b"], "left_anti"), "hub-pairs")
    more = stored(linked(tried, full), "hub-links")
    star = lambda g: g.select(F.col("id").alias("a"), F.col("component").alias("b"))
    groups = stored(components(star(groups).unionByName(more)), "hub-components")
    left = proposed(second_cells(components_of_roots(members, groups)), False).join(pairs.unionByName(tried), ["a", "b"], "left_anti")
    groups = components(star(groups).unionByName(stored(linked(stored(left, "second-pairs"), full), "second-links")))

    named = sets.join(classes.drop("n"), ["h1", "h2"], "left")
    named = named.join(groups, named["class_id"] == groups["id"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
