"""Ranked lexical search: range-maximum sparse tables over posting lists, best-first document intervals.

Documents lie in shards as the tasks read them; a shard has the posting lists of the asked terms in the order of its documents, each
posting with its impact (what it adds to a score). A sparse table over the lists gives the largest impact in any range of a list.
An interval of a shard's documents is bounded by the sum of its terms' range maxima. Of an item's intervals those with the largest bounds are
taken first and split at the document of the largest impact in them, which is scored itself; intervals of at most ``LEAF`` documents are
scored whole; an interval whose bound is below the item's tenth score (over all shards that the task has searched) is left out.
The tasks' best documents are merged at last.

Nothing is shuffled but these. The items are asked in blocks of ``ITEMS``: for each block one scan of the documents stores the shards, so
neither the number of items nor that of terms is held anywhere at once.

Defined cases: null texts have no term; items without terms, or whose terms no document has, have no row; rows with one item_id are one
item with the terms of all; repeated documents are ranked each; a null doc_id is the smallest; texts of any length are read whole; further columns
aren't read; an empty table on either side gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequarry.llm.shared import schema_of, stored, texts_of

#: Documents and postings of a shard; documents of an interval that is scored whole; intervals split at once; items of one block.
SHARD, POSTINGS, LEAF, WIDTH, ITEMS = 8192, 1_000_000, 64, 32, 2000
NO_ID = -(1 << 63)
SHARDS = "n_docs long, n_terms long, docs binary, lengths binary, terms binary, places binary, counts binary"
#: ASCII letters (folded), digits and every byte beyond ASCII are parts of terms.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or 48 <= x <= 57 or x > 127 else 32 for x in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def packed(values: object, dtype: str) -> bytes:
    return zstandard.compress(np.asarray(values, dtype=dtype).tobytes(), 1)


def unpacked(value: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value), dtype=dtype)


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Shards of ``docs`` with the postings of the numbered terms by term and document; n_docs and n_terms count all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # terms of one block of items

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, asked = schema_of(SHARDS), shared.value
        names = asked.keys()
        n_docs = n_terms = size = 0
        rows: list[tuple[int, int, list[int], list[int]]] = []

        def shard() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            term = np.fromiter((t for r in rows for t in r[2]), np.int32, size)
            place = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
            count = np.fromiter((c for r in rows for c in r[3]), np.int32, size)
            order = np.lexsort((place, term))
            row = (n_docs, n_terms, packed([r[0] for r in rows], "<i8"), packed([r[1] for r in rows], "<i8"), packed(term[order], "<i4"), packed(place[order], "<i4"), packed(count[order], "<i4"))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for b in batches:
            ids = b.column(0)
            for i, text in texts_of(b):
                found = Counter(terms_of(text))
                if not found:
                    continue
                n = found.total()
                n_docs, n_terms = n_docs + 1, n_terms + n
                here = names & found.keys()
                if here:
                    rows.append((NO_ID if ids[i].as_py() is None else ids[i].as_py(), n, [asked[t] for t in here], [found[t] for t in here]))
                    size += len(here)
                if len(rows) == SHARD or size > POSTINGS:
                    yield shard()
                    n_docs = n_terms = size = 0
                    rows = []
        if n_docs:
            yield shard()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SHARDS)


def document_counts(shards: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each numbered term occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            for terms in b.column(0):
                n += np.bincount(unpacked(terms.as_py(), "<i4"), minlength=n_terms)
        seen = np.flatnonzero(n)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], names=["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in shards.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


class Best:
    """The ``k`` best documents so far: largest score first, then smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.least()[0])
        scores, docs = np.r_[self.scores, scores[some]], np.r_[self.docs, docs[some]]
        first = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[first], docs[first]

    def least(self) -> tuple[int, int]:
        """The last one's score and id; a document counts if its score is larger, or equal and its id smaller."""
        return (int(self.scores[-1]), int(self.docs[-1])) if len(self.scores) == self.k else (0, NO_ID)


class Index:
    """Posting lists of a shard one behind the other, and their sparse tables."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.docs, self.places, self.impacts, self.n = docs, places, np.r_[impacts, 0], len(docs)
        self.keys = terms.astype(np.int64) * self.n + places
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1))
        longest = int(np.diff(self.starts).max(initial=1))
        #: At [k][i] where the largest impact of the 2^k postings from i on lies; ranges over two lists are never asked for.
        self.tables = [np.arange(len(places), dtype=np.int32)]
        while 2 << len(self.tables) - 1 <= longest:
            last, half = self.tables[-1], 1 << len(self.tables) - 1
            a, b = last[: len(last) - half], last[half:]
            self.tables.append(np.where(impacts[a] >= impacts[b], a, b))
        size = max(map(len, self.tables))
        self.table = np.zeros((len(self.tables), size), dtype=np.int32)
        for k, t in enumerate(self.tables):
            self.table[k, : len(t)] = t
        del self.tables
        self.log = np.frexp(np.arange(longest + 1))[1] - 1

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the largest impact in [a, b) lies; one place past the postings, of impact 0, for an empty range."""
        some = a < b
        a, b = np.where(some, a, 0), np.where(some, b, 1)
        k = self.log[b - a]
        x, y = self.table[k, a], self.table[k, b - (1 << k)]
        return np.where(some, np.where(self.impacts[x] >= self.impacts[y], x, y), len(self.impacts) - 1)

    def search(self, terms: np.ndarray, best: Best) -> None:
        terms = terms[self.starts[terms] < self.starts[terms + 1]]
        if not len(terms):
            return
        base = terms.astype(np.int64) * self.n
        # of each open interval: its bound, its first and last document, and its range of each list
        a, b = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        first, end = np.array([0]), np.array([self.n])
        top = self.largest(a, b)
        bound = self.impacts[top].sum(1)
        while len(bound):
            score, doc = best.least()
            open_ = (bound > score) | (bound == score) & (bound > 0) & (self.docs[np.minimum(first, self.n - 1)] < doc)
            bound, first, end, a, b, top = (x[open_] for x in (bound, first, end, a, b, top))
            if not len(bound):
                break
            now = np.argsort(-bound, kind="stable")[:WIDTH]
            rest = np.ones(len(bound), dtype=bool)
            rest[now] = False
            leaf = now[end[now] - first[now] <= LEAF]
            if len(leaf):
                x, y = a[leaf].ravel(), b[leaf].ravel()
                n = y - x
                at = np.repeat(x - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                places, which = np.unique(self.places[at], return_inverse=True)
                best.add(np.bincount(which, self.impacts[at]).astype(np.int64), self.docs[places])  # sums below 2^53
            cut = now[end[now] - first[now] > LEAF]
            if len(cut):
                tops = top[cut]
                place = self.places[np.take_along_axis(tops, self.impacts[tops].argmax(1)[:, None], 1)[:, 0]]
                c = np.clip(np.searchsorted(self.keys, base[None, :] + place[:, None]), a[cut], b[cut])
                hit = (c < b[cut]) & (self.places[np.minimum(c, len(self.places) - 1)] == place[:, None])
                best.add((self.impacts[c] * hit).sum(1), self.docs[place])
                a2, b2 = np.vstack([a[cut], c + hit]), np.vstack([c, b[cut]])
                top2 = self.largest(a2, b2)
                new = (self.impacts[top2].sum(1), np.r_[first[cut], place + 1], np.r_[place, end[cut]], a2, b2, top2)
                bound, first, end, a, b, top = (np.concatenate([x[rest], y]) for x, y in zip((bound, first, end, a, b, top), new))
            else:
                bound, first, end, a, b, top = (x[rest] for x in (bound, first, end, a, b, top))


def best_of(shards: DataFrame, items: list[tuple[int | None, np.ndarray]], n_terms: int, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score): the best documents of each task's shards for each item."""
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, length = total[0] or 0, total[1] or 1
    counts = document_counts(shards, n_terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in counts], dtype=np.int64)
    shared = shards.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        for b in batches:
            for row in range(len(b)):
                docs, lengths, terms, places, counts = (unpacked(b.column(i)[row].as_py(), t) for i, t in enumerate(("<i8", "<i8", "<i4", "<i4", "<i4")))
                if not len(terms):
                    continue
                m = 100 - 90 + 90 * lengths * n_docs // length
                tf = counts.astype(np.int64)
                index = Index(docs, terms, places, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[places])), n_terms)
                for (_, asked), found in zip(items, best):
                    index.search(asked, found)
        rows = [(item, None if d == NO_ID else int(d), int(s)) for (item, _), f in zip(items, best) for d, s in zip(f.docs, f.scores)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item_id", "doc_id", "score"])

    return shards.select("docs", "lengths", "terms", "places", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of each item."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id").toLocalIterator()
    found, block, numbers = None, [], {}

    def ask() -> None:
        nonlocal found, block, numbers
        if numbers:
            best = stored(best_of(stored(postings(docs, numbers), "postings"), block, len(numbers), k), "best")
            found = best if found is None else found.unionByName(best)
        block, numbers = [], {}

    for item, texts in groupby(rows, key=lambda r: r["item_id"]):
        terms = {t for r in texts for t in terms_of(r["text"])}
        block.append((item, np.array(sorted({numbers.setdefault(t, len(numbers)) for t in sorted(terms)}), dtype=np.int64)))
        if len(block) == ITEMS:
            ask()
    ask()
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
