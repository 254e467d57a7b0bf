"""Substring dedup: words covered by windows that occur in a document with a smaller id are removed.

Shards are made by content, so that a window meets all its occurrences in one shard. Of each window of ``size`` words the least hash
among its ``GRAM``-word shingles tells the shard; consecutive windows with the same one are a stretch of words. Shingles
of a single document are left out first (a grouped minimum and maximum of the ids), and with them the windows that no other document can have.

A shard has a compressed full-text index over its distinct stretches: the Burrows-Wheeler transform of their words in a wavelet matrix
of packed bits. The stretches are streamed through it: backward search extends each window word by word and leaves a window as soon
as a single suffix is left, so it computes each start's matching statistic up to ``size`` words. The smallest id among the suffixes of an
interval that reaches ``size`` words decides about the window in all its occurrences.

Equal stretches of one batch are one: only the smallest id's is in doubt, the others go because of it. So a stretch that very many documents
share is one row a batch, and windows of a shingle with more than ``HOT`` documents are routed by all their words.

The repeated shingles are broadcast where they are at most ``BROADCAST``; beyond that stretches are joined to them by their hash. Which way is
taken doesn't change the result. Hashes only route; words are compared themselves.

Defined cases: null texts have no words; fewer than ``size`` words are never removed; a document doesn't remove words of its own or of
rows with the same id; a null id is smaller than all others; repeated rows lose the same words; texts of any length are read whole; further
columns are passed through, except the operator's own (n_words, n_removed, th, spans); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import mixed, parts, schema_of, stored
from wavequarry.llm.wordsets import EACH, words_at

SIZE, GRAM = 13, 5
#: Bytes of text that are hashed at once; of stretches that are dealt at once; words of a shard (about); documents of a hot shingle; shingles that are broadcast.
CHUNK, FLUSH, SHARD, HOT, BROADCAST = 1 << 21, 1 << 24, 1 << 20, 4096, 1 << 23
NO_ID = -(1 << 63)
OWN = ("n_words", "n_removed", "th", "spans")
GRAMS = "gram long, low long, high long, n long"
ROUTED = "shard int, stretches binary"
SPANS = "doc_id long, th long, start int, stop int"


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' bytes one behind the other, where each begins, the ids and the text hashes; about ``CHUNK`` bytes at a time."""
    for b in batches:
        text = b.column(2).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
        ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        i = 0
        while i < len(filled):
            j = max(i + 1, int(np.searchsorted(offsets[filled], offsets[filled[i]] + CHUNK)))
            rows = filled[i:j]
            start, stop = offsets[rows[0]], offsets[rows[-1] + 1]
            yield data[start:stop], offsets[rows] - start, ids[rows], hashes[rows]
            i = j


class Words:
    """The words of a chunk: their hashes, their documents, and of each window of ``size`` words its routing shingle."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, size: int):
        self.h, self.doc, self.first, self.last = words_at(data, starts, EACH)
        k = min(GRAM, size)
        n = max(0, len(self.h) - size + 1)
        grams = self.h[: max(0, len(self.h) - k + 1)].copy()
        for i in range(1, k):
            grams = mixed(grams) + self.h[i : i + len(grams)]
        grams = mixed(grams)
        least = grams[:n].copy()
        for i in range(1, size - k + 1):
            np.minimum(least, grams[i : i + n], out=least)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        self.gram = least[self.at].view(np.int64)


def sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "th", "text")


def repeated_grams(docs: DataFrame, size: int) -> DataFrame:
    """The routing shingles that documents of different ids have; n counts documents (those of a batch once)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, n = schema_of(GRAMS), [], 0

        def combined() -> pa.RecordBatch:
            gram, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            last = np.r_[first[1:], len(gram)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((gram[first], doc[first], doc[last - 1], last - first), schema)], schema=schema)

        for data, starts, ids, _ in chunks(batches):
            words = Words(data, starts, size)
            if len(words.at):
                doc = words.doc[words.at]
                new = np.r_[True, (words.gram[1:] != words.gram[:-1]) | (doc[1:] != doc[:-1])]
                held.append((words.gram[new], ids[doc[new]]))
                n += int(new.sum())
            if n > 1_000_000:
                yield combined()
                held, n = [], 0
        if n:
            yield combined()

    rows = sources(docs).mapInArrow(run, GRAMS)
    return rows.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high").select("gram", "n")


class Dealt:
    """Stretches by shard. Of equal ones the smallest id's occurrences are kept; the others' spans are decided by them."""

    def __init__(self, shards: int, size: int):
        self.shards, self.size = shards, size
        self.clear()

    def clear(self) -> None:
        self.stretches: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
        self.done: dict[int, list[tuple[int, int, int, int]]] = {}
        self.bytes = 0

    def add(self, data: np.ndarray, words: Words, ids: np.ndarray, hashes: np.ndarray, keep: np.ndarray, hot: np.ndarray) -> None:
        """The kept ones of the chunk's windows, those of hot shingles each on its own."""
        at, gram, hot = words.at[keep], words.gram[keep], hot[keep]
        if not len(at):
            return
        doc = words.doc[at]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | hot[1:]])
        windows = np.r_[new[1:], len(at)] - new
        a, route = at[new], gram[new].view(np.uint64)
        whole = words.h[a].copy()
        for i in range(1, self.size):
            whole = mixed(whole) + words.h[a + i]
        route = mixed(np.where(hot[new], route + mixed(whole), route)) % np.uint64(self.shards)
        doc = words.doc[a]
        place = a - np.searchsorted(words.doc, doc)
        text, size = data.tobytes(), self.size
        for r, n, f, l, d, t, p in zip(route.tolist(), windows.tolist(), words.first[a].tolist(), words.last[a + windows + size - 2].tolist(), ids[doc].tolist(), hashes[doc].tolist(), place.tolist()):
            stretch = b" ".join(text[f : l + 1].split())
            of = self.stretches.setdefault(r, {})
            known = of.get(stretch)
            if known is None:
                of[stretch] = [(d, t, p)]
                self.bytes += len(stretch)
            elif d == known[0][0]:
                known.append((d, t, p))
            else:
                if d < known[0][0]:
                    of[stretch], gone = [(d, t, p)], known
                else:
                    gone = [(d, t, p)]
                for d, t, p in gone:
                    self.done.setdefault(d % self.shards, []).append((d, t, p, p + n + size - 1))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for shard in self.stretches.keys() | self.done.keys():
            row = (shard, packed(self.stretches.get(shard, {}), self.done.get(shard, [])))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema_of(ROUTED))], schema=schema_of(ROUTED))
        self.clear()


def packed(stretches: dict[bytes, list[tuple[int, int, int]]], done: list[tuple[int, int, int, int]]) -> bytes:
    """Stretches with their occurrences (id, text hash, first word, number of the stretch) and decided spans, as one value."""
    rows = np.array([(*o, i) for i, s in enumerate(stretches.values()) for o in s], dtype="<i8").reshape(-1, 4)
    spans = np.array(done, dtype="<i8").reshape(-1, 4)
    return zstandard.compress(np.array([len(rows), len(spans)], "<i8").tobytes() + rows.T.tobytes() + spans.T.tobytes() + b"\n".join(stretches), 3)


def unpacked(value: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(value)
    n, m = np.frombuffer(raw, "<i8", 2)
    rows, spans = (np.frombuffer(raw, "<i8", 4 * k, at).reshape(4, k).T for k, at in ((n, 16), (m, 16 + 32 * n)))
    return raw[16 + 32 * (n + m) :].split(b"\n") if n else [], rows, spans


def dealt(docs: DataFrame, repeated: DataFrame, n_repeated: int, shards: int, size: int, most: int) -> DataFrame:
    """Rows of ``ROUTED``: the stretches of repeated shingles by shard."""
    if n_repeated <= most:
        found = repeated.select("gram", (F.col("n") > HOT).alias("hot")).toArrow()
        gram, hot = found.column(0).to_numpy(), found.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(gram)
        shared = docs.sparkSession.sparkContext.broadcast((gram[order], hot[order]))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (grams, hot), out = shared.value, Dealt(shards, size)
            for data, starts, ids, hashes in chunks(batches):
                words = Words(data, starts, size)
                if len(grams):
                    k = np.minimum(np.searchsorted(grams, words.gram), len(grams) - 1)
                    out.add(data, words, ids, hashes, grams[k] == words.gram, hot[k])
                if out.bytes > FLUSH:
                    yield from out.rows()
            yield from out.rows()

        return sources(docs).mapInArrow(run, ROUTED)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("gram long, doc_id long, th long, start int, windows int")
        for data, starts, ids, hashes in chunks(batches):
            words = Words(data, starts, size)
            if len(words.at):
                doc = words.doc[words.at]
                new = np.flatnonzero(np.r_[True, (words.at[1:] != words.at[:-1] + 1) | (words.gram[1:] != words.gram[:-1]) | (doc[1:] != doc[:-1])])
                at, doc = words.at[new], doc[new]
                row = (words.gram[new], ids[doc], hashes[doc], at - np.searchsorted(words.doc, doc), np.r_[new[1:], len(words.at)] - new)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealt(shards, size)
        for b in batches:
            for i in range(len(b)):
                one = b.slice(i, 1)
                runs = one.column(3).to_pylist()[0]
                for data, starts, ids, hashes in chunks([one]):
                    words = Words(data, starts, size)
                    keep, hot = np.zeros(len(words.at), bool), np.zeros(len(words.at), bool)
                    for r in runs:
                        keep[r["start"] : r["start"] + r["windows"]] = True
                        hot[r["start"] : r["start"] + r["windows"]] = r["hot"]
                    out.add(data, words, ids, hashes, keep, hot)
                if out.bytes > FLUSH:
                    yield from out.rows()
        yield from out.rows()

    rows = sources(docs).mapInArrow(places, "gram long, doc_id long, th long, start int, windows int").join(repeated.select("gram", (F.col("n") > HOT).alias("hot")), "gram")
    runs = rows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "windows", "hot")).alias("runs"))
    return sources(docs).join(runs, ["doc_id", "th"]).select("doc_id", "th", "text", "runs").mapInArrow(joined, ROUTED)


class Numbers(dict):
    """word -> number from 1 on, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class WaveletMatrix:
    """Ranks of symbols in a sequence, of one packed bit vector a level (the symbols' highest bit first) with a count at each 64 bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n, self.levels = len(values), max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            words = np.zeros(len(values) // 64 + 1, dtype="<u8")
            as_bytes = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(as_bytes)] = as_bytes
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        every = np.arange(symbols)
        self.start = self.walk(every, np.zeros(symbols, dtype=np.int64))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & MASKS[i & 63])
            i = np.where(symbol >> level & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.walk(symbol, i) - self.start[symbol]


MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffixes(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` symbols at least; equal ones by place."""
    rank, h = sequence, 1
    while h < depth:
        base = int(rank.max(initial=0)) + 2
        fold = 3 if base**3 < 1 << 63 else 2
        key = rank + 1
        for i in range(1, fold):
            key = key * base
            key[: max(0, len(rank) - i * h)] += rank[i * h :] + 1
        rank, h = np.unique(key, return_inverse=True)[1], h * fold
    return np.argsort(rank, kind="stable")


class Index:
    """Compressed full-text index over stretches of words; suffixes are in order up to ``size`` words, so patterns up to that length are found."""

    def __init__(self, stretches: list[bytes], size: int):
        lengths = np.array([s.count(b" ") + 1 for s in stretches])
        words = b" ".join(stretches).split(b" ")
        numbers = Numbers()
        #: The words' numbers with 0 behind each stretch; the stretch of each place; where each stretch starts.
        self.of = np.repeat(np.arange(len(stretches)), lengths + 1)
        self.begin = np.r_[0, np.cumsum(lengths + 1)]
        self.sequence = np.zeros(len(self.of), dtype=np.int64)
        inside = np.ones(len(self.of), dtype=bool)
        inside[self.begin[1:] - 1] = False
        self.sequence[inside] = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        self.order = suffixes(self.sequence, size)
        symbols = len(numbers) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(self.sequence, minlength=symbols))]
        self.tree = WaveletMatrix(self.sequence[self.order - 1], symbols)
        self.size = size
        #: Where windows of ``size`` words begin.
        self.windows = np.flatnonzero(self.begin[self.of + 1] - 1 - np.arange(len(self.of)) >= size)

    def intervals(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the windows from ``starts`` on: those that more than one suffix begins with, and their intervals."""
        word = self.sequence[starts + self.size - 1]
        low, high = self.before[word], self.before[word + 1]
        for j in range(self.size - 2, -1, -1):
            more = high - low > 1
            starts, low, high = starts[more], low[more], high[more]
            word = self.sequence[starts + j]
            both = self.before[word] + self.tree.rank(np.r_[word, word], np.r_[low, high]).reshape(2, -1)
            low, high = both
        more = high - low > 1
        return starts[more], low[more], high[more]

    def smallest(self, ids: np.ndarray) -> np.ndarray:
        """For each of ``windows`` the smallest of its occurrences' ids, given each stretch's."""
        by_order = np.r_[ids[self.of[self.order]], np.iinfo(np.int64).max]
        out = ids[self.of[self.windows]]
        for i in range(0, len(self.windows), 1 << 17):
            part = self.windows[i : i + (1 << 17)]
            starts, low, high = self.intervals(part)
            if len(starts):
                each, which = np.unique(low, return_index=True)
                least = np.minimum.reduceat(by_order, np.stack([each, high[which]], 1).ravel())[::2]
                out[i + np.searchsorted(part, starts)] = least[np.searchsorted(each, low)]
        return out


def decided(stretches: list[bytes], rows: np.ndarray, size: int) -> np.ndarray:
    """Spans (id, text hash, first word, word behind the last) that are removed, of a shard's distinct stretches and their occurrences."""
    index = Index(stretches, size)
    ids = np.full(len(stretches), np.iinfo(np.int64).max)
    np.minimum.at(ids, rows[:, 3], rows[:, 0])
    later = rows[rows[:, 0] > ids[rows[:, 3]]]
    whole = np.stack([later[:, 0], later[:, 1], later[:, 2], later[:, 2] + index.begin[later[:, 3] + 1] - index.begin[later[:, 3]] - 1], 1)
    gone = index.windows[index.smallest(ids) < ids[index.of[index.windows]]]
    if not len(gone):
        return whole
    of = index.of[gone]
    first = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1])])
    stretch, start, stop = of[first], gone[first] - index.begin[of[first]], gone[np.r_[first[1:], len(gone)] - 1] + size - index.begin[of[first]]
    own = rows[rows[:, 0] == ids[rows[:, 3]]]
    own = own[np.argsort(own[:, 3], kind="stable")]
    low, high = np.searchsorted(own[:, 3], stretch), np.searchsorted(own[:, 3], stretch, side="right")
    n = high - low
    at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return np.vstack([whole, np.stack([own[at, 0], own[at, 1], own[at, 2] + np.repeat(start, n), own[at, 2] + np.repeat(stop, n)], 1)])


def removed(docs: DataFrame, size: int, most: int) -> DataFrame:
    """Rows (doc_id, th, spans): of each document that loses words the spans of words."""
    repeated = stored(repeated_grams(docs, size), "repeated-shingles")
    n, places = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(parts(docs.sparkSession), -(-places * (2 * size) // SHARD))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(SPANS)
        shard, numbers, rows = None, {}, []

        def done() -> Iterator[pa.RecordBatch]:
            if numbers:
                spans = decided(list(numbers), np.vstack(rows), size)
                yield pa.RecordBatch.from_arrays([pa.array(spans[:, i], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for i in range(len(b)):
                if b.column(0)[i].as_py() != shard:
                    yield from done()
                    shard, numbers, rows = b.column(0)[i].as_py(), {}, []
                stretches, found, spans = unpacked(b.column(1)[i].as_py())
                if len(spans):
                    yield pa.RecordBatch.from_arrays([pa.array(spans[:, i], f.type) for i, f in enumerate(schema)], schema=schema)
                if len(found):
                    own = np.array([numbers.setdefault(s, len(numbers)) for s in stretches])
                    rows.append(np.column_stack([found[:, :3], own[found[:, 3]]]))
        yield from done()

    routed = dealt(docs, repeated, n, shards, size, most).repartition(min(shards, 4096), "shard").sortWithinPartitions("shard")
    return routed.mapInArrow(run, SPANS).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = SIZE, most: int = BROADCAST) -> DataFrame:
    """``docs`` with the words that are left, joined by a space, as text (null texts stay null), and n_words (before), n_removed and the removed spans."""
    docs = docs.drop(*OWN).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = removed(docs.select("doc_id", "th", "text"), size, most).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    joined = docs.join(gone.hint("merge"), (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("th", "_id", "_th")
    names = joined.columns
    schema = joined.limit(0).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, words, cut = [], [], []
            for text, spans in zip(b.column(names.index("text")), b.column(names.index("spans")).to_pylist()):
                if text.as_py() is None:
                    left, n, gone = None, 0, 0
                else:
                    own = text.as_py().encode("utf-8", "surrogatepass").split()
                    n = gone = 0
                    if spans:
                        keep = np.ones(len(own) + 1, dtype=bool)
                        for s in spans:
                            keep[s["start"] : s["stop"]] = False
                        n, own = len(own), [own[i] for i in np.flatnonzero(keep[:-1])]
                        gone = n - len(own)
                    n, left = n or len(own), b" ".join(own).decode("utf-8", "surrogatepass")
                texts.append(left)
                words.append(n)
                cut.append(gone)
            own = {"text": pa.array(texts, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(cut, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else b.column(names.index(f.name)) for f in schema], names=schema.names)

    return joined.mapInArrow(run, schema)
