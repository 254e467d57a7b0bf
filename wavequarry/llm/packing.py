"""Lexical retrieval packing: documents cut into training sequences with their lexical neighbours.

Every full window of a document is a sequence of its own. What is left of each document, its tail, goes to a shard of
lexically close tails, in the order of two min-hashes of its rare ids. A shard holds a BM25 inverted index over token ids (document counts are taken over the whole
corpus); each seed tail retrieves unused neighbours, those that fit fill its window greedily, and the best neighbour
that doesn't fit is cut, its rest staying in the shard. So only the last window of a partition can be short; it is cut
into sequences whose lengths are powers of two, which need no padding. A seed asks with its ``TERMS`` rarest ids and looks at the
``LOOKED_AT`` best tails at a time, until the window is full; the order decides where no unused tail of the shard shares one of them.

Defined cases: a null or empty text is the single closing id 0; equal tails are ordered by id, then by text; rows with
a null id are packed like others; repeated ids are packed once per row; further columns aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import MIX, mixed, parts, schema_of, stored, texts_of

WINDOW = 1024
#: Tails of one index; query terms of a seed; neighbours looked at; BM25's two constants; an id is rare in a share of 1 / RARE of the documents.
SHARD, TERMS, LOOKED_AT, K1, B, RARE = 2048, 24, 48, 1.2, 0.75, 100
TOKENS = "doc_id long, doc_tokens long, ids binary"
TAILS = "doc_id long, start long, doc_tokens long, ids binary, key_a long, key_b long"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: The byte-level pre-tokenizer's own pattern, as its makers published it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of texts by a ``tokenizers`` file, as bytes.

    Texts of a byte-level BPE go through ``tiktoken``, with the vocabulary of the same file as ranks, where the
    file's merges come in the order of their ids: then both give the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        by_word = self.model.normalizer is None and type(self.model.pre_tokenizer).__name__ == "ByteLevel" and not self.model.pre_tokenizer.add_prefix_space
        self.ranked = self.ranks() if by_word else None

    def ranks(self):
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        told = json.loads(self.model.to_str())["model"]
        vocabulary, merges = told["vocab"], [m.split(" ") if isinstance(m, str) else m for m in told["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(made) or told["type"] != "BPE":
            return None
        # the printable stand-ins of the bytes: those that print stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in printable]
        byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}
        if set(byte) != set(ByteLevel.alphabet()):
            return None
        tokens = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        if self.ranked is None or any(s in text for s in self.special):
            return self.plain([text])[0]
        found = array("H" if self.dtype.itemsize == 2 else "I", self.ranked.encode_ordinary(text))
        return found.tobytes() if sys.byteorder == "little" else np.array(found, dtype=self.dtype).tobytes()


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """One for all tasks of a Python worker."""
    return Tokenizer(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, its number of ids (with the closing 0), the ids."""
    schema = schema_of(TOKENS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            numbers, rows, size = b.column(0), [], 0
            for i, text in texts_of(b):
                ids = t.ids(text) + bytes(t.dtype.itemsize)
                rows.append((numbers[i].as_py(), len(ids) // t.dtype.itemsize, ids))
                size += len(ids)
                if size > 8_000_000 or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def document_counts(tokens: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """In how many documents each id occurs; the vocabulary bounds what reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            for ids in b.column(0):
                n[np.unique(np.frombuffer(ids.as_buffer(), dtype=dtype))] += 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["id", "n"])

    found = np.zeros(vocabulary, dtype=np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        found[row["id"]] = row["n"]
    return found


def order_keys(counts: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Two values of each id whose least ones order tails: hashes, those of rare ids (in several documents, but few) below all others."""
    h = mixed(np.arange(1, len(counts) + 1, dtype=np.uint64))
    common = np.where((counts > 1) & (counts * RARE <= max(n_docs, 2 * RARE)), np.uint64(0), np.uint64(1 << 62))
    return [((x >> np.uint64(2)) | common).astype(np.int64) for x in (h, h * MIX)]


class Shard:
    """Tails with an inverted index of BM25 weights."""

    def __init__(self, tails: list[tuple], counts: np.ndarray, n_docs: int, mean: float):
        self.tails = tails  # (doc_id, start, ids, doc_tokens)
        self.size = np.array([len(t[2]) for t in tails])
        owner = np.repeat(np.arange(len(tails)), self.size)
        terms = np.concatenate([t[2] for t in tails]).astype(np.int64)
        key, tf = np.unique(terms * len(tails) + owner, return_counts=True)
        term, self.doc = key // len(tails), key % len(tails)
        idf = np.log1p((n_docs - counts[term] + 0.5) / (counts[term] + 0.5))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.size[self.doc] / mean))
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.term, self.first, self.end = term[starts], starts, np.r_[starts[1:], len(term)]
        self.idf = idf[starts]
        self.posting = np.repeat(np.arange(len(starts)), self.end - starts)
        by_doc = np.argsort(self.doc, kind="stable")
        self.of_doc = self.posting[by_doc]
        self.bounds = np.searchsorted(self.doc[by_doc], np.arange(len(tails) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused tails that share a query term with the seed, best first."""
        p = self.of_doc[self.bounds[seed] : self.bounds[seed + 1]]
        p = p[self.end[p] - self.first[p] > 1]  # terms that some other tail has
        if not len(p):
            return p
        if len(p) > TERMS:
            p = p[np.argpartition(-self.idf[p], TERMS)[:TERMS]]
        at = np.concatenate([np.arange(self.first[i], self.end[i]) for i in p])
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.tails)) * unused
        best = np.argpartition(-score, LOOKED_AT)[:LOOKED_AT] if len(score) > LOOKED_AT else np.arange(len(score))
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def windows(shard: Shard, window: int, carried: list[tuple]) -> Iterator[list[tuple]]:
    """Windows as lists of (doc_id, start, ids, doc_tokens); all but the last yielded are full. carried: pieces that open the first."""
    n = len(shard.tails)
    unused, begin = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
    size, cursor = shard.size.copy(), 0
    pieces = list(carried)
    room = window - sum(len(p[2]) for p in pieces)

    def take(i: int, most: int) -> int:
        doc, start, ids, total = shard.tails[i]
        got, b = min(int(size[i]), most), int(begin[i])
        pieces.append((doc, start + b, ids[b : b + got], total))
        begin[i] += got
        size[i] -= got
        unused[i] = size[i] > 0
        return got

    while True:
        while cursor < n and not unused[cursor]:
            cursor += 1
        if cursor == n:
            break
        seed = cursor
        room -= take(seed, room)
        if room:
            ranked = shard.neighbours(seed, unused)
            for i in ranked:
                if size[i] <= room:
                    room -= take(i, room)
                    if not room:
                        break
            if room:
                rest = ranked[unused[ranked]] if len(ranked) else ranked
                while room:
                    if not len(rest):  # all that were looked at are used up: the next best ones
                        rest = shard.neighbours(seed, unused)
                    if len(rest):
                        i, rest = rest[0], rest[1:]
                    else:
                        while cursor < n and not unused[cursor]:
                            cursor += 1
                        if cursor == n:
                            break
                        i = cursor
                    room -= take(i, room)
        if not room:
            yield pieces
            pieces, room = [], window
    if pieces:
        yield pieces


def powers(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """A short window cut into sequences whose lengths are falling powers of two."""
    left = sum(len(p[2]) for p in pieces)
    pieces = pieces[::-1]
    while left:
        size = min(window, 1 << (left.bit_length() - 1))
        out, need = [], size
        while need:
            doc, start, ids, total = pieces.pop()
            out.append((doc, start, ids[:need], total))
            if len(ids) > need:
                pieces.append((doc, start + need, ids[need:], total))
            need -= len(out[-1][2])
        left -= size
        yield out


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of documents with their place in the sequences; columns as in ``PIECES``.

    ids: the piece's token ids, little-endian unsigned 32-bit. path: a file of the ``tokenizers`` library.
    """
    model = tokenizer(path)
    dtype, vocabulary = model.dtype, model.model.get_vocab_size()
    width = dtype.itemsize
    tokens = stored(tokenized(docs, path), "tokens")
    counts = document_counts(tokens, dtype, vocabulary)
    tail = F.col("doc_tokens") % window
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(tail > 0, tail)).alias("mean")).first()
    n_docs, mean = totals["n"], totals["mean"] or 1.0
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = schema_of(PIECES)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def rows_of(pieces: list[tuple], sequence: int) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
            offset += len(ids)
        return out

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        for b in batches:
            numbers, totals = (b.column(i).to_pylist() for i in (0, 1))
            rows: list[tuple] = []
            for i, value in enumerate(b.column(2)):
                ids = np.frombuffer(value.as_buffer(), dtype=dtype).astype("<u4")
                for j in range(totals[i] // window):
                    rows.append((numbers[i], j * window, window, ids[j * window : (j + 1) * window].tobytes(), totals[i], 2 * sequence, 0))
                    sequence += 1
                if len(rows) > 2000 or rows and i == len(b) - 1:
                    yield batch(rows)
                    rows = []

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        carried: list[tuple] = []
        held: list[tuple] = []

        def fill() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, carried, held
            rows: list[tuple] = []
            found = windows(Shard(held, shared.value, n_docs, mean), window, carried)
            carried, held = [], []
            for pieces in found:
                if sum(len(p[2]) for p in pieces) < window:
                    carried = pieces
                    continue
                rows += rows_of(pieces, 2 * sequence + 1)
                sequence += 1
            if rows:
                yield batch(rows)

        for b in batches:
            numbers, starts, totals = (b.column(i).to_pylist() for i in range(3))
            for i, value in enumerate(b.column(3)):
                held.append((numbers[i], starts[i], np.frombuffer(value.as_py(), dtype=dtype), totals[i]))
                if len(held) == SHARD:
                    yield from fill()
        if held:
            yield from fill()
        for pieces in powers(carried, window):
            yield batch(rows_of(pieces, 2 * sequence + 1))
            sequence += 1

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = order_keys(shared.value, n_docs)
        for b in batches:
            if len(b):
                ends = np.frombuffer(b.column(3).buffers()[1], dtype="<i4")[b.column(3).offset :][: len(b) + 1] // width
                at = np.frombuffer(b.column(3).buffers()[2], dtype=dtype)[ends[0] : ends[-1]]
                keys = [pa.array(np.minimum.reduceat(v[at], ends[:-1] - ends[0])) for v in values]
                yield pa.RecordBatch.from_arrays([*b.columns, *keys], names=[f.name for f in schema_of(TAILS)])

    whole_pieces = tokens.where(F.col("doc_tokens") >= window).select("doc_id", "doc_tokens", "ids").mapInArrow(whole, PIECES)
    begins = F.col("doc_tokens") - tail
    tails = tokens.where(tail > 0).select("doc_id", begins.alias("start"), "doc_tokens", F.expr(f"substring(ids, CAST((doc_tokens - doc_tokens % {window}) * {width} + 1 AS INT))").alias("ids")).mapInArrow(keyed, TAILS)
    # the driver samples the keys of the ranges, so they are numbers alone
    order = ["key_a", "key_b", "doc_id", "tie"]
    dealt = tails.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return whole_pieces.unionByName(dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(packed, PIECES))
