"""Document fingerprints by winnowing.

``fingerprints``: rolling hashes of the k-character grams of a text, the minimum of every window of w consecutive
grams with ties to the rightmost, each chosen gram kept once with its position. Any stretch of w + k - 1 characters
that two texts share is found in both fingerprints.

``fingerprint_edits`` compares each document with an edited copy of itself and with its successor in ascending id.

Defined cases: a null text is empty; an empty text has the empty fingerprint; a text of fewer than k characters has
one gram, the whole text; a text with fewer than w grams has one window; equal texts have equal fingerprints; two empty
fingerprints have likeness 1, an empty and another one 0; further columns of the input are not read; an empty table
gives an empty result. Repeated ids are neighbours in the order of
their text; rows without an id come before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import mixed, parts, schema_of, texts_of

K, WINDOW = 8, 16
EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: stands for a missing id: the least long
NO_ID = -(1 << 63)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams. Grams of doubled length are joined from two halves, so a gram costs log2(k) steps."""
    n = len(points)
    if n < k:
        k = n
    h, length = mixed(points.astype(np.uint64) + np.uint64(1)), 1
    while length < k:
        step = min(length, k - length)
        h = mixed(h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:])
        length += step
    return h >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the chosen grams, by position."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = rolling(code_points(text), k)
    n, size = len(h), min(window, len(h))
    # equal hashes: the later position has the smaller key
    low = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    length = 1
    while length < size:
        step = min(length, size - length)
        low = np.minimum(low[: len(low) - step], low[step:])
        length += step
    low = low[np.r_[True, low[1:] != low[:-1]]]
    return (low >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def encoded(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Hexadecimal: 8 digits of the hash and 8 of the position for each chosen gram."""
    return np.stack([hashes, positions], axis=1).astype(">u4").tobytes().hex() if len(hashes) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two arrays of distinct sorted hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, follower: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + follower[:cut]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, fingerprint (see ``encoded``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoded(*winnow(t, k, window)) for _, t in texts_of(b)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def chained(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows (block, last, doc_id, text): blocks of consecutive ids, each with the first document of the next block behind
    it (``last`` 1; it closes the block and isn't one of its documents). The last block is followed by the first one.

    The bounds of the blocks are quantiles of the ids, so many that a block fits in a task; only they reach the driver.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark, n = docs.sparkSession, blocks or 3 * parts(docs.sparkSession)
    cuts = spark_cuts(docs, n)
    block = F.lit(0)
    if cuts:
        block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id")))
    firsts = sorted((r["block"], r["doc_id"]) for r in docs.groupBy(block.alias("block")).agg(F.min("doc_id").alias("doc_id")).collect())
    # the rows that open a block go to the end of the block before it as well
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    rows = docs.select(block.alias("block"), F.lit(0).alias("last"), "doc_id", "text")
    if before:
        goes = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        closing = docs.where(F.col("doc_id").isin(list(before))).select(goes[F.col("doc_id")].alias("block"), F.lit(1).alias("last"), "doc_id", "text")
        rows = rows.unionByName(closing)
    # blocks in turn: no two of neighbouring numbers in one task while another has none
    return rows.repartitionById(parts(spark), F.pmod("block", F.lit(parts(spark)))).sortWithinPartitions("block", "last", "doc_id", "text")


def spark_cuts(docs: DataFrame, n: int) -> list[int]:
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] if n > 1 else None
    return sorted(set(found or []))


def fingerprint_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint, that of its edited text and how like they are; columns as in ``EDITS``.

    Edited: the last quarter of the characters replaced by as many from the start of the next document.
    """
    schema = schema_of(EDITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document before, which waits for its follower
        out: list[tuple] = []
        size = 0
        for b in batches:
            blocks, last, ids = (b.column(i).to_pylist() for i in range(3))
            for i, text in texts_of(b):
                mark = winnow(text, k, window)
                seen = np.unique(mark[0])
                if held and held[0] == blocks[i]:
                    _, doc, own, print_, own_seen = held
                    new = edited(own, text)
                    changed = winnow(new, k, window) if new != own else print_
                    out.append((None if doc == NO_ID else doc, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encoded(*print_), encoded(*changed), likeness(own_seen, np.unique(changed[0])), likeness(own_seen, seen)))
                    size += len(own)
                held = None if last[i] else (blocks[i], ids[i], text, mark, seen)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return chained(docs).mapInArrow(run, EDITS)
