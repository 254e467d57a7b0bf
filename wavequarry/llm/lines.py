"""Line dedup: runs of lines that occur before, in the same or another document, are deleted.

The corpus is a sequence of line ids per document. Prefix doubling ranks the suffixes of these sequences by their first
1, 2, 4, ... lines: the rank at level k + 1 is that of two ranks of level k, 2^k lines apart, in their global order. A prefix that
only one suffix has is dropped, so each level holds the repeated runs alone, and equal ranks lie together in the suffix
array. An interval of the array whose longest common prefix is at least m lines is the set of suffixes with the same two
ranks that overlap in m lines.

Of each start the least run of at least ``min_words`` words is looked up, and of each end likewise; these intervals' runs cover
exactly the maximal repeated runs of so many words. In every interval the first occurrence (by id, then line) stays and
the lines of all later ones are deleted. The depth of the doubling depends on ``min_words`` only.

Defined cases: null texts are empty and stay as they are; blank lines separate nothing, have no id and stay unless the lines on
both sides go; rows equal in id and text are one document and lose the same lines; rows without an id come first;
further columns are passed through; an empty table gives an empty result. A document that loses all its lines has the text ''.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequarry.llm.shared import parts, schema_of, stored, texts_of

MIN_WORDS = 50
LINES = "doc_id long, th long, pos int, h1 long, h2 long, ahead int, back int"
WINDOWS = "doc_id long, th long, start int, m int, a long, b long"


def filled(text: str) -> list[int]:
    """Numbers of the lines that have words."""
    return [i for i, line in enumerate(text.split("\n")) if not line.isspace() and line]


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line with words: its place among them, its id, and how many lines the least windows from it and up to it have (0: none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(LINES)
        for b in batches:
            ids, hashes, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, text in texts_of(b):
                lines = text.split("\n")
                lines = [lines[j] for j in filled(text)]
                if not lines:
                    continue
                total = np.cumsum([0, *(len(x.split()) for x in lines)])
                n = len(lines)
                ahead = np.searchsorted(total, total[:-1] + min_words) - np.arange(n)
                back = np.arange(1, n + 1) - (np.searchsorted(total, total[1:] - min_words, side="right") - 1)
                ahead[total[-1] - total[:-1] < min_words] = 0
                back[total[1:] < min_words] = 0
                for j, line in enumerate(lines):
                    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
                    out.append((ids[i], hashes[i], j, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), int(ahead[j]), int(back[j])))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select("doc_id", "th", "text").mapInArrow(run, LINES)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys occur more than once, with the place of these keys in the order of all such as ``name``."""
    classes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    # a range exchange and a sort, so ids rise from row to row and from partition to partition
    return rows.join(stored(classes.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("name")), "ranks"), keys)


def windows(levels: list[DataFrame], partitions: int) -> DataFrame:
    """The windows that consist of repeated lines, each told by the two ranks that overlap in it; columns as in ``WINDOWS``."""
    rows = None
    for k, level in enumerate(levels):
        some = level.select("doc_id", "th", "pos", F.lit(k).alias("k"), "name", "ahead", "back")
        rows = some if rows is None else rows.unionByName(some)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(WINDOWS)
        key, names, out = None, {}, []
        sizes: list[tuple[int, int, int]] = []

        def done() -> None:
            for pos, ahead, back in sizes:
                found = {(pos, ahead), (pos - back + 1, back)}
                for start, m in found:
                    if m:
                        k = m.bit_length() - 1
                        a, b = names.get((k, start)), names.get((k, start + m - (1 << k)))
                        if a is not None and b is not None:
                            out.append((*key, start, m, a, b))

        for b in batches:
            for doc, th, pos, k, name, ahead, back in zip(*(c.to_pylist() for c in b.columns)):
                if key != (doc, th):
                    done()
                    key, names, sizes = (doc, th), {}, []
                names[k, pos] = name
                if k == 0:
                    sizes.append((pos, ahead, back))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # rows without an id are keyed by their text alone
    dealt = rows.repartition(partitions, "doc_id", "th").sortWithinPartitions("doc_id", "th")
    return dealt.mapInArrow(run, WINDOWS).distinct()


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, th, gone): for each document that loses lines the list of (start, m) of its later copies."""
    # equal rows are one document, wherever they lie
    lines = stored(line_rows(docs, min_words).dropDuplicates(["doc_id", "th", "pos"]), "lines")
    # a line in a single place never is in a repeated run
    level = stored(ranked(lines, ["h1", "h2"]).select("doc_id", "th", "pos", "name", "ahead", "back"), "level")
    levels = [level]
    ahead = Window.partitionBy("doc_id", "th").orderBy("pos")
    for k in range(max(1, min_words).bit_length() - 1):
        step = 1 << k
        pairs = level.withColumn("next", F.first("name").over(ahead.rangeBetween(step, step))).where("next IS NOT NULL").withColumnRenamed("name", "own")
        level = stored(ranked(pairs, ["own", "next"]).select("doc_id", "th", "pos", "name", "ahead", "back"), "level")
        levels.append(level)
    found = stored(windows(levels, parts(docs.sparkSession)), "windows")
    # of each interval of the suffix array the first suffix; joined by its place, as an interval may hold a third of all rows
    first = found.groupBy("m", "a", "b").agg(F.min(F.struct("doc_id", "th", "start")).alias("first")).select("m", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "th", "start")])
    own = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("th") == F.col("first_th")) & (F.col("start") == F.col("first_start")) & (found["m"] == first["m"])
    later = found.join(first, own, "left_anti")
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("gone"))


def without(text: str, gone: Iterable[tuple[int, int]]) -> tuple[str, int]:
    """The text that is left and the number of lines deleted. A blank line between two deleted lines goes as well."""
    lines, has = text.split("\n"), filled(text)
    cut = np.zeros(len(has) + 1, dtype=int)
    for start, m in gone:
        cut[start] += 1
        cut[start + m] -= 1
    deleted = np.cumsum(cut)[:-1] > 0
    drop = set(np.array(has)[deleted].tolist())
    edges = [-1, *has, len(lines)]
    out_of = {-1, len(lines)} | drop
    for a, b in zip(edges, edges[1:]):
        if a in out_of and b in out_of:
            drop.update(range(a + 1, b))
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), int(deleted.sum())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left, its n_chars, and n_lines (that had words) and n_deleted."""
    docs = docs.drop("n_lines", "n_deleted", "th", "gone").withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = stored(repeated(keyed.select("doc_id", "th", "text"), min_words), "deleted-runs").withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    # dealt by key at every size, whether or not the list of deletions would fit in memory
    joined = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").drop("th", "d", "t")
    names = [c for c in docs.columns if c != "n_chars"] + ["n_chars", "n_lines", "n_deleted"]
    schema = docs.select(*[c for c in docs.columns if c != "n_chars"]).limit(0).withColumns({"n_chars": F.lit(0).cast("long"), "n_lines": F.lit(0), "n_deleted": F.lit(0)}).schema
    text_at, gone_at = joined.columns.index("text"), joined.columns.index("gone")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars, n, cut = [], [], [], []
            runs = b.column(gone_at).to_pylist()
            for i, text in enumerate(b.column(text_at).to_pylist()):
                n.append(len(filled(text or "")))
                left, deleted = without(text, [(r["start"], r["m"]) for r in runs[i]]) if runs[i] else (text, 0)
                texts.append(left)
                chars.append(len(left or ""))
                cut.append(deleted)
            own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(chars, pa.int64()), "n_lines": pa.array(n, pa.int32()), "n_deleted": pa.array(cut, pa.int32())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else b.column(b.schema.get_field_index(c)) for c in names], names=names)

    return joined.mapInArrow(run, schema)
