"""Toxicity by a convolutional text classifier trained here in numpy.

Words are hashed to embeddings, as wholes and by their first and last characters; filters of several widths slide over them, each filter's maximum over the text goes to
a logistic output. The output is calibrated on labelled rows kept from training: a slope and an offset put the best
overall threshold at a score of 0.5, and each language gets a threshold of its own for ``toxic``.

The classifier is fitted on at most ``sample`` labelled rows (those with the smallest hashes of their ids) of at most
``LONGEST`` characters each, which bounds what reaches the one task that fits it; the driver gets the model alone, never a text. Scoring covers every whole text of any length.
Labels, language, source and id are never inputs of a score.

Defined cases: a null or empty text is scored by its bias, without words; without labelled rows of both classes every score
is 0; a document labelled more than once counts as toxic if any label says so, and each row of a repeated id is scored and
learnt from by its own text; null labels are ignored; a language
unseen in calibration, or null, has the overall threshold; further columns are passed through by ``score`` (its own
names win); an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import texts_of

WORDS = re.compile(r"[^\W_]+")
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS, SAMPLE = 1 << 18, 8, (1, 2, 3), 8, 6, 6000
LONGEST = 50_000


PAD = max(WIDTHS)


def words_in(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def pieces(word: str) -> tuple[int, ...]:
    """Buckets of a word, its first 5, first 4 and last 5 characters. Bucket 0 is kept for padding."""
    return tuple(1 + crc32(g.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for g in (word, f"<{word[:5]}", f"<{word[:4]}", f"{word[-5:]}>"))


class Pieces(dict):
    """word -> buckets; forgets all when there are too many."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 100_000:
            self.clear()
        value = pieces(word)
        if len(word) < 64:
            self[word] = value
        return value


PIECES = Pieces()  # one for all tasks of a Python worker


def numbered(text: str) -> np.ndarray:
    """(words, 4) buckets, padded to the widest filter."""
    return np.array([PIECES[w] for w in words_in(text)] + [(0, 0, 0, 0)] * PAD, dtype=np.int32)


def vectors(embedding: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A word's vector joins the vectors of its four buckets."""
    return embedding[words].reshape(len(words), DIM)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # of width w: (w, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maxima of all filters and where they are."""
        values, places = [], []
        for w, (f, b) in zip(WIDTHS, zip(self.filters, self.bias)):
            n = max(1, len(x) - PAD - w + 1)
            a = x[:n] @ f[0]
            for j in range(1, w):
                a = a + x[j : n + j] @ f[j]
            p = a.argmax(axis=0)
            values.append(a[p, np.arange(FILTERS)] + b)
            places.append(p)
        return np.concatenate(values), np.concatenate(places)

    def logit(self, x: np.ndarray) -> float:
        h, _ = self.hidden(x)
        return float(np.maximum(h, 0) @ self.out + self.offset)

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.logit(x) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def trained(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adagrad, one text at a time. A bucket's first value starts at its log odds, less their standard error, in the training texts."""
    rng = np.random.default_rng(seed)
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t, y in zip(texts, labels):
        (pos if y else neg)[np.unique(t)] += 1
    n_pos, n_neg = max(1, labels.sum()), max(1, (1 - labels).sum())
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    sure = np.maximum(0, np.abs(odds) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))) * np.sign(odds) * (pos + neg > 1)
    e = rng.normal(0, 0.05, (BUCKETS, DIM // 4)).astype(np.float32)
    e[:, 0] = np.clip(sure, -4, 4) / 2
    e[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, :: DIM // 4, : FILTERS // 2] += 0.5
    m = Model(e, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), float(np.log(n_pos / n_neg)))
    ge, gf, go = np.full(e.shape, 1e-2, np.float32), [np.full(f.shape, 1e-2, np.float32) for f in filters], np.full(m.out.shape, 1e-2, np.float32)
    gb, gc = [np.full(FILTERS, 1e-2, np.float32) for _ in WIDTHS], 1e-2
    for epoch in range(EPOCHS):
        rate = 0.05 / (1 + 0.5 * epoch)
        for i in rng.permutation(len(texts)):
            words = texts[i]
            x = vectors(m.embedding, words)
            h, at = m.hidden(x)
            a = np.maximum(h, 0)
            z = float(np.clip(a @ m.out + m.offset, -30, 30))
            d = 1 / (1 + np.exp(-z)) - labels[i]
            dh = d * m.out * (h > 0)
            g = d * a + 1e-4 * m.out
            go += g * g
            m.out -= rate * g / np.sqrt(go)
            gc += d * d
            m.offset -= rate * d / np.sqrt(gc)
            for k, w in enumerate(WIDTHS):
                dk, p = dh[k * FILTERS : (k + 1) * FILTERS], at[k * FILTERS : (k + 1) * FILTERS]
                if not dk.any():
                    continue
                gb[k] += dk * dk
                m.bias[k] -= rate * dk / np.sqrt(gb[k])
                for j in range(w):
                    de = dk[:, None] * m.filters[k][j].T
                    df = (x[p + j] * dk[:, None]).T
                    gf[k][j] += df * df
                    m.filters[k][j] -= rate * df / np.sqrt(gf[k][j])
                    rows, step = words[p + j], de.reshape(FILTERS, 4, DIM // 4)
                    np.add.at(ge, rows, step * step)
                    np.add.at(m.embedding, rows, -0.3 * rate * step / np.sqrt(ge[rows]))
    m.embedding[0] = 0
    return m


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle between the neighbouring values that part the classes with the fewest errors."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]  # all below the cut are taken for clean
    best = np.flatnonzero(errors == errors.min())
    cuts = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
    return float(cuts[best[len(best) // 2]])


def calibrate(m: Model, z: np.ndarray, y: np.ndarray, langs: list[str], least: int = 40) -> None:
    cut = best_threshold(z, y)
    m.slope = 1.0 / max(0.25, float(np.std(z - cut)))
    m.shift = -m.slope * cut
    scores = m.slope * z + m.shift
    langs_ = np.array(langs)
    for lang in sorted(set(langs)):
        own = langs_ == lang
        # a language's own threshold needs enough rows of either class; it is drawn to the overall one by their number
        if min(y[own].sum(), (1 - y[own]).sum()) >= least // 4 and own.sum() >= least:
            weight = own.sum() / (own.sum() + 4 * least)
            m.thresholds[lang] = float(1 / (1 + np.exp(-weight * best_threshold(scores[own], y[own]))))


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    columns = [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")]
    # at most ``sample`` small rows are broadcast
    rows = docs.select(*columns).where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "toxic")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model_of(pa.Table.from_batches(held)))], pa.binary())], names=["model"])

    # the sample is bounded, so one task can fit it; what fitting takes then is not the driver's memory
    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else None


def model_of(rows: pa.Table) -> Model | None:
    """The model of rows (doc_id, text, lang, toxic), in whatever order they come; None without both classes."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(rows["toxic"].to_pylist(), dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return None
    texts = [numbered(t.as_py()) for t in rows["text"]]
    langs = [x or "" for x in rows["lang"].to_pylist()]
    fold = np.array([crc32(f"fold{d}".encode()) % 4 == 0 for d in rows["doc_id"].to_pylist()])
    if not (0 < y[fold].sum() < fold.sum() and 0 < y[~fold].sum() < (~fold).sum()):
        fold[:] = False
    fit = np.flatnonzero(~fold)
    m = trained([texts[i] for i in fit], y[fit])
    held = np.flatnonzero(fold) if fold.any() else fit
    calibrate(m, np.array([m.logit(vectors(m.embedding, texts[i])) for i in held]), y[held], [langs[i] for i in held])
    return m


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with score (0 to 1) and toxic (score at or above the threshold of the document's language)."""
    m = fitted(docs, labels, sample)
    docs = docs.drop("score", "toxic")
    if m is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("toxic", F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(m)
    fields = docs.schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = fields.index("lang") if "lang" in fields else None
        for b in batches:
            scores = [model.score(vectors(model.embedding, numbered(t))) for _, t in texts_of(b)]
            langs = b.column(at).to_pylist() if at is not None else [None] * len(scores)
            toxic = [s >= model.thresholds.get(lang, 0.5) for s, lang in zip(scores, langs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())], names=[*fields, "score", "toxic"])

    schema = docs.limit(0).withColumn("score", F.lit(0.0)).withColumn("toxic", F.lit(False)).schema
    return docs.mapInArrow(run, schema)
