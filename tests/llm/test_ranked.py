"""Ranked search against scoring every document; the index's range maxima and intervals on their own."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wavequarry.llm import ranked

DOCS = "doc_id long, text string, score string, rank string, item_id string"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked, out = {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, ts in asked.items():
        scores = []
        for d, c in counts:
            m = 100 - 90 + 90 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, -(1 << 63) if d is None else d))
        out += [(item, i + 1, None if d == -(1 << 63) else d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def tables():
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["Éa", "ÉA", "x_y", "The", "the"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.choice([1, 5, 40, 200])))) for i in range(700)]
    docs += [(1000 + i, "same words in every copy w7 w9") for i in range(60)]  # ties
    docs += [(None, "same words in every copy w7 w9"), (5000, None), (5001, ""), (5002, " ,.; "), (5003, "w1 " * 50_000), (3, "repeated id w3 w7"), (1000, "same words in every copy w7 w9")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "absent"), (103, "same COPY every"), (104, "w1"), (104, "w2 w3"), (None, "w5 w6"), (105, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("shard, leaf, width, block", [(8192, 64, 32, 2000), (50, 1, 1, 7), (200, 8, 4, 20)])
def test_search(spark, monkeypatch, shard, leaf, width, block):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("WIDTH", width), ("ITEMS", block)):
        monkeypatch.setattr(ranked, name, value)
    docs, items = tables()
    got = ranked.search(spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a", "", "", "")], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert ranked.search(docs.limit(0), items).collect() == []
    assert ranked.search(docs, items.limit(0)).collect() == []


def test_range_maxima():
    rng = np.random.default_rng(1)
    terms_ = np.repeat(np.arange(5), [1, 40, 7, 64, 3])
    places = np.concatenate([np.sort(rng.choice(100, n, replace=False)) for n in (1, 40, 7, 64, 3)])
    impacts = rng.integers(1, 50, len(places))
    index = ranked.Index(np.arange(100), terms_, places, impacts, 5)
    for t in range(5):
        for a in range(index.starts[t], index.starts[t + 1] + 1):
            for b in range(a, index.starts[t + 1] + 1):
                at = index.largest(np.array([a]), np.array([b]))
                assert index.impacts[at][0] == (impacts[a:b].max() if a < b else 0)


def test_intervals_are_left_out(monkeypatch):
    """A search reads few postings when few documents can be among the best."""
    n = 4096
    impacts = np.full(n, 10)
    impacts[[17, 900, 3000]] = 1000
    index, best = ranked.Index(np.arange(n), np.zeros(n, np.int64), np.arange(n), impacts, 1), ranked.Best(3)
    asked = []
    plain = index.largest
    index.largest = lambda a, b: asked.append(len(a)) or plain(a, b)
    index.search(np.array([0]), best)
    assert best.docs.tolist() == [17, 900, 3000] and sum(asked) < 12
