"""Substring dedup against sets of windows; the wavelet matrix and the index on their own."""

import random
import re

import numpy as np
import pytest

from wavequarry.llm import fmindex

DOCS = "doc_id long, text string, n_words string, th string, spans string, gram string"


def brute(docs, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (d, _), ws in zip(docs, words):
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            first[w] = min(first.get(w, (1 << 63)), -(1 << 63) if d is None else d)
    out = []
    for (d, t), ws in zip(docs, words):
        gone = {j for i in range(len(ws) - size + 1) if first[tuple(ws[i : i + size])] < (-(1 << 63) if d is None else d) for j in range(i, i + size)}
        out.append((d, len(ws), len(gone), None if t is None else " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def documents(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["W1", "é", "\x00", "x.y", "a b"]
    passages = [rng.choices(words, k=rng.choice([12, 13, 14, 30])) for _ in range(12)]
    docs = []
    for i in range(150):
        ws = []
        for _ in range(rng.randrange(6)):
            ws += rng.choice(passages) if rng.random() < 0.6 else rng.choices(words, k=rng.randrange(20))
        docs.append((i, "".join(w + rng.choice([" ", "\n", "  \t"]) for w in ws)))
    docs += [(200 + i, docs[7][1]) for i in range(20)]  # copies
    docs += [(300, "z " * 400), (301, "z " * 30), (302, "z " * 12), (303, "u v " * 50), (304, "v u " * 50)]  # periodic
    docs += [(400, None), (401, ""), (402, " \n "), (None, " ".join(passages[0])), (5, docs[9][1]), (5, docs[9][1]), (7, "new " + docs[7][1])]
    docs.append((500, " ".join(" ".join(rng.choices(words, k=500)) + " " + " ".join(passages[3]) for _ in range(20))))
    return docs


@pytest.mark.parametrize("size, most, change", [(13, 1 << 23, {}), (13, 0, {}), (13, 1 << 23, {"HOT": 2, "SHARD": 300, "FLUSH": 500}), (13, 0, {"HOT": 3, "CHUNK": 2000}), (3, 1 << 23, {"CHUNK": 500}), (1, 1 << 23, {})])
def test_remove_repeats(spark, monkeypatch, size, most, change):
    for name, value in change.items():
        monkeypatch.setattr(fmindex, name, value)
    docs = documents()
    table = spark.createDataFrame([(*d, "a", "b", "c", "kept") for d in docs], DOCS).repartition(3)
    got = fmindex.remove_repeats(table, size, most)
    assert got.columns == ["doc_id", "text", "gram", "spans", "n_words", "n_removed"]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in rows), key=repr) == brute(docs, size)
    assert {r["gram"] for r in rows} == {"kept"}


def test_empty(spark):
    assert fmindex.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    got = fmindex.remove_repeats(spark.createDataFrame([(1, None, "", "", "", "")], DOCS)).collect()
    assert [(r["text"], r["n_words"], r["n_removed"]) for r in got] == [(None, 0, 0)]


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for symbols, n in ((1, 5), (2, 64), (9, 1000), (700, 129)):
        values = rng.integers(0, symbols, n)
        tree = fmindex.WaveletMatrix(values, symbols)
        for i in (0, 1, n // 2, 63, 64, n):
            if i <= n:
                assert tree.rank(np.arange(symbols), np.full(symbols, i)).tolist() == np.bincount(values[:i], minlength=symbols).tolist()


def test_matching_of_windows():
    """Backward search counts the occurrences of windows, over any number of stretches."""
    rng = random.Random(4)
    stretches = [" ".join(rng.choices("abc", k=rng.randrange(1, 30))).encode() for _ in range(40)]
    stretches = list(dict.fromkeys(stretches))
    for size in (1, 2, 5, 13):
        index = fmindex.Index(stretches, size)
        places = {}
        for s in stretches:
            ws = s.split(b" ")
            for i in range(len(ws) - size + 1):
                places[tuple(ws[i : i + size])] = places.get(tuple(ws[i : i + size]), 0) + 1
        starts, low, high = index.intervals(index.windows)
        names = {i: w for w, i in dict.fromkeys((w, int(n)) for s in stretches for w, n in zip(s.split(b" "), index.sequence[index.begin[stretches.index(s)] :]))}
        got = {tuple(names[int(x)] for x in index.sequence[a : a + size]): int(h - lo) for a, lo, h in zip(starts, low, high)}
        assert got == {w: n for w, n in places.items() if n > 1}
