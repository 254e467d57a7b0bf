"""Fitted heads against plain least squares and a plain optimum, the layout on planted clusters, pooling of long owners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import scan
from wavequarry.operators import evaluate, heads, layout


def vectors(spark, x, **columns):
    rows = [(i, [float(v) for v in row], *[c[i] for c in columns.values()]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "x", *columns])


def test_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = x @ rng.normal(size=(5, 3)) + [1, 2, 3] + 0.1 * rng.normal(size=(200, 3))
    df = vectors(spark, x, a=y[:, 0].tolist(), b=y[:, 1].tolist(), c=y[:, 2].tolist()).repartition(3)
    w, b = heads.regression(df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double"))), ["a", "b", "c"], "x")
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert np.allclose(b, want[0]) and np.allclose(w, want[1:].T)
    held, _ = heads.regression(df, ["a"], "x", 1e9)
    assert np.abs(held).max() < 1e-5
    w, b = heads.regression(df.limit(0), ["a"], "x")
    assert not w.any() and not b.any()


def test_probe(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 3)) + m for m in ([0, 0, 0], [3, 0, 0], [0, 3, 3])])
    label = ["a"] * 60 + ["b"] * 60 + ["c"] * 60
    classes, w, b = heads.probe(vectors(spark, x, label=label).repartition(4), "label", "x", 1e-2)
    assert classes == ["a", "b", "c"]

    def slope(v):
        v = v.reshape(3, 4)
        z = np.c_[np.ones(180), x] @ v.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(180), np.repeat([0, 1, 2], 60)] -= 1
        return p.T @ np.c_[np.ones(180), x] / 180 + 1e-2 * v

    assert np.abs(slope(np.c_[b, w])).max() < 1e-8
    assert (np.argmax(x @ w.T + b, 1) == np.repeat([0, 1, 2], 60)).mean() > 0.9
    one, w, _ = heads.probe(vectors(spark, x[:60], label=label[:60]), "label", "x")
    assert one == ["a"] and not w.any()


def test_layout_tells_planted_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(70, 6)) + 8 * np.eye(6)[c] for c in range(3)])
    df = vectors(spark, x).repartition(3)
    df = df.unionByName(df.limit(1).select(F.lit(999).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x")))
    edges = layout.neighbour_graph(df, "id", "x").collect()
    assert {(r["a"], r["b"]) for r in edges} == {(r["b"], r["a"]) for r in edges} and 999 not in {r["a"] for r in edges}
    assert all(0 < r["w"] <= 1 for r in edges)
    got = {r["key"]: r for r in layout.spectral_layout(layout.neighbour_graph(df, "id", "x"), rounds=4).collect()}
    y = np.array([got[i]["y"] / np.sqrt(got[i]["degree"]) for i in range(210)])
    centres = np.array([y[70 * c : 70 * c + 70].mean(0) for c in range(3)])
    nearest = np.argmin(((y[:, None] - centres) ** 2).sum(2), 1)
    assert (nearest == np.repeat([0, 1, 2], 70)).mean() > 0.95


@pytest.mark.parametrize("kind", ["mean", "max"])
def test_bins_of_one_long_owner(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(o, p, bool(rng.random() < 0.7), rng.normal(size=3).tolist()) for o, n in ((1, 500), (2, 3), (3, 1)) for p in range(n)] + [(4, 0, False, [1.0, 1.0, 1.0])]
    got = evaluate.pool(spark.createDataFrame(rows, "owner_id int, pos int, valid boolean, vec array<double>").repartition(4), kind, 4).collect()
    want = {}
    for o in (1, 2, 3, 4):
        own = [np.array(v) for i, _, ok, v in sorted(rows, key=lambda r: r[:2]) if i == o and ok]
        for b in range(4):
            some = [v for k, v in enumerate(own) if k * 4 // len(own) == b]
            value = np.zeros(3) if not some else np.mean(some, 0) if kind == "mean" else np.max(some, 0)
            want |= {(o, b, d): value[d] for d in range(3)}
    assert {(r["owner_id"], r["bin"], r["dim"]) for r in got} == set(want)
    assert all(r["v"] == pytest.approx(want[r["owner_id"], r["bin"], r["dim"]]) for r in got)


def test_coordinates_are_not_broadcast(spark, monkeypatch):
    """However small they are: a broadcast passes through the driver, in every step."""
    plans, stored = [], scan.stored
    monkeypatch.setattr(scan, "stored", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stored(df, name))
    df = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(40)], "id long, x array<double>")
    out = layout.spectral_layout(layout.neighbour_graph(df, "id", "x"), rounds=1, steps=1)
    assert out.count() == 40
    joins = [p for p in plans if "Join" in p]
    assert joins and not any("BroadcastHashJoin" in p for p in joins)
