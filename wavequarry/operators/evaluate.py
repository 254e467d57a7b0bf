"""Evaluation: mergeable sums of reconstructions, classes, regressions, embeddings."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wavequarry.functions import arrays as A
from wavequarry.functions import scan

SUMS = ["n", "st", "sp", "stt", "spp", "stp", "sse"]


def recon_sums(df: DataFrame, target: str, pred: str, by: str | None = None) -> DataFrame:
    """Sufficient statistics of pairs, overall (by null) and per group, in one pass of grouping sets."""
    t, p = F.col(target).cast("double"), F.col(pred).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(t).alias("st"), F.sum(p).alias("sp"), F.sum(t * t).alias("stt"), F.sum(p * p).alias("spp"), F.sum(t * p).alias("stp"), F.sum((t - p) * (t - p)).alias("sse")]
    return df.groupingSets([[by], []], by).agg(*aggs) if by else df.agg(*aggs)


def patch_sums(df: DataFrame, target: str, pred: str, by: str | None = None, normalize: bool = False) -> DataFrame:
    """``recon_sums`` of arrays: each row's sums are made in the row. normalize: targets in the frame of their own patch."""
    t, p = (F.col(c).cast("array<double>") for c in (target, pred))
    df = df.withColumn("_t", A.unit_patch(t) if normalize else t).withColumn("_p", p)
    pairs = lambda f: A.total(F.zip_with("_t", "_p", f))
    rows = {"n": F.size("_t").cast("long"), "st": A.total(F.col("_t")), "sp": A.total(F.col("_p")), "stt": A.total(F.col("_t"), lambda v: v * v), "spp": A.total(F.col("_p"), lambda v: v * v), "stp": pairs(lambda a, b: a * b), "sse": pairs(lambda a, b: (a - b) * (a - b))}
    df = df.select(*([by] if by else []), *[v.alias(k) for k, v in rows.items()])
    aggs = [F.sum(c).alias(c) for c in SUMS]
    return df.groupingSets([[by], []], by).agg(*aggs) if by else df.agg(*aggs)


def aligned(targets: DataFrame, predictions: DataFrame, masks: DataFrame, key: list[str]) -> DataFrame:
    """Patches with their prediction and mask; patches without either fall out."""
    return targets.join(predictions, key).join(masks, key)


def recon_metrics(sums: DataFrame, least: float = 1e-12) -> DataFrame:
    """Root mean squared error, correlation and share of variance explained; NaN where variances are too small."""
    n = F.col("n")
    mt, mp = F.col("st") / n, F.col("sp") / n
    vt, vp = F.greatest(F.col("stt") / n - mt * mt, F.lit(0.0)), F.greatest(F.col("spp") / n - mp * mp, F.lit(0.0))
    spread, tss, nan = F.sqrt(vt * vp), F.col("stt") - n * mt * mt, F.lit(float("nan"))
    return sums.where(n > 0).withColumns({"rmse": F.sqrt(F.col("sse") / n), "r": F.when(spread > least, (F.col("stp") / n - mt * mp) / spread).otherwise(nan), "r2": F.when(tss > least, 1 - F.col("sse") / tss).otherwise(nan)})


def confusion(df: DataFrame, true: str, pred: str, classes: DataFrame) -> DataFrame:
    """All class pairs with their counts. The classes are few: their pairs are a crossed axis, not data."""
    counts = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    c = classes.select(F.col("class").alias("true")).crossJoin(F.broadcast(classes.select(F.col("class").alias("pred"))))
    return c.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; 0 where nothing divides."""
    rows = cells.select(F.explode(F.array(F.struct(F.col("true").alias("class"), F.lit(1).alias("t"), (F.col("true") != F.col("pred")).cast("int").alias("_")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("t"), F.lit(0).alias("_")))).alias("s"), "true", "pred", "n").select("s.class", "s.t", "true", "pred", "n")
    hit = F.col("true") == F.col("pred")
    out = rows.groupBy("class").agg(F.sum(F.when(hit & (F.col("t") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("t") == 0, F.col("n")).otherwise(0)).alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary_scores(df: DataFrame, true: str, pred: str, classes: DataFrame) -> DataFrame:
    """Accuracy and macro scores over the classes with support or predictions."""
    per = class_scores(confusion(df, true, pred, classes)).where("support + predicted > 0")
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def regression_errors(df: DataFrame, pred: str, target: str) -> DataFrame:
    """MAE and MSE overall (output null) and per output."""
    rows = df.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))).alias("output", "x")).select("output", (F.col("x.p") - F.col("x.t")).alias("d"))
    return rows.groupingSets([["output"], []], "output").agg(F.avg(F.abs("d")).alias("mae"), F.avg(F.col("d") * F.col("d")).alias("mse"))


def weighted_loss(df: DataFrame, loss: str, n: str, by: str) -> DataFrame:
    return df.groupingSets([[by], []], by).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def patch_losses(df: DataFrame, pred: str, target: str, kind: str, normalize: bool = False, divisor: int | None = None) -> DataFrame:
    """loss of each patch: elements averaged over the patch, or over ``divisor`` columns where patches were padded to that width."""
    t = F.col(target)
    if normalize:
        m, s = A.mean(t), F.greatest(A.std(t, 1), F.lit(1e-6))
        t = F.transform(t, lambda v: (v - m) / s)
    d = F.zip_with(F.col(pred), t, lambda a, b: A.elementwise_loss(a - b, kind))
    return df.withColumn("loss", A.total(d) / (F.lit(divisor) if divisor else F.size(d)))


def masked_visible(df: DataFrame, masked: str, alpha: float) -> DataFrame:
    m, v = F.avg(F.when(F.col(masked), F.col("loss"))), F.avg(F.when(~F.col(masked), F.col("loss")))
    return df.agg(m.alias("masked"), v.alias("visible"), (F.coalesce(m, F.lit(0.0)) + alpha * F.coalesce(v, F.lit(0.0))).alias("total"))


def denormalized(pred: Column, target: Column) -> Column:
    m, s = A.mean(target), F.greatest(A.std(target), F.lit(1e-6))
    return F.transform(pred, lambda v: v * s + m)


def element_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """n, and per element the sums of values and of squares; tasks return one row a key, not one a value."""
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    names = [f.name for f in rows.schema.fields[: len(keys)]]
    kinds = [to_arrow_type(f.dataType) for f in rows.schema.fields[: len(keys)]]

    def run(batches):
        sums: dict = {}
        for b in batches:
            held: dict = {}
            for *key, x in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((*key, len(x)), []).append([np.nan if v is None else v for v in x])
            for key, xs in held.items():
                x = np.array(xs, dtype=float)
                n, s, q = sums.get(key, (0, 0.0, 0.0))
                sums[key] = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        for (*key, d), (n, s, q) in sums.items():
            if d:
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * d, t) for k, t in zip(key, kinds)], pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(s), pa.array(q)], names=[*names, "dim", "n", "s", "q"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    return rows.mapInArrow(run, f"{ddl}, dim int, n long, s double, q double").groupBy(*names, "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Element-wise means; tasks return sums a class."""
    rows = element_sums(df.select(F.col(label).alias("class"), vector), ["class"], vector).select("class", "dim", (F.col("s") / F.col("n")).alias("v"))
    return rows.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("centroid"))


def linear_scores(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Scores of all rows of a weight matrix, which is one constant of the plan whatever its size."""
    head = F.from_json(F.lit(json.dumps([{"w": w, "b": b} for w, b in zip(weights, bias)])), "array<struct<w:array<double>,b:double>>")
    return F.transform(head, lambda h: A.dot(vector, h["w"]) + h["b"])


def centroid_shift(df: DataFrame, split: str, label: str, vector: str, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """Where the class centroids of val and test lie for a linear head; a class without test rows has nulls there."""
    scored = centroids(df.where(F.col(split) == "val"), label, vector).withColumn("val_logits", linear_scores(F.col("centroid"), weights, bias)).drop("centroid")
    test = centroids(df.where(F.col(split) == "test"), label, vector).withColumn("test_logits", linear_scores(F.col("centroid"), weights, bias)).drop("centroid")
    out = scored.join(F.broadcast(test), "class", "left")  # one row per class
    shift = F.sqrt(A.total(F.zip_with("val_logits", "test_logits", lambda a, b: (a - b) * (a - b))))
    out = out.withColumns({"val_region": A.argmax(F.col("val_logits")), "test_region": A.argmax(F.col("test_logits")), "val_margin": A.margin(F.col("val_logits"), F.col("class")), "test_margin": A.margin(F.col("test_logits"), F.col("class")), "logit_shift": shift})
    cloud = df.where(F.col(split) == "test").select(F.col(label).alias("class"), A.argmax(linear_scores(F.col(vector), weights, bias)).alias("region"))
    agree = cloud.join(F.broadcast(out.select("class", "test_region")), "class").groupBy("class").agg(F.avg((F.col("region") == F.col("test_region")).cast("int")).alias("agreement"), F.avg((F.col("region") == F.col("class")).cast("int")).alias("accuracy"))
    return out.join(agree, "class", "left").withColumn("shifted", F.col("val_region") != F.col("test_region"))


def pool(tokens: DataFrame, kind: str, bins: int = 1, tokens_kept: int = 0) -> DataFrame:
    """Tokens (owner_id, pos, valid, vec) of an owner to one row per (owner, bin, dim), or to one vector (flat)."""
    if kind == "flat":
        zero = F.transform("vec", lambda v: F.lit(0.0))
        rows = tokens.withColumn("vec", F.when(F.col("valid"), F.col("vec").cast("array<double>")).otherwise(zero)).where(F.col("pos") < tokens_kept)
        flat = rows.groupBy("owner_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"])).alias("vector"), F.max(F.size("vec")).alias("w"))
        return flat.select("owner_id", A.padded(F.col("vector"), F.col("w") * tokens_kept).alias("vector"))
    owners = tokens.groupBy("owner_id").agg(F.count_if("valid").alias("_n"), F.max(F.size("vec")).alias("w"))
    placed = scan.numbered(tokens.where("valid"), ["owner_id"], "pos", "_rank").join(owners, "owner_id").withColumn("bin", F.floor(F.col("_rank") * bins / F.col("_n")).cast("int"))
    if kind == "mean":
        got = element_sums(placed.select("owner_id", "bin", "vec"), ["owner_id", "bin"], "vec").select("owner_id", "bin", "dim", (F.col("s") / F.col("n")).alias("v"))
    else:
        got = element_maxima(placed.select("owner_id", "bin", "vec"), ["owner_id", "bin"], "vec")
    every = owners.select("owner_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "w").select("owner_id", "bin", F.explode(A.indices(F.col("w"))).alias("dim"))
    return every.join(got, ["owner_id", "bin", "dim"], "left").select("owner_id", "bin", "dim", F.coalesce("v", F.lit(0.0)).alias("v"))


def element_maxima(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per element the largest value of each key (v, null without one); tasks return one row a key and element."""
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    fields = rows.schema.fields[: len(keys)]
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        most: dict = {}
        for b in batches:
            for *key, x in zip(*(c.to_pylist() for c in b.columns)):
                x = np.array([np.nan if v is None else v for v in x], dtype=float)
                at = (*key, len(x))
                most[at] = np.fmax(most[at], x) if at in most else x
        for (*key, d), x in most.items():
            if d:
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * d, t) for k, t in zip(key, kinds)], pa.array(np.arange(d, dtype=np.int32)), pa.array(x, from_pandas=True)], names=[*names, "dim", "v"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{ddl}, dim int, v double").groupBy(*names, "dim").agg(F.max("v").alias("v"))


def normality(df: DataFrame, vector: str, projections: list[list[float]], points: int = 17, reach: float = 5.0) -> float:
    """Sliced Epps-Pulley statistic: characteristic functions of projected embeddings against the normal one's. Tasks return
    sums per (slice, point)."""
    m, t = np.array(projections, dtype=float), np.linspace(-reach, reach, points)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)

    def run(batches):
        for b in batches:
            if len(b):
                x = np.array(b.column(0).to_pylist(), dtype=float) @ m.T
                a = x[:, :, None] * t
                yield pa.RecordBatch.from_pydict({"at": np.arange(m.shape[0] * points), "c": np.cos(a).sum(0).ravel(), "s": np.sin(a).sum(0).ravel(), "n": np.full(m.shape[0] * points, len(x))})

    rows = sorted(df.select(vector).mapInArrow(run, "at long, c double, s double, n long").groupBy("at").agg(F.sum("c"), F.sum("s"), F.sum("n")).collect())
    if not rows:
        return float("nan")
    n = rows[0][3]
    c, s = (np.array([r[i] for r in rows]).reshape(len(m), points) / n for i in (1, 2))
    normal = np.exp(-t * t / 2)
    return float((np.trapezoid(((c - normal) ** 2 + s * s) * normal, t, axis=1) * n).mean())


def view_similarity(df: DataFrame, owner: str, is_global: str, vector: str) -> DataFrame:
    """Mean squared distance of local views to the mean of an owner's global views."""
    centre = element_sums(df.where(F.col(is_global)), [owner], vector).select(owner, "dim", (F.col("s") / F.col("n")).alias("m"))
    local = element_sums(df.where(~F.col(is_global)), [owner], vector)
    # the squared distances of n values to m, from their sums
    apart = F.col("q") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") * F.col("m")
    return local.join(centre, [owner, "dim"]).agg((F.sum(apart) / F.sum("n")).alias("similarity"))


def embedding_objective(df: DataFrame, owner: str, is_global: str, vector: str, projections: list[list[float]], weight: float) -> DataFrame:
    """similarity, normality and (1 - weight) similarity + weight normality."""
    statistic = normality(df, vector, projections)
    out = view_similarity(df, owner, is_global, vector).withColumn("normality", F.lit(statistic))
    return out.withColumn("objective", (1 - weight) * F.col("similarity") + weight * F.col("normality"))


def projected_2d(vector: Column, matrix: list[list[float]]) -> list[Column]:
    return [A.dot(vector, F.array(*map(F.lit, row))) for row in matrix]


def scatter(df: DataFrame, group: str, vector: str) -> DataFrame:
    """n, sums and sums of products of each group: what between- and within-class scatter are made of. One row per (group, i, j);
    tasks return sums of outer products."""
    rows = df.select(F.col(group).alias("group"), F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")

    def run(batches):
        sums: dict = {}
        for b in batches:
            held: dict = {}
            for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault((g, len(x)), []).append([0.0 if v is None else v for v in x])
            for key, xs in held.items():
                x = np.array(xs, dtype=float)
                n, s, p = sums.get(key, (0, 0.0, 0.0))
                sums[key] = n + len(x), s + x.sum(0), p + x.T @ x
        for (g, d), (n, s, p) in sums.items():
            if d:
                yield pa.RecordBatch.from_pydict({"group": pa.array([g] * (d * d), kind), "i": np.repeat(np.arange(d, dtype=np.int32), d), "j": np.tile(np.arange(d, dtype=np.int32), d), "n": np.full(d * d, n), "sa": np.repeat(s, d), "sb": np.tile(s, d), "sab": p.ravel()})

    kind = to_arrow_type(rows.schema["group"].dataType)
    parts = rows.mapInArrow(run, f"group {rows.schema['group'].dataType.simpleString()}, i int, j int, n long, sa double, sb double, sab double")
    return parts.groupBy("group", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])


def discriminant_axes(sums: DataFrame, dims: int, k: int = 2) -> np.ndarray:
    """The k leading axes from the collected scatter, dims x dims a group."""
    groups: dict = {}
    for r in sums.collect():
        n, m, p = groups.setdefault(r["group"], [r["n"], np.zeros(dims), np.zeros((dims, dims))])
        m[r["i"]] = r["sa"] / r["n"]
        p[r["i"], r["j"]] = r["sab"]
    if len(groups) < 3:
        raise ValueError("needs three groups")
    total = sum(g[0] for g in groups.values())
    centre = sum(g[0] * g[1] for g in groups.values()) / total
    within = sum(p - n * np.outer(m, m) for n, m, p in groups.values())
    between = sum(n * np.outer(m - centre, m - centre) for n, m, _ in groups.values())
    values, vectors = np.linalg.eig(np.linalg.solve(within + 1e-6 * np.eye(dims), between))
    return np.real(vectors[:, np.argsort(-np.real(values))[:k]]).T


def linear_probe(df: DataFrame, label: str, vector: str, max_iter: int = 50):
    """Multinomial logistic regression on embeddings; returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return LogisticRegression(maxIter=max_iter, family="multinomial").fit(rows)


def regression_heads(df: DataFrame, targets: list[str], vector: str) -> list:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    return [LinearRegression(maxIter=50).fit(df.select(F.col(t).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))) for t in targets]


def overview(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")


#: Poolings by name.
POOLS = {"mean": {"kind": "mean"}, "max": {"kind": "max"}, "bins": {"kind": "mean", "bins": 4}, "flatten": {"kind": "flat", "tokens_kept": 4}}


def pooled(tokens: DataFrame, name: str, **options) -> DataFrame:
    return pool(tokens, **(POOLS[name] | options))
