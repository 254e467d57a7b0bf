"""Mixing to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier gives every document a posterior over the domains. Its features are binned numbers: format and
length counts, and for each domain but the first how much the document's words speak for it, which is the mean log ratio of
hashed words. The words' ratios are fitted to one half of the labelled documents (at most ``SAMPLE`` of them, those with
the smallest hashes of their ids), the likelihoods of all bins to the whole other half, so that the words' scores are
calibrated on documents that they were not fitted to.

Projected-gradient least squares then fits a document rate r from ``lowest`` to ``HIGHEST`` for each document so that the expected tokens of
domain k, the sum of r * tokens * P(k | document), meet its target. Steps are accelerated (with restarts). The state of
an iteration is one residual per domain: a document's rate is the fold of all residuals so far over its own posterior, so
no rates are stored or shuffled, and an iteration is one aggregation over the distinct combinations of bins. It ends
when the targets are met or the steps no longer change the totals; targets that are not met then are told by a warning.

A document is then taken floor(r) times, and once more with probability r - floor(r) by a hash of its id and text.

Defined cases: a null or empty text has no tokens and rate ``lowest`` or 1, whichever is larger; without labelled rows all rates are 1;
null labels are ignored; a document labelled more than once counts for its greatest label; a domain without a weight
has target 0; rows without an id and repeated ids are rated by row; further columns are passed through (names of this operator win); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import stored

BINS, ITERATIONS, STEP, TOLERANCE = 16, 40, 1.0, 1e-4
#: Buckets of hashed words; labelled documents that their ratios are fitted to; the greatest ratio of a word, and bins for a unit of the mean.
BUCKETS, SAMPLE, MOST, PER_UNIT = 2048, 20_000, 3.0, 8
#: A document is repeated so often at most.
HIGHEST = 16.0
SYMBOLS, DIGITS, CAPITALS = r"[#$%&*|!<>{}\[\]=_~^]", "[0-9]", "[A-Z]"


def word_bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def with_features(df: DataFrame, ratios: list[list[float]]) -> DataFrame:
    """``df`` with tokens (words) and bins: features of the text as numbers from 0 to ``BINS`` - 1. Each is one scan of the text.

    ratios: for each domain but the first the log ratio of every bucket of words."""
    text = F.coalesce("text", F.lit(""))
    n, most = F.greatest(F.length(text), F.lit(1)), F.lit(BINS - 1)
    share = lambda pattern, scale: F.least(most, F.ceil(scale * F.regexp_count(text, F.lit(pattern)) / n)).cast("int")
    df = df.withColumn("tokens", F.regexp_count(text, F.lit(r"\S+")).cast("long"))
    lines = F.split(text, "\n")

    def speaks(ratio: list[float]) -> Column:
        total = F.aggregate(F.split(text, r"\s+"), F.lit(0.0), lambda a, w: a + F.get(F.lit(ratio), word_bucket(w)))
        return F.greatest(F.lit(0), F.least(most, F.floor(BINS / 2 + PER_UNIT * total / F.greatest(F.col("tokens"), F.lit(1))))).cast("int")

    return df.withColumn(
        "bins",
        F.array(
            F.least(most, F.floor(F.log2(F.length(text) + F.lit(1.0)))).cast("int"),
            share(SYMBOLS, 40),
            share(DIGITS, 40),
            share(CAPITALS, 20),
            F.least(most, F.floor(n / F.greatest(F.col("tokens"), F.lit(1)))).cast("int"),
            F.least(most, F.floor(10 * F.size(F.array_distinct(lines)) / F.size(lines))).cast("int"),
            *map(speaks, ratios),
        ),
    )


def chance() -> Column:
    """A number from 0 to 1 by a hash of id and text."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit("mix"))
    return (F.pmod(key, F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, domain and half (0: for words, 1: for bins) of every labelled document."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("domain"))
    return known.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)))


def word_ratios(docs: DataFrame, known: DataFrame, domains: list) -> list[list[float]]:
    """For each domain but the first, the log ratio of every bucket: the share of its documents that have a word there against that of the others."""
    chosen = known.where("half = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "domain")
    text = F.coalesce("text", F.lit(""))
    # at most ``SAMPLE`` pairs of numbers are broadcast
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    buckets = F.concat(F.array(F.lit(-1)), F.array_distinct(F.transform(words_of(F.col("text")), word_bucket)))
    counts = {(r["domain"], r["b"]): r["n"] for r in rows.select("domain", F.explode(buckets).alias("b")).groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = [sum(counts.get((d, b), 0) for d in domains) for b in range(-1, BUCKETS)]  # the number of documents first
    out = []
    for d in domains[1:]:
        own = [counts.get((d, b), 0) for b in range(-1, BUCKETS)]
        logs = [math.log((o + 0.5) / (own[0] + 1)) - math.log((e - o + 0.5) / (every[0] - own[0] + 1)) for o, e in zip(own[1:], every[1:])]
        out.append([max(-MOST, min(MOST, x)) for x in logs])
    return out


def classifier(featured: DataFrame, known: DataFrame, domains: list) -> tuple[list[float], list[list[list[float]]]]:
    """Log priors and log likelihoods by feature, bin and domain, from the counts over all documents of the second half."""
    rows = featured.select("doc_id", "bins").join(known.where("half = 1").select("doc_id", "domain"), "doc_id").select("domain", F.posexplode("bins").alias("f", "bin"))
    counts = {(r["domain"], r["f"], r["bin"]): r["n"] for r in rows.groupBy("domain", "f", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_features = 1 + max((f for _, f, _ in counts), default=-1)
    of = {d: sum(n for (x, f, _), n in counts.items() if x == d and f == 0) for d in domains}
    prior = [math.log((of[d] + 0.5) / (sum(of.values()) + 0.5 * len(domains))) for d in domains]
    likely = [[[math.log((counts.get((d, f, b), 0) + 0.5) / (of[d] + 0.5 * BINS)) for d in domains] for b in range(BINS)] for f in range(n_features)]
    return prior, likely


def with_posterior(df: DataFrame, prior: list[float], likely: list[list[list[float]]]) -> DataFrame:
    """``df``, which has bins, with p. Each step is a column of its own, so that none is computed more than once."""
    logits = []
    for k, value in enumerate(prior):
        total = F.lit(value)
        for f, table in enumerate(likely):
            total = total + F.get(F.array(*[F.lit(row[k]) for row in table]), F.col("bins")[f])
        logits.append(total)
    df = df.withColumn("_logits", F.array(*logits)).withColumn("_top", F.array_max("_logits"))
    df = df.withColumn("_powers", F.transform("_logits", lambda x: F.exp(x - F.col("_top"))))
    df = df.withColumn("_sum", F.aggregate("_powers", F.lit(0.0), lambda a, b: a + b))
    return df.withColumn("p", F.transform("_powers", lambda x: x / F.col("_sum"))).drop("_logits", "_top", "_powers", "_sum")


def rate(p: Column, steps: list[tuple[float, list[float]]], lowest: float) -> Column:
    """r and the r before it after all steps (momentum, residuals), projected to the range from ``lowest`` to ``HIGHEST`` after each."""
    start = F.struct(F.lit(max(1.0, lowest)).alias("r"), F.lit(max(1.0, lowest)).alias("before"))
    if not steps:
        return start
    told = F.array(*[F.struct(F.lit(m).alias("momentum"), F.array(*map(F.lit, e)).alias("residuals")) for m, e in steps])
    dot = lambda e: F.aggregate(F.zip_with(p, e, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def step(state: Column, s: Column) -> Column:
        ahead = state["r"] + s["momentum"] * (state["r"] - state["before"])
        return F.struct(F.least(F.lit(HIGHEST), F.greatest(F.lit(lowest), ahead - STEP * dot(s["residuals"]))).alias("r"), state["r"].alias("before"))

    return F.aggregate(told, start, step)


def fitted(members: DataFrame, targets: list[float], lowest: float) -> list[tuple[float, list[float]]]:
    """members: tokens, p. The momentum of each step and the residuals there, as shares of the domain's tokens at rate 1."""
    k = len(targets)

    def totals(*rates: Column) -> list[list[float]]:
        rows = members.select(F.col("tokens").alias("t"), "p", *[r.alias(f"r{j}") for j, r in enumerate(rates)])
        row = rows.agg(*[F.sum(F.col("t") * F.col(f"r{j}") * F.col("p")[i]) for j in range(len(rates)) for i in range(k)]).first()
        return [[x or 0.0 for x in row[j * k : (j + 1) * k]] for j in range(len(rates))]

    whole = totals(F.lit(1.0))[0]
    residual = lambda got: [(a - t) / w if w else 0.0 for a, t, w in zip(got, targets, whole)]
    steps: list[tuple[float, list[float]]] = []
    age, last = 1.0, [math.inf] * k
    for _ in range(ITERATIONS):
        older, age = age, (1 + math.sqrt(1 + 4 * age * age)) / 2
        momentum = (older - 1) / age
        state = rate(F.col("p"), steps, lowest)
        now, ahead = map(residual, totals(state["r"], state["r"] + momentum * (state["r"] - state["before"])))
        if max(map(abs, now), default=0) < TOLERANCE or max(abs(a - b) for a, b in zip(now, last)) < TOLERANCE / 100:
            break
        if sum(e * e for e in now) > sum(e * e for e in last):  # the momentum leads astray: start it anew
            age, momentum, ahead = 1.0, 0.0, now
        steps.append((momentum, ahead))
        last = now
    if max(map(abs, last), default=0) > 100 * TOLERANCE and steps and max(map(abs, now)) > 100 * TOLERANCE:
        warnings.warn(f"rates of at least {lowest} leave domains off their targets by {[round(e, 4) for e in now]} of their tokens", stacklevel=2)
    return steps


OWN = ["tokens", "bins", "p", "rate", "copies", "_chance"]


def rates(featured: DataFrame, known: DataFrame, domains: list, weights: dict, lowest: float):
    """A function that adds p, rate and copies to rows with bins and _chance, fitted to ``featured`` (doc_id, tokens, bins)."""
    if not domains:
        return lambda df: df.withColumn("p", F.array().cast("array<double>")).withColumn("rate", F.lit(max(1.0, lowest))).withColumn("copies", F.lit(max(1, int(lowest))))
    prior, likely = classifier(featured, known, domains)
    # a posterior depends on the bins alone: documents with equal bins are summed up first
    alike = featured.groupBy("bins").agg(F.sum("tokens").alias("tokens"))
    members = stored(with_posterior(alike, prior, likely).select("tokens", "p"), "posteriors")
    share = [float(weights.get(d, 0.0)) for d in domains]
    share = [s / sum(share) for s in share] if sum(share) else [1 / len(share)] * len(share)
    now = [x or 0.0 for x in members.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(len(domains))]).first()]
    total = max([sum(now), *[lowest * n / s for n, s in zip(now, share) if s]]) if lowest else sum(now)
    steps = fitted(members, [s * total for s in share], lowest)
    one = F.lit(max(1.0, lowest))
    return lambda df: with_posterior(df, prior, likely).withColumn("rate", F.when(F.col("tokens") > 0, rate(F.col("p"), steps, lowest)["r"]).otherwise(one)).withColumn("copies", F.floor(F.col("rate") + F.col("_chance")).cast("int"))


def prepared(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, DataFrame, list]:
    """Documents with features, labelled documents, and the domains, which are few."""
    known = labelled(labels, label)
    domains = sorted(r["domain"] for r in known.select("domain").distinct().collect())
    docs = docs.drop(*OWN)
    return with_features(docs, word_ratios(docs, known, domains)).withColumn("_chance", chance()), known, domains


def rated(docs: DataFrame, labels: DataFrame, weights: dict, label: str = "quality", lowest: float = 0.0) -> DataFrame:
    """``docs`` without text, with tokens, p (posterior by domain, in the order of the sorted labels), rate and copies.

    The targets are the weights times the tokens of ``docs``; with ``lowest`` above 0, times the least total for which no domain
    needs fewer tokens than it has at that rate.
    """
    featured, known, domains = prepared(docs, labels, label)
    featured = stored(featured.drop("text"), "features")
    return rates(featured, known, domains, weights, lowest)(featured).drop("bins", "_chance")


def mixed_docs(docs: DataFrame, labels: DataFrame, weights: dict, label: str = "quality", lowest: float = 0.0) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    featured, known, domains = prepared(docs, labels, label)
    featured = stored(featured, "features")
    rows = rates(featured, known, domains, weights, lowest)(featured).select(*[c for c in docs.columns if c not in OWN], F.col("copies").alias("_copies"))
    # written before the filter: pushed below the projections, it would compute the posterior anew for every reference
    rows = stored(rows, "copies").where("_copies > 0")
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy", "_copies")
