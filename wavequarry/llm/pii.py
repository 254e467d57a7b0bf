"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans: the base patterns (email, ip, card, phone), whose spans always stay, and wider ones
(``LOOSE``) that find many more strings of the same look and overlap each other. Format and context features of the
wide candidates are small integers. Some candidates have a distant label that the features don't show: a check of their
value (the last label of a domain, the parts of an address, the check digit of a card, the fixed prefixes and lengths of
keys) or, for phones, a country code before them that is masked from the features. Written-out forms that no check
covers (``[at]``, bracketed dots, phones without a country code, keys of other lengths) have none and are only scored.

How often each combination of features occurs among labelled candidates, and with which label, is a table whose size the
bins bound. Boosted trees of depth two are fitted to the rows of the training folds on the driver in plain Python; on
the held-out fold the scores of each kind are calibrated to probabilities (pooling adjacent violators), and the least
score whose own probability is ``PRECISION`` or more is the kind's threshold. The trees are scored as column expressions; of
chosen spans that overlap the one with the higher score stays, and those that overlap a base span go.

Spans are told in code points, end exclusive. Defined cases: a null text is empty and has no spans (the digest is that of
the empty string); rows without an id and repeated ids are kept as rows; further columns are not read; an empty table
gives an empty result; equal spans of one kind are one span; a kind without labelled candidates in either part adds none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import stored

#: Fixed patterns. Possessive quantifiers find the same strings without backtracking; the look-behind keeps a
#: long run of characters from being tried at each of its positions, and \G resumes behind the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
#: Wider candidates, by the kind that they would be.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}(?:[\[(]?\.[\])]?[0-9]{1,4}){3,5}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./-]?[0-9]{3,6}){2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{3,5}(?![0-9])",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,80}[0-9])[A-Za-z0-9_-]{20,80}+(?![A-Za-z0-9_-])",
}
NAMES = list(LOOSE)
#: Fixed words that announce personal data or keys.
CONTEXT = r"(?i)(?:mail|tel|phone|call|fax|mobil|card|visa|iban|account|token|key|secret|password|host|server|addr)[^\n]{0,12}$"
#: Fixed looks of keys: prefixes of issuers, lengths of hexadecimal digests.
KEY = r"^(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|xox[abps]-[0-9A-Za-z-]{10,}|(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}))$"
#: What looks like a key and is none: numbers, identifiers in five groups, titles of words and numbers.
NO_KEY = r"^(?:[0-9]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:[A-Za-z]{1,12}|[0-9]{1,4})(?:[_-](?:[A-Za-z]{1,12}|[0-9]{1,4})){2,})$"
SPAN = "struct<start:int,stop:int,hit:string>"
PRECISION, ROUNDS, RATE, AROUND, FOLDS = 0.9, 24, 0.4, 20, 4


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, hit) of the leftmost non-overlapping matches: lengths of the gaps between them and of the matches add up."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.from_json(F.lit('{"at":0,"found":[]}'), f"at int, found array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        stop = start + F.length(pair["hit"])
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("hit")))).alias("found"))

    pairs = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, empty, step, lambda s: s["found"])).otherwise(F.from_json(F.lit("[]"), f"array<{SPAN}>"))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: of the digits from the right, every second is doubled and its digits added."""
    back = F.split(F.reverse(number), "")
    values = F.transform(back, lambda d, i: F.when(i % 2 == 0, F.try_element_at(F.array(*map(F.lit, range(10))), d.try_cast("int") + 1)).otherwise(F.try_element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.try_cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    part = lambda hit: F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    return {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda s: part(s["hit"])),
        "card": F.filter(matches(text, CARD), lambda s: F.length(digits(s["hit"])).between(14, 19) & luhn(digits(s["hit"]))),
        "phone": F.filter(matches(text, PHONE), lambda s: F.length(digits(s["hit"])).between(10, 15)),
    }


#: Bins of a feature; a candidate's cell is the combination of its features.
FEATURES = {"kind": 5, "length": 6, "digits": 4, "capitals": 3, "marks": 3, "context": 2, "before": 3, "after": 3}


def beside(c: Column) -> Column:
    """0: a blank or the edge of the text, 1: a quote, bracket or sign of assignment, 2: something else."""
    return F.when(F.trim(c) == "", 0).when(c.rlike(r"""["'(){}\[\]<>=:]"""), 1).when(c.isin("\n", "\t", "\r"), 0).otherwise(2)


def features(kind: str, span: Column, text: Column) -> Column:
    hit, size = span["hit"], F.length(span["hit"])
    n = F.length(digits(hit))
    before = F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - AROUND), F.least(span["start"], F.lit(AROUND)))
    capitals = F.length(F.regexp_replace(hit, "[^A-Z]", ""))
    marks = F.length(F.regexp_replace(hit, r"[^@().\[\]\x20/+_-]", ""))
    return F.array(
        F.lit(NAMES.index(kind)),
        F.least(F.floor(size / 8), F.lit(5)).cast("int"),
        F.least(F.floor(4 * n / size), F.lit(3)).cast("int"),
        F.when(capitals == 0, 0).when(2 * capitals > size, 2).otherwise(1),
        F.least(F.floor(marks / 2), F.lit(2)).cast("int"),
        F.coalesce(before.rlike(CONTEXT), F.lit(False)).cast("int"),
        beside(F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise("")),
        beside(F.substring(text, span["stop"] + 1, F.lit(1))),
    )


def label(kind: str, span: Column) -> Column:
    """1 or 0 where a check of the value, or a masked country code, tells; else null. None of it is a feature."""
    hit = span["hit"]
    within = lambda k: F.exists(F.col(k), lambda b: (span["start"] < b["stop"]) & (b["start"] < span["stop"]))
    parts = F.split(hit, r"\.")
    return {
        "email": F.when(hit.contains("@"), hit.rlike(r"\.[A-Za-z]{2,24}$").cast("int")),
        "ip": F.when(~hit.rlike(r"[\[\]()]"), ((F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))).cast("int")),
        "card": (F.length(digits(hit)).between(14, 19) & luhn(digits(hit))).cast("int"),
        "phone": F.when(within("phone"), 1).when(within("ip") | within("card") | within("email") | ~F.length(digits(hit)).between(7, 12), 0),
        "key": F.when(hit.rlike(KEY), 1).when(hit.rlike(NO_KEY), 0),
    }[kind]


def fitted(cells: list[tuple[tuple[int, ...], float, float]]) -> list[dict]:
    """Newton boosting of depth-two trees on cells (features, weight of all, weight of positives)."""
    score = [0.0] * len(cells)
    trees = []
    for _ in range(ROUNDS if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [pos - w * q for (_, w, pos), q in zip(cells, p)]
        h = [w * q * (1 - q) for (_, w, _), q in zip(cells, p)]

        def best(rows: list[int]) -> tuple[float, int, int]:
            gain = lambda i: sum(g[r] for r in i) ** 2 / (sum(h[r] for r in i) + 1)
            whole, found = gain(rows), (0.0, 0, 0)
            for f, bins in enumerate(FEATURES.values()):
                for cut in range(1, bins):
                    low, high = [r for r in rows if cells[r][0][f] < cut], [r for r in rows if cells[r][0][f] >= cut]
                    if low and high:
                        found = max(found, (gain(low) + gain(high) - whole, f, cut))
            return found

        leaf = lambda rows: RATE * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + 1)
        everything = list(range(len(cells)))
        _, f, cut = best(everything)
        tree: dict = {"f": f, "cut": cut, "sides": []}
        for rows in ([r for r in everything if cells[r][0][f] < cut], [r for r in everything if cells[r][0][f] >= cut]):
            gained, f2, cut2 = best(rows)
            parts = ([r for r in rows if cells[r][0][f2] < cut2], [r for r in rows if cells[r][0][f2] >= cut2]) if gained > 0 else (rows, rows)
            tree["sides"].append((f2, cut2, leaf(parts[0]), leaf(parts[1])))
            for side, part in enumerate(parts if gained > 0 else (rows,)):
                for r in part:
                    score[r] += tree["sides"][-1][2 + side]
        trees.append(tree)
    return trees


def value(trees: list[dict], cell: tuple[int, ...]) -> float:
    total = 0.0
    for t in trees:
        f, cut, low, high = t["sides"][cell[t["f"]] >= t["cut"]]
        total += high if cell[f] >= cut else low
    return total


def thresholds(trees: list[dict], cells: list[tuple[tuple[int, ...], float, float]]) -> dict[str, float]:
    """Of each kind the lowest score whose calibrated probability is at least ``PRECISION``; infinite without one.

    Probabilities are the shares of positives at each score, each with half a negative and half a positive more, where
    a lower score has the higher share pooled with those above it.
    """
    out = {}
    for k, kind in enumerate(NAMES):
        at: dict[float, list[float]] = {}
        for c, w, pos in cells:
            if c[0] == k and w:
                sums = at.setdefault(round(value(trees, c), 6), [0.0, 0.0])
                sums[0] += w
                sums[1] += pos
        pools: list[list[float]] = []  # lowest score, weight, positives; by rising score
        for s in sorted(at):
            pools.append([s, *at[s]])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                _, w, pos = pools.pop()
                pools[-1][1] += w
                pools[-1][2] += pos
        out[kind] = min((s for s, w, pos in pools if pos + 0.5 >= PRECISION * (w + 1)), default=math.inf) - 1e-6  # scores were rounded
    return out


def scored(trees: list[dict], cell: Column) -> Column:
    total = F.lit(0.0)
    for t in trees:
        sides = [F.when(cell[f] >= cut, F.lit(high)).otherwise(F.lit(low)) for f, cut, low, high in t["sides"]]
        total = total + F.when(cell[t["f"]] >= t["cut"], sides[1]).otherwise(sides[0])
    return total


def told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(NAMES.index(kind)).alias("kind"), s["stop"].alias("stop")))


def line(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def proposed(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and the wide candidates with features and distant label; each text is read here alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # most texts lack the characters that a pattern needs; none is searched for what it can't have
    rows = rows.withColumn("numbers", F.col("text").rlike("[0-9]")).withColumn("at", F.col("text").contains("@"))
    able = {"email": F.col("at"), "ip": F.col("numbers") & F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("numbers") & F.col("text").rlike("[0-9][ -]?[0-9]"), "phone": F.col("numbers") & F.col("text").contains("+")}
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    rows = rows.select("doc_id", "text", "numbers", "at", *[F.when(able[k], v).otherwise(none).alias(k) for k, v in base(F.col("text")).items()])

    def candidates(kind: str, pattern: str) -> Column:
        can = F.col("at") | F.col("text").rlike(r"[\[({](?:at|AT)[\])}]") if kind == "email" else F.col("numbers")
        made = F.transform(matches(F.col("text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), features(kind, s, F.col("text")).alias("cell"), label(kind, s).alias("label")))
        return F.when(can, made).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,cell:array<int>,label:int>>"))

    wide = F.concat(*[candidates(k, p) for k, p in LOOSE.items()])
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(k) for k in KINDS]
    return rows.select("doc_id", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).alias("fold"), *bare, wide.alias("wide"))


def model(rows: DataFrame) -> tuple[list[dict], dict[str, float]]:
    """Trees fitted to the labelled candidates of all folds but 0, and thresholds calibrated on fold 0."""
    labelled = rows.select((F.col("fold") == 0).alias("held"), F.explode("wide").alias("c")).where("c.label IS NOT NULL")
    # the bins bound the number of cells
    counted = labelled.groupBy("held", "c.cell").agg(F.count(F.lit(1)).alias("n"), F.sum("c.label").alias("p")).collect()
    cells = lambda held: sorted((tuple(r["cell"]), float(r["n"]), float(r["p"])) for r in counted if r["held"] == held)
    trees = fitted(cells(False))
    return trees, thresholds(trees, cells(True))


def apart(spans: Column) -> Column:
    """Of spans that overlap the one with the higher score, by their starts."""
    kept = F.slice(spans, 1, 0)

    def step(state: Column, s: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        rest = F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0)))
        return F.when(last.isNull() | (s["start"] >= last["stop"]), F.concat(state, F.array(s))).when(s["score"] > last["score"], F.concat(rest, F.array(s))).otherwise(state)

    return F.aggregate(F.array_sort(spans), kept, step)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, base: all of them, and added: the candidates that the trees select and that overlap no base span."""
    rows = stored(proposed(docs), "candidates")
    trees, cut = model(rows)
    least = F.array(*[F.lit(cut[k]) for k in NAMES])
    scores = F.transform("wide", lambda c: F.struct(c["start"].alias("start"), c["cell"][0].alias("kind"), c["stop"].alias("stop"), scored(trees, c["cell"]).alias("score")))
    bases = F.concat(*[told(k, F.col(k)) for k in KINDS])
    rows = rows.select("doc_id", *KINDS, bases.alias("base"), scores.alias("scores"))
    chosen = F.filter("scores", lambda c: (c["score"] >= least[c["kind"]]) & ~F.exists("base", lambda b: (c["start"] < b["stop"]) & (b["start"] < c["stop"])))
    rows = rows.select("doc_id", *KINDS, "base", chosen.alias("chosen"))
    return rows.select("doc_id", *KINDS, "base", F.transform(apart(F.col("chosen")), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))).alias("added"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_added: how many of the spans the trees have added."""
    return find(docs).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
