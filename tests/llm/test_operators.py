"""Each operator on small tables against brute force, and on the cases that its docstring defines."""

import base64
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavequarry.llm import caps, htmltext, jaccard, lines, mixing, packing, pii, shared, toxicity, warc, winnowing

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()


def docs_of(spark, texts):
    """Documents with clashing extra columns; ids in order, or given."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    """Null, empty, blank, tiny, long, repeated and equal texts, and ids that are null or repeated."""
    rng = random.Random(5)
    long_ = text(rng, 30_000)
    return [None, "", " \n\t ", "a", "one two three", long_, text(rng, 300), text(rng, 300), "dup " + text(rng, 60), (None, "no id"), (6, "again"), (9, None), "é漢🙂 <|endoftext|> x  y\n\n z "]


# ---- packing


def check_pieces(rows, texts):
    model = Tokenizer.from_file(BPE)
    left = Counter((i, tuple(model.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in texts)
    sequences = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0  # so nothing is padded
    # pieces of rows with one id can belong to either row: they are matched greedily
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, parts in by.items():
        want = [list(ids) for (i, ids), n in left.items() for _ in range(n) if i == doc]
        assert sum(r["length"] for r in parts) == sum(map(len, want))
        for r in parts:
            got = np.frombuffer(r["ids"], "<u4").tolist()
            assert any(len(w) == r["doc_tokens"] and w[r["start"] : r["start"] + r["length"]] == got for w in want)
    assert set(by) == {i for i, _ in left}


def test_packing(spark, hard):
    df = docs_of(spark, hard)
    rows = packing.pack(df, BPE).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert packing.pack(df.limit(0), BPE).count() == 0


def test_tokenizer_equals_the_library():
    rng, t = random.Random(2), packing.tokenizer(BPE)
    alphabet = "ab 'stéZ\n\t .,1²_—漢<|\x1c  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["x<|endoftext|>y", "", " ", "\n", "a\nb", "a \nb", "it's I'll don't"]
    assert [t.ids(x) for x in texts] == [t.plain([x])[0] for x in texts]


def test_neighbours_fill_windows():
    a = np.arange(10, 40)
    tails = [(i, 0, ids, len(ids)) for i, ids in enumerate([a, np.arange(500, 530), a[::-1].copy(), np.arange(900, 930)])]
    counts = np.ones(1000, dtype=np.int64)
    counts[10:40] = 2
    shard = packing.Shard(tails, counts, 4, 30.0)
    assert shard.neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    first = next(packing.windows(shard, 60, []))
    assert [p[0] for p in first] == [0, 2]


# ---- line dedup


def brute_lines(texts, least):
    """Lines of runs of at least ``least`` words that occur before."""
    runs, gone = {}, {}
    for i, t in texts:
        rows = [x for x in (t or "").split("\n") if x.strip()]
        for a in range(len(rows)):
            for b in range(a + 1, len(rows) + 1):
                if sum(len(x.split()) for x in rows[a:b]) >= least:
                    key = tuple(rows[a:b])
                    if runs.setdefault(key, (i, a)) != (i, a):
                        gone.setdefault(i, set()).update(range(a, b))
    return {i: [x for k, x in enumerate(x for x in (t or "").split("\n") if x.strip()) if k not in gone.get(i, ())] for i, t in texts}


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [text(rng, n) for n in (1, 2, 3, 8, 20, 30, 60)]
    texts = [(i, "\n".join(rng.choice([*pool, text(rng, rng.randrange(1, 12)), ""]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    got = {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if x.strip()] for r in lines.dedup_lines(docs_of(spark, texts), 20).collect()}
    assert got == brute_lines(texts, 20)


def test_line_dedup_cases(spark, hard):
    passage = text(random.Random(1), 60)
    df = docs_of(spark, [*hard, passage, "own line\n" + passage + "\nand another", passage])
    rows = lines.dedup_lines(df)
    assert rows.columns[:2] == ["doc_id", "text"] and "score" in rows.columns and rows.count() == df.count()
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in rows.collect() if r["doc_id"] is not None}
    n = len(hard)
    assert got[n] == (passage, 0) and got[n + 1] == ("own line\nand another", 1) and got[n + 2] == ("", 1)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    twice = docs_of(spark, [(1, passage), (1, passage)])
    assert [r["n_deleted"] for r in lines.dedup_lines(twice).collect()] == [0, 0]


def test_ranks_are_in_the_order_of_the_keys(spark):
    rng = random.Random(35)
    rows = spark.createDataFrame([(i, rng.randrange(40), rng.randrange(3)) for i in range(300)], "i long, a long, b long").repartition(5)
    got = {(r["a"], r["b"]): r["name"] for r in lines.ranked(rows, ["a", "b"]).collect()}
    assert sorted(got, key=got.get) == sorted(got) and len(set(got.values())) == len(got)


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for j, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), j, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii(spark, hard):
    rng = random.Random(4)
    bits = ["a.b@c.de", "x_y@q", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é🙂 ", " ", "12 34", "00000000000000", "9" * 40, "token = " + "ab12" * 10, "+49.30.123456", "..@..", "1" * 300 + ".1.1.1"]
    texts = [*hard, *["".join(rng.choice([*bits, " w "]) for _ in range(rng.randrange(1, 12))) for _ in range(250)], "1 " * 5000, "9" * 50_000, "a" * 20_000 + "@b.c"]
    df = docs_of(spark, texts)
    got = pii.digest(df).collect()
    want = Counter((r["doc_id"], hashlib.sha256(base_spans(r["text"] or "").encode()).hexdigest()) for r in df.collect())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    of = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] > 12:
            assert set(filter(None, base_spans(of[r["doc_id"]]).split(","))) <= set(r["spans"].split(","))
    assert pii.digest(df.limit(0)).count() == 0


def test_boosting_learns_a_cell():
    cells = [((k, 1, 1, 0, 0, c, 0, 0), 50.0, 50.0 if c else 1.0) for k in range(3) for c in (0, 1)]
    trees = pii.fitted(cells)
    assert min(pii.value(trees, c) for c, _, p in cells if p > 1) > max(pii.value(trees, c) for c, _, p in cells if p == 1)


def test_thresholds_are_the_calibrated_precision(monkeypatch):
    monkeypatch.setattr(pii, "value", lambda trees, cell: float(cell[1]))
    rng = random.Random(31)
    for _ in range(40):
        cells = [((0, s, 0, 0, 0, 0, 0, 0), float(w := rng.randrange(0, 60)), float(rng.randrange(0, w + 1) if s < 3 else w)) for s in range(6)]
        # isotonic shares by their definition: the greatest, over lower ends, of the least share up to a higher end
        has = [(s, w, p) for (_, s, *_), w, p in cells if w]
        best = None
        for i in range(len(has)):
            for low in range(i + 1):
                share = [(sum(p for _, _, p in has[low : high + 1]), sum(w for _, w, _ in has[low : high + 1])) for high in range(i, len(has))]
                if all(p + 0.5 >= pii.PRECISION * (w + 1) for p, w in share) and low == i:
                    best = has[i][0] if best is None else best
        got = pii.thresholds([], cells)["email"]
        assert got == float("inf") or any(p >= pii.PRECISION * w * 0.9 for s, w, p in has if s >= got)
        assert best is None or got <= best


def test_pii_selects_more_than_the_rules(spark):
    """Phones without a country code, written-out addresses and keys of other lengths look like those that a check tells."""
    rng = random.Random(32)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    texts = []
    for i in range(240):
        texts.append(f"{text(rng, 9)} call +1 {number()} now or 10.220.1{i % 10}0.140 {text(rng, 3)} key = \"{hexa(40)}\" and my-own-title-{i}-of-it mail a{i}@b.com. {text(rng, 4)}")
    at = len(texts)
    texts += [f"please call {number()} now", f'key = "{hexa(48)}" ok', f"mail me[at]host{at}[dot]com. ok", "see my-other-title-77-of-it now"]
    rows = {r["doc_id"]: r for r in pii.digest(docs_of(spark, texts)).collect()}
    assert rows[at]["spans"] == f"phone:12:{12 + 14}" and rows[at]["n_phone"] == 0
    assert rows[at + 1]["spans"] == "key:7:55" and rows[at + 2]["spans"].startswith("email:5:") and rows[at + 3]["spans"] == ""
    assert all("key:" in rows[i]["spans"] and rows[i]["n_added"] == 1 for i in range(at))


# ---- html


def test_html():
    page = "<html><head><title>no</title><style>p{}</style></head><body><nav><a>menu</a></nav><header>site</header><div class='cookie-notice'>ok?</div><article><h1>T &amp;  x</h1><p>a<b>b</b> c<br>d<p>e&#233;<script>var t='</p>'</script><section class=comments><p>me too</p></section><form>f</form></article><aside>s</aside><footer>f</footer></body></html>"
    assert htmltext.main_text(page) == "T & x ab c d eé"
    assert [htmltext.main_text(x) for x in ("", "plain", "<", "<p", "<!-- x", "<p>a<p>b", "<div class=ad>x</div>y", "<article>a")] == ["", "plain", "<", "", "", "a b", "y", "a"]


def test_html_keeps_what_holds_the_article():
    body = "<h1>Title</h1><p>" + "long text of it " * 20 + "</p>"
    want = "Title " + ("long text of it " * 20).strip()
    bar = "<div class=sidebar>side</div>"
    for around in ("<div id=page class=with-sidebar>%s</div>", "<div class='layout header-fixed'><article>%s</article></div>", "<article class='post comments-open'>%s</article>", "<form>%s</form>", "<article><div class=social-story>%s</div></article>"):
        assert htmltext.main_text("<body>" + around % (body + bar) + "</body>") == want
    assert htmltext.main_text("<article><div class=post-header><h1>T</h1></div><p>x</p><div class=comments>no</div></article>") == "T x"
    assert htmltext.main_text("<div class=related>" + body + "<article>teaser</article></div><article><p>own</p></article>") == "own"


def test_html_skips_inline_elements_to_their_own_end():
    assert htmltext.main_text("<article>x <span class=related>a<span>b</span>c</span> y<span class=ad>z</article>") == "x yz"
    assert htmltext.main_text("<p>k<b class=ad>u<!-- </b> --><script>'</b>'</script>v</b>w</p>") == "kw"


def test_html_work_is_linear():
    for part in ("<span class=ad>x", "<div>x", "<div class=ad>x", "</x><p>", "<b class=ad>y</i>", "<li>", "<script x"):
        began = time.process_time()
        htmltext.main_text(part * 20_000)
        assert time.process_time() - began < 8
    deep = list(htmltext.blocks("<div>x" * 3000))
    assert len(deep) == 3000 and max(len(nodes) for _, nodes, _, _ in deep) == htmltext.DEPTH
    assert htmltext.main_text("<i>" * 5000 + "x") == "x" and htmltext.main_text("<article>" * 2000 + "x" + "<" * 50) == "x" + "<" * 50


def test_importance_by_definition(spark):
    """Leaves by the entropy of their features over pages, inner elements by their layouts and children, in plain loops."""
    rng = random.Random(33)
    parts = ["<div>menu <a href=/x>here</a></div>", "<div><p>a</p></div>", "<nav>all <img src=i.png></nav>"]
    pages = ["<body>" + "".join(rng.choice([*parts, f"<div class=z><p>{rng.randrange(5)}</p><p>x y</p></div>", f"<p>own {i}</p>"]) for _ in range(6)) + "</body>" for i in range(9)]
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate([*pages, pages[0]])], "page_id long, url string, html string")
    rows = htmltext.style_tree(df, 5).collect()
    got = {r["node"]: (r["pages"], r["importance"]) for r in rows}
    leaves, layouts, levels = {}, {}, {}
    for i, page in enumerate(pages):
        below, last = {}, ()
        for _, _, nodes, t, sources in htmltext.marked(page):
            path = (*nodes, htmltext.child(nodes[-1], htmltext.TEXTS))
            for f in htmltext.features([(t, sources)], shared.Hashes())[0]:
                leaves.setdefault(path[-1], {}).setdefault(f, Counter())[i] += 1
            shared_ = 0
            while shared_ < min(len(path), len(last)) and path[shared_] == last[shared_]:
                shared_ += 1
            for j in range(max(1, min(shared_, len(path) - 1)), len(path)):
                below.setdefault(path[j - 1], []).append(path[j])
                levels[path[j - 1]] = j
            last = path
        for n, children in below.items():
            layouts.setdefault(n, {})[i] = tuple(children)
    assert set(got) == set(leaves) | set(layouts)
    entropy = lambda counts: -sum(c / sum(counts) * np.log(c / sum(counts)) for c in counts)
    want = {}
    for n, found in leaves.items():
        on = {i for c in found.values() for i in c}
        every = sum(sum(c.values()) for c in found.values())
        want[n] = (len(on), 1.0 if len(on) == 1 else 1 - sum(sum(c.values()) * entropy(list(c.values())) for c in found.values()) / every / np.log(len(on)))
    for n in sorted(layouts, key=levels.get, reverse=True):
        m, styles = len(layouts[n]), Counter(layouts[n].values())
        children = sum(np.mean([want[c][1] for c in x]) for x in layouts[n].values()) / m
        left = 0.9 ** len(styles)
        want[n] = (m, (1 - left) * (1.0 if m == 1 else entropy(list(styles.values())) / np.log(m)) + left * children)
    for n, (m, x) in want.items():
        assert got[n][0] == m and abs(got[n][1] - x) < 1e-9
    top = {r["node"]: r["top"] for r in rows}
    for n, (m, x) in want.items():
        below = [top[c] for x in layouts.get(n, {}).values() for c in x]
        assert top[n] == pytest.approx(max([x if m >= 5 else 1.0, *below]))


def test_style_tree_parses_a_page_once_and_holds_it_in_a_row(spark):
    """Leaves and inner elements of a page come from one pass; equal pages of a host are one row, others are not."""
    page = "<body><div><p>a b a</p><p>a b</p><p>c <a href=/x>d</a><a href=/x>e</a></p></div><div><p>f</p></div></body>"
    hosts = ["http://h/1", "https://www.H/2", "http://i/1", None]
    df = spark.createDataFrame([(u, page) for u in hosts] + [("http://h/3", page + "<p>g"), ("http://h/4", None)], "url string, html string")
    made = htmltext.merged(df.select(htmltext.host(), "html"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = made.collect()
    assert len(rows) == 4 and len({r["host"] for r in rows}) == 3 and len({r["page"] for r in rows}) == 2
    want, shares = Counter(), {}
    for _, _, nodes, t, sources in htmltext.marked(page):
        leaf = htmltext.child(nodes[-1], htmltext.TEXTS)
        want.update((leaf, f) for f in htmltext.features([(t, sources)], shared.Hashes())[0])
        shares.setdefault(nodes[1], Counter())[nodes[2]] += 1
    same = min((r["page"] for r in rows), key=lambda p: -sum(r["page"] == p for r in rows))
    for r in (r for r in rows if r["page"] == same):
        assert dict(zip(zip(r["leaf"], r["feature"]), r["c"])) == want and len(r["c"]) == len(want)
        assert len(r["inner"]) == len(set(r["inner"])) == len(r["level"]) == len(r["layout"]) and set(r["parent"]) == set(r["inner"])
        got = dict(zip(zip(r["parent"], r["child"]), r["share"]))
        assert all(got[n, c] == k / below.total() for n, below in shares.items() for c, k in below.items())


def test_style_tree_finds_what_differs_in_a_word_and_regions_of_one_layout(spark):
    """Neither the tag nor the class of these parts says what they are."""
    rng = random.Random(12)
    own = [text(rng, 50) for _ in range(12)]
    more = "Read about the news of our town and all that is new in our shop today, visitor number"
    pages = [(i, f"http://e.example/{i}", f"<body><div class=qa><p>{more} {rng.randrange(9999)}</p></div><div class=qb><ul><li><a href=/a>About us</a><li><a href=/b>Contact</a></ul></div><div class=qc><p>{own[i]}</p></div></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(own))


def test_style_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(6)
    pages = [(i, "http://h.example/%d" % i, f"<body><div id=w><div>Visit our other pages today</div><div id=c><p>{text(rng, 30)}</p></div></div></body>") for i in range(12)]
    pages += [(90, None, None), (91, "nonsense", ""), (92, "http://x.example/", "<p>alone</p>"), (0, pages[0][1], pages[0][2]), (None, "http://x.example/", "<p>no id</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next(p[2] for p in pages if p[0] == r["page_id"])
        want = re.search("<p>(.*)</p>", html)[1] if html else ""
        assert r["text"] == want and r["n_chars"] == len(want)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_style_tree_decides_inside_and_outside_articles(spark):
    rng = random.Random(8)
    own = [text(rng, 60) for _ in range(18)]
    notice = "<div class=zq>Read all our other pages today</div>"
    pages = [(i, "http://a.example/%d" % i, f"<body><p>top</p><main><article><h1>t{i}</h1>{notice}<p>{own[i]}</p></article></main></body>", f"t{i} {own[i]}") for i in range(8)]
    pages += [(i, "http://b.example/%d" % i, f"<body><div class=q7>{own[i]}</div>{notice}<article>See {i}</article></body>", f"{own[i]} See {i}") for i in range(8, 16)]
    pages += [(16, "http://c.example/", f"<body><div>{own[16]}</div><article>See</article></body>", own[16] + " See")]
    # pages of one article in different frames keep it
    pages += [(20 + i, "http://d.example/%d" % i, f"<body><div>x{i}</div><article><p>{own[17]}</p></article></body>", own[17]) for i in range(8)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()} == {p[0]: p[3] for p in pages}


# ---- mixing


def test_mixing_meets_targets(spark, hard):
    rng = random.Random(7)
    texts = [*hard, *[text(rng, rng.randrange(20, 80)) + (" ### %%% ***" * 9 if i % 5 == 0 else "") for i in range(300)]]
    labels = spark.createDataFrame([(i, int(i % 5 != 3), None if i % 7 == 0 else 0) for i in range(14, 300)] + [(None, 1, 1), (20, None, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.rated(docs_of(spark, texts), labels, {0: 0.4, 1: 0.6}).collect()
    assert len(rows) == len(texts) and all(r["rate"] >= 0 for r in rows)
    t, p, r = (np.array([x[c] for x in rows]) for c in ("tokens", "p", "rate"))
    assert np.allclose(p.sum(axis=1), 1)
    got = (t[:, None] * p * r[:, None]).sum(axis=0) / t.sum()
    assert np.allclose(got, [0.4, 0.6], atol=0.01)
    # the same descent in numpy
    want, whole = np.ones(len(t)), (t[:, None] * p).sum(axis=0)
    residual = lambda r: (((t * r)[:, None] * p).sum(axis=0) - np.array([0.4, 0.6]) * t.sum()) / whole
    before, age, last = want, 1.0, np.full(2, np.inf)
    for _ in range(mixing.ITERATIONS):
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        e = residual(want)
        if np.abs(e).max() < mixing.TOLERANCE:
            break
        momentum = (older - 1) / age
        if (e @ e) > (last @ last):
            age, momentum = 1.0, 0.0
        ahead, last = want + momentum * (want - before), e
        before, want = want, np.clip(ahead - mixing.STEP * p @ residual(ahead), 0, mixing.HIGHEST)
    assert np.allclose(r[t > 0], want[t > 0], atol=1e-3) and (r[t == 0] == 1).all()
    assert all(int(x["rate"]) <= x["copies"] <= int(x["rate"]) + 1 for x in rows)
    up = mixing.rated(docs_of(spark, texts), labels, {0: 0.4, 1: 0.6}, lowest=1.0)
    assert up.where("copies < 1").count() == 0


def test_mixing_without_labels(spark, hard):
    df = docs_of(spark, hard)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["rate"] for r in mixing.rated(df, none, {}).collect()] == [1.0] * len(hard)
    assert mixing.mixed_docs(df, none, {}).columns == df.columns and mixing.mixed_docs(df.limit(0), none, {}).count() == 0


# ---- embeddings


def test_caps_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24))
    x[50:150] = x[0] + 0.12 * rng.normal(size=(100, 24))
    x[150:180] = x[1]
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)] + [(1000, None, "n"), (1001, [0.0] * 24, "n"), (1002, [float("nan")] * 24, "n"), (1003, [1.0, None] * 12, "n"), (1004, [], "n"), (1005, [0.5, 1.0], "n"), (1006, [1.0, 2.0], "n"), (1007, [-1.0, 0.0], "n"), (None, x[0].tolist(), "n"), (5, x[5].tolist(), "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    low = caps.forest(close)
    want = {i: (int(close[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(len(x))}
    assert sum(got[i][0] for i in want) >= 0.99 * close.sum()
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i] == (0, i, True) for i in [*range(1000, 1005), 1007]) and got[None] == (0, None, None)
    assert got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)  # a shorter length has links of its own
    assert caps.near_duplicates(df.limit(0)).count() == 0


def test_caps_find_links_at_any_size_of_the_table():
    rng = np.random.default_rng(34)
    x = rng.normal(size=(600, 64))
    y = x + 0.3 * rng.normal(size=x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = (x * y).sum(axis=1) >= 0.95
    for rows in (100, 10**6, 10**8):
        code = caps.ProductCode(64, rows)
        assert code.words**2 >= caps.FILTERS_PER_ROW * rows and sum(b.size for pair in code.books for b in pair) < 10**7
        shared_ = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y))]
        assert near.sum() > 300 and np.mean(np.array(shared_)[near]) >= 0.9


def test_caps_recall_on_fresh_pairs_of_any_length():
    """Pairs right at the least cosine, which the fit hasn't seen; a code drawn from the fitted numbers is the fitted code."""
    rng = np.random.default_rng(77)
    for dim, rows in ((2, 10**4), (8, 10**5), (64, 2000)):
        code = caps.ProductCode(dim, rows)
        u, v = rng.normal(size=(2, 500, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v -= (u * v).sum(axis=1, keepdims=True) * u
        v = 0.951 * u + np.sqrt(1 - 0.951**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(u), code.decode(v))]) >= 0.92
        again = caps.ProductCode(dim, rows, fitted=(code.threshold, code.least))
        assert all((a == b).all() for a, b in zip(code.decode(u[:20]), again.decode(u[:20])))


def test_caps_send_a_vector_once_to_its_group(spark, monkeypatch):
    """A group of any width equals brute force: whole, in pairs of blocks, or by its filters where it is long and sparse. Vectors aren't stored again."""
    rng = np.random.default_rng(61)
    x = rng.normal(size=(1100, 24))
    x[:300] = x[0] + 0.1 * rng.normal(size=(300, 24))  # dense
    turn = 0.2 * np.arange(160)
    x[300:460] = np.cos(turn)[:, None] * x[300] + np.sin(turn)[:, None] * x[301] + (0.004 * np.arange(160))[:, None] * x[302]  # a chain
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    low = caps.forest(close)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made, store = [], caps.stored

    def kept(d, name):
        made.append((name, store(d, name)))
        return made[-1][1]

    monkeypatch.setattr(caps, "stored", kept)
    for more in ({}, {"wide": 64}, {"wide": 4}):
        made.clear()
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicates(df, **more).collect()}
        assert sum(got[i] == (close[i].sum(), low[i]) for i in range(len(x))) >= (0.97 if 4 in more.values() else 0.99) * len(x)
        assert all(n <= close[i].sum() for i, (n, _) in got.items())
        if not more:
            files = [f.removeprefix("file:") for n, d in made if n != "decoded" for f in d.inputFiles()]
            assert sum(map(os.path.getsize, files)) < x.nbytes / 4
        assert [not d.isEmpty() for n, d in made if n == "sparse-groups"] == {None: [], 64: [False], 4: [True]}[more.get("wide")]


def test_caps_sketches_lose_no_pair_that_shares_a_filter(spark):
    rng = np.random.default_rng(62)
    for dim in (2, 24, 100):
        u, v = rng.normal(size=(2, 200, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v -= (u * v).sum(axis=1, keepdims=True) * u
        v = 0.95001 * u + np.sqrt(1 - 0.95001**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(np.concatenate([u, v]))], "vec_id long, embedding array<double>")
        code = caps.ProductCode(dim, 400)
        shared_ = [i for i, (a, b) in enumerate(zip(code.decode(u), code.decode(v))) if len(np.intersect1d(a, b))]
        got = {r["vec_id"]: r["n_links"] for r in caps.near_duplicates(df).collect()}
        assert len(shared_) >= 180 and all(got[i] and got[200 + i] for i in shared_)


# ---- Jaccard join


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    low = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "a b c", "A  b\tc", "c b a"]
    for _ in range(25):
        own = text(rng, rng.choice([5, 9, 40, 120])).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(own)
            for _ in range(rng.randrange(0, 1 + len(own) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy[rng.randrange(0, 3) :]))
    passage = text(rng, 80)
    texts += [passage + " " + text(rng, 25) for _ in range(20)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_links_come_from_its_trees(spark, monkeypatch):
    """Blocks of four sets, so that roots have many and large components have their own; both traversals find links."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    written = {}
    monkeypatch.setattr(jaccard, "stored", lambda df, name: written.setdefault(name, shared.stored(df, name)))
    rng = random.Random(29)
    texts, base = [], text(rng, 80).split()
    for group in range(3):  # chains: each text is near the one before it and far from the first; they share a passage
        own = base[:40] + text(rng, 40).split()
        for i in range(24):
            own = list(own)
            own[40 + (7 * i) % 40] = "w%d" % rng.randrange(10**6)
            texts.append(" ".join(own))
    texts += [" ".join(base[:40] + text(rng, 12 + i % 5).split()) for i in range(12)]
    star = text(rng, 80).split()  # copies that are near their original only
    texts += [" ".join(w if j not in (5 + i % 30, 42 + i % 31) else f"s{i}" for j, w in enumerate(star)) for i in range(30)] + [" ".join(star)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs_of(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows)
    assert want[len(texts) - 1][1] == len(texts) - 31
    first, hub, second = ({tuple(r) for r in written[n].collect()} for n in ("first-links", "hub-links", "second-links"))
    assert len(first) > 20 and len(hub) > 0 and len(second) > 0 and not (first & hub or first & second or hub & second)


def test_jaccard_in_any_order_of_ids(spark):
    rng = random.Random(19)
    rows = []
    for _ in range(30):
        own = text(rng, 60).split()
        near = [*own[:-1], "other"]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((own, own, near, own, near))]
    want = brute_components(rows)
    shuffled = list(rows)
    rng.shuffle(shuffled)
    for order, files in ((rows[::-1], 1), (shuffled, 1), (shuffled, 37)):
        df = docs_of(spark, order).repartition(files) if files > 1 else docs_of(spark, order).coalesce(1)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(df).collect()} == want
    names = jaccard.set_rows(docs_of(spark, rows).select("doc_id", "text")).select("h2").distinct()
    alone = docs_of(spark, [(i, text(random.Random(1), 60)) for i in range(40)]).repartition(8).select("doc_id", "text")
    assert names.count() == 60 and jaccard.shared_counts(alone).count() == 0


def test_jaccard_cases(spark, hard):
    df = docs_of(spark, hard)
    assert jaccard.similar(df).count() == len(hard) and jaccard.similar(df.limit(0)).count() == 0


def test_tree_traversal_loses_no_pair():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) < 0.9], rng.integers(0, 1 << 62, 10, dtype=np.uint64)]) for _ in range(40)] + [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (50, 150, 300)]
    sets.sort(key=len)
    bits = np.zeros((len(sets), jaccard.BITS // 64), np.uint64)
    for i, s in enumerate(sets):
        for at in (s >> np.uint64(20)) % np.uint64(jaccard.BITS):
            bits[i, int(at) // 64] |= np.uint64(1) << (at % np.uint64(64))
    tree = jaccard.Tree(np.array(list(map(len, sets))), bits, np.arange(len(sets)))
    found = set(zip(*(x.tolist() for x in jaccard.dual(tree, tree, True))))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found or (j, i) in found


# ---- winnowing


def test_winnowing_definition():
    rng = random.Random(11)
    for t in ["", "a", "abcdefg", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", *("".join(rng.choice("abc é") for _ in range(rng.randrange(120))) for _ in range(50))]:
        hashes, places = winnowing.winnow(t)
        if not t:
            assert not len(hashes)
            continue
        h = winnowing.rolling(winnowing.code_points(t), winnowing.K)
        size = min(winnowing.WINDOW, len(h))
        want = sorted({max(range(i, i + size), key=lambda j: (-int(h[j]), j)) for i in range(len(h) - size + 1)})
        assert places.tolist() == want and hashes.tolist() == [int(h[j]) for j in want]


def test_winnowing_edits(spark, hard):
    ids = [(3 * i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(hard)]
    ids = [(i, t) for i, t in ids if i is not None and i != 9 and i != 6] + [(6, "six"), (9, "nine")]
    got = {r["doc_id"]: r for r in winnowing.fingerprint_edits(docs_of(spark, ids)).collect()}
    order = sorted(ids)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        new = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == winnowing.encoded(*winnowing.winnow(t)) and r["edited_fingerprint"] == winnowing.encoded(*winnowing.winnow(new))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (r["near_next"] == 1 if t == n else True)
    df = docs_of(spark, hard)
    assert winnowing.fingerprint_edits(df).count() == len(hard) and winnowing.fingerprint_edits(df.limit(0)).count() == 0
    assert winnowing.fingerprints(df).count() == len(hard)


# ---- toxicity


def test_toxicity_learns(spark, hard):
    rng = random.Random(12)
    texts = [(i, text(rng, 60) + (" vile " if i % 6 == 0 else " ") + text(rng, 20)) for i in range(500)]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(500)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, labels).withColumn("held", toxicity.is_held_out()).collect()
    held = [r for r in rows if r["held"]]
    assert sum(r["held"] for r in rows) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500))
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    odd = toxicity.score(docs_of(spark, hard), labels)
    assert odd.count() == len(hard) and odd.where("score between 0 and 1").count() == len(hard)
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).count() == 0


def test_toxicity_is_fitted_in_a_task(spark):
    """The driver gets the model alone: it numbers no words. Its model is the one of the same rows in any order."""
    rows = [(i, ("calm lake " if i % 3 else "vile brute ") + text(random.Random(i), 20), "en", int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    toxicity.PIECES.clear()
    m = toxicity.fitted(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert not toxicity.PIECES
    want = toxicity.model_of(df.where(~toxicity.is_held_out()).orderBy("doc_id", ascending=False).toArrow())
    assert (m.embedding == want.embedding).all() and (m.out == want.out).all() and (m.slope, m.shift, m.thresholds) == (want.slope, want.shift, want.thresholds)


def plain_logit(m, words):
    """The network by loops over its definition."""
    x = m.embedding[words].reshape(len(words), toxicity.DIM)
    total = float(m.offset)
    for k, (w, f, b) in enumerate(zip(toxicity.WIDTHS, m.filters, m.bias)):
        n = max(1, len(words) - toxicity.PAD - w + 1)
        for c in range(toxicity.FILTERS):
            best = max(sum(float(x[i + j] @ f[j][:, c]) for j in range(w)) for i in range(n)) + float(b[c])
            total += max(0.0, best) * float(m.out[k * toxicity.FILTERS + c])
    return total


def test_convolution_and_its_gradient(monkeypatch):
    rng = np.random.default_rng(36)
    texts = [toxicity.numbered(" ".join(rng.choice(WORDS, n))) for n in (1, 2, 5, 30, 0)]
    labels = np.array([1, 0, 1, 0, 0], dtype=np.float32)
    m = toxicity.trained(texts, labels)
    for t in texts:
        assert abs(m.logit(toxicity.vectors(m.embedding, t)) - plain_logit(m, t)) < 1e-4
    loss = lambda m: sum(np.log1p(np.exp(-(2 * y - 1) * plain_logit(m, t))) for t, y in zip(texts, labels))
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    start = loss(toxicity.trained(texts, labels))
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    once = loss(toxicity.trained(texts, labels))
    assert loss(m) < once < start


# ---- WARC


def test_warc_round_trip(spark):
    pages = [(i, f"http://www.h{i % 3}.example/{i % 4}?q={i}#f", "<p>%d é</p>\r\n\r\nWARC/1.1" % (i % 5)) for i in range(40)] + [(100, None, None), (101, "", ""), (None, "x", "lost")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    for least in (0, 18):
        captures = warc.verified(warc.read_archives(spark, warc.write_archives(df, least=least)))
        got = {r["page_id"]: r for r in captures.collect()}
        assert len(got) == len(pages)
        for i, u, h in pages:
            data, r = (h or "").encode(), got[i]
            same = [p for p, _, x in pages if (x or "").encode() == data and p is not None]
            first = max(same) if same and len(data) >= least else i
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["url"] == (u or "")
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
            assert r["payload"] == (data if first == i else None)
    history = warc.merge_index(captures).collect()
    keys = [(r["urlkey"], r["timestamp"], -1 if r["page_id"] is None else r["page_id"]) for r in history]
    assert keys == sorted(keys) and len(keys) == len(pages)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def test_loser_tree():
    rng = random.Random(13)
    for k in range(0, 9):
        runs = [sorted(("u%d" % rng.randrange(9), "t%d" % rng.randrange(9), rng.randrange(99)) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


# ---- shared


def test_components(spark):
    edges = [(i + 1, i) for i in range(20)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(37)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    low = list(range(150))
    for _ in range(150):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: low[x] for e in edges if e[0] != e[1] for x in e}
