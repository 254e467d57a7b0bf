"""Main text of web pages by a site style tree.

The pages of a host are merged into a tree of elements, styled by tag, class and id; an element's text is a leaf below it. A
leaf's features are its words (as min-hashes of each text's set of words), links and images. Its content importance is one minus the mean entropy of its features'
occurrences over the pages that have the leaf: what most pages of a host repeat (notices, menus) has entropy near 1, text of its own has 0. An inner
element's presentation importance is the entropy of its layouts (the sequence of its children) over the pages, and its importance a composite of that, by as much as it
has more layouts, and of its children's importance. Branches in which no node's importance reaches ``least`` are removed from each page.

What HTML itself marks as no part of the article (navigation, scripts ...), forms, a page's headers, and elements whose class, id or role names such a part
are in the tree as all others, with the prior weight ``PRIOR``, which no importance lifts to ``least``; such a form, header or name has no weight where the element holds most of the page's
text and no article element stands outside of it, or all but a tenth of the article's text. An article or main element is a prior too: nodes below it are
removed as any others, unless most of its text would go, and blocks outside of it stay only where they hold more text than it does.

Defined cases: null or empty html gives an empty text; tags that are never closed end with their parent; inline elements with such
a word are skipped up to their own end, and not at all without one; elements more than ``DEPTH`` deep belong to their ancestor there, so work
is linear in a page's length however it is nested; a host's nodes on fewer than
``pages`` different pages are kept (entropy over a few pages says little); a null url, or one without a host, is the host ''; rows with a
null id are kept; repeated rows are extracted each, and count once in the tree; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import Hashes, mixed, schema_of, stored, texts_of

#: Pages of a host that tell of a node; the least importance that stays; the weight of marked parts; the share that a composite leaves to one layout's
#: children; min-hashes of a text; depth.
PAGES, LEAST, PRIOR, SHARE, HASHES, DEPTH = 4, 0.3, 0.25, 0.9, 8, 48
TEXT = "page_id long, url string, text string, n_chars long"
#: Of each page: its leaves' features and how many of a leaf's texts have each; its inner elements with their levels and layouts; and their children.
TREE = "host long, page long, leaf array<long>, feature array<long>, c array<double>, inner array<long>, level array<int>, layout array<long>, parent array<long>, child array<long>, share array<double>"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^\s\"'>/]*)(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>?|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s>/\"']*)")
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: fixed values of HTML: elements whose content is raw text, that have no content, that are part of a line
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: elements that are never part of an article's text
NEVER = RAW | frozenset("head nav aside footer button select option input svg math object audio video canvas map dialog menu datalist fieldset optgroup progress meter".split())
#: words of a class, id or role that name such parts
PARTS = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted
nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar
header masthead topbar footer bottombar sidebar rail widget widgets
cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login
comment comments disqus reply replies respond discussion
share sharing social related recommended search searchbox form
complementary contentinfo alert alertdialog dialog
""".split())
#: opening one of these closes an open paragraph
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body article main section div".split())


def named(tag: str) -> set[str]:
    hints = " ".join(x for m in HINT.finditer(tag) for x in m.groups() if x)
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", hints).lower())) if hints else set()


#: Comments, raw elements and the tags of inline elements.
SPANS = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(sorted(RAW))})\b|<(?P<end>/?)(?P<tag>{'|'.join(sorted(INLINE, key=lambda t: (-len(t), t)))})(?=[\s/>])[^>]*>", re.S | re.I)


def ends(page: str) -> dict[int, int]:
    """Where the element that opens at a place ends, of the inline elements that are closed; one pass over the page."""
    found: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    at = 0
    while m := SPANS.search(page, at):
        at = m.end()
        if m["raw"]:
            end = re.compile(rf"</{m['raw']}\b[^>]*>?", re.I).search(page, at)
            if not end:
                break
            at = end.end()
        elif m["tag"]:
            around = open_.setdefault(m["tag"].lower(), [])
            if m["end"] and around:
                found[around.pop()] = at
            elif not m["end"] and not m[0].endswith("/>"):
                around.append(m.start())
    return found


def child(parent: int, style: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{style}") >> 1


SOURCE = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def blocks(page: str) -> Iterator[tuple[int, tuple[int, ...], str, tuple[str, ...]]]:
    """The ``marked`` blocks that can be part of the article, without the mark."""
    return (b[1:] for b in marked(page) if not b[0])


def marked(page: str) -> Iterator[tuple[bool, int, tuple[int, ...], str, tuple[str, ...]]]:
    """(whether it is marked as no part of an article, depth of the article or main element around it or 0, nodes of the styled elements around, text, links and images) of each block, in order."""
    stack: list[tuple[str, tuple[int, ...], bool, int, tuple[int, ...]]] = []  # tag, nodes, removed, inside, doubtful elements around
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    text: list[str] = []
    found: list[tuple[int, tuple[int, ...], str, tuple[int, ...], bool, tuple[str, ...]]] = []
    links: list[str] = []
    doubtful: list[bool] = []  # whether each doubtful element is inside an article
    articles: set[tuple[int, ...]] = set()
    closed: dict[int, int] | None = None
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                found.append((stack[-1][3], stack[-1][1], whole, stack[-1][4], stack[-1][2], tuple(links)) if stack else (0, (), whole, (), False, tuple(links)))
            links.clear()

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]

    while at < n:
        m = TOKEN.match(page, at)
        piece, at = m[0], m.end()
        if piece[0] != "<" or piece == "<":
            text.append(piece)
            continue
        name = NAME.match(piece)
        if not name:
            continue
        tag = name[1].lower()
        if piece[1] == "/":
            if tag in INLINE:
                continue
            if tag in ("p", "br"):
                flush()
            if opened.get(tag):
                flush()
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in INLINE:
                flush()
            continue
        hints = named(piece) if "=" in piece else set()
        if tag in ("a", "img") and "=" in piece and (link := SOURCE.search(piece)):
            links.append(next(x for x in link.groups() if x is not None))
        if tag in INLINE:
            if hints & PARTS and not piece.endswith("/>"):  # an inline element can be an advert or a comment: skip to its end
                closed = ends(page) if closed is None else closed
                at = max(at, closed.get(m.start(), at))
            continue
        flush()
        if tag in VOID:
            continue
        if tag in BLOCKS or tag in CLOSES:
            for other in ("p",) if tag in BLOCKS else CLOSES[tag]:
                for i in range(len(stack) - 1, -1, -1) if opened.get(other) else ():
                    if stack[i][0] == other:
                        cut(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
        removed, inside, around = stack[-1][2:] if stack else (False, 0, ())
        removed = removed or tag in NEVER
        # a page's header is none of the article's text; an article's own one holds its heading
        parts = hints & PARTS - {"header"} if inside else hints & PARTS
        if not removed and len(around) < DEPTH and (parts and tag not in ("html", "body", "main") or tag == "form" or tag == "header" and not inside):
            around = (*around, len(doubtful))
            doubtful.append(inside > 0)
        if not removed and (tag in ("article", "main") or "main" in hints and tag not in ("html", "body")):
            inside = inside or len(stack) + 1
            articles.add(around)
        nodes = stack[-1][1] if stack else ()
        if len(nodes) < DEPTH:
            nodes = (*nodes, child(nodes[-1] if nodes else 0, f"{tag}.{'.'.join(sorted(hints - {''}))}" if hints else tag))
        stack.append((tag, nodes, removed, inside, around))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    gone = without([f[:4] for f in found if not f[4]], doubtful, articles)
    for own, nodes, whole, around, removed, sources in found:
        yield removed or not gone.isdisjoint(around), own, nodes, whole, sources


def without(found: list[tuple], doubtful: list[bool], articles: set[tuple[int, ...]]) -> set[int]:
    """The doubtful elements to remove: not those that hold the article or, where a page marks none, most of its text."""
    gone = set(range(len(doubtful)))
    if not gone:
        return gone
    size, total = [0] * len(doubtful), 0
    for _, _, t, around in found:
        total += len(t)
        for x in around:
            size[x] += len(t)
    for x, within in enumerate(doubtful):  # outer elements come first
        if 2 * size[x] <= total:
            continue
        if within and any(gone.isdisjoint(a) for a in articles):
            left = sum(len(t) for own, _, t, around in found if own and gone.isdisjoint(around))
            if 10 * left < size[x]:
                gone.discard(x)
        elif not any(gone.isdisjoint(a) for a in articles):
            gone.discard(x)
    return gone


def host() -> Column:
    """A hash of the name of the url's host."""
    name = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.xxhash64(F.regexp_replace(F.lower(name), r"^www\.", "")).alias("host")


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The unmarked blocks outside low nodes (marked ones have the weight ``PRIOR`` below ``LEAST``): those of the article, and the others where they hold more text or no article is marked."""
    found = list(blocks(page))
    kept = [low.isdisjoint((*nodes[own:], child(nodes[-1] if nodes else 0, TEXTS))) for own, nodes, _, _ in found]
    inside = sum(len(t) for own, _, t, _ in found if own)
    stays = sum(len(t) for (own, _, t, _), k in zip(found, kept) if own and k)
    if 2 * stays < inside:
        kept = [k or own > 0 for (own, _, _, _), k in zip(found, kept)]
        stays = inside
    every = sum(len(t) for (own, _, t, _), k in zip(found, kept) if k and not own) > stays
    return " ".join(t for (own, _, t, _), k in zip(found, kept) if k and (own or every))


#: The style of the leaf that holds an element's own text.
TEXTS = "#text"
SEEDS = np.random.default_rng(31).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def features(found: list[tuple[str, tuple[str, ...]]], hashes: Hashes) -> list[set[int]]:
    """Of each text with its links and images: min-hashes of its words, and hashes of the links and images."""
    out: list[set[int]] = [set() for _ in found]
    for i, f in zip(*(x.tolist() for x in told(found, hashes))):
        out[i].add(f)
    return out


def told(found: list[tuple[str, tuple[str, ...]]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature) of all ``features``, with repeats, as two columns."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = [text.encode("utf-8", "surrogatepass").split() for text, _ in found]
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), dtype=np.uint64)
    starts = np.cumsum([0, *map(len, words[:-1])])
    least = np.array([np.minimum.reduceat(mixed(h * s), starts) >> np.uint64(1) for s in SEEDS])
    of = [i for i, (_, sources) in enumerate(found) for _ in sources]
    own = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for _, sources in found for x in sources]
    return np.r_[np.tile(np.arange(len(found)), HASHES), np.array(of, np.int64)], np.r_[least.astype(np.int64).ravel(), np.array(own, np.int64)]


def counted(leaf: np.ndarray, text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, feature, how many of its texts have it) from rows (leaf, text, feature) with repeats."""
    order = np.lexsort((text, feature, leaf))
    leaf, text, feature = leaf[order], text[order], feature[order]
    new = np.r_[True, (leaf[1:] != leaf[:-1]) | (feature[1:] != feature[:-1])][: len(leaf)]
    another = new | np.r_[True, text[1:] != text[:-1]][: len(leaf)]
    first = np.flatnonzero(new)
    return leaf[first], feature[first], (np.add.reduceat(another, first, dtype=np.float64) if len(first) else np.empty(0))


def layouts(paths: list[tuple[int, ...]]) -> list[list]:
    """Columns inner element, level, layout; and element, child, share of the element's children: of a page whose texts are below these paths."""
    children: dict[int, list[int]] = {}
    levels: dict[int, int] = {}
    last: tuple[int, ...] = ()
    for path in paths:
        same = next((j for j, (x, y) in enumerate(zip(path, last)) if x != y), min(len(path), len(last)))
        for j in range(max(1, min(same, len(path) - 1)), len(path)):  # what the block opens below what it shares with the one before
            children.setdefault(path[j - 1], []).append(path[j])
            levels[path[j - 1]] = j - 1
        last = path
    layout = [xxhash.xxh3_64_intdigest(np.array(below, dtype="<i8").tobytes()) >> 1 for below in children.values()]
    rows = [(node, c, n / len(below)) for node, below in children.items() for c, n in Counter(below).items()]
    return [list(children), [levels[x] for x in children], layout, *([list(x) for x in zip(*rows)] or [[], [], []])]


def merged(pages: DataFrame) -> DataFrame:
    """A row (``TREE``) for each page, which is parsed once. pages: host, html. Pages of a host that are equal are one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, hashes = schema_of(TREE), Hashes(100_000)
        keys: list[tuple[int, int]] = []
        of: dict[tuple[int, int], int] = {}  # numbers of the (page, leaf) that are held
        texts: list[tuple[str, tuple[str, ...]]] = []
        leaves: list[int] = []  # of each text
        inner: list[list[list]] = []

        def done() -> pa.RecordBatch:
            text, feature = told(texts, hashes)
            leaf, feature, c = counted(np.array(leaves)[text], text, feature)
            page, node = (np.array(x, dtype=np.int64)[leaf] for x in zip(*of))
            ends = np.searchsorted(page, np.arange(len(keys) + 1)).astype(np.int32)
            columns = [pa.array(x, pa.int64()) for x in zip(*keys)] + [pa.ListArray.from_arrays(ends, x) for x in (node, feature, c)]
            columns += [pa.array(x, f.type) for x, f in zip(zip(*inner), list(schema)[5:])]
            for held in (keys, of, texts, leaves, inner):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for b in batches:
            hosts, size = b.column(0).to_pylist(), 0
            for i, page in texts_of(b, "html"):
                if found := list(marked(page)):
                    paths = [(*nodes, child(nodes[-1] if nodes else 0, TEXTS)) for _, _, nodes, _, _ in found]
                    leaves += [of.setdefault((len(keys), path[-1]), len(of)) for path in paths]
                    texts += [(text, sources) for _, _, _, text, sources in found]
                    inner.append(layouts(paths))
                    keys.append((hosts[i], xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1))
                    size += len(page)
                if keys and (size > 1_000_000 or i == len(b) - 1):
                    yield done()
                    size = 0

    return pages.select("host", "html").mapInArrow(run, TREE).dropDuplicates(["host", "page"])


def style_tree(pages: DataFrame, on_pages: int = PAGES) -> DataFrame:
    """Rows (host, node, pages, importance, top) of the merged trees. top: the largest importance in the node's branch, 1 where a node of it is on fewer than ``on_pages`` pages."""
    each = stored(merged(pages.select(host(), "html")), "trees")
    # every step is a sum that combines before the shuffle
    n_pages = each.select("host", F.explode(F.array_distinct("leaf")).alias("node")).groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"))
    leaves = each.select("host", "leaf", "c", F.posexplode("feature").alias("k", "feature")).select("host", F.get("leaf", "k").alias("node"), "feature", F.get("c", "k").alias("c"))
    per = leaves.groupBy("host", "node", "feature").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    # entropy of a feature's occurrences over pages, averaged over the leaf's occurrences
    content = per.groupBy("host", "node").agg(F.sum(F.col("total") * F.log("total") - F.col("clogc")).alias("h"), F.sum("total").alias("all")).join(n_pages, ["host", "node"])
    own = F.when(F.col("pages") > 1, 1 - F.col("h") / F.col("all") / F.log(F.col("pages").cast("double"))).otherwise(1.0)
    told_ = F.when(F.col("pages") >= on_pages, F.col("importance")).otherwise(1.0)
    done = stored(content.select("host", "node", "pages", own.alias("importance")).withColumn("top", told_), "leaf-importance")
    # how many pages have each layout; a child's share of its parent is its mean share of the layouts
    styles = each.select("host", "level", "layout", F.posexplode("inner").alias("k", "node")).select("host", "node", F.get("level", "k").alias("level"), F.get("layout", "k").alias("layout"))
    styles = styles.groupBy("host", "node", "level", "layout").agg(F.count(F.lit(1)).alias("on"))
    shape = styles.groupBy("host", "node", "level").agg(F.sum("on").alias("n"), F.sum(F.col("on") * F.log("on")).alias("nlogn"), F.count(F.lit(1)).alias("styles"))
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("nlogn") / F.col("n")) / F.log(F.col("n").cast("double"))).otherwise(1.0)
    shape = stored(shape.select("host", "node", "level", F.col("n").alias("pages"), F.col("styles"), entropy.alias("shape")), "shapes")
    shares = each.select("host", "parent", "share", F.posexplode("child").alias("k", "child")).select("host", F.get("parent", "k").alias("node"), "child", F.get("share", "k").alias("share"))
    shares = stored(shares.groupBy("host", "node", "child").agg(F.sum("share").alias("share")), "shares")
    deepest = shape.agg(F.max("level")).first()[0]
    for level in range(-1 if deepest is None else deepest, -1, -1):  # at most ``DEPTH`` levels, each a join of nodes, not of pages
        here = shape.where(F.col("level") == level)
        below = shares.join(here.select("host", "node"), ["host", "node"]).join(done.select("host", F.col("node").alias("child"), "importance", "top"), ["host", "child"])
        below = below.groupBy("host", "node").agg((F.sum(F.col("share") * F.col("importance")) / F.sum("share")).alias("below"), F.max("top").alias("highest"))
        left = F.pow(F.lit(SHARE), F.col("styles"))
        made = here.join(below, ["host", "node"]).withColumn("importance", (1 - left) * F.col("shape") + left * F.col("below"))
        made = made.select("host", "node", "pages", "importance", F.greatest("highest", told_).alias("top"))
        done = stored(done.unionByName(made), "importance")
    return done


def extract(pages: DataFrame, least: float = LEAST, on_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    low = style_tree(rows, on_pages).where(F.col("top") < least)
    low = stored(low.groupBy("host").agg(F.collect_list("node").alias("low")), "low-nodes")
    # Spark broadcasts the low nodes only where the written table is below its own broadcast limit
    joined = rows.withColumn("host", host()).join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows, texts = b.column(3).to_pylist(), []
            for i, page in texts_of(b, "html"):
                texts.append(main_text(page, frozenset(lows[i] or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema_of(TEXT))

    return joined.mapInArrow(run, TEXT)
