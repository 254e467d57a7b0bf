"""The conversation trie against a trie of dictionaries, whatever the bands are."""

import hashlib
import math
import random
import re
import zlib

import pytest

from wavequarry.llm import trie

ROWS = "conv_id long, turn long, role string, text string, depth string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0, 0) if p in children else (1, 0)
        if p:
            saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]))
        for q in children.get(p, []):
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in members.items():
        parent = min(members[p[:-1]])[0] if p else None
        ends = ",".join(str(c) for c in sorted(c for c, end in m if end))
        out.append((min(m)[0], len(p), parent, len(m), len(children.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng, rows = random.Random(3), []
    for c in range(150):
        n = rng.choice([0, 1, 2, 3, 5, 7])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b c", "", None, "é x y"])) for t in range(n)]
    long_ = [(200, t, "user", f"w{t} x") for t in range(60)]
    rows += long_ + [(c, t, r, x) for c in (220, 240) for _, t, r, x in long_[:58]]  # share 58 turns and part
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(4)]  # copies
    rows += [(400, None, "user", "first"), (400, -1, "user", "second"), (None, 0, "user", "nobody"), (-7, 0, "user", "negative"), (-20, 0, "user", "block")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 7, 2000])
def test_trie(spark, limit):
    rows = conversations()
    got = trie.trie(spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS), limit).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_no_conversations(spark):
    assert trie.trie(spark.createDataFrame([], ROWS)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], ROWS)).collect() == []


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(1, 30)]
    got = trie.trie(spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
