"""Prefix trie of conversations by truncation peeling.

Every conversation is the path of its turns' digests. The nodes of the greatest depth are made of the conversations that end
there; their last turn is stripped, which turns each into a contribution to its parent, and what is equal then is one node
of the depth before, together with the conversations that end there. So each node's members, children, leaves and saved words
are summed up while it is discovered.

Depths are peeled in bands. Below a depth at which no prefix has more than ``LIMIT`` contributions, a prefix is a group of
bounded size and one task peels it down to that depth; the depth above it, where some prefix has more, is one grouped sum over all
tasks, after which that prefix is a single contribution and the next band begins. So neither a common prefix nor a very long
conversation costs a job for each depth. Conversations that are equal are one contribution from the start.

Defined cases: rows without conv_id belong to no conversation; null roles and texts are empty; turns come by ``turn`` (null first),
those of one turn by their digest; a conversation of any length is one record of 20 bytes a turn; further columns aren't read; an empty
table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import parts, schema_of, stored

#: Contributions below one prefix that a task peels; ids in one piece of a list that is hashed.
LIMIT, PIECE = 2000, 4096
#: Conversations of one block share the first turns of its first one: the block's size, and the modulus of how many.
BLOCK, SHARED = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"
DIGEST = 16
ENTRY = "depth int, keys binary, words binary, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PEELED = "open boolean, key binary, parent_key binary, " + ENTRY
NODE = ["key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NONE = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each the digest of its role and text and its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("t"))


def rebuilt(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """Each conversation with the first h turns of its block's first one in place of its own, h = crc32(id) % ``shared``."""
    own = stored(turns(conversations), "turns")
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("first_id"), F.slice("t", 1, max(1, shared - 1)).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    return own.join(first, F.col("conv_id") - F.col("conv_id") % block == F.col("first_id"), "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("first", F.slice("t", 1, 0)), F.lit(1), h), F.slice("t", h + 1, F.greatest(F.size("t"), F.lit(1)))).alias("t"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, the keys of its prefixes one behind the other, and the words of its turns."""
    schema = schema_of("conv_id long, depth int, keys binary, words binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, keys = b"", []
                for t in ts:
                    key = hashlib.md5(key + t["digest"]).digest()
                    keys.append(key)
                out.append((c, len(keys), b"".join(keys), np.array([t["words"] for t in ts], "<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return conversations.select("conv_id", "t").mapInArrow(run, "conv_id long, depth int, keys binary, words binary")


def key_at(depth: Column) -> Column:
    """The key of an entry's prefix of ``depth`` turns; the root's is empty."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.expr("keys").substr((depth - 1) * DIGEST + 1, F.lit(DIGEST)))


def ended(chains: DataFrame) -> DataFrame:
    """A row per distinct path: how many conversations end there, the smallest of them, the hash of the list of their ids.

    The ids are put in order over all tasks and joined to pieces first, so the list of a path that very many conversations share is a
    few rows where it is hashed."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("key binary, first long, n long, ids string")
        key, ids = None, []

        def piece() -> list[tuple]:
            return [(key, ids[0], len(ids), ",".join(map(str, ids)))] if ids else []

        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key or len(ids) == PIECE:
                    out += piece()
                    key, ids = k, []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece()), schema)], schema=schema)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("conv_id long, n_convs long, ends_sha256 string")
        key = low = sha = None
        n = 0
        for b in batches:
            out = []
            for k, first, count, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if sha:
                        out.append((low, n, sha.hexdigest()))
                    key, low, n, sha = k, first, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
                n += count
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((low, n, sha.hexdigest()), schema)], schema=schema)

    n = parts(chains.sparkSession)
    rows = chains.select(key_at(F.col("depth")).alias("key"), "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    listed = rows.mapInArrow(pieces, "key binary, first long, n long, ids string").repartition(n, "key").sortWithinPartitions("key", "first")
    return listed.mapInArrow(hashed, "conv_id long, n_convs long, ends_sha256 string")


def peel(entries: list[tuple], least: int) -> Iterator[tuple]:
    """Peels contributions that share their prefix of ``least`` turns from the greatest depth to that one: its nodes, and the
    contribution to the prefix before it."""
    levels: dict[int, dict[bytes, list]] = {}

    def add(depth, keys, words, n, low, children, leaves, saved, ends):
        at = levels.setdefault(depth, {})
        node = at.get(key := keys[-DIGEST:])
        if node is None:
            at[key] = [keys, words, n, low, children, leaves, saved, ends]
        else:
            node[2] += n
            node[3] = min(node[3], low)
            node[4] += children
            node[5] += leaves
            node[6] += saved
            node[7] = node[7] or ends

    for e in entries:
        add(*e)
    for depth in range(max(levels), least - 1, -1):
        for key, (keys, words, n, low, children, leaves, saved, ends) in levels.pop(depth, {}).items():
            leaves = leaves or 1
            saved += (n - 1) * int.from_bytes(words[-4:], "little") if depth else 0
            above = keys[: -DIGEST or None]
            yield False, key, above[-DIGEST:] if depth else None, depth, None, None, n, low, children, leaves, saved, ends or NONE
            if depth > least:
                add(depth - 1, above, words[:-4], n, low, 1, leaves, saved, None)
            elif depth:
                yield True, None, None, depth - 1, above, words[:-4], n, low, 1, leaves, saved, None


def band(entries: DataFrame, least: int) -> DataFrame:
    """Each group of entries with one prefix of ``least`` turns, peeled in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(PEELED)
        prefix, group, out = None, [], []
        for b in batches:
            for p, *entry in zip(*(c.to_pylist() for c in b.columns)):
                if p != prefix and group:
                    out += peel(group, least)
                    group = []
                prefix = p
                group.append(entry)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if group:
            out += peel(group, least)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    names = [c.split()[0] for c in ENTRY.split(", ")]
    grouped = entries.select(key_at(F.lit(least)).alias("prefix"), *names).repartition(parts(entries.sparkSession), "prefix").sortWithinPartitions("prefix")
    return grouped.mapInArrow(run, PEELED)


def level(entries: DataFrame, depth: int) -> DataFrame:
    """All nodes of ``depth`` as grouped sums, and their contributions to the depth before; columns as those of ``band``."""
    here = entries.where(F.col("depth") == depth).groupBy(key_at(F.lit(depth)).alias("key")).agg(
        F.any_value("keys").alias("keys"), F.any_value("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"))
    last = F.lit(0)
    if depth:
        b = [F.conv(F.hex(F.col("words").substr(4 * depth - 3 + i, 1)), 16, 10).cast("long") for i in range(4)]
        last = b[0] + b[1] * 256 + b[2] * 65536 + b[3] * 16777216
    here = here.withColumn("saved_tokens", F.col("saved") + (F.col("n_convs") - 1) * last)
    above = F.col("keys").substr(1, (depth - 1) * DIGEST)
    sums = ["n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]
    node = here.select(F.lit(False).alias("open"), "key", (key_at(F.lit(depth - 1)) if depth else F.lit(None).cast("binary")).alias("parent_key"), F.lit(depth).alias("depth"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("words"), *sums, F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))
    if not depth:
        return node
    up = here.select(F.lit(True).alias("open"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(depth - 1).alias("depth"), above.alias("keys"), F.col("words").substr(1, 4 * (depth - 1)).alias("words"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
    return node.unionByName(up)


def crowded(entries: DataFrame, limit: int) -> tuple[int, int]:
    """The greatest depth, and the least one from which on no prefix has more than ``limit`` entries."""
    each = entries.select("keys", F.explode(F.sequence(F.lit(0), "depth")).alias("at"))
    most = each.groupBy("at", key_at(F.col("at")).alias("key")).count().groupBy("at").agg(F.max("count").alias("n")).agg(F.max("at"), F.max(F.when(F.col("n") > limit, F.col("at")))).first()
    return -1 if most[0] is None else most[0], -1 if most[1] is None else most[1]


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie's nodes over ``conversations`` as they are rebuilt: columns of ``NODE`` and parent_conv_id."""
    chains = stored(paths(rebuilt(conversations)), "paths")
    zero = F.lit(0).cast("long")
    entries = ended(chains).join(chains, "conv_id").select("depth", "keys", "words", "n_convs", "conv_id", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
    names = [c.split()[0] for c in ENTRY.split(", ")]
    entries, found = stored(entries, "entries"), []
    deepest, full = crowded(entries, limit)
    while deepest >= 0:
        if deepest > full:
            least = full + 1
            peeled = stored(band(entries.where(F.col("depth") >= least), least), "band")
        else:
            least = deepest
            peeled = stored(level(entries, least), "level")
        found.append(peeled.where("NOT open").select(*NODE))
        if not least:
            break
        entries = peeled.where("open").select(*names).unionByName(entries.where(F.col("depth") < least).select(*names))
        # right above a band some prefix is crowded by what has been stripped to it
        deepest, full = (least - 1, least - 1) if deepest > full else crowded(entries, limit)
    if not found:
        return level(entries, 0).select(*NODE, F.lit(None).cast("long").alias("parent_conv_id")).limit(0)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent_key", "left").select(*NODE, "parent_conv_id")
