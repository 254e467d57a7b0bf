"""The stages, each on its own input, against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from wavequarry.llm import entries

from .test_operators import brute_components, brute_lines, text


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    d = str(tmp_path_factory.mktemp("tables"))
    passage = "\n".join(text(rng, 30) for _ in range(2))
    rows = [(i, text(rng, 70) + (" vile" if i % 8 == 0 else "") + ("\n" + passage if i % 10 == 3 else ""), "en", f"s{i % 3}", 0) for i in range(300)]
    near = text(rng, 300).split()
    rows += [(1000 + i, " ".join(w if j != 10 * i else "other" for j, w in enumerate(near)), "en", "s9", 0) for i in range(8)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 8 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]

    clean = corpus_pipeline.drop_toxic(spark, docs, tables)
    assert clean.columns == columns
    kept = {r["doc_id"] for r in clean.collect()}
    toxic = {i for i in range(300) if i % 8 == 0}
    assert len(toxic - kept) >= 0.9 * len(toxic) and len(kept) >= 0.98 * (310 - len(toxic))

    left = corpus_pipeline.drop_repeated_lines(spark, docs, tables)
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = brute_lines(texts, 50)
    full = {i for i, t in texts if not (t or "").strip() or want[i]}
    assert {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if x.strip()] for r in left.collect()} == {i: want[i] for i in full} and left.columns == columns

    single = corpus_pipeline.drop_near_copies(spark, docs, tables)
    low = brute_components([(i, t) for i, t in texts if i >= 200])
    assert sorted(r["doc_id"] for r in single.where("doc_id >= 200").collect()) == sorted(i for i, (_, c) in low.items() if i == c) and single.columns == columns

    mixed = corpus_pipeline.mix_sources(spark, docs, tables)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) == {i for i, _ in texts} and mixed.columns == columns and max(copies.values()) < 20

    packed = corpus_pipeline.pack(spark, mixed, tables).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        for x in [*model.encode(t or "", add_special_tokens=False).ids, 0]:
            want[x] += copies[i]
    got = Counter()
    for r in packed:
        got.update(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want


def test_stages_on_odd_tables(spark, tables):
    """Empty tables, repeated rows, nulls and clashing columns pass every stage."""
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, "y", 2), (3, "", None, None), (4, "vile words here", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, rate int")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "n_lines": F.lit(7), "tokens": F.lit("t")})
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            got = stage(spark, df, tables)
            if name == "packing":
                assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in df.collect()}
                continue
            assert got.columns == df.columns
            back = sorted(map(str, got.select("doc_id", "text", "toxic", "rate", "n_lines", "tokens").distinct().collect()))
            assert set(back) <= set(map(str, df.select("doc_id", "text", "toxic", "rate", "n_lines", "tokens").collect()))
            assert len(back) >= (3 if df is docs else 0)


def test_query_wrappers(spark, tables):
    """The digests that queries derive from their operators."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    scored = entries.op9_toxicity(spark, tables).collect()
    assert scored[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(scored) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in entries.op1_packing(spark, tables).collect():
        ids = [*model.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
    assert entries.op3_pii(spark, tables).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert entries.op5_mixing(spark, tables).where("rate < 0 OR abs(p_low + p_high - 1) > 1e-9").count() == 0


def test_run_and_entries(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0
    names = entries.queries()
    assert [n.split("_")[0] for n in names] == sorted((n.split("_")[0] for n in names), key=lambda n: int(n[2:])) and len(names) == 13
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries()) and set(entries.oracle_sql()) <= set(names)
