"""The training-data pipeline over ``documents``: each stage is one of the operators of ``wavequarry.llm``.

The near-duplicate stage works on word shingles (five words, similarity 0.75 or more). Mixing only repeats documents
here (rates of at least 1), so no clean document is lost to it; what it repeats, packing packs as often.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.llm import jaccard, lines, mixing, packing, toxicity
from wavequarry.llm.shared import stored, table

#: Weights of the quality labels in the mixed corpus.
WEIGHTS = {0: 0.3, 1: 0.7}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels of both classes, or of an empty table, all stay; repeated rows are
    judged each by their text; columns named as the operator's own come from ``docs``."""
    renamed = {c: f"_docs_{c}" for c in docs.columns if c in ("score", "toxic")}
    scored = toxicity.score(docs.withColumnsRenamed(renamed), table(spark, sf_dir, "labels"))
    return scored.where("NOT toxic").drop("score", "toxic").withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left go; those that were empty before stay. Rows equal in id and text are one document."""
    renamed = {c: f"_docs_{c}" for c in docs.columns if c in ("n_lines", "n_deleted", "th", "gone")}
    left = lines.dedup_lines(docs.withColumnsRenamed(renamed))
    return left.where("n_deleted = 0 OR text <> ''").drop("n_lines", "n_deleted").withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; documents without an id stay. An id that stays keeps
    all its rows, whatever their texts."""
    kept = jaccard.similar(docs).where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; columns named as the operator's own come back from ``docs``."""
    renamed = {c: f"_docs_{c}" for c in docs.columns if c in mixing.OWN}
    mixed = mixing.mixed_docs(docs.withColumnsRenamed(renamed), table(spark, sf_dir, "labels"), WEIGHTS, lowest=1.0)
    return mixed.withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row; a repeated row is packed as often. An empty table gives none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Training, list decoding by hash and packing are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
