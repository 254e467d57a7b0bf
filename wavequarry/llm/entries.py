"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.llm import caps, fmindex, htmltext, jaccard, lines, mixing, packing, pii, ranked, toxicity, trie, warc, winnowing
from wavequarry.llm.shared import stored, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_lines", "n_deleted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {0: 0.3, 1: 0.7})
    return rated.select("doc_id", "source", "tokens", F.get("p", F.lit(0)).alias("p_low"), F.get("p", F.lit(1)).alias("p_high"), "rate", "copies")


def op6_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    captures = stored(warc.verified(warc.read_archives(spark, folder)).drop("payload"), "captures")
    return warc.merge_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return trie.trie(table(spark, sf_dir, "conversations")).select(*[F.col(c).cast("long").alias(c) for c in columns], "ends_sha256")


def op13_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = fmindex.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: DuckDB lacks base 32; 40 bits of the digest at a time give 8 digits.
BASE32_SQL = "translate(" + " || ".join(f"lpad(to_base(('0x' || substr(sha1(coalesce(html, '')), {i}, 10))::BIGINT, 32), 8, '0')" for i in (1, 11, 21, 31)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

#: CRC-32 of a decimal number: the reflected polynomial, a byte and then a bit at a time.
CRC32_SQL = "xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::BIGINT))"

TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op10_warc": f"""
            WITH p AS (SELECT page_id::BIGINT AS page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {BASE32_SQL} AS payload_digest FROM pages),
            m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN response <> page_id THEN response END AS refers_to FROM m""",
        "op11_ranked": f"""
            WITH d AS (SELECT row_number() OVER () AS place, doc_id, {TERMS_SQL} AS terms FROM documents),
            total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
            tf AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
            weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
            asked AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
            score AS (SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // length)))))::BIGINT AS score
                FROM asked JOIN weight USING (term) JOIN tf USING (term), total GROUP BY ALL)
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= 10""",
        "op12_trie": f"""
            WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS digest,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
            c AS (SELECT conv_id, {CRC32_SQL} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
            turns AS (SELECT c.conv_id, 0 AS own, t.* EXCLUDE conv_id FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h
                UNION ALL SELECT c.conv_id, 1, t.* EXCLUDE conv_id FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
            numbered AS (SELECT conv_id, words, digest, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM turns),
            path AS (SELECT conv_id, depth, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM numbered UNION ALL SELECT conv_id, 0, 0, '' FROM c),
            step AS (SELECT *, lag(k) OVER w AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
            node AS (SELECT k, depth, any_value(above) AS above, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256 FROM step GROUP BY k, depth),
            below AS (SELECT above AS k, count(*) AS n_children FROM node WHERE above IS NOT NULL GROUP BY above),
            whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN below USING (k)),
            subtree AS (SELECT p.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens FROM whole w JOIN path p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.k)
            SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
            FROM whole w JOIN subtree s USING (k) LEFT JOIN node p ON p.k = w.above""",
        "op13_fmindex": r"""
            WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
            w AS (SELECT place, doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) > 12),
            judged AS (SELECT place, i, doc_id > min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + 12], ' ')) AS gone FROM w),
            cut AS (SELECT place, i FROM judged WHERE gone),
            covered AS (SELECT DISTINCT place, unnest(range(i, i + 13)) AS i FROM cut),
            each AS (SELECT place, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
            left_over AS (SELECT place, count(c.i) AS gone, string_agg(word, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept FROM each e LEFT JOIN covered c USING (place, i) GROUP BY place)
            SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN left_over USING (place)""",
    }
