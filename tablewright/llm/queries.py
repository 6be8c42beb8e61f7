"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, langid, linededup, maxent, packing, quality, secrets, simhash, urlfilter, warc

from tablewright.llm.shared import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.judge(docs, F.col("doc_id"), F.col("text"), quality.fit(docs, F.col("text"), F.col("lang")))
    return found.withColumnRenamed("key", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 5)
    found = langid.label(docs, F.col("doc_id"), F.col("text"), langid.fit(docs, F.col("text"), F.col("lang"), fold != 0))
    return found.select(F.col("key").alias("doc_id"), (crc_fold(F.col("key"), 5) == 0).alias("held_out"), "lang_pred", "score", "other_words")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, F.col("doc_id"), F.col("text"), secrets.fit(docs, F.col("text"))).withColumnRenamed("key", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = simhash.classes(docs, F.col("doc_id"), F.col("text"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"), F.col("doc_id"), F.col("text"))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return linededup.cleaned(docs).select("row.doc_id", "n_lines", F.col("n_gone").alias("n_removed"), digest.alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_fold(F.col("doc_id"), 7) == 2
    found = maxent.score(docs, F.col("doc_id"), F.col("text"), ~held)
    return found.withColumnRenamed("key", "doc_id").withColumn("held_out", held)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op5_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        h AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS x FROM p),
        d AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS digest FROM h),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY n, digest) AS response FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to FROM l
    """,
    "op9_line_dedup": r"""
        WITH d AS (SELECT DISTINCT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        r AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM d),
        w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM r),
        p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM w),
        ends AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.c - a.c + a.w >= 50 GROUP BY ALL),
        starts AS (SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.pos),
        runs AS (SELECT * FROM ends UNION SELECT * FROM starts),
        named AS (SELECT runs.*, array_to_string(l[s + 1 : e + 1], chr(10)) AS t FROM runs JOIN d USING (doc_id)),
        later AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM named),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM later WHERE k > 1)
        SELECT p.doc_id, count(*)::BIGINT AS n_lines, count(gone.pos)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
        FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos GROUP BY p.doc_id
    """,
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
        places AS (SELECT doc_id, item_id, i, grams.n AS n FROM grams JOIN windows USING (g, n)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM places) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM places) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
}
