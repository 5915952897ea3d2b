"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, huffman, linededup, lm, simhash, tokencount, topk, toxicity, warc
from loomgraph.llm.text import small_batches

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_check(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stated queries: every row whose id is divisible by 100, against all rows.
    found = topk.top_k(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 100 == 0)
    return found.withColumn("distance", F.round("distance", 6))


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_warc": op2_warc,
        "op3_token_counts": op3_token_counts,
        "op4_decontamination": op4_decontamination,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_huffman_ids": op6_huffman_ids,
        "op7_toxicity": op7_toxicity,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_line_dedup": op10_line_dedup,
    }


OP2_SQL = "SELECT page_id, url, html FROM (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id) AS rn FROM pages) WHERE rn = 1"

OP5_SQL = """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM (
  SELECT vec_id, neighbor_id, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM (
    SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id))
WHERE rank <= 10
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS place FROM d WHERE len(lines) >= 3),
w AS (SELECT doc_id, place, lines[place + 1] AS a, lines[place + 2] AS b, lines[place + 3] AS c FROM l
      WHERE greatest(length(trim(lines[place + 1], ' ')), length(trim(lines[place + 2], ' ')), length(trim(lines[place + 3], ' '))) > 0),
later AS (SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS rn FROM w) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, place + i AS n FROM later, range(3) AS r(i)),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM line ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(string_split(documents.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(cnt.k, 0) AS INTEGER) AS n_removed
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_exact_top_k": OP5_SQL, "op10_line_dedup": OP10_SQL}
