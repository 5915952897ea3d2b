"""The corpus pipeline: five stages from ``documents`` to token identifiers.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in
the shared folder and rereads as the next stage's docs. All but the last keep the columns of
``documents``, whatever they are besides ``doc_id`` and ``text``:

1. toxicity: documents with a significant toxic passage go; the model is fitted on ``labels``;
2. line dedup: later occurrences of three-line windows, and of windows of sentences within and across lines,
   are cut from the texts, and documents of which nothing is left go;
3. SimHash near-dedup: of each group of near copies the document of the least id stays;
4. decontamination: documents in which a test item of ``benchmark`` is found go;
5. BPE: each document's token identifiers, which are decoded again to see that they give the text.

Null and empty texts pass stages 1 to 4 and have null and no tokens; see the operators for the
rest. SQL expresses neither the fit nor the fingerprints, so ORACLE_SQL is None and the tests hold
``run`` against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, decontaminate, linededup, simhash, toxicity
from loomgraph.llm.queries import VOCABULARY, table
from loomgraph.llm.text import small_batches
from loomgraph.plans import scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return linededup.apply_to(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_and_check(docs, VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("byte-level BPE", tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of the documents that all stages keep."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch.within(spark) as kept:
            docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            kept.append(docs)
        if before is not None:  # what the stage before wrote has been read
            scratch.drop(before)
        before = docs
    return docs
