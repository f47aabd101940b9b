"""From raw documents to token ids: rules, toxicity, near copies, the mix, byte-level BPE.

Each stage is one of the operators over all documents that the stage before kept; a stage's result is written as Parquet
in the shared folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import drop, give_back, table, temporary, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the learned decision list reject."""
    from stratum.llm.quality_rules import passing

    return passing(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier marks as toxic."""
    from stratum.llm.toxicity import fit, keep_documents

    return keep_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    from stratum.llm.minhash import deduplicate

    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix says: a document taken twice has two rows."""
    from stratum.llm.mixing import mix_documents

    return mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mix holds, and whether they decode to its text."""
    from stratum.llm.byte_bpe import encode_decode

    out = encode_decode(docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


def _compact(stage):
    """The stage, after executors have given back the heap that the stage before took: its workers need the room."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _compact(stage)) for name, stage in [("quality rules", quality_rules), ("toxicity", toxicity), ("near duplicates", near_duplicates), ("mixing", mixing), ("byte-level BPE", byte_bpe)]]

#: A learned list and a trained network are not SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, results = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        # a stage's own tables go when its result is written, and so does the result before it
        with temporary(spark, results):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            results.append(docs.stratum_path)
        if len(results) > 1:
            drop(spark, results[-2])
    return docs
