"""The corpus pipeline: five operators over documents, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared
folder and reads them again for the next, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import bpe, decontaminate, quality_rules, queries, secrets, simhash
from provlake.llm.common import materialize, ship, table

#: SimHash and the ranks' ids aren't expressible in DuckDB SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go."""
    ship(spark)
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    ship(spark)
    return secrets.mask(docs, queries.secret_detector(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether these decode to the text."""
    ship(spark)
    rows = bpe.decode(bpe.encode(docs, queries.RANKS, queries.PATTERN), queries.RANKS, queries.PATTERN)
    same = F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
