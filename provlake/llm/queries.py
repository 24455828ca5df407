"""One query for each operator of this subpackage, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, centroids, chat, decontaminate, html_text, quality_gam, quality_rules, secrets, shards, simhash, trie_bpe, warc
from .common import ship, table
from .oracle import ORACLE

#: Place and pattern of the rank file; a cluster may name a folder that all its nodes have.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("adaptive_failed")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def dictionary(spark: SparkSession) -> DataFrame:
    """The letter-only pieces of three or more letters in the rank file, in lower case: at most its 50,256 rows."""
    with open(RANKS, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]).strip().lower() for line in f if line.strip()}
    return spark.createDataFrame([(w.decode(),) for w in sorted(pieces) if len(w) >= 3 and w.isalpha() and w.isascii()], "word string")


@functools.lru_cache(maxsize=1)
def secret_detector(spark: SparkSession) -> secrets.Detector:
    """Trained once for each session: its findings are made by rule, so every training gives the same detector."""
    return secrets.train(secrets.synthetic_findings(spark), dictionary(spark))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secret_detector(spark))
    return found.select("doc_id", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), "places", "score", "is_secret")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(chat.probe(spark)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.correspond(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, PIECES)


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


QUERIES = (op1_quality_rules, op2_quality_gam, op3_simhash, op4_sharding, op5_bpe, op6_secret_scan, op7_chat, op8_warc, op9_decontamination, op10_html_text, op11_centroids, op12_alignment, op13_trie_bpe)


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipping(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
