"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, linededup, lmscore, mixing, periodic, quality, secrets, sharding, sketch, tokenids, trie, urlfilter
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_mixing(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.op2_lm_score(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op3_line_dedup(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op4_url_filters(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_sharding(table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.op6_token_ids(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op7_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8_secret_scans(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op9_jaccard_join(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_quality_rules(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op11_conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.op12_fingerprints(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op13_periodic_runs(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_ablation(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_lm_score, op3_line_dedup, op4_url_filters, op5_sharding, op6_token_ids, op7_decontamination, op8_secret_scans, op9_jaccard_join, op10_quality_rules, op11_conversation_trie, op12_fingerprints, op13_periodic_runs, quality_ablation)}
ORACLES = {
    "op1_mixing": mixing.op1_oracle(),
    "op3_line_dedup": linededup.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
    "quality_ablation": quality.ABLATION_ORACLE,
}
