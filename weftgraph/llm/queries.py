"""The registered queries of the training-data operators: each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, lm_score, pii, quality, repair, toxicity
from .bpe import encode_digests
from .common import read_table
from .simhash import near_duplicates
from .token_counts import token_counts


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", chat.TRAP), (-7, 1, "assistant", chat.TRAP)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(read_table(spark, sf_dir, "conversations").select(own.columns).unionByName(own))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_rules, op3_personal_data, op4_token_id_output, op5_token_counts, op6_lm_scoring, op7_benchmark_decontamination, op8_chat_formatting, op9_toxicity, op10_bpe_encode_decode)}

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality.SQL, "op8_chat_formatting": chat.SQL}
