"""Registered queries of the training-data operators: each applies its
operator with production parameters to its whole table and returns the
contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, cascade, huffman, imatch, lines, lm, mixing, runs, secrets, simhash, template, toxicity, whitening
from vigil.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm.score(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quality_report(read_table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.report(read_table(spark, sf_dir, "documents"))


def op8_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(read_table(spark, sf_dir, "pages"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.scratch_path(spark)
    huffman.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return huffman.read_tokens(spark, path, digest=True)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(read_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_toxicity, op4_lm_score, op5_secrets, op6_quality_rules, op7_imatch,
                                   op8_template, op9_token_file, op10_bpe, op11_runs, op12_line_dedup, op13_whitening)}

ORACLE: dict[str, str] = {"op6_quality_rules": cascade.oracle_sql(), "op7_imatch": imatch.oracle_sql(), "op12_line_dedup": lines.oracle_sql()}
