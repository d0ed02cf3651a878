"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import hmm, jpeg, licenses, line_rules, mixing, oracles, packing, simhash, suffixes, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passages(_documents(spark, sf_dir)).drop("k")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("spans")


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(_documents(spark, sf_dir)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(tables.read(spark, f"{sf_dir}/pages.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_documents(spark, sf_dir))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_documents(spark, sf_dir)).drop("clean_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_license_scan, op4_jpeg, op5_toxicity, op6_simhash, op7_warc, op8_packing, op9_hmm, op10_line_rules)
}
ORACLES: dict[str, str] = {"op1_mixing": mixing.mix_sql(), "op2_suffix_dedup": oracles.PASSAGES, "op3_license_scan": oracles.LICENSES, "op7_warc": warc.SQL, "op10_line_rules": oracles.LINES}
