"""Dictionaries, white lists, glossaries and version lists from JSON files; reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _maps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, key, value (as JSON text) of the entries of JSON objects, one object a file."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.select("file", F.explode("m").alias("key", "value"))


def entries(spark: SparkSession, path: str, platform: str | None = None, check: bool = True) -> DataFrame:
    """file, src, dst, allow_reorder of path/*.json and, for a platform, path/<platform>/*.json; keys that begin with _ are notes.

    A value is a string or {dst, allow_reorder}. With check, a src in two entries is an error.
    """
    found = _maps(spark, f"{path}/*.json")
    if platform:
        found = found.unionByName(_maps(spark, f"{path}/{platform}/*.json"))
    found = found.where(~F.startswith("key", F.lit("_")))
    whole = F.from_json("value", "dst string, allow_reorder boolean")
    nested = F.col("value").rlike(r'(?s)^\s*\{.*"dst"\s*:') & whole["dst"].isNotNull()
    out = found.select("file", F.col("key").alias("src"), F.when(nested, whole["dst"]).otherwise(F.col("value")).alias("dst"), F.when(nested, F.coalesce(whole["allow_reorder"], F.lit(False))).otherwise(F.lit(False)).alias("allow_reorder"))
    if check and (twice := out.groupBy("src").count().where("count > 1").select("src").take(1)):
        raise ValueError(f"two entries have the source {twice[0][0]!r}")
    return out


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """kind (exact, regex, literal_exact) and text; literal_exact must be stripped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "exact array<string>, regex array<string>, literal_exact array<string>").alias("w"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"w.{k}").alias("texts")) for k in ("exact", "regex", "literal_exact")])
    out = raw.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.texts").alias("text")).where(~F.startswith("text", F.lit("_comment")))
    if bad := out.where((F.col("kind") == "literal_exact") & F.col("text").rlike(r"(?U)^\s|\s$")).take(1):
        raise ValueError(f"literal_exact must be stripped: {bad[0]['text']!r}")
    return out


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, keep, phrase, forms of {"terms": {term: {"zh": [...]} or {"keep": true}, "phrase": true}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "terms map<string,struct<zh:array<string>,keep:boolean,phrase:boolean>>").alias("g"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return raw.select(F.explode("g.terms").alias("term", "t")).select("term", no("t.keep").alias("keep"), no("t.phrase").alias("phrase"), F.coalesce("t.zh", F.array().cast("array<string>")).alias("forms"))


def terms(found: DataFrame) -> dict[str, list]:
    """keep, translate (words), phrases (longest first) and require (forms by word) of a glossary, which is a short list: arguments of operators.glossary.violations."""
    rows = sorted(found.collect(), key=lambda r: r["term"])
    words = [r for r in rows if not r["phrase"]]
    return {
        "keep": [r["term"] for r in words if r["keep"]], "translate": [r["term"] for r in words if not r["keep"]],
        "phrases": sorted((r["term"] for r in rows if r["phrase"]), key=lambda t: (-len(t), t)), "require": {r["term"]: list(r["forms"]) for r in words if r["forms"]},
    }


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """file, src, dst of path/*.json whose values are strings; keys that begin with _ are notes."""
    raw = spark.read.text(f"{path}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.parse_json("value").alias("v"))
    each = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(~F.startswith("key", F.lit("_")) & (F.schema_of_variant("value") == "STRING"))
    return each.select("file", F.col("key").alias("src"), F.variant_get("value", "$", "string").alias("dst"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, platform, expected of {"versions": {version: {platform: sha256}}}; an error if the file or that key is missing."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "versions map<string,map<string,string>>").alias("c"))
    raw = raw.select(F.when(F.col("c.versions").isNull(), F.raise_error(F.lit("no versions")).cast("map<string,map<string,string>>")).otherwise(F.col("c.versions")).alias("v"))
    return raw.select(F.explode("v").alias("version", "p")).select("version", F.explode("p").alias("platform", "expected"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a report's candidates."""
    return spark.read.json(path, multiLine=True).select(F.explode("candidates").alias("c")).select("c.*")
