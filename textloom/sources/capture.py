"""Captured requests: prompts in JSON bodies, and every description at any depth of a tool's schema, as variants in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import strip


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, line (its place in the file, from 1) and body of each line of JSON-lines files. Lines of large files are numbered by splits, in parallel."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row a split
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("file", "block").orderBy("i"))
    numbered = lines.join(sizes.select("file", "block", before.alias("before")), ["file", "block"])
    return numbered.select("file", (F.col("before") + own).alias("line"), F.get_json_object("value", "$.body").alias("body"))


#: Levels of a schema that are walked between two looks at whether any is left.
LEVELS = 6


def _children(nodes: DataFrame, variant: str) -> DataFrame:
    """nodes with pos, key (null in arrays) and value of each child of a variant; scalars have none."""
    return nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col(variant).outer()))


def _kind(variant: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.col(variant)), r"^\w+", 0)


def _string(variant: str, path: str = "$") -> Column:
    """A string at a path; null for other types."""
    found = F.try_variant_get(F.col(variant), path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(F.col(variant), path, "string"))


def descriptions(nodes: DataFrame) -> DataFrame:
    """label, text of each non-blank string named description below each node (label, node: a variant); a property of that name is walked.

    Rows are nodes still to be walked, which turn into their children level by level, and texts found, which stay. So all
    levels are one pass over the input; another pass follows only where a node is deeper than LEVELS.
    """
    rows, tvf = nodes.select("label", F.lit(None).cast("string").alias("text"), "node"), nodes.sparkSession.tvf
    walked = F.col("node").isNotNull()
    label = F.when(~walked, F.col("label")).when(F.col("key").isNull(), F.format_string("%s[%d]", "label", "pos")).otherwise(F.concat_ws(".", "label", "key"))
    found = F.when(F.col("key") == "description", _string("value"))
    text = F.when(~walked, F.col("text")).when(strip(found) != "", found)
    while True:
        for _ in range(LEVELS):
            child = rows.lateralJoin(tvf.variant_explode_outer(F.col("node").outer()))
            rows = child.select(label.alias("label"), text.alias("text"), F.when(walked & _kind("value").isin("OBJECT", "ARRAY"), F.col("value")).alias("node")).where("text IS NOT NULL OR node IS NOT NULL")
        if not rows.where("node IS NOT NULL").take(1):
            return rows.select("label", "text")


def segments(records: DataFrame) -> DataFrame:
    """label, text of each prompt in records (line: its place in the file, from 1; body: JSON text).

    rec{line}.sys[{i}] for non-empty system texts, rec{line}.tool[{i}:{name}].description and ...input_schema for a tool's
    non-blank descriptions; bodies that are missing or no JSON objects, tools that are no objects and schemas that are
    none are passed over.
    """
    bodies = records.select("line", F.try_parse_json("body").alias("body"))
    part = lambda name: bodies.select("line", F.try_variant_get("body", f"$.{name}", "variant").alias("part")).where(_kind("part") == "ARRAY")
    system = _children(part("system"), "part").select(F.format_string("rec%d.sys[%d]", "line", "pos").alias("label"), _string("value", "$.text").alias("text")).where("text <> ''")
    tools = _children(part("tools"), "part").where(_kind("value") == "OBJECT")
    name = F.coalesce(F.try_variant_get("value", "$.name", "string"), F.lit("?"))
    tools = tools.select(F.format_string("rec%d.tool[%d:%s]", "line", "pos", name).alias("label"), "value")
    own = tools.select(F.concat("label", F.lit(".description")).alias("label"), _string("value", "$.description").alias("text")).where(strip(F.col("text")) != "")
    schemas = tools.select(F.concat("label", F.lit(".input_schema")).alias("label"), F.try_variant_get("value", "$.input_schema", "variant").alias("node")).where(_kind("node") == "OBJECT")
    return system.unionByName(own).unionByName(descriptions(schemas))


def without_external(found: DataFrame, mark: str = "mcp__") -> DataFrame:
    return found.where(~F.contains("label", F.lit(mark)))
