"""The capture log as a stream: residual words of new records, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import residual


def read(spark: SparkSession, folder: str) -> DataFrame:
    """body of each appended JSON line."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", "ts double, path string, body string").alias("r")).select("r.*").where(F.col("body").isNotNull())


def residual_words(records: DataFrame, exact: list[str], regex: list[str], literal_exact: list[str]) -> DataFrame:
    """ts and the words left over of each system text."""
    body = F.from_json("body", "system array<struct<type:string,text:string>>")
    texts = records.select("ts", F.explode(body["system"]).alias("s")).select("ts", F.col("s.text").alias("text"))
    return texts.select("ts", residual(F.col("text"), exact, regex, literal_exact).alias("words")).where(F.size("words") > 0)


def start(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
