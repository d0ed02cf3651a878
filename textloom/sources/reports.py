"""Sinks: reports, candidates as JSON, CSV and text, work lists by part, white lists, versions, prompts and modules. All are written by tasks, in parallel."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import version_key
from . import container

LEVELS = {"OK": logging.INFO, "WARN": logging.WARNING, "FAIL": logging.ERROR, "INFO": logging.INFO}
_log = logging.getLogger("textloom")


def write_candidates(df: DataFrame, path: str, text: str = "text") -> None:
    """path/json whole, path/csv with previews of 80 characters on one line, path/txt the texts alone."""
    df.write.mode("overwrite").json(f"{path}/json")
    short = F.replace(F.replace(F.substring(text, 1, 80), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    df.withColumn(text, short).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(f"{path}/txt")


def write_extract(candidates: DataFrame, summary: DataFrame, path: str) -> None:
    """path/candidates, the best first, and path/summary, one row."""
    candidates.orderBy(F.desc("score"), "offset").write.mode("overwrite").json(f"{path}/candidates")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_report(path: str, **parts: DataFrame) -> None:
    """Each part of a report (totals, rows by source, conflicts, misses, ...) as JSON lines in a folder of its name."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def group_names(n: int) -> list[str]:
    """Names of n work groups: letters a to j as far as they reach, else numbers from 1."""
    return list("abcdefghij"[:n]) if n <= 10 else [str(i + 1) for i in range(n)]


def write_groups(df: DataFrame, path: str, n: int, part: str = "part", todo: str | None = None) -> None:
    """A folder for each of n parts (numbered from 0): group=1 and on, or, with todo, pairs of a source and that mark in group=a and on."""
    names = group_names(n) if todo is not None else [str(i + 1) for i in range(n)]
    rows = df.withColumn("group", F.element_at(F.array(*map(F.lit, names)), (F.col(part) + 1).cast("int"))).drop(part)
    rows = rows if todo is None else rows.select("group", "src", F.lit(todo).alias("dst"))
    rows.write.mode("overwrite").partitionBy("group").json(path)


def write_versions(config: DataFrame, path: str) -> None:
    """version, platform, expected in the order of versions by number, then platforms; a short list, in one file."""
    config.orderBy(version_key(F.col("version")), "version", "platform").coalesce(1).write.mode("overwrite").json(path)


def write_prompts(texts: DataFrame, path: str, label: Column) -> DataFrame:
    """path/texts: a row a prompt in a folder of its name, NN_label.en; path/manifest: id, name, size, has_placeholder, file. Returns the manifest.

    texts: place (from 1, the largest first), text.
    """
    named = texts.select((F.col("place") - 1).alias("id"), label.alias("name"), "text").withColumn("file", F.format_string("%02d_%s.en", "id", "name"))
    named.select("file", "text").write.mode("overwrite").partitionBy("file").text(f"{path}/texts")
    manifest = named.select("id", "name", F.octet_length("text").cast("long").alias("size"), F.contains("text", F.lit("${")).alias("has_placeholder"), "file")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_modules(files: DataFrame, trailer: bytes, path: str) -> None:
    """Contents, source maps (.map) and bytecode (.jsc) of files' modules that have any, as rows of path/data: path, file, bytes; path/metadata: the tables."""
    table = container.modules(files, trailer).join(files.select("path", "content"), "path")
    safe = F.regexp_replace(F.regexp_replace("name", "^/+", ""), "/", "_")
    safe = F.when(safe == "", F.format_string("module_%d", "i")).otherwise(safe)
    kinds = [F.struct(F.concat(safe, F.lit(suffix)).alias("file"), F.col(f"{f}_off").alias("off"), F.col(f"{f}_len").alias("len")) for f, suffix in (("contents", ""), ("sourcemap", ".map"), ("bytecode", ".jsc"))]
    parts = table.select("path", "content", F.explode(F.array(*kinds)).alias("k")).where((F.col("k.len") > 0) | ~F.col("k.file").rlike(r"\.(map|jsc)$"))
    cut = parts.select("path", "k.file", F.substring("content", F.col("k.off").cast("int") + 1, F.col("k.len").cast("int")).alias("bytes"))
    cut.write.mode("overwrite").parquet(f"{path}/data")
    table.drop("content").write.mode("overwrite").json(f"{path}/metadata")


def write_glossary(found: DataFrame, path: str) -> None:
    """A row a violated term: term (kind:word) and hits (file, head of the source); the most violated first."""
    rows = found.groupBy(F.concat_ws(":", "kind", "word").alias("term")).agg(F.collect_list(F.struct("file", F.substring("src", 1, 55).alias("head"))).alias("hits"))
    rows.orderBy(F.desc(F.size("hits")), "term").write.mode("overwrite").json(path)


def log(tag: str, message: str) -> None:
    """A line on standard error with the tag OK, WARN, FAIL or INFO."""
    if tag not in LEVELS:
        raise ValueError(f"no such tag: {tag}")
    _log.log(LEVELS[tag], "[%s] %s", tag, message)


def write_whitelist(texts: DataFrame, path: str) -> None:
    """Distinct texts, the shorter first, then by code point."""
    texts.select("text").distinct().orderBy(F.char_length("text"), "text").write.mode("overwrite").json(path)
