"""Versions: latest patches, version x platform matrices, and hashes that must match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import version_key


def pick(versions: DataFrame, n: int = 5) -> DataFrame:
    """version of the latest patch of each (major, minor), and of the last n patches of the newest minor."""
    parts = F.split("version", r"\.")
    v = versions.where(F.col("version").rlike(r"^\d+\.\d+\.\d+$")).select("version", *[parts[i].cast("int").alias(c) for i, c in enumerate(("major", "minor", "patch"))]).distinct()
    newest = v.agg(F.max(F.struct("major", "minor")).alias("m"))  # one row
    ranked = v.withColumn("place", F.row_number().over(W.partitionBy("major", "minor").orderBy(F.desc("patch")))).crossJoin(F.broadcast(newest))
    return ranked.where((F.col("place") == 1) | (F.col("place") <= n) & (F.struct("major", "minor") == F.col("m"))).select("version")


def matrix(versions: DataFrame, platforms: DataFrame) -> DataFrame:
    """Every version with every platform (a short list of each)."""
    return versions.crossJoin(platforms)


def gate(found: DataFrame, config: DataFrame) -> DataFrame:
    """found (version, platform, sha) with status ok, mismatch or unlisted, by config (version, platform, expected)."""
    both = found.join(config, ["version", "platform"], "left")
    return both.select("version", "platform", "sha", F.when(F.col("expected").isNull(), "unlisted").when(F.col("sha") == F.col("expected"), "ok").otherwise("mismatch").alias("status"))


def find_matches(config: DataFrame, shas: DataFrame) -> DataFrame:
    """sha, place, version, platform: all that have each sha, numbered from 1 in the order of versions by number, then platforms; one row without them where none has."""
    order = W.partitionBy("sha").orderBy(version_key(F.col("version")), "platform", "version")
    found = config.select(F.col("expected").alias("sha"), "version", "platform").withColumn("place", F.row_number().over(order))
    return shas.join(found, "sha", "left").select("sha", "place", "version", "platform")


def find_match(config: DataFrame, shas: DataFrame) -> DataFrame:
    """sha with the first (version by number, platform) that has it; null where none has."""
    return find_matches(config, shas).where("place IS NULL OR place = 1").drop("place")


def require_match(config: DataFrame, shas: DataFrame, force: bool = False) -> DataFrame:
    """find_match; a sha that nothing has is an error unless force is set."""
    found = find_match(config, shas)
    if force:
        return found
    known = F.when(F.col("version").isNull(), F.raise_error(F.concat(F.lit("not supported: "), F.col("sha"))).cast("string")).otherwise(F.col("version"))
    return found.withColumn("version", known)


def supported(config: DataFrame) -> DataFrame:
    """Distinct versions in their order by number."""
    return config.select("version").distinct().orderBy(version_key(F.col("version")), "version")


def chosen(text: str | None, run: list[str]) -> list[str]:
    """The versions that a comma-separated text names, sorted; those of the run if it names none."""
    named = {v.strip() for v in (text or "").split(",")} - {""}
    return sorted(named or set(run))
