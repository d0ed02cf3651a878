"""Terminology: words that must be kept or translated, checked in pairs of source and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote, strip_code, whole_word


def violations(pairs: DataFrame, keep: list[str], translate: list[str], phrases: list[str], require: dict[str, list[str]] | None = None) -> DataFrame:
    """id, kind, word: phrase_keep (a phrase is lost), keep_lost, kept_english; with require also not_translated (no given form is there).

    Code areas are left out. Phrases, longest first, are taken out of both sides before single words are looked for.
    """
    df = pairs.select("id", strip_code(F.col("src")).alias("a"), strip_code(F.col("dst")).alias("b"))
    found = []
    for p in sorted(phrases, key=lambda s: (-len(s), s)):
        here, there = whole_word(F.col("a"), p), whole_word(F.col("b"), p)
        pattern = f"(?<![A-Za-z0-9_]){quote(p)}(?![A-Za-z0-9_])"
        df = df.withColumn(f"_{len(found)}", here & ~there).withColumn("b", F.when(here, F.regexp_replace("b", pattern, " ")).otherwise(F.col("b"))).withColumn("a", F.regexp_replace("a", pattern, " "))
        found.append(("phrase_keep", p, F.col(f"_{len(found)}")))
    a, b = F.col("a"), F.col("b")
    found += [("keep_lost", w, whole_word(a, w) & ~whole_word(b, w)) for w in keep]
    found += [("kept_english", w, whole_word(a, w) & whole_word(b, w)) for w in translate]
    for w, forms in (require or {}).items():
        some = F.lit(False)
        for f in forms:
            some = some | F.contains(b, F.lit(f))
        found.append(("not_translated", w, whole_word(a, w) & ~some))
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("word"))) for kind, w, c in found]))
    return df.select("id", F.explode(rows).alias("v")).select("id", "v.kind", "v.word")


def summary(found: DataFrame) -> DataFrame:
    """kind, word, n, the most frequent first."""
    return found.groupBy("kind", "word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "word")
