"""Coverage: status of each text, counts, histograms, length statistics and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as R
from ..functions import scoring
from ..functions import text as text_rules
from . import catalog, matching


def status(exact: Column, partial: Column, text: Column, whitelisted: Column) -> Column:
    """exact before partial before Han script before white list; else untranslated."""
    return F.when(exact, "exact").when(partial, "partial").when(text.rlike(R.HAN), "han").when(whitelisted, "whitelisted").otherwise("untranslated")


def length_stats(df: DataFrame, n: Column) -> DataFrame:
    """min, median (interpolated), p95 (the value at place floor(0.95 * count) in order, from 0), max: exact, without sorting in one task.

    Lengths repeat, so the order statistic comes from counts by length: one small row for each distinct length.
    """
    by = df.select(n.cast("long").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(W.orderBy("n"))).withColumn("total", F.sum("c").over(W.partitionBy()))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    return upto.agg(
        F.min("n").alias("min_len"),
        ((at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2.0).alias("median_len"),
        at(F.floor(F.col("total") * 0.95)).alias("p95_len"), F.max("n").alias("max_len"),
    )


def length_buckets(df: DataFrame, n: Column) -> DataFrame:
    return df.agg(F.count_if(n < 60).alias("short"), F.count_if((n >= 60) & (n < 200)).alias("middle"), F.count_if(n >= 200).alias("long"))


def summary(df: DataFrame) -> DataFrame:
    """total, translated, whitelisted, untranslated and their percentages; df has the booleans translated and whitelisted. An empty table is an error."""
    left = ~F.col("translated") & ~F.col("whitelisted")
    out = df.agg(F.count("*").alias("total"), F.count_if("translated").alias("translated"), F.count_if(~F.col("translated") & F.col("whitelisted")).alias("whitelisted"), F.count_if(left).alias("untranslated"))
    share = lambda c: F.when(F.col("total") == 0, F.raise_error(F.lit("nothing to measure")).cast("double")).otherwise(F.round(100 * F.col(c) / F.col("total"), 4))
    return out.select("*", share("translated").alias("translated_pct"), share("untranslated").alias("untranslated_pct"))


def candidates(lits: DataFrame, covered: DataFrame, white: Column, min_score: int = 3, **lists) -> DataFrame:
    """Literals that may be prose, with score, class and whether they are covered; skipped ones have class skip.

    lits: id, start_off, end_off, lit_type, text, group_size, mixed (operators.groups); covered: id, start_off, exact,
    partial for literals that a dictionary covers; white: whether text is whitelisted. A text that is no UTF-8 has class null.
    """
    score = scoring.score_text(F.col("text"), **lists) + F.when(F.col("group_size") >= 3, 1).otherwise(0)
    tags = F.concat(scoring.evidence(F.col("text"), **lists), F.when(F.col("group_size") >= 3, F.array(F.lit("array_group"))).otherwise(F.array().cast("array<string>")))
    both = lits.join(covered, ["id", "start_off"], "left").withColumns({"score": score, "evidence": F.when(F.col("mixed"), F.array_append(tags, F.lit("mixed_template"))).otherwise(tags)})
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.select(
        "id", F.col("start_off").alias("offset"), F.col("end_off").alias("end"), (F.col("end_off") - F.col("start_off")).alias("len"), F.col("lit_type").alias("type"), "group_size", "mixed",
        F.when(F.col("text").isNotNull(), scoring.classify(F.col("score"), min_score=min_score)).alias("class"), "score", "evidence", "text",
        status(yes("exact"), yes("partial"), F.col("text"), white).alias("status"),
    ).withColumns({"translated": F.col("status").isin("exact", "partial", "han"), "whitelisted": F.col("status") == "whitelisted"})


def covered(lits: DataFrame, keys: DataFrame, variables: dict[str, list[str]] | None = None, least: int = 20) -> DataFrame:
    """id, start_off, exact, partial of literals (id, start_off, text) that a dictionary's keys (src) cover.

    exact: the text is a key, a key with the k-th variables of its sentinels, or a piece of 8 characters or more between
    a key's placeholders. partial: a key of least characters or more stands in the text, as it is or with first variables.
    """
    keys = keys.select("src").distinct()
    whole = keys
    if variables:
        known = keys.sparkSession.createDataFrame([(n, v) for n, v in variables.items()], "name string, vars array<string>")
        made = catalog.expand_sentinels(keys.select(F.col("src").alias("entry"), "src", F.col("src").alias("dst")), known, strict=False)
        whole = keys.union(made.select("src"))
    exact = whole.union(whole.select(F.explode(text_rules.fragments(F.col("src"))))).toDF("text").distinct().withColumn("exact", F.lit(True))
    long_ = keys.union(keys.select(catalog.first_instances(F.col("src"), variables or {}))).distinct().select("src", F.col("src").alias("key"))
    part = matching.contained(lits.select(F.struct("id", "start_off").alias("at"), "text"), long_, least).select("id.id", "id.start_off").distinct().withColumn("partial", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    both = lits.join(exact, "text", "left").join(part, ["id", "start_off"], "left")
    return both.select("id", "start_off", yes("exact"), yes("partial")).where("exact OR partial")


def diff_report(found: DataFrame, min_score: int = 2, k: int = 50) -> dict[str, DataFrame]:
    """Parts of a report on candidates() from a score: totals, scores (of what nothing covers) and top."""
    rows = found.where(F.col("class").isNotNull() & (F.col("score") >= min_score))
    left = rows.where(~F.col("translated") & ~F.col("whitelisted"))
    return {
        "totals": summary(rows).withColumn("min_score", F.lit(min_score)), "scores": left.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")),
        "top": top(left.select("id", "offset", "len", "score", "class", "evidence", "text"), F.desc("score"), F.asc("id"), F.asc("offset"), k=k),
    }


def capture_report(found: DataFrame, exact: list[str], regex: list[str], literal_exact: list[str], show: int = 20, external: str = "mcp__") -> dict[str, DataFrame]:
    """Parts of a report on captured segments (label, text): totals, by_label and tokens.

    Segments of external tools are counted and left out, registration lines are counted and taken out, and what the white
    list does not cover is told by label and in all.
    """
    own = found.where(~F.contains("label", F.lit(external)))
    rest, lines = text_rules.strip_dynamic_lines(F.col("text"))
    words = own.select("label", lines.alias("lines"), text_rules.residual(rest, exact, regex, literal_exact).alias("words"))
    by, totals = residual_report(words, show)
    outside = found.agg(F.count("*").alias("total_segments"), F.count_if(F.contains("label", F.lit(external))).alias("external_segments"))
    stripped = words.agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("stripped_lines"))
    return {"totals": outside.crossJoin(stripped).crossJoin(totals.drop("segments")), "by_label": by, "tokens": words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))}  # one row each


def counters(found: DataFrame) -> DataFrame:
    """One row of ten counts over candidates()."""
    is_ = lambda c: F.col("class") == c
    some, left = F.col("class").isin("prompt", "weak"), F.col("status") == "untranslated"
    return found.agg(
        F.count("*").alias("total_literals"), F.count_if(F.col("text").isNotNull()).alias("decoded_ok"), F.count_if(is_("prompt")).alias("scored_prompt"),
        F.count_if(is_("weak")).alias("scored_weak"), F.count_if(is_("skip")).alias("scored_skip"), F.count_if(some & F.col("translated")).alias("translated"),
        F.count_if(some & F.col("whitelisted")).alias("whitelisted"), F.count_if(is_("prompt") & left).alias("untranslated_prompt"),
        F.count_if(is_("weak") & left).alias("untranslated_weak"), F.count_if(some & left & F.col("mixed")).alias("mixed_lang_template_residual"),
    )


def untranslated(found: DataFrame, class_: str | None = None, min_score: int | None = None) -> DataFrame:
    """Candidates that nothing covers, of a class or from a score."""
    rows = found.where(F.col("class").isin("prompt", "weak") & ~F.col("translated") & ~F.col("whitelisted"))
    rows = rows if class_ is None else rows.where(F.col("class") == class_)
    return rows if min_score is None else rows.where(F.col("score") >= min_score)


def sample(df: DataFrame, *order: Column, k: int) -> DataFrame:
    """The first k rows in an order: a bounded sample for a report (40 mixed fragments, the 5 shortest stale texts, 10 conflicts, ...)."""
    return df.orderBy(*order).limit(k)


def residual_report(found: DataFrame, show: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a row a label: its distinct residual words, sorted, and the first show of them; one row of totals). found: label, words (array)."""
    rows = found.where(F.size("words") > 0)
    by = rows.groupBy("label").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))  # labels name one text each
    each = found.select("label", F.explode_outer("words").alias("word"))
    totals = each.agg(F.countDistinct("label").alias("segments"), F.countDistinct(F.when(F.col("word").isNotNull(), F.col("label"))).alias("segments_with_residual"), F.count("word").alias("words"), F.countDistinct("word").alias("distinct_words"))
    return by.select("label", "words", F.slice("words", 1, show).alias("shown")), totals


def legacy_coverage(texts: DataFrame, min_len: int = 30, min_score: int = 5) -> DataFrame:
    """One row: han_count and han_bytes (texts with Han script), residual (long and prose-like without), skipped_short, skipped_score. texts: text."""
    n, han = F.octet_length("text"), F.col("text").rlike(R.HAN_LEGACY)
    rows = texts.where(F.col("text").isNotNull()).select(n.alias("n"), (n >= min_len).alias("long"), han.alias("han"), "text")
    left = F.col("long") & ~F.col("han")
    # a score is computed once, and only where it counts
    rows = rows.select("n", "long", "han", F.when(left, scoring.legacy_score(F.col("text")) >= min_score).alias("enough"))
    return rows.agg(
        F.count_if(F.col("long") & F.col("han")).alias("han_count"), F.coalesce(F.sum(F.when(F.col("long") & F.col("han"), F.col("n"))), F.lit(0)).cast("long").alias("han_bytes"),
        F.count_if(left & F.col("enough")).alias("residual"), F.count_if(~F.col("long")).alias("skipped_short"), F.count_if(left & ~F.col("enough")).alias("skipped_score"),
    )


def type_counts(lits: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, lit_type, n, bytes and share of the source (percent) of literals; sizes: id, size in bytes."""
    by = lits.groupBy("id", "lit_type").agg(F.count("*").alias("n"), F.sum(F.col("end_off") - F.col("start_off")).alias("bytes"))
    return by.join(sizes, "id").select("id", "lit_type", "n", "bytes", F.round(100 * F.col("bytes") / F.col("size"), 4).alias("share"))


def top(df: DataFrame, *order: Column, k: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(k)
