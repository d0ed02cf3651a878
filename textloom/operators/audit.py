"""Risks of a dictionary: what its replacements would hit, before anything is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions.text import placeholders, placeholders_safe, preview
from . import matching


def risks(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of totals. entries: key_id, src, dst, allow_reorder; hits: key_id, inside (whether the hit lies in a literal).

    risk_a: sources that occur twice or more; risk_b: hits outside literals of sources that have none inside; missed:
    sources with hits on both sides; risk_c: always 0, as inconsistent placeholders are risk_e first; risk_e: sources
    whose placeholders differ from their translation's.
    """
    per = hits.groupBy("key_id").agg(F.count("*").alias("n"), F.count_if("inside").alias("within"), F.count_if(~F.col("inside")).alias("outside"))
    some = F.size(placeholders(F.col("src"))) > 0
    bad = some & ~placeholders_safe(F.col("src"), F.col("dst"), F.col("allow_reorder"))
    all_ = entries.join(per, "key_id", "left").na.fill(0, ["n", "within", "outside"]).withColumn("some", some).withColumn("bad", bad)
    plain = ~F.col("some")
    return all_.agg(
        F.count("*").alias("total"), F.count_if(F.col("n") >= 2).alias("risk_a"),
        F.coalesce(F.sum(F.when(plain & (F.col("within") == 0), F.col("outside"))), F.lit(0)).cast("long").alias("risk_b"),
        F.count_if(plain & (F.col("within") > 0) & (F.col("outside") > 0)).alias("missed"),
        F.lit(0).cast("long").alias("risk_c"), F.count_if("bad").alias("risk_e"),
    )


def by_source(sources: DataFrame, lits: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row an entry, one row of totals): what raw occurrences of sources' keys would hit, in bytes, by the spans of literals.

    Entry: key_id, src_preview, src_len (bytes), allow_reorder, occurrences, in_literal, cross_literal_safe, code_region,
    placeholder_violation, risk_a, true_risk_b, scanner_fn (hits in code of a key that also stands in literals). Totals: as
    risks(), with total_hits, risk_d (pairs of hits that overlap in part, where of two with one start the shorter comes first)
    and high_risk. An entry with other placeholders than its translation has no hits but risk_e. Hits meet a broadcast of the
    keys' numbers and flags, as a join by shuffle would send all hits of a frequent key to one task.
    """
    bytes_ = matching.as_bytes
    keys = entries.select("key_id", bytes_(F.col("src")).alias("key"))
    found = matching.occurrences(sources.toDF("id", "source").select("id", bytes_(F.col("source"))), keys)
    has = F.size(placeholders(F.col("src"))) > 0
    marked = entries.withColumns({"marked": has, "bad": has & ~placeholders_safe(F.col("src"), F.col("dst"), F.col("allow_reorder"))})
    hits = matching.in_spans(found, lits.select("id", F.col("start_off").alias("start"), F.col("end_off").alias("end"))).join(F.broadcast(marked.select("key_id", "marked", "bad")), "key_id")
    n = lambda c: F.count_if(~F.col("bad") & c)
    per = hits.groupBy("key_id").agg(F.count("*").alias("occurrences"), n(F.col("inside")).alias("in_literal"), n(~F.col("inside") & F.col("marked")).alias("cross_literal_safe"), n(~F.col("inside") & ~F.col("marked")).alias("code_region"))
    rows = marked.join(per, "key_id", "left").na.fill(0, ["occurrences", "in_literal", "cross_literal_safe", "code_region"]).select(
        "key_id", preview(F.col("src")).alias("src_preview"), F.octet_length("src").alias("src_len"), "allow_reorder", "occurrences", "in_literal", "cross_literal_safe", "code_region",
        F.col("bad").alias("placeholder_violation"), (F.col("occurrences") >= 2).alias("risk_a"),
        ((F.col("code_region") > 0) & (F.col("in_literal") == 0)).alias("true_risk_b"), ((F.col("code_region") > 0) & (F.col("in_literal") > 0)).alias("scanner_fn"),
    )
    kept = hits.where(~F.col("bad") & (F.col("inside") | F.col("marked"))).select("id", "key_id", "pos", "len")
    risk_d = conflicts(kept).agg(F.count("*").alias("risk_d"))
    totals = rows.agg(
        F.count("*").alias("total_src"), F.coalesce(F.sum(F.col("in_literal") + F.col("cross_literal_safe")), F.lit(0)).cast("long").alias("total_hits"), F.count_if("risk_a").alias("risk_a"),
        F.coalesce(F.sum(F.when(F.col("true_risk_b"), F.col("code_region"))), F.lit(0)).cast("long").alias("risk_b"), F.lit(0).cast("long").alias("risk_c"), F.count_if("placeholder_violation").alias("risk_e"),
    )
    totals = totals.crossJoin(risk_d)  # one row each
    return rows, totals.withColumn("high_risk", F.col("risk_b") + F.col("risk_c") + F.col("risk_d") + F.col("risk_e"))


def replacement_report(sources: DataFrame, lits: DataFrame, entries: DataFrame, context: int = 30) -> dict[str, DataFrame]:
    """Parts of a report on matching.replacements(): totals, missed, skipped, violations and conflicts.

    totals: hits, misses (entries that hit nothing), skips (occurrences in code, with context bytes around them),
    placeholder_violations, nested (hits within others, which are not replaced), conflicts and delta, the bytes by which
    sources grow. Arguments as for matching.replacements().
    """
    hits = matching.replacements(sources, lits, entries)
    replaced = matching.overlaps(hits.where("kind <> 'code'"))
    has = F.size(placeholders(F.col("src"))) > 0
    bad = entries.where(has & ~placeholders_safe(F.col("src"), F.col("dst"), F.col("allow_reorder")))
    missed = entries.join(bad.select("key_id"), "key_id", "left_anti").join(hits.select("key_id").distinct(), "key_id", "left_anti").select("key_id", "src")
    around = F.substring(matching.as_bytes(F.col("source")), F.greatest(F.lit(1), F.col("pos") + 1 - context).cast("int"), (F.col("len") + F.least(F.lit(context), F.col("pos")) + context).cast("int"))
    skipped = hits.where("kind = 'code'").join(sources.toDF("id", "source"), "id").select("id", "key_id", "pos", "lit_type", F.encode(around, "ISO-8859-1").cast("string").alias("context"))
    per = replaced.where("NOT nested").groupBy("key_id", "lit_type").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
    written = per.join(entries.select("key_id", "dst"), "key_id").select((F.col("n") * F.octet_length(L.encoded(F.col("dst"), F.col("lit_type"))) - F.col("len")).alias("delta"))
    pairs = conflicts(replaced.select("id", "key_id", "pos", "len")).where("pos1 < pos2")
    one = [
        replaced.agg(F.count("*").alias("hits"), F.count_if("nested").alias("nested")), missed.agg(F.count("*").alias("misses")), skipped.agg(F.count("*").alias("skips")),
        bad.agg(F.count("*").alias("placeholder_violations")), pairs.agg(F.count("*").alias("conflicts")), written.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("long").alias("delta")),
    ]
    totals = one[0]
    for x in one[1:]:
        totals = totals.crossJoin(x)  # one row each
    violations = bad.select("key_id", "src", placeholders(F.col("src")).alias("src_placeholders"), placeholders(F.col("dst")).alias("dst_placeholders"), "allow_reorder")
    return {"totals": totals, "missed": missed, "skipped": skipped, "violations": violations, "conflicts": pairs}


def conflicts(hits: DataFrame, by: str = "id", block: int = 4096) -> DataFrame:
    """Pairs of hits of a source of which one begins inside the other and ends after it (of equal starts the shorter is the other).

    A join on blocks of places: a hit is sent to the block in which it begins and, as the earlier one of a pair, to all it covers.
    """
    a = hits.select(by, F.col("key_id").alias("key1"), F.col("pos").alias("pos1"), F.col("len").alias("len1"), F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor((F.col("pos") + F.col("len")) / block))).alias("block"))
    b = hits.select(by, F.col("key_id").alias("key2"), F.col("pos").alias("pos2"), F.col("len").alias("len2"), F.floor(F.col("pos") / block).alias("block"))
    end1, end2 = F.col("pos1") + F.col("len1"), F.col("pos2") + F.col("len2")
    return a.join(b, [by, "block"]).where((F.col("pos1") <= F.col("pos2")) & (F.col("pos2") < end1) & (end2 > end1)).drop("block")
