"""Steps whose memory or time must not grow faster than the input: what they hand on, join and evaluate."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from textloom.functions import literals as L
from textloom.functions import scoring
from textloom.operators import groups, matching
from textloom.plans import queries as P

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_hits_are_handed_on_in_bounded_batches(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "aaaa"), (2, "b"), (3, None), (4, "aa b")], "id int, text string")
    keys = spark.createDataFrame([(1, "aa"), (2, "b")], "key_id int, key string")
    spark.conf.set(BATCH, "10000")
    monkeypatch.setattr(matching, "HITS_AT_ONCE", 2)
    found = sorted(map(tuple, matching.occurrences(texts, keys).collect()))
    assert found == [(1, 1, 0, 2), (1, 1, 1, 2), (1, 1, 2, 2), (2, 2, 0, 1), (4, 1, 0, 2), (4, 2, 3, 1)]
    assert int(spark.conf.get(BATCH)) <= 1000


def plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


@needs_tables
def test_hits_are_counted_before_they_are_joined(spark):
    joined = plan(P.QUERIES["size_plan"](spark, DATA)).split("Join")[1]
    assert "Aggregate [key_id" in joined


def test_round_trip_holds_one_form_at_a_time(spark):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    text = 'a\n"é$`\t\x01😀\\'
    forms = ('a\\n\\"é$`\\t\\x01😀\\\\', 'a\\n"é$`\\t\\x01😀\\\\', 'a\n"é\\$\\`\\t\\x01😀\\\\')
    assert L.round_trip(text) == (*map(md5, forms), True)
    assert L.round_trip("a\r\nb")[3] is False and L.round_trip(None) == (None, None, None, None)
    assert L.decode("你\\ud83d\\ude00\\ud83dA\\\\u0041".encode()) == "你😀\\ud83dA\\u0041"
    spark.conf.set(BATCH, "10000")
    L.literals(spark.createDataFrame([(1, "x")], "id int, source string"), "id", "source")
    assert int(spark.conf.get(BATCH)) <= 1000


def test_islands_leave_texts_behind(spark):
    lits = L.literals(spark.createDataFrame([(1, "t=`a${v}你好`")], "id int, source string"), "id", "source")
    p = plan(groups.mixed_templates(lits, "id").select("id", "template_group", "mixed"))
    assert p.rindex("Window") < p.index("RLIKE")  # patterns are looked for below the sorts


@needs_tables
def test_scores_of_work_items_are_computed_once(spark):
    made = P.QUERIES["work_groups"](spark, DATA)
    assert "markdown" not in plan(made) and "RLIKE" not in plan(made)  # what is numbered was written before


def test_legacy_counts_are_evaluated_once(spark):
    p = plan(spark.createDataFrame([("The word.",)], "text string").select(scoring.legacy_score(F.col("text")).alias("s")))
    assert p.count("[a-zA-Z]+") == 1 and p.count("(?<![a-z])") == 1


@needs_tables
def test_legacy_coverage_scores_once(spark):
    p = plan(P.QUERIES["legacy_coverage"](spark, DATA))
    assert p.count("(?<![a-z])") == 1


def test_legacy_score_of_odd_texts(spark):
    texts = [None, "", "1 2", "# The IMPORTANT.", "K the", "é" * 50 + " the of to", "a." * 60, "You are the one. " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r["s"] for r in df.orderBy("i").select(scoring.legacy_score(F.col("text")).alias("s")).collect()] == [0, 0, 0, 10, 2, 5, 11, 13]


@needs_tables
def test_hits_meet_a_broadcast_of_the_keys(spark):
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin [key_id" in plan(P.QUERIES["literal_audit"](spark, DATA), "sparkPlan")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


@needs_tables
def test_counters_scan_sources_once(spark):
    assert plan(P.QUERIES["extract_counters"](spark, DATA)).count("MapInArrow") == 2  # literals, and keys in texts
