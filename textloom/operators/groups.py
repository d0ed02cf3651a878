"""Islands of neighbouring literals: arrays, templates, and templates that mix languages. Input: functions.literals.literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as R
from ..functions.text import strip


def islands(df: DataFrame, joined: Column, by: str, name: str) -> DataFrame:
    """df with name: the number of each row's island in its source; joined: whether a row belongs to the one before.

    What looks at texts and gaps is computed before rows are sent and sorted, so that these stay behind where nobody asks for them.
    """
    order = W.partitionBy(by).orderBy("start_off")
    broken = df.withColumn("_joined", F.coalesce(joined, F.lit(False))).withColumn("_new", F.when(F.lag("start_off").over(order).isNotNull() & F.col("_joined"), 0).otherwise(1))
    return broken.withColumn(name, F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_joined", "_new")


def array_groups(lits: DataFrame, by: str) -> DataFrame:
    """Neighbours join if only white space, commas and slashes stand between them, a comma among these. Adds array_group, group_size."""
    joined = F.col("gap").rlike(r"^[ \t\n\r,/]+$") & F.contains("gap", F.lit(","))
    return islands(lits, joined, by, "array_group").withColumn("group_size", F.count("*").over(W.partitionBy(by, "array_group")))


def template_groups(lits: DataFrame, by: str) -> DataFrame:
    """Fragments of one template: neighbours with only an interpolation without a back-quote between. Adds template_group."""
    before = F.lag("lit_type").over(W.partitionBy(by).orderBy("start_off"))
    lits = lits.withColumn("_alone", F.col("gap").rlike(r"(?s)^\$\{.*\}$") & ~F.contains("gap", F.lit("`")))
    lits = lits.withColumn("_pair", (F.col("lit_type") == "tmpl_frag") & (before == "tmpl_frag"))
    return islands(lits, F.col("_pair") & F.col("_alone"), by, "template_group").drop("_alone", "_pair")


def mixed_templates(lits: DataFrame, by: str, least: int = 8) -> DataFrame:
    """Adds mixed: a template of two fragments or more holds Han script, this one does not, and it has words and least characters."""
    group = W.partitionBy(by, "template_group")
    own = ~F.col("_han") & (F.char_length(F.col("text")) >= least) & (F.char_length(strip(F.col("text"))) >= least) & F.col("text").rlike("[A-Za-z']{2,}")
    lits = lits.withColumn("_han", F.col("text").rlike(R.HAN)).withColumn("_own", own)
    has = F.max(F.col("_han").cast("int")).over(group) == 1
    return template_groups(lits, by).withColumn("mixed", F.coalesce((F.count("*").over(group) >= 2) & has & F.col("_own"), F.lit(False))).drop("_han", "_own")
