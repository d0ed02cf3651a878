"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target of words. Its documents first get whole copies: floor(target / words of the source) of each. What
is left of the target is drawn without repetition and with unequal probabilities: a document's inclusion probability is
proportional to the binary digits of its size (so to the logarithm of its length), with a factor such that the expected
words of the draw are those that are left. Documents whose probability reaches 1 are certain and get a whole copy. The
others are ranked by random odds u / (1 - u), u from a digest of the id, divided by inclusion odds p / (1 - p), and taken in
this order while they fit the words left (fixed size, in words); CLOSING closing documents of each size class at most fill
the remaining gap.

The order is found without sorting a source in one task: words are summed by (source, slice of the rank), the slice where
the target is reached is found from those sums, likewise a slice of that slice, and only the rows of this one are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the rank, and of each slice.
SLICES = 1 << 10
CLOSING = 4
#: More sources than these are numbered and summed up over the cluster, not in one task.
SOURCES = 100_000
#: Rows of sources, or of their size classes (64 each at most), that are broadcast: 100 bytes each.
BROADCAST_ROWS = 500_000
CAP = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an id's MD5."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def digits(size: Column) -> Column:
    """Binary digits of a size: a document's size class, and its weight in the draw."""
    return F.length(F.bin(size)).cast("long")


def _before(df: DataFrame, many: bool, order: list[Column], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of its column over the rows that stand before in an order, which is total; many: over the cluster."""
    if many:
        df = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
        parts = df.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])  # a row for each partition
        run = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        df = df.join(F.broadcast(parts.select("_part", *[F.sum(f"_{n}").over(run).alias(f"_{n}") for n in sums])), "_part")
    run = (W.partitionBy("_part") if many else W.partitionBy()).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(c).over(run), F.lit(0)) + (F.coalesce(F.col(f"_{n}"), F.lit(0)) if many else 0) for n, c in sums.items()}
    return df.withColumns(own).drop("_part", *[f"_{n}" for n in sums])


def targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3 by code point order (null last) share all words; none gets over cap times its own.

    With sources in the order of size / weight, those that the cap holds are a prefix; the rest share by weight what these leave.
    """
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    # one row a source from here on
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    many = sums.count() > SOURCES
    ranked = _before(sums, many, by_name, place=F.lit(1)).select("source", "source_size", (F.col("place") % 3 + 1).alias("weight"))
    ranked = _before(ranked, many, [F.col("source_size") / F.col("weight"), *by_name], size_before=F.col("source_size"), weight_before=F.col("weight"))
    ranked = cut(ranked)
    words, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left_words, left_weight = F.lit(words) - cap * F.col("size_before"), F.lit(weights) - F.col("weight_before")
    ranked = ranked.withColumn("open", cap * F.col("source_size") * left_weight > left_words * F.col("weight"))
    first = ranked.where("open").agg(F.min(F.struct(F.col("source_size") / F.col("weight"), *by_name, left_words.alias("w"), left_weight.alias("g"))).alias("m")).first()["m"]
    share = F.col("weight") * F.lit(first["w"]) / F.lit(first["g"]) if first else F.lit(0.0)
    return ranked.select("source", "source_size", F.when(F.col("open"), share).otherwise((cap * F.col("source_size")).cast("double")).alias("target"))


def _same_source(a: str = "source", b: str = "s_source") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _attach(rows: DataFrame, per: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with what per says of their source (and size class, where per has one); few: per may be broadcast."""
    on = _same_source()
    if "s_digits" in per.columns:
        on = on & (F.col("digits") == F.col("s_digits"))
    return rows.join(F.broadcast(per) if few else per, on, how).drop("s_source", "s_digits")


def chances(per: DataFrame, sizes: DataFrame, few: bool = False) -> DataFrame:
    """s_source, s_digits, p (inclusion probability, 1 for certain documents), left (words to be drawn beside the certain ones).

    per: source, budget; sizes: source, digits, words (a row for each size class of each source).
    """
    both = _attach(sizes, per.select(F.col("source").alias("s_source"), "budget"), few)
    down = W.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(W.unboundedPreceding, -1)
    up = W.partitionBy("source").orderBy("digits").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("above", F.coalesce(F.sum("words").over(down), F.lit(0))).withColumn("factor", (F.col("budget") - F.col("above")) / F.sum(F.col("digits") * F.col("words")).over(up))
    # classes above the first whose probability stays below 1 are certain
    first = F.max(F.when(F.col("factor") * F.col("digits") < 1, F.struct("digits", "factor", "above"))).over(W.partitionBy("source"))
    both = both.withColumn("first", first)
    p = F.when(F.col("digits") <= F.col("first.digits"), F.col("first.factor") * F.col("digits")).otherwise(1.0)
    left = F.col("budget") - F.coalesce(F.col("first.above"), F.sum("words").over(W.partitionBy("source")))
    return both.select(F.col("source").alias("s_source"), F.col("digits").alias("s_digits"), p.alias("p"), left.alias("left"))


def _edge(rows: DataFrame, slice_: Column, before: Column) -> DataFrame:
    """For each source the slice in which the words of the rows pass left: s_source, edge, before (words of the slices before)."""
    sums = rows.groupBy("source", "left", slice_.alias("slice")).agg(F.sum("size").alias("words"), F.max(before).alias("start"))
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))  # SLICES rows a source at most
    return cut(sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left"))).select(F.col("source").alias("s_source"), F.col("slice").alias("edge"), "before"))


def plan(sized: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame, bool]:
    """(a row a source: s_source, source_size, target, copies, edge, last, extra; a row a size class: s_source, s_digits, p, left; whether both may be broadcast).

    A document is drawn if it is certain, its slice is before edge, its key in that slice is not after last, or it is one of extra.
    sized: source, size, u, doc (id as text), digits.
    """
    per = targets(sized, cap)
    per = per.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    per = cut(per.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")))
    some, few = sized.where("size > 0"), 64 * per.count() <= BROADCAST_ROWS
    classes = cut(chances(per, some.groupBy("source", "digits").agg(F.sum("size").alias("words")), few))
    # documents larger than what is to be drawn can't be part of it
    can = _attach(some.select("source", "size", "u", "doc", "digits"), classes, few).where(_open()).withColumn("q", _rank()).withColumn("slice", _slice())
    coarse = _edge(can, F.shiftright("slice", SLICES.bit_length() - 1), F.lit(0))
    inner = _attach(can, coarse, few).where(F.shiftright("slice", SLICES.bit_length() - 1) == F.col("edge")).drop("edge")
    fine = _edge(inner, F.col("slice"), F.col("before"))
    inner = _attach(can, fine, few).where("slice = edge")
    upto = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("q", "doc", "size"))
    fits = inner.withColumn("upto", upto).where("upto <= left").groupBy("source").agg(F.max(F.struct("q", "doc", "size")).alias("last"), F.max("upto").alias("upto"))
    whole = can.groupBy("source").agg(F.sum("size").alias("all"), F.first("left").alias("left"))
    ends = whole.withColumnRenamed("source", "s_source")
    ends = ends.join(fine, ends["s_source"].eqNullSafe(fine["s_source"]), "left").select(ends["s_source"], "all", "left", "edge", "before")
    ends = ends.join(fits, _same_source(), "left").select("s_source", F.coalesce("edge", F.lit(SLICES * SLICES)).alias("edge"), "last", (F.col("left") - F.coalesce("upto", "before", "all")).alias("gap"))
    ends = cut(ends)
    # closing documents: the smallest in each of CLOSING parts of each size class that are not drawn, the larger first, as they fit the gap
    rest = _attach(can, ends, few).where(~_in_prefix() & (F.col("size") <= F.col("gap")))
    best = rest.groupBy("source", "gap", "digits", F.floor(F.col("u") * CLOSING)).agg(F.min(F.struct("size", "q", "doc")).alias("b"))
    each = F.sort_array(F.collect_list("b"), asc=False)
    none = F.struct(F.col("gap"), F.array().cast("array<struct<q:double,doc:string,size:bigint>>").alias("extra"))
    take = lambda a, b: F.when(b["size"] <= a["gap"], F.struct((a["gap"] - b["size"]).alias("gap"), F.concat(a["extra"], F.array(F.struct(b["q"].alias("q"), b["doc"].alias("doc"), b["size"].alias("size")))).alias("extra"))).otherwise(a)
    extra = best.groupBy("source", "gap").agg(each.alias("b")).select("source", F.aggregate("b", none, take)["extra"].alias("extra"))
    ends = ends.join(extra, _same_source(), "left").select("s_source", "edge", "last", "extra")
    per = per.join(ends, _same_source(), "left").select(F.col("source").alias("s_source"), "source_size", "target", "copies", F.coalesce("edge", F.lit(0)).alias("edge"), "last", F.coalesce("extra", F.array().cast("array<struct<q:double,doc:string,size:bigint>>")).alias("extra"))
    return cut(per), classes, few


def _open() -> Column:
    return (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") <= F.col("left"))


def _rank() -> Column:
    """Random odds by inclusion odds."""
    return F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))


def _slice() -> Column:
    return F.floor(F.col("q") / (1 + F.col("q")) * (SLICES * SLICES)).cast("long")


def _in_prefix() -> Column:
    return (F.col("slice") < F.col("edge")) | F.coalesce((F.col("slice") == F.col("edge")) & (F.struct("q", "doc", "size") <= F.col("last")), F.lit(False))


def _copies(rows: DataFrame, per: DataFrame, classes: DataFrame, few: bool) -> DataFrame:
    """rows (source, size, u, doc, digits and more) with times: how often the mix takes each, and the columns of their source."""
    rows = _attach(_attach(rows, classes, few, "left"), per, few).withColumn("q", F.when(_open(), _rank())).withColumn("slice", _slice())
    drawn = F.coalesce(F.col("p") >= 1, F.lit(False)) | F.col("q").isNotNull() & (_in_prefix() | F.array_contains("extra", F.struct("q", "doc", "size")))
    return rows.withColumn("times", F.col("copies") + F.coalesce(drawn, F.lit(False)).cast("long"))


def _sized(rows: DataFrame, source: str, text: str, doc_id: str) -> DataFrame:
    doc = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return rows.withColumns({"source": F.col(source), "size": n_words(F.col(text)), "u": uniform(doc), "doc": doc}).withColumn("digits", digits(F.col("size")))


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    A null or wordless text has size 0 and is never taken; a very long one is counted whole and drawn only if it fits; a
    null source is a source; a null id is an id like any other. Rows that repeat an id and a size in a source stand or fall
    together (in the prefix their words count each; as a closing document only once). Equal ranks are ordered by id and
    size. An empty table gives an empty result. Other columns, whatever their names, are not looked at.
    """
    sized = cut(_sized(docs.select("doc_id", "source", "text"), "source", "text", "doc_id").drop("text"))
    return _copies(sized, *plan(sized, cap)).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def take(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them (up to cap times), with docs' own columns, whatever their names.

    Texts are read twice and never shuffled. A document without words adds no words to any source and is kept once.
    """
    rows = _sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "row.source", "row.text", "row.doc_id")
    taken = _copies(rows, *plan(cut(rows.drop("row")), cap))
    times = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("times"))
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_")).select("row.*")


def mix_sql(cap: int = CAP) -> str:
    """The same result in SQL, for mix()."""
    key = "struct_pack(q := q, doc := doc, size := size)"
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
         coalesce(CAST(doc_id AS VARCHAR), '') AS doc
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM sums),
lefts AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () - {cap} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM ranked WINDOW o AS (ORDER BY source_size / weight, source IS NULL, encode(source))),
opens AS (SELECT *, {cap} * source_size * left_weight > left_words * weight AS is_open FROM lefts),
firsts AS (SELECT left_words AS fw, left_weight AS fg FROM opens WHERE is_open ORDER BY place LIMIT 1),
tgt AS (
  SELECT source AS s, source_size, CASE WHEN is_open THEN CAST(weight * fw AS DOUBLE) / CAST(fg AS DOUBLE) ELSE CAST({cap} * source_size AS DOUBLE) END AS target
  FROM opens LEFT JOIN firsts ON true),
per AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM tgt),
per2 AS (SELECT *, target - copies * source_size AS budget FROM per),
cls AS (SELECT source, length(bin(size)) AS d, CAST(sum(size) AS BIGINT) AS words FROM sized WHERE size > 0 GROUP BY 1, 2),
run AS (
  SELECT c.*, budget, coalesce(sum(words) OVER (PARTITION BY source ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(words * d) OVER (PARTITION BY source ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below, sum(words) OVER (PARTITION BY source) AS total
  FROM cls c JOIN per2 ON source IS NOT DISTINCT FROM s),
fac AS (SELECT *, (budget - CAST(above AS DOUBLE)) / CAST(below AS DOUBLE) AS f FROM run),
one AS (SELECT source AS os, max(d) AS od, arg_max(f, d) AS of, CAST(arg_max(above, d) AS DOUBLE) AS oabove FROM fac WHERE f * d < 1 GROUP BY source),
chance AS (
  SELECT source AS cs, d AS cd, CASE WHEN d <= od THEN of * d ELSE 1.0::DOUBLE END AS p, budget - coalesce(oabove, CAST(total AS DOUBLE)) AS left_words
  FROM fac LEFT JOIN one ON source IS NOT DISTINCT FROM os),
q AS (
  SELECT sized.*, p, left_words, CASE WHEN p > 0 AND p < 1 AND size <= left_words THEN u / (1 - u) / (p / (1 - p)) END AS q
  FROM sized LEFT JOIN chance ON source IS NOT DISTINCT FROM cs AND length(bin(size)) = cd AND size > 0),
drawn AS (
  SELECT *, coalesce(q IS NOT NULL AND sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc, size) <= left_words, false) AS prefix FROM q),
gaps AS (SELECT source AS gs, any_value(left_words) - coalesce(sum(size) FILTER (prefix), 0) AS gap FROM drawn WHERE q IS NOT NULL GROUP BY source),
best AS (
  SELECT source AS bs, min(struct_pack(size := size, q := q, doc := doc)) AS b
  FROM drawn JOIN gaps ON source IS NOT DISTINCT FROM gs WHERE q IS NOT NULL AND NOT prefix AND size <= gap GROUP BY source, length(bin(size)), floor(u * {CLOSING})),
turns AS (SELECT *, row_number() OVER (PARTITION BY bs ORDER BY b DESC) AS i FROM best),
fold(fs, i, gap, doc, size, q) AS (
  SELECT gs, 0::BIGINT, CAST(gap AS DOUBLE), NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE FROM gaps
  UNION ALL
  SELECT fs, turns.i, CASE WHEN b.size <= fold.gap THEN fold.gap - b.size ELSE fold.gap END, CASE WHEN b.size <= fold.gap THEN b.doc END,
         CASE WHEN b.size <= fold.gap THEN b.size END, CASE WHEN b.size <= fold.gap THEN b.q END
  FROM fold JOIN turns ON bs IS NOT DISTINCT FROM fs AND turns.i = fold.i + 1),
extra AS (SELECT DISTINCT fs, struct_pack(q := q, doc := doc, size := size) AS k FROM fold WHERE size IS NOT NULL)
SELECT doc_id, size, source_size, target,
       (copies + CAST(coalesce(p >= 1, false) OR prefix OR EXISTS (SELECT 1 FROM extra WHERE fs IS NOT DISTINCT FROM source AND k = {key}) AS BIGINT)) * size AS taken
FROM drawn JOIN per2 ON source IS NOT DISTINCT FROM s"""
