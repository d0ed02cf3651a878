"""The dictionary: duplicate sources, sentinels and their variables, and the work list."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as R
from ..functions.text import strip
from ..sources.tables import cut


def duplicate_sources(entries: DataFrame, src: str = "src") -> DataFrame:
    """src, n for sources with several entries."""
    return entries.groupBy(src).agg(F.count("*").alias("n")).where("n > 1")


_VARIABLE = r"\$\{[A-Za-z0-9_.$]+\}"


def resolve_sentinels(buffer: str, declared: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    """Variables of each sentinel; declared: (name, before, after), a name as often as it has instances. Names without any are absent.

    A declaration looks at one place only: the next occurrence of its anchor (before, or after where before is empty)
    at or behind its name's cursor. If a variable and the other anchor stand there, that is the instance and the cursor
    goes behind it; else the cursor goes one place on, and the declaration yields nothing.
    """
    out: dict[str, list[str]] = {}
    at: dict[str, int] = {}
    whole = {(b, a): re.compile(f"({_VARIABLE}){re.escape(a)}" if b else f"({_VARIABLE})$", re.ASCII) for _, b, a in declared}
    for name, before, after in declared:
        place = buffer.find(before or after, at.get(name, 0))
        if place < 0:
            continue
        # with a before-anchor the rest is read on from its end; without one the variable ends where the anchor begins
        found = whole[before, after].match(buffer, place + len(before)) if before else whole[before, after].search(buffer[max(0, buffer.rfind("${", 0, place)) : place])
        if found:
            out.setdefault(name, []).append(found[1])
        at[name] = place + 1 if not found else found.end() if before else place + len(after)
    return out


def expand_sentinels(entries: DataFrame, variables: DataFrame, strict: bool = True) -> DataFrame:
    """entries (entry, src, dst and more) once for each instance of the sentinels in src; variables: (name, vars).

    An entry without a declared sentinel stays as it is; one with a sentinel that has no instance is left out. The k-th
    instances of several sentinels belong together; if their numbers differ that is an error with strict, else the
    smallest counts. Equal pairs of an entry appear once.
    """
    known = variables.agg(F.map_from_entries(F.collect_list(F.struct("name", "vars"))).alias("_known"))  # a short list: one row
    names = F.array_intersect(F.array_distinct(F.regexp_extract_all("src", F.lit(r"\$\{([\w.$]+)\}"), F.lit(1))), F.map_keys("_known"))
    rows = entries.crossJoin(F.broadcast(known)).withColumn("_names", names)
    sizes = F.transform("_names", lambda n: F.size(F.element_at("_known", n)))
    least = F.array_min(sizes)
    if strict:
        differ = F.concat(F.lit("numbers of instances differ: "), F.to_json("_names"))
        least = F.when((least > 0) & (least != F.array_max(sizes)), F.raise_error(differ).cast("int")).otherwise(least)
    some = rows.where((F.size("_names") > 0)).withColumn("_n", least).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    fill = lambda c: F.aggregate("_names", F.col(c), lambda t, n: F.replace(t, F.concat(F.lit("${"), n, F.lit("}")), F.element_at(F.element_at("_known", n), F.col("_k"))))
    made = some.withColumn("_src", fill("src")).withColumn("dst", fill("dst")).withColumn("src", F.col("_src")).select(*entries.columns).dropDuplicates(["entry", "src", "dst"])
    return rows.where(F.size("_names") == 0).select(*entries.columns).unionByName(made)


def first_instances(text: Column, variables: dict[str, list[str]]) -> Column:
    """text with each sentinel replaced by its first variable."""
    for name, found in variables.items():
        if found:
            text = F.replace(text, F.lit("${" + name + "}"), F.lit(found[0]))
    return text


def without_sentinels(items: DataFrame, src: str = "src") -> DataFrame:
    """items whose source has no sentinel."""
    return items.where(~F.col(src).rlike(R.SENTINEL))


def prompts(texts: DataFrame, beginning: str = "You are ", least: int = 100) -> DataFrame:
    """Texts of least bytes or more that begin so."""
    return texts.where(F.startswith("text", F.lit(beginning)) & (F.octet_length("text") >= least))


def work_items(reports: DataFrame) -> DataFrame:
    """What is to be translated of reports of several versions: text (stripped) once, with the attributes first seen and the versions in input order.

    reports: ord (input order), version, text, class, score, len, evidence, offset, translated, whitelisted. Only prompts count
    that are neither translated nor whitelisted nor blank.
    """
    left = reports.where((F.col("class") == "prompt") & ~F.col("translated") & ~F.col("whitelisted")).withColumn("src", strip(F.col("text"))).where("src <> ''")
    seen = F.min_by(F.struct("len", "score", "class", "evidence", F.col("offset").alias("offset_example")), "ord")
    versions = F.transform(F.array_sort(F.collect_list(F.struct("ord", "version"))), lambda x: x["version"])
    return left.groupBy("src").agg(seen.alias("seen"), versions.alias("from_versions")).select("src", "seen.*", "from_versions")


def work_groups(items: DataFrame, n: int) -> DataFrame:
    """items with part: dealt in turn to n parts in the order of score, then length, the larger first, then text.

    Items are read three times for it, so they are written once to the shared folder first.
    """
    lead = -(F.col("score") * F.lit(float(1 << 32)) + F.col("len"))
    return round_robin(cut(items), n, lead, "src")


def merge_versions(items: DataFrame) -> DataFrame:
    """src once, with the attributes first seen and the versions in input order. items: src, score, version, ord."""
    return items.groupBy("src").agg(F.min_by("score", "ord").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "version"))), lambda x: x["version"]).alias("versions"))


def numbered(items: DataFrame, lead: Column, *ties: str, slots: int = 256) -> DataFrame:
    """items with place: their number, from 1, in the order of a number lead and of the columns ties, which is total.

    Items are dealt to slots by bounds on lead, a slot is ordered in one task, and what stands in the slots before is
    added; bounds only steer how even slots are, so an approximation of them does. A null lead comes first.
    """
    items = items.withColumn("_lead", lead.cast("double"))
    bounds = items.agg(F.percentile_approx("_lead", [i / slots for i in range(1, slots)]).alias("b")).first()["b"] or []
    items = items.withColumn("_slot", F.aggregate(F.array(*[F.lit(x) for x in sorted(set(bounds))]).cast("array<double>"), F.lit(0), lambda n, x: n + F.coalesce(x < F.col("_lead"), F.lit(False)).cast("int")))
    sizes = items.groupBy("_slot").agg(F.count("*").alias("_n"))  # at most as many rows as there are slots
    before = sizes.select("_slot", F.coalesce(F.sum("_n").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_slot").orderBy("_lead", *ties))
    return items.join(F.broadcast(before), "_slot").withColumn("place", own + F.col("_before")).drop("_lead", "_slot", "_before")


def round_robin(items: DataFrame, n: int, lead: Column, *ties: str) -> DataFrame:
    """items with part: place in order modulo n."""
    return numbered(items, lead, *ties).withColumn("part", ((F.col("place") - 1) % n).cast("long")).drop("place")


def sentinels_in(text: Column, declared: list[str]) -> Column:
    """Declared sentinel names in text, each once, in the order they are first seen."""
    return F.array_intersect(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([\w.$]+)\}"), F.lit(1))), F.array(*[F.lit(n) for n in declared]))


def resolve(buffers: DataFrame, declared: list[tuple[str, str, str]]) -> DataFrame:
    """id, name, k, var of the k-th variable (from 1) that resolve_sentinels finds for each name in each buffer (id, buffer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, name, k, v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for name, found in resolve_sentinels(t or "", declared).items() for k, v in enumerate(found, 1)]
            kinds = (b.schema.field(0).type, pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["id", "name", "k", "var"])

    return buffers.select("id", "buffer").mapInArrow(run, f"id {buffers.schema['id'].dataType.simpleString()}, name string, k long, var string")


def merge_whitelist(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct stripped texts of both, blank ones left out."""
    return a.union(b).select(F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''").distinct()
