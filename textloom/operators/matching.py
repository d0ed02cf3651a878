"""Matching a dictionary against texts: equal texts, occurrences, containment in spans, overlaps, what was never found."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import literals as L
from ..functions.text import placeholders, placeholders_safe
from ..sources.tables import narrow_batches

#: Keys in one automaton; a larger dictionary is searched in several, one after the other, so what is broadcast stays bounded.
KEYS_AT_ONCE = 50_000
#: Hits that a Python worker holds before it hands them on.
HITS_AT_ONCE = 50_000


def exact(texts: DataFrame, keys: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """Rows of texts that equal a key; Spark picks the join from the sizes."""
    return texts.join(keys, texts[text] == keys[key])


def _search(texts: DataFrame, keys: list[tuple[object, str]], key_type: str, first_only: bool) -> DataFrame:
    narrow_batches(texts.sparkSession)
    shared, most = texts.sparkSession.sparkContext.broadcast(keys), HITS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, (_, s) in enumerate(shared.value):
            machine.add_word(s, (*machine.get(s, ()), k))
        machine.make_automaton()
        ids = [k for k, _ in shared.value]
        size = [len(s) for _, s in shared.value]

        def hits(ids: pa.Array) -> pa.RecordBatch:
            columns = [ids.take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip((key, pos, length), kinds[1:], strict=True)]]
            for c in (row, key, pos, length):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["id", "key_id", "pos", "len"])

        row, key, pos, length = [], [], [], []
        for b in batches:
            for i, t in enumerate(b.column(1)):
                seen = set()
                for end, found in machine.iter(t.as_py() or "") if len(machine) else ():
                    for k in found:
                        if first_only and k in seen:
                            continue
                        seen.add(k)
                        row.append(i)
                        key.append(ids[k])
                        pos.append(end - size[k] + 1)
                        length.append(size[k])
                    if len(row) >= most:
                        yield hits(b.column(0))
            if row:
                yield hits(b.column(0))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"id {texts.schema.fields[0].dataType.simpleString()}, key_id {key_type}, pos long, len long"
    kinds = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema).types
    return texts.mapInArrow(run, schema)


def occurrences(texts: DataFrame, keys: DataFrame, first_only: bool = False) -> DataFrame:
    """id, key_id, pos, len of every occurrence (overlapping ones too) of every key in every text; positions are characters from 0.

    texts: (id, text); keys: (key_id, key), empty keys left out. Linear in the texts, however many keys; with first_only
    a key counts once a text. Keys are searched KEYS_AT_ONCE at a time.
    """
    kind = keys.schema.fields[0].dataType.simpleString()
    keys = keys.toDF("key_id", "key").where(F.length("key") > 0)
    out, part = None, []
    rows = keys.toLocalIterator()
    for r in rows:
        part.append((r["key_id"], r["key"]))
        if len(part) == KEYS_AT_ONCE:
            found = _search(texts, part, kind, first_only)
            out, part = found if out is None else out.unionByName(found), []
    if part or out is None:
        found = _search(texts, part, kind, first_only)
        out = found if out is None else out.unionByName(found)
    return out


def contained(texts: DataFrame, keys: DataFrame, least: int = 20) -> DataFrame:
    """id, key_id: keys of least characters or more that stand in a text."""
    keys = keys.toDF("key_id", "key")
    return occurrences(texts, keys.where(F.char_length("key") >= least), first_only=True).select("id", "key_id").distinct()


def in_spans(hits: DataFrame, spans: DataFrame, by: str = "id") -> DataFrame:
    """hits with the span (start, end) of the greatest start not after pos, and whether the hit lies in it whole.

    Spans are disjoint. Hits and spans are sorted together once, so there is no join of ranges.
    """
    a = hits.select("*", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("s_start"), F.lit(None).cast("long").alias("s_end"), F.col("pos").alias("at"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in hits.schema.fields if f.name != by]
    b = spans.select(by, *none, F.lit(0).alias("kind"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("start").alias("at"))
    both = a.select(b.columns).unionByName(b)
    order = W.partitionBy(by).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    span = F.last(F.when(F.col("kind") == 0, F.struct("s_start", "s_end")), ignorenulls=True).over(order)
    both = both.withColumn("span", span).where("kind = 1")
    inside = F.coalesce(F.col("pos") + F.col("len") <= F.col("span.s_end"), F.lit(False))
    return both.select(*hits.columns, F.col("span.s_start").alias("start"), F.col("span.s_end").alias("end"), inside.alias("inside"))


def overlaps(hits: DataFrame, by: str = "id", audit_compat: bool = False) -> DataFrame:
    """hits with nested (inside an earlier, longer one) and conflict (it begins inside an earlier one and ends after it).

    Order: by pos, the longer first; with audit_compat by pos, the shorter first, which makes conflicts of equal starts.
    """
    end = F.col("pos") + F.col("len")
    order = W.partitionBy(by).orderBy("pos", "len" if audit_compat else F.desc("len"), "key_id")
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    return hits.select("*", F.coalesce(end <= reach, F.lit(False)).alias("nested"), F.coalesce((F.col("pos") < reach) & (end > reach), F.lit(False)).alias("conflict"))


def as_bytes(source: Column) -> Column:
    """A text whose characters are the source's UTF-8 bytes, so that places in it are places in bytes."""
    return F.decode(source.cast("binary"), "ISO-8859-1")


def form_occurrences(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """id, key_id, pos, len, lit_type of every occurrence, in bytes, of every form under which a key may stand in a source: raw, or escaped as in a literal.

    sources: (id, source); keys: (key_id, key). A dictionary is small beside the sources; its forms go through the driver, and
    their numbers are broadcast, as a join by shuffle would send all hits of a frequent form to one task.
    """
    found = keys.toDF("key_id", "key").select("key_id", F.explode(L.forms(F.col("key"))).alias("f")).select("key_id", "f.form", "f.lit_type")
    rows = [(i, r["key_id"], r["form"], r["lit_type"]) for i, r in enumerate(found.toLocalIterator())]
    kind = keys.schema.fields[0].dataType.simpleString()
    table = sources.sparkSession.createDataFrame(rows, f"form_id long, key_id {kind}, form string, lit_type string")
    hits = occurrences(sources.toDF("id", "source").select("id", as_bytes(F.col("source"))), table.select("form_id", as_bytes(F.col("form")).alias("form")))
    return hits.withColumnRenamed("key_id", "form_id").join(F.broadcast(table.drop("form")), "form_id").select("id", "key_id", "pos", "len", "lit_type")


def replacements(sources: DataFrame, lits: DataFrame, entries: DataFrame) -> DataFrame:
    """id, key_id, pos, len, lit_type, kind of everything that entries would replace in sources, in bytes.

    kind: whole (a literal whose text is the key), inside (an occurrence of a form of the key within a literal), crossing
    (one across literals whose placeholders are safe) or code (any other, which is not replaced). Occurrences are looked
    for only where no literal of the source is the key. Entries with placeholders that differ from their translation's
    replace nothing. sources: (id, source); lits: id, start_off, end_off, lit_type, text; entries: key_id, src, dst, allow_reorder.
    """
    has = F.size(placeholders(F.col("src"))) > 0
    safe = entries.where(~has | placeholders_safe(F.col("src"), F.col("dst"), F.col("allow_reorder"))).select("key_id", "src", has.alias("marked"))
    whole = lits.join(safe.select("key_id", F.col("src").alias("text")), "text").select("id", "key_id", F.col("start_off").alias("pos"), (F.col("end_off") - F.col("start_off")).alias("len"), "lit_type", F.lit("whole").alias("kind"))
    rest = form_occurrences(sources, safe.select("key_id", "src")).join(whole.select("id", "key_id").distinct(), ["id", "key_id"], "left_anti")
    placed = in_spans(rest, lits.select("id", F.col("start_off").alias("start"), F.col("end_off").alias("end"))).join(F.broadcast(safe.select("key_id", "marked")), "key_id")
    kind = F.when(F.col("inside"), "inside").when(F.col("marked"), "crossing").otherwise("code")
    return whole.unionByName(placed.select("id", "key_id", "pos", "len", "lit_type", kind.alias("kind")))


def in_order_of_application(hits: DataFrame, by: str = "id") -> DataFrame:
    """Hits that are replaced (those nested in others left out), the last place of a source first, so that places stay valid."""
    return overlaps(hits, by).where(~F.col("nested")).drop("nested", "conflict").orderBy(by, F.desc("pos"))


def stale_texts(white: DataFrame, lits: DataFrame, sources: DataFrame) -> DataFrame:
    """White-list texts (text) that no literal equals and that no source holds, raw or escaped."""
    left = white.join(lits.select("text").distinct(), "text", "left_anti")
    keys = left.select(F.col("text").alias("key_id"), F.col("text").alias("key"))
    return left.join(form_occurrences(sources, keys).select(F.col("key_id").alias("text")).distinct(), "text", "left_anti")


def stale_everywhere(keys: DataFrame, white: DataFrame, matched: DataFrame) -> DataFrame:
    """text of keys and white-list entries (both text) that were matched (text) nowhere."""
    return keys.select("text").union(white.select("text")).distinct().join(matched.select("text").distinct(), "text", "left_anti")


def stale(keys: DataFrame, matched: DataFrame, key: str = "key") -> DataFrame:
    """Keys (distinct) that were never matched."""
    return keys.select(key).distinct().join(matched.select(key).distinct(), key, "left_anti")
