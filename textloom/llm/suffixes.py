"""Passages of MIN_WORDS words or more that texts share, by a sparse suffix array over minimiser positions.

Of each text only suffixes at content-selected positions are retained: where the least hash of K words in some window of
MIN_WORDS words stands (a window has WINDOW such hashes; the least is the same wherever the window stands). Suffixes
whose K words one text only has are left out (a fixed-size table of bits tells; a wrong bit costs rows, never a passage).

Neighbours in one order of the suffixes would not do: two texts may share, say, 20 words before a position and 30 from it
on, while each has longer one-sided matches with others, that stand between them in any single order. So a retained
suffix enters the array once for each of its left extensions that makes a window of MIN_WORDS words, with the hash of that
window: the array is sorted over the cluster, by range, by the K words, that hash and the document. Equal windows are
neighbours then, the smallest document's first, so no partner is missed, and a window in a third of all rows fills many
partitions. Runs of equal windows at the edges of a partition are decided by what the other partitions say of the same
window (two rows of each). What matches is extended left and right: windows of one suffix that match and meet leave a
partition as one span, and spans of neighbouring suffixes that meet become one passage.

Of the places of a window all are redundant but those in the smallest (doc_id, text). As that order is total, each window
is redundant everywhere but in one document, which is the same for all of its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import words as tok
from .common import checked_broadcast, cut, narrow_batches

MIN_WORDS = 50
K = 25
WINDOW = MIN_WORDS - K + 1
#: Rows that are worked on at once.
BATCH = 200_000
#: Bits in the table of hashes that occur twice, and in each of the parts it is made of.
BITS, PART_BITS = 27, 20
U64 = np.uint64


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over each run of n neighbours, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def least(w: tok.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each run of MIN_WORDS words the least hash of K words in it, and whether the run lies in one text."""
    if len(w.hash) < MIN_WORDS:
        return np.zeros(0, U64), np.zeros(0, bool)
    return _slide(tok.grams(w.hash, K), WINDOW, np.minimum), tok.same_text(w.doc, MIN_WORDS)


def least_of_texts(w: tok.Words) -> np.ndarray:
    """The least hashes of each text, each once a text."""
    g, ok = least(w)
    doc = w.doc[: len(g)]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1])[: len(g)] & ok
    g, doc = g[new], doc[new]
    order = np.lexsort([g, doc])
    g, doc = g[order], doc[order]
    return g[np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))[: len(g)]]


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def _twice(texts: DataFrame) -> np.ndarray:
    """The table of bits: set for least hashes that two texts or more have. Its size is fixed, whatever the input's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in tok.chunks(b.column(2)):
                g, n = np.unique(least_of_texts(tok.split(data, at)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    def part(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, bool)
        bits[t["bit"].to_numpy() & ((1 << PART_BITS) - 1)] = True
        return pa.table({"part": t["part"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    often = texts.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    bit = often.select(F.col("g").bitwiseAND(F.lit((1 << BITS) - 1)).alias("bit")).distinct().withColumn("part", F.shiftright("bit", PART_BITS))
    rows = bit.groupBy("part").applyInArrow(part, "part long, bits binary").collect()  # 2 ** (BITS - PART_BITS) rows at most
    table = np.zeros((1 << (BITS - PART_BITS), (1 << PART_BITS) // 8), np.uint8)
    for r in rows:
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _windows(texts: DataFrame, shared) -> DataFrame:
    """Windows of MIN_WORDS words whose least hash (m) is in the (broadcast) table: their own hash h and first word pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for low, _, data, at in tok.chunks(b.column(2)):
                w = tok.split(data, at)
                m, ok = least(w)
                bit = (m & U64((1 << BITS) - 1)).astype(np.int64)
                i = np.flatnonzero(ok & ((bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1) > 0))
                if not len(i):
                    continue
                h, firsts = tok.grams(w.hash, MIN_WORDS), w.firsts()
                for some in np.array_split(i, -(-len(i) // BATCH)):
                    doc = w.doc[some]
                    rows = pa.array(low + doc)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(1).take(rows), pa.array(m[some].view(np.int64)), pa.array(h[some].view(np.int64)), pa.array((some - firsts[doc]).astype(np.int32))],
                        ["doc_id", "k", "m", "h", "pos"],
                    )

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, k long, m long, h long, pos int")


_SPAN = ("doc_id", "k", "start", "end", "keeper", "redundant")


def _one(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _ids(ids: pa.Array) -> np.ndarray:
    """doc_id as numbers in its order, null the smallest."""
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    return order.to_numpy().astype(np.int64)


def _solve(t: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Spans of whole runs of equal windows. first, last: the first or last run may go on in another partition; its windows are told as they are, and what is known of it."""
    ids = _one(t["doc_id"])
    k, m, h, pos = (t[c].to_numpy() for c in ("k", "m", "h", "pos"))
    new = np.append(True, (m[1:] != m[:-1]) | (h[1:] != h[:-1]))
    heads, run = np.flatnonzero(new), np.cumsum(new) - 1
    lead = heads[run]
    redundant = k != k[lead]
    many = np.logical_or.reduceat(redundant, heads)
    open_ = np.zeros(len(heads), bool)
    if first:
        open_[0] = True
    if last:
        open_[-1] = True

    def batch(row: np.ndarray, start, end, keeper, flag, side: int | None = None) -> pa.RecordBatch:
        n = len(row)
        own = [pa.nulls(n, pa.int64())] * 2 if side is None else [pa.array(x[row]) for x in (m, h)]
        columns = [ids.take(pa.array(row)), pa.array(k[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), ids.take(pa.array(keeper)), pa.array(flag), *own, pa.array([side] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*_SPAN, "m", "h", "side"])

    row = np.flatnonzero((many & ~open_)[run])
    if len(row):
        row = row[np.lexsort([pos[row], redundant[row], k[row]])]
        # windows of one text that meet, with one verdict, are one span
        begin = np.flatnonzero(np.append(True, (k[row][1:] != k[row][:-1]) | (redundant[row][1:] != redundant[row][:-1]) | (pos[row][1:] > pos[row][:-1] + MIN_WORDS)))
        end = np.append(begin[1:], len(row)) - 1
        order = np.argsort(_ids(ids), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keeper = order[np.minimum.reduceat(rank[lead[row]], begin)]
        yield batch(row[begin], pos[row[begin]], pos[row[end]] + MIN_WORDS, keeper, redundant[row[begin]])
    row = np.flatnonzero(open_[run])
    if len(row):
        yield batch(row, pos[row], pos[row] + MIN_WORDS, row, redundant[row], 0)
        row = heads[open_]
        yield batch(row, pos[row], pos[row], row, many[open_], 1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one sorted partition."""
    held, first = [], True
    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
        if sum(x.num_rows for x in held) >= BATCH:
            t = pa.concat_tables(held).combine_chunks()
            m, h = t["m"].to_numpy(), t["h"].to_numpy()
            new = np.flatnonzero((m[1:] != m[:-1]) | (h[1:] != h[:-1]))
            held = [t]
            if len(new):
                yield from _solve(t.slice(0, int(new[-1]) + 1), first, False)
                held, first = [t.slice(int(new[-1]) + 1).combine_chunks()], False
    if held:
        yield from _solve(pa.concat_tables(held).combine_chunks(), first, True)


def shared_spans(docs: DataFrame) -> DataFrame:
    """doc_id, k, start, end, keeper, redundant: spans of words that texts share; k: a digest of id and text; keeper: the smallest document that has a window of it."""
    narrow_batches(docs.sparkSession)
    # ranges of even size also where one passage fills many of them
    conf, sampled = docs.sparkSession.conf, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = conf.get(sampled)
    conf.set(sampled, "200")
    texts = docs.select("doc_id", _key().alias("k"), F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(_twice(texts))  # 2 ** BITS bits
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = ("m", "h", "doc_id", "k", "pos")
    found = _windows(texts, table).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(found.mapInArrow(_compare, f"doc_id {kind}, k long, start int, end int, keeper {kind}, redundant boolean, m long, h long, side int"))
    conf.set(sampled, before)
    table.destroy()
    edges = found.where("side = 1").groupBy("m", "h").agg(F.min(F.struct("doc_id", "k")).alias("low"), (F.max("redundant") | (F.min("k") != F.max("k"))).alias("many")).where("many")  # of two rows a partition at most
    low = docs.sparkSession.sparkContext.broadcast({(r["m"], r["h"]): (r["low"]["doc_id"], r["low"]["k"]) for r in edges.collect()})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans as they are; windows that were left open by what all partitions say of them: none or one row for each."""
        for b in batches:
            if (done := b.filter(b.column(8).is_null())).num_rows:
                yield pa.RecordBatch.from_arrays(done.columns[:6], list(_SPAN))
            b = b.filter(b.column(8).is_valid())
            if not b.num_rows:
                continue
            m, h = (b.column(i).to_numpy() for i in (6, 7))
            heads = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (h[1:] != h[:-1]))).tolist()
            for i, j in zip(heads, [*heads[1:], len(m)], strict=True):
                if (key := (int(m[i]), int(h[i]))) in low.value:
                    doc_id, k = low.value[key]
                    own = b.slice(i, j - i)
                    keeper = pa.array([doc_id], own.column(0).type).take(pa.array(np.zeros(j - i, np.int64)))
                    yield pa.RecordBatch.from_arrays([*own.columns[:4], keeper, pa.array(own.column(1).to_numpy() != k)], list(_SPAN))

    return found.where("side IS NULL OR side = 0").mapInArrow(decide, found.select(*_SPAN).schema)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, k, start_word, end_word, redundant, keeper: shared spans merged in each document, redundant ones and kept ones each by themselves.

    Words are [^\\x20\\x09-\\x0D]+, compared exactly; words are counted from 0. Documents that share no passage have no
    row. A null or short text shares none; a very long one is compared whole; rows that repeat an id and a text count as
    one document; of equal texts that with the smallest doc_id keeps its passages, of equal doc_ids that with the smallest
    k; a null doc_id is the smallest. An empty table gives an empty result; other columns, whatever their names, are not
    looked at.
    """
    spans = shared_spans(docs)
    order = W.partitionBy("doc_id", "k", "redundant").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "k", "redundant", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("keeper").alias("keeper")).select("doc_id", "k", "start_word", "end_word", "redundant", "keeper")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without some spans of words (and the white space after each)."""
    at = [m.span() for m in _WORD.finditer(text)]
    parts, done = [], 0
    for s, e in sorted(spans):
        low = at[s][0]
        if low > done:
            parts.append(text[done:low])
        done = max(done, at[e][0] if e < len(at) else len(text))
    return "".join([*parts, text[done:]])


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs without redundant passages, with docs' own columns, whatever their names (n_chars, where there is one, counted anew).

    A document that loses all its words is left out; all others stay, those that share nothing unchanged, null and empty
    texts too. Rows that repeat an id and a text lose the same words. An empty table gives an empty result.
    """
    found = passages(docs).where("redundant")
    per = cut(found.groupBy(F.col("k").alias("cut_k"), F.col("doc_id").alias("cut_id")).agg(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("cuts")))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("row"), _key().alias("k")).join(checked_broadcast(per), (F.col("k") == F.col("cut_k")) & F.col("row.doc_id").eqNullSafe(F.col("cut_id")), "left")

    @F.pandas_udf("string")
    def clean(text, cuts):
        import pandas as pd

        return pd.Series([without(t, [(c["s"], c["e"]) for c in x]) if x is not None else t for t, x in zip(text, cuts, strict=True)])

    some = F.col("cuts").isNotNull()
    changed = rows.where(some).withColumn("row", F.col("row").withField("text", clean("row.text", "cuts"))).where(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("row", F.col("row").withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType)))
    return rows.where(~some).select("row.*").union(changed.select("row.*"))
