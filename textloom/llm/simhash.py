"""SimHash near-deduplication with BK-trees.

Texts are reduced to 64-bit SimHash fingerprints; equal fingerprints become one row. Rows meet in shards, each shard is
a BK-tree that its task builds and searches; what is linked there is joined to components over the whole table.

Shards are trees over a bounded part of the rows. They travel by shuffle to the tasks that search them, not by a
broadcast from the driver, since the driver must not gather the fingerprints of all documents:
  near fingerprints (radius r): one shard for each value of each of r + 1 blocks of bits. Two fingerprints that differ
    in at most r bits agree in one block whole, so every link is met (pigeonhole). In a shard with more than SHARD
    fingerprints the other bits are cut into r + 1 blocks again, and so on: r + 1 rows for one, however large the shard.
  similar texts (Jaccard similarity of shingles): one shard for each value of each band of min-hashes; a link must lie
    within the radius, and the similarity of the two sets of shingles must be large enough. A shard with more than SHARD
    rows is cut into parts. Each part meets the first one; then only rows outside the shard's largest component meet all
    parts, as two rows inside it need no link. So one group of near copies costs twice its rows, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as tok
from .bktree import components
from .common import checked_broadcast, cut, narrow_batches

SEED = 42
SHARD = 20_000
#: Shards of fingerprints that agree in all but so many bits are not cut further: they hold 2 ** LEAST_BITS at most.
LEAST_BITS = 14
U64 = np.uint64
_LANES = U64(0x0101010101010101)
#: Min-hashes by which texts meet: at a similarity of 0.8 a pair misses all bands with a chance of 0.0008.
BANDS, ROWS = 10, 3
#: Cells of a sketch of a text's shingles. Pairs whose sketches show a similarity less by SLACK (almost five deviations) are not looked at further.
CELLS, SLACK = 256, 0.12
#: Fingerprints of sets at a similarity of 0.8 differ in each bit with a chance of up to 0.1875 (four and five shingles;
#: 0.151 for long texts), so in more than RADIUS of 64 bits with one below 0.00001, far below that of missing all bands.
RADIUS = 28
_FACTORS = tok.mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_hashes(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of k words, joined by single spaces (fewer words: of all), and where each text's begin."""
    w = tok.split(data, at, tok.SPACE, tok.LOWER, hashed=False)
    size = w.end - w.start
    inside = np.flatnonzero(tok.SPACE[w.data])
    clean = np.full(len(inside) + len(size), 0x20, np.uint8)
    clean[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = w.data[inside]
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    firsts = w.firsts()
    n = np.diff(firsts)
    m = np.where(n > 0, np.maximum(1, n - k + 1), 0)
    edge = np.concatenate([[0], np.cumsum(m)])
    low = np.arange(edge[-1]) + np.repeat(firsts[:-1] - edge[:-1], m)
    high = np.minimum(low + k, np.repeat(firsts[1:], m)) - 1
    raw, digest = clean.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[s:e], SEED) for s, e in zip(begin[low].tolist(), (begin[high] + size[high]).tolist(), strict=True)], dtype=U64)
    return hashes, edge


def fingerprints(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's hashes; no hashes: 0."""
    m = np.diff(edge)
    blocks = (m + 254) // 255
    first = np.concatenate([[0], np.cumsum(blocks)])
    if not first[-1]:
        return np.zeros(len(m), U64)
    at = np.repeat(edge[:-1], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    bits = np.zeros((first[-1], 8, 8), np.int64)
    for j in range(8):
        bits[:, :, j] = np.add.reduceat((hashes >> U64(j)) & _LANES, at).view(np.uint8).reshape(-1, 8)
    some = blocks > 0
    total = np.add.reduceat(bits.reshape(-1, 64), first[:-1][some], axis=0)
    out = np.zeros(len(m), U64)
    out[some] = np.packbits(2 * total > m[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def distinct(hashes: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, and where each text's begin."""
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort([hashes, doc])
    h, d = hashes[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=len(edge) - 1))])


def min_hashes(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes for each text; all equal for texts without words."""
    some = np.diff(edge) > 0
    out = np.full((len(some), BANDS * ROWS), ~U64(0), U64)
    if some.any():
        for j, factor in enumerate(_FACTORS):
            out[some, j] = np.minimum.reduceat(hashes * factor, edge[:-1][some])
    return tok.mix(out)


def sketches(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each text CELLS bytes: of the shingles that fall in a cell the least one's mark (1 to 255), 0 for an empty cell."""
    out = np.zeros((len(edge) - 1, CELLS), np.uint8)
    if len(hashes):
        h = tok.mix(hashes)
        key = np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * CELLS + (h >> U64(56)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        out.ravel()[key[order][heads]] = tok.mix(np.minimum.reduceat(h[order], heads)) % U64(255) + U64(1)
    return out


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of shingles, from the cells that either text has."""
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1))


def short_sets(hashes: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """The upper 32 bits of each text's (distinct, sorted) hashes, each once: two texts' sets tell their similarity up to rare collisions."""
    doc, h = np.repeat(np.arange(len(edge) - 1), np.diff(edge)), (hashes >> U64(32)).astype(np.uint32)
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    at = 4 * np.searchsorted(doc[new], np.arange(len(edge)))
    raw = h[new].tobytes()
    return [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def with_fingerprints(docs: DataFrame, shingle: int, signed: bool = False) -> DataFrame:
    """docs' columns doc_id, text's fingerprint fp (long) and, if signed, bands (array of keys), sig (short set of shingles, binary) and k.

    A signed fingerprint counts each shingle once.
    """
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in tok.chunks(b.column(1)):
                hashes, edge = shingle_hashes(data, at, shingle)
                cols = [b.column(0).slice(low, high - low), pa.array(fingerprints(hashes, edge).view(np.int64))]
                if signed:
                    hashes, edge = distinct(hashes, edge)
                    sig = min_hashes(hashes, edge)
                    cols[1] = pa.array(fingerprints(hashes, edge).view(np.int64))
                    keys = sum((tok.mix(sig[:, r::ROWS] + U64(r)) for r in range(ROWS)), np.zeros((1, 1), U64)) + np.arange(BANDS, dtype=U64)
                    flat = pa.array(tok.mix(keys).view(np.int64).ravel())
                    cols += [pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * BANDS + 1, BANDS, dtype=np.int32)), flat), pa.array(short_sets(hashes, edge), pa.binary()), b.column(2).slice(low, high - low)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "bands", "sig", "k"][: len(cols)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long" + ", bands array<bigint>, sig binary, k long" * signed
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return (texts.withColumn("k", _text_key()) if signed else texts).mapInArrow(run, schema)


def _splits(radius: int) -> list[int]:
    """Masks of the bits that agree, by path: path p's children are p * (radius + 1) + 1 and on, path 0 is the start (no bits)."""
    n = radius + 1
    masks, free, level = {0: 0}, {0: list(range(64))}, [0]
    while level and len(free[level[0]]) > LEAST_BITS:
        below = []
        for p in level:
            for j, block in enumerate(np.array_split(np.array(free[p]), n)):
                child = p * n + 1 + j
                masks[child] = masks[p] | sum(1 << int(i) for i in block)
                free[child] = [i for i in free[p] if not masks[child] >> i & 1]
                below.append(child)
        level = below
    return [masks[p] - (1 << 64 if masks[p] >> 63 else 0) for p in sorted(masks)]


def _met_by_blocks(items: DataFrame, radius: int) -> DataFrame:
    """id, fp, key: items (id, fp), once for each shard of SHARD items at most that they share with others."""
    n, masks = radius + 1, _splits(radius)
    leaves = len(masks) - (len(masks) - 1) // n  # paths without children stand last
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("path") + 1)
    level, out = items.select("id", "fp", F.lit(0).alias("path")), None
    while True:
        level = level.select("id", "fp", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.col("path") * n + j)).alias("path"))
        level = level.withColumn("key", F.xxhash64("path", F.col("fp").bitwiseAND(mask)))
        count = cut(level.groupBy("key").agg(F.count("*").alias("n"), F.max("path").alias("at")).where("n > 1"))
        hot = (F.col("n") > SHARD) & (F.col("at") < len(masks) - leaves)
        cold = level.join(count.where(~hot).select("key"), "key").select("id", "fp", "key")
        out = cold if out is None else out.union(cold)
        hot_keys = count.where(hot).select("key")
        if not hot_keys.take(1):
            return out
        level = cut(level.join(checked_broadcast(hot_keys), "key").select("id", "fp", "path"))


def _links_by_bands(items: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links of items (id, fp, keys, rid) that share a band and are similar; sets: rid, sig."""
    rows = items.select("id", "fp", "rid", F.explode(F.array_distinct("keys")).alias("key"))
    count = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / SHARD).cast("int")))
    # sets travel only with rows that share a shard
    find = lambda met: links(met.select("id", "fp", "rid", "key").join(sets, "rid").drop("rid"), radius, similarity)
    out = find(rows.join(count.where("parts = 1").select("key"), "key"))
    wide = count.where("parts > 1").select("key", "parts")
    if not wide.take(1):
        return out
    # wide shards are few: joined by broadcast, their rows stay where they are
    wide = cut(rows.join(checked_broadcast(wide), "key").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    task = lambda *of: F.xxhash64("key", *of).alias("key")
    met = wide.select("id", "fp", "rid", "key", F.explode(F.when(F.col("part") == 0, every).otherwise(F.array("part"))).alias("to"))
    first = cut(find(met.select("id", "fp", "rid", task("to"))))
    wide = cut(wide.join(connected(first), "id", "left").withColumn("root", F.coalesce("root", "id")))
    largest = wide.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    both = wide.join(checked_broadcast(cut(largest)), "key").withColumn("out", F.col("root") != F.col("largest"))
    blocks = cut(both.where("out").groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks")))
    both = both.join(checked_broadcast(blocks), "key")
    as_row = both.select("id", "fp", "rid", "key", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    as_query = both.where("out").select("id", "fp", "rid", "key", F.explode(every).alias("part"), F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    second = find(as_row.union(as_query).select("id", "fp", "rid", task("block", "part")).distinct())
    return out.union(first).union(second)


def links(met: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """u, v: for each item its component within a shard, as a star: linear in the items of a shard, however many links it has.

    met: id, fp, key (of the shard), and sig if similarity is given.
    """
    kind = met.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, fp, key = t["id"].combine_chunks(), t["fp"].to_numpy().view(U64), t["key"].to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            alike = None
            if similarity is not None:
                sig = t["sig"].combine_chunks()
                at = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset : sig.offset + len(sig) + 1] // 4
                values = np.frombuffer(sig.buffers()[2] or b"", np.uint32)
                values, at = values[at[0] : at[-1]], at - at[0]
                sketch = sketches(values.astype(U64) << U64(32), at)

                def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    ok = sketch_similarity(sketch[a], sketch[b]) >= similarity - SLACK
                    ok |= (at[a + 1] == at[a]) & (at[b + 1] == at[b])
                    for i in np.flatnonzero(ok).tolist():
                        x, y = a[i], b[i]
                        ok[i] = similarity_of(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]]) >= similarity
                    return ok

            label = components(fp, np.flatnonzero(new), radius, alike)
            out = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(out)), ids.take(pa.array(label[out]))], ["u", "v"])

        def whole(t: pa.Table) -> int:
            """Rows before the last shard."""
            key = t["key"].to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1])
            return int(new[-1]) + 1 if len(new) else 0

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 50_000 or sum(x.nbytes for x in held) >= 64 << 20:
                t = pa.Table.from_batches(held)
                if n := whole(t):
                    yield solve(t.slice(0, n))
                held = t.slice(n).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return met.repartition("key").sortWithinPartitions("key", "id").mapInArrow(search, f"u {kind}, v {kind}").where("u != v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of each linked id's component (large-star and small-star rounds, cut after each)."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small = cut(small)
        totals = lambda x: tuple(x.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if totals(small) == totals(e):
            return small.select(F.col("u").alias("id"), F.col("v").alias("root"))
        e = small


def classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of each row: fingerprints link if they differ in at most radius bits.

    component_id is the smallest doc_id that can be reached over links, itself included. A text without words (null or
    empty) has fingerprint 0, linked like any other; a very long one is fingerprinted whole; a null id never becomes a
    component_id while its component has another; repeated rows stay rows, and of equal fingerprints all are in one class.
    An empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    rows = cut(with_fingerprints(docs, shingle))
    # a fingerprint's name is in the order of its smallest doc_id, so a component's smallest name tells its class
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("id"))
    root = connected(links(_met_by_blocks(prints, radius), radius))
    named = prints.join(root, "id", "left").select("fp", F.coalesce("root", "id")["least"].alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, k, kept_id, kept for each row of docs: one document of each group of similar texts is kept, that with the smallest doc_id.

    Texts link if the similarity of their whole sets of shingles reaches the given one and their fingerprints (which count
    each shingle once, as the similarity does) lie within radius. k: a digest of id and text; both together name a
    document. A null or wordless text has no shingle, and such texts are alike; a text of fewer words than a shingle is
    one shingle; very long texts are compared whole. Of equal doc_ids the least k comes first; a null one is the smallest.
    """
    rows = cut(with_fingerprints(docs, shingle, signed=True)).withColumns({"set": F.xxhash64("sig"), "rid": F.monotonically_increasing_id()})
    # equal sets of shingles are one item, named by its first document
    texts = cut(rows.groupBy("fp", "set").agg(F.min(F.struct("doc_id", "k", "rid")).alias("id"), F.first("bands").alias("keys")))
    root = connected(_links_by_bands(texts.select("id", "fp", "keys", F.col("id.rid").alias("rid")), rows.select("rid", "sig"), radius, similarity))
    named = texts.select("fp", "set", "id").join(root, "id", "left").select("fp", "set", F.coalesce("root", "id").alias("root"))
    both = rows.select("doc_id", "k", "fp", "set").join(named, ["fp", "set"])
    return both.select("doc_id", "k", F.col("root.doc_id").alias("kept_id"), (F.col("doc_id").eqNullSafe(F.col("root.doc_id")) & (F.col("k") == F.col("root.k"))).alias("kept"))


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each group of similar texts the row with the smallest doc_id, with docs' own columns, whatever their names.

    Texts without words are one group. Of rows that repeat a doc_id and a text one stays; a null doc_id counts as the
    smallest; very long texts are compared whole. An empty table gives an empty result. Only rows that go are looked up,
    by broadcast if a count allows it, so the texts that stay are not shuffled.
    """
    found = similar(docs, shingle, similarity).groupBy(F.col("doc_id").alias("g_id"), F.col("k").alias("g_k")).agg(F.first("kept").alias("g_kept"), F.count("*").alias("g_n"))
    gone = cut(found.where(~F.col("g_kept") | (F.col("g_n") > 1)))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("row"), "doc_id", _text_key().alias("k"))
    same = lambda g: F.col("doc_id").eqNullSafe(g["g_id"]) & (F.col("k") == g["g_k"])
    side = checked_broadcast(gone.select("g_id", "g_k"), 500_000)  # 100 bytes a row
    left = rows.join(side, same(side), "left_anti").select("row.*")
    again = gone.where("g_kept").select("g_id", "g_k")
    if again.take(1):
        again = checked_broadcast(again)
        left = left.union(rows.join(again, same(again), "left_semi").groupBy("doc_id", "k").agg(F.first("row").alias("row")).select("row.*"))
    return left
