"""Best-fit packing of tokenised documents into sequences, with lower bounds that certify the result.

Documents are tokenised where they are read; a longer document is cut, its first piece the shorter one. Whole pieces
are sequences of their own. The others are dealt to partitions of a bounded size, each packed best-fit decreasing;
dual-feasible functions bound from below how many bins its pieces need. A partition that meets its bound is certified.
In one with a gap bins exchange pieces: what remains of the emptiest bin moves into the gaps of the others. Partitions that
still have a gap exchange the pieces of their unfilled bins: these are pooled, dealt anew to fewer partitions and packed
best-fit decreasing again, until one partition has had them all or IDLE rounds in a row saved nothing.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tok
from .common import cut, narrow_batches

CAPACITY = 1024
END = 2
#: Pieces packed by one task.
PART = 50_000
#: Rounds without a saving after which the search ends: exchange between partitions, and between the bins of one.
IDLE, TRIES = 2, 4
#: Bins that are filled anew together.
TOGETHER = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def default_ranks() -> str:
    """The same vocabulary as ranks: tiktoken gives the same ids from it as tokenizers does, in a quarter of the time."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Ids:
    """Token ids of a text as tokenizers gives them; with ranks, by tiktoken for all texts without a special token's string."""

    def __init__(self, path: str, ranks: str | None):
        import public_tokenizers
        import tiktoken

        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.special = [t["content"] for t in json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))[0]]
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            if self.slow is None:  # read only where it is needed
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text), np.uint32)


_ready: dict[tuple, Ids] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs. A null text is the end token alone."""
    key = (tokenizer, ranks) if tokenizer else (default_tokenizer(), default_ranks())
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ready.get(key) or _ready.setdefault(key, Ids(*key))
        end = np.array([END], np.uint32)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                own = np.concatenate([ids(text.as_py() or ""), end])
                n = -(-len(own) // capacity)
                raw, at = own.astype("<u4").tobytes(), 0
                for p in range(n):
                    to = len(own) - (n - 1 - p) * capacity
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    at = to
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
            tok.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, best-fit decreasing: each goes where the least room is left that is enough."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = open_ >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            k = room[free].pop()
            if not room[free]:
                open_ ^= 1 << free
        else:
            k, free, n = n, capacity, n + 1
        bins[i], offsets[i] = k, capacity - free
        if free > s:
            room[free - s].append(k)
            open_ |= 1 << (free - s)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    return lower_bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def lower_bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound on the number of bins from two families of dual-feasible functions (rounding down, and dropping small items); count: items by size."""
    count = count.astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 33):
        value = np.where(x * (k + 1) % capacity == 0, x * k, x * (k + 1) // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    number, words = np.cumsum(count[::-1])[::-1], np.cumsum((count * x)[::-1])[::-1]
    low = np.arange(1, capacity // 2 + 1)
    value = np.append(number, 0)[capacity - low + 1] * capacity + words[low] - np.append(words, 0)[capacity - low + 1]
    return max(best, -(-int(value.max()) // capacity))


def fullest(sizes: list[int], room: int) -> list[int]:
    """Places of the sizes that together come nearest to room without exceeding it; sums are the bits of an integer."""
    mask, sums = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        sums.append(sums[-1] | sums[-1] << s & mask)
        if sums[-1] >> room & 1:
            break
    left, out = sums[-1].bit_length() - 1, []
    for i in range(len(sums) - 2, -1, -1):
        if not sums[i] >> left & 1:
            out.append(i)
            left -= sizes[i]
    return out


def packed(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bin of each item, its offset, whether the number of bins meets the lower bound).

    Best-fit decreasing; then, while there is a gap to the bound, the emptiest bin meets all unfilled ones (and as many
    full ones, for other choices of items), TOGETHER at a time: these are filled anew, each as full as can be, from the
    items of all, and what does not go in stays with the emptiest, until nothing is left of it. The search ends after
    TRIES rounds in a row that took nothing from it.
    """
    bins, offsets = best_fit(sizes, capacity)
    least = lower_bound(sizes, capacity)
    number = int(bins.max()) + 1 if len(sizes) else 0
    if number <= least:
        return bins, offsets, True
    own, rng = sizes.tolist(), np.random.default_rng(len(sizes))
    order = np.argsort(bins, kind="stable")
    held = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(bins))[:-1])]
    filled = [sum(own[i] for i in x) for x in held]
    failed = 0
    while len(held) > least and failed < TRIES:
        k = int(np.argmin(filled))
        rest, size = held.pop(k), filled.pop(k)
        before = size
        loose, full = ([j for j in range(len(held)) if (filled[j] < capacity) == x] for x in (True, False))
        met = rng.permutation([*loose, *rng.choice(full, min(len(full), len(loose)), replace=False).tolist()]) if full else rng.permutation(loose)
        for group in np.array_split(met, -(-len(met) // TOGETHER)) if len(met) else []:
            group = group.tolist()
            items = rest + [i for j in group for i in held[j]]
            total = sum(filled[j] for j in group)
            for turn in range(3):
                left = sorted(items, key=lambda i: -own[i]) if not turn else [items[i] for i in rng.permutation(len(items))]
                made = []
                for _ in group:
                    taken = set(fullest([own[i] for i in left], capacity))
                    made.append([i for n, i in enumerate(left) if n in taken])
                    left = [i for n, i in enumerate(left) if n not in taken]
                sums = [sum(own[i] for i in x) for x in made]
                if sum(sums) > total or sum(sums) == total and turn == 2:
                    size -= sum(sums) - total
                    rest = left
                    for j, x, n in zip(group, made, sums, strict=True):
                        held[j], filled[j] = x, n
                    break
            if not rest:
                break
        if rest:
            held.append(rest)
            filled.append(size)
        failed = 0 if size < before else failed + 1
    for k, items in enumerate(held):
        at = 0
        for i in items:
            bins[i], offsets[i], at = k, at, at + own[i]
    return bins, offsets, len(held) <= least


_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def _packed(rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    """rows (with mid and pid) and their sequence_id, offset, room left in the sequence, and whether the partition met its bound."""

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("mid")
        sizes = t["length"].to_numpy()
        bins, offsets, certified = packed(sizes, capacity)
        filled = np.bincount(bins, sizes).astype(np.int64)
        t = t.append_column("sequence_id", pa.array((turn << 48) + t["pid"].to_numpy() * (1 << 17) + bins))
        t = t.append_column("offset", pa.array(offsets)).append_column("room", pa.array(capacity - filled[bins]))
        return t.append_column("certified", pa.array(np.full(len(sizes), certified)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("pid").applyInArrow(fit, f"{kinds}, sequence_id long, offset long, room long, certified boolean")


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece; certified, least_sequences.

    certified: whether the pieces that were packed with this one last fill no more sequences than their lower bound;
    least_sequences: the same bound for the whole table, below which no packing can get.

    A null or empty text is one piece, the end token. A very long one is tokenised whole and cut. Rows that repeat are
    packed each by itself; pieces of equal length are taken in the order they are read. An empty table gives an empty
    result. Other columns, whatever their names, are not looked at. Reruns on the same files give the same sequences up to
    their numbers.
    """
    all_pieces = cut(pieces(docs, tokenizer, ranks, capacity)).withColumn("mid", F.monotonically_increasing_id())
    count = np.zeros(capacity + 1, np.int64)
    for r in all_pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        count[r["length"]] = r["n"]
    least = F.lit(lower_bound_of_counts(count, capacity)).cast("long").alias("least_sequences")
    out = (*_COLUMNS, "sequence_id", "offset", "certified")
    whole = all_pieces.where(F.col("length") == capacity)
    done = [whole.select(*_COLUMNS, (F.lit(1 << 62) + F.col("mid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    rows, n, bins, turn, idle = all_pieces.where(F.col("length") < capacity), int(count[:capacity].sum()), None, 0, 0
    while n:
        parts = max(1, -(-n // PART))
        dealt = rows.select(*_COLUMNS, "mid", F.pmod(F.xxhash64("mid", F.lit(turn)), F.lit(parts)).alias("pid"))
        now = cut(_packed(dealt, turn, capacity))
        used = now.select("sequence_id").distinct().count()
        if bins is not None and used >= bins:
            now, idle = rows, idle + 1  # the packing before is as good
        else:
            idle = 0
        if parts == 1 or idle >= IDLE:
            done.append(now.select(*out))
            break
        if not idle:
            # a certified partition has one bin at most that others could fill; those with a gap give all that have room
            last = now.where("certified").groupBy("pid").agg(F.max(F.struct("room", "sequence_id")).alias("m")).select(F.col("m.sequence_id").alias("s")).withColumn("least", F.lit(True))
            now = now.join(F.broadcast(last) if parts <= 10_000 else last, now["sequence_id"] == last["s"], "left")
            gives = (F.col("room") > 0) & (~F.col("certified") | F.coalesce(F.col("least"), F.lit(False)))
            done.append(now.where(~gives).select(*out))
            rows = now.where(gives).select(*out, "mid")
            n, bins = rows.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        turn += 1
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result.withColumn("least_sequences", least)
