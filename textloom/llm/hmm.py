"""A hidden Markov language model: Baum-Welch counts summed over partitions train it, a scaled forward recursion gives exact likelihoods.

Tokens are the words of a text and one end. Each token has a symbol: the OWN most frequent tokens one each, the end one,
all others one of CLASSES by their last letters. The model is a chain of STATES hidden states that emit symbols; a token
of a class is drawn within it with (c + 1) / (C + V + 1), c its count, C and V the class's count and number of distinct
tokens, and 1 for what is unknown there. So a text's probability is that of its symbols (forward recursion, whole text)
times those of its tokens within their classes.

Counts cover all texts. Tokens that occur often in any text, HEAD at most, have their counts broadcast; all others, which
are rare everywhere, are joined. Baum-Welch goes over whole training texts, a sequence each, until a pass gains less than
GAIN of the log-likelihood or MOST_PASSES are done. Its backward recursion keeps forward weights at the edges of blocks
only and makes those between anew, so a text of any length takes bounded memory beside its symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as tok
from .common import cut, narrow_batches, remainder

STATES = 8
OWN, CLASSES = 4095, 1024
SYMBOLS = OWN + 1 + CLASSES
#: Tokens whose counts are broadcast, at most (16 bytes each).
HEAD = 1_000_000
MOST_PASSES, GAIN = 4, 1e-3
#: Symbols whose states' weights are held at once in training, and symbols of texts taken together in training and scoring.
BLOCK, AT_ONCE = 400_000, 3_000_000
#: Weight, in tokens, of the symbols' overall shares in each state's emissions.
PRIOR = 50.0
U64 = np.uint64
END = np.int64(0x51ED270B7A3F1C95)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[tok.Words, np.ndarray]:
    """Words, A-Z lower-cased, and the class of each."""
    w = tok.split(data, at, tok.SPACE, tok.LOWER)
    last = np.zeros(len(w.hash), np.int64)
    for j in (1, 2, 3):
        i = w.end - j
        last = last * 257 + np.where(i >= w.start, w.data[np.maximum(i, 0)].astype(np.int64) + 1, 0)
    return w, last * 7919 % 1_000_003 % CLASSES


class Model:
    """start (STATES), move (STATES x STATES), emit (SYMBOLS x STATES: of each state, a symbol's probability)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, share: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * np.exp(rng.normal(0, 0.7, (SYMBOLS, STATES)))
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the sequences, longest first; symbols time by time; where each time's begin)."""
    if len(sequences) == 1:
        return np.zeros(1, np.int64), sequences[0], np.arange(len(sequences[0]) + 1)
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    edge = np.concatenate([[0], np.cumsum(alive)])
    time = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.empty_like(flat)
    out[edge[time] + np.repeat(np.arange(len(size)), size)] = flat
    return order, out, edge


def log10_likelihood(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Of each sequence of symbols (each has one at least), by the scaled forward recursion over its whole length."""
    order, symbols, edge = _by_time(sequences)
    total = np.zeros(len(sequences))
    a = None
    for t in range(len(edge) - 1):
        n = edge[t + 1] - edge[t]
        e = m.emit[symbols[edge[t] : edge[t + 1]]]
        a = (m.start if a is None else a[:n] @ m.move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


class Counts:
    """Expected counts of Baum-Welch's first step, and the log10-likelihood under the model they were made with."""

    def __init__(self):
        self.start, self.move, self.emit, self.fit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES)), 0.0

    def add(self, m: Model, sequences: list[np.ndarray]) -> None:
        _, symbols, edge = _by_time(sequences)
        # blocks of times with BLOCK symbols at most (one time at least)
        cuts = [0]
        while cuts[-1] < len(edge) - 1:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edge, edge[cuts[-1]] + BLOCK, side="right")) - 1))
        blocks = list(zip(cuts[:-1], cuts[1:], strict=True))

        def forward(low: int, high: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """Scaled weights and scales of the times low to high, from the weights one time before."""
            base = edge[low]
            alpha, scale = np.empty((edge[high] - base, STATES)), np.empty(edge[high] - base)
            for t in range(low, high):
                here, n = slice(edge[t] - base, edge[t + 1] - base), edge[t + 1] - edge[t]
                a = (m.start if before is None else before[:n] @ m.move) * m.emit[symbols[edge[t] : edge[t + 1]]]
                scale[here] = a.sum(axis=1)
                before = alpha[here] = a / scale[here][:, None]
            return alpha, scale

        entry: list[np.ndarray | None] = [None]
        for low, high in blocks[:-1]:
            alpha, _ = forward(low, high, entry[-1])
            entry.append(alpha[edge[high - 1] - edge[low] :].copy())
        beta, pairs = None, np.zeros((STATES, STATES))  # beta: what follows the time after, with its symbols' emissions
        for (low, high), before in zip(reversed(blocks), reversed(entry), strict=True):
            alpha, scale = forward(low, high, before)
            base = edge[low]
            self.fit += float(np.log10(scale).sum())
            for t in range(high - 1, low - 1, -1):
                here, n = slice(edge[t] - base, edge[t + 1] - base), edge[t + 1] - edge[t]
                own, a = np.ones((n, STATES)), alpha[here]
                if beta is not None:
                    pairs += a[: len(beta)].T @ beta
                    own[: len(beta)] = beta @ m.move.T
                beta = m.emit[symbols[edge[t] : edge[t + 1]]] * own / scale[here][:, None]
                a *= own  # from here on the states' weights
            if low == 0:
                self.start += alpha[: edge[1]].sum(axis=0)
            for k in range(STATES):
                self.emit[:, k] += np.bincount(symbols[base : edge[high]], alpha[:, k], minlength=SYMBOLS)
        self.move += pairs * m.move

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        yield 0, 0, self.start
        for i, x in enumerate(self.move):
            yield 1, i, x
        for i in np.flatnonzero(self.emit.any(axis=1)):
            yield 2, int(i), self.emit[i]
        yield 3, 0, np.full(STATES, self.fit)


def improved(m: Model, counts: Counts, share: np.ndarray) -> Model:
    """Baum-Welch's second step; every state keeps a little of every symbol and move."""
    emit = counts.emit + PRIOR * share[:, None]
    move = counts.move + 0.1
    start = counts.start + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index("symbols")).nbytes // 2
        if size >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sequences(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2") for x in t["symbols"]]


def _alike(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences of like lengths together, about BLOCK symbols at a time; a longer one comes alone."""
    some, size = [], 0
    for s in sorted(sequences, key=len):
        if some and size + len(s) > BLOCK:
            yield some
            some, size = [], 0
        some.append(s)
        size += len(s)
    if some:
        yield some


def _count(texts: DataFrame) -> DataFrame:
    """h, cls, n, m: how often each token occurs in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            learned = ~b.column(1).to_numpy(zero_copy_only=False)
            for low, high, data, at in tok.chunks(b.column(2)):
                w, cls = tokens(data, at)
                h, first, back, m = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
                n = np.bincount(back, learned[low:high][w.doc], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls[first].astype(np.int32)), pa.array(n), pa.array(m)], ["h", "cls", "n", "m"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([int(learned.sum())]), pa.array([b.num_rows])], ["h", "cls", "n", "m"])

    return texts.mapInArrow(run, "h long, cls int, n long, m long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"), F.sum("m").alias("m"))


def _size_class(n: str) -> Column:
    """Eighths of powers of two."""
    return F.floor(F.log2(n) * 8)


def _threshold(counts: DataFrame, n: str, most: int) -> int:
    """The least size class such that most rows at most are in it or above; from a histogram of some hundred rows."""
    taken, least = 0, 1 << 20
    for r in sorted(counts.groupBy(_size_class(n).alias("c")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["c"]):
        taken += r["k"]
        if taken > most:
            break
        least = r["c"]
    return least


def train(rows: DataFrame, share: np.ndarray, passes: int = MOST_PASSES) -> Model:
    """A model from rows' symbols: each pass sums the counts of all partitions."""
    m, last = Model.initial(share), None
    names = [f"s{i}" for i in range(STATES)]
    for _ in range(passes):
        shared = rows.sparkSession.sparkContext.broadcast(m)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = Counts()
            for t in _gather(batches):
                for some in _alike(_sequences(t)):
                    counts.add(shared.value, some)
            kind, idx, values = zip(*counts.rows(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(idx, pa.int32()), *(pa.array(c) for c in np.array(values).T)], ["kind", "idx", *names])

        got = rows.where(~F.col("held_out")).select("symbols").mapInArrow(expect, "kind int, idx int, " + ", ".join(f"{n} double" for n in names)).groupBy("kind", "idx").agg(*[F.sum(n).alias(n) for n in names]).collect()  # one row a symbol at most
        counts = Counts()
        for r in got:
            if r["kind"] == 3:
                counts.fit = r["s0"]
            else:
                (counts.start[None], counts.move, counts.emit)[r["kind"]][r["idx"]] = [r[n] for n in names]
        m = improved(m, counts, share)
        shared.destroy()
        if last is not None and counts.fit - last < -GAIN * last:
            break
        last = counts.fit
    return m


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each h is one of the sorted keys, and its value, 0 if it is none."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    found = keys[place] == h
    return found, np.where(found, values[place], 0)


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Learned from rows whose crc32(doc_id as text) mod modulus is not held. A null or empty text is the end alone; a very
    long one is counted, learned from and scored whole. Repeated rows are learned from and scored each by itself. Of
    tokens with nearly equal counts all or none have a symbol of their own, so ties don't depend on order. Without
    training rows all tokens are unknown and base_score is 0. An empty table gives an empty result; other columns,
    whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", (remainder(modulus) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = cut(_count(texts))
    N, V = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    head_class = _threshold(counts, "m", HEAD)
    in_head = _size_class("m") >= head_class
    head = counts.where(in_head).select("h", "n").toArrow()  # HEAD rows at most, as columns: 16 bytes each
    order = np.argsort(head["h"].to_numpy())
    head_h, head_n = head["h"].to_numpy()[order], head["n"].to_numpy()[order]
    trained = counts.where((F.col("n") > 0) & (F.col("h") != F.lit(int(END))))
    top = trained.where(_size_class("n") >= _threshold(trained, "n", OWN)).select("h", "n").toArrow()  # OWN rows at most
    order = np.argsort(top["h"].to_numpy())
    own_h, own_n = top["h"].to_numpy()[order].astype(np.int64), top["n"].to_numpy()[order].astype(np.int64)
    own = spark.createDataFrame([(int(h),) for h in [*own_h, END]], "own long")
    per = {r["cls"]: (r["c"], r["v"]) for r in trained.join(F.broadcast(own), F.col("h") == F.col("own"), "left_anti").groupBy("cls").agg(F.sum("n").alias("c"), F.count("*").alias("v")).collect()}
    room = np.array([sum(per.get(c, (0, 0))) + 1 for c in range(CLASSES)], np.float64)
    ends = next(iter(counts.where(F.col("h") == F.lit(int(END))).select("n").collect()), [0])[0]
    share = np.array([*own_n] + [0] * (OWN - len(own_h)) + [ends] + [per.get(c, (0, 0))[0] for c in range(CLASSES)], np.float64) + 1
    share /= share.sum()
    shared = spark.sparkContext.broadcast((head_h, head_n, own_h, own_n, np.log10(room), int(ends)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_h, head_n, own_h, own_n, log_room, ends = shared.value
        log_end = np.log10(ends + 1)
        for b in batches:
            for low, high, data, at in tok.chunks(b.column(2)):
                w, cls = tokens(data, at)
                h, first, back = np.unique(w.hash.view(np.int64), return_index=True, return_inverse=True)
                known, c = _lookup(head_h, head_n, h)
                is_own, own_c = _lookup(own_h, own_n, h)
                known, c = known | is_own, np.where(is_own, own_c, c)
                mine = np.searchsorted(own_h, h)
                symbol = np.where(is_own, mine, OWN + 1 + cls[first])[back]
                n, firsts = w.texts, w.firsts()
                per_doc = lambda x: np.bincount(w.doc, x, minlength=n).astype(np.float64)
                log_c = np.log10(c + 1)[back]
                in_class = ~is_own[back]
                rest = ~known[back]
                pairs, times = np.unique(np.stack([w.doc[rest], back[rest]]), axis=1, return_counts=True)
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(h[pairs[1]]), pa.array(times.astype(np.int32))], ["h", "times"]))
                u2 = symbol.astype("<u2")
                stop = np.array([OWN], "<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(w.counts() + 1),
                        pa.array(per_doc((c > 0)[back]).astype(np.int64) + (ends > 0)), pa.array(per_doc(log_c) + log_end),
                        pa.array(per_doc(np.where(in_class, log_c - log_room[np.maximum(symbol - OWN - 1, 0)], 0.0))),
                        pa.array([u2[s:e].tobytes() + stop for s, e in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary()), tail,
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols", "tail"],
                )

    rows = cut(texts.mapInArrow(encode, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, within double, symbols binary, tail array<struct<h:bigint,times:int>>")).withColumn("rid", F.monotonically_increasing_id())
    shared.destroy()
    model = spark.sparkContext.broadcast(train(rows, share))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gather(batches):
            yield from t.drop_columns(["symbols"]).append_column("hidden", pa.array(log10_likelihood(model.value, _sequences(t)))).combine_chunks().to_batches()

    scored = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols").mapInArrow(forward, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, within double, hidden double")
    tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.h").alias("h"), F.col("t.times").alias("times"))
    rest = counts.where(~in_head & (F.col("n") > 0)).select("h", "n")
    found = tail.join(rest, "h").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known"))
    more, known = (F.coalesce(F.col(c), F.lit(0)) for c in ("more", "known"))
    return scored.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(N)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(N + V + 1)))).alias("base_score"), (F.col("hidden") + F.col("within") + more).alias("score"),
    )
