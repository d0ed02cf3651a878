"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of its character n-grams (3 to 5, with marks at its ends) and itself, each hashed to a row of a table of
embeddings; a window of WINDOW words is the average of its words; a linear softmax tells its class. Unseen spellings
share n-gram vectors with seen ones. Insults are a few words of a long text, so windows are classified and a document's
score is that of its worst window. In training each window first has its document's label; in later rounds only those
windows of a toxic document count as toxic that the model finds worst, the others are left out.

Learning uses at most SAMPLE documents of each class, of LARGEST bytes at most each, taken in the order of a digest of
their ids; scores cover all documents, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tok
from .common import id_text, narrow_batches, remainder

#: Documents of each class that are learned from, and the bytes that such a document has at most: what the driver gathers is bounded by both.
SAMPLE, LARGEST = 1200, 1 << 18
#: One in so many of them is held back from training and sets the bias instead.
HELD_BACK = 4
BUCKETS, WIDTH = 1 << 16, 8
WINDOW = 24
EPOCHS, ROUNDS, BATCH = 3, 2, 128
RATE, DECAY = 1.0, 1e-3
#: An n-gram that fewer documents of the sample have keeps a zero vector.
LEAST_DOCS = 3
#: An n-gram that d documents have counts d / (d + SHRINK).
SHRINK = 5
#: What a false alarm weighs, the classes' shares left out, when the bias is set.
FALSE_ALARM = 5
#: A longer run of letters counts as several words of so many bytes, which overlap so that no n-gram is lost.
LONGEST, OVERLAP = 40, 4
U64 = np.uint64
_FACTOR = tok.mix(np.arange(1, 9, dtype=U64) * U64(0x8CB92BA72F3D8DD7)) | U64(1)


def split(data: np.ndarray, at: np.ndarray) -> tok.Words:
    """Runs of letters and digits, A-Z lower-cased; those of over LONGEST bytes (texts without spaces, say) in pieces."""
    w = tok.split(data, at, tok.ALNUM, tok.LOWER)
    size = w.end - w.start
    if not len(size) or size.max() <= LONGEST:
        return w
    n = np.maximum(1, -(-(size - OVERLAP) // (LONGEST - OVERLAP)))
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = w.start[of] + i * (LONGEST - OVERLAP)
    end = np.minimum(start + LONGEST, w.end[of])
    hashes, piece = w.hash[of], n[of] > 1
    length = (end - start)[piece]
    edge = np.concatenate([[0], np.cumsum(length)])
    inner = np.repeat(start[piece] - edge[:-1], length) + np.arange(edge[-1])
    # a piece is not the word that has the same letters: its marks differ
    hashes[piece] = tok.mix(tok.split(w.data[inner], edge, tok.ALNUM).hash + 2 * (i > 0)[piece].astype(U64) + (i < n[of] - 1)[piece].astype(U64))
    return tok.Words(w.data, w.at, hashes, start, end, w.doc[of])


def _cut(w: tok.Words, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a run of letters goes on over these places; before: the byte on the other side of each."""
    inside = (before >= 0) & (before < len(w.data)) & (w.at[np.minimum(np.searchsorted(w.at, at), len(w.at) - 1)] != at)
    return inside & tok.ALNUM[w.data[np.clip(before, 0, len(w.data) - 1)]]


def bags(w: tok.Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in of, bucket) of the n-grams (3 to 5 UTF-8 bytes, with marks at both ends, others where a run was cut) of the words of, and of each word itself."""
    size = w.end[of] - w.start[of]
    edge = np.concatenate([[0], np.cumsum(size + 2)])
    begin = edge[:-1]
    text = np.empty(edge[-1], np.uint8)
    text[begin] = np.where(_cut(w, w.start[of], w.start[of] - 1), 0, ord("<"))
    text[begin + size + 1] = np.where(_cut(w, w.end[of], w.end[of]), 0, ord(">"))
    inner = np.repeat(begin + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text[inner] = w.data[np.repeat(w.start[of] - begin - 1, size) + inner]
    owner = np.repeat(np.arange(len(of), dtype=np.int32), size + 2)
    places, buckets = [np.arange(len(of), dtype=np.int32)], [(w.hash[of] & U64(BUCKETS - 1)).astype(np.int32)]
    for n in (3, 4, 5):
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = sum((text[j : m + j].astype(U64) * _FACTOR[j] for j in range(n)), U64(n))
        ok = owner[:m] == owner[n - 1 :]
        places.append(owner[:m][ok])
        buckets.append((tok.mix(h[ok]) & U64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(places), np.concatenate(buckets)


def _edges(w: tok.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window; a text's windows have WINDOW words, the last the rest."""
    firsts = w.firsts()
    n = -(-np.diff(firsts) // WINDOW)
    doc = np.repeat(np.arange(w.texts), n)
    return firsts[doc] + WINDOW * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), doc


class Model:
    """The trained table times the output vector (all that scores need) and the bias."""

    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias = parts, bias

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The largest window logit of each text; without words that of no evidence."""
        w = split(data, at)
        out = np.full(w.texts, min(self.bias, -1.0))
        if not len(w.hash):
            return out
        _, some, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place, bucket = bags(w, some)
        score = (np.bincount(place, self.parts[bucket], minlength=len(some)) / np.bincount(place, minlength=len(some)))[back]
        first, doc = _edges(w)
        mean = np.add.reduceat(score, first) / np.diff(np.append(first, len(score)))
        best = np.full(w.texts, -np.inf)
        np.maximum.at(best, doc, mean + self.bias)
        return np.where(best > -np.inf, best, out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [self.logits(data, at) for _, _, data, at in tok.chunks(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -500, 500)))


NOTHING = Model(np.zeros(BUCKETS), -4.0)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """A model of labelled texts; without both classes (or without words) it scores every text alike, as not toxic."""
    labels = np.array(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return NOTHING
    rng = np.random.default_rng(seed)
    kept = np.arange(len(labels)) % HELD_BACK != 0
    if len(set(labels[kept].tolist())) < 2 or len(set(labels[~kept].tolist())) < 2:
        kept = np.ones(len(labels), bool)
    w = split(*tok.buffer_of(pa.array([t for t, k in zip(texts, kept, strict=True) if k], pa.string())))
    if not len(w.hash):
        return NOTHING
    y_doc = labels[kept]
    _, some, codes = np.unique(w.hash, return_index=True, return_inverse=True)
    parts = [(place + low, bucket) for low in range(0, len(some), 20_000) for place, bucket in [bags(w, some[low : low + 20_000])]]
    place, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # documents a bucket occurs in
    pairs = np.unique(np.stack([w.doc, codes]), axis=1)
    order = np.argsort(place, kind="stable")
    place, bucket = place[order], bucket[order]
    size = np.bincount(place, minlength=len(some))
    begin = np.cumsum(size) - size
    spread = lambda c: (np.repeat(begin[c] - (np.cumsum(size[c]) - size[c]), size[c]) + np.arange(size[c].sum()))
    spread_over = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(y_doc), 100):  # some documents at a time: a text has many n-grams
        some_pairs = pairs[:, np.searchsorted(pairs[0], low) : np.searchsorted(pairs[0], low + 100)]
        seen = np.unique(np.repeat(some_pairs[0] - low, size[some_pairs[1]]) * BUCKETS + bucket[spread(some_pairs[1])])
        spread_over += np.bincount(seen % BUCKETS, minlength=BUCKETS)
    live = spread_over >= LEAST_DOCS
    first, owner = _edges(w)
    length = np.diff(np.append(first, len(codes)))
    e = np.zeros((BUCKETS, WIDTH), np.float32)
    out, bias = rng.uniform(-1, 1, WIDTH).astype(np.float32), -2.0
    y, use = y_doc[owner].astype(np.float32), np.ones(len(first), bool)
    # AdaGrad: rare n-grams keep a large step
    e2, out2, bias2 = np.full((BUCKETS, WIDTH), 1e-4, np.float32), np.full(WIDTH, 1e-2, np.float32), 1e-2

    def averages(idx: np.ndarray):
        n = length[idx]
        words = codes[np.repeat(first[idx] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        unique, inverse = np.unique(words, return_inverse=True)
        grams = bucket[spread(unique)]
        vectors = np.add.reduceat(e[grams], np.cumsum(size[unique]) - size[unique], axis=0) / size[unique][:, None]
        return n, unique, inverse, grams, np.add.reduceat(vectors[inverse], np.cumsum(n) - n, axis=0) / n[:, None]

    for turn in range(ROUNDS):
        if turn:
            score = np.concatenate([averages(np.arange(i, min(len(first), i + 2048)))[-1] @ out + bias for i in range(0, len(first), 2048)])
            best = np.full(len(y_doc), -np.inf)
            np.maximum.at(best, owner, score)
            toxic = y_doc[owner] == 1
            hot = toxic & ((score >= best[owner] - 1e-6) | (score > 0))
            y, use = hot.astype(np.float32), ~toxic | hot
        share = max(1e-3, float(y[use].mean()))
        balance = np.where(y == 1, max(1.0, min(20.0, 0.25 / share)), 1.0).astype(np.float32)
        for _ in range(EPOCHS):
            shuffled = rng.permutation(np.flatnonzero(use))
            for i in range(0, len(shuffled), BATCH):
                idx = shuffled[i : i + BATCH]
                n, unique, inverse, grams, mean = averages(idx)
                g = (1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30))) - y[idx]) * balance[idx]
                g_out, g_bias = mean.T @ g / len(idx), float(g.mean())
                g_word = np.bincount(inverse, np.repeat(g / n, n), minlength=len(unique))
                rows, back = np.unique(grams, return_inverse=True)
                g_row = np.bincount(back, np.repeat(g_word / size[unique], size[unique]), minlength=len(rows))
                rows, g_row = rows[live[rows]], g_row[live[rows]]
                step = g_row[:, None] * out[None, :] + DECAY * 0.01 * e[rows]
                e2[rows] += step**2
                e[rows] -= RATE * step / np.sqrt(e2[rows])
                out2 += g_out**2
                out -= 0.05 * g_out / np.sqrt(out2)
                bias2 += g_bias**2
                bias -= 0.05 * g_bias / np.sqrt(bias2)
    model = Model(e @ out.astype(np.float64) * (spread_over / (spread_over + SHRINK)), bias)
    # the bias that tells the held-back documents best apart: a document is judged by its worst window, which windows' own bias can't foresee
    back = ~kept if not kept.all() else kept
    z = np.concatenate([model.logits(d, a) for _, _, d, a in tok.chunks(pa.array([t for t, k in zip(texts, back, strict=True) if k], pa.string()))])
    truth = labels[back]
    order = np.argsort(z)
    z, truth = z[order], truth[order]
    # a clean document that is rejected weighs FALSE_ALARM times a toxic one that is missed
    right = FALSE_ALARM * np.concatenate([[0], np.cumsum(truth == 0)]) / max(1, (truth == 0).sum()) + (truth.sum() - np.concatenate([[0], np.cumsum(truth)])) / max(1, truth.sum())
    best = np.flatnonzero(right >= right.max() - 1e-12)
    bounds = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    middle = best[len(best) // 2]
    model.bias -= float((bounds[middle] + bounds[middle + 1]) / 2)
    return model


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> Model:
    """A model from labelled documents whose crc32(doc_id as text) mod modulus is not 0, SAMPLE of each class at most.

    The sample is the least of a digest of the ids. A limit on the digest, from the number of labels, leaves few rows to
    be ordered; as that limit only cuts the end of the same order, the sample is the same without it.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(modulus) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("order", F.xxhash64(id_text()))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    take = []
    for c in (0, 1):
        # twice the share that is wanted, and some: that fewer than SAMPLE are left has no chance worth counting
        share = min(1.0, (2 * SAMPLE + 100) / max(1, counts.get(c, 0)))
        low = known.where((F.col("toxic") == c) & (F.col("order") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1025)))))
        take.append(low.orderBy("order", "doc_id").limit(SAMPLE))
    sample = F.broadcast(take[0].union(take[1]).select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label")))  # 2 * SAMPLE rows at most
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LARGEST)
    rows = short.join(sample, F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).orderBy("label_id").toArrow()
    return train(rows["text"].to_pylist(), [int(x) for x in rows["label"].to_pylist()])


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, in one pass over whole texts after training.

    A null or wordless text gets the score of no evidence (below 0.5); a very long one is scored whole, and has the score
    of its worst window. Of a document's several labels the largest counts, of several texts of one labelled id the
    smallest; unlabelled rows, null labels and null ids are not learned from (a null id counts as the empty text in
    held_out). With labels of one class only, or none, every score is the same and below 0.5. Equal texts get equal
    scores; an empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    narrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, modulus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), (remainder(modulus) == 0).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with docs' own columns, whatever their names. Texts are not shuffled.

    Null, empty, very long and repeated texts are judged as score() scores them; an empty table gives an empty result.
    """
    narrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(pa.array(text, pa.string(), from_pandas=True)))

    return docs.where(toxic(F.col("text").cast("string")) < 0.5)
