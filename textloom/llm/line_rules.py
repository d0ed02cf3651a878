"""Line-first cleaning: every line is judged by rules, failing lines are removed, and a document that loses too much text is rejected.

Rules for a line that has a word (all on whole texts, in numpy):
  punctuation  no sentence mark anywhere in it and fewer than SHORT words
  navigation   a separator | for every three words at most
  boilerplate  one of PHRASES in it
  shouting     more than 60 % capitals among its ASCII letters (6 words at least), or an exclamation mark for every two words
  symbols      a character of [#*$%&|<>] for every two words
  stutter      half of its words equal the word before
  repetition   equal to an earlier line of the document
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tok
from .common import narrow_batches

SHORT = 4
WINDOW = 8
#: A document is rejected if more than this share of its words is in removed lines.
MOST_LOST = 0.5
#: Phrases that mark a line as boilerplate, in lower case.
PHRASES = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "sign up", "log in", "enable javascript", "subscribe to our newsletter", "share this")
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_removed_lines long, lost_words long, base_failed boolean, kept boolean, clean_text string"

_is = {c: np.arange(256) == ord(c) for c in "|!"}
_symbol = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_mark = np.isin(np.arange(256), [ord(c) for c in ".!?;:"])
_upper = np.isin(np.arange(256), np.arange(65, 91))
_letter = _upper | np.isin(np.arange(256), np.arange(97, 123))
_begins = (np.arange(256) & 0xC0) != 0x80


def _between(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[high] - total[low]


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once; whether an equal one stands before it."""
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    later, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = equal
    many[order[1:]] |= equal
    many[order[:-1]] |= equal
    return many, later


def measure(data: np.ndarray, at: np.ndarray, with_text: bool = False) -> dict[str, list | np.ndarray]:
    """The columns of OUT for some texts given as bytes and offsets."""
    n = len(at) - 1
    w = tok.split(data, at)
    per = lambda doc, weights=None: np.bincount(doc, weights, minlength=n).astype(np.int64)
    n_words = w.counts()
    inside = tok.SPACE[data]
    out: dict[str, list | np.ndarray] = {"n_words": n_words, "word_chars": _between(inside & _begins[data], at[:-1], at[1:]), "n_symbols": _between(_symbol[data], at[:-1], at[1:])}

    g = tok.grams(w.hash, WINDOW) ^ tok.mix(w.doc[: max(0, len(w.doc) - WINDOW + 1)] + 1)
    ok = np.flatnonzero(tok.same_text(w.doc, WINDOW))
    twice = ok[_again(g[ok])[0]]
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    out["n_repeat_words"] = per(w.doc[np.cumsum(step[:-1]) > 0])

    lines = tok.split(data, at, tok.NEWLINE)
    first, end = np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)
    has = end > first
    start, stop, doc, first, end = lines.start[has], lines.end[has], lines.doc[has], first[has], end[has]
    repeated = _again(lines.hash[has] ^ tok.mix(doc + 1))[1]
    out["n_dup_lines"] = per(doc[repeated])
    count = end - first
    of = lambda table: _between(table[data], start, stop)
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    stutter = _between(same, np.minimum(first + 1, end), end)
    upper, letters = of(_upper), of(_letter)
    bad = (of(_mark) == 0) & (count < SHORT)
    bad |= 3 * of(_is["|"]) >= count
    bad |= (count >= 6) & (10 * upper > 6 * letters) | (2 * of(_is["!"]) >= count) & (count > 1)
    bad |= 2 * of(_symbol) >= count
    bad |= (count > 3) & (2 * stutter >= count)
    bad |= repeated
    low = tok.LOWER[data].tobytes()
    for phrase in map(str.encode, PHRASES):
        i = low.find(phrase)
        while i >= 0:
            k = np.searchsorted(start, i, side="right") - 1
            if k >= 0 and i + len(phrase) <= stop[k]:
                bad[k] = True
            i = low.find(phrase, i + 1)
    lost = per(doc, np.where(bad, count, 0))
    out["n_lines"], out["n_removed_lines"], out["lost_words"] = per(doc), per(doc[bad]), lost
    out["base_failed"] = (n_words < 20) | (100 * out["n_repeat_words"] > 30 * n_words)
    out["kept"] = ~out["base_failed"] & (lost <= MOST_LOST * n_words)
    if with_text:
        raw, parts = data.tobytes(), [[] for _ in range(n)]
        for s, e, d, b in zip(start.tolist(), stop.tolist(), doc.tolist(), bad.tolist(), strict=True):
            if not b:
                parts[d].append(raw[s:e])
        out["clean_text"] = [b"\n".join(p).decode() for p in parts]
    else:
        out["clean_text"] = pa.nulls(n, pa.string())
    return out


_NAMES = [x.split()[0] for x in OUT.split(", ")]


def judge(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id and the columns of OUT for each row of docs, in one pass over the texts, without a shuffle.

    A null text counts as empty: no words, base_failed, not kept. A very long one is judged whole. Repeated rows are judged
    each by itself; of equal lines of a text the first stays. An empty table gives an empty result. Other columns, whatever
    their names, are not looked at.
    """
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in tok.chunks(b.column(1)):
                got = measure(data, at, with_text)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), *(pa.array(got[k]) for k in _NAMES)], ["doc_id", *_NAMES])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")
