"""License scans by diagonal voting.

All rolling K-word hashes of all texts meet the positions of the same hashes in templates in a Spark join. A hash shared
by word p of a text and word q of a template votes for the diagonal p - q; votes are summed by diagonal, neighbouring
diagonals are merged, and each merged span is verified against its template: by the share of the template's words that lie
in runs of K words which the span repeats, so scattered words count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import words as tok
from .common import cut, narrow_batches

K = 3
#: Diagonals at most so far apart belong to one span (words inserted or left out).
DRIFT = 3
#: A span is reported if so large a share of its template's words is in it, in runs of K.
LEAST = 0.7
#: Phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices, as words, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _hashes(text: str) -> np.ndarray:
    data, at = tok.buffer_of(pa.array([text]))
    return tok.split(data, at, tok.ALNUM, tok.LOWER).hash


def template_positions(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """gram, places (template, place): one row for each K-word run of the templates; a few hundred rows, fixed by the templates."""
    places: dict[int, list[tuple[int, int]]] = {}
    for t, (_, text) in enumerate(templates):
        for q, g in enumerate(tok.grams(_hashes(text), K).view(np.int64).tolist()):
            places.setdefault(g, []).append((t, q))
    return spark.createDataFrame(list(places.items()), "gram long, places array<struct<template:int,place:int>>")


def _first_pass(docs: DataFrame) -> DataFrame:
    """What the base columns need, and grams: the hash of each run of K words, by its first word."""
    phrases = [(_hashes(p), label) for p, label in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in tok.chunks(b.column(1)):
                w = tok.split(data, at, tok.ALNUM, tok.LOWER)
                n, firsts = w.texts, w.firsts()
                count, lead, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels = [set() for _ in range(n)]
                for h, label in phrases:
                    k = len(h)
                    if len(w.hash) < k:
                        continue
                    here = w.hash[: len(w.hash) - k + 1] == h[0]
                    for j in range(1, k):
                        here &= w.hash[j : len(w.hash) - k + 1 + j] == h[j]
                    i = np.flatnonzero(here & tok.same_text(w.doc, k))
                    d = w.doc[i]
                    np.add.at(count, d, 1)
                    np.minimum.at(lead, d, i - firsts[d])
                    np.maximum.at(last, d, i - firsts[d])
                    for x in np.unique(d):
                        labels[x].add(label)
                g, m = tok.grams(w.hash, K)[tok.same_text(w.doc, K)], np.maximum(w.counts() - K + 1, 0)
                edge = np.concatenate([[0], np.cumsum(m)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(low, high - low), pa.array(w.counts()), pa.array(count),
                        pa.array(lead, mask=count == 0), pa.array(last, mask=count == 0), pa.array([",".join(sorted(x)) for x in labels]),
                        pa.ListArray.from_arrays(pa.array(edge), pa.array(g.view(np.int64))),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<bigint>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def spans(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs, keyed by rid; verified spans: rid, template, start_word, end_word, share)."""
    spark = docs.sparkSession
    narrow_batches(spark)
    rows = _first_pass(docs).withColumn("rid", F.monotonically_increasing_id())
    # a row of a text without runs of K words comes through with no gram; the base columns stay with a text's first row
    all_ = rows.select("rid", F.struct(*_BASE).alias("base"), F.posexplode_outer("grams").alias("pos", "gram"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    all_ = all_.select("rid", "pos", "gram", F.when(first, F.col("base")).alias("base"))
    joined = all_.join(F.broadcast(template_positions(spark, templates)), "gram", "left").where(F.col("places").isNotNull() | F.col("base").isNotNull())
    joined = cut(joined.select("rid", "pos", "places", "base"))
    rows = joined.where(F.col("base").isNotNull()).select("rid", "base.*")
    votes = joined.where(F.col("places").isNotNull()).select("rid", "pos", F.explode("places").alias("p")).select("rid", "p.template", "p.place", "pos", (F.col("pos") - F.col("p.place")).alias("diagonal"))
    by = votes.groupBy("rid", "template", "diagonal").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("place").alias("places"))  # a template's places at most
    order = W.partitionBy("rid", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int")
    by = by.withColumn("island", F.sum(F.coalesce(new, F.lit(0))).over(order)).withColumn("word", F.explode(F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + K - 1))))))
    lengths = F.array(*[F.lit(len(text.split())) for _, text in templates])
    islands = by.groupBy("rid", "template", "island").agg(F.min("low").alias("start_word"), (F.max("high") + K).alias("end_word"), F.collect_set("word").alias("words"))
    found = islands.withColumn("share", F.size("words") / F.element_at(lengths, F.col("template") + 1)).where(F.col("share") >= LEAST)
    return rows, found.select("rid", "template", "start_word", "end_word", "share")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row of docs.

    score: the largest verified share of a template, 0.5 at least if a base phrase occurs, else 0. A null text counts
    as empty: no words, no labels, score 0. A very long text is scanned whole, and a template that stands in it often votes
    for each place. Repeated rows are scanned each by itself, spans of equal start by end and label; an empty table gives
    an empty result; other columns, whatever their names, are not looked at.
    """
    rows, found = spans(docs, templates)
    names = F.array(*[F.lit(label) for label, _ in templates])
    per = found.groupBy("rid").agg(
        F.collect_set(F.element_at(names, F.col("template") + 1)).alias("named"), F.max("share").alias("share"),
        F.sort_array(F.collect_list(F.struct("start_word", "end_word", F.element_at(names, F.col("template") + 1).alias("label"), "share"))).alias("spans"),
    )
    both = rows.join(per, "rid", "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("named", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "spans",
    )
