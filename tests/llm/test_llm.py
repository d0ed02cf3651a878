"""Each operator against brute force, on small tables with nulls, empty and long texts, repeated rows, ties and clashing columns."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import bktree, common, hmm, jpeg, licenses, line_rules, mixing, packing, simhash, suffixes, toxicity, warc
from textloom.llm import words as tok

rng = random.Random(5)
VOCABULARY = [f"wort{i}" for i in range(3000)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = text(60)
TEXTS = [
    None, "", "   \n\t", "one", "a b", "Éa\x1cb \x85c", "MIT License MIT license", "x\n\nx\nx y\nx", "<|endoftext|> is text", "the the the the the the the the the the " * 5,
    text(300) + " " + PASSAGE + " " + text(20), PASSAGE, text(5) + " " + PASSAGE, text(20000), "released under the mit license.", "home | about | help | contact",
]
TEXTS += [TEXTS[10], TEXTS[13][:-1], TEXTS[3], text(200)]
LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i, 0.5, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[1]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score double, k string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_long_words_and_lines_have_hashes_of_their_own():
    h = lambda t: tok.split(*tok.buffer_of(pa.array([t]))).hash.tolist()
    n = 1 << 16
    assert len({h(x)[0] for x in ("a" * n + "b", "b" + "a" * n, "a" * (n + 1), "a" * (n - 1) + "ba", "ab" + "a" * (n - 1))}) == 5
    assert h("x " + "a" * n + "b")[1] == h("a" * n + "b")[0] and h("short")[0] == h("short " + "a" * (2 * n))[0]
    r = random.Random(1)
    line = "".join(r.choice("abcdef ") for _ in range(80_000))
    other = line[n] + line[1:n] + line[0] + line[n + 1 :]
    got = line_rules.measure(*tok.buffer_of(pa.array([f"{line}\n{other}\n{line}" if line != other else ""])))
    assert got["n_dup_lines"].tolist() == [1]


def test_words():
    data, at = tok.buffer_of(pa.array(TEXTS))
    w = tok.split(data, at)
    assert [[bytes(data[s:e]).decode() for s, e, d in zip(w.start, w.end, w.doc) if d == i] for i in range(4)] == [WORD.findall(t or "") for t in TEXTS[:4]]
    assert w.counts().tolist() == [len(WORD.findall(t or "")) for t in TEXTS]
    for low, high, d, a in tok.chunks(pa.array(TEXTS), 1000):
        assert tok.split(d, a).counts().tolist() == w.counts()[low:high].tolist()


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 3 * got["size"]).all()
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.sql(mixing.mix_sql()).df()
    assert list(got.columns) == list(want.columns) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    again = mixing.mix(docs.repartition(2)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    assert mixing.mix(empty).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and mixing.take(empty).count() == 0
    words = lambda df: df.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words(taken) == got["taken"].sum()


def test_mixing_numbers_many_sources_over_the_cluster(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "SOURCES", 1)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want


def test_mixing_draws_with_the_stated_probabilities(spark):
    """The share drawn of each size class is its inclusion probability, which is proportional to the binary digits of sizes."""
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([3, 6, 12, 25, 50])), "a") for i in range(20_000)] + [(10**6 + i, "w " * 40, "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing._sized(df, "source", "text", "doc_id").drop("text").cache()
    per, classes, few = mixing.plan(sized)
    chance = {(c["s_source"], c["s_digits"]): c["p"] for c in classes.collect()}
    p = [chance["a", d] / d for d in (2, 3, 4, 5, 6)]
    assert max(p) - min(p) < 1e-12 and 0 < p[0] < 1 / 6
    copies = per.where("s_source = 'a'").first()["copies"]
    for x in mixing._copies(sized, per, classes, few).where("source = 'a'").groupBy("digits").agg(F.avg(F.col("times") - copies).alias("share"), F.count("*").alias("n")).collect():
        q = chance["a", x["digits"]]
        assert abs(x["share"] - q) < 4 * math.sqrt(q * (1 - q) / x["n"]) + 0.003


def test_mixing_takes_certain_documents_first(spark):
    rows = [(i, "w " * 2, "a") for i in range(50)] + [(100, "w " * 4000, "a")] + [(200 + i, "w " * 1000, "b") for i in range(9)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # the target is 4367 of 4100 words: a whole copy of each, and 267 words of the small ones
    assert got[100]["taken"] == 4000 and sum(r["taken"] for i, r in got.items() if i < 200) in range(4100, 4368)


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "abcde"[min(4, i % 9)]) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    m = got.merge(spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source").toPandas())
    by = m.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by["taken"] - by["target"]) <= 3).all() and abs(by["target"].sum() - by["size"].sum()) < 1e-6
    assert (by["target"] <= 3 * by["size"] + 1e-9).all()


def test_suffixes(spark, docs, empty):
    got = suffixes.passages(docs).collect()
    grams, covered, found = defaultdict(set), defaultdict(set), defaultdict(set)
    split = {i: WORD.findall(t or "") for i, t in enumerate(TEXTS)}
    for i, w in split.items():
        for j in range(len(w) - 49):
            grams[tuple(w[j : j + 50])].add(i)
    for i, w in split.items():
        for j in range(len(w) - 49):
            if len(grams[tuple(w[j : j + 50])]) > 1:
                covered[i].update(range(j, j + 50))
    for r in got:
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert found == covered and suffixes.passages(empty).count() == 0
    left = suffixes.dedup(docs)
    assert left.columns == docs.columns and suffixes.dedup(empty).count() == 0
    rest = by_id(left)
    assert {i for i in range(len(TEXTS)) if not covered[i]} <= set(rest)
    assert PASSAGE in rest[10]["text"] and all(PASSAGE not in (rest[i]["text"] or "") for i in rest if i != 10)
    assert all(r["n_chars"] == len(r["text"] or "") for r in rest.values())


def test_suffixes_across_partitions(spark, monkeypatch):
    rows = [(i, f"{text(3)} {PASSAGE} {text(2)}") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.passages(df).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["doc_id"] for r in got} == set(range(300)) and {r["doc_id"] for r in got if r["redundant"]} == set(range(1, 300))


def _redundant(rows):
    """Words of each document in windows of 50 words that a smaller document has."""
    low, out = {}, defaultdict(set)
    split = {i: WORD.findall(t) for i, t in rows}
    for i in sorted(split):
        for j in range(len(split[i]) - 49):
            if low.setdefault(tuple(split[i][j : j + 50]), i) != i:
                out[i].update(range(j, j + 50))
    return out


def _found(spark, rows):
    out = defaultdict(set)
    for r in suffixes.passages(spark.createDataFrame(rows, "doc_id long, text string")).where("redundant").collect():
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return out


def _one_least(n, low, high):
    """n words all of whose windows have the same least run of 25 words, and where it begins, from low to high."""
    while True:
        t = text(n)
        g = tok.grams(tok.split(*tok.buffer_of(pa.array([t]))).hash, 25)
        if len({i + int(g[i : i + 26].argmin()) for i in range(len(g) - 25)}) == 1 and low <= int(g.argmin()) <= high:
            return t.split(), int(g.argmin())


def test_suffixes_keep_one_place_of_a_quoted_passage(spark):
    """A smaller document that quotes a part of a passage leaves one whole copy only."""
    words, i = _one_least(60, 10, 25)
    rows = [(0, f"{text(30)} {' '.join(words[i - 5 : i + 30])} {text(30)}")] + [(j, f"{text(30)} {' '.join(words)} {text(30)}") for j in range(1, 400)]
    found = _found(spark, rows)
    assert found == _redundant(rows) and set(found) == set(range(2, 400))


def test_suffixes_in_small_batches(monkeypatch):
    r = np.random.default_rng(3)
    n = 3000
    t = pa.table({"doc_id": r.integers(0, 40, n), "m": np.sort(r.integers(0, 30, n)), "h": r.integers(0, 3, n), "pos": pa.array(r.integers(0, 5000, n), pa.int32())})
    t = t.append_column("k", t["doc_id"]).select(["doc_id", "k", "m", "h", "pos"]).sort_by([(c, "ascending") for c in ("m", "h", "doc_id", "k", "pos")])
    least = {(x["m"], x["h"]): x["doc_id"] for x in reversed(t.to_pylist())}
    count = {key: {x["k"] for x in t.to_pylist() if (x["m"], x["h"]) == key} for key in least}
    want = {(x["k"], x["pos"] + j, x["doc_id"] != least[x["m"], x["h"]]) for x in t.to_pylist() if len(count[x["m"], x["h"]]) > 1 for j in range(50)}
    for size in (200_000, 70):
        monkeypatch.setattr(suffixes, "BATCH", size)
        got = pa.Table.from_batches(suffixes._compare(iter(t.to_batches(64)))).to_pylist()
        assert {(x["k"], w, x["redundant"]) for x in got if x["side"] != 1 for w in range(x["start"], x["end"])} == want
        assert sum(x["side"] == 1 for x in got) == 2


def test_suffixes_of_one_repeated_word(spark):
    """A run of one word is found to its end, also where the text before it ends with the same word."""
    same = " ".join(["0"] * 1000)
    for rows in ([(1, same), (2, same)], [(1, text(60) + " 0"), (2, same), (3, text(60) + " 0"), (4, same)], [(1, f"{text(20)} {same} {text(9)}"), (2, f"{text(70)} {same} {text(3)}")]):
        found = _found(spark, rows)
        assert found == _redundant(rows) and max(map(len, found.values())) == 1000


def test_suffixes_find_a_passage_behind_longer_one_sided_matches(spark):
    """Passages of 50 words exactly, of whose middle others share more on one side and less than 50 in all."""
    parts, whole = [], []
    for _ in range(20):
        words, i = _one_least(50, 10, 15)
        for before, after in ((text(30), text(30)), (text(30), text(30))):
            whole.append(f"{before} {' '.join(words)} {after}")
            parts.append(f"{text(20)} {' '.join([*before.split()[-8:], *words[: i + 25]])} {text(20)}")
            parts.append(f"{text(20)} {' '.join([*words[i:], *after.split()[:8]])} {text(20)}")
    rows = list(enumerate(parts + whole))
    found = _found(spark, rows)
    assert found == _redundant(rows) and len(found) == 20


def test_licenses(spark, docs, empty):
    got = by_id(licenses.scan(docs))
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW(t))
        at = [(j, name) for p, name in licenses.BASE for q in [p.split()] for j in range(len(w)) if w[j : j + len(q)] == q]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)) and r["base_labels"] == ",".join(sorted({n for _, n in at}))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r["score"] <= 1
    assert got[14]["labels"] == "mit" and got[14]["score"] == 1.0 and licenses.scan(empty).count() == 0
    changed = spark.createDataFrame([(1, "redistribution and use in source or binary forms with or without any modification are permitted provided that the following conditions are met")], "doc_id long, text string")
    assert licenses.scan(changed).first()["labels"] == "bsd"


def _slow_license_shares(t, templates):
    """(template, start, end, share) of islands of diagonals, a word at a time."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW(t))
    out = set()
    for k, (_, text_) in enumerate(templates):
        v = text_.split()
        votes = defaultdict(list)
        for p in range(len(w) - 2):
            for q in range(len(v) - 2):
                if w[p : p + 3] == v[q : q + 3]:
                    votes[p - q].append((p, q))
        island, last = [], None
        for d in [*sorted(votes), None]:
            if last is not None and (d is None or d - last > licenses.DRIFT):
                words = {q + i for _, q in island for i in range(3)}
                if len(words) / len(v) >= licenses.LEAST:
                    out.add((k, min(p for p, _ in island), max(p for p, _ in island) + 3, round(len(words) / len(v), 9)))
                island = []
            island += votes[d] if d is not None else []
            last = d
    return out


def test_licenses_against_a_slow_scan(spark):
    r = random.Random(4)
    texts = ["", "a b", None]
    for i in range(80):
        words = text(r.randrange(0, 20)).split()
        for _ in range(r.randrange(1, 4)):
            t = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.randrange(0, 5)):
                j = r.randrange(len(t))
                t[j : j + 1] = r.choice([[], ["new"], [t[j], "more"], [t[j].upper() + ","]])
            words += t + text(r.randrange(0, 6)).split()
        texts.append(r.choice([" ", "\n", " - "]).join(words))
    rows, found = licenses.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {x["rid"]: x["doc_id"] for x in rows.collect()}
    got = defaultdict(set)
    for x in found.collect():
        got[ids[x["rid"]]].add((x["template"], x["start_word"], x["end_word"], round(x["share"], 9)))
    assert sorted(ids.values()) == list(range(len(texts)))
    assert dict(got) == {i: s for i, t in enumerate(texts) if (s := _slow_license_shares(t, licenses.TEMPLATES))}
    scattered = " the ".join(licenses.TEMPLATES[1][1].split())
    assert licenses.scan(spark.createDataFrame([(1, scattered)], "doc_id long, text string")).first()["labels"] == ""


def test_jpeg(docs, empty):
    got = by_id(jpeg.features(jpeg.store(docs)))
    for i, t in enumerate(TEXTS):
        p = jpeg.padded((t or "").encode())
        import hashlib

        assert got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(p[-32:])
        assert got[i]["payload_bytes"] == len(p) and got[i]["n_bytes"] == len((t or "").encode())
    assert got[10]["media_sha256"] == got[16]["media_sha256"] and jpeg.features(jpeg.store(empty)).count() == 0
    for p in (os.urandom(576), b"\xff" * 1152, os.urandom(576 * 900)):
        f = jpeg.encode_all([p])
        h = [jpeg.parse(x) for x in f]
        assert jpeg.payload_of(h[0], jpeg.decode_all(f, h)[0]) == p
    with pytest.raises(ValueError):
        jpeg.parse(b"no picture")


def test_thumbnail_hashes_see_every_sample():
    """Means of areas, by fractions; samples that no grid of points meets count."""
    r = np.random.default_rng(4)
    for shape in ((800, 3), (16, 18), (5, 7), (1, 1)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        want = []
        for columns in (8, 9):
            big = np.kron(image.astype(np.int64), np.ones((8, columns), np.int64))
            want.append(big.reshape(8, shape[0], columns, shape[1]).sum(axis=(1, 3)))
        a, d = want
        assert jpeg.thumbnail_hashes(image) == (np.packbits(a * 64 > a.sum()).tobytes().hex(), np.packbits(d[:, 1:] > d[:, :-1]).tobytes().hex())
    image = np.full((800, 3), 100, np.uint8)
    other = image.copy()
    other[1:100] = 0
    assert jpeg.thumbnail_hashes(image) != jpeg.thumbnail_hashes(other)


def _slow_jpeg(data):
    """A symbol at a time, for grey images: coefficients of each block."""
    h = jpeg.parse(data)
    codes = {}
    for t, table in h.tables.items():
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                codes[t, n, code] = table[k]
                code, k = code + 1, k + 1
            code <<= 1
    raw = data[h.scan[0] : h.scan[1]]
    parts = re.split(rb"\xff[\xd0-\xd7]", raw)
    out = []
    for part in parts:
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        at, dc = 0, 0

        def symbol(t):
            nonlocal at
            for n in range(1, 17):
                if (t, n, int(bits[at : at + n], 2)) in codes:
                    s = codes[t, n, int(bits[at : at + n], 2)]
                    at += n
                    return s

        def value(s):
            nonlocal at
            v = int(bits[at : at + s], 2) if s else 0
            at += s
            return v if not s or v >> (s - 1) else v - (1 << s) + 1

        for _ in range(h.interval or h.units[0] * h.units[1]):
            block, k = [0] * 64, 1
            dc += value(symbol(0))
            block[0] = dc
            while k < 64:
                s = symbol(0x10)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            out.append(block)
    return np.array(out)


def test_jpeg_decodes_other_tables():
    """A file with runs, ends of blocks and differences of DC, and no restarts."""
    table = lambda kind, symbols: b"\xff\xc4" + (19 + len(symbols)).to_bytes(2) + bytes([kind, 0, 0, 0, len(symbols)] + [0] * 12) + bytes(symbols)
    dc, ac = [0, 1, 2, 3, 4, 5], [0x00, 0xF0, 0x01, 0x02, 0x11, 0x23]
    r, bits = random.Random(2), ""
    code = lambda t, s: f"{t.index(s):04b}"
    for _ in range(6):
        s = r.choice(dc)
        bits += code(dc, s) + "".join(r.choice("01") for _ in range(s))
        k = 1
        while k < 64:
            s = r.choice(ac if k < 30 else [0x00, 0x01, 0x11])
            if s >> 4 and k + (s >> 4) > 60 or s == 0:
                bits += code(ac, 0)
                break
            bits += code(ac, s) + "".join(r.choice("01") for _ in range(s & 15))
            k += (s >> 4) + 1
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + jpeg._DQT + b"\xff\xc0" + bytes([0, 11, 8, 0, 16, 0, 24, 1, 1, 0x11, 0]) + table(0, dc) + table(0x10, ac) + jpeg._SOS
    data = head + scan + b"\xff\xd9"
    h = jpeg.parse(data)
    got = jpeg.decode_all([data], [h])[0]
    assert (got == _slow_jpeg(data)).all() and jpeg.luminance(h, got).shape == (2, 3)


def test_toxicity(spark, docs, empty):
    bad = ["zorgle", "blarp", "fnoot"]
    rows = [(i, text(60) + (" " + rng.choice(bad) + " " + rng.choice(bad) if i % 3 == 0 else "") + " " + text(10), int(i % 3 == 0)) for i in range(600)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic"), spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, lab).toPandas().merge(lab.toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    model = toxicity.learn(df, lab)
    low, high = model.scores(pa.array(["wort1 wort2 wort3 wort4 wort5 wort6", "wort1 wort2 zorrgle wort4 wort5 wort6"]))
    assert high > low  # an unseen spelling
    none = toxicity.score(docs, lab.where("false")).collect()
    assert len(none) == docs.count() and all(r["predicted"] == 0 for r in none)
    assert toxicity.score(empty, lab).count() == 0
    kept = toxicity.keep(docs, lab.where("false"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def _slow_logit(model, t):
    """A window's mean over its words of the mean part of their n-grams, a letter at a time; the largest counts."""
    mask = (1 << 64) - 1

    def mix(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * c & mask
        return x ^ x >> 33

    factors = [mix(i * 0x8CB92BA72F3D8DD7 & mask) | 1 for i in range(1, 9)]
    words = re.findall(rb"[0-9a-z\x80-\xff]+", LOW(t).encode())
    if not words:
        return min(model.bias, -1.0)
    value = []
    for w in words:
        assert len(w) <= toxicity.LONGEST
        own = int(tok.split(*tok.buffer_of(pa.array([w.decode()])), tok.ALNUM).hash[0])
        marked, buckets = b"<" + w + b">", [own & toxicity.BUCKETS - 1]
        for n in (3, 4, 5):
            buckets += [mix(n + sum(c * f for c, f in zip(marked[i : i + n], factors)) & mask) & toxicity.BUCKETS - 1 for i in range(len(marked) - n + 1)]
        value.append(sum(model.parts[b] for b in buckets) / len(buckets))
    return max(sum(v) / len(v) for i in range(0, len(value), toxicity.WINDOW) for v in [value[i : i + toxicity.WINDOW]]) + model.bias


def test_toxicity_scores_against_a_slow_model():
    r = np.random.default_rng(6)
    model = toxicity.Model(r.normal(0, 1, toxicity.BUCKETS), -0.3)
    texts = ["Ein Wörtchen, a WORD, x9", "", None, "...", "b", text(200), "日本 語", "a-b" * 5, TEXTS[10]]
    got = np.concatenate([model.logits(d, a) for _, _, d, a in tok.chunks(pa.array(texts))])
    assert np.allclose(got, [_slow_logit(model, t) for t in texts])


def test_toxicity_learns_from_a_stated_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    monkeypatch.setattr(toxicity, "LARGEST", 50)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, seed=7: seen.append(sorted(zip(texts, labels))) or toxicity.NOTHING)
    docs = spark.createDataFrame([(i, f"t{i}" + "x" * (60 if i % 50 == 7 else 0)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(4000)], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    order = labels.where(common.remainder(5) != 0).withColumn("o", F.xxhash64(common.id_text())).orderBy("o").collect()
    want = [r for c in (0, 1) for r in [r for r in order if r["toxic"] == c][:5]]
    assert seen == [sorted((f"t{r['doc_id']}", r["toxic"]) for r in want if r["doc_id"] % 50 != 7)]


def test_toxicity_of_long_runs_of_letters():
    """Texts without spaces count to their end, and so does what stands behind 40 bytes of other letters."""
    r = random.Random(9)
    chars = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    run = lambda n: "".join(r.choice(chars) for _ in range(n))
    made = [(run(60) + (chr(0x6000) + chr(0x6001) + chr(0x6002) if i % 2 else "") + run(20), i % 2) for i in range(400)]
    model = toxicity.train([x for x, _ in made[:300]], [y for _, y in made[:300]])
    got = model.scores(pa.array([x for x, _ in made[300:]])) >= 0.5
    assert (got == np.array([y for _, y in made[300:]])).mean() > 0.9
    w = toxicity.split(*tok.buffer_of(pa.array(["a" * 40, "b" * 41, "c" * 500 + " d", "e" * 36, "e" * 44])))
    assert (w.end - w.start).max() == 40 and w.counts().tolist() == [1, 2, 15, 1, 2]
    # every n-gram of five letters is in some piece
    word = "".join(r.choice("abcdefgh") for _ in range(333))
    w = toxicity.split(*tok.buffer_of(pa.array([word])))
    pieces = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)]
    assert {word[i : i + 5] for i in range(329)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}


def test_bktree():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]]))
    cuts = np.array([0, 10, 11, 60])
    label = bktree.components(prints, cuts, 2)
    group = np.searchsorted(cuts, np.arange(len(prints)), side="right")
    want = np.arange(len(prints))
    for _ in range(20):
        for i in range(len(prints)):
            near = (np.bitwise_count(prints ^ prints[i]) <= 2) & (group == group[i])
            want[near] = want[near].min()
    assert (label == want).all()


def _fingerprint(t, k=3):
    w = WORD.findall(LOW(t))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("shard", [20_000, 3])
def test_simhash(spark, docs, empty, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    base = [text(80) for _ in range(30)]
    more = [(100 + i, " ".join(w if rng.random() > 0.02 else "other" for w in base[i % 30].split())) for i in range(150)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = df.collect()
    prints = [_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r["doc_id"])
    want = sorted((r["doc_id"], prints[i], least[find(i)]) for i, r in enumerate(rows))
    got = sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.classes(df).collect())
    assert got == want and simhash.classes(empty).count() == 0


def test_near_copies(spark, docs, empty):
    base = [text(100) for _ in range(20)]
    edit = lambda t: " ".join("changed" if i in (20, 60) else w for i, w in enumerate(t.split()))
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edit(t)) for i, t in enumerate(base)] + [(200, base[0])]
    kept = sorted(r["doc_id"] for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(20))
    left = simhash.dedup(docs)
    assert left.columns == docs.columns and simhash.dedup(empty).count() == 0
    # without words: one stays; a copy, a near copy, and a passage with a few words before it go
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(len(TEXTS)) if i not in (1, 2, 12, 16, 17, 18)]


def _similar_groups(rows, least=0.8, k=5):
    """doc_id of the group of each row, by comparing all sets of shingles."""
    sets = []
    for _, t in rows:
        w = WORD.findall(LOW(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a and not b or len(a & b) >= least * len(a | b) and a:
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        group[find(i)].append(d)
    return {min(g) for g in group.values()}


@pytest.mark.parametrize("shard", [20_000, 8, 2])
def test_near_copies_against_all_pairs(spark, monkeypatch, shard):
    """Chains of edits whose similarities lie on both sides of the threshold."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    r, rows = random.Random(11), []
    for i in range(40):
        words = text(r.choice([60, 150, 400])).split()
        for j in range(5):
            rows.append((100 * i + j, " ".join(words)))
            for _ in range(r.randrange(0, max(2, len(words) // 20))):
                words[r.randrange(len(words))] = r.choice(VOCABULARY)
    rows += [(9000, ""), (9001, None), (9002, "two words"), (9003, "Two  words"), (9004, "three words here")]
    kept = {x["doc_id"] for x in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _similar_groups(rows)
    # one in a thousand pairs at the threshold meets in no band
    assert len(kept ^ want) <= 1 and want <= kept and len(want) > 60


def test_near_copies_with_repeated_lines(spark):
    """Texts with one set of shingles, of which one repeats a line, are near copies."""
    rows = []
    for i in range(30):
        body, line = text(100), text(10)
        rows += [(i, f"{body} {line} {line}"), (100 + i, f"{body} " + " ".join([line] * 40))]
    kept = sorted(r["doc_id"] for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(30))


def test_connected(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)]
    got = {r["id"]: r["root"] for r in simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


@pytest.mark.parametrize("most", [100_000, 0])
def test_warc(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    big = "é" * 600
    rows = [(1, "u1", "x"), (2, "u\r\n2", None), (3, None, big), (4, "u", big), (9, "u", big), (5, "u", "x"), (6, "u", ""), (None, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted(map(tuple, warc.archived(pages).collect()), key=str)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages(page_id BIGINT, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", [(r[0], r[2]) for r in rows])
    assert got == sorted(db.sql(warc.SQL).fetchall(), key=str)
    assert warc.archived(pages.where("false")).count() == 0


def test_warc_pushes_down(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "long" * 300) for i in range(3)], "page_id long, url string, html string")
    warc.store(pages, f"file://{tmp_path}/w")
    found = spark.read.format("warc").load(f"file://{tmp_path}/w").where("record_type = 'revisit' and page_id = '1'")
    assert [(r["target_uri"], r["refers_to"], r["payload"]) for r in found.collect()] == [("u1", "2", None)]
    import io

    with open(next((tmp_path / "w").glob("*.warc")), "rb") as f:
        raw = f.read()
    assert all(p is None for _, p in warc.records(io.BytesIO(raw), wants_payload=False))
    response = warc.record_bytes("response", 1, "u", "d", 8, None, b"longlong")
    for cut in (response[:-1], response[:-7], raw + response[:-30]):
        for wants in (True, False):
            with pytest.raises(ValueError, match="ends before"):
                list(warc.records(io.BytesIO(cut), wants, keep=lambda h: wants or h["warc-type"] != "response"))
    with pytest.raises(ValueError, match="version"):
        list(warc.records(io.BytesIO(b"junk\r\n"), True))


def test_best_fit():
    sizes = np.array([rng.randrange(1, 1024) for _ in range(3000)])
    bins, offsets = packing.best_fit(sizes)
    assert (np.bincount(bins, sizes) <= 1024).all()
    for k in range(bins.max() + 1):
        own = sorted(zip(offsets[bins == k], sizes[bins == k]))
        assert [o for o, _ in own] == list(np.cumsum([0] + [s for _, s in own[:-1]]))
    assert packing.lower_bound(sizes) <= bins.max() + 1 <= 1.02 * packing.lower_bound(sizes) + 1
    assert packing.lower_bound(np.array([600] * 7)) == 7 and packing.lower_bound(np.array([400] * 5)) == 3


def test_packed_partitions():
    """Exchange between bins saves what best-fit decreasing wastes; the bound holds and offsets have no gaps."""
    r = np.random.default_rng(0)
    saved = 0
    for sizes in (np.clip(np.random.default_rng(3).lognormal(4.5, 1.2, 6000).astype(int) + 1, 1, 1023), r.integers(1, 1024, 300), np.array([1023]), np.array([342, 342, 342, 340, 340, 340] * 40), np.zeros(0, np.int64)):
        bins, offsets, certified = packing.packed(sizes)
        n = len(np.unique(bins))
        assert n == (bins.max() + 1 if len(bins) else 0) and certified == (n <= packing.lower_bound(sizes))
        for k in range(0, n, 101):
            own = sorted(zip(offsets[bins == k], sizes[bins == k]))
            assert [o for o, _ in own] == list(np.cumsum([0] + [s for _, s in own[:-1]])) and sum(s for _, s in own) <= 1024
        if len(sizes):
            first = packing.best_fit(sizes)[0].max() + 1
            assert n <= first
            saved += first - n
    assert saved > 0
    assert sum([5, 3, 9][i] for i in packing.fullest([5, 3, 9], 13)) == 12 and packing.fullest([7], 5) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_ids_are_those_of_the_tokenizer():
    import duckdb as db
    from tokenizers import Tokenizer

    texts = [x for (x,) in db.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    ids, slow = packing.Ids(packing.default_tokenizer(), packing.default_ranks()), Tokenizer.from_file(packing.default_tokenizer())
    assert all(ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("part", [50_000, 5])
def test_packing(spark, docs, empty, monkeypatch, part):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART", part)
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(TEXTS)}
    rows = packing.pack(docs).collect()
    seen, pieces = defaultdict(list), Counter()
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and len(own) == r["length"] <= 1024
        assert r["piece"] == 0 or r["length"] == 1024
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["length"]
    for s in seen.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    assert pieces == Counter({i: len(x) * (2 if i in (10, 1) else 1) for i, x in ids.items()})
    assert packing.pack(empty).count() == 0
    least = {r["least_sequences"] for r in rows}
    assert len(least) == 1 and max(least) <= len(seen) and (len(seen) == max(least)) <= all(r["certified"] for r in rows)
    assert len(seen) <= -(-sum(pieces.values()) // 1024) + 2


def test_hmm_blocks_change_nothing(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 4)
    r = np.random.default_rng(2)
    share = np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS)
    m = hmm.Model.initial(share)
    runs = [r.integers(0, 900, n).astype(np.uint16) for n in (300, 1, 41, 40, 40, 7)]
    for some in (runs, runs[:1]):
        got = []
        for block in (10_000, 90, 3):
            monkeypatch.setattr(hmm, "BLOCK", block)
            counts = hmm.Counts()
            counts.add(m, some)
            got.append(counts)
        for other in got[1:]:
            assert all(np.allclose(getattr(other, k), getattr(got[0], k), atol=1e-9) for k in ("start", "move", "emit", "fit"))
        assert math.isclose(got[0].fit, hmm.log10_likelihood(m, some).sum(), rel_tol=1e-9)


def test_hmm_scores_do_not_depend_on_what_is_broadcast(spark, docs, monkeypatch):
    got = []
    for head in (1_000_000, 3_000, 50, 0):
        monkeypatch.setattr(hmm, "HEAD", head)
        got.append(sorted((r["doc_id"], round(r["score"], 6), round(r["base_score"], 6), r["n_known"]) for r in hmm.score(docs).collect()))
    assert got[0] == got[1] == got[2] == got[3]


@pytest.mark.parametrize("head", [1_000_000, 50])
def test_hmm(spark, docs, empty, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = [*[(i, t) for i, t in enumerate(TEXTS)], (10, TEXTS[10]), (1, TEXTS[1])]
    tokens = lambda t: [*WORD.findall(LOW(t)), "\n"]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in hmm.score(docs).collect():
        w = tokens(TEXTS[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert hmm.score(empty).count() == 0
    lone = hmm.score(docs.where("doc_id = 2").withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)))).first()
    assert lone["train_tokens"] == 0 and lone["base_score"] == 0


def test_hmm_recursions(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    r = np.random.default_rng(0)
    share = r.random(hmm.SYMBOLS)
    m = hmm.Model.initial(share / share.sum())
    runs = [r.integers(0, 5, n) for n in (4, 1, 3)]
    slow = []
    for s in runs:
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        slow.append(math.log10(total))
    assert np.allclose(hmm.log10_likelihood(m, runs), slow)
    before = sum(slow)
    for _ in range(3):
        counts = hmm.Counts()
        counts.add(m, runs)
        assert math.isclose(counts.fit, before, rel_tol=1e-9) and math.isclose(counts.emit.sum(), 8) and math.isclose(counts.start.sum(), 3) and math.isclose(counts.move.sum(), 5)
        monkeypatch.setattr(hmm, "PRIOR", 1e-9)
        m = hmm.improved(m, counts, share / share.sum())
        now = hmm.log10_likelihood(m, runs).sum()
        assert now >= before - 1e-6
        before = now


def test_line_rules(docs, empty):
    got = by_id(line_rules.judge(docs, with_text=True))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w, places = WORD.findall(t), defaultdict(list)
        for j in range(len(w) - 7):
            places[tuple(w[j : j + 8])].append(j)
        again = {j + x for p in places.values() if len(p) > 1 for j in p for x in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert got[19]["kept"] and not got[15]["kept"] and got[15]["clean_text"] == "" and line_rules.judge(empty).count() == 0
    both = line_rules.judge(docs.sparkSession.createDataFrame([(1, text(30) + ".\nhome | about | help\n" + text(30) + ".\nAll rights reserved. " + text(5))], "doc_id long, text string"), True).first()
    assert both["kept"] and both["n_removed_lines"] == 2 and "|" not in both["clean_text"]


def _slow_bad(line, earlier):
    """The rules of a line that has a word, as the module's description states them."""
    w = WORD.findall(line)
    count = lambda p: len(re.findall(p, line))
    upper, letters = count("[A-Z]"), count("[A-Za-z]")
    return (
        len(w) < line_rules.SHORT and not count("[.!?;:]") or 3 * count(r"\|") >= len(w) or len(w) >= 6 and 10 * upper > 6 * letters or len(w) > 1 and 2 * count("!") >= len(w)
        or 2 * count(r"[#*$%&|<>]") >= len(w) or len(w) > 3 and 2 * sum(a == b for a, b in zip(w, w[1:])) >= len(w) or line in earlier or any(p in LOW(line) for p in line_rules.PHRASES)
    )


def test_line_rules_against_a_slow_judge(spark):
    r, rows = random.Random(12), []
    kinds = [lambda: text(9) + ".", lambda: text(3), lambda: "a | b | c", lambda: text(8).upper(), lambda: "buy! now!", lambda: "# * x", lambda: "go go go go", lambda: "All Rights reserved. " + text(5), lambda: "same line here again.", lambda: "  ", lambda: "é ü. ñ\tx"]
    for i in range(120):
        rows.append((i, "\n".join(r.choice(kinds[: r.choice([2, 11])])() for _ in range(r.randrange(0, 14)))))
    got = by_id(line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), True))
    for i, t in rows:
        lines = [x for x in t.split("\n") if WORD.search(x)]
        bad = [_slow_bad(x, lines[:k]) for k, x in enumerate(lines)]
        lost, n = sum(len(WORD.findall(x)) for x, b in zip(lines, bad) if b), len(WORD.findall(t))
        x = got[i]
        assert (x["n_lines"], x["n_removed_lines"], x["lost_words"]) == (len(lines), sum(bad), lost)
        assert x["clean_text"] == "\n".join(x for x, b in zip(lines, bad) if not b) and x["kept"] == (not x["base_failed"] and lost <= line_rules.MOST_LOST * n)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept."""
    import corpus_pipeline as P

    r = random.Random(13)
    rows = [(i, text(r.randrange(55, 200)) + (" zorgle blarp fnoot" * 3 if i % 9 == 0 else ""), "en", r.choice(["a", "b", None]), 0) for i in range(150)]
    rows += [(500 + i, rows[i][1].replace(" ", "  ", 3) + r.choice(["", " end", " " + text(90)]), "en", "a", 0) for i in range(40)]
    rows += [(700 + i, f"{text(60)} {PASSAGE} {text(7)}", "en", "b", 0) for i in range(6)] + [(800, None, None, None, None), (801, "", "en", "b", 0), (None, text(80), "en", "a", 0), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["text"] or "")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        out.append((sorted(before.collect(), key=key) if k < 4 else before.collect(), sorted(docs.collect(), key=key) if k < 4 else docs.collect()))
    model = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    score = model.scores(pa.array([x["text"] for x in out[0][0]], pa.string()))
    assert out[0][1] == [x for x, s in zip(out[0][0], score) if s < 0.5] and 5 < len(out[0][0]) - len(out[0][1]) < 40

    names = {x["doc_id"] if x["doc_id"] is not None else -1: x for x in out[1][0]}
    assert {x["doc_id"] if x["doc_id"] is not None else -1 for x in out[1][1]} == _similar_groups([(i, x["text"]) for i, x in names.items()])
    assert len({x["doc_id"] for x in out[1][1]}) == len(out[1][1])

    texts = [(x["doc_id"] if x["doc_id"] is not None else -1, x["text"] or "") for x in out[2][0]]
    redundant = _redundant(texts)
    left = {i: [w for j, w in enumerate(WORD.findall(t)) if j not in redundant[i]] for i, t in texts}
    assert {x["doc_id"] if x["doc_id"] is not None else -1: WORD.findall(x["text"] or "") for x in out[2][1]} == {i: w for i, w in left.items() if w or not WORD.findall(dict(texts)[i])}

    taken = mixing.mix(spark.createDataFrame(out[3][0], spark.read.parquet(f"{tmp_path}/2").schema)).collect()
    times = Counter({t["doc_id"]: t["taken"] // t["size"] if t["size"] else 1 for t in taken})
    assert Counter(x["doc_id"] for x in out[3][1]) == +times

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    ids = {x["doc_id"]: slow.encode(x["text"] or "", add_special_tokens=False).ids + [2] for x in out[4][0]}
    many = Counter(x["doc_id"] for x in out[4][0])
    assert Counter({i: sum(x["length"] for x in out[4][1] if x["doc_id"] == i) for i in ids}) == Counter({i: len(v) * many[i] for i, v in ids.items()})
    assert all(zlib.crc32(np.array(ids[x["doc_id"]][x["start"] : x["start"] + x["length"]], "<u4").tobytes()) == x["ids_crc32"] for x in out[4][1])
    filled = defaultdict(list)
    for x in out[4][1]:
        filled[x["sequence_id"]].append((x["offset"], x["length"]))
    assert all([o for o, _ in sorted(s)] == np.cumsum([0] + [n for _, n in sorted(s)[:-1]]).tolist() and sum(n for _, n in s) <= 1024 for s in filled.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, text(120), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", "en", "s0", 0) for i in range(5)]
    rows += [(200 + i, text(30) + " " + PASSAGE + " " + text(30), "en", "s1", 0) for i in range(5)] + [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (_, f) in enumerate(P.STAGES):
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs)
    assert {r["doc_id"] for r in counts[1].collect()} == {*range(60), *range(200, 205), 300}
    assert counts[2].count() == 66 and counts[2].where(F.contains("text", F.lit(PASSAGE))).count() == 1
    assert P.run(spark, str(tmp_path)).count() == counts[4].count()


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op1_mixing", "op2_suffix_dedup", "op3_license_scan", "op7_warc", "op10_line_rules"])
def test_query_against_sql(spark, name):
    from textloom.llm import queries as Q

    assert set(Q.ORACLES) == {"op1_mixing", "op2_suffix_dedup", "op3_license_scan", "op7_warc", "op10_line_rules"}
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, DATA), db.sql(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    rows = lambda names, all_: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in all_), key=str)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_sql_on_odd_rows(spark, docs):
    """Nulls, empty texts, ties and repeated ids in the SQL of scans and line rules."""
    from textloom.llm import oracles

    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    for got, sql in ((licenses.scan(docs).drop("spans"), oracles.LICENSES), (line_rules.judge(docs).drop("clean_text"), oracles.LINES)):
        want = db.sql(sql)
        rows = lambda names, all_: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in all_), key=str)
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
