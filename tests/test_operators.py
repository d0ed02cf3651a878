import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from textloom.functions import scoring, text
from textloom.operators import catalog, coverage, matching
from textloom.sources import container, dictionary, reports
from textloom.streaming import capture as stream


def test_scoring_tags(spark):
    rows = ["# Title\nYou should not. IMPORTANT: do it, ${x}", "https://a.b/c", "some_name", "", None, "src/a.ts", "你好 ok", "}),;if(a){let b=c.length;return Error(d)}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    got = {r["id"]: (r["s"], r["e"]) for r in df.select("id", scoring.score_text(F.col("text")).alias("s"), scoring.evidence(F.col("text")).alias("e")).collect()}
    assert got[0][1][:4] == ["markdown_heading", "imperative_marker", "has_placeholder", "stop_words"][:4]
    assert "url" in got[1][1] and "identifier" in got[2][1] and "path" in got[5][1] and "has_han" in got[6][1]
    assert got[3][0] == got[4][0] == -3
    assert got[7][0] < -10


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    hits = [(d, k, rng.randrange(60), rng.randrange(1, 12)) for d in range(5) for k in range(40)]
    df = spark.createDataFrame(hits, "id int, key_id int, pos long, len long")
    got = {(r["id"], r["key_id"]): (r["nested"], r["conflict"]) for r in matching.overlaps(df).collect()}
    for d, k, p, n in hits:
        before = [h for h in hits if h[0] == d and (h[2], -h[3], h[1]) < (p, -n, k)]
        reach = max((h[2] + h[3] for h in before), default=-1)
        assert got[d, k] == (p + n <= reach, p < reach < p + n)


def test_same_start_is_a_conflict_only_for_the_audit(spark):
    df = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 0, 5)], "id int, key_id int, pos long, len long")
    assert matching.overlaps(df).where("conflict").count() == 0
    assert matching.overlaps(df, audit_compat=True).where("conflict").count() == 1


def test_occurrences_overlap_and_shard(spark, monkeypatch):
    monkeypatch.setattr(matching, "KEYS_AT_ONCE", 2)
    texts = spark.createDataFrame([(1, "aaaa é b"), (2, None), (3, "")], "id int, text string")
    keys = spark.createDataFrame([(1, "aa"), (2, "é"), (3, ""), (4, "b")], "key_id int, key string")
    assert sorted(map(tuple, matching.occurrences(texts, keys).collect())) == [(1, 1, 0, 2), (1, 1, 1, 2), (1, 1, 2, 2), (1, 2, 5, 1), (1, 4, 7, 1)]
    assert sorted(map(tuple, matching.contained(texts, keys, 2).collect())) == [(1, 1)]


def test_whitelist_rules_differ(spark):
    df = spark.createDataFrame([("cat cats cat cat",), ("  ",), ("ab 123",)], "text string")
    white = [r[0] for r in df.select(text.whitelisted(F.col("text"), ["cat"], [], [])).collect()]
    left = [r[0] for r in df.select(text.residual(F.col("text"), ["cat"], [], [])).collect()]
    assert white == [True, True, True]
    assert left == [["cats"], [], []]


def test_empty_summary_is_an_error(spark):
    none = spark.createDataFrame([], "translated boolean, whitelisted boolean")
    with pytest.raises(Exception, match="nothing to measure"):
        coverage.summary(none).collect()


def test_length_stats_of_an_even_count(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 4, 9]], "n long")
    assert tuple(coverage.length_stats(df, F.col("n")).first()) == (1, 3.0, 9, 9)


def test_sentinels_try_one_place():
    buffer = "A${x}B A${y}C A${z}B ${$w}Q"
    assert catalog.resolve_sentinels(buffer, [("n", "A", "B"), ("n", "A", "B"), ("n", "A", "B"), ("m", "", "Q"), ("k", "Z", "")]) == {"n": ["${x}", "${z}"], "m": ["${$w}"]}
    # a failed try moves on by one place only
    assert catalog.resolve_sentinels("aaa${x}b", [("n", "aa", "b")] * 2) == {"n": ["${x}"]}
    assert catalog.resolve_sentinels("${}Q ${a.b}Q${c}Q", [("n", "", "Q")] * 3) == {"n": ["${a.b}", "${c}"]}
    assert catalog.resolve_sentinels("A${x} B", [("n", "A", "B"), ("m", "A", "")]) == {"m": ["${x}"]}


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "linux").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"_note": "x", "one": "eins", "two": {"dst": "zwei", "allow_reorder": True}}))
    (tmp_path / "linux" / "b.json").write_text(json.dumps({"three": "drei"}))
    got = sorted(map(tuple, dictionary.entries(spark, str(tmp_path), "linux").collect()))
    assert got == [("a.json", "one", "eins", False), ("a.json", "two", "zwei", True), ("b.json", "three", "drei", False)]
    (tmp_path / "c.json").write_text(json.dumps({"one": "noch eins"}))
    with pytest.raises(ValueError, match="one"):
        dictionary.entries(spark, str(tmp_path))
    (tmp_path / "w.txt").write_text(json.dumps({"exact": ["_comment x", "a"], "regex": [], "literal_exact": [" b"]}))
    with pytest.raises(ValueError, match="stripped"):
        dictionary.whitelist(spark, str(tmp_path / "w.txt"))


def test_container(spark):
    trailer, bundle, name = b"\n-- end --\n", b"var a='b'", b"/m.js"
    body = name + bundle
    entry = struct.pack("<12I4B", 0, len(name), len(name), len(bundle), *[0] * 8, 1, 2, 0, 0)
    data = b"\x7fELF" + body + entry + struct.pack("<8I", len(body) + 52, 0, len(body), 52, 0, 0, 0, 0) + trailer
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    r = container.modules(files, trailer).first()
    assert data[r["contents_off"] : r["contents_off"] + r["contents_len"]] == bundle and r["name"] == "/m.js"
    assert (r["entry"], r["loader"], r["module_format"], r["side"]) == (True, "js", "esm", "server")
    both = files.union(spark.createDataFrame([("g.js", bytearray(b"x=1"))], files.schema))
    assert {p: bytes(b) for p, b in container.bundles(both, trailer).collect()} == {"f": bundle, "g.js": b"x=1"}
    assert [tuple(x) for x in container.segments(files, trailer).orderBy("off").select("label", "off", "len").collect()] == [("module_0_name", 0, 5), ("module_0_contents", 5, len(bundle)), ("modules_array", len(body), 52)]
    assert json.loads(container.metadata(data, trailer))["module_count"] == 1
    bad = bytearray(data)
    struct.pack_into("<I", bad, 4 + len(body) + 12, 9999)
    with pytest.raises(ValueError, match="pointer"):
        container.read_table(bytes(bad), trailer)
    assert container.fit((100, 400), 120, 200, 10, 16) == {"new_byte_count": 210, "header": 258, "padding": 22}
    with pytest.raises(ValueError, match="3 bytes"):
        container.fit((100, 400), 120, 200, 35, 16)
    assert files.select(container.file_format(F.col("content"))).first()[0] == "linux"
    with pytest.raises(ValueError):
        container.read_table(b"nothing", trailer)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"ts": 1.0, "path": "/", "headers": {}, "body": json.dumps({"system": [{"type": "text", "text": "keep the word 你好"}]})}
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(line) + "\n{broken\n")
    q = stream.start(stream.residual_words(stream.read(spark, str(tmp_path / "in")), ["the"], [], []), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("words").first()[0] == ["keep", "word"]


def test_sections(spark):
    elf = bytearray(b"\x7fELF" + bytes(60) + struct.pack("<2I6Q", 1, 5, 100, 0, 0, 50, 50, 0) + struct.pack("<2I6Q", 2, 0, 0, 0, 0, 999, 0, 0))
    struct.pack_into("<Q", elf, 32, 64)
    struct.pack_into("<2H", elf, 54, 56, 2)
    assert container.sections(bytes(elf)) == [(100, 150)] and container.containing(bytes(elf), 149) == (100, 150)
    with pytest.raises(ValueError):
        container.containing(bytes(elf), 150)
    kinds = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate([b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xcf", b"\xca\xfe\xba\xbe", b"MZ", b"\x7fELF", b"x"])], "i int, content binary")
    assert [r[0] for r in kinds.orderBy("i").select(container.file_format(F.col("content"))).collect()] == ["darwin", "darwin", None, "win32", "linux", None]
    mach = b"\xcf\xfa\xed\xfe" + bytes(12) + struct.pack("<I", 2) + bytes(12) + struct.pack("<2I", 7, 8) + struct.pack("<2I16s4Q4I", 0x19, 72, b"x", 0, 0, 10, 5, 0, 0, 0, 0)
    assert container.sections(mach) == [(10, 15)]
    pe = bytearray(0x40 + 24 + 40)
    pe[:2] = b"MZ"
    struct.pack_into("<I", pe, 0x3C, 0x40)
    struct.pack_into("<H", pe, 0x46, 1)
    struct.pack_into("<2I", pe, 0x40 + 24 + 16, 7, 20)
    assert container.sections(bytes(pe)) == [(20, 27)]


def test_numbered_against_sorting(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 1, 1, rng.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int")
    want = {i: k for k, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}
    assert {r["id"]: r["place"] for r in catalog.numbered(df, F.col("v"), "id", slots=8).collect()} == want
    assert catalog.numbered(df.limit(0), F.col("v"), "id").count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a "b"\nc', "x"), (1, "d", "y")], "part int, text string, src string")
    reports.write_candidates(df, str(tmp_path / "c"))
    assert sorted(r["text"] for r in spark.read.option("header", True).csv(str(tmp_path / "c/csv")).collect()) == ["a 'b' c", "d"]
    reports.write_groups(df, str(tmp_path / "g"), 2, todo="__TODO__")
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "g")).select("src", "dst", "group").collect())) == [("x", "__TODO__", "a"), ("y", "__TODO__", "b")]
    reports.write_groups(df, str(tmp_path / "h"), 2)
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "h")).select("text", "group").collect())) == [('a "b"\nc', 1), ("d", 2)]
    assert reports.group_names(11)[-1] == "11" and reports.group_names(10)[-1] == "j"
    reports.write_whitelist(df.union(df), str(tmp_path / "w"))
    lines = [json.loads(x)["text"] for f in sorted((tmp_path / "w").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == ["d", 'a "b"\nc']


def test_resolved_sentinels(spark):
    df = spark.createDataFrame([(1, "A${x}B A${z}B"), (2, None)], "id long, buffer string")
    assert sorted(map(tuple, catalog.resolve(df, [("n", "A", "B"), ("n", "A", "B")]).collect())) == [(1, "n", 1, "${x}"), (1, "n", 2, "${z}")]
