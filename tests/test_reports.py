"""Dictionaries, captures, replacements, audits, versions and reports against values worked out by hand or by brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import literals as L
from textloom.functions import scoring, text
from textloom.operators import audit, catalog, coverage, glossary, groups, matching, versions
from textloom.sources import capture, dictionary, reports


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def scores(spark, *texts, **lists):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [(r["s"], r["e"]) for r in df.orderBy("i").select(scoring.score_text(F.col("text"), **lists).alias("s"), scoring.evidence(F.col("text"), **lists).alias("e")).collect()]


def test_scores_of_each_rule(spark):
    long_ = "Lists the files of a folder, and of those below it; the rest is left out. "
    cases = {
        "# Head\nword": (4, ["markdown_heading"]),
        "You must go": (3, ["starts_with_You"]),
        "NOTE: go": (3, ["imperative_marker"]),
        "see ${a.b} there": (2, ["has_placeholder"]),
        "if not this then that of it": (2, ["stop_words"]),
        "see <example> there": (2, ["xml_tags"]),
        "Set this to anything": (-3, ["config_desc"]),
        "Default true": (-3, ["config_desc"]),
        long_: (5, ["stop_words", "desc_verb_lead"]),
        long_ * 3: (9, ["stop_words", "long", "desc_verb_lead", "prose_structure"]),
        "https://a.b/c?d": (-5, ["url"]),
        "src/x.tsx": (-5, ["path"]),
        "one_name": (-5, ["identifier"]),
        "123 456": (-3, ["no_words"]),
        "var H=typeof _ here": (-10, ["js_code"]),
        "\\if x": (0, []),
        "}if x y": (-5, ["js_punct_lead"]),
        "]H.x y zz": (-5, ["js_punct_lead"]),
        "a.then( b.has( c.uuid dd": (-8, ["minified_js"]),
        ", go .then( there": (-8, ["minified_js"]),
        "你好 there": (1, ["has_han"]),
    }
    assert dict(zip(cases, scores(spark, *cases), strict=True)) == cases
    assert scores(spark, "a SDKX b and zz", sdk=["SDKX"])[0] == (-5, ["sdk_string"])
    assert scores(spark, "the left_click 你", "the left_click", browser=["left_click"]) == [(1, ["has_han"]), (-3, ["browser_tool"])]
    got = spark.range(1).select(scoring.classify(F.lit(4), F.lit(3)), scoring.classify(F.lit(4), F.lit(2)), scoring.classify(F.lit(2))).first()
    assert tuple(got) == ("prompt", "weak", "skip")


def test_captures(spark, tmp_path):
    body = {"system": [{"text": "sys"}, {"text": ""}], "tools": [{"name": "a b", "description": "d", "input_schema": {"description": {"description": "named so"}, "x": [[{"description": "deep"}]], "y": {"description": 5}}}]}
    lines = [json.dumps({"ts": 1, "body": json.dumps(body)}), json.dumps({"ts": 2}), json.dumps({"body": "{"}), json.dumps({"body": json.dumps({"system": [{"text": "last"}]})})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    records = capture.read(spark, str(tmp_path / "c.jsonl"))
    assert [r["line"] for r in records.orderBy("line").collect()] == [1, 2, 3, 4]
    tool = "rec1.tool[0:a b]"
    assert rows(capture.segments(records)) == sorted([("rec1.sys[0]", "sys"), (f"{tool}.description", "d"), (f"{tool}.input_schema.description.description", "named so"), (f"{tool}.input_schema.x[0][0].description", "deep"), ("rec4.sys[0]", "last")], key=str)
    assert capture.segments(records.where("false")).count() == 0


def _in_literal(lits, low, high):
    return any(s <= low and high <= e for s, e, _ in lits)


def test_replacements_and_audit_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", 'say "x"', "new\nline", "é", "${v}"]
    sources = []
    for i in range(30):
        parts = []
        for _ in range(6):
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
            kind = rng.choice(["dq", "sq", "tmpl_frag", "code"])
            parts.append(t.replace('"', "").replace("\n", " ") if kind == "code" else {"dq": '"%s"', "sq": "'%s'", "tmpl_frag": "`%s`"}[kind] % (t if kind == "tmpl_frag" and "`" not in t else L.encode(t, kind, rng.random() < 0.3)))
        sources.append((i, ";".join(parts)))
    entries = [(1, "alpha", "A", False), (2, "alpha beta", "B", False), (3, 'say "x"', "C", False), (4, "new\nline", "D", False), (5, "é", "E", False), (6, "${v} alpha", "F ${v}", True), (7, "beta ${v}", "lost", False)]
    df = spark.createDataFrame(sources, "id long, source string")
    lits = L.literals(df, "id", "source").cache()
    table = spark.createDataFrame(entries, "key_id long, src string, dst string, allow_reorder boolean")
    want, occurrences, pairs = [], {k: [0, 0, 0, 0] for k, *_ in entries}, 0
    for i, source in sources:
        raw = source.encode()
        found = L.scan(raw)
        hits = []
        for k, src, _, _ in entries:
            for low in range(len(raw)):
                if raw.startswith(src.encode(), low):
                    inside = _in_literal(found, low, low + len(src.encode()))
                    occurrences[k][0] += 1
                    if k != 7:
                        occurrences[k][1 if inside else 2 if "${" in src else 3] += 1
                        if inside or "${" in src:
                            hits.append((low, low + len(src.encode())))
            if k == 7:
                continue
            equal = [(s, e, t) for s, e, t in found if L.decode(raw[s:e]) == src]
            want += [(i, k, s, e - s, t, "whole") for s, e, t in equal]
            if not equal:
                for form, t in L.search_forms(src):
                    f = form.encode()
                    for low in range(len(raw)):
                        if raw.startswith(f, low):
                            want.append((i, k, low, len(f), t, "inside" if _in_literal(found, low, low + len(f)) else "crossing" if "${" in src else "code"))
        pairs += sum(a <= c < b < d for x, (a, b) in enumerate(hits) for y, (c, d) in enumerate(hits) if x != y)
    assert rows(matching.replacements(df, lits, table)) == sorted(want, key=str)
    per, totals = audit.by_source(df, lits, table)
    assert {r["key_id"]: [r["occurrences"], r["in_literal"], r["cross_literal_safe"], r["code_region"]] for r in per.collect()} == occurrences
    t = totals.first()
    b = sum(n[3] for n in occurrences.values() if n[3] and not n[1])
    assert (t["risk_b"], t["risk_d"], t["risk_e"], t["high_risk"]) == (b, pairs, 1, b + pairs + 1) and t["total_src"] == 7
    applied = matching.in_order_of_application(matching.replacements(df, lits, table)).where("id = 0").collect()
    assert [r["pos"] for r in applied] == sorted((r["pos"] for r in applied), reverse=True)
    white = spark.createDataFrame([("alpha beta beta beta beta",), ('say "x"',), ("zz",)], "text string")
    assert "zz" in [r[0] for r in matching.stale_texts(white, lits, df).collect()] and 'say "x"' not in [r[0] for r in matching.stale_texts(white, lits, df).collect()]
    assert rows(matching.stale_everywhere(white, white.limit(1), white.where("text = 'zz'"))) == [("alpha beta beta beta beta",), ('say "x"',)]


def test_conflicts_across_blocks(spark):
    hits = [(1, k, p, n) for k, (p, n) in enumerate([(0, 10), (5, 10), (9, 1), (9, 2), (20, 100), (100, 40), (0, 10), (0, 12)])]
    want = {(x[1], y[1]) for x in hits for y in hits if x[2] <= y[2] < x[2] + x[3] < y[2] + y[3]}
    got = audit.conflicts(spark.createDataFrame(hits, "id int, key_id int, pos long, len long"), block=8)
    assert sorted((r["key1"], r["key2"]) for r in got.collect()) == sorted(want)


def test_dictionaries_and_glossaries(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_n": "x", "one": "eins", "two": {"dst": "zwei"}}))
    assert rows(dictionary.pairs(spark, str(tmp_path))) == [("a.json", "one", "eins")]
    (tmp_path / "g.txt").write_text(json.dumps({"terms": {"agent": {"keep": True}, "tool": {"zh": ["werkzeug"]}, "pull request": {"keep": True, "phrase": True}, "pull": {"zh": ["x"], "phrase": True}}}))
    t = dictionary.terms(dictionary.glossary(spark, str(tmp_path / "g.txt")))
    assert t == {"keep": ["agent"], "translate": ["tool"], "phrases": ["pull request", "pull"], "require": {"tool": ["werkzeug"]}}
    pairs = spark.createDataFrame([(1, "an agent, a tool", "ein agent, ein werkzeug"), (2, "a tool", "ein ding"), (3, "a tool, a pull request", "ein tool")], "id long, src string, dst string")
    assert rows(glossary.violations(pairs, **t)) == [(2, "not_translated", "tool"), (3, "kept_english", "tool"), (3, "not_translated", "tool"), (3, "phrase_keep", "pull request")]
    counts = glossary.summary(glossary.violations(pairs, **t)).collect()
    assert [r["n"] for r in counts] == sorted((r["n"] for r in counts), reverse=True)
    (tmp_path / "v.txt").write_text(json.dumps({"versions": {"1.10.0": {"l": "aa"}, "1.9.0": {"l": "aa", "d": "bb"}}}))
    config = dictionary.versions(spark, str(tmp_path / "v.txt"))
    reports.write_versions(config, str(tmp_path / "out"))
    assert [(r["version"], r["platform"]) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("1.9.0", "d"), ("1.9.0", "l"), ("1.10.0", "l")]
    assert [r[0] for r in versions.supported(config).collect()] == ["1.9.0", "1.10.0"]
    (tmp_path / "bad.txt").write_text("{}")
    with pytest.raises(Exception, match="no versions"):
        dictionary.versions(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dictionary.versions(spark, str(tmp_path / "none.txt")).collect()


def test_versions(spark):
    config = spark.createDataFrame([("1.10.0", "l", "aa"), ("1.9.0", "l", "aa"), ("1.x", "d", "bb")], "version string, platform string, expected string")
    shas = spark.createDataFrame([("aa",), ("bb",), ("cc",)], "sha string")
    assert rows(versions.find_matches(config, shas)) == [("aa", 1, "1.9.0", "l"), ("aa", 2, "1.10.0", "l"), ("bb", 1, "1.x", "d"), ("cc", None, None, None)]
    assert rows(versions.require_match(config, shas, force=True)) == rows(versions.find_match(config, shas))
    with pytest.raises(Exception, match="not supported: cc"):
        versions.require_match(config, shas).collect()
    assert versions.chosen(" 2.0 ,1.0,", ["3"]) == ["1.0", "2.0"] and versions.chosen(" , ", ["3", "2"]) == versions.chosen(None, ["2", "3"]) == ["2", "3"]
    v = spark.createDataFrame([("1.2.30",), ("a.1",)], "v string")
    assert [r[0] for r in v.select(text.version_key(F.col("v"))).collect()] == [[1, 2, 30], [0, 1]]
    assert v.where("v <> 'a.1'").select(text.version_parts(F.col("v"))).first()[0] == [1, 2, 30]
    with pytest.raises(Exception, match="no version: a.1"):
        v.select(text.version_parts(F.col("v"))).collect()


def test_sentinels(spark):
    known = spark.createDataFrame([("__A__", ["${x}", "${y}"]), ("__B__", ["${p}"])], "name string, vars array<string>")
    both = spark.createDataFrame([(1, "${__A__} ${__B__}", "t", True)], "entry long, src string, dst string, more boolean")
    with pytest.raises(Exception, match="numbers of instances differ"):
        catalog.expand_sentinels(both, known).collect()
    assert rows(catalog.expand_sentinels(both, known, strict=False)) == [(1, "${x} ${p}", "t", True)]
    assert spark.range(1).select(catalog.first_instances(F.lit("a ${__A__} ${__C__}"), {"__A__": ["${x}", "${y}"], "__C__": []})).first()[0] == "a ${x} ${__C__}"


def test_extraction_report(spark, tmp_path):
    sources = spark.createDataFrame([(1, "a=['Wir gehen heute alle','You are here','IMPORTANT: go on then','You must not go'];t=`你好 ${x} some english words ${y}`")], "id long, source string")
    lits = groups.mixed_templates(groups.array_groups(L.literals(sources, "id", "source"), "id"), "id").cache()
    covered = lits.where("text = 'You are here'").select("id", "start_off", F.lit(True).alias("exact"), F.lit(False).alias("partial"))
    found = coverage.candidates(lits, covered, F.lit(False), min_score=1).cache()
    assert {r["text"]: (r["class"], r["score"], r["status"]) for r in found.collect()} == {
        "Wir gehen heute alle": ("weak", 1, "untranslated"), "You are here": ("weak", 4, "exact"), "IMPORTANT: go on then": ("weak", 4, "untranslated"),
        "You must not go": ("prompt", 6, "untranslated"), "你好 ": ("skip", -2, "han"), " some english words ": ("skip", 0, "untranslated"),
    }
    t = coverage.counters(found).first().asDict()
    assert t == {"total_literals": 6, "decoded_ok": 6, "scored_prompt": 1, "scored_weak": 3, "scored_skip": 2, "translated": 1, "whitelisted": 0, "untranslated_prompt": 1, "untranslated_weak": 2, "mixed_lang_template_residual": 0}
    assert [r["mixed"] for r in found.where("text LIKE ' some%'").collect()] == [True]
    reports.write_extract(found, coverage.counters(found), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).first()["total_literals"] == 6
    assert [r["score"] for r in spark.read.json(str(tmp_path / "r/candidates")).coalesce(1).collect()][0] == 6
    assert coverage.untranslated(found, "weak", 4).count() == 1 and coverage.sample(coverage.untranslated(found), F.char_length("text"), k=1).first()["text"] == "You must not go"
    reports.write_report(str(tmp_path / "d"), totals=coverage.counters(found), top=coverage.untranslated(found))
    assert spark.read.json(str(tmp_path / "d/top")).count() == 3


def test_residual_report(spark, tmp_path):
    found = spark.createDataFrame([("a", ["zz", "bb", "zz"]), ("b", []), ("c", ["bb"])], "label string, words array<string>")
    by, totals = coverage.residual_report(found, show=1)
    assert rows(by) == [("a", ["bb", "zz"], ["bb"]), ("c", ["bb"], ["bb"])] and tuple(totals.first()) == (3, 2, 4, 2)


def test_prompts_modules_and_logs(spark, tmp_path, caplog):
    import struct

    texts = spark.createDataFrame([(1, "You are a long one ${x}. More"), (2, "You are short")], "place long, text string")
    m = reports.write_prompts(texts, str(tmp_path / "p"), scoring.short_label(F.col("text")))
    assert rows(m) == [(0, "you_are_a_long", 29, True, "00_you_are_a_long.en"), (1, "you_are_short", 13, False, "01_you_are_short.en")]
    assert sorted(x.name for x in (tmp_path / "p/texts").iterdir() if x.is_dir()) == ["file=00_you_are_a_long.en", "file=01_you_are_short.en"]
    body = b"/a/m.js" + b"code" + b"map"
    entry = struct.pack("<12I4B", 0, 7, 7, 4, 11, 3, *[0] * 6, 1, 2, 0, 0)
    data = body + entry + struct.pack("<8I", len(body) + 52, 0, len(body), 52, 0, 0, 0, 0) + b"END"
    reports.write_modules(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"), b"END", str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m/data")).select("file", F.decode("bytes", "UTF-8"))) == [("a_m.js", "code"), ("a_m.js.map", "map")]
    found = spark.createDataFrame([("f", "s" * 60, "keep_lost", "x"), ("f", "s", "keep_lost", "y"), ("g", "t", "keep_lost", "y")], "file string, src string, kind string, word string")
    reports.write_glossary(found, str(tmp_path / "g"))
    assert {r["term"]: len(r["hits"]) for r in spark.read.json(str(tmp_path / "g")).collect()} == {"keep_lost:x": 1, "keep_lost:y": 2}
    with caplog.at_level("INFO", logger="textloom"):
        reports.log("OK", "done")
    assert "[OK] done" in caplog.text
    with pytest.raises(ValueError):
        reports.log("NO", "x")


def test_groups_of_literals(spark):
    src = "a=['one','two', 'three'];f('four');g(`x ${n} y ${'in'} z`);t=`ab${c}你${d}english words`;u=['a'\n,/**/'b']"
    lits = groups.mixed_templates(groups.array_groups(L.literals(spark.createDataFrame([(1, src), (2, None)], "id int, source string"), "id", "source"), "id"), "id")
    got = [(r["text"], r["group_size"], r["mixed"]) for r in lits.orderBy("start_off").collect()]
    assert got == [("one", 3, False), ("two", 3, False), ("three", 3, False), ("four", 1, False), ("x ", 1, False), (" y ", 1, False), ("in", 1, False), (" z", 1, False), ("ab", 1, False), ("你", 1, False), ("english words", 1, True), ("a", 1, False), ("b", 1, False)]
    t = {r["text"]: r["template_group"] for r in lits.collect()}
    assert t["x "] == t[" y "] != t[" z"] and t["ab"] == t["你"] == t["english words"]


def test_reports_and_keys_read_back(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"source": "x", "candidates": [{"text": "a", "score": 5}, {"text": "b", "score": 2}]}))
    assert rows(dictionary.candidates(spark, str(tmp_path / "r.json")).select("text", "score")) == [("a", 5), ("b", 2)]
    (tmp_path / "d").mkdir()
    for name in "ab":
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps({"one": name, "_x": "y"}))
    assert rows(dictionary.entries(spark, str(tmp_path / "d"), check=False).select("src").distinct()) == [("one",)]


def test_descriptions_deeper_than_a_pass(spark):
    node = {"description": "bottom", "x": {}}
    for i in range(15):
        node = [node, 1] if i % 3 == 0 else {"description": node, "y": "z"}
    body = json.dumps({"tools": [{"name": "t", "input_schema": {"a": node}}]})
    found = capture.segments(spark.createDataFrame([(7, body)], "line long, body string")).collect()
    assert [r["text"] for r in found] == ["bottom"] and found[0]["label"].startswith("rec7.tool[0:t].input_schema.a.description.description[0]") and found[0]["label"].count("description") == 11


def test_shared_beginnings_match_the_same_words():
    import re as regex

    words = ["a", "an", "and", "as", "be", "been", "being", "in", "into", "do", "don", "x"]
    pattern = regex.compile("(?<![a-z])" + scoring._branches(words) + "(?![a-z])")
    for w in [*words, "ands", "b", "bee", "int", "dont", "xx", "i"]:
        assert bool(pattern.search(f"-{w}-")) == (w in words)


def test_patterns_present(spark):
    from textloom.functions import rules as R

    texts = ["plain words", *R.CODE_MARKERS, *R.MINIFIED_TOKENS, "return Error and void 0", ".length of a.b", "x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.orderBy("i").select(scoring.present(F.col("text"), R.CODE_MARKERS), scoring.present(F.col("text"), R.MINIFIED_TOKENS)).collect()
    assert [tuple(r) for r in got] == [(sum(p in t for p in R.CODE_MARKERS), sum(p in t for p in R.MINIFIED_TOKENS)) for t in texts]


def test_reports_of_each_kind(spark, tmp_path):
    src = 'a("one thing"); b(\'one thing\\n\'); c(`see ${x} there`); one thing; d("two")'
    sources = spark.createDataFrame([(1, src)], "id long, source string")
    lits = L.literals(sources, "id", "source")
    entries = spark.createDataFrame([(1, "one thing", "eine Sache", False), (2, "see ${x} there", "dort ${x}", False), (3, "thing;", "x", False), (4, "nowhere", "x", False), (5, "a ${y}", "b", False), (6, "two", 'zw"ei', False)], "key_id long, src string, dst string, allow_reorder boolean")
    parts = audit.replacement_report(sources, lits, entries)
    # key 1 is a whole literal, so its other places are not looked for
    assert parts["totals"].first().asDict() == {"hits": 3, "nested": 0, "misses": 1, "skips": 1, "placeholder_violations": 1, "conflicts": 0, "delta": (10 - 9) + (9 - 14) + (6 - 3)}
    assert rows(parts["missed"]) == [(4, "nowhere")] and parts["violations"].first()["src_placeholders"] == ["${y}"]
    s = parts["skipped"].first()
    assert (s["key_id"], s["pos"]) == (3, src.index("thing;")) and s["context"] == src[s["pos"] - 30 : s["pos"] + 36]
    reports.write_report(str(tmp_path / "r"), **parts)
    assert spark.read.json(str(tmp_path / "r/totals")).first()["misses"] == 1

    found = spark.createDataFrame([("rec1.sys[0]", "keep the word\n- a:b:c gone"), ("rec1.tool[0:mcp__x].description", "outside"), ("rec2.sys[0]", "the")], "label string, text string")
    parts = coverage.capture_report(found, ["the"], [], [])
    assert parts["totals"].first().asDict() == {"total_segments": 3, "external_segments": 1, "stripped_lines": 1, "segments_with_residual": 1, "words": 2, "distinct_words": 2}
    assert rows(parts["by_label"]) == [("rec1.sys[0]", ["keep", "word"], ["keep", "word"])] and rows(parts["tokens"]) == [("keep", 1), ("word", 1)]

    lits = groups.mixed_templates(groups.array_groups(L.literals(spark.createDataFrame([(1, "a('You must not go there');b('You must do it');c('x y z')")], "id long, source string"), "id", "source"), "id"), "id")
    cands = coverage.candidates(lits, coverage.covered(lits, spark.createDataFrame([("You must do it",)], "src string")), F.lit(False), min_score=1)
    parts = coverage.diff_report(cands, min_score=1)
    assert parts["totals"].select("total", "translated", "untranslated", "min_score").first() == (2, 1, 1, 1)
    assert rows(parts["scores"]) == [(5, 1)] and [r["text"] for r in parts["top"].collect()] == ["You must not go there"]


def test_coverage_by_a_dictionary(spark):
    texts = ["whole key", "say ${v} now", "say ${w} now", "a long piece here", "short", "before this is a key of twenty more after", "so see ${v} in a long enough key", "other"]
    lits = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "id long, start_off long, text string")
    keys = spark.createDataFrame([("whole key",), ("say ${__A__} now",), ("a long piece here${x}short",), ("this is a key of twenty more",), ("see ${__A__} in a long enough key",)], "src string")
    got = {texts[r["start_off"]]: (r["exact"], r["partial"]) for r in coverage.covered(lits, keys, {"__A__": ["${v}", "${w}"]}).collect()}
    assert got == {"whole key": (True, False), "say ${v} now": (True, False), "say ${w} now": (True, False), "a long piece here": (True, False), texts[5]: (False, True), texts[6]: (False, True)}


def test_legacy_breakdown(spark):
    b = spark.createDataFrame([("# You are to use it. Never stop!",)], "t string").select(scoring.legacy_breakdown(F.col("t")).alias("b")).first()["b"]
    assert (b["len"], b["words"], b["md_title"], b["keyword_hits"]) == (32, 7, True, 2) and b["period_density"] == round(2 / 32, 3)
