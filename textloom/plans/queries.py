"""Queries over the driver's tables, one for each operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import literals as L
from ..functions import rules as R
from ..functions import scoring, text
from ..operators import catalog, coverage, glossary, groups, matching, versions
from ..sources import capture, tables
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(name: str):
    return lambda spark, d: tables.read(spark, f"{d}/{name}.parquet")


documents, benchmark, pages, conversations, labels = map(_table, ("documents", "benchmark", "pages", "conversations", "labels"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "lang", F.char_length("text").alias("n"), scoring.score_text(F.col("text")).alias("score"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return benchmark(spark, d).select(F.col("item_id").alias("key_id"), F.col("text").alias("key"))


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query
def score_class_by_lang(spark, d):
    s = _scored(spark, d)
    return s.groupBy("lang", scoring.classify(F.col("score")).alias("class")).agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query
def score_histogram(spark, d):
    """Scores of what nothing covers."""
    s = _status(spark, d).where("status = 'untranslated'")
    return s.groupBy(scoring.score_text(F.col("text")).alias("score")).agg(F.count("*").alias("n"))


@query
def legacy_score(spark, d):
    return documents(spark, d).groupBy(scoring.legacy_score(F.col("text")).alias("score")).agg(F.count("*").alias("n"))


@query
def feature_vector(spark, d):
    f = scoring.features(F.col("text"))
    whole = ("len", "word_count", "stop_word_hits")
    return documents(spark, d).select("doc_id", *[f[k].cast("long").alias(k) if k in whole else F.round(f[k], 6).alias(k) for k in f])


@query
def reject_reasons(spark, d):
    return documents(spark, d).groupBy(scoring.reject_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query
def short_label(spark, d):
    return documents(spark, d).select("doc_id", scoring.short_label(F.col("text"), X.LABELS).alias("label"))


@query
def length_stats(spark, d):
    return coverage.length_stats(documents(spark, d), F.char_length("text"))


@query
def length_buckets(spark, d):
    return coverage.length_buckets(documents(spark, d), F.char_length("text"))


def _covered(spark, d):
    """Each document with same (its text is a key) and part (a key stands in it); texts are compared by digests, so they are not shuffled."""
    keys, digest = _keys(spark, d), F.sha2(F.col("text").cast("binary"), 256)
    docs = documents(spark, d).select("doc_id", "text", digest.alias("digest"))
    found = matching.contained(docs.select("doc_id", "text"), keys).select(F.col("id").alias("doc_id")).distinct().withColumn("part", F.lit(True))
    same = keys.select(F.sha2(F.col("key").cast("binary"), 256).alias("digest")).distinct().withColumn("same", F.lit(True))
    both = docs.join(same, "digest", "left").join(found, "doc_id", "left")
    return both.select("doc_id", "text", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("same", "part")])


def _status(spark, d):
    white = text.whitelisted(F.col("text"), X.EXACT, X.REGEX, X.LITERAL)
    return _covered(spark, d).select("doc_id", "text", coverage.status(F.col("same"), F.col("part"), F.col("text"), white).alias("status"))


@query
def coverage_status(spark, d):
    return _status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query
def coverage_summary(spark, d):
    s = _status(spark, d).select(F.col("status").isin("exact", "partial", "han").alias("translated"), (F.col("status") == "whitelisted").alias("whitelisted"))
    return coverage.summary(s)


@query
def top_untranslated(spark, d):
    s = _status(spark, d).where("status = 'untranslated'").select("doc_id", scoring.score_text(F.col("text")).alias("score"), F.char_length("text").alias("n"))
    return coverage.top(s.where(scoring.classify(F.col("score")) == "prompt"), F.desc("score"), F.asc("doc_id"), k=50)


@query
def exact_match(spark, d):
    docs = documents(spark, d)
    return docs.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("first", "n")


@query
def key_is_text(spark, d):
    """Each document with the first that has its text."""
    docs = documents(spark, d).select("doc_id", "text")
    return matching.exact(docs, docs.groupBy(F.col("text").alias("key")).agg(F.min("doc_id").alias("key_id"))).select("doc_id", "key_id")


@query
def partial_match(spark, d):
    return matching.contained(documents(spark, d).select("doc_id", "text"), _keys(spark, d)).select(F.col("id").alias("doc_id"), "key_id")


@query
def stale_keys(spark, d):
    found = matching.contained(documents(spark, d).select("doc_id", "text"), _keys(spark, d))
    return matching.stale(_keys(spark, d), found, "key_id")


def _hits(spark, d):
    return matching.occurrences(documents(spark, d).select("doc_id", "text"), _values(spark, list(enumerate(X.KEYS)), "key_id long, key string"))


@query
def occurrences(spark, d):
    return _hits(spark, d).groupBy(F.col("id").alias("doc_id"), "key_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query
def span_overlap(spark, d):
    return matching.overlaps(_hits(spark, d)).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("hits"), F.count_if("nested").alias("nested"), F.count_if("conflict").alias("conflicts"))


@query
def audit_overlap(spark, d):
    found = matching.overlaps(_hits(spark, d), audit_compat=True)
    return found.groupBy("key_id").agg(F.count("*").alias("hits"), F.count_if("conflict").alias("conflicts"))


def _inside(spark, d):
    """Hits, and whether each lies in one line."""
    lines = documents(spark, d).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    order = W.partitionBy("id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("line") + 1).over(order), F.lit(0))
    spans = lines.select("id", start.alias("start"), (start + F.char_length("line")).alias("end")).where("end > start")
    return matching.in_spans(_hits(spark, d), spans)


@query
def hits_in_spans(spark, d):
    return _inside(spark, d).groupBy("key_id").agg(F.count("*").alias("hits"), F.count_if("inside").alias("inside"))


@query
def whitelist_static(spark, d):
    white = text.whitelisted(F.col("text"), X.EXACT, X.REGEX, X.LITERAL)
    return conversations(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.count_if(white).alias("whitelisted"))


def _residual(spark, d):
    return conversations(spark, d).select("conv_id", "turn", "role", F.explode(text.residual(F.col("text"), X.EXACT, X.REGEX, X.LITERAL)).alias("word"))


@query
def residual_tokens(spark, d):
    return _residual(spark, d).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_distinct"))


@query
def residual_by_label(spark, d):
    return _residual(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_distinct"), F.md5(F.array_join(F.sort_array(F.collect_set("word")), " ").cast("binary")).alias("words"))


@query
def strip_lines(spark, d):
    made = F.concat(F.lit("- tool-a:run-b: x\n  * Not:this\n"), F.col("text"), F.lit("\n\t* a:b:c"))
    rest, n = text.strip_dynamic_lines(made)
    return documents(spark, d).select("doc_id", F.md5(rest.cast("binary")).alias("digest"), n.cast("long").alias("n"))


@query
def strip_code(spark, d):
    return pages(spark, d).select("page_id", F.md5(text.strip_code(F.col("html")).cast("binary")).alias("digest"))


@query
def placeholder_check(spark, d):
    p = _values(spark, X.PAIRS, "id long, src string, dst string, allow_reorder boolean")
    return p.select("id", F.size(text.placeholders(F.col("src"))).cast("long").alias("n"), text.placeholders_safe(F.col("src"), F.col("dst"), F.col("allow_reorder")).alias("safe"))


@query
def fragment_split(spark, d):
    p = _values(spark, X.PAIRS, "id long, src string, dst string, allow_reorder boolean")
    return p.select("id", F.explode(text.fragments(F.col("src"))).alias("fragment"))


@query
def duplicate_sources(spark, d):
    return catalog.duplicate_sources(documents(spark, d).select(F.md5(F.col("text").cast("binary")).alias("src")))


@query
def sentinel_expand(spark, d):
    return catalog.expand_sentinels(_values(spark, X.SENTINELS, "entry long, src string, dst string"), _values(spark, X.VARIABLES, "name string, vars array<string>"))


@query
def glossary_violations(spark, d):
    found = glossary.violations(_values(spark, X.TERMS, "id long, src string, dst string"), X.KEEP, X.TRANSLATE, X.PHRASES)
    return glossary.summary(found)


def _scripts(spark, d):
    """id (page:place), source of every script of every page."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("k", "source")
    return pages(spark, d).select("page_id", found).select(F.format_string("%d:%d", "page_id", "k").alias("id"), "source")


@query
def scripts(spark, d):
    sources = _scripts(spark, d)
    return coverage.type_counts(L.literals(sources, "id", "source"), sources.select("id", F.octet_length("source").alias("size")))


@query
def array_groups(spark, d):
    lits = L.literals(_values(spark, X.SOURCES, "id long, src string"), "id", "src")
    return groups.mixed_templates(groups.array_groups(lits, "id"), "id").select("id", "start_off", "lit_type", "text", "array_group", "group_size", "template_group", "mixed")


@query
def latest_per_minor(spark, d):
    return versions.pick(_values(spark, [(v,) for v in X.VERSIONS], "version string"), 2)


@query
def version_hash_gate(spark, d):
    return versions.gate(_values(spark, X.FOUND, "version string, platform string, sha string"), _values(spark, X.CONFIG, "version string, platform string, expected string"))


@query
def version_reverse(spark, d):
    shas = _values(spark, sorted({(s,) for *_, s in X.FOUND}), "sha string")
    return versions.find_match(_values(spark, X.CONFIG, "version string, platform string, expected string"), shas)


@query
def version_matrix(spark, d):
    return versions.matrix(_values(spark, [(v,) for v in X.VERSIONS], "version string").distinct(), _values(spark, [("linux",), ("darwin",)], "platform string"))


@query
def round_robin_groups(spark, d):
    return catalog.round_robin(labels(spark, d).select("doc_id").distinct(), 7, -F.col("doc_id"), "doc_id")


@query
def merge_versions(spark, d):
    items = documents(spark, d).select(F.md5(F.col("text").cast("binary")).alias("src"), F.char_length("text").alias("score"), F.col("source").alias("version"), F.col("doc_id").alias("ord"))
    merged = catalog.merge_versions(items)
    return merged.select("src", "score", F.array_join("versions", ",").alias("versions"))


@query
def whitelist_merge(spark, d):
    c = conversations(spark, d)
    merged = catalog.merge_whitelist(c.where("role = 'user'").select("text"), c.where("role <> 'user'").select("text"))
    return merged.select(F.md5(F.col("text").cast("binary")).alias("digest"), F.char_length("text").cast("long").alias("n"))


@query
def capture_segments(spark, d):
    return capture.without_external(capture.segments(_values(spark, X.CAPTURES, "line long, body string")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _present(patterns) -> str:
    return "(" + " + ".join(f"CAST(contains(text, {_quoted(p)}) AS INT)" for p in patterns) + ")"


def _rows(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ", ".join(map(_quoted, v)) + "]" if isinstance(v, list) else _quoted(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {_quoted(p)})" for p in prefixes) + ")"


def _scored_sql() -> str:
    """Every rule as a column of its own over counts made once."""
    return f"""
base AS (SELECT doc_id, lang, text, length(text) AS n, regexp_extract_all(lower(text), '[a-z'']{{2,}}') AS words, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM documents),
counted AS (SELECT *, len(words) AS n_words, len(list_filter(words, lambda w: w IN {_list(R.STOP_WORDS)})) AS stops, len(regexp_extract_all(text, '[.,;:][ \\n)]')) AS marks,
  regexp_matches(text, '(?m)^#{{1,6}} \\S') AS heading, regexp_matches(text, '\\b(IMPORTANT|CRITICAL|NEVER|ALWAYS|MUST|NOTE):\\s') AS imperative,
  {_present(R.MINIFIED_TOKENS)} AS minified, {_present(R.CODE_MARKERS)} AS code FROM base),
scored AS (SELECT doc_id, lang, text, n,
  4 * CAST(heading AS INT) + 3 * CAST(regexp_matches(text, '^You (are|should|can|have|must|may)\\b') AS INT) + 3 * CAST(imperative AS INT)
  + 2 * CAST(regexp_matches(text, '\\$\\{{[\\w.]+\\}}') AS INT) + 2 * CAST(stops >= 3 AS INT)
  + 2 * CAST(regexp_matches(text, '<(example|commentary|when_to_save|how_to_use|types?|user|assistant)\\b') AS INT)
  + CASE WHEN n >= 200 THEN 2 WHEN n >= 80 THEN 1 ELSE 0 END + CAST(regexp_matches(text, '{R.HAN}') AS INT)
  + 3 * CAST(n >= 60 AND stops >= 3 AND NOT heading AND regexp_extract(text, '^\\s*([A-Za-z]+)', 1) IN {_list(R.DESCRIPTION_VERBS)} AS INT)
  + 2 * CAST(n >= 160 AND stops >= 8 AND marks >= 6 AND marks >= 0.045 * greatest(n_words, 1) AS INT)
  - 5 * CAST(regexp_matches(bare, '^https?://\\S+$') AS INT) - 5 * CAST(regexp_matches(bare, '^/?[A-Za-z0-9_\\-./]+\\.(ts|tsx|js|jsx|py|md|json|sh|toml)$') AS INT)
  - 5 * CAST(regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9_]*$') AS INT) - 3 * CAST(n_words = 0 AS INT) - 10 * CAST(code >= 2 AS INT)
  - 5 * CAST(regexp_matches(bare, '^[}})\\],;`&|][}})\\],;`\\\\&|]{{0,2}}\\s*(if|for|let|const|var|return|await|throw|else|q\\.|_\\.|H\\.|message:|P=|\\$\\{{|[a-zA-Z_$]+\\()') AS INT)
  - 3 * CAST({_starts("bare", R.CONFIG_PREFIXES)} AS INT)
  - 8 * CAST(minified >= 3 OR (minified >= 1 AND NOT imperative AND substr(bare, 1, 1) IN {_list(R.MINIFIED_LEAD)}) AS INT) AS score
  FROM counted)"""


_LEGACY = f"""
f0 AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '[a-zA-Z]+')) AS w, len(regexp_extract_all(text, '[a-zA-Z]')) AS letters,
  len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN {_list(R.LEGACY_STOP_WORDS)})) AS stops, len(regexp_extract_all(text, '[.?!]')) AS ends, {_present(R.LEGACY_KEYWORDS)} AS kw FROM documents)"""


def _hits_sql() -> str:
    return f"""
k(key_id, key) AS ({_rows(list(enumerate(X.KEYS)))}),
hits AS (SELECT doc_id, key_id, p - 1 AS pos, length(key) AS len FROM (SELECT doc_id, text, key_id, key, unnest(range(1, length(text) + 1)) AS p FROM documents, k WHERE contains(text, key)) WHERE substr(text, p, length(key)) = key)"""


def _white_sql(col: str = "text") -> str:
    out = col
    for s in sorted(X.EXACT, key=lambda s: (-len(s), s)):
        out = f"replace({out}, {_quoted(s)}, '')"
    for p in X.REGEX:
        out = f"regexp_replace({out}, {_quoted(p)}, '', 'g')"
    bare = f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"
    return f"({bare} = '' OR {bare} IN {_list(X.LITERAL)} OR NOT regexp_matches({out}, '[A-Za-z]{{3,}}'))"


def _residual_sql() -> str:
    out = "text"
    for s in sorted(X.LITERAL, key=lambda s: (-len(s), s)):
        out = f"replace({out}, {_quoted(s)}, ' ')"
    for s in sorted(X.EXACT, key=lambda s: (-len(s), s)):
        for _ in range(2):  # no lookaround: neighbours share a separator
            out = f"regexp_replace({out}, '(^|[^A-Za-z]){s}($|[^A-Za-z])', '\\1 \\2', 'g')"
    for p in X.REGEX:
        out = f"regexp_replace({out}, {_quoted(p)}, ' ', 'g')"
    return f"res AS (SELECT conv_id, turn, role, unnest(regexp_extract_all({out}, '[A-Za-z]{{3,}}')) AS word FROM conversations)"


def _status_sql() -> str:
    return f"""
st AS (SELECT doc_id, text, CASE WHEN text IN (SELECT text FROM benchmark) THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) >= 20 AND contains(d.text, b.text)) THEN 'partial'
  WHEN regexp_matches(text, '{R.HAN}') THEN 'han' WHEN {_white_sql()} THEN 'whitelisted' ELSE 'untranslated' END AS status FROM documents d)"""


def _strip_sql(column: str) -> str:
    out = column
    for p in R.CODE_AREAS:
        out = f"regexp_replace({out}, {_quoted(p)}, ' ', 'g')"
    return out


def _word_sql(column: str) -> str:
    """Whether the column word stands in a column as a whole word."""
    return f"regexp_matches({column}, '(^|[^A-Za-z0-9_])' || word || '($|[^A-Za-z0-9_])')"


def _mask_sql(column: str) -> str:
    return f"regexp_replace({column}, '(^|[^A-Za-z0-9_])' || word || '($|[^A-Za-z0-9_])', '\\1 \\2', 'g')"


_PH = R.PLACEHOLDER.replace("'", "''")
ORACLES: dict[str, str] = {
    "score_class_by_lang": f"WITH {_scored_sql()} SELECT lang, CASE WHEN score >= 5 THEN 'prompt' WHEN score >= 3 THEN 'weak' ELSE 'skip' END AS class, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM scored GROUP BY ALL",
    "score_histogram": f"WITH {_scored_sql()}, {_status_sql()} SELECT score, count(*) AS n FROM scored JOIN st USING (doc_id) WHERE status = 'untranslated' GROUP BY score",
    "legacy_score": f"""WITH {_LEGACY} SELECT CASE WHEN w = 0 THEN 0 ELSE CAST(n >= 40 AS INT) + 2 * CAST(n >= 100 AS INT) + 2 * CAST(stops >= 3 AS INT) + 3 * CAST(stops >= 8 AS INT)
        + 2 * CAST(stops / w >= 0.15 AS INT) + CAST(letters / w >= 4 AS INT) + 4 * CAST(regexp_matches(text, '^\\s*#') AS INT) + 2 * CAST(regexp_matches(text, '^\\s*[-*]\\s') AS INT)
        + CAST(ends / n >= 0.005 AS INT) + 2 * CAST(kw >= 1 AS INT) + 3 * CAST(kw >= 3 AS INT) END AS score, count(*) AS n FROM f0 GROUP BY 1""",
    "feature_vector": f"""WITH {_LEGACY} SELECT doc_id, CAST(n AS BIGINT) AS len, round(len(regexp_extract_all(text, '[{{}}();,=<>$]')) / greatest(n, 1), 6) AS code_ratio, round(len(regexp_extract_all(text, ' ')) / greatest(n, 1), 6) AS space_ratio, round(len(regexp_extract_all(text, '\\pL')) / greatest(n, 1), 6) AS alpha_ratio,
        round(ends / greatest(n, 1), 6) AS period_density, CAST(w AS BIGINT) AS word_count, round(letters / greatest(w, 1), 6) AS avg_word_len, CAST(stops AS BIGINT) AS stop_word_hits FROM f0""",
    "reject_reasons": f"""WITH {_LEGACY} SELECT CASE WHEN n < 40 THEN 'too_short' WHEN regexp_matches(text, 'function\\(|=>|===|!==') OR len(regexp_extract_all(text, '\\{{')) > 3 THEN 'js_code'
        WHEN len(regexp_extract_all(text, '[{{}}();,=<>$]')) / n > 0.05 THEN 'code_ratio' WHEN len(regexp_extract_all(text, '\\pL')) / n < 0.5 THEN 'alpha_ratio' WHEN len(regexp_extract_all(text, ' ')) / n < 0.08 THEN 'space_ratio'
        WHEN letters / greatest(w, 1) < 3.5 THEN 'short_words' WHEN stops < 3 THEN 'few_stopwords' WHEN contains(text, '\\fB') OR contains(text, '\\fP') THEN 'troff'
        WHEN len(regexp_extract_all(text, '--[a-z][a-z\\-]+')) > 5 THEN 'cli_help' ELSE 'PASS' END AS reason, count(*) AS n FROM f0 GROUP BY 1""",
    "short_label": "WITH h AS (SELECT doc_id, split_part(substr(text, 1, list_max(list_filter(range(0, 201), lambda n: strlen(substr(text, 1, n)) <= 200))), '.', 1) AS head FROM documents) SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(head, '(?i){p}') THEN {_quoted(n)}" for p, n in X.LABELS)
    + " ELSE lower(array_to_string(list_slice(regexp_extract_all(head, '[a-zA-Z]+'), 1, 4), '_')) END AS label FROM h",
    "length_stats": """WITH o AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS c FROM documents)
        SELECT CAST(min(n) AS BIGINT) AS min_len, median(n) AS median_len, CAST(max(CASE WHEN i = CAST(floor(c * 0.95) AS BIGINT) THEN n END) AS BIGINT) AS p95_len, CAST(max(n) AS BIGINT) AS max_len FROM o""",
    "length_buckets": "SELECT count(*) FILTER (length(text) < 60) AS short, count(*) FILTER (length(text) >= 60 AND length(text) < 200) AS middle, count(*) FILTER (length(text) >= 200) AS long FROM documents",
    "coverage_status": f"WITH {_status_sql()} SELECT status, count(*) AS n FROM st GROUP BY status",
    "coverage_summary": f"""WITH {_status_sql()}, t AS (SELECT count(*) AS total, count(*) FILTER (status IN ('exact', 'partial', 'han')) AS translated, count(*) FILTER (status = 'whitelisted') AS whitelisted, count(*) FILTER (status = 'untranslated') AS untranslated FROM st)
        SELECT *, round(100 * translated / total, 4) AS translated_pct, round(100 * untranslated / total, 4) AS untranslated_pct FROM t""",
    "top_untranslated": f"WITH {_status_sql()}, {_scored_sql()} SELECT doc_id, score, n FROM scored JOIN st USING (doc_id) WHERE status = 'untranslated' AND score >= 5 ORDER BY score DESC, doc_id LIMIT 50",
    "exact_match": "SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "key_is_text": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS key_id FROM documents",
    "partial_match": "SELECT doc_id, item_id AS key_id FROM documents d JOIN benchmark b ON length(b.text) >= 20 AND contains(d.text, b.text)",
    "stale_keys": "SELECT DISTINCT item_id AS key_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE length(b.text) >= 20 AND contains(d.text, b.text))",
    "occurrences": f"WITH {_hits_sql()} SELECT doc_id, key_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM hits GROUP BY doc_id, key_id",
    "span_overlap": f"""WITH {_hits_sql()}, m AS (SELECT *, max(pos + len) OVER (PARTITION BY doc_id ORDER BY pos, len DESC, key_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits)
        SELECT doc_id, count(*) AS hits, count(*) FILTER (pos + len <= reach) AS nested, count(*) FILTER (pos < reach AND pos + len > reach) AS conflicts FROM m GROUP BY doc_id""",
    "audit_overlap": f"""WITH {_hits_sql()}, m AS (SELECT *, max(pos + len) OVER (PARTITION BY doc_id ORDER BY pos, len, key_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits)
        SELECT key_id, count(*) AS hits, count(*) FILTER (pos < reach AND pos + len > reach) AS conflicts FROM m GROUP BY key_id""",
    "hits_in_spans": f"WITH {_hits_sql()} SELECT key_id, count(*) AS hits, count(*) FILTER (NOT contains(substr(text, pos + 1, len), chr(10))) AS inside FROM hits JOIN documents USING (doc_id) GROUP BY key_id",
    "whitelist_static": f"SELECT role, count(*) AS n, count(*) FILTER ({_white_sql()}) AS whitelisted FROM conversations GROUP BY role",
    "residual_tokens": f"WITH {_residual_sql()} SELECT conv_id, turn, count(*) AS n, count(DISTINCT word) AS n_distinct FROM res GROUP BY conv_id, turn",
    "residual_by_label": f"WITH {_residual_sql()} SELECT role, count(*) AS n, count(DISTINCT word) AS n_distinct, md5(string_agg(DISTINCT word, ' ' ORDER BY word)) AS words FROM res GROUP BY role",
    "strip_lines": """WITH t AS (SELECT doc_id, '- tool-a:run-b: x' || chr(10) || '  * Not:this' || chr(10) || text || chr(10) || chr(9) || '* a:b:c' AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(t, '(?m)^[ \\t]*[-*][ \\t]+[a-z][\\w\\-]*:[\\w\\-]+:.*$', '', 'g')) AS digest, CAST(len(regexp_extract_all(t, '(?m)^[ \\t]*[-*][ \\t]+[a-z][\\w\\-]*:[\\w\\-]+:.*$')) AS BIGINT) AS n FROM t""",
    "strip_code": """SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '(?m)^(?:[ \\t]{2,}|\\t).*$', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'),
        '"[^"\\n]*"|''[^''\\n]*''', ' ', 'g'), '<[^>\\n]{1,40}>', ' ', 'g')) AS digest FROM pages""",
    "placeholder_check": f"""WITH p(id, src, dst, ok) AS ({_rows(X.PAIRS)}), q AS (SELECT id, ok, regexp_extract_all(src, '{_PH}') AS a, regexp_extract_all(dst, '{_PH}') AS b FROM p)
        SELECT CAST(id AS BIGINT) AS id, CAST(len(a) AS BIGINT) AS n, CASE WHEN ok THEN list_sort(a) = list_sort(b) ELSE a = b END AS safe FROM q""",
    "fragment_split": f"WITH p(id, src, dst, ok) AS ({_rows(X.PAIRS)}), q AS (SELECT id, unnest(regexp_split_to_array(src, '{_PH}')) AS fragment FROM p) SELECT CAST(id AS BIGINT) AS id, fragment FROM q WHERE length(fragment) >= 8",
    "duplicate_sources": "SELECT md5(text) AS src, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "sentinel_expand": f"""WITH e(entry, src, dst) AS ({_rows(X.SENTINELS)}), v(name, vars) AS ({_rows(X.VARIABLES)}),
        u AS (SELECT e.*, v.name, vars, unnest(range(1, len(vars) + 1)) AS k FROM e JOIN v ON contains(src, '$' || '{{' || name || '}}')),
        gone AS (SELECT DISTINCT entry FROM e JOIN v ON contains(src, '$' || '{{' || name || '}}') WHERE len(vars) = 0),
        p AS (SELECT entry, src, dst, k, list(struct_pack(n := name, x := vars[k]) ORDER BY name) AS pairs FROM u WHERE entry NOT IN (SELECT entry FROM gone) GROUP BY ALL),
        m AS (SELECT entry, replace(replace(src, '$' || '{{' || pairs[1].n || '}}', pairs[1].x), '$' || '{{' || coalesce(pairs[2].n, '-') || '}}', coalesce(pairs[2].x, '')) AS src,
              replace(replace(dst, '$' || '{{' || pairs[1].n || '}}', pairs[1].x), '$' || '{{' || coalesce(pairs[2].n, '-') || '}}', coalesce(pairs[2].x, '')) AS dst FROM p)
        SELECT CAST(entry AS BIGINT) AS entry, src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM v WHERE contains(src, '$' || '{{' || name || '}}')) UNION ALL SELECT DISTINCT CAST(entry AS BIGINT), src, dst FROM m""",
    "latest_per_minor": f"""WITH v(version) AS ({_rows([(x,) for x in X.VERSIONS])}), p AS (SELECT DISTINCT version, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c FROM v WHERE regexp_matches(version, '^\\d+\\.\\d+\\.\\d+$')),
        r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c DESC) AS i, max(a * 100000 + b) OVER () AS m FROM p) SELECT version FROM r WHERE i = 1 OR (i <= 2 AND a * 100000 + b = m)""",
    "version_hash_gate": f"WITH f(version, platform, sha) AS ({_rows(X.FOUND)}), c(version, platform, expected) AS ({_rows(X.CONFIG)}) SELECT version, platform, sha, CASE WHEN expected IS NULL THEN 'unlisted' WHEN sha = expected THEN 'ok' ELSE 'mismatch' END AS status FROM f LEFT JOIN c USING (version, platform)",
    "version_reverse": f"""WITH f(version, platform, sha) AS ({_rows(X.FOUND)}), c(version, platform, expected) AS ({_rows(X.CONFIG)}), r AS (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT), platform) AS i FROM c)
        SELECT s.sha, r.version, r.platform FROM (SELECT DISTINCT sha FROM f) s LEFT JOIN r ON r.expected = s.sha AND i = 1""",
    "version_matrix": f"WITH v(version) AS ({_rows([(x,) for x in X.VERSIONS])}), p(platform) AS (VALUES ('linux'), ('darwin')) SELECT * FROM (SELECT DISTINCT version FROM v), p",
    "round_robin_groups": "WITH b AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id DESC) - 1) % 7 AS BIGINT) AS part FROM b",
    "merge_versions": "SELECT md5(text) AS src, CAST(min(length(text)) AS INT) AS score, string_agg(source, ',' ORDER BY doc_id) AS versions FROM documents GROUP BY 1",
    "whitelist_merge": "WITH t AS (SELECT DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) SELECT md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM t WHERE t <> ''",
    "scripts": """WITH s AS (SELECT page_id || ':' || (k - 1) AS id, x AS source FROM (SELECT page_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS l FROM pages))),
        q AS (SELECT id, strlen(source) AS size, unnest(regexp_extract_all(source, '"([^"\\\\]|\\\\.)*"')) AS t FROM s)
        SELECT id, 'dq' AS lit_type, count(*) AS n, CAST(sum(strlen(t) - 2) AS BIGINT) AS bytes, round(100 * sum(strlen(t) - 2) / any_value(size), 4) AS share FROM q GROUP BY id""",
    "glossary_violations": f"""WITH RECURSIVE t(id, src, dst) AS ({_rows(X.TERMS)}), ph(word, i) AS ({_rows([(p, i) for i, p in enumerate(sorted(X.PHRASES, key=lambda s: (-len(s), s)), 1)])}),
        s AS (SELECT id, {_strip_sql("src")} AS a, {_strip_sql("dst")} AS b FROM t),
        m AS (SELECT id, a, b, 0 AS i, NULL::VARCHAR AS lost FROM s UNION ALL
          SELECT id, {_mask_sql("a")}, CASE WHEN {_word_sql("a")} THEN {_mask_sql("b")} ELSE b END, ph.i, CASE WHEN {_word_sql("a")} AND NOT {_word_sql("b")} THEN word END FROM m JOIN ph ON ph.i = m.i + 1),
        f AS (SELECT id, a, b FROM m WHERE i = {len(X.PHRASES)}), w(word, keep) AS ({_rows([(w, True) for w in X.KEEP] + [(w, False) for w in X.TRANSLATE])})
        SELECT 'phrase_keep' AS kind, lost AS word, count(*) AS n FROM m WHERE lost IS NOT NULL GROUP BY lost UNION ALL
        SELECT CASE WHEN keep THEN 'keep_lost' ELSE 'kept_english' END, word, count(*) FROM f, w WHERE {_word_sql("a")} AND {_word_sql("b")} <> keep GROUP BY keep, word""",
    "capture_segments": f"""WITH c(line, body) AS ({_rows(X.CAPTURES)}), j AS (SELECT line, CAST(body AS JSON) AS body FROM c WHERE TRY_CAST(body AS JSON) IS NOT NULL),
        sys AS (SELECT line, unnest(range(CAST(json_array_length(body, '$.system') AS BIGINT))) AS i, body FROM j WHERE json_type(body, '$.system') = 'ARRAY'),
        tool AS (SELECT line, i, json_extract(body, '$.tools[' || i || ']') AS t FROM (SELECT line, unnest(range(CAST(json_array_length(body, '$.tools') AS BIGINT))) AS i, body FROM j WHERE json_type(body, '$.tools') = 'ARRAY')),
        named AS (SELECT t, 'rec' || line || '.tool[' || i || ':' || coalesce(t ->> '$.name', '?') || ']' AS label FROM tool WHERE json_type(t) = 'OBJECT'),
        deep AS (SELECT label || '.input_schema' || substr(fullkey, 2) AS label, value ->> '$' AS text FROM (SELECT label, json_extract(t, '$.input_schema') AS s FROM named WHERE json_type(t, '$.input_schema') = 'OBJECT'), json_tree(s) AS x WHERE x.key = 'description' AND x.type = 'VARCHAR'),
        al AS (SELECT 'rec' || line || '.sys[' || i || ']' AS label, json_extract_string(body, '$.system[' || i || '].text') AS text, true AS blank FROM sys UNION ALL
          SELECT label || '.description', t ->> '$.description', false FROM named WHERE json_type(t, '$.description') = 'VARCHAR' UNION ALL SELECT label, text, false FROM deep)
        SELECT label, text FROM al WHERE text <> '' AND (blank OR regexp_matches(text, '\\S')) AND NOT contains(label, 'mcp__')""",
}
