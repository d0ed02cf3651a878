"""More queries over the driver's tables: audits, sets of versions, digests, containers and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions import rules as R
from ..functions import text
from ..operators import audit, catalog, matching
from ..sources import container
from . import fixtures as X
from .queries import ORACLES, _hits, _hits_sql, _inside, _list, _quoted, _rows, _values, conversations, documents, pages, query

_PAIRS = "key_id long, src string, dst string, allow_reorder boolean"
_ENTRIES = [(i, k, k.upper(), True) for i, k in enumerate(X.KEYS)] + [(i + 100, *rest) for i, *rest in X.PAIRS]
_DQ = r'"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"'
_SQ = r"'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'"
_QUOTED = {"dq": _DQ, "sq": _SQ, "bt": r"`[^`\\]*(?:\\.[^`\\]*)*`"}


@query
def audit_risks(spark, d):
    return audit.risks(_values(spark, _ENTRIES, _PAIRS), _inside(spark, d))


@query
def size_plan(spark, d):
    delta = F.octet_length("dst") - F.octet_length("src")
    hits = _hits(spark, d).groupBy("key_id").agg(F.count("*").alias("hits"))  # counted before the join, which would send all hits of a key to one task
    return hits.join(_values(spark, _ENTRIES, _PAIRS), "key_id").groupBy("key_id").agg(F.sum("hits").alias("n"), F.sum(F.col("hits") * delta).cast("long").alias("delta"))


@query
def unique_matches(spark, d):
    docs = documents(spark, d)
    one = [F.count_if(F.regexp_count("text", F.lit(text.quote(k))) == 1).alias(f"k{i}") for i, k in enumerate(X.KEYS)]
    return docs.agg(*one)


@query
def stale_whitelist(spark, d):
    words = _values(spark, [(i, w) for i, w in enumerate(X.WHITE)], "key_id long, key string")
    found = matching.occurrences(documents(spark, d).select("doc_id", "text"), words, first_only=True)
    return matching.stale(words, found, "key_id")


@query
def search_forms(spark, d):
    rows = [(i, form, kind) for i, t in enumerate(X.FORMS) for form, kind in L.search_forms(t)]
    return _values(spark, rows, "id long, form string, lit_type string")


@query
def quoted_literals(spark, d):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("html", F.lit(r), F.lit(0)).alias("found")) for k, r in _QUOTED.items()])
    both = pages(spark, d).select("page_id", F.explode(kinds).alias("k")).select("page_id", "k.kind", F.explode("k.found").alias("literal"))
    return both.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("literal").alias("n_distinct"), F.sum(F.octet_length("literal")).alias("bytes"))


@query
def text_digests(spark, d):
    return pages(spark, d).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.md5(F.col("html").cast("binary")).alias("md5"))


@query
def text_previews(spark, d):
    return documents(spark, d).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query
def translated_texts(spark, d):
    return conversations(spark, d).groupBy(F.col("text").rlike(R.HAN).alias("han")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query
def distinct_texts(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.countDistinct("text").alias("n"))


@query
def reload_items(spark, d):
    """Of rows that repeat a source the last one wins."""
    return documents(spark, d).groupBy(F.md5(F.col("text").cast("binary")).alias("src")).agg(F.max("doc_id").alias("doc_id"))


@query
def longest_texts(spark, d):
    return documents(spark, d).select("doc_id", F.char_length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(30)  # a top-k report


@query
def numbered_texts(spark, d):
    some = documents(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes >= 100")
    return catalog.numbered(some, -F.col("bytes"), "doc_id")


@query
def sentinel_names(spark, d):
    rows = _values(spark, X.MARKED, "id long, src string")
    return rows.select("id", F.posexplode(catalog.sentinels_in(F.col("src"), [n for n, _ in X.VARIABLES])).alias("i", "name")).select("id", F.col("i").cast("long").alias("i"), "name")


@query
def sentinel_resolve(spark, d):
    return catalog.resolve(_values(spark, X.BUFFERS, "id long, buffer string"), X.DECLARED)


@query
def version_flatten(spark, d):
    import json

    config: dict = {}
    for v, p, s in X.CONFIG:
        config.setdefault(v, {})[p] = s
    rows = _values(spark, [(json.dumps(config),)], "body string").select(F.explode(F.from_json("body", "map<string,map<string,string>>")).alias("version", "p"))
    return rows.select("version", F.explode("p").alias("platform", "expected"))


@query
def version_sets(spark, d):
    run, known = _values(spark, [(v,) for v in X.VERSIONS], "version string"), _values(spark, [(v,) for v, *_ in X.CONFIG], "version string")
    return run.intersect(known).withColumn("kind", F.lit("both")).union(run.subtract(known).withColumn("kind", F.lit("run"))).union(known.subtract(run).withColumn("kind", F.lit("known")))


@query
def unsupported_hashes(spark, d):
    return _values(spark, X.FOUND, "version string, platform string, sha string").join(_values(spark, X.CONFIG, "version string, platform string, sha string").select("sha"), "sha", "left_anti").select("version", "platform", "sha")


@query
def container_format(spark, d):
    return _values(spark, X.HEADS, "id long, head string").select("id", container.file_format(F.unhex("head")).alias("platform"))


_DUCK_PREVIEW = "CASE WHEN length(text) > 80 THEN replace(substr(text, 1, 80), chr(10), '\\n') || '…' ELSE replace(text, chr(10), '\\n') END"
ORACLES |= {
    "audit_risks": f"""WITH {_hits_sql()}, e(key_id, src, dst, ok) AS ({_rows(_ENTRIES)}),
        h AS (SELECT key_id, count(*) AS n, count(*) FILTER (NOT contains(substr(text, pos + 1, len), chr(10))) AS within FROM hits JOIN documents USING (doc_id) GROUP BY key_id),
        p AS (SELECT e.*, coalesce(n, 0) AS n, coalesce(within, 0) AS within, regexp_extract_all(src, {_quoted(R.PLACEHOLDER)}) AS a, regexp_extract_all(dst, {_quoted(R.PLACEHOLDER)}) AS b FROM e LEFT JOIN h USING (key_id))
        SELECT count(*) AS total, count(*) FILTER (n >= 2) AS risk_a, CAST(coalesce(sum(n) FILTER (len(a) = 0 AND within = 0), 0) AS BIGINT) AS risk_b,
        count(*) FILTER (len(a) = 0 AND within > 0 AND n > within) AS missed, 0::BIGINT AS risk_c,
        count(*) FILTER (len(a) > 0 AND CASE WHEN ok THEN list_sort(a) <> list_sort(b) ELSE a <> b END) AS risk_e FROM p""",
    "size_plan": f"WITH {_hits_sql()}, e(key_id, src, dst, ok) AS ({_rows(_ENTRIES)}) SELECT CAST(key_id AS BIGINT) AS key_id, count(*) AS n, CAST(sum(strlen(dst) - strlen(src)) AS BIGINT) AS delta FROM hits JOIN e USING (key_id) GROUP BY key_id",
    "unique_matches": "SELECT " + ", ".join(f"count(*) FILTER ((length(text) - length(replace(text, {_quoted(k)}, ''))) = {len(k)}) AS k{i}" for i, k in enumerate(X.KEYS)) + " FROM documents",
    "stale_whitelist": f"WITH w(key_id, w) AS ({_rows(list(enumerate(X.WHITE)))}) SELECT CAST(key_id AS BIGINT) AS key_id FROM w WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, w))",
    "search_forms": f"""WITH t(id, t) AS ({_rows(list(enumerate(X.FORMS)))}), e AS (SELECT id, t, replace(t, chr(92), chr(92) || chr(92)) AS b FROM t),
        k AS (SELECT id, 0 AS i, t AS form, 'raw' AS lit_type FROM t UNION ALL SELECT id, 1, replace(replace(b, '"', chr(92) || '"'), chr(10), chr(92) || 'n'), 'dq' FROM e
          UNION ALL SELECT id, 3, replace(replace(b, chr(39), chr(92) || chr(39)), chr(10), chr(92) || 'n'), 'sq' FROM e UNION ALL SELECT id, 5, replace(replace(b, '`', chr(92) || '`'), '$', chr(92) || '$'), 'tmpl_frag' FROM e),
        a AS (SELECT * FROM k UNION ALL SELECT id, i + 1, replace(form, 'é', chr(92) || 'u00e9'), lit_type FROM k WHERE i > 0)
        SELECT CAST(id AS BIGINT) AS id, form, arg_min(lit_type, i) AS lit_type FROM a GROUP BY id, form""",
    "quoted_literals": " UNION ALL ".join(
        f"SELECT page_id, '{k}' AS kind, count(*) AS n, count(DISTINCT t) AS n_distinct, CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM (SELECT page_id, unnest(regexp_extract_all(html, {_quoted(p)})) AS t FROM pages) GROUP BY page_id" for k, p in _QUOTED.items()
    ),
    "text_digests": "SELECT page_id, sha256(html) AS sha, md5(html) AS md5 FROM pages",
    "text_previews": f"SELECT doc_id, {_DUCK_PREVIEW} AS preview FROM documents",
    "translated_texts": f"SELECT regexp_matches(text, '{R.HAN}') AS han, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1",
    "distinct_texts": "SELECT lang, count(DISTINCT text) AS n FROM documents GROUP BY lang",
    "reload_items": "SELECT md5(text) AS src, max(doc_id) AS doc_id FROM documents GROUP BY 1",
    "longest_texts": "SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 30",
    "numbered_texts": "SELECT doc_id, strlen(text) AS bytes, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) AS place FROM documents WHERE strlen(text) >= 100",
    "sentinel_names": f"WITH m(id, src) AS ({_rows(X.MARKED)}), a AS (SELECT id, regexp_extract_all(src, '\\$\\{{(__[A-Z0-9_]+__)\\}}', 1) AS names FROM m), b AS (SELECT id, unnest(names) AS name, unnest(range(len(names))) AS nr FROM a), c AS (SELECT id, name, min(nr) AS nr FROM b WHERE name IN {_list([n for n, _ in X.VARIABLES])} GROUP BY id, name) SELECT CAST(id AS BIGINT) AS id, row_number() OVER (PARTITION BY id ORDER BY nr) - 1 AS i, name FROM c",
    "sentinel_resolve": f"WITH b(id, buffer) AS ({_rows(X.BUFFERS)}), "
    # the k-th declaration of a name looks at the k-th place of its anchor
    r"""p AS (SELECT id, buffer, unnest(range(1, length(buffer) + 1)) AS p FROM b),
        n AS (SELECT id, 'n' AS name, p, regexp_extract(substr(buffer, p), '^A(\$\{[\w.$]+\})B', 1) AS var FROM p WHERE substr(buffer, p, 1) = 'A' QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) <= 3),
        m AS (SELECT id, 'm' AS name, p, regexp_extract(substr(buffer, 1, p - 1), '(\$\{[\w.$]+\})$', 1) AS var FROM p WHERE substr(buffer, p, 1) = 'Q' QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) <= 1)
        SELECT CAST(id AS BIGINT) AS id, name, row_number() OVER (PARTITION BY id, name ORDER BY p) AS k, var FROM (SELECT * FROM n UNION ALL SELECT * FROM m) WHERE var <> ''""",
    "version_flatten": f"SELECT * FROM ({_rows(X.CONFIG)}) t(version, platform, expected)",
    "version_sets": f"WITH r(version) AS ({_rows([(v,) for v in X.VERSIONS])}), k(version) AS ({_rows([(v,) for v, *_ in X.CONFIG])}) SELECT version, 'both' AS kind FROM (SELECT * FROM r INTERSECT SELECT * FROM k) UNION ALL SELECT version, 'run' FROM (SELECT * FROM r EXCEPT SELECT * FROM k) UNION ALL SELECT version, 'known' FROM (SELECT * FROM k EXCEPT SELECT * FROM r)",
    "unsupported_hashes": f"WITH f(version, platform, sha) AS ({_rows(X.FOUND)}), c(version, platform, expected) AS ({_rows(X.CONFIG)}) SELECT * FROM f WHERE sha NOT IN (SELECT expected FROM c)",
    "container_format": f"WITH h(id, head) AS ({_rows(X.HEADS)}) SELECT CAST(id AS BIGINT) AS id, CASE WHEN head LIKE '7F454C46%' THEN 'linux' WHEN head LIKE 'CFFAEDFE%' OR head LIKE 'FEEDFACF%' THEN 'darwin' WHEN head LIKE '4D5A%' THEN 'win32' END AS platform FROM h",
}
