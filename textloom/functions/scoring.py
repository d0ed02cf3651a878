"""Scores that tell prose from code and identifiers, as built-in column expressions only (whole-stage code, no Python)."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import let, quote, strip


_MARK, _JOINT = r"[(){}=;:\[`/!]", r"[.,][A-Za-z_]"


def present(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in text (each counts once).

    Long lists are of code: all their patterns have a mark, or a letter right after a full stop or comma, or are a few
    words. One look tells that a text has none of these, as most prose, and spares it the search for each pattern.
    """
    count = reduce(add, [F.contains(text, F.lit(p)).cast("int") for p in patterns], F.lit(0))
    if len(patterns) < 20:
        return count
    others = [quote(p) for p in patterns if not re.search(f"{_MARK}|{_JOINT}", p)]
    return F.when(text.rlike("|".join([_MARK, _JOINT, *others])), count).otherwise(0)


def _branches(words: list[str]) -> str:
    """A pattern of the words that tries each letter once: words with a common beginning share it."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    out = [c + (_branches(rest) if any(rest) else "") for c, rest in heads.items()]
    whole = "(?:" + "|".join(out) + ")" if len(out) > 1 else out[0]
    return whole + "?" if "" in words and len(out) == 1 and len(out[0]) == 1 else f"(?:{whole})?" if "" in words else whole


def words_in(text: Column, words: list[str]) -> Column:
    """How often the listed words occur among the runs of two letters or apostrophes or more."""
    return F.regexp_count(F.lower(text), F.lit("(?<![a-z'])" + _branches(sorted(w for w in words if len(w) > 1)) + "(?![a-z'])"))


def score_rules(text: Column, sdk: list[str] = (), errors: list[str] = (), browser: list[str] = ()) -> list[tuple[str, Column, int]]:
    """(tag, condition, weight) of every rule. sdk, errors and browser: a product's own phrases, which the user supplies."""
    n = F.char_length(text)
    words = F.regexp_count(F.lower(text), F.lit("[a-z']{2,}"))
    stops = words_in(text, R.STOP_WORDS)
    heading, imperative, bare = text.rlike(R.HEADING), text.rlike(R.IMPERATIVE), strip(text)
    marks = F.regexp_count(text, F.lit(R.SENTENCE_MARK))
    minified = present(text, R.MINIFIED_TOKENS)
    # the rule data holds weights and patterns; here is what they mean
    conditions = {
        "markdown_heading": heading, "starts_with_You": text.rlike(R.ADDRESS), "imperative_marker": imperative, "has_placeholder": text.rlike(R.VARIABLE),
        "stop_words": stops >= 3, "xml_tags": text.rlike(R.TAGS), "long": n >= 200, "medium": (n >= 80) & (n < 200), "has_han": text.rlike(R.HAN),
        "desc_verb_lead": (n >= 60) & (stops >= 3) & F.regexp_extract(text, r"(?U)^\s*([A-Za-z]+)", 1).isin(R.DESCRIPTION_VERBS) & ~heading,
        "prose_structure": (n >= 160) & (stops >= 8) & (marks >= 6) & (marks >= 0.045 * F.greatest(words, F.lit(1))),
        "url": bare.rlike(R.URL), "path": bare.rlike(R.PATH), "identifier": bare.rlike(R.IDENTIFIER), "no_words": words == 0,
        "js_code": present(text, R.CODE_MARKERS) >= 2, "js_punct_lead": bare.rlike(R.CODE_LEAD),
        "minified_js": (minified >= 3) | (F.substring(bare, 1, 1).isin(list(R.MINIFIED_LEAD)) & (minified >= 1) & ~imperative),
        "config_desc": reduce(or_, [F.startswith(bare, F.lit(p)) for p in R.CONFIG_PREFIXES]),
    }
    for tag, phrases in (("sdk_string", sdk), ("sdk_error", errors), ("browser_tool", browser)):
        if phrases:
            conditions[tag] = present(text, list(phrases)) >= 1
    if browser:
        conditions["browser_tool"] &= ~text.rlike(R.IDEOGRAPH)
    return [(tag, conditions[tag], weight) for tag, weight in R.WEIGHTS.items() if tag in conditions]


def score_text(text: Column, **lists) -> Column:
    """The sum of the weights of the rules that hold; a null text scores as an empty one."""
    rules = score_rules(F.coalesce(text, F.lit("")), **lists)
    return reduce(add, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for _, c, w in rules])


def evidence(text: Column, **lists) -> Column:
    rules = score_rules(F.coalesce(text, F.lit("")), **lists)
    return F.array_compact(F.array(*[F.when(c, F.lit(tag)) for tag, c, _ in rules]))


def classify(score: Column, group_size: Column | None = None, min_score: int = 3) -> Column:
    """prompt from 5 points, weak from min_score, else skip; a group of 3 literals or more adds a point."""
    if group_size is not None:
        score = score + F.when(group_size >= 3, 1).otherwise(0)
    return F.when(score >= 5, "prompt").when(score >= min_score, "weak").otherwise("skip")


def legacy_features(text: Column, words: Column | None = None, stops: Column | None = None) -> dict[str, Column]:
    """What the older scorer looks at; words and stops: the two counts, where they are known."""
    words = F.regexp_count(text, F.lit("[a-zA-Z]+")) if words is None else words
    letters = F.octet_length(F.regexp_replace(text, "[^a-zA-Z]+", ""))
    n = F.char_length(text)
    stops = F.regexp_count(F.lower(text), F.lit("(?<![a-z])" + _branches(R.LEGACY_STOP_WORDS) + "(?![a-z])")) if stops is None else stops
    ends = reduce(add, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in ".?!"])
    return {
        "words": words, "stop_hits": stops, "stop_density": stops / F.greatest(words, F.lit(1)), "avg_word_len": letters / F.greatest(words, F.lit(1)),
        "md_title": text.rlike(r"^\s*#"), "md_bullet": text.rlike(r"^\s*[-*]\s"), "period_density": ends / F.greatest(n, F.lit(1)), "keyword_hits": present(text, R.LEGACY_KEYWORDS),
    }


def legacy_breakdown(text: Column) -> Column:
    """What the older scorer looks at, as a struct; densities and means to three places."""
    f = legacy_features(text)
    thirds = ("stop_density", "avg_word_len", "period_density")
    return F.struct(F.char_length(text).alias("len"), *[F.bround(c, 3).alias(k) if k in thirds else c.alias(k) for k, c in f.items()])


def legacy_score(text: Column) -> Column:
    """The older scorer: eleven cumulative rules; a text without words scores 0."""

    def score(f: Column) -> Column:
        rules = [
            (f["n"] >= 40, 1), (f["n"] >= 100, 2), (f["stop_hits"] >= 3, 2), (f["stop_hits"] >= 8, 3), (f["stop_density"] >= 0.15, 2), (f["avg_word_len"] >= 4, 1),
            (f["md_title"], 4), (f["md_bullet"], 2), (f["period_density"] >= 0.005, 1), (f["keyword_hits"] >= 1, 2), (f["keyword_hits"] >= 3, 3),
        ]
        return F.when(f["words"] == 0, 0).otherwise(reduce(add, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in rules]))

    counts = ("words", "stop_hits")
    f = legacy_features(text)
    # words and stop words are counted first, once: densities divide by these counts
    first = F.struct(F.char_length(text).alias("n"), *[f[k].alias(k) for k in counts])
    rest = lambda c: legacy_features(text, c["words"], c["stop_hits"])
    return let(first, lambda c: let(F.struct(c["n"].alias("n"), *[x.alias(k) for k, x in rest(c).items()]), score))


def features(text: Column) -> dict[str, Column]:
    n = F.char_length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(n, F.lit(1))
    f = legacy_features(text)
    return {"len": n, "code_ratio": share(r"[{}();,=<>$]"), "alpha_ratio": share(r"\p{L}"), "space_ratio": share(" "), "period_density": share("[.?!]"), "word_count": f["words"], "avg_word_len": f["avg_word_len"], "stop_word_hits": f["stop_hits"]}


def reject_reason(text: Column, least: int = 40) -> Column:
    """The first reason, in order, why a text is not prose; PASS if there is none."""
    f = features(text)
    code = text.rlike(r"function\(|=>|===|!==") | (F.regexp_count(text, F.lit(r"\{")) > 3)
    return (
        F.when(f["len"] < least, "too_short").when(code, "js_code").when(f["code_ratio"] > 0.05, "code_ratio").when(f["alpha_ratio"] < 0.5, "alpha_ratio")
        .when(f["space_ratio"] < 0.08, "space_ratio").when(f["avg_word_len"] < 3.5, "short_words").when(f["stop_word_hits"] < 3, "few_stopwords")
        .when(F.contains(text, F.lit("\\fB")) | F.contains(text, F.lit("\\fP")), "troff").when(F.regexp_count(text, F.lit(r"--[a-z][a-z\-]+")) > 5, "cli_help").otherwise("PASS")
    )


def short_label(text: Column, patterns: list[tuple[str, str]] = ()) -> Column:
    """The first of the user's (pattern, name) pairs found in the first sentence of 200 bytes, else its first four words."""
    head = F.substring_index(F.make_valid_utf8(F.substring(text.cast("binary"), 1, 200).cast("string")), ".", 1)
    words = F.lower(F.array_join(F.slice(F.regexp_extract_all(head, F.lit("[a-zA-Z]+"), F.lit(0)), 1, 4), "_"))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in patterns:
        out = out.when(head.rlike("(?i)" + pattern), name)
    return out.otherwise(words)
