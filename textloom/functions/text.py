"""Column functions on text: placeholders, white lists, residual words, code areas, versions and digests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def let(value: Column, f) -> Column:
    """f(value), in which value is evaluated once however often f names it; Spark copies a repeated expression into branches."""
    return F.transform(F.array(value), f)[0]


def strip(text: Column) -> Column:
    """text without white space (Unicode's) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quote(s: str) -> str:
    """s as a literal pattern for Java, DuckDB's RE2 and Python alike."""
    return re.sub(r"([^A-Za-z0-9_\s])", lambda m: m[1] if ord(m[1]) > 127 else "\\" + m[1], s)


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(R.PLACEHOLDER), F.lit(0))


def placeholders_safe(src: Column, dst: Column, allow_reorder: Column) -> Column:
    """Equal as lists, or as multisets where reordering is allowed."""
    a, b = placeholders(src), placeholders(dst)
    return F.when(allow_reorder, F.array_sort(a) == F.array_sort(b)).otherwise(a == b)


def fragments(text: Column, least: int = 8) -> Column:
    """What lies between placeholders, pieces of least characters or more."""
    return F.filter(F.split(text, R.PLACEHOLDER), lambda x: F.char_length(x) >= least)


def whitelisted(text: Column, exact: list[str], regex: list[str], literal_exact: list[str]) -> Column:
    """Blank, an exact literal, or without a word of three letters once exact strings (longest first) and patterns are taken out."""
    bare = strip(text)
    rest = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), sorted(exact, key=lambda s: (-len(s), s)), text)
    rest = reduce(lambda t, p: F.regexp_replace(t, p, ""), regex, rest)
    return (bare == "") | bare.isin(literal_exact or [""]) | ~rest.rlike("[A-Za-z]{3,}")


def residual(text: Column, exact: list[str], regex: list[str], literal_exact: list[str]) -> Column:
    """Words of three letters or more that stay once the white list is taken out (strings anywhere, then whole words, then patterns)."""
    rest = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(" ")), sorted(literal_exact, key=lambda s: (-len(s), s)), text)
    rest = reduce(lambda t, s: F.regexp_replace(t, f"(?<![A-Za-z]){quote(s)}(?![A-Za-z])", " "), sorted(exact, key=lambda s: (-len(s), s)), rest)
    rest = reduce(lambda t, p: F.regexp_replace(t, p, " "), regex, rest)
    return F.regexp_extract_all(rest, F.lit("[A-Za-z]{3,}"), F.lit(0))


def strip_dynamic_lines(text: Column) -> tuple[Column, Column]:
    """(text without registration lines, how many there were)."""
    return F.regexp_replace(text, R.DYNAMIC_LINE, ""), F.regexp_count(text, F.lit(R.DYNAMIC_LINE))


def strip_code(text: Column) -> Column:
    """Fences, indented lines, back-quoted and quoted strings and short tags become a space, in this order."""
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), R.CODE_AREAS, text)


def whole_word(text: Column, word: str) -> Column:
    """Whether word stands in text with no letter, digit or underscore at its sides."""
    return text.rlike(f"(?<![A-Za-z0-9_]){quote(word)}(?![A-Za-z0-9_])")


def version_key(version: Column) -> Column:
    """Parts of a version as numbers; what is no number is 0."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def version_parts(version: Column) -> Column:
    """major, minor and patch of a version as numbers; other forms are an error."""
    bad = F.raise_error(F.concat(F.lit("no version: "), version)).cast("array<int>")
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.transform(F.split(version, r"\."), lambda x: x.cast("int"))).otherwise(bad)


def platform_key(package: Column, prefix: str) -> Column:
    """A package's name without its scope and prefix."""
    return F.regexp_replace(F.substring_index(package, "/", -1), "^" + quote(prefix), "")


def preview(text: Column, n: int = 80) -> Column:
    cut = F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit("\\n"))
    return F.when(F.char_length(text) > n, F.concat(cut, F.lit("…"))).otherwise(cut)
