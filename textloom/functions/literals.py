"""String literals of JavaScript source: a table function that finds them, and their decoding and encoding.

The scanner cuts code into tokens by one pattern and keeps an explicit stack of open interpolations, one source a row;
sources run in parallel.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import narrow_batches

#: Literals, and bytes of sources, after which a Python worker hands on what it holds.
ROWS_AT_ONCE, BYTES_AT_ONCE = 20_000, 4 << 20
#: Bytes after which, and words right before which, a slash begins a regular expression.
BEFORE_REGEX = set(b"=([,;:!&|?+-*/%^~{}<>\n\t ")
WORDS_BEFORE_REGEX = {b"return", b"typeof", b"instanceof", b"in", b"of", b"void", b"delete", b"new", b"throw", b"yield", b"await", b"else", b"do", b"case", b"default"}
_TOKEN = re.compile(
    rb"""(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|"(?P<dq>(?:[^"\\]++|\\[\s\S])*+)"|'(?P<sq>(?:[^'\\]++|\\[\s\S])*+)'|(?P<open>["'])|(?P<tick>`)"""
    rb"""|(?P<brace>[{}])|(?P<slash>/)|(?P<word>[A-Za-z0-9_$]+)|(?P<blank>[ \t\n\r]+)|(?P<other>[^"'`{}/A-Za-z0-9_$ \t\n\r]+)"""
)
_TEMPLATE = re.compile(rb"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+")
#: An interpolation in which nothing opens, ends or divides: the fragment behind it goes on at once.
_PLAIN = re.compile(rb"""\$\{[^"'`{}/]*+\}""")
_REGEX = re.compile(rb"/(?:\\[\s\S]|\[(?:\\[\s\S]|[^\]\\\n])*\]?|[^\\/\n\[])*(/[gimsuyd]*)?")


def scan(src: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of the contents of literals, by start: dq, sq, and the static fragments of templates (empty ones left out).

    A quoted literal may hold line breaks; one that is never closed ends the scan, and an unclosed template gives no last
    fragment. A slash is a division after a value, so also after a word that white space parts from it.
    """
    out: list[tuple[int, int, str]] = []
    # for each open interpolation: how many braces are open in it
    stack: list[int] = []
    i, last, word = 0, ord(" "), b""

    def fragment(i: int) -> int:
        """Reads a fragment from i; returns where code goes on."""
        end = _TEMPLATE.match(src, i).end()
        while plain := _PLAIN.match(src, end):
            if end > i:
                out.append((i, end, "tmpl_frag"))
            i = plain.end()
            end = _TEMPLATE.match(src, i).end()
        closed = src[end : end + 1] == b"`"
        if end > i and (closed or src[end : end + 2] == b"${"):
            out.append((i, end, "tmpl_frag"))
        if not closed:
            stack.append(0)
        return end + (1 if closed else 2)

    while i < len(src):
        m = _TOKEN.match(src, i)
        kind, start, i = m.lastgroup, m.start(), m.end()
        touching, word = word, b""
        if kind in ("dq", "sq"):
            out.append((*m.span(kind), kind))
            last = src[start]
        elif kind == "open":
            break
        elif kind == "tick" or kind == "brace" and m[0] == b"}" and stack and not stack[-1]:
            if kind == "brace":
                stack.pop()
            i = fragment(i)
            last = ord("`") if src[i - 1 : i] == b"`" else ord(" ")
        elif kind == "brace":
            if stack:
                stack[-1] += 1 if m[0] == b"{" else -1
            last = m[0][0]
        elif kind == "slash":
            if last in BEFORE_REGEX or not touching[:1].isdigit() and touching in WORDS_BEFORE_REGEX:
                r = _REGEX.match(src, start)
                i = r.end()
                last = ord("/") if r[1] else last
            else:
                last = ord("/")
        elif kind in ("word", "other"):
            last = m[0][-1]
            word = m[0] if kind == "word" else b""
    return sorted(out)


_ESCAPE = re.compile(r"\\(u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\s\S])")
#: The same, with runs of escaped units as one.
_ESCAPES = re.compile(r"\\(?:(u[0-9a-fA-F]{4}(?:\\u[0-9a-fA-F]{4})*)|x[0-9a-fA-F]{2}|[\s\S])")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", '"': '"', "'": "'", "`": "`", "$": "$", "\\": "\\", "/": "/"}


def _unescaped(m: re.Match) -> str:
    e = m[1]
    if len(e) == 1:
        return _SIMPLE.get(e, m[0])
    units = [int(x, 16) for x in re.findall("[0-9a-fA-F]{4}", e)] if e[0] == "u" else [int(e[1:], 16)]
    if len(units) == 2:
        return b"".join(x.to_bytes(2) for x in units).decode("utf-16-be")
    return m[0] if e[0] == "u" and 0xD800 <= units[0] < 0xE000 else chr(units[0])


def _all_unescaped(m: re.Match) -> str:
    if not m[1]:
        return _ESCAPE.sub(_unescaped, m[0]) if len(m[0]) > 2 else _SIMPLE.get(m[0][1], m[0])
    try:
        return bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be")
    except UnicodeDecodeError:  # a lone surrogate among them
        return _ESCAPE.sub(_unescaped, m[0])


def decode(raw: bytes) -> str | None:
    """A literal's text; None if it is not UTF-8. Unknown escapes and lone surrogates stay as written; CRLF, escaped too, becomes LF."""
    try:
        text = raw.decode("utf-8")
        return (_ESCAPES.sub(_all_unescaped, text) if "\\" in text else text).replace("\r\n", "\n")
    except UnicodeDecodeError:
        return None


def _marks(kind: str) -> tuple[re.Pattern, dict[str, str]]:
    """What is escaped in a literal of a kind, and how."""
    table = {"\\": "\\\\", **{chr(i): f"\\x{i:02x}" for i in range(32)}, "\t": "\\t", "\n": "\\n", "\r": "\\r"}
    table |= {c: "\\" + c for c in {"dq": '"', "sq": "'", "tmpl_frag": "`$"}[kind]}
    if kind == "tmpl_frag":
        del table["\n"]
    return re.compile("[" + re.escape("".join(table)) + "]"), table


KINDS = ("dq", "sq", "tmpl_frag")
_MARKS = {kind: _marks(kind) for kind in KINDS}


def encode(text: str, kind: str, ascii_only: bool = False) -> str:
    """text as the contents of a literal of a kind: dq, sq, tmpl_frag, or raw (unchanged)."""
    if kind == "raw":
        return text
    if kind not in _MARKS:
        raise ValueError(f"no such literal: {kind}")
    marks, table = _MARKS[kind]
    out = marks.sub(lambda m: table[m[0]], text)
    if ascii_only and not out.isascii():
        out = re.sub(r"[^\x00-\x7f]+", lambda m: "\\u" + m[0].encode("utf-16-be").hex("|", 2).replace("|", "\\u"), out)
    return out


def round_trip(text: str | None) -> tuple[str | bool | None, ...]:
    """MD5 of a text as the contents of each of KINDS, and whether these forms and the ASCII ones decode to it; one form is held at a time."""
    if text is None:
        return (*[None] * len(KINDS), None)
    digests, same = [], True
    for kind in KINDS:
        form = encode(text, kind).encode()
        digests.append(hashlib.md5(form, usedforsecurity=False).hexdigest())
        same = same and decode(form) == text and (form.isascii() or decode(encode(text, kind, True).encode()) == text)
    return (*digests, same)


def search_forms(text: str) -> list[tuple[str, str]]:
    """(form, type) under which a text may stand in a source: raw, then each literal's, plain and ASCII; equal forms once."""
    forms = {text: "raw"}
    for kind in ("dq", "sq", "tmpl_frag"):
        for ascii_only in (False, True):
            forms.setdefault(encode(text, kind, ascii_only), kind)
    return list(forms.items())


def forms(text: Column) -> Column:
    """search_forms of a column, as an array of (form, lit_type)."""

    @F.pandas_udf("array<struct<form:string,lit_type:string>>")
    def f(t: pd.Series) -> pd.Series:
        return t.map(lambda s: None if s is None else [{"form": a, "lit_type": b} for a, b in search_forms(s)])

    return f(text)


def encoded(text: Column, kind: Column) -> Column:
    """encode of a column as the kind of literal that another names."""

    @F.pandas_udf("string")
    def f(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else encode(s, x) for s, x in zip(t, k, strict=True)], dtype=object)

    return f(text, kind)


def literals(df: DataFrame, key: str, source: str) -> DataFrame:
    """key, start_off, end_off, lit_type, text, gap for each literal of each source (a string or binary column).

    gap: the bytes between the literal before and this one, quotes left out, as text; null for the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

        def found(ids: pa.Array) -> pa.RecordBatch:
            columns = [ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]]
            at.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [key, "start_off", "end_off", "lit_type", "text", "gap"])

        at, rows = [], []
        for b in batches:
            held = 0
            for i in range(b.num_rows):
                src, last = b.column(1)[i].as_py() or b"", None
                for s, e, kind in scan(src):
                    gap = None
                    if last is not None:
                        low = last[1] + (last[2] != "tmpl_frag" or src[last[1] : last[1] + 1] == b"`")
                        high = s - (kind != "tmpl_frag" or src[s - 1 : s] == b"`")
                        gap = src[low : max(low, high)].decode("utf-8", "replace")
                    rows.append((s, e, kind, decode(src[s:e]), gap))
                    last = (s, e, kind)
                    at.append(i)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield found(b.column(0))
                held += len(src)
                if rows and held >= BYTES_AT_ONCE:
                    held = 0
                    yield found(b.column(0))
            if rows:
                yield found(b.column(0))

    narrow_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(source).cast("binary").alias("src")).mapInArrow(run, f"{key} {kind}, start_off long, end_off long, lit_type string, text string, gap string")
