"""Bundles in executables: format by magic bytes, the module table behind the trailer, its segments and the sections that hold them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the offsets record and of a module's entry, what a module's pointers point to, and names of enumerations.
OFFSETS, ENTRY = 32, 52
FIELDS = ("name", "contents", "sourcemap", "bytecode", "module_info", "bop")
LOADERS = ("jsx", "js", "ts", "tsx", "css", "file", "json", "toml", "wasm", "napi", "text", "sqlite")
FORMATS = ("none", "cjs", "esm")
SIDES = ("server", "client")
MACH = ("CFFAEDFE", "FEEDFACF")


def file_format(content: Column) -> Column:
    """linux, darwin or win32 by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "7F454C46", "linux").when(head.isin(*MACH), "darwin").when(F.substring(head, 1, 4) == "4D5A", "win32")


def _name(names: tuple[str, ...], i: int) -> str:
    return names[i] if i < len(names) else f"?{i}"


def read_table(data: bytes, trailer: bytes) -> dict:
    """byte_count, entry_point_id, flags, start (of the payload in data), table and args (place in the payload, length) and modules.

    A module: i, name, entry (whether the program starts in it), loader, module_format, side, padding, and at: for each of
    FIELDS the place in data and length. Raises without a trailer or with pointers beyond the payload.
    """
    at = data.rfind(trailer)
    if at < OFFSETS:
        raise ValueError("no trailer")
    size, _, where, length, entry, args, args_length, flags = struct.unpack_from("<8I", data, at - OFFSETS)
    start = at - OFFSETS - size
    if start < 0 or where + length > size or args + args_length > size or length % ENTRY:
        raise ValueError("the module table lies outside the data")
    modules = []
    for i in range(length // ENTRY):
        v = struct.unpack_from("<12I4B", data, start + where + i * ENTRY)
        pointers = {f: (start + v[2 * k], v[2 * k + 1]) for k, f in enumerate(FIELDS)}
        if any(low + n > start + size for low, n in pointers.values()):
            raise ValueError("a pointer lies outside the data")
        low, n = pointers["name"]
        kinds = {"loader": _name(LOADERS, v[12]), "module_format": _name(FORMATS, v[13]), "side": _name(SIDES, v[14]), "padding": v[15]}
        modules.append({"i": i, "name": data[low : low + n].decode("utf-8", "replace"), "entry": i == entry, **kinds, "at": pointers})
    return {"byte_count": size, "entry_point_id": entry, "flags": flags, "start": start, "table": (where, length), "args": (args, args_length), "modules": modules}


def metadata(data: bytes, trailer: bytes) -> str:
    """The table as JSON."""
    t = read_table(data, trailer)
    return json.dumps({k: t[k] for k in ("byte_count", "entry_point_id", "flags")} | {"module_count": len(t["modules"]), "modules": t["modules"]})


def _rows(files: DataFrame, rows, schema: str) -> DataFrame:
    """path and what rows(content) gives for each of files (path, content), one file a row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], "path string, " + schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                got = [(p.as_py(), *r) for r in rows(c.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate(kinds.types)], kinds.names)

    return files.select("path", "content").mapInArrow(run, "path string, " + schema)


def modules(files: DataFrame, trailer: bytes) -> DataFrame:
    """path, i, name, entry, loader, module_format, side, padding, and off and length of each of FIELDS, of files' modules."""
    one = lambda m: (m["i"], m["name"], m["entry"], m["loader"], m["module_format"], m["side"], m["padding"], *(x for f in FIELDS for x in m["at"][f]))
    pointers = ", ".join(f"{f}_off long, {f}_len long" for f in FIELDS)
    return _rows(files, lambda c: [one(m) for m in read_table(c, trailer)["modules"]], f"i int, name string, entry boolean, loader string, module_format string, side string, padding int, {pointers}")


def segments(files: DataFrame, trailer: bytes) -> DataFrame:
    """path, label, off (in the payload), len of each part of files' payloads that is not empty: module fields, arguments, and the table itself."""

    def rows(content: bytes) -> list[tuple[str, int, int]]:
        t = read_table(content, trailer)
        out = [(f"module_{m['i']}_{f}", m["at"][f][0] - t["start"], m["at"][f][1]) for m in t["modules"] for f in FIELDS]
        return [x for x in [*out, ("args", *t["args"])] if x[2] > 0] + [("modules_array", *t["table"])]

    return _rows(files, rows, "label string, off long, len long")


def bundles(files: DataFrame, trailer: bytes) -> DataFrame:
    """path, bundle: the first module's contents; a file of a name in .js is its own bundle."""
    plain = F.endswith("path", F.lit(".js"))

    def first(content: bytes) -> list[tuple[bytes]]:
        low, n = read_table(content, trailer)["modules"][0]["at"]["contents"]
        return [(content[low : low + n],)]

    return files.where(plain).select("path", F.col("content").alias("bundle")).unionByName(_rows(files.where(~plain), first, "bundle binary"))


def fit(section: tuple[int, int], start: int, old: int, delta: int, trailer: int) -> dict[str, int]:
    """new_byte_count, header (the payload's size with its offsets and trailer) and padding left in the section once a payload grows by delta; raises if it does not fit."""
    new = old + delta
    used = start - section[0] + new + OFFSETS + trailer
    if used > section[1] - section[0]:
        raise ValueError(f"{used - (section[1] - section[0])} bytes too many")
    return {"new_byte_count": new, "header": new + OFFSETS + trailer, "padding": section[1] - section[0] - used}


def sections(data: bytes) -> list[tuple[int, int]]:
    """(first byte, end) in the file of each loaded segment of an ELF64 or 64-bit Mach-O file, or each section of a PE file."""
    if data[:4] == b"\x7fELF":
        (table,), (size, count) = struct.unpack_from("<Q", data, 32), struct.unpack_from("<2H", data, 54)
        heads = [struct.unpack_from("<2I4Q", data, table + i * size) for i in range(count)]
        return [(h[2], h[2] + h[5]) for h in heads if h[0] == 1]
    if data[:4].hex().upper() in MACH:
        out, at = [], 32
        for _ in range(struct.unpack_from("<I", data, 16)[0]):
            kind, size = struct.unpack_from("<2I", data, at)
            if kind == 0x19:
                start, n = struct.unpack_from("<2Q", data, at + 40)
                out.append((start, start + n))
            at += size
        return out
    if data[:2] == b"MZ":
        at = struct.unpack_from("<I", data, 0x3C)[0]
        (count,), (optional,) = struct.unpack_from("<H", data, at + 6), struct.unpack_from("<H", data, at + 20)
        raw = [struct.unpack_from("<2I", data, at + 24 + optional + 40 * i + 16) for i in range(count)]
        return [(start, start + n) for n, start in raw]
    raise ValueError("unknown format")


def containing(data: bytes, off: int) -> tuple[int, int]:
    """The section that holds byte off; an error if none does."""
    for low, high in sections(data):
        if low <= off < high:
            return low, high
    raise ValueError(f"no section holds byte {off}")
