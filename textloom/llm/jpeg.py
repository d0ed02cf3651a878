"""Baseline JPEG in numpy: parse markers, Huffman-decode scans, DC-only luminance thumbnails, and payloads kept losslessly.

A payload's bytes become quantised coefficients, JPEG's own unit: 64 bytes a block of 8 x 8, byte b as coefficient
b - 511, all quantisation steps 1, in zigzag order. So each coefficient is of size 9 and its Huffman symbol is always the
same; the stream has a restart interval of one block, and a comment holds the payload's length. Any baseline decoder
reads the image; its coefficients are the payload.

The decoder takes any baseline (SOF0) stream of one interleaved scan. It works on all restart intervals of many images
in step, one symbol of each at a time, so a column of small images costs few numpy calls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tok
from .common import narrow_batches

UNIT = 576
FILL = 255
BLOCK = 64
#: Blocks in a column, so that a height stays below 65,536.
TALLEST = 6000
#: Intervals decoded in step at once.
STEP = 20_000

_DQT = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
_ONE = lambda kind, symbol: b"\xff\xc4" + struct.pack(">HB", 20, kind) + bytes([1] + [0] * 15) + bytes([symbol])
_DHT = _ONE(0x00, 9) + _ONE(0x10, 9)
_DRI = b"\xff\xdd" + struct.pack(">HH", 4, 1)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of UNIT."""
    return data + bytes([FILL]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _shape(payload: int) -> tuple[int, int]:
    """Blocks across and down for a payload of so many bytes."""
    n = payload // BLOCK
    across = 3 * max(1, -(-n // (3 * TALLEST)))
    return across, -(-n // across)


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload (each a positive multiple of UNIT long)."""
    shapes = [_shape(len(p)) for p in payloads]
    full = b"".join(p + bytes([FILL]) * (a * d * BLOCK - len(p)) for p, (a, d) in zip(payloads, shapes, strict=True))
    # symbol '0', then 9 bits of b - 511: its top bit is 0 and the others are b. 4 coefficients are 5 bytes.
    q = np.frombuffer(full, np.uint8).reshape(-1, 4).astype(np.uint64)
    bits = (q[:, 0] << np.uint64(30)) | (q[:, 1] << np.uint64(20)) | (q[:, 2] << np.uint64(10)) | q[:, 3]
    body = np.stack([(bits >> np.uint64(s)).astype(np.uint8) for s in (32, 24, 16, 8, 0)], axis=1).reshape(-1, 80)
    count = np.array([a * d for a, d in shapes])
    end = np.cumsum(count)
    number = np.arange(len(body)) - np.repeat(end - count, count)
    marks = np.empty((len(body), 2), np.uint8)
    marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + number % 8
    flat = np.concatenate([body, marks], axis=1).ravel()
    stuff = np.zeros(flat.shape, np.int64)
    stuff.reshape(-1, 82)[:, :80] = body == 0xFF
    place = np.arange(len(flat)) + np.cumsum(stuff) - stuff
    out = np.zeros(len(flat) + int(stuff.sum()), np.uint8)
    out[place] = flat
    edges = np.append(place[::82], len(out))[np.append(0, end)]
    raw = out.tobytes()
    files = []
    for p, (a, d), s, e in zip(payloads, shapes, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        note = b"payload %d" % len(p)
        head = b"\xff\xd8" + _DQT + b"\xff\xfe" + struct.pack(">H", 2 + len(note)) + note + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, 8 * d, 8 * a, 1, 1, 0x11, 0) + _DHT + _DRI + _SOS
        files.append(head + raw[s : e - 2] + b"\xff\xd9")  # no mark after the last interval
    return files


@dataclass
class Header:
    """What the markers of a file say; parts: (component, horizontal, vertical, table of steps, DC table, AC table)."""

    width: int = 0
    height: int = 0
    parts: list[list[int]] = field(default_factory=list)
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    note: bytes = b""
    scan: tuple[int, int] = (0, 0)

    @property
    def units(self) -> tuple[int, int]:
        """Coding units across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[int]:
        """For each block of a unit the component's place."""
        return [0] if len(self.parts) == 1 else [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]

    def key(self) -> tuple:
        return tuple(sorted(self.tables.items())), tuple(tuple(p[1:3] + p[4:]) for p in self.parts), self.interval


def parse(data: bytes) -> Header:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    h, i = Header(), 2
    while True:
        if i + 4 > len(data) or data[i] != 0xFF:
            raise ValueError("a marker is expected")
        kind = data[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        n = int.from_bytes(data[i + 2 : i + 4])
        body = data[i + 4 : i + 2 + n]
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                h.steps[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif kind == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                h.tables[body[0]] = body[1:size]
                body = body[size:]
        elif kind == 0xC0:
            if body[0] != 8:
                raise ValueError("8-bit samples are expected")
            h.height, h.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            h.parts = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(body[5])]
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("only baseline files are read")
        elif kind == 0xDD:
            h.interval = int.from_bytes(body[:2])
        elif kind == 0xFE:
            h.note = body
        elif kind == 0xDA:
            if body[0] != len(h.parts):
                raise ValueError("one interleaved scan is expected")
            for k in range(body[0]):
                part = next(p for p in h.parts if p[0] == body[1 + 2 * k])
                part[4], part[5] = body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15
            start = i + 2 + n
            end = start
            while True:  # the scan ends at the first marker that is no restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan does not end")
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            h.scan = (start, end)
            return h
        i += 2 + n


def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: symbol * 32 + length of its code (0: no code)."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = table[k] * 32 + length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _intervals(files: list[bytes], headers: list[Header]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scans without stuffing and marks, one after the other; where each restart interval begins; the number of its file."""
    scans = [f[h.scan[0] : h.scan[1]] for f, h in zip(files, headers, strict=True)]
    data = np.frombuffer(b"".join(scans), np.uint8)
    size = np.array([len(s) for s in scans])
    first = np.cumsum(size) - size
    mark = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
    after = data[mark + 1] if len(mark) else np.zeros(0, np.uint8)
    drop = np.zeros(len(data), bool)
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    drop[mark[after == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    moved = np.concatenate([[0], np.cumsum(~drop)])
    begin = np.sort(np.concatenate([first, restart + 2]))
    return data[~drop], moved[begin], np.searchsorted(first, begin, side="right") - 1


def decode_all(files: list[bytes], headers: list[Header]) -> list[np.ndarray]:
    """Quantised coefficients, in zigzag order, of each file's blocks as they come in the scan: (blocks, 64)."""
    out: list[np.ndarray | None] = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(headers):
        groups.setdefault(h.key(), []).append(i)
    for members in groups.values():
        h = headers[members[0]]
        pattern = np.array(h.blocks())
        tables = sorted(h.tables)
        look = np.concatenate([_lookup(h.tables[t]) for t in tables])
        dc = np.array([tables.index(h.parts[p][4]) << 16 for p in pattern])
        ac = np.array([tables.index(h.parts[p][5]) << 16 for p in pattern])
        data, begin, owner = _intervals([files[i] for i in members], [headers[i] for i in members])
        wide = np.concatenate([data, np.zeros(16, np.uint8)])
        window = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            window |= wide[j : j + len(window)].astype(np.uint64) << np.uint64(56 - 8 * j)
        units = np.array([headers[i].units[0] * headers[i].units[1] for i in members])
        per = np.bincount(owner, minlength=len(members))
        number = np.arange(len(begin)) - np.repeat(np.cumsum(per) - per, per)
        length = units[owner] - number * h.interval if h.interval else units[owner]
        length = (np.minimum(length, h.interval) if h.interval else length) * len(pattern)
        if (length <= 0).any() or (np.bincount(owner, length, minlength=len(members)) != units * len(pattern)).any():
            raise ValueError("restart marks are missing")
        first = np.cumsum(length) - length
        result = np.zeros((int(length.sum()), 64), np.int16)
        for low in range(0, len(begin), STEP):
            _step(window, begin[low : low + STEP] * 8, first[low : low + STEP], length[low : low + STEP], pattern, look, dc, ac, result)
        edge = np.concatenate([[0], np.cumsum(units * len(pattern))])
        for k, i in enumerate(members):
            out[i] = result[edge[k] : edge[k + 1]]
    return out


def _step(window, bit, first, length, pattern, look, dc, ac, result) -> None:
    """Decodes intervals in step: each turn one symbol of each that is not at its end."""
    n, kinds = len(bit), int(pattern.max()) + 1
    bit, block, k = bit.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    before = np.zeros((n, kinds), np.int64)
    live = np.arange(n)
    flat = result.reshape(-1)
    while len(live):
        at, here = bit[live], k[live]
        of = block[live] % len(pattern)
        bits = window[at >> 3] << (at & 7).astype(np.uint64)
        got = look[np.where(here == 0, dc[of], ac[of]) + (bits >> np.uint64(48)).astype(np.int64)]
        used = got & 31
        if not used.all():
            raise ValueError("no such Huffman code")
        symbol = got >> 5
        size = symbol & 15
        value = ((bits << used.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        value = np.where((value >> np.maximum(size - 1, 0) == 0) & (size > 0), value - (1 << size) + 1, value)
        bit[live] = at + used + size
        is_dc = here == 0
        if is_dc.any():
            who, part = live[is_dc], pattern[of[is_dc]]
            before[who, part] += value[is_dc]
            value[is_dc] = before[who, part]
        run = np.where(is_dc, 0, symbol >> 4)
        to = here + run
        put = (size > 0) | is_dc
        if (to[put] > 63).any():
            raise ValueError("too many coefficients")
        flat[(first[live] + block[live])[put] * 64 + to[put]] = value[put]
        after = np.where(put, to + 1, np.where(run == 15, here + 16, 64))
        over = after >= 64
        k[live] = np.where(over, 0, after)
        block[live] += over
        if over.any():
            live = live[block[live] < length[live]]


def luminance(h: Header, coefficients: np.ndarray) -> np.ndarray:
    """The DC-only thumbnail: one sample for each 8 x 8 block of the first component, as (rows, columns) of 0 to 255."""
    across, down = h.units
    pattern = h.blocks()
    mine = [i for i, p in enumerate(pattern) if p == 0]
    wide, high = (h.parts[0][1], h.parts[0][2]) if len(h.parts) > 1 else (1, 1)
    dc = coefficients.reshape(-1, len(pattern), 64)[:, mine, 0].astype(np.int64) * int(h.steps[h.parts[0][3]][0])
    grid = dc.reshape(down, across, high, wide).transpose(0, 2, 1, 3).reshape(down * high, across * wide)
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hashes(image: np.ndarray) -> tuple[str, str]:
    """(average hash, difference hash) as hexadecimal, from the means of 8 x 8 and of 8 x 9 equal areas of a thumbnail."""
    def shares(cells: int, size: int) -> np.ndarray:
        """How much of each sample lies in each cell, in parts of 1 / cells."""
        i, y = np.arange(cells)[:, None], np.arange(size)
        return np.maximum(0, np.minimum((y + 1) * cells, (i + 1) * size) - np.maximum(y * cells, i * size))

    a, d = (shares(rows, image.shape[0]) @ image.astype(np.int64) @ shares(columns, image.shape[1]).T for rows, columns in ((8, 8), (8, 9)))
    return np.packbits(a * 64 > a.sum()).tobytes().hex(), np.packbits(d[:, 1:] > d[:, :-1]).tobytes().hex()


def payload_of(h: Header, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_all stored."""
    n = int(h.note.removeprefix(b"payload "))
    return (coefficients.ravel()[:n] + 511).astype(np.uint8).tobytes()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each row: its text (null: empty) as UTF-8, padded, in a JPEG file.

    Equal texts give equal files, and repeated rows a file each; a very long text is one file, of up to 3 GB. An empty
    table gives an empty result; other columns, whatever their names, are not looked at.
    """
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in tok.chunks(b.column(1), 1 << 20):
                raw = data.tobytes()
                files = encode_all([padded(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(np.diff(at)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """What the stored files say when they are read back: payload (size, digests), file (size, digest), and feature: width x height and thumbnail hashes.

    Repeated rows are read each by itself; an empty table gives an empty result. A media value that is no baseline JPEG
    raises an error.
    """
    narrow_batches(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media, low = b.column(2), 0
            while low < b.num_rows:
                files, size = [], 0
                while low + len(files) < b.num_rows and size < 1 << 20:
                    files.append(media[low + len(files)].as_py())
                    size += len(files[-1])
                headers = [parse(f) for f in files]
                rows = []
                for f, h, c in zip(files, headers, decode_all(files, headers), strict=True):
                    p = payload_of(h, c)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(f), hashlib.sha256(f).hexdigest(), f"{h.width}x{h.height}:" + ":".join(thumbnail_hashes(luminance(h, c)))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                own = [b.column(i).slice(low, len(files)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *(x.split()[0] for x in OUT.split(", "))])
                low += len(files)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, {OUT}")
