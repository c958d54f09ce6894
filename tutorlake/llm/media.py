"""Media columns: documents as baseline JPEG files, and features of the files.

Storing (``store``): the text's UTF-8 bytes, filled with zeros to a positive multiple of 64, are
the quantised coefficients of a grey baseline JPEG, 64 bytes a block in scan order. Samples would
be rounded by the transform, coefficients are not, so the format's own unit keeps every byte. A
byte b is the coefficient 256 + b, one of nine magnitude bits, so one Huffman code of one bit
serves all of them; a restart marker after each block resets the prediction. The image is as
square as its block count allows; blocks of zero bytes fill its last row, and a comment segment
holds the payload's length.

Reading (``read``): parses the markers, takes out stuffing, decodes the Huffman scan and rebuilds
a luminance thumbnail from the DC coefficients alone, one sample a block. The decoder takes any
one-scan baseline JPEG, grey or colour: it steps through all restart intervals of all files of a
slice at once, one symbol of each at a time, by table lookup in numpy.

Nulls count as empty texts (one block of zeros). A file that is no such JPEG gives null features,
payload and size; no row is dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm.common import keyed, map_columns

BLOCK = 64
BIAS = 256  # a byte b is stored as the coefficient b + BIAS, of 9 magnitude bits
BITS = 9


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(blocks: int) -> tuple[int, int]:
    wide = int(np.ceil(np.sqrt(blocks)))
    return wide, -(-blocks // wide)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; the length of each is a positive multiple of 64."""
    if not payloads:
        return []
    shapes = [_shape(len(p) // BLOCK) for p in payloads]
    counts = np.array([w * h for w, h in shapes])
    data = np.frombuffer(b"".join(p.ljust(n * BLOCK, b"\0") for p, n in zip(payloads, counts.tolist())), np.uint8)
    # 0 (the code), then nine bits: four coefficients make five bytes
    x = data.reshape(-1, 4).astype(np.uint64) + np.uint64(BIAS)
    y = x[:, 0] << np.uint64(30) | x[:, 1] << np.uint64(20) | x[:, 2] << np.uint64(10) | x[:, 3]
    rows = np.empty((len(data) // BLOCK, 82), np.uint8)
    rows[:, :80] = (y[:, None] >> np.arange(32, -1, -8, dtype=np.uint64)).astype(np.uint8).reshape(-1, 80)
    ends = np.cumsum(counts)
    order = np.arange(len(rows)) - np.repeat(ends - counts, counts)
    rows[:, 80], rows[:, 81] = 0xFF, 0xD0 + order % 8
    full = rows[:, :80] == 0xFF
    per_row = 82 + full.sum(1)
    at = np.flatnonzero(full.ravel())
    flat = np.insert(rows.ravel(), at // 80 * 82 + at % 80 + 1, 0)
    stops = np.concatenate([[0], np.cumsum(per_row)[ends - 1]])
    code = bytes([1] + [0] * 15)
    tables = _segment(0xDB, b"\0" + bytes([1] * 64)), _segment(0xC4, b"\x00" + code + bytes([BITS]) + b"\x10" + code + bytes([BITS])) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")
    jfif = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, shapes)):
        frame = _segment(0xC0, b"\x08" + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + b"\1\1\x11\0")
        out.append(jfif + _segment(0xFE, b"payload=%d" % len(p)) + tables[0] + frame + tables[1] + flat[stops[i] : stops[i + 1] - 2].tobytes() + b"\xff\xd9")
    return out


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # quantiser -> its DC step
    huffman: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index of part, DC table, AC table
    comment: bytes = b""
    start: int = 0

    def mcu(self) -> list[tuple[int, int, int]]:
        """(part, DC table, AC table) of each block of a unit of the scan."""
        if len(self.scan) == 1:
            return list(self.scan)
        return [s for s in self.scan for _ in range(self.parts[s[0]][1] * self.parts[s[0]][2])]

    def grid(self) -> tuple[int, int]:
        h = 1 if len(self.scan) == 1 else max(p[1] for p in self.parts)
        v = 1 if len(self.scan) == 1 else max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes) -> Frame | None:
    """The markers up to the scan; None if this is no one-scan baseline JPEG."""
    f, at = Frame(), 2
    if not media or media[:2] != b"\xff\xd8" or media[-2:] != b"\xff\xd9":
        return None
    while at + 4 <= len(media) and media[at] == 0xFF:
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0 and len(body) >= 6 and body[0] == 8:
            f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            f.parts = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])) if len(c) == 3]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return None
        elif marker == 0xC4:
            while len(body) > 16:
                n = 17 + sum(body[1:17])
                f.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            f.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xDA:
            ids = [p[0] for p in f.parts]
            try:
                f.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            except (ValueError, IndexError):
                return None
            f.start = at
            known = all(d in f.huffman and 16 + a in f.huffman for _, d, a in f.scan) and all(p[3] in f.quant for p in f.parts)
            whole = 0 in {s[0] for s in f.scan} and len(f.scan) == len(f.parts)
            return f if known and whole and f.width and f.height and all(p[1] and p[2] for p in f.parts) else None
    return None


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: 256 * length of the code + symbol; length 0 where no code begins so."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for symbol in table[at : at + table[length - 1]]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at += table[length - 1]
        code <<= 1
    return out


class _Bits:
    """Bit positions in many intervals of one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.zeros(len(data) + 1, np.uint64)
        for i in range(8):
            self.words |= padded[i : i + len(data) + 1].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.at = starts.astype(np.int64) * 8
        self.last = len(data)

    def symbol(self, lanes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each lane and the value of the bits that its low half counts."""
        at = self.at[lanes]
        ahead = self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)
        hit = table[(ahead >> np.uint64(48)).astype(np.int64)]
        length, symbol = hit >> 8, hit & 255
        size = symbol & 15
        value = ((ahead << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        self.at[lanes] = at + length + size
        return np.where(length > 0, symbol, -1), value


def _scans(files: list[bytes], frames: list[Frame]) -> list[np.ndarray | None]:
    """Coefficients (in scan order, part by part as coded) of files that share tables and layout:
    an array (blocks, 64) for each, None where a code is broken."""
    unit = frames[0].mcu()
    tables = {k: _lookup(t) for k, t in frames[0].huffman.items()}
    data = np.frombuffer(b"".join(m[f.start :] for m, f in zip(files, frames)), np.uint8)
    after = np.append(data[1:], 0)
    full = data == 0xFF
    marker = full & (after != 0)
    drop = np.zeros(len(data), bool)
    drop[1:] |= full[:-1]  # what follows FF: a stuffed zero or the second byte of a marker
    drop |= marker
    place = np.cumsum(~drop) - ~drop
    ends = np.flatnonzero(marker & ((after & 0xF8 == 0xD0) | (after == 0xD9)))
    last = after[ends] == 0xD9
    starts = np.concatenate([[0], place[ends[:-1]]]) if len(ends) else np.zeros(0, int)
    of = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    total = np.array([f.grid()[0] * f.grid()[1] for f in frames])
    if last.sum() != len(files):
        return [None] * len(files)
    each = np.array([f.restart or n for f, n in zip(frames, total.tolist())])
    nth = np.arange(len(ends)) - first[of]
    units = np.clip(total[of] - nth * each[of], 0, each[of])
    base = np.concatenate([[0], np.cumsum(units)[:-1]]) * len(unit)
    out = np.zeros((int(units.sum()) * len(unit), 64), np.int16)
    flat, bits = out.reshape(-1), _Bits(data[~drop], starts)
    broken = np.zeros(len(ends), bool)
    broken |= units == 0
    dc = np.zeros((len(ends), len(frames[0].parts)), np.int64)
    for step in range(int(units.max(initial=0))):
        lanes = np.flatnonzero(units > step)
        for b, (part, dc_table, ac_table) in enumerate(unit):
            row = (base[lanes] + step * len(unit) + b) * 64
            symbol, diff = bits.symbol(lanes, tables[dc_table])
            broken[lanes] |= symbol < 0
            dc[lanes, part] += diff
            flat[row] = dc[lanes, part]
            live, k = np.arange(len(lanes)), np.ones(len(lanes), np.int64)
            while len(live):
                symbol, value = bits.symbol(lanes[live], tables[16 + ac_table])
                run, size = symbol >> 4, symbol & 15
                to = k[live] + run
                bad = (symbol < 0) | (to > 63) & (symbol > 0)
                broken[lanes[live[bad]]] = True
                put = (size > 0) & ~bad
                if put.all():
                    flat[row[live] + to] = value
                else:
                    flat[row[live[put]] + to[put]] = value[put]
                k[live] = np.where(bad | (symbol == 0), 64, to + 1)
                live = live[k[live] < 64]
    short = np.bincount(of, units, len(files)) < total
    short |= np.bincount(of, broken, len(files)) > 0
    stops = np.cumsum(np.bincount(of, units, len(files)).astype(np.int64)) * len(unit)
    return [None if short[i] else out[stops[i] - int(total[i]) * len(unit) : stops[i]] for i in range(len(files))]


def decode(files: list[bytes | None]) -> list[tuple[Frame, np.ndarray] | None]:
    """Frame and coefficients of each file; None for what is no one-scan baseline JPEG."""
    frames = [parse(m) if m else None for m in files]
    alike, out = defaultdict(list), [None] * len(files)
    for i, f in enumerate(frames):
        if f:
            alike[tuple(sorted(f.huffman.items())), tuple(f.mcu()), len(f.parts)].append(i)
    for group in alike.values():
        for i, c in zip(group, _scans([files[i] for i in group], [frames[i] for i in group])):
            out[i] = None if c is None else (frames[i], c)
    return out


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each block from its DC coefficient, in rows of the image."""
    unit = frame.mcu()
    wide, high = frame.grid()
    h, v = (1, 1) if len(frame.scan) == 1 else frame.parts[0][1:3]
    own = [b for b, u in enumerate(unit) if u[0] == 0]
    dc = coefficients[:, 0].astype(np.int64).reshape(-1, len(unit))[:, own] * frame.quant[frame.parts[0][3]]
    rows = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    return np.clip((rows + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def feature(frame: Frame, thumb: np.ndarray) -> str:
    """Dimensions, average hash of 8 x 8 samples of the thumbnail, digest of the thumbnail."""
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    small = thumb[rows][:, cols]
    bits = np.packbits(small > small.mean()).tobytes().hex()
    return f"{frame.width}x{frame.height}:{bits}:{hashlib.md5(thumb.tobytes()).hexdigest()}"


def payload_of(frame: Frame, coefficients: np.ndarray) -> bytes | None:
    """The bytes that ``encode`` stored; None for a picture that it didn't make."""
    if not frame.comment.startswith(b"payload=") or not frame.comment[8:].isdigit():
        return None
    return (coefficients - BIAS).astype(np.uint8).tobytes()[: int(frame.comment[8:])]


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the texts as JPEG files."""

    def run(c):
        raw = [x.encode() for x in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [len(x) for x in raw], "media": encode([x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK, b"\0") for x in raw])}

    kind = df.schema[key].dataType.simpleString()
    return map_columns(keyed(df, key, text), f"doc_id {kind}, n_bytes long, media binary", "text", lambda: run)


def read(df: DataFrame, key: str = "doc_id", media: str = "media", carry: str = "n_bytes") -> DataFrame:
    """Dimensions, thumbnail features and payload digests of stored files."""
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(key).alias("doc_id"), F.col(carry).cast("long").alias("n_bytes"), F.coalesce(F.col(media), F.lit(b"")).alias("media"))

    def run(c):
        out = {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"], "media_bytes": [len(m) for m in c["media"]], "media_sha256": [hashlib.sha256(m).hexdigest() for m in c["media"]]}
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "width", "height", "feature")
        rows = []
        for got in decode(c["media"]):
            if got is None:
                rows.append([None] * len(names))
                continue
            p = payload_of(*got)
            known = [None] * 3 if p is None else [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:])]
            rows.append([*known, got[0].width, got[0].height, feature(got[0], thumbnail(*got))])
        return out | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_columns(df, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int", "media", lambda: run)
