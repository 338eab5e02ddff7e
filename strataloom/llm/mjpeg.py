"""Motion JPEG in AVI as a media column: write, parse by index, decode intra frames, cut into shots.

Writer: a payload of bytes becomes frames of COLUMNS x ROWS grey blocks of 8 x 8, one byte
a block. With a quantiser of 8 the DC coefficient v - 128 is a flat block of samples v, so
baseline JPEG holds the bytes exactly and every decoder shows them. A restart interval is
one row of blocks, which lets all rows of all frames be decoded side by side.

Reader: RIFF lists and the index (idx1, or a walk of the movi list where it is missing) give
the frames; `decode_jpeg` is a baseline decoder (any Huffman and quantisation tables, any
sampling, restart intervals or none) whose entropy decoding runs in lockstep over segments.

Shots: frame histograms of the luma samples differ by a share of their mass; a cut lies
where that exceeds the mean and some deviations of the differences before it in the shot.
Null and empty texts have a payload of 64 zero bytes. Equal payloads give equal files. Texts of
any length pass in runs of FRAMES frames (a file has to stay below 4 GiB, as RIFF has it).
Frames that are not baseline JPEG raise ValueError; an empty movi list gives no clips. An empty
table gives no rows; columns other than the id and the text stay behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

#: Blocks of a frame, and frames a second.
COLUMNS, ROWS, RATE = 64, 32, 25
#: Frames that are coded or decoded side by side, and blocks of the files that are read together.
FRAMES, BLOCKS = 96, 1 << 18

#: The zigzag order of a block, row by row.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _table(kind: int, ident: int, counts: list[int], symbols: list[int]) -> bytes:
    body = bytes([kind << 4 | ident, *counts, *symbols])
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


# The writer's tables: DC categories 0 to 8 with four bits each, and a one-bit end of block.
_DC = _table(0, 0, [0, 0, 0, 9, *[0] * 12], list(range(9)))
_AC = _table(1, 0, [1, *[0] * 15], [0])


def _head(width: int, height: int, interval: int) -> bytes:
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0])
    restart = b"\xff\xdd" + struct.pack(">HH", 4, interval)
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])
    return b"\xff\xd8" + quant + frame + _DC + _AC + restart + scan


def _segments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of every row of blocks (stuffed, padded with ones), end to end, and their offsets."""
    v = rows.astype(np.int32) - 128
    diff = np.diff(v, axis=1, prepend=0)
    size = np.zeros_like(diff)
    mag = np.abs(diff)
    for k in range(8):
        size += mag >= 1 << k
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = (size << size | extra) << 1  # category, extra bits, end of block (a zero)
    bits = size + 5
    ends = np.cumsum(bits, axis=1)
    byte = -(-ends[:, -1] // 8)
    first = np.concatenate([[0], np.cumsum(byte)])
    out = np.zeros(int(first[-1]) + 4, np.uint8)
    at = first[:-1, None] * 8 + ends - bits
    word = (code.astype(np.uint64) << (32 - bits).astype(np.uint64)) >> (at & 7).astype(np.uint64)
    base = at >> 3
    for k in range(3):  # 13 bits at most, at any bit of a byte
        part = (word >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.uint8)
        np.bitwise_or.at(out, (base + k).ravel(), part.ravel())
    pad = byte * 8 - ends[:, -1]
    out[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out = out[: int(first[-1])]
    stuffed = out == 255
    gain = np.concatenate([[0], np.cumsum(stuffed)])
    full = np.zeros(len(out) + int(stuffed.sum()), np.uint8)
    full[np.arange(len(out)) + gain[:-1]] = out
    return full, first + gain[first]


def encode_frames(payload: bytes, columns: int = COLUMNS, rows: int = ROWS) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of `columns`; the last frame is filled up with zeros."""
    flat = np.frombuffer(payload, np.uint8).reshape(-1, columns)
    fill = -len(flat) % rows
    if fill:
        flat = np.vstack([flat, np.zeros((fill, columns), np.uint8)])
    head = _head(8 * columns, 8 * rows, columns)
    out = []
    for lo in range(0, len(flat), FRAMES * rows):
        some = flat[lo : lo + FRAMES * rows]
        data, at = _segments(some)
        data = data.tobytes()
        for f in range(0, len(some), rows):
            parts = [head]
            for r in range(rows):
                parts.append(data[at[f + r] : at[f + r + 1]])
                parts.append(b"\xff" + bytes([0xD0 + r % 8]) if r < rows - 1 else b"\xff\xd9")
            out.append(b"".join(parts))
    return out


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    lists = lambda tag, body: chunk(b"LIST", tag + body)
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = lists(b"hdrl", chunk(b"avih", main) + lists(b"strl", chunk(b"strh", stream) + chunk(b"strf", image)))
    body, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        body.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    all_ = header + lists(b"movi", b"".join(body)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", 4 + len(all_)) + b"AVI " + all_


def text_payload(text: str | None, unit: int = COLUMNS) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % unit or (unit if not raw else 0))


@dataclass
class Avi:
    rate: float = 0.0
    width: int = 0
    height: int = 0
    frames: list[tuple[int, int]] = field(default_factory=list)  #: place and length of each video chunk


def parse_avi(data: bytes) -> Avi:
    """Header and frame places: by idx1 if there is one (offsets from the movi list or from the file), else by walking movi."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    avi, movi, walked, index = Avi(), 0, [], []

    def walk(at: int, end: int) -> None:
        nonlocal movi
        while at + 8 <= end:
            tag, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + n, end)
            if tag in (b"LIST", b"RIFF"):
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, stop)
            elif tag == b"avih":
                step, avi.width, avi.height = struct.unpack_from("<I28xII", data, body)
                avi.rate = 1_000_000 / step if step else 0.0
            elif tag == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                avi.rate = rate / scale if scale and rate else avi.rate
            elif tag == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", data[body : body + n // 16 * 16]))
            elif tag[2:] in (b"dc", b"db"):
                walked.append((body, n))
            at = body + n + n % 2

    walk(0, len(data))
    places = []
    for tag, _, off, n in index:
        if tag[2:] in (b"dc", b"db"):
            base = movi if data[movi + off : movi + off + 4] == tag else 0
            places.append((base + off + 8, n))
    avi.frames = [p for p in (places or walked) if p[1]]
    return avi


@dataclass
class _Scan:
    height: int
    width: int
    parts: list[tuple[int, int, int, int, int]]  #: component: id, horizontal and vertical sampling, DC and AC table
    quant: list[np.ndarray]
    huffman: dict[tuple[int, int], tuple[bytes, bytes]]
    interval: int
    data: np.ndarray  #: entropy-coded bytes of all segments, without stuffing and markers
    begin: np.ndarray  #: where each segment starts in them


def _parse_jpeg(data: bytes) -> _Scan:
    at, quant, huff, parts, interval, size = 2, {}, {}, [], 0, (0, 0)
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        if at + 4 > len(data):
            raise ValueError("no scan")
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            p = 0
            while p < len(body):
                wide, t = body[p] >> 4, body[p] & 15
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.int32)
                quant[t] = q
                p += 1 + 64 * (1 + wide)
        elif mark == 0xC4:
            p = 0
            while p < len(body):
                counts = body[p + 1 : p + 17]
                huff[body[p] >> 4, body[p] & 15] = (counts, body[p + 17 : p + 17 + sum(counts)])
                p += 17 + sum(counts)
        elif mark in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            size = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            pick = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
    raw = np.frombuffer(data, np.uint8, len(data) - at, at)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    other = ff[(after != 0) & (after != 255) & ~restart]
    end = int(other[0]) if len(other) else len(raw)
    keep = np.ones(len(raw), bool)
    keep[end:] = False
    keep[ff[after == 0] + 1] = False
    marks = ff[restart]
    marks = marks[marks < end]
    keep[marks] = keep[marks + 1] = False
    begin = np.concatenate([[0], np.cumsum(keep)[marks]])
    return _Scan(size[0], size[1], [(i, h, v, *pick[i]) for i, h, v, _ in parts], [quant[q] for *_, q in parts], huff, interval, raw[keep], begin)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For 16 coming bits: code length << 8 | symbol (length 0: no code)."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_coefficients(scans: list[_Scan]) -> list[list[np.ndarray]]:
    """Quantised coefficients of each component of scans with equal headers, (blocks, 64), or (blocks, 1) if no block has any but the first.

    All segments of all scans advance in lockstep.
    """
    head = scans[0]
    wide, high = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
    single = len(head.parts) == 1
    mcus = -(-head.width // (8 * (1 if single else wide))) * -(-head.height // (8 * (1 if single else high)))
    unit = [c for c, p in enumerate(head.parts) for _ in range(1 if single else p[1] * p[2])]
    tables = np.stack([_lookup(*head.huffman[kind, p[3 + kind]]) for p in head.parts for kind in (0, 1)])
    per = head.interval or mcus
    need = -(-mcus // per)
    if any(len(x.begin) < need for x in scans):
        raise ValueError("restart markers are missing")
    base = np.concatenate([[0], np.cumsum([len(x.data) for x in scans])])
    begin = np.concatenate([x.begin[:need] + at for x, at in zip(scans, base, strict=False)])
    count = np.tile(np.minimum(per, mcus - per * np.arange(need)), len(scans)) * len(unit)
    data = np.concatenate([*[x.data for x in scans], np.full(16, 255, np.uint8)])
    window = np.zeros(len(data), np.uint64)  # 64 bits from each byte on
    for k in range(8):
        window[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((int(first[-1]), 1), np.int16)
    live = np.flatnonzero(count)
    bit, block, k = begin[live] * 8, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    last = np.zeros((len(begin), len(head.parts)), np.int64)
    unit = np.array(unit)
    half = np.array([0, *[1 << n - 1 for n in range(1, 17)]])
    u = np.uint64
    limit = len(data) - 9

    def peek() -> np.ndarray:
        return window[np.minimum(bit >> 3, limit)] << (bit & 7).astype(u)

    def symbol(kind: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = tables[kind, (bits >> u(48)).astype(np.int64)]
        if not hit.all():
            raise ValueError("bad Huffman code")
        return hit >> 8, hit & 255

    def number(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = (bits >> u(1) >> (63 - size).astype(u)).astype(np.int64)
        return np.where(x < half[size], x - 2 * half[size] + 1, x)

    while len(live):
        comp = unit[block % len(unit)]
        bits = peek()
        if not k.any():  # all stand at a DC symbol: mostly the end of the block follows, and both are read at once
            n, size = symbol(2 * comp, bits)
            bits = bits << n.astype(u)
            value = number(bits, size)
            bits = bits << size.astype(u)
            last[live, comp] += value
            out[first[live] + block, 0] = last[live, comp]
            m, sym = symbol(2 * comp + 1, bits)
            end = sym == 0
            bit = bit + n + size + np.where(end, m, 0)
            block, k = block + end, np.where(end, 0, 1)
        else:
            dc = k == 0
            n, sym = symbol(2 * comp + ~dc, bits)
            size = np.where(dc, sym, sym & 15).astype(np.int64)
            run = np.where(dc, 0, sym >> 4)
            value = number(bits << n.astype(u), size)
            bit = bit + n + size
            row = first[live] + block
            last[live[dc], comp[dc]] += value[dc]
            out[row[dc], 0] = last[live[dc], comp[dc]]
            ac = ~dc & (size > 0)
            spot = k + run
            if (spot[ac] > 63).any():
                raise ValueError("bad coefficient run")
            if ac.any():
                if out.shape[1] == 1:
                    out = np.hstack([out, np.zeros((len(out), 63), np.int16)])
                out[row[ac], spot[ac]] = value[ac]
            k = np.where(dc, 1, np.where(~dc & (size == 0) & (run < 15), 64, spot + 1))
            done = k > 63
            block, k = block + done, np.where(done, 0, k)
        left = block < count[live]
        if not left.all():
            live, bit, block, k = live[left], bit[left], block[left], k[left]
    total = mcus * len(unit)
    return [[out[f * total : (f + 1) * total].reshape(mcus, len(unit), -1)[:, unit == c].reshape(-1, out.shape[1]) for c in range(len(head.parts))] for f in range(len(scans))]


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples 0 to 255 of quantised zigzag coefficients."""
    full = np.zeros((len(coefficients), 64))
    size = coefficients.shape[1]
    full[:, ZIGZAG[:size]] = coefficients.astype(np.int64) * quant[:size]
    if size == 1:
        flat = np.clip(np.rint(full[:, 0] / 8) + 128, 0, 255).astype(np.uint8)
        return np.broadcast_to(flat[:, None, None], (len(flat), 8, 8))
    x = _COS @ full.reshape(-1, 8, 8) @ _COS.T
    return np.clip(np.rint(x) + 128, 0, 255).astype(np.uint8)


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """Planes (height, width) of a baseline frame, each in its own sampling."""
    scan = _parse_jpeg(data)
    wide, high = max(p[1] for p in scan.parts), max(p[2] for p in scan.parts)
    single = len(scan.parts) == 1
    across = -(-scan.width // (8 * (1 if single else wide)))
    planes = []
    for (_, h, v, *_), q, c in zip(scan.parts, scan.quant, decode_coefficients([scan])[0], strict=True):
        s, h, v = samples(c, q), 1 if single else h, 1 if single else v
        tall = len(s) // (across * h * v)
        grid = s.reshape(tall, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(tall * v * 8, across * h * 8)
        top = (scan.height, scan.width) if single else (-(-scan.height * v // high), -(-scan.width * h // wide))
        planes.append(grid[: top[0], : top[1]])
    return planes


def _luma(scan: _Scan, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoded samples of the first component: the value of each block's first sample, and the histogram of all in 32 steps."""
    s = samples(coefficients, scan.quant[0])
    if scan.width % 8 or scan.height % 8:  # what lies beyond the picture does not count
        across = -(-scan.width // 8)
        grid = s.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)
        return s[:, 0, 0], np.bincount(grid[: scan.height, : scan.width].ravel() >> 3, minlength=32)
    if s.strides[1] == 0:  # all blocks are flat: one sample stands for 64
        return s[:, 0, 0], 64 * np.bincount(s[:, 0, 0] >> 3, minlength=32)
    return s[:, 0, 0], np.bincount(s.ravel() >> 3, minlength=32)


def decode_files(files: list[bytes], avis: list[Avi]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each file of grey frames: (frames, blocks) first samples and (frames, 32) sample histograms; frames with equal headers advance in lockstep."""
    places = [(i, p, n) for i, a in enumerate(avis) for p, n in a.frames]
    flat: list[np.ndarray] = []
    hist: list[np.ndarray] = []
    for lo in range(0, len(places), FRAMES):
        scans = [_parse_jpeg(files[i][p : p + n]) for i, p, n in places[lo : lo + FRAMES]]
        groups: dict[tuple, list[int]] = {}
        for i, s in enumerate(scans):
            groups.setdefault((s.width, s.height, s.interval, tuple(s.parts), tuple(sorted(s.huffman.items()))), []).append(i)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for own in groups.values():
            for i, c in zip(own, decode_coefficients([scans[k] for k in own]), strict=True):
                found[i] = _luma(scans[i], c[0])
        flat += [found[i][0].copy() for i in range(len(scans))]
        hist += [found[i][1] for i in range(len(scans))]
    out, at = [], 0
    for a in avis:
        n = len(a.frames)
        out.append((np.stack(flat[at : at + n]), np.stack(hist[at : at + n])) if n else (np.zeros((0, 0), np.uint8), np.zeros((0, 32), np.int64)))
        at += n
    return out


def shots(luma: np.ndarray, hist: np.ndarray, rate: float, sigmas: float = 3.0, least: float = 0.15) -> list[dict]:
    """Timed clips: a cut where the difference of sample histograms exceeds `least` and mean + sigmas deviations of the shot so far."""
    if not len(luma):
        return []
    share = hist / hist.sum(1, keepdims=True)
    diff = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts, n, mean, var = [0], 0, 0.0, 0.0
    for i, d in enumerate(diff.tolist(), 1):
        if d > least and n >= 1 and d > mean + sigmas * max((var / n) ** 0.5, 0.02):
            cuts.append(i)
            n, mean, var = 0, 0.0, 0.0
            continue
        n += 1
        step = d - mean
        mean += step / n
        var += step * (d - mean)
    return [{"clip": k, "first": a, "last": b - 1, "start_ms": round(1000 * a / rate, 3), "end_ms": round(1000 * b / rate, 3), "luma": round(float(luma[a:b].mean()), 3)} for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(luma)], strict=True))]


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload_bytes and media (an AVI file) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, media = [], [], []
            for t in b.column(1):
                raw, payload = text_payload(t.as_py())
                n.append(raw)
                size.append(len(payload))
                media.append(write_avi(encode_frames(payload), 8 * COLUMNS, 8 * ROWS))
                del payload
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "payload_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(thrifty(run), "id long, n_bytes long, payload_bytes long, media binary")


def read(df: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """id, n_bytes, payload_bytes, payload (read back), media_bytes, media_sha256, clips array<struct> of stored files."""
    clip = "clip int, first int, last int, start_ms double, end_ms double, luma double"
    kind = pa.list_(pa.struct([("clip", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("luma", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            sizes = b.column(2).to_pylist()
            while lo < b.num_rows:  # as many files at once as have about so many blocks
                hi, held = lo + 1, sizes[lo]
                while hi < b.num_rows and held + sizes[hi] <= blocks:
                    held += sizes[hi]
                    hi += 1
                files = b.column(3).slice(lo, hi - lo).to_pylist()
                avis = [parse_avi(f) for f in files]
                seen = decode_files(files, avis)
                payload = [x.tobytes()[:n] for (x, _), n in zip(seen, sizes[lo:hi], strict=True)]
                part = b.slice(lo, hi - lo)
                sha = [hashlib.sha256(f).hexdigest() for f in files]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(payload, pa.binary()), pa.array([len(f) for f in files], pa.int64()), pa.array(sha), pa.array([shots(x, h, a.rate) for (x, h), a in zip(seen, avis, strict=True)], kind)], ["id", "n_bytes", "payload_bytes", "payload", "media_bytes", "media_sha256", "clips"])
                lo = hi

    return df.select("id", "n_bytes", "payload_bytes", "media").mapInArrow(thrifty(run), f"id long, n_bytes long, payload_bytes long, payload binary, media_bytes long, media_sha256 string, clips array<struct<{clip.replace(' ', ':').replace(',:', ',')}>>")


def clip_rows(read_back: DataFrame) -> DataFrame:
    """A row for each timed clip."""
    return read_back.select(F.col("id"), F.explode("clips").alias("c")).select("id", "c.*")


def digest(read_back: DataFrame) -> DataFrame:
    """The digest of the payload and the clips (as JSON) by DataFrame functions."""
    tail = F.expr("substring(payload, length(payload) - 63, 64)")
    return read_back.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        "media_bytes", "media_sha256", F.to_json("clips").alias("feature"),
    )
