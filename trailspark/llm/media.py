"""Media columns: GIF frames as binary columns, decoded with numpy.

``encode`` stores bytes as the palette indices of an animated GIF, compressed by
LZW with a clear code where the table is full; ``decode``
reads any GIF: code streams (LZW with clear and end codes, width 3 to 12,
interlace), global and local palettes, transparency, disposal methods and frame
delays. ``frames`` turns a table of GIFs into timed frames with colour-histogram
columns.

Decoding is array work: within a stretch between clear codes the code widths
follow from the position alone, so the codes are cut out at once; a table entry
is a stretch of the output written before it, so strings are copied by pointer
doubling rather than by growing a table.

An empty or null payload has one block of zeros, so every row has an image.
A damaged file raises ``ValueError`` in ``decode``; ``frames`` gives it no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailspark.plans.session import ship

from . import common

UNIT = 64
#: Image width in samples, and the most rows of a frame.
WIDTH, ROWS = 64, 1024
SPEC = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration int"


@dataclass
class Frame:
    """One frame as shown: start and delay in hundredths of a second, indices as stored, and the canvas."""

    start: int
    delay: int
    indices: np.ndarray
    canvas: np.ndarray


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(payload) // unit) * unit)
    return payload + bytes(size - len(payload))


def _schedule(min_size: int, n: int) -> np.ndarray:
    """Bits of the i-th code (from 0) after a clear code."""
    i = np.arange(n)
    table = np.minimum((1 << min_size) + 2 + np.maximum(i - 1, 0), 4096)  # entries known to the decoder when it reads code i
    bits = np.full(n, min_size + 1)
    for w in range(min_size + 1, 12):
        bits[table >= (1 << w)] = w + 1
    return np.minimum(bits, 12)


#: Bits of the codes of 8-bit samples, by their place after a clear code.
_WIDTHS = _schedule(8, 4096)


def _codes_out(data: bytes) -> bytes:
    """An LZW code stream of 8-bit samples; the table starts anew when it is full."""
    # codes are held with eight free bits, so that a code and the next sample make a key at once
    out: list[int] = [256 << 8]
    at = [0]  # place of each code after its clear code; the first clear code stands like one
    table: dict[int, int] = {}
    get, put = table.get, out.append
    cur, free, full, begun = data[0] << 8, 258 << 8, 4096 << 8, 1
    for b in data[1:]:
        code = get(cur | b)
        if code:
            cur = code
            continue
        put(cur)
        table[cur | b] = free
        free += 256
        cur = b << 8
        if free == full:
            put(256 << 8)
            at += range(len(out) - begun)
            begun = len(out)
            table.clear()
            free = 258 << 8
    out += [cur, 257 << 8]
    at += range(len(out) - begun)
    # bits of all codes, least first
    wide = _WIDTHS[np.array(at)]
    bits = ((np.array(out, np.uint32) >> 8).astype(np.uint16)[:, None] >> np.arange(12, dtype=np.uint16) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < wide[:, None]], bitorder="little").tobytes()


def _blocks(stream: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes and the terminator."""
    whole = len(stream) // 255
    full = np.empty((whole, 256), np.uint8)
    full[:, 0] = 255
    full[:, 1:] = np.frombuffer(stream, np.uint8, whole * 255).reshape(whole, 255)
    rest = stream[whole * 255 :]
    return full.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


#: The palette: index i is the colour (i, 255 - i, i * 7 mod 256).
PALETTE = np.stack([np.arange(256), 255 - np.arange(256), np.arange(256) * 7 % 256], 1).astype(np.uint8)


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = 10) -> bytes:
    """A GIF of ``width`` columns that holds the samples; a frame for each ``width * rows`` of them."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE.tobytes()]
    for at in range(0, len(samples), width * rows):
        part = samples[at : at + width * rows]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(_codes_out(part))]
    return b"".join([*out, b"\x3b"])


_schedules: dict[int, np.ndarray] = {}


def lzw_decode(stream: bytes, min_size: int, expected: int) -> np.ndarray:
    """Samples of a GIF code stream."""
    if not 1 <= min_size <= 11:
        raise ValueError("bad code size")
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    total = len(stream) * 8
    out: list[np.ndarray] = []
    made, bit = 0, 0
    if min_size not in _schedules:
        _schedules[min_size] = np.cumsum(np.r_[0, _schedule(min_size, 4200)])
    ladder = _schedules[min_size]
    guess = min(max(total // (min_size + 1) + 1, 16), 4096)
    while bit < total and made < expected:
        n = guess
        while True:
            offs = ladder[: n + 1] if n < len(ladder) else np.r_[ladder, ladder[-1] + 12 * np.arange(1, n - len(ladder) + 2)]
            at, wide = bit + offs[:-1], np.diff(offs)
            inside = at + wide <= total
            at, wide = at[inside], wide[inside]
            b = at >> 3
            word = raw[b] | raw[b + 1] << np.uint32(8) | raw[b + 2] << np.uint32(16)
            codes = ((word >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << wide.astype(np.uint32)) - np.uint32(1))).astype(np.int64)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or len(codes) < n or made + n >= expected + 2:
                break
            n *= 4
        k = int(stop[0]) if len(stop) else len(codes)
        finished = not len(stop) or codes[k] == end
        if k:
            part = _expand(codes[:k], clear)
            out.append(part)
            made += len(part)
        guess = max(16, min(guess, (total - bit) // (min_size + 1) + 1))
        if finished:
            break
        bit = int(at[k] + wide[k])
    got = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(got) < expected:
        raise ValueError("code stream ends early")
    return got[:expected]


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes of one stretch. Entry ``clear + 2 + j`` is code j's string and the next string's first sample."""
    if codes.max() < clear:
        return codes.astype(np.uint8)
    first = clear + 2
    n = len(codes)
    if (codes - first >= np.minimum(np.arange(n), 4096 - first)).any() or codes[0] >= clear:
        raise ValueError("code before its entry")
    # length of each code's string: one more than that of the code its entry was made from, by pointer doubling
    refers = codes >= first
    ref = np.flatnonzero(refers)
    parent = np.full(n + 1, n, np.int32)
    parent[ref] = codes[ref] - first
    size_a = np.ones(n + 1, np.int32)
    size_a[n] = 0
    while (parent < n).any():
        size_a += size_a[parent]
        parent = parent[parent]
    size_a = size_a[:n]
    start = np.zeros(n + 1, np.int32)
    np.cumsum(size_a, out=start[1:])
    source = np.arange(start[-1], dtype=np.int32)
    lens = size_a[ref]
    if len(ref):
        # each sample of a string that was seen before comes from where that one began
        back = np.repeat(start[codes[ref] - first] - start[ref], lens)
        mine = np.repeat(refers, size_a)
        source[mine] += back
    while True:
        nxt = source[source]
        if np.array_equal(nxt, source):
            break
        source = nxt
    literal = np.zeros(start[-1], np.uint8)
    own = codes < clear
    literal[start[:-1][own]] = codes[own]
    return literal[source]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("file ends in a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames in order; canvases are RGBA."""
    width, height, found = opened(data)
    return width, height, list(found)


def opened(data: bytes) -> tuple[int, int, Iterator[Frame]]:
    """The same with one frame at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
    return width, height, _frames(data, at, palette, width, height)


def _rgba(colours: np.ndarray) -> np.ndarray:
    """Opaque colours as one number each, of 256 entries; indices beyond a palette show its last colour."""
    full = np.full((256, 4), 255, np.uint8)
    full[: len(colours), :3] = colours
    full[len(colours) :, :3] = colours[-1]
    return full.view(np.uint32).ravel()


def _frames(data: bytes, at: int, palette: np.ndarray | None, width: int, height: int) -> Iterator[Frame]:
    canvas = np.zeros((height, width), np.uint32)
    clock, delay, disposal, clear_index = 0, 0, 0, -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            block, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, block[1] | block[2] << 8
                clear_index = block[3] if block[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours = palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
        size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        indices = lzw_decode(stream, size, w * h).reshape(h, w)
        if flags & 0x40:
            order = np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        if colours is not None:
            area = canvas[top : top + h, left : left + w]
            seen = indices[: area.shape[0], : area.shape[1]]
            shown = _rgba(colours)[seen]
            if clear_index < 0:
                area[:] = shown
            else:
                area[seen != clear_index] = shown[seen != clear_index]
        yield Frame(clock, delay, indices, canvas.view(np.uint8).reshape(height, width, 4).copy())
        clock += delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1


def histogram(frame: Frame, bins: int = 4) -> list[int]:
    """Visible pixels by ``bins`` levels of red, green and blue each: ``bins ** 3`` counts."""
    pixels = frame.canvas.reshape(-1, 4)
    red, green, blue = (pixels[:, k] // np.uint8(256 // bins) for k in range(3))
    level = (red.astype(np.int32) * bins + green) * bins + blue
    return np.bincount(level[pixels[:, 3] > 0], minlength=bins**3).tolist()


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed frames of a column of GIFs: ``doc_id, frame, start, delay, width, height, histogram``. A damaged or null file has no rows."""
    spec = "doc_id long, frame int, start int, delay int, width int, height int, histogram array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k.split(" ")[0]: [] for k in spec.split(", ")}
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    w, h, found = decode(data or b"")
                except (ValueError, struct.error, IndexError):
                    continue
                for k, f in enumerate(found):
                    for name, v in zip(rows, (i, k, f.start, f.delay, w, h, histogram(f)), strict=True):
                        rows[name].append(v)
            yield common.as_arrow(spec, rows)

    ship(media.sparkSession)
    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, spec)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a GIF."""
    spec = "doc_id long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield common.as_arrow(spec, {"doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "media": [encode(pad(t)) for t in texts]})

    return common.id_text(docs, id_col, text_col).mapInArrow(run, spec)


def read_back(data: bytes) -> tuple[bytes, list[int], int, int]:
    """What a stored file holds: payload, pixels of all frames by colour, frames, and hundredths of a second."""
    parts, hist, count, length = [], np.zeros(64, np.int64), 0, 0
    for f in opened(data)[2]:
        parts.append(f.indices.tobytes())
        hist += histogram(f)
        count, length = count + 1, f.start + f.delay
    return b"".join(parts), hist.tolist(), count, length


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold, decoded from them: payload and file digests, the colour histogram of the canvases, frames and their time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text="media"):
            rows = {k.split(" ")[0]: [] for k in SPEC.split(", ")}
            for i, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, hist, count, length = read_back(data)
                for name, v in zip(rows, (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, hist)), count, length), strict=True):
                    rows[name].append(v)
            yield common.as_arrow(SPEC, rows)

    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SPEC)
