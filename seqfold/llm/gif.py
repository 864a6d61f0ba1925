"""GIF columns: LZW streams, palettes, disposal and transparency, timed frames with colour histograms.

``encode`` writes an animation whose pixels are palette indices; ``frames`` reads any GIF87a/89a file (local
palettes, interlacing, disposal methods 0 to 3, transparent index, deferred clear codes) and gives the composed
canvas of each frame with its start and duration.

Defined results: a null or malformed file, or one with a canvas of no pixels or more than ``MAX_PIXELS``, gives the
frames before the fault and then a row with ``error`` (``read_frames``); frames are
numbered from 0 and timed in milliseconds; a null text is stored like an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pixels in a row, and rows in a full frame, of a stored payload.
WIDTH, ROWS = 192, 64
DELAY_CS = 10
BINS = 16
#: Pixels of a canvas or a frame beyond which a file is refused: four bytes each are held at once.
MAX_PIXELS = 1 << 25


class GifError(ValueError):
    pass


class Frame(NamedTuple):
    start_ms: int
    delay_ms: int
    rect: tuple[int, int, int, int]
    canvas: np.ndarray


def _schedule(bits: int, limit: int = 4096) -> np.ndarray:
    """Width of the k-th code since the last clear code: it follows from k alone until the table is full."""
    k = np.arange(1, limit + 1)
    following = (1 << bits) + 1 + k  # first free entry once code k was read
    width = np.full(limit, bits + 1)
    for w in range(bits + 1, 12):
        # Width w + 1 starts after the code that makes the free entry 2^w.
        width[1:][following[:-1] >= (1 << w)] = w + 1
    return width


_WIDTHS = {bits: _schedule(bits) for bits in range(2, 9)}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Greedy LZW with variable-width codes; the table is cleared when it is full."""
    clear, done = 1 << bits, (1 << bits) + 1
    codes, cleared = [clear], [0]
    append = codes.append
    entries: dict[int, int] = {}
    get, free = entries.get, done + 1
    if data:
        prefix = data[0]
        for c in data[1:]:
            key = prefix << 8 | c
            code = get(key)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            if free < 4096:
                entries[key] = free
                free += 1
            else:
                cleared.append(len(codes))
                append(clear)
                entries = {}
                get, free = entries.get, done + 1
            prefix = c
        append(prefix)
    append(done)
    widths = np.empty(len(codes), np.int64)
    schedule = _WIDTHS[bits]
    at = 0
    widths[0] = bits + 1
    for start, end in zip(cleared, [*cleared[1:], len(codes) - 1]):
        # Codes start+1 .. end (the next clear or the end code included) follow the schedule.
        n = end - start
        widths[start + 1 : end + 1] = schedule[np.minimum(np.arange(n), len(schedule) - 1)]
    ends = np.cumsum(widths)
    at = ends - widths
    shifted = np.asarray(codes, np.int64) << (at & 7)
    first = at >> 3
    total = int((ends[-1] + 7) >> 3)
    packed = sum(np.bincount(first + i, weights=(shifted >> (8 * i)) & 255, minlength=total + 3) for i in range(3))
    return packed[:total].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The indices of a code stream, at most ``most`` of them."""
    if not 2 <= bits <= 8:
        raise GifError("code size")
    clear, done = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    end_bit = len(stream) * 8
    out: list[bytes] = []
    made, bit = 0, 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    schedule = _WIDTHS[bits]
    span = np.concatenate([[0], np.cumsum(schedule)])
    table, previous, first = roots.copy(), None, 0
    while made < most:
        # The codes up to the next clear code, a block at a time; beyond the schedule every code has 12 bits.
        if first < len(schedule):
            at = bit + span[first:-1] - span[first]
            width = schedule[first:]
        else:
            at = bit + 12 * np.arange(4096)
            width = np.full(4096, 12)
        fits = int(np.searchsorted(at + width, end_bit, side="right"))
        if not fits:
            raise GifError("code stream ends early")
        at, width = at[:fits], width[:fits]
        b = at >> 3
        codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == done))
        n = int(stops[0]) if len(stops) else fits
        push, grow = out.append, table.append
        size = len(table)
        for c in codes[:n].tolist():
            if previous is None:
                if c >= clear:
                    raise GifError("code without a prefix")
                entry = roots[c]
            else:
                if c < size:
                    entry = table[c]
                elif c == size and size < 4096:
                    entry = previous + previous[:1]
                else:
                    raise GifError("code beyond the table")
                if size < 4096:
                    grow(previous + entry[:1])
                    size += 1
            push(entry)
            made += len(entry)
            previous = entry
        if len(stops):
            if codes[n] == done:
                break
            bit = int(at[n] + width[n])
            table, previous, first = roots.copy(), None, 0
        else:
            bit = int(at[-1] + width[-1])
            first += fits
    return b"".join(out)[:most]


GRAY = bytes(v for i in range(256) for v in (i, i, i))


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animation that shows ``samples`` (whole rows of ``width``) from the top left, ``rows`` rows a frame."""
    if not samples or len(samples) % width:
        raise GifError("whole rows are needed")
    step = width * rows
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, len(samples) // width), 0xF7, 0, 0), GRAY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for start in range(0, len(samples), step):
        part = samples[start : start + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        code = lzw_encode(part)
        out.append(b"\x08")
        for i in range(0, len(code), 255):
            block = code[i : i + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("data ends in a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def frames(data: bytes) -> Iterator[Frame]:
    """The composed frames of a file, in order; the canvas is rows x columns x 4 (red, green, blue, alpha).

    The canvas given is the drawing surface itself: it changes when the next frame is asked for.
    """
    try:
        yield from _frames(data)
    except GifError:
        raise
    except (IndexError, ValueError, struct.error) as broken:
        raise GifError(f"truncated: {broken}") from broken


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("signature")
    columns, lines, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    if not 0 < lines * columns <= MAX_PIXELS:
        raise GifError("canvas size")
    canvas = np.zeros((lines, columns, 4), np.uint8)
    clock, delay, disposal, transparent = 0, 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            block, at = _blocks(data, at + 1)
            if label == 0xF9 and len(block) >= 4:
                packed, delay_cs, index = struct.unpack_from("<BHB", block)
                delay, disposal, transparent = delay_cs * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise GifError("block kind")
        left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if palette is None:
            raise GifError("no palette")
        if width * height > MAX_PIXELS:
            raise GifError("frame size")
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, bits, width * height), np.uint8)
        if len(index) < width * height:
            raise GifError("too few pixels")
        index = index.reshape(height, width)
        if flags & 0x40:
            order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        if index.size and int(index.max()) >= len(palette):
            raise GifError("index beyond the palette")
        kept = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + height, left : left + width]
        index = index[: area.shape[0], : area.shape[1]]
        if transparent is None:
            area[..., :3] = palette[index]
            area[..., 3] = 255
        else:
            seen = index != transparent
            area[seen, :3] = palette[index[seen]]
            area[seen, 3] = 255
        yield Frame(clock, delay, (left, top, width, height), canvas)
        clock += delay
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas[...] = kept
        delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Counts of the visible pixels in ``bins`` equal ranges of red, green and blue."""
    seen = canvas[canvas[..., 3] > 0][:, :3]
    return [np.bincount(seen[:, c].astype(np.int64) * bins >> 8, minlength=bins).tolist() for c in range(3)]


FRAME_SCHEMA = (
    "media_id long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, "
    "red_hist array<int>, green_hist array<int>, blue_hist array<int>, error string"
)


def read_frames(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """A row per composed frame; a file that breaks off gives the frames before that and a row with ``error``."""

    def make():
        def of(media_id, data):
            rows = []
            try:
                for k, f in enumerate(frames(data or b"")):
                    height, width = f.canvas.shape[:2]
                    rows.append((media_id, k, f.start_ms, f.delay_ms, width, height, f.canvas.tobytes(), *histogram(f.canvas), None))
            except GifError as broken:
                rows.append((media_id, len(rows), None, None, None, None, None, None, None, None, str(broken)))
            return rows

        return of

    return common.flat_map_rows(media.select(id_col, data_col), make, FRAME_SCHEMA)


def write_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, gif): each text, padded with blanks to whole rows, as an animation."""
    return common.map_rows(docs.select("doc_id", "text"), lambda: lambda i, t: (i, len(x := (t or "").encode()), encode(padded(x))), "doc_id long, n_bytes long, gif binary")


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH)


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as a GIF, read the file back frame by frame, and derive the digest columns."""

    def make():
        def of(doc_id, text):
            raw = (text or "").encode()
            media = encode(padded(raw))
            read, total, count = [], np.zeros(BINS, np.int64), 0
            for f in frames(media):
                _, _, width, height = f.rect
                red = f.canvas[:height, :width, 0]
                read.append(red.tobytes())
                total += np.bincount(red.ravel() >> 4, minlength=BINS)
                count += 1
            payload = b"".join(read)
            feature = f"frames={count};ms={f.start_ms + f.delay_ms};hist=" + ",".join(map(str, total.tolist()))
            return doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return of

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_rows(docs.select("doc_id", "text"), make, schema)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
