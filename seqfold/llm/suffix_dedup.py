"""Exact substring dedup of a whole corpus with suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (smaller document id, or the same document
and an earlier start) is removed; overlaps count, and all strings are judged on the input.

The suffix array is built by two-stage sorting (``suffix_array``): only the suffixes smaller than their successors
are sorted directly, the rest follow from scans of the buckets; adjacent common prefixes then give the runs of equal
strings. It isn't built over all text in one place. Each string is assigned to an anchor, the least of the hashed
32-byte grams in it (the leftmost of equal ones), so equal strings have equal anchors; consecutive strings with the
same anchor are one segment.

1. Tasks over the documents list their segments: hash of the anchor, digest of the segment's bytes, place. Equal
   segments within a task are settled there and only the earliest goes on, so a passage shared by a third of all
   documents sends one record per task.
2. Records meet by anchor. Equal segments keep the earliest, the others lose all their strings. Anchors with one
   segment are done; where different segments share an anchor, one of each kind goes on.
3. Those fetch their bytes and meet by anchor again. Strings whose hash no other string there has go; suffix arrays
   over what is left find the equal strings.
4. The removed ranges meet by document.

Number of parts: by the input's bytes, so a part's records and bytes fit a task's memory at any size.

Defined results: a null text is an empty one; rows without an id lose nothing and take nothing from others; rows
repeated with their id count once, so repetition alone removes nothing (rows that share an id must share the text);
an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

LENGTH, GRAM = 100, 32
#: Low bits of a gram's hash that give way to its place; a block is no longer than they can tell.
PLACE_BITS = 22
#: Text bytes whose grams are hashed at once, segments settled at once, and text bytes to a part of the exchanges.
BLOCK, SETTLE, PART_BYTES = 1 << 21, 1 << 20, 24 << 20
#: Bytes of open segments whose strings are hashed at once.
HASHED = 1 << 18
SEGMENT = np.dtype([("h", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
SEGMENTS, RANGES, OPEN = 0, 1, 2


# --- two-stage suffix sorting -------------------------------------------------------------------------------------


def packed(t: np.ndarray) -> np.ndarray:
    """The seven symbols (of nine bits) from each position on as one number; zeros follow the end."""
    t = np.concatenate([t.astype(np.uint64), np.zeros(8, np.uint64)])
    two = t[:-1] << np.uint64(9) | t[1:]
    four = two[:-2] << np.uint64(18) | two[2:]
    n = len(t) - 8
    return four[:n] << np.uint64(27) | two[4 : 4 + n] << np.uint64(9) | t[6 : 6 + n]


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the suffix after it (the end of the text being smallest)."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    step[-1] = -1
    places = np.flatnonzero(step)
    return step[places[np.searchsorted(places, np.arange(n))]] > 0


def direct_sort(words: np.ndarray, at: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffixes ``at`` in order of their first ``depth`` symbols (None: of all)."""
    n = len(words)
    order = at[np.argsort(words[at], kind="stable")]
    group = np.zeros(len(order), np.int64)  # first index of equal entries
    if len(order) > 1:
        key = words[order]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(order)), 0))
    done = 7
    while depth is None or done < depth:
        same = np.zeros(len(order), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        far = order[tied] + done
        if depth is None and (far >= n + 7).all():
            break
        key = np.where(far < n, words[np.minimum(far, n - 1)], np.uint64(0))
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key, g = key[by], group[tied]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        group[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        done += 7
    return order


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``t`` (symbols from 0 to 256) in order; with ``depth``, equal beyond that many symbols is any order."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(t)
    direct = direct_sort(packed(t if depth is not None else t + 1), np.flatnonzero(small), depth)
    symbols = int(t.max()) + 1
    bounds = np.searchsorted(t[direct], np.arange(symbols + 1))  # direct is in order of its first symbols
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    waiting[t[n - 1]].append(np.array([n - 1]))  # the last suffix comes after the end of the text
    out = []
    for c in range(symbols):
        induced = []
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(now):  # runs of the symbol itself
            induced.append(now)
            before = now - 1
            before = before[before >= 0]
            now = before[(t[before] == c) & ~small[before]]
        bucket = np.concatenate([*induced, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[(t[before] > c) & ~small[before]]
        if len(before):
            symbol = t[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part in np.split(before, cuts):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, limit: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix (of those ``wanted``, else 0) with the one before it in ``order``, up to ``limit``."""
    n = len(t)
    common_prefix = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return common_prefix
    words = packed(t + 1)
    alive = np.arange(1, len(order)) if wanted is None else np.flatnonzero(wanted[1:]) + 1
    done = 0
    while len(alive) and done < limit:
        a, b = order[alive - 1] + done, order[alive] + done
        wa = np.where(a < n, words[np.minimum(a, n - 1)], np.uint64(0))
        wb = np.where(b < n, words[np.minimum(b, n - 1)], np.uint64(0))
        differ = wa ^ wb
        whole = differ == 0
        for k in range(7):  # symbols agreed before the first difference
            agreed = (differ >> np.uint64(9 * (6 - k))) == 0
            common_prefix[alive] += agreed & (wa >> np.uint64(9 * (6 - k)) & np.uint64(511) != 0)
        alive = alive[whole & (a < n) & (b < n)]
        done += 7
    return np.minimum(common_prefix, limit)


def later_strings(pieces: list[bytes], starts: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Places in the joined text of ``pieces`` whose ``length``-byte string also begins, by ``rank``, earlier.

    ``starts`` counts the strings of each piece (len(piece) - length + 1); ``rank`` orders all strings of all pieces.
    """
    t = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(p) for p in pieces])
    # A zero after each piece: strings never cross it.
    ends = np.cumsum(sizes)
    t = np.insert(t, ends, 0)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.repeat(first - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    string = np.full(len(t), -1, np.int64)
    string[place] = np.arange(len(place))
    order = suffix_array(t, depth=length)
    of = string[order]
    # Runs of equal strings; a suffix that begins no string has a run of its own.
    follows = (of >= 0) & np.concatenate([[False], of[:-1] >= 0])
    run = np.cumsum(~follows | (adjacent_prefixes(t, order, length, follows) < length))
    kept = of >= 0
    of, run = of[kept], run[kept]
    least = np.full(int(run.max()) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, run, rank[of])
    return of[rank[of] > least[run]]


# --- anchors ------------------------------------------------------------------------------------------------------


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from each position on."""
    x = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    size = 1
    while size < gram:
        x = x[:-size] * np.uint64((0xD6E8FEB86659FD93 * (2 * size + 1)) % (1 << 64)) + (x[size:] ^ (x[size:] >> np.uint64(29)))
        size *= 2
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def segments(joined: bytes, docs: list[tuple[int, int, int, int]], length: int = LENGTH) -> np.ndarray:
    """Segments of documents joined to one text.

    ``docs`` has (id, offset in the text, size, offset within the document) of each; a string belongs to one of them.
    """
    if len(joined) < length:
        return np.zeros(0, SEGMENT)
    hashes = gram_hashes(np.frombuffer(joined, np.uint8))
    if len(joined) > 1 << PLACE_BITS:
        raise ValueError("too long a block")
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & low).astype(np.int64)  # of the string that begins here
    owner = np.full(len(anchor), -1, np.int64)
    for k, (_, offset, n, _) in enumerate(docs):
        if n >= length:
            owner[offset : offset + n - length + 1] = k
    edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(owner) != 0)) + 1
    first = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([first, [len(anchor)]]))
    own = owner[first] >= 0
    first, count = first[own], count[own]
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    out = np.zeros(len(first), SEGMENT)
    out["h"] = hashes[anchor[first]]
    out["digest"] = np.fromiter((digest(view[s : s + c + length - 1]) for s, c in zip(first.tolist(), count.tolist())), np.uint64, len(first))
    ids, offsets, within = (np.array(x, np.int64) for x in zip(*((d, o, w) for d, o, _, w in docs)))
    k = owner[first]
    out["doc"], out["start"], out["n"] = ids[k], first - offsets[k] + within[k], count
    return out


def settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of equal segments, the ranges of all others)."""
    if not len(found):
        return found, np.zeros(0, RANGE)
    order = np.lexsort((found["start"], found["doc"], found["digest"], found["h"]))
    found = found[order]
    same = (found["h"][1:] == found["h"][:-1]) & (found["digest"][1:] == found["digest"][:-1])
    same = np.concatenate([[False], same])
    again = np.concatenate([[False], (found["doc"][1:] == found["doc"][:-1]) & (found["start"][1:] == found["start"][:-1])]) & same
    # A repeated row lists its places again: the copies of a place are one.
    leader = np.maximum.accumulate(np.where(~same, np.arange(len(found)), 0))
    repeat = again & (found["doc"] == found["doc"][leader]) & (found["start"] == found["start"][leader])
    return found[~same], ranges(found[same & ~repeat])


def ranges(found: np.ndarray) -> np.ndarray:
    out = np.zeros(len(found), RANGE)
    for name in RANGE.names:
        out[name] = found[name]
    return out


def string_hashes(b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of the ``length`` bytes from each position on, by two grams that cover them."""
    gram, n = 1 << (length.bit_length() - 1), len(b) - length + 1
    x = gram_hashes(b, gram)
    return x[:n] * np.uint64(0x9E3779B97F4A7C15) + x[length - gram : length - gram + n]


def repeated(r: np.ndarray, pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, list[bytes]]:
    """The segments and their bytes, cut to the range of the strings that may equal another one of their anchor."""
    n = r["n"].astype(np.int64)
    sizes = np.cumsum(n + length - 1)
    found, at = [], 0
    while at < len(r):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + HASHED, side="right")))
        some = n[at:stop]
        place = np.repeat((length - 1) * np.arange(len(some)), some) + np.arange(int(some.sum()))
        hashes = string_hashes(np.frombuffer(b"".join(pieces[at:stop]), np.uint8), length)[place]
        found.append(hashes ^ np.repeat(r["h"][at:stop] * np.uint64(0xD6E8FEB86659FD93), some))
        at = stop
    keys = np.concatenate(found)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    hits = np.flatnonzero(hit)
    of = np.repeat(np.arange(len(r)), n)[hits]
    kept, first = np.unique(of, return_index=True)
    last = np.append(first[1:], len(of))[: len(kept)] - 1
    base = (np.cumsum(n) - n)[kept]
    low, high = hits[first] - base, hits[last] - base + 1
    out = r[kept].copy()
    out["start"], out["n"] = out["start"] + low, high - low
    return out, [pieces[k][a : b + length - 1] for k, a, b in zip(kept.tolist(), low.tolist(), high.tolist())]


# --- exchanges ----------------------------------------------------------------------------------------------------

PARTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
PARTS_DDL = "part int, kind int, data binary"


def pack(records: np.ndarray) -> bytes:
    """Records by column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(records[name]).tobytes() for name in records.dtype.names))


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        field = kind[name]
        out[name] = np.frombuffer(raw, field, n, at)
        at += n * field.itemsize
    return out


def doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    x = doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def shares(records: np.ndarray, part: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(part)]):
        if end > start:
            yield int(part[start]), kind, pack(records[start:end])


def release() -> None:
    """Gives the memory that a task has freed back to the system: the next task of the worker may be another's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _send(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    yield from _sent(rows)
    release()


def _sent(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PARTS)], schema=PARTS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PARTS)], schema=PARTS)


def _list_segments(parts: int, length: int) -> Callable:
    """Step 1, over (doc_id, text)."""

    def blocks(batches) -> Iterator[tuple[bytes, list]]:
        held, docs, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer()
                n = raw.size if raw is not None else 0
                # Long texts in blocks that overlap by a string less one byte.
                for at in range(0, max(1, n - length + 1), BLOCK):
                    piece = raw[at : at + BLOCK + length - 1].to_pybytes() if n >= length else b""
                    if not piece:
                        continue
                    if size + len(piece) > 1 << PLACE_BITS:
                        yield b"".join(held), docs
                        held, docs, size = [], [], 0
                    held.append(piece)
                    docs.append((doc, size, len(piece), at))
                    size += len(piece)
                    if size >= BLOCK:
                        yield b"".join(held), docs
                        held, docs, size = [], [], 0
        if held:
            yield b"".join(held), docs

    def rows(batches):
        held, count = [], 0
        for joined, docs in blocks(batches):
            held.append(segments(joined, docs, length))
            count += len(held[-1])
            if count >= SETTLE:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        first, rest = settle(np.concatenate(held))
        yield from shares(first, (first["h"] % np.uint64(parts)).astype(np.int32), SEGMENTS)
        yield from shares(rest, doc_part(rest["doc"], parts), RANGES)

    return lambda batches: _send(rows(batches))


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
            found.setdefault(kind, []).append(data)
    return found


def _meet(parts: int) -> Callable:
    """Step 2, over the segments of one part."""

    def rows(batches):
        found: list[np.ndarray] = []
        for batch in batches:
            for part, kind, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if kind == RANGES:
                    yield part, kind, data
                else:
                    found.append(unpack(data, SEGMENT))
        if not found:
            return
        first, rest = settle(np.concatenate(found))
        yield from shares(rest, doc_part(rest["doc"], parts), RANGES)
        shared = np.zeros(len(first), bool)
        shared[1:] = first["h"][1:] == first["h"][:-1]
        shared[:-1] |= shared[1:]
        unsure = first[shared]
        yield from shares(unsure, doc_part(unsure["doc"], parts), OPEN)

    return lambda batches: _send(rows(batches))


def _by_document(kind: int, dtype: np.dtype) -> Callable:
    """(doc_id, records) for each document of a part."""
    schema = pa.schema([("id", pa.int64()), ("records", pa.binary())])

    def run(batches):
        found = [unpack(x, dtype) for x in _gather(batches).get(kind, [])]
        if not found:
            return
        records = np.concatenate(found)
        records = records[np.argsort(records["doc"], kind="stable")]
        cuts = np.flatnonzero(np.diff(records["doc"])) + 1
        bounds = [0, *cuts.tolist(), len(records)]
        for at in range(0, len(bounds) - 1, 4096):
            some = bounds[at : at + 4097]
            pairs = [(int(records["doc"][s]), records[s:e]) for s, e in zip(some, some[1:])]
            data = [(merged(r) if dtype == RANGE else r).tobytes() for _, r in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return run


def merged(r: np.ndarray) -> np.ndarray:
    """Ranges of strings that touch or overlap, as one; in order."""
    r = r[np.argsort(r["start"], kind="stable")]
    start, end = r["start"].astype(np.int64), r["start"].astype(np.int64) + r["n"]
    reach = np.maximum.accumulate(end)
    fresh = np.concatenate([[True], start[1:] > reach[:-1]])
    out = np.zeros(int(fresh.sum()), RANGE)
    at = np.flatnonzero(fresh)
    out["doc"], out["start"] = r["doc"][at], start[at]
    out["n"] = reach[np.concatenate([at[1:], [len(r)]]) - 1] - start[at]
    return out


OPENED = np.dtype([*((n, SEGMENT[n]) for n in SEGMENT.names), ("size", "<u4")])


def _fetch(parts: int, length: int) -> Callable:
    """Step 3, first half, over (doc_id, text, records): the bytes of the open segments, to the parts of their anchors."""

    def flush(held):
        records = np.concatenate([r for r, _ in held])
        pieces = [p for _, ps in held for p in ps]
        part = (records["h"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for some in np.split(order, cuts):
            head = pack(records[some])
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(pieces[i] for i in some.tolist()))
            yield int(records["h"][some[0]] % np.uint64(parts)), OPEN, len(head).to_bytes(4, "little") + head + body

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for _, text, data in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                records = np.frombuffer(data, SEGMENT)
                raw = text.as_buffer()
                pieces = [raw[s : s + n + length - 1].to_pybytes() for s, n in zip(records["start"].tolist(), records["n"].tolist())]
                held.append((records, pieces))
                size += sum(map(len, pieces))
                if size > BLOCK * 4:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return lambda batches: _send(rows(batches))


def _sort(parts: int, length: int) -> Callable:
    """Step 3, second half: suffix arrays over what may be equal in a part's segments, some anchors at once."""

    def rows(batches):
        records, pieces = [], []
        for data in _gather(batches).get(OPEN, []):
            size = int.from_bytes(data[:4], "little")
            r = unpack(data[4 : 4 + size], SEGMENT)
            body = zstandard.ZstdDecompressor().decompress(data[4 + size :])
            ends = np.cumsum(r["n"].astype(np.int64) + length - 1).tolist()
            pieces += [body[a:b] for a, b in zip([0, *ends], ends)]
            records.append(r)
        if not records:
            return
        r = np.concatenate(records)
        r, pieces = repeated(r, pieces, length)
        if not len(r):
            return
        order = np.argsort(r["h"], kind="stable")
        r, pieces = r[order], [pieces[i] for i in order.tolist()]
        sizes = np.cumsum(r["n"].astype(np.int64) + length)
        edges = np.concatenate([np.flatnonzero(np.diff(r["h"])) + 1, [len(r)]])
        start, done = 0, 0
        while start < len(r):
            # All segments of an anchor stay together.
            k = max(int(np.searchsorted(sizes[edges - 1], done + BLOCK, side="right")) - 1, 0)
            end = int(edges[k]) if edges[k] > start else int(edges[np.searchsorted(edges, start, side="right")])
            some = r[start:end]
            n = some["n"].astype(np.int64)
            doc = np.repeat(some["doc"], n)
            at = np.repeat(some["start"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            rank = np.empty(len(doc), np.int64)
            by = np.lexsort((at, doc))
            # Places that a repeated row lists again have one rank.
            rank[by] = np.cumsum(np.concatenate([[0], (np.diff(doc[by]) != 0) | (np.diff(at[by]) != 0)]))
            later = later_strings(pieces[start:end], n, rank, length)
            out = np.zeros(len(later), RANGE)
            out["doc"], out["start"], out["n"] = doc[later], at[later], 1
            if len(out):
                yield from shares(out, doc_part(out["doc"], parts), RANGES)
            start, done = end, int(sizes[end - 1])

    return lambda batches: _send(rows(batches))


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, records): for each document that loses bytes, its ranges of strings that also begin earlier."""
    spark = docs.sparkSession
    common.visible(spark)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    listed = texts.mapInArrow(_list_segments(parts, length), PARTS_DDL)
    met = common.cut(listed.repartitionById(parts, "part").mapInArrow(_meet(parts), PARTS_DDL))
    unsure = met.where(F.col("kind") == OPEN).repartitionById(parts, "part").mapInArrow(_by_document(OPEN, SEGMENT), "id long, records binary")
    opened = texts.join(unsure, F.col("doc_id") == F.col("id")).select("doc_id", "text", "records")
    sorted_ = opened.mapInArrow(_fetch(parts, length), PARTS_DDL).repartitionById(parts, "part").mapInArrow(_sort(parts, length), PARTS_DDL)
    return met.where(F.col("kind") == RANGES).union(sorted_).repartitionById(parts, "part").mapInArrow(_by_document(RANGES, RANGE), "id long, records binary")


def spans(records: bytes | None, length: int) -> list[tuple[int, int]]:
    """Byte spans, maximal, from ranges of strings."""
    out: list[list[int]] = []
    for start, n in np.frombuffer(records or b"", RANGE)[["start", "n"]].tolist():
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text, records) of every row."""
    gone = removed(docs, length)
    return docs.select("doc_id", "text").join(gone, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "records")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, spans): the bytes left of each text, and the spans removed."""

    def make():
        def of(doc_id, text, records):
            raw, cut = (text or "").encode(), spans(records, length)
            return doc_id, keep(raw, cut), [{"start": a, "end": b} for a, b in cut]

        return of

    return common.map_rows(with_spans(docs, length), make, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def keep(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in cut:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def make():
        def of(doc_id, text, records):
            raw, cut = (text or "").encode(), spans(records, length)
            left = keep(raw, cut)
            return doc_id, len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest()

        return of

    return common.map_rows(with_spans(docs, length), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
