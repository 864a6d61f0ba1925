"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with exclusive-or and bit counts in numpy, tile against tile. A tile holds fingerprints
with the same bit counts in each of their four 16-bit quarters; as one differing bit changes one of these counts by
one, only pairs of tiles whose counts differ by ``radius`` or less in total can hold a link, and all others are
skipped. Equal fingerprints are one node from the start, so groups of copies cost one comparison.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link like any other;
rows with a null id are given with a null component unless linked to another; repeated rows link to themselves; an
empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a cell that one tile holds at most, and the sides of a block compared at once.
TILE, BLOCK = 1 << 16, 1 << 11
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bit k is set if it is set in more than half of the shingles' hashes (signed 64-bit pattern)."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    n = max(1, len(words) - width + 1) if words else 0
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, n, CHUNK):
        h = np.fromiter(itertools.islice(hashes, CHUNK), np.uint64, min(CHUNK, n - start))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    return common.map_rows(docs.select("doc_id", "text"), lambda: lambda i, t: (i, fingerprint(t or "", width)), "doc_id long, fp long")


def _forward(radius: int) -> list[int]:
    """Steps to the cells that come later in order and whose counts differ by at most ``radius`` in total."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    coded = ((sum(map(abs, s)), (s[0] << 15) + (s[1] << 10) + (s[2] << 5) + s[3]) for s in steps)
    return sorted(c for far, c in coded if far <= radius and c > 0)


def _cell(fp, radius: int):
    """Bit counts of the quarters, five bits each; ``radius`` is added so that steps never borrow."""
    parts = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)) + radius for k in range(4)]
    return (F.shiftleft(parts[3], 15) + F.shiftleft(parts[2], 10) + F.shiftleft(parts[1], 5) + parts[0]).cast("int")


def near(home: np.ndarray, other: np.ndarray, radius: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``home``, of ``other``) within ``radius`` bits."""
    for i in range(0, len(home), block):
        left = home[i : i + block, None]
        for j in range(0, len(other), block):
            a, b = np.nonzero(np.bitwise_count(left ^ other[None, j : j + block]) <= radius)
            if len(a):
                yield a + i, b + j


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) for all pairs of the distinct fingerprints in ``nodes`` (node, fp) within ``radius`` bits."""
    if not 0 <= radius <= 5:
        raise ValueError("radius must be from 0 to 5")
    placed = nodes.select("node", "fp", _cell(F.col("fp"), radius).alias("cell"))
    # At most 17^4 cells: this side has a bound of its own, whatever the data.
    tiles = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    tiled = placed.join(tiles, "cell").select("node", "fp", "cell", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    home = tiled.select("cell", "tile", F.lit(0).alias("side"), "node", "fp")
    within = tiled.where("tile + 1 < tiles").select("cell", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "node", "fp")
    ahead = placed.select(F.explode(F.transform(F.array(*map(F.lit, _forward(radius))), lambda step: F.col("cell") + step)).alias("cell"), "node", "fp")
    visits = ahead.join(tiles, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "node", "fp")
    rows = home.union(within).union(visits).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "side")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The home rows of a tile come first and are held; visitors pass by in batches."""
        held: tuple | None = None
        nodes_held, fps_held = [], []

        def joined():
            if len(nodes_held) > 1:
                nodes_held[:], fps_held[:] = [np.concatenate(nodes_held)], [np.concatenate(fps_held)]
            return (nodes_held[0], fps_held[0]) if nodes_held else (np.empty(0, np.int64), np.empty(0, np.uint64))

        def emit(left, right):
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], schema=schema)

        for batch in batches:
            cell, part, side, node, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.astype(np.int64).view(np.uint64)
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *change], [*change, len(cell)]):
                if start == end:
                    continue
                if held != (cell[start], part[start]):
                    held = (cell[start], part[start])
                    nodes_held, fps_held = [], []
                n, f = node[start:end], fp[start:end]
                mine, seen = joined()
                for i, j in near(seen, f, radius):
                    yield emit(mine[i], n[j])
                if side[start] == 0:
                    for i, j in near(f, f, radius):
                        later = i < j
                        if later.any():
                            yield emit(n[i[later]], n[j[later]])
                    nodes_held.append(n)
                    fps_held.append(f)

    common.visible(nodes.sparkSession)
    return rows.mapInArrow(compare, "a long, b long")


def group(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = common.cut(fingerprints(docs, width))
    nodes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node IS NOT NULL"), radius))
    named = nodes.join(found, "node", "left").select(F.col("fp").alias("node_fp"), F.coalesce("component_id", "node").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("node_fp"), "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group(common.table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each group, all its columns; rows without an id stay."""
    dropped = common.cut(group(docs, width, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct())
    stay = docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
    row = Window.partitionBy("doc_id").orderBy("doc_id")
    boxed = stay.select("doc_id", F.struct(*stay.columns).alias("doc")).withColumn("copy", F.row_number().over(row))
    return boxed.where("copy = 1 OR doc_id IS NULL").select("doc.*")
