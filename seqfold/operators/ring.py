"""Consistent-hash ring as data: tokens, successors, placement, routing and remapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seqfold.functions import u64
from seqfold.sources.durable import visible

VIRTUAL_NODES = 128


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that break a rule, with the reason: ids and hosts that are empty, untrimmed or hold what they mustn't,
    repeated ids, repeated endpoints (host without case, port)."""
    rated = nodes.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).withColumn("_e", F.count("*").over(Window.partitionBy(F.lower("host"), "port")))
    name, host = F.coalesce("id", F.lit("")), F.coalesce("host", F.lit(""))
    reason = F.when(name == "", "empty id").when(name.rlike(r"^\s|\s$"), "untrimmed id").when(name.rlike(r"[\x00-\x1F\x7F]"), "control in id")
    reason = reason.when(host == "", "empty host").when(host.rlike(r"[\s\x00-\x1F\x7F]"), "space or control in host").when(F.col("_n") > 1, "repeated id").when(F.col("_e") > 1, "repeated endpoint").when(~F.col("port").between(1, 65535), "port")
    return rated.withColumn("reason", reason).where("reason IS NOT NULL").drop("_n", "_e")


def tokens(nodes: DataFrame, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(node_id, v, token): ``virtual_nodes`` hashes of each node's id and number."""
    each = nodes.select(F.col("id").alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("v"))
    return each.withColumn("token", u64.ring_hash(F.concat("node_id", F.lit("#"), F.col("v").cast("string"))))


def counts(nodes: DataFrame, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(node_count, virtual_nodes, tokens) of a ring."""
    return nodes.agg(F.count("*").alias("node_count")).select("node_count", F.lit(virtual_nodes).alias("virtual_nodes"), (F.col("node_count") * virtual_nodes).alias("tokens"))


def hashes(keys: pa.Array) -> np.ndarray:
    """The ring hash of every key of a batch, letter by letter over all keys that are long enough."""
    keys = keys.cast(pa.large_binary())
    offsets = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    size, start = np.diff(offsets), offsets[:-1]
    order = np.argsort(-size, kind="stable")
    longer = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), side="left")  # keys with a letter at each place
    h, start = np.full(len(keys), u64.OFFSET, np.uint64), start[order]
    for at, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + at]) * np.uint64(1099511628211)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(u64.MIX)
    out = np.empty_like(h)
    out[order] = h ^ (h >> np.uint64(32))
    return out


def placement(keys: DataFrame, ring: DataFrame, factor: int, key: Column) -> DataFrame:
    """The first ``factor`` distinct nodes clockwise of each key, in order (``replica`` from 0).

    The tokens (nodes times virtual nodes, whatever the number of keys) are sorted once, and the walk from each of them
    is taken in advance; a key is then one binary search, in Arrow batches and without a shuffle. No key: no rows. A
    null key has no place. More replicas than nodes is an error.
    """
    found = ring.select("node_id", "token").collect()
    if factor < 1 or len({r.node_id for r in found}) < factor:
        raise ValueError("more replicas than nodes" if factor > 0 else "a factor of one or more is needed")
    ordered = sorted((r.token % (1 << 64), r.node_id) for r in found)
    tokens_, nodes = np.array([t for t, _ in ordered], np.uint64), [n for _, n in ordered]
    walks = []
    for at in range(len(nodes)):
        walk: list[str] = []
        while len(walk) < factor:
            if nodes[at % len(nodes)] not in walk:
                walk.append(nodes[at % len(nodes)])
            at += 1
        walks += walk
    steps = pa.array(walks, pa.string())
    schema = StructType.fromJson(keys.schema.jsonValue()).add("replica", "integer").add("node_id", "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.searchsorted(tokens_, hashes(batch.column(batch.num_columns - 1)), side="left") % len(tokens_)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), factor))
                replica = np.tile(np.arange(factor, dtype=np.int32), batch.num_rows)
                columns = [c.take(rows) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(replica), steps.take(pa.array(np.repeat(at, factor) * factor + replica))], schema=arrow)

    visible(keys.sparkSession)
    return keys.withColumn("_key", key.cast("binary")).where("_key IS NOT NULL").mapInArrow(run, schema)


def primary(keys: DataFrame, ring: DataFrame, key: Column) -> DataFrame:
    return placement(keys, ring, 1, key).drop("replica")


def route(placed: DataFrame, reachable: DataFrame) -> DataFrame:
    """Primaries with ``status``: there is no failover, an unreachable primary is unavailable."""
    side = F.broadcast(reachable.select(F.col("id").alias("_id")).distinct())
    return placed.join(side, F.col("node_id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNull(), "unavailable").otherwise("ok")).drop("_id")


def remap_fraction(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(keys, moved, fraction); no keys: 0."""
    joined = before.select(key, F.col("node_id").alias("a")).join(after.select(key, F.col("node_id").alias("b")), key)
    counts = joined.agg(F.count("*").alias("keys"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
    return counts.withColumn("fraction", F.when(F.col("keys") == 0, 0.0).otherwise(F.col("moved") / F.col("keys")))
