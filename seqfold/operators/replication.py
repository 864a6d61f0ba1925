"""Replication state per stream (primary, key): applied, duplicate and gap, watermarks, snapshots, lag, recovery.

A message is applied if it is the next of its stream, a duplicate if not newer, a gap otherwise (no change). That is a
fold over each stream in order of arrival, done as one aggregate over the stream's sorted messages; streams are
independent, so the work spreads by stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _fold(items: Column) -> Column:
    start = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("last", "applied", "duplicates", "gaps")))

    def step(s: Column, x: Column) -> Column:
        seq = x["seq"]
        dup, nxt = seq <= s["last"], seq == s["last"] + 1
        one = lambda c: F.when(c, 1).otherwise(0).cast("long")
        return F.struct(
            F.when(nxt, seq).otherwise(s["last"]).alias("last"), (s["applied"] + one(nxt)).alias("applied"),
            (s["duplicates"] + one(dup)).alias("duplicates"), (s["gaps"] + one(~dup & ~nxt)).alias("gaps"),
        )

    return F.aggregate(items, start, step)


def classify(messages: DataFrame, stream: list[str], arrival: list[str]) -> DataFrame:
    """(stream, last, applied, duplicates, gaps) of messages with a ``seq``."""
    items = F.array_sort(F.collect_list(F.struct(*arrival, F.col("seq").cast("long").alias("seq"))))
    return messages.groupBy(*stream).agg(_fold(items).alias("r")).select(*stream, "r.*")


def own(messages: DataFrame, now_ms: int, arrival: list[str]) -> DataFrame:
    """Outcome counts per key with ownership: a live key of another primary refuses a message, an expired one yields.

    The fold is by key; it holds the owner, the deadline of its value, and each primary's watermark in a map.
    """
    items = F.array_sort(F.collect_list(F.struct(*arrival, "primary_id", F.col("seq").cast("long").alias("seq"), "op", "expires_at_ms")))
    start = F.struct(
        F.lit(None).cast("string").alias("owner"), F.lit(0).cast("long").alias("expires"), F.create_map().cast("map<string,bigint>").alias("marks"),
        *(F.lit(0).cast("long").alias(c) for c in ("applied", "duplicates", "gaps", "conflicts")),
    )

    def step(s: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(s["marks"], x["primary_id"]), F.lit(0).cast("long"))
        dead = (s["expires"] != 0) & (s["expires"] <= now_ms)
        owner = F.when(dead, F.lit(None)).otherwise(s["owner"])
        dup, gap = x["seq"] <= last, x["seq"] > last + 1
        clash = ~dup & ~gap & owner.isNotNull() & (owner != x["primary_id"])
        take = ~dup & ~gap & ~clash
        alive = take & (x["op"] == 1) & ((x["expires_at_ms"] == 0) | (x["expires_at_ms"] > now_ms))
        one = lambda c: F.when(c, 1).otherwise(0).cast("long")
        marks = F.map_concat(F.map_filter(s["marks"], lambda k, v: k != x["primary_id"]), F.create_map(x["primary_id"], x["seq"]))
        return F.struct(
            F.when(alive, x["primary_id"]).when(take, F.lit(None)).otherwise(owner).alias("owner"),
            F.when(alive, x["expires_at_ms"]).when(take, F.lit(0)).otherwise(F.when(dead, F.lit(0)).otherwise(s["expires"])).cast("long").alias("expires"),
            F.when(take, marks).otherwise(s["marks"]).alias("marks"), (s["applied"] + one(take)).alias("applied"),
            (s["duplicates"] + one(dup)).alias("duplicates"), (s["gaps"] + one(gap)).alias("gaps"), (s["conflicts"] + one(clash)).alias("conflicts"),
        )

    return messages.groupBy("key").agg(F.aggregate(items, start, step).alias("r")).select("key", "r.owner", "r.applied", "r.duplicates", "r.gaps", "r.conflicts")


def snapshot(watermarks: DataFrame, applied: DataFrame, stream: list[str], now_ms: int) -> DataFrame:
    """A message per stream with a watermark: its value if that is current and live, else a delete at the watermark.

    ``applied`` has the stream's records (op, seq, value, expires_at_ms) of the sequence that the watermark names.
    """
    marks = watermarks.where("last > 0").select(*stream, F.col("last").alias("seq"))
    joined = marks.join(applied, [*stream, "seq"], "left")
    put = (F.col("op") == 1) & ((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms))
    put = F.coalesce(put, F.lit(False))
    return joined.select(
        *stream, "seq", F.when(put, 1).otherwise(2).alias("op"), F.when(put, F.col("value")).otherwise("").alias("value"),
        F.when(put, F.col("expires_at_ms")).otherwise(0).cast("long").alias("expires_at_ms"),
    )


def snapshot_errors(messages: DataFrame) -> DataFrame:
    """What forbids installing a snapshot: a stream twice, or a key put twice."""
    streams = messages.groupBy("primary_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated stream").alias("error"))
    keys = messages.where("op = 1").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated key").alias("error"))
    return streams.union(keys)


def get(values: DataFrame, now_ms: int) -> DataFrame:
    """(key, value) a replica answers with: what has expired isn't there."""
    return values.where((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms)).select("key", "value")


def get_from(values: DataFrame, nodes: DataFrame, node_id: str, now_ms: int) -> DataFrame:
    """(key, value) on one node, from (node_id, key, value, expires_at_ms). A node that is unknown or down is an error."""
    state = nodes.where(F.col("id") == node_id).select("available").first()
    if state is None or not state.available:
        raise ValueError(f"replica is {'unknown' if state is None else 'unavailable'}: {node_id}")
    return get(values.where(F.col("node_id") == node_id), now_ms)


def cluster_errors(nodes: DataFrame, factor: int) -> DataFrame:
    """(id, error): what forbids a cluster of ``nodes``; an id of null is about the cluster itself."""
    long_ids = nodes.where(F.octet_length("id") > 255).select("id", F.lit("id exceeds 255 bytes").alias("error"))
    negative = nodes.where("delay_ms < 0").select("id", F.lit("negative delay").alias("error")) if "delay_ms" in nodes.columns else long_ids.limit(0)
    count = nodes.agg(F.count("*").alias("n")).where((F.col("n") < factor) | F.lit(not 1 <= factor <= 3))
    return long_ids.union(negative).union(count.select(F.lit(None).cast("string"), F.lit("factor must be 1 to 3 and fit the nodes")))


def lag(latest: DataFrame, applied: DataFrame, on: list[str], placed: DataFrame | None = None, node: str = "node_id") -> DataFrame:
    """latest - min(latest, applied) per stream and node.

    With ``placed`` (the stream's columns and ``node``), rows of nodes that don't hold the stream have a null lag and
    an ``error``.
    """
    out = latest.join(applied, on, "left").withColumn("lag", F.col("latest") - F.least("latest", F.coalesce("applied", F.lit(0))))
    if placed is None:
        return out
    holds = placed.select(*on, node).distinct().withColumn("_holds", F.lit(True))
    joined = out.join(holds, list(dict.fromkeys([*on, node])), "left")
    return joined.select(*out.columns[:-1], F.when(F.col("_holds"), F.col("lag")).alias("lag"), F.when(F.col("_holds").isNull(), "not a replica").alias("error"))


def acknowledge(mutations: DataFrame, placed: DataFrame, nodes: DataFrame, timeout_ms: int, mode: str) -> DataFrame:
    """Outcome of each mutation: acknowledged, sequence, acknowledgements, required, unavailable, timed_out, sequence_gaps.

    ``mutations``: (mutation, key), in order of ``mutation``; ``placed``: (mutation, replica, node_id), replica 0 being
    the primary; ``nodes``: (id, available, delay_ms), or as well by ``mutation`` where states change over time.

    A mutation whose primary is down, or slower than the timeout, returns at once: it takes no sequence (0) and counts
    that one failure alone. Others take the next sequence of their stream (primary, key). A node that missed one of the
    stream's sequences finds a gap in every later one.
    """
    if mode not in ("primary", "all") or timeout_ms < 0:
        raise ValueError("acknowledgement mode or timeout")
    on = [c for c in ("mutation",) if c in nodes.columns]
    side = nodes.select(*on, F.col("id").alias("node_id"), "available", "delay_ms")
    joined = mutations.select("mutation", "key").join(placed, "mutation").join(side, [*on, "node_id"])
    down, late = ~F.col("available"), F.col("available") & (F.col("delay_ms") > timeout_ms)
    joined = joined.withColumns({"down": down, "late": late})
    lead = joined.where("replica = 0").select(F.col("mutation").alias("m"), F.col("node_id").alias("primary"), F.col("down").alias("p_down"), F.col("late").alias("p_late"), "key")
    stream = Window.partitionBy("primary", "key").orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = lead.withColumn("accepted", ~(F.col("p_down") | F.col("p_late")))
    lead = lead.withColumn("sequence", F.when(F.col("accepted"), F.sum(F.col("accepted").cast("long")).over(stream)).otherwise(0).cast("long")).drop("key")
    sent = joined.join(lead, F.col("mutation") == F.col("m"))
    before = Window.partitionBy("primary", "key", "node_id").orderBy("mutation").rowsBetween(Window.unboundedPreceding, -1)
    missed = F.col("accepted") & (F.col("down") | F.col("late"))
    sent = sent.withColumn("behind", F.coalesce(F.max(missed.cast("int")).over(before), F.lit(0)) == 1).withColumn("reached", F.col("accepted") & ~F.col("down") & ~F.col("late"))
    count = lambda accepted, rejected: F.when(F.first("accepted"), F.count_if(accepted)).otherwise(F.first(rejected).cast("long"))
    out = sent.groupBy("mutation").agg(
        F.first("sequence").alias("sequence"), F.count_if(F.col("reached") & ~F.col("behind")).alias("acknowledgements"),
        F.count("*").alias("replicas"), count(F.col("down"), F.col("p_down")).alias("unavailable"),
        count(F.col("late"), F.col("p_late")).alias("timed_out"), F.count_if(F.col("reached") & F.col("behind")).alias("sequence_gaps"), F.first("accepted").alias("accepted"),
    )
    required = F.lit(1).cast("long") if mode == "primary" else F.col("replicas")
    return out.withColumn("required", required).select(
        "mutation", (F.col("accepted") & (F.col("acknowledgements") >= F.col("required"))).alias("acknowledged"), "sequence", "acknowledgements", "required",
        "unavailable", "timed_out", "sequence_gaps",
    )


def recover(history: DataFrame, marks: DataFrame, stream: list[str], node: str | None = None, placed: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Replay of retained history from a node's watermarks: (stream, last, replayed, gap).

    With ``placed`` (the stream's columns and node_id) only streams that ``node`` holds are replayed; with ``nodes`` a
    node that is unknown or down is an error.
    """
    if nodes is not None and nodes.where((F.col("id") == node) & F.col("available")).limit(1).count() == 0:
        raise ValueError(f"replica is unavailable: {node}")
    if placed is not None:
        history = history.join(placed.where(F.col("node_id") == node).select(*stream).distinct(), stream, "left_semi")
    todo = history.join(marks, stream, "left").where(F.col("seq") > F.coalesce("last", F.lit(0)))
    out = todo.groupBy(*stream).agg(F.min("seq").alias("first"), F.max("seq").alias("top"), F.count_distinct("seq").alias("replayed"), F.first(F.coalesce("last", F.lit(0))).alias("from"))
    broken = (F.col("first") != F.col("from") + 1) | (F.col("top") - F.col("from") != F.col("replayed"))
    return out.select(*stream, F.when(broken, F.col("from")).otherwise(F.col("top")).alias("last"), "replayed", broken.alias("gap"))
