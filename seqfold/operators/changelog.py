"""Point operations and folds of a change log.

A change log has (seq, op, key, value, expires_at_ms): op 1 puts, op 2 deletes, expiry 0 never. The clock is always
given. The last record of a key is found first and its liveness judged after, so an expired put hides older values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqfold.sources.durable import cut

PUT, DELETE = 1, 2
MAX_KEY, MAX_VALUE = 65_536, 16 << 20
#: Inactive segments from which a log is compacted.
ON_DEMAND, IN_BACKGROUND = 2, 4


def live(now_ms, op: str = "op", expires: str = "expires_at_ms") -> Column:
    """Put and not expired; a deadline equal to the clock has passed."""
    return (F.col(op) == PUT) & ((F.col(expires) == 0) | (F.col(expires) > F.lit(now_ms)))


def key_valid(key: Column) -> Column:
    return F.coalesce(F.octet_length(key).between(1, MAX_KEY), F.lit(False))


def last_records(log: DataFrame) -> DataFrame:
    """The last record of each key, tombstones included."""
    rest = [c for c in log.columns if c != "key"]
    return log.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("key", "r.*")


def snapshot(log: DataFrame, now_ms: int) -> DataFrame:
    return last_records(log).where(live(now_ms)).drop("op")


def assign_sequence(mutations: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """``seq`` = base + place in ``order``: sorted by range, numbered within each range, shifted by the ranges before.

    The sorted rows are written once, so that counts and rows are those of one run; the table of offsets has a row per
    partition. Rows that tie in ``order`` are numbered in any order.
    """
    ranged = cut(mutations.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("seq", F.lit(base) + F.col("_offset") + F.col("_at") + 1).drop("_part", "_at", "_offset")


def put_ex(mutations: DataFrame, now_ms: str = "now_ms", ttl_ms: str = "ttl_ms") -> DataFrame:
    """Deadline of puts with a time to live; a sum beyond 2^63 - 1 or no positive ttl gives a null deadline."""
    return mutations.withColumn("expires_at_ms", F.when(F.col(ttl_ms) > 0, F.try_add(F.col(now_ms), F.col(ttl_ms))))


def admit(mutations: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """Mutations (op, key, value, ttl_ms, now_ms) with ``error`` or else ``seq`` and ``expires_at_ms``.

    Rejected: keys and values out of bounds, times to live that are given but not positive or whose deadline passes
    2^63 - 1. What is rejected takes no sequence.
    """
    error = (
        F.when(~key_valid(F.col("key")), "invalid_key").when(F.octet_length("value") > MAX_VALUE, "invalid_value")
        .when((F.col("op") == PUT) & (F.col("ttl_ms") <= 0), "invalid_ttl").when((F.col("op") == PUT) & F.col("ttl_ms").isNotNull() & F.try_add("now_ms", "ttl_ms").isNull(), "ttl_overflow")
    )
    judged = mutations.withColumn("error", error)
    deadline = F.when((F.col("op") == PUT) & F.col("ttl_ms").isNotNull(), F.try_add("now_ms", "ttl_ms")).otherwise(0).cast("long")
    taken = assign_sequence(judged.where("error IS NULL"), order, base).withColumn("expires_at_ms", deadline)
    refused = judged.where("error IS NOT NULL").withColumns({"seq": F.lit(None).cast("long"), "expires_at_ms": F.lit(None).cast("long")})
    return taken.unionByName(refused)


def get_batch(requests: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Each request with the value of its key, null if none."""
    side = state.select(F.col(key).alias("_k"), "value")
    return requests.join(side, requests[key] == side["_k"], "left").drop("_k")


def exists_batch(requests: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    side = state.select(F.col(key).alias("_k"))
    return requests.join(side, requests[key] == side["_k"], "left").withColumn("found", F.col("_k").isNotNull()).drop("_k")


def ttl_batch(requests: DataFrame, state: DataFrame, now_ms: int, key: str = "key") -> DataFrame:
    """status not_found, persistent or expiring, and what remains in milliseconds."""
    side = state.select(F.col(key).alias("_k"), F.col("expires_at_ms").alias("_e"))
    status = F.when(F.col("_k").isNull(), "not_found").when(F.col("_e") == 0, "persistent").otherwise("expiring")
    joined = requests.join(side, requests[key] == side["_k"], "left")
    return joined.withColumn("status", status).withColumn("remaining_ms", F.when(F.col("_e") > 0, F.col("_e") - now_ms)).drop("_k", "_e")


def deletes(log: DataFrame, clock: str = "ts_ms") -> DataFrame:
    """(seq, key, existed): whether each delete met a live value at its own time."""
    w = Window.partitionBy("key").orderBy("seq")
    before = log.withColumn("_op", F.lag("op").over(w)).withColumn("_e", F.lag("expires_at_ms").over(w))
    met = (F.col("_op") == PUT) & ((F.col("_e") == 0) | (F.col("_e") > F.col(clock)))
    return before.where(F.col("op") == DELETE).select("seq", "key", F.coalesce(met, F.lit(False)).alias("existed"))


def replay(requests: DataFrame, clock: str = "ts_ms") -> DataFrame:
    """Answer the reads of one ordered log of mutations and reads, each as of its place.

    ``kind`` is put, delete or get. Gives (seq, key, found, value).
    """
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("kind") != "get", F.struct("kind", "value", "expires_at_ms"))
    seen = requests.withColumn("_last", F.last(change, ignorenulls=True).over(w)).where(F.col("kind") == "get")
    found = (F.col("_last.kind") == "put") & ((F.col("_last.expires_at_ms") == 0) | (F.col("_last.expires_at_ms") > F.col(clock)))
    found = F.coalesce(found, F.lit(False))
    return seen.select("seq", "key", found.alias("found"), F.when(found, F.col("_last.value")).alias("value"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index entries (key, seq, value), those of ``new`` in the place of equal keys in ``old``."""
    a, b = old.select("key", F.struct("seq", "value").alias("a")), new.select("key", F.struct("seq", "value").alias("b"))
    return a.join(b, "key", "full").select("key", F.coalesce("b", "a").alias("r")).select("key", "r.*")


def erase(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select("key"), "key", "left_anti")


def erase_if_sequence(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Without the entries whose key and sequence are both expected."""
    return index.join(expected.select("key", "seq"), ["key", "seq"], "left_anti")


def replace_if_sequence(index: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` has (key, seq, new_seq, new_value); entries whose sequence differs stay."""
    joined = index.join(expected, ["key", "seq"], "left")
    return joined.select("key", F.coalesce("new_seq", "seq").alias("seq"), F.when(F.col("new_seq").isNull(), F.col("value")).otherwise(F.col("new_value")).alias("value"))


def expiry_schedule(state: DataFrame, k: int) -> DataFrame:
    """The next ``k`` deadlines."""
    return state.where("expires_at_ms > 0").orderBy("expires_at_ms", "seq").limit(k)


def encoded_size(key: Column, value: Column, header: int = 44) -> Column:
    return (F.lit(header) + F.octet_length(key) + F.octet_length(value)).cast("long")


def rotate(log: DataFrame, max_bytes: int, first_segment: int = 1, used: int = 0) -> DataFrame:
    """``segment_id`` of each record: a new segment where the record would take a non-empty one over ``max_bytes``.

    The first segment already holds ``used`` bytes. A fold over the whole order, so one task reads (seq, size) pairs in order; nothing else passes through it.
    """

    def fold(batches):
        segment, size = first_segment, used
        for pdf in batches:
            # One step per segment, to the last record that still fits.
            ends = np.cumsum(pdf["size"].to_numpy())
            ids, at, done = np.empty(len(ends), np.int64), 0, 0
            while at < len(ends):
                stop = int(np.searchsorted(ends, max_bytes - size + done, side="right"))
                if stop <= at and size:
                    segment, size = segment + 1, 0
                    continue
                stop = max(stop, at + 1)
                ids[at:stop] = segment
                size, done, at = size + ends[stop - 1] - done, ends[stop - 1], stop
            yield pdf.assign(segment_id=ids)

    # Spark's own size column is dropped before the join back.
    order = log.select("seq", "size").repartitionByRange(1, "seq").sortWithinPartitions("seq")
    return log.join(order.mapInPandas(fold, "seq long, size long, segment_id long").drop("size"), "seq")


def compact(rotated: DataFrame, now_ms: int) -> DataFrame:
    """Records after compaction: of inactive segments only those that are still current and live, all of the active."""
    active = rotated.agg(F.max("segment_id").alias("active"))
    current = last_records(rotated.select("key", "seq", "op", "expires_at_ms")).where(live(now_ms)).select("seq")
    marked = rotated.join(F.broadcast(active))
    kept = marked.where("segment_id < active").join(current, "seq", "left_semi").withColumn("segment_id", F.lit(1).cast("long"))
    return kept.unionByName(marked.where("segment_id = active")).drop("active")


def compaction_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """input_segments (inactive), bytes before and after, bytes written, and whether there are enough of them to
    compact on demand (2) and in the background (4)."""
    top = before.agg(F.max("segment_id").alias("active"), F.sum("size").alias("bytes_before"), (F.count_distinct("segment_id") - 1).alias("input_segments"))
    rest = after.agg(F.sum("size").alias("bytes_after"), F.max("segment_id").alias("last"), F.min("segment_id").alias("first"))
    written = after.join(F.broadcast(before.agg(F.max("segment_id").alias("active")))).where("segment_id < active").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_written"))
    due = [(F.col("input_segments") >= ON_DEMAND).alias("on_demand"), (F.col("input_segments") >= IN_BACKGROUND).alias("in_background")]
    return top.join(F.broadcast(rest)).join(F.broadcast(written)).select("input_segments", "bytes_before", "bytes_after", "bytes_written", *due)
