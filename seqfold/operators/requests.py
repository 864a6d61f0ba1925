"""Predicates and rendering of requests and responses (opcodes 1-8: PUT GET DELETE EXISTS PUTEX TTL PING STATS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqfold.functions import u64

PUT, GET, DELETE, EXISTS, PUTEX, TTL, PING, STATS = range(1, 9)
OK, NOT_FOUND, INVALID, INTERNAL_ERROR, STORAGE_ERROR, OVERLOADED, NO_EXPIRY = range(7)
MAX_TTL_MS = (1 << 63) - 1


def request_valid(opcode: Column, key_size: Column, value_size: Column, ttl_ms: Column) -> Column:
    """What a request must and must not carry; ``ttl_ms`` are the first eight bytes of a PUTEX value (null if fewer).

    Sizes themselves are bounded by the frame format.
    """
    keyed = key_size > 0
    return (
        F.when(opcode == PUT, keyed)
        .when(opcode == PUTEX, keyed & (value_size >= 8) & F.coalesce(ttl_ms > 0, F.lit(False)))
        .when(opcode.isin(GET, DELETE, EXISTS, TTL), keyed & (value_size == 0))
        .when(opcode.isin(PING, STATS), (key_size == 0) & (value_size == 0))
        .otherwise(False)
    )


def response_valid(opcode: Column, status: Column, value: Column) -> Column:
    """Opcode, status and payload (binary) of a response that fit together; responses carry no key."""
    size = F.octet_length(value)
    ok = (
        F.when(opcode.isin(PUT, DELETE, PUTEX), size == 0)
        .when(opcode.isin(GET, STATS), F.lit(True))
        .when(opcode == EXISTS, F.hex(value).isin("00", "01"))
        .when(opcode == TTL, (size == 8) & (F.hex(value) != "0" * 16))
        .when(opcode == PING, F.hex(value) == "504F4E47")
        .otherwise(False)
    )
    return (
        F.when(status.isin(INVALID, INTERNAL_ERROR, STORAGE_ERROR, OVERLOADED), F.lit(True))
        .when(status == NOT_FOUND, opcode.isin(GET, DELETE, TTL) & (size == 0))
        .when(status == NO_EXPIRY, (opcode == TTL) & (size == 0))
        .when(status == OK, ok)
        .otherwise(False)
    )


def status_of(valid: Column, found: Column, opcode: Column, persistent: Column | None = None, failure: Column | None = None) -> Column:
    """The status a request gets. ``failure`` is null, ``storage`` or another word for what went wrong inside."""
    none = F.lit(None).cast("string")
    failed, lasting = (none if failure is None else failure), (F.lit(False) if persistent is None else persistent)
    return (
        F.when(~valid | ~opcode.between(1, 8), "INVALID_REQUEST").when(failed == "storage", "STORAGE_ERROR").when(failed.isNotNull(), "INTERNAL_ERROR")
        .when(opcode.isin(GET, DELETE, TTL) & ~found, "NOT_FOUND").when((opcode == TTL) & lasting, "NO_EXPIRY").otherwise("OK")
    )


def putex_payload(ttl_ms: Column, value: Column) -> Column:
    """Eight bytes of time to live, then the value; null for what may not be sent."""
    return F.when((ttl_ms > 0) & (F.octet_length(value) <= (16 << 20) - 8), F.concat(u64.to_big_endian(ttl_ms), value.cast("binary")))


def split_putex(payload: Column) -> Column:
    """(ttl_ms, value) of a payload as a struct; null if it is too short or its time isn't from 1 to 2^63 - 1."""
    ttl = u64.big_endian(F.substring(payload, 1, 8))
    return F.when((F.octet_length(payload) >= 8) & (ttl > 0), F.struct(ttl.alias("ttl_ms"), F.expr("''").cast("binary").alias("value")).withField("value", payload.substr(F.lit(9), F.octet_length(payload))))


def ttl_payload(remaining_ms: Column) -> Column:
    return F.when(remaining_ms > 0, u64.to_big_endian(remaining_ms))


def answer(requests: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """``requests`` (opcode, key, ...) that read (GET EXISTS TTL PING) with ``status`` and ``value`` (binary).

    ``state`` is a snapshot (key, value, expires_at_ms) at the clock given.
    """
    side = state.select(F.col("key").alias("_k"), F.col("value").cast("binary").alias("_v"), F.col("expires_at_ms").alias("_e"))
    joined = requests.join(side, requests["key"] == side["_k"], "left")
    op, found = F.col("opcode"), F.col("_k").isNotNull()
    status = status_of(F.lit(True), found, op, F.coalesce(F.col("_e") == 0, F.lit(False)))
    value = (
        F.when(op == PING, F.lit("PONG").cast("binary")).when(op == EXISTS, F.when(found, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))))
        .when((op == GET) & found, F.col("_v")).when((op == TTL) & (F.col("_e") > 0), ttl_payload(F.col("_e") - now_ms)).otherwise(F.lit("").cast("binary"))
    )
    return joined.select(*requests.columns, status.alias("status"), value.alias("value"))


def render(opcode: Column, status: Column, value: Column) -> tuple[Column, Column]:
    """(line, exit code) that a command prints and ends with."""
    line = (
        F.when(status == "NOT_FOUND", "NOT_FOUND").when((status == "NO_EXPIRY") & (opcode == TTL), "PERSISTENT")
        .when(status != "OK", F.concat(F.lit("ERROR "), value.cast("string"))).when(opcode.isin(GET, PING, STATS), value.cast("string"))
        .when(opcode == EXISTS, F.when(F.hex(F.substring(value, 1, 1)) == "01", "true").otherwise("false"))
        .when(opcode == TTL, u64.big_endian(value).cast("string")).otherwise("OK")
    )
    code = F.when(status == "NOT_FOUND", 3).when((status == "NO_EXPIRY") & (opcode == TTL), 0).when(status != "OK", 1).otherwise(0)
    return line, code


def pipeline_errors(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(batch_id, request_id, error): what is wrong with batches of requests and the responses to them.

    Ids must be unique within a batch; each request is answered once, by its own id and opcode.
    """
    ids = requests.groupBy("batch_id", "request_id").agg(F.count("*").alias("n"), F.min("opcode").alias("opcode"))
    back = responses.groupBy("batch_id", "request_id").agg(F.count("*").alias("m"), F.min("opcode").alias("answered"), F.max("opcode").alias("_top"))
    joined = ids.join(back, ["batch_id", "request_id"], "full")
    error = (
        F.when(F.col("n") > 1, "repeated request id").when(F.col("n").isNull(), "unexpected response").when(F.col("m").isNull(), "no response")
        .when(F.col("m") > 1, "repeated response").when((F.col("opcode") != F.col("answered")) | (F.col("answered") != F.col("_top")), "opcode differs")
    )
    return joined.withColumn("error", error).where("error IS NOT NULL").select("batch_id", "request_id", "error")


OPERATIONS = {2: "get", 1: "put", 3: "delete", 4: "exists", 5: "putex", 6: "ttl", 7: "ping", 8: "stats"}
GAUGES = ("rejected_connections", "active_connections", "queue_depth", "bytes_appended", "segments", "compactions", "last_compaction_ns", "index_entries")


def stats(requests: DataFrame, gauges: DataFrame) -> DataFrame:
    """The statistics document: counters per opcode of (opcode, valid, failed), then the one row of ``gauges``.

    An invalid request counts as an error alone; one that failed inside as an operation and an error.
    """
    ran = F.col("valid")
    counts = requests.agg(*(F.count_if(ran & (F.col("opcode") == k)).alias(v) for k, v in OPERATIONS.items()), F.count_if(~ran | F.col("failed")).alias("errors"))
    row = counts.join(F.broadcast(gauges.select(*GAUGES)))  # one row each
    return row.select(F.to_json(F.struct(*OPERATIONS.values(), "errors", *GAUGES)).alias("stats"))
