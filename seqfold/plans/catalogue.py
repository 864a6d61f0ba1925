"""Query catalogue: one entry per operator, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqfold.functions import u64
from seqfold.operators import changelog as kv, evidence, replication, requests, ring
from seqfold.sources import durable, evidence_io, kvlog
from seqfold.streaming import replay as stream

NOW_MS = 1706659200000
MID_MS = 1705276800000
SEGMENT = 4096

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the events table as a change log -----------------------------------------------------------------------------

LOG_SQL = """log AS (
  SELECT event_id + 1 AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
         CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, epoch_us(ts) // 1000 AS ts_ms,
         CASE WHEN event_type = 'signup' THEN epoch_us(ts) // 1000 + 259200000 ELSE 0 END AS expires_at_ms, event_type FROM events)"""


def snap_sql(name: str, now: int = NOW_MS, where: str = "true") -> str:
    return f"""{name} AS (SELECT key, value, seq, expires_at_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE {where})
  WHERE rn = 1 AND op = 1 AND (expires_at_ms = 0 OR expires_at_ms > {now}))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` seen as a change log: errors delete, signups expire after three days."""
    return as_log(table(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    ts_ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")
    error = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).alias("seq"), F.col("user_id").cast("string").alias("key"), F.when(error, 2).otherwise(1).alias("op"),
        F.when(error, "").otherwise(F.col("props")).alias("value"), ts_ms.alias("ts_ms"),
        F.when(F.col("event_type") == "signup", ts_ms + 259200000).otherwise(0).cast("long").alias("expires_at_ms"), "event_type",
    )


def plain(df: DataFrame) -> DataFrame:
    return df.select("key", "value", "seq", "expires_at_ms")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))


LOOKUPS_SQL = "req AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer)"


@query(f"WITH {LOG_SQL}, {snap_sql('s')} SELECT * FROM s")
def snapshot_live(spark, sf_dir):
    return plain(kv.snapshot(log(spark, sf_dir), NOW_MS))


@query(f"WITH {LOG_SQL}, {snap_sql('s')}, {LOOKUPS_SQL} SELECT req.key, s.value FROM req LEFT JOIN s USING (key)")
def get_batch(spark, sf_dir):
    return kv.get_batch(lookups(spark, sf_dir), kv.snapshot(log(spark, sf_dir), NOW_MS))


@query(f"WITH {LOG_SQL}, {snap_sql('s')}, {LOOKUPS_SQL} SELECT req.key, s.key IS NOT NULL AS found FROM req LEFT JOIN s USING (key)")
def exists_batch(spark, sf_dir):
    return kv.exists_batch(lookups(spark, sf_dir), kv.snapshot(log(spark, sf_dir), NOW_MS))


@query(f"""WITH {LOG_SQL}, {snap_sql('s')}, {LOOKUPS_SQL} SELECT req.key,
  CASE WHEN s.key IS NULL THEN 'not_found' WHEN expires_at_ms = 0 THEN 'persistent' ELSE 'expiring' END AS status,
  CASE WHEN expires_at_ms > 0 THEN expires_at_ms - {NOW_MS} END AS remaining_ms FROM req LEFT JOIN s USING (key)""")
def ttl_batch(spark, sf_dir):
    return kv.ttl_batch(lookups(spark, sf_dir), kv.snapshot(log(spark, sf_dir), NOW_MS), NOW_MS)


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'signup' THEN 3600000 + epoch_us(ts) // 1000 ELSE NULL END AS expires_at_ms FROM events")
def put_sequence(spark, sf_dir):
    """Puts numbered in order of arrival after sequence 1000, and the deadlines of those with a time to live."""
    events = table(spark, sf_dir, "events").withColumns({"now_ms": F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"), "ttl_ms": F.when(F.col("event_type") == "signup", 3600000).otherwise(0)})
    return kv.put_ex(kv.assign_sequence(events.select("event_id", "ts", "now_ms", "ttl_ms"), ["ts", "event_id"], 1000)).select("event_id", "seq", "expires_at_ms")


@query(f"""WITH {LOG_SQL}, b AS (SELECT *, lag(op) OVER w AS o, lag(expires_at_ms) OVER w AS e FROM log WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT seq, key, coalesce(o = 1 AND (e = 0 OR e > ts_ms), false) AS existed FROM b WHERE op = 2""")
def delete_existed(spark, sf_dir):
    return kv.deletes(log(spark, sf_dir))


KIND = "CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'put' END"


@query(f"""WITH {LOG_SQL}, k AS (SELECT *, {KIND} AS kind FROM log), p AS (SELECT *, max(CASE WHEN kind <> 'get' THEN seq END)
    OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM k)
SELECT p.seq, p.key, coalesce(k.kind = 'put' AND (k.expires_at_ms = 0 OR k.expires_at_ms > p.ts_ms), false) AS found,
  CASE WHEN k.kind = 'put' AND (k.expires_at_ms = 0 OR k.expires_at_ms > p.ts_ms) THEN k.value END AS value
FROM p LEFT JOIN k ON p.at = k.seq WHERE p.kind = 'get'""".replace(" AS at ", " AS prev ").replace("p.at", "p.prev"))
def request_replay(spark, sf_dir):
    return kv.replay(log(spark, sf_dir).withColumn("kind", F.expr(KIND)))


@query(f"""WITH {LOG_SQL}, {snap_sql('s')} SELECT count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 2) AS deletes, CAST(max(seq) AS BIGINT) AS last_sequence,
  CAST(sum(44 + strlen(key) + strlen(value)) AS BIGINT) AS bytes_appended, count(DISTINCT key) AS keys_seen,
  (SELECT count(*) FROM (SELECT arg_max(op, seq) AS o FROM log GROUP BY key) WHERE o = 1) AS indexed, (SELECT count(*) FROM s) AS live FROM log""")
def stats_counters(spark, sf_dir):
    rows = log(spark, sf_dir)
    last = kv.last_records(rows)
    sizes = last.agg(F.count_if(F.col("op") == 1).alias("indexed"), F.count_if(kv.live(NOW_MS)).alias("live"))
    totals = rows.agg(
        F.count_if(F.col("op") == 1).alias("puts"), F.count_if(F.col("op") == 2).alias("deletes"), F.max("seq").alias("last_sequence"),
        F.sum(kv.encoded_size(F.col("key"), F.col("value"))).alias("bytes_appended"), F.count_distinct("key").alias("keys_seen"),
    )
    return totals.join(F.broadcast(sizes))


OPCODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 5 ELSE 6 END"


OP_COUNTS = " || ".join(f"""'{',' if i else ''}"{name}":' || count(*) FILTER (valid AND o = {k})""" for i, (k, name) in enumerate(requests.OPERATIONS.items()))


@query(f"""WITH {LOG_SQL}, r AS (SELECT {OPCODE} AS o, event_id % 10 > 0 AS valid, event_id % 100 = 7 AS failed FROM events)
SELECT '{{' || {OP_COUNTS} || ',"errors":' || count(*) FILTER (NOT valid OR failed) || ',"rejected_connections":0,"active_connections":0,"queue_depth":0,"bytes_appended":' ||
  (SELECT sum(44 + strlen(key) + strlen(value)) FROM log) || ',"segments":1,"compactions":0,"last_compaction_ns":0,"index_entries":' ||
  (SELECT count(*) FROM (SELECT arg_max(op, seq) AS l FROM log GROUP BY key) WHERE l = 1) || '}}' AS stats FROM r""")
def stats_document(spark, sf_dir):
    """Every tenth request is invalid, every hundredth fails inside; the gauges are those of the log."""
    rows = log(spark, sf_dir)
    size = rows.agg(F.sum(kv.encoded_size(F.col("key"), F.col("value"))).alias("bytes_appended"))
    entries = kv.last_records(rows).agg(F.count_if(F.col("op") == 1).alias("index_entries"))
    zero = {n: F.lit(0) for n in requests.GAUGES if n not in ("bytes_appended", "index_entries", "segments")}
    gauges = size.join(F.broadcast(entries)).withColumns(zero | {"segments": F.lit(1)})  # one row each
    e = F.col("event_id")
    return requests.stats(table(spark, sf_dir, "events").select(F.expr(OPCODE).alias("opcode"), (e % 10 > 0).alias("valid"), (e % 100 == 7).alias("failed")), gauges)


REQUEST = "event_id % 9 AS opcode, user_id % 3 AS key_size, CASE WHEN event_type = 'view' THEN 0 ELSE octet_length({}) END AS value_size, event_id % 4 - 1 AS ttl_ms"


@query(f"""WITH r AS (SELECT event_id, {REQUEST.format('encode(props)')} FROM events),
v AS (SELECT *, CASE WHEN opcode = 1 THEN key_size > 0 WHEN opcode = 5 THEN key_size > 0 AND value_size >= 8 AND ttl_ms > 0
  WHEN opcode IN (2, 3, 4, 6) THEN key_size > 0 AND value_size = 0 WHEN opcode IN (7, 8) THEN key_size = 0 AND value_size = 0 ELSE false END AS valid FROM r)
SELECT event_id, valid, CASE WHEN NOT valid THEN 'INVALID_REQUEST' WHEN event_id % 50 = 1 THEN 'STORAGE_ERROR' WHEN event_id % 50 = 2 THEN 'INTERNAL_ERROR'
  WHEN opcode IN (2, 3, 6) AND event_id % 2 = 0 THEN 'NOT_FOUND' WHEN opcode = 6 AND event_id % 3 = 0 THEN 'NO_EXPIRY' ELSE 'OK' END AS status FROM v""")
def request_status(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("event_id", *REQUEST.format("props").replace(", CASE", "| CASE").replace(", user", "| user").replace(", event_id % 4", "| event_id % 4").split("|"))
    e, valid = F.col("event_id"), requests.request_valid(F.col("opcode"), F.col("key_size"), F.col("value_size"), F.col("ttl_ms"))
    failure = F.when(e % 50 == 1, "storage").when(e % 50 == 2, "internal")
    return r.withColumn("valid", valid).select("event_id", "valid", requests.status_of(F.col("valid"), e % 2 == 1, F.col("opcode"), e % 3 == 0, failure).alias("status"))


@query(f"""WITH {LOG_SQL}, {snap_sql('s')}, r AS (SELECT c_custkey AS request_id, CAST(c_custkey AS VARCHAR) AS key, [2, 4, 6, 7][c_custkey % 4 + 1] AS opcode FROM customer),
a AS (SELECT r.*, s.value, s.expires_at_ms AS e, s.key IS NOT NULL AS found FROM r LEFT JOIN s USING (key))
SELECT request_id, CASE opcode WHEN 7 THEN 'PONG' WHEN 4 THEN CAST(found AS VARCHAR) ELSE CASE WHEN NOT found THEN 'NOT_FOUND' WHEN opcode = 2 THEN value
    WHEN e = 0 THEN 'PERSISTENT' ELSE CAST(e - {NOW_MS} AS VARCHAR) END END AS line, CASE WHEN opcode IN (2, 6) AND NOT found THEN 3 ELSE 0 END AS exit_code FROM a""")
def command_output(spark, sf_dir):
    """Reads (GET EXISTS TTL PING) of customers' keys against the live snapshot, as a command prints them."""
    key = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(key.alias("request_id"), key.cast("string").alias("key"), F.element_at(F.array(*map(F.lit, (2, 4, 6, 7))), (key % 4 + 1).cast("int")).alias("opcode"))
    line, code = requests.render(F.col("opcode"), F.col("status"), F.col("value"))
    return requests.answer(r, kv.snapshot(log(spark, sf_dir), NOW_MS), NOW_MS).select("request_id", line.alias("line"), code.alias("exit_code"))


@query("""SELECT event_id // 50 AS batch_id, event_id % 49 AS request_id, 'repeated request id' AS error FROM events GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT event_id // 50, event_id % 49, 'no response' FROM events WHERE event_id % 50 = 7 UNION ALL SELECT event_id // 50, event_id % 49, 'opcode differs' FROM events WHERE event_id % 50 = 9""")
def pipeline_check(spark, sf_dir):
    """Batches of fifty requests, the last with the id of the first; one isn't answered, one with another opcode."""
    e = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.floor(e / 50).alias("batch_id"), (e % 49).alias("request_id"), F.lit(1).alias("opcode"), e)
    r = r.withColumn("request_id", F.col("event_id") % 49)
    answers = r.where("event_id % 50 <> 7").select("batch_id", "request_id", F.when(F.col("event_id") % 50 == 9, 2).otherwise(1).alias("opcode"))
    return requests.pipeline_errors(r, answers)


@query("""SELECT event_id, CASE WHEN user_id % 3 = 1 THEN false WHEN user_id % 3 = 2 THEN false ELSE true END AS valid FROM events""")
def key_check(spark, sf_dir):
    """Keys that are empty, too long, or as they should be."""
    key = F.when(F.col("user_id") % 3 == 1, "").when(F.col("user_id") % 3 == 2, F.repeat(F.lit("k"), kv.MAX_KEY + 1)).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", kv.key_valid(key).alias("valid"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 20 = 3 THEN 'invalid_key' WHEN event_id % 20 = 4 THEN 'invalid_ttl' WHEN event_id % 20 = 5 THEN 'ttl_overflow' END AS error FROM events)
SELECT event_id, error, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL ORDER BY event_id) END AS seq, CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 1000 + event_id ELSE 0 END END AS expires_at_ms FROM r""")
def admitted(spark, sf_dir):
    """Puts with a key, time to live or deadline that is refused; the others are numbered without gaps."""
    e = F.col("event_id")
    ttl = F.when(e % 20 == 4, 0).when(e % 20 == 5, F.lit((1 << 63) - 1)).when(e % 2 == 0, 1000).cast("long")
    m = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("op"), F.when(e % 20 == 3, "").otherwise("k").alias("key"), F.lit("v").alias("value"), ttl.alias("ttl_ms"), e.alias("now_ms"))
    return kv.admit(m, ["event_id"]).select("event_id", "error", "seq", "expires_at_ms")


@query("SELECT event_id, printf('%016X', event_id + 1) || upper(hex(encode(props))) AS payload, event_id + 1 AS ttl_ms, props AS value, printf('%016X', event_id + 1) AS remaining FROM events")
def putex_payloads(spark, sf_dir):
    """Times to live and values packed into one payload, and taken apart again."""
    ttl = F.col("event_id") + 1
    packed = table(spark, sf_dir, "events").select("event_id", requests.putex_payload(ttl, F.col("props")).alias("p"), F.hex(requests.ttl_payload(ttl)).alias("remaining"))
    return packed.withColumn("x", requests.split_putex(F.col("p"))).select("event_id", F.hex("p").alias("payload"), "x.ttl_ms", F.col("x.value").cast("string").alias("value"), "remaining")


@query("""WITH r AS (SELECT event_id, event_id % 8 + 1 AS opcode, event_id // 8 % 8 AS status, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'PONG' WHEN 'signup' THEN chr(1) WHEN 'error' THEN 'abcdefgh' ELSE props END AS value FROM events)
SELECT event_id, CASE WHEN status IN (2, 3, 4, 5) THEN true WHEN status = 1 THEN opcode IN (2, 3, 6) AND strlen(value) = 0 WHEN status = 6 THEN opcode = 6 AND strlen(value) = 0
  WHEN status = 0 THEN CASE WHEN opcode IN (1, 3, 5) THEN strlen(value) = 0 WHEN opcode IN (2, 8) THEN true WHEN opcode = 4 THEN value IN (chr(0), chr(1))
    WHEN opcode = 6 THEN strlen(value) = 8 WHEN opcode = 7 THEN value = 'PONG' END ELSE false END AS valid FROM r""")
def response_valid(spark, sf_dir):
    kind = F.col("event_type")
    value = F.when(kind == "view", "").when(kind == "click", "PONG").when(kind == "signup", F.char(F.lit(1))).when(kind == "error", "abcdefgh").otherwise(F.col("props"))
    r = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8 + 1).alias("opcode"), F.expr("event_id div 8 % 8").alias("status"), value.cast("binary").alias("value"))
    return r.select("event_id", requests.response_valid(F.col("opcode"), F.col("status"), F.col("value")).alias("valid"))


# --- the index ----------------------------------------------------------------------------------------------------

TWO_SQL = f"{LOG_SQL}, {snap_sql('a', MID_MS, f'ts_ms < {MID_MS}')}, {snap_sql('b')}"


def two(spark, sf_dir):
    rows = log(spark, sf_dir)
    return plain(kv.snapshot(rows.where(F.col("ts_ms") < MID_MS), MID_MS)), plain(kv.snapshot(rows, NOW_MS))


@query(f"WITH {TWO_SQL} SELECT coalesce(b.key, a.key) AS key, coalesce(b.seq, a.seq) AS seq, CASE WHEN b.key IS NULL THEN a.value ELSE b.value END AS value FROM a FULL JOIN b ON a.key = b.key")
def index_upsert(spark, sf_dir):
    return kv.upsert(*two(spark, sf_dir))


@query(f"WITH {TWO_SQL} SELECT key, value, seq, expires_at_ms FROM a WHERE key NOT IN (SELECT key FROM b)")
def index_erase(spark, sf_dir):
    return plain(kv.erase(*two(spark, sf_dir)))


@query(f"WITH {TWO_SQL} SELECT key, value, seq, expires_at_ms FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.key = b.key AND a.seq = b.seq)")
def index_cas_delete(spark, sf_dir):
    return plain(kv.erase_if_sequence(*two(spark, sf_dir)))


@query(f"""WITH {TWO_SQL} SELECT a.key, CASE WHEN b.key IS NOT NULL THEN a.seq + 1000000 ELSE a.seq END AS seq, CASE WHEN b.key IS NOT NULL THEN 'new' ELSE a.value END AS value
FROM a LEFT JOIN b ON a.key = b.key AND a.seq = b.seq""")
def index_cas_replace(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return kv.replace_if_sequence(a.select("key", "seq", "value"), b.select("key", "seq", (F.col("seq") + 1000000).alias("new_seq"), F.lit("new").alias("new_value")))


@query(f"WITH {TWO_SQL} SELECT key, value, seq, expires_at_ms FROM a WHERE key IN (SELECT key FROM b)")
def index_contains(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return a.join(b.select("key"), "key", "left_semi")


@query(f"WITH {LOG_SQL}, {snap_sql('s')} SELECT key, value, seq, expires_at_ms FROM s WHERE expires_at_ms > 0 ORDER BY expires_at_ms, seq LIMIT 20")
def expiry_topk(spark, sf_dir):
    return plain(kv.expiry_schedule(kv.snapshot(log(spark, sf_dir), NOW_MS), 20))


# --- rotation and compaction --------------------------------------------------------------------------------------

ROTATED_SQL = f"""{LOG_SQL}, sized AS (SELECT *, 44 + strlen(key) + strlen(value) AS size FROM log),
fold AS (SELECT list_reduce(list_prepend({{'seg': 1::BIGINT, 'used': 0::BIGINT, 'size': 0::BIGINT, 'segs': []::BIGINT[]}},
    list({{'seg': 0::BIGINT, 'used': 0::BIGINT, 'size': size::BIGINT, 'segs': []::BIGINT[]}} ORDER BY seq)), lambda a, x: {{
      'seg': CASE WHEN a.used > 0 AND a.used + x.size > {SEGMENT} THEN a.seg + 1 ELSE a.seg END,
      'used': CASE WHEN a.used > 0 AND a.used + x.size > {SEGMENT} THEN x.size ELSE a.used + x.size END, 'size': 0::BIGINT,
      'segs': list_append(a.segs, CASE WHEN a.used > 0 AND a.used + x.size > {SEGMENT} THEN a.seg + 1 ELSE a.seg END)}}) AS r FROM sized),
rot AS (SELECT sized.*, segment_id FROM sized JOIN (SELECT unnest(r.segs) AS segment_id, unnest(range(1, len(r.segs) + 1)) AS pos FROM fold) ON seq = pos)"""
COMPACT_SQL = f"""{ROTATED_SQL}, {snap_sql('s')},
done AS (SELECT 1 AS segment_id, rot.seq, rot.key, rot.op, rot.value, rot.size FROM rot JOIN s ON rot.seq = s.seq WHERE segment_id < (SELECT max(segment_id) FROM rot)
  UNION ALL SELECT segment_id, seq, key, op, value, size FROM rot WHERE segment_id = (SELECT max(segment_id) FROM rot))"""


def rotated(spark, sf_dir):
    # Read several times by what follows: the fold runs once.
    return durable.cut(kv.rotate(log(spark, sf_dir).withColumn("size", kv.encoded_size(F.col("key"), F.col("value"))), SEGMENT))


@query(f"WITH {ROTATED_SQL} SELECT segment_id, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq FROM rot GROUP BY segment_id")
def rotate_segments(spark, sf_dir):
    return rotated(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"))


@query(f"WITH {COMPACT_SQL} SELECT CAST(segment_id AS BIGINT) AS segment_id, seq, key, op, value FROM done")
def compact_log(spark, sf_dir):
    return kv.compact(rotated(spark, sf_dir), NOW_MS).select("segment_id", "seq", "key", "op", "value")


@query(f"""WITH {COMPACT_SQL} SELECT (SELECT count(DISTINCT segment_id) - 1 FROM rot) AS input_segments, (SELECT CAST(sum(size) AS BIGINT) FROM rot) AS bytes_before,
  (SELECT CAST(sum(size) AS BIGINT) FROM done) AS bytes_after, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM done WHERE segment_id < (SELECT max(segment_id) FROM rot)) AS bytes_written,
  (SELECT count(DISTINCT segment_id) - 1 FROM rot) >= 2 AS on_demand, (SELECT count(DISTINCT segment_id) - 1 FROM rot) >= 4 AS in_background""")
def compaction_stats(spark, sf_dir):
    before = rotated(spark, sf_dir)
    return kv.compaction_stats(before, kv.compact(before, NOW_MS))


# --- hashes and the ring ------------------------------------------------------------------------------------------

M64 = "18446744073709551616::UHUGEINT"


def fnv_sql(text: str) -> str:
    return f"""list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UHUGEINT)),
  lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % {M64})"""


def ring_sql(text: str) -> str:
    fold = lambda x: f"xor(({x})::UBIGINT, (({x}) // 4294967296::UHUGEINT)::UBIGINT)::UHUGEINT"
    # One element lists bind each step's value once.
    return f"list_transform(list_transform([{fnv_sql(text)}], lambda x: ({fold('x')} * {u64.MIX}::UHUGEINT) % {M64}), lambda y: {fold('y')})[1]"


SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN CAST({0} AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST({0} AS HUGEINT) END AS BIGINT)"


@query(f"SELECT CAST(h % 16::UHUGEINT AS BIGINT) AS shard, count(*) AS keys FROM (SELECT {fnv_sql(chr(39) + 'key-' + chr(39) + ' || o_orderkey')} AS h FROM orders) GROUP BY 1".replace("'key-' || o_orderkey", "t").replace("FROM orders", "FROM (SELECT 'key-' || o_orderkey AS t FROM orders)"))
def shard_histogram(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")).alias("k"))
    return keys.select(u64.modulo(u64.fnv1a64(F.col("k")), 16).alias("shard")).groupBy("shard").agg(F.count("*").alias("keys"))


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lower("r_name").alias("host"), (F.col("r_regionkey") + 7001).alias("port"))


def order_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")).alias("k"))


def customer_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("k"))


RING_SQL = f"ring AS (SELECT node_id, v, {ring_sql('t')} AS token FROM (SELECT r_name AS node_id, v, r_name || '#' || v AS t FROM region, range(128) g(v)))"
ORDERS_SQL = f"k AS (SELECT o_orderkey, {ring_sql('t')} AS h FROM (SELECT o_orderkey, 'key-' || o_orderkey AS t FROM orders))"
CUSTOMERS_SQL = f"k AS (SELECT c_custkey, {ring_sql('t')} AS h FROM (SELECT c_custkey, 'key-' || c_custkey AS t FROM customer))"
SUCCESSOR = "SELECT k.{0}, coalesce(r.node_id, (SELECT arg_min(node_id, token) FROM {1})) AS node_id FROM k ASOF LEFT JOIN {1} r ON k.h <= r.token"


@query(f"WITH {RING_SQL} SELECT node_id, CAST(v AS INT) AS v, {SIGNED.format('token')} AS token FROM ring")
def ring_tokens(spark, sf_dir):
    return ring.tokens(nodes(spark, sf_dir))


@query("SELECT count(*) AS node_count, 128 AS virtual_nodes, count(*) * 128 AS tokens FROM region")
def ring_counts(spark, sf_dir):
    return ring.counts(nodes(spark, sf_dir))


@query(f"WITH {RING_SQL}, {ORDERS_SQL}, p AS ({SUCCESSOR.format('o_orderkey', 'ring')}) SELECT * FROM p")
def ring_primary(spark, sf_dir):
    return ring.primary(order_keys(spark, sf_dir), ring.tokens(nodes(spark, sf_dir)), F.col("k")).drop("k")


PLACED_SQL = f"""WITH {RING_SQL}, {CUSTOMERS_SQL}, n AS (SELECT c_custkey, node_id, min(CASE WHEN token >= h THEN token END) AS nxt, min(token) AS low FROM k, ring GROUP BY ALL),
p AS (SELECT c_custkey, node_id, row_number() OVER (PARTITION BY c_custkey ORDER BY nxt IS NULL, coalesce(nxt, low), node_id) - 1 AS replica FROM n)"""


@query(f"{PLACED_SQL} SELECT c_custkey, node_id, CAST(replica AS INT) AS replica FROM p WHERE replica < 3")
def ring_placement_rf3(spark, sf_dir):
    return ring.placement(customer_keys(spark, sf_dir), ring.tokens(nodes(spark, sf_dir)), 3, F.col("k")).drop("k")


@query(f"{PLACED_SQL} SELECT c_custkey, node_id, CASE WHEN node_id = 'ASIA' THEN 'unavailable' ELSE 'ok' END AS status FROM p WHERE replica = 0")
def ring_route(spark, sf_dir):
    placed = ring.primary(customer_keys(spark, sf_dir), ring.tokens(nodes(spark, sf_dir)), F.col("k")).drop("k")
    return ring.route(placed, nodes(spark, sf_dir).where("id <> 'ASIA'"))


@query(f"""WITH {RING_SQL}, {CUSTOMERS_SQL}, less AS (SELECT * FROM ring WHERE node_id <> 'ASIA'), a AS ({SUCCESSOR.format('c_custkey', 'ring')}), b AS ({SUCCESSOR.format('c_custkey', 'less')})
SELECT count(*) AS keys, count(*) FILTER (a.node_id <> b.node_id) AS moved, avg(CASE WHEN a.node_id <> b.node_id THEN 1.0 ELSE 0.0 END)::DOUBLE AS fraction FROM a JOIN b USING (c_custkey)""")
def ring_remap(spark, sf_dir):
    tokens, keys = ring.tokens(nodes(spark, sf_dir)), customer_keys(spark, sf_dir)
    before, after = ring.primary(keys, tokens, F.col("k")), ring.primary(keys, tokens.where("node_id <> 'ASIA'"), F.col("k"))
    return ring.remap_fraction(before, after, "c_custkey")


@query("SELECT n_name AS id, 'repeated endpoint' AS reason FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) > 1)")
def ring_invalid_nodes(spark, sf_dir):
    """Nations as nodes that share an endpoint per region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("Host").alias("host"), (F.col("n_regionkey") + 1).alias("port"))
    return ring.invalid_nodes(n).select("id", "reason")


CRC_TABLE = "[" + ", ".join(map(str, u64.CASTAGNOLI)) + "]"


@query(f"""SELECT event_id, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT)),
  lambda c, b: xor({CRC_TABLE}[(xor(c, b) & 255) + 1]::BIGINT, c >> 8))) AS BIGINT) AS crc FROM (SELECT event_id, CAST(user_id AS VARCHAR) || props AS t FROM events)""")
def crc32c_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", u64.crc32c(F.concat(F.col("user_id").cast("string"), "props")).alias("crc"))


# --- replication --------------------------------------------------------------------------------------------------

ARRIVAL = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]
FOLD_SQL = """f AS (SELECT l_orderkey AS stream, list_reduce(list_prepend({'seq': 0::BIGINT, 'last': 0::BIGINT, 'applied': 0::BIGINT, 'duplicates': 0::BIGINT, 'gaps': 0::BIGINT},
    list({'seq': l_linenumber::BIGINT, 'last': 0::BIGINT, 'applied': 0::BIGINT, 'duplicates': 0::BIGINT, 'gaps': 0::BIGINT} ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber)),
    lambda s, x: {'seq': 0::BIGINT, 'last': CASE WHEN x.seq = s.last + 1 THEN x.seq ELSE s.last END, 'applied': s.applied + CASE WHEN x.seq = s.last + 1 THEN 1 ELSE 0 END,
      'duplicates': s.duplicates + CASE WHEN x.seq <= s.last THEN 1 ELSE 0 END, 'gaps': s.gaps + CASE WHEN x.seq > s.last + 1 THEN 1 ELSE 0 END}) AS r FROM lineitem GROUP BY l_orderkey)"""


def messages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").cast("long").alias("seq"), *ARRIVAL, "l_quantity")


def watermarks(spark, sf_dir):
    return replication.classify(messages(spark, sf_dir), ["stream"], ARRIVAL)


@query(f"WITH {FOLD_SQL} SELECT stream, r.last, r.applied, r.duplicates, r.gaps FROM f")
def repl_classify(spark, sf_dir):
    return watermarks(spark, sf_dir)


@query(f"WITH {FOLD_SQL} SELECT o_orderkey, coalesce(r.last, 0) AS last_sequence FROM orders LEFT JOIN f ON o_orderkey = stream")
def repl_watermark(spark, sf_dir):
    marks = watermarks(spark, sf_dir)
    return table(spark, sf_dir, "orders").join(marks, F.col("o_orderkey") == F.col("stream"), "left").select("o_orderkey", F.coalesce("last", F.lit(0)).alias("last_sequence"))


@query(f"""WITH {FOLD_SQL}, v AS (SELECT l_orderkey AS stream, l_linenumber AS seq, max(l_suppkey) AS top FROM lineitem GROUP BY ALL)
SELECT f.stream, r.last AS seq, CASE WHEN top % 3 > 0 THEN 1 ELSE 2 END AS op, CASE WHEN top % 3 > 0 THEN CAST(top AS VARCHAR) ELSE '' END AS value, CAST(0 AS BIGINT) AS expires_at_ms
FROM f JOIN v ON f.stream = v.stream AND r.last = v.seq WHERE r.last > 0""")
def repl_snapshot(spark, sf_dir):
    """Streams whose record at the watermark has a supplier divisible by three have expired."""
    applied = messages(spark, sf_dir).groupBy("stream", "seq").agg(F.max("l_suppkey").alias("top"))
    applied = applied.select("stream", "seq", F.lit(1).alias("op"), F.col("top").cast("string").alias("value"), F.when(F.col("top") % 3 == 0, 1).otherwise(0).cast("long").alias("expires_at_ms"))
    return replication.snapshot(watermarks(spark, sf_dir), applied, ["stream"], NOW_MS)


@query(f"WITH {FOLD_SQL}, t AS (SELECT l_orderkey AS stream, CAST(max(l_linenumber) AS BIGINT) AS latest FROM lineitem GROUP BY 1) SELECT stream, latest, r.last AS applied, latest - least(latest, r.last) AS lag FROM t JOIN f USING (stream)")
def repl_lag(spark, sf_dir):
    latest = messages(spark, sf_dir).groupBy("stream").agg(F.max("seq").alias("latest"))
    return replication.lag(latest, watermarks(spark, sf_dir).select("stream", F.col("last").alias("applied")), ["stream"])


@query(f"""WITH {FOLD_SQL}, h AS (SELECT DISTINCT l_orderkey AS stream, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem), m AS (SELECT stream, r.last FROM f),
g AS (SELECT h.stream, min(seq) AS lo, max(seq) AS hi, count(*) AS n, any_value(last) AS base FROM h JOIN m USING (stream) WHERE seq > last GROUP BY h.stream)
SELECT stream, CASE WHEN lo <> base + 1 OR hi - base <> n THEN base ELSE hi END AS last, n AS replayed, (lo <> base + 1 OR hi - base <> n) AS gap FROM g""")
def repl_recover(spark, sf_dir):
    history = messages(spark, sf_dir).select("stream", "seq").distinct()
    return replication.recover(history, watermarks(spark, sf_dir).select("stream", "last"), ["stream"])


# Nodes come and go from one mutation to the next.
DOWN, DELAY = "(o_orderkey + r_regionkey) % 11 = 0", "(o_orderkey * 7 + r_regionkey * 13) % 40"


def acked(mode: str):
    def run(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey AS mutation", "concat('key-', o_custkey) AS key")
        placed = ring.placement(orders.select("mutation", "key"), ring.tokens(nodes(spark, sf_dir)), 3, F.col("key")).drop("key")
        # Five regions: a state per mutation and node.
        status = orders.join(F.broadcast(table(spark, sf_dir, "region"))).selectExpr("mutation", "r_name AS id", f"NOT ({DOWN}) AS available", f"{DELAY} AS delay_ms")
        return replication.acknowledge(orders.select("mutation", "key"), placed, status, 35, mode)

    return run


for _mode in ("primary", "all"):
    _QUERIES[f"repl_ack_{_mode}"] = acked(_mode)
    _SQL[f"repl_ack_{_mode}"] = f"""WITH {RING_SQL}, k AS (SELECT key, {ring_sql('key')} AS h FROM (SELECT DISTINCT 'key-' || o_custkey AS key FROM orders)),
n AS (SELECT key, node_id, min(CASE WHEN token >= h THEN token END) AS nxt, min(token) AS low FROM k, ring GROUP BY ALL),
p AS (SELECT * FROM (SELECT key, node_id, row_number() OVER (PARTITION BY key ORDER BY nxt IS NULL, coalesce(nxt, low), node_id) - 1 AS replica FROM n) WHERE replica < 3),
q AS (SELECT o_orderkey AS m, p.*, {DOWN} AS down, NOT ({DOWN}) AND {DELAY} > 35 AS late FROM orders JOIN p ON p.key = 'key-' || o_custkey JOIN region ON r_name = node_id),
a AS (SELECT m, key, down AS pd, late AS pl FROM q WHERE replica = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m) AS seq FROM a WHERE NOT pd AND NOT pl),
c AS (SELECT q.*, seq, (SELECT min(b2.seq) FROM b b2 JOIN q q2 ON q2.m = b2.m WHERE q2.key = q.key AND q2.node_id = q.node_id AND (q2.down OR q2.late)) AS miss FROM q JOIN b USING (m)),
d AS (SELECT m, count(*) FILTER (NOT down AND NOT late AND (miss IS NULL OR miss > seq)) AS acks, count(*) FILTER (down) AS un, count(*) FILTER (late) AS ti,
  count(*) FILTER (NOT down AND NOT late AND miss < seq) AS gaps, any_value(seq) AS seq FROM c GROUP BY m),
w AS (SELECT {'1' if _mode == 'primary' else '3'} AS need)
SELECT a.m AS mutation, coalesce(acks >= need, false) AS acknowledged, coalesce(seq, 0) AS sequence, coalesce(acks, 0) AS acknowledgements, need AS required,
  coalesce(un, CAST(pd AS BIGINT)) AS unavailable, coalesce(ti, CAST(pl AS BIGINT)) AS timed_out, coalesce(gaps, 0) AS sequence_gaps FROM a LEFT JOIN d ON a.m = d.m, w"""


@query("""WITH z AS (SELECT l_partkey AS key, list({'p': CAST(l_suppkey AS VARCHAR), 'seq': CAST(l_linenumber AS BIGINT), 'put': l_returnflag <> 'R', 'owner': NULL::VARCHAR, 'marks': MAP {}::MAP(VARCHAR, BIGINT), 'c': [0, 0, 0, 0]::BIGINT[]}
    ORDER BY l_shipdate, l_orderkey, l_suppkey, l_linenumber, l_returnflag = 'R') AS xs FROM lineitem GROUP BY l_partkey),
r AS (SELECT key, list_reduce(list_prepend({'p': NULL::VARCHAR, 'seq': 0::BIGINT, 'put': false, 'owner': NULL::VARCHAR, 'marks': MAP {}::MAP(VARCHAR, BIGINT), 'c': [0, 0, 0, 0]::BIGINT[]}, xs), lambda s, x: list_transform(
  [CASE WHEN x.seq <= coalesce(s.marks[x.p], 0) THEN 2 WHEN x.seq > coalesce(s.marks[x.p], 0) + 1 THEN 3 WHEN s.owner IS NOT NULL AND s.owner <> x.p THEN 4 ELSE 1 END], lambda k: {
    'p': NULL::VARCHAR, 'seq': 0::BIGINT, 'put': false, 'owner': CASE WHEN k <> 1 THEN s.owner WHEN x.put THEN x.p END,
    'marks': CASE WHEN k = 1 THEN map_concat(s.marks, MAP {x.p: x.seq}) ELSE s.marks END, 'c': list_transform(s.c, lambda n, i: n + CASE WHEN i = k THEN 1 ELSE 0 END)})[1]) AS s FROM z)
SELECT key, s.owner AS owner, s.c[1] AS applied, s.c[2] AS duplicates, s.c[3] AS gaps, s.c[4] AS conflicts FROM r""")
def repl_ownership(spark, sf_dir):
    """Keys (parts) written by several primaries (suppliers): who owns them and what was refused."""
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_suppkey").cast("string").alias("primary_id"), F.col("l_linenumber").cast("long").alias("seq"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("op"), F.lit(0).cast("long").alias("expires_at_ms"), "l_shipdate", "l_orderkey", "l_suppkey",
    )
    return replication.own(m, NOW_MS, ["l_shipdate", "l_orderkey", "l_suppkey"])


@query("SELECT o_orderkey AS stream, r_name AS node_id, CAST(5 AS BIGINT) AS latest, CASE WHEN r_regionkey <> o_orderkey % 5 THEN 5 - least(5, o_orderkey % 7) END AS lag, CASE WHEN r_regionkey = o_orderkey % 5 THEN 'not a replica' END AS error FROM orders, region")
def repl_lag_placed(spark, sf_dir):
    """Every region is asked about every order; one of them doesn't hold it."""
    o, r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stream")), table(spark, sf_dir, "region")
    asked = o.join(F.broadcast(r)).select("stream", F.col("r_name").alias("node_id"), F.lit(5).cast("long").alias("latest"), "r_regionkey")  # five regions
    placed = asked.where("r_regionkey <> stream % 5").select("stream", "node_id")
    return replication.lag(asked.drop("r_regionkey"), o.select("stream", (F.col("stream") % 7).alias("applied")), ["stream"], placed).select("stream", "node_id", "latest", "lag", "error")


@query(f"WITH {LOG_SQL}, l AS (SELECT key, arg_max(value, seq) AS value, arg_max(op, seq) AS op, arg_max(expires_at_ms, seq) AS e FROM log WHERE seq % 2 = 0 GROUP BY key) SELECT key, value FROM l WHERE op = 1 AND (e = 0 OR e > {NOW_MS})")
def repl_get_from(spark, sf_dir):
    """Two nodes that each hold half of the log; one of them is asked."""
    rows = log(spark, sf_dir).withColumn("node_id", F.when(F.col("seq") % 2 == 0, "even").otherwise("odd"))
    held = kv.last_records(rows.where("node_id = 'even'")).where("op = 1")
    return replication.get_from(held, spark.createDataFrame([("even", True), ("odd", False)], "id string, available boolean"), "even", NOW_MS)


@query("SELECT n_name AS id, 'id exceeds 255 bytes' AS error FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_name, 'negative delay' FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT NULL, 'factor must be 1 to 3 and fit the nodes'")
def repl_cluster_errors(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.repeat(F.lit("x"), 256)).otherwise(F.col("n_name")).alias("id"), F.when(F.col("n_nationkey") % 7 == 0, -1).otherwise(0).alias("delay_ms"))
    found = replication.cluster_errors(n.select(F.concat("n_name", F.when(F.col("id") != F.col("n_name"), F.col("id")).otherwise("")).alias("id"), "delay_ms"), 4)
    return found.select(F.regexp_replace("id", "x{256}$", "").alias("id"), "error")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, 'repeated key' AS error FROM (SELECT o_custkey AS c_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def repl_snapshot_errors(spark, sf_dir):
    """Orders as a snapshot that puts a customer's key once per order, each from a primary of its own."""
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("primary_id"), F.col("o_custkey").cast("string").alias("key"), F.lit(1).alias("op"))
    return replication.snapshot_errors(m)


# --- evidence -----------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT i, (i::UHUGEINT * 11400714819323198485::UHUGEINT + 42) % {M64} AS x FROM range(10000) g(i))
SELECT i AS op_no, x % 1000000 < 800000 AS is_read, 'bench-key-' || lpad(CAST((x // 1048576) % 1000 AS VARCHAR), 12, '0') AS key FROM m""")
def workload_gen(spark, sf_dir):
    return evidence.workload(spark, 10000, 42, 1000, 0.8)


@query("""SELECT i AS op_no, 'put' AS kind, 'bench-key-' || lpad(CAST(i AS VARCHAR), 12, '0') AS key FROM range(1000) g(i)
UNION ALL SELECT i + 1000, 'get', 'bench-key-' || lpad(CAST(i % 1000 AS VARCHAR), 12, '0') FROM range(2500) g(i)""")
def workload_preload(spark, sf_dir):
    return evidence.preload(spark, 1000, 2500)


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return evidence.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


TRIALS = ["l_returnflag", "l_linestatus"]
TRIALS_SQL = """SELECT l_returnflag, l_linestatus, count(*) AS trials, min(l_extendedprice) AS ops_min, median(l_extendedprice) AS ops_median, max(l_extendedprice) AS ops_max,
  median(l_tax) AS p99_median, max(l_tax) AS p99_max, CAST(sum(l_linenumber) AS BIGINT) AS errors FROM lineitem GROUP BY 1, 2"""


@query(TRIALS_SQL)
def matrix_summary(spark, sf_dir):
    return evidence.trial_summary(table(spark, sf_dir, "lineitem"), TRIALS, "l_extendedprice", "l_tax", "l_linenumber")


@query(f"""WITH t AS ({TRIALS_SQL}), c AS (SELECT max(CASE WHEN l_returnflag = 'A' THEN ops_median END) AS before, max(CASE WHEN l_returnflag = 'R' THEN ops_median END) AS after FROM t)
SELECT before, after, round((after / before - 1) * 100, 6) AS change_percent, round(after / before, 9) AS multiple FROM c""")
def ab_compare(spark, sf_dir):
    summary = matrix_summary(spark, sf_dir)
    out = evidence.compare(summary, F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", "ops_median")
    return out.select("before", "after", F.round("change_percent", 6).alias("change_percent"), F.round("multiple", 9).alias("multiple"))


@query("""SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage_diff(spark, sf_dir):
    return evidence.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("""WITH x AS (SELECT * FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type), (SELECT DISTINCT user_id FROM events)) SELECT event_type, user_id, 'missing' AS problem FROM x
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = x.event_type AND e.user_id = x.user_id AND e.value > 400)""")
def contention_coverage(spark, sf_dir):
    """Every event type for every user is expected with a value over 400."""
    e = table(spark, sf_dir, "events")
    expected = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, EVENT_TYPES))))
    return evidence.coverage(expected, e.where("value > 400").select("event_type", "user_id").distinct(), ["event_type", "user_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_trials(spark, sf_dir):
    return evidence.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, count(*) AS lines, count(*) FILTER (l_extendedprice > o_totalprice) AS over_total FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey""")
def evidence_join(spark, sf_dir):
    """Trials joined with their results: compared field by field, trials of one status left out."""
    joined = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_extendedprice") > F.col("o_totalprice")).alias("over_total"))


@query("""SELECT a.event_id, b.event_id AS captured_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 300 SECONDS
WHERE a.event_type = 'purchase' AND b.event_type = 'view'""")
def resource_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    results = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    captures = e.where("event_type = 'view'").select(F.col("event_id").alias("captured_id"), "user_id", "ts")
    return evidence.within(results, captures, "user_id").select("event_id", "captured_id")


RULES_SQL = {
    "throughput": "o_orderkey % 5 = 0", "errors_over_operations": "o_orderkey % 7 = 0", "percentile_order": "o_orderkey % 11 = 0", "threads_over_connections": "o_orderkey % 13 = 0",
    "no_bound": "o_orderkey % 17 = 0", "durability_kind": "o_orderkey % 19 = 0", "git_sha": "o_orderkey % 23 = 0", "timestamp_utc": "o_orderkey % 29 = 0", "warmup_without_preload": "o_orderkey % 31 = 0",
    "port": "o_orderkey % 37 = 0", "host": "o_orderkey % 41 = 0", "read_ratio": "o_orderkey % 43 = 0", "value_size_limit": "o_orderkey % 47 = 0",
}


@query(" UNION ALL ".join(f"SELECT o_orderkey AS trial, '{rule}' AS rule FROM orders WHERE {where}" for rule, where in RULES_SQL.items()))
def result_validation(spark, sf_dir):
    """Orders as results; one in a few breaks each rule."""
    bad = {rule: F.expr(where) for rule, where in RULES_SQL.items()}
    either = lambda rule, wrong, right: F.when(bad[rule], wrong).otherwise(right)
    one = F.lit(1.0)
    return evidence.result_violations(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trial"), F.lit(100).cast("long").alias("operations"), F.lit(2.0).alias("seconds"), either("throughput", 51.0, 50.0).alias("ops_per_second"),
        either("percentile_order", 2.0, 1.0).alias("p50"), one.alias("p95"), one.alias("p99"), one.alias("max"), either("errors_over_operations", 101, 0).cast("long").alias("errors"),
        either("threads_over_connections", 9, 4).cast("long").alias("threads"), F.lit(8).cast("long").alias("connections"), either("no_bound", 0, 100).cast("long").alias("request_bound"),
        F.lit(0).cast("long").alias("duration_bound_s"), either("durability_kind", "often", "always").alias("durability"), either("git_sha", "abc", "a" * 40).alias("git_sha"),
        either("timestamp_utc", "2024-02-30T00:00:00Z", "2024-02-29T00:00:00Z").alias("timestamp_utc"), (~bad["warmup_without_preload"]).alias("preload"), F.lit(5).cast("long").alias("warmup_requests"),
        F.lit(10).cast("long").alias("key_count"), either("port", 70000, 7001).cast("long").alias("port"), either("host", " h", "h").alias("host"), either("read_ratio", 1.5, 0.8).alias("read_ratio"),
        either("value_size_limit", 1 << 25, 128).cast("long").alias("value_size"),
    ))


@query("""SELECT user_id, 'p99' AS field FROM events WHERE user_id % 7 = 0 GROUP BY user_id UNION ALL SELECT user_id, 'operations' FROM events WHERE user_id % 11 = 0 GROUP BY user_id""")
def latency_recomputed(spark, sf_dir):
    """Users as results whose percentiles are those of their events, but for some."""
    e = table(spark, sf_dir, "events")
    said = evidence.latency_summary(e, ["user_id"], "value").withColumn("operations", F.col("n") + F.when(F.col("user_id") % 11 == 0, 1).otherwise(0)).withColumn("p99", F.col("p99") * F.when(F.col("user_id") % 7 == 0, 1.001).otherwise(1.000001))
    return evidence.recomputed(e.select("user_id", "value"), said.drop("n"), "user_id", "value")


@query("""SELECT o_orderkey, 'priority' AS field FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'cust' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT -1 - o_orderkey, '(no result)' FROM orders WHERE o_orderkey % 13 = 0""")
def row_against_document(spark, sf_dir):
    """Orders as documents and, in text, as rows: some fields differ, some rows have no document."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        "o_orderkey", F.when(k % 5 == 0, "other").otherwise(F.col("o_orderpriority")).alias("priority"), F.concat(F.when(k % 7 == 0, "0").otherwise(""), F.col("o_custkey").cast("string")).alias("cust"),
        F.concat(F.when(k % 11 == 0, " ").otherwise(""), (F.col("o_totalprice") * 1.000001).cast("string")).alias("price"),
    )
    rows = rows.unionByName(rows.where("o_orderkey % 13 = 0").withColumn("o_orderkey", -1 - k))
    return evidence.differing_fields(rows, o, "o_orderkey", {"priority": "o_orderpriority"}, {"cust": "o_custkey"}, {"price": "o_totalprice"})


@query("""SELECT i // 1000 AS thread, i % 1000 AS op_no, CASE WHEN i % 10 = 0 THEN 'replace' ELSE 'find' END AS kind, 'contention-key-' || ((i // 1000 * 1009 + i % 1000 * 17) % 64) AS key FROM range(4000) g(i)""")
def contention_workload(spark, sf_dir):
    return evidence.contention(spark, 4, 1000, 64, False)


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) SELECT CASE WHEN i % 2 = 0 THEN 'same-key' ELSE 'distributed-key' END AS workload, 1 AS shards, (i + 1) // 2 AS repetition,
  unnest(list_filter([CASE WHEN i % 5 = 0 THEN 'throughput' END, CASE WHEN i % 7 = 0 THEN 'configuration' END], lambda r: r IS NOT NULL)) AS rule FROM x WHERE i <= 20
UNION ALL SELECT unnest(['same-key', 'distributed-key']), 2, r, 'missing' FROM range(1, 11) g(r)""")
def contention_validation(spark, sf_dir):
    """Twenty nations as runs on one shard; those on two are missing."""
    n = kv.assign_sequence(table(spark, sf_dir, "nation").select("n_nationkey"), ["n_nationkey"]).where("seq <= 20")
    i = F.col("seq")
    rows = n.select(
        F.when(i % 2 == 0, "same-key").otherwise("distributed-key").alias("workload"), F.lit(1).cast("long").alias("shards"), F.when(i % 7 == 0, 5).otherwise(4).cast("long").alias("threads"), F.lit(64).cast("long").alias("keys"),
        F.lit(4000).cast("long").alias("operations"), F.floor((i + 1) / 2).cast("long").alias("repetition"), F.lit(2.0).alias("seconds"), F.when(i % 5 == 0, 2001.0).otherwise(2000.0).alias("ops_per_second"), i.alias("checksum"),
    )
    return evidence.contention_violations(rows, [1, 2], 4, 64, 1000, 10)


@query("""SELECT s_suppkey AS run, s_suppkey % 5 > 0 AS all_excess_rejected, s_suppkey % 7 > 0 AS no_excess_served, s_suppkey % 3 > 0 AS threads_bounded, true AS fds_bounded, s_suppkey % 11 > 0 AS recovered,
  s_suppkey % 2 > 0 AS threads_near_base, true AS fds_near_base, s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 3 > 0 AND s_suppkey % 11 > 0 AND s_suppkey % 2 > 0 AS passed FROM supplier""")
def overload_validation(spark, sf_dir):
    k = F.col("s_suppkey")
    either = lambda n, wrong, right: F.when(k % n == 0, wrong).otherwise(right)
    return evidence.overload_checks(table(spark, sf_dir, "supplier").select(
        k.alias("run"), F.lit(16).alias("excess"), either(5, 15, 16).alias("rejected"), either(7, 1, 0).alias("excess_served"), F.lit(7).alias("threads_base"), either(3, 42, 41).alias("threads_peak"),
        F.lit(32).alias("connection_cap"), F.lit(6).alias("fds_base"), F.lit(40).alias("fds_peak"), (k % 11 > 0).alias("recovered"), either(2, 10, 9).alias("threads_end"), F.lit(6).alias("fds_end"),
    ))


@query("""SELECT c_custkey AS pid, c_custkey AS "VmRSS", c_custkey * 2 AS "VmHWM", CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 3 END AS "VmPeak", CAST(7 AS BIGINT) AS "Threads", CASE WHEN c_custkey % 5 > 0 THEN []::VARCHAR[] ELSE ['VmPeak'] END AS missing FROM customer""")
def process_status(spark, sf_dir):
    """Status texts of processes, line by line; every fifth lacks a field."""
    k = F.col("c_custkey").cast("string")
    line = lambda name, factor: F.concat(F.lit(f"{name}:\t  "), (F.col("c_custkey") * factor).cast("string"), F.lit(" kB"))
    texts = F.array_compact(F.array(F.concat(F.lit("Name:\tnode-"), k), line("VmRSS", 1), line("VmHWM", 2), F.when(F.col("c_custkey") % 5 > 0, line("VmPeak", 3)), F.lit("Threads:\t7")))
    return evidence.proc_status(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.explode(texts).alias("value")))


@query("""SELECT event_id, replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS json, '"' || replace(t, '"', '""') || '"' AS csv FROM (SELECT event_id, props || chr(10) || '\\' || event_type AS t FROM events)""")
def escapes(spark, sf_dir):
    text = F.concat("props", F.lit("\n\\"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", evidence_io.json_escape(text).alias("json"), evidence_io.csv_escape(text).alias("csv"))


@query("""SELECT c_custkey AS file, f.field, CASE f.field WHEN 'pid' THEN CAST(c_custkey AS VARCHAR) WHEN 'Threads' THEN '7' ELSE CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END END AS value,
  CASE WHEN f.field = 'system' AND c_custkey % 3 = 0 THEN 'empty' END AS error FROM customer, (SELECT unnest(['pid', 'Threads', 'system']) AS field) f""")
def resource_fields(spark, sf_dir):
    """Resource files of three lines, in both forms a line may have."""
    k = F.col("c_custkey").cast("string")
    lines = F.array(F.concat(F.lit("pid="), k), F.lit("Threads:\t7"), F.concat(F.lit("system="), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))))
    return evidence_io.resource_fields(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.explode(lines).alias("value")))


@query("SELECT c_custkey AS case_order, 'trial' AS rule FROM customer WHERE c_custkey % 10 = 3")
def manifest_validation(spark, sf_dir):
    """Customers as manifest rows; in order and unique, some with trial zero."""
    c = kv.assign_sequence(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    m = c.select(F.lit("run").alias("run_id"), F.col("seq").alias("case_order"), F.lit("axis").alias("experiment"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("variant"), F.when(F.col("c_custkey") % 10 == 3, 0).otherwise(1).alias("trial"), F.lit("ok").alias("status"), "c_custkey")
    return evidence.manifest_violations(m).join(m.select("case_order", "c_custkey"), "case_order").select(F.col("c_custkey").alias("case_order"), "rule")


@query("""SELECT * FROM (SELECT 'connections' AS experiment, unnest(['1', '10']) AS variant UNION ALL SELECT 'durability', unnest(['always', 'none', 'periodic'])), (SELECT CAST(unnest([1, 2, 3]) AS INT) AS trial)""")
def matrix_cases(spark, sf_dir):
    return evidence.matrix(spark, {"connections": "10", "durability": "periodic"}, {"connections": ["1", "10"], "durability": ["always", "none", "periodic"]}, 3).drop("settings")


# --- the binary log and streams -----------------------------------------------------------------------------------


@query(f"WITH {ROTATED_SQL} SELECT CAST(segment_id AS BIGINT) AS segment_id, seq, op, key, value, expires_at_ms, CAST(size AS BIGINT) AS encoded_size FROM rot")
def log_round_trip(spark, sf_dir):
    """Written as a binary log and read back, both checksums of every record verified."""
    with durable.scratch(spark, "kvlog") as path:
        kvlog.write_log(rotated(spark, sf_dir), path)
        read = kvlog.read_ordered(spark, path).select("segment_id", "seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "expires_at_ms", "encoded_size")
        return durable.cut(read)


@query(f"""WITH {LOG_SQL}, h AS (SELECT *, row_number() OVER (ORDER BY seq) <= (SELECT count(*) // 2 FROM log) AS early FROM log) SELECT (SELECT count(*) FROM log) AS records, (SELECT CAST(sum(seq) AS BIGINT) FROM log) AS sequences,
  (SELECT CAST(sum(44 + strlen(key) + strlen(value)) AS BIGINT) FROM log) AS bytes, true AS complete, CAST(0 AS BIGINT) AS out_of_order""")
def log_appended(spark, sf_dir):
    """Half of the log is written, the rest appended: what the segments then hold."""
    rows = log(spark, sf_dir).withColumn("size", kv.encoded_size(F.col("key"), F.col("value")))
    half = rows.count() // 2
    with durable.scratch(spark, "kvlog") as path:
        kvlog.write_log(kv.rotate(rows.where(F.col("seq") <= half), SEGMENT), path)
        kvlog.append_log(rows.where(F.col("seq") > half).drop("size"), path, SEGMENT)
        read, report = kvlog.read_ordered(spark, path), kvlog.tail_report(spark, path)
        totals = read.agg(F.count("*").alias("records"), F.sum("seq").alias("sequences"))
        sizes = report.agg(F.sum("valid_bytes").alias("bytes"), F.bool_and(F.col("status") == "complete").alias("complete"))
        wrong = kvlog.order_errors(spark, path).agg(F.count("*").alias("out_of_order"))
        return durable.cut(totals.join(F.broadcast(sizes)).join(F.broadcast(wrong)))  # one row each


@query("""WITH l AS (SELECT event_id // 100 AS segment_id, event_id % 100 AS record_offset, CASE WHEN event_id % 50 = 20 THEN event_id - 3 ELSE event_id + 1 END AS seq FROM events),
p AS (SELECT *, max(seq) OVER (PARTITION BY segment_id ORDER BY record_offset ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b FROM l) SELECT segment_id, record_offset, seq FROM p WHERE seq <= b""")
def log_order_errors(spark, sf_dir):
    """A log in which some records fall back behind the one before."""
    e = F.col("event_id")
    return kvlog.sequence_errors(table(spark, sf_dir, "events").select(F.floor(e / 100).alias("segment_id"), (e % 100).alias("record_offset"), F.when(e % 50 == 20, e - 3).otherwise(e + 1).alias("seq")))


@query("SELECT event_id, 'node-' || user_id AS primary_id, event_id + 1 AS seq, CAST(user_id AS VARCHAR) AS key, props AS value, 48 + strlen('node-' || user_id) + strlen(CAST(user_id AS VARCHAR)) + strlen(props) AS size FROM events")
def message_round_trip(spark, sf_dir):
    """Replication messages, encoded and decoded again with both checksums."""
    m = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("primary_id"), (F.col("event_id") + 1).alias("seq"), F.lit(1).alias("op"), F.lit(0).cast("long").alias("expires_at_ms"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))
    back = kvlog.decode_messages(kvlog.encode_messages(m, "event_id"), "event_id")
    return back.select("event_id", "primary_id", "seq", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "size")


@query("SELECT event_id + 1 AS request_id, CAST(user_id AS VARCHAR) AS key, props AS value FROM events")
def frame_round_trip(spark, sf_dir):
    """Requests as frames, joined to one stream of bytes per user, cut into odd chunks and parsed again."""
    r = table(spark, sf_dir, "events").select(
        F.lit(1).alias("kind"), F.lit(1).alias("opcode"), F.lit(0).alias("status"), (F.col("event_id") + 1).alias("request_id"),
        F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
    )
    framed = kvlog.encode_frames(r)
    halves = F.array(F.struct(F.lit(0).alias("half"), F.substring("frame", 1, 37).alias("chunk")), F.struct(F.lit(1).alias("half"), F.expr("substring(frame, 38)").alias("chunk")))
    chunks = framed.select(F.pmod("request_id", F.lit(64)).cast("string").alias("connection"), "request_id", F.explode(halves).alias("x")).select("connection", (F.col("request_id") * 2 + F.col("x.half")).alias("pos"), "x.chunk")
    return kvlog.frames_of(chunks).select("request_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {LOG_SQL}, {snap_sql('s')} SELECT * FROM s")
def stream_snapshot(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/events*.parquet")
    last = stream.drain(stream.latest(as_log(source)), "complete", ["key"])
    return plain(last.where(kv.live(NOW_MS)))


@query(f"WITH {FOLD_SQL} SELECT stream, r.last, r.applied, r.duplicates, r.gaps FROM f")
def stream_replication(spark, sf_dir):
    schema = table(spark, sf_dir, "lineitem").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem*.parquet")
    arrival = F.concat(F.date_format("l_shipdate", "yyyyMMdd"), *(F.lpad(F.col(c).cast("string"), 12, "0") for c in ARRIVAL[1:]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.drain(stream.replicate(source.select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").cast("long").alias("seq"), arrival.alias("arrival"))), "update", ["stream"])
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
