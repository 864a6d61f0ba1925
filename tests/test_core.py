"""Behaviour of the change-log, ring and replication operators on small tables."""

import random
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqfold.functions import u64
from seqfold.operators import changelog as kv, evidence, replication, requests, ring
from seqfold.sources import codec, kvlog

LOG = "seq long, op int, key string, value string, expires_at_ms long"


def fnv(data: bytes) -> int:
    h = u64.OFFSET
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def mixed(data: bytes) -> int:
    x = fnv(data)
    x ^= x >> 32
    x = x * u64.MIX % (1 << 64)
    return x ^ x >> 32


def signed(x: int) -> int:
    return struct.unpack("q", struct.pack("Q", x))[0]


def test_hashes_and_checksum(spark):
    texts = ["", "a", "123456789", "key-1", "é漢", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", u64.fnv1a64(F.col("t")).alias("f"), u64.ring_hash(F.col("t")).alias("r"), u64.crc32c(F.col("t")).alias("c"), u64.modulo(u64.fnv1a64(F.col("t")), 16).alias("m")).collect()
    for r in rows:
        b = r.t.encode()
        assert (r.f, r.r, r.c, r.m) == (signed(fnv(b)), signed(mixed(b)), codec.crc32c(b), fnv(b) % 16)
    assert codec.crc32c(b"123456789") == 0xE3069283


def test_snapshot_follows_a_sequential_fold(spark):
    rng = random.Random(5)
    rows, state = [], {}
    for seq in range(1, 800):
        key, op, exp = f"k{rng.randrange(40)}", rng.choice([1, 1, 2]), rng.choice([0, 0, 50, 100, 150])
        exp = 0 if op == 2 else exp
        rows.append((seq, op, key, "" if op == 2 else str(seq), exp))
        state.pop(key, None)
        if op == 1 and (exp == 0 or exp > 100):
            state[key] = str(seq)
    rng.shuffle(rows)
    got = {r.key: r.value for r in kv.snapshot(spark.createDataFrame(rows, LOG), 100).collect()}
    assert got == state


def test_an_expired_put_hides_the_value_before(spark):
    log = spark.createDataFrame([(1, 1, "k", "old", 0), (2, 1, "k", "new", 1)], LOG)
    assert kv.snapshot(log, 1).count() == 0  # the deadline itself has passed
    assert kv.last_records(log).first().seq == 2


def test_delete_tells_whether_a_live_value_was_there(spark):
    log = spark.createDataFrame([(1, 2, "a", "", 0, 5), (2, 1, "a", "x", 0, 6), (3, 2, "a", "", 0, 7), (4, 1, "b", "x", 10, 8), (5, 2, "b", "", 0, 10)], LOG + ", ts_ms long")
    assert {r.seq: r.existed for r in kv.deletes(log).collect()} == {1: False, 3: True, 5: False}


def test_sequences_follow_the_order_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t")).repartition(7)
    rows = kv.assign_sequence(df, ["t"], 10).collect()
    assert sorted((r.seq, r.t) for r in rows) == [(11 + i, i) for i in range(1000)]


def test_compaction_keeps_what_is_current(spark):
    # Two records fill a segment; the tombstone is in an inactive one.
    rows = [(1, 1, "s", "v", 0), (2, 2, "gone", "", 0), *((i, 1, "c", f"v{i}", 0) for i in range(3, 10)), (10, 1, "z", "v", 0)]
    log = spark.createDataFrame(rows, LOG).withColumn("size", kv.encoded_size(F.col("key"), F.col("value")))
    rotated = kv.rotate(log, 100)
    after = kv.compact(rotated, 0)
    assert kv.snapshot(after, 0).select("key", "seq").sort("key").collect() == kv.snapshot(log, 0).select("key", "seq").sort("key").collect()
    assert 2 not in {r.seq for r in after.collect()}
    stats = kv.compaction_stats(rotated, after).first()
    assert stats.bytes_after < stats.bytes_before


def test_index_compare_and_set(spark):
    index = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, seq long, value string")
    stale = spark.createDataFrame([("a", 1, 5, "n"), ("b", 9, 6, "n")], "key string, seq long, new_seq long, new_value string")
    assert sorted(map(tuple, kv.replace_if_sequence(index, stale).collect())) == [("a", 5, "n"), ("b", 2, "y")]
    assert [r.key for r in kv.erase_if_sequence(index, stale).collect()] == ["b"]


def test_ring_places_distinct_nodes_and_moves_little(spark):
    nodes = spark.createDataFrame([(f"node-{c}", "h", 7000 + i) for i, c in enumerate("abcd")], "id string, host string, port int")
    keys = spark.range(500).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("k"))
    tokens = ring.tokens(nodes, 64)
    ordered = sorted((mixed(f"node-{c}#{v}".encode()), f"node-{c}") for c in "abcd" for v in range(64))
    placed = {}
    for r in ring.placement(keys, tokens, 3, F.col("k")).collect():
        placed.setdefault(r.k, []).append((r.replica, r.node_id))
    for k, got in placed.items():
        h, walk = mixed(k.encode()), []
        at = next((i for i, t in enumerate(ordered) if t[0] >= h), 0)
        for i in range(len(ordered)):
            n = ordered[(at + i) % len(ordered)][1]
            if n not in walk:
                walk.append(n)
        assert [n for _, n in sorted(got)] == walk[:3]
    before, after = ring.primary(keys, tokens.where("node_id <> 'node-d'"), F.col("k")), ring.primary(keys, tokens, F.col("k"))
    moved = before.alias("b").join(after.alias("a"), "k").where("a.node_id <> b.node_id").select("a.node_id").distinct().collect()
    assert [r.node_id for r in moved] == ["node-d"]
    assert 0 < ring.remap_fraction(before, after, "k").first().fraction < 0.5
    with pytest.raises(Exception, match="more replicas than nodes"):
        ring.placement(keys, tokens, 5, F.col("k")).collect()
    assert ring.invalid_nodes(nodes).count() == 0


def test_replication_gap_duplicate_and_ownership(spark):
    m = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 2)], "arrival long, seq long").withColumn("s", F.lit("x"))
    r = replication.classify(m, ["s"], ["arrival"]).first()
    assert (r.last, r.applied, r.duplicates, r.gaps) == (2, 2, 1, 1)
    rows = [("k", "a", 1, 1, 1, 1), ("k", "b", 1, 1, 0, 2), ("k", "a", 2, 1, 0, 3)]
    o = replication.own(spark.createDataFrame(rows, "key string, primary_id string, seq long, op int, expires_at_ms long, arrival long"), 10, ["arrival"]).first()
    assert (o.owner, o.applied, o.conflicts) == ("b", 2, 1)  # the expired owner yields, the live one doesn't


NODES = "mutation long, id string, available boolean, delay_ms int"


def outcome(spark, states, mode, timeout=10):
    """Mutations of one key on nodes a (primary), b and c; ``states``: per mutation (available, delay) of each."""
    mutations = spark.createDataFrame([(m, "k") for m in range(len(states))], "mutation long, key string")
    placed = spark.createDataFrame([(m, r, "abc"[r]) for m in range(len(states)) for r in range(3)], "mutation long, replica int, node_id string")
    nodes = spark.createDataFrame([(m, "abc"[r], *x) for m, xs in enumerate(states) for r, x in enumerate(xs)], NODES)
    return [tuple(r)[1:] for r in replication.acknowledge(mutations, placed, nodes, timeout, mode).sort("mutation").collect()]


def test_acknowledgement_counts_what_happened(spark):
    up, down, slow = (True, 0), (False, 0), (True, 500)
    # acknowledged, sequence, acknowledgements, required, unavailable, timed_out, gaps
    assert outcome(spark, [[up, down, up]], "primary") == [(True, 1, 2, 1, 1, 0, 0)]
    assert outcome(spark, [[up, down, up]], "all") == [(False, 1, 2, 3, 1, 0, 0)]
    assert outcome(spark, [[up, up, down], [up, up, up]], "all") == [(False, 1, 2, 3, 1, 0, 0), (False, 2, 2, 3, 0, 0, 1)]
    assert outcome(spark, [[up, slow, up]], "all") == [(False, 1, 2, 3, 0, 1, 0)]
    # A primary that is down or late: one failure, no sequence; the next mutation takes the first.
    assert outcome(spark, [[down, down, slow], [slow, up, up], [up, up, up]], "all") == [(False, 0, 0, 3, 1, 0, 0), (False, 0, 0, 3, 0, 1, 0), (True, 1, 3, 3, 0, 0, 0)]
    with pytest.raises(ValueError):
        outcome(spark, [[up, up, up]], "most")


def test_recovery_and_reads_of_a_node(spark):
    history = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("u", 3)], "stream string, seq long")
    marks = spark.createDataFrame([("s", 1)], "stream string, last long")
    placed = spark.createDataFrame([("s", "b"), ("u", "b"), ("t", "c")], "stream string, node_id string")
    nodes = spark.createDataFrame([("b", True), ("c", False)], "id string, available boolean")
    assert sorted(map(tuple, replication.recover(history, marks, ["stream"], "b", placed, nodes).collect())) == [("s", 2, 1, False), ("u", 0, 1, True)]
    values = spark.createDataFrame([("b", "k", "v", 0), ("b", "old", "v", 5), ("c", "k", "w", 0)], "node_id string, key string, value string, expires_at_ms long")
    assert [tuple(r) for r in replication.get_from(values, nodes, "b", 5).collect()] == [("k", "v")]
    for node in ("c", "x"):
        with pytest.raises(ValueError):
            replication.recover(history, marks, ["stream"], node, placed, nodes)
        with pytest.raises(ValueError):
            replication.get_from(values, nodes, node, 5)


def test_sequences_of_wide_rows(spark):
    wide = spark.range(120_000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 16).alias("pad")).repartition(30, "pad")
    out = kv.assign_sequence(wide, ["id"])
    assert out.agg(F.count("*"), F.count_if(F.col("seq") != F.col("id") + 1)).first() == (120_000, 0)


def test_ring_refuses_bad_nodes_and_takes_any_key(spark):
    rows = [("a", "h", 1), (" b", "h", 2), ("c\x01", "h", 3), ("d", "h h", 4), ("e", "", 5), ("f", "H", 1), ("", "x", 6), ("g", "y", 0)]
    reasons = {r.id: r.reason for r in ring.invalid_nodes(spark.createDataFrame(rows, "id string, host string, port int")).collect()}
    assert set(reasons) == {r[0] for r in rows} and reasons["a"] == "repeated endpoint" and reasons[" b"] == "untrimmed id"
    nodes = spark.createDataFrame([("a", "h", 1), ("b", "h", 2)], "id string, host string, port int")
    texts = ["", "x", "é漢" * 70, "y" * 3000, None]
    keys = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, k string")
    got = {r.i: r.node_id for r in ring.primary(keys, ring.tokens(nodes, 16), F.col("k")).collect()}
    ordered = sorted((mixed(f"{n}#{v}".encode()), n) for n in "ab" for v in range(16))
    assert got == {i: next((n for t, n in ordered if t >= mixed(x.encode())), ordered[0][1]) for i, x in enumerate(texts) if x is not None}
    assert ring.primary(keys.limit(0), ring.tokens(nodes, 16), F.col("k")).count() == 0


def test_streams_of_several_batches(spark, tmp_path):
    from seqfold.streaming import replay

    for k, rows in enumerate([[(1, 1, 1), (2, 2, 2)], [(1, 2, 3), (2, 1, 4)], [(1, 2, 5), (1, 4, 6)]]):
        spark.createDataFrame(rows, "stream long, seq long, arrival long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema("stream long, seq long, arrival long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = replay.drain(replay.replicate(source), "update", ["stream"])
        assert sorted(map(tuple, got.collect())) == [(1, 2, 2, 1, 1), (2, 1, 1, 0, 1)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    log = source.select(F.col("stream").alias("key"), "seq")
    assert sorted(map(tuple, replay.drain(replay.latest(log), "complete", ["key"]).collect())) == [(1, 4), (2, 2)]


def test_log_goes_on_and_reports_its_tail(spark, tmp_path):
    log = spark.createDataFrame([(i, 1, f"k{i}", "v" * i, 0) for i in range(1, 40)], LOG).withColumn("size", kv.encoded_size(F.col("key"), F.col("value")))
    path = str(tmp_path / "log")
    kvlog.write_log(kv.rotate(log.where("seq < 20"), 500), path)
    kvlog.append_log(log.where("seq >= 20").drop("size"), path, 500)
    together = {r.seq: r.segment_id for r in kv.rotate(log, 500).collect()}
    assert {r.seq: r.segment_id for r in kvlog.read_ordered(spark, path).collect()} == together
    with pytest.raises(codec.CodecError, match="sequence_not_increasing"):
        kvlog.append_log(log.where("seq = 5").drop("size"), path, 500)
    last = kvlog.segments(path)[-1][1]
    whole = open(last, "rb").read()
    open(last, "wb").write(whole[:-1])
    report = {r.segment_id: (r.valid_bytes, r.status) for r in kvlog.tail_report(spark, path).collect()}
    assert report[max(together.values())][1] == "truncated" and {s for _, s in report.values()} == {"complete", "truncated"}
    with pytest.raises(codec.CodecError, match="truncated"):
        kvlog.append_log(log.where("seq = 5").withColumn("seq", F.lit(99)).drop("size"), path, 500)


def test_evidence_files(spark, tmp_path):
    from seqfold.sources import evidence_io

    (tmp_path / "c.csv").write_text("# host\nworkload,shards,threads,keys,operations,repetition,seconds,ops_per_second,checksum\nsame-key,1,4,64,4000,1,2.0,2000.0,7\n")
    rows = evidence_io.read_contention(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in evidence.contention_violations(rows, [1], 4, 64, 1000, 1).collect()] == [("distributed-key", 1, 1, "missing")]
    names = [f.name for f in spark.createDataFrame([], evidence_io.RESULT_SCHEMA).schema]
    good = {n: 1 for n in names} | {"latency_us": {"p50": 1, "p95": 2, "p99": 3, "max": 4}, "preload": True, "working_tree_dirty": False} | {n: "x: \"y\"" for n in evidence.TEXTS}
    import json

    text = json.dumps(good)
    for name, body in (("good", text), ("twice", text[:-1] + ', "seed": 2}'), ("more", text[:-1] + ', "zzz": 2}'), ("less", json.dumps({k: v for k, v in good.items() if k != "seed"})), ("broken", text[:-1])):
        (tmp_path / f"{name}.json").write_text(body)
    got = {r.output_prefix: r.error for r in evidence_io.read_results(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"good": None, "twice": "repeated field", "more": "unknown field", "less": "missing field", "broken": "malformed"}
    results = evidence_io.read_results(spark, str(tmp_path / "good.json")).drop("error", "output_prefix")
    samples = spark.createDataFrame([("good", 1.5)], "output_prefix string, latency_us double")
    evidence_io.write_trials(results, samples, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        evidence_io.write_trials(results, samples, str(tmp_path / "out"))
    raw = spark.createDataFrame([(bytearray(b"a\xff\xc3\xa9"),), (bytearray("é".encode()),)], "b binary")
    assert [r[0] for r in raw.select(evidence_io.from_bytes(F.col("b"))).collect()] == ["a\\u00ffé", "é"]
    odd = "a\x01\x1f\"\\/\t,"
    r = spark.createDataFrame([(odd,)], "t string").select(evidence_io.json_escape(F.col("t")), evidence_io.csv_escape(F.col("t"))).first()
    assert json.loads(f'"{r[0]}"') == odd and r[1] == '"' + odd.replace('"', '""') + '"'


def test_requests_and_responses(spark):
    rows = [(2, 1, 0, None, True), (2, 1, 3, None, False), (5, 1, 9, 1, True), (5, 1, 9, 0, False), (7, 0, 0, None, True), (9, 1, 1, None, False)]
    df = spark.createDataFrame(rows, "o int, k int, v int, t long, want boolean")
    assert df.where(requests.request_valid(F.col("o"), F.col("k"), F.col("v"), F.col("t")) != F.col("want")).count() == 0


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 100):
        r = evidence.latency_summary(spark.range(1, n + 1).withColumn("g", F.lit(1)), ["g"], "id").first()
        rank = lambda p: max(1, -(-int(p * 100) * n // 100))
        assert (r.p50, r.p95, r.p99, r.max) == (rank(0.5), rank(0.95), rank(0.99), n)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 2]), st.integers(1, (1 << 64) - 1), st.binary(min_size=1, max_size=40), st.binary(max_size=40), st.integers(0, (1 << 64) - 1))
def test_records_round_trip_and_break_at_every_byte(op, seq, key, value, exp):
    value, exp = (value, exp) if op == 1 else (b"", 0)
    data = codec.encode_record(op, seq, key, value, exp)
    r = codec.decode_record(data)
    assert (r.op, r.seq, r.key, r.value, r.expires_at_ms, r.encoded_size) == (op, seq, key, value, exp, len(data))
    for n in range(len(data)):
        with pytest.raises(codec.CodecError):
            codec.decode_record(data[:n])
        broken = bytearray(data)
        broken[n] ^= 1
        with pytest.raises(codec.CodecError):
            codec.decode_record(bytes(broken))


def test_old_records_and_frames_and_messages():
    old = codec.decode_record(codec.encode_record(1, 9, b"legacy", b"value", version=1))
    assert (old.header_size, old.expires_at_ms, old.value) == (36, 0, b"value")
    frames = [codec.Frame(1, o, 0, i + 1, b"k" * i, b"\x00\xff" * o) for i, o in enumerate(range(1, 9))]
    data = b"".join(map(codec.encode_frame, frames))
    for step in (1, 7, 41, len(data)):
        parser = codec.FrameParser()
        assert [f for i in range(0, len(data), step) for f in parser.feed(data[i : i + step])] == frames
    parser = codec.FrameParser()
    for _ in range(2):
        with pytest.raises(codec.CodecError):
            parser.feed(b"x" * 40)
    m = codec.Message("node-a", 3, 1, 7, b"k", b"v")
    assert codec.decode_message(codec.encode_message(m)) == m
    assert codec.split_putex(codec.putex_payload(5, b"v")) == (5, b"v")


def test_log_source_and_sink(spark, tmp_path):
    rows = [(i, 2 if i % 5 == 0 else 1, f"k{i % 7}", "" if i % 5 == 0 else "v" * i, 0) for i in range(1, 60)]
    log = spark.createDataFrame(rows, LOG).withColumn("size", kv.encoded_size(F.col("key"), F.col("value")))
    path = str(tmp_path / "log")
    kvlog.write_log(kv.rotate(log, 500), path)
    read = kvlog.read_log(spark, path)
    assert sorted((r.seq, r.op, r.key.decode(), r.value.decode()) for r in read.collect()) == [r[:4] for r in rows]
    assert kvlog.sequence_errors(read).count() == 0
    last = kvlog.segments(path)[-1][1]
    whole = open(last, "rb").read()
    open(last, "wb").write(whole[:-3])
    assert kvlog.read_log(spark, path).count() == len(rows) - 1  # a tail cut off in the active segment is dropped
    first = kvlog.segments(path)[0][1]
    data = bytearray(open(first, "rb").read())
    data[60] ^= 1
    open(first, "wb").write(bytes(data))
    assert kvlog.read_log(spark, path, "permissive").where("error_code IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="checksum"):
        kvlog.read_log(spark, path).collect()
