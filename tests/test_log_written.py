"""Rotation and writing of a log, many records at once."""

import random

import pyarrow as pa
import pytest

from seqfold.operators import changelog as kv
from seqfold.sources import codec, kvlog


def test_no_record_is_written_singly(tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(i // 40 + 1, i + 1, 1, rng.randbytes(4), rng.randbytes(rng.randint(0, 20)), 0) for i in range(1000)]
    want = {i: b"".join(codec.encode_record(r[2], r[1], *r[3:]) for r in rows if r[0] == i) for i in range(1, 26)}
    monkeypatch.setattr(codec, "encode_record", lambda *a: pytest.fail("one record"))
    monkeypatch.setattr(kvlog, "PIECE_BYTES", 700, raising=False)
    kinds = {"segment_id": pa.int64(), "seq": pa.int64(), "op": pa.int32(), "key": pa.binary(), "value": pa.binary(), "expires_at_ms": pa.int64()}
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
    writer = kvlog._Writer({"path": str(tmp_path)})
    writer.commit([writer.write(iter([batch.slice(0, 333), batch.slice(333, 0), batch.slice(333)])), None])
    assert {i: open(f, "rb").read() for i, f in kvlog.segments(str(tmp_path))} == want


def test_rotation_is_the_fold(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 30, 99, 100, 101, 250]) for _ in range(400)]
    for used in (0, 100, 130):
        want, segment, size = [], 7, used
        for n in sizes:
            if size and size + n > 100:
                segment, size = segment + 1, 0
            size += n
            want.append(segment)
        log = spark.createDataFrame(list(enumerate(sizes)), "seq long, size long")
        assert [r.segment_id for r in kv.rotate(log, 100, 7, used).orderBy("seq").collect()] == want
