"""The binary log as a Spark data source, ``spark.read.format("kvlog").load(dir)`` and ``df.write.format("kvlog")``.

A partition per ``PARTITION_BYTES`` of consecutive segment files, read in Arrow batches, through a memory map where they
are large. ``mode`` failfast (default) raises on corruption; permissive gives a row with ``error_code``. A tail cut off in
the active (last) segment is dropped either way; ``report`` gives, instead of records, one row per segment: how far it is
valid and what follows; ``order`` (failfast) what ``order_errors`` needs. Records are decoded and verified many at once;
where one isn't as it should be, the rest of its segment is taken singly, to say what is wrong. Order across segments is
checked by ``sequence_errors``, and by ``read_ordered`` before anything is returned. Paths must be on a mount that all
executors share.
"""

from __future__ import annotations

import mmap
import os
import re
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from seqfold.sources import codec
from seqfold.sources.durable import local_path, visible

SCHEMA = "segment_id long, record_offset long, seq long, op int, key binary, value binary, expires_at_ms long, header_size int, encoded_size long, payload_crc long, error_code string"
#: ``order``: of each segment its first record and highest sequence, and without ``top`` what is not above the record before.
ORDER = "segment_id long, record_offset long, seq long, top long"
PARTITION_BYTES = 1 << 23
#: Bytes of records decoded at once.
PIECE_BYTES = 1 << 22
NAME = re.compile(r"segment-(\d{20})\.fkv")


def segments(path: str) -> list[tuple[int, str]]:
    """(id, file) of a log directory in order; names and kinds that don't belong to it are corruption."""
    found: dict[int, str] = {}
    with os.scandir(local_path(path)) as entries:
        for entry in entries:
            name = entry.name
            if not name.startswith("segment-") or not name.endswith(".fkv"):
                continue
            m = NAME.fullmatch(name)
            if not m or int(m[1]) == 0 or not entry.is_file(follow_symlinks=False) or int(m[1]) in found:
                raise codec.CodecError("malformed_segment_name")
            found[int(m[1])] = os.path.join(path, name)
    return sorted(found.items())


def file_of(path: str, segment_id: int) -> str:
    return os.path.join(path, f"segment-{segment_id:020d}.fkv")


class _Segments(InputPartition):
    """Ids of consecutive segments, and of the active one."""

    def __init__(self, listed: list[int], active: int):
        super().__init__(listed[0])
        self.listed, self.active = listed, active


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = local_path(options["path"]), options.get("mode", "failfast")
        if self.mode not in ("failfast", "permissive", "report", "order"):
            raise ValueError(f"unknown mode: {self.mode}")

    def partitions(self):
        listed, parts, size = segments(self.path), [], PARTITION_BYTES
        for i, file in listed:
            if size >= PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += os.path.getsize(file)
        return [_Segments(p, listed[-1][0]) for p in parts]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for i in partition.listed if partition is not None else ():
            with open(file_of(self.path, i), "rb") as f:
                length = os.fstat(f.fileno()).st_size
                if length > PIECE_BYTES:
                    yield from self._decoded(held)
                    held, size = [], 0
                    yield from self._large(i, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), i == partition.active)
                    continue
                data = f.read()
            starts, end = codec.walk(data, 0, length)
            held.append((i, data, starts, end, i == partition.active))
            size += length
            if size >= PIECE_BYTES:
                yield from self._decoded(held)
                held, size = [], 0
        yield from self._decoded(held)

    def _large(self, segment_id: int, data, active: bool) -> Iterator[pa.RecordBatch]:
        at, edge, last = 0, _Edge(segment_id), len(data)
        while at < last:
            starts, end = codec.walk(data, at, PIECE_BYTES)
            good, columns = codec.decode_records(_bytes([data[at:end]]), np.array(starts, np.int64) - at) if starts else (np.ones(0, bool), None)
            if not starts or not good.all():
                break
            yield from self._batch(np.full(len(starts), segment_id), np.array(starts, np.int64), columns, [(edge, len(starts))])
            at = end
        yield from self._singly(edge, data, active, at)

    def _decoded(self, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Small segments together; those with anything amiss from their start, singly."""
        if not held:
            return
        counts, begins = np.array([len(x[2]) for x in held]), np.cumsum([0, *(len(x[1]) for x in held)])
        offsets = np.array([at for x in held for at in x[2]], np.int64)
        whole = np.array([end == len(data) for _, data, _, end, _ in held])
        of = np.repeat(np.arange(len(held)), counts)
        good, columns = codec.decode_records(_bytes([x[1] for x in held]), offsets + begins[of])
        whole &= np.bincount(of[~good], minlength=len(held)) == 0
        edges = [_Edge(x[0]) for x in held]
        if whole.all():
            yield from self._batch(np.array([x[0] for x in held])[of], offsets, columns, list(zip(edges, counts.tolist())))
            yield from self._rows([row for edge, x in zip(edges, held) for row in self._summary(edge, len(x[1]), "complete")])
        elif len(held) > 1:
            for x in held:
                yield from self._decoded([x])
        else:
            yield from self._singly(edges[0], held[0][1], held[0][4], 0)

    def _singly(self, edge: _Edge, data, active: bool, at: int) -> Iterator[pa.RecordBatch]:
        """What a segment has from ``at`` on, and its row in ``report`` and ``order``."""
        rows: list[tuple] = []
        size, nothing, end, status = 0, (None,) * 8, at, "complete"
        for at, r, error in codec.read_segment(data, active, at):
            if r is None:
                status = error
                if self.mode in ("failfast", "order") and error != "truncated":
                    raise codec.CodecError(f"{error} in segment {edge.segment_id} at {at}")
                if self.mode == "permissive" and error != "truncated":
                    rows.append((edge.segment_id, at, *nothing, error))
                continue
            end = at + r.encoded_size
            if self.mode == "report":
                continue
            if r.seq >= 1 << 63 or r.expires_at_ms >= 1 << 63:
                raise OverflowError("sequence or deadline beyond a long")
            if self.mode == "order":
                rows += edge.add(np.array([at]), np.array([r.seq]))
                continue
            rows.append((edge.segment_id, at, r.seq, r.op, r.key, r.value, r.expires_at_ms, r.header_size, r.encoded_size, r.payload_crc, None))
            size += 64 + len(r.value)
            if size > PIECE_BYTES:
                yield from self._rows(rows)
                rows, size = [], 0
        yield from self._rows(rows + self._summary(edge, end, status))

    def _summary(self, edge: _Edge, end: int, status: str) -> list[tuple]:
        if self.mode == "report":
            return [(edge.segment_id, end, *(None,) * 8, status)]
        return [(edge.segment_id, *edge.first, edge.top)] if self.mode == "order" and edge.first else []

    def _rows(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield _batch(rows, ORDER if self.mode == "order" else SCHEMA)

    def _batch(self, segment_ids: np.ndarray, offsets: np.ndarray, columns: dict, edges: list[tuple[_Edge, int]]) -> Iterator[pa.RecordBatch]:
        if self.mode == "order":
            rows, at = [], 0
            for edge, n in edges:
                rows += edge.add(offsets[at : at + n], columns["seq"][at : at + n])
                at += n
            yield from self._rows(rows)
        elif self.mode != "report" and len(offsets):
            flat = [segment_ids, offsets, columns["seq"], columns["op"], columns["key"], columns["value"], columns["expires"], columns["head"], columns["size"], columns["crc"]]
            arrays = [_binary(*x) if isinstance(x, tuple) else pa.array(x, field.type) for x, field in zip(flat, arrow_schema(SCHEMA))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(offsets), pa.string())], schema=arrow_schema(SCHEMA))


class _Edge:
    """First record, highest and last sequence of a segment, as far as it has been read."""

    def __init__(self, segment_id: int):
        self.segment_id, self.first, self.top, self.last = segment_id, None, None, None

    def add(self, offsets: np.ndarray, seqs: np.ndarray) -> list[tuple]:
        """Takes the next records; gives those not above the one before."""
        if not len(seqs):
            return []
        before = np.concatenate([[seqs[0] - 1 if self.last is None else self.last], seqs[:-1]])
        if self.first is None:
            self.first = int(offsets[0]), int(seqs[0])
        self.top, self.last = max(self.top or 0, int(seqs.max())), int(seqs[-1])
        return [(self.segment_id, int(offsets[i]), int(seqs[i]), None) for i in np.flatnonzero(seqs <= before)]


def _bytes(pieces: list[bytes]) -> np.ndarray:
    """The pieces and 8 bytes more."""
    return np.frombuffer(b"".join([*pieces, bytes(8)]), np.uint8)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a binary array without nulls."""
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], np.diff(at)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows, about ``PIECE_BYTES`` of keys and values at once."""
    if any(c.null_count for c in batch.columns):
        raise TypeError("a record with a null")
    ends = np.cumsum(_flat(batch.column("key"))[1] + _flat(batch.column("value"))[1])
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    arrow = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), arrow)], schema=arrow)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def arrow_schema(ddl: str) -> pa.Schema:
    """A flat schema of this module in Arrow's terms; workers have no session to parse it with."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in ddl.split(","))])


class _Done(WriterCommitMessage):
    """Ids of the segments that a task wrote, and what the names of its files end in."""

    def __init__(self, ids: list[int], ending: str):
        self.ids, self.ending = ids, ending


class _Writer(DataSourceArrowWriter):
    """A file per segment id of the rows; each is written aside and renamed once all tasks have succeeded.

    The rows of a segment must be in one partition, in order of their sequence. With the option ``continue`` rows of
    the active segment go on at its end: its file is copied, extended and put in its place at once.
    """

    def __init__(self, options):
        self.path, self.going_on = local_path(options["path"]), options.get("continue", "false") == "true"

    def write(self, batches) -> _Done:
        os.makedirs(self.path, exist_ok=True)
        ids, out, ending = [], None, f".{os.getpid()}.tmp"
        for batch in (part for whole in batches for part in _parts(whole)):
            long = lambda name: batch.column(name).to_numpy().astype(np.int64)  # noqa: B023, E731
            data, sizes = codec.encode_records(long("op"), long("seq"), long("expires_at_ms"), _flat(batch.column("key")), _flat(batch.column("value")))
            of, ends = long("segment_id"), np.cumsum(sizes)
            stops, at = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)], 0
            for segment_id, end in zip(of[np.array(stops) - 1].tolist(), ends[np.array(stops) - 1].tolist()):
                if not ids or segment_id != ids[-1]:
                    if out:
                        out.close()
                    ids.append(segment_id)
                    out = open(file_of(self.path, segment_id) + ending, "wb")  # noqa: SIM115
                out.write(data[at:end])
                at = end
        if out:
            out.close()
        return _Done(ids, ending)

    def commit(self, messages) -> None:
        there, ids = set(os.listdir(self.path)) if os.path.isdir(self.path) else set(), [i for m in messages if m for i in m.ids]
        if len(set(ids)) != len(ids) or (not self.going_on and any(os.path.basename(file_of("", i)) in there for i in ids)):
            self.abort(messages)
            raise FileExistsError("a segment would be written twice")
        for i, ending in sorted((i, m.ending) for m in messages if m for i in m.ids):
            final = file_of(self.path, i)
            temporary = final + ending
            if os.path.basename(final) in there:  # the active segment
                with open(f"{temporary}.whole", "wb") as out:
                    for part in (final, temporary):
                        with open(part, "rb") as f:
                            shutil.copyfileobj(f, out)
                os.remove(temporary)
                temporary = f"{temporary}.whole"
            os.rename(temporary, final)

    def abort(self, messages) -> None:
        for m in messages:
            for i in m.ids if m else ():
                if os.path.exists(temporary := file_of(self.path, i) + m.ending):
                    os.remove(temporary)


class KvLog(DataSource):
    @classmethod
    def name(cls):
        return "kvlog"

    def schema(self):
        return ORDER if self.options.get("mode") == "order" else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    visible(spark)
    spark.dataSource.register(KvLog)


def write_log(rotated: DataFrame, path: str) -> None:
    """Write (segment_id, seq, op, key, value, expires_at_ms) as a new log."""
    _write(rotated, path, "false")


def _write(rotated: DataFrame, path: str, going_on: str) -> None:
    register(rotated.sparkSession)
    rows = rotated.select("segment_id", "seq", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "expires_at_ms")
    rows.repartition("segment_id").sortWithinPartitions("segment_id", "seq").write.format("kvlog").option("continue", going_on).mode("append").save(path)


def append_log(log: DataFrame, path: str, max_bytes: int) -> None:
    """Go on with an existing log: (seq, op, key, value, expires_at_ms) rotate on from the end of its active segment.

    Sequences must rise above the log's last one; a tail cut off must be dealt with first.
    """
    from seqfold.operators import changelog

    spark = log.sparkSession
    at = tail_report(spark, path).orderBy(F.desc("segment_id")).first()
    if at is None:
        raise FileNotFoundError(path)
    if at.status != "complete":
        raise codec.CodecError(f"{at.status} in segment {at.segment_id} at {at.valid_bytes}")
    last = read_log(spark, path).agg(F.max("seq")).first()[0] or 0
    if log.where(F.col("seq") <= last).limit(1).count():
        raise codec.CodecError("sequence_not_increasing")
    sized = log.withColumn("size", changelog.encoded_size(F.col("key"), F.col("value")))
    _write(changelog.rotate(sized, max_bytes, at.segment_id, at.valid_bytes), path, "true")


def tail_report(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, valid_bytes, status): complete, truncated (in the active segment) or what is corrupt after them."""
    return read_log(spark, path, "report").select("segment_id", F.col("record_offset").alias("valid_bytes"), F.col("error_code").alias("status"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The log, once it is known that its sequences rise throughout; otherwise an error."""
    found = read_log(spark, path)
    bad = order_errors(spark, path).orderBy("segment_id", "record_offset").first()
    if bad is not None:
        raise codec.CodecError(f"sequence_not_increasing in segment {bad.segment_id} at {bad.record_offset}")
    return found


def read_log(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    register(spark)
    return spark.read.format("kvlog").option("mode", mode).load(path)


def order_errors(spark: SparkSession, path: str) -> DataFrame:
    """``sequence_errors`` of a log of files: the reader compares within a segment, one row of each is left to compare."""
    before = Window.orderBy("segment_id", "record_offset").rowsBetween(Window.unboundedPreceding, -1)
    found = read_log(spark, path, "order").withColumn("_before", F.max("top").over(before))
    return found.where("top IS NULL OR seq <= _before").select("segment_id", "record_offset", "seq")


def sequence_errors(log: DataFrame) -> DataFrame:
    """Records whose sequence doesn't rise above that of the record before, within and across segments.

    Within a segment by a window of its own; across segments from one row each.
    """
    w = Window.partitionBy("segment_id").orderBy("record_offset")
    inside = log.where("seq IS NOT NULL").withColumn("_before", F.lag("seq").over(w)).where(F.col("seq") <= F.col("_before")).select("segment_id", "record_offset", "seq")
    edges = log.where("seq IS NOT NULL").groupBy("segment_id").agg(F.min("record_offset").alias("record_offset"), F.min_by("seq", "record_offset").alias("seq"), F.max("seq").alias("top"))
    over = Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    across = edges.withColumn("_before", F.max("top").over(over)).where(F.col("seq") <= F.col("_before")).select("segment_id", "record_offset", "seq")
    return inside.union(across)


def frames_of(chunks: DataFrame) -> DataFrame:
    """Frames of (connection, pos, chunk): each connection's chunks in order through one parser."""
    schema = "connection string, number int, kind int, opcode int, status int, request_id long, key binary, value binary, error_code string"

    def parse(pdf):
        import pandas as pd

        parser, rows, who = codec.FrameParser(), [], pdf["connection"].iloc[0]
        for chunk in pdf.sort_values("pos")["chunk"]:
            try:
                rows += [(who, len(rows) + k, *f, None) for k, f in enumerate(parser.feed(bytes(chunk)))]
            except codec.CodecError as e:
                rows.append((who, len(rows), None, None, None, None, None, None, e.code))
                break
        return pd.DataFrame(rows, columns=["connection", "number", "kind", "opcode", "status", "request_id", "key", "value", "error_code"])

    register(chunks.sparkSession)
    return chunks.groupBy("connection").applyInPandas(parse, schema)


def encode_frames(requests: DataFrame) -> DataFrame:
    """``requests`` (kind, opcode, status, request_id, key, value) with ``frame``."""
    register(requests.sparkSession)
    names = ["kind", "opcode", "status", "request_id", "key", "value"]

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in names))
            yield pa.RecordBatch.from_arrays([b.column("request_id"), pa.array([codec.encode_frame(codec.Frame(*r)) for r in rows], pa.binary())], names=["request_id", "frame"])

    return requests.select(*names).mapInArrow(run, "request_id long, frame binary")


MESSAGE = ["primary_id", "seq", "op", "expires_at_ms", "key", "value"]


def encode_messages(messages: DataFrame, carried: str) -> DataFrame:
    """(carried, message) of replication messages (carried, primary_id, seq, op, expires_at_ms, key, value)."""
    register(messages.sparkSession)

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in MESSAGE))
            yield pa.RecordBatch.from_arrays([b.column(carried), pa.array([codec.encode_message(codec.Message(*r)) for r in rows], pa.binary())], names=[carried, "message"])

    return messages.select(carried, *MESSAGE).mapInArrow(run, f"{carried} long, message binary")


def decode_messages(encoded: DataFrame, carried: str) -> DataFrame:
    """The messages again, with their size; what can't be decoded has an ``error_code`` and nothing else."""
    register(encoded.sparkSession)
    schema = f"{carried} long, primary_id string, seq long, op int, expires_at_ms long, key binary, value binary, size long, error_code string"

    def row(data):
        try:
            return (*codec.decode_message(data), len(data), None)
        except codec.CodecError as e:
            return (None,) * 6 + (len(data), e.code)

    def run(batches):
        arrow = arrow_schema(schema)
        for b in batches:
            if b.num_rows:
                columns = zip(*(row(x) for x in b.column("message").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(carried), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return encoded.select(carried, "message").mapInArrow(run, schema)
