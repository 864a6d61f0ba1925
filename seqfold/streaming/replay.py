"""Change logs as streams: last writer per key, and replication state per stream of messages."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from seqfold.sources import durable


def latest(log: DataFrame) -> DataFrame:
    """The last record per key of a streaming (or batch) log, in complete or update mode."""
    rest = [c for c in log.columns if c != "key"]
    return log.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("key", "r.*")


#: Groups of streams that share a state. A batch rewrites the state of the groups it touches (40 bytes a stream).
BUCKETS = 4096
_NO_SEQ = -(1 << 63)


class ReplicaState(StatefulProcessor):
    """Watermarks and counts of one bucket's streams, packed in one value; each batch's messages are taken in order of arrival.

    A call per stream would cost more than the fold itself, which takes about four messages of each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(self.state.get()[0], "<i8").reshape(-1, 5).tolist() if self.state.exists() else []
        marks = {stream: rest for stream, *rest in held}
        due = defaultdict(list)
        for part in rows:
            late = part["arrival"].isna()
            for stream, none, arrival, seq in zip(*(x.tolist() for x in (part["stream"], late, part["arrival"], part["seq"]))):
                due[stream].append((none, 0 if none else arrival, seq))
        for stream, messages in due.items():
            messages.sort()
            last, applied, duplicates, gaps = marks.get(stream, (0, 0, 0, 0))
            for _, _, seq in messages:
                if seq == last + 1:
                    last, applied = seq, applied + 1
                elif seq > last:
                    gaps += 1
                elif seq != _NO_SEQ:
                    duplicates += 1
            marks[stream] = last, applied, duplicates, gaps
        self.state.update((np.array([(k, *v) for k, v in marks.items()], "<i8").tobytes(),))
        out = pd.DataFrame([(k, *marks[k]) for k in due], columns=["stream", "last", "applied", "duplicates", "gaps"])
        yield out if key[0] >= 0 else out.assign(stream=pd.array([None] * len(out), "Int64"))

    def close(self) -> None:
        pass


def replicate(messages: DataFrame) -> DataFrame:
    """(stream, last, applied, duplicates, gaps) after each batch, from (stream, seq, arrival).

    Messages that tie in arrival are taken by sequence, those without an arrival last; one without a sequence counts as
    nothing. Nulls are taken out of the longs here (pandas would make floats of them); the stream null has a bucket of its own.
    """
    durable.visible(messages.sparkSession)
    bucket = F.when(F.col("stream").isNull(), -1).otherwise(F.pmod(F.xxhash64("stream"), F.lit(BUCKETS))).cast("long")
    plain = messages.select(bucket.alias("bucket"), F.coalesce("stream", F.lit(0)).alias("stream"), F.coalesce("seq", F.lit(_NO_SEQ)).alias("seq"), "arrival")
    return plain.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ReplicaState(), outputStructType="stream long, last long, applied long, duplicates long, gaps long", outputMode="Update", timeMode="None"
    )


def drain(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over what there is, and give its result as a table in the shared folder.

    Each batch is written as Parquet, under its number, so one that is run again replaces itself. Complete mode: the
    last batch is the result. Update mode: of each key the row of the last batch that has it.
    """
    spark: SparkSession = stream.sparkSession
    path = durable.fresh(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    durable.delete(spark, f"{path}/state")
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("last"))), F.col("batch") == F.col("last")).drop("batch", "last")  # one row
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*stream.columns)
