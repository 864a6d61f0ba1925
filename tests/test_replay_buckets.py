"""Many streams share a state, and are folded as if each had its own."""

import random

from pyspark.sql import functions as F

from seqfold.operators import replication
from seqfold.streaming import replay


def test_streams_share_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "BUCKETS", 4, raising=False)
    rng, kind = random.Random(3), "stream long, seq long, arrival string"
    rows = [(s, q, f"{rng.random():.9f}") for s in [None, -1, 1 << 60, *range(200)] for q in [*range(1, 6), rng.randint(1, 9)]]
    rows += [(7, None, "0"), (7, (1 << 62) + 1, "1"), (8, None, "2")]
    rows.sort(key=lambda r: r[2])
    for k in range(3):
        spark.createDataFrame(rows[k * 500 : k * 500 + 500 if k < 2 else None], kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = replay.replicate(source).writeStream.format("memory").queryName("shared").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 5
    got = {r.stream: tuple(r) for r in spark.table("shared").orderBy(F.col("applied") + F.col("duplicates") + F.col("gaps")).collect()}
    want = replication.classify(spark.createDataFrame(rows, kind), ["stream"], ["arrival"])
    assert got == {r.stream: tuple(r) for r in want.collect()}
