"""What the corpus operators share: reading tables, row-wise Arrow maps and durable lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from seqfold.sources.durable import cut as cut, visible as visible

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` sees it.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array (null text: none), without Python and without a regular expression."""
    plain = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def in_ids(df: DataFrame, column: str, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """Rows whose ``column`` may be among ``ids`` (one long column): exactly those while ``ids`` are few enough to
    broadcast (8 bytes each), else all rows. To be used before a join that needs no others."""
    if ids.limit(most + 1).count() > most:
        return df
    side = ids.toDF("only_id")
    return df.join(F.broadcast(side), df[column] == side["only_id"], "left_semi")


def small(side: DataFrame, most: int = 500_000) -> DataFrame:
    """``side`` to be joined: broadcast while it has at most ``most`` rows, which are taken to be a few numbers each."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row per input row: ``make()`` builds, on the executor, the function of one row's values.

    Rows stream through Arrow batches, so memory is that of one batch.
    """
    return flat_map_rows(df, lambda: _single(make()), schema)


def _single(of: Callable[..., tuple]) -> Callable[..., list[tuple]]:
    return lambda *values: [of(*values)]


def flat_map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str, flush_bytes: int = 1 << 25) -> DataFrame:
    """Any number of output rows per input row; a batch is sent on once it holds about ``flush_bytes``."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                for row in of(*values):
                    rows.append(row)
                    held += sum(len(x) if isinstance(x, (bytes, str, list)) else 8 for x in row)
                if held > flush_bytes:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, arrow)

    visible(df.sparkSession)
    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows), arrow)], schema=arrow)

