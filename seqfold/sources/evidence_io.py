"""Files of benchmark evidence: readers that keep every field as text until it is checked, and a writer that never overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RESULT_SCHEMA = (
    "timestamp_utc string, git_sha string, working_tree_dirty boolean, compiler string, build string, system string, hardware_threads long, ram string, "
    "storage_medium string, run_id string, experiment string, variant string, host string, port long, connections long, threads long, request_bound long, "
    "duration_bound_s long, read_ratio double, key_count long, value_size long, pipeline_depth long, warmup_requests long, seed long, preload boolean, "
    "server_workers long, server_shards long, durability string, repetition long, operations long, seconds double, operations_per_second double, "
    "latency_us struct<p50:double,p95:double,p99:double,max:double>, errors long, connection_errors long"
)
CONTENTION_SCHEMA = "workload string, shards long, threads long, keys long, operations long, repetition long, seconds double, ops_per_second double, checksum long"
_NAMED = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_escape(text: Column) -> Column:
    """Text as it stands between the quotes of a JSON string: named escapes, other controls as four hex digits."""
    for raw, escaped in [*_NAMED.items(), *((chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in _NAMED)]:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def csv_escape(text: Column) -> Column:
    """Text in quotes if it holds a comma, a quote or a line end, its quotes doubled."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def from_bytes(raw: Column) -> Column:
    """Bytes as text; those that aren't UTF-8 as escaped hex digits, one by one."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def escaped(values):
        return values.map(lambda b: None if b is None else bytes(b).decode("utf-8", "backslashreplace").replace("\\x", "\\u00"))

    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(escaped(raw))


def write_trials(results: DataFrame, latencies: DataFrame, path: str) -> None:
    """``results`` as JSON and as CSV rows, ``latencies`` (output_prefix, latency_us) beside them; what exists is an error."""
    flat = results.select("*", *(F.col(f"latency_us.{p}").alias(f"{p}_us") for p in ("p50", "p95", "p99", "max"))).drop("latency_us")
    results.write.mode("errorifexists").json(f"{path}/json")
    flat.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    latencies.write.mode("errorifexists").option("header", True).partitionBy("output_prefix").csv(f"{path}/latency")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results by name of file, one document a file. ``error`` says what isn't a result: a document that doesn't parse,
    a field given twice, a field unknown or missing."""
    names = [f.name for f in spark.createDataFrame([], RESULT_SCHEMA).schema]
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("output_prefix"), F.col("value").alias("document"))
    keys = F.regexp_extract_all(F.regexp_replace("document", r'(?s):\s*"(?:[^"\\]|\\.)*"', ": 0"), F.lit(r'"([^"]+)"\s*:'), F.lit(1))
    top = F.filter(keys, lambda k: ~k.isin("p50", "p95", "p99", "max"))
    parsed = raw.withColumns({"r": F.from_json("document", RESULT_SCHEMA, {"mode": "PERMISSIVE"}), "given": F.json_object_keys("document"), "top": top})
    error = (
        F.when(F.col("given").isNull(), "malformed").when(F.size(keys) != F.size(F.array_distinct(keys)), "repeated field")
        .when(F.size(F.array_except("given", F.array(*map(F.lit, names)))) > 0, "unknown field").when(F.size(F.array_except(F.array(*map(F.lit, names)), "given")) > 0, "missing field")
    )
    return parsed.select("output_prefix", "r.*", error.alias("error"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV result rows as text, with ``output_prefix`` from the file's name."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("output_prefix", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))


def read_latencies(spark: SparkSession, path: str) -> DataFrame:
    """(output_prefix, value as text) of raw latency files, without their header."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)-latency-us\.csv$", 1).alias("output_prefix"), "value")
    return lines.where("value <> 'latency_us'")


def read_contention(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("comment", "#").option("mode", "FAILFAST").schema(CONTENTION_SCHEMA).csv(path)


def resource_fields(lines: DataFrame, by: str = "file") -> DataFrame:
    """(file, field, value, error) of lines ``field=value`` or ``field: value``."""
    shape = r"^(?:([^=]*?):?=(.*)|([A-Za-z][A-Za-z0-9_]*):[ \t]*(.*))$"
    part = lambda k: F.regexp_extract("value", shape, k)
    split = F.contains(F.col("value"), F.lit("="))
    fields = lines.select(by, F.when(split, part(1)).otherwise(part(3)).alias("field"), F.when(split, part(2)).otherwise(part(4)).alias("text"), "value")
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(by, "field"))
    error = (
        F.when(~F.col("value").rlike(shape), "not a field").when(~F.col("field").rlike("^[A-Za-z][A-Za-z0-9_]*$"), "field name").when(F.trim("text") == "", "empty")
        .when(F.col("text") != F.regexp_replace("text", r"^\s+|\s+$", ""), "untrimmed").when(F.col("text").rlike(r"\p{Cntrl}"), "unprintable").when(n > 1, "repeated field")
    )
    return fields.select(by, "field", F.col("text").alias("value"), error.alias("error"))
