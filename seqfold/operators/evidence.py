"""Benchmark evidence: workloads, latency summaries, validation and comparison of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqfold.functions import u64
from seqfold.operators.changelog import assign_sequence

FACTOR = 0x9E3779B97F4A7C15


def workload(spark: SparkSession, operations: int, seed: int, keys: int, read_ratio: float) -> DataFrame:
    """(op_no, is_read, key): the deterministic mixed workload."""
    mixed = u64.times_plus(F.col("id"), FACTOR, seed)
    shifted = F.shiftrightunsigned("mixed", 20)  # 44 bits: no sign left
    number = (shifted % keys).cast("string")
    return spark.range(operations).withColumn("mixed", mixed).select(
        F.col("id").alias("op_no"), (u64.modulo(F.col("mixed"), 1_000_000) < int(read_ratio * 1_000_000)).alias("is_read"),
        F.concat(F.lit("bench-key-"), F.lpad(number, 12, "0")).alias("key"),
    )


def preload(spark: SparkSession, keys: int, warm_up: int) -> DataFrame:
    """A put of every key, then ``warm_up`` reads round robin."""
    name = lambda c: F.concat(F.lit("bench-key-"), F.lpad(c.cast("string"), 12, "0"))
    puts = spark.range(keys).select(F.col("id").alias("op_no"), F.lit("put").alias("kind"), name(F.col("id")).alias("key"))
    gets = spark.range(warm_up).select((F.col("id") + keys).alias("op_no"), F.lit("get").alias("kind"), name(F.col("id") % keys).alias("key"))
    return puts.union(gets)


def nearest_rank(value: Column | str, p: float) -> Column:
    """The value of rank max(1, ceil(p n)); nothing for no values."""
    name = value if isinstance(value, str) else None
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)") if name else F.percentile_disc(value, p)


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95"), nearest_rank(value, 0.99).alias("p99"), F.max(value).alias("max")
    )


def trial_summary(trials: DataFrame, by: list[str], ops: str, p99: str, errors: str) -> DataFrame:
    return trials.groupBy(*by).agg(
        F.count("*").alias("trials"), F.min(ops).alias("ops_min"), F.median(ops).alias("ops_median"), F.max(ops).alias("ops_max"),
        F.median(p99).alias("p99_median"), F.max(p99).alias("p99_max"), F.sum(errors).alias("errors"),
    )


def compare(summary: DataFrame, before: Column, after: Column, value: str) -> DataFrame:
    """(before, after, change_percent, multiple) of two variants in a summary."""
    both = summary.agg(F.max(F.when(before, F.col(value))).alias("before"), F.max(F.when(after, F.col(value))).alias("after"))
    return both.select("before", "after", ((F.col("after") / F.col("before") - 1) * 100).alias("change_percent"), (F.col("after") / F.col("before")).alias("multiple"))


def coverage(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """What is missing, and what wasn't expected."""
    missing = expected.select(*on).join(found.select(*on), on, "left_anti").withColumn("problem", F.lit("missing"))
    extra = found.select(*on).join(expected.select(*on), on, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.union(extra)


def repeated(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(case_order, rule) of rows that break a rule of the manifest."""
    from pyspark.sql import Window

    # Numbered over ranges of the order, so that no task holds more than its part.
    numbered = assign_sequence(manifest, ["case_order"]).withColumnRenamed("seq", "_row")
    first = numbered.where("_row = 1").select(F.col("run_id").alias("_first"))  # one row
    rated = numbered.join(F.broadcast(first)).withColumn("_same", F.count("*").over(Window.partitionBy("run_id", "experiment", "variant", "trial")))
    safe = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
    rules = F.array_compact(
        F.array(
            F.when(~F.col("status").isin("ok", "invalid", "failed", "skipped"), "status"), F.when(F.col("case_order") != F.col("_row"), "case_order"),
            F.when(F.col("_same") > 1, "repeated_case"), F.when(F.col("run_id") != F.col("_first"), "run_id"),
            F.when(~(F.col("experiment").rlike(safe) & F.col("variant").rlike(safe)), "unsafe_name"), F.when(F.col("trial") < 1, "trial"),
        )
    )
    return rated.select("case_order", F.explode(rules).alias("rule"))


def _close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal up to a share of the larger, as floating-point comparisons with a relative tolerance have it."""
    return (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


LIMIT, VALUE_BYTES, TEXT = (1 << 63) - 1, 16 << 20, 4096
POSITIVE = ("connections", "threads", "key_count", "value_size", "pipeline_depth", "server_workers", "server_shards")
NOT_NEGATIVE = ("request_bound", "duration_bound_s", "warmup_requests", "hardware_threads", "errors", "connection_errors")
TEXTS = ("host", "ram", "storage_medium", "durability", "compiler", "build", "system")


def result_violations(results: DataFrame, tolerance: float = 1e-5, by: str = "trial") -> DataFrame:
    """(by, rule) of results out of their domain. Rules about columns that ``results`` doesn't have aren't checked.

    ``p50``, ``p95``, ``p99`` and ``max`` stand for the fields of ``latency_us``. Numbers beyond a long don't get here.
    """
    c, have = F.col, set(results.columns)
    ordered = ("p50", "p95", "p99", "max")
    rules = [
        *(({n}, n, c(n) <= 0) for n in POSITIVE), *(({n}, n, c(n) < 0) for n in NOT_NEGATIVE), ({"value_size"}, "value_size_limit", c("value_size") > VALUE_BYTES),
        ({"threads", "connections"}, "threads_over_connections", c("threads") > c("connections")), ({"port"}, "port", ~c("port").between(1, 65535)),
        ({"request_bound", "duration_bound_s"}, "no_bound", (c("request_bound") == 0) & (c("duration_bound_s") == 0)),
        ({"read_ratio"}, "read_ratio", F.isnan("read_ratio") | ~c("read_ratio").between(0, 1)), ({"preload", "warmup_requests"}, "warmup_without_preload", ~c("preload") & (c("warmup_requests") != 0)),
        ({"preload", "key_count", "warmup_requests", "request_bound"}, "request_ids", F.coalesce(F.try_add(F.when(c("preload"), F.try_add("key_count", "warmup_requests")).otherwise(0), c("request_bound")).isNull(), F.lit(True))),
        *(({n}, n, F.coalesce(c(n), F.lit("")).rlike(r"^\s|\s$|^$|\p{Cntrl}") | (F.length(n) > TEXT)) for n in TEXTS),
        ({"durability"}, "durability_kind", ~c("durability").isin("unspecified", "always", "periodic", "none")),
        ({"operations"}, "operations", c("operations") <= 0), ({"seconds"}, "seconds", F.isnan(c("seconds").cast("double")) | (c("seconds") <= 0) | (c("seconds") > LIMIT)),
        ({"operations", "seconds", "ops_per_second"}, "throughput", (c("seconds") > 0) & ~_close(c("ops_per_second"), c("operations") / F.nullif(c("seconds"), F.lit(0)), tolerance)),
        ({"operations", "request_bound"}, "operations_over_bound", (c("request_bound") > 0) & (c("operations") > c("request_bound"))),
        *(({n}, n, F.isnan(c(n).cast("double")) | (c(n) < 0) | (c(n) == float("inf"))) for n in ("ops_per_second", *ordered)),
        (set(ordered), "percentile_order", ~((c("p50") <= c("p95")) & (c("p95") <= c("p99")) & (c("p99") <= c("max")))),
        ({"timestamp_utc"}, "timestamp_utc", F.coalesce(F.date_format(F.try_to_timestamp("timestamp_utc", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), "yyyy-MM-dd'T'HH:mm:ss'Z'") != c("timestamp_utc"), F.lit(True))),
        ({"git_sha"}, "git_sha", ~c("git_sha").rlike("^[0-9a-f]{40}$")), ({"errors", "operations"}, "errors_over_operations", c("errors") > c("operations")),
        ({"connection_errors", "threads"}, "connection_errors_over_threads", c("connection_errors") > c("threads")),
    ]
    used = [(name, test) for need, name, test in rules if need <= have]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), name) for name, test in used)))
    return results.select(by, F.explode(F.array_distinct(broken)).alias("rule"))


def differing_fields(rows: DataFrame, results: DataFrame, on: str, exact: dict[str, str], whole: dict[str, str], numbers: dict[str, str], tolerance: float = 1e-5) -> DataFrame:
    """(on, field) where the text of a CSV row doesn't say what the result says, or one of the two isn't there.

    Each dict maps a column of ``rows`` to one of ``results``: texts equal as they are, whole numbers without leading
    zeros or signs, numbers without white space and equal up to ``tolerance``.
    """
    left = rows.select(F.col(on).alias("_a"), *(F.col(n).alias(f"a_{n}") for n in [*exact, *whole, *numbers]))
    right = results.select(F.col(on).alias("_b"), *(F.col(m).alias(f"b_{n}") for n, m in {**exact, **whole, **numbers}.items()))
    both = left.join(right, F.col("_a") == F.col("_b"), "full")
    number = lambda n: F.when(F.col(f"a_{n}").rlike(r"^[^\s].*[^\s]$|^[^\s]$"), F.expr(f"try_cast(`a_{n}` AS double)"))
    tests = [
        *((n, F.col(f"a_{n}") == F.col(f"b_{n}").cast("string")) for n in exact),
        *((n, F.col(f"a_{n}").rlike("^(0|[1-9][0-9]*)$") & (F.expr(f"try_cast(`a_{n}` AS decimal(38,0))") == F.col(f"b_{n}").cast("long"))) for n in whole),
        *((n, _close(number(n), F.col(f"b_{n}").cast("double"), tolerance)) for n in numbers),
    ]
    missing = F.array_compact(F.array(F.when(F.col("_b").isNull(), "(no result)"), F.when(F.col("_a").isNull(), "(no row)")))
    fields = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), n) for n, test in tests)))
    return both.select(F.coalesce("_a", "_b").alias(on), F.explode(F.when(F.size(missing) > 0, missing).otherwise(fields)).alias("field"))


def recomputed(samples: DataFrame, results: DataFrame, on: str, value: str, tolerance: float = 1e-5) -> DataFrame:
    """(on, field) of results whose operations, p50, p95, p99 or max aren't those of the raw samples."""
    found = latency_summary(samples, [on], value).select(F.col(on).alias("_on"), F.col("n"), *(F.col(p).alias(f"_{p}") for p in ("p50", "p95", "p99", "max")))
    joined = results.join(found, results[on] == found["_on"], "left")
    tests = [("operations", F.col("n") == F.col("operations")), *((p, _close(F.col(f"_{p}"), F.col(p), tolerance)) for p in ("p50", "p95", "p99", "max"))]
    fields = F.array_compact(F.array(*(F.when(~F.coalesce(t, F.lit(False)), n) for n, t in tests)))
    return joined.select(on, F.explode(F.when(F.col("_on").isNull(), F.array(F.lit("(no samples)"))).otherwise(fields)).alias("field"))


def contention(spark: SparkSession, threads: int, operations: int, keys: int, same_key: bool) -> DataFrame:
    """(thread, op_no, kind, key): a tenth of each thread's operations replace, the others find."""
    number = F.lit(0).cast("long") if same_key else (F.col("thread") * 1009 + F.col("op_no") * 17) % keys
    each = spark.range(threads * operations).select(F.floor(F.col("id") / operations).alias("thread"), (F.col("id") % operations).alias("op_no"))
    return each.select("thread", "op_no", F.when(F.col("op_no") % 10 == 0, "replace").otherwise("find").alias("kind"), F.concat(F.lit("contention-key-"), number.cast("string")).alias("key"))


def contention_violations(rows: DataFrame, shards: list[int], threads: int, keys: int, operations_per_thread: int, repetitions: int, tolerance: float = 1e-4) -> DataFrame:
    """(workload, shards, repetition, rule): rows out of their domain, runs that repeat, are missing or weren't asked for."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    run = ["workload", "shards", "repetition"]
    wanted = spark.createDataFrame([(w, s, r) for w in ("same-key", "distributed-key") for s in shards for r in range(1, repetitions + 1)], "workload string, shards long, repetition long")
    bad = lambda n: F.isnan(F.col(n)) | (F.col(n) <= 0) | (F.col(n) == float("inf"))
    rules = [
        ("workload", ~F.col("workload").isin("same-key", "distributed-key")), ("configuration", (F.col("threads") != threads) | (F.col("keys") != keys)),
        ("operations", F.col("operations") != threads * operations_per_thread), ("seconds", bad("seconds")), ("ops_per_second", bad("ops_per_second")), ("checksum", F.col("checksum") < 0),
        ("throughput", ~bad("seconds") & ~_close(F.col("ops_per_second"), F.col("operations") / F.nullif(F.col("seconds"), F.lit(0.0)), tolerance)), ("repeated", F.col("_n") > 1),
    ]
    rated = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*run)))
    own = rated.select(*run, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), n) for n, t in rules)))).alias("rule"))
    return own.union(coverage(wanted, rows.select(*run).distinct(), run).withColumnRenamed("problem", "rule")).distinct()


def within(results: DataFrame, captures: DataFrame, on: str, limit_s: int = 300) -> DataFrame:
    """Results with a capture of the same ``on`` no earlier and at most ``limit_s`` later."""
    c = captures.select(F.col(on).alias("_on"), F.col("ts").alias("captured"), *(x for x in captures.columns if x not in (on, "ts")))
    return results.join(c, (results[on] == c["_on"]) & F.col("captured").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {limit_s} SECONDS"))).drop("_on")


def matrix(spark: SparkSession, centre: dict[str, str], axes: dict[str, list[str]], trials: int) -> DataFrame:
    """(experiment, variant, trial, settings): sweeps of each axis around a centre."""
    rows = [(axis, value, dict(centre, **{axis: value})) for axis, values in axes.items() for value in values]
    base = spark.createDataFrame(rows, "experiment string, variant string, settings map<string,string>")
    return base.select("experiment", "variant", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), "settings")


def overload_checks(runs: DataFrame, slack: int = 2) -> DataFrame:
    """Seven assertions of an overload run, one boolean column each, and whether all hold."""
    bound = lambda peak, base: F.col(peak) <= F.col(base) + F.col("connection_cap") + slack
    checks = {
        "all_excess_rejected": F.col("rejected") == F.col("excess"), "no_excess_served": F.col("excess_served") == 0, "threads_bounded": bound("threads_peak", "threads_base"),
        "fds_bounded": bound("fds_peak", "fds_base"), "recovered": F.col("recovered"), "threads_near_base": F.col("threads_end") <= F.col("threads_base") + slack,
        "fds_near_base": F.col("fds_end") <= F.col("fds_base") + slack,
    }
    return runs.select("run", *(t.alias(n) for n, t in checks.items())).withColumn("passed", F.expr(" AND ".join(checks)))


PROC_FIELDS = ("VmRSS", "VmHWM", "VmPeak", "Threads")


def proc_status(lines: DataFrame, by: str = "pid") -> DataFrame:
    """(pid, VmRSS, VmHWM, VmPeak, Threads, missing) from the lines of process status texts; the first number counts."""
    parts = lines.select(by, F.regexp_extract("value", r"^(\w+):\s*(\d+)", 1).alias("field"), F.regexp_extract("value", r"^(\w+):\s*(\d+)", 2).alias("number"))
    out = parts.groupBy(by).agg(*(F.max(F.when(F.col("field") == n, F.col("number").cast("long"))).alias(n) for n in PROC_FIELDS))
    return out.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in PROC_FIELDS))))
