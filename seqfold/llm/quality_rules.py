"""Document rules and host verdicts: rule failures by host, shrunk by an empirical beta prior.

Native: built-in functions only.

A document fails a rule by its own text. For each host (``source``) and rule, the failure rate is shrunk towards
all hosts by a beta prior fitted to the hosts by moments; a host with a shrunk rate over ``HOST_LIMIT`` for any
rule is rejected with all its documents. A document is kept if it passes every rule and its host isn't rejected.

Defined results: a null text has no words and fails the length rule; documents without a host form one host of
their own; repeated rows are judged one by one; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common
from .common import let

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: More symbols than this per hundred words, or more repeated lines than this per hundred lines with words.
SYMBOL_PERCENT = 30
DUP_LINE_PERCENT = 50
HOST_LIMIT = 0.5
#: Rejected hosts up to which their names are broadcast.
BROADCAST_HOSTS = 100_000
#: Parts of a host where rejected hosts are too many to broadcast.
SALTS = 64
RULES = ("short", "repetitive", "symbols", "dup_lines")


def repeat_words(words: Column) -> Column:
    """Number of words inside a three-word window that occurs twice or more in the array."""

    def covered(windows: Column) -> Column:
        def count(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            hits = F.filter(
                ordered,
                lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["w"] == x["w"])) | ((k < last) & (F.get(ordered, k + 1)["w"] == x["w"])),
            )
            starts = F.sort_array(F.transform(hits, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
                lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), count)
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(
            F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
            covered,
        )
    )


def measures(text: Column) -> Column:
    """The measures of a text as a struct of longs."""
    has_word = rf"[^\x20\x09-\x0D]"

    def of(t: Column) -> Column:
        bare = F.translate(t, common.BLANKS, "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word))
        return F.struct(
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            let(common.words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("rep"))).alias("words"),
        )

    return let(F.coalesce(text, F.lit("")), of)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, measures, one flag per rule, base_failed) of every row."""
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m"))
    flat = m.select(
        "doc_id", "host", F.col("m.words.n").alias("n_words"), "m.word_chars", "m.n_symbols",
        F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.words.rep").alias("n_repeat_words"), F.col("m.lines.n").alias("n_lines"),
    )
    return flat.select("*", *rule_flags())


def rule_flags() -> list[Column]:
    n = F.col("n_words")
    short, repetitive = n < MIN_WORDS, 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n
    return [
        short.alias("short"),
        repetitive.alias("repetitive"),
        (100 * F.col("n_symbols") > SYMBOL_PERCENT * n).alias("symbols"),
        (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines")).alias("dup_lines"),
        (short | repetitive).alias("base_failed"),
    ]


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, <rule>_rate, host_rejected): shrunk failure rates of each host.

    With pooled rate m and between-host variance v (that of the raw rates, less the sampling variance expected
    within hosts), the prior is Beta(m k, (1 - m) k), k = m (1 - m) / v - 1, held to [1, 1000].
    """
    counts = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    pooled = counts.agg(
        *(F.try_divide(F.sum(r), F.sum("n")).cast("double").alias(f"m_{r}") for r in RULES),
        *(F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in RULES),
        F.avg(1.0 / F.col("n")).alias("inverse"),
    )
    # One row of pooled figures joins the hosts: its size doesn't depend on the data.
    rated = counts.join(F.broadcast(pooled))
    for r in RULES:
        spread = F.col(f"m_{r}") * (1 - F.col(f"m_{r}"))
        between = F.col(f"v_{r}") - spread * F.col("inverse")
        k = F.when(between > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), spread / between - 1))).otherwise(1000.0)
        rated = rated.withColumn(f"{r}_rate", (F.col(r) + F.col(f"m_{r}") * k) / (F.col("n") + k))
    return rated.select("host", F.col("n").alias("n_docs"), *(f"{r}_rate" for r in RULES), F.greatest(*(F.col(f"{r}_rate") for r in RULES)).__gt__(limit).alias("host_rejected"))


def without_rejected(rows: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """``rows`` whose host isn't rejected.

    Rejected hosts alone are joined: by broadcast while they are few, else in ``SALTS`` parts of each host, so that a
    host with a third of all rows isn't one task's.
    """
    rejected = verdicts.where("host_rejected").select(F.col("host").alias("rejected_host"))
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(rejected), F.col(host).eqNullSafe(F.col("rejected_host")), "left_anti")
    side = rejected.withColumn("rejected_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("own_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return salted.join(side, F.col(host).eqNullSafe(F.col("rejected_host")) & (F.col("own_salt") == F.col("rejected_salt")), "left_anti").drop("own_salt")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = common.cut(judge(common.table(spark, sf_dir, "documents")))
    verdicts = common.cut(host_verdicts(judged))
    good = "NOT (base_failed OR symbols OR dup_lines)"
    passed = without_rejected(judged.where(good), verdicts, "host").withColumn("kept", F.lit(True))
    failed = judged.where(f"NOT ({good})").withColumn("kept", F.lit(False))
    # Those of rejected hosts: what passes its own rules and isn't in ``passed``.
    few = verdicts.where("host_rejected").select(F.col("host").alias("rejected_host"))
    few = F.broadcast(few) if few.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else few
    rejected = judged.where(good).join(few, F.col("host").eqNullSafe(F.col("rejected_host")), "left_semi").withColumn("kept", F.lit(False))
    return passed.unionByName(failed).unionByName(rejected).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def failures(text: Column) -> Column:
    """The rules of ``RULES`` that a text fails, as the bits of one number."""

    def of(m: Column) -> Column:
        n, long = m["words"]["n"], F.lit(0).cast("long")
        tests = (n < MIN_WORDS, 100 * m["words"]["rep"] > REPEAT_PERCENT * n, 100 * m["n_symbols"] > SYMBOL_PERCENT * n, 100 * m["lines"]["dup"] > DUP_LINE_PERCENT * m["lines"]["n"])
        return sum((F.when(t, F.lit(1 << k).cast("long")).otherwise(long) for k, t in enumerate(tests)), long)

    return let(measures(text), of)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, all their columns. While rejected hosts are few the texts never leave their tasks.

    Measures are taken for the hosts first and again beside the text, as one number each time, so that no plan takes
    them once per use.
    """
    marked = docs.select(F.col("source").alias("host"), failures(F.col("text")).alias("failed"))
    bits = marked.select("host", *((F.shiftright("failed", k).bitwiseAND(1) == 1).alias(r) for k, r in enumerate(RULES)))
    verdicts = common.cut(host_verdicts(bits))
    boxed = docs.where(failures(F.col("text")) == 0).select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("host"))
    return without_rejected(boxed, verdicts, "host").select("doc.*")


SQL = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines, t FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT rid, unnest(lines) AS x FROM w)
       WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, d.host, CAST(len(w.words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(ln.n, 0) AS n_lines
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} AS short, 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS repetitive,
        100 * n_symbols > {SYMBOL_PERCENT} * n_words AS symbols, 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines AS dup_lines FROM m),
c AS (SELECT host, count(*) AS n, {', '.join(f'sum(CAST({r} AS INT)) AS {r}' for r in RULES)} FROM j GROUP BY host),
p AS (SELECT avg(1.0 / n) AS inverse, {', '.join(f'sum({r}) / sum(n) AS m_{r}, var_pop({r} / n) AS v_{r}' for r in RULES)} FROM c),
k AS (SELECT p.*, {', '.join(f'CASE WHEN v_{r} - m_{r} * (1 - m_{r}) * inverse > 0 THEN least(1000.0, greatest(1.0, m_{r} * (1 - m_{r}) / (v_{r} - m_{r} * (1 - m_{r}) * inverse) - 1)) ELSE 1000.0 END AS k_{r}' for r in RULES)} FROM p),
h AS (SELECT host, greatest({', '.join(f'({r} + m_{r} * k_{r}) / (n + k_{r})' for r in RULES)}) > {HOST_LIMIT} AS host_rejected FROM c, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repetitive) AS base_failed,
  NOT (short OR repetitive OR symbols OR dup_lines OR host_rejected) AS kept
FROM j JOIN h ON j.host IS NOT DISTINCT FROM h.host"""
