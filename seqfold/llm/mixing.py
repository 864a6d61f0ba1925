"""Mixing sources to target weights: hierarchical budgets, then a seeded token-prefix of each leaf.

Native: built-in functions only.

The tree is domain > language > source. A node's capacity is that of its leaves, each of which can give its own
tokens ``MAX_EPOCHS`` times. The total budget goes from the root down: at each node it is divided among the
children by weight, a child that can't take its part gives the rest to its siblings, and only what the whole family
can't take was passed to the parent's siblings before (capacities are added up first, so one pass down suffices).

A leaf takes whole epochs while its budget lasts and the last one in part: the documents of an epoch come in the
order of a hash of seed, epoch and id, and the longest prefix whose tokens fit is taken. No leaf is sorted in one
task: 16^3 ranges of the hash are summed first, whole ranges are taken or left, and only the range in which the
budget ends is ordered by itself.

Defined results: tokens are white-space words; a null text has none; documents without tokens are taken with every
full epoch and, within the last, if they come before the cut; null languages, sources or ids are values of their
own; repeated rows come in the same place of the order, as ties: they are taken together or not at all; a tree
without weight for a leaf gives it none; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

SEED = "mix-1"
MAX_EPOCHS = 2
#: Share of all tokens that the mixture holds.
BUDGET = 0.6
#: Target weights. Domains are families of sources, by the number in their name; sources in a family weigh alike.
DOMAIN_WEIGHTS = {0: 4, 1: 3, 2: 2, 3: 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
OTHER_LANG_WEIGHT = 1
RANGE_DIGITS = 3


def default_tree(docs: DataFrame) -> DataFrame:
    """``docs`` with domain and the weights of the three levels."""
    number = F.coalesce(F.try_element_at(F.regexp_extract_all("source", F.lit(r"([0-9]{1,9})$"), 1), F.lit(1)).cast("long"), F.lit(0))
    domain = (number % len(DOMAIN_WEIGHTS)).cast("int")
    weigh = lambda value, weights, other: F.coalesce(*(F.when(value == k, float(w)) for k, w in weights.items()), F.lit(float(other)))
    return docs.withColumns({"domain": domain, "domain_weight": weigh(domain, DOMAIN_WEIGHTS, 0), "lang_weight": weigh(F.col("lang"), LANG_WEIGHTS, OTHER_LANG_WEIGHT), "source_weight": F.lit(1.0)})


LEVELS = ("domain", "lang", "source")


def _fill(nodes: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """Divide ``budget`` (of the parent) among the rows by ``weight``, none above ``capacity``.

    In the order of capacity over weight the first children are filled; the first whose fair part of what is left
    fits below its capacity sets the level for all that follow.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("ratio"), F.col(name).asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    family = Window.partitionBy(*parents)
    rated = nodes.withColumn("w", weight).where("w > 0").withColumn("ratio", F.col("capacity") / F.col("w"))
    rated = rated.withColumn("level", (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("w").over(after))
    rated = rated.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(family))
    return rated.withColumn("budget", F.when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("w") * F.col("level")))).drop("w", "ratio", "level", "capacity")


def budgets(leaves: DataFrame, share: float = BUDGET, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, weights, tokens) of each leaf."""
    sized = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    total = leaves.agg((F.sum("tokens") * F.lit(share)).cast("double").alias("budget"))
    top = sized.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("domain_weight").alias("domain_weight"))
    top = _fill(top.join(F.broadcast(total)).withColumn("root", F.lit(0)), ["root"], "domain", F.col("domain_weight")).select(F.col("domain").alias("d"), "budget")
    mid = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("lang_weight").alias("lang_weight"))
    mid = _fill(mid.join(top, F.col("domain").eqNullSafe(F.col("d"))).drop("d"), ["domain"], "lang", F.col("lang_weight")).select(F.col("domain").alias("d"), F.col("lang").alias("g"), "budget")
    low = sized.join(mid, F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("g"))).drop("d", "g")
    return _fill(low, ["domain", "lang"], "source", F.col("source_weight")).select("domain", "lang", "source", "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def select(docs: DataFrame, share: float = BUDGET, epochs: int = MAX_EPOCHS, seed: str = SEED, tree=default_tree) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs): how often each document is taken; those taken never, not."""
    sized = tree(docs.select("doc_id", "lang", "source", "text")).withColumn("n_tokens", F.size(common.words_of(F.col("text"))).cast("long")).drop("text")
    sized = common.cut(sized)
    leaves = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), *(F.max(f"{x}_weight").alias(f"{x}_weight") for x in LEVELS))
    plan = common.cut(
        budgets(leaves, share, epochs).where("budget > 0").select(
            F.col("domain").alias("b_domain"), F.col("lang").alias("b_lang"), F.col("source").alias("b_source"),
            F.expr("CAST(budget DIV tokens AS INT)").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"),
        )
    )
    few = plan.limit(100_001).count() <= 100_000
    same = F.col("domain").eqNullSafe(F.col("b_domain")) & F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
    leaf = ["b_domain", "b_lang", "b_source"]
    drawn = sized.join(F.broadcast(plan) if few else plan, same).withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    drawn = drawn.withColumn("range", F.substring("draw", 1, RANGE_DIGITS))
    sums = drawn.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("t"))
    up_to = Window.partitionBy(*leaf).orderBy("range")
    placed = sums.withColumn("before", F.sum("t").over(up_to) - F.col("t")).select(*(F.col(c).alias(f"r_{c}") for c in [*leaf, "range"]), "before", "t")
    here = F.col("range") == F.col("r_range")
    for c in leaf:
        here = here & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    ranged = drawn.join(placed, here).drop(*(f"r_{c}" for c in [*leaf, "range"]))
    inside = F.col("before") + F.col("t") <= F.col("rest")
    edge = ~inside & (F.col("before") <= F.col("rest"))
    order = Window.partitionBy(*leaf, "range").orderBy("draw")  # ties: a range frame takes equal draws together
    settled = ranged.where(~edge).withColumn("times", F.col("whole") + inside.cast("int"))
    cutting = ranged.where(edge).withColumn("times", F.col("whole") + (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("int"))
    return settled.unionByName(cutting).where("times > 0").select("doc_id", "domain", "lang", "source", "n_tokens", F.col("times").alias("epochs"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(common.table(spark, sf_dir, "documents"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each epoch in which a document is taken."""
    times = common.cut(select(docs, **settings).select(F.col("doc_id").alias("taken_id"), "epochs").distinct())
    boxed = docs.select("doc_id", F.struct(*docs.columns).alias("doc"))
    taken = boxed.join(times, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("doc.*")


def _sql_fill(name: str, source: str, parents: str, key: str, weight: str, keep: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    both = f"{part} ORDER BY capacity / {weight}, {key} NULLS FIRST"
    return f"""{name}_l AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({both} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum({weight}) OVER ({both} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {source} WHERE {weight} > 0),
{name} AS (SELECT {keep}, CASE WHEN lv IS NULL THEN capacity ELSE least(capacity, {weight} * lv) END AS budget FROM (
    SELECT *, max(CASE WHEN capacity / {weight} >= lev THEN lev END) OVER ({part}) AS lv FROM {name}_l))"""


_CASES = "CASE {} " + "{} ELSE {} END"
SQL = f"""WITH s AS (SELECT doc_id, lang, source, coalesce(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % {len(DOMAIN_WEIGHTS)} AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {MAX_EPOCHS} AS capacity,
    {_CASES.format('domain', ' '.join(f'WHEN {k} THEN {w}.0' for k, w in DOMAIN_WEIGHTS.items()), '0.0')} AS dw,
    {_CASES.format('lang', ' '.join(f"WHEN '{k}' THEN {w}.0" for k, w in LANG_WEIGHTS.items()), f'{OTHER_LANG_WEIGHT}.0')} AS lw, 1.0 AS sw FROM s GROUP BY domain, lang, source),
a AS (SELECT domain, sum(capacity) AS capacity, max(dw) AS dw, (SELECT CAST(sum(tokens) * {BUDGET} AS DOUBLE) FROM leaf) AS budget FROM leaf GROUP BY domain),
{_sql_fill('a2', 'a', '', 'domain', 'CAST(dw AS DOUBLE)', 'domain')},
b AS (SELECT leaf.domain, lang, sum(capacity) AS capacity, max(lw) AS lw, any_value(budget) AS budget FROM leaf JOIN a2 ON leaf.domain = a2.domain GROUP BY leaf.domain, lang),
{_sql_fill('b2', 'b', 'domain', 'lang', 'CAST(lw AS DOUBLE)', 'domain, lang')},
c AS (SELECT leaf.*, b2.budget FROM leaf JOIN b2 ON leaf.domain = b2.domain AND leaf.lang IS NOT DISTINCT FROM b2.lang),
{_sql_fill('c2', 'c', 'domain, lang', 'source', 'CAST(sw AS DOUBLE)', 'domain, lang, source, tokens')},
p AS (SELECT domain, lang, source, CAST(floor(budget + 1e-6) AS BIGINT) // tokens AS whole, CAST(floor(budget + 1e-6) AS BIGINT) % tokens AS rest FROM c2 WHERE floor(budget + 1e-6) > 0),
o AS (SELECT s.*, whole, rest, sum(n_tokens) OVER (PARTITION BY s.domain, s.lang, s.source ORDER BY md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS upto
    FROM s JOIN p ON s.domain = p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(domain AS INT) AS domain, lang, source, n_tokens, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INT) AS epochs FROM o
WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
