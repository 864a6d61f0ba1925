"""Near-duplicate lines across all documents, by a deletion-neighbourhood join.

Native: built-in functions only.

Two lines are alike if one word inserted, deleted or replaced turns one into the other, or none (``MAX_EDITS`` = 1,
over words). A line goes if an earlier line (by document id, then line number) is like it; earlier lines count
whether or not they go themselves.

Equal lines are one entry from the start. By the pigeonhole rule, lines one edit apart agree in their first or their
last half, so lines whose halves occur once leave the search. The others emit every variant with one word deleted,
and the whole line, as hashed keys. Lines that lost a word at the same place and agree are one replacement apart; a
whole line that equals another's variant is one insertion apart. Per key only the earliest line is needed, so no
pairs within a group are made; the pair with the earliest is then verified word by word.

Defined results: lines with fewer than ``MIN_WORDS`` words are alike only if they are equal, as one word in so few
makes another line; blank lines always stay; white space within a line doesn't count; a
null text stays null and has no lines; a document that loses all lines stays with an empty text; rows without an id
are passed on unchanged; rows that share an id are one document, from which a line number is removed as a whole; an
empty table gives an empty one; columns named like those added (``dedup``: n_lines, n_removed) are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common
from .common import let

MIN_WORDS = 5


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at, h1, h2, k2) of every line with a word: where it is, and its hashes.

    From ``MIN_WORDS`` words on, h1 and h2 are those of its halves. A line meets any line one word apart by one of
    three halves: of its own length, or as the longer of the two (k2). Shorter lines have no halves and a null k2.
    """
    spaced = F.col("text")
    for blank in common.BLANKS[1:].replace("\n", ""):
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split(spaced, "\n")).alias("at", "line"))
    # Blank lines go by the line itself: a filter on what is made of it would be pushed below and make it twice.
    rows = rows.where(F.trim("line") != "").select("doc_id", "at", F.array_remove(F.split("line", " "), "").alias("w"))
    w, n = F.col("w"), F.size("w")
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    # The number comes first: the hash of several values is chained.
    first = lambda size: F.xxhash64(F.lit("first"), size, F.slice(w, 1, size))
    last = lambda size: F.xxhash64(F.lit("last"), size, F.slice(w, n - size + 1, size))
    # Odd lengths: the first halves coincide; even ones: the last halves do.
    other = F.when(n % 2 == 1, last(n - 1 - less)).otherwise(first(less))
    long = n >= MIN_WORDS
    h1, h2 = F.when(long, first(half)).otherwise(F.xxhash64(w)), F.when(long, last(n - half)).otherwise(F.xxhash64(F.lit(1), w))
    return rows.select("doc_id", "at", h1.alias("h1"), h2.alias("h2"), F.when(long, other).alias("k2"))


def _variants(words: Column) -> Column:
    """Hashes of a line (its words' hashes given): of the whole, then without word 0, 1, ...

    A line's hash is the exclusive-or of its words' hashes with their places. Without word p, words before it keep
    their places and words after it move up by one, so each variant follows from the one before it.
    """

    def of(kept: Column, moved: Column) -> Column:
        fold = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(h))
        steps = F.slice(F.transform(kept, lambda h, i: h.bitwiseXOR(F.coalesce(F.get(moved, i + 1), F.lit(0).cast("long")))), 1, F.size(kept) - 1)
        start = F.struct(fold(moved).bitwiseXOR(F.get(moved, 0)).alias("h"))
        return let(
            start["h"],
            lambda first: F.aggregate(
                steps,
                F.struct(first.alias("h"), F.array(fold(kept), first).alias("all")),
                lambda s, x: F.struct(s["h"].bitwiseXOR(x).alias("h"), F.concat(s["all"], F.array(s["h"].bitwiseXOR(x))).alias("all")),
                lambda s: s["all"],
            ),
        )

    return let(
        F.struct(F.transform(words, lambda h, i: F.xxhash64(h, i)).alias("kept"), F.transform(words, lambda h, i: F.xxhash64(h, i - 1)).alias("moved")),
        lambda x: of(x["kept"], x["moved"]),
    )


def _agree(a: Column, b: Column) -> Column:
    """One word's edit or less: the common beginning and end leave at most one word of the longer line."""
    head = lambda x, y: let(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int"), lambda at: F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (head(a, b) + head(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at): every line that goes."""
    place = F.struct("doc_id", "at")
    # Equal lines share their halves: one entry per distinct line, at its earliest place.
    every = common.cut(_lines(docs))
    distinct = common.cut(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("k2").alias("k2")))
    halves = distinct.where("k2 IS NOT NULL").select("first", F.explode(F.array("h1", "h2", "k2")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    near = halves.join(shared, F.col("key") == F.col("k"), "left_semi").groupBy("first.doc_id").agg(F.collect_set("first.at").alias("ats"))
    near = common.cut(near.select(F.col("doc_id").alias("near_id"), "ats"))
    # The texts of the lines that are left, from their documents.
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    found = common.in_ids(texts, "doc_id", near.select("near_id")).join(near, F.col("doc_id") == F.col("near_id"))
    lines = found.select("doc_id", let(F.split("text", "\n"), lambda x: F.transform("ats", lambda i: F.struct(i.alias("at"), common.words_of(F.get(x, i)).alias("words")))).alias("lines"))
    lines = lines.select("doc_id", F.explode("lines").alias("x")).select(F.struct("doc_id", "x.at").alias("place"), "x.words").where(F.size("words") >= MIN_WORDS)
    lines = common.cut(lines.groupBy("place").agg(F.min("words").alias("words")))
    keys = lines.select("place", F.posexplode(let(_word_hashes(F.col("words")), _variants)).alias("number", "h"))
    keys = keys.select(F.col("place.doc_id").alias("d"), F.col("place.at").alias("a"), (F.col("number") - 1).alias("gap"), "h")
    # Keys that occur once are the bulk: they go by their hashes alone, before any place is shuffled.
    common_keys = keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("common_h"))
    keys = common.cut(keys.join(common_keys, F.col("h") == F.col("common_h"), "left_semi").select(F.struct(F.col("d").alias("doc_id"), F.col("a").alias("at")).alias("place"), "gap", "h"))
    replaced = keys.where("gap >= 0").groupBy("h", "gap").agg(F.min("place").alias("early"), F.count("*").alias("n")).where("n > 1")
    inserted = keys.groupBy("h").agg(F.min(F.when(F.col("gap") < 0, F.col("place"))).alias("short"), F.min(F.when(F.col("gap") >= 0, F.col("place"))).alias("long")).where("short IS NOT NULL AND long IS NOT NULL")
    r = replaced.select(F.col("h").alias("r_h"), F.col("gap").alias("r_gap"), "early")
    s = inserted.select(F.col("h").alias("r_h"), "short", "long")
    by_replacement = keys.join(r, (F.col("h") == F.col("r_h")) & (F.col("gap") == F.col("r_gap"))).select("place", "early")
    by_insertion = keys.join(s, F.col("h") == F.col("r_h")).select("place", F.when(F.col("gap") < 0, F.col("long")).otherwise(F.col("short")).alias("early"))
    pairs = by_replacement.union(by_insertion).where("early < place").distinct()
    left, right = lines.select(F.col("place").alias("p1"), F.col("words").alias("w1")), lines.select(F.col("place").alias("p2"), F.col("words").alias("w2"))
    verified = pairs.join(left, F.col("place") == F.col("p1")).join(right, F.col("early") == F.col("p2")).where(_agree(F.col("w1"), F.col("w2")))
    gone = verified.select("place").distinct().withColumn("gone", F.lit(True)).withColumnRenamed("place", "gone_at")
    # Equal lines share the verdict of the earliest; otherwise all but the earliest go.
    judged = distinct.join(gone, F.col("first") == F.col("gone_at"), "left").where("n > 1 OR gone").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", "gone")
    return every.join(judged, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(F.coalesce("gone", F.lit(False)) | (place != F.col("first"))).select("doc_id", "at")


def _cleaned(docs: DataFrame) -> DataFrame:
    """(doc, text, n_lines, n_removed): each row of ``docs`` but its text, and the text without the lines removed."""
    gone = common.cut(removed_lines(docs).groupBy("doc_id").agg(F.collect_set("at").alias("gone_ats")).withColumnRenamed("doc_id", "gone_id"))
    boxed = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("doc"))
    whole = boxed.withColumn("gone_ats", F.lit(None).cast("array<int>"))
    ids = gone.select("gone_id")
    if ids.limit(500_001).count() > 500_000:
        return _without(boxed.join(gone, F.col("doc_id") == F.col("gone_id"), "left").drop("gone_id"))
    # Few enough to broadcast (8 bytes each): only the texts that change are shuffled.
    side = F.broadcast(ids.withColumnRenamed("gone_id", "hit_id"))
    changed = boxed.join(side, F.col("doc_id") == F.col("hit_id"), "left_semi").join(gone, F.col("doc_id") == F.col("gone_id")).drop("gone_id")
    return _without(changed).unionByName(_without(whole.join(side, F.col("doc_id") == F.col("hit_id"), "left_anti")))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines removed from ``text``, and n_lines and n_removed beside its other columns."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _cleaned(docs).select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names), "n_lines", "n_removed")


def _without(joined: DataFrame) -> DataFrame:
    """(doc, text, n_lines, n_removed) from (doc, text, gone_ats)."""
    rest = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone_ats")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("gone_ats").isNull(), F.col("text")).otherwise(rest)
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.select("doc", text.alias("text"), n_lines.alias("n_lines"), F.when(F.col("gone_ats").isNull(), 0).otherwise(F.size("gone_ats")).cast("long").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines removed and ``n_chars`` brought up to date; all other columns as they are."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return _cleaned(docs).select(*(new.get(c, F.col(f"doc.`{c}`").alias(c)) for c in docs.columns))


SQL = rf"""WITH l AS (SELECT doc_id, i - 1 AS pos, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM (
    SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a, a[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL))),
k AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) > 0),
u AS (SELECT s, any_value(w) AS w, min((doc_id, pos)) AS f, count(*) AS n FROM k GROUP BY s),
long AS (SELECT * FROM u WHERE len(w) >= {MIN_WORDS}),
v AS (SELECT f, gap, array_to_string(list_concat(w[1:gap - 1], w[gap + 1:]), ' ') AS d FROM (SELECT f, w, unnest(range(1, len(w) + 1)) AS gap FROM long)),
gone AS (SELECT v.f FROM v JOIN (SELECT d, gap, min(f) AS e FROM v GROUP BY d, gap HAVING count(*) > 1) g ON v.d = g.d AND v.gap = g.gap WHERE g.e < v.f
  UNION SELECT v.f FROM v JOIN long u ON v.d = u.s WHERE u.f < v.f
  UNION SELECT u.f FROM v JOIN long u ON v.d = u.s WHERE v.f < u.f),
r AS (SELECT k.doc_id, list(DISTINCT k.pos) AS ats FROM k JOIN u ON k.s = u.s LEFT JOIN gone ON u.f = gone.f
  WHERE gone.f IS NOT NULL OR (k.doc_id, k.pos) <> u.f GROUP BY k.doc_id)
SELECT d.doc_id, CASE WHEN ats IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ats, i - 1)), chr(10)), '') END AS text,
  CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""
