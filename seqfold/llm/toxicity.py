"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has the probability sigmoid(bias + sum of its words' weights); a text's
score is their noisy-or, 1 - prod(1 - p). Weights are trained on document labels alone, through the noisy-or; the
sentence probabilities then locate what offends. A word's features are itself and its leading letters, so that
inflected and compounded forms of a stem count together.

The fit uses a bounded sample of the labelled rows (``MAX_PER_CLASS`` of either label, the first by a hash of the
id, and at most ``MAX_BYTES`` of text, filled in the order of another hash, whatever the texts' lengths); scoring
covers every text.

Defined results: a null or empty text is one empty sentence, whose probability is the bias alone; unlabelled rows
and labels without a document aren't trained on, null labels neither; repeated rows are scored alike; with labels of
only one kind the score is that class's smoothed rate, with none it is 0; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MAX_PER_CLASS = 3000
MAX_BYTES = 24 << 20
MIN_DOCS = 3
MIN_Z = 3.0
STEMS = (3, 4, 5)
STEPS = 300
BALANCE = 0.5
#: Where the bias starts: most sentences of any text are harmless.
BIAS = -7.0
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
EDGE = ".,;:!?\"'()[]{}*_-«»¿¡“”‘’…"


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]
    rate: float | None = None  # the score of every text, where there was nothing to learn from


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: up to the end marks or the end of the line. None: the whole text is one."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, len(text))]


def features(word: str) -> list[str]:
    word = word.strip(EDGE).lower()
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)] if word else []


def fit(texts: list[str], labels: list[int]) -> Model:
    """Maximum likelihood of the labels under the noisy-or, by Adam with an L2 penalty, over screened features."""
    y = np.asarray(labels, float)
    n_pos = float(y.sum())
    if not 0 < n_pos < len(y):
        return Model(BIAS, {}, (n_pos + 0.5) / (len(y) + 1) if len(y) else 0.0)
    known: dict[str, list[str]] = {}

    def names(words: list[str]) -> set[str]:
        return {f for w in words for f in (known.get(w) or known.setdefault(w, features(w)))}

    seen, toxic = Counter(), Counter()
    for t, label in zip(texts, y):
        found = names(t.split())
        seen.update(found)
        if label:
            toxic.update(found)
    # Screening: features whose share of toxic documents stands out from that of all documents.
    share = n_pos / len(y)
    ids: dict[str, int] = {}
    for f in sorted(seen):
        n, k = seen[f], toxic[f]
        if n >= MIN_DOCS and abs(k - n * share) / np.sqrt(n * share * (1 - share)) >= MIN_Z:
            ids[f] = len(ids)
    owner, sentence, feature = [], [], []
    for d, t in enumerate(texts):
        for a, b in sentences(t):
            kept = sorted(ids[f] for f in names(t[a:b].split()) if f in ids)
            sentence += [len(owner)] * len(kept)
            feature += kept
            owner.append(d)
    owner, sentence, feature = np.array(owner), np.array(sentence, np.int64), np.array(feature, np.int64)
    # Between the labels' own rates (BALANCE 0) and equal weight for both labels (1).
    balance = np.where(y == 1, (0.5 / n_pos) ** BALANCE, (0.5 / (len(y) - n_pos)) ** BALANCE) * len(y) ** BALANCE
    w, bias = np.zeros(len(ids) + 1), BIAS
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, w[feature], len(owner)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        miss = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of the product of 1 - p
        score = np.clip(-np.expm1(miss), 1e-9, 1 - 1e-9)
        pull = balance * np.where(y == 1, (1 - score) / score, -1.0)  # d likelihood / d z = pull * p
        g_sentence = pull[owner] * p
        gradient = np.append(np.bincount(feature, g_sentence[sentence], len(ids)), g_sentence.sum()) / len(y)
        gradient[:-1] -= 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[-1]), {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-6})


class Scorer:
    """Sentence probabilities of a model, as it was fitted: a feature counts once in a sentence.

    The features of words met that have a weight are kept, up to a bound.
    """

    def __init__(self, model: Model, keep: int = 200_000):
        self.bias, self.weights, self.keep, self.rate = model.bias, model.weights, keep, model.rate
        self.words: dict[str, tuple[str, ...]] = {}

    def word(self, word: str) -> tuple[str, ...]:
        if len(self.words) >= self.keep:
            self.words.clear()
        known = self.words[word] = tuple(f for f in features(word) if f in self.weights)
        return known

    def score(self, spans: list[tuple[int, int, float]]) -> float:
        return noisy_or([p for _, _, p in spans]) if self.rate is None else self.rate

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        known, word = self.words, self.word
        found = []
        for a, b in sentences(text):
            hit: set[str] = set()
            for x in text[a:b].split():
                if (names := known.get(x)) is None:
                    names = word(x)
                if names:
                    hit.update(names)
            z = self.bias + sum(map(self.weights.__getitem__, sorted(hit))) if hit else self.bias
            found.append((a, b, 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))))
        return found


def noisy_or(probabilities: list[float]) -> float:
    miss = 1.0
    for p in probabilities:
        miss *= 1.0 - p
    return 1.0 - miss


def train(docs: DataFrame, labels: DataFrame, usable, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows for which the condition ``usable`` (over ``doc_id``) holds."""
    given = labels.where(usable & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = lambda label: given.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
    ids = draw(0).unionByName(draw(1)).collect()  # at most two bounded samples of two integers
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "chosen long, toxic int")
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    sizes = joined.groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size")).collect()
    budget, taken = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):  # whatever their length
        if budget[r.toxic] >= r["size"]:
            budget[r.toxic] -= r["size"]
            taken.append((r.doc_id, r.toxic))
    final = spark.createDataFrame(taken, "chosen long, toxic int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(final), F.col("doc_id") == F.col("chosen")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.toxic for r in rows])


SCHEMA = "doc_id long, score double, offending array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, offending): the noisy-or of each text, and the spans (code points) of sentences whose own
    probability reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was trained on

    def make():
        scorer = Scorer(shared.value)

        def of(doc_id, text):
            spans = scorer.spans(text or "")
            hits = [{"start": a, "end": b, "probability": p} for a, b, p in spans if p >= threshold]
            return doc_id, scorer.score(spans), hits

        return of

    return common.map_rows(docs.select("doc_id", "text"), make, SCHEMA)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
