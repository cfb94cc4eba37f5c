"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.features import byte_kinds, dot, held_out, labelled_sample, with_features
from clausework.llm.scratch import materialize
from clausework.llm.words import shingle_hashes, word_hashes

#: Labelled rows that a model learns from at most: all.
SAMPLE: int | None = None
#: Hash buckets that a labelled row is in, the least number of all buckets, and rows of the rarer label in each on average where there are more.
SLOTS = 4
PAIR_BUCKETS = 64
RARER_IN_BUCKET = 4
THRESHOLD = 0.7

FEATURES = ("upper", "bang", "symbol", "digit", "some_upper", "some_symbol", "repeated_words", "repeat_runs", "repeated_shingles", "rare_words", "long_words", "log_words", "short", "no_words")


def quality_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text: rates of signs and repetitions, as square roots where small rates matter."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, words in word_hashes(texts):
        kinds, n = byte_kinds(texts[i]), len(words)
        upper, lower, digit, _, bang, stop, symbol, high = kinds
        total = max(1, kinds.sum() - kinds[3])
        letters = max(1, upper + lower + high)
        shingles = shingle_hashes(words)
        distinct = len(np.unique(words)) / max(1, n)
        runs = np.count_nonzero(words[1:] == words[:-1]) / max(1, n - 1)
        again = 1 - len(np.unique(shingles)) / max(1, len(shingles))
        rates = upper / letters, bang / total, symbol / total, digit / total
        out[i] = (
            *np.sqrt(rates), min(1, 5 * max(0, rates[0] - 0.05)), min(1, 30 * rates[2]), 1 - distinct, np.sqrt(runs), again,
            distinct, total / max(1, n) / 10, np.log1p(n) / 5, 1 / (1 + n), n == 0,
        )
    return out


@dataclass
class QualityModel:
    """Weights of the features, the raw score that the quantile sets as threshold, and its scale."""

    weights: list[float]
    cut: float
    scale: float

    def score(self, features: str = "_features"):
        """0 to 1; THRESHOLD where the raw score is at the cut."""
        raw = (dot(features, self.weights) - self.cut) / self.scale
        odds = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -(raw + F.lit(float(odds)))))))


def _constant() -> QualityModel:
    return QualityModel([0.0] * len(FEATURES), 0.0, 1.0)


def fit_quality(features: DataFrame, labels: DataFrame, rows: int | None = SAMPLE) -> QualityModel:
    """Learn from all labelled rows that are not held out, or from the first ``rows`` by a hash.

    Each row is in SLOTS hash buckets, whose number grows with the rows of the rarer label; rows of label 1 and
    of label 0 that meet in one form preference pairs, about SLOTS * RARER_IN_BUCKET for each row of the commoner label, so
    that hardly one in a million is left without a pair (more, where the rarer label has fewer rows than there are buckets). The
    logistic loss on their feature differences, without an intercept, gives the Bradley-Terry weights; it is the
    same for a difference and its reverse, so every other bucket gives reverses. The cut is the quantile of the scores that
    separates all labels best. Without rows of both labels every text scores THRESHOLD. The pairs are cached while they
    are fitted; a lost executor's part is made again.
    """
    known = materialize(labelled_sample(features, labels, "quality", rows), "quality-labelled")
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return _constant()
    buckets = max(PAIR_BUCKETS, min(counts.values()) * SLOTS // RARER_IN_BUCKET)
    slots = known.withColumn("slot", F.explode(F.expr(f"transform(sequence(0, {SLOTS - 1}), k -> pmod(xxhash64(doc_id, k), {buckets}L))")))
    better, worse = (slots.where(f"label = {v}").select("slot", F.col("_features").alias(name)) for v, name in ((1, "x"), (0, "y")))
    forth = F.col("slot") % 2 == 0
    difference = F.when(forth, F.zip_with("x", "y", lambda p, q: p - q)).otherwise(F.zip_with("y", "x", lambda p, q: p - q))
    pairs = better.join(worse, "slot").select(array_to_vector(difference).alias("features"), forth.cast("double").alias("label")).cache()
    try:
        if pairs.isEmpty():
            return _constant()
        model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60).fit(pairs)
    finally:
        pairs.unpersist()
    weights = [float(w) for w in model.coefficients]
    scored = known.select("label", dot("_features", weights).alias("raw"))
    n0 = counts[0.0] / sum(counts.values())
    levels = sorted({min(0.999, max(0.001, n0 * f)) for f in np.linspace(0.4, 1.6, 49)})
    cuts = scored.approxQuantile("raw", levels, 0.0005)
    right = scored.agg(*[F.avg(((F.col("raw") >= c) == (F.col("label") == 1)).cast("double")).alias(f"c{k}") for k, c in enumerate(cuts)]).first()
    best = max(right)
    good = [c for c, r in zip(cuts, right, strict=True) if r >= best - 0.002]
    low, high = scored.approxQuantile("raw", [0.05, 0.95], 0.001)
    return QualityModel(weights, (good[0] + good[-1]) / 2, max(1e-9, (high - low) / 8))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int | None = SAMPLE) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of ``labels`` (doc_id, quality).

    Returns doc_id, held_out (crc32 of the id as text modulo 4 is 2: such labels are not
    learned), score (0 to 1), predicted (1 if score >= 0.7, else 0). Only the text enters a
    score: whole texts, null as empty; empty texts score by their features too. Labels other than 0
    and 1 are ignored, of several labels of one id the largest counts; repeated rows each get
    their score. An empty table gives no rows.
    """
    features = materialize(with_features(docs.select("doc_id", "text"), quality_features).drop("text"), "quality-features")
    score = fit_quality(features, labels, rows).score()
    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int | None = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of at least THRESHOLD. Two passes over the texts: features of those that can be learned from, which meet the labels without their texts, and the scores."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    features = with_features(learn, quality_features).drop("text").dropDuplicates(["doc_id", "_hash"])
    model = fit_quality(features, labels, rows)
    name = "_quality_features"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return with_features(docs, quality_features, name).where(model.score(name) >= THRESHOLD).drop(name)
