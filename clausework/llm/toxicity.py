"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Part of the lexicon is learned from the labelled texts. So that the trees see features as they are
on new texts, each labelled text's features come from a lexicon that was learned without it: from
the other parts of the fitting rows, or, for the rows that calibrate, from all fitting rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.features import byte_kinds, held_out, labelled_ids, with_features
from clausework.llm.scratch import materialize
from clausework.llm.words import as_bytes, letter_hashes

SAMPLE = 20_000
THRESHOLD = 0.3
#: Parts of the labelled rows by a hash of their id: the first ones fit, each with a lexicon of the others, the last one calibrates.
FITTING = 5
PARTS = FITTING + 1
NEAR = 6
STEMS = (4, 5, 6, 7, 8)
PRECISION = 0.8
#: Insults, and words that address the reader.
LEXICON = ("clown", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "idiotic", "kill", "loser", "moron", "pathetic", "pig", "scum", "shut", "stupid", "trash", "ugly", "vile", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "vous", "votre", "usted", "ti", "vuestro")

FEATURES = ("lexicon_rate", "lexicon_log", "lexicon_kinds", "lexicon_dense", "obfuscated_rate", "obfuscated_log", "second_rate", "near_second", "upper", "bang", "stop", "symbol", "digit", "log_words")


def word_codes(words: Sequence[str]) -> np.ndarray:
    """Hashes of single words, as the lexicons hold them."""
    return np.sort(np.concatenate([h[:, 0] for _, h in letter_hashes([w.encode() for w in words])]))


def _member(h: np.ndarray, of: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows of which any value is in the sorted ``of``; ``bits`` rules most out first."""
    out = np.zeros(len(h), dtype=bool)
    maybe = np.flatnonzero(bits[h >> np.uint64(44)].any(axis=1)) if h.ndim > 1 else np.flatnonzero(bits[h >> np.uint64(44)])
    if len(maybe) and len(of):
        own = h[maybe]
        same = of[np.searchsorted(of, own).clip(max=len(of) - 1)] == own
        out[maybe] = same.any(axis=1) if h.ndim > 1 else same
    return out


def _bits(codes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, dtype=bool)
    bits[codes >> np.uint64(44)] = True
    return bits


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, part, texts, toxic texts) of the stems of a batch of labelled texts."""
    for batch in batches:
        toxic, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        codes: dict[tuple[int, int], list[np.ndarray]] = {}
        for i, h in letter_hashes(as_bytes(batch.column(0)), STEMS):
            codes.setdefault((int(part[i]), int(toxic[i])), []).append(np.unique(h))
        for (k, label), found in codes.items():
            c, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(np.full(len(c), k, dtype=np.int32)), pa.array(n), pa.array(n * label)], names=["code", "part", "n", "toxic"])


def learned_lexicons(sample: DataFrame) -> list[np.ndarray]:
    """Codes of words and stems that tell toxic texts, from ``sample`` (text, label, part): for each fitting part the lexicon of the other fitting parts, at last that of all of them.

    A stem is a word's first STEMS bytes. A code counts if it is in at least a fiftieth of the
    toxic texts in question, five at least, and at least PRECISION of the texts that have it are
    toxic. That bounds a lexicon: it has at most fifty times as many codes as a toxic text has on average
    (about 50,000 for texts of 1000 different words and stems), eight bytes each on the driver.
    """
    fitting = sample.where(F.col("part") < FITTING)
    held = {r.part: r.n for r in fitting.where("label = 1").groupBy("part").agg(F.count("*").alias("n")).collect()}
    counts = fitting.select("text", "label", "part").mapInArrow(_stem_counts, "code long, part int, n long, toxic long")
    of = lambda c, k: F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    wide = counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), *[of(c, k) for c in ("n", "toxic") for k in range(FITTING)])

    def counts_in(k: int | None) -> Column:
        n, toxic = (F.col(c) - (F.lit(0) if k is None else F.col(f"{c}{k}")) for c in ("n", "toxic"))
        least = max(5, (sum(held.values()) - held.get(k, 0)) // 50)
        return (toxic >= least) & (toxic >= PRECISION * n)

    flags = [counts_in(k) for k in [*range(FITTING), None]]
    rows = wide.select("code", F.array(*flags).alias("f")).where(F.exists("f", lambda x: x)).collect()
    return [np.array(sorted(r.code for r in rows if r.f[k]), dtype=np.int64).view(np.uint64) for k in range(PARTS)]


def toxicity_features(learned: np.ndarray, lexicon: Sequence[str] = LEXICON) -> Callable[[list[bytes]], np.ndarray]:
    """A function from texts to rows of FEATURES; words are runs of letters, once as written and once with look-alike signs read as letters."""
    fixed, second = word_codes(lexicon), word_codes(SECOND_PERSON)
    bad = np.unique(np.concatenate([fixed, learned]))

    def run(texts: list[bytes]) -> np.ndarray:
        bad_bits, second_bits = _bits(bad), _bits(second)
        out = np.zeros((len(texts), len(FEATURES)))
        for first in range(0, len(texts), 256):
            lot = texts[first : first + 256]
            masked = {i: np.count_nonzero(_member(h, bad, bad_bits)) for i, h in letter_hashes(lot, look_alikes=True)}
            for i, stems in letter_hashes(lot, STEMS):
                words = stems[:, 0]
                n = max(1, len(words))
                hits = np.flatnonzero(_member(stems, bad, bad_bits))
                whole = np.count_nonzero(_member(words, bad, bad_bits))
                you = np.flatnonzero(_member(words, second, second_bits))
                hidden = max(0, masked[i] - whole)
                near = 0
                if len(hits) and len(you):
                    at = np.searchsorted(you, hits)
                    gap = np.minimum(np.abs(hits - you[at.clip(max=len(you) - 1)]), np.abs(hits - you[(at - 1).clip(min=0)]))
                    near = np.count_nonzero(gap <= NEAR) / len(hits)
                dense = max(np.searchsorted(hits, hits + 50) - np.arange(len(hits)), default=0)
                upper, lower, digit, _, bang, stop, symbol, high = byte_kinds(lot[i])
                letters, total = max(1, upper + lower + high), max(1, upper + lower + high + digit + bang + stop + symbol)
                out[first + i] = (len(hits) / n, np.log1p(len(hits)), len(np.unique(words[hits])), dense, hidden / n, np.log1p(hidden), len(you) / n, near, upper / letters, bang / total, stop / total, symbol / total, digit / total, np.log1p(len(words)))
        return out

    return run


@dataclass
class ToxicityModel:
    """Trees and the isotonic map of their probabilities; both None where no labels of both kinds were given."""

    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, rows: DataFrame, features: str = "_features") -> DataFrame:
        """``rows`` with a column score (0 to 1)."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(0.0))
        raw = self.trees.transform(rows.withColumn("_vector", array_to_vector(features)))
        raw = raw.withColumn("_p", vector_to_array("probability").getItem(1))
        if self.calibration is None:
            return raw.withColumn("score", F.col("_p")).drop("_vector", "rawPrediction", "probability", "_p", "_class")
        # ties on a level of the calibration keep the order of the trees
        scored = self.calibration.transform(raw).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("_calibrated") + 0.001 * F.col("_p"))))
        return scored.drop("_vector", "rawPrediction", "probability", "_p", "_class", "_calibrated")


def fit_toxicity(sample: DataFrame) -> ToxicityModel:
    """Fit on ``sample`` (part, _features, label): trees on the fitting parts, isotonic calibration on the last.

    Without rows of both labels in a part of the two, that one is left out; without trees all texts score 0.
    """
    sample = sample.select("part", "label", array_to_vector("_features").alias("_vector")).cache()
    try:
        fit, rest = sample.where(F.col("part") < FITTING), sample.where(F.col("part") == FITTING)
        if fit.select("label").distinct().count() < 2:
            return ToxicityModel(None, None)
        trees = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_class", maxDepth=3, maxIter=12, stepSize=0.3, maxBins=64, seed=7).fit(fit)
        if rest.select("label").distinct().count() < 2:
            return ToxicityModel(trees, None)
        own = trees.transform(rest).withColumn("_p", vector_to_array("probability").getItem(1))
        calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(own.select("_p", "label"))
        return ToxicityModel(trees, calibration)
    finally:
        sample.unpersist()


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, lexicon: Sequence[str] = LEXICON) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of ``labels`` (doc_id, toxic).

    Returns doc_id, held_out (crc32 of the id as text modulo 4 is 2: such labels are not
    learned), score (0 to 1), predicted (1 if score >= 0.3, else 0). Only the text enters a
    score: whole texts, null as empty; an empty text scores as one without any sign. Labels other
    than 0 and 1 are ignored, of several labels of one id the largest counts; repeated rows each
    get their score. An empty table gives no rows. At most ``rows`` labelled rows are learned from.
    """
    docs = docs.select("doc_id", "text")
    known = labelled_ids(labels, "toxic", rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PARTS)).cast("int"))
    sample = materialize(docs.join(F.broadcast(known), "doc_id").select("text", "label", "part"), "toxicity-sample")
    lexicons = learned_lexicons(sample)
    parts = [with_features(sample.where(F.col("part") == k), toxicity_features(codes, lexicon)).drop("text") for k, codes in enumerate(lexicons)]
    model = fit_toxicity(reduce(DataFrame.unionByName, parts))
    scored = model.score(with_features(docs, toxicity_features(lexicons[-1], lexicon)).drop("text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score").withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
