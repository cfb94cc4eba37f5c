"""op9 and op10 against plain computations, and all operators on tables with further columns and long texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import quality, queries, toxicity

TEXTS = ["", "One two two! THREE 4 four.", "a b c d e a b c d e a b c d e", "¡Qué BIEN! $$ 100%", "word " * 300, "Ab\tcd\nef  gh; \x00 it's \U0001f600"]


def plain_quality(text):
    """The features by their definitions, sign by sign."""
    raw = text.encode()
    n = lambda test: sum(map(test, raw))
    upper, lower, digit = n(lambda b: 65 <= b <= 90), n(lambda b: 97 <= b <= 122), n(lambda b: 48 <= b <= 57)
    bang, stop, high, space = n(lambda b: b in b"!?"), n(lambda b: b in b".,;:'\"()-"), n(lambda b: b >= 128), n(lambda b: b <= 32)
    symbol = len(raw) - upper - lower - digit - bang - stop - high - space
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if raw.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in raw))
    total, letters, k = max(1, len(raw) - space), max(1, upper + lower + high), len(words)
    shingles = [tuple(words[i : i + 5]) for i in range(max(0, k - 4))] if k >= 5 else [tuple(words)] if k else []
    rates = upper / letters, bang / total, symbol / total, digit / total
    distinct = len(set(words)) / max(1, k)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, k - 1)
    again = 1 - len(set(shingles)) / max(1, len(shingles))
    return [*map(math.sqrt, rates), min(1, 5 * max(0, rates[0] - 0.05)), min(1, 30 * rates[2]), 1 - distinct, math.sqrt(runs), again, distinct, total / max(1, k) / 10, math.log1p(k) / 5, 1 / (1 + k), float(k == 0)]


def test_quality_features_are_their_definitions():
    got = quality.quality_features([t.encode() for t in TEXTS])
    assert np.allclose(got, [plain_quality(t) for t in TEXTS])


@pytest.fixture(scope="module")
def quality_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.with_features(docs.select("doc_id", "text"), quality.quality_features).drop("text").cache(), labels


def test_quality_weights_minimize_the_pairs_loss(spark, quality_table):
    """The gradient of the loss on the same pairs, by numpy, is nil at the weights; the cut separates best."""
    features, labels = quality_table
    model = quality.fit_quality(features, labels)
    sample = quality.labelled_sample(features, labels, "quality", quality.SAMPLE)
    assert sample.where("fold = 2").count() == 0
    rows = sample.withColumn("slot", F.explode(F.expr(f"transform(sequence(0, 3), k -> pmod(xxhash64(doc_id, k), {quality.PAIR_BUCKETS}))"))).toPandas()
    better, worse = (rows[rows.label == v] for v in (1, 0))
    met = better.merge(worse, on="slot")
    d = np.stack(met["_features_x"].to_numpy()) - np.stack(met["_features_y"].to_numpy())
    w, spread = np.array(model.weights), np.std(np.concatenate([d, -d]), axis=0, ddof=1)
    gradient = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 1e-4 * w * spread**2
    assert np.abs(gradient / np.maximum(spread, 1e-9))[spread > 0].max() < 5e-3
    own = sample.toPandas()
    raw = np.stack(own["_features"].to_numpy()) @ w
    right = lambda c: ((raw >= c) == (own.label == 1)).mean()
    assert right(model.cut) >= max(right(c) for c in np.quantile(raw, np.linspace(0.02, 0.98, 97))) - 0.02


def test_quality_learns_from_all_labels(spark):
    """The first 20,000 labelled rows by hash are all of label 1: what tells the labels apart is in the others."""
    ids = spark.range(32_000).selectExpr("id as doc_id", "row_number() over (order by xxhash64(id), id) as place")
    rows = ids.selectExpr("doc_id", f"array_repeat(if(place > 28000, 0.1D, 0.9D), {len(quality.FEATURES)}) as _features", "if(place > 28000, 0, 1) as quality").cache()
    model = quality.fit_quality(rows.select("doc_id", "_features"), rows.select("doc_id", "quality"))
    assert model.weights[0] > 0
    wrong = rows.where((model.score() >= quality.THRESHOLD) != (F.col("quality") == 1)).count()
    assert wrong == 0


def test_quality_scores_follow_from_the_weights(spark, quality_table):
    features, labels = quality_table
    model = quality.fit_quality(features, labels)
    got = features.select("_features", model.score().alias("s")).toPandas()
    raw = (np.stack(got["_features"].to_numpy()) @ np.array(model.weights) - model.cut) / model.scale
    expected = 1 / (1 + np.exp(np.clip(-(raw + math.log(0.7 / 0.3)), -30, 30)))
    assert np.allclose(got["s"], expected) and (0 <= got["s"]).all() and (got["s"] <= 1).all()


def test_toxicity_features_are_their_definitions():
    lexicon = ("vile", "rotten")
    run = toxicity.toxicity_features(np.zeros(0, dtype=np.uint64), lexicon)
    texts = ["You are VILE, v1le and r0tten!! truly rotten", "nothing here", "", "vile " * 120 + "you"]
    got = [dict(zip(toxicity.FEATURES, row, strict=True)) for row in run([t.encode() for t in texts])]
    names = toxicity.FEATURES
    for text, row in zip(texts, run([t.encode() for t in texts]), strict=True):
        words = re.findall(r"[A-Za-z]+", text)
        n, hits = max(1, len(words)), [i for i, w in enumerate(words) if w.lower() in lexicon]
        assert row[0] == len(hits) / n and math.isclose(row[1], math.log1p(len(hits))) and row[2] == len({words[i].lower() for i in hits})
        assert row[3] == max((sum(h <= j < h + 50 for j in hits) for h in hits), default=0)
        letters = sum(c.isalpha() for c in text)
        assert math.isclose(row[8], sum(c.isupper() for c in text) / max(1, letters)) and math.isclose(row[-1], math.log1p(len(words)))
    assert got[0][names[4]] > 0 and got[1][names[4]] == 0  # disguised words
    assert got[0][names[7]] > 0 and got[1][names[7]] == 0  # second person beside them


def test_isotonic_map_is_the_pooled_one(spark):
    """The calibration equals pooling adjacent violators of the trees' probabilities."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        x = rng.normal(size=len(toxicity.FEATURES))
        rows.append((k % (toxicity.FITTING + 1), x.tolist(), float(rng.random() < 1 / (1 + np.exp(-2 * x[0])))))
    sample = spark.createDataFrame(rows, "part int, _features array<double>, label double").cache()
    model = toxicity.fit_toxicity(sample)
    rest = sample.where(F.col("part") == toxicity.FITTING)
    trees = toxicity.ToxicityModel(model.trees, None).score(rest).toPandas().sort_values("score")
    blocks = []
    for p, own in trees.groupby("score"):
        blocks.append([own.label.sum(), len(own), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + at]
    pooled = {p: s / n for s, n, at in blocks for p in at}
    got = {r.p: r.score for r in model.score(rest.join(toxicity.ToxicityModel(model.trees, None).score(rest).select("_features", F.col("score").alias("p")), "_features")).select("p", "score").collect()}
    assert set(got) == set(pooled) and all(math.isclose(got[p], 0.999 * pooled[p] + 0.001 * p, abs_tol=1e-6) for p in got)
    levels = [got[p] for p in sorted(got)]
    assert levels == sorted(levels)


#: Names that the operators use for columns of their own.
CLASHING = ("band", "rep", "component", "component_id", "kept", "host", "path", "text_", "label_", "size", "rank", "score", "source_size", "n_shingles", "_features", "task", "length", "spans", "registers", "u", "v", "x")
LONG = " ".join(f"w{k % 977} long{k % 13}" for k in range(60_000)) + " mail me@site.org"


@pytest.mark.parametrize("name", ["op1_minhash_neardup", "op2_embedding_neardup", "op3_decontamination", "op6_licenses", "op8_pii", "op9_quality", "op10_toxicity", "op12_embedding_whitening", "op13_best_fit_packing"])
def test_further_columns_and_long_texts(spark, sf_dir, tmp_path, name):
    """Further columns change nothing, and a text of 700 kB among short ones does not either."""
    plain, more = tmp_path / "plain", tmp_path / "more"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    long = spark.createDataFrame([(9001, LONG, "en", "s0", len(LONG)), (9002, LONG + " end", "en", "s0", len(LONG) + 4)], docs.schema)
    tables = {"documents": docs.unionByName(long), "embeddings": spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 80")}
    tables |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels", "pages")}
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{plain}/{t}.parquet")
        df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns]).coalesce(1).write.parquet(f"{more}/{t}.parquet")
    a, b = (queries.QUERIES[name](spark, str(d)) for d in (plain, more))
    columns = [c for c in a.columns if not (name.startswith("op12") and c == "whitened")]
    rows = lambda df: Counter(map(str, df.select(*columns).collect()))
    first = rows(a)
    assert first == rows(b)
    if name.startswith("op1_"):
        assert {r.component_id for r in a.where("doc_id > 9000").collect()} == {9001}
    if name.startswith("op8"):
        assert {r.n_email for r in a.where("doc_id > 9000").collect()} == {1}


def test_exceptions_and_whole_licences(spark):
    from clausework.llm.licenses import SENTENCES, find_licenses

    def said(*names):
        return "\n".join(SENTENCES[n] for n in names)

    wrapped = said("gpl-header-2-only", "gpl-warranty").replace("it under", "it\n * under").replace("hope that", "hope\n * that")
    texts = {
        1: said("gpl-header-2", "gpl-warranty", "classpath-1", "classpath-2"), 2: wrapped, 3: said("gnu-verbatim", "gpl3-text-1", "gpl3-text-2"), 4: said("gnu-verbatim", "gpl2-text-1", "lgpl2.1-text"),
        5: said("gpl-header-2", "gpl-warranty"), 6: said("gpl-header-3", "gpl-warranty", "gcc-runtime"), 7: "x\n" + said("apache-text-1") + "\nmore\n" + said("apache-text-2"), 8: said("gnu-verbatim"),
    }
    rows = find_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id", "license").collect()
    assert sorted(map(tuple, rows)) == [
        (1, "GPL-2.0-or-later WITH Classpath-exception-2.0"), (2, "GPL-2.0-only"), (3, "GPL-3.0"), (4, "LGPL-2.1"), (5, "GPL-2.0-or-later"), (6, "GPL-3.0-or-later WITH GCC-exception-3.1"), (7, "Apache-2.0"),
    ]
