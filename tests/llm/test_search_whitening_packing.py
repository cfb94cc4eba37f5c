"""op11 to op13 against plain computations, on given tables and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clausework.llm import packing, queries, search, whitening

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# --- ranked search


def plain_search(docs, items, top=50):
    """The ranking by its formulas, document by document."""
    terms = lambda t: re.findall(search.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, words = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for k, (item, text) in enumerate(items):
        scored = []
        for doc_id, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, top=50):
    rows = search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string, rank int"), top)
    return sorted(map(tuple, rows.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("short", "stretch", "block"), [(8192, 256, 8192), (0, 4, 16), (30, 2, 7), (10**9, 256, 8192)])
def test_search_equals_brute_force(spark, monkeypatch, short, stretch, block):
    """All lists long, all short, both; many small stretches and blocks."""
    monkeypatch.setattr(search, "SHORT_POSTINGS", short)
    monkeypatch.setattr(search, "STRETCH", stretch)
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    rnd = random.Random(short + stretch)
    words = ["The", "a", "Ωmega", "naïve", "x1", "rare", "odd", "É", "b-c", "d_e", "the"] + [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rnd.choices(words, weights=[30, 20] + [5] * 9 + [1] * 30, k=n))
    docs = [(k, text(rnd.choice([0, 1, 3, 20, 60])), "x") for k in range(90)] + [(90, None, "x"), (91, "--- !!", "x"), (5, text(9), "x"), (None, "rare odd", "x"), (92, "rare odd", "x"), (93, "rare odd", "x"), (93, "rare odd", "x"), (94, text(5000), "x")]
    items = [(1, text(8), 0), (2, "rare rare ODD", 0), (3, "nowhere", 0), (4, None, 0), (5, "", 0), (2, "É naïve, the", 0), (None, "x1", 0)]
    for top in (50, 3):
        assert ranked(spark, docs, items, top) == plain_search([d[:2] for d in docs], [i[:2] for i in items], top)


def test_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a", 0)]) == [] and ranked(spark, [(1, "a", "")], []) == [] and ranked(spark, [(1, None, "")], [(1, "a", 0)]) == []


def test_search_in_lots(spark, monkeypatch):
    docs, items = [(k, f"a{k % 7} b{k % 5} c", "") for k in range(40)], [(k, f"a{k} b{k % 5} c", 0) for k in range(9)]
    whole = ranked(spark, docs, items)
    monkeypatch.setattr(search, "LOT_TERMS", 5)
    assert ranked(spark, docs, items) == whole == plain_search([d[:2] for d in docs], [i[:2] for i in items])


# --- whitening


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((fit - sums / n).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > len(values) * 1e-15 * values[0]).sum()))
    return n, ((n * x - sums) ** 2).sum(axis=1), ((x - sums / n) @ axes[:, :k]) / np.sqrt(values[:k]), values[:k] / values.sum()


def whitened(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string"))
    return df.orderBy("vec_id", "component").collect()


def test_whitening_equals_eigenvectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, expected, share = plain_whitening([r.embedding for r in rows])
    got = queries.op12_embedding_whitening(spark, sf_dir).orderBy("vec_id", "component").collect()
    w = np.array([r.whitened for r in got]).reshape(-1, 16)
    signs = np.sign((w * expected).sum(axis=0))
    assert np.abs(w - expected * signs).max() < 1e-8
    assert [r.deviation for r in got[::16]] == deviation.tolist() and {r.n for r in got} == {n}
    assert np.allclose([r.explained for r in got[:16]], share, rtol=1e-10) and {r.identity_error < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("kind", ["ill", "flat", "few", "copies"])
def test_whitening_of_hard_tables(spark, kind):
    """Badly conditioned, rank-deficient, fewer vectors than dimensions, one vector for most rows."""
    rnd = np.random.default_rng(7)
    m = rnd.normal(size=(300, 12)) * 100
    if kind == "ill":
        m = m * np.geomspace(1e2, 1e-3, 12)
    elif kind == "flat":
        m[:, 5] = 3.0
        m[:, 7] = m[:, 1] + m[:, 2].round()
    elif kind == "few":
        m = m[:6]
    else:
        m[50:] = m[0]
    m = m.astype(np.float32).astype(np.float64)
    got = whitened(spark, [(k, v.tolist(), "x") for k, v in enumerate(m)])
    n, deviation, expected, share = plain_whitening(m)
    k = got[-1].component
    assert k >= len(share) - 1 and len(got) == k * len(m) and got[0].n == n
    w, top = np.array([r.whitened for r in got]).reshape(-1, k), min(k, 4)
    signs = np.sign((w * expected[:, :k]).sum(axis=0))
    assert np.abs(w[:, :top] - (expected[:, :k] * signs)[:, :top]).max() < 1e-5
    assert [r.deviation for r in got[::k]] == deviation.tolist() and got[0].identity_error < 1e-4


def test_whitening_of_odd_rows(spark):
    odd = [(1, None, ""), (2, [], ""), (3, [1.0, float("nan")], ""), (4, [float("inf"), 1.0], ""), (5, [None, 1.0], "")]
    assert whitened(spark, odd) == [] and whitened(spark, []) == [] and whitened(spark, [*odd, (6, [1.0, 2.0], "")]) == []
    got = whitened(spark, [*odd, (7, [1.0, 2.0], ""), (8, [-1.0, 0.5], ""), (None, [3.0, 0.0], ""), (8, [-1.0, 0.5], ""), (9, [1.0, 2.0, 3.0], ""), (10, [0.0, 0.0, 9.0], "")])
    assert Counter((r.vec_id, r.n) for r in got) == {(7, 3): 2, (8, 3): 4, (None, 3): 2, (9, 2): 1, (10, 2): 1}
    big = whitened(spark, [(1, [1e30, 0.0], ""), (2, [-1e30, 1.0], ""), (3, [0.0, 2.0], "")])
    assert [r.deviation for r in big if r.component == 1] == [None, None, 27 * 0 + big[-1].deviation]


# --- packing


@pytest.mark.parametrize("path", [WORD_BPE, public_tokenizers.path("byte_bpe_50k.json")])
def test_ids_by_word_are_those_of_whole_texts(path):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(path), packing.WordTokenizer.load(path)
    texts = ["It's Here's A'LL don't 'tis x", "\x1c\x1d x\x85y", "a1b2 12345", "École ßÿ×÷ İ ΣΑΣ é é nbsp em ", "<|endoftext|> x<|startoftext|>y", "\U0001f600 中文 ª º µ", "\x00\x01\x7f it’s", "", "   ", "A'S 'Re'VE''S", "".join(map(chr, range(32, 384)))]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert own.by_word == (path == WORD_BPE)


def fewest(sizes, capacity):
    """The fewest bins, by trying all placements."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[k]}):
            rest = list(rooms)
            rest[rest.index(r)] -= sizes[k]
            put(k + 1, rest)
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_plans_hold_all_pieces_and_few_bins():
    rnd = random.Random(3)
    for _ in range(150):
        capacity = rnd.choice([7, 10, 20])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 9))]
        plan = packing.packing_plan(Counter(sizes), capacity)
        held = Counter()
        for p in plan:
            assert p.copies > 0 and p.filled() <= capacity
            held.update({s: n * p.copies for s, n in p.items})
        assert held == Counter(sizes)
        bins, least = sum(p.copies for p in plan), fewest(sizes, capacity)
        assert least <= bins <= least + 1
        # what the reduction fixes costs nothing: the rest needs no more than the best of all would leave
        left = Counter(sizes)
        fixed = sum(p.copies for p in packing.dominance_reduction(left, capacity))
        assert fixed + fewest(list(left.elements()), capacity) == least


def test_large_plans_are_near_the_bound_and_small():
    rnd = random.Random(5)
    counts = {s: rnd.randint(1, 10**6) for s in range(1, 2049)}
    plan = packing.packing_plan(counts)
    assert len(plan) < 3 * 2048 and sum(p.copies for p in plan) <= 1.03 * sum(s * n for s, n in counts.items()) / 2048


def pieces_of(rows, capacity):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(WORD_BPE), []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out += [(doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    return sorted(out, key=str)


def test_packing_equals_the_tokenizer(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op13_best_fit_packing(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == pieces_of(docs, 2048)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in got) / 2048) * 1.02 + 1


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three " * 40), (4, "same"), (4, "same"), (None, "x"), (5, "Ω ünï <|endoftext|>")]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, piece string")
    got = packing.pack(docs, WORD_BPE, capacity=16, with_ids=True)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()), key=str) == pieces_of(rows, 16)
    whole = packing.sequences(got).collect()
    assert all(len(r.ids) <= 16 for r in whole) and sum(len(r.ids) for r in whole) == got.agg(F.sum("length")).first()[0]
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0
