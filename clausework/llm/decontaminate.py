"""Benchmark decontamination by SimHash over item-sized windows.

Each window of a text as long as a benchmark item gets a 256-bit SimHash of its five-word
shingles, weighted by their occurrences. A multi-index of two levels returns every item
within the Hamming radius: two fingerprints that differ in at most RADIUS bits agree up to
RADIUS // BLOCKS bits in some block of 32, and there up to a quarter of that in some byte.
Postings by byte give what is looked at, the block's distance decides what is a candidate,
the whole distance and then the exact weighted similarity of the shingles decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.words import as_bytes, mix, shingle_hashes, word_hashes

BITS = 256
BLOCKS = 8
BYTES = BITS // 8
#: Shingle vectors of a similarity of 0.75 differ in 44 bits on average, with a deviation of 6; others in 128.
RADIUS = 63
BLOCK_RADIUS = RADIUS // BLOCKS
BYTE_RADIUS = BLOCK_RADIUS // (BYTES // BLOCKS)
#: Share of repeated shingles from which a window's or item's angle no longer follows from the similarity; such are compared with all.
HEAVY = 0.05
#: Benchmark items and bytes of text indexed at a time; a larger benchmark is matched in several passes over the texts.
LOT_ITEMS = 20_000
LOT_BYTES = 16 << 20
MATCH_SCHEMA = "doc_id long, item_id long, start_word int, end_word int, similarity double"

_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int16) * 2 - 1


def _bit_signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits of each shingle's hash."""
    raw = np.stack([mix(shingles, salt=40 + k) for k in range(BITS // 64)], axis=1)
    return _SIGNS[np.ascontiguousarray(raw).view(np.uint8)].reshape(len(shingles), BITS)


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


_FLIPS = np.array([0] + [sum(1 << b for b in c) for r in range(1, BYTE_RADIUS + 1) for c in combinations(range(8), r)], dtype=np.uint8)


def repeats(shingles: np.ndarray) -> int:
    """Occurrences of shingles after their first."""
    return len(shingles) - len(np.unique(shingles))


@dataclass
class Postings:
    """Fingerprints of the items of one length, and for each byte and value the items whose byte is within BYTE_RADIUS of it."""

    items: np.ndarray
    prints: np.ndarray
    heavy: np.ndarray  # items that every window meets
    starts: np.ndarray  # (BYTES * 256 + 1): where the postings of a byte's value begin
    owners: np.ndarray

    @classmethod
    def build(cls, items: np.ndarray, prints: np.ndarray, heavy: np.ndarray) -> Postings:
        slots = (np.arange(BYTES)[:, None, None] * 256 + (prints.T[:, :, None] ^ _FLIPS)).ravel()
        owners = np.broadcast_to(np.arange(len(items), dtype=np.int32)[None, :, None], (BYTES, len(items), len(_FLIPS))).ravel()
        order = np.argsort(slots, kind="stable")
        return cls(items, prints, heavy, np.searchsorted(slots[order], np.arange(BYTES * 256 + 1)).astype(np.int32), owners[order])

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, row of items) that agree up to BLOCK_RADIUS bits in some block, each pair once."""
        slots = (np.arange(BYTES) * 256 + prints).ravel()
        first, count = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        ends = np.cumsum(count, dtype=np.int64)
        at = np.repeat(np.arange(len(slots)), count)
        k = self.owners[np.repeat(first - (ends - count), count) + np.arange(len(at))]
        w, block = at // BYTES, at % BYTES // (BYTES // BLOCKS)
        close = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint32)[w, block] ^ self.prints.view(np.uint32)[k, block]) <= BLOCK_RADIUS
        pairs = np.unique(w[close] * len(self.items) + k[close])
        return pairs // len(self.items), pairs % len(self.items)

    def near(self, prints: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with at most RADIUS differing bits; heavy windows and items meet all."""
        w, k = self.candidates(prints)
        close = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1, dtype=np.int32) <= RADIUS
        w, k = w[close], k[close]
        if heavy.any() or self.heavy.any():
            all_w, all_k = np.nonzero(heavy[:, None] | self.heavy[None, :])
            pairs = np.unique(np.stack([np.concatenate([w, all_w]), np.concatenate([k, all_k])], axis=1), axis=0)
            w, k = pairs[:, 0], pairs[:, 1]
        return w, self.items[k]


@dataclass
class BenchmarkIndex:
    """The items of one pass, their shingles and the multi-index for each length."""

    item_ids: list[int]
    counts: list[tuple[np.ndarray, np.ndarray]]  # distinct shingles, occurrences
    known: np.ndarray  # all shingles of the items, sorted
    lengths: dict[int, Postings]  # by length in shingles

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> BenchmarkIndex:
        ids, shingles = [], []
        for i, words in word_hashes([t.encode() for _, t in items]):
            if len(words):
                ids.append(items[i][0])
                shingles.append(shingle_hashes(words))
        sizes = np.array([len(s) for s in shingles], dtype=np.int64)
        lengths = {}
        for length in np.unique(sizes):
            own = np.flatnonzero(sizes == length)
            prints = np.stack([_fingerprints(_bit_signs(shingles[k]).sum(axis=0, keepdims=True, dtype=np.int32))[0] for k in own])
            lengths[int(length)] = Postings.build(own, prints, np.array([repeats(shingles[k]) > HEAVY * length for k in own]))
        known = np.unique(np.concatenate(shingles)) if ids else np.zeros(0, np.uint64)
        return cls(ids, [np.unique(s, return_counts=True) for s in shingles], known, lengths)


def weighted_similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger occurrences of all shingles of either side."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(x[1][i], y[1][j]).sum())
    return common / (int(x[1].sum()) + int(y[1].sum()) - common)


def _matches(words: np.ndarray, index: BenchmarkIndex, filter_bits: np.ndarray, percent: int, first_only: bool = False) -> list[tuple[int, int, int, float]]:
    """(item, first word, end word, similarity) of the best window for each item found in a text; with ``first_only`` any one match."""
    shingles = shingle_hashes(words)
    if not len(shingles):
        return []
    maybe = np.flatnonzero(filter_bits[(shingles >> np.uint64(40)).astype(np.int64)])
    if not len(maybe):
        return []
    at = np.searchsorted(index.known, shingles[maybe]).clip(max=len(index.known) - 1)
    maybe = maybe[index.known[at] == shingles[maybe]]
    if not len(maybe):
        return []
    flags = np.zeros(len(shingles) + 1, dtype=np.int32)
    flags[maybe + 1] = 1
    seen = np.cumsum(flags)
    best: dict[int, tuple[float, int, int]] = {}
    for length, postings in index.lengths.items():
        span = min(length, len(shingles))
        if 100 * span < percent * length:
            continue
        # a window with too few shingles of any item can reach the similarity with none
        starts = np.flatnonzero(100 * (seen[span:] - seen[: len(seen) - span]) >= percent * length)
        for lot in range(0, len(starts), 4096):
            some = starts[lot : lot + 4096]
            lo, hi = int(some[0]), int(some[-1]) + span
            if hi - lo <= 4 * (span + len(some)):
                sums = np.zeros((hi - lo + 1, BITS), dtype=np.int32)
                np.cumsum(_bit_signs(shingles[lo:hi]), axis=0, out=sums[1:])
                prints = _fingerprints(sums[some - lo + span] - sums[some - lo])
            else:
                prints = np.concatenate([_fingerprints(_bit_signs(shingles[s : s + span]).sum(axis=0, keepdims=True, dtype=np.int32)) for s in some])
            heavy = np.fromiter((repeats(shingles[s : s + span]) > HEAVY * span for s in some), dtype=bool, count=len(some)) if repeats(shingles[lo:hi]) else np.zeros(len(some), dtype=bool)
            for w, k in zip(*postings.near(prints, heavy), strict=True):
                start = int(some[w])
                value = weighted_similarity(np.unique(shingles[start : start + span], return_counts=True), index.counts[k])
                if 100 * value >= percent - 1e-9 and value > best.get(int(k), (0.0,))[0]:
                    end = start + span + 4 if len(words) >= 5 else len(words)
                    best[int(k)] = (value, start, end)
                    if first_only:
                        return [(index.item_ids[k], start, end, value)]
    return [(index.item_ids[k], s, e, v) for k, (v, s, e) in sorted(best.items())]


def _filter_bits(index: BenchmarkIndex) -> np.ndarray:
    bits = np.zeros(1 << 24, dtype=bool)
    bits[(index.known >> np.uint64(40)).astype(np.int64)] = True
    return bits


def _finder(index: BenchmarkIndex, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _filter_bits(index)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *m) for i, words in word_hashes(as_bytes(batch.column(1))) for m in _matches(words, index, bits, percent)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "similarity"])

    return run


def _keeper(index: BenchmarkIndex, percent: int, text: int):
    """Batches without the rows whose text holds an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _filter_bits(index)
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for i, words in word_hashes(as_bytes(batch.column(text))):
                clean[i] = not _matches(words, index, bits, percent, first_only=True)
            yield batch.filter(pa.array(clean))

    return run


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lots of at most LOT_ITEMS items and about LOT_BYTES, streamed to the driver lot by lot."""
    lot, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        lot.append((row.item_id, row.text))
        held += len(row.text.encode())
        if len(lot) >= LOT_ITEMS or held >= LOT_BYTES:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that repeat an item of ``benchmark`` (item_id, text).

    Returns one row per input row and item found: doc_id, item_id, start_word and end_word of
    the best window (the first of equal ones), similarity (at least ``percent`` / 100).

    A window has as many shingles as the item, or all of a text that has fewer. Null or wordless
    texts and items match nothing; items with a null id are left out; repeated items of one id
    can give several rows. Repeated documents each give their rows, null doc_ids included. An
    empty table on either side gives no rows. Texts of any length are read whole, in one map
    over the documents for every lot of the benchmark and without a shuffle: a benchmark of n items
    reads the documents n / LOT_ITEMS times. Ids of both sides are cast to long.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _passes(benchmark):
        index = BenchmarkIndex.build(items)
        if not index.item_ids:
            continue
        part = docs.mapInArrow(_finder(index, percent), MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], MATCH_SCHEMA) if found is None else found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item was found; one map for every lot, no shuffle. Each row stands for itself, whatever its doc_id."""
    for items in _passes(benchmark):
        index = BenchmarkIndex.build(items)
        if index.item_ids:
            docs = docs.mapInArrow(_keeper(index, percent, docs.columns.index("text")), docs.schema)
    return docs
