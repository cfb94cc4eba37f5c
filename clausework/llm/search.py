"""Ranked lexical search: accumulators of the short lists, then document-at-a-time over the long ones.

The index is cut by blocks of documents. An item's rarest terms, up to a fixed number of
postings, are summed term at a time by a Spark aggregation; the sums are accumulators and give
a first bound on the score that the item's last rank needs. In each block the accumulators are
then one more iterator, with its own largest value as bound, beside the iterators of the long
lists: stretches of documents whose bounds cannot reach the last rank are skipped, and in the
others only lists that still matter offer candidates.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize

TOP = 50
#: Documents and bytes of text of an index block at most (a longer text is a block of its own).
BLOCK_DOCS = 8192
BLOCK_BYTES = 8 << 20
#: Documents of a stretch, for which each list knows its largest value.
STRETCH = 256
#: Postings of an item's short lists at most; all others are long lists.
SHORT_POSTINGS = 8192
#: Terms of the items that one pass over the index looks for, about (a bound on what tasks hold).
LOT_TERMS = 200_000
#: Bits of the fixed-size filter of the items' terms.
FILTER_BITS = 1 << 23
_WORD_BITS = 32768

#: Letters and digits of ASCII, lower-cased, and all bytes of other signs; the rest parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """``text`` with A-Z as a-z, other signs as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _term_filter(terms: DataFrame) -> np.ndarray:
    """A set of FILTER_BITS bits with the terms' checksums; its size does not depend on the number of items."""
    at = terms.select(F.pmod(F.crc32("term"), F.lit(FILTER_BITS)).alias("bit"))
    words = at.groupBy(F.floor(F.col("bit") / _WORD_BITS).alias("word")).agg(F.bitmap_construct_agg(F.col("bit") % _WORD_BITS).alias("bits"))
    out = np.zeros(FILTER_BITS, dtype=bool)
    for r in words.toLocalIterator():  # FILTER_BITS / _WORD_BITS rows at most
        out[r["word"] * _WORD_BITS : (r["word"] + 1) * _WORD_BITS] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
    return np.packbits(out)


def _index_block(block: int, texts: list[bytes], ids: pa.Array, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents (term null), then for each term that may be wanted the documents, occurrences and the documents' sizes."""
    words = [t.translate(_FOLD).split() for t in texts]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = pa.array([w for own in words for w in own], pa.binary())
    codes = flat.dictionary_encode()
    terms = codes.dictionary.to_pylist()
    bits = np.fromiter((zlib.crc32(t) % FILTER_BITS for t in terms), dtype=np.int64, count=len(terms))
    keep = (wanted[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1 == 1
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), lengths)
    use = keep[code] if len(code) else np.zeros(0, dtype=bool)
    cells, tf = np.unique(code[use] * len(words) + doc[use], return_counts=True)
    of_term, at = np.divmod(cells, max(1, len(words)))
    held, starts = np.unique(of_term, return_index=True)
    offsets = pa.array(np.append(starts, len(cells)).astype(np.int32))
    empty, one = pa.list_(pa.int64()), pa.int64()
    rows = [
        [pa.array([block]), pa.nulls(1, pa.binary()), *[pa.nulls(1, empty)] * 3, pa.array([ids], pa.list_(ids.type)), pa.array([(lengths > 0).sum()], one), pa.array([lengths.sum()], one)],
        [
            pa.array(np.full(len(held), block)),
            codes.dictionary.take(pa.array(held)),
            *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at, tf.astype(np.int64), lengths[at])),
            pa.nulls(len(held), pa.list_(ids.type)),
            *[pa.nulls(len(held), one)] * 2,
        ],
    ]
    for columns in rows:
        yield pa.RecordBatch.from_arrays(columns, names=["block", "term", "docs", "tfs", "sizes", "doc_ids", "n_docs", "n_words"])


def _index(wanted: np.ndarray, most_docs: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        texts: list[bytes] = []
        ids: list = []
        held = 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                if texts and (held + len(raw) > most_bytes or len(texts) == most_docs):
                    yield from _index_block(block, texts, pa.array(ids, kind), wanted)
                    block, texts, ids, held = block + 1, [], [], 0
                texts.append(raw)
                ids.append(doc_id)
                held += len(raw)
        if texts:
            yield from _index_block(block, texts, pa.array(ids, kind), wanted)

    return run


def _impact(tf, n, docs: int, words: int):
    """The part of a score that does not depend on the term, in 64-bit integers."""
    m = 50 + (50 * n * docs) // max(1, words)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Best:
    """The ``top`` highest (score, smallest doc_id first) of an item in one block."""

    def __init__(self, top: int, floor: int):
        self.top, self.heap, self.floor = top, [], floor

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        for s, d in zip(scores.tolist(), docs.tolist(), strict=True):
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, (s, -d))
            elif (s, -d) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -d))
        if len(self.heap) == self.top:
            self.floor = max(self.floor, self.heap[0][0])


def _search_item(summed: tuple[np.ndarray, np.ndarray] | None, lists: list[tuple[int, tuple]], best: _Best, stretches: int, stretch: int) -> None:
    """Document-at-a-time over one block.

    ``summed`` is the iterator of accumulators (places, sums); ``lists`` are the long lists as
    (weight, (places, impacts, first posting of each stretch, largest impact of each stretch)).
    A stretch is skipped if the sum of its bounds is below the last rank; ties are kept, since
    the smaller doc_id may come later.
    """
    iterators = [(at, w * impact, first, w * top) for w, (at, impact, first, top) in lists]
    if summed is not None:
        at, sums = summed
        first = np.searchsorted(at, np.arange(stretches + 1) * stretch)
        top = np.zeros(stretches, dtype=np.int64)
        np.maximum.at(top, at // stretch, sums)
        iterators.append((at, sums, first, top))
    if not iterators:
        return
    bounds = np.stack([it[3] for it in iterators])
    for k in np.flatnonzero(bounds.sum(axis=0) >= max(1, best.floor)):
        here = bounds[:, k]
        if here.sum() < max(1, best.floor):
            continue  # the last rank has risen since
        order = np.argsort(-here, kind="stable")
        rest = here.sum()
        score = np.zeros(stretch, dtype=np.int64)
        seen = None
        for i in order:
            if not here[i]:
                break
            at, value, first, _ = iterators[i]
            part, gain = at[first[k] : first[k + 1]] - k * stretch, value[first[k] : first[k + 1]]
            if rest >= max(1, best.floor):  # the lists from here on can still bring a document to the last rank
                score[part] += gain
            else:
                if seen is None:
                    seen = np.flatnonzero(score + rest * (score > 0) >= max(1, best.floor))
                else:
                    seen = seen[score[seen] + rest >= max(1, best.floor)]
                if not len(seen):
                    break
                to = np.minimum(np.searchsorted(part, seen), len(part) - 1)
                hit = part[to] == seen
                score[seen[hit]] += gain[to[hit]]
            rest -= here[i]
        found = np.flatnonzero(score >= max(1, best.floor)) if seen is None else seen[score[seen] >= max(1, best.floor)]
        best.offer(score[found], found + k * stretch)


def _search(queries: dict, floors: dict, docs: int, words: int, top: int, stretch: int):
    """queries: item -> [(term, weight)] of its long lists; floors: item -> score that its last rank has at least."""

    def run(index: pa.Table, sums: pa.Table) -> pa.Table:
        head = index.filter(pc.is_null(index["term"]))
        ids = head["doc_ids"].combine_chunks().flatten()
        index = index.filter(pc.is_valid(index["term"]))
        stretches = -(-len(ids) // stretch)
        # places follow the doc_id, so that ties go to the smaller one; null comes last
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy() if len(ids) else np.zeros(0, dtype=np.int64)
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        lists = {}
        for term, *posting in zip(index["term"].to_pylist(), *(index[c].combine_chunks() for c in ("docs", "tfs", "sizes")), strict=True):
            at, tf, n = (x.values.to_numpy(zero_copy_only=False) for x in posting)
            impact = _impact(tf, n, docs, words)
            turn = np.argsort(place[at])
            at, impact = place[at][turn], impact[turn]
            first = np.searchsorted(at, np.arange(stretches + 1) * stretch)
            most = np.zeros(stretches, dtype=np.int64)
            np.maximum.at(most, at // stretch, impact)
            lists[term] = (at, impact, first, most)
        summed = {}
        if len(sums):
            item, at, value = (sums[c].to_numpy() for c in ("item", "at", "sum"))
            turn = np.lexsort((place[at], item))
            item, at, value = item[turn], place[at][turn], value[turn]
            cuts = np.append(np.flatnonzero(np.diff(item, prepend=item[0] - 1)), len(item))
            summed = {int(item[a]): (at[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)}
        out: list[tuple[int, int, int]] = []
        for item, terms in queries.items():
            own = [(w, lists[t]) for t, w in terms if t in lists]
            if own or item in summed:
                best = _Best(top, floors.get(item, 0))
                _search_item(summed.get(item), own, best, stretches, stretch)
                out += [(item, -d, s) for s, d in best.heap]
        items, at, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": ids.take(pa.array(order[list(at)] if at else [], pa.int64())), "score": pa.array(score, pa.int64())})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id, score: the highest scores above 0, equal scores by
    ascending doc_id, fewer rows if fewer score. All numbers of the score but the weights'
    logarithm are 64-bit integers (see the formulas in ``_impact`` and ``_weights``).

    A null text has no terms; a document without terms is not counted and not found, an item
    without terms has no rows. A null doc_id comes last among ties, repeated rows are ranked each,
    repeated item_ids too; further columns are ignored. Empty tables give no rows. Texts are
    read whole, and each counts with all its terms.

    Documents are tokenized once, into blocks of at most BLOCK_DOCS documents that keep the lists of
    terms of the items only, chosen by a filter of a fixed size. A pass over the index serves
    the items of a lot of about LOT_TERMS terms, which is all that a task holds of the items.
    """
    ids = materialize(items.select("item_id", lowered(F.col("text")).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))))
    terms = materialize(ids.select("item", found.alias("term")), "item-terms")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, term binary, docs array<long>, tfs array<long>, sizes array<long>, doc_ids array<{kind}>, n_docs long, n_words long"
    index = materialize(docs.select("doc_id", "text").mapInArrow(_index(_term_filter(terms), BLOCK_DOCS, BLOCK_BYTES), schema), "index")
    n_docs, n_words = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_words")).first())
    weighted = _weights(terms, index, n_docs)
    lots = max(1, -(-terms.count() // LOT_TERMS))
    parts = [_lot(weighted.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == k) if lots > 1 else weighted, index, n_docs, n_words, top, kind, k) for k in range(lots)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(ids.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _weights(terms: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(item, term, df, w, short): the terms that occur, and whether they belong to the item's short lists."""
    df = index.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
    joined = terms.select("item", F.col("term").cast("binary").alias("term")).join(df, "term")
    w = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    taken = F.sum("df").over(Window.partitionBy("item").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0))
    weighted = joined.withColumn("w", w).where("w > 0").withColumn("short", taken <= SHORT_POSTINGS)
    return materialize(weighted, "weights")


def _lot(weighted: DataFrame, index: DataFrame, n_docs: int, n_words: int, top: int, kind: str, number: int) -> DataFrame:
    """The best documents of each block for the items of one lot."""
    lists = index.where("term is not null").drop("doc_ids", "n_docs", "n_words")
    # a lot has about LOT_TERMS terms, so its tables can be sent to all tasks
    short = lists.join(F.broadcast(weighted.where("short").select("item", "term", "w")), "term")
    posting = short.select("block", "item", "w", F.explode(F.arrays_zip("docs", "tfs", "sizes")).alias("p")).selectExpr("block", "item", "w", "p.docs as at", "p.tfs as tf", "p.sizes as n")
    impact = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 20 * (50 + (50 * n * {n_docs}L) div {max(1, n_words)}L)))")
    sums = materialize(posting.groupBy("item", "block", "at").agg(F.sum(impact).cast("long").alias("sum")), f"accumulators-{number}")
    # any ``top`` documents bound the last rank from below: here those with the largest accumulators
    order = Window.partitionBy("item").orderBy(F.col("sum").desc())
    last = sums.select("item", "sum").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("item").agg(F.count("*").alias("n"), F.min("sum").alias("floor")).where(F.col("n") == top)
    floors = {r["item"]: r["floor"] for r in last.toLocalIterator()}
    long_lists = weighted.where("not short")
    queries: dict[int, list[tuple[bytes, int]]] = {r["item"]: [] for r in weighted.select("item").distinct().toLocalIterator()}
    for r in long_lists.select("item", "term", "w").toLocalIterator():
        queries[r["item"]].append((bytes(r["term"]), r["w"]))
    used = lists.join(F.broadcast(long_lists.select("term").distinct()), "term", "left_semi")
    heads = index.where("term is null").select("block", "doc_ids")
    both = used.unionByName(heads, allowMissingColumns=True)
    search = _search(queries, floors, n_docs, n_words, top, STRETCH)
    hits = both.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(search, f"item long, doc_id {kind}, score long")
    return materialize(hits, f"hits-{number}")
