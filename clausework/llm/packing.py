"""Packing documents into training sequences: Martello-Toth dominance reduction, then best fit.

Documents are tokenized and cut in a map. Only the number of pieces of each size (at most
``capacity`` numbers) goes to the driver, where the plan is made on counts: sets that dominate
all others are fixed, the rest is packed best-fit. The plan's bins have few different contents,
so it is a short list of patterns with multiplicities. Pieces get their rank within their size
from counts per task, and a rank names a place in the plan; no piece passes through the driver.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize

CAPACITY = 2048
#: Id that ends each document.
END_ID = 0
_END = END_ID.to_bytes(4, "little")
#: Words whose ids a Python worker remembers at most; then it starts over.
CACHE_WORDS = 1 << 19

_SPACE = re.compile(r"[\t-\r ]+")
#: Signs whose case, normal form and class do not depend on a Unicode version.
_PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: Fixed value: the tokenizer's own split, for texts of plain signs.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
#: Fixed value: the split that the shortcut stands for; another tokenizer takes the plain path.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[str, WordTokenizer] = {}


class _Words(dict):
    """The ids of words as unsigned little-endian 32-bit numbers, found out on first use."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if word.isalpha() and word.islower() and _PLAIN_TEXT.fullmatch(word):
            spelled = word if word.isascii() else self.tokenizer.pre_tokenizer.pre_tokenize_str(word)[0][0]
            ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class WordTokenizer:
    """A tokenizer file whose ids are remembered by word.

    Where words never join across white space (``word_bpe_49k.json``), a text's ids are those of
    its words, and each different word is encoded once. Other files encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _SPLIT in self.tokenizer.to_str().replace("\\\\", "\\")
        self.words = _Words(self.tokenizer)

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as ``encode(text, add_special_tokens=False)`` gives them, four bytes each."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _PIECE.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, filter(None, _SPACE.split(text))))


@dataclass
class Pattern:
    """``copies`` bins that each hold ``items``: (size, how many), in the order in which they lie in the bin."""

    copies: int
    items: list[tuple[int, int]]

    def filled(self) -> int:
        return sum(size * n for size, n in self.items)


def _largest(counts: Counter, at_most: int, without: Counter) -> int:
    """The largest size up to ``at_most`` of which more than ``without`` are left; 0 if none."""
    return next((s for s in range(at_most, 0, -1) if counts[s] > without[s]), 0)


def _smallest(counts: Counter, without: Counter, n: int, top: int) -> list[int]:
    """The ``n`` smallest sizes left, fewer if there are not so many."""
    out: list[int] = []
    for s in range(1, top + 1):
        left = counts[s] - without[s]
        out += [s] * min(left, n - len(out)) if left > 0 else []
        if len(out) == n:
            break
    return out


def _dominating(counts: Counter, j: int, capacity: int) -> list[int] | None:
    """Sizes that share a bin with one piece of size ``j`` in some best packing, or None if that is not proven.

    A set dominates another if its members can be swapped, each for a group of the other's that
    is no larger. Proven are: j alone if nothing fits beside it; j and the size that fills the
    bin; j and the largest that fits, if no two fit or no two that fit are larger together; j
    and a pair, if no three fit and each single piece or pair that fits is no larger than it,
    piece by piece.
    """
    room, own = capacity - j, Counter([j])
    first = _largest(counts, room, own)
    if not first:
        return []
    if first == room:
        return [first]
    small = _smallest(counts, own, 3, room)
    if len(small) < 2 or small[0] + small[1] > room:
        return [first]
    if len(small) == 3 and sum(small) <= room:
        return None
    best = 0
    for a in range(min(first, room - 1), 0, -1):  # the largest pair that fits: a is its larger piece
        if 2 * a <= best:
            break
        if counts[a] > own[a] and (b := _largest(counts, min(a, room - a), own + Counter([a]))):
            best = max(best, a + b)
    if best <= first:
        return [first]
    second = _largest(counts, room - first, own + Counter([first]))
    if not second:
        return None
    # a pair of two pieces above the second one would not be swapped piece by piece
    above = Counter({s: n - own[s] for s, n in counts.items() if s > second and n > own[s]})
    two = _smallest(above, Counter(), 2, room)
    return [first, second] if len(two) < 2 or sum(two) > room else None


def dominance_reduction(counts: Counter, capacity: int) -> list[Pattern]:
    """Fix sets that dominate all others, largest piece first, until none is left to fix; takes them out of ``counts``.

    As long as the sizes of a fixed set are left, the proof holds for its next copy too, since
    taking pieces away makes no new set fit: copies are fixed together.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0 and (partners := _dominating(counts, j, capacity)) is not None:
                own = Counter([j, *partners])
                copies = min(counts[s] // n for s, n in own.items())
                counts.subtract({s: n * copies for s, n in own.items()})
                fixed.append(Pattern(copies, sorted(own.items(), reverse=True)))
                again = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: each piece goes to the fullest bin that takes it, equal bins together.

    Each size splits at most one group of equal bins and opens at most two, so that there are
    at most 3 * capacity patterns whatever the number of pieces.
    """
    open_bins: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def put(copies: int, items: list[tuple[int, int]], room: int) -> None:
        if copies:
            (open_bins.setdefault(room, []) if room else done).append(Pattern(copies, items))

    for size in range(capacity, 0, -1):
        left = counts[size]
        for room in [r for r in sorted(open_bins) if r >= size]:
            fit = room // size
            while left and open_bins.get(room):
                bins = open_bins[room].pop()
                full = min(bins.copies, left // fit)
                put(full, [*bins.items, (size, fit)], room - fit * size)
                left -= full * fit
                rest = bins.copies - full
                if rest and left:
                    put(1, [*bins.items, (size, left)], room - left * size)
                    rest, left = rest - 1, 0
                put(rest, bins.items, room)
        fit = capacity // size
        put(left // fit, [(size, fit)], capacity - fit * size)
        if left % fit:
            put(1, [(size, left % fit)], capacity - left % fit * size)
    return done + [p for own in open_bins.values() for p in own]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together hold all pieces: proven sets first, best fit for the rest."""
    left = Counter({s: n for s, n in counts.items() if n > 0})
    return dominance_reduction(left, capacity) + best_fit(left, capacity)


def _places(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """For each size rows of (first rank, pieces in a bin, first bin, offset in the bin), in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    bins = 0
    for p in plan:
        offset = 0
        for size, n in p.items:
            out.setdefault(size, []).append((ranks[size], n, bins, offset))
            ranks[size] += n * p.copies
            offset += n * size
        bins += p.copies
    return {s: np.array(rows, dtype=np.int64) for s, rows in out.items()}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(path)
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            docs, out = batch.column(0), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = tokenizer.ids(text or "") + _END
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    size = len(own) // 4
                    out.append((row, piece, start, size, zlib.crc32(own), seen[size], own))
                    seen[size] += 1
                    if len(out) >= 4096:
                        yield _piece_batch(docs, out, task, with_ids)
                        out = []
            if out:
                yield _piece_batch(docs, out, task, with_ids)

    return run


def _piece_batch(docs: pa.Array, out: list[tuple], task: int, with_ids: bool) -> pa.RecordBatch:
    rows, piece, start, size, crc, rank, ids = zip(*out, strict=True)
    columns = {
        "doc_id": docs.take(pa.array(rows, pa.int64())),
        "piece": pa.array(piece, pa.int32()),
        "start": pa.array(start, pa.int64()),
        "length": pa.array(size, pa.int64()),
        "ids_crc32": pa.array(crc, pa.int64()),
        "task": pa.array([task] * len(out), pa.int32()),
        "own_rank": pa.array(rank, pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def _placed(places: dict[int, np.ndarray], carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            bins, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                rows = places[int(s)]
                first, n, base, begin = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1].T
                bins[at] = base + (rank[at] - first) // n
                offset[at] = begin + (rank[at] - first) % n * s
            columns = {c: batch.column(c) for c in carry}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(bins), "offset": pa.array(offset)})

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece (from 0), start (ids of its document before it),
    length, ids_crc32 (CRC-32 of the ids as unsigned little-endian 32-bit numbers), sequence_id,
    offset (place in the sequence; sequences have no gaps), and with ``with_ids`` the ids.

    A document is its text's ids and END_ID; only longer ones are cut, into pieces of
    ``capacity`` ids, the last may be shorter. A null or empty text is END_ID alone. A null
    doc_id is a value, repeated rows are packed each; further columns are left out. An empty
    table gives no rows. Texts are tokenized whole.

    The tokenizer's file must exist at the same path on all executors. The pieces' table is
    written once, so that ranks stay as they are when an executor is lost. A size with a third
    of all rows spreads over as many groups as there are tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, own_rank long{ids}"
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema), "pieces")
    own = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = materialize(own.selectExpr("task", "length", "n", "cast(coalesce(sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding), 0) as long) as before"), "piece-ranks")
    # one row per size, at most ``capacity`` of them
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    places = _places(packing_plan(counts, capacity))
    carry = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    # a row for each task and size: it grows with the input, so it is not to be broadcast
    ranked = pieces.join(before.drop("n").hint("shuffle_merge"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("own_rank"))
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    return ranked.select(*carry, "rank").mapInArrow(_placed(places, carry), out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the sequences of a packing ``with_ids``, each a group of at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
