"""Words and five-word shingles of whole texts as 64-bit hashes, many texts at a time.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False
#: Signs that stand for letters in disguised words.
_ALIKE = _LOWER.copy()
_ALIKE[list(b"0134578@$!|")] = list(b"oieastbasil")
_NO_ALIKE = _NO_LETTER.copy()
_NO_ALIKE[list(b"0134578@$!|")] = False
_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits; each salt gives another function."""
    h = h + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, dtype=_U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


def _hash_segment(raw: np.ndarray, starts: np.ndarray, lower: np.ndarray, gaps: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated texts, and for each text the number of words before it."""
    space = gaps[raw]
    first = ~space
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[starts] = True
    begins = first.copy()
    begins[1:] &= space[:-1] | cut[1:-1]
    ends = first.copy()
    ends[:-1] &= space[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum((lower[raw].astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
        if prefixes:
            to = np.stack([np.minimum(s + k, e) if k else e for k in prefixes], axis=1)
            h = mix((sums[to] - sums[s][:, None]) * down[s][:, None])
        else:
            h = mix((sums[e] - sums[s]) * down[s])
    return h, np.searchsorted(s, starts)


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of about CHUNK_BYTES; a longer text is cut at white space into several pieces."""
    ids: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK_BYTES:
            if ids:
                yield ids, parts
                ids, parts, held = [], [], 0
            at = 0
            while at < len(t):
                to = min(len(t), at + CHUNK_BYTES)
                while to < len(t) and t[to] not in b" \t\n\r\x0b\x0c":
                    to += 1
                yield [i], [t[at:to]]
                at = to
            continue
        ids.append(i)
        parts.append(t)
        held += len(t)
        if held >= CHUNK_BYTES:
            yield ids, parts
            ids, parts, held = [], [], 0
    if ids:
        yield ids, parts


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def letter_hashes(texts: list[bytes], prefixes: tuple[int, ...] = (), look_alikes: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the runs of letters of each text, lower-cased, one row per run.

    The first column has the whole run, the others its first ``prefixes`` bytes (the whole run
    where it is shorter). look_alikes reads digits and signs as the letters that they resemble.
    """
    texts = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    tables = (_ALIKE, _NO_ALIKE) if look_alikes else (_LOWER, _NO_LETTER)
    return word_hashes(texts, *tables, prefixes=(0, *prefixes))


def word_hashes(texts: list[bytes], lower: np.ndarray = _LOWER, gaps: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of its words in order) for each text, in order."""
    waiting: dict[int, list[np.ndarray]] = {}
    last = -1
    for ids, parts in _segments(texts):
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        if len(raw):
            h, at = _hash_segment(raw, starts, lower, gaps, prefixes)
        else:
            h, at = np.zeros((0, len(prefixes)) if prefixes else 0, dtype=_U), np.zeros(len(parts), dtype=np.int64)
        bounds = np.append(at, len(h))
        for k, i in enumerate(ids):
            piece = h[bounds[k] : bounds[k + 1]]
            if i != last and last in waiting:
                yield last, np.concatenate(waiting.pop(last))
            last = i
            if len(texts[i]) > CHUNK_BYTES:
                waiting.setdefault(i, []).append(piece)
            else:
                yield i, piece
    for i, pieces in waiting.items():
        yield i, np.concatenate(pieces)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each run of ``size`` words; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < size:
            return mix((words * _STEPS[:n]).sum(dtype=_U, keepdims=True), salt=100 + n)
        out = words[: n - size + 1] * _STEPS[0]
        for k in range(1, size):
            out = out + words[k : n - size + 1 + k] * _STEPS[k]
        return mix(out, salt=7)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words))
