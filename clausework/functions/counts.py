"""Counts over whole texts that Spark's functions could only make by interpreted lambdas, as one Arrow kernel.

Each text crosses to Python once, whatever is counted: signs by a table of character classes, which also
finds the few tokens that can be damaged; words by a look-up, phrases and the cues of patterns by an automaton
each. Everything that is decided from the counts stays in Spark expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import vocab
from clausework.functions.dialect import SPARK, SparkSql, spaced_cues

#: What can be counted, with the fields that each part gives.
PARTS = {
    "signs": "n_all int, n_alnum int, n_space int, n_letter int, n_upper int, n_vowel int",
    "tokens": "n_tokens int, malformed_count int, quoted_count int, digit_letter_mix_count int, may_run boolean, may_burst boolean",
    "words": "n_plain int, n_known int, n_trust int, n_legal int",
    "phrases": "p_hits long",
    "policy": "policy_hits long, policy_matched string, contract_hits long, contract_matched string",
    "types": "t_hits array<long>",
    "cues": "cued long",
}
#: Patterns that are searched in texts with a cue of theirs only, a bit of ``cued`` for each.
CUED = [p for p in dict.fromkeys(vocab.OUTLINES) if spaced_cues(p)][:63]
#: Tokens whose marks a worker remembers, the first it meets; results do not depend on it.
REMEMBERED = 200_000
CLEAN = (False, False, 0)
_SPECIAL_2 = re.compile(r"[^\w\s]{2,}")
_BURST = re.compile(r"[!@#$%^&*]{2,}")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxyz]{5,}", re.IGNORECASE)
_INNER = re.compile(r"[a-zA-Z][^\w\s][a-zA-Z]")
_CODE = re.compile(r"[a-zA-Z0-9]{3,}")
_SWAPS = re.compile(r"[01](?=[a-zA-Z])|(?<=[a-zA-Z])[01]")
_NO_WORD = re.compile(r"\W")
_WORD = re.compile(r"[a-z]{3,}")
_BETWEEN_WORDS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))
#: Bits of the table of character classes.
ALNUM, SPACE, LETTER, CAPITAL, VOWEL, CONSONANT, BURST, WORD_END = (1 << k for k in range(8))


def token_marks(w: str) -> tuple[bool, bool, int]:
    """(damaged, damaged by the tests for quotes, marks of digits mixed with letters) of one token."""
    plain = w if w[-1].isalnum() else w[:-1]
    if plain.isalpha():
        # a word of letters, with at most one sign behind it, fails the test of consonants or none
        return (True, False, 0) if len(plain) >= 3 and _CONSONANTS.search(plain) else CLEAN
    clean = _NO_WORD.sub("", w)
    doubled = bool(_SPECIAL_2.search(w))
    burst = bool(_BURST.search(w))
    if len(clean) < 3:
        short = len(w) >= 3 and (doubled or burst)
        return short, short, 0
    mixed = bool(_CODE.fullmatch(clean)) and bool(re.search("[0-9]", clean)) and bool(re.search("[a-zA-Z]", clean))
    digits = sum("0" <= c <= "9" for c in clean)
    partly = mixed and 0.1 * len(clean) <= digits <= 0.6 * len(clean)
    swaps = len(_SWAPS.findall(w)) + sum(c in "@%!$" for c in w)
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "s" for c in w]
    switching = len(w) >= 4 and sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= 3
    quoted = partly or doubled or switching or swaps >= 2 or burst
    return quoted or bool(_CONSONANTS.search(clean)) or bool(_INNER.search(w)), quoted, int(partly) + int(mixed and swaps >= 2)


@cache
def _sign_classes() -> np.ndarray:
    """Bits of every code point: letter or number, white space, letter, capital, ASCII vowel, consonant, sign of bursts, end of a word."""
    bits = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        sign = chr(point)
        kind = unicodedata.category(sign)
        bits[point] = (kind[0] in "LN") * ALNUM + sign.isspace() * SPACE + (kind[0] == "L") * LETTER + (kind == "Lu") * CAPITAL + sign.isalnum() * WORD_END
    for sign in "aeiouAEIOU":
        bits[ord(sign)] |= VOWEL
    for sign in r"!@#$%^&*+=~|\<>?":
        bits[ord(sign)] |= BURST
    for m in re.finditer("[bcdfghjklmnpqrstvwxyz]", "".join(map(chr, range(0x110000))), re.IGNORECASE):
        bits[m.start()] |= CONSONANT
    return bits


def _row(flags: np.ndarray, n: int) -> np.ndarray:
    """Places from which on a flag is set n times in a row."""
    last = max(len(flags) - n + 1, 0)
    held = flags[:last]
    for k in range(1, n):
        held = held & flags[k : k + last]
    return np.flatnonzero(held)


class Signs:
    """Some texts as one array of code points with a line break behind each, so that nothing runs on from text to text."""

    def __init__(self, texts: Sequence[str]):
        self.text = "\n".join([*texts, ""])
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.bits = _sign_classes()[self.points]
        self.sizes = np.array([len(t) for t in texts])
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1

    def _in_texts(self, places: np.ndarray) -> np.ndarray:
        """How many of the sorted places lie in each text."""
        return np.diff(np.searchsorted(places, self.begins), append=len(places))

    def sign_counts(self) -> list[tuple[int, ...]]:
        each = [np.add.reduceat((self.bits & bit) > 0, self.begins, dtype=np.int64) for bit in (ALNUM, SPACE, LETTER, CAPITAL, VOWEL)]
        each[1] -= 1
        return list(zip(*(x.tolist() for x in (self.sizes, *each)), strict=True))

    def token_counts(self, marks: dict[str, tuple[bool, bool, int]]) -> list[list[object]]:
        """Counts of tokens and of those damaged, and whether runs of one sign and bursts are possible.

        A token of letters with at most one sign behind it and no five consonants in a row is clean; only the others are looked at.
        """
        bits, points = self.bits, self.points
        inside = np.concatenate([[False], (bits & SPACE) == 0])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        odd = np.flatnonzero((bits & (LETTER | SPACE)) == 0)
        odd = odd[((bits[odd] & WORD_END) > 0) | ((bits[odd + 1] & SPACE) == 0)]
        at = np.zeros(len(starts), dtype=bool)
        for places in (odd, _row((bits & CONSONANT) > 0, 5)):
            at[np.searchsorted(starts, places, side="right") - 1] = True
        found = []
        for start, end in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            w = self.text[start:end]
            seen = marks.get(w)
            if seen is None:
                seen = token_marks(w)
                if len(marks) < REMEMBERED:
                    marks[w] = seen
            found.append(seen)
        of = np.searchsorted(self.begins, starts[at], side="right") - 1
        total = [np.bincount(of, weights=x, minlength=len(self.sizes)).astype(np.int64) for x in np.array(found, dtype=np.int64).reshape(-1, 3).T]
        same = _row(points[1:] == points[:-1], 2)
        same = same[(points[same] > 127) | ((bits[same] & (ALNUM | SPACE)) == 0)]
        burst = _row((bits & BURST) > 0, 3)
        columns = [self._in_texts(starts), *total, self._in_texts(same) > 0, self._in_texts(burst) > 0]
        return list(zip(*(x.tolist() for x in columns), strict=True))


def in_lots(texts: Sequence[str], size: int = 200_000) -> Iterator[list[str]]:
    """Texts in lots of about ``size`` characters; one that is longer is a lot of its own."""
    lot: list[str] = []
    room = size
    for text in texts:
        if lot and len(text) > room:
            yield lot
            lot, room = [], size
        lot.append(text)
        room -= len(text) + 1
    if lot:
        yield lot


class Phrases:
    """Occurrences of each of a list of phrases in a text, those of one phrase not overlapping."""

    def __init__(self, phrases: Sequence[str]):
        self.lengths = [len(p) for p in phrases]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()

    def counts(self, text: str) -> list[int]:
        found, free = [0] * len(self.lengths), [0] * len(self.lengths)
        for end, k in self.automaton.iter(text):
            if end + 1 - self.lengths[k] >= free[k]:
                found[k] += 1
                free[k] = end + 1
        return found


class Cues:
    """Which of some patterns a text in lower case can match, as bits: those of which it holds a cue, with any white space between its words."""

    def __init__(self, patterns: Sequence[str]):
        held: dict[str, int] = {}
        for k, p in enumerate(patterns):
            for w in spaced_cues(p):
                held[w] = held.get(w, 0) | 1 << k
        self.automaton = ahocorasick.Automaton()
        for w, bits in held.items():
            self.automaton.add_word(w, bits)
        self.automaton.make_automaton()

    def bits(self, low: str) -> int:
        for sign in "\t\n\v\f\r":
            low = low.replace(sign, " ")
        while "  " in low:
            low = low.replace("  ", " ")
        out = 0
        for _, bits in self.automaton.iter(low):
            out |= bits
        return out


def has_outline(q: SparkSql, t: str, pattern: str) -> str:
    """Whether ``t`` matches one of the patterns; Spark searches it only where the part "cues" found a cue."""
    found = q.has(t, pattern)
    return f"(getbit(cued, {CUED.index(pattern)}) = 1 and {found})" if q is SPARK and pattern in CUED else found


def _distinct(*lists: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(p for items in lists for p in items))


def text_counts(
    parts: Sequence[str], dictionary: Sequence[str] = vocab.DICTIONARY, trust: Sequence[str] = vocab.TRUST_WORDS, legal: Sequence[str] = vocab.LEGAL_WORDS,
    phrases: Sequence[str] = vocab.LEGAL_PHRASES, policy: Sequence[str] = vocab.POLICY_WORDS, contract: Sequence[str] = vocab.CONTRACT_SIGNALS,
    types: Mapping[str, Sequence[str]] = vocab.POLICY_TYPES, k: int = 10,
):
    """A vectorized function from texts to the fields of the chosen PARTS; null counts as empty."""
    sets, most = (dictionary, trust, legal), k
    terms = {"policy": policy, "contract": contract}
    single = {n: frozenset(x for x in t if " " not in x) for n, t in terms.items()}
    several = {n: _distinct([x for x in t if " " in x]) for n, t in terms.items()}
    wanted = _distinct(phrases if "phrases" in parts else (), *(several.values() if "policy" in parts else ()), *(types.values() if "types" in parts else ()))
    place = {p: i for i, p in enumerate(wanted)}
    names = [f.split(" ")[0] for p in parts for f in PARTS[p].split(", ")]
    state: dict[str, object] = {"marks": {}}
    # what each word counts for: a bit for each set, then one for each list of single terms
    counts_for: dict[bytes, int] = {}
    for bit, items in enumerate([*sets, *single.values()]):
        for w in items:
            if _WORD.fullmatch(w):
                counts_for[w.encode()] = counts_for.get(w.encode(), 0) | 1 << bit

    def row(text: str, signs: Sequence[int], tokens: Sequence[object]) -> tuple:
        low = text.lower()
        out: list[object] = []
        if {"words", "policy"} & set(parts):
            words = low.encode("utf-8", "surrogatepass").translate(_BETWEEN_WORDS).split()
            known = [(w, n, counts_for[w]) for w, n in Counter(filter(counts_for.__contains__, words)).items()]
        if "phrases" not in state:
            state["phrases"] = Phrases(wanted) if wanted else None
            state["cues"] = Cues(CUED) if "cues" in parts else None
        found = state["phrases"].counts(low) if wanted else []
        for part in parts:
            if part == "signs":
                out += signs
            elif part == "tokens":
                out += tokens
            elif part == "words":
                out += [sum(len(w) > 2 for w in words), *(sum(n for _, n, of in known if of >> k & 1) for k in range(len(sets)))]
            elif part == "cues":
                out.append(state["cues"].bits(low))
            elif part == "phrases":
                out.append(sum(found[place[p]] for p in dict.fromkeys(phrases)))
            elif part == "policy":
                for k, name in enumerate(terms, len(sets)):
                    hits = {w.decode(): n for w, n, of in known if of >> k & 1}
                    matched = sorted([*hits, *(p for p in several[name] if found[place[p]])])
                    out += [sum(hits.values()) + sum(found[place[p]] for p in several[name]), "|".join(matched[:most])]
            else:
                out.append([sum(found[place[p]] for p in dict.fromkeys(items)) for items in types.values()])
        return tuple(out)

    def rows(texts: list[str]) -> Iterator[tuple]:
        signs = Signs(texts) if {"signs", "tokens"} & set(parts) else None
        none: list[Sequence] = [()] * len(texts)
        return map(row, texts, signs.sign_counts() if "signs" in parts else none, signs.token_counts(state["marks"]) if "tokens" in parts else none)

    @F.pandas_udf(", ".join(PARTS[p] for p in parts))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([r for lot in in_lots([t or "" for t in texts]) for r in rows(lot)], columns=names)

    return run


def with_counts(docs: DataFrame, parts: Sequence[str], text: str = "text", **lists) -> DataFrame:
    """The fields of the chosen PARTS as columns beside the others."""
    return docs.withColumn("_counts", text_counts(parts, **lists)(text)).select("*", "_counts.*").drop("_counts")
