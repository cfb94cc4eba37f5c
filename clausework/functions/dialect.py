"""Spellings of the few expressions that Spark SQL and DuckDB write differently.

Operators state their rules once, as text over these spellings: Spark runs them through
``expr``, and the oracle queries run the same rules in DuckDB.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Mapping, Sequence
from functools import cache
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SparkSql:
    """Spark's spelling."""

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def regex(self, pattern: str) -> str:
        return "r'" + pattern.replace("'", r"\x27") + "'"

    def has(self, t: str, pattern: str) -> str:
        return f"({t} rlike {self.regex(pattern)})"

    def count(self, t: str, pattern: str) -> str:
        return f"regexp_count({t}, {self.regex(pattern)})"

    def all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.regex(pattern)}, 0)"

    def first(self, t: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({t}, {self.regex(pattern)}, {group})"

    def replace(self, t: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({t}, {self.regex(pattern)}, {self.text(re.sub(r'<([0-9])>', r'$\1', to))})"

    def keep(self, items: str, x: str, condition: str) -> str:
        return f"filter({items}, {x} -> {condition})"

    def each(self, items: str, x: str, value: str) -> str:
        return f"transform({items}, {x} -> {value})"

    def some(self, items: str, x: str, condition: str) -> str:
        return f"exists({items}, {x} -> {condition})"

    def size(self, items: str) -> str:
        return f"size({items})"

    def join(self, items: str, by: str) -> str:
        return f"array_join({items}, {self.text(by)})"

    def split(self, t: str, pattern: str) -> str:
        return f"split({t}, {self.regex(pattern)})"

    def array(self, items: Sequence[str]) -> str:
        return f"array({', '.join(items)})"

    def sorted(self, items: str) -> str:
        return f"array_sort({items})"

    def distinct(self, items: str) -> str:
        return f"array_distinct({items})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def head(self, items: str, n: int) -> str:
        return f"slice({items}, 1, {n})"

    def total(self, items: str) -> str:
        return f"aggregate({items}, cast(0 as bigint), (s, x) -> s + x)"

    def contains(self, t: str, part: str) -> str:
        return f"contains({t}, {part})"

    def strip(self, t: str) -> str:
        """Without white space at either end."""
        return self.replace(t, r"^\s+|\s+$")

    def at(self, items: str, index: str) -> str:
        """The item at an index from 0, null where there is none."""
        return f"get({items}, cast({index} as int))"

    def last(self, items: str) -> str:
        return f"try_element_at({items}, -1)"

    def cut(self, items: str, start: str, length: str) -> str:
        """Items from an index from 0."""
        return f"slice({items}, cast({start} + 1 as int), cast({length} as int))"

    def where(self, items: str, x: str, condition: str) -> str:
        """Indexes from 0 of the items for which the condition holds."""
        return f"filter(transform({items}, ({x}, _k) -> if({condition}, _k, -1)), _k -> _k >= 0)"

    def least_of(self, items: str) -> str:
        return f"array_min({items})"

    def most_of(self, items: str) -> str:
        return f"array_max({items})"


class DuckSql(SparkSql):
    """DuckDB's spelling."""

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def regex(self, pattern: str) -> str:
        return "'" + pattern.replace("'", r"\x27") + "'"

    def has(self, t: str, pattern: str) -> str:
        return f"regexp_matches({t}, {self.regex(pattern)})"

    def count(self, t: str, pattern: str) -> str:
        return f"len(regexp_extract_all({t}, {self.regex(pattern)}))"

    def all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.regex(pattern)})"

    def replace(self, t: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({t}, {self.regex(pattern)}, {self.text(re.sub(r'<([0-9])>', r'\\\1', to))}, 'g')"

    def keep(self, items: str, x: str, condition: str) -> str:
        return f"list_filter({items}, lambda {x}: {condition})"

    def each(self, items: str, x: str, value: str) -> str:
        return f"list_transform({items}, lambda {x}: {value})"

    def some(self, items: str, x: str, condition: str) -> str:
        return f"(len(list_filter({items}, lambda {x}: {condition})) > 0)"

    def size(self, items: str) -> str:
        return f"len({items})"

    def join(self, items: str, by: str) -> str:
        return f"array_to_string({items}, {self.text(by)})"

    def split(self, t: str, pattern: str) -> str:
        return f"string_split_regex({t}, {self.regex(pattern)})"

    def array(self, items: Sequence[str]) -> str:
        return f"[{', '.join(items)}]"

    def sorted(self, items: str) -> str:
        return f"list_sort({items})"

    def distinct(self, items: str) -> str:
        return f"list_distinct({items})"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def head(self, items: str, n: int) -> str:
        return f"({items})[1:{n}]"

    def total(self, items: str) -> str:
        return f"coalesce(list_sum({items}), 0)"

    def at(self, items: str, index: str) -> str:
        return f"({items})[cast({index} as int) + 1]"

    def last(self, items: str) -> str:
        return f"({items})[-1]"

    def cut(self, items: str, start: str, length: str) -> str:
        return f"({items})[cast({start} as int) + 1 : cast({start} + {length} as int)]"

    def where(self, items: str, x: str, condition: str) -> str:
        return f"list_filter(list_transform({items}, lambda {x}, _k: case when {condition} then cast(_k - 1 as int) else -1 end), lambda _k: _k >= 0)"

    def least_of(self, items: str) -> str:
        return f"list_min({items})"

    def most_of(self, items: str) -> str:
        return f"list_max({items})"


SPARK, DUCK = SparkSql(), DuckSql()
Layer = Mapping[str, str]


def with_layers(df: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """Add each layer's columns; a layer sees those before it."""
    for layer in layers:
        df = df.withColumns({name: F.expr(e) for name, e in layer.items()})
    return df


def layers_sql(table: str, layers: Sequence[Layer]) -> str:
    """The same in DuckDB: nested selects."""
    for layer in layers:
        table = f"(select *, {', '.join(f'{e} as {name}' for name, e in layer.items())} from {table})"
    return table


MOST_CUES = 20


def cues(pattern: str) -> list[str]:
    """Lower-case words of which every match of a pattern holds one, the longest choice that the pattern's parts give; none if there is no such choice.

    A plain search for a few words costs a small part of a case-insensitive pattern over a long text, and most texts hold none.
    """

    rank = lambda words: (min(map(len, words)), -len(words))

    def of(parts) -> list[str] | None:
        best: list[str] | None = None
        run = ""

        def offer(words: list[str] | None) -> None:
            nonlocal best
            words = sorted({w for w in words or () if not any(other != w and other in w for other in words)})  # a word that holds another one tells no more
            if words and len(words) <= MOST_CUES and min(map(len, words)) >= 3 and (best is None or rank(words) > rank(best)):
                best = words

        for op, value in [*parts, (None, None)]:
            if op is sre.LITERAL:
                run += chr(value).lower()
                continue
            offer([run] if run else None)
            run = ""
            if op is sre.SUBPATTERN:
                offer(of(value[-1]))
            elif op is sre.BRANCH:
                each = [of(branch) for branch in value[1]]
                offer(sorted({w for words in each for w in words}) if all(each) else None)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                offer(of(value[2]))
        return best

    return of(_parsed(pattern)) or []


def has_cued(q: SparkSql, t: str, low: str, pattern: str) -> str:
    """Whether ``t`` matches; Spark first looks for the pattern's cues in ``low``, the text in lower case."""
    words = cues(pattern) if q is SPARK else []
    found = q.has(t, pattern)
    return f"({any_of([q.contains(low, q.text(w)) for w in words])} and {found})" if words else found


MOST_SPELLINGS = 200
_SPACES = [(sre.IN, [(sre.CATEGORY, sre.CATEGORY_SPACE)])]


def _parsed(pattern: str):
    return sre.parse(re.sub(r"\\x\{([0-9a-fA-F]{2})\}", r"\\x\1", pattern))


def _spellings(op, value) -> list[str] | None:
    """All texts that a part of a pattern stands for, in lower case and with white space as one space; None if they are many."""
    out: set[str] | None = None
    if op is sre.LITERAL:
        out = {chr(value).lower()}
    elif op is sre.AT:
        out = {""}
    elif op is sre.IN:
        if value == _SPACES[0][1]:
            out = {" "}
        elif all(kind is sre.LITERAL for kind, _ in value):
            out = {chr(x).lower() for _, x in value}
    elif op is sre.SUBPATTERN:
        out = _sequences(value[-1])
    elif op is sre.BRANCH:
        each = [_sequences(branch) for branch in value[1]]
        out = None if None in each else set().union(*each)
    elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        if list(inner) == _SPACES:
            out = {" "} if least else {"", " "}
        elif most == 1:
            once = _sequences(inner)
            out = None if once is None else once if least else once | {""}
    return None if out is None or len(out) > MOST_SPELLINGS else sorted(out)


def _sequences(parts) -> set[str] | None:
    out = {""}
    for op, value in parts:
        more = _spellings(op, value)
        if more is None or len(out) * len(more) > MOST_SPELLINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


@cache
def spaced_cues(pattern: str) -> tuple[str, ...]:
    """As ``cues``, for texts in lower case with one space in place of each run of white space: words that follow each other make one cue."""
    rank = lambda words: (min(map(len, words)), -len(words))

    def of(parts) -> set[str] | None:
        best: set[str] | None = None
        run = {""}

        def offer(words: set[str] | None) -> None:
            nonlocal best
            words = {re.sub(" +", " ", w).strip() for w in words or ()}
            words = {w for w in words if not any(other != w and other in w for other in words)}
            if words and min(map(len, words)) >= 2 and (best is None or rank(words) > rank(best)):
                best = words

        for op, value in parts:
            more = _spellings(op, value)
            if more is not None and len(run) * len(more) <= MOST_SPELLINGS:
                run = {a + b for a, b in product(run, more)}
                continue
            offer(run)
            run = set(more or {""})
            if more is None and op is sre.SUBPATTERN:
                offer(of(value[-1]))
            elif more is None and op is sre.BRANCH:
                each = [of(branch) for branch in value[1]]
                offer(set().union(*each) if all(each) else None)
            elif more is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                inner = _sequences(value[2])
                offer(of(value[2]) if inner is None else {"".join(w) for w in product(inner, repeat=value[0])} if len(inner) ** value[0] <= MOST_SPELLINGS else inner)
        offer(run)
        return best

    return tuple(sorted(of(_parsed(pattern)) or ()))


def any_of(items: Sequence[str]) -> str:
    return "(" + " or ".join(items) + ")"


def flag_sum(conditions: Sequence[str]) -> str:
    """How many of the conditions hold."""
    return "(" + " + ".join(f"cast({c} as int)" for c in conditions) + ")"


def words_in(values: Sequence[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def clamp(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


def piecewise(x: str, steps: Sequence[tuple[float, str]], otherwise: str) -> str:
    """The value of the first step whose bound x does not exceed."""
    return "cast(case " + " ".join(f"when {x} <= {bound} then {value}" for bound, value in steps) + f" else {otherwise} end as double)"
