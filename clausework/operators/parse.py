"""Model responses to findings (J-1 to J-7): Spark's JSON functions first, a helper only for what they reject."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("issue_title", "severity", "category", "location", "quoted_text", "risk_explanation", "suggested_improvement")
#: Other names of the fields, and the labels of the text form.
ALIASES = {
    "title": "issue_title", "issue": "issue_title", "risk_level": "severity", "quote": "quoted_text", "quoted": "quoted_text", "suggested_rewrite": "suggested_improvement", "text": "quoted_text", "clause": "quoted_text",
    "explanation": "risk_explanation", "risk": "risk_explanation", "improvement": "suggested_improvement", "suggestion": "suggested_improvement", "recommendation": "suggested_improvement", "section": "location",
}
LABELS = {"Issue": "issue_title", "Severity": "severity", "Category": "category", "Location": "location", "Quoted Text": "quoted_text", "Risk Explanation": "risk_explanation", "Suggested Improvement": "suggested_improvement"}
ITEMS = "array<map<string,string>>"


#: Spans nested deeper hold no findings that a decoder could read.
MOST_NESTED = 200
_DECODER = json.JSONDecoder(strict=False)
_FENCE = re.compile(r"```[a-zA-Z]*[ \t]*\n?(.*?)(?:```|\Z)", re.DOTALL)


class _Brackets:
    """One pass over a text that pairs its brackets.

    Whether a bracket counts depends on the quotes before it, and prose may hold a stray one. So
    both readings are followed: brackets behind an even and behind an odd number of quotes pair
    among themselves. ``spans`` are (start, end, reading, height) by start; an unclosed one ends with the text.
    """

    def __init__(self, text: str):
        self.text = text
        stacks: tuple[list, list] = ([], [])
        self.commas: tuple[list[int], list[int]] = ([], [])
        self.spans: list[tuple[int, int, int, int]] = []
        self.quotes: list[int] = []
        odd, skip = 0, False
        for i, c in enumerate(text):
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                odd ^= 1
                self.quotes.append(i)
            elif c in "[{":
                stacks[odd].append([i, c, 0])
            elif c in "]}" and stacks[odd] and (stacks[odd][-1][1] == "[") == (c == "]"):
                start, _, height = stacks[odd].pop()
                self.spans.append((start, i + 1, odd, height + 1))
                if stacks[odd]:
                    stacks[odd][-1][2] = max(stacks[odd][-1][2], height + 1)
            elif c == ",":
                self.commas[odd].append(i)
        self.odd = odd
        for reading, left in enumerate(stacks):
            for k, (start, _, height) in enumerate(left):
                self.spans.append((start, len(text), reading, height + len(left) - k))
        self.open = [[(start, c) for start, c, _ in left] for left in stacks]
        self.spans.sort(key=lambda x: (x[0], -x[1]))
        self._mended: dict[int, str] = {}

    def mended(self, reading: int) -> str:
        """The text with a blank for each comma before a closing bracket; places stay as they are."""
        if reading not in self._mended:
            out = list(self.text)
            for at in self.commas[reading]:
                if re.compile(r"\s*[\]}]").match(self.text, at + 1):
                    out[at] = " "
            self._mended[reading] = "".join(out)
        return self._mended[reading]

    def closers(self, start: int, reading: int) -> str:
        return "".join("]" if c == "[" else "}" for at, c in reversed(self.open[reading]) if at >= start)

    def whole(self, start: int, end: int, reading: int) -> str:
        """The span made whole: no commas too many, an open string, key or value ended, open brackets closed."""
        part = self.mended(reading)[start:end]
        closing = self.closers(start, reading) if end == len(self.text) else ""
        if not closing:
            return part
        if self.odd != reading:  # inside a string: of an object's key, or of a value
            before = self.text[start : self.quotes[-1]].rstrip()
            if part.endswith("\\") and (len(part) - len(part.rstrip("\\"))) % 2:
                part = part[:-1]
            return part + ('":""' if before[-1:] in "{," and closing[0] == "}" else '"') + closing
        part = part.rstrip().rstrip(",").rstrip()
        return part + ('""' if part.endswith(":") else "") + closing


def _decoded(text: str) -> tuple[object, int]:
    """The value at the start of ``text`` and -1, or None and the place where it stops being JSON."""
    try:
        return _DECODER.raw_decode(text)[0], -1
    except json.JSONDecodeError as wrong:
        return None, wrong.pos
    except RecursionError:
        return None, 0


def _walk(value: object) -> Iterator[object]:
    """A value and all lists and objects in it, in the order of their text."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, (dict, list)):
            yield v
            waiting += reversed(list(v.values() if isinstance(v, dict) else v))


def json_findings(text: str) -> tuple[str, list[dict[str, str]]] | None:
    """J-1: the method and findings of the first JSON in ``text`` that holds any, in prose, fences or other JSON.

    Spans are tried by their start, outer before inner ones, each as it stands and then made
    whole (J-2), at last cut after its last closing bracket. An inner span is the same JSON
    wherever it stands, so one that contains the place where an outer one failed is not read again.
    """
    brackets = _Brackets(text)
    read_to, failed, mended_failed = 0, -1, -1
    for start, end, reading, height in brackets.spans:
        if start < read_to or height > MOST_NESTED:
            continue
        closed = text[end - 1] in "]}" and not (end == len(text) and any(at == start for at, _ in brackets.open[reading]))
        if closed and not start <= failed < end:
            value, wrong = _decoded(text[start:end])
            if wrong < 0:
                for inner in _walk(value):
                    if items := _items(inner):
                        return "strict", items
                read_to = end
                continue
            failed = max(failed, start + wrong)
        if start <= mended_failed < end:
            continue
        value, wrong = _decoded(brackets.whole(start, end, reading))
        if wrong >= 0 and not closed:
            cut = max(text.rfind("}", start, end), text.rfind("]", start, end)) + 1
            if cut - start > (end - start) // 2:
                part = _Brackets(text[start:cut])
                value, again = _decoded(part.whole(0, cut - start, 0))
                method = "truncated"
                wrong = wrong if again >= 0 else -1
        else:
            method = "repaired"
        if wrong < 0:
            for inner in _walk(value):
                if items := _items(inner):
                    return method, items
        else:
            mended_failed = max(mended_failed, start + wrong)
    return None


def repair_json(text: str) -> str | None:
    """J-2: the first JSON of ``text`` made whole, from its first bracket on; None if it has none.

    Fences go; control signs in strings are escaped, commas before closing brackets dropped, an
    open string, key or value ended, open brackets closed.
    """
    fenced = _FENCE.match(text.strip())
    text = fenced[1].strip() if fenced else text.strip()
    brackets = _Brackets(text)
    if not brackets.spans:
        return None
    start, _, reading, _ = brackets.spans[0]
    whole = brackets.whole(start, len(text), reading)
    out, quoted, skip = [], False, False
    for c in whole:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif quoted and c < " ":
            c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\u{ord(c):04x}")
        out.append(c)
    return "".join(out)


def known_key(key: str) -> str:
    """J-4: a key in snake case, by its field's name if it is an alias."""
    snake = re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key.strip())).lower()
    return ALIASES.get(snake, snake)


def _items(value: object) -> list[dict[str, str]]:
    """The findings of a decoded value: of an object's issues, an object with a known field, or a list's objects; those with a known field that is not blank."""
    if isinstance(value, dict):
        if isinstance(value.get("issues"), list):
            value = value["issues"]
        else:
            value = [value]
    out = []
    for x in value:
        if isinstance(x, dict):
            named = {known_key(k): v for k, v in x.items()}
            if any(f in named and named[f] is not None and str(named[f]).strip() for f in FIELDS):
                out.append({k: v if isinstance(v, str) else json.dumps(v) for k, v in x.items() if v is not None})
    return out


def labelled(text: str) -> list[dict[str, str]]:
    """J-3: blocks that start with "Issue:", a field on each labelled line."""
    found = []
    for block in re.split(r"(?im)^(?=[ \t]*Issue[ \t]*:)", text)[1:]:
        pairs = re.findall(r"(?ims)^\s*(" + "|".join(LABELS) + r")\s*:\s*(.*?)(?=^\s*(?:" + "|".join(LABELS) + r")\s*:|\Z)", block)
        found.append({LABELS[next(k for k in LABELS if k.lower() == name.lower())]: " ".join(value.split()) for name, value in pairs})
    return found


def _rescue(text: str | None) -> dict:
    text = (text or "").strip()
    fenced = [m[1].strip() for m in _FENCE.finditer(text)] if "```" in text else []
    for part in [*fenced, text]:
        if found := json_findings(part):
            return {"method": found[0], "items": found[1]}
    items = labelled(text)
    return {"method": "labeled" if items else "failed", "items": items}


@F.pandas_udf(T.StructType([T.StructField("method", T.StringType()), T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.StringType())))]))
def _rescued(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_rescue(t) for t in texts], columns=["method", "items"])


def normalize_keys(item: Column) -> Column:
    """J-4: snake-case keys, known aliases, trimmed values; the map holds fields and unknown keys alike."""
    snake = lambda k: F.lower(F.regexp_replace(F.regexp_replace(F.trim(k), r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = F.transform(F.map_entries(item), lambda e: F.struct(F.coalesce(F.try_element_at(alias, snake(e["key"])), snake(e["key"])).alias("k"), F.trim(e["value"], F.lit(" \t\n\r\x0b\x0c")).alias("v")))
    # the last of keys that fall together counts
    last = F.aggregate(named, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return F.map_filter(last, lambda _, v: v != "")


def parse_issues(responses: DataFrame) -> DataFrame:
    """J-1: (doc_id, issue_no, the seven fields, extra_fields, parse_method) of each finding of ``responses`` (doc_id, response_text).

    A text that is one valid JSON (an array, an object with issues, or one object) is read by Spark; only others, and
    those whose findings stand deeper, go through the scanning helper: JSON in prose or fences, several of them, cut off or
    malformed. A finding has a known field that is not blank; findings are numbered in order. A response without any
    finding, and a null one, give no rows. parse_method is strict, repaired, truncated or labeled.
    """
    text = F.trim("response_text")
    array = F.from_json(F.when(text.startswith("["), text), ITEMS)
    wrapped = F.from_json(F.when(text.startswith("{"), text), f"struct<issues:{ITEMS}>")["issues"]
    single = F.when(text.startswith("{") & F.try_parse_json(text).isNotNull() & F.get_json_object(text, "$.issues").isNull(), F.array(F.from_json(text, "map<string,string>")))
    found = lambda items: F.filter(F.transform(items, normalize_keys), lambda m: F.exists(F.map_keys(m), lambda k: k.isin(*FIELDS)))
    fast = responses.withColumn("_fast", found(F.coalesce(array, wrapped, single)))
    good = F.coalesce(F.size("_fast") > 0, F.lit(False))
    strict = fast.where(good).select("doc_id", F.lit("strict").alias("parse_method"), F.col("_fast").alias("items"))
    slow = fast.where(~good).select("doc_id", _rescued("response_text").alias("r")).select("doc_id", F.col("r.method").alias("parse_method"), found(F.col("r.items")).alias("items"))
    each = strict.unionByName(slow).select("doc_id", "parse_method", F.posexplode("items").alias("pos", "item"))
    extras = F.map_filter("item", lambda k, _: ~k.isin(*FIELDS))
    return each.select("doc_id", (F.col("pos") + 1).alias("issue_no"), *[F.try_element_at("item", F.lit(f)).alias(f) for f in FIELDS], F.to_json(extras).alias("extra_fields"), "parse_method")


def render_issues(issues: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """J-5: a document's findings as labelled text, in their order; empty fields have a bare label.

    With ``responses`` (doc_id, response_text) what stood before their first "Issue:" line is put in front, and documents
    without findings keep that alone; nothing can follow the last block, which reaches to the end.
    """
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{name}:"), F.when(F.coalesce(field, F.lit("")) != "", F.concat(F.lit(" "), F.col(field))).otherwise("")) for name, field in LABELS.items()])
    blocks = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("issue_no", F.rtrim(lines).alias("block")))).alias("b"))
    rendered = blocks.select("doc_id", F.array_join(F.expr("transform(b, x -> x.block)"), "\n\n").alias("rendered"))
    if responses is None:
        return rendered
    before = F.when(F.col("response_text").rlike(r"(?im)^Issue:"), F.regexp_replace(F.split("response_text", r"(?im)^Issue:", 2)[0], r"^\s+|\s+$", "")).otherwise("")
    both = responses.select("doc_id", before.alias("_before")).join(rendered, "doc_id", "full")
    return both.select("doc_id", F.concat_ws("\n\n", F.when(F.col("_before") != "", F.col("_before")), F.when(F.col("rendered") != "", F.col("rendered"))).alias("rendered"))


@F.pandas_udf(T.StringType())
def _literal_to_json(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return json.dumps(ast.literal_eval(t)) if t else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None

    return texts.map(one)


def repair_legacy_json(history: DataFrame, column: str) -> DataFrame:
    """J-6: a JSON column that holds Python literals in some rows, mended; repaired tells which. Only invalid rows reach the helper."""
    good = F.try_parse_json(column).isNotNull()
    valid = history.where(good).withColumn("repaired", F.lit(False))
    bad = history.where(~good & F.col(column).isNotNull()).withColumn("_new", _literal_to_json(column))
    mended = bad.withColumn("repaired", F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column)).drop("_new")
    return valid.unionByName(mended).unionByName(history.where(F.col(column).isNull()).withColumn("repaired", F.lit(False)))


def repair_report(mended: dict[str, DataFrame]) -> DataFrame:
    """J-6: how many rows of each table were mended, from results of ``repair_legacy_json`` by the table's name; tables without any count 0."""
    parts = [df.agg(F.count_if("repaired").alias("n_repaired")).select(F.lit(name).alias("table_name"), "n_repaired") for name, df in mended.items()]
    return reduce(DataFrame.unionByName, parts)


#: The fields that a payload of each mode needs, and the list or text among them.
REQUIRED = {
    "AUDIT": ("success", "model", "mode", "response_type", "schema_version", "issue_count", "issues", "structured_parse_failed", "legacy_text"),
    "REDACTION": ("success", "model", "mode", "response_type", "schema_version", "redacted_text", "redaction_entities", "redaction_count"),
    "ADVISORY": ("success", "model", "mode", "response_type", "schema_version", "advisory_text"),
}
SCHEMA_VERSION = 1


def validate_results(results: DataFrame) -> DataFrame:
    """J-7: payloads (doc_id, mode, payload as JSON) with violations, the first one first, empty if valid, and a warning for scores outside 0 to 1.

    A field that is there but null counts as there. An unknown mode, and a payload that is no JSON object, are violations.
    """
    fields = F.from_json("payload", "map<string,string>")
    mode = F.upper("mode")
    checks = [F.when(F.col("_f").isNull(), "invalid_json"), F.when(~F.coalesce(mode.isin(*REQUIRED), F.lit(False)), "unknown_mode")]
    checks += [F.when((mode == m) & ~F.map_contains_key("_f", F.lit(f)), f"missing_{f}") for m, names in REQUIRED.items() for f in names]
    checks.append(F.when(F.map_contains_key("_f", F.lit("schema_version")) & ~F.col("_f")["schema_version"].eqNullSafe(str(SCHEMA_VERSION)), "schema_version"))
    checks += [F.when((mode == m) & F.map_contains_key("_f", F.lit(f)) & ~F.coalesce(F.col("_f")[f].startswith("["), F.lit(False)), f"{f}_no_list") for m, f in (("AUDIT", "issues"), ("REDACTION", "redaction_entities"))]
    kind = F.expr("schema_of_variant(variant_get(try_parse_json(payload), '$.advisory_text'))")
    checks.append(F.when((mode == "ADVISORY") & F.map_contains_key("_f", F.lit("advisory_text")) & (kind != "STRING"), "advisory_text_no_text"))
    score = F.expr("try_cast(_f['confidence_score'] as double)")
    rated = F.coalesce(F.col("_f")["confidence_score"].isNotNull() & mode.isin("AUDIT", "ADVISORY") & ~F.coalesce(score.between(0.0, 1.0), F.lit(False)), F.lit(False))
    return results.withColumn("_f", fields).select("doc_id", "mode", F.concat_ws(",", *checks).alias("violations"), F.when(rated, "confidence_score_out_of_range").alias("warning"))


def validate_payload(issues: DataFrame) -> DataFrame:
    """J-7: what a finding lacks or has wrong, joined by commas; empty if nothing."""
    checks = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing_{c}")) for c in ("issue_title", "category", "quoted_text", "risk_explanation")]
    checks.append(F.when(~F.coalesce(F.col("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), F.lit(False)), F.lit("bad_severity")))
    return issues.select("doc_id", "issue_no", F.concat_ws(",", *checks).alias("violations"))
