"""Redaction (R-1 to R-12): spans stay an array on the document's row until they are counted.

Spark's functions give no match offsets, so candidates come from Python. The single steps R-2 to R-7 are
expressions over arrays; bulk work takes ``detect_entities``, the same seven steps as one Arrow kernel.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK, Layer, SparkSql, with_layers

#: What an entity of each type looks like, its confidence, and its priority by order.
ENTITY_PATTERNS: dict[str, tuple[str, int, float]] = {
    "EMAIL": (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0, 0.99),
    "PHONE": (r"(?<!\w)(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}(?!\w)", 0, 0.92),
    "ADDRESS": (
        r"(?<![\d-])\b\d{1,6}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){0,5}\s+(?:Street|St|Road|Rd|Terrace|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Circle|Cir|Court|Ct|Way|Place|Pl)\b",
        re.IGNORECASE,
        0.9,
    ),
    "COMPANY": (
        r"\b[A-Z][A-Za-z0-9&.'-]*(?:\s+[A-Z][A-Za-z0-9&.'-]*){0,5}\s+(?:Inc\.?|LLC|Ltd\.?|Limited|Corp\.?|Corporation|Company|Co\.?|LLP|PLC|Pvt\.?\s+Ltd\.?|Services|Solutions|Group|Holdings)\b",
        0,
        0.84,
    ),
    "MONEY": (r"(?<!\w)(?:[$₹€£]\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s?(?:USD|INR|EUR|GBP|dollars?|rupees?|euros?|pounds?))(?!\w)", re.IGNORECASE, 0.93),
    "DATE": (
        r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{2,4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{2,4})\b",
        re.IGNORECASE,
        0.86,
    ),
    "ID_NUMBER": (
        r"\b(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{2}\d{2}[A-Z0-9]{11}|\d{3}-\d{2}-\d{4}|[A-Z]{1,4}[- ]?\d{5,12}|(?:ID|Passport|Aadhaar|SSN|TIN|GSTIN|License)\s*(?:No\.?|Number|#)?\s*[:#-]?\s*[A-Z0-9-]{4,20})\b",
        re.IGNORECASE,
        0.82,
    ),
    "LOCATION": (r"\b(?:Austin|California|Canada|Cayman Islands|Delaware|England|Florida|France|Germany|India|Ireland|London|New York|San Francisco|Singapore|Texas|United Kingdom|United States)\b", 0, 0.78),
    "PERSON": (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", 0, 0.72),
}
PRIORITY = {name: k for k, name in enumerate(ENTITY_PATTERNS)}
#: Words around names.
LEADIN = "contact regarding please dear hello hi attention attn re cc from to subject call email ask meet notify inform visit consult copy".split()
EXCLUDED = ("Agreement", "Recipient", "Discloser", "Company", "Corporation", "Clause", "Section", "Exhibit", "Schedule", "Governing Law", "Cayman Islands", "New York", "San Francisco", "Austin", "Disclosure Agreement", "This Agreement", "The Recipient")
LEGAL_TERMS = "agreement clause confidential confidentiality disclosure discloser effective exhibit governing jurisdiction law party recipient schedule section term".split()
COMPANY_WORDS = "llc inc ltd limited corp corporation company co services solutions group holdings".split()
TEMPLATE = r"(?i)\b(?:this|the)\s+(?:agreement|recipient|discloser|company|clause|section|exhibit|schedule)\b|\b(?:non[-\s]?disclosure|confidentiality|disclosure)\s+agreement\b|\bgoverning\s+law\b"
BOILERPLATE = "(?i)whereas|hereby|pursuant|notwithstanding|set forth|governing law"
#: Options and the types that each turns off; money, dates and numbers always stay on.
OPTIONS = {"emails": ("EMAIL",), "phones": ("PHONE",), "names": ("PERSON", "LOCATION"), "addresses": ("ADDRESS",), "companies": ("COMPANY",)}
CANDIDATES = "array<struct<entity_type:string,start:int,end:int,original_text:string,confidence:double,before:string,after:string,repeated:boolean>>"
ENTITIES = "array<struct<entity_type:string,start:int,end:int,original_text:string,confidence:double>>"


#: Words of which each match of COMPANY holds one.
_COMPANY_CUES = ("Inc", "LLC", "Ltd", "Limited", "Corp", "Company", "Co", "LLP", "PLC", "Services", "Solutions", "Group", "Holdings")
_PLACES = frozenset(ENTITY_PATTERNS["LOCATION"][0].removeprefix(r"\b(?:").removesuffix(r")\b").split("|"))
_CUES = {ENTITY_PATTERNS["EMAIL"][0]: ("@",), ENTITY_PATTERNS["COMPANY"][0]: _COMPANY_CUES, ENTITY_PATTERNS["LOCATION"][0]: tuple(sorted(_PLACES))}
_NUMBER = re.compile(r"\d(?<!\d\d)")
_ID_WORD = re.compile("|".join(rf"{w}(?<!\w{w})" for w in ("id", "passport", "aadhaar", "ssn", "tin", "gstin", "license")))
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Signs that patterns without case take for i, s and k as well.
_ODD_CASES = re.compile("[\u0130\u0131\u017f\u212a]")


def _letters_before(text: str, end: int) -> int:
    """Where the run of letters that ends at ``end`` starts."""
    while end and text[end - 1] in _LETTERS:
        end -= 1
    return end


def _address_starts(text: str, low: str, numbers: Sequence[int]) -> Sequence[int]:
    return numbers


def _phone_starts(text: str, low: str, numbers: Sequence[int]) -> Iterator[int]:
    for at in numbers:
        if at and text[at - 1] in "+(":
            yield at - 1
        yield at


def _money_starts(text: str, low: str, numbers: Sequence[int]) -> Iterator[int]:
    for at in numbers:
        sign = at - 2 if at > 1 and text[at - 1].isspace() else at - 1
        if sign >= 0 and text[sign] in "$₹€£":
            yield sign
        yield at


def _date_starts(text: str, low: str, numbers: Sequence[int]) -> Iterator[int]:
    """Numbers, and words with white space, after a full stop or not, between them and a number."""
    for at in numbers:
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        if end < at:
            end -= end > 0 and text[end - 1] == "."
            start = _letters_before(text, end)
            if start < end:
                yield start
        yield at


def _id_starts(text: str, low: str, numbers: Sequence[int]) -> Sequence[int]:
    """Numbers, letters in front of them with one sign between at most, and the words that name a number."""
    starts = {m.start() for m in _ID_WORD.finditer(low)}
    for at in numbers:
        starts.add(at)
        starts.add(_letters_before(text, at))
        if at and text[at - 1] in "- ":
            starts.add(_letters_before(text, at - 1))
    return sorted(starts)


#: Where matches of known patterns can start at all: each place is tried, in order, so the matches are those of a search over the whole text.
_STARTS = {
    ENTITY_PATTERNS["ADDRESS"][0]: _address_starts, ENTITY_PATTERNS["PHONE"][0]: _phone_starts, ENTITY_PATTERNS["MONEY"][0]: _money_starts,
    ENTITY_PATTERNS["DATE"][0]: _date_starts, ENTITY_PATTERNS["ID_NUMBER"][0]: _id_starts,
}


def matches(text: str, low: str, compiled: Iterable[re.Pattern[str]]) -> Iterator[Iterable[re.Match[str]]]:
    """What each pattern's ``finditer`` gives, pattern by pattern; known patterns are spared what cannot match. ``low`` is the text in lower case."""
    plain = not text.isascii() and _ODD_CASES.search(text) is not None
    numbers = [] if plain else [m.start() for m in _NUMBER.finditer(text)]
    for pattern in compiled:
        starts = None if plain else _STARTS.get(pattern.pattern)
        cues = _CUES.get(pattern.pattern)
        if starts is not None:
            yield _matches_at(pattern, text, starts(text, low, numbers))
        elif cues is None or any(cue in text for cue in cues):
            yield pattern.finditer(text)
        else:
            yield ()


def _matches_at(pattern: re.Pattern[str], text: str, starts: Iterable[int]) -> Iterator[re.Match[str]]:
    free = 0
    for start in starts:
        if start >= free:
            m = pattern.match(text, start)
            if m:
                free = m.end()
                yield m


#: Texts whose spans are held as Python objects at once; the rest of a batch is Arrow.
TEXTS_AT_ONCE = 256


def _span_kernel(find: Callable[[str | None], list[tuple]], ddl: str, item: pa.StructType):
    """An Arrow function from texts to arrays of ``item``, of which ``find`` gives the values as tuples.

    It counts as nondeterministic, which it is not, so that Spark does not evaluate it twice: a filter such as the one
    that an explode brings along would be pushed below and take a copy of the function with it.
    """

    @F.arrow_udf(ddl)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(texts)), TEXTS_AT_ONCE):
            offsets, flat = [0], []
            for text in texts.slice(at, TEXTS_AT_ONCE):
                flat += find(text.as_py())
                offsets.append(len(flat))
            columns = zip(*flat, strict=True) if flat else ((),) * item.num_fields
            items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, item, strict=True)], fields=list(item))
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items))
        return pa.concat_arrays(parts)

    return run.asNondeterministic()


_SPAN = [("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("original_text", pa.string()), ("confidence", pa.float64())]


def candidate_spans(types: Sequence[str]):
    """A vectorized function from texts to the matches of the types' patterns, with 36 characters on either side."""
    compiled = {t: (re.compile(ENTITY_PATTERNS[t][0], ENTITY_PATTERNS[t][1]), ENTITY_PATTERNS[t][2]) for t in types}

    def find(text: str | None) -> list[tuple]:
        if not text:
            return []
        low, counts, out = text.lower(), {}, []
        for (kind, (_, sure)), found in zip(compiled.items(), matches(text, low, [p for p, _ in compiled.values()]), strict=True):
            for m in found:
                start, end, small = m.start(), m.end(), m[0].lower()
                legal = kind == "PERSON" and any(w in small for w in LEGAL_TERMS)
                if legal and small not in counts:
                    counts[small] = low.count(small)
                out.append((kind, start, end, m[0], sure, text[max(0, start - 36) : start], text[end : end + 36], legal and counts[small] > 1))
        return out

    return _span_kernel(find, CANDIDATES, pa.struct([*_SPAN, ("before", pa.string()), ("after", pa.string()), ("repeated", pa.bool_())]))


def detect_candidates(docs: DataFrame, options: dict[str, bool] | None = None, out: str = "candidates") -> DataFrame:
    """R-1: all matches of the nine patterns with offsets in code points; ``options`` turns types off."""
    off = {t for name, on in (options or {}).items() if not on for t in OPTIONS[name]}
    return docs.withColumn(out, candidate_spans([t for t in ENTITY_PATTERNS if t not in off])("text"))


def _held(docs: DataFrame) -> DataFrame:
    """The rows, passed through a generator: a filter on a step's result is not pushed below, where the steps would be copied into it, each as often as it is read."""
    return docs.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def strip_leadin(docs: DataFrame, out: str = "candidates") -> DataFrame:
    """R-2: a person's leading salutation word goes, and the start moves behind it."""
    first = r"regexp_extract(c.original_text, r'^\S+', 0)"
    lead = rf"c.entity_type = 'PERSON' and lower({first}) in {_in(LEADIN)} and c.original_text rlike r'\s'"
    return _held(docs.withColumn(out, F.expr(rf"transform({out}, c -> if({lead}, named_struct('entity_type', c.entity_type, 'start', c.start + length({first}) + 1, 'end', c.end, 'original_text', array_join(slice(split(c.original_text, r'\s+'), 2, 9), ' '), 'confidence', c.confidence, 'before', right(concat(c.before, substr(c.original_text, 1, length({first}) + 1)), 36), 'after', c.after, 'repeated', c.repeated), c))")))


def adjust_confidence(docs: DataFrame, out: str = "candidates") -> DataFrame:
    """R-3: a person's confidence falls with legal terms, clause templates, repetition and boilerplate around it."""
    q = SPARK
    legal = q.some(q.array([q.text(w) for w in LEGAL_TERMS]), "w", "contains(lower(c.original_text), w)")
    near = "concat(right(c.before, 24), c.original_text, left(c.after, 24))"
    wide = "concat(c.before, c.original_text, c.after)"
    cut = f"if({legal}, 0.18, 0.0) + if({q.has(near, TEMPLATE)}, 0.16, 0.0) + if(c.repeated, 0.12, 0.0) + if({q.has(wide, BOILERPLATE)}, 0.10, 0.0)"
    value = f"if(c.entity_type = 'PERSON', greatest(0.0, round(c.confidence - ({cut}), 2)), c.confidence)"
    return _held(docs.withColumn(out, F.expr(f"transform({out}, c -> named_struct('entity_type', c.entity_type, 'start', c.start, 'end', c.end, 'original_text', c.original_text, 'confidence', cast({value} as double), 'before', c.before, 'after', c.after, 'repeated', c.repeated))")))


def classify_person(docs: DataFrame, out: str = "candidates") -> DataFrame:
    """R-4: persons that are excluded terms, legal terms or templates get a reason; places and companies are retyped."""
    q = SPARK
    words = r"transform(split(lower(c.original_text), r'\s+'), w -> regexp_replace(w, r'^[.,:;()\[\]]+|[.,:;()\[\]]+$', ''))"
    near24 = "concat(right(c.before, 24), c.original_text, left(c.after, 24))"
    near20 = "lower(concat(right(c.before, 20), c.original_text, left(c.after, 20)))"
    company = f"(exists({words}, w -> w in {_in(COMPANY_WORDS)}) or {q.has(near20, chr(92) + 'b(?:' + '|'.join(COMPANY_WORDS) + ')' + chr(92) + '.?' + chr(92) + 'b')})"
    place = "c.original_text in " + _in([p for p in ENTITY_PATTERNS["LOCATION"][0].removeprefix(r"\b(?:").removesuffix(r")\b").split("|")])
    reason = (
        f"case when c.entity_type <> 'PERSON' then null when c.original_text in {_in(EXCLUDED)} then 'excluded term' when {place} then null "
        f"when {q.has('c.original_text', '^(?:This|The)' + chr(92) + 'b')} or {q.has('right(c.before, 12)', chr(92) + 'b(?:This|The)' + chr(92) + 's+$')} then 'legal reference' "
        f"when exists({words}, w -> w in {_in(LEGAL_TERMS)}) then 'legal document terminology' when {q.has(near24, TEMPLATE)} then 'legal clause template' "
        f"when {company} then null when c.confidence < 0.45 then 'low confidence' end"
    )
    told = f"transform({out}, c -> named_struct('c', c, 'reason', {reason}, 'place', {place}, 'company', c.entity_type = 'PERSON' and {company}))"
    # a rejected candidate stays a person of its own confidence
    kept = "x.c.entity_type = 'PERSON' and x.reason is null"
    kind = f"case when {kept} and x.place then 'LOCATION' when {kept} and x.company then 'COMPANY' else x.c.entity_type end"
    sure = f"case when {kept} and x.place then greatest(x.c.confidence - 0.08, 0.5) when {kept} and x.company then greatest(x.c.confidence, 0.82) else x.c.confidence end"
    return _held(docs.withColumn(out, F.expr(f"transform({told}, x -> named_struct('entity_type', {kind}, 'base_type', x.c.entity_type, 'start', x.c.start, 'end', x.c.end, 'original_text', x.c.original_text, 'confidence', cast({sure} as double), 'before', x.c.before, 'after', x.c.after, 'reason', x.reason))")))


def reject_false_numbers(docs: DataFrame, out: str = "candidates") -> DataFrame:
    """R-5: year ranges and long digit runs are no phones; unlabelled letter-digit codes are no identifiers."""
    q = SPARK
    bare = r"regexp_replace(c.original_text, r'[+()]', '')"
    phone = rf"c.entity_type = 'PHONE' and (c.original_text rlike r'^\d{{4}}-\d{{4}}$' or ({bare} rlike r'^\d+$' and length({bare}) > 11))"
    code, window = r"^[A-Z]{1,4}[- ]?\d{5,12}$", "lower(concat(right(c.before, 24), c.original_text, left(c.after, 24)))"
    known = r"^(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{2}\d{2}[A-Z0-9]{11}|\d{3}-\d{2}-\d{4})$|\b(?:ID|Passport|Aadhaar|SSN|TIN|GSTIN|License)\b"
    labelled = q.has(window, "id|passport|aadhaar|ssn|tin|gstin|license|employee")
    number = rf"c.entity_type = 'ID_NUMBER' and not {q.has('c.original_text', known)} and {q.has('c.original_text', code)} and ((c.original_text rlike '^[A-Z]{{2}}' and not {labelled}) or length(regexp_replace(c.original_text, '[^0-9]', '')) > 9)"
    return _held(docs.withColumn(out, F.expr(f"filter({out}, c -> not ({phone}) and not ({number}))")))


def resolve_overlaps(docs: DataFrame, candidates: str = "candidates", out: str = "entities") -> DataFrame:
    """R-6: take spans by priority, confidence, length and start; later ones that overlap go."""
    order = F.expr(f"array_sort(transform(filter({candidates}, c -> c.reason is null), c -> struct({_priority('c.entity_type')} as p, -c.confidence as minus_confidence, c.start - c.end as minus_length, c.start as start, c.end as end, c.entity_type as entity_type, c.base_type as base_type, c.original_text as original_text, c.confidence as confidence)))")
    fold = "aggregate(_ordered, filter(_ordered, o -> false), (kept, c) -> if(exists(kept, k -> k.start < c.end and c.start < k.end), kept, concat(kept, array(c))))"
    return _held(docs.withColumn("_ordered", order).withColumn(out, F.expr(f"array_sort(transform({fold}, c -> struct(c.start as start, c.end as end, c.entity_type as entity_type, c.base_type as base_type, c.original_text as original_text, c.confidence as confidence)))")).drop("_ordered"))


def _priority(kind: str) -> str:
    return "case " + kind + " " + " ".join(f"when '{t}' then {k}" for t, k in PRIORITY.items()) + " else 99 end"


def _identity(value: str) -> str:
    return rf"""lower(trim(regexp_replace(regexp_replace({value}, r'\s+', ' '), r'^[\s.,:;()\[\]"\x27?!]+|[\s.,:;()\[\]"\x27?!]+$', '')))"""


def reconcile_repeats(docs: DataFrame, candidates: str = "candidates", entities: str = "entities") -> DataFrame:
    """R-7: rejected persons whose text was accepted elsewhere in the document come back where free, and a repeated text gets one type."""
    one = lambda x, kind, base: f"struct({x}.start as start, {x}.end as end, {kind} as entity_type, {base} as base_type, {x}.original_text as original_text, {x}.confidence as confidence, {_identity(f'{x}.original_text')} as name)"
    refused = f"transform(filter({candidates}, c -> c.reason is not null), c -> {one('c', repr('PERSON'), 'cast(null as string)')})"
    docs = _held(docs.withColumn("_kept", F.expr(f"transform({entities}, e -> {one('e', 'e.entity_type', 'e.base_type')})")).withColumn("_refused", F.expr(refused)))
    docs = docs.withColumn("_back", F.expr("filter(_refused, r -> exists(_kept, e -> e.name = r.name) and not exists(_kept, e -> e.start < r.end and r.start < e.end))"))
    docs = _held(docs.withColumn("_all", F.expr("array_sort(concat(_kept, _back))")))
    # a name that is there several times gets one type
    many = "filter(transform(array_distinct(transform(_kept, e -> e.name)), n -> struct(n as name, filter(_kept, e -> e.name = n) as same, size(filter(_all, e -> e.name = n)) as n)), g -> g.n > 1)"
    votes = f"transform(array_distinct(transform(g.same, e -> e.entity_type)), t -> struct(-size(filter(g.same, e -> e.entity_type = t)) as v, {_priority('t')} as p, t as t))"
    kinds = f"map_from_entries(transform({many}, g -> struct(g.name as name, if(exists(g.same, e -> e.base_type = 'PERSON'), 'PERSON', element_at(array_sort({votes}), 1).t) as kind)))"
    docs = _held(docs.withColumn("_kinds", F.expr(kinds)))
    typed = "transform(_all, x -> struct(x.start as start, x.end as end, coalesce(element_at(_kinds, x.name), x.entity_type) as entity_type, x.base_type as base_type, x.original_text as original_text, x.confidence as confidence))"
    return _held(docs.withColumn(entities, F.expr(typed)).drop("_kept", "_refused", "_back", "_all", "_kinds"))


def _overlaid(entities: str, text: str = "text") -> Column:
    step = "(t, e) -> concat(substr(t, 1, e.start), '[REDACTED_', e.entity_type, ']', substr(t, e.end + 1))"
    return F.expr(f"aggregate(reverse(array_sort(transform({entities}, e -> struct(e.start as start, e.end as end, e.entity_type as entity_type)))), {text}, {step})")


def apply_redactions(docs: DataFrame, entities: str = "entities", out: str = "redacted_text") -> DataFrame:
    """R-8: replace each span from the right by [REDACTED_TYPE]; null texts stay null."""
    return docs.withColumn(out, _overlaid(entities))


def preview_redactions(docs: DataFrame, active: DataFrame | None = None, active_types: Sequence[str] | None = None, entities: str = "entities") -> DataFrame:
    """R-9: as R-8 for the chosen entities only, with total and active counts.

    ``active`` (doc_id, position) names entities by their place in the document's list, from 0; ``active_types`` limits
    them to types. Without either all are active; a document that ``active`` does not name has none.
    """
    chosen = f"transform({entities}, (e, i) -> named_struct('e', e, 'i', i))"
    if active_types is not None:
        chosen = f"filter({chosen}, x -> x.e.entity_type in {_in(active_types) if active_types else '(null)'})"
    if active is not None:
        places = active.groupBy("doc_id").agg(F.collect_set("position").alias("_places"))
        docs = docs.join(places, "doc_id", "left")
        chosen = f"filter({chosen}, x -> array_contains(coalesce(_places, array()), x.i))"
    shown = docs.withColumn("_active", F.expr(f"transform({chosen}, x -> x.e)"))
    shown = shown.withColumn("preview", _overlaid("_active")).withColumn("n_total", F.size(entities)).withColumn("n_active", F.size("_active"))
    return shown.drop("_active", "_places")


def mask_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    """Four replacements in a fixed order; the unescaped dot of the second is meant."""
    name, email, phone = r"[A-Z][a-z]+\s[A-Z][a-z]+", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+.[a-zA-Z]+", r"\+?\d[\d\s-]{7,}"
    address = r"(?i)\d+\s+[A-Za-z]+\s+(Street|St|Road|Rd|Terrace|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd)"
    out = t
    for p in (name, email, phone, address):
        out = q.replace(out, p, "[REDACTED]")
    return [{"masked": out}]


def mask_pii_fallback(docs: DataFrame) -> DataFrame:
    """R-10: mask names, e-mail addresses, phones and street addresses."""
    return with_layers(docs.select("doc_id", "text"), mask_layers(SPARK)).select("doc_id", "masked")


def safe_entities(docs: DataFrame, entities: str = "entities") -> DataFrame:
    """R-11: entities without their raw values: the replacement stands for the text, which is emptied."""
    return docs.withColumn(entities, F.expr(f"transform({entities}, e -> struct(e.start as start, e.end as end, e.entity_type as entity_type, concat('[REDACTED_', e.entity_type, ']') as original_text, e.confidence as confidence))")).withColumn("text", F.lit(""))


#: The order in which types are shown.
SHOWN = ("PERSON", "EMAIL", "PHONE", "ADDRESS", "COMPANY", "LOCATION", "MONEY", "DATE", "ID_NUMBER")


def entity_stats(docs: DataFrame, active_types: Sequence[str] | None = None, entities: str = "entities") -> DataFrame:
    """R-12: entities, active entities and documents for each type, with the type's place in the list shown; partial sums before the shuffle."""
    each = docs.select("doc_id", F.explode(entities).alias("e")).select("doc_id", F.col("e.entity_type").alias("entity_type"))
    active = F.col("entity_type").isin(*(SHOWN if active_types is None else active_types))
    order = F.expr("case entity_type " + " ".join(f"when '{t}' then {k}" for k, t in enumerate(SHOWN)) + " else 99 end")
    counts = each.groupBy("entity_type").agg(F.count("*").alias("n_entities"), F.count_if(active).alias("n_active"), F.count_distinct("doc_id").alias("n_docs"))
    return counts.withColumn("shown_at", order)


def entity_positions(docs: DataFrame, entities: str = "entities") -> DataFrame:
    """R-12: the places of a document's entities by type, in order: (doc_id, entity_type, positions)."""
    each = docs.select("doc_id", F.posexplode(entities).alias("position", "e"))
    return each.groupBy("doc_id", F.col("e.entity_type").alias("entity_type")).agg(F.array_sort(F.collect_list("position")).alias("positions"))


class _Spans:
    """Spans that do not overlap, in order of their starts."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: dict[int, int] = {}

    def add(self, start: int, end: int) -> bool:
        """Take a span if it is free; only its neighbours can overlap it."""
        k = bisect_left(self.starts, end)
        if k and self.ends[self.starts[k - 1]] > start:
            return False
        self.starts.insert(k, start)
        self.ends[start] = end
        return True


_STRIPPED = ".,:;()[]\"'?!"
_WORD_SIGNS = ".,:;()[]"
_NEAR_COMPANY = re.compile(r"\b(?:" + "|".join(COMPANY_WORDS) + r")\.?\b")
_TEMPLATE, _BOILERPLATE = re.compile(TEMPLATE), re.compile(BOILERPLATE)
_THIS = re.compile(r"\b(?:This|The)\s+$")
_FIXED_ID = re.compile(r"(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{2}\d{2}[A-Z0-9]{11}|\d{3}-\d{2}-\d{4})")
_LABEL_IN_ID = re.compile(r"\b(?:ID|Passport|Aadhaar|SSN|TIN|GSTIN|License)\b")
_CODE = re.compile(r"([A-Z]{1,4})[- ]?(\d{5,12})")
_ID_LABELS = ("id", "passport", "aadhaar", "ssn", "tin", "gstin", "license", "employee")


def _person(name: str, start: int, end: int, text: str, low: str, counts: dict[str, int]) -> tuple[str, float, bool]:
    """(type, confidence, rejected) of a person's candidate after R-3 and R-4."""
    small = name.lower()
    words = {w.lower().strip(_WORD_SIGNS) for w in name.split()}
    legal = any(t in small for t in LEGAL_TERMS)
    stop = start + len(name)
    sure = ENTITY_PATTERNS["PERSON"][2] - 0.18 * legal - 0.16 * bool(_TEMPLATE.search(text[max(0, start - 24) : stop + 24]))
    if legal:
        if small not in counts:
            counts[small] = low.count(small)
        sure -= 0.12 * (counts[small] > 1)
    sure -= 0.1 * bool(_BOILERPLATE.search(text[max(0, start - 36) : stop + 36]))
    sure = max(round(sure, 2), 0.0)
    if name in EXCLUDED:
        return "PERSON", sure, True
    if name in _PLACES:
        return "LOCATION", max(sure - 0.08, 0.5), False
    if name.split()[0] in ("This", "The") or _THIS.search(text[max(0, start - 12) : start]) or words & set(LEGAL_TERMS) or _TEMPLATE.search(text[max(0, start - 24) : end + 24]):
        return "PERSON", sure, True
    if words & set(COMPANY_WORDS) or _NEAR_COMPANY.search(text[max(0, start - 20) : end + 20].lower()):
        return "COMPANY", max(sure, 0.82), False
    return "PERSON", sure, sure < 0.45


def _no_number(kind: str, found: str, start: int, end: int, text: str) -> bool:
    """R-5 for one candidate."""
    if kind == "PHONE":
        bare = found.translate({ord(c): None for c in "+()"})
        return bool(re.fullmatch(r"\d{4}-\d{4}", found)) or (bool(re.fullmatch(r"\d+", bare)) and len(bare) > 11)
    if kind != "ID_NUMBER" or _FIXED_ID.fullmatch(found) or _LABEL_IN_ID.search(found):
        return False
    code = _CODE.fullmatch(found)
    if not code:
        return False
    window = text[max(0, start - 24) : end + 24].lower()
    return (len(code[1]) > 1 and not any(t in window for t in _ID_LABELS)) or len(code[2]) > 9


def with_entity(name: str, pattern: str, confidence: float, flags: int = 0, before: str | None = None, rules: Mapping[str, tuple[str, int, float]] = ENTITY_PATTERNS) -> dict[str, tuple[str, int, float]]:
    """``rules`` with one more type of entity, or another pattern for a known one.

    A type's place is its priority where spans overlap: in front of the type ``before``, a known one's own, else the last.
    """
    re.compile(pattern, flags)
    rule, out = (pattern, flags, confidence), {}
    for known, value in rules.items():
        if known == before:
            out[name] = rule
        if known != name or (before is None):
            out[known] = rule if known == name else value
    return out if name in out else {**out, name: rule}


def entities_of(text: str | None, compiled: Mapping[str, tuple[re.Pattern[str], float]]) -> list[tuple[int, int, str, str, float]]:
    """R-1 to R-7 for one text: (start, end, type, text, confidence) by start. Sorting once and looking at neighbours only keeps it near linear in the candidates.

    ``compiled`` are the types' patterns and confidences in order of priority.
    """
    first = {t: k for k, t in enumerate(compiled)}
    rank = lambda t: first.get(t, len(first))
    if not text:
        return []
    low, counts = text.lower(), {}
    taken, refused = [], []
    for (kind, (_, confidence)), hits in zip(compiled.items(), matches(text, low, [p for p, _ in compiled.values()]), strict=True):
        for m in hits:
            found, start, end, sure, now, no = m[0], m.start(), m.end(), confidence, kind, False
            if kind == "PERSON":
                words = found.split()
                if len(words) >= 2 and words[0].lower() in LEADIN:
                    found, start = " ".join(words[1:]), start + len(words[0]) + 1
                now, sure, no = _person(found, start, end, text, low, counts)
            if no:
                refused.append((found, start, end, sure))
            elif not _no_number(kind, found, start, end, text):
                taken.append((rank(now), -sure, start - end, start, end, now, kind, found, sure))
    spans, kept = _Spans(), []
    for c in sorted(taken):
        if spans.add(c[3], c[4]):
            kept.append(c[3:])
    key = lambda t: " ".join(t.strip().strip(_STRIPPED).lower().split())
    groups: dict[str, list] = {}
    for e in kept:
        groups.setdefault(key(e[4]), []).append(e)
    again: dict[str, list] = {}
    for r in refused:
        if key(r[0]) in groups:
            again.setdefault(key(r[0]), []).append(r)
    out = []
    for name, members in groups.items():
        votes = Counter(e[2] for e in members)
        kind = min(votes, key=lambda t: (-votes[t], rank(t)))
        if any(e[3] == "PERSON" for e in members) and len(members) + len(again.get(name, ())) >= 2:
            kind = "PERSON"
        out += [(e[0], e[1], kind, e[4], e[5]) for e in members]
        out += [(start, end, kind, found, sure) for found, start, end, sure in again.get(name, ()) if spans.add(start, end)]
    return sorted(out)


def entity_kernel(types: Sequence[str], rules: Mapping[str, tuple[str, int, float]] = ENTITY_PATTERNS):
    """R-1 to R-7 as one Arrow function from texts to arrays of entities: flat arrays with offsets, no object per entity."""
    compiled = {t: (re.compile(rules[t][0], rules[t][1]), rules[t][2]) for t in types}
    return _span_kernel(lambda text: [(kind, start, end, found, sure) for start, end, kind, found, sure in entities_of(text, compiled)], ENTITIES, pa.struct(_SPAN))


def detect_entities(docs: DataFrame, options: dict[str, bool] | None = None, out: str = "entities", rules: Mapping[str, tuple[str, int, float]] = ENTITY_PATTERNS) -> DataFrame:
    """R-1 to R-7 in one map: the entities that the single steps above give, as an array by start.

    ``rules`` are the types in order of priority, each with its pattern, flags and confidence; see ``with_entity``.
    """
    off = {t for name, on in (options or {}).items() if not on for t in OPTIONS[name]}
    return docs.withColumn(out, entity_kernel([t for t in rules if t not in off], rules)("text"))


def redact_documents(docs: DataFrame, options: dict[str, bool] | None = None, rules: Mapping[str, tuple[str, int, float]] = ENTITY_PATTERNS) -> DataFrame:
    """Bulk redaction: R-1 to R-8 as one map over the documents. Adds entities and redacted_text."""
    return apply_redactions(detect_entities(docs, options, rules=rules))


def stepwise_entities(docs: DataFrame, options: dict[str, bool] | None = None) -> DataFrame:
    """The same by the single operators R-1 to R-7, for looking into their steps."""
    out = detect_candidates(docs, options)
    for step in (strip_leadin, adjust_confidence, classify_person, reject_false_numbers, resolve_overlaps, reconcile_repeats):
        out = step(out)
    return out.drop("candidates")
