"""Personal data by candidate spans and gradient-boosted trees, in DataFrame functions only.

Generators propose overlapping spans with high recall. Trees, learned by boosting from
format and context features, give each span a probability; thresholds calibrated for each
kind on a held-out part select the spans to redact. Spans of the four base kinds that pass
their fixed tests are always selected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize

#: Base kinds in the order of the result, in Java's syntax. Possessive repeats match the same as
#: greedy ones here and need no stack, and the look-behind only skips starts that cannot match.
BASE: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators: their spans are selected by the trees.
EXTRA: dict[str, str] = {
    "account": r"[0-9](?:[\x20-]?[0-9])++",
    "local_phone": r"(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3})[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b\x20?[=:]\x20?[\"']?[A-Za-z0-9_+/-]{8,}",
    "written_email": r"(?i)[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,4}",
}
#: Candidates that the trees learn from, and documents that these are taken from, the first by a hash of their text.
SAMPLE = 20_000
SAMPLE_DOCS = 50_000
#: Written examples for each example text of the further kinds.
EXAMPLES = 40
MAX_DEPTH, TREES = 3, 12
#: Share of true spans that the selected ones of each kind have to have on the held-out part of the sample.
PRECISION = 0.9
FEATURES = (
    "length", "digits", "letters", "separators", "groups", "distinct", "after_letter", "before_letter", "cue_phone", "cue_mail", "cue_card", "cue_key", "quoted", "at_sign", "dots", "plus", "even_groups",
    "cue_other", *(f"is_{k}" for k in EXTRA),
)
#: There is no labelled text with spans of the further kinds, so the trees learn them from written examples: what names such data, and
#: what only looks like it. {dN} stands for N digits, {hN} for N hexadecimal signs, {w} for a word.
EXAMPLE_TEXTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "account": (
        ("please wire to account {d12} today", "IBAN {d20} at the bank", "my bank account is {d10}, thanks", "account number: {d11}", "payment to acct {d9} was made", "visa {d15} is on file"),
        ("order {d10} was shipped", "the sum {d12} is large", "item {d9} of the list", "part no {d11} fits", "in row {d14} of it", "serial {d16} on the back", "{w} {d9} {w}", "{w} {w} {d16} {w}", "{w}. {d13}, {w}",
         "{w} {d16} {d16} {w}", "{w} {d10} {w}", "{w}{d12}{w} {w}", 'token = "{h8}{w}{d12}{h4}"', "{w}\n{d16} {w}"),
    ),
    "local_phone": (
        ("call me at ({d3}) {d3}-{d4} now", "phone {d3}-{d3}-{d4}", "my mobile: {d3} {d3} {d4}", "tel. {d3}.{d3}.{d4}", "fax ({d3}) {d3}-{d4}"),
        ("part {d3}-{d3}-{d4} of the kit", "rows {d3} {d3} {d4} of it", "entry ({d3}) {d3}-{d4} in the index", "sizes {d3}.{d3}.{d4} and more", "lot {d3}-{d3}-{d4} was sold", "{w} {d3}-{d3}-{d4} {w}",
         "{w} ({d3}) {d3}-{d4} {w}", "{w} {d3} {d3} {d4} {w}"),
    ),
    "secret": (
        ('token = "{h32}"', "api_key={h24}", "password: {w}{d4}{w}", "the secret={h16} is set", "passwd = '{h8}{d2}'", "key: {h40}"),
        ("token = identifier of it", "key: important to know", "password: required here", "secret = something_more to say", "api-key: documentation is there", "passwd=changeable by you"),
    ),
    "written_email": (
        ("write to {w} [at] {w} [dot] com", "mail {w}{d2}(at){w}(dot)org please", "contact: {w}.{w} [at] {w} [dot] net", "e-mail {w}[at]{w}[dot]de"),
        ("they met {w} (at) {w} (dot) and left", "look {w} [at] {w} [dot] and comma", "a {w} (at) {w} (dot) pattern", "drawn {w} [at] {w} [dot] by dot"),
    ),
}
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _prefix_sums(lengths: Column) -> Column:
    """Sum of the values before each value: sums of blocks first, so that long arrays stay cheap."""
    add = lambda s, x: s + x
    zero = F.lit(0).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))
    return let(blocks, lambda sums: F.transform(lengths, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), F.floor(i / _BLOCK).cast("int")), zero, add) + F.aggregate(F.slice(lengths, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK), zero, add)))


def _prefix_max(values: Column) -> Column:
    """The largest of the values before each value, 0 where there is none, in blocks as above."""
    larger = lambda s, x: F.greatest(s, x)
    zero = F.lit(0).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), zero, larger))
    before = lambda tops: F.transform(
        values, lambda _, i: F.greatest(F.aggregate(F.slice(tops, F.lit(1), F.floor(i / _BLOCK).cast("int")), zero, larger), F.aggregate(F.slice(values, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK), zero, larger))
    )
    return F.when(F.size(values) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(blocks, before))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost matches that don't overlap; code points, end exclusive.

    The matches and the pieces between them make up the text, so their lengths give the offsets.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        lengths = F.zip_with(F.slice(both["p"], F.lit(1), F.size(both["m"])), both["m"], lambda p, m: F.char_length(p) + F.char_length(m))
        starts = lambda sums: F.transform(
            both["m"],
            lambda m, i: let(
                F.get(sums, i) + F.char_length(F.get(both["p"], i)),
                lambda at: F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), m.alias("value"), F.right(F.get(both["p"], i), F.lit(24)).alias("before"), F.substring(F.coalesce(F.get(both["p"], i + 1), F.lit("")), 1, 1).alias("after")),
            ),
        )
        return let(lengths, lambda ls: let(_prefix_sums(ls), starts))

    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)")
    return let(F.struct(matches.alias("m"), pieces.alias("p")), lambda both: F.when(F.size(both["m"]) == 0, none).otherwise(placed(both)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: let(F.substring(digits, -i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda part: let(F.ltrim(part, F.lit("0")), lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.char_length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _features(span: Column) -> list[Column]:
    """Format of the value and its context, none of which repeats a base kind's test."""
    v, before = span["value"], F.lower(span["before"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    near = lambda p: flag(before.rlike(p) | F.lower(v).rlike(p))
    return [
        F.char_length(v).cast("double"), count("[0-9]"), count("[A-Za-z]"), count(r"[\x20().-]"), count("[0-9]+"),
        F.size(F.array_distinct(F.split(F.substring(v, 1, 64), ""))).cast("double"), flag(span["after"].rlike(r"[\p{L}]")), flag(span["before"].rlike(r"[\p{L}]$")),
        near(r"phone|\btel\b|\btel[.:]|\bcall|mobile|\bfax|anruf|llam[ae]|appel"), near("mail|contact"), near(r"card|visa|account|\bacct|iban|payment|bank|konto|cuenta|compte"), near("token|secret|passw|key"),
        flag(span["before"].rlike("[\"']$") | v.rlike("[\"']")), count("@"), count(r"\."), count(r"^\+"), flag(v.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$")),
        near(r"\border|\bitem|\bpart|\brow|\blot\b|serial|\bentry|\bsize"), *[(span["kind"] == k).cast("double") for k in EXTRA],
    ]


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees as nested tuples (feature, split, left, right) with leaf values, their weights and each kind's threshold; a kind without one selects nothing."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: tuple[tuple[str, float], ...]

    def selects(self, span: Column) -> Column:
        least = F.lit(2.0)
        for kind, value in self.thresholds:
            least = F.when(span["kind"] == kind, value).otherwise(least)
        return self.probability(_features(span)) >= least

    def probability(self, features: list[Column]) -> Column:
        if not self.trees:
            return F.lit(0.0)
        # each feature is worked out once for all trees
        return let(F.array(*features), lambda f: 1 / (1 + F.exp(-2 * sum((F.lit(w) * _tree_value(t, f) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0)))))


def _tree_value(tree, features: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    index, split, left, right = tree
    return F.when(features[index] <= split, _tree_value(left, features)).otherwise(_tree_value(right, features))


def _read_tree(description: str):
    """A fitted tree from its printed form."""
    lines = [line.strip() for line in description.split("\n")[1:] if line.strip()]

    def node(at: int):
        if lines[at].startswith("Predict:"):
            return float(lines[at].split(":")[1]), at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        left, at = node(at + 1)
        right, at = node(at + 1)
        return (int(m[1]), float(m[2]), left, right), at

    return node(0)[0]


def _of_kind(spans: Column, kind: str) -> Column:
    valid = lambda s: _valid(kind, s["value"]) if kind in BASE else F.lit(False)
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "before", "after")], valid(s).alias("valid")))


def _candidates(text: Column) -> Column:
    """array<struct<kind, start, end, value, before, after, valid>> of all generators; base kinds first, in order."""
    named = []
    needs = {"email": "@", "phone": "+"}
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string,before:string,after:string,valid:boolean>>)")
    for kind, pattern in (BASE | EXTRA).items():
        found = _of_kind(_spans(text, pattern), kind)
        if kind == "account":  # runs that are no card and long enough to name something
            found = F.filter(found, lambda s: F.char_length(_digits(s["value"])).between(9, 34))
        test = text.contains(needs[kind]) if kind in needs else text.rlike("[0-9]" if kind in ("ip", "card", "account", "local_phone") else r"(?i)token|secret|passw|key" if kind == "secret" else r"(?i)[\[(]at[\])]")
        named.append(F.when(test, found).otherwise(none))
    return F.concat(*named)


_HINT = r"[0-9@]|(?i)[\[(]at[\])]|token|secret|passw|key"


def with_spans(docs: DataFrame, model: SpanModel, out: str = "_spans") -> DataFrame:
    """``docs`` with a column array<struct<kind, start, end>>: valid base spans and the spans that the model selects."""
    text = F.coalesce("text", F.lit(""))
    chosen = F.filter(F.when(text.rlike(_HINT), _candidates(text)), lambda s: s["valid"] | (~s["kind"].isin(*BASE) & model.selects(s)))
    # what lies within a base span adds nothing: in order of starts, the furthest end of the base spans so far tells
    placed = F.array_sort(F.transform(chosen, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), (~s["kind"].isin(*BASE)).alias("extra"), i.alias("at"), s["kind"].alias("kind"))))
    kept = let(
        placed,
        lambda all_: let(
            _prefix_max(F.transform(all_, lambda s: F.when(s["extra"], 0).otherwise(-s["minus_end"]))),
            lambda reach: F.filter(F.transform(all_, lambda s, i: F.when(~s["extra"] | (F.get(reach, i) < -s["minus_end"]), s)), lambda s: s.isNotNull()),
        ),
    )
    slim = F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), s["start"].alias("start"), (-s["minus_end"]).alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return docs.withColumn(out, F.coalesce(slim, none))


def _written(example: str) -> Column:
    """The example with values that follow from the row's id."""
    parts = []
    for k, piece in enumerate(re.split(r"(\{[dhw][0-9]*\})", example)):
        m = re.fullmatch(r"\{([dhw])([0-9]*)\}", piece)
        if not m:
            parts.append(F.lit(piece))
            continue
        raw = F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}:{example}")), 512)
        signs = F.translate(raw, "abcdef", "012345") if m[1] == "d" else F.translate(raw, "0123456789", "ghijklmnop") if m[1] == "w" else raw
        parts.append(F.substring(signs, 1, int(m[2] or 7)))
    return F.concat(*parts)


def written_examples(docs: DataFrame, examples: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], n: int = EXAMPLES) -> DataFrame:
    """(kind, label, text): ``n`` texts of every example, with words around them."""
    ids = docs.sparkSession.range(n)
    texts = [F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.concat(F.lit("and so "), _written(e), F.lit(" for it")).alias("text")) for kind, both in examples.items() for label, side in ((1.0, both[0]), (0.0, both[1])) for e in side]
    return ids.select(F.explode(F.array(*texts)).alias("e")).select("e.*")


def fit_spans(docs: DataFrame, rows: int = SAMPLE, sample_docs: int = SAMPLE_DOCS) -> SpanModel:
    """Learn the trees from at most ``rows`` candidates of about ``sample_docs`` documents, chosen by a hash of their text, and from written examples.

    There are no labelled spans: candidates of the base kinds are true if they pass their kind's
    test, and false otherwise; the tests themselves are no features, so that the trees learn what
    true spans look like and stand beside. Spans of the further kinds are true in the texts of
    EXAMPLE_TEXTS that name such data. A quarter of all calibrates the thresholds: for each kind the
    lowest at which PRECISION of its candidates above it are true. A table without candidates of the
    base kinds leaves the written examples.
    """
    text = F.col("text")
    n = max(1, docs.count())
    share = min(1.0, sample_docs / n)
    few = docs.where(text.rlike(_HINT)).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.explode(_candidates(text)).alias("s"))
    known = few.where(F.col("s.kind").isin(*BASE)).select("s", F.col("s.valid").cast("double").alias("label"))
    made = written_examples(docs, EXAMPLE_TEXTS).select("kind", "label", F.explode(_candidates(text)).alias("s")).where("s.kind = kind").select("s", "label")
    labelled = lambda df: df.select(F.array(*_features(F.col("s"))).alias("f"), F.col("s.kind").alias("kind"), "label", F.xxhash64("s.kind", "s.value", "s.before").alias("h"))
    found = materialize(labelled(known), "span-candidates")
    sample = labelled(made)
    # few of the candidates are true: both labels get half of the sample
    for label in (0.0, 1.0):
        sample = sample.unionByName(found.where(F.col("label") == label).orderBy("h").limit(rows // 2))
    sample = materialize(sample.repartition(4), "span-sample")
    fit, rest = sample.where("pmod(h, 4) != 0"), sample.where("pmod(h, 4) = 0")
    model = GBTClassifier(featuresCol="v", labelCol="label", maxDepth=MAX_DEPTH, maxIter=TREES, stepSize=0.3, seed=5).fit(fit.select(array_to_vector("f").alias("v"), "label"))
    trees = tuple(_read_tree(t.toDebugString) for t in model.trees)
    learned = SpanModel(trees, tuple(float(w) for w in model.treeWeights), ())
    p = learned.probability([F.get("f", F.lit(k)) for k in range(len(FEATURES))])
    grid = [k / 40 for k in range(12, 40)]
    scored = rest.where(F.col("kind").isin(*EXTRA)).select("kind", "label", p.alias("p"))
    got = scored.groupBy("kind").agg(*[F.avg(F.when(F.col("p") >= t, F.col("label"))).alias(f"t{k}") for k, t in enumerate(grid)]).collect()
    thresholds = []
    for row in sorted(got, key=lambda r: r.kind):
        good = [t for k, t in enumerate(grid) if row[f"t{k}"] is not None and row[f"t{k}"] >= PRECISION]
        if good:
            thresholds.append((row.kind, good[0]))
    return SpanModel(trees, learned.weights, tuple(thresholds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (SHA-256 of the base spans as
    kind:start:end, by kind as listed and start, joined by commas) and spans (all spans, base
    ones first, the further kinds by generator and start), offsets in code points, end exclusive.

    Null and empty texts have no spans and the hash of the empty string; null doc_ids and repeated
    rows each give their row; an empty table gives no rows. One map over the documents, beside
    the candidates of the sampled ones.
    """
    docs = docs.select("doc_id", "text")
    model = fit_spans(docs, rows)
    found = with_spans(docs, model).select("doc_id", F.col("_spans").alias("s"))
    base = F.filter("s", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def redact(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``docs``, all columns, with every span of the text replaced by its kind in brackets; n_chars follows where there is one.

    Overlapping spans are replaced together, under the kind of the first. Texts without spans,
    null ones included, stay as they are.
    """
    name = "_pii"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    found = with_spans(docs, fit_spans(docs.select("doc_id", "text"), rows), name)
    ordered = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def rewritten(spans: Column) -> Column:
        def pieces(reach: Column) -> Column:
            piece = lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.array_join(F.transform(spans, lambda s, i: piece(s, F.get(reach, i))), "")

        ends = F.transform(spans, lambda s: -s["minus_end"])
        return F.concat(let(_prefix_max(ends), pieces), F.substring(F.col("text"), F.array_max(ends) + 1, F.char_length("text")))

    out = found.withColumn("text", F.when(F.size(name) > 0, let(ordered, rewritten)).otherwise(F.col("text"))).drop(name)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
