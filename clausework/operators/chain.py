"""The whole review chain of a corpus (N-18): every rule in its order, with a ledger on each finding.

Documents become facts in one map over their texts: flags, conflicts and what the verifiers
find. Findings join those facts once, by doc_id; all later stages are projections and windows on
that partitioning. A dropped finding stays on its row, marked, until the result is taken, and
each stage that changes, drops or adds a finding writes (stage, field, before, after) to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK, Layer, with_layers, words_in
from clausework.operators import clauses, findings
from clausework.operators.clauses import VERIFIERS, Verifier

FACTS = (*findings.FLAGS, "conflicts", "first_surviving", "first_ending", "verified")
ADDED = ("original_category", "contradiction_detected", "detection_method", "verifier")
STATE = ("is_finding", "added_by", "dropped_by", "drop_reason", "ledger")
ENTRY = "struct<stage:string,field:string,before:string,after:string>"
LIVE = "(is_finding and dropped_by is null)"
#: Stages in the order in which they run; the document-level pass repeats three drops whose inputs no stage in between changes, so they stand once.
STAGES = (
    "severity_normalized", "fields_normalized", "advice_refined", "quotes_deduplicated", "balanced_indemnity", "false_sla", "mismatched_title", "titles_rewritten",
    "complete_exclusions", "short_noncompete", "own_time_inventions", "wrong_section", "document_bmi", "standard_nda", "mutual_capped_indemnity", "asymmetry",
    "contradictions_suppressed", "contradictions_elevated", "verifiers",
)
_RULE_OF = {"balanced_indemnity": "n7", "false_sla": "n8", "mismatched_title": "n12", "complete_exclusions": "n9", "short_noncompete": "n10", "own_time_inventions": "n11", "wrong_section": "n9b"}
COLUMNS = ("doc_id", *findings.COLUMNS[1:], *ADDED, *STATE)


def document_facts(docs: DataFrame, verifiers: Sequence[Verifier] = VERIFIERS) -> DataFrame:
    """(doc_id, flags, conflicts, the clauses in conflict, verified): all that the chain needs of a document, by one map over its text."""
    steps = dict.fromkeys(v.layers for v in verifiers)
    found = with_layers(docs.select("doc_id", "text"), [*findings.document_flag_layers(SPARK), *clauses.conflict_layers(SPARK), *[layer for step in steps for layer in step(SPARK)]])
    quotes = F.array(*[F.expr(f"if(({v.fires}) and {v.quote} <> '', {v.quote}, null)") for v in verifiers]) if verifiers else F.array().cast("array<string>")
    short = [F.expr(f"left({c}, {clauses.EXCERPT})").alias(c) for c in ("first_surviving", "first_ending")]
    differ = F.expr("first_surviving <> first_ending").alias("differ")
    facts = F.struct("doc_id", *findings.FLAGS, "conflicts", *short, differ, quotes.alias("verified"))
    return found.select(F.inline(F.array(facts)))  # a generator: filters on facts are not pushed below, where the rules would be copied


def _entry(stage: str, field: str, before: str, after: str) -> str:
    return f"named_struct('stage', '{stage}', 'field', '{field}', 'before', cast({before} as string), 'after', cast({after} as string))"


def _change(rows: DataFrame, stage: str, layers: Sequence[Layer], updates: dict[str, str]) -> DataFrame:
    """Set fields of the findings that are left to the layers' columns, and note what changed."""
    made = with_layers(rows, layers)
    entries = ", ".join(f"if({LIVE} and not ({f} <=> {new}), {_entry(stage, f, f, new)}, null)" for f, new in updates.items())
    out = {f: F.expr(f"if({LIVE}, {new}, {f})") for f, new in updates.items()} | {"ledger": F.expr(f"concat(ledger, filter(array({entries}), x -> x is not null))")}
    return made.select(*[out[c].alias(c) if c in out else c for c in rows.columns])


def _drop(rows: DataFrame, drops: dict[str, tuple[str, str]], layers: Sequence[Layer] = ()) -> DataFrame:
    """Mark findings by the first of ``drops`` (stage: condition, reason) that holds; both are SQL."""
    made, columns = with_layers(rows, layers), rows.columns
    for stage, (condition, reason) in drops.items():
        hit = f"({LIVE} and coalesce({condition}, false))"
        out = {
            "dropped_by": F.expr(f"if({hit}, '{stage}', dropped_by)"),
            "drop_reason": F.expr(f"if({hit}, {reason}, drop_reason)"),
            "ledger": F.expr(f"if({hit}, concat(ledger, array({_entry(stage, 'dropped', 'null', reason)})), ledger)"),
        }
        made = made.withColumns(out)
    return made.select(*columns)


def _rules(rows: DataFrame, stages: Sequence[str]) -> DataFrame:
    return _drop(rows, {s: (_RULE_OF[s], SPARK.text(findings.REASONS[_RULE_OF[s]])) for s in stages}, findings.suppression_layers(SPARK))


def _deduplicated(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("_key", F.expr(f"if({LIVE}, {findings.quote_key(SPARK)}, null)"))
    marked = keyed.withColumn("_first", F.min("issue_no").over(Window.partitionBy("doc_id", "_key")))
    return _drop(marked, {"quotes_deduplicated": ("_key <> '' and issue_no > _first", "'Repeats the quote of an earlier finding'")}).drop("_key", "_first")


def _in_conflict(rows: DataFrame) -> DataFrame:
    """held: the finding quotes survival and another one of its document an ending in the same topic, or the other way round.

    Counted per topic in a window of the document, so that no two findings are paired.
    """
    quote = "coalesce(quoted_text, '')"
    rows = rows.withColumn("_topics", F.expr(clauses.topics(SPARK, clauses.WHOLE)))
    rows = rows.withColumns({"_s": F.expr(f"{LIVE} and {SPARK.has(quote, clauses.SURVIVAL)}"), "_t": F.expr(f"{LIVE} and {SPARK.has(quote, clauses.TERMINATION)}")})
    names = list(clauses.TOPICS)
    counts = {f"_{kind}_{k}": F.expr(f"count_if({kind} and array_contains(_topics, '{name}'))").over(Window.partitionBy("doc_id")) for kind in ("_s", "_t") for k, name in enumerate(names)}
    rows = rows.withColumns(counts)
    met = [f"(array_contains(_topics, '{name}') and ((_s and __t_{k} - cast(_t as int) > 0) or (_t and __s_{k} - cast(_s as int) > 0)))" for k, name in enumerate(names)]
    return rows.withColumn("held", F.expr(" or ".join(met))).drop("_s", "_t", *counts)


def _added(rows: DataFrame, made: Sequence[tuple[str, str, dict[str, str]]], last: str) -> DataFrame:
    """Put findings behind a document's: ``made`` are (stage, condition, fields as SQL), seen on its first row; ``last`` is its last number."""
    own = rows.schema
    kept = [f.name for f in own if f.name not in ("_one", last)]
    shaped = lambda fields: "named_struct(" + ", ".join(f"'{c}', cast({fields.get(c, 'null')} as {own[c].dataType.simpleString()})" for c in kept) + ")"
    facts = {c: c for c in ("doc_id", *FACTS, "differ")}
    items = []
    for k, (stage, condition, fields) in enumerate(made):
        state = {"is_finding": "true", "added_by": f"'{stage}'", "ledger": f"array({_entry(stage, 'added', 'null', fields['issue_title'])})", "issue_no": f"{last} + {k + 1}"}
        items.append(f"if(_one = 1 and ({condition}), {shaped(facts | fields | state)}, null)")
    return rows.select(F.expr(f"inline(filter(array({shaped({c: c for c in kept})}, {', '.join(items)}), x -> x is not null))"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_one": F.row_number().over(Window.partitionBy("doc_id").orderBy("issue_no")), "_last": F.coalesce(F.max("issue_no").over(Window.partitionBy("doc_id")), F.lit(0))})


def audit_chain(docs: DataFrame, issues: DataFrame, verifiers: Sequence[Verifier] = VERIFIERS) -> DataFrame:
    """All findings of ``docs`` (doc_id, text) after the chain, dropped ones too, with their ledgers.

    ``issues`` are findings as parsed (see ``findings.COLUMNS``; other columns are left out). Returns
    COLUMNS: the finding, original_category, contradiction_detected, detection_method, verifier, added_by and
    dropped_by (a stage, or null), drop_reason, ledger. Findings of a document that is not in ``docs`` pass
    the rules that need none; a null text is empty; a document without findings can get some.
    Shuffles by doc_id only. See ``chain_findings``, ``stage_ledger`` and ``chain_trace``.
    """
    given = issues.select(*[F.col(c) if c in issues.columns else F.lit(None).cast("string").alias(c) for c in findings.COLUMNS])
    # a full join keeps no partitioning: one more shuffle by doc_id serves all windows
    rows = document_facts(docs, verifiers).join(given, "doc_id", "full").repartition("doc_id")
    empty = {"original_category": "string", "contradiction_detected": "boolean", "detection_method": "string", "verifier": "string", "added_by": "string", "dropped_by": "string", "drop_reason": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | {"is_finding": F.col("issue_no").isNotNull(), "ledger": F.expr(f"cast(array() as array<{ENTRY}>)")})
    rows = rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in findings.FLAGS})
    rows = _change(rows, "severity_normalized", findings.severity_layers(SPARK), {"severity": "new_severity"})
    rows = _change(rows, "fields_normalized", findings.field_layers(SPARK), {"category": "new_category", "risk_explanation": "new_explanation", "suggested_improvement": "new_advice"})
    rows = _change(rows, "advice_refined", findings.advice_layers(SPARK), {"suggested_improvement": "new_improvement"})
    rows = _deduplicated(rows)
    rows = _rules(rows, ("balanced_indemnity", "false_sla", "mismatched_title"))
    rows = _change(rows, "titles_rewritten", findings.title_layers(SPARK), {"issue_title": "new_title"})
    rows = _rules(rows, ("complete_exclusions", "short_noncompete", "own_time_inventions", "wrong_section"))
    for stage, column in (("document_bmi", "s14"), ("standard_nda", "s15"), ("mutual_capped_indemnity", "s16")):
        rows = _change(rows, stage, findings.level_layers(SPARK), {"severity": column})
    rows = _change(rows, "asymmetry", findings.level_layers(SPARK), {"severity": "s17", "category": "c17"})
    rows = _in_conflict(rows)
    reason = "case contradiction_type " + " ".join(f"when '{k}' then {SPARK.text(r)}" for k, r in clauses.REASONS.items()) + " end"
    rows = _drop(rows, {"contradictions_suppressed": ("contradiction_type is not null and not held", reason)}, clauses.contradiction_layers(SPARK))
    rows = rows.withColumn("_hit", F.expr(f"{LIVE} and (held or arrays_overlap(_topics, split(coalesce(nullif(conflicts, ''), '-'), '[|]')))")).drop("held", "_topics")
    up = f"_hit and coalesce(category, '') <> 'Structural Inconsistency' and lower(coalesce(category, '')) not in {words_in(clauses.NEVER_STRUCTURAL)}"
    rows = rows.withColumn("_up", F.expr(up))
    elevated = [{"e_category": "if(_up, 'Structural Inconsistency', category)", "e_original": "if(_up, category, original_category)", "e_detected": "if(_up, true, contradiction_detected)"}]
    rows = _change(rows, "contradictions_elevated", elevated, {"category": "e_category", "original_category": "e_original", "contradiction_detected": "e_detected"})
    rows = _numbered(rows.withColumn("_any_hit", F.max("_hit").over(Window.partitionBy("doc_id"))).drop("_hit", "_up"))
    place, why, advice = (SPARK.text(x) for x in clauses.GENERATED)
    made = {"issue_title": "'Structural Inconsistency'", "severity": "'MEDIUM'", "category": "'Structural Inconsistency'", "location": place, "risk_explanation": why, "suggested_improvement": advice, "quoted_text": "concat(first_surviving, ' | ', first_ending)", "contradiction_detected": "false"}
    rows = _added(rows, [("contradictions_elevated", "conflicts <> '' and differ and not coalesce(_any_hit, false)", made)], "_last").drop("_any_hit")
    same = "lower(trim(coalesce({}, ''))) = lower(trim({}))".format
    known = {f"_known_{k}": F.max(F.expr(f"{LIVE} and {same('issue_title', SPARK.text(v.issue_title))} and {same('category', SPARK.text(v.category))}")).over(Window.partitionBy("doc_id")) for k, v in enumerate(verifiers)}
    rows = _numbered(rows.withColumns(known))
    items = [
        ("verifiers", f"get(verified, {k}) is not null and not coalesce(_known_{k}, false)", {f: SPARK.text(x) for f, x in v.values().items()} | {"quoted_text": f"get(verified, {k})", "detection_method": "'verifier'", "verifier": SPARK.text(v.name)})
        for k, v in enumerate(verifiers)
    ]
    return _added(rows, items, "_last").where("is_finding").select(*COLUMNS)


def chain_findings(rows: DataFrame) -> DataFrame:
    """The findings that the chain keeps."""
    return rows.where("dropped_by is null").drop("is_finding", "dropped_by", "drop_reason", "ledger")


def _stage_no(column: str) -> str:
    return f"case {column} " + " ".join(f"when '{s}' then {k + 1}" for k, s in enumerate(STAGES)) + " end"


def stage_ledger(rows: DataFrame) -> DataFrame:
    """N-18: one row for each entry: doc_id, issue_no, stage_no, stage, field, before, after. field is 'dropped' or 'added' where the finding was."""
    each = rows.select("doc_id", "issue_no", F.inline("ledger"))
    return each.select("doc_id", "issue_no", F.expr(_stage_no("stage")).alias("stage_no"), "stage", "field", "before", "after")


def chain_trace(rows: DataFrame) -> DataFrame:
    """N-18: per stage, zeros too: stage_no, stage, n_before, n_changed (findings with another value), n_dropped, n_added, n_after.

    Entries are counted by partial aggregation; the running totals are over one row per stage.
    """
    entries = F.expr("array_distinct(transform(ledger, e -> struct(e.stage, case when e.field in ('dropped', 'added') then e.field else 'changed' end as kind)))")
    counts = rows.select(F.inline(entries)).groupBy("stage").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("changed", "dropped", "added")])
    given = rows.agg(F.count_if(F.col("added_by").isNull()).alias("given"))
    every = rows.sparkSession.createDataFrame([(k + 1, s) for k, s in enumerate(STAGES)], "stage_no int, stage string")
    filled = every.join(counts, "stage", "left").join(F.broadcast(given), how="cross").na.fill(0)
    after = "cast(given + sum(n_added - n_dropped) over (order by stage_no) as bigint)"
    out = filled.withColumn("n_after", F.expr(after)).withColumn("n_before", F.expr("lag(n_after, 1, given) over (order by stage_no)"))
    return out.select("stage_no", "stage", "n_before", "n_changed", "n_dropped", "n_added", "n_after")
