"""Clauses and contradictions (C-1 to C-8) and rule checks on whole documents (N-19).

A document's clauses stay an array on its row, so splitting and conflicts are one map; null and
blank documents have no clauses. Findings of a document meet by equi-joins on (doc_id, topic).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK, Layer, SparkSql, any_of, cues, has_cued, with_layers, words_in

#: The 21 topics of obligations.
TOPICS: dict[str, str] = {
    "confidential": r"(?i)\bconfidential", "proprietary": r"(?i)\bproprietary", "non_disclosure": r"(?i)\bnon-?disclos", "nda": r"(?i)\bnda\b",
    "non_compete": r"(?i)\bnon-?compete", "competition": r"(?i)\bcompetition", "restrictive_covenant": r"(?i)\brestrictive\s+covenant", "governing_law": r"(?i)\bgoverning\s+law",
    "choice_of_law": r"(?i)\bchoice\s+of\s+law", "jurisdiction": r"(?i)\bjurisdiction", "venue": r"(?i)\bvenue\b", "indemnity": r"(?i)\bindemnif",
    "hold_harmless": r"(?i)\bhold\s+harmless", "entire_agreement": r"(?i)\bentire\s+agreement", "merger": r"(?i)\bmerger\b", "integration": r"(?i)\bintegration\s+clause",
    "supersede": r"(?i)\bsupersed", "survival": r"(?i)\bsurviv", "post_termination": r"(?i)\bpost-?termination", "termination": r"(?i)\bterminat(?:e|ion|ing)", "expiry": r"(?i)\bexpir",
}
#: Signs of survival, ending, duration and of findings that deny themselves.
SURVIVAL = (
    r"(?i)\bsurvive\s+(?:the\s+)?termination\b|\bcontinues?\s+(?:to\s+)?(?:be\s+)?(?:in\s+)?effect\s+(?:after\s+)?(?:the\s+)?termination\b"
    r"|\bremain\s+(?:in\s+)?effect\s+(?:after\s+)?(?:termination|expiration)\b|\bshall\s+survive\b|\bwill\s+survive\b|\bobligations?\s+[^\n]*\bsurvive\b"
    r"|\bprovisions?\s+[^\n]*\bsurvive\b|\bterms?\s+[^\n]*\bsurvive\b|\bcontinues?\s+after\s+termination\b"
)
TERMINATION = (
    r"(?i)\b(?:cease|shall\s+not\s+survive|shall\s+not\s+continue|shall\s+not\s+remain|no\s+longer\s+bound)\b|\bimmediately\s+(?:cease|terminate|end)\b"
    r"|\b(?:terminates?\s+immediately|termination\s+of\s+[^\n]*\s+obligations)\b"
)
FINITE = r"(?i)\w+\s*\(\d+\)\s*years?|\d+\s*\(\w+\)\s*years?|\d+\s+years?|(?:for\s+a\s+period\s+of|lasts?\s+for)\s+\d+\s*years?"
PERPETUAL = r"(?i)\b(?:perpetual|indefinite|without\s+limit|permanently|in\s+perpetuity|indefinitely)\b"
TOO_SHORT = (
    r"(?i)\b(?:duration|period|time\s*frame|timeframe|length)\s+(?:is\s+)?(?:insufficient|inadequate|too\s+short|too\s+brev)"
    r"|\b(?:does\s+not\s+specify|fails?\s+to\s+specify|lacks?)\s+(?:(?:a|an|any|the)\s+(?:\w+\s+)?)?(?:duration|period|time\s*(?:limit|frame|period)|survival\s+period|length|expiration\s*date|end\s*date)"
    r"|\b(?:no\s+)?(?:specified|defined|stated)\s+(?:duration|period|end\s*date|termination\s*date)|\b(?:survival\s+)?(?:period|duration)\s+(?:is\s+)?(?:unspecified|undefined|not\s+stated|missing)"
    r"|\b(?:indefinite|perpetual|permanent)\s+(?:obligation|duty|commitment|survival)|\b(?:no\s+)?(?:end\s*date|expiration\s*date|termination\s*date)\s+(?:is\s+)?(?:provided|specified|stated|defined)"
    r"|\b(?:continues\s+(?:indefinitely|forever|perpetually)|no\s+end\s+to\s+obligations)"
)
MISSING = r"(?i)\b(?:missing|absent|lacks?|no\s+(?:survival|provision|clause)|omitted|not\s+found|not\s+present|does\s+not\s+(?:exist|appear|state|specify))\b"
ENDING = r"(?i)\b(?:terminate|termination|expire|expiration|cease|dissolve)\b"
SELF_NEGATING = (
    r"(?i)does\s+not\s+create\s+(?:significant\s+)?risk|does\s+not\s+appear\s+(?:to\s+)?(?:create\s+)?(?:significant\s+)?(?:risk|problematic)"
    r"|(?:is|appears?\s+to\s+be)\s+standard\s+and\s+(?:does\s+not|is\s+not)|commercially\s+reasonable|no\s+suggested\s+improvement\s+needed|does\s+not\s+warrant\s+a\s+finding"
    r"|not\s+a\s+risk|no\s+significant\s+risk"
)
PROHIBITED = (
    "confidentiality termination", "missing survival clause", "termination survival", "survival clause missing", "no survival provision", "absence of survival",
    "survival omission", "confidentiality ends on termination", "termination of confidentiality",
)
NEVER_STRUCTURAL = ("indemnification", "liability exposure")
HEADING = r"^(?:\d+(?:\.\d+)*[.)]\s+[A-Z]|(?:Section|Article|Clause|Paragraph)\s+\d+|(?:EXHIBIT|APPENDIX|SCHEDULE)\s+[A-Z])"
#: Place, explanation and advice of the finding that a conflict of a document makes.
GENERATED = (
    "Multiple sections",
    "The contract contains contradictory language across different sections: one clause specifies that certain obligations survive termination for a defined period, while another clause "
    "states that all obligations cease immediately upon termination. These provisions cannot both be satisfied simultaneously.",
    "Resolve the contradiction by specifying whether the obligations survive termination or cease immediately, and ensure consistent language across all related clauses.",
)
EXCERPT = 300
_MARK = "\x1e\x1f\x1e"


def _not_empty(q: SparkSql, items: str) -> str:
    return q.keep(items, "c", "c <> ''")


def _cued(q: SparkSql, items: str, low: str, pattern: str) -> str:
    """The items with a pattern; Spark looks at them only if ``low``, the whole text in lower case, holds one of the pattern's cues."""
    found = q.keep(items, "c", q.has("c", pattern))
    words = cues(pattern) if q is SPARK else []
    return f"if({any_of([q.contains(low, q.text(w)) for w in words])}, {found}, filter({items}, c -> false))" if words else found


def _lowered(q: SparkSql, name: str, x: str) -> list[Layer]:
    """Spark's column of the text in lower case, in which it looks for cues."""
    return [{name: f"lower({x})"}] if q is SPARK else []


def clause_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    """Blank-line parts, which stand if their first surviving and first ending ones differ; else lines grouped at headings; else the whole text."""
    x = f"coalesce({t}, '')"
    first = lambda p: q.at(_cued(q, "parts", "c_low", p), "0")
    marked = q.join(q.each("lines", "c", f"case when {q.has('c', HEADING)} then concat({q.text(_MARK)}, c) else c end"), " ")
    return [
        *_lowered(q, "c_low", x),
        {"parts": _not_empty(q, q.each(q.split(x, r"\n\s*\n+"), "c", q.strip("c"))), "lines": _not_empty(q, q.each(q.split(x, r"\n"), "c", q.strip("c")))},
        {"survivor": first(SURVIVAL), "ender": first(TERMINATION), "headed": _not_empty(q, q.each(q.split(marked, _MARK), "c", "trim(c)"))},
        {"clauses": f"case when {q.size('parts')} >= 2 and coalesce(survivor <> ender, false) then parts when {q.size('headed')} >= 2 then headed else {_not_empty(q, q.array([q.strip(x)]))} end"},
    ]


def flag_layers(q: SparkSql, c: str = "clause") -> list[Layer]:
    signs = {"is_survival": SURVIVAL, "is_termination": TERMINATION, "is_finite": FINITE, "is_perpetual": PERPETUAL, "is_insufficient": TOO_SHORT}
    return [*_lowered(q, "f_low", c), {name: has_cued(q, c, "f_low", p) for name, p in signs.items()}]


def topics(q: SparkSql, t: str) -> str:
    return q.keep(q.array([f"case when {q.has(t, p)} then '{name}' else '' end" for name, p in TOPICS.items()]), "x", "x <> ''")


def conflict_layers(q: SparkSql) -> list[Layer]:
    """Topics shared by surviving and ending clauses. Clauses are joined by a sign that no topic's pattern spans."""
    return [
        *clause_layers(q),
        {"surviving": _cued(q, "clauses", "c_low", SURVIVAL), "ending": _cued(q, "clauses", "c_low", TERMINATION)},
        {"s_text": q.join("surviving", " | "), "t_text": q.join("ending", " | "), "several": f"{q.size('clauses')} >= 2"},
        {"shared": q.sorted(q.both(topics(q, "s_text"), topics(q, "t_text")))},
        {"conflicts": f"case when several then {q.join('shared', '|')} else '' end"},
        {"first_surviving": f"case when several then coalesce({q.at('surviving', '0')}, '') else '' end", "first_ending": f"case when several then coalesce({q.at('ending', '0')}, '') else '' end"},
    ]


def split_clauses(docs: DataFrame) -> DataFrame:
    """C-1: (doc_id, clause_no, clause)."""
    split = with_layers(docs.select("doc_id", "text"), clause_layers(SPARK))
    # a generator below: the filter that an explode of a column brings along is not pushed below the rules, where it would copy them
    held = split.select(F.inline(F.array(F.struct("doc_id", "clauses"))))
    return held.select("doc_id", F.posexplode("clauses").alias("clause_no", "clause"))


def clause_flags(clauses: DataFrame) -> DataFrame:
    """C-2: survival, ending, finite, perpetual and insufficient-duration signs of each clause."""
    return with_layers(clauses, flag_layers(SPARK)).select("doc_id", "clause_no", "is_survival", "is_termination", "is_finite", "is_perpetual", "is_insufficient")


def obligation_domains(rows: DataFrame, text: str = "clause") -> DataFrame:
    """C-3: the topics of obligation that a text touches, as an array column domains."""
    return rows.withColumn("domains", F.expr(topics(SPARK, text)))


def document_conflicts(docs: DataFrame) -> DataFrame:
    """C-4: (doc_id, conflicts, first_surviving, first_ending, n_surviving, n_ending): topics that surviving and ending clauses share; documents of one clause have none. No shuffle.

    The row passes through a generator, so that a filter on it is not pushed below and the rules copied into it.
    """
    out = with_layers(docs.select("doc_id", "text"), conflict_layers(SPARK))
    row = F.struct("conflicts", "first_surviving", "first_ending", F.size("surviving").alias("n_surviving"), F.size("ending").alias("n_ending"))
    return out.select("doc_id", F.inline(F.array(row)))


WHOLE = "concat_ws(' ', coalesce(category, ''), coalesce(quoted_text, ''), coalesce(risk_explanation, ''))"


def issue_conflicts(issues: DataFrame) -> DataFrame:
    """C-5: findings of which one quotes survival and another an ending in the same topic of the same document, by an equi-join on (doc_id, topic)."""
    quote = "coalesce(quoted_text, '')"
    marked = issues.select("doc_id", "issue_no", F.expr(topics(SPARK, WHOLE)).alias("domains"), F.expr(SPARK.has(quote, SURVIVAL)).alias("s"), F.expr(SPARK.has(quote, TERMINATION)).alias("t")).where("s or t")
    each = marked.withColumn("domain", F.explode("domains"))
    a, b = each.where("s").select("doc_id", "domain", F.col("issue_no").alias("i")), each.where("t").select("doc_id", "domain", F.col("issue_no").alias("j"))
    pairs = a.join(b, ["doc_id", "domain"]).where("i <> j")
    return pairs.select("doc_id", F.explode(F.array("i", "j")).alias("issue_no")).distinct()


REASONS = {
    "survival_category_mismatch": "The quote says that the obligation survives, but the category says that it does not.",
    "semantic_mismatch": "The quote says that the obligation survives, but the explanation says that it ends or is missing.",
    "finite_duration_contradiction": "The quote has a finite duration, but the title or explanation says perpetual or indefinite.",
    "self_negating": "The finding's own explanation says that the clause is not risky.",
}


def contradiction_layers(q: SparkSql) -> list[Layer]:
    quote, why, title = "coalesce(quoted_text, '')", "coalesce(risk_explanation, '')", "coalesce(issue_title, '')"
    mild = r"(?i)^\s*(?:low|medium)\s*(?:/|$)"
    return [
        {"q_survives": q.has(quote, SURVIVAL), "w_short": q.has(why, TOO_SHORT)},
        {
            "contradiction_type": f"""case when q_survives and lower(trim(coalesce(category, ''))) in {words_in(PROHIBITED)} and not w_short then 'survival_category_mismatch'
              when q_survives and not w_short and ({q.has(why, MISSING)} or {q.has(why, ENDING)}) then 'semantic_mismatch'
              when {q.has(quote, FINITE)} and ({q.has(title, PERPETUAL)} or {q.has(why, PERPETUAL)}) then 'finite_duration_contradiction'
              when {q.has("coalesce(severity, '')", mild)} and {q.has(why, SELF_NEGATING)} then 'self_negating' end"""
        },
    ]


def contradiction_types(issues: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """C-6: the first contradiction within a finding with its reason, null if none. Findings in ``held`` (doc_id, issue_no; by default those of ``issue_conflicts``) have none: their clauses really conflict."""
    typed = with_layers(issues, contradiction_layers(SPARK)).drop("q_survives", "w_short")
    keys = (issue_conflicts(issues) if held is None else held).select(F.col("doc_id").alias("_d"), F.col("issue_no").alias("_i"))
    joined = typed.join(keys, (typed["doc_id"] == F.col("_d")) & (typed["issue_no"] == F.col("_i")), "left")
    out = joined.withColumn("contradiction_type", F.when(F.col("_d").isNull(), F.col("contradiction_type"))).drop("_d", "_i")
    reason = F.expr("case contradiction_type " + " ".join(f"when '{k}' then {SPARK.text(r)}" for k, r in REASONS.items()) + " end")
    return out.withColumn("contradiction_reason", reason)


def suppress_contradictions(issues: DataFrame) -> DataFrame:
    """C-7: findings without a contradiction of their own; the log of the others is ``contradiction_types`` where a type stands."""
    return contradiction_types(issues).where("contradiction_type is null").select(*issues.columns)


def elevate_contradictions(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """C-8: findings in conflict, with each other or with the document's own conflict, become structural inconsistencies.

    Indemnities and liabilities keep their category. A document whose clauses conflict without any such finding gets one
    made from the first surviving and the first ending clause, with its place, explanation and advice; its issue_no follows
    the document's last. All columns of ``issues`` stay; original_category and contradiction_detected are added.
    """
    found = document_conflicts(docs).where("conflicts <> ''")
    flagged = issue_conflicts(issues).withColumn("hit", F.lit(True))
    marked = issues.join(flagged, ["doc_id", "issue_no"], "left").join(found.select("doc_id", "conflicts"), "doc_id", "left")
    touches = F.expr(f"arrays_overlap({topics(SPARK, WHOLE)}, split(coalesce(conflicts, '-'), '[|]'))")
    marked = marked.withColumn("hit", F.coalesce("hit", F.lit(False)) | touches)
    raised = F.col("hit") & (F.coalesce("category", F.lit("")) != "Structural Inconsistency") & ~F.lower(F.coalesce("category", F.lit(""))).isin(*NEVER_STRUCTURAL)
    up = {"original_category": F.when(raised, F.col("category")), "contradiction_detected": raised, "category": F.when(raised, "Structural Inconsistency").otherwise(F.col("category"))}
    kept = marked.withColumns(up).drop("conflicts", "hit")
    counts = marked.groupBy("doc_id").agg(F.max("issue_no").alias("_last"), F.max("hit").alias("_hit"))
    bare = found.where("first_surviving <> first_ending").join(counts, "doc_id", "left").where("not coalesce(_hit, false)")
    place, why, advice = (F.lit(x) for x in GENERATED)
    made = bare.select(
        "doc_id", F.expr("cast(coalesce(_last, 0) + 1 as int)").alias("issue_no"), F.lit("Structural Inconsistency").alias("issue_title"), F.lit("MEDIUM").alias("severity"),
        F.lit("Structural Inconsistency").alias("category"), place.alias("location"), why.alias("risk_explanation"), advice.alias("suggested_improvement"), F.lit(False).alias("contradiction_detected"),
        F.expr(f"concat(left(first_surviving, {EXCERPT}), ' | ', left(first_ending, {EXCERPT}))").alias("quoted_text"),
    )
    wanted = [c for c in made.columns if c in kept.columns]
    return kept.unionByName(made.select(*wanted), allowMissingColumns=True)


#: Fixed values of the three document rules: title, category, severity, place.
RULES = {
    "as_is": ("AS-IS No Warranty Provision", "Enforceability Weakness", "MEDIUM", "Warranty / Disclaimer Clause"),
    "asymmetric": ("Asymmetric Termination Rights", "Negotiation Imbalance", "MEDIUM", "Termination Clause"),
    "single_trigger": ("Single-Trigger Change of Control Acceleration", "Enforceability Weakness", "MEDIUM", "Change of Control Clause"),
}
WARRANTY_LINE = r"(?i)as is|as available|no warranties|warranties|warranty|disclaimer"
WARRANTY_CONFIRM = r"(?i)as is|as available|no warrant"
AS_IS = r"(?i)as\s+is|as\s+available"
NO_WARRANTY = r"(?i)no\s+warrant(?:y|ies)|warranties\s+of\s+any\s+kind|disclaim(?:s|ed)?\s+all\s+warranties|without\s+warrant(?:y|ies)"
AT_WILL = r"(?i)\bterminate\b[^\n]*\b(?:at any time|for convenience|for any reason|for no reason)\b"
ONLY_BREACH = r"(?i)\bterminate\b[^\n]*\bonly for\b[^\n]*\bbreach\b|\bonly\b[^\n]*\bif\b[^\n]*\bbreach\b"
CONTROL_LINE = r"(?i)change of control"
SINGLE_TRIGGER = r"(?i)immediately\s+accelerate|become\s+fully\s+vested|(?:accelerat|vest)[^\n]*upon[^\n]*change of control|upon\s+(?:a\s+)?change of control[^\n]*accelerat"
DOUBLE_TRIGGER = r"(?i)if[^\n]*(?:employ|terminat)[^\n]*accelerat|accelerat[^\n]*only[^\n]*if"


def _section(q: SparkSql, at: str, lines: str = "d_lines") -> str:
    """Lines from one before the first index to two behind the last; null without an index."""
    first, last = q.least_of(at), q.most_of(at)
    return f"case when {q.size(at)} > 0 then {q.join(q.cut(lines, f'greatest(0, {first} - 1)', f'(least({q.size(lines)}, {last} + 3) - greatest(0, {first} - 1))'), chr(10))} end"


def _quoted(q: SparkSql, section: str, n: int) -> str:
    """The first n lines that are not blank, stripped, on one line."""
    return q.join(q.head(_not_empty(q, q.each(q.split(section, r"\n"), "c", q.strip("c"))), n), " ")


def verifier_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    """Each rule finds lines, takes the section around them and tests it; documents without the rule's words skip the lines."""
    x = f"coalesce({t}, '')"
    find = lambda p: f"case when {has_cued(q, x, 'v_low', p)} then {q.where('d_lines', 'c', q.has('c', p))} else {q.keep(q.array(['0']), 'k', 'k < 0')} end"
    low, high = "least(at_will, only_breach)", "greatest(at_will, only_breach)"
    same = q.join(q.cut("d_lines", "greatest(0, at_will - 1)", f"(least({q.size('d_lines')}, at_will + 1) - greatest(0, at_will - 1))"), "\n")
    rest = q.join(q.cut("d_lines", f"greatest(0, {low} - 1)", f"(greatest({q.size('d_lines')}, {high} + 1) - greatest(0, {low} - 1))"), "\n")
    return [
        *_lowered(q, "v_low", x),
        {"d_lines": q.split(x, r"\n")},
        {"w_at": find(WARRANTY_LINE), "c_at": find(CONTROL_LINE), "u_at": find(AT_WILL), "b_at": find(ONLY_BREACH)},
        {"w_section": _section(q, "w_at"), "c_section": _section(q, "c_at"), "at_will": q.most_of("u_at"), "only_breach": q.most_of("b_at")},
        {"t_section": f"case when at_will = only_breach then {same} else {rest} end", "t_lines": "case when at_will = only_breach then 1 else 2 end"},
        {
            "as_is": f"coalesce({q.has('w_section', WARRANTY_CONFIRM)} and {q.has('w_section', AS_IS)} and {q.has('w_section', NO_WARRANTY)}, false)",
            "asymmetric": "at_will is not null and only_breach is not null",
            "single_trigger": f"coalesce({q.has('c_section', SINGLE_TRIGGER)} and not {q.has('c_section', DOUBLE_TRIGGER)}, false)",
        },
        {
            "as_is_quote": _quoted(q, "w_section", 4), "single_trigger_quote": _quoted(q, "c_section", 4),
            "asymmetric_quote": f"concat('Asymmetric termination rights clause: ', case when t_lines = 1 then {_quoted(q, 't_section', 1)} else {_quoted(q, 't_section', 2)} end)",
        },
    ]


@dataclass(frozen=True)
class Verifier:
    """A rule on a document's whole text and the finding that it makes.

    ``fires`` and ``quote`` are SQL expressions over the document's columns and those that ``layers``
    add (text is the document); ``section_verifier`` makes one from patterns.
    """

    name: str
    issue_title: str
    category: str
    severity: str
    location: str
    risk_explanation: str
    suggested_improvement: str
    fires: str
    quote: str
    layers: Callable[[SparkSql], list[Layer]]

    def values(self) -> dict[str, str]:
        return {k: getattr(self, k) for k in ("issue_title", "category", "severity", "location", "risk_explanation", "suggested_improvement")}


#: Explanation and advice of the three document rules.
VERIFIED_TEXTS = {
    "as_is": (
        "The AS IS / no warranty provision disclaims all implied warranties (merchantability, fitness, title, non-infringement). In a paid service agreement, this creates significant risk for "
        "the paying party who has no guarantee of service quality or functionality.",
        "Include standard warranty that the service will perform substantially in accordance with the documentation and that professional-grade efforts will be used. Limit exclusions to implied "
        "warranties only where necessary.",
    ),
    "asymmetric": (
        "The agreement contains asymmetric termination rights: the provider can terminate for convenience at any time while the customer can only terminate for material breach. This creates a "
        "fundamental power imbalance where the disadvantaged party's business depends on a service the provider can cancel at will.",
        "Make termination rights mutual: both parties should have the same termination rights, or at minimum provide the disadvantaged party with a corresponding right to terminate for "
        "convenience.",
    ),
    "single_trigger": (
        "Single-trigger change of control accelerates all unvested equity upon change of control alone, without requiring termination. This creates a perverse incentive for the executive to "
        "facilitate a sale regardless of shareholder interest. Double-trigger (acceleration only if terminated after CIC) is the market standard.",
        "Replace single-trigger with double-trigger vesting: acceleration should occur only if the executive is terminated (without cause or for good reason) within 12-24 months following a "
        "change of control.",
    ),
}
VERIFIER_NAMES = {"as_is": "as_is_no_warranty", "asymmetric": "asymmetric_termination", "single_trigger": "single_trigger_coc"}
VERIFIERS = tuple(Verifier(VERIFIER_NAMES[k], *values, *VERIFIED_TEXTS[k], k, f"{k}_quote", verifier_layers) for k, values in RULES.items())


def section_verifier(
    name: str, issue_title: str, category: str, severity: str, location: str, risk_explanation: str, suggested_improvement: str, lines: str, confirm: Sequence[str] = (), deny: Sequence[str] = (), quoted_lines: int = 4
) -> Verifier:
    """A verifier that takes the section around the lines with the pattern ``lines``; all of ``confirm`` and none of ``deny`` must be in it. Its first lines are the quote."""
    if not re.fullmatch("[a-z][a-z0-9_]*", name):
        raise ValueError(f"a verifier's name is its columns' prefix: {name!r}")

    def layers(q: SparkSql) -> list[Layer]:
        x = "coalesce(text, '')"
        at, section = f"{name}__at", f"{name}__section"
        tests = [q.has(section, p) for p in confirm] + [f"not {q.has(section, p)}" for p in deny]
        return [
            {f"{name}__lines": q.split(x, r"\n")},
            {at: f"case when {q.has(x, lines)} then {q.where(f'{name}__lines', 'c', q.has('c', lines))} else {q.keep(q.array(['0']), 'k', 'k < 0')} end"},
            {section: _section(q, at, f"{name}__lines")},
            {f"{name}__fires": f"coalesce({' and '.join([f'{section} is not null', *tests])}, false)", f"{name}__quote": _quoted(q, section, quoted_lines)},
        ]

    return Verifier(name, issue_title, category, severity, location, risk_explanation, suggested_improvement, f"{name}__fires", f"{name}__quote", layers)


def verify_clauses(docs: DataFrame, verifiers: Sequence[Verifier] = VERIFIERS) -> DataFrame:
    """N-19: findings of the ``verifiers`` on the text itself, one row each, in their order within a document.

    Returns doc_id, issue_title, category, severity, location, quoted_text, risk_explanation, suggested_improvement,
    detection_method ('verifier'), verifier. A rule without a quote finds nothing. No shuffle.
    """
    if len({v.name for v in verifiers}) < len(verifiers):
        raise ValueError("two verifiers of one name")
    steps = dict.fromkeys(v.layers for v in verifiers)
    found = with_layers(docs.select("doc_id", "text"), [layer for step in steps for layer in step(SPARK)])

    def item(v: Verifier) -> str:
        fields = {k: SPARK.text(x) for k, x in v.values().items()} | {"quoted_text": v.quote, "detection_method": "'verifier'", "verifier": SPARK.text(v.name)}
        return f"if(({v.fires}) and {v.quote} <> '', named_struct({', '.join(f"'{k}', {x}" for k, x in fields.items())}), null)"

    rows = F.expr(f"explode(filter(array({', '.join(map(item, verifiers))}), x -> x is not null))")
    order = ["issue_title", "category", "severity", "location", "quoted_text", "risk_explanation", "suggested_improvement", "detection_method", "verifier"]
    return found.select("doc_id", rows.alias("f")).select("doc_id", *[f"f.{c}" for c in order])
