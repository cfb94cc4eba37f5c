"""Findings (N-1 to N-18, N-20): severity, categories, wording, duplicates and suppression.

A finding is (doc_id, issue_no, issue_title, severity, category, location, quoted_text,
risk_explanation, suggested_improvement); issue_no is its place in the list. Rules that need
the document join ``document_flags``, a few booleans per document, never its text. Null fields
count as empty; a blank document lets no document-level rule fire.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import findings_values as v
from clausework.functions.dialect import SPARK, Layer, SparkSql, any_of, has_cued, with_layers, words_in

COLUMNS = ("doc_id", "issue_no", "issue_title", "severity", "category", "location", "quoted_text", "risk_explanation", "suggested_improvement")
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RANK = "case upper(trim({})) when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL' then 3 else -1 end"
KINDS = tuple(v.EXCLUSION_KINDS)


def _text(column: str) -> str:
    return f"coalesce({column}, '')"


TITLE, QUOTE, WHY, ADVICE, CATEGORY = (_text(c) for c in ("issue_title", "quoted_text", "risk_explanation", "suggested_improvement", "category"))


def _holds_any(q: SparkSql, t: str, terms: Sequence[str]) -> str:
    return any_of([q.contains(t, q.text(w)) for w in terms])


def document_flag_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    x = _text(t)
    flags = {
        "d_any": f"length({x}) > 0", "d_long": f"length({x}) > 100",
        "d_disclaims_sla": _holds_any(q, "d_low", v.SLA_DISCLAIMERS), "d_saas": _holds_any(q, "d_low", v.SAAS_TERMS), "d_sla": _holds_any(q, "d_low", v.SLA_TERMS),
        **{f"d_{k}": has_cued(q, x, "d_low", p) for k, p in v.EXCLUSION_KINDS.items()}, "d_excludes": has_cued(q, x, "d_low", v.HAS_EXCLUSIONS),
        "d_mutual": has_cued(q, x, "d_low", v.MUTUAL), "d_cap": has_cued(q, x, "d_low", v.DOCUMENT_CAP), "d_exclusion": has_cued(q, x, "d_low", v.DOCUMENT_EXCLUSION),
        "d_wide_cap": has_cued(q, x, "d_low", v.WIDE_CAP), "d_wide_exclusion": has_cued(q, x, "d_low", v.WIDE_EXCLUSION), "d_unlimited": has_cued(q, x, "d_low", v.UNLIMITED),
        "d_standard_nda": f"({has_cued(q, x, "d_low", v.NDA_EXCLUSIONS)} and {has_cued(q, x, "d_low", v.NDA_TERM)} and {has_cued(q, x, "d_low", v.NDA_RETURN)})",
        "d_one_sided_strict": _one_sided(q, x, strict=True), "d_one_sided_stems": _one_sided(q, x, strict=False),
    }
    return [{"d_low": f"lower({x})"}, flags]


def _one_sided(q: SparkSql, x: str, strict: bool) -> str:
    """A duty beside an explicit denial, or a denial in a document without mutual language. ``strict`` ends stems at whole words."""
    end = r"\b" if strict else ""
    return f"(({has_cued(q, x, "d_low", v.SOME_DUTY + end)} and {has_cued(q, x, "d_low", v.EXPLICIT_NO_DUTY)}) or ({has_cued(q, x, "d_low", v.NO_DUTY + end)} and not {has_cued(q, x, "d_low", v.MUTUAL_WORDS)}))"


FLAGS = (
    "d_any", "d_long", "d_disclaims_sla", "d_saas", "d_sla", *(f"d_{k}" for k in KINDS), "d_excludes", "d_mutual", "d_cap", "d_exclusion",
    "d_wide_cap", "d_wide_exclusion", "d_unlimited", "d_standard_nda", "d_one_sided_strict", "d_one_sided_stems",
)


def document_flags(docs: DataFrame) -> DataFrame:
    """What the rules need to know of each document: booleans, (doc_id, d_...)."""
    return with_layers(docs.select("doc_id", "text"), document_flag_layers(SPARK)).select("doc_id", *FLAGS)


def indemnity_layers(q: SparkSql, t: str = "quoted_text") -> list[Layer]:
    x = _text(t)
    return [
        {"i_mutual": q.has(x, v.MUTUAL), "i_cap": q.has(x, v.CAP), "i_exclusion": q.has(x, v.EXCLUSION), "i_risk": q.has(x, v.UNLIMITED)},
        {"i_balanced": "i_mutual and i_cap and i_exclusion"},
    ]


def severity_layers(q: SparkSql) -> list[Layer]:
    rank = RANK.format
    shielded = (
        f"({q.has(QUOTE, v.WIDE_CAP)} and {q.has(QUOTE, v.WIDE_EXCLUSION)} and not i_risk and ({q.has(QUOTE, v.INDEMNITY)} or {q.has(QUOTE, v.LIABILITY_WORDS)}))"
    )
    lawful = f"(upper(trim({CATEGORY})) in ('GOVERNING LAW', 'GOVERNING LAW RISK') or {q.contains(f'upper({CATEGORY})', q.text('RESIDUALS'))})"
    return [
        *indemnity_layers(q),
        {"s_given": f"upper(trim({_text('severity')}))"},
        {"s_risk": "case when i_risk then 'CRITICAL' else s_given end"},
        {"s_law": f"case when {lawful} and {rank('s_risk')} < 2 then 'HIGH' else s_risk end"},
        {"s_balanced": f"case when i_balanced and {rank('s_law')} > 0 then 'LOW' else s_law end"},
        {"s_shielded": f"case when {rank('s_balanced')} >= 2 and {shielded} then 'MEDIUM' else s_balanced end"},
        {"new_severity": "case when s_shielded <> '' and s_shielded <> s_given then s_shielded else severity end"},
    ]


def _replaced(q: SparkSql, t: str, rules: Sequence[tuple[str, str]]) -> str:
    for pattern, to in rules:
        t = q.replace(t, pattern, to)
    return t


def field_layers(q: SparkSql) -> list[Layer]:
    """Wording, category and advice of a finding: one chain, since each step sees the one before."""
    everything = f"concat_ws(' ', c_given, {QUOTE}, {WHY}, {ADVICE})"
    uncapped = ((r"(?i)\bunlimited\b", "uncapped"),)
    residual = ((r"(?i)\b(?:unlimited|uncapped|no limit|no cap)\b", "unrestricted"), (r"(?i)\b(?:liability|liable|damages|exposure)\b", ""), (r"\s+", " "))
    return [
        *indemnity_layers(q),
        {"c_given": q.strip(CATEGORY)},
        {"c_low": "lower(c_given)", "f_all": everything},
        {"f_indemnity": f"({q.contains('c_low', q.text('indemnification'))} or {q.has('f_all', v.INDEMNITY)})", "f_capped": q.has(QUOTE, v.CAP_CUES), "f_why": _replaced(q, WHY, uncapped), "f_advice": _replaced(q, ADVICE, uncapped)},
        {"f_why_capped": f"case when f_indemnity and f_capped then {_replaced(q, 'f_why', v.CAPPED_WORDING)} else f_why end", "f_advice_capped": f"case when f_indemnity and f_capped then {_replaced(q, 'f_advice', v.CAPPED_WORDING)} else f_advice end"},
        {"f_why_balanced": f"case when i_balanced and {q.has('f_why_capped', v.ALARMING)} then {q.text(v.BALANCED_TEXT)} else f_why_capped end"},
        {
            "c_mapped": f"""case when c_low in {words_in(v.STRUCTURAL_NAMES)} then 'Structural Inconsistency' when c_low in {words_in(v.INDEMNITY_NAMES)} then 'Indemnification'
              when c_low = 'liability exposure' and {q.has('f_all', v.INDEMNITY)} then 'Indemnification' when c_low = 'enforceability weakness' and f_indemnity and f_capped then 'Indemnification'
              when c_low = 'legal risk exposure' then 'Liability Exposure' when c_low = 'residuals risk' then 'Residuals' when c_low = 'governing law risk' then 'Governing Law' else c_given end"""
        },
        {
            "new_category": f"""case when lower(c_mapped) in {words_in(v.NEVER_STRUCTURAL)} then c_mapped
              when upper(trim({_text('severity')})) in ('HIGH', 'CRITICAL') and {q.has('f_all', v.STRUCTURAL_PHRASES)} then 'Structural Inconsistency'
              when {q.has('f_why_balanced', v.STRUCTURAL_CUES)} or {q.has(QUOTE, v.STRUCTURAL_CUES)} then 'Structural Inconsistency' else c_mapped end"""
        },
        {"c_new": "lower(new_category)"},
        {
            "new_explanation": f"case when {q.contains('c_new', q.text('residuals'))} then trim({_replaced(q, 'f_why_balanced', residual)}) else f_why_balanced end",
            "new_advice": f"""case when {q.contains('c_new', q.text('indemnification'))} and {q.has(QUOTE, v.UNLIMITED_TOKENS)} then {q.text(v.INDEMNITY_ADVICE)}
              when {q.contains('c_new', q.text('confidentiality'))} and not {q.has(TITLE, v.INCOMPLETE_TITLE)} then {q.text(v.CONFIDENTIALITY_ADVICE)}
              when {q.contains('c_new', q.text('residuals'))} then {q.text(v.RESIDUALS_ADVICE)} else f_advice_capped end""",
        },
    ]


def advice_layers(q: SparkSql, category: str = "category", advice: str = "suggested_improvement") -> list[Layer]:
    """Advice that is short or says nothing specific is composed from the group's parts whose signs the finding shows."""
    now = q.strip(_text(advice))
    groups = " ".join(f"when {_holds_any(q, 'a_low', words)} then {q.text(name)}" for words, name in v.GROUPS)
    good = " ".join(f"when {q.text(name)} then {_holds_any(q, 'lower(a_now)', words)}" for name, words in v.GOOD_WORDS.items())
    whole = f"concat_ws(' ', {QUOTE}, {WHY}, {TITLE})"

    def parts(rules: Sequence[tuple[str, str]]) -> str:
        return q.array([q.text(a) if not sign else f"case when {q.has('a_all', rf'(?i)(?:\b(?:{sign})\b)')} then {q.text(a)} else '' end" for sign, a in rules])

    chosen = " ".join(f"when {q.text(name)} then {parts(rules)}" for name, rules in v.RISK_ADVICE.items())
    return [
        {"a_low": f"lower({q.strip(_text(category))})", "a_now": now, "a_all": whole},
        {"a_group": f"case {groups} else a_low end"},
        {"a_good": f"case a_group {good} else false end", "a_known": f"a_group in {words_in(list(v.RISK_ADVICE))}"},
        {"a_needed": f"a_known and (length(a_now) < 25 or (not a_good and (length(a_now) < 40 or not {q.has('a_now', v.SPECIFIC_ADVICE)})))"},
        {"a_parts": q.keep(f"case a_group {chosen} end", "a", "a <> ''")},
        {"a_n": q.size("a_parts")},
        {
            "new_improvement": f"""case when {_text(category)} = '' then {advice} when not a_needed then a_now when a_n = 1 then {q.at('a_parts', '0')}
              when a_n = 2 then concat({q.at('a_parts', '0')}, ' and ', {q.at('a_parts', '1')}) else concat({q.join(q.cut('a_parts', '0', 'greatest(a_n - 1, 0)'), ', ')}, ', and ', {q.last('a_parts')}) end"""
        },
    ]


def quote_key(q: SparkSql) -> str:
    """Quoted text without outer white space and quotation marks, in lower case, with single spaces."""
    return f"lower({q.replace(q.replace(q.replace(q.strip(QUOTE), '^\"+|\"+$'), '^\\x27+|\\x27+$'), r'\s+', ' ')})"


def suppression_layers(q: SparkSql) -> list[Layer]:
    """Reasons for which findings (joined with document flags) are dropped, in order; null keeps a finding."""
    title = f"trim({TITLE})"
    months = f"try_cast(nullif({q.first(QUOTE, v.MONTHS, 1)}, '') as bigint)"
    word = "[a-z][a-z-]+"
    topic = q.keep(q.all("t_low", word), "w", f"length(w) > 2 and w not in {words_in(v.STOP_WORDS)}")
    root = "greatest(5, least(length(a), length(b)) - 2)"
    parts = f"(length(a) > 3 and length(b) > 3 and (left(a, length(b)) = b or left(b, length(a)) = a or left(a, {root}) = left(b, {root})))"
    near = q.some(q.split("w", "-"), "a", q.some(q.split("t", "-"), "b", parts))
    met = q.some("topic", "w", q.some("quote_words", "t", f"(left(t, length(w)) = w or left(w, length(t)) = t or {near})"))
    searched = q.array([f"case when d_long then d_{k} else {q.has(QUOTE, p)} end" for k, p in v.EXCLUSION_KINDS.items()])
    kinds = q.keep(q.array([f"case when {q.at('searched', str(i))} then '{k}' else '' end" for i, k in enumerate(KINDS)]), "k", "k <> ''")
    return [
        *indemnity_layers(q),
        {"t_low": f"lower({TITLE})", "q_low": f"lower({QUOTE})", "is_ice": q.has(TITLE, v.INCOMPLETE_TITLE), "searched": searched},
        {"topic": topic, "quote_words": q.all("q_low", word), "kinds": kinds, "is_sla": _holds_any(q, "t_low", ("no service level agreement", "no sla"))},
        {
            "n7": "i_balanced and not i_risk", "n8": "is_sla and d_any and not d_disclaims_sla and (d_sla or not d_saas)",
            "n9": f"is_ice and {q.size('kinds')} = {len(KINDS)}", "n9b": f"is_ice and d_excludes and {q.has(QUOTE, v.OBLIGATION_QUOTE)}",
            "n10": f"{title} = 'Excessive Non-Compete Duration' and coalesce({months} <= 6, false)", "n11": f"{title} = 'Overbroad Invention Assignment' and {q.has(QUOTE, v.OWN_TIME)}",
            "n12": f"q_low <> '' and t_low <> '' and {q.size('topic')} > 0 and not {met}",
        },
        {"suppressed_by": "case " + " ".join(f"when {k} then '{k}'" for k in STAGES) + " end"},
        {"suppression_reason": "case suppressed_by " + " ".join(f"when {q.text(k)} then {q.text(r)}" for k, r in REASONS.items()) + " end", "matched_categories": f"case when suppressed_by = 'n9' then {q.join('kinds', '|')} else '' end"},
    ]


#: The rules in the order in which they drop findings, with the log's reasons.
REASONS = {
    "n7": "Balanced mutual indemnity without additional risk",
    "n8": "Document is not a hosted service or has service levels",
    "n12": "Title shares no topic with the quoted text",
    "n9": "All 4 standard exclusion categories found",
    "n10": "Non-compete duration <= 6 months (within acceptable threshold)",
    "n11": "Invention assignment clause contains own-time carve-out (not overbroad)",
    "n9b": "Quote is from the obligations; the document has exclusions elsewhere",
}
STAGES = tuple(REASONS)


def title_layers(q: SparkSql) -> list[Layer]:
    coc = "Single-Trigger Change of Control Acceleration"
    long_months = f"coalesce(try_cast(nullif({q.first('q_low', v.MONTHS, 1)}, '') as bigint) > 6, false)"
    has = lambda w: q.contains("q_low", q.text(w))
    return [
        {"q_low": f"lower({QUOTE})"},
        {
            "new_title": f"""case when issue_title = {q.text(coc)} and {has('solicit')} and not {has('change of control')} then 'Non-Solicitation Clause in NDA'
              when issue_title = {q.text(coc)} and {has('compete')} and not {has('change of control')} and {long_months} then 'Excessive Non-Compete Duration'
              when issue_title = 'Non-Competition' and {long_months} then 'Excessive Non-Compete Duration'
              when issue_title = 'Intellectual Property Ownership' and {q.contains(f'lower({CATEGORY})', q.text('intellectual property'))} and {has('consultant')} and {has('retain')} then 'Consultant Retains All Deliverable IP'
              else issue_title end"""
        },
    ]


def level_layers(q: SparkSql, strict: bool = True) -> list[Layer]:
    """Document-level changes of severity (N-14 to N-17), each with its own column."""
    rank = RANK.format("severity")
    category = f"lower(trim({CATEGORY}))"
    named = any_of([any_of([q.contains(category, q.text(c)), q.contains(f"lower({TITLE})", q.text(c))]) for c in v.NDA_CATEGORIES] + [q.has(TITLE, v.NDA_TITLES)])
    about = q.has(f"concat({category}, ' ', {TITLE})", v.INDEMNITY_STEM + (r"\b" if strict else ""))
    one_sided = f"(d_one_sided_{'strict' if strict else 'stems'} and {about})"
    open_ended = f"({q.has(QUOTE, v.UNLIMITED)} or {q.has(WHY, v.UNLIMITED)})"
    return [
        {
            "s14": f"case when {rank} > 0 and {q.has(QUOTE, v.WIDE_MUTUAL)} and not ({q.has(QUOTE, v.WIDE_CAP)} and {q.has(QUOTE, v.WIDE_EXCLUSION)}) and d_wide_cap and d_wide_exclusion and not d_unlimited then 'LOW' else severity end",
            "s15": f"case when d_standard_nda and {rank} > 0 and {named} then 'LOW' else severity end",
            "s16": f"case when d_mutual and d_cap and d_exclusion and {category} in {words_in(v.CAPPED_CATEGORIES)} and {rank} = 1 and not {q.has(WHY, v.FORBIDDEN)} then 'LOW' else severity end",
            "s17": f"case when {one_sided} and {rank} > 2 and not {open_ended} then 'HIGH' else severity end",
            "c17": f"case when {one_sided} then 'Negotiation Imbalance' else category end",
        },
    ]


def _keys(issues: DataFrame, layers: Sequence[Layer], columns: Sequence[str]) -> DataFrame:
    return with_layers(issues, layers).select("doc_id", "issue_no", *columns)


def balanced_indemnity_flags(issues: DataFrame) -> DataFrame:
    """N-1: mutual, cap, exclusion, additional risk of each finding's quote; balanced if the first three hold."""
    return _keys(issues, indemnity_layers(SPARK), ("i_mutual", "i_cap", "i_exclusion", "i_risk", "i_balanced"))


def override_severity(issues: DataFrame) -> DataFrame:
    """N-2: an unlimited quote is CRITICAL; governing law and residuals at least HIGH; balanced at most LOW; capped and excluded at most MEDIUM."""
    return _keys(issues, severity_layers(SPARK), ("new_severity",))


def remap_category(issues: DataFrame) -> DataFrame:
    """N-3: one name for each category; indemnities are not filed under liability; contradictory texts are structural, liabilities never."""
    return _keys(issues, field_layers(SPARK), ("new_category",))


def sanitize_language(issues: DataFrame) -> DataFrame:
    """N-4: explanations and advice without "unlimited", calmer where the quote is capped or balanced, canned for residuals, confidentiality and uncapped indemnities."""
    return _keys(issues, field_layers(SPARK), ("new_explanation", "new_advice"))


def refine_improvement(issues: DataFrame) -> DataFrame:
    """N-5: specific advice stays, other advice is composed from the group's parts; categories outside the groups keep theirs."""
    return _keys(issues, advice_layers(SPARK), ("new_improvement",))


def dedupe_quotes(issues: DataFrame) -> DataFrame:
    """N-6: the first finding of each quoted text of a document; findings without a quote all stay. Spam of one clause stays within its (document, quote) group."""
    keyed = issues.withColumn("_key", F.expr(quote_key(SPARK)))
    first = keyed.where("_key <> ''").groupBy("doc_id", "_key").agg(F.min("issue_no").alias("issue_no"))
    return keyed.where("_key = ''").select("doc_id", "issue_no").unionByName(first.select("doc_id", "issue_no"))


def suppressed(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """N-7 to N-12: (doc_id, issue_no, suppressed_by, suppression_reason, matched_categories): the first rule that drops a finding, null if none does."""
    return _keys(issues.join(document_flags(docs), "doc_id"), suppression_layers(SPARK), ("suppressed_by", "suppression_reason", "matched_categories"))


def _dropped_by(*rules: str):
    def run(issues: DataFrame, docs: DataFrame) -> DataFrame:
        marked = _keys(issues.join(document_flags(docs), "doc_id"), suppression_layers(SPARK), rules)
        return marked.where(" and ".join(f"not coalesce({r}, false)" for r in rules)).select("doc_id", "issue_no")

    return run


suppress_balanced, suppress_false_sla, suppress_noncompete, suppress_invention, suppress_mismatched_title = (_dropped_by(f"n{k}") for k in (7, 8, 10, 11, 12))
suppress_ice = _dropped_by("n9", "n9b")


def rewrite_titles(issues: DataFrame) -> DataFrame:
    """N-13: titles whose quote shows a non-solicitation, a long non-compete or a consultant's retained rights instead."""
    return _keys(issues, title_layers(SPARK), ("new_title",))


def document_levels(issues: DataFrame, docs: DataFrame, strict: bool = True) -> DataFrame:
    """N-14 to N-17: severity by the document's other terms: s14, s15, s16, s17 and the category c17. ``strict`` ends the stems of N-17 at whole words."""
    return _keys(issues.join(document_flags(docs), "doc_id"), level_layers(SPARK, strict), ("s14", "s15", "s16", "s17", "c17"))


def stage_trace(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """N-18: findings after each suppression rule, and how many it dropped: (stage, n_issues, n_dropped), in one pass."""
    marked = with_layers(issues.join(document_flags(docs), "doc_id"), suppression_layers(SPARK))
    counts = marked.groupBy("suppressed_by").agg(F.count("*").alias("n"))
    order = F.expr("case suppressed_by " + " ".join(f"when '{s}' then {k + 1}" for k, s in enumerate(STAGES)) + " else 99 end")
    total = counts.agg(F.sum("n").alias("total"))
    every = issues.sparkSession.createDataFrame([(k + 1, s) for k, s in enumerate(STAGES)], "stage_no int, stage string")
    by = counts.withColumn("stage_no", order).select("stage_no", "n")
    joined = every.join(by, "stage_no", "left").join(F.broadcast(total), how="cross").withColumn("n_dropped", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.withColumn("n_issues", F.expr("cast(total - sum(n_dropped) over (order by stage_no) as bigint)")).select("stage_no", "stage", "n_issues", "n_dropped")


def merge_verifier_findings(issues: DataFrame, found: DataFrame) -> DataFrame:
    """N-20: add rule findings unless the document has one of the same title and category, whatever the case and outer blanks.

    The columns of both stay, null where one side lacks them. Added findings are numbered behind the document's last, by verifier.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = issues.select("doc_id", key("issue_title").alias("_t"), key("category").alias("_c")).distinct()
    new = found.withColumns({"_t": key("issue_title"), "_c": key("category")}).join(known, ["doc_id", "_t", "_c"], "left_anti").drop("_t", "_c")
    last = issues.groupBy("doc_id").agg(F.max("issue_no").alias("_last"))
    order = Window.partitionBy("doc_id").orderBy(*[c for c in ("verifier", "issue_title", "category") if c in found.columns])
    numbered = new.join(last, "doc_id", "left").withColumn("issue_no", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("_last")
    return issues.unionByName(numbered, allowMissingColumns=True)
