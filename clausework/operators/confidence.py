"""Confidence of audits and of advice (K-1 to K-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK, Layer, SparkSql, clamp, flag_sum, with_layers, words_in
from clausework.operators.classify import AUTHORITY, INDIA
from clausework.operators.quality import WORD, label

#: Weights, accepted categories, penalties and caps.
AUDIT_WEIGHTS = {
    "qt_match_rate": 0.30, "category_validity": 0.12, "explanation_quality": 0.12, "improvement_quality": 0.10, "severity_consistency": 0.08,
    "location_diversity": 0.08, "count_signal": 0.08, "domain_signal": 0.07, "parse_success": 0.05,
}
VALID_CATEGORIES = (
    "structural inconsistency", "indemnification", "liability exposure", "governing law", "residuals", "enforceability weakness",
    "negotiation imbalance", "privacy risk", "confidentiality termination", "intellectual property", "restrictive covenants",
)
ADVISORY_WEIGHTS = {"refusal_absent": 0.25, "topic_relevance": 0.20, "completeness": 0.20, "no_generic": 0.20, "no_uncertainty": 0.15}
TOPIC_WORDS = (
    "contract", "clause", "liability", "indemnif", "termination", "confidential", "breach", "damages", "jurisdiction", "governing law", "arbitration", "compliance", "regulation",
    "statute", "obligation", "warranty", "disclaimer", "intellectual property", "copyright", "trademark", "patent", "non-disclosure", "nda", "employment", "severance", "non-compete", "non-solicit",
)
#: Refusals, each tried by itself; the service's name before "advisory scope" may be any word.
REFUSALS = (
    r"(?i)\b(?:I cannot|I can't|I am unused|I'm unused)", r"(?i)\b(?:cannot assist|can't help|won't help)", r"(?i)\b(?:I refuse|I will not answer)",
    r"(?i)\bdoes not generate full legal agreements\b", r"(?i)\boutside \S+ advisory scope\b", r"(?i)\bI assist only with legal practice\b",
)
DISCLAIMERS = r"(?i)\b(?:I am not a lawyer|I am not an attorney|not legal advice|consult a lawyer|consult an attorney|seek legal counsel|seek professional legal advice|for informational purposes only)"
ANSWERS = r"(?i)\b(?:is (?:generally |likely )?enforceable|is unenforceable|is void|is valid|appears? (?:to be|enforceable)|you (?:should|can|may|must)|is likely|the clause is)\b"
CONTRAST = r"(?i)\b(?:but|however|that said|that being said|nevertheless|in general|generally)\b"
REDIRECT = r"(?i)\b(?:please consult|consult (?:a|an|your) (?:lawyer|attorney)|seek (?:legal|professional) (?:counsel|advice)|contact a (?:lawyer|attorney)|I(?:'m| am) sorry)\b"
GENERIC = (r"(?i)\b(?:it depends|this is a complex|there are many factors)", r"(?i)\b(?:generally speaking|in general|typically)", r"(?i)\b(?:I would recommend|you should consider)")
UNCERTAIN = (r"(?i)\b(?:to the best of my knowledge|as far as I know|I cannot verify|I am not certain)", r"(?i)\b(?:may not be accurate|information may be inaccurate|details may be incorrect)")


def quote_match(q: SparkSql) -> str:
    """1 if the text holds the quote or the quote is short, 0.5 if it holds the first 40 characters, else 0."""
    key = "lower(trim(coalesce(quoted_text, '')))"
    return f"case when length({key}) < 20 then 1.0 when {q.contains('low', key)} then 1.0 when {q.contains('low', f'left({key}, 40)')} then 0.5 else 0.0 end"


def _tiers(x: str, steps: tuple[tuple[int, float], ...], last: float) -> str:
    return "case " + " ".join(f"when {x} >= {n} then {v}" for n, v in steps) + f" else {last} end"


#: Sums per document over findings joined with the lower-cased text; then the factors.
AUDIT_SUMS = {
    "n_issues": "count(issue_no)", "s_match": "sum(case when issue_no is not null then matched end)", "n_valid": "sum(cast(valid as int))", "n_why": "sum(why_words)", "n_advice": "sum(advice_words)",
    "lo": "min(rank)", "hi": "max(rank)", "n_places": "count(distinct place)",
}


def finding_layers(q: SparkSql) -> list[Layer]:
    return [
        {
            "matched": quote_match(q), "valid": f"lower(coalesce(category, '')) in {words_in(VALID_CATEGORIES)}", "why_words": q.count("coalesce(risk_explanation, '')", WORD),
            "advice_words": q.count("coalesce(suggested_improvement, '')", WORD), "rank": "case upper(coalesce(severity, 'MEDIUM')) when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end", "place": "lower(coalesce(location, 'unknown'))",
        }
    ]


def factor_layers() -> list[Layer]:
    none = "n_issues = 0"
    expected = "case when n_words < 200 then 1 when n_words < 500 then 2 when n_words < 1000 then 3 else 4 end"
    d = lambda e: f"cast({e} as double)"
    return [
        {"ratio": f"cast(n_issues as double) / ({expected})"},
        {
            "qt_match_rate": d(f"case when {none} or n_words is null then 0.5 else cast(s_match as double) / n_issues end"), "category_validity": d(f"case when {none} then 0.5 else cast(n_valid as double) / n_issues end"),
            "explanation_quality": d(f"case when {none} then 0.3 else {_tiers('cast(n_why as double) / nullif(n_issues, 0)', ((30, 1.0), (20, 0.8), (10, 0.6), (5, 0.4)), 0.2)} end"),
            "improvement_quality": d(f"case when {none} then 0.3 else {_tiers('cast(n_advice as double) / nullif(n_issues, 0)', ((25, 1.0), (15, 0.8), (8, 0.6), (3, 0.4)), 0.2)} end"),
            "severity_consistency": d(f"case when {none} then 0.5 when lo <> hi then 1.0 when lo in (2, 3) then 0.8 else 0.5 end"), "location_diversity": d(f"case when {none} then 0.5 when n_places >= 3 then 1.0 when n_places = 2 then 0.7 else 0.4 end"),
            "count_signal": d("case when n_words is null then 0.5 when ratio between 0.5 and 2.0 then 1.0 when ratio between 0.25 and 3.0 then 0.7 else 0.4 end"),
        },
    ]


FACTORS = tuple(k for k in AUDIT_WEIGHTS if k not in ("domain_signal", "parse_success"))


def audit_factors(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """K-1: the factors that come from findings, for every document, those without findings included.

    Findings of a document are few; they are joined to its text once, reduced to numbers in the
    same stage and added up by doc_id on the join's own partitioning.
    """
    texts = docs.select("doc_id", F.lower("text").alias("low"), F.when(F.length("text") > 0, F.expr(SPARK.count("text", WORD))).alias("n_words"))
    both = with_layers(texts.join(issues, "doc_id", "left"), finding_layers(SPARK))
    live = lambda e: e.replace("count(distinct place)", "count(distinct case when issue_no is not null then place end)").replace("cast(valid as int)", "case when issue_no is not null then cast(valid as int) end")
    sums = both.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *[F.expr(live(e)).alias(k) for k, e in AUDIT_SUMS.items()])
    return with_layers(sums, factor_layers()).select("doc_id", *FACTORS)


def score_layers() -> list[Layer]:
    base = " + ".join(f"{k} * {w}" for k, w in AUDIT_WEIGHTS.items())
    return [
        {"raw": f"{clamp(base)} * case when policy_detected then 0.50 else 1.0 end * case when non_legal_detected then 0.25 else 1.0 end * case when duplicate_suppressed > 0 then 0.75 else 1.0 end"},
        {"capped": "case when parse_success < 1 then least(raw, 0.25) else raw end"},
        {"score": "cast(case when fallback_used and input_degraded then least(capped, 0.25) when input_degraded then least(capped, 0.30) else capped end as double)"},
        {"confidence_label": label("score")},
    ]


def audit_confidence(factors: DataFrame) -> DataFrame:
    """K-2: weighted score, penalties and caps. Needs all factors and policy_detected, non_legal_detected, duplicate_suppressed, fallback_used, input_degraded."""
    return with_layers(factors, score_layers()).select("doc_id", "score", "confidence_label")


def advisory_layers(q: SparkSql, t: str = "text", query: str = "''", degraded: str = "false", fallback: str = "false", jurisdiction: str = "''") -> list[Layer]:
    """A refusal that goes on to answer counts as none: it holds an answer's words, or a contrast behind a refusing phrase with no mere redirection there."""
    x = f"coalesce({t}, '')"
    # what follows the first match of each refusing phrase; (?s) lets the rest span lines
    tails = {f"tail_{k}": q.first(x, "(?s)" + p + "(.*)$", 1) for k, p in enumerate(REFUSALS)}
    goes_on = [f"({q.has(f'tail_{k}', CONTRAST)} and not {q.has(f'tail_{k}', REDIRECT)})" for k in range(len(REFUSALS))]
    both = f"lower(concat({x}, ' ', coalesce({query}, '')))"
    return [
        {**tails, "n_words": q.count(x, WORD), "a_both": both},
        {
            "refuses": f"(({' or '.join(q.has(x, p) for p in REFUSALS)}) and not {q.has(x, ANSWERS)} and not ({' or '.join(goes_on)}))", "n_topics": flag_sum([q.contains("a_both", q.text(w)) for w in TOPIC_WORDS]),
            "has_disclaimer": q.has(x, DISCLAIMERS), "n_generic": flag_sum([q.has(x, p) for p in GENERIC]), "n_uncertain": flag_sum([q.has(x, p) for p in UNCERTAIN]),
            "is_grounded": f"({q.has(x, AUTHORITY)} or {q.has(x, INDIA)})",
        },
        {
            "refusal_absent": "case when refuses then 0.0 else 1.0 end", "topic_relevance": "least(1.0, n_topics / 4.0)", "completeness": _tiers("n_words", ((200, 1.0), (100, 0.8), (50, 0.6), (20, 0.4)), 0.2),
            "no_generic": "greatest(0.0, 1.0 - 0.3 * n_generic)", "no_uncertainty": "greatest(0.0, 1.0 - 0.25 * n_uncertain)",
        },
        {"base": f"cast({clamp(' + '.join(f'{k} * {w}' for k, w in ADVISORY_WEIGHTS.items()))} as double)"},
        {"limited": f"cast(case when {degraded} and {fallback} then least(base, 0.25) when {degraded} then least(base, 0.30) else base end as double)"},
        {"held": "cast(case when refuses then least(limited, 0.40) else limited end as double)"},
        {"score": f"cast(case when {jurisdiction} = 'not specified' and not is_grounded and held > 0.5 then held * 0.5 else held end as double)"},
        {"confidence_label": label("score")},
    ]


def advisory_confidence(responses: DataFrame, text: str = "text") -> DataFrame:
    """K-3: score and label of each advisory answer; other columns pass through.

    Columns query, input_degraded, fallback_used and jurisdiction count where they are there. Disclaimers (has_disclaimer)
    lower nothing; genuine refusals stay at 0.40, degraded input at 0.30, at 0.25 with a fallback; answers without a
    jurisdiction and without an authority lose half.
    """
    given = {"query": "query", "degraded": "coalesce(input_degraded, false)", "fallback": "coalesce(fallback_used, false)", "jurisdiction": "coalesce(jurisdiction, '')"}
    needed = {"query": "query", "degraded": "input_degraded", "fallback": "fallback_used", "jurisdiction": "jurisdiction"}
    chosen = {k: e for k, e in given.items() if needed[k] in responses.columns}
    return with_layers(responses, advisory_layers(SPARK, text, **chosen)).select(*responses.columns, "score", "confidence_label", "has_disclaimer")


def confidence_label(rows: DataFrame, score: str = "score") -> DataFrame:
    """K-4: HIGH from 0.75, MEDIUM from 0.45, else LOW."""
    return rows.withColumn("confidence_label", F.expr(label(score)))
