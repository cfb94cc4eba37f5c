"""Document classification and routing (D-1 to D-6, P-1 to P-6): projections of one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from clausework.functions import vocab
from clausework.functions.counts import has_outline, with_counts
from clausework.functions.dialect import DUCK, SPARK, Layer, SparkSql, flag_sum, with_layers, words_in
from clausework.operators.quality import WORD, quality_counts_sql, quality_layers


def structure_score_of(hits: str, n: int) -> str:
    raw = f"({hits} / cast({n} as double))"
    third = f"least(1.0, {raw} * 1.3)"
    return f"case when {hits} >= 6 then least(1.0, {third} * 1.2) when {hits} >= 3 then {third} else {raw} end"


def phrase_count(q: SparkSql, t: str, phrases: Sequence[str]) -> str:
    """Occurrences of all phrases, each counted by itself: one fold over a list of (phrase) lengths."""
    part = f"(length({t}) - length(replace({t}, p, ''))) / length(p)"
    return q.total(q.each(q.array([q.text(p) for p in phrases]), "p", f"cast({part} as bigint)"))


def policy_counts_sql(terms: Sequence[str] = vocab.POLICY_WORDS, signals: Sequence[str] = vocab.CONTRACT_SIGNALS, k: int = 10) -> list[Layer]:
    """DuckDB's counts of policy and contract terms, over columns low and plain; Spark takes them from the kernel."""
    out: Layer = {}
    for name, words in (("policy", terms), ("contract", signals)):
        single, several = [x for x in words if " " not in x], [x for x in words if " " in x]
        hits = DUCK.array([f"case when contains(low, {DUCK.text(x)}) then {DUCK.text(x)} else '' end" for x in several] or ["''"])
        found = f"concat({DUCK.both(DUCK.array([DUCK.text(x) for x in single]), DUCK.distinct('plain'))}, {hits})"
        count = DUCK.size(DUCK.keep("plain", "w", f"w in {words_in(single)}"))
        out |= {f"{name}_hits": f"{count} + {phrase_count(DUCK, 'low', several)}" if several else count, f"{name}_matched": DUCK.join(DUCK.head(DUCK.sorted(DUCK.keep(found, "m", "m <> ''")), k), "|")}
    return [out]


def low_sql(t: str = "text") -> list[Layer]:
    return [{"low": f"lower(coalesce({t}, ''))"}]


def domain_counts_sql(phrases: Sequence[str] = vocab.LEGAL_PHRASES) -> list[Layer]:
    return [{"p_hits": phrase_count(DUCK, "low", phrases)}]


def type_counts_sql(types: Mapping[str, Sequence[str]] = vocab.POLICY_TYPES) -> list[Layer]:
    return [{"t_hits": DUCK.array([phrase_count(DUCK, "low", words) for words in types.values()])}]


#: What the kernel counts for each decision.
DOMAIN_PARTS = ("tokens", "words", "phrases", "cues")
POLICY_PARTS = ("words", "policy", "types", "cues")
ROUTE_PARTS = ("signs", "tokens", "words", "phrases", "policy", "types", "cues")


def domain_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    """Over the counts of DOMAIN_PARTS."""
    return [
        {"blank": f"({t} is null or not {q.has(t, WORD)})"},
        {"c_hits": flag_sum([has_outline(q, f"coalesce({t}, '')", p) for p in vocab.CONTRACT_STRUCTURE])},
        {
            "legal_keyword_ratio": "coalesce(cast(n_legal as double) / nullif(n_plain, 0), 0.0)",
            "structure_score": structure_score_of("c_hits", len(vocab.CONTRACT_STRUCTURE)),
            "legal_phrase_density": "coalesce(cast(p_hits as double) / nullif(n_tokens, 0), 0.0)",
            "non_legal_penalty": f"cast(case when blank then 0.5 else least(1.0, {flag_sum([has_outline(q, t, p) for p in vocab.NON_LEGAL_STRONG])} * 0.20 + {flag_sum([has_outline(q, t, p) for p in vocab.NON_LEGAL_WEAK])} * 0.08) end as double)",
        },
        {"signal": "legal_keyword_ratio * 0.40 + structure_score * 0.35 + legal_phrase_density * 0.25"},
        {"lifted": f"case when {has_outline(q, f'coalesce({t}, {chr(39) * 2})', vocab.EMPLOYMENT_TITLE)} then greatest(0.25, signal - non_legal_penalty) else greatest(0.0, signal - non_legal_penalty) end"},
        {"domain": "case when lifted <= 0.08 then 'NON_LEGAL' when lifted < 0.20 then 'POSSIBLY_LEGAL' else 'LEGAL' end", "domain_confidence": "lifted"},
    ]


def content_type_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    low = f"lower(coalesce({t}, ''))"
    names = list(vocab.CONTENT_TYPES)
    score = {f"s_{k}": f"({' + '.join(q.count(low, p) for p in vocab.CONTENT_TYPES[name])}) / cast({len(vocab.CONTENT_TYPES[name])} as double)" for k, name in enumerate(names)}
    return [score, {"best_score": "greatest(" + ", ".join(score) + ")"}, {"content_type": f"case when best_score = 0 then {q.text(vocab.UNCATEGORIZED)} " + " ".join(f"when s_{k} = best_score then {q.text(name)}" for k, name in enumerate(names)) + " end"}]


def keyword_layers(name: str = "policy") -> list[Layer]:
    return [{f"{name}_score": f"coalesce(cast({name}_hits as double) / nullif(n_plain, 0), 0.0)"}]


def type_layers(q: SparkSql, types: Mapping[str, Sequence[str]] = vocab.POLICY_TYPES) -> list[Layer]:
    score = {f"t_{k}": f"{q.at('t_hits', str(k))} * (cast(1.0 as double) / {len(words)})" for k, words in enumerate(types.values())}
    return [score, {"type_score": "greatest(0.0, " + ", ".join(score) + ")"}, {"policy_type": "case when type_score = 0 then 'General Policy' " + " ".join(f"when t_{k} = type_score then {q.text(name)}" for k, name in enumerate(types)) + " end"}]


def policy_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    """Over the counts of POLICY_PARTS."""
    employed = "is_employment"
    return [
        {"blank": f"({t} is null or not {q.has(t, WORD)})"},
        {"p_structure": flag_sum([has_outline(q, f"coalesce({t}, '')", p) for p in vocab.POLICY_STRUCTURE]), "is_employment": has_outline(q, f"coalesce({t}, '')", vocab.EMPLOYMENT_TITLE)},
        *keyword_layers("policy"), *keyword_layers("contract"), *type_layers(q),
        {"policy_signal": f"policy_score * 0.40 + ({structure_score_of('p_structure', len(vocab.POLICY_STRUCTURE))}) * 0.35 + type_score * 0.25"},
        {"effective": "greatest(0.0, policy_signal - contract_score * 0.5)"},
        {"clearly": "(policy_signal >= 0.04 and contract_score < 0.015 and policy_signal / greatest(contract_score, 0.001) >= 2.5) or (policy_signal >= 0.08 and contract_score < 0.0225)"},
        {"detection": f"case when blank or {employed} then 'NOT_POLICY' when clearly then 'POLICY' when policy_signal >= 0.04 and contract_score > 0.015 then 'UNCLEAR' else 'NOT_POLICY' end"},
        {
            "found_type": f"case when blank or {employed} then 'General Policy' else policy_type end",
            "policy_explanation": f"case when blank then {q.text(vocab.BLANK_EXPLANATION)} when {employed} then {q.text(vocab.EMPLOYMENT_EXPLANATION)} else case policy_type " + " ".join(f"when {q.text(k)} then {q.text(e)}" for k, e in vocab.POLICY_EXPLANATIONS.items()) + " end end",
        },
        {"policy_confidence": f"case when blank or {employed} then 0.0 when detection = 'POLICY' then least(1.0, effective * 3.0) else effective end"},
    ]


def route_counts_sql() -> list[Layer]:
    return [*quality_counts_sql(), *low_sql(), *domain_counts_sql(), *policy_counts_sql(), *type_counts_sql()]


def route_layers(q: SparkSql, fallback: str = "false") -> list[Layer]:
    """Over the counts of ROUTE_PARTS."""
    poor = "(n_tokens = 0 or cast(quoted_count as double) / nullif(n_tokens, 0) > 0.20 or coalesce(r_symbol, 0.0) > 0.25)"
    return [*quality_layers(q), *policy_layers(q), *domain_layers(q), {"route": f"case when {fallback} and is_degraded and {poor} then 'suppressed' when is_degraded then 'unreadable' when detection = 'POLICY' then 'policy' when domain = 'NON_LEGAL' then 'non_legal' else 'audit' end"}]


#: Signs of a jurisdiction and of authorities.
INDIA = r"(?i)\b(?:Indian law|India|Indian Contract|Specific Relief)\b"
AUTHORITY = r"(?i)\b(?:see|cited|statute|case|precedent|section)\b"
#: First-person disclosures, and questions about the maker.
DISCLOSURE = (
    r"(?i)\b(?:as\s+an?\s+|i\s*(?:am|'m)\s+an?\s+)(?:ai|artificial\s+intelligence|language\s+model|llm|chatbot|assistant)\b"
    r"|\bi\s*(?:am|'m)\s+(?:a\s+)?(?:large\s+)?language\s+model\b|\bi\s+was\s+(?:created|built|trained)\s+as\s+an?\s+(?:ai|assistant|language\s+model)\b"
)
MAKER_QUESTION = r"(?i)who made you|who created you|who built you|who is your creator"
REFUSALS = {
    "validation_error": "[SYSTEM ERROR] Response validation failed due to invalid format.",
    "identity_guard": "[SYSTEM REFUSAL] Response rejected due to identity guard violation.",
    "identity_disclosure": "[SYSTEM REFUSAL] Response rejected due to compliance violation: First-person AI identity disclosure detected.",
}


def jurisdiction_layers(q: SparkSql) -> list[Layer]:
    query, response = "coalesce(query, '')", "coalesce(response, '')"
    return [{"jurisdiction": f"case when {q.has(query, INDIA)} or {q.has(response, INDIA)} then 'India' else 'not specified' end", "is_grounded": f"({q.has(response, AUTHORITY)} or {q.has(response, INDIA)})"}]


def validity_layers(q: SparkSql, response: str = "response", query: str = "query", maker: tuple[str, str] | None = None) -> list[Layer]:
    x, asked = f"coalesce({response}, '')", f"coalesce({query}, '')"
    guard = ""
    if maker:
        surname, name = (q.text(n.lower()) for n in maker)
        guard = f"when mode <> 'REDACTION' and {q.has(asked, MAKER_QUESTION)} and {q.contains(f'lower({asked})', surname)} and not {q.contains(f'lower({x})', name)} then 'identity_guard' "
    return [
        {"violation_type": f"case when {x} = '' then 'validation_error' {guard}when {q.has(x, DISCLOSURE)} then 'identity_disclosure' end"},
        {"is_valid": "violation_type is null", "refusal_message": "case violation_type " + " ".join(f"when '{k}' then {q.text(m)}" for k, m in REFUSALS.items()) + " end"},
    ]


def _select(docs: DataFrame, parts: Sequence[str], layers: Sequence[Layer], columns: Sequence[str], **lists) -> DataFrame:
    counted = with_counts(docs.select("doc_id", "text"), parts, **lists) if parts else docs.select("doc_id", "text")
    return with_layers(counted, layers).select("doc_id", *columns)


def legal_keyword_ratio(docs: DataFrame, words: Sequence[str] = vocab.LEGAL_WORDS) -> DataFrame:
    """D-1: share of legal keywords among words of three letters and more; 0 without words."""
    return _select(docs, DOMAIN_PARTS, domain_layers(SPARK)[:3], ("legal_keyword_ratio",), legal=words)


def structure_score(docs: DataFrame) -> DataFrame:
    """D-2: share of contract outlines that match, raised from three and from six matches on."""
    return _select(docs, DOMAIN_PARTS, domain_layers(SPARK)[:3], ("c_hits", "structure_score"))


def phrase_density(docs: DataFrame, phrases: Sequence[str] = vocab.LEGAL_PHRASES) -> DataFrame:
    """D-3: occurrences of legal phrases for each word; overlapping phrases all count."""
    return _select(docs, DOMAIN_PARTS, domain_layers(SPARK)[:3], ("p_hits", "legal_phrase_density"), phrases=phrases)


def non_legal_penalty(docs: DataFrame) -> DataFrame:
    """D-4: penalty for signs of other kinds of text; 0.5 for blank texts."""
    return _select(docs, DOMAIN_PARTS, domain_layers(SPARK)[:3], ("non_legal_penalty",))


def classify_domain(docs: DataFrame) -> DataFrame:
    """D-5: LEGAL, POSSIBLY_LEGAL or NON_LEGAL with its confidence."""
    return _select(docs, DOMAIN_PARTS, domain_layers(SPARK), ("domain", "domain_confidence"))


def non_legal_content_type(docs: DataFrame) -> DataFrame:
    """D-6: the content type with the most hits for each pattern, the first of equal ones, and its explanation."""
    why = {"content_explanation": "case content_type " + " ".join(f"when {SPARK.text(k)} then {SPARK.text(e)}" for k, e in vocab.CONTENT_EXPLANATIONS.items()) + " end"}
    return _select(docs, (), [*content_type_layers(SPARK), why], ("content_type", "best_score", "content_explanation"))


def keyword_score(docs: DataFrame, terms: Sequence[str] = vocab.POLICY_WORDS, k: int = 10) -> DataFrame:
    """P-1: matches of terms for each word, and the first k matched terms, sorted."""
    renamed = {"term_score": "policy_score", "term_matched": "policy_matched"}
    return _select(docs, ("words", "policy"), [*keyword_layers("policy"), renamed], tuple(renamed), policy=terms, k=k)


def policy_type(docs: DataFrame) -> DataFrame:
    """P-2: the policy type with the most keyword hits for its number of keywords."""
    return _select(docs, ("types",), type_layers(SPARK), ("policy_type", "type_score"))


def detect_policy(docs: DataFrame) -> DataFrame:
    """P-3: POLICY, UNCLEAR or NOT_POLICY with confidence, type, explanation and matched terms; employment contracts and blank texts are none."""
    return _select(docs, POLICY_PARTS, [*policy_layers(SPARK), {"policy_type": "found_type"}], ("detection", "policy_confidence", "policy_type", "policy_explanation", "policy_matched", "contract_matched"))


def route_documents(docs: DataFrame) -> DataFrame:
    """P-4: suppressed, unreadable, policy, non_legal or audit, by gates in that order. Other columns pass through.

    Suppressed are degraded documents of poor text whose response came from a fallback, where a column fallback_used tells so.
    """
    fallback = "coalesce(fallback_used, false)" if "fallback_used" in docs.columns else "false"
    return with_layers(with_counts(docs, ROUTE_PARTS), route_layers(SPARK, fallback)).select(*docs.columns, "route")


def detect_jurisdiction(exchanges: DataFrame) -> DataFrame:
    """P-5: jurisdiction of a question and its answer (query, response; other columns pass through), the question first; whether the answer names an authority."""
    return with_layers(exchanges, jurisdiction_layers(SPARK)).select(*exchanges.columns, "jurisdiction", "is_grounded")


def validate_responses(exchanges: DataFrame, maker: tuple[str, str] | None = None) -> DataFrame:
    """P-6: the first violation of each response (query, response, mode; other columns pass through), null if there is none, with its refusal.

    Empty responses, answers about the maker (surname, first name) that leave out the first name, and first-person
    disclosures are violations; without ``maker`` the second never is.
    """
    layers = validity_layers(SPARK, maker=maker)
    return with_layers(exchanges, layers).select(*exchanges.columns, "violation_type", "is_valid", "refusal_message")
