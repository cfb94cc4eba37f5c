"""Text quality (Q-1 to Q-8): factor scores, hard limits, warnings and the context budget.

Every operator is a projection of one row; blank and null texts get the values the docstrings state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import vocab
from clausework.functions.counts import with_counts
from clausework.functions.dialect import DUCK, SPARK, Layer, SparkSql, clamp, flag_sum, piecewise, with_layers, words_in

WORD = r"[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"
SPECIAL = r"[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
#: The factors' weights.
WEIGHTS = {
    "symbol_density": 0.15, "non_alphanumeric_ratio": 0.10, "repeated_special_chars": 0.12, "malformed_words": 0.20, "dictionary_word_ratio": 0.13,
    "uppercase_ratio": 0.10, "vowel_ratio": 0.08, "symbol_burst_density": 0.07, "keyword_trust": 0.05,
}
WARNINGS = {
    "symbol_density": "High symbol density detected - possible OCR noise",
    "non_alphanumeric_ratio": "High non-alphanumeric character ratio",
    "repeated_special_chars": "Repeated special character sequences detected",
    "malformed_words": "Significant number of malformed words detected",
    "dictionary_word_ratio": "Low dictionary-word ratio - text may be corrupted",
    "uppercase_ratio": "High uppercase ratio - possible OCR corruption",
    "vowel_ratio": "Low vowel ratio - text may be corrupted or non-linguistic",
    "symbol_burst_density": "Symbol burst clusters detected - possible OCR noise",
    "keyword_trust": "Legal keywords present but text quality too low for trust",
}


def _ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif({b}, 0))"


def sign_layers(t: str = "text") -> list[Layer]:
    """DuckDB's counts of signs; Spark takes them from the kernel."""
    count = lambda p: f"(length({t}) - length({DUCK.replace(t, p)}))"
    return [{"n_all": f"length({t})", "n_alnum": count(r"[\p{L}\p{N}]+"), "n_space": count(r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"), "n_letter": count(r"\p{L}+"), "n_upper": count(r"\p{Lu}+"), "n_vowel": count("[aeiouAEIOU]+")}]


def char_class_layers() -> list[Layer]:
    return [
        {"r_symbol": _ratio("n_all - n_alnum - n_space", "n_all"), "r_other": f"1.0 - {_ratio('n_alnum', 'n_all')}", "r_upper": _ratio("n_upper", "n_letter"), "r_vowel": _ratio("n_vowel", "n_letter")},
        {
            "symbol_density": f"coalesce({piecewise('r_symbol', [(0.08, '1.0'), (0.15, clamp('1.0 - (r_symbol - 0.08) * 5.0')), (0.25, clamp('0.65 - (r_symbol - 0.15) * 3.0')), (0.40, clamp('0.35 - (r_symbol - 0.25) * 2.0'))], clamp('0.05 - (r_symbol - 0.40) * 0.5'))}, 1.0)",
            "non_alphanumeric_ratio": f"coalesce({piecewise('r_other', [(0.25, '1.0'), (0.40, clamp('1.0 - (r_other - 0.25) * 3.0')), (0.60, clamp('0.55 - (r_other - 0.40) * 2.0'))], clamp('0.15 - (r_other - 0.60) * 0.5'))}, 1.0)",
            "uppercase_ratio": f"case when r_upper is null then 1.0 else {piecewise('r_upper', [(0.50, '1.0'), (0.70, clamp('1.0 - (r_upper - 0.50) * 2.5')), (0.85, clamp('0.5 - (r_upper - 0.70) * 2.5')), (0.95, clamp('0.12 - (r_upper - 0.85)'))], '0.02')} end",
            "vowel_ratio": f"case when r_vowel is null or r_vowel >= 0.30 then 1.0 when r_vowel >= 0.20 then {clamp('0.5 + (r_vowel - 0.20) * 5.0')} when r_vowel >= 0.10 then {clamp('0.1 + (r_vowel - 0.10) * 4.0')} else {clamp('r_vowel')} end",
        },
    ]


def burst_layers(q: SparkSql, text: str = "text") -> list[Layer]:
    """Runs of one special sign and bursts of symbols, for n_tokens words. Spark counts runs by a backreference, where the kernel's part "tokens" found that there may be any; DuckDB, which has none, counts their ends within special parts."""
    t = f"coalesce({text}, '')"
    bursts = q.count(t, r"[!@#$%^&*+=~|\\<>?]{3,}")
    if q is SPARK:
        runs = f"if(may_run, {q.count(t, f'({SPECIAL})' + r'\1{2,}')}, 0)"
        bursts = f"if(may_burst, {bursts}, 0)"
    else:
        ends = "len(list_filter(range(3, length(p) + 1), lambda i: p[i] = p[i - 1] and p[i] = p[i - 2] and (i = 3 or p[i - 3] <> p[i])))"
        runs = f"coalesce(list_sum(list_transform({q.all(t, SPECIAL + '{3,}')}, lambda p: {ends})), 0)"
    return [
        {"n_words": "greatest(1, n_tokens)", "n_runs": f"cast({runs} as bigint)", "n_bursts": bursts},
        {"f_runs": "cast(n_runs as double) / (n_words / 10.0)", "f_bursts": "cast(n_bursts as double) / (n_words / 5.0)"},
        {
            "repeated_special_chars": piecewise("f_runs", [(0.05, "1.0"), (0.15, clamp("1.0 - (f_runs - 0.05) * 4.0")), (0.35, clamp("0.6 - (f_runs - 0.15) * 2.0")), (0.6, clamp("0.2 - (f_runs - 0.35) * 0.6"))], "0.05"),
            "symbol_burst_density": piecewise("f_bursts", [(0.05, "1.0"), (0.2, clamp("1.0 - (f_bursts - 0.05) * 4.0")), (0.5, clamp("0.4 - (f_bursts - 0.2)"))], "0.05"),
        },
    ]


def token_layers(t: str = "text") -> list[Layer]:
    """DuckDB's counts of tokens; Spark takes them from the kernel."""
    q = DUCK
    clean = q.replace("w", r"[^\p{L}\p{N}_]")
    digits = f"(length({clean}) - length({q.replace(clean, '[0-9]')}))"
    mixed = f"({q.has(clean, '^[a-zA-Z0-9]{3,}$')} and {q.has(clean, '[0-9]')} and {q.has(clean, '[a-zA-Z]')})"
    partly = f"({mixed} and {digits} >= 0.1 * length({clean}) and {digits} <= 0.6 * length({clean}))"
    # letters doubled, so that two digits beside one letter both count
    swaps = f"({q.count(q.replace('w', '([a-zA-Z])', '<1><1>'), '[a-zA-Z][01]|[01][a-zA-Z]')} + {q.count('w', '[@%!$]')})"
    classes = q.replace(q.replace(q.replace("w", r"\p{L}+", "a"), r"\p{Nd}+", "d"), r"[^ad]+", "s")
    doubled, burst = q.has("w", SPECIAL + "{2,}"), q.has("w", "[!@#$%^&*]{2,}")
    quoted = f"({partly} or {doubled} or (length(w) >= 4 and length({classes}) >= 4) or {swaps} >= 2 or {burst})"
    more = f"({q.has(clean, '(?i)[bcdfghjklmnpqrstvwxyz]{5,}')} or {q.has('w', '[a-zA-Z]' + SPECIAL + '[a-zA-Z]')})"
    short = f"(length({clean}) < 3 and length(w) >= 3 and ({doubled} or {burst}))"
    keep = lambda c: q.size(q.keep("tokens", "w", c))
    long = f"length({clean}) >= 3"
    return [
        {"tokens": q.all(f"coalesce({t}, '')", WORD)},
        {"n_tokens": q.size("tokens"), "malformed_count": keep(f"{short} or ({long} and ({quoted} or {more}))"), "quoted_count": keep(f"{short} or ({long} and {quoted})"), "digit_letter_mix_count": f"({keep(f'{long} and {partly}')} + {keep(f'{long} and {mixed} and {swaps} >= 2')})"},
    ]


def malformed_layers(count: str = "malformed_count") -> list[Layer]:
    return [
        {"malformed_ratio": f"coalesce({_ratio(count, 'n_tokens')}, 0.0)"},
        {"malformed_words": piecewise("malformed_ratio", [(0.02, "1.0"), (0.06, clamp("1.0 - (malformed_ratio - 0.02) * 10.0")), (0.15, clamp("0.6 - (malformed_ratio - 0.06) * 4.0")), (0.30, clamp("0.24 - (malformed_ratio - 0.15) * 1.5"))], "0.01")},
    ]


def word_layers(t: str = "text", dictionary: Sequence[str] = vocab.DICTIONARY, trust: Sequence[str] = vocab.TRUST_WORDS, legal: Sequence[str] = vocab.LEGAL_WORDS) -> list[Layer]:
    """DuckDB's counts of words; Spark takes them from the kernel."""
    keep = lambda words: DUCK.size(DUCK.keep("plain", "w", f"w in {words_in(words)}"))
    return [{"plain": DUCK.all(f"lower(coalesce({t}, ''))", "[a-z]{3,}")}, {"n_plain": DUCK.size("plain"), "n_known": keep(dictionary), "n_trust": keep(trust), "n_legal": keep(legal)}]


def dictionary_layers(t: str = "text") -> list[Layer]:
    return [
        {"known_ratio": _ratio("n_known", "n_plain")},
        {"dictionary_word_ratio": f"case when length({t}) = 0 then 1.0 when known_ratio is null then 0.3 when known_ratio >= 0.40 then 1.0 when known_ratio >= 0.25 then {clamp('0.6 + (known_ratio - 0.25) * 2.67')} when known_ratio >= 0.10 then {clamp('0.2 + (known_ratio - 0.10) * 2.67')} else {clamp('known_ratio * 2.0')} end"},
    ]


def trust_layers() -> list[Layer]:
    return [
        {"legal_ratio": _ratio("n_trust", "n_plain")},
        {"keyword_trust": f"case when legal_ratio is null then 0.5 when legal_ratio < 0.05 then 1.0 when malformed_ratio > 0.15 or symbol_density < 0.3 then {clamp('0.35 - legal_ratio * 0.5')} when malformed_ratio > 0.05 or symbol_density < 0.5 then {clamp('0.6 - legal_ratio * 0.3')} else 1.0 end"},
    ]


def label(score: str) -> str:
    return f"case when {score} >= 0.75 then 'HIGH' when {score} >= 0.45 then 'MEDIUM' else 'LOW' end"


#: What the kernel counts for the whole assessment, and how DuckDB counts the same.
QUALITY_PARTS = ("signs", "tokens", "words")


def quality_counts_sql() -> list[Layer]:
    return [*sign_layers(), *token_layers(), *word_layers()]


def quality_layers(q: SparkSql, t: str = "text") -> list[Layer]:
    """Over the counts of QUALITY_PARTS."""
    hard = ["malformed_ratio > 0.15", "symbol_density < 0.30", "symbol_burst_density < 0.3", "digit_letter_mix_count >= 2", "repeated_special_chars < 0.35"]
    warnings = q.array([f"case when {k} < 0.5 then {q.text(w)} else '' end" for k, w in WARNINGS.items()])
    return [
        *char_class_layers(), *burst_layers(q, t), *malformed_layers(), *dictionary_layers(t), *trust_layers(),
        {"is_blank": f"({t} is null or not {q.has(t, WORD)})", "hard_limits": flag_sum(hard), "weighted": clamp(" + ".join(f"{k} * {w}" for k, w in WEIGHTS.items()))},
        {"quality_score": "case when is_blank then 0.0 when hard_limits > 0 then least(weighted, 0.20) else weighted end"},
        {"quality_label": label("quality_score"), "is_degraded": "quality_score < 0.35", "warnings": f"case when is_blank then 'Input text is empty or whitespace-only' else {q.join(q.keep(warnings, 'w', chr(119) + ' <> ' + chr(39) * 2), '; ')} end"},
    ]


def _select(docs: DataFrame, parts: Sequence[str], layers: Sequence[Layer], columns: Sequence[str], **lists) -> DataFrame:
    counted = with_counts(docs.select("doc_id", "text"), parts, **lists) if parts else docs.select("doc_id", "text")
    return with_layers(counted, layers).select("doc_id", *columns)


def char_class_factors(docs: DataFrame) -> DataFrame:
    """Q-1: symbol density, other characters, capitals and vowels as scores; an empty text scores 1, a null text 1."""
    return _select(docs, ("signs",), char_class_layers(), ("symbol_density", "non_alphanumeric_ratio", "uppercase_ratio", "vowel_ratio"))


def repeat_and_burst_factors(docs: DataFrame) -> DataFrame:
    """Q-2: runs of one special sign per ten words, bursts of symbols per five."""
    return _select(docs, ("tokens",), burst_layers(SPARK), ("n_runs", "n_bursts", "repeated_special_chars", "symbol_burst_density"))


def malformed_words(docs: DataFrame) -> DataFrame:
    """Q-3: tokens that look damaged by recognition, with the count of digits mixed into words."""
    return _select(docs, ("tokens",), malformed_layers(), ("malformed_count", "digit_letter_mix_count", "malformed_ratio", "malformed_words"))


def dictionary_word_ratio(docs: DataFrame, dictionary: Sequence[str] = vocab.DICTIONARY) -> DataFrame:
    """Q-4: share of words of three letters and more that ``dictionary`` holds, as a score; 0.3 without words."""
    return _select(docs, ("words",), dictionary_layers(), ("n_plain", "n_known", "dictionary_word_ratio"), dictionary=dictionary)


def keyword_trust(docs: DataFrame) -> DataFrame:
    """Q-5: how far legal keywords can be trusted, given damage and symbols."""
    return _select(docs, QUALITY_PARTS, [*char_class_layers(), *malformed_layers(), *trust_layers()], ("legal_ratio", "keyword_trust"))


def assess_quality(docs: DataFrame, dictionary: Sequence[str] = vocab.DICTIONARY) -> DataFrame:
    """Q-6: weighted score with hard limits, label, degraded flag, warnings; blank texts score 0."""
    return _select(docs, QUALITY_PARTS, quality_layers(SPARK), ("quality_score", "quality_label", "is_degraded", "warnings", *WEIGHTS), dictionary=dictionary)


POOR = {"is_poor": "n_tokens = 0 or malformed_ratio > 0.20 or coalesce(r_symbol, 0.0) > 0.25"}


def poor_quote_quality(docs: DataFrame) -> DataFrame:
    """Q-7: the gate for quoted text: blank, over a fifth of tokens damaged (consonants and inner signs aside), or a quarter symbols."""
    return _select(docs, ("signs", "tokens"), [*char_class_layers(), *malformed_layers("quoted_count"), POOR], ("malformed_ratio", "is_poor"))


def budget_layers(prompt_chars: int, context: int, reply: int) -> list[Layer]:
    return [
        {"n": "length(coalesce(text, ''))", "room": str(max(0, (context - reply) * 4 - prompt_chars))},
        {"kept_chars": "least(n, room)"},
        {"dropped_chars": "n - kept_chars", "was_truncated": "n > room", "estimated_tokens": f"cast(floor((kept_chars + {prompt_chars}) / 4) as bigint)"},
        {"context_utilization_pct": f"cast(100.0 * estimated_tokens as double) / {context}"},
    ]


def context_budget(docs: DataFrame, prompt_chars: int = 2000, context: int = 8192, reply: int = 1024) -> DataFrame:
    """Q-8: how much of a text fits a model's context at four characters a token; keeps the head. pages_seen passes through, null where there is no such column."""
    seen = {"pages_seen": "pages_seen" if "pages_seen" in docs.columns else "cast(null as int)"}
    budget = with_layers(docs, [*budget_layers(prompt_chars, context, reply), seen])
    return budget.select("doc_id", *("kept_chars", "dropped_chars", "was_truncated", "estimated_tokens", "context_utilization_pct", "pages_seen"))


def pages_in_budget(pages: DataFrame, prompt_chars: int = 2000, context: int = 8192, reply: int = 1024, separator: str = "") -> DataFrame:
    """Q-8: the budget of documents given as pages (doc_id, page_no, text), and how many of their pages the kept head reaches.

    Returns doc_id, n_pages, pages_seen, kept_chars, dropped_chars, was_truncated. Pages lie in their order with ``separator``
    between them, as ``assemble_pages`` joins them; a page is seen if the cut lies behind its first character, empty pages
    before the cut are. Page lengths are summed in a window of the document; no text is put together.
    """
    room, gap = max(0, (context - reply) * 4 - prompt_chars), len(separator)
    sized = pages.select("doc_id", "page_no", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    placed = sized.withColumn("begin", F.expr(f"coalesce(sum(size + {gap}) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding), 0)"))
    whole = placed.groupBy("doc_id").agg(F.count("*").alias("n_pages"), (F.sum(F.col("size") + gap) - gap).alias("n"), F.count_if((F.col("begin") < room) | (F.col("begin") + F.col("size") <= room)).alias("pages_seen"))
    kept = F.least("n", F.lit(room)).cast("long")
    return whole.select("doc_id", "n_pages", "pages_seen", kept.alias("kept_chars"), (F.col("n") - kept).cast("long").alias("dropped_chars"), (F.col("n") > room).alias("was_truncated"))
