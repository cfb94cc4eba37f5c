"""Queries of the library's own operators and the SQL that states the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import vocab
from clausework.functions.dialect import DUCK, layers_sql
from clausework.operators import classify, clauses, findings, quality, redact
from clausework.plans import fixtures
from clausework.streaming.streams import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def over_documents(name: str, operator: Callable[[DataFrame], DataFrame], layers: Sequence, columns: Sequence[str]) -> None:
    """Register an operator that projects documents, and its layers as SQL."""
    register(name, lambda spark, d: operator(table(spark, d, "documents")), f"select doc_id, {', '.join(columns)} from {layers_sql('documents', layers)}")


def _quality() -> None:
    signs, tokens, words = quality.sign_layers(), quality.token_layers(), quality.word_layers()
    chars, bad = quality.char_class_layers(), quality.malformed_layers()
    over_documents("q1_char_class_factors", quality.char_class_factors, [*signs, *chars], ("symbol_density", "non_alphanumeric_ratio", "uppercase_ratio", "vowel_ratio"))
    over_documents("q2_repeat_and_burst_factors", quality.repeat_and_burst_factors, [*tokens, *quality.burst_layers(DUCK)], ("n_runs", "n_bursts", "repeated_special_chars", "symbol_burst_density"))
    over_documents("q3_malformed_words", quality.malformed_words, [*tokens, *bad], ("malformed_count", "digit_letter_mix_count", "malformed_ratio", "malformed_words"))
    over_documents("q4_dictionary_word_ratio", quality.dictionary_word_ratio, [*words, *quality.dictionary_layers()], ("n_plain", "n_known", "dictionary_word_ratio"))
    over_documents("q5_keyword_trust", quality.keyword_trust, [*signs, *tokens, *words, *chars, *bad, *quality.trust_layers()], ("legal_ratio", "keyword_trust"))
    over_documents("q6_assess_quality", quality.assess_quality, [*quality.quality_counts_sql(), *quality.quality_layers(DUCK)], ("quality_score", "quality_label", "is_degraded", "warnings", *quality.WEIGHTS))
    over_documents("q7_poor_quote_quality", quality.poor_quote_quality, [*signs, *tokens, *chars, *quality.malformed_layers("quoted_count"), quality.POOR], ("malformed_ratio", "is_poor"))
    over_documents("q8_context_budget", quality.context_budget, quality.budget_layers(2000, 8192, 1024), ("kept_chars", "dropped_chars", "was_truncated", "estimated_tokens", "context_utilization_pct", "cast(null as int) as pages_seen"))


def _classify() -> None:
    words, low = quality.word_layers(), classify.low_sql()
    domain = [*quality.token_layers(), *words, *low, *classify.domain_counts_sql(), *classify.domain_layers(DUCK)[:3]]
    terms = [*words, *low, *classify.policy_counts_sql()]
    over_documents("d1_legal_keyword_ratio", classify.legal_keyword_ratio, domain, ("legal_keyword_ratio",))
    over_documents("d2_structure_score", classify.structure_score, domain, ("c_hits", "structure_score"))
    over_documents("d3_phrase_density", classify.phrase_density, domain, ("p_hits", "legal_phrase_density"))
    over_documents("d4_non_legal_penalty", classify.non_legal_penalty, domain, ("non_legal_penalty",))
    over_documents("d5_classify_domain", classify.classify_domain, [*domain, *classify.domain_layers(DUCK)[3:]], ("domain", "domain_confidence"))
    explained = "case content_type " + " ".join(f"when '{k}' then {DUCK.text(e)}" for k, e in vocab.CONTENT_EXPLANATIONS.items()) + " end as content_explanation"
    over_documents("d6_non_legal_content_type", classify.non_legal_content_type, classify.content_type_layers(DUCK), ("content_type", "best_score", explained))
    over_documents("p1_keyword_score", classify.keyword_score, [*terms, *classify.keyword_layers("policy"), {"term_score": "policy_score", "term_matched": "policy_matched"}], ("term_score", "term_matched"))
    over_documents("p2_policy_type", classify.policy_type, [*low, *classify.type_counts_sql(), *classify.type_layers(DUCK)], ("policy_type", "type_score"))
    over_documents("p3_detect_policy", classify.detect_policy, [*terms, *classify.type_counts_sql(), *classify.policy_layers(DUCK)], ("detection", "policy_confidence", "found_type as policy_type", "policy_explanation", "policy_matched", "contract_matched"))
    routed = layers_sql("documents", [*classify.route_counts_sql(), *classify.route_layers(DUCK)])
    fell = layers_sql("(select *, doc_id % 2 = 0 as fallback_used from documents)", [*classify.route_counts_sql(), *classify.route_layers(DUCK, "fallback_used")])
    register("p4_route_documents", lambda s, d: classify.route_documents(table(s, d, "documents").selectExpr("*", "doc_id % 2 = 0 as fallback_used")).select("doc_id", "route"), f"select doc_id, route from {fell}")
    register("route_by_lang", lambda s, d: classify.route_documents(table(s, d, "documents")).groupBy("lang", "route").agg(F.count("*").alias("n_docs")), f"select lang, route, count(*) as n_docs from {routed} group by lang, route")
    signs = ("", " Under Indian law see section 5.", " As an AI model I cannot say.", " I am a language model.", " The case was cited.")
    query = "concat(text, case when turn % 4 = 0 then ' Who made you, Smith?' else '' end)"
    answer = "case when turn % 7 = 0 then '' else lead(text) over (partition by conv_id order by turn) || case (conv_id + turn) % 5 " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(signs)) + " end end"
    pairs = f"select conv_id, turn, {query} as query, {answer} as response, case when conv_id % 3 = 0 then 'REDACTION' else 'ADVISORY' end as mode from conversations"
    exchanges = lambda s, d: table(s, d, "conversations").selectExpr("conv_id", "turn", f"{query} as query", f"{answer} as response", "case when conv_id % 3 = 0 then 'REDACTION' else 'ADVISORY' end as mode")
    india = "regexp_matches({}, '(?i)\\b(Indian law|India|Indian Contract|Specific Relief)\\b')"
    register("p5_detect_jurisdiction", lambda s, d: classify.detect_jurisdiction(exchanges(s, d)).select("conv_id", "turn", "jurisdiction", "is_grounded"), f"""
      select conv_id, turn, case when {india.format("query")} or coalesce({india.format("response")}, false) then 'India' else 'not specified' end as jurisdiction,
        coalesce({india.format("response")} or regexp_matches(response, '(?i)\\b(see|cited|statute|case|precedent|section)\\b'), false) as is_grounded from ({pairs})""")
    register("p6_validate_responses", lambda s, d: classify.validate_responses(exchanges(s, d), ("Smith", "Ann")).select("conv_id", "turn", "violation_type", "is_valid", "refusal_message"), f"""
      with v as (select *, case when coalesce(response, '') = '' then 'validation_error' when mode <> 'REDACTION' and query ilike '%who made you%' and query ilike '%smith%' and response not ilike '%ann%' then 'identity_guard'
        when regexp_matches(response, '(?i)\\bas an? ai\\b|\\bi am an? (ai|language model)\\b') then 'identity_disclosure' end as violation_type from ({pairs}))
      select conv_id, turn, violation_type, violation_type is null as is_valid, case violation_type when 'validation_error' then '[SYSTEM ERROR] Response validation failed due to invalid format.'
        when 'identity_guard' then '[SYSTEM REFUSAL] Response rejected due to identity guard violation.'
        when 'identity_disclosure' then '[SYSTEM REFUSAL] Response rejected due to compliance violation: First-person AI identity disclosure detected.' end as refusal_message from v""")


def _redact() -> None:
    docs, texts = fixtures.letters, fixtures.letters_sql()
    register("r10_mask_pii_fallback", lambda s, d: redact.mask_pii_fallback(docs(s, d)), f"select doc_id, masked from {layers_sql(texts, redact.mask_layers(DUCK))}")
    found = lambda s, d: redact.detect_entities(docs(s, d))
    flat = lambda df: df.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.entity_type", "e.start", "e.end", "e.original_text", "e.confidence")
    steps = {"r1_detect_candidates": 1, "r2_strip_leadin": 2, "r3_adjust_confidence": 3, "r4_classify_person": 4, "r5_reject_false_numbers": 5}
    chain = (redact.detect_candidates, redact.strip_leadin, redact.adjust_confidence, redact.classify_person, redact.reject_false_numbers)
    for name, n in steps.items():

        def query(s, d, n=n):
            out = docs(s, d)
            for step in chain[:n]:
                out = step(out)
            return out.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.entity_type", "c.start", "c.end", "c.original_text", "c.confidence", *(["c.reason"] if n > 3 else []))

        register(name, query)
    # DuckDB's word bounds know ASCII only and it has no look-around: other letters and digits become a word sign, bounds before signs are spelled out
    part, last = r"\d{1,3}[\s.-]?", r"\d{3,4}[\s.-]?\d{4}\b"
    two = r"(?:\(?\d{2,4}\)?[\s.-]?)?"
    units = "(?:USD|INR|EUR|GBP|dollars?|rupees?|euros?|pounds?)"
    stated = {t: ("(?i)" if flag else "") + pattern for t, (pattern, flag, _) in redact.ENTITY_PATTERNS.items()} | {
        "PHONE": rf"\B\+{part}{two}{last}|\B\(\d{{2,4}}\)?[\s.-]?{last}|\b{part}{two}{last}|\b(?:\d{{2,4}}\)?[\s.-]?)?{last}",
        "MONEY": rf"(?i)\B[$₹€£]\s?(?:\d[\d,]*\.\d{{1,2}}\b|\d[\d,]*,\B|\d(?:[\d,]*\d)?\b)|\b\d[\d,]*(?:\.\d{{1,2}})?\s?{units}\b",
        "ADDRESS": "(?i)(?:^|[^-0-9A-Za-z_])" + redact.ENTITY_PATTERNS["ADDRESS"][0].removeprefix(r"(?<![\d-])\b"),
        "EMAIL": redact.ENTITY_PATTERNS["EMAIL"][0].replace("._%+-", ".%+-"),
    }
    signs = "regexp_replace(regexp_replace({}, '[^\\P{{L}}A-Za-z]', '_', 'g'), '[^\\P{{N}}0-9]', '_', 'g')".format
    over = {t: signs("replace(text, '_', 'z')" if t == "EMAIL" else "text") for t in stated}
    counted = " union all ".join(f"select doc_id, '{t}' as entity_type, len(regexp_extract_all({over[t]}, {DUCK.regex(pattern)})) as n from {texts}" for t, pattern in stated.items())
    counts = lambda s, d: redact.detect_candidates(docs(s, d)).select("doc_id", F.explode("candidates").alias("c")).groupBy("doc_id", F.col("c.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))
    register("r1_candidate_counts", counts, f"select doc_id, entity_type, n from ({counted}) where n > 0")
    register("r6_resolve_overlaps", lambda s, d: flat(redact.resolve_overlaps(redact.reject_false_numbers(redact.classify_person(redact.adjust_confidence(redact.strip_leadin(redact.detect_candidates(docs(s, d)))))))))
    register("r7_reconcile_repeats", lambda s, d: flat(found(s, d)))
    register("r7_stepwise", lambda s, d: flat(redact.stepwise_entities(docs(s, d))))
    register("r8_apply_redactions", lambda s, d: redact.redact_documents(docs(s, d)).select("doc_id", "redacted_text"))

    def previews(s, d):
        # entities are found once and kept: the chosen ones and the previews both come from them
        path = f"{work_folder(s)}/entities"
        found(s, d).write.parquet(path)
        kept = s.read.parquet(path)
        odd = kept.select("doc_id", F.posexplode("entities").alias("position", "e")).where("position % 2 = 1").select("doc_id", "position")
        return redact.preview_redactions(kept, odd).select("doc_id", "preview", "n_total", "n_active")

    register("r9_preview_redactions", previews)
    register("r11_safe_entities", lambda s, d: redact.safe_entities(found(s, d)).select("doc_id", "text", F.expr("array_join(transform(entities, e -> e.original_text), ',')").alias("shown")))
    register("r12_entity_stats", lambda s, d: redact.entity_stats(found(s, d), ("PERSON", "EMAIL", "MONEY")))
    register("r12_entity_positions", lambda s, d: redact.entity_positions(found(s, d)).select("doc_id", "entity_type", F.array_join("positions", ",").alias("positions")))


def _clauses() -> None:
    texts = fixtures.contracts_sql()
    has, pack = DUCK.has, DUCK.strip
    surviving, ending = has("clause", clauses.SURVIVAL), has("clause", clauses.TERMINATION)
    # clauses as rows: by blank lines, and by running counts of headings over lines
    split_sql = f"""(with d as (select * from {texts}),
      p as (select doc_id, k, {pack("c")} as clause from (select doc_id, unnest(x) as c, generate_subscripts(x, 1) as k from (select doc_id, string_split_regex(text, '\\n\\s*\\n+') as x from d)) where {pack("c")} <> ''),
      ok as (select doc_id from p group by doc_id having count(*) >= 2 and min_by(clause, k) filter ({surviving}) <> min_by(clause, k) filter ({ending})),
      l as (select doc_id, k, {pack("c")} as line from (select doc_id, unnest(x) as c, generate_subscripts(x, 1) as k from (select doc_id, string_split(text, chr(10)) as x from d)) where {pack("c")} <> ''),
      s as (select *, sum(case when {has("line", clauses.HEADING)} then 1 else 0 end) over (partition by doc_id order by k) as part from l),
      h as (select doc_id, part as k, string_agg(line, ' ' order by k) as clause from s group by doc_id, part),
      h2 as (select doc_id from h group by doc_id having count(*) >= 2),
      w as (select doc_id, 1 as k, {pack("text")} as clause from d where {pack("text")} <> '' and doc_id not in (select doc_id from ok) and doc_id not in (select doc_id from h2))
      select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) as clause_no, clause from (
        select * from p where doc_id in (select doc_id from ok) union all select * from h where doc_id in (select doc_id from h2) and doc_id not in (select doc_id from ok) union all select * from w))"""
    contracts = fixtures.contracts
    split = lambda s, d: clauses.split_clauses(contracts(s, d))
    register("c1_split_clauses", split, f"select doc_id, clause_no, clause from {split_sql}")
    flagged = layers_sql(split_sql, clauses.flag_layers(DUCK))
    flags = "is_survival, is_termination, is_finite, is_perpetual, is_insufficient"
    register("c2_clause_flags", lambda s, d: clauses.clause_flags(split(s, d)), f"select doc_id, clause_no, {flags} from {flagged}")
    register("c3_obligation_domains", lambda s, d: clauses.obligation_domains(contracts(s, d), "text").select("doc_id", F.array_join("domains", "|").alias("domains")), f"select doc_id, array_to_string({clauses.topics(DUCK, 'text')}, '|') as domains from {texts}")
    met = f"(select *, unnest({clauses.topics(DUCK, 'clause')}) as domain from {flagged})"
    conflicts = f"""(select d.doc_id, case when n.n >= 2 then coalesce(c.conflicts, '') else '' end as conflicts, case when n.n >= 2 then coalesce(n.s1, '') else '' end as first_surviving, case when n.n >= 2 then coalesce(n.t1, '') else '' end as first_ending,
        cast(coalesce(n.ns, 0) as int) as n_surviving, cast(coalesce(n.nt, 0) as int) as n_ending from documents d
      left join (select doc_id, count(*) as n, count(*) filter (is_survival) as ns, count(*) filter (is_termination) as nt, min_by(clause, clause_no) filter (is_survival) as s1, min_by(clause, clause_no) filter (is_termination) as t1 from {flagged} group by doc_id) n using (doc_id)
      left join (select doc_id, string_agg(domain, '|' order by domain) as conflicts from (select doc_id, domain from {met} group by doc_id, domain having bool_or(is_survival) and bool_or(is_termination)) group by doc_id) c using (doc_id))"""
    register("c4_document_conflicts", lambda s, d: clauses.document_conflicts(contracts(s, d)), f"select * from {conflicts}")
    marked = f"(select doc_id, issue_no, {has('quoted_text', clauses.SURVIVAL)} as s, {has('quoted_text', clauses.TERMINATION)} as t, unnest({clauses.topics(DUCK, clauses.WHOLE)}) as domain from {fixtures.issues_sql()})"
    pairs = f"(select a.doc_id, a.issue_no as i, b.issue_no as j from {marked} a join {marked} b on a.doc_id = b.doc_id and a.domain = b.domain and a.s and b.t and a.issue_no <> b.issue_no)"
    flagged_issues = f"(select doc_id, i as issue_no from {pairs} union select doc_id, j from {pairs})"
    register("c5_issue_conflicts", lambda s, d: clauses.issue_conflicts(fixtures.issues(s, d)), f"select * from {flagged_issues}")
    typed = f"(select t.*, case when f.issue_no is null then contradiction_type end as kind from {layers_sql(fixtures.issues_sql(), clauses.contradiction_layers(DUCK))} t left join {flagged_issues} f on t.doc_id = f.doc_id and t.issue_no = f.issue_no)"
    register("c6_contradiction_types", lambda s, d: clauses.contradiction_types(fixtures.issues(s, d)).select("doc_id", "issue_no", "contradiction_type"), f"select doc_id, issue_no, kind as contradiction_type from {typed}")
    register("c7_suppress_contradictions", lambda s, d: clauses.suppress_contradictions(fixtures.issues(s, d)).select("doc_id", "issue_no"), f"select doc_id, issue_no from {typed} where kind is null")
    touched = f"(select i.doc_id, i.issue_no from (select doc_id, issue_no, unnest({clauses.topics(DUCK, clauses.WHOLE)}) as domain from {fixtures.issues_sql()}) i join (select doc_id, unnest(string_split(conflicts, '|')) as domain from {conflicts} where conflicts <> '') c using (doc_id, domain))"
    hit = f"(select doc_id, issue_no from {flagged_issues} union select doc_id, issue_no from {touched})"
    up = "h.issue_no is not null and category <> 'Structural Inconsistency' and lower(category) not in ('indemnification', 'liability exposure')"
    place, why, advice = (DUCK.text(x) for x in clauses.GENERATED)
    every = "doc_id issue_no issue_title severity category original_category contradiction_detected location quoted_text risk_explanation suggested_improvement".split()
    register("c8_elevate_contradictions", lambda s, d: clauses.elevate_contradictions(fixtures.issues(s, d), contracts(s, d)).select(*every), f"""
      select i.doc_id, i.issue_no, issue_title, severity, case when {up} then 'Structural Inconsistency' else category end as category, case when {up} then category end as original_category, ({up}) as contradiction_detected,
        location, quoted_text, risk_explanation, suggested_improvement
      from {fixtures.issues_sql()} i left join {hit} h on i.doc_id = h.doc_id and i.issue_no = h.issue_no
      union all select c.doc_id, cast(coalesce(m.n, 0) + 1 as int), 'Structural Inconsistency', 'MEDIUM', 'Structural Inconsistency', null, false,
        {place}, left(first_surviving, 300) || ' | ' || left(first_ending, 300), {why}, {advice}
      from {conflicts} c left join (select doc_id, max(issue_no) as n from {fixtures.issues_sql()} group by doc_id) m using (doc_id) where conflicts <> '' and first_surviving <> first_ending and c.doc_id not in (select doc_id from {hit})""")


def _verified_sql(texts: str) -> str:
    """The three document rules over numbered lines."""
    has = DUCK.has
    line = f"(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from {texts})"
    first = lambda c, n: f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {DUCK.strip('x')}), lambda x: x <> '')[1:{n}], ' ')"

    def around(pattern: str) -> str:
        return f"""(select l.doc_id, string_agg(l.line, chr(10) order by l.k) as part from {line} l join (select doc_id, min(k) as a, max(k) as b from {line} where {has("line", pattern)} group by doc_id) m
          on l.doc_id = m.doc_id and l.k between m.a - 1 and m.b + 2 group by l.doc_id)"""

    w, c = around("(?i)as is|as available|no warranties|warranties|warranty|disclaimer"), around("(?i)change of control")
    two = f"""(select l.doc_id, m.u = m.b as same, string_agg(l.line, chr(10) order by l.k) filter (case when m.u = m.b then l.k between m.u - 1 and m.u else l.k >= least(m.u, m.b) - 1 end) as part
      from {line} l join (select doc_id, max(k) filter ({has("line", clauses.AT_WILL)}) as u, max(k) filter ({has("line", clauses.ONLY_BREACH)}) as b from {line} group by doc_id) m on l.doc_id = m.doc_id and m.u is not null and m.b is not null group by l.doc_id, m.u, m.b)"""
    return f"""(select doc_id, 'AS-IS No Warranty Provision' as issue_title, 'Enforceability Weakness' as category, 'MEDIUM' as severity, 'Warranty / Disclaimer Clause' as location, {first("part", 4)} as quoted_text from {w}
        where {has("part", "(?i)as is|as available|no warrant")} and {has("part", clauses.AS_IS)} and {has("part", clauses.NO_WARRANTY)}
      union all select doc_id, 'Single-Trigger Change of Control Acceleration', 'Enforceability Weakness', 'MEDIUM', 'Change of Control Clause', {first("part", 4)} from {c} where {has("part", clauses.SINGLE_TRIGGER)} and not {has("part", clauses.DOUBLE_TRIGGER)}
      union all select doc_id, 'Asymmetric Termination Rights', 'Negotiation Imbalance', 'MEDIUM', 'Termination Clause', 'Asymmetric termination rights clause: ' || case when same then {first("part", 1)} else {first("part", 2)} end from {two})"""


def _findings() -> None:
    issues, sql = fixtures.issues, fixtures.issues_sql()
    docs, texts = fixtures.contracts, fixtures.contracts_sql()
    flags = f"(select doc_id, {', '.join(findings.FLAGS)} from {layers_sql(texts, findings.document_flag_layers(DUCK))})"
    joined = f"(select i.*, f.* exclude (doc_id) from {sql} i join {flags} f using (doc_id))"

    def on_issues(name, operator, layers, columns):
        register(name, lambda s, d: operator(issues(s, d)), f"select doc_id, issue_no, {', '.join(columns)} from {layers_sql(sql, layers)}")

    on_issues("n1_balanced_indemnity_flags", findings.balanced_indemnity_flags, findings.indemnity_layers(DUCK), ("i_mutual", "i_cap", "i_exclusion", "i_risk", "i_balanced"))
    on_issues("n2_override_severity", findings.override_severity, findings.severity_layers(DUCK), ("new_severity",))
    on_issues("n3_remap_category", findings.remap_category, findings.field_layers(DUCK), ("new_category",))
    on_issues("n4_sanitize_language", findings.sanitize_language, findings.field_layers(DUCK), ("new_explanation", "new_advice"))
    on_issues("n5_refine_improvement", findings.refine_improvement, findings.advice_layers(DUCK), ("new_improvement",))
    key = "lower(regexp_replace(trim(trim(regexp_replace(quoted_text, '^\\s+|\\s+$', '', 'g'), chr(34)), chr(39)), '\\s+', ' ', 'g'))"
    register("n6_dedupe_quotes", lambda s, d: findings.dedupe_quotes(issues(s, d)), f"select doc_id, issue_no from (select *, {key} as k, row_number() over (partition by doc_id, {key} order by issue_no) as r from {sql}) where k = '' or r = 1")
    dropped = layers_sql(joined, findings.suppression_layers(DUCK))
    month = "coalesce(try_cast(regexp_extract(quoted_text, '(?i)([0-9]+)\\s*\\)?\\s*month', 1) as int) <= 6, false)"
    anyone = lambda words: "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
    disclaims = anyone(("no service level", "no sla", "does not guarantee", "no guarantee", "not warrant", "as is", "as-available"))
    hosted = anyone(("saas", "software-as-a-service", "software as a service", "subscription", "cloud", "platform", "service provider", "service level", "uptime", "availability", "service credit", "downtime", "sla"))
    promised = anyone(("service level", "uptime", "availability", "99.5%", "98%", "99%", "sla", "guarantee", "maintain"))
    kept = {
        "7": ("suppress_balanced", f"select doc_id, issue_no from {dropped} where not coalesce(n7, false)"),
        "8": ("suppress_false_sla", f"select i.doc_id, issue_no from {sql} i join {texts} t using (doc_id) where not ((issue_title ilike '%no sla%' or issue_title ilike '%no service level agreement%') and text <> '' and not {disclaims} and (not {hosted} or {promised}))"),
        "10": ("suppress_noncompete", f"select doc_id, issue_no from {sql} where not (issue_title = 'Excessive Non-Compete Duration' and {month})"),
        "11": ("suppress_invention", f"select doc_id, issue_no from {sql} where not (issue_title = 'Overbroad Invention Assignment' and regexp_matches(quoted_text, '(?is)develops entirely on .*? own time'))"),
        "12": ("suppress_mismatched_title", f"select doc_id, issue_no from {dropped} where not coalesce(n12, false)"),
    }
    for k, (name, by_hand) in kept.items():
        register(f"n{k}_{name}", lambda s, d, f=getattr(findings, name): f(issues(s, d), docs(s, d)), by_hand)
    register("n9_suppress_ice", lambda s, d: findings.suppress_ice(issues(s, d), docs(s, d)), f"select doc_id, issue_no from {dropped} where not n9 and not n9b")
    months = "try_cast(nullif(regexp_extract(lower(quoted_text), '([0-9]+)\\s*\\)?\\s*month', 1), '') as int) > 6"
    register("n13_rewrite_titles", lambda s, d: findings.rewrite_titles(issues(s, d)), f"""
      select doc_id, issue_no, case when issue_title like 'Single-Trigger Change of Control Acc%' and quoted_text ilike '%solicit%' and quoted_text not ilike '%change of control%' then 'Non-Solicitation Clause in NDA'
        when issue_title like 'Single-Trigger Change of Control Acc%' and quoted_text ilike '%compete%' and quoted_text not ilike '%change of control%' and {months} then 'Excessive Non-Compete Duration'
        when issue_title = 'Non-Competition' and {months} then 'Excessive Non-Compete Duration'
        when issue_title = 'Intellectual Property Ownership' and category ilike '%intellectual property%' and quoted_text ilike '%consultant%' and quoted_text ilike '%retain%' then 'Consultant Retains All Deliverable IP' else issue_title end as new_title from {sql}""")
    levels = layers_sql(joined, findings.level_layers(DUCK))
    for name, column in (("n14_document_bmi", "s14"), ("n15_cap_standard_nda", "s15"), ("n16_cap_mutual_indemnity", "s16")):
        register(name, lambda s, d, c=column: findings.document_levels(issues(s, d), docs(s, d)).select("doc_id", "issue_no", c), f"select doc_id, issue_no, {column} from {levels}")
    for name, strict in (("n17_detect_asymmetry", True), ("n17_asymmetry_of_stems", False)):
        register(name, lambda s, d, strict=strict: findings.document_levels(issues(s, d), docs(s, d), strict).select("doc_id", "issue_no", "s17", "c17"), f"select doc_id, issue_no, s17, c17 from {layers_sql(joined, findings.level_layers(DUCK, strict))}")
    log = ("doc_id", "issue_no", "suppressed_by", "suppression_reason", "matched_categories")
    register("n18_suppression_log", lambda s, d: findings.suppressed(issues(s, d), docs(s, d)).where("suppressed_by is not null"), f"select {', '.join(log)} from {dropped} where suppressed_by is not null")
    stages = ", ".join(f"({k + 1}, '{x}')" for k, x in enumerate(findings.STAGES))
    register("n18_stage_trace", lambda s, d: findings.stage_trace(issues(s, d), docs(s, d)), f"""
      with x as (select * from {dropped}), st(stage_no, stage) as (values {stages}), c as (select st.stage_no, st.stage, (select count(*) from x where suppressed_by = st.stage) as n_dropped from st)
      select stage_no, stage, n_dropped, cast((select count(*) from x) - sum(n_dropped) over (order by stage_no) as bigint) as n_issues from c""")
    told = ", ".join(f"({DUCK.text(clauses.RULES[k][0])}, {DUCK.text(why)}, {DUCK.text(advice)}, '{clauses.VERIFIER_NAMES[k]}')" for k, (why, advice) in clauses.VERIFIED_TEXTS.items())
    found = f"(select f.*, v.why as risk_explanation, v.advice as suggested_improvement, 'verifier' as detection_method, v.name as verifier from {_verified_sql(texts)} f join (values {told}) v(title, why, advice, name) on f.issue_title = v.title)"
    register("n19_verify_clauses", lambda s, d: clauses.verify_clauses(docs(s, d)), f"select * from {found}")
    register("n20_merge_verifier_findings", lambda s, d: findings.merge_verifier_findings(issues(s, d), clauses.verify_clauses(docs(s, d))), f"""
      select i.*, null as detection_method, null as verifier from {sql} i union all by name
      select f.*, cast(coalesce(m.n, 0) + row_number() over (partition by f.doc_id order by f.verifier) as int) as issue_no from {found} f left join (select doc_id, max(issue_no) as n from {sql} group by doc_id) m using (doc_id)
      where not exists (select 1 from {sql} i where i.doc_id = f.doc_id and lower(i.issue_title) = lower(f.issue_title) and lower(i.category) = lower(f.category))""")


_quality()
_classify()
_redact()
_clauses()
_findings()
