"""The whole review chain as queries, and in DuckDB as a table after each stage."""

from __future__ import annotations

from clausework.functions.dialect import DUCK, layers_sql
from clausework.operators import chain, clauses, findings
from clausework.plans import fixtures
from clausework.plans.queries import ORACLES, register

FIELDS = findings.COLUMNS[2:]
_KEPT = ("doc_id", "issue_no", *FIELDS, "original_category", "detected", "method", "verifier", "added_by", *findings.FLAGS, "dropped_by", "changed")


def _changed(before: str, stage: str, layers: list, updates: dict[str, str]) -> str:
    differ = " or ".join(f"{f} is distinct from {new}" for f, new in updates.items())
    now = {f: f"case when dropped_by is null then {new} else {f} end as {f}" for f, new in updates.items()}
    now["changed"] = f"case when dropped_by is null and ({differ}) then list_append(changed, '{stage}') else changed end as changed"
    return f"select {', '.join(now.get(c, c) for c in _KEPT)} from {layers_sql(before, layers)}"


def _dropped(before: str, layers: list, rules: dict[str, str]) -> str:
    cases = " ".join(f"when coalesce({condition}, false) then '{stage}'" for stage, condition in rules.items())
    return f"select {', '.join(c if c != 'dropped_by' else f'coalesce(dropped_by, case {cases} end) as dropped_by' for c in _KEPT)} from {layers_sql(before, layers)}"


def chain_sql() -> str:
    """CTEs s0 to s18, one for each stage; s18 holds all findings, dropped ones too."""
    texts, has = fixtures.contracts_sql(), DUCK.has
    rule = lambda *names: {s: chain._RULE_OF[s] for s in names}
    drops, levels = findings.suppression_layers(DUCK), findings.level_layers(DUCK)
    key = "lower(regexp_replace(trim(trim(regexp_replace(quoted_text, '^\\s+|\\s+$', '', 'g'), chr(34)), chr(39)), '\\s+', ' ', 'g'))"
    none = ", ".join(f"cast(null as {t}) as {c}" for c, t in (("original_category", "varchar"), ("detected", "boolean"), ("method", "varchar"), ("verifier", "varchar"), ("added_by", "varchar"), ("dropped_by", "varchar")))
    flags = f"(select doc_id, {', '.join(findings.FLAGS)} from {layers_sql(texts, findings.document_flag_layers(DUCK))})"
    steps = [
        f"select i.*, f.* exclude (doc_id), {none}, cast([] as varchar[]) as changed from {fixtures.fitting_issues_sql()} i join {flags} f using (doc_id)",
        _changed("s0", "severity_normalized", findings.severity_layers(DUCK), {"severity": "new_severity"}),
        _changed("s1", "fields_normalized", findings.field_layers(DUCK), {"category": "new_category", "risk_explanation": "new_explanation", "suggested_improvement": "new_advice"}),
        _changed("s2", "advice_refined", findings.advice_layers(DUCK), {"suggested_improvement": "new_improvement"}),
        _dropped(f"(select *, {key} as k, row_number() over (partition by doc_id, {key} order by issue_no) as r from s3)", [], {"quotes_deduplicated": "k <> '' and r > 1"}),
        _dropped("s4", drops, rule("balanced_indemnity", "false_sla", "mismatched_title")),
        _changed("s5", "titles_rewritten", findings.title_layers(DUCK), {"issue_title": "new_title"}),
        _dropped("s6", drops, rule("complete_exclusions", "short_noncompete", "own_time_inventions", "wrong_section")),
        _changed("s7", "document_bmi", levels, {"severity": "s14"}),
        _changed("s8", "standard_nda", levels, {"severity": "s15"}),
        _changed("s9", "mutual_capped_indemnity", levels, {"severity": "s16"}),
        _changed("s10", "asymmetry", levels, {"severity": "s17", "category": "c17"}),
    ]
    surviving, ending, topics = has("quoted_text", clauses.SURVIVAL), has("quoted_text", clauses.TERMINATION), clauses.topics(DUCK, clauses.WHOLE)
    marked = f"(select doc_id, issue_no, {surviving} as s, {ending} as t, unnest({topics}) as domain from s11 where dropped_by is null)"
    pairs = f"select a.doc_id, a.issue_no as i, b.issue_no as j from {marked} a join {marked} b on a.doc_id = b.doc_id and a.domain = b.domain and a.s and b.t and a.issue_no <> b.issue_no"
    held = "(select *, exists (select 1 from held h where h.doc_id = s11.doc_id and h.issue_no = s11.issue_no) as is_held from s11)"
    shared = f"list_has_any({topics}, string_split(c.conflicts, '|'))"
    hit = f"(select s12.*, dropped_by is null and (exists (select 1 from held h where h.doc_id = s12.doc_id and h.issue_no = s12.issue_no) or exists (select 1 from conflicts c where c.doc_id = s12.doc_id and c.conflicts <> '' and {shared})) as hit from s12)"
    up = "hit and coalesce(category, '') <> 'Structural Inconsistency' and lower(coalesce(category, '')) not in ('indemnification', 'liability exposure')"
    raised = [{"e_category": f"case when {up} then 'Structural Inconsistency' else category end", "e_original": f"case when {up} then category end", "e_detected": f"case when {up} then true else detected end"}]
    steps.append(_dropped(held, clauses.contradiction_layers(DUCK), {"contradictions_suppressed": "contradiction_type is not null and not is_held"}))
    steps.append(_changed(hit, "contradictions_elevated", raised, {"category": "e_category", "original_category": "e_original", "detected": "e_detected"}))
    place, why, advice = (DUCK.text(x) for x in clauses.GENERATED)
    last = "(select doc_id, max(issue_no) as n from {} group by doc_id)".format
    steps.append(f"""select * from s13 union all by name
      select c.doc_id, cast(coalesce(m.n, 0) + 1 as int) as issue_no, 'Structural Inconsistency' as issue_title, 'MEDIUM' as severity, 'Structural Inconsistency' as category, {place} as location,
        left(first_surviving, 300) || ' | ' || left(first_ending, 300) as quoted_text, {why} as risk_explanation, {advice} as suggested_improvement, false as detected, 'contradictions_elevated' as added_by
      from conflicts c left join {last("s13")} m using (doc_id) where conflicts <> '' and first_surviving <> first_ending and not exists (select 1 from {hit} h where h.hit and h.doc_id = c.doc_id)""")
    order = "case v.verifier when 'as_is_no_warranty' then 1 when 'asymmetric_termination' then 2 else 3 end"
    steps.append(f"""select * from s14 union all by name
      select v.doc_id, cast(coalesce(m.n, 0) + {order} as int) as issue_no, v.issue_title, v.severity, v.category, v.location, v.quoted_text, v.risk_explanation, v.suggested_improvement, v.detection_method as method, v.verifier, 'verifiers' as added_by
      from verified v left join {last("s14")} m using (doc_id)
      where not exists (select 1 from s14 x where x.dropped_by is null and x.doc_id = v.doc_id and lower(trim(x.issue_title)) = lower(v.issue_title) and lower(trim(x.category)) = lower(v.category))""")
    extra = f"conflicts as materialized ({ORACLES['c4_document_conflicts']}), verified as materialized ({ORACLES['n19_verify_clauses']})"
    tables = [f"s{k} as materialized ({step})" for k, step in enumerate(steps)]
    tables.insert(12, f"held as materialized (select doc_id, i as issue_no from ({pairs}) union select doc_id, j from ({pairs}))")
    return f"with {extra}, {', '.join(tables)}"


def _register() -> None:
    sql = chain_sql()
    rows = lambda s, d: chain.audit_chain(fixtures.contracts(s, d), fixtures.fitting_issues(s, d))
    names = ", ".join(f"({k + 1}, '{x}')" for k, x in enumerate(chain.STAGES))
    register("n18_chain_trace", lambda s, d: chain.chain_trace(rows(s, d)), f"""{sql},
      st(stage_no, stage) as (values {names}),
      n as (select stage_no, stage, (select count(*) from s15 where list_contains(changed, stage)) as n_changed, (select count(*) from s15 where dropped_by = stage) as n_dropped, (select count(*) from s15 where added_by = stage) as n_added from st),
      a as (select *, cast((select count(*) from s15 where added_by is null) + sum(n_added - n_dropped) over (order by stage_no) as bigint) as n_after from n)
      select *, lag(n_after, 1, (select count(*) from s15 where added_by is null)) over (order by stage_no) as n_before from a""")
    register("n18_chain_findings", lambda s, d: chain.chain_findings(rows(s, d)), f"""{sql}
      select doc_id, issue_no, {', '.join(FIELDS)}, original_category, detected as contradiction_detected, method as detection_method, verifier, added_by from s15 where dropped_by is null""")
    register("n18_chain_ledger", lambda s, d: chain.stage_ledger(rows(s, d)).where("field in ('dropped', 'added')").select("doc_id", "issue_no", "stage", "field"), f"""{sql}
      select doc_id, issue_no, dropped_by as stage, 'dropped' as field from s15 where dropped_by is not null union all select doc_id, issue_no, added_by, 'added' from s15 where added_by is not null""")


_register()
