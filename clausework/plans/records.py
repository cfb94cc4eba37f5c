"""Queries of parsing, confidence, history, evaluation, sources and streams, and their SQL."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.dialect import DUCK, layers_sql
from clausework.operators import classify, confidence, evaluate, parse, quality, redact, results
from clausework.plans import fixtures
from clausework.plans.queries import register, table
from clausework.sources import corpus, store
from clausework.streaming import streams

ISSUES, TRUTH, RUNS, HISTORY = fixtures.issues_sql(), fixtures.truth_sql(), fixtures.runs_sql(), fixtures.history_sql()
NOW = "timestamp '2024-03-01 00:00:00'"


def _parse() -> None:
    parsed = lambda s, d: parse.parse_issues(fixtures.responses(s, d))
    kinds = f"case doc_id % {len(fixtures.RESPONSE_KINDS)} " + " ".join(f"when {k} then '{m}'" for k, (_, m) in enumerate(fixtures.RESPONSE_KINDS)) + " end"
    clean = "case when doc_id % 13 <> 4 then replace(replace(replace(quoted_text, chr(92), ' '), chr(34), ' '), chr(10), ' ') else quoted_text end"
    read = f"(select * from (select doc_id, issue_no, issue_title, severity, nullif(trim(regexp_replace({clean}, '\\s+', ' ', 'g')), '') as quoted_text, {kinds} as parse_method from {ISSUES}) where parse_method <> '')"
    flat = lambda s, d: parsed(s, d).select("doc_id", "issue_no", "issue_title", "severity", F.regexp_replace(F.trim("quoted_text"), r"\s+", " ").alias("quoted_text"), "parse_method")
    register("j1_parse_issues", flat, f"select * from {read}")
    register("j2_repair_json", lambda s, d: flat(s, d).where("parse_method in ('repaired', 'truncated')"), f"select * from {read} where parse_method in ('repaired', 'truncated')")
    register("j3_parse_labeled_text", lambda s, d: flat(s, d).where("parse_method = 'labeled'"), f"select * from {read} where parse_method = 'labeled'")
    register("j4_normalize_keys", lambda s, d: fixtures.issues(s, d).select("doc_id", "issue_no", parse.normalize_keys(F.create_map(F.lit("Issue Title"), F.col("issue_title"), F.lit("quotedText"), F.col("quoted_text"), F.lit("Extra-Key"), F.col("location"))).alias("m")).select("doc_id", "issue_no", F.expr("try_element_at(m, 'issue_title')").alias("issue_title"), F.expr("try_element_at(m, 'extra_key')").alias("extra_key"), F.size("m").alias("n_keys")), f"select doc_id, issue_no, issue_title, location as extra_key, cast(2 + case when trim(quoted_text) <> '' then 1 else 0 end as int) as n_keys from {ISSUES}")
    labels = " || chr(10) || ".join(f"'{name}:' || case when coalesce({field}, '') = '' then '' else ' ' || {field} end" for name, field in parse.LABELS.items())
    rendered = f"(select doc_id, string_agg(rtrim({labels}), chr(10) || chr(10) order by issue_no) as rendered from {ISSUES} group by doc_id)"
    register("j5_render_issues", lambda s, d: parse.render_issues(fixtures.issues(s, d)), f"select * from {rendered}")
    wrapped = "case when doc_id % 3 = 0 then concat('Intro of ', cast(doc_id as varchar(20)), chr(10), chr(10), 'Issue: x', chr(10), 'Severity: LOW') else 'no findings' end as response_text"
    register("j5_render_legacy_text", lambda s, d: parse.render_issues(fixtures.issues(s, d), table(s, d, "documents").selectExpr("doc_id", wrapped)), f"""
      select doc_id, concat_ws(chr(10) || chr(10), case when doc_id % 3 = 0 then 'Intro of ' || doc_id end, rendered) as rendered from documents left join {rendered} using (doc_id)""")
    literal = "case event_id % 3 when 0 then concat('{\"a\": ', cast(event_id as varchar(20)), '}') when 1 then concat('{''a'': ', cast(event_id as varchar(20)), ', ''b'': None}') end"
    register("j6_repair_legacy_json", lambda s, d: parse.repair_legacy_json(table(s, d, "events").select("event_id", F.expr(literal.replace("''a''", "\\'a\\'").replace("''b''", "\\'b\\'")).alias("payload")), "payload").select("event_id", F.get_json_object("payload", "$.a").alias("a"), "repaired"), "select event_id, case when event_id % 3 < 2 then cast(event_id as varchar) end as a, event_id % 3 = 1 as repaired from events")
    old = lambda s, d: parse.repair_legacy_json(table(s, d, "events").select("event_id", F.expr(literal.replace("''a''", "\\'a\\'").replace("''b''", "\\'b\\'")).alias("payload")), "payload")
    register("j6_repair_report", lambda s, d: parse.repair_report({"audit": old(s, d).where("event_id % 2 = 0"), "redaction": old(s, d).where("event_id % 2 = 1"), "advisory": old(s, d).where("event_id < 0")}), """
      select 'audit' as table_name, count(*) filter (event_id % 3 = 1 and event_id % 2 = 0) as n_repaired from events union all select 'redaction', count(*) filter (event_id % 3 = 1 and event_id % 2 = 1) from events union all select 'advisory', 0""")
    common = '"success": true, "model": "m", "mode": "x", "response_type": "t"'
    payloads = (
        f'{{{common}, "schema_version": 1, "issue_count": 0, "issues": [], "structured_parse_failed": false, "legacy_text": "", "confidence_score": 0.5}}',
        f'{{{common}, "schema_version": 2, "issue_count": 0, "issues": "none", "structured_parse_failed": false, "legacy_text": "", "confidence_score": 1.5}}',
        f'{{{common}, "schema_version": 1, "advisory_text": "a", "redacted_text": "", "redaction_entities": []}}', "not json",
    )
    made = "case event_id % 4 " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(payloads)) + " end as payload"
    modes = "case event_id % 5 when 0 then 'audit' when 1 then 'REDACTION' when 2 then 'ADVISORY' when 3 then 'AUDIT' else 'other' end as mode"
    verdicts = {
        ("AUDIT", 0): ("", None), ("AUDIT", 1): ("schema_version,issues_no_list", "confidence_score_out_of_range"), ("AUDIT", 2): ("missing_issue_count,missing_issues,missing_structured_parse_failed,missing_legacy_text", None), ("AUDIT", 3): ("invalid_json", None),
        ("REDACTION", 0): ("missing_redacted_text,missing_redaction_entities,missing_redaction_count", None), ("REDACTION", 1): ("missing_redacted_text,missing_redaction_entities,missing_redaction_count,schema_version", None), ("REDACTION", 2): ("missing_redaction_count", None), ("REDACTION", 3): ("invalid_json", None),
        ("ADVISORY", 0): ("missing_advisory_text", None), ("ADVISORY", 1): ("missing_advisory_text,schema_version", "confidence_score_out_of_range"), ("ADVISORY", 2): ("", None), ("ADVISORY", 3): ("invalid_json", None),
        ("OTHER", 0): ("unknown_mode", None), ("OTHER", 1): ("unknown_mode,schema_version", None), ("OTHER", 2): ("unknown_mode", None), ("OTHER", 3): ("invalid_json,unknown_mode", None),
    }
    expected = ", ".join(f"('{m}', {k}, '{v}', {repr(w) if w else 'null'})" for (m, k), (v, w) in verdicts.items())
    register("j7_validate_results", lambda s, d: parse.validate_results(table(s, d, "events").selectExpr("event_id as doc_id", modes, made)), f"select e.event_id as doc_id, e.mode, v.violations, v.warning from (select *, {modes} from events) e join (values {expected}) as v(m, k, violations, warning) on upper(e.mode) = v.m and e.event_id % 4 = v.k")
    checks = ", ".join([f"case when trim(coalesce({c}, '')) = '' then 'missing_{c}' end" for c in ("issue_title", "category", "quoted_text", "risk_explanation")] + ["case when severity not in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') then 'bad_severity' end"])
    register("j7_validate_payload", lambda s, d: parse.validate_payload(fixtures.issues(s, d)), f"select doc_id, issue_no, concat_ws(',', {checks}) as violations from {ISSUES}")


def _confidence() -> None:
    texts = f"(select doc_id, lower(text) as low, case when length(text) > 0 then {DUCK.count('text', quality.WORD)} end as n_words from documents)"
    both = layers_sql(f"(select t.*, i.* exclude (doc_id) from {texts} t left join {ISSUES} i using (doc_id))", confidence.finding_layers(DUCK))
    live = lambda e: e.replace("count(distinct place)", "count(distinct case when issue_no is not null then place end)").replace("cast(valid as int)", "case when issue_no is not null then cast(valid as int) end")
    sums = f"(select doc_id, max(n_words) as n_words, {', '.join(f'{live(e)} as {k}' for k, e in confidence.AUDIT_SUMS.items())} from {both} group by doc_id)"
    factors = layers_sql(sums, confidence.factor_layers())
    columns = ", ".join(confidence.FACTORS)
    audit = lambda s, d: confidence.audit_factors(fixtures.issues(s, d), table(s, d, "documents"))
    register("k1_audit_factors", audit, f"select doc_id, {columns} from {factors}")
    extra = {"domain_signal": "cast(doc_id % 10 as double) / 10", "parse_success": "case when doc_id % 9 = 0 then 0.0 else 1.0 end", "policy_detected": "doc_id % 7 = 0", "non_legal_detected": "doc_id % 8 = 0", "duplicate_suppressed": "doc_id % 3", "fallback_used": "doc_id % 6 = 0", "input_degraded": "doc_id % 5 = 0"}
    register("k2_audit_confidence", lambda s, d: confidence.audit_confidence(audit(s, d).selectExpr("*", *[f"{e} as {k}" for k, e in extra.items()])), f"select doc_id, score, confidence_label from {layers_sql(factors, [extra, *confidence.score_layers()])}")
    tails = ("", " I cannot say, but the clause is enforceable.", " I cannot help; please consult a lawyer.", " Generally speaking it depends on the contract, liability, breach and damages.", " As far as I know the statute applies.", " I refuse. However, consult an attorney.")
    asked = "text || case (conv_id + turn) % 6 " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(tails)) + " end as text, 'termination clause' as query, turn % 5 = 0 as input_degraded, turn % 10 = 0 as fallback_used, case when conv_id % 2 = 0 then 'not specified' else 'India' end as jurisdiction"
    turns = lambda s, d: table(s, d, "conversations").selectExpr("conv_id", "turn", *[x for x in (asked.split(", 'termination")[0], "'termination clause' as query", "turn % 5 = 0 as input_degraded", "turn % 10 = 0 as fallback_used", "case when conv_id % 2 = 0 then 'not specified' else 'India' end as jurisdiction")])
    given = confidence.advisory_layers(DUCK, "text", "query", "input_degraded", "fallback_used", "jurisdiction")
    register("k3_advisory_confidence", lambda s, d: confidence.advisory_confidence(turns(s, d)).select("conv_id", "turn", "score", "confidence_label", "has_disclaimer"), f"select conv_id, turn, score, confidence_label, has_disclaimer from {layers_sql(f'(select conv_id, turn, {asked} from conversations)', given)}")
    register("k4_confidence_label", lambda s, d: confidence.confidence_label(fixtures.runs(s, d), "confidence_score").select("run_id", "doc_id", "confidence_label"), f"select run_id, doc_id, {quality.label('confidence_score')} as confidence_label from {RUNS}")


def _history() -> None:
    issues, history = fixtures.issues, fixtures.history
    known = ", ".join(f"'{x}'" for x in results.SEVERITIES)
    pivot = ", ".join([f"count(*) filter (severity = '{x}') as {x}" for x in results.SEVERITIES] + [f"count(*) filter (severity not in ({known}) or severity is null) as UNRATED"])
    register("h1_severity_counts", lambda s, d: results.severity_counts(issues(s, d)), f"select doc_id, {pivot} from {ISSUES} group by doc_id")
    register("h1_category_counts", lambda s, d: results.category_counts(issues(s, d)), f"select doc_id, case when trim(coalesce(category, '')) = '' then 'Uncategorized' else category end as category, count(*) as n from {ISSUES} group by all")
    clashing = lambda s, d: issues(s, d).selectExpr("*", fixtures.CLASH)
    scored = lambda s, d: table(s, d, "documents").selectExpr("doc_id", "cast(doc_id % 10 as double) / 10 as score")
    clashing_sql = f"(select *, {fixtures.CLASH} from {ISSUES})"
    risks = f"""(select doc_id, case when high > 0 and (clash or doc_id % 10 >= 5) then 'HIGH_RISK' when high > 0 then 'MODERATE_RISK' when medium > 0 and clash then 'HIGH_RISK' when medium > 0 then 'MODERATE_RISK'
        when low > 0 and clash then 'MODERATE_RISK' when low > 0 then 'LOW_RISK' else 'SAFE' end as risk_level
      from documents left join (select doc_id, count(*) filter (severity in ('HIGH', 'CRITICAL')) as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low, bool_or(contradiction_detected) as clash from {clashing_sql} group by doc_id) using (doc_id))"""
    risk = lambda s, d: results.risk_level(clashing(s, d), scored(s, d))
    register("h2_risk_level", risk, f"select * from {risks}")
    register("h3_document_summary", lambda s, d: results.document_summary(clashing(s, d), risk(s, d)), f"""
      with recursive i as (select * from {clashing_sql}), r as (select * from {risks}),
      a as (select doc_id, 1 as part, issue_no, 'Contradictory ' || lower(category) || ' clauses found' as finding from i where contradiction_detected union all select doc_id, 2, issue_no, issue_title || ' detected' from i where severity in ('HIGH', 'CRITICAL')),
      a1 as (select doc_id, list(finding order by place) as acc from (select doc_id, finding, min(part * 1000 + issue_no) as place from a group by all) group by doc_id),
      c as (select doc_id, category, count(*) as n, row_number() over (partition by doc_id order by min(issue_no)) as k from i group by doc_id, category),
      w as (select r.doc_id, coalesce(a1.acc, []) as acc, 0 as k from r left join a1 using (doc_id) union all
        select w.doc_id, case when len(list_filter(w.acc, lambda f: contains(lower(f), lower(c.category)))) > 0 then w.acc else list_append(w.acc, case when c.n > 1 then 'Multiple ' || lower(c.category) || ' issues found' else c.category || ' concern identified' end) end, w.k + 1
        from w join c on c.doc_id = w.doc_id and c.k = w.k + 1),
      f as (select doc_id, max_by(acc, k) as acc from w group by doc_id),
      first as (select doc_id, min_by(lower(category), issue_no) as top from i where severity in ('HIGH', 'CRITICAL') group by doc_id), two as (select doc_id, string_agg(category, ' and ' order by k) as cats from c where k <= 2 group by doc_id)
      select r.doc_id, array_to_string(f.acc[1:5], '; ') as key_findings, case when two.cats is null then 'No compliance issues detected in this document.' when risk_level = 'HIGH_RISK' and top is not null then 'High-risk ' || top || ' and other critical concerns detected.'
        when risk_level = 'MODERATE_RISK' then cats || ' concerns found. Review recommended before signing.' when risk_level = 'LOW_RISK' then 'Minor compliance observations. Document is generally sound.' else 'Document appears compliant. No significant issues found.' end as summary
      from r join f using (doc_id) left join first using (doc_id) left join two using (doc_id)""")
    terms = ("indemnify", "perpetual", "unlimited liability", "termination", "exclusive jurisdiction", "confidentiality survives", "force majeure", "limitation of liability", "governing law", "arbitration")
    hits = " union all ".join(f"select doc_id, '{w}' as term, len(regexp_extract_all(lower(text), '\\b{'indemnif(?:y|ies|ication)' if w == 'indemnify' else w}\\b')) as n from {fixtures.contracts_sql()}" for w in terms)
    register("h4_term_hits", lambda s, d: results.term_hits(fixtures.contracts(s, d)), f"select * from ({hits}) where n > 0")
    routed = lambda s, d: table(s, d, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then 'policy' when 1 then 'non_legal' when 2 then 'suppressed' else 'audit' end as route", "case when doc_id % 4 = 1 then 'General Text or Notes' end as content_type", "case when doc_id % 12 = 3 then 'refused' end as refusal_message")
    read = "doc_id route $.success $.response_type $.schema_version $.issue_count $.structured_parse_failed $.legacy_text $.metadata.content_type $.issues[0].issue_title $.issues[0].quoted_text".split()
    register("h5_build_results", lambda s, d: results.build_results(routed(s, d), issues(s, d)).select("doc_id", "route", *[F.get_json_object("payload", c).alias(re.sub("[^a-z0-9]+", "_", c[2:])) for c in read[2:]]), f"""
      select doc_id, case doc_id % 4 when 0 then 'policy' when 1 then 'non_legal' when 2 then 'suppressed' else 'audit' end as route, case when doc_id % 12 = 3 then 'false' else 'true' end as success,
        case when doc_id % 12 = 3 then 'refusal' when doc_id % 4 = 0 then 'policy' when doc_id % 4 = 1 then 'non_legal' else 'audit' end as response_type, '1' as schema_version,
        cast(case when doc_id % 4 = 3 then coalesce(n, 0) else 0 end as varchar) as issue_count, case when doc_id % 4 = 2 then 'true' else 'false' end as structured_parse_failed,
        case when doc_id % 12 = 3 then 'refused' when doc_id % 4 = 1 then 'This document does not appear to be a legal contract or agreement and has been flagged as non-contract content: General Text or Notes. Only contractual documents are processed through the legal-risk audit pipeline.'
          when doc_id % 4 = 2 then 'Document quality too degraded for reliable legal analysis.' else '' end as legacy_text,
        case when doc_id % 4 = 1 then 'General Text or Notes' end as metadata_content_type, case when doc_id % 4 = 3 then title end as issues_0_issue_title, case when doc_id % 4 = 3 then quote end as issues_0_quoted_text
      from documents left join (select doc_id, count(*) as n, min_by(issue_title, issue_no) as title, min_by(quoted_text, issue_no) as quote from {ISSUES} group by doc_id) using (doc_id)""")
    # every seventh audit is marked as advisory
    marked = "case when id % 7 = 0 then 'ADVISORY' else mode end as mode"
    mixed = lambda s, d: history(s, d).selectExpr(*[c for c in fixtures.HISTORY if c != "mode"], marked)
    mixed_sql = f"(select * exclude (mode), {marked} from {HISTORY})"
    register("h6_filter_history", lambda s, d: results.filter_history(mixed(s, d), filename="file1", severity="HIGH").select("id", "record_type", "filename"), f"select id, record_type, filename from {mixed_sql} where contains(filename, 'file1') and severity_level = 'HIGH' and not (record_type = 'audit' and mode = 'ADVISORY')")

    def dated(s, d):
        rows = mixed(s, d)
        stored = store.DatedTable(s, f"{streams.work_folder(s)}/history", rows.schema)
        for batch in (0, 1, 1):  # the second batch comes twice
            stored.append(rows.where(f"id % 2 = {batch}"), batch)
        return stored

    span = (datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18, 30))
    between = "ts between timestamp '2024-01-10 06:00:00' and timestamp '2024-01-20 18:30:00'"
    register("h6_filter_dates", lambda s, d: results.filter_history(s.read.parquet(dated(s, d).path), mode="AUDIT", since=span[0], until=span[1]).select("id", "ts"), f"select id, ts from {mixed_sql} where mode = 'AUDIT' and {between}")
    kinds = lambda s, d: [mixed(s, d).where(f"record_type = '{k}'") for k in ("audit", "redaction", "advisory")]
    shown = {("all", None): "not (record_type = 'audit' and mode = 'ADVISORY')", ("all", "AUDIT"): "record_type = 'audit' and mode = 'AUDIT'", ("all", "REDACTION"): "record_type = 'redaction'", ("all", "ADVISORY"): "record_type = 'advisory'", ("redaction", None): "record_type = 'redaction'", ("all", "OTHER"): "false"}

    def feeds(s, d):
        parts = [results.history_feed(*kinds(s, d), record_type=t, mode=m).withColumn("chosen", F.lit(f"{t} {m}")) for t, m in shown]
        return reduce(DataFrame.unionByName, parts)

    register("h7_history_feed", lambda s, d: results.history_feed(*kinds(s, d)), f"select id, record_type, filename, ts, item_count from {mixed_sql} where not (record_type = 'audit' and mode = 'ADVISORY')")
    register("h7_history_feed_modes", feeds, " union all ".join(f"select id, record_type, filename, ts, item_count, '{t} {m}' as chosen from {mixed_sql} where {test}" for (t, m), test in shown.items()))
    register("h8_page", lambda s, d: results.page(history(s, d), 20, 40).select("id", "record_type", "ts"), f"select id, record_type, ts from {HISTORY} order by ts desc, record_type, id desc limit 20 offset 40")

    def later_page(s, d):
        last = results.page(history(s, d), 100).agg(F.min(F.struct("ts", "record_type", "id"))["ts"]).first()[0]
        at = history(s, d).where(F.col("ts") == F.lit(last)).orderBy(F.col("record_type").desc(), "id").first()
        return results.page_after(s.read.parquet(dated(s, d).path), (at["ts"], at["record_type"], at["id"]), 30).select("id", "record_type", "ts")

    register("h8_page_after", later_page, f"select id, record_type, ts from {HISTORY} order by ts desc, record_type, id desc limit 30 offset 100")

    def stored_without(s, d):
        rows = history(s, d)
        kept = store.KeyedTable(s, f"{streams.work_folder(s)}/records", rows.schema, ["record_type", "id"], 8)
        kept.upsert(rows, batch=0)
        kept.upsert(rows.where("id % 10 = 3").selectExpr("record_type", "id", "-1 as item_count"), batch=1)
        kept.upsert(rows.where("id % 10 = 3").selectExpr("record_type", "id", "-2 as item_count"), batch=1)  # comes again: nothing
        kept.delete(rows.where("item_count = 0").select("record_type", "id"), batch=2)
        return kept.rows()

    register("h9_delete_stored", lambda s, d: stored_without(s, d).select("id", "record_type", "filename", "item_count"), f"select id, record_type, filename, case when id % 10 = 3 then -1 else item_count end as item_count from {HISTORY} where item_count <> 0")
    register("h10_retain_stored", lambda s, d: dated(s, d).retain(datetime(2024, 1, 25, 12), 10, ["record_type"]), f"select record_type, count(*) filter (ts < timestamp '2024-01-15 12:00:00') as n_deleted, count(*) filter (ts >= timestamp '2024-01-15 12:00:00') as n_kept from {HISTORY} group by record_type")

    def after_retention(s, d):
        stored = dated(s, d)
        stored.retain(datetime(2024, 1, 25, 12), 10)
        return stored.rows().select("id", "record_type")

    register("h10_retained_rows", after_retention, f"select id, record_type from {HISTORY} where ts >= timestamp '2024-01-15 12:00:00'")
    register("h9_get_record", lambda s, d: results.get_record(history(s, d), "audit", 3).select("id", "record_type", "filename"), f"select id, record_type, filename from {HISTORY} where record_type = 'audit' and id = 3")
    register("h9_delete_records", lambda s, d: results.delete_records(history(s, d), history(s, d).where("item_count = 0").select("record_type", "id")).select("id", "record_type"), f"select id, record_type from {HISTORY} where item_count <> 0")
    now = lambda: F.expr(NOW)
    register("h10_retain", lambda s, d: results.retain(history(s, d), now()).select("id", "record_type"), f"select id, record_type from {HISTORY} where ts >= {NOW} - interval 90 days")
    register("h10_retention_report", lambda s, d: results.retention_report(history(s, d), now()), f"select record_type, count(*) filter (ts >= {NOW} - interval 90 days) as n_kept, count(*) filter (not coalesce(ts >= {NOW} - interval 90 days, false)) as n_deleted from {HISTORY} group by record_type")
    register("h11_activity_summary", lambda s, d: results.activity_summary(history(s, d)), f"""
      select count(*) filter (record_type = 'audit') as total_audits, count(*) filter (record_type = 'redaction') as total_redactions, count(*) filter (record_type = 'advisory') as total_sessions,
        cast(coalesce(sum(item_count) filter (record_type = 'audit'), 0) as bigint) as total_findings, cast(coalesce(sum(item_count) filter (record_type = 'redaction'), 0) as bigint) as total_entities, count(*) as total_activities from {HISTORY}""")
    register("h12_latest_per_mode", lambda s, d: results.latest_per_mode(history(s, d)), f"select mode, id, filename, ts from (select *, row_number() over (partition by mode order by ts desc, id desc) as r from {HISTORY}) where r = 1")
    register("h13_recent_confidence", lambda s, d: results.recent_confidence(history(s, d)), f"select cast(round(avg(confidence) * 100, 0) as bigint) as percent, count(confidence) as n_scored from (select * from {HISTORY} order by ts desc, id desc limit 20)")
    register("h14_iso_timestamp", lambda s, d: results.iso_timestamp(history(s, d)).select("id", "iso"), f"select id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from {HISTORY}")
    register("h15_transcripts", lambda s, d: results.transcripts(table(s, d, "conversations")), "select conv_id, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || coalesce(text, ''), chr(10) order by turn) as transcript from conversations group by conv_id")
    said = "case when role = 'assistant' and (conv_id + turn) % 7 = 0 then concat(text, ' As an AI model I cannot say.') else text end as text"
    talks = lambda s, d: table(s, d, "conversations").selectExpr("conv_id", "turn", "role", said)
    # P-6's disclosures as whole words: DuckDB's word bounds know ASCII only, so other letters and digits become a word sign
    ascii_words = "regexp_replace(regexp_replace(replace(next_text, chr(11), ' '), '[^\\P{L}A-Za-z]', '_', 'g'), '[^\\P{Nd}0-9]', '_', 'g')"
    discloses = DUCK.has(ascii_words, classify.DISCLOSURE)
    register("h16_session_history", lambda s, d: results.session_history(talks(s, d)).select("conv_id", "n_exchanges", "first_turn", "last_turn", F.expr("array_join(transform(exchanges, x -> concat(x.user, ' / ', x.assistant)), chr(10))").alias("exchanges")), f"""
      select conv_id, count(*) as n_exchanges, min(turn) as first_turn, max(turn) as last_turn, string_agg(text || ' / ' || next_text, chr(10) order by turn) as exchanges
      from (select *, lead(role) over w as next_role, lead(text) over w as next_text from (select conv_id, turn, role, {said} from conversations) window w as (partition by conv_id order by turn))
      where role = 'user' and next_role = 'assistant' and trim(coalesce(text, '')) <> '' and trim(coalesce(next_text, '')) <> '' and not {discloses} group by conv_id""")


def _evaluate() -> None:
    issues, truth, runs = fixtures.issues, fixtures.truth, lambda s, d: fixtures.runs(s, d).withColumn("gt_count", F.expr("tp + fn"))
    rows = f"(select *, tp + fn as gt_count from {RUNS})"
    plain = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"
    anywhere = lambda patterns, c: f"exists (select 1 from (select unnest({patterns}) as p) where contains({c}, lower(p)))"
    pairs = f"""(select doc_id, issue_no, gt_no, issue_title, expected_title from (select i.*, g.* exclude (doc_id), {plain("quoted_text")} as q, {plain("risk_explanation")} as w from {ISSUES} i join {TRUTH} g using (doc_id))
      where list_contains(list_transform(allowed_categories, lambda c: lower(c)), lower(category)) and list_contains(list_transform(allowed_severities, lambda c: upper(c)), upper(severity))
        and (len(quote_patterns) = 0 or {anywhere("quote_patterns", "q")}) and (len(explanation_patterns) = 0 or {anywhere("explanation_patterns", "w")}) and not {anywhere("quote_not_patterns", "q")} and not {anywhere("explanation_not_patterns", "w")})"""
    first = f"(select doc_id, issue_no, gt_no, issue_title, expected_title from (select *, row_number() over (partition by doc_id, issue_no order by gt_no) as r from {pairs}) where r = 1)"
    register("e1_match_findings", lambda s, d: evaluate.match_findings(issues(s, d), truth(s, d)), f"select * from {pairs}")
    register("e2_first_match", lambda s, d: evaluate.first_match(evaluate.match_findings(issues(s, d), truth(s, d))), f"select * from {first}")
    register("e3_title_match_class", lambda s, d: evaluate.title_match_class(evaluate.match_findings(issues(s, d), truth(s, d))).select("doc_id", "issue_no", "gt_no", "title_class"), f"select doc_id, issue_no, gt_no, {evaluate.title_class(DUCK, 'issue_title', 'expected_title')} as title_class from {pairs}")
    classed = lambda source: f"(select *, {evaluate.title_class(DUCK, 'issue_title', 'expected_title')} as tc from {source})"

    def metrics_sql(found: str, firsts: str) -> str:
        return f"""(select *, case when tp + fp > 0 then tp / (tp + fp) when gt_count = 0 then 1.0 else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) when gt_count = 0 then 1.0 else 0.0 end as recall,
          case when tp > 0 then (n_exact + n_partial) / tp else 1.0 end as title_accuracy, 1.0 as severity_accuracy from (
          select d.doc_id, coalesce(tp, 0) as tp, coalesce(n_found, 0) - coalesce(tp, 0) as fp, coalesce(gt_count, 0) - coalesce(n_gt_hit, 0) as fn, coalesce(gt_count, 0) as gt_count, coalesce(n_exact, 0) as n_exact, coalesce(n_partial, 0) as n_partial,
            doc_id % 9 > 0 as parse_ok, doc_id % 4 = 1 as red_flag
          from documents d left join (select doc_id, count(*) as n_found from {found} group by doc_id) f using (doc_id) left join (select doc_id, count(*) as gt_count from {TRUTH} group by doc_id) g using (doc_id)
          left join (select doc_id, count(*) as tp, count(distinct gt_no) as n_gt_hit, count(*) filter (tc = 'exact') as n_exact, count(*) filter (tc = 'partial') as n_partial from {classed(firsts)} group by doc_id) h using (doc_id)))"""

    flags = lambda s, d: table(s, d, "documents").selectExpr("doc_id", "doc_id % 9 > 0 as parse_ok", "doc_id % 4 = 1 as red_flag")
    counted = metrics_sql(ISSUES, first)
    register("e4_document_metrics", lambda s, d: evaluate.document_metrics(issues(s, d), truth(s, d), flags(s, d)), f"""
      select * exclude (red_flag), fail_reasons = '' as pass from (select *, array_to_string(list_filter([case when not parse_ok then 'parse_failed' end, case when red_flag and tp = 0 and gt_count > 0 then 'catastrophic_false_negative' end,
        case when gt_count > 0 and tp < gt_count then 'missing ' || (gt_count - tp) || '/' || gt_count || ' findings' end, case when gt_count > 0 and fp > 0 then fp || ' false positive(s)' end], lambda x: x is not null), '; ') as fail_reasons from {counted})""")
    sums = "cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, count(*) as n_docs, avg(parse_ok::int) as parse_rate, sum(tp * severity_accuracy) as sv, sum(n_exact + n_partial) as tt"
    rates = "coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall, coalesce(fp / nullif(tp + fp, 0), 0.0) as fpr, coalesce(fn / nullif(tp + fn, 0), 0.0) as fnr, coalesce(sv / nullif(tp, 0), 0.0) as severity_accuracy, coalesce(tt / nullif(tp, 0), 0.0) as title_accuracy"
    weighing = "100.0 * (parse_rate * 0.20 + precision * 0.20 + recall * 0.25 + severity_accuracy * 0.15 + (1 - least(greatest(fpr - 0.30, 0) / 0.30, 1)) * 0.10 + (1 - least(greatest(fnr - 0.35, 0) / 0.35, 1)) * 0.10)"
    total = lambda by, group, source=rows: f"(select * exclude (sv, tt), cast({weighing} as double) as composite from (select *, {rates} from (select {by}{sums} from {source} {group})))"
    register("e5_corpus_metrics", lambda s, d: evaluate.corpus_metrics(runs(s, d)), f"select * from {total('', '')}")
    register("e6_metrics_by_type", lambda s, d: evaluate.metrics_by_type(runs(s, d)), f"select doc_type, tp, fp, fn, n_docs, precision, recall, composite from {total('doc_type, ', 'group by grouping sets ((), (doc_type))')}")
    scores = ", ".join(f"cast({e} as double) as {k}" for k, e in evaluate.SCORES.items())
    register("e7_correctness_scores", lambda s, d: evaluate.correctness_scores(runs(s, d)), f"select run_id, doc_id, {scores} from {rows}")
    average = lambda c: f"rank() over (partition by run_id order by {c}) + (count(*) over (partition by run_id, {c}) - 1) / 2.0"
    register("e8_spearman", lambda s, d: evaluate.spearman(runs(s, d), "confidence_score", "tp", ["run_id"]), f"select *, case when abs(rho) >= 1 then 0.0 else least(1.0, 2 * exp(-0.5 * abs(rho * sqrt((n - 2) / (1 - rho * rho))))) end as p_value from (select run_id, count(*) as n, coalesce(corr(rx, ry), 0) as rho from (select run_id, cast({average('confidence_score')} as double) as rx, cast({average('tp')} as double) as ry from {rows}) group by run_id)")
    register("e9_kendall", lambda s, d: evaluate.kendall(runs(s, d), "fp", "tp"), f"""
      with p as (select fp as x, tp as y, count(*) as n from {rows} group by all), m as (select sum(case when a.y < b.y then a.n * b.n else 0 end) as c, sum(case when a.y > b.y then a.n * b.n else 0 end) as d from p a join p b on a.x < b.x and a.y <> b.y)
      select cast(coalesce(c, 0) as bigint) as concordant, cast(coalesce(d, 0) as bigint) as discordant, coalesce(cast(c - d as double) / nullif(c + d, 0), 0.0) as tau from m""")
    register("e10_mann_whitney", lambda s, d: evaluate.mann_whitney(runs(s, d), "confidence_score", "pass"), f"""
      with v as (select confidence_score as v, count(*) filter (pass) as p, count(*) filter (not pass) as f from {rows} where pass is not null group by 1), t as (select sum(p) as n1, sum(f) as n2 from v),
      u as (select sum(p * (coalesce(below, 0) + f / 2.0)) as u from (select *, sum(f) over (order by v rows between unbounded preceding and 1 preceding) as below from v))
      select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, cast(u / (n1 * n2) as double) as auc from t, u""")
    edges = "(values (0.0, 0.25), (0.25, 0.45), (0.45, 0.6), (0.6, 0.75), (0.75, 0.9), (0.9, 1.01)) as b(lo, hi)"
    register("e11_calibration_bins", lambda s, d: evaluate.calibration_bins(runs(s, d)), f"select cast(lo as double) as lo, cast(hi as double) as hi, count(*) as n_docs, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tp) as double) / nullif(sum(tp + fp), 0) as micro_precision, avg(cast(tp as double) / nullif(tp + fp, 0)) as mean_precision from {rows} join {edges} on confidence_score >= cast(lo as double) and confidence_score < cast(hi as double) group by lo, hi")
    register("e12_confidence_gap", lambda s, d: evaluate.confidence_gap(runs(s, d)), f"select avg(confidence_score) filter (pass) as mean_pass, avg(confidence_score) filter (not pass) as mean_fail, min(confidence_score) as lo, max(confidence_score) as hi, avg(confidence_score) filter (pass) - avg(confidence_score) filter (not pass) as gap from {rows}")
    register("e13_overconfident", lambda s, d: evaluate.overconfident(runs(s, d)), f"select run_id, doc_id, confidence_score, pass, tp, not pass and confidence_score >= 0.8 as high_confidence_failure, tp = 0 and fp + fn > 0 and (fp > 0 or gt_count > 0) and gt_count > 0 and confidence_score >= 0.5 as nothing_correct from {rows} where (not pass and confidence_score >= 0.8) or (tp = 0 and gt_count > 0 and confidence_score >= 0.5)")
    register("e14_compare_runs", lambda s, d: evaluate.compare_runs(runs(s, d), "run1", ["run2", "run3"]), f"select *, (run2 + run3) / 2 as mean_after, (run2 + run3) / 2 - run1 as delta from (select doc_id, avg(confidence_score) filter (run_id = 'run1') as run1, avg(confidence_score) filter (run_id = 'run2') as run2, avg(confidence_score) filter (run_id = 'run3') as run3 from {rows} group by doc_id)")
    per = total("run_id, ", "group by run_id")
    names = ("precision", "recall", "fpr", "fnr", "composite")
    register("e14_compare_overall", lambda s, d: evaluate.compare_overall(runs(s, d), "run1", ["run2", "run3"]), " union all ".join(f"select '{m}' as metric, b as before, a as mean_after, a - b as delta from (select max({m}) filter (run_id = 'run1') as b, avg({m}) filter (run_id <> 'run1') as a from {per})" for m in names))
    register("e15_run_stats", lambda s, d: evaluate.run_stats(runs(s, d)), " union all ".join(f"select '{m}' as metric, avg({m}) as mean, stddev_samp({m}) as sd from {per}" for m in names))
    weight = "case when gt_count = 0 then case when fp > 0 then 0.0 else 1.0 end else greatest(0.0, least(1.0, tp / gt_count - fp * 0.15 - fn * 0.35)) end"
    register("e15_misleading_scores", lambda s, d: evaluate.misleading_scores(runs(s, d)), f"select *, weighted > 0.7 and (fp > 0 or gt_count = 0) as too_high, weighted < 0.3 and gt_count > 0 and tp > 0 as too_low from (select doc_id, avg(cast({weight} as double)) as weighted, avg(tp) as tp, avg(fp) as fp, avg(fn) as fn, max(gt_count) as gt_count from {rows} group by doc_id)")
    grid = "(select a.x as fp_penalty, b.x as fn_penalty, a.i, b.i as j from (values (0.05, 0), (0.10, 1), (0.15, 2), (0.20, 3), (0.25, 4)) a(x, i), (values (0.15, 0), (0.25, 1), (0.35, 2), (0.45, 3), (0.55, 4)) b(x, i))"
    score = "case when gt_count = 0 then case when fp > 0 then 0.0 else 1.0 end else greatest(0.0, least(1.0, cast(tp as double) / nullif(gt_count, 0) - fp * cast(fp_penalty as double) - fn * cast(fn_penalty as double))) end"
    ranked = lambda c: f"cast(rank() over (partition by i, j order by {c}) + (count(*) over (partition by i, j, {c}) - 1) / 2.0 as double)"
    shown = ("mean", "sd", "spread", "rho", "separation", "agreement", "robustness", "composite")
    rounded = ", ".join(f"round({c}, 6) as {c}" for c in shown)
    register("e16_sensitivity_grid", lambda s, d: evaluate.sensitivity_grid(runs(s, d)).selectExpr("fp_penalty", "fn_penalty", *[f"round({c}, 6) as {c}" for c in shown]), f"""
      with s as (select *, round(cast({score} as double), 9) as score from {rows}, {grid}), r as (select *, {ranked('score')} as ra, {ranked('confidence_score')} as rb from s),
      g as (select i, j, cast(fp_penalty as double) as fp_penalty, cast(fn_penalty as double) as fn_penalty, avg(score) as mean, stddev_pop(score) as sd, max(score) - min(score) as spread, coalesce(corr(ra, rb), 0) as rho, coalesce(avg(score) filter (pass), 0) - coalesce(avg(score) filter (not pass), 0) as separation from r group by all),
      t as (select x.i, x.j, coalesce(corr(x.ra, y.ra), 0) as c from r x join r y on x.run_id = y.run_id and x.doc_id = y.doc_id and (x.i <> y.i or x.j <> y.j) group by x.i, x.j, y.i, y.j), t2 as (select i, j, avg(c) as agreement from t group by i, j),
      n as (select a.i, a.j, 1 - (max(b.rho) - min(b.rho)) as robustness from g a join g b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 group by a.i, a.j),
      f as (select *, rho * 0.35 + agreement * 0.25 + robustness * 0.20 + separation * 0.10 + sd * 0.10 as composite from g join t2 using (i, j) join n using (i, j))
      select fp_penalty, fn_penalty, {rounded} from f order by round(composite, 9) desc, fp_penalty, fn_penalty limit 10""")
    long = " union all ".join(f"select run_id, doc_id, confidence_score, pass, '{k}' as formula, cast({e} as double) as value from {rows}" for k, e in evaluate.SCORES.items())
    scale = lambda c: f"coalesce(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 0.0)"
    register("e17_rank_formulas", lambda s, d: evaluate.rank_formulas(evaluate.formula_criteria(runs(s, d))).selectExpr("formula", "round(total, 6) as total", "place"), f"""
      with l as ({long}), st as (select formula, 1 - (max(m) - min(m)) as stability from (select formula, run_id, avg(value) as m from l group by all) group by formula),
      c as (select formula, coalesce(corr(value, confidence_score), 0.0) as rho, avg(value) filter (pass) - avg(value) filter (not pass) as separation, stddev_pop(value) as spread from l group by formula),
      t as (select formula, {scale('rho')} * 0.25 + {scale('separation')} * 0.15 + {scale('spread')} * 0.30 + {scale('stability')} * 0.30 as total from c join st using (formula))
      select formula, round(total, 6) as total, cast(rank() over (order by round(total, 9) desc, formula) as int) as place from t""")
    a, b = lambda s, d: evaluate.document_metrics(issues(s, d), truth(s, d), flags(s, d)), lambda s, d: evaluate.document_metrics(issues(s, d).where("issue_no <> 2"), truth(s, d), flags(s, d))
    second = metrics_sql(f"(select * from {ISSUES} where issue_no <> 2)", f"(select * from {first} where issue_no <> 2)")
    register("e18_ab_compare", lambda s, d: evaluate.ab_compare(a(s, d), b(s, d)), f"select doc_id, y.tp - x.tp as d_tp, y.fp - x.fp as d_fp, y.fn - x.fn as d_fn, x.tp = y.tp and x.fp = y.fp and x.fn = y.fn as is_same from {counted} x join {second} y using (doc_id)")
    register("e18_ab_corpus", lambda s, d: evaluate.ab_corpus(a(s, d), b(s, d)), " union all ".join(f"select '{m}' as metric, x.{m} as a, y.{m} as b, y.{m} - x.{m} as delta from {total('', '', counted)} x, {total('', '', second)} y" for m in names))
    side = "doc_id, issue_no, issue_title, category"
    register("e18_ab_identity", lambda s, d: evaluate.ab_identity(issues(s, d).select(*side.split(", ")), issues(s, d).selectExpr("doc_id", "issue_no", "case when issue_title = 'No SLA' then 'SLA' else issue_title end as issue_title", "category").where("issue_no <> 3")), f"""
      with x as (select {side} from {ISSUES}), y as (select doc_id, issue_no, case when issue_title = 'No SLA' then 'SLA' else issue_title end as issue_title, category from {ISSUES} where issue_no <> 3)
      select (select count(*) from (select * from x except all select * from y)) as n_only_a, (select count(*) from (select * from y except all select * from x)) as n_only_b, (select count(*) from (select * from x except all select * from y)) + (select count(*) from (select * from y except all select * from x)) = 0 as is_identical""")
    gates = [("few_false", "fp <= {}", 1), ("recall", "recall >= {}", 0.5), ("some_found", "tp >= {}", 1)]
    register("e19_regression_gates", lambda s, d: evaluate.regression_gates(a(s, d), gates), " union all ".join(f"select doc_id, '{n}' as gate, {c.format(v)} as passed from {counted}" for n, c, v in gates))


    answered = """select doc_id, case doc_id % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence_label, cast((doc_id * 37) % 101 as double) / 100 as confidence_score,
      case when doc_id % 5 = 0 then 'non_legal' else 'audit' end as response_type, doc_id % 11 = 0 as parse_failed, case when doc_id % 7 = 0 then 'degraded' end as quality_warning from documents where doc_id % 17 <> 3"""
    cases = [("clean", "label_is_not", "LOW", None), ("clean", "forbids_category", "confidentiality", None), ("indemnity", "requires_category", "INDEMN", None), ("indemnity", "at_most_findings", None, 2.0), ("spam", "at_least_score", None, 0.3), ("spam", "parsed", None, None), ("spam", "type_is", "audit", None), ("odd", "warned", None, None), ("odd", "no_such_kind", "x", None), ("title", "requires_title", "sla", None)]

    def gated(s, d):
        table(s, d, "documents").createOrReplaceTempView("documents")
        rows = evaluate.result_rows(s.sql(answered), issues(s, d))
        own = F.inline(F.array(*[F.struct(F.lit(c).alias("case_name"), F.lit(k).alias("kind"), F.lit(w).cast("string").alias("words"), F.lit(n).cast("double").alias("bound")) for c, k, w, n in cases]))
        return evaluate.run_gates(rows, table(s, d, "documents").select("doc_id", own))

    fails = {"clean": ["case when exists (select 1 from i where i.doc_id = r.doc_id and lower(category) = 'confidentiality') then 'forbids_category confidentiality' end", "case when confidence_label = 'LOW' then 'label_is_not LOW' end"],
      "indemnity": ["case when (select count(*) from i where i.doc_id = r.doc_id) > 2 then 'at_most_findings 2.0' end", "case when not exists (select 1 from i where i.doc_id = r.doc_id and category ilike '%indemn%') then 'requires_category INDEMN' end"],
      "spam": ["case when confidence_score < 0.3 then 'at_least_score 0.3' end", "case when parse_failed then 'parsed' end", "case when response_type <> 'audit' then 'type_is audit' end"],
      "odd": ["'no_such_kind x'", "case when quality_warning is null then 'warned' end"], "title": ["case when not exists (select 1 from i where i.doc_id = r.doc_id and issue_title ilike '%sla%') then 'requires_title sla' end"]}
    each = " union all ".join(f"select doc_id, '{c}' as case_name, concat_ws('; ', {', '.join(tests)}) as reasons from r" for c, tests in fails.items())
    names = ", ".join(f"('{c}')" for c in fails)
    register("e19_case_gates", gated, f"""with i as (select * from {ISSUES}), r as ({answered}), t as ({each}),
      x as (select * from t union all select doc_id, c as case_name, 'no result' as reasons from documents, (values {names}) v(c) where doc_id % 17 = 3)
      select case_name, doc_id, reasons = '' as passed, reasons from x""")


def _sources() -> None:
    each_page, most = 700, (8192 - 1024) * 4 - 2000
    pages_of = lambda s, d: table(s, d, "documents").selectExpr("doc_id", "text", "explode(sequence(0, cast(greatest(ceil(length(text) / 700.0), 1) as int) - 1)) as page_no").selectExpr("doc_id", "page_no", f"substr(text, 1 + {each_page} * page_no, {each_page}) as text")
    register("q8_pages_in_budget", lambda s, d: quality.pages_in_budget(pages_of(s, d), separator="\n"), f"""
      with p as (select doc_id, unnest(generate_series(0, cast(greatest(ceil(length(text) / 700.0), 1) as bigint) - 1)) as k, length(text) as size, cast(greatest(ceil(length(text) / 700.0), 1) as bigint) as pages from documents)
      select doc_id, count(*) as n_pages, count(*) filter (k * {each_page + 1} < {most} or size = 0) as pages_seen, least({most}, any_value(size) + count(*) - 1) as kept_chars, greatest(0, any_value(size) + count(*) - 1 - {most}) as dropped_chars,
        any_value(size) + count(*) - 1 > {most} as was_truncated from p group by doc_id""")
    files = "concat('f', cast(doc_id as varchar(20)), case doc_id % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.DOCX' else '.exe' end) as filename, case when doc_id % 13 = 0 then 0 else length(text) * 1000 end as size_bytes"
    register("io2_admission_gate", lambda s, d: corpus.admission_gate(table(s, d, "documents").selectExpr("doc_id", "text", *[x.strip() for x in (files.rsplit(", case when doc_id % 13", 1)[0], "case when doc_id % 13" + files.rsplit(", case when doc_id % 13", 1)[1])])).select("doc_id", "filename", "reject_reason"), f"select doc_id, filename, reject_reason from {layers_sql(f'(select *, {files} from documents)', corpus.admission_layers(DUCK))}")
    pages = lambda s, d: table(s, d, "pages").selectExpr("page_id div 4 as doc_id", "page_id % 4 as page_no", "html as text")
    pages_sql = "(select page_id // 4 as doc_id, page_id % 4 as page_no, html as text from pages)"
    register("io3_assemble_pages", lambda s, d: corpus.assemble_pages(pages(s, d)), f"select doc_id, string_agg(coalesce(text, ''), '' order by page_no, text) as text, cast(count(*) as int) as n_pages from {pages_sql} group by doc_id")
    # conversations as pages, with noise that degrades some
    noise = "' @@## T3XT %%% w0rd !!! $$$ 1nput ### &&& *** x9x9x9 @@@ ### 0o0o1l1l'"
    paged = f"conv_id as doc_id, turn as page_no, case when turn % 3 = 2 and conv_id % 4 > 0 then 'no' when conv_id % 2 = 1 then {noise} || {noise} || text else text end as text"
    short = lambda s, d: table(s, d, "conversations").selectExpr(*paged.replace("conv_id as doc_id, turn as page_no, ", "conv_id as doc_id|turn as page_no|").split("|", 2))
    whole = layers_sql(f"(select doc_id, string_agg(coalesce(text, ''), '' order by page_no, text) as text from (select {paged} from conversations) group by doc_id)", [*quality.quality_counts_sql(), *quality.quality_layers(DUCK)])
    register("io4_page_text_triage", lambda s, d: corpus.page_text_triage(short(s, d)), f"""
      select *, n_deficient > 0 and deficient_ratio < 0.2 and is_degraded as needs_full_ocr from (select c.*, n_deficient / n_pages as deficient_ratio, is_degraded from
        (select conv_id as doc_id, count(*) as n_pages, count(*) filter (length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 50) as n_deficient from (select conv_id, text from (select doc_id as conv_id, text from (select {paged} from conversations))) group by conv_id) c join {whole} q using (doc_id))""")
    stops = "regexp_replace(regexp_replace(coalesce(text, ''), '([a-zA-Z0-9])\\.([A-Z])', '\\1. \\2', 'g'), '([a-zA-Z0-9])\\.([A-Z])', '\\1. \\2', 'g')"
    register("io5_fix_merged_words", lambda s, d: corpus.fix_merged_words(table(s, d, "documents")), f"select doc_id, regexp_replace({stops}, '([a-z])([A-Z])', '\\1 \\2', 'g') as fixed from documents")

    def a_file_each(rows, key: str, folder: str) -> None:
        """A file for each value, in a few folders: with a folder each, every one would be a task of the listing."""
        rows.selectExpr("value", f"pmod({key}, 64) as part").write.partitionBy("part").option("maxRecordsPerFile", 1).text(folder)

    def text_files(s, d):
        """The number of the conversation is the first line of its file."""
        path = f"{streams.work_folder(s)}/texts"
        a_file_each(results.transcripts(table(s, d, "conversations")).selectExpr("conv_id", "concat(coalesce(cast(conv_id as string), ''), '\n', transcript) as value"), "conv_id", path)
        return corpus.read_text_corpus(s, path).selectExpr("try_cast(substring_index(text, '\n', 1) as long) as conv_id", "substr(text, instr(text, '\n') + 1) as text")

    register("io1_read_text_corpus", text_files, "select conv_id, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || coalesce(text, ''), chr(10) order by turn) || chr(10) as text from conversations group by conv_id")

    def packed(df, fields: str, folder: str) -> None:
        """JSON arrays of at most 100 documents in a file each, as review and run files hold them."""
        rows = df.selectExpr("doc_id div 100 as part", f"to_json(struct({fields})) as j").groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("value"))
        a_file_each(rows, "part", folder)

    def review_files(s, d):
        folder = f"{streams.work_folder(s)}/reviews"
        item = "struct(gt_no, concat(doc_id, '-', gt_no) as id, expected_title as expected_issue_title, allowed_severities, allowed_categories, quote_patterns as must_contain_quoted_text_pattern)"
        lists = fixtures.truth(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.expr(item))).alias("issues"))
        packed(lists, "cast(doc_id as string) as document_id, struct(issues) as ground_truth", folder)
        return corpus.load_ground_truth(s, folder, "*").selectExpr("cast(doc_id as bigint) as doc_id", "gt_no", "id", "expected_issue_title", "array_join(allowed_severities, '|') as severities", "size(must_contain_quoted_text_pattern) as n_patterns")

    register("io6_load_ground_truth", review_files, f"select doc_id, cast(gt_no - 1 as int) as gt_no, doc_id || '-' || gt_no as id, expected_title as expected_issue_title, array_to_string(allowed_severities, '|') as severities, len(quote_patterns) as n_patterns from {TRUTH}")

    def run_files(s, d):
        folder = f"{streams.work_folder(s)}/runs"
        lists = fixtures.runs(s, d).selectExpr("doc_id", "run_id", "array(struct(cast(doc_id as string) as doc_id, tp, fp, fn, confidence_score)) as per_document")
        packed(lists, "run_id, per_document", folder)
        return corpus.load_runs(s, folder).selectExpr("run_id", "cast(doc_id as bigint) as doc_id", "tp", "fp", "fn", "confidence_score")

    register("io7_load_runs", run_files, f"select run_id, doc_id, tp, fp, fn, confidence_score from {RUNS}")
    register("io8_redaction_rows", lambda s, d: corpus.redaction_rows(redact.redact_documents(fixtures.letters(s, d))))
    item = "'{\"issue_no\":' || issue_no || ',\"issue_title\":\"' || issue_title || '\",\"severity\":\"' || severity || '\"}'"
    register("io8_history_rows", lambda s, d: corpus.history_rows(fixtures.issues(s, d)), f"select doc_id, 'doc' || doc_id || '.txt' as filename, cast(count(*) as int) as issue_count, '[' || string_agg({item}, ',' order by issue_no) || ']' as issues_json, 'HIGH' as severity_level from {ISSUES} group by doc_id")
    register("io9_report_text", lambda s, d: corpus.report_text(fixtures.issues(s, d)), f"select doc_id, 'Findings of document ' || doc_id || chr(10) || string_agg(issue_no || '. ' || issue_title || ' [' || severity || '] ' || coalesce(category, ''), chr(10) order by issue_no) as report from {ISSUES} group by doc_id")


def _streams() -> None:
    """The streams' logic on whole tables; tests hold the streaming runs against these."""
    register("t1_score_stream", lambda s, d: streams.score_stream(table(s, d, "documents")).select("doc_id", "route"), f"select doc_id, route from {layers_sql('documents', [*classify.route_counts_sql(), *classify.route_layers(DUCK)])}")
    sessions = lambda s, d: table(s, d, "conversations").selectExpr("conv_id as session_id", "text as messages", "turn as message_count", "timestamp_seconds(turn) as ts")
    current = lambda s, d: sessions(s, d).where("message_count = 0 and session_id % 2 = 0").selectExpr("session_id", "concat('Title ', cast(session_id as string)) as title", "messages", "message_count", "ts")
    register("t2_upsert_sessions", lambda s, d: streams.upsert_sessions(current(s, d), sessions(s, d).where("message_count >= 1")).select("session_id", "title", "message_count"), """
      with l as (select conv_id as session_id, max(turn) as n from conversations where turn >= 1 group by conv_id), c as (select distinct conv_id as session_id, 'Title ' || conv_id as title from conversations where turn = 0 and conv_id % 2 = 0)
      select session_id, coalesce(title, 'Advisory session') as title, coalesce(n, 0) as message_count from l full join c using (session_id)""")
    register("t2_upsert_stream", lambda s, d: streams.upserted(streams.replayed(sessions(s, d).coalesce(1)), 8).select("session_id", "title", "messages", "message_count"), f"""
      select conv_id as session_id, 'Advisory session' as title, max_by(text, turn) as messages, max(turn) as message_count from conversations group by conv_id""")
    scored = lambda s, d: streams.drained(streams.score_stream(streams.replayed(table(s, d, "documents"))))
    register("t1_scored_stream", lambda s, d: scored(s, d).groupBy("route").agg(F.count("*").alias("n_docs")), f"select route, count(*) as n_docs from {layers_sql('documents', [*classify.route_counts_sql(), *classify.route_layers(DUCK)])} group by route")
    register("t4_running_stream", lambda s, d: streams.drained(streams.running_summary(streams.replayed(fixtures.history(s, d))), "complete"), f"select mode, count(*) as n_records, cast(sum(item_count) as bigint) as n_items from {HISTORY} group by mode")
    register("t5_retain_stream", lambda s, d: streams.retained(streams.replayed(fixtures.history(s, d).unionByName(fixtures.history(s, d))), 10).select("id", "record_type"), f"select id, record_type from {HISTORY} where ts >= (select max(ts) from {HISTORY}) - interval 10 days")
    # turns at even places; odd ones set a mode, or clear the conversation behind its second exchange
    said = """select conv_id, cast(2 * turn as bigint) as turn, role, text from conversations
      union all select conv_id, -1, 'system', case when conv_id % 8 = 1 then 'mode poetry' else 'mode advisory' end from conversations where turn = 0 and conv_id % 4 = 1
      union all select conv_id, 5, 'system', 'reset' from conversations where turn = 0 and conv_id % 4 = 2 union all select conv_id, 7, 'system', 'mode redaction' from conversations where turn = 0 and conv_id % 8 = 2"""

    def timed(s, d):
        table(s, d, "conversations").createOrReplaceTempView("conversations")
        return s.sql(f"select *, timestamp_seconds(1700000000 + turn) as ts from ({said})")

    register("t3_session_state", lambda s, d: streams.drained(streams.session_state(streams.replayed(timed(s, d).coalesce(1))), "update").select("conv_id", "mode", "n_exchanges", "last_turn", F.expr("array_join(transform(exchanges, x -> concat(x.turn, ': ', x.user, ' / ', x.assistant)), chr(10))").alias("exchanges")), f"""
      with t as (select * from ({said})),
      p as (select *, lead(role) over w as next_role, lead(text) over w as next_text from t where not (role = 'system' and text like 'mode %') window w as (partition by conv_id order by turn)),
      e as (select conv_id, turn, text || ' / ' || next_text as exchange from p where role = 'user' and next_role = 'assistant' and trim(coalesce(text, '')) <> '' and trim(coalesce(next_text, '')) <> '' and not (conv_id % 4 = 2 and turn < 5)),
      l as (select conv_id, count(*) as n, string_agg(turn || ': ' || exchange, chr(10) order by turn) as exchanges from e group by conv_id)
      select conv_id, case when conv_id % 8 = 2 then 'REDACTION' when conv_id % 8 = 5 then 'ADVISORY' else 'AUDIT' end as mode, coalesce(any_value(n), 0) as n_exchanges, max(turn) as last_turn, coalesce(any_value(l.exchanges), '') as exchanges
      from t left join l using (conv_id) group by conv_id""")

    def reviewed(s, d):
        docs = fixtures.contracts(s, d).selectExpr("*", "case doc_id % 3 when 0 then 'audit' when 1 then 'REDACTION' else 'ADVISORY' end as mode", "timestamp_seconds(1700000000 + 7200 * doc_id) as ts")
        # two batches, each of as many files as the documents are read in parts
        n = table(s, d, "documents").rdd.getNumPartitions()
        docs = docs.join(fixtures.responses(s, d), "doc_id", "left").repartition(2 * n, "doc_id")
        folder = streams.work_folder(s)
        docs.write.parquet(f"{folder}/in")
        files = len(s.read.parquet(f"{folder}/in").inputFiles())
        stream = s.readStream.schema(docs.schema).option("maxFilesPerTrigger", (files + 1) // 2).parquet(f"{folder}/in")
        streams.reviewed(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        # the second batch comes again, as after a failure before its commit
        s.read.parquet(f"{folder}/out/_incoming/batch=1").write.parquet(f"{folder}/again")
        streams.review_sink(f"{folder}/out")(s.read.parquet(f"{folder}/again"), 1)
        routes, redactions = (s.read.parquet(f"{folder}/out/{k}").groupBy("doc_id").agg(F.count("*").alias(f"n_{k}")) for k in ("routes", "redactions"))
        history = streams.DatedTable(s, f"{folder}/out/history", streams.HISTORY).rows().groupBy(F.col("id").alias("doc_id"), "record_type").agg(F.count("*").alias("n_records"))
        return s.read.parquet(f"{folder}/in").select("doc_id").join(routes, "doc_id", "left").join(redactions, "doc_id", "left").join(history, "doc_id", "left").na.fill(0)

    routed = layers_sql(fixtures.contracts_sql(), [*classify.route_counts_sql(), *classify.route_layers(DUCK)])
    register("t1_review_stream", reviewed, f"""
      select doc_id, case when doc_id % 3 = 0 then 1 else 0 end as n_routes, case when doc_id % 3 = 1 then 1 else 0 end as n_redactions,
        case when doc_id % 3 = 1 then 'redaction' when doc_id % 3 = 0 and route = 'audit' then 'audit' end as record_type, case when doc_id % 3 = 1 or (doc_id % 3 = 0 and route = 'audit') then 1 else 0 end as n_records from {routed}""")
    register("t4_running_summary", lambda s, d: streams.running_summary(fixtures.history(s, d)), f"select mode, count(*) as n_records, cast(sum(item_count) as bigint) as n_items from {HISTORY} group by mode")


_parse()
_confidence()
_history()
_evaluate()
_sources()
_streams()
