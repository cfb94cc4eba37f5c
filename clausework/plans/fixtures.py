"""Findings, ground truth, runs, responses and history derived from the given tables, in Spark and in DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions.dialect import DUCK, SPARK, Layer, SparkSql, layers_sql, with_layers

TITLES = (
    "No SLA", "Incomplete Confidentiality Exclusions", "Excessive Non-Compete Duration", "Overbroad Invention Assignment", "Uncapped Liability", "Governing Law Risk", "One-sided Indemn Duty",
    "Perpetual Survival", "Non-Competition", "Single-Trigger Change of Control Acceleration", "Intellectual Property Ownership", "Mutual Indemnification", "Residuals Clause",
)
CATEGORIES = (
    "liability exposure", "Confidentiality", "Intellectual Property", "Confidentiality Termination", "Indemnification", "Governing Law Risk", "", "Enforceability Weakness", "Residuals Risk",
    "Negotiation Imbalance", "Uncapped Liability", "legal risk exposure", "missing survival clause", "Privacy Risk", "Conflicting Structure",
)
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL", "HIGH", "medium")
QUOTES = (
    "Each party shall defend and indemnifies the other; capped at the fees paid, and excludes consequential damages.",
    "The employee shall not compete: non-compete for 6 months after leaving.",
    "The receiving party shall hold all information in confidence; this obligation shall survive termination for 3 years.",
    "All confidentiality obligations shall immediately cease on termination.",
    "Vendor shall indemnify customer with unlimited liability.",
    "Except an invention that the employee develops entirely on his or her own time.",
    "The service is provided as is, at the sole discretion of the provider.",
    "Uptime is not guaranteed and no service level applies.",
    "Employee shall not solicit staff for twelve (12) months.",
    "Consultant shall retain all deliverables.",
    "Each party indemnifies the other for third-party claims.",
    "The restriction on competing lasts 18 months and bars compete activity.",
    "Liability is limited to fees paid, excluding any indirect damages, and the vendor shall hold harmless and indemnify.",
)
EXPLANATIONS = (
    "Unlimited liability could be catastrophic; substantial risk.", "The obligation is indefinite and perpetual.", "The clause is commercially reasonable and not a risk.", "The clause is missing and obligations terminate.",
    "The duration is too short.", "Conflicting clauses leave no cap on uncapped exposure.", "", "Termination is immediate and without cause; any loss is covered.",
)
ADVICE = ("Cap the liability at 12 months of fees under an aggregate cap.", "Clarify this clause.", "", "Review the whole of this provision with outside counsel soon.", "Add unlimited notice for termination rights.")
#: Sections that are put behind texts, so that document rules fire: each is a list of paragraphs.
SECTIONS = (
    ("1. Survival\nThe confidentiality obligations shall survive termination for 3 years.", "2. End\nAll confidentiality obligations shall immediately cease on termination."),
    ("Section 4 Warranty\nTHE SERVICE IS PROVIDED AS IS.\nProvider makes no warranties of any kind.",),
    ("Provider may terminate this agreement at any time.\nCustomer may terminate only for material breach.",),
    ("Upon a change of control all unvested shares immediately accelerate.\nThe board decides.",),
    ("This SaaS subscription has an uptime of 99.5%.", "Each party indemnifies the other. Liability is capped at the fees paid. Neither is liable for any consequential damages."),
    ("The vendor disclaims service levels: no SLA applies to this cloud platform.",),
    ("Exclusions from confidential information: what is publicly available, in prior possession, independently developed, or received from a third party.", "The term of this agreement is two years.\nThe recipient shall return all confidential information."),
    ("The customer shall hold harmless the vendor. The vendor shall not indemnify the customer and there is no indemnification by the vendor.",),
    ("Section 1 Term\nThe obligations of each party shall survive.\nSection 2 Law\nThe governing law is that of the state.",),
    ("Shares vest upon a change of control only if the employment is terminated and then accelerate.",),
    (),
)


def _pick(q: SparkSql, index: str, values: Sequence[str]) -> str:
    return f"case ({index}) % {len(values)} " + " ".join(f"when {k} then {q.text(v)}" for k, v in enumerate(values)) + " end"


def issue_layers(q: SparkSql) -> list[Layer]:
    return [
        {
            "issue_title": _pick(q, "doc_id * 7 + issue_no * 3", TITLES), "severity": _pick(q, "doc_id * 5 + issue_no", SEVERITIES), "category": _pick(q, "doc_id * 3 + issue_no * 7", CATEGORIES),
            "location": "concat('Section ', cast(1 + (doc_id + issue_no) % 9 as varchar(10)))", "risk_explanation": _pick(q, "doc_id + issue_no * 5", EXPLANATIONS), "suggested_improvement": _pick(q, "doc_id * 2 + issue_no", ADVICE),
            "quoted_text": f"case when (doc_id + issue_no) % 5 = 0 then substr(text, cast(1 + doc_id % 40 as int), 60) when (doc_id + issue_no) % 11 = 0 then '' else {_pick(q, 'doc_id * 11 + cast(issue_no / 2 as int)', QUOTES)} end",
        }
    ]


ISSUES = ("doc_id", "issue_no", "issue_title", "severity", "category", "location", "quoted_text", "risk_explanation", "suggested_improvement")
#: Some findings are marked as contradictions where a query needs it.
CLASH = "(doc_id + issue_no) % 6 = 0 as contradiction_detected"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three findings for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 > 0")
    each = docs.withColumn("issue_no", F.explode(F.expr("sequence(1, cast(doc_id % 4 as int))")))
    return with_layers(each, issue_layers(SPARK)).select(*ISSUES)


def issues_sql() -> str:
    base = "(select *, cast(unnest(generate_series(1, doc_id % 4)) as int) as issue_no from documents where doc_id % 4 > 0)"
    # halves are cut, not rounded, in both engines
    layers = [{k: v.replace("cast(issue_no / 2 as int)", "(issue_no // 2)") for k, v in layer.items()} for layer in issue_layers(DUCK)]
    return f"(select {', '.join(ISSUES)} from {layers_sql(base, layers)})"


#: Titles that fit the quotes, one for each.
FITTING = (
    "Mutual Indemnification", "Excessive Non-Compete Duration", "Incomplete Confidentiality Exclusions", "Confidentiality Termination", "Unlimited Liability Indemnity", "Overbroad Invention Assignment",
    "Sole Discretion Service", "Uptime Service Level", "Solicitation of Staff", "Consultant Deliverables", "Mutual Indemnification", "Non-Competition", "Liability Indemnity",
)


def _fitting(q: SparkSql) -> tuple[str, ...]:
    half = "floor(issue_no / 2)" if q is SPARK else "(issue_no // 2)"
    title = f"case when doc_id % 3 > 0 then {_pick(q, f'doc_id * 11 + cast({half} as int)', FITTING)} else issue_title end as issue_title"
    return tuple(title if c == "issue_title" else c for c in ISSUES)


def fitting_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings, two thirds of them with titles that fit their quotes."""
    return issues(spark, sf_dir).selectExpr(*_fitting(SPARK))


def fitting_issues_sql() -> str:
    return f"(select {', '.join(_fitting(DUCK))} from {issues_sql()})"


def contract_layers(q: SparkSql) -> list[Layer]:
    """Each text with one of the sections behind it, after a blank line."""
    bodies = [q.join(q.array([q.text("")] + [q.text(p) for p in parts]), "\n\n") if parts else "''" for parts in SECTIONS]
    return [{"contract": f"concat(coalesce(text, ''), case doc_id % {len(SECTIONS)} " + " ".join(f"when {k} then {b}" for k, b in enumerate(bodies)) + " end)"}]


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a contract section behind their text: doc_id, text."""
    return with_layers(spark.read.parquet(f"{sf_dir}/documents.parquet"), contract_layers(SPARK)).selectExpr("doc_id", "contract as text")


#: Sentences with entities of all types, put behind texts.
LETTERS = (
    "Contact Jane Smith at jane.smith@example.com or +1 555 123 4567.", "This Agreement between Jane Smith and Acme Corp. Separately, Jane Smith is a consultant.", "Pay $1,200.50 to Blue River Holdings by 01/02/2024.",
    "He lives at 12 Old Mill Road near New York. Order ABC123456 shipped, license A12345678.", "SSN 123-45-6789, call 1234-5678 in 2024-2025. The Governing Law of England applies to Mary Ann Jones.",
    "Dear\nPeter Parker, whereas Effective Date is March 3, 2021, Peter Parker agrees.", "Confidential Party met Confidential Party hereby.", "Hello Maria Garcia of Garcia Services LLC, Austin, Texas. Maria Garcia signs.",
)


def letter_layers(q: SparkSql) -> list[Layer]:
    return [{"letter": "concat(coalesce(text, ''), ' ', " + _pick(q, "doc_id", LETTERS) + ")"}]


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a sentence of entities behind their text: doc_id, text."""
    return with_layers(spark.read.parquet(f"{sf_dir}/documents.parquet"), letter_layers(SPARK)).selectExpr("doc_id", "letter as text")


def letters_sql() -> str:
    return f"(select doc_id, letter as text from {layers_sql('documents', letter_layers(DUCK))})"


def contracts_sql() -> str:
    return f"(select doc_id, contract as text from {layers_sql('documents', contract_layers(DUCK))})"


def _truth(q: SparkSql) -> tuple[str, ...]:
    none = q.keep(q.array(["''"]), "x", "x <> ''")
    changed = "(doc_id + issue_no) % 3 = 0"
    return (
        "doc_id", "issue_no as gt_no", "case when doc_id % 2 = 0 then issue_title else concat('Missing ', issue_title) end as expected_title",
        f"case when {changed} then {q.array([q.text('LOW')])} else {q.array(['severity', q.text('critical')])} end as allowed_severities",
        f"case when (doc_id + 2 * issue_no) % 5 = 0 then {q.array([q.text('Other')])} else {q.array(['category', q.text('Payment')])} end as allowed_categories",
        f"case when doc_id % 7 = 0 then {none} else {q.array(['left(trim(quoted_text), 12)', q.text('no such words')])} end as quote_patterns",
        f"case when doc_id % 5 = 0 then {q.array([q.text('Uptime')])} else {none} end as quote_not_patterns",
        f"case when doc_id % 6 = 1 then {q.array([q.text('Liability'), q.text('obligation'), q.text('clause')])} else {none} end as explanation_patterns",
        f"case when doc_id % 8 = 2 then {q.array([q.text('perpetual')])} else {none} end as explanation_not_patterns",
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected findings from ``issues``: some with other severities or categories, titles with a word more, patterns of all four kinds."""
    return issues(spark, sf_dir).selectExpr(*_truth(SPARK))


def truth_sql() -> str:
    return f"(select {', '.join(_truth(DUCK))} from {issues_sql()})"


_RUNS = (
    "concat('run', cast(run_no as varchar(10))) as run_id", "doc_id", "case doc_id % 3 when 0 then 'NDA' when 1 then 'EMP' else 'VEN' end as doc_type", "((doc_id * 3 + run_no) % 10) > 0 as parse_ok",
    "cast((doc_id + run_no) % 4 as int) as tp", "cast((doc_id * 3 + run_no) % 3 as int) as fp", "cast((doc_id * 5 + run_no) % 3 as int) as fn",
    "cast(((doc_id * 37 + run_no * 11) % 101) as double) / 100 as confidence_score", "quality = 1 as pass",
    "cast((doc_id + run_no) % 3 as double) / 2 as severity_accuracy", "cast((doc_id + run_no) % 4 as int) - cast((doc_id + run_no) % 4 as int) % 2 as n_exact", "cast((doc_id + run_no) % 4 as int) % 2 as n_partial",
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three evaluation runs over the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.withColumn("run_no", F.explode(F.expr("sequence(1, 3)"))).selectExpr(*_RUNS)


def runs_sql() -> str:
    return f"(select {', '.join(_RUNS)} from (select *, unnest([1, 2, 3]) as run_no from labels))"


def _history(q: SparkSql) -> tuple[str, ...]:
    kind = "case event_id % 3 when 0 then 'audit' when 1 then 'redaction' else 'advisory' end"
    return (
        "event_id as id", f"{kind} as record_type", "concat('file', cast(user_id % 50 as varchar(20)), '.pdf') as filename", "ts", "case event_id % 3 when 0 then 'AUDIT' when 1 then 'REDACTION' else 'ADVISORY' end as mode",
        "cast(event_id % 7 as int) as item_count", "case when event_id % 7 > 0 then 'HIGH' else 'LOW' end as severity_level", "case when event_id % 5 > 0 then cast((event_id * 13) % 101 as double) / 100 end as confidence", "event_type",
    )


HISTORY = ("id", "record_type", "filename", "ts", "mode", "item_count", "severity_level", "confidence", "event_type")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit, redaction and advisory records, one for each event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_history(SPARK))


def history_sql() -> str:
    return f"(select {', '.join(_history(DUCK))} from events)"


def _item(q: SparkSql) -> str:
    clean = "replace(replace(replace(quoted_text, chr(92), ' '), chr(34), ' '), chr(10), ' ')"
    return f"concat('{{\"Issue Title\": \"', issue_title, '\", \"severity\": \"', severity, '\", \"quotedText\": \"', {clean}, '\"}}')"


_LABELLED = "concat('Issue: ', issue_title, chr(10), 'Severity: ', severity, chr(10), 'Quoted Text: ', replace(quoted_text, chr(10), ' '))"
#: Kinds of response around a document's findings, by doc_id: how its text is made, and how it is read ('' where it holds no finding).
RESPONSE_KINDS = (
    ("concat('[', items, ']')", "strict"),
    ("concat('{\"issues\": [', items, ']}')", "strict"),
    ("concat('```json', chr(10), '{\"issues\": [', items, ',]}', chr(10), '```')", "repaired"),
    ("concat('{\"issues\": [', items, ', {\"Issue Ti')", "repaired"),
    ("labelled", "labeled"),
    ("concat('Here are the findings:', chr(10), '[', items, ']')", "strict"),
    ("concat('Sure, see [1]:', chr(10), '```json', chr(10), '{\"issues\": [', items, ']}', chr(10), '```', chr(10), 'Done {a}.')", "strict"),
    ("'{\"error\": {\"code\": [429], \"note\": \"rate limit\"}}'", ""),
    ("concat('{\"note\": {\"n\": 1}} and then {\"result\": {\"issues\": [', items, ']}} as asked.')", "strict"),
    ("concat('[', replace(items, '\"severity\": \"', concat('\"severity\": \"', chr(10), chr(9))), ']')", "strict"),
    ("concat('[', items, ', {\"severity\": tru')", "truncated"),
    ("concat('A 5\" pipe: [', items, ' , ] and [so', chr(10), 'on')", "repaired"),
    ("'The contract looks [fine] to me.'", ""),
)
_RESPONSE = f"case doc_id % {len(RESPONSE_KINDS)} " + " ".join(f"when {k} then {text}" for k, (text, _) in enumerate(RESPONSE_KINDS)) + " end as response_text"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's response for each document, with all its findings in order."""
    each = issues(spark, sf_dir).selectExpr("doc_id", "issue_no", f"{_item(SPARK)} as item", f"{_LABELLED} as label")
    lists = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("issue_no", "item", "label"))).alias("f"))
    texts = lists.selectExpr("doc_id", "array_join(transform(f, x -> x.item), ', ') as items", "array_join(transform(f, x -> x.label), '\\n\\n') as labelled")
    return texts.selectExpr("doc_id", _RESPONSE)
