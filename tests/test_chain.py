"""The whole chain on single documents, its ledger, and verifiers of one's own."""

import pytest

from clausework.operators import chain, clauses

SURVIVES, ENDS = "1. Survival\nThe confidentiality obligations shall survive termination for 3 years.", "2. End\nAll confidentiality obligations shall immediately cease on termination."
FIELDS = "doc_id long, issue_no int, issue_title string, severity string, category string, location string, quoted_text string, risk_explanation string, suggested_improvement string"


def finding(doc_id, issue_no, title="Uncapped Liability", severity="low", category="Uncapped Liability", quote="liability is unlimited", why="", advice=""):
    return (doc_id, issue_no, title, severity, category, "", quote, why, advice)


WARRANTY = "3. Warranty\nTHE SERVICE IS PROVIDED AS IS.\nProvider makes no warranties of any kind."
PENALTY = clauses.section_verifier("late_fee", "Late Fee", "Payment", "HIGH", "Fees", "Fees grow.", "Cap the fee.", lines=r"(?i)late fee", confirm=[r"(?i)compound"], deny=[r"(?i)capped"], quoted_lines=1)
DOCS = [
    (1, "A text."), (2, f"{SURVIVES}\n\n{ENDS}\n\n{WARRANTY}"), (3, None), (4, ""), (5, "x"), (6, "x"), (8, "a\nA late fee will\ncompound daily."), (9, "A late fee may compound but is capped."),
]
ISSUES = [
    finding(1, 1), finding(1, 2, quote=' "Liability is  UNLIMITED" '),
    finding(5, 1, "Confidentiality Survival", category="Confidentiality", quote="Confidentiality obligations shall survive termination."),
    finding(5, 2, "Confidentiality Ends", category="Confidentiality", quote="All confidentiality obligations shall cease upon termination."),
    finding(6, 1, "Confidentiality Survival", category="survival clause missing", quote="Confidentiality obligations shall survive termination."),
    finding(7, 1),
]


@pytest.fixture(scope="module")
def rows(spark):
    docs, issues = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ISSUES, FIELDS)
    return chain.audit_chain(docs, issues, [*clauses.VERIFIERS, PENALTY]).cache()


def of(rows, doc_id):
    return sorted(rows.where(f"doc_id = {doc_id}").collect(), key=lambda r: r.issue_no)


def test_ledger_of_one_finding(rows):
    first, second = of(rows, 1)
    assert first.dropped_by is None and first.severity == "CRITICAL"
    assert [(e.stage, e.field, e.before, e.after) for e in first.ledger][0] == ("severity_normalized", "severity", "low", "CRITICAL")
    assert second.dropped_by == "quotes_deduplicated" and second.ledger[-1].field == "dropped"
    # each value follows from the one before it
    for r in (first, second):
        for field in ("severity", "category"):
            steps = [e for e in r.ledger if e.field == field]
            assert all(a.after == b.before for a, b in zip(steps, steps[1:], strict=False)) and (not steps or steps[-1].after == r[field])


def test_documents_without_findings_get_some(rows):
    got = of(chain.chain_findings(rows), 2)
    assert [(r.issue_no, r.issue_title, r.added_by, r.verifier) for r in got] == [
        (1, "Structural Inconsistency", "contradictions_elevated", None),
        (2, "AS-IS No Warranty Provision", "verifiers", "as_is_no_warranty"),
    ]
    assert all(r.risk_explanation and r.suggested_improvement and r.location for r in got)
    assert not of(rows, 3) and not of(rows, 4)


def test_findings_in_conflict_are_elevated_not_suppressed(rows):
    assert [(r.category, r.original_category, r.contradiction_detected) for r in of(rows, 5)] == [("Structural Inconsistency", "Confidentiality", True)] * 2
    assert [r.dropped_by for r in of(rows, 6)] == ["contradictions_suppressed"]


def test_findings_of_unknown_documents_stay(rows):
    assert [r.dropped_by for r in of(rows, 7)] == [None]


def test_trace_adds_up(rows):
    trace = chain.chain_trace(rows).orderBy("stage_no").collect()
    assert [r.stage for r in trace] == list(chain.STAGES) and trace[0].n_before == len(ISSUES)
    for a, b in zip(trace, trace[1:], strict=False):
        assert b.n_before == a.n_after
    assert all(r.n_after == r.n_before + r.n_added - r.n_dropped for r in trace)
    assert trace[-1].n_after == chain.chain_findings(rows).count()
    assert chain.stage_ledger(rows).where("field = 'dropped'").count() == sum(r.n_dropped for r in trace)


def test_own_verifiers(spark, rows):
    assert [(r.issue_title, r.severity, r.quoted_text, r.verifier) for r in of(rows, 8)] == [("Late Fee", "HIGH", "a", "late_fee")] and not of(rows, 9)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert clauses.verify_clauses(docs, [PENALTY]).count() == 1
    with pytest.raises(ValueError):
        clauses.verify_clauses(docs, [PENALTY, PENALTY])
