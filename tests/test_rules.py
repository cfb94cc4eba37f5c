"""Literal cases of single rules."""

import pytest

from clausework.operators import clauses, confidence, evaluate, findings, parse, quality, redact
from clausework.plans import fixtures


def entities(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = redact.redact_documents(docs).first()
    return [(e.entity_type, e.original_text) for e in row.entities], row.redacted_text


@pytest.mark.parametrize("text", ["2024-2025", "1234-5678", "call 12345678901234567890 now"])
def test_no_phone(spark, text):
    assert not [e for e in entities(spark, text)[0] if e[0] == "PHONE"]


@pytest.mark.parametrize("phone", ["555-123-4567", "(555) 123-4567", "+1 555 123 4567", "555.123.4567"])
def test_phone(spark, phone):
    found, text = entities(spark, f"reach us at {phone} today")
    assert ("PHONE", phone) in found and "[REDACTED_PHONE]" in text


def test_labelled_and_unlabelled_numbers(spark):
    assert ("ID_NUMBER", "123-45-6789") in entities(spark, "123-45-6789")[0]
    assert not entities(spark, "Order ABC123456 shipped")[0]


def test_leadin_is_not_redacted(spark):
    found, text = entities(spark, "Contact Jane Smith soon")
    assert found == [("PERSON", "Jane Smith")] and text == "Contact [REDACTED_PERSON] soon"


def test_repeated_person_keeps_one_type(spark):
    found, _ = entities(spark, "This Agreement between Jane Smith and Acme Corp. Separately, Jane Smith is a consultant.")
    assert {t for t, name in found if name == "Jane Smith"} == {"PERSON"}


def test_redaction_is_idempotent(spark):
    once = entities(spark, "mail a.b@example.com, born 01/02/1990, pay $500")[1]
    assert entities(spark, once)[1] == once


def test_quality_of_blank_and_noise(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "@@## T3XT %%% w0rd !!! $$$ 1nput ### &&& *** x9x9x9"), (4, "the agreement and the parties shall give notice to each other")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess_quality(docs).collect()}
    assert got[1].quality_score == got[2].quality_score == 0 and got[3].is_degraded and got[3].quality_score <= 0.20 and got[4].quality_label == "HIGH"


SURVIVES = "5. Survival\nThe duty of confidentiality shall survive termination for five (5) years."
ENDS = "6. End\nOn termination all duties shall immediately cease, confidentiality included."
FIELDS = "doc_id long, issue_no int, issue_title string, severity string, category string, location string, quoted_text string, risk_explanation string, suggested_improvement string"


def issue(spark, title="T", severity="HIGH", category="Liability", quote="", why="", advice=""):
    return spark.createDataFrame([(1, 1, title, severity, category, "here", quote, why, advice)], FIELDS)


def contract(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_clause_split(spark):
    texts = [f"Title\n\n{SURVIVES}\n\n{ENDS}\n", f"Title\n{SURVIVES}\n{ENDS}", "one block only", None, f"{SURVIVES}\n\nnothing that ends", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in clauses.split_clauses(docs).orderBy("doc_id", "clause_no").collect():
        got.setdefault(r.doc_id, []).append(r.clause)
    flat = lambda t: t.replace("\n", " ")
    assert got == {0: ["Title", SURVIVES, ENDS], 1: ["Title", flat(SURVIVES), flat(ENDS)], 2: ["one block only"], 4: [f"{SURVIVES}\n\nnothing that ends"]}
    found = {r.doc_id: r.conflicts for r in clauses.document_conflicts(docs).collect()}
    assert "confidential" in found[0] and "confidential" in found[1] and not any(found[k] for k in (2, 3, 4, 5))


def test_conflict_of_a_document_without_findings_makes_one(spark):
    docs = contract(spark, f"{SURVIVES}\n\n{ENDS}")
    none = issue(spark).where("false")
    (made,) = clauses.elevate_contradictions(none, docs).collect()
    assert (made.issue_no, made.category, made.severity) == (1, "Structural Inconsistency", "MEDIUM") and made.quoted_text == f"{SURVIVES} | {ENDS}"
    (raised,) = clauses.elevate_contradictions(issue(spark, category="Confidentiality", quote="confidential"), docs).collect()
    assert (raised.category, raised.original_category, raised.contradiction_detected) == ("Structural Inconsistency", "Confidentiality", True)
    (kept,) = clauses.elevate_contradictions(issue(spark, category="Indemnification", quote="confidential"), docs).collect()
    assert (kept.category, kept.contradiction_detected) == ("Indemnification", False)


@pytest.mark.parametrize(
    "fields, expected",
    [
        (dict(quote=SURVIVES, why="no survival clause"), "semantic_mismatch"),
        (dict(quote=SURVIVES, why="the provision is missing"), "semantic_mismatch"),
        (dict(quote=SURVIVES, why="it does not specify a duration"), None),
        (dict(quote=SURVIVES, why="The duration is too short."), None),
        (dict(quote=SURVIVES, category="Missing Survival Clause"), "survival_category_mismatch"),
        (dict(quote="lasts three (3) years", why="survives indefinitely"), "finite_duration_contradiction"),
        (dict(quote="lasts 2 years", title="Perpetual duty"), "finite_duration_contradiction"),
        (dict(quote="lasts for ever", title="Perpetual duty"), None),
        (dict(severity="LOW", why="This is commercially reasonable."), "self_negating"),
        (dict(severity="HIGH", why="This is commercially reasonable."), None),
        (dict(severity="MEDIUM / LOW", why="not a risk"), "self_negating"),
    ],
)
def test_contradiction_types(spark, fields, expected):
    assert clauses.contradiction_types(issue(spark, **fields)).first().contradiction_type == expected


@pytest.mark.parametrize(
    "text, titles",
    [
        ("Warranty\nTHE SERVICE IS PROVIDED AS IS.\nThere are no warranties.", ["AS-IS No Warranty Provision"]),
        ("The service is provided as is.", []),
        ("There are no warranties.", []),
        ("Vendor may terminate at any time.\nClient may terminate only for material breach.", ["Asymmetric Termination Rights"]),
        ("Either party may terminate at any time.", []),
        ("Upon a change of control the options immediately accelerate.", ["Single-Trigger Change of Control Acceleration"]),
        ("On a change of control options accelerate only if terminated.", []),
        (None, []),
    ],
)
def test_document_rules(spark, text, titles):
    assert [r.issue_title for r in clauses.verify_clauses(contract(spark, text)).collect()] == titles


def test_document_rule_quotes_its_lines(spark):
    (row,) = clauses.verify_clauses(contract(spark, "a\n\n  b \nWarranty: as is\n no warranties \nc\nd\ne")).collect()
    assert row.quoted_text == "b Warranty: as is no warranties c" and row.category == "Enforceability Weakness"


@pytest.mark.parametrize(
    "title, category, quote, expected",
    [
        ("Single-Trigger Change of Control Acceleration", "X", "neither party shall solicit staff", "Non-Solicitation Clause in NDA"),
        ("Single-Trigger Change of Control Acceleration", "X", "on a change of control, the solicit duty", None),
        ("Single-Trigger Change of Control Acceleration", "X", "for eighteen (18) months shall not compete", "Excessive Non-Compete Duration"),
        ("Single-Trigger Change of Control Acceleration", "X", "for six (6) months shall not compete", None),
        ("Non-Competition", "X", "for 12 months", "Excessive Non-Compete Duration"),
        ("Non-Competition", "X", "for 6 months", None),
        ("Intellectual Property Ownership", "Intellectual Property", "Consultant shall retain all", "Consultant Retains All Deliverable IP"),
        ("Intellectual Property Ownership", "Other", "Consultant shall retain all", None),
    ],
)
def test_titles(spark, title, category, quote, expected):
    assert findings.rewrite_titles(issue(spark, title, category=category, quote=quote)).first().new_title == (expected or title)


BALANCED = "Each party indemnifies the other; liability is capped at fees; neither is liable for consequential damages"


@pytest.mark.parametrize(
    "quote, balanced",
    [(BALANCED, True), ("Each party indemnifies the other and is capped at fees", False), ("Both parties indemnify; excludes indirect damages", False), ("mutual indemnity; maximum liability; no liability for indirect loss", True), ("mutual indemnitation; liability cap; no liability for indirect loss", True), ("mutual indemnity", False)],
)
def test_balanced_needs_all_three(spark, quote, balanced):
    assert findings.balanced_indemnity_flags(issue(spark, quote=quote)).first().i_balanced is balanced


@pytest.mark.parametrize(
    "fields, expected",
    [
        (dict(quote="unlimited liability", severity="LOW"), "CRITICAL"), (dict(category="Governing Law", severity="LOW"), "HIGH"), (dict(category="Residuals Clause", severity="LOW"), "HIGH"),
        (dict(quote=BALANCED, severity="HIGH"), "LOW"), (dict(quote="damages limited to fees, excluding any indirect loss", severity="CRITICAL"), "MEDIUM"), (dict(quote="limited to fees", severity="HIGH"), "HIGH"), (dict(severity="odd"), "odd"),
    ],
)
def test_severity(spark, fields, expected):
    assert findings.override_severity(issue(spark, **fields)).first().new_severity == expected


@pytest.mark.parametrize(
    "category, why, expected",
    [("Uncapped Liability", "", "Indemnification"), ("Liability Exposure", "they indemnify us", "Indemnification"), ("Liability Exposure", "conflicting clauses", "Liability Exposure"), ("Residuals Risk", "", "Residuals"), ("Termination", "conflicting clauses", "Structural Inconsistency"), ("legal risk exposure", "", "Liability Exposure")],
)
def test_categories(spark, category, why, expected):
    assert findings.remap_category(issue(spark, category=category, why=why)).first().new_category == expected


def suppressed_by(spark, text, **fields):
    return findings.suppressed(issue(spark, **fields), contract(spark, text)).first().suppressed_by


ALL_FOUR = "Excluded is what is publicly known, in prior possession, independently developed or received from a third party. " + "x" * 100


@pytest.mark.parametrize(
    "text, fields, expected",
    [
        ("plain sale of goods", dict(title="No SLA", quote="no sla here"), "n8"), ("a cloud platform with uptime", dict(title="No SLA", quote="the sla"), "n8"), ("a cloud platform as is", dict(title="No SLA", quote="the sla"), None),
        ("a cloud platform", dict(title="No SLA", quote="the sla"), None), ("", dict(title="No SLA", quote="the sla"), None),
        (ALL_FOUR, dict(title="Incomplete Confidentiality Exclusions", quote="confidential exclusions"), "n9"), (ALL_FOUR.replace("independently", "jointly"), dict(title="Incomplete Confidentiality Exclusions", quote="confidential exclusions"), None),
        ("1. Exclusions\nnone", dict(title="Incomplete Confidentiality Exclusions", quote="shall hold confidential"), "n9b"),
        ("t", dict(title="Excessive Non-Compete Duration", quote="compete for six (6) months"), "n10"), ("t", dict(title="Excessive Non-Compete Duration", quote="compete for 12 months"), None),
        ("t", dict(title="Overbroad Invention Assignment", quote="invention that one develops entirely on his\nor her own time"), "n11"), ("t", dict(title="Governing Law Risk", quote="all warranties disclaimed"), "n12"),
        ("t", dict(title="Excessive Non-Compete Duration", quote="TOTAL LIABILITY SHALL NOT EXCEED THE FEES"), "n12"), ("t", dict(title="Termination Risk", quote="anything"), None), ("t", dict(title="x", quote=BALANCED), "n7"),
    ],
)
def test_suppression(spark, text, fields, expected):
    assert suppressed_by(spark, text, **fields) == expected


def test_asymmetry_by_whole_words_and_by_stems(spark):
    text = "The customer shall hold harmless the vendor. The vendor shall not indemnify."
    levels = lambda title, strict: findings.document_levels(issue(spark, title, "CRITICAL", "Other"), contract(spark, text), strict).first()
    assert levels("Indemnification gap", True).c17 == "Other" and levels("Indemn gap", True).c17 == "Negotiation Imbalance"
    row = levels("Indemnification gap", False)
    assert (row.c17, row.s17) == ("Other", "CRITICAL") or row.c17 == "Negotiation Imbalance"


def test_document_levels(spark):
    text = "Each party indemnifies the other. Liability is capped at fees, excluding any indirect damages."
    row = findings.document_levels(issue(spark, category="Indemnification", severity="MEDIUM", quote="Each party indemnifies the other"), contract(spark, text)).first()
    assert (row.s14, row.s16) == ("LOW", "LOW")
    nda = "Confidential information does not include public facts. The term is two years. Recipient shall return all confidential information."
    assert findings.document_levels(issue(spark, category="Confidentiality Risk"), contract(spark, nda)).first().s15 == "LOW"


def test_advice(spark):
    told = lambda **f: findings.refine_improvement(issue(spark, **f)).first().new_improvement
    assert told(category="Governing Law", advice="") == "Clarify dispute resolution procedures including arbitration rules if applicable"
    assert told(category="Indemnification", quote="uncapped; hold harmless", advice="Review.") == (
        "Cap liability at a defined monetary amount, Limit indemnity obligations to third-party claims only, and Define a clear aggregate cap on total indemnification exposure"
    )
    assert told(category="Indemnification", advice="Agree an aggregate cap on it all") == "Agree an aggregate cap on it all" and told(category="Odd", advice="x") == "x"


@pytest.mark.parametrize(
    "text, expected",
    [("Chapter one: define the theorem, in this textbook?", "Educational Material"), ("Homework: answer each question of the task", "Questions or Assignments"), ("Notes: a summary and overview", "General Text or Notes"), ("Dear all, the meeting notes and action items. Thanks", "Non-Contract Communication"), ("zzz", "Uncategorized Non-Legal"), (None, "Uncategorized Non-Legal")],
)
def test_content_types(spark, text, expected):
    from clausework.operators import classify

    assert classify.non_legal_content_type(contract(spark, text)).first().content_type == expected


def test_risk_levels_and_key_findings(spark):
    from clausework.operators import results

    rows = [(1, 1, "A", "HIGH", "Law", False), (1, 2, "B", "LOW", "Law", False), (2, 1, "A", "HIGH", "Law", False), (3, 1, "A", "LOW", "Data Use", True), (4, 1, "A found", "CRITICAL", "Data", True), (5, 1, "A", "MEDIUM", "Fees", True)]
    found = spark.createDataFrame(rows, "doc_id long, issue_no int, issue_title string, severity string, category string, contradiction_detected boolean")
    scores = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.9), (4, 0.1), (5, 0.9), (6, None)], "doc_id long, score double")
    risk = results.risk_level(found, scores)
    assert {r.doc_id: r.risk_level for r in risk.collect()} == {1: "HIGH_RISK", 2: "MODERATE_RISK", 3: "MODERATE_RISK", 4: "HIGH_RISK", 5: "HIGH_RISK", 6: "SAFE"}
    got = {r.doc_id: (r.summary, r.key_findings) for r in results.document_summary(found, risk).collect()}
    assert got[1] == ("High-risk law and other critical concerns detected.", "A detected; Multiple law issues found") and got[6] == ("No compliance issues detected in this document.", "")
    assert got[4][1] == "Contradictory data clauses found; A found" and got[3][0] == "Data Use concerns found. Review recommended before signing."


def test_kernel_equals_single_steps(spark, sf_dir):
    from clausework.plans import fixtures

    docs = fixtures.letters(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, [tuple(e.asDict().get(k) for k in ("start", "end", "entity_type", "original_text", "confidence")) for e in r.entities]) for r in df.select("doc_id", "entities").collect())
    assert key(redact.detect_entities(docs)) == key(redact.stepwise_entities(docs))


def test_redactions_equal_brute_force(spark, sf_dir):
    from clausework.plans import fixtures

    for r in redact.redact_documents(fixtures.letters(spark, sf_dir)).collect():
        text = r.text
        for e in sorted(r.entities, key=lambda e: -e.start):
            text = text[: e.start] + f"[REDACTED_{e.entity_type}]" + text[e.end :]
        assert text == r.redacted_text


def test_previews_by_place_and_stats(spark):
    docs = redact.detect_entities(contract(spark, "mail a@b.org, c@d.org, $5"))
    active = spark.createDataFrame([(1, 1)], "doc_id long, position int")
    row = redact.preview_redactions(docs, active).first()
    assert (row.preview, row.n_total, row.n_active) == ("mail a@b.org, [REDACTED_EMAIL], $5", 3, 1)
    assert {(r.entity_type, r.n_entities, r.n_active) for r in redact.entity_stats(docs, ("MONEY",)).collect()} == {("EMAIL", 2, 0), ("MONEY", 1, 1)}
    assert {(r.entity_type, tuple(r.positions)) for r in redact.entity_positions(docs).collect()} == {("EMAIL", (0, 1)), ("MONEY", (2,))}


def test_leadin_before_a_line_break(spark):
    found, text = entities(spark, "Dear\nPeter Parker, hi")
    assert found == [("PERSON", "Peter Parker")] and text == "Dear\n[REDACTED_PERSON], hi"


def test_many_candidates_take_near_linear_time(spark):
    text = " ".join(f"a{k}@b.org Jane Smith" for k in range(20000))
    found, _ = entities(spark, text)
    assert len(found) == 40000


@pytest.mark.parametrize("tp, fp, fn, rate, expected", [(10, 6, 0, 0.9, 88.00), (7, 6, 3, 0.9, 75.88), (9, 7, 1, 1.0, 84.17), (6, 5, 4, 0.9, 72.33), (2, 8, 8, 1.0, 44.00)])
def test_published_composites(spark, tp, fp, fn, rate, expected):
    docs = spark.createDataFrame([(tp if k == 0 else 0, fp if k == 0 else 0, fn if k == 0 else 0, k < rate * 10) for k in range(10)], "tp int, fp int, fn int, parse_ok boolean")
    assert evaluate.corpus_metrics(docs).first().composite == pytest.approx(expected, abs=0.011)


def test_parse_cascade(spark):
    texts = ['[{"Issue Title": "A", "severity": "HIGH"}]', '```json\n{"issues": [{"issue_title": "B",}]}\n```', '{"issues": [{"title": "C"', "Issue: D\nSeverity: LOW", "nothing here", None, "", '{"title": "E"}']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, response_text string")
    got = {r.doc_id: (r.issue_title, r.parse_method) for r in parse.parse_issues(df).collect()}
    assert got == {0: ("A", "strict"), 1: ("B", "repaired"), 2: ("C", "repaired"), 3: ("D", "labeled"), 7: ("E", "strict")}


def test_advisory_refusal_is_capped(spark):
    df = spark.createDataFrame([(1, "I cannot help with that."), (2, "I cannot be certain, but the clause is likely enforceable and you should review the contract, liability and termination terms."), (3, None)], "id long, text string")
    got = {r.id: r.score for r in confidence.advisory_confidence(df).collect()}
    assert got[1] <= 0.40 < got[2]


def test_suppression_is_idempotent(spark, sf_dir):
    from clausework.plans import fixtures

    issues, docs = fixtures.issues(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = issues.join(findings.suppress_ice(issues, docs), ["doc_id", "issue_no"])
    assert findings.suppress_ice(once, docs).count() == once.count()


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 4.0)], "x double, y double")
    p = df.toPandas()
    assert evaluate.spearman(df, "x", "y").first().rho == pytest.approx(p["x"].rank().corr(p["y"].rank()))
    assert evaluate.spearman(df.withColumn("y", df["y"] * 0), "x", "y").first().rho == 0


@pytest.mark.parametrize("block", [50_000, 7])
def test_kendall_equals_all_pairs(spark, block):
    import itertools
    import random

    r = random.Random(3)
    rows = [(r.randrange(40) / 7, r.random() if k % 2 else r.randrange(5) / 3) for k in range(300)]
    c = sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in itertools.combinations(rows, 2))
    d = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in itertools.combinations(rows, 2))
    row = evaluate.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y", block=block).first()
    assert (row.concordant, row.discordant) == (c, d) and row.tau == pytest.approx((c - d) / (c + d))
    assert evaluate.kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first().tau == 0


def test_word_lists_are_whole():
    from clausework.functions import vocab

    assert {"abatement", "affidavit", "appellate", "apportionment"} <= set(vocab.LEGAL_WORDS) and "warrantion" not in vocab.LEGAL_WORDS
    assert {"admissions", "accreditation", "accommodation"} <= set(vocab.POLICY_WORDS)
    sizes = {"DICTIONARY": 470, "LEGAL_WORDS": 511, "LEGAL_PHRASES": 234, "POLICY_WORDS": 353, "CONTRACT_SIGNALS": 66, "CONTRACT_STRUCTURE": 26, "POLICY_STRUCTURE": 18}
    assert {k: len(set(getattr(vocab, k))) for k in sizes} == sizes


def test_policy_of_admissions_scores(spark):
    from clausework.operators import classify

    (row,) = classify.keyword_score(spark.createDataFrame([(1, "admissions accreditation accommodation xyz")], "doc_id long, text string")).collect()
    assert row.term_score == 0.75 and row.term_matched == "accommodation|accreditation|admissions"


def test_own_entities(spark):
    rules = redact.with_entity("CASE_NO", r"\bCASE-\d{4}\b", 0.95, before="ID_NUMBER")
    assert list(rules).index("CASE_NO") == list(rules).index("ID_NUMBER") - 1 and "CASE_NO" not in redact.ENTITY_PATTERNS
    docs = spark.createDataFrame([(1, "See CASE-12345678 or CASE-1234, mail a@b.co.")], "doc_id long, text string")
    (row,) = redact.redact_documents(docs, rules=rules).collect()
    assert row.redacted_text == "See CASE-[REDACTED_PHONE] or [REDACTED_CASE_NO], mail [REDACTED_EMAIL]."
    stricter = redact.with_entity("EMAIL", r"never", 0.5)
    assert list(stricter) == list(redact.ENTITY_PATTERNS)
    assert "a@b.co" in redact.redact_documents(docs, rules=stricter).first().redacted_text


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ranks_in_parts(spark, block):
    values = [(g, (k * 7) % 13 if g else 5) for g in (0, 1) for k in range(40)]
    df = spark.createDataFrame(values, "g long, x long")
    got = {(r.g, r.x): r.rank_x for r in evaluate._ranks(df, "x", ["g"], block).collect()}
    for g, x in set(values):
        own = [v for h, v in values if h == g]
        assert got[g, x] == sum(v < x for v in own) + (own.count(x) + 1) / 2
    alone = {r.x: r.rank_x for r in evaluate._ranks(df, "x", [], block).collect()}
    assert alone[5] == sum(v < 5 for _, v in values) + (sum(v == 5 for _, v in values) + 1) / 2


def test_gates_of_missing_results(spark):
    results = spark.createDataFrame([(1, "HIGH", 0.9, "audit", False, None)], "doc_id long, confidence_label string, confidence_score double, response_type string, parse_failed boolean, quality_warning string")
    issues = spark.createDataFrame([(1, "T", "Indemnification")], "doc_id long, issue_title string, category string")
    gates = spark.createDataFrame([("a", 1, "label_is", "HIGH", None), ("a", 1, "requires_category", "indemn", None), ("a", 1, "at_least_findings", None, 1.0), ("b", 2, "parsed", None, None)], "case_name string, doc_id long, kind string, words string, bound double")
    got = {r.case_name: (r.passed, r.reasons) for r in evaluate.run_gates(evaluate.result_rows(results, issues), gates).collect()}
    assert got == {"a": (True, ""), "b": (False, "no result")}


def test_pages_reached_by_the_cut(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 30), (1, 2, "b" * 30), (1, 3, "c"), (2, 1, None), (3, 1, "x" * 40), (3, 2, "")], "doc_id long, page_no long, text string")
    got = {r.doc_id: (r.n_pages, r.pages_seen, r.kept_chars, r.dropped_chars) for r in quality.pages_in_budget(pages, prompt_chars=0, context=10, reply=0).collect()}
    assert got == {1: (3, 2, 40, 21), 2: (1, 1, 0, 0), 3: (2, 2, 40, 0)}


def test_rules_of_clauses_look_for_cues_first(spark):
    """Every pattern of a clause's signs has cues, so that most clauses are spared it, and both ways give the same."""
    from clausework.functions.dialect import SPARK, cues

    patterns = {"is_survival": clauses.SURVIVAL, "is_termination": clauses.TERMINATION, "is_finite": clauses.FINITE, "is_perpetual": clauses.PERPETUAL, "is_insufficient": clauses.TOO_SHORT}
    assert all(cues(p) for p in patterns.values())
    texts = (
        "Duties SHALL Survive.", "All terms\tof it survive", "they shall not  continue", "no LONGER bound", "Three (3) Years", "lasts for 2 years", "in  Perpetuity", "Without\nlimit", "the time  frame is too brev", "LACKS any end  date",
        "stated EndDate", "period missing", "permanent duty", "end date provided", "no end to obligations", "continues forever", "", "plain words of a year", "the period is long",
    )
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, clause_no int, clause string")
    plain = rows.selectExpr("doc_id", "clause_no", *[f"{SPARK.has('clause', p)} as {n}" for n, p in patterns.items()])
    assert sorted(clauses.clause_flags(rows).collect()) == sorted(plain.collect())
    assert plain.selectExpr(*[f"count_if({n})" for n in patterns]).first() == (2, 2, 2, 2, 8)


def test_previews_find_entities_once(spark, sf_dir):
    """The chosen entities and the previews come from entities that were written once, not from two searches."""
    from clausework.plans.queries import QUERIES

    out = QUERIES["r9_preview_redactions"](spark, sf_dir)
    assert "EvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    docs = redact.detect_entities(fixtures.letters(spark, sf_dir)).selectExpr("doc_id", "size(entities) as n_total", "size(entities) div 2 as n_active")
    assert sorted(out.select("doc_id", "n_total", "n_active").collect()) == sorted(docs.collect())
