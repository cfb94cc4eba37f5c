"""Model responses: JSON in prose and fences, cut off, malformed, several of them."""

import json
import time

import pytest

from clausework.operators.parse import json_findings, parse_issues, repair_json

A = '{"issue_title": "A", "severity": "HIGH"}'
B = '{"issue_title": "B", "quoted_text": "say \\"x\\", [1] {2}"}'

CASES = [
    (f"Here are the findings:\n[{A}, {B}]", "strict", ["A", "B"]),
    (f"Sure:\n```json\n[{A},{B}]\n```\nDone.", "strict", ["A", "B"]),
    (f"Sure:\n```json\n[{A},{B},]\n```\nDone [1].", "repaired", ["A", "B"]),
    (f"```json\n[{A}, {B}\n```\nbye", "repaired", ["A", "B"]),
    (f'```json\n{{"issues": [{A}, {B}', "repaired", ["A", "B"]),
    (f"[{A}] and so on [1] {{x}}", "strict", ["A"]),
    (f'{{"note": 1}} then {{"issues": [{B}]}}', "strict", ["B"]),
    (f'{{"data": {{"issues": [{A}]}}}}', "strict", ["A"]),
    (f'{{"issues": [{{"foo": 1}}, {A}]}}', "strict", ["A"]),
    (f'Size 5" pipe: [{A}]', "strict", ["A"]),
    (f'He said "well [see: {A}', "strict", ["A"]),
    (f"See [section 1 for more: [{A}, {B}]", "strict", ["A", "B"]),
    (f"X [{A},{B} , ] Y", "repaired", ["A", "B"]),
    (f'{{"issues": [{A}, {{"issue_title": "C","risk_explanation": "some tex', "repaired", ["A", "C"]),
    (f'{{"issues": [{A}, {{"issue_title": "C","risk_expl', "repaired", ["A", "C"]),
    (f'{{"issues": [{A}, {{"issue_title": "C","risk":', "repaired", ["A", "C"]),
    ('[{"issue_title": "C\\', "repaired", ["C"]),
    (f'[{A}, {B}, {{"x": tru', "truncated", ["A", "B"]),
    ('[{"issue_title": "A\nB\tC\x01"}]', "strict", ["A\nB\tC\x01"]),
    ("Issue: foo\nSeverity: HIGH\n\nIssue: bar", "labeled", ["foo", "bar"]),
    ('{"issue": "first", "issue_title": "second"}', "strict", ["second"]),
    ('{"error": "rate limit"}', None, []),
    ('{"issues": []}', None, []),
    ('[{"foo": 1}]', None, []),
    ('{"issue_title": "  "}', None, []),
    ("[ ] {", None, []),
    ("", None, []),
    (None, None, []),
]


def test_findings_of_responses(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(CASES)], "doc_id long, response_text string")
    got = parse_issues(rows).select("doc_id", "issue_no", "issue_title", "parse_method").collect()
    for k, (text, method, titles) in enumerate(CASES):
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.issue_no)
        assert ([r.issue_title for r in own], {r.parse_method for r in own}) == (titles, {method} if titles else set()), text
        assert [r.issue_no for r in own] == list(range(1, len(titles) + 1))


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": "b', {"a": "b"}),
        ('{"a": 1, "b', {"a": 1, "b": ""}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('{"a": ["x", "y', {"a": ["x", "y"]}),
        ('well: {"a": "x,]"', {"a": "x,]"}),
        ('```json\n{"a": "x\ty\x02"}\n```', {"a": "x\ty\x02"}),
        ('{"a": {"b": [', {"a": {"b": []}}),
    ],
)
def test_repair(text, value):
    assert json.loads(repair_json(text)) == value


def test_no_bracket_no_repair():
    assert repair_json("nothing here") is None and repair_json("") is None


@pytest.mark.parametrize("part", ["[", "[{", '{"x" ', "[1,]", f"[{A[:-1]}, "])
def test_long_broken_texts_take_near_linear_time(part):
    start = time.process_time()
    json_findings(part * 20_000)
    assert time.process_time() - start < 20
