"""Cases that the small tables do not hold and larger ones do."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from clausework.functions import counts, vocab
from clausework.functions.dialect import spaced_cues
from clausework.operators import redact
from clausework.streaming import streams


def both(spark, folder, name, tables):
    """A query's rows and its SQL's over tables written under ``folder``."""
    c = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    ours = entry.queries()[name](spark, str(folder)).toPandas()
    theirs = c.execute(entry.oracle_sql()[name]).df()[list(ours.columns)]
    return [sorted(df.itertuples(index=False, name=None)) for df in (ours, theirs)]


@pytest.mark.parametrize(("answer", "kept"), [("Ment pas an ai queen.", True), ("Las an aiieraux.", True), ("\u00e9as an ai.", True), ("Well, as an AI I pass.", False), ("As\u000ba chatbot.", False), ("I'm a language model.", False)])
def test_session_history_drops_disclosures_only(spark, tmp_path, answer, kept):
    turns = spark.createDataFrame([(1, 1, "user", "Q"), (1, 2, "assistant", answer), (1, 3, "user", "R"), (1, 4, "assistant", "Fine.")], "conv_id long, turn long, role string, text string")
    ours, theirs = both(spark, tmp_path, "h16_session_history", {"conversations": turns})
    assert ours == theirs and ours[0][1] == 1 + kept


@pytest.mark.parametrize("name", ["r1_detect_candidates", "r1_candidate_counts", "r6_resolve_overlaps", "r7_reconcile_repeats", "r12_entity_stats", "r12_entity_positions"])
def test_spans_are_found_once(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_spared_search_gives_the_same_matches():
    bits = "Jan|feb |Sept.| march|12| 3,|2021|/|-|01| |\n| |ID|id|tin|Passport|license no.|#|ABCDE1234F|AB12|x|é|ı|ſep|İ|٣|$|€ |1,200.50|usd|(|555|)|+1|-4567|123-45-6789|Old Mill|Road|_|.|GSTIN|99999999".split("|")
    rnd = random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choices(bits, k=rnd.randint(1, 14)))
        compiled = [re.compile(p, flags) for p, flags, _ in redact.ENTITY_PATTERNS.values()]
        found = [[m.span() for m in hits] for hits in redact.matches(text, text.lower(), compiled)]
        assert found == [[m.span() for m in p.finditer(text)] for p in compiled]


def test_steps_of_redaction_are_not_copied(spark, sf_dir):
    plan = entry.queries()["r7_stepwise"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and len(plan) < 200_000


@pytest.mark.parametrize("name", ["route_by_lang", "t1_score_stream", "d5_classify_domain", "p3_detect_policy"])
def test_cues_of_outlines_are_found_in_one_pass(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(" not in plan and "lower(" not in plan


ODD_OUTLINES = [
    None, "", " \n ", "By \n\t and  Between A and B", "EMPLOYMENT\r\n CONTRACT", "x EMPLOYMENT CONTRACT", "I  \f think so", "alibi was", "\n  1.\n Scope", "wow!!! what??", "wow!!", "NON-COMPLIANCE", "failure  to comply",
    '"ABC  D"\nshall\tmean', "This policy sets\nout", "12. Terms", "Well,\n I", "aaa--- ***", "___ ...", "duties \n obligations", "the end.", "purpose\n:", "<!-- x -->\n", "non_disclosure deed", "\u0130n witness", "SHALL\nBE\nDEEMED",
]


@pytest.mark.parametrize("name", ["d2_structure_score", "d4_non_legal_penalty", "p3_detect_policy", "q2_repeat_and_burst_factors", "t1_score_stream"])
def test_outlines_with_odd_white_space(spark, tmp_path, name):
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(ODD_OUTLINES)], "doc_id long, text string, lang string, source string")
    ours, theirs = both(spark, tmp_path, name, {"documents": docs})
    assert str(ours) == str(theirs)


def test_each_outline_has_cues_over_white_space():
    assert spaced_cues(r"(?i)\bby\s+and\s+(?:be)?tween\b") == ("by and between", "by and tween")
    assert spaced_cues(r"(?i)\?{2,}|!{3,}") == ("!!!", "??") and spaced_cues(r"a\s*:") == ("a :", "a:") and not spaced_cues(r"(?m)^\s*\d+\.\s+[A-Z]")
    assert [p for p in vocab.OUTLINES if p not in counts.CUED] == [r"(?im)^\s*\d+\.\s+[A-Z]"]


def test_tokens_of_joined_texts_are_those_of_each():
    bits = [*"ab cdXZ019._-@#$%!*\u00e9\u00bd\u00b2\u2167\u0663\u017f\u212a\u0130\u4e2d\u4e00\u0301\x1c\x85\n\t ", "strng", "bcdfg", "o0o", "***", "...", "rhythms"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 20))) for _ in range(3000)]
    got = [r for lot in counts.in_lots(texts, 500) for r in counts.Signs(lot).token_counts({})]
    for text, row in zip(texts, got, strict=True):
        marks = [counts.token_marks(w) for w in text.split()]
        assert row[:4] == (len(marks), *(sum(m[k] for m in marks) for k in range(3))), text
        assert row[4] or not re.search(r"([^\w\s])\1\1", text)
        assert row[5] == bool(re.search(r"[!@#$%^&*+=~|\\<>?]{3,}", text))


def test_text_files_lie_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "work_folder", lambda s: str(tmp_path / "work"))
    turns = spark.createDataFrame([(k, t, role, f"{k}\n\u00e9 {t}") for k in range(300) for t, role in enumerate(("user", "assistant"))] + [(-7, 0, "user", None)], "conv_id long, turn long, role string, text string")
    ours, theirs = both(spark, tmp_path, "io1_read_text_corpus", {"conversations": turns})
    assert sorted(map(str, ours)) == sorted(map(str, theirs)) and len(ours) == 301
    files = list((tmp_path / "work").rglob("part-*.txt"))
    assert len(files) == 301 and len({f.parent for f in files}) <= 64


def test_text_file_without_a_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "work_folder", lambda s: str(tmp_path / "work"))
    spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = entry.queries()["io1_read_text_corpus"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(None, "User: x\n")]
