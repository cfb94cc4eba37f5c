"""Evaluation of findings against ground truth and of scores against outcomes (E-1 to E-19)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK, SparkSql, clamp


def normalized(q: SparkSql, c: str) -> str:
    return f"trim({q.replace(f'lower(coalesce({c}, {chr(39) * 2}))', r'[ \t\n\r]+', ' ')})"


def _any(q: SparkSql, patterns: str, text: str) -> str:
    return q.some(f"coalesce({patterns}, {q.keep(q.array([q.text('')]), 'p', 'false')})", "p", q.contains(text, "lower(p)"))


def match_condition(q: SparkSql) -> str:
    """Category and severity are allowed; the quote and the explanation hold one of their patterns, where there are any, and no forbidden one."""
    quote, why = normalized(q, "i.quoted_text"), normalized(q, "i.risk_explanation")
    needs = lambda patterns, text: f"({q.size(f'g.{patterns}')} = 0 or {_any(q, f'g.{patterns}', text)})"
    allowed = q.some("g.allowed_categories", "c", "lower(c) = lower(coalesce(i.category, ''))") + " and " + q.some("g.allowed_severities", "c", "upper(c) = upper(coalesce(i.severity, ''))")
    return f"{allowed} and {needs('quote_patterns', quote)} and {needs('explanation_patterns', why)} and not {_any(q, 'g.quote_not_patterns', quote)} and not {_any(q, 'g.explanation_not_patterns', why)}"


def match_findings(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """E-1: pairs of a finding and an expected one of its document that it satisfies.

    Truth rows hold allowed_categories, allowed_severities, quote_patterns, quote_not_patterns, explanation_patterns and
    explanation_not_patterns as arrays; an empty array of patterns asks for nothing.
    """
    i, g = issues.alias("i"), truth.alias("g")
    return i.join(g, F.expr(f"i.doc_id = g.doc_id and {match_condition(SPARK)}")).select("i.doc_id", "i.issue_no", "g.gt_no", "i.issue_title", "g.expected_title")


def first_match(pairs: DataFrame) -> DataFrame:
    """E-2: the first expected finding that each finding matches."""
    return pairs.groupBy("doc_id", "issue_no").agg(F.min_by(F.struct("gt_no", "issue_title", "expected_title"), "gt_no").alias("m")).select("doc_id", "issue_no", "m.*")


def title_class(q: SparkSql, a: str, b: str) -> str:
    words = lambda c: q.keep(q.split(normalized(q, c), " "), "w", "w <> ''")
    return f"case when {normalized(q, a)} = {normalized(q, b)} then 'exact' when {q.size(q.both(q.distinct(words(a)), words(b)))} > 0 then 'partial' else 'category_only' end"


def title_match_class(matches: DataFrame) -> DataFrame:
    """E-3: exact, partial (a word in common) or category_only."""
    return matches.withColumn("title_class", F.expr(title_class(SPARK, "issue_title", "expected_title")))


_METRICS = {
    "precision": "case when tp + fp > 0 then cast(tp as double) / (tp + fp) when gt_count = 0 then 1.0 else 0.0 end",
    "recall": "case when tp + fn > 0 then cast(tp as double) / (tp + fn) when gt_count = 0 then 1.0 else 0.0 end",
    "title_accuracy": "case when tp > 0 then cast(n_exact + n_partial as double) / tp else 1.0 end",
    "severity_accuracy": "1.0D",
}
_VERDICT = {
    "fail_reasons": """concat_ws('; ', case when not parse_ok then 'parse_failed' end, case when red_flag and tp = 0 and gt_count > 0 then 'catastrophic_false_negative' end,
      case when gt_count > 0 and tp < gt_count then concat('missing ', cast(gt_count - tp as varchar(20)), '/', cast(gt_count as varchar(20)), ' findings') end,
      case when gt_count > 0 and fp > 0 then concat(cast(fp as varchar(20)), ' false positive(s)') end)""",
}


def document_metrics(issues: DataFrame, truth: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """E-4: for every document on either side, and those of ``docs`` (doc_id, parse_ok, red_flag): tp (findings that match), fp, fn
    (expected ones that nothing matches), rates, title accuracy, the reasons why it fails, and whether it passes.

    Precision is 1 without findings and truth, recall 1 without truth. Matches have an allowed severity, so its accuracy is 1.
    """
    matched = title_match_class(first_match(match_findings(issues, truth)))
    found = issues.groupBy("doc_id").agg(F.count("*").alias("n_found"))
    expected = truth.groupBy("doc_id").agg(F.count("*").alias("gt_count"))
    named = lambda c: F.count_if(F.col("title_class") == c)
    hits = matched.groupBy("doc_id").agg(F.count("*").alias("tp"), F.count_distinct("gt_no").alias("n_gt_hit"), named("exact").alias("n_exact"), named("partial").alias("n_partial"))
    both = found.join(expected, "doc_id", "full").join(hits, "doc_id", "left")
    both = both.join(docs.select("doc_id", "parse_ok", "red_flag"), "doc_id", "full") if docs is not None else both.withColumns({"parse_ok": F.lit(True), "red_flag": F.lit(False)})
    out = both.na.fill(0).na.fill({"parse_ok": True, "red_flag": False})
    out = out.selectExpr("doc_id", "tp", "n_found - tp as fp", "gt_count - n_gt_hit as fn", "gt_count", "n_exact", "n_partial", "parse_ok", "red_flag")
    out = out.selectExpr("*", *[f"{e} as {k}" for k, e in _METRICS.items()]).selectExpr("*", *[f"{e} as {k}" for k, e in _VERDICT.items()])
    return out.withColumn("pass", F.expr("fail_reasons = ''")).drop("red_flag")


def composite(parse: str = "parse_rate", precision: str = "precision", recall: str = "recall", severity: str = "severity_accuracy", fpr: str = "fpr", fnr: str = "fnr") -> str:
    """The weighted score from 0 to 100."""
    falls = lambda x, at: f"(1.0 - least(greatest({x} - {at}, 0.0) / {at}, 1.0))"
    return f"100.0 * ({parse} * 0.20 + {precision} * 0.20 + {recall} * 0.25 + {severity} * 0.15 + {falls(fpr, 0.30)} * 0.10 + {falls(fnr, 0.35)} * 0.10)"


_CORPUS = {
    "tp": "cast(sum(tp) as bigint)", "fp": "cast(sum(fp) as bigint)", "fn": "cast(sum(fn) as bigint)", "n_docs": "count(*)", "parse_rate": "avg(cast(parse_ok as int))",
}
_RATES = {
    "precision": "coalesce(cast(tp as double) / nullif(tp + fp, 0), 0.0)", "recall": "coalesce(cast(tp as double) / nullif(tp + fn, 0), 0.0)", "fpr": "coalesce(cast(fp as double) / nullif(tp + fp, 0), 0.0)",
    "fnr": "coalesce(cast(fn as double) / nullif(tp + fn, 0), 0.0)",
}
#: Sums and rates that need columns which not every table has, and the value where they are missing.
_OPTIONAL = {
    "severity_accuracy": (("severity_accuracy",), "sum(tp * severity_accuracy)", "1.0D"),
    "title_accuracy": (("n_exact", "n_partial"), "cast(sum(n_exact + n_partial) as double)", "cast(null as double)"),
}
_CORPUS_COLUMNS = ("tp", "fp", "fn", "n_docs", "parse_rate", "precision", "recall", "fpr", "fnr", "severity_accuracy", "title_accuracy")


def _corpus(docs: DataFrame, grouped) -> DataFrame:
    has = {k: all(c in docs.columns for c in needs) for k, (needs, _, _) in _OPTIONAL.items()}
    sums = _CORPUS | {f"s_{k}": total for k, (_, total, _) in _OPTIONAL.items() if has[k]}
    rates = _RATES | {k: f"coalesce(cast(s_{k} as double) / nullif(tp, 0), 0.0)" if has[k] else missing for k, (_, _, missing) in _OPTIONAL.items()}
    return grouped.agg(*[F.expr(e).alias(k) for k, e in sums.items()]).selectExpr("*", *[f"{e} as {k}" for k, e in rates.items()])


def corpus_metrics(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E-5: sums and rates over documents (tp, fp, fn, parse_ok) and the composite, for each group of ``by``.

    Severity accuracy weighs documents by tp, and is 1 where no such column is given; title accuracy needs n_exact and
    n_partial. Rates over nothing are 0.
    """
    return _corpus(docs, docs.groupBy(*by)).selectExpr(*by, *_CORPUS_COLUMNS, f"cast({composite()} as double) as composite")


def metrics_by_type(docs: DataFrame) -> DataFrame:
    """E-6: the same overall (doc_type null) and for each type, by grouping sets in one pass."""
    return _corpus(docs, docs.rollup("doc_type")).selectExpr("doc_type", "tp", "fp", "fn", "n_docs", "precision", "recall", f"cast({composite()} as double) as composite")


SCORES = {
    "f1": "coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0)",
    "f2": "coalesce(5.0 * tp / nullif(5.0 * tp + fp + 4.0 * fn, 0), 0.0)",
    "weighted": f"case when gt_count = 0 then case when fp > 0 then 0.0 else 1.0 end else {clamp('cast(tp as double) / nullif(gt_count, 0) - fp * 0.15 - fn * 0.35')} end",
    "pr_composite": clamp("coalesce(cast(tp as double) / nullif(tp + fp, 0), 0.0) * 0.5 + coalesce(cast(tp as double) / nullif(tp + fn, 0), 0.0) * 0.5 - fp * 0.05 - fn * 0.10"),
    "jaccard": "case when tp + fp + fn = 0 then 1.0 else cast(tp as double) / nullif(tp + fp + fn, 0) end",
    "completeness": f"case when gt_count = 0 then case when fp > 0 then 0.0 else 1.0 end else {clamp('cast(tp as double) / nullif(gt_count, 0) - coalesce(cast(fp as double) / nullif(tp + fp, 0), 0.0) * 0.25 - cast(fn as double) / nullif(gt_count, 0) * 0.35 + case when tp + fp = gt_count then 0.1 else 0.0 end')} end",
}


def correctness_scores(docs: DataFrame) -> DataFrame:
    """E-7: six ways to score a document's tp, fp, fn and gt_count from 0 to 1."""
    return docs.selectExpr("run_id", "doc_id", *[f"cast({e} as double) as {k}" for k, e in SCORES.items()])


def _cuts(values: DataFrame, columns: Sequence[str], block: int, most: int) -> list[list[float]]:
    """For each column values that cut its rows into parts of about ``block``, ``most`` at most."""
    parts = min(most, max(1, -(-values.count() // block)))
    levels = [k / parts for k in range(1, parts)]
    if not levels:
        return [[] for _ in columns]
    found = values.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(list(columns), levels, 0.1 / parts)
    return [sorted(set(c)) for c in found]


def _place(column: str, cuts: Sequence[float]) -> Column:
    """The part of a value: even ones lie between two cuts, odd ones hold the one value that is a cut."""
    at, value = F.array(*[F.lit(float(v)) for v in cuts]).cast("array<double>"), F.col(column).cast("double")
    return 2 * F.size(F.filter(at, lambda v: v < value)) + F.array_contains(at, value).cast("int")


#: Distinct values of a part that one window sorts, about, and parts at most.
RANK_BLOCK, RANK_PARTS = 200_000, 400


def _ranks(df: DataFrame, x: str, by: Sequence[str], block: int = RANK_BLOCK) -> DataFrame:
    """Average ranks from the distinct values and their counts.

    Values are cut into parts by quantiles: a rank is the number of rows in the parts before, from sums of one row per
    part, and of those before it in its own part, the only rows that a window sorts.
    """
    values = df.groupBy(*by, x).agg(F.count("*").alias("_n"))
    (cuts,) = _cuts(values, [x], block, RANK_PARTS)
    placed = values.withColumn("_part", _place(x, cuts))
    keys = ", ".join(by)
    over = lambda *more: f"partition by {', '.join([*by, *more])} " if by or more else ""
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    before = sums.withColumn("_before", F.expr(f"coalesce(sum(_in) over ({over()}order by _part rows between unbounded preceding and 1 preceding), 0)")).drop("_in")
    own = f"coalesce(sum(_n) over ({over('_part')}order by {x} rows between unbounded preceding and 1 preceding), 0)"
    ranked = placed.withColumn("_own", F.expr(own)).join(before, [*by, "_part"] if keys else ["_part"])
    return ranked.withColumn(f"rank_{x}", F.expr("_before + _own + (_n + 1) / 2.0").cast("double")).drop("_n", "_part", "_own", "_before")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """E-8: rank correlation with averaged ties, 0 where a side is constant, and its approximate p value, for each group of ``by``."""
    df = df.where(f"{x} is not null and {y} is not null")
    ranked = df.join(_ranks(df, x, by), [*by, x]).join(_ranks(df, y, by), [*by, y])
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(f"rank_{x}", f"rank_{y}").alias("c"), F.var_pop(f"rank_{x}").alias("vx"), F.var_pop(f"rank_{y}").alias("vy"))
    out = sums.select(*by, "n", F.expr("case when vx > 0 and vy > 0 then c / sqrt(vx * vy) else 0D end").alias("rho"), F.expr("vx > 0 and vy > 0").alias("_varies"))
    return out.withColumn("p_value", F.expr(P_VALUE)).drop("_varies")


#: The approximate p value of a rank correlation; 1 for constants, 0 for a perfect one.
P_VALUE = "cast(case when not _varies or n < 2 then 1.0 when abs(rho) >= 1.0 then 0.0 else least(1.0, 2.0 * exp(-0.5 * abs(rho * sqrt((n - 2) / (1.0 - rho * rho))))) end as double)"


def ordered_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Weighted pairs of rows of different x and y: (concordant, discordant), ranked by the bits of y's place from the top.

    Two places differ first in some bit, below a common prefix; among rows of one prefix the sums of weights before each
    row in the order of x give its pairs. Takes O(n log^2 n).
    """
    y = np.unique(y, return_inverse=True)[1]
    x = np.unique(x, return_inverse=True)[1]
    up = down = 0
    for bit in range(max(1, int(y.max(initial=0)).bit_length())):
        prefix, one = y >> (bit + 1), (y >> bit) & 1
        order = np.lexsort((x, prefix))
        p, xs, ones, w = prefix[order], x[order], one[order], n[order]
        new_prefix = np.concatenate(([True], p[1:] != p[:-1]))
        new_x = new_prefix | np.concatenate(([True], xs[1:] != xs[:-1]))
        # weights of the prefix's rows of smaller x: sums before the first row of this x, less those before the prefix
        first_x, first_p = (np.maximum.accumulate(np.where(new, np.arange(len(p)), 0)) for new in (new_x, new_prefix))
        for value, other in ((0, 1), (1, 0)):
            sums = np.concatenate(([0], np.cumsum(np.where(ones == value, w, 0))))
            total = int((w * (sums[first_x] - sums[first_p]))[ones == other].sum())
            up, down = (up + total, down) if value == 0 else (up, down + total)
    return up, down


def _group_pairs(x: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up, down = ordered_pairs(pdf[x].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy().astype(object if pdf["n"].sum() > 1 << 30 else np.int64))
        return pd.DataFrame({"c": [Decimal(int(up))], "d": [Decimal(int(down))]})

    return run


def kendall(df: DataFrame, x: str, y: str, block: int = 50_000, most_blocks: int = 250) -> DataFrame:
    """E-9: (concordant - discordant) / both, ties aside, from counts of distinct (x, y) pairs, without a pair join.

    Values are cut into blocks of about ``block`` distinct pairs (``most_blocks`` cuts at most) on either axis, and each cut
    is a block of its own. Pairs of rows in different blocks on both axes follow from the counts of the cells, at most
    (2 * most_blocks + 1)^2 numbers; pairs within one block are counted in it by sorting, but for blocks of a single value,
    however many rows share it: they hold ties only.
    """
    pairs = df.where(f"{x} is not null and {y} is not null").groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    cuts = _cuts(pairs, ["x", "y"], block, most_blocks)
    placed = pairs.withColumns({"xb": _place("x", cuts[0]), "yb": _place("y", cuts[1])})
    cells = placed.groupBy("xb", "yb").agg(F.sum("n").alias("n")).collect()
    grid = np.zeros((2 * len(cuts[0]) + 1, 2 * len(cuts[1]) + 1), dtype=object)
    for r in cells:
        grid[r.xb, r.yb] = int(r.n)
    after = np.cumsum(grid[::-1], axis=0)[::-1] - grid  # same y block, later x blocks
    higher = np.cumsum(after[:, ::-1], axis=1)[:, ::-1] - after
    lower = np.cumsum(after, axis=1) - after
    up, down = int((grid * higher).sum()), int((grid * lower).sum())
    within = placed.where("xb % 2 = 0").groupBy("xb").applyInPandas(_group_pairs("x"), "c decimal(38,0), d decimal(38,0)")
    within = within.unionByName(placed.where("yb % 2 = 0").groupBy("yb").applyInPandas(_group_pairs("xb"), "c decimal(38,0), d decimal(38,0)"))
    met = within.agg((F.coalesce(F.sum("c"), F.lit(0)) + F.lit(Decimal(up))).alias("c"), (F.coalesce(F.sum("d"), F.lit(0)) + F.lit(Decimal(down))).alias("d"))
    return met.selectExpr("cast(c as bigint) as concordant", "cast(d as bigint) as discordant", "cast(coalesce(cast(c - d as double) / nullif(cast(c + d as double), 0), 0.0) as double) as tau")


def mann_whitney(df: DataFrame, score: str, flag: str) -> DataFrame:
    """E-10: share of pairs of a passed and a failed row in which the passed one scores higher, ties half, by rank sums."""
    df = df.where(f"{score} is not null and {flag} is not null")
    ranked = df.join(_ranks(df, score, ()), [score])
    sums = ranked.agg(F.count_if(F.col(flag)).alias("n1"), F.count_if(~F.col(flag)).alias("n2"), F.sum(F.when(F.col(flag), F.col(f"rank_{score}"))).alias("r1"))
    return sums.selectExpr("n1", "n2", "cast(coalesce((r1 - n1 * (n1 + 1) / 2.0) / nullif(n1 * n2, 0), 0.5) as double) as auc")


def calibration_bins(df: DataFrame, edges: Sequence[float] = (0.0, 0.25, 0.45, 0.6, 0.75, 0.9, 1.01)) -> DataFrame:
    """E-11: documents, sums, micro and mean precision in half-open bins of the confidence score."""
    bins = df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "lo double, hi double")
    held = df.join(F.broadcast(bins), F.expr("confidence_score >= lo and confidence_score < hi"))
    mean = "avg(cast(tp as double) / nullif(tp + fp, 0))"
    return held.groupBy("lo", "hi").agg(F.count("*").alias("n_docs"), F.expr("cast(sum(tp) as bigint)").alias("tp"), F.expr("cast(sum(fp) as bigint)").alias("fp"), F.expr("cast(sum(fn) as bigint)").alias("fn"), F.expr("cast(sum(tp) as double) / nullif(sum(tp + fp), 0)").alias("micro_precision"), F.expr(mean).alias("mean_precision"))


def confidence_gap(df: DataFrame) -> DataFrame:
    """E-12: mean confidence of passed and failed documents, their difference, and the range."""
    return df.agg(F.avg(F.expr("case when pass then confidence_score end")).alias("mean_pass"), F.avg(F.expr("case when not pass then confidence_score end")).alias("mean_fail"), F.min("confidence_score").alias("lo"), F.max("confidence_score").alias("hi")).selectExpr("*", "mean_pass - mean_fail as gap")


def overconfident(df: DataFrame, high: float = 0.8, some: float = 0.5) -> DataFrame:
    """E-13: failed documents of high confidence, and documents of some confidence whose precision and recall are both 0, with the reason."""
    rated = df.selectExpr("*", f"{_METRICS['precision']} as _precision", f"{_METRICS['recall']} as _recall")
    high_fail, empty = f"(not pass and confidence_score >= {high})", f"(_precision = 0 and _recall = 0 and confidence_score >= {some})"
    return rated.where(f"{high_fail} or {empty}").selectExpr("run_id", "doc_id", "confidence_score", "pass", "tp", f"{high_fail} as high_confidence_failure", f"{empty} as nothing_correct")


def compare_runs(df: DataFrame, before: str, after: Sequence[str]) -> DataFrame:
    """E-14: a document's confidence before, in each run after, their mean and the change."""
    wide = df.groupBy("doc_id").pivot("run_id", [before, *after]).agg(F.avg("confidence_score"))
    mean = sum((F.col(r) for r in after[1:]), F.col(after[0])) / len(after)
    return wide.withColumn("mean_after", mean).withColumn("delta", F.col("mean_after") - F.col(before))


RUN_METRICS = ("precision", "recall", "fpr", "fnr", "composite")


def compare_overall(df: DataFrame, before: str, after: Sequence[str]) -> DataFrame:
    """E-14: each corpus metric before, its mean over the runs after, and the change: (metric, before, mean_after, delta)."""
    per = corpus_metrics(df.where(F.col("run_id").isin(before, *after)), ["run_id"]).unpivot("run_id", list(RUN_METRICS), "metric", "value")
    wide = per.groupBy("metric").agg(F.avg(F.when(F.col("run_id") == before, F.col("value"))).alias("before"), F.avg(F.when(F.col("run_id") != before, F.col("value"))).alias("mean_after"))
    return wide.withColumn("delta", F.col("mean_after") - F.col("before"))


def run_stats(df: DataFrame) -> DataFrame:
    """E-15: mean and sample deviation over runs of each run-level metric."""
    per = corpus_metrics(df, ["run_id"]).unpivot("run_id", list(RUN_METRICS), "metric", "value")
    return per.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def misleading_scores(df: DataFrame) -> DataFrame:
    """E-15: a document's means over runs, and whether its weighted score is too high (over 0.7 with false findings or no truth) or too low (under 0.3 with true findings)."""
    means = df.withColumn("_w", F.expr(f"cast({SCORES['weighted']} as double)")).groupBy("doc_id").agg(
        F.avg("_w").alias("weighted"), F.avg("tp").alias("tp"), F.avg("fp").alias("fp"), F.avg("fn").alias("fn"), F.max("gt_count").alias("gt_count")
    )
    return means.selectExpr("*", "weighted > 0.7 and (fp > 0 or gt_count = 0) as too_high", "weighted < 0.3 and gt_count > 0 and tp > 0 as too_low")


def sensitivity_grid(df: DataFrame, fps: Sequence[float] = (0.05, 0.10, 0.15, 0.20, 0.25), fns: Sequence[float] = (0.15, 0.25, 0.35, 0.45, 0.55), k: int = 10) -> DataFrame:
    """E-16: each pair of penalties by the weighted score it gives: mean, deviation, range, rank correlation with confidence (rho), gap between
    passed and failed (separation), mean rank correlation with the other pairs (agreement), 1 - the range of rho among neighbours on the grid
    (robustness), and their weighted sum; the k best by it.

    The grid meets distinct (tp, fp, fn, gt_count, confidence, pass) combinations with their counts, not documents.
    """
    cells = df.groupBy("tp", "fp", "fn", "gt_count", "confidence_score", "pass").agg(F.count("*").alias("n"))
    rows = [(i * len(fns) + j, i, j, float(a), float(b)) for i, a in enumerate(fps) for j, b in enumerate(fns)]
    grid = df.sparkSession.createDataFrame(rows, "point int, gi int, gj int, fp_penalty double, fn_penalty double")
    score = f"cast(case when gt_count = 0 then case when fp > 0 then 0.0 else 1.0 end else {clamp('cast(tp as double) / nullif(gt_count, 0) - fp * fp_penalty - fn * fn_penalty')} end as double)"
    scored = cells.join(F.broadcast(grid), how="cross").withColumn("score", F.round(F.expr(score), 9))
    by = ["point", "fp_penalty", "fn_penalty", "gi", "gj"]
    ranks = []
    for x in ("score", "confidence_score"):
        values = scored.groupBy("point", x).agg(F.sum("n").alias("_n"))
        ranks.append(values.withColumn(f"rank_{x}", F.expr(f"cast(coalesce(sum(_n) over (partition by point order by {x} rows between unbounded preceding and 1 preceding), 0) + (_n + 1) / 2.0 as double)")).drop("_n"))
    ranked = scored.join(ranks[0], ["point", "score"]).join(ranks[1], ["point", "confidence_score"])
    weighted = lambda e: F.sum(F.expr(f"n * ({e})"))
    a, b = "rank_score", "rank_confidence_score"
    gap = lambda flag: F.expr(f"coalesce(sum(case when {flag} then n * score end) / nullif(sum(case when {flag} then n end), 0), 0D)")
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), weighted("score").alias("s"), weighted("score * score").alias("ss"), F.min("score").alias("lo"), F.max("score").alias("hi"), (gap("pass") - gap("not pass")).alias("separation"),
        weighted(a).alias("sa"), weighted(b).alias("sb"), weighted(f"{a} * {a}").alias("saa"), weighted(f"{b} * {b}").alias("sbb"), weighted(f"{a} * {b}").alias("sab"),
    )
    out = sums.selectExpr(*by, "s / n as mean", "sqrt(greatest(0D, ss / n - (s / n) * (s / n))) as sd", "hi - lo as spread", "separation", f"{_RHO} as rho")
    # ranks of two penalties meet on the outcomes (tp, fp, fn, gt_count), whose ranks hold for all their documents
    key = ["tp", "fp", "fn", "gt_count"]
    slim = ranked.groupBy("point", *key).agg(F.sum("n").alias("n"), F.first(a).alias("r"))
    pair = slim.alias("x").join(slim.selectExpr("point as point2", *key, "r as r2"), key).where("point <> point2")
    agreed = pair.groupBy("point", "point2").agg(F.sum("n").alias("n"), weighted("r").alias("sa"), weighted("r2").alias("sb"), weighted("r * r").alias("saa"), weighted("r2 * r2").alias("sbb"), weighted("r * r2").alias("sab"))
    agreement = agreed.selectExpr("point", f"{_RHO} as rho").groupBy("point").agg(F.avg("rho").alias("agreement"))
    near = out.select(F.col("gi").alias("hi_"), F.col("gj").alias("hj_"), F.col("rho").alias("near_rho"))
    robust = out.select("point", "gi", "gj").join(F.broadcast(near), F.expr("abs(gi - hi_) <= 1 and abs(gj - hj_) <= 1")).groupBy("point").agg((1 - (F.max("near_rho") - F.min("near_rho"))).alias("robustness"))
    full = out.join(agreement, "point", "left").join(robust, "point").na.fill(0.0, ["agreement"])
    full = full.withColumn("composite", F.expr("rho * 0.35 + agreement * 0.25 + robustness * 0.20 + separation * 0.10 + sd * 0.10"))
    columns = ["fp_penalty", "fn_penalty", "mean", "sd", "spread", "rho", "separation", "agreement", "robustness", "composite"]
    return full.orderBy(F.round("composite", 9).desc(), "fp_penalty", "fn_penalty").limit(k).select(*columns)


_RHO = "coalesce((n * sab - sa * sb) / nullif(sqrt(greatest(0D, n * saa - sa * sa)) * sqrt(greatest(0D, n * sbb - sb * sb)), 0D), 0D)"


def rank_formulas(scores: DataFrame) -> DataFrame:
    """E-17: formulas (formula, rho, separation, spread, stability) by a weighted sum of their scaled criteria: one row per formula."""
    scale = lambda c: f"coalesce(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 0.0)"
    total = f"{scale('rho')} * 0.25 + {scale('separation')} * 0.15 + {scale('spread')} * 0.30 + {scale('stability')} * 0.30"
    return scores.selectExpr("formula", f"cast({total} as double) as total").selectExpr("formula", "total", "cast(rank() over (order by round(total, 9) desc, formula) as int) as place")


def formula_criteria(df: DataFrame) -> DataFrame:
    """The four criteria of the correctness scores over evaluation rows: correlation with confidence, gap between passed and failed, deviation, and 1 - the mean's change between runs."""
    long = correctness_scores(df).join(df.select("run_id", "doc_id", "confidence_score", "pass"), ["run_id", "doc_id"]).unpivot(["run_id", "doc_id", "confidence_score", "pass"], list(SCORES), "formula", "value")
    runs = long.groupBy("formula", "run_id").agg(F.avg("value").alias("m")).groupBy("formula").agg((1 - (F.max("m") - F.min("m"))).alias("stability"))
    base = long.groupBy("formula").agg(F.coalesce(F.corr("value", "confidence_score"), F.lit(0.0)).alias("rho"), (F.avg(F.when(F.col("pass"), F.col("value"))) - F.avg(F.when(~F.col("pass"), F.col("value")))).alias("separation"), F.stddev_pop("value").alias("spread"))
    return base.join(runs, "formula")


def ab_compare(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """E-18: document metrics of two pipelines side by side, with the changes and whether anything changed."""
    left, right = (df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in ("tp", "fp", "fn")]) for df, s in ((a, "a"), (b, "b")))
    both = left.join(right, key, "full").na.fill(0)
    return both.selectExpr(key, "tp_b - tp_a as d_tp", "fp_b - fp_a as d_fp", "fn_b - fn_a as d_fn", "tp_a = tp_b and fp_a = fp_b and fn_a = fn_b as is_same")


def ab_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """E-18: rows of either side that the other lacks, repeats counted: (n_only_a, n_only_b, is_identical). Both sides need the same columns."""
    sides = a.exceptAll(b.select(*a.columns)).select(F.lit("a").alias("side")).unionByName(b.select(*a.columns).exceptAll(a).select(F.lit("b").alias("side")))
    counts = sides.agg(F.count_if(F.col("side") == "a").alias("n_only_a"), F.count_if(F.col("side") == "b").alias("n_only_b"))
    return counts.withColumn("is_identical", F.expr("n_only_a = 0 and n_only_b = 0"))


def ab_corpus(a: DataFrame, b: DataFrame) -> DataFrame:
    """E-18: corpus metrics of two tables of document metrics and their changes: (metric, a, b, delta)."""
    sides = [corpus_metrics(df).unpivot([], list(RUN_METRICS), "metric", name) for df, name in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], "metric").withColumn("delta", F.col("b") - F.col("a"))


def regression_gates(results: DataFrame, gates: Sequence[tuple[str, str, float]]) -> DataFrame:
    """E-19: named limits (gate, condition, bound) on each row of ``results``: (doc_id, gate, passed). Conditions are SQL over the row with {} for the bound."""
    checks = F.array(*[F.struct(F.lit(name).alias("gate"), F.expr(condition.format(bound)).alias("passed")) for name, condition, bound in gates])
    return results.select("doc_id", F.explode(checks).alias("c")).select("doc_id", "c.gate", "c.passed")


#: Conditions of a gate's kinds, over a result's row with the gate's words and bound.
GATE_KINDS = {
    "label_is": "confidence_label = words", "label_is_not": "confidence_label <> words", "type_is": "response_type = words",
    "requires_category": "exists(categories, c -> contains(lower(c), lower(words)))", "forbids_category": "not exists(categories, c -> lower(c) = lower(words))",
    "requires_title": "exists(titles, t -> contains(lower(t), lower(words)))", "at_least_findings": "n_findings >= bound", "at_most_findings": "n_findings <= bound",
    "at_least_score": "confidence_score >= bound", "at_most_score": "confidence_score <= bound", "parsed": "not parse_failed", "warned": "coalesce(quality_warning, '') <> ''",
}


def result_rows(results: DataFrame, issues: DataFrame) -> DataFrame:
    """What gates look at: ``results`` (doc_id, confidence_label, confidence_score, response_type, parse_failed, quality_warning) with each document's categories, titles and number of findings."""
    lists = issues.groupBy("doc_id").agg(F.count("*").alias("n_findings"), F.collect_set(F.coalesce("category", F.lit(""))).alias("categories"), F.collect_set(F.coalesce("issue_title", F.lit(""))).alias("titles"))
    none = F.array().cast("array<string>")
    joined = results.join(lists, "doc_id", "left")
    return joined.withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)), "categories": F.coalesce("categories", none), "titles": F.coalesce("titles", none)})


def run_gates(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """E-19: cases as rows: ``gates`` (case_name, doc_id, kind, words, bound) held against ``rows`` (see ``result_rows``).

    Returns one row per case and document: case_name, doc_id, passed, reasons (the kinds that fail, with their words or
    bound, sorted and joined by "; "). A document without a result, an unknown kind and a condition over a null fail.
    Gates and results meet by doc_id; see ``regression_gates`` for limits that hold for every document.
    """
    own = gates.join(rows.withColumn("_there", F.lit(True)), "doc_id", "left")
    met = F.expr("case kind " + " ".join(f"when '{k}' then {test}" for k, test in GATE_KINDS.items()) + " end")
    said = F.concat("kind", F.lit(" "), F.coalesce("words", F.col("bound").cast("string"), F.lit("")))
    why = F.when(F.col("_there").isNull(), "no result").when(~F.coalesce(met, F.lit(False)), F.rtrim(said))
    tested = own.select("case_name", "doc_id", why.alias("why"))
    out = tested.groupBy("case_name", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("reasons"))
    return out.select("case_name", "doc_id", (F.col("reasons") == "").alias("passed"), "reasons")
