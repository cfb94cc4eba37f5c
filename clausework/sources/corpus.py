"""Readers and writers (IO-1 to IO-9): text corpora, pages, review files, runs, history and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK, Layer, SparkSql, with_layers
from clausework.operators.quality import assess_quality

#: Accepted kinds of files with their size limits in megabytes, and the text limit.
LIMITS_MB = {"pdf": 25, "docx": 15, "txt": 2}
MAX_CHARS = 500_000
REVIEW_SCHEMA = (
    "document_id string, title string, ground_truth struct<parse_should_succeed:boolean, expected_issue_count:int, max_allowed_issues:int, issues:array<struct<id:string, expected_issue_title:string, "
    "expected_severity:string, allowed_severities:array<string>, expected_category:string, allowed_categories:array<string>, must_contain_quoted_text_pattern:array<string>, must_not_contain_quoted_text_pattern:array<string>, "
    "must_contain_explanation_pattern:array<string>, must_not_contain_explanation_pattern:array<string>>>>"
)
RUN_SCHEMA = (
    "run_id string, model string, timestamp timestamp, per_document array<struct<doc_id:string, pass:boolean, parse_ok:boolean, issue_count:int, tp:int, fp:int, fn:int, gt_count:int, "
    "precision:double, recall:double, severity_accuracy:double, title_accuracy:double, confidence_score:double, confidence_label:string>>"
)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """IO-1: text files as (path, text), bytes that are no UTF-8 dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "").alias("text"))


def admission_layers(q: SparkSql) -> list[Layer]:
    limit = "case extension " + " ".join(f"when '{k}' then {mb * 1024 * 1024}" for k, mb in LIMITS_MB.items()) + " end"
    return [
        {"extension": f"lower({q.first('filename', '[.]([A-Za-z0-9]+)$', 1)})"},
        {"reject_reason": f"case when extension not in ({', '.join(repr(k) for k in LIMITS_MB)}) then 'extension' when coalesce(size_bytes, 0) = 0 then 'empty' when size_bytes > {limit} then 'size' when length(coalesce(text, '')) > {MAX_CHARS} then 'text_length' end"},
    ]


def admission_gate(files: DataFrame) -> DataFrame:
    """IO-2: why each file (filename, size_bytes, text) is turned away, null if it isn't. Other columns pass through."""
    return with_layers(files, admission_layers(SPARK)).drop("extension")


def assemble_pages(pages: DataFrame, separator: str = "") -> DataFrame:
    """IO-3: the text of each document (doc_id, page_no, text) in order of its pages."""
    lists = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return lists.select("doc_id", F.array_join(F.expr("transform(p, x -> x.text)"), separator).alias("text"), F.size("p").alias("n_pages"))


def page_text_triage(pages: DataFrame, min_chars: int = 50, bad_ratio: float = 0.20) -> DataFrame:
    """IO-4: pages of a document with under ``min_chars`` characters, their share, and whether the whole must be read again: the
    assembled text is degraded although some, but under ``bad_ratio``, of its pages are deficient (with more, those pages are the fault)."""
    short = F.length(F.expr(SPARK.strip("coalesce(text, '')"))) < min_chars
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(short).alias("n_deficient"))
    quality = assess_quality(assemble_pages(pages)).select("doc_id", "is_degraded")
    rated = counts.withColumn("deficient_ratio", F.col("n_deficient") / F.col("n_pages")).join(quality, "doc_id")
    return rated.withColumn("needs_full_ocr", (F.col("n_deficient") > 0) & (F.col("deficient_ratio") < bad_ratio) & F.col("is_degraded"))


def fix_merged_words(docs: DataFrame) -> DataFrame:
    """IO-5: a space behind a stop between a letter or digit and a capital, and between a small letter and a capital."""
    stops = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?<=[a-zA-Z0-9])\.(?=[A-Z])", ". ")
    return docs.select("doc_id", F.regexp_replace(stops, "(?<=[a-z])(?=[A-Z])", " ").alias("fixed"))


META_SCHEMA = "document_id string, title string, type string, subtype string, risk_level string, red_flag boolean, word_count int, jurisdiction string"


def _reviews(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(path)


def load_ground_truth(spark: SparkSession, path: str, pattern: str = "*.review.json") -> DataFrame:
    """IO-6: expected findings of review files (one document or an array of them in each), one row each, in order (gt_no)."""
    reviews = _reviews(spark, path, REVIEW_SCHEMA, pattern)
    return reviews.select(F.col("document_id").alias("doc_id"), F.posexplode("ground_truth.issues").alias("gt_no", "g")).select("doc_id", "gt_no", "g.*")


def load_reviewed_documents(spark: SparkSession, path: str, reviews: str = "*.review.json", metas: str = "*.meta.json") -> DataFrame:
    """IO-6: every reviewed document with its counts and limits, joined with its meta file; without one, those columns are null."""
    truth = _reviews(spark, path, REVIEW_SCHEMA, reviews).selectExpr("document_id as doc_id", "ground_truth.parse_should_succeed", "ground_truth.max_allowed_issues", "coalesce(size(ground_truth.issues), 0) as gt_count")
    meta = _reviews(spark, path, META_SCHEMA, metas).selectExpr("document_id as doc_id", "type", "subtype", "risk_level", "coalesce(red_flag, false) as red_flag", "word_count", "jurisdiction")
    return truth.join(meta, "doc_id", "left")


def load_runs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """IO-7: run files as one row for each run and document, with the file's name."""
    runs = _reviews(spark, path, RUN_SCHEMA, pattern)
    return runs.select("run_id", "model", F.input_file_name().alias("file"), F.explode("per_document").alias("d")).select("run_id", "model", "file", "d.*")


def history_rows(issues: DataFrame) -> DataFrame:
    """IO-8: one audit record per document: filename, issue_count, issues as JSON, severity_level (HIGH if there is any finding)."""
    lists = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("issue_no", "issue_title", "severity"))).alias("l"))
    return lists.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.size("l").alias("issue_count"), F.to_json("l").alias("issues_json"), F.when(F.size("l") > 0, "HIGH").otherwise("LOW").alias("severity_level"))


def redaction_rows(docs: DataFrame) -> DataFrame:
    """IO-8: one redaction record per document (doc_id, entities, redacted_text): filename, count, entities without raw values as JSON, the redacted text, and the types found, sorted."""
    safe = F.to_json(F.expr("transform(entities, e -> named_struct('entity_type', e.entity_type, 'replacement', concat('[REDACTED_', e.entity_type, ']'), 'start', e.start, 'end', e.end))"))
    types = F.array_join(F.array_sort(F.array_distinct(F.expr("transform(entities, e -> e.entity_type)"))), ",")
    return docs.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.size("entities").alias("redaction_count"), safe.alias("entities_json"), "redacted_text", types.alias("redaction_types"))


def append_history(rows: DataFrame, path: str) -> None:
    """IO-8: append records with the time of writing, in folders by date."""
    stamped = rows.withColumn("timestamp", F.current_timestamp()).withColumn("date", F.current_date())
    stamped.write.mode("append").partitionBy("date").parquet(path)


def report_text(results: DataFrame) -> DataFrame:
    """IO-9: a plain text report for each finding list (doc_id, issue_no, issue_title, severity, category)."""
    line = F.concat(F.col("issue_no").cast("string"), F.lit(". "), F.col("issue_title"), F.lit(" ["), F.col("severity"), F.lit("] "), F.coalesce("category", F.lit("")))
    lists = results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("issue_no", line.alias("line")))).alias("l"))
    return lists.select("doc_id", F.concat(F.lit("Findings of document "), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(F.expr("transform(l, x -> x.line)"), "\n")).alias("report"))


def export_reports(results: DataFrame, path: str, fmt: str = "json") -> None:
    """IO-9: write the reports as JSON or as text."""
    report = report_text(results)
    if fmt == "json":
        report.write.json(path)
    elif fmt == "text":
        report.select("report").write.option("lineSep", "\n\n").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")
