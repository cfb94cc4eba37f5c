"""Readers, writers, and streams that end with the batch operators' rows."""

import json

from pyspark.sql import functions as F

from clausework.operators import results
from clausework.plans import fixtures
from clausework.sources import corpus
from clausework.streaming import streams


def test_text_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode() + b"\xff!")
    got = corpus.read_text_corpus(spark, str(tmp_path)).collect()
    assert [r.text for r in got] == ["héllo!"]


def test_ground_truth_and_runs(spark, tmp_path):
    issue = {"id": "1", "expected_issue_title": "T", "allowed_categories": ["x"], "allowed_severities": ["HIGH"]}
    (tmp_path / "A.review.json").write_text(json.dumps({"document_id": "A", "ground_truth": {"issues": [issue, issue]}}, indent=1))
    assert [(r.doc_id, r.gt_no, r.allowed_categories) for r in corpus.load_ground_truth(spark, str(tmp_path)).orderBy("gt_no").collect()] == [("A", 0, ["x"]), ("A", 1, ["x"])]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "r.json").write_text(json.dumps({"run_id": "r1", "per_document": [{"doc_id": "A", "tp": 1}]}))
    assert [(r.run_id, r.doc_id, r.tp) for r in corpus.load_runs(spark, str(runs)).collect()] == [("r1", "A", 1)]


def test_history_is_appended_by_date(spark, sf_dir, tmp_path):
    rows = corpus.history_rows(fixtures.issues(spark, sf_dir))
    for _ in range(2):
        corpus.append_history(rows, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2 * rows.count()


def test_reports(spark, sf_dir, tmp_path):
    issues = fixtures.issues(spark, sf_dir)
    for fmt in ("json", "text"):
        corpus.export_reports(issues, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == issues.select("doc_id").distinct().count()


def test_scored_stream_is_the_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    streams.write_stream(streams.score_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted(df.select("doc_id", "route").collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(streams.score_stream(docs))


def test_sessions_are_upserted(spark, tmp_path):
    schema = "session_id long, messages string, message_count long, ts timestamp"
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "session_id long, messages string, message_count long").withColumn("ts", F.timestamp_seconds("message_count"))
    sink = streams.session_sink(str(tmp_path / "s"))
    sink(rows.select(*[c.split()[0] for c in schema.split(", ")]), 0)
    sink(rows.where("session_id = 1").withColumn("message_count", F.lit(9).cast("long")), 1)
    got = {r.session_id: (r.title, r.message_count) for r in streams.session_table(spark, str(tmp_path / "s")).rows().collect()}
    assert got == {1: (streams.DEFAULT_TITLE, 9), 2: (streams.DEFAULT_TITLE, 1)}


def test_session_state_counts_the_batch_exchanges(spark, sf_dir, tmp_path):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("turn")))
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    query = streams.session_state(stream).writeStream.format("memory").queryName("sessions").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.conv_id: r.n_exchanges for r in spark.table("sessions").where("n_exchanges > 0").collect()}
    assert got == {r.conv_id: r.n_exchanges for r in results.session_history(turns).collect()}


def test_running_summary_is_the_batch(spark, sf_dir, tmp_path):
    history = fixtures.history(spark, sf_dir)
    history.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    streams.running_summary(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("totals").collect()) == sorted(streams.running_summary(history).collect())


def test_retained_stream_keeps_each_record_once(spark, sf_dir, tmp_path):
    history = fixtures.history(spark, sf_dir)
    history.unionByName(history).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    streams.retain_stream(stream).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("kept").count() == history.count()
