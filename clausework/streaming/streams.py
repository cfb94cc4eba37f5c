"""Streaming forms (T-1 to T-5): documents as they arrive, sessions, running totals and retention."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clausework.operators.chain import audit_chain, chain_findings
from clausework.operators.classify import DISCLOSURE, route_documents
from clausework.operators.clauses import VERIFIERS, Verifier
from clausework.operators.parse import parse_issues
from clausework.operators.redact import redact_documents
from clausework.sources.corpus import redaction_rows
from clausework.sources.store import BUCKETS, DatedTable, KeyedTable

DEFAULT_TITLE = "Advisory session"
DEFAULT_MODE = "AUDIT"
SESSIONS = "session_id long, title string, messages string, message_count long, ts timestamp"
MODES = ("AUDIT", "REDACTION", "ADVISORY")
IDLE_DAYS = 1
_DISCLOSES = re.compile(DISCLOSURE)


def work_folder(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder; a cluster must name one that its machines share.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="clausework-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replayed(table: DataFrame) -> DataFrame:
    """A stream of the table's rows: a copy in the shared folder, read as a file stream."""
    path = f"{work_folder(table.sparkSession)}/in"
    table.write.parquet(path)
    return table.sparkSession.readStream.schema(table.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives until it has read what is there; each batch is written once under its number."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


def score_stream(docs: DataFrame) -> DataFrame:
    """T-1: arriving documents with their route: the batch projection, unchanged."""
    return route_documents(docs)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """T-1: append the stream to Parquet files until all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_sessions(batch: DataFrame) -> DataFrame:
    """The last row of each session (session_id, messages, message_count, ts) of a batch."""
    last = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("message_count").desc())
    return batch.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def upsert_sessions(current: DataFrame, batch: DataFrame) -> DataFrame:
    """T-2: the session table after a batch: known sessions get messages, count and time but keep their title, new ones get the default title."""
    new = latest_sessions(batch).select("session_id", *[F.col(c).alias(f"new_{c}") for c in ("messages", "message_count", "ts")])
    both = current.join(new, "session_id", "full")
    return both.select("session_id", F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"), *[F.coalesce(f"new_{c}", c).alias(c) for c in ("messages", "message_count", "ts")])


def session_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """T-2: the keyed table of sessions under ``path``."""
    return KeyedTable(spark, path, SESSIONS, ["session_id"], buckets)


def session_sink(path: str, buckets: int = BUCKETS):
    """T-2: a foreachBatch function that keeps the session table under ``path``: a batch writes the buckets of its sessions only, a repeated batch nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        new = latest_sessions(batch)
        session_table(batch.sparkSession, path, buckets).upsert(new, keep=["title"], defaults={"title": F.lit(DEFAULT_TITLE)}, batch=batch_id)

    return run


def upserted(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """T-2: the session table after all batches that a stream of sessions gives until it has read what is there."""
    folder = work_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(session_sink(folder, buckets)).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return session_table(stream.sparkSession, folder, buckets).rows()


class _Sessions(StatefulProcessor):
    """A conversation's mode and exchanges: the user's turn that waits for its answer, and a list of the exchanges so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", "mode string, waiting long, question string, last long, newest long")
        self.exchanges = handle.getListState("exchanges", "turn long, user string, assistant string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mode, waiting, question, last, newest = self.info.get() if self.info.exists() else (DEFAULT_MODE, -1, None, -1, 0)
        turns = pd.concat(list(rows)).sort_values("turn")
        for turn, role, text in zip(turns["turn"], turns["role"], turns["text"], strict=True):
            text = text if isinstance(text, str) else ""
            if role == "system" and text.strip().lower() == "reset":
                mode, waiting = DEFAULT_MODE, -1
                self.exchanges.clear()
            elif role == "system" and text.lower().startswith("mode "):
                wanted = text[5:].strip().upper()
                mode = wanted if wanted in MODES else mode
            elif role == "user" and text.strip():
                waiting, question = int(turn), text
            else:
                if role == "assistant" and waiting >= 0 and text.strip() and not _DISCLOSES.search(text):
                    self.exchanges.appendValue((waiting, question, text))
                waiting = -1
            last = max(last, int(turn))
        newest = max(newest, int(turns["ts"].max().timestamp() * 1000))
        self.info.update((mode, waiting, question, last, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + IDLE_DAYS * 24 * 3600 * 1000)
        held = [{"turn": t, "user": u, "assistant": a} for t, u, a in self.exchanges.get()]
        yield pd.DataFrame({"conv_id": [key[0]], "mode": [mode], "n_exchanges": [len(held)], "last_turn": [last], "exchanges": [json.dumps(held, ensure_ascii=False)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.info.clear()
        self.exchanges.clear()
        yield from ()

    def close(self) -> None:
        pass


def session_state(turns: DataFrame) -> DataFrame:
    """T-3: snapshots of conversations (conv_id, turn, role, text, ts): conv_id, mode, n_exchanges, last_turn, exchanges.

    An exchange is a user's turn that the next turn answers, both not blank and the answer without a violation; exchanges
    hold turn, user and assistant in order. A system turn "reset" empties a conversation and sets the mode back, "mode X" sets
    one of MODES; others are ignored. Each batch that brings turns of a conversation gives its snapshot.
    Exchanges are a list in the state store, to which a turn adds without reading the rest; a timer of event time
    empties a conversation IDLE_DAYS after its last turn, so a run over what is there ends and replays agree.
    Sets the session's state store to RocksDB, which list states and timers need.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = turns.withWatermark("ts", f"{IDLE_DAYS} days").groupBy("conv_id")
    out = timed.transformWithStateInPandas(_Sessions(), "conv_id long, mode string, n_exchanges long, last_turn long, exchanges string", "Update", "EventTime")
    return out.withColumn("exchanges", F.from_json("exchanges", "array<struct<turn:long,user:string,assistant:string>>"))


def running_summary(feed: DataFrame) -> DataFrame:
    """T-4: records and items of each mode so far; the same on a stream and on a table."""
    return feed.groupBy("mode").agg(F.count("*").alias("n_records"), F.sum("item_count").cast("long").alias("n_items"))


def retain_stream(feed: DataFrame, days: int = 90) -> DataFrame:
    """T-5: records of arriving history once each by (record_type, id), as long as their time is within ``days`` of the newest one seen."""
    return feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["record_type", "id"])


def retention_sink(path: str, days: int = 90):
    """T-5: a foreachBatch function that appends records to a dated table and deletes what is older than ``days`` before the newest of its records."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table = DatedTable(batch.sparkSession, path, batch.schema)
        table.append(batch, batch_id)
        dates = table.dates()
        if dates:
            newest = table.rows(since=datetime.combine(dates[-1], time.min)).agg(F.max("ts")).first()[0]
            table.retain(newest, days)

    return run


def retained(feed: DataFrame, days: int = 90) -> DataFrame:
    """T-5: what the dated table holds after all batches of a stream of history."""
    folder = work_folder(feed.sparkSession)
    once = retain_stream(feed, days)
    once.writeStream.foreachBatch(retention_sink(folder, days)).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return DatedTable(feed.sparkSession, folder, once.schema).rows()


HISTORY = "id long, record_type string, filename string, ts timestamp, mode string, item_count long, severity_level string"


def review_sink(path: str, verifiers: Sequence[Verifier] = VERIFIERS):
    """T-1: a foreachBatch function over documents (doc_id, text, response_text, mode, ts) with three sinks under ``path``.

    routes: the route of each AUDIT document; findings: those of the chain over its response, where the route is an audit;
    redactions: redacted text and safe entities of each REDACTION document; history: a dated record for each audit and each
    redaction. Each sink is written under the batch number, so that a batch that comes again adds nothing, whichever
    sinks it had reached.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}"), spark.read.schema(df.schema).parquet(f"{path}/{name}/batch={batch_id}"))[1]
        batch = keep(batch.select("doc_id", "text", "response_text", F.upper("mode").alias("mode"), "ts"), "_incoming")
        routed = keep(route_documents(batch.where("mode = 'AUDIT'")).select("doc_id", "ts", "route"), "routes")
        audits = batch.join(routed.where("route = 'audit'").select("doc_id"), "doc_id", "left_semi")
        rows = audit_chain(audits.select("doc_id", "text"), parse_issues(audits.select("doc_id", "response_text")), verifiers)
        found = keep(chain_findings(rows), "findings")
        redacted = keep(redaction_rows(redact_documents(batch.where("mode = 'REDACTION'").select("doc_id", "text"))), "redactions")
        name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename")
        level = lambda n: F.when(n > 0, "HIGH").otherwise("LOW").alias("severity_level")
        n = F.coalesce("n", F.lit(0)).cast("long")
        counted = audits.select("doc_id", "ts").join(found.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
        audited = counted.select(F.col("doc_id").alias("id"), F.lit("audit").alias("record_type"), name, "ts", F.lit("AUDIT").alias("mode"), n.alias("item_count"), level(n))
        masked = redacted.join(batch.select("doc_id", "ts"), "doc_id")
        hidden = F.col("redaction_count").cast("long")
        masked = masked.select(F.col("doc_id").alias("id"), F.lit("redaction").alias("record_type"), "filename", "ts", F.lit("REDACTION").alias("mode"), hidden.alias("item_count"), level(hidden))
        DatedTable(spark, f"{path}/history", HISTORY).append(audited.unionByName(masked), batch_id)

    return run


def reviewed(docs: DataFrame, path: str, checkpoint: str, verifiers: Sequence[Verifier] = VERIFIERS) -> StreamingQuery:
    """T-1: a stream of documents into the sinks of ``review_sink``, until all that is there has been read."""
    return docs.writeStream.foreachBatch(review_sink(path, verifiers)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
