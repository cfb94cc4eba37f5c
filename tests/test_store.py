"""Tables that change: what a change touches, what a repeated batch does, and what the plans read."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausework.operators import results
from clausework.sources.store import DatedTable, KeyedTable
from clausework.streaming import streams

SCHEMA = "id long, name string, n long"


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["id"], 16)
    assert table.rows().count() == 0
    assert table.upsert(spark.range(200).selectExpr("id", "concat('a', id) as name", "id as n"), batch=0) == 16
    before = {r.bucket: r.folder for r in table.manifest().collect()}
    assert table.upsert(spark.createDataFrame([(7, -1), (1000, -2)], "id long, n long"), keep=["name"], defaults={"name": F.lit("new")}, batch=1) <= 2
    after = {r.bucket: r.folder for r in table.manifest().collect()}
    assert sum(before[b] != after[b] for b in before if b >= 0) <= 2
    got = {r.id: (r.name, r.n) for r in table.rows().collect()}
    assert len(got) == 201 and got[7] == ("a7", -1) and got[1000] == ("new", -2) and got[8] == ("a8", 8)
    # the same batch again, and an older one, change nothing
    kept = files(tmp_path)
    assert table.upsert(spark.createDataFrame([(7, 5)], "id long, n long"), batch=1) == 0 and files(tmp_path) == kept
    assert table.delete(spark.range(100), batch=2) == 16 and table.rows().count() == 101
    assert table.vacuum() > 0 and table.rows().count() == 101
    assert table.delete(spark.range(2000)) == 16 and table.rows().count() == 0
    # a change that broke off before its manifest is not seen
    spark.range(5).write.parquet(f"{tmp_path}/data/v=99/bucket=0")
    (tmp_path / "manifest/v=99").mkdir()
    assert table.rows().count() == 0
    assert table.upsert(spark.range(3).selectExpr("id"), batch=3) and table.rows().count() == 3


def records(spark, days):
    return spark.createDataFrame([(k, "audit" if k % 2 else "redaction", datetime(2024, 1, 1 + d, 12)) for k, d in enumerate(days)], "id long, record_type string, ts timestamp")


def test_retention_drops_dates_and_rewrites_one(spark, tmp_path):
    rows = records(spark, [0, 0, 1, 2, 2, 3, 9])
    table = DatedTable(spark, str(tmp_path), rows.schema)
    table.append(rows, 0)
    early = spark.createDataFrame([(50, "audit", datetime(2024, 1, 3, 1)), (51, "audit", None)], rows.schema)
    table.append(early, 1)
    table.append(early, 1)
    assert table.rows().count() == 8  # a record without a time is not kept; the repeated batch adds nothing
    later = files(tmp_path / "date=2024-01-04") | files(tmp_path / "date=2024-01-10")
    report = {r.record_type: (r.n_deleted, r.n_kept) for r in table.retain(datetime(2024, 1, 6, 6), 3, ["record_type"]).collect()}
    assert report == {"audit": (2, 2), "redaction": (2, 2)}
    assert sorted(r.id for r in table.rows().collect()) == [3, 4, 5, 6]
    assert [str(d) for d in table.dates()] == ["2024-01-03", "2024-01-04", "2024-01-10"]
    assert (files(tmp_path / "date=2024-01-04") | files(tmp_path / "date=2024-01-10")) == later
    # what was written aside before a failure is put in its place by the next cut
    rows.where("id = 3").write.parquet(f"{tmp_path}/_edge/date=2024-01-03/batch=0")
    table.retain(datetime(2024, 1, 6, 6), 3)
    assert sorted(r.id for r in table.rows().collect()) == [3, 5, 6]
    assert DatedTable(spark, str(tmp_path / "none"), rows.schema).retain(datetime(2024, 1, 6), 3, ["record_type"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_times_prune_dates(spark, tmp_path):
    rows = records(spark, range(20)).withColumns({"mode": F.lit("AUDIT"), "filename": F.lit("f"), "severity_level": F.lit("LOW")})
    table = DatedTable(spark, str(tmp_path), rows.schema)
    table.append(rows, 0)
    stored = spark.read.parquet(str(tmp_path))
    since, until = datetime(2024, 1, 5), datetime(2024, 1, 7)
    for df in (results.filter_history(stored, since=since, until=until), table.rows(since, until)):
        filters = next(line for line in plan(df).splitlines() if "FileScan" in line)
        assert "PartitionFilters: [isnotnull(date" in filters and "date#" in filters.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert sorted(r.id for r in df.collect()) == [4, 5]
    after = results.page_after(stored, (datetime(2024, 1, 5, 12), "redaction", 4), 3)
    assert [r.id for r in after.collect()] == [3, 2, 1] and "TakeOrderedAndProject" in plan(after) and "(date#" in plan(after).split("PartitionFilters")[1]


def test_sessions_by_batches(spark, tmp_path):
    turns = [[(1, 0, "user", "hi"), (2, 0, "system", "mode redaction"), (2, 1, "user", "q")], [(1, 1, "assistant", "hello"), (2, 2, "system", "reset"), (2, 3, "assistant", "late")], [(1, 2, "user", "x"), (1, 3, "assistant", "as an AI I cannot"), (1, 4, "user", "y"), (1, 5, "assistant", "fine")]]
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    for k, batch in enumerate(turns):
        spark.createDataFrame([(*t, datetime(2024, 1, 1, 0, k)) for t in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.drained(streams.session_state(stream), "update").collect()
    one = [(r.n_exchanges, [(e.turn, e.user, e.assistant) for e in r.exchanges]) for r in sorted(got, key=lambda r: r.last_turn) if r.conv_id == 1]
    assert one == [(0, []), (1, [(0, "hi", "hello")]), (2, [(0, "hi", "hello"), (4, "y", "fine")])]
    assert [(r.mode, r.n_exchanges) for r in sorted(got, key=lambda r: r.last_turn) if r.conv_id == 2] == [("REDACTION", 0), ("AUDIT", 0)]


@pytest.mark.parametrize(("step", "first"), [(3, "-01"), (40, "-01-01")])
def test_many_dates_lie_in_few_folders(spark, tmp_path, step, first):
    made = lambda ids, days: spark.createDataFrame([(k, "audit", datetime(2024, 1, 1, 12) + timedelta(days=d), "AUDIT", "f", "LOW") for k, d in zip(ids, days, strict=True)], "id long, record_type string, ts timestamp, mode string, filename string, severity_level string")
    rows, late = made(range(300), range(0, 300 * step, step)), made([1000, 1001], [200 * step, 200 * step + 1])
    table = DatedTable(spark, str(tmp_path), rows.schema)
    for batch, df in enumerate((rows, late)):
        for _ in range(2):
            table.append(df, batch)
    held = sorted((r.id, r.ts) for r in rows.unionByName(late).collect())
    got = lambda df: sorted((r.id, r.ts) for r in df.collect())
    assert got(table.rows()) == held and len(list(tmp_path.glob("date=*/batch=0"))) <= 40
    assert all(p.parent.name.endswith(first) for p in tmp_path.glob("date=*/batch=0")) and len(list(tmp_path.glob("date=*/batch=1"))) == 2
    stored = spark.read.parquet(str(tmp_path))
    at = [held[k][1] for k in (0, 7, 150)] + [datetime(2024 + step * 150 // 365, 1, 1), datetime(2024 + step * 150 // 365, 6, 1)]
    for since, until in [(a, b) for a in at for b in (a, at[2], None) if b is None or a <= b]:
        wanted = [x for x in held if since <= x[1] and (until is None or x[1] <= until)]
        assert got(table.rows(since, until)) == wanted == got(results.filter_history(stored, since=since, until=until))
    assert [r.id for r in results.page_after(stored, (held[9][1], "audit", held[9][0]), 20).collect()] == list(range(8, -1, -1))
    # cuts inside a span, at its first day, and behind all but the last records
    for now in (held[100][1], datetime(at[3].year, at[3].month, 1), held[-1][1]):
        later = files(tmp_path)
        table.retain(now, 1)
        held = [x for x in held if x[1] >= now - timedelta(days=1)]
        assert got(table.rows()) == held
        edge = str((now - timedelta(days=1)).date())
        kept = {p for p in later if p.parent.parent.name > f"date={edge}"}
        assert kept and {p: later[p] for p in kept}.items() <= files(tmp_path).items()
        assert set(table.dates()) == {date.fromisoformat(p.parent.parent.name[5:]) for p in files(tmp_path)}
