"""Tables that change: one keyed by hash buckets (T-2, H-9), one dated by partition (T-5, H-10, H-6).

Both are Parquet folders that any Spark session of the shared file system reads. A change
rewrites what it touches only: buckets of the keys that come, or the dates that a cut goes
through. Each has one writer at a time, like the sink of a streaming query.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.operators.results import span_starts, within

BUCKETS = 64
FOLDERS = 128
_MANIFEST = "version int, batch long, bucket int, folder string"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` in the session's file system, none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()] if system.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class KeyedTable:
    """A table with one row for each key, in buckets of the key's hash.

    A manifest of one row per bucket names the folder that holds it. A change joins the rows that
    come with the buckets they fall into, writes these buckets anew and then the next manifest;
    readers see the old rows until then, and a change that fails leaves nothing but files that no
    manifest names. A batch number that the manifest already has is not applied again. The number
    of buckets is fixed when the table is made; choose it so that a bucket is a few hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifest(self) -> DataFrame:
        """The newest manifest: version, batch, bucket, folder."""
        versions = [int(v[2:]) for v in _folders(self.spark, f"{self.path}/manifest") if v.startswith("v=")]
        done = [v for v in sorted(versions, reverse=True) if self._written(v)]
        if not done:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/v={done[0]}")

    def _written(self, version: int) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v={version}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _rows(self, folders: list[str]) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        return read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The table as it is now."""
        return self._rows([r["folder"] for r in self.manifest().where("bucket >= 0").toLocalIterator()])

    def _change(self, keys: DataFrame, apply, batch: int | None) -> int:
        """Rewrite the buckets that ``keys`` fall into by ``apply(their rows)``; the number of rewritten buckets."""
        known = {r["bucket"]: r for r in self.manifest().collect()}  # ``buckets`` rows at most, and one for the batch number
        version = max([r["version"] for r in known.values()], default=-1) + 1
        last = max([r["batch"] for r in known.values()], default=-1)
        if batch is not None and batch <= last:
            return 0
        touched = sorted(r["bucket"] for r in keys.select(self._bucket()).distinct().collect())
        held = self._rows([known[b]["folder"] for b in touched if b in known])
        new = apply(held).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        data = f"data/v={version}"
        new.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{data}")
        names = {int(name[7:]) for name in _folders(self.spark, f"{self.path}/{data}") if name.startswith("bucket=")}
        kept = [(version, last if batch is None else batch, -1, "")]
        kept += [(version, kept[0][1], b, r["folder"]) for b, r in known.items() if b >= 0 and b not in touched]
        kept += [(version, kept[0][1], b, f"{data}/bucket={b}") for b in sorted(names)]
        self.spark.createDataFrame(kept, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={version}")
        return len(touched)

    def upsert(self, rows: DataFrame, keep: Sequence[str] = (), defaults: dict[str, Column] | None = None, batch: int | None = None) -> int:
        """Put ``rows`` (one for each key) in place of those with their keys; the number of buckets written.

        Known keys keep their values of the columns ``keep``; new keys get ``defaults`` where a column is missing or null.
        """
        defaults = defaults or {}
        given = [f.name for f in self.schema if f.name in rows.columns and f.name not in self.keys]
        new = rows.select(*self.keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_comes"))

        def merged(held: DataFrame) -> DataFrame:
            both = held.withColumn("_was", F.lit(True)).join(new, self.keys, "full")

            def value(c: str) -> Column:
                old, comes = F.col(c), F.col(f"_new_{c}") if c in given else F.lit(None)
                comes = F.coalesce(comes, defaults[c]) if c in defaults else comes
                fresh = old if c in keep or c not in given else comes
                return F.when(F.col("_comes").isNull(), old).when(F.col("_was").isNull(), comes).otherwise(fresh).alias(c)

            return both.select(*self.keys, *[value(f.name) for f in self.schema if f.name not in self.keys])

        return self._change(rows, merged, batch)

    def delete(self, keys: DataFrame, batch: int | None = None) -> int:
        """Delete the rows with ``keys``; the number of buckets written."""
        wanted = keys.select(*self.keys).distinct()
        return self._change(wanted, lambda held: held.join(wanted, self.keys, "left_anti"), batch)

    def vacuum(self) -> int:
        """Remove the files that the newest manifest does not name; the number of folders removed. No reader may be at work."""
        named = {r["folder"] for r in self.manifest().toLocalIterator()}
        newest = max([int(v[2:]) for v in _folders(self.spark, f"{self.path}/manifest") if self._written(int(v[2:]))], default=-1)
        gone = [f"data/{v}/{b}" for v in _folders(self.spark, f"{self.path}/data") for b in _folders(self.spark, f"{self.path}/data/{v}")]
        gone = [f for f in gone if f not in named] + [f"manifest/{v}" for v in _folders(self.spark, f"{self.path}/manifest") if int(v[2:]) < newest]
        for f in gone:
            _remove(self.spark, f"{self.path}/{f}")
        return len(gone)


class DatedTable:
    """Records in folders by date of their time ``ts`` and by batch number: appended once per batch, cut by whole dates.

    A batch with records of more than ``FOLDERS`` dates is laid out by months, one with more months by years; ``date`` is
    then the first of the month or year. So its folders don't grow with the dates.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def dates(self) -> list[date]:
        """The first date of each folder."""
        return sorted(date.fromisoformat(f[5:]) for f in _folders(self.spark, self.path) if f.startswith("date=") and f[5] != "_")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write ``rows`` under the batch number; the same batch again, of the same rows, writes the same folders again and adds nothing. Rows without a time go."""
        dated = rows.where("ts is not null").select(*[f.name for f in self.schema], F.to_date("ts").alias("date"), F.lit(batch).cast("long").alias("batch"))
        dated = dated.persist()  # rows of a stream are made once
        try:
            days, months = dated.select("date").distinct().agg(F.count("*"), F.count_distinct(F.trunc("date", "month"))).first()
            laid = dated if days <= FOLDERS else dated.withColumn("date", F.trunc("date", "month" if months <= FOLDERS else "year"))
            laid.hint("rebalance", "date").sortWithinPartitions("date", "batch", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(self.path)
        finally:
            dated.unpersist()

    def rows(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Records of a time span (both ends in it); the dates of the span reach the scan as partition filters."""
        if not self.dates():
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema, T.StructField("date", T.DateType()), T.StructField("batch", T.LongType())])
        return within(self.spark.read.schema(full).parquet(self.path), since, until).select(*[f.name for f in self.schema])

    def retain(self, now: datetime, days: int = 90, by: Sequence[str] = ()) -> DataFrame:
        """H-10: delete records older than ``days`` days before ``now``; (the columns ``by``, n_deleted, n_kept).

        Folders of earlier dates go whole, those that the cut goes through are written anew (its day, and
        its month or year where a batch is laid out so), later ones are not touched. Counts come first, from the columns ``by`` and ``ts`` alone.
        """
        self._finish_edge()
        cut = now - timedelta(days=days)
        old = F.col("ts") < F.lit(cut)
        counted = self.rows().groupBy(*by).agg(F.count_if(old).alias("n_deleted"), F.count_if(~old).alias("n_kept")).collect() if by else self.rows().agg(F.count_if(old).alias("n_deleted"), F.count_if(~old).alias("n_kept")).collect()
        report = [tuple(r) for r in counted]  # one row for each kind of record
        kinds = T.StructType([*[self.schema[c] for c in by], T.StructField("n_deleted", T.LongType()), T.StructField("n_kept", T.LongType())])
        edges = span_starts(cut.date())
        for d in self.dates():
            if d < cut.date() and d not in edges:
                _remove(self.spark, f"{self.path}/date={d}")
        for d in sorted({*self.dates()} & {*edges}):
            edge = f"date={d}"
            for b in _folders(self.spark, f"{self.path}/{edge}"):
                here = self.spark.read.schema(self.schema).parquet(f"{self.path}/{edge}/{b}")
                gone, left = here.agg(F.count_if(old), F.count_if(~old)).first()
                if not left:
                    _remove(self.spark, f"{self.path}/{edge}/{b}")
                elif gone:
                    here.where(~old).write.mode("overwrite").parquet(f"{self.path}/_edge/{edge}/{b}")
            if not _folders(self.spark, f"{self.path}/{edge}"):
                _remove(self.spark, f"{self.path}/{edge}")
        self._finish_edge()
        return self.spark.createDataFrame(report, kinds)

    def _finish_edge(self) -> None:
        """Put what is left of a date in its place: written aside in whole first, so that a cut that was broken off is finished by the next."""
        for d in _folders(self.spark, f"{self.path}/_edge"):
            for b in _folders(self.spark, f"{self.path}/_edge/{d}"):
                aside = f"{self.path}/_edge/{d}/{b}"
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/_SUCCESS")
                if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                    self.spark.read.schema(self.schema).parquet(aside).write.mode("overwrite").parquet(f"{self.path}/{d}/{b}")
                _remove(self.spark, aside)
            _remove(self.spark, f"{self.path}/_edge/{d}")
