"""Dense features of whole texts, computed in batches and carried beside all other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.words import CHUNK_BYTES, as_bytes

FOLDS = 4
HELD_OUT = 2

_UPPER, _LOWER, _DIGIT, _SPACE, _BANG, _STOP, _SYMBOL, _HIGH = range(8)
_KIND = np.full(256, _SYMBOL, dtype=np.uint8)
_KIND[:33] = _SPACE
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_KIND[list(b"!?")] = _BANG
_KIND[list(b".,;:'\"()-")] = _STOP
KINDS = 8


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out, a null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def byte_kinds(text: bytes) -> np.ndarray:
    """Number of bytes of each kind."""
    out = np.zeros(KINDS, dtype=np.int64)
    for at in range(0, len(text), CHUNK_BYTES):
        out += np.bincount(_KIND[np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - at), at)], minlength=KINDS)
    return out


def with_features(docs: DataFrame, features: Callable[[list[bytes]], np.ndarray], out: str = "_features") -> DataFrame:
    """``docs`` with an array<double> column ``out`` from its text column; all other columns pass through."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = features(as_bytes(batch.column(at)))
            offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def dot(features: str, weights: Sequence[float]) -> Column:
    """The weighted sum of an array column's values."""
    total = F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.get(features, F.lit(k))
    return total


def labelled_ids(labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The rows (doc_id, label) that are labelled 0 or 1 and not held out; with ``rows`` at most so many, the first by a hash of doc_id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    return known if rows is None else known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_sample(features: DataFrame, labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The rows (doc_id, fold, _features, label) of ``features`` with one of the labelled_ids."""
    sample = features.select("doc_id", "_features").join(labelled_ids(labels, label, rows), "doc_id")
    return sample.select("doc_id", fold(F.col("doc_id")).alias("fold"), "_features", "label")
