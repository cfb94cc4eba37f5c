"""Embedding whitening by shifted CholeskyQR.

Each pass over the centred vectors adds up a Gram matrix in the tasks and factors it on the
driver (one matrix of dimension squared). The first factor comes from a shifted Gram matrix,
which is always positive definite; the rows solved against it are far better conditioned, so
that further passes make them orthonormal to double precision. The product of the factors is
the R of the whole table, and its singular values and vectors are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Gram passes at most; three make any table of full rank orthonormal.
PASSES = 6
#: Distance of the last Gram matrix from the identity at which no further pass is needed.
ORTHONORMAL = 1e-13
_EPS = np.finfo(np.float64).eps


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_width(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = batch.column(name).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(widths):
        yield int(d), batch if (widths == d).all() else batch.filter(pa.array(widths == d))


class _Centre:
    """The exact mean S / n of one dimension's vectors, kept as whole part and remainder."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.over = np.array([s % n for s in sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.over / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S) ** 2 in integers; null where it exceeds 64 bits."""
        steps = x - self.whole
        most = max(1, int(np.abs(steps).max(initial=0))) + 1
        if x.shape[1] * (most * self.n) ** 2 < 1 << 63:
            return pa.array(((steps * self.n - self.over) ** 2).sum(axis=1))
        exact = ((steps.astype(object) * self.n - self.over.astype(object)) ** 2).sum(axis=1)
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of one task's vectors, high and low 32 bits apart so that none can overflow."""
    n: dict[int, int] = {}
    high: dict[int, np.ndarray] = {}
    low: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, part in _by_width(batch, "x"):
            x = _rows(part.column("x"))
            n[d] = n.get(d, 0) + len(x)
            high[d] = high.get(d, 0) + (x >> 32).sum(axis=0)
            low[d] = low.get(d, 0) + (x & 0xFFFFFFFF).sum(axis=0)
    for d in n:
        yield pa.RecordBatch.from_pydict({"dim": [d] * d, "i": list(range(d)), "n": [n[d]] * d, "high": high[d], "low": low[d]}, pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _gram(of: dict[int, callable]):
    """Per task and length of vectors the sum of outer products of ``of[length](vectors)``, one row per line of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in _by_width(batch, "x"):
                if d in of:
                    q = of[d](_rows(part.column("x")))
                    total[d] = total.get(d, 0) + q.T @ q
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(m), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "i", "task", "line"])

    return run


def _added(lines: pa.Table) -> pa.Table:
    """One line of a matrix from all tasks' parts, always in the same order."""
    turn = np.argsort(lines["task"].to_numpy(), kind="stable")
    line = _rows(lines["line"])[turn].sum(axis=0)
    return pa.table({"dim": lines["dim"][:1], "i": lines["i"][:1], "line": pa.array([line], pa.list_(pa.float64()))})


def _gram_matrices(fit: DataFrame, of: dict[int, callable]) -> dict[int, np.ndarray]:
    """The summed matrices; the driver gets one of dimension squared for each length."""
    parts = fit.mapInArrow(_gram(of), "dim int, i int, task int, line array<double>")
    lines = parts.groupBy("dim", "i").applyInArrow(_added, "dim int, i int, line array<double>")
    found: dict[int, list] = {}
    for r in lines.toLocalIterator():
        found.setdefault(r["dim"], []).append((r["i"], r["line"]))
    return {d: np.array([line for _, line in sorted(own)]) for d, own in found.items()}


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor of the Gram matrix: of a shifted one in the first pass, and wherever it is not positive definite."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * np.linalg.norm(gram, 2)
    shift = min(shift, 1e-3 * np.linalg.norm(gram, 2)) if first else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 10 * d * _EPS * np.linalg.norm(gram, 2))


class _Whitening:
    """Components of one length's vectors: eigenvalues in falling order and unit directions as columns."""

    def __init__(self, centre: _Centre, factors: list[np.ndarray], last: np.ndarray, components: int):
        self.centre = centre
        r = np.eye(len(last))
        for f in factors:
            r = f @ r
        # the rows' Gram matrix after the last pass: the identity for vectors of full rank; where they
        # span fewer dimensions, its root puts right the directions that hold nothing
        values, turn = np.linalg.eigh(last)
        root = (turn * np.sqrt(np.maximum(values, 0))) @ turn.T
        _, sizes, axes = np.linalg.svd(root @ r)
        self.values = sizes**2 / centre.n
        self.trace = self.values.sum()
        held = self.values > len(last) * _EPS * self.values[0]
        self.count = min(components, int(held.sum()))
        self.axes = axes[: self.count].T

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.axes / np.sqrt(self.values[: self.count])


def _output(models: dict[int, _Whitening], errors: dict[int, float], kind: pa.DataType):
    schema = pa.schema([("vec_id", kind), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_width(batch, "x"):
                m = models.get(d)
                if m is None or not m.count:
                    continue
                x, k = _rows(part.column("x")), m.count
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, m.centre.n)),
                        m.centre.deviation(x).take(each),
                        pa.array(m.project(x).ravel()),
                        pa.array(np.tile(m.values[:k] / m.trace, len(x))),
                        pa.array(np.full(len(x) * k, errors[d])),
                    ],
                    schema=schema,
                )

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of ``embeddings`` (vec_id, embedding).

    Returns one row per row and component (from 1, by falling variance, ``components`` at most):
    vec_id, component, n (different vectors fitted), deviation (sum over dimensions of
    (n * x - S) ** 2, exact; null beyond 64 bits), whitened, explained (share of the variance),
    identity_error (largest entry of the whitened fit list's covariance minus the identity).

    Entries become x = floor(SCALE * c) + SHIFT, held within 53 bits. Vectors that are null,
    empty or hold a null or non-finite entry are dropped. Each different x counts once in the
    fit, every row gets its result; repeated rows too, a null vec_id is a value. Vectors of
    different lengths are fitted apart. Components without variance are left out, so that a
    single vector, equal vectors and an empty table give no rows. Further columns are ignored.

    The fit list is written once; each pass reads it and sends one matrix of dimension squared
    per task, added up line by line in as many groups as there are dimensions.
    """
    spark = embeddings.sparkSession
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    top = float(1 << 53)
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), c * SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    rows = materialize(rows.select("vec_id", x.alias("x")), "grid-vectors")
    fit = materialize(rows.select("x").distinct(), "fit-list")
    centres = {}
    own = fit.mapInArrow(_sums, "dim int, i int, n long, high long, low long").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found: dict[int, list] = {}
    for r in own.toLocalIterator():
        found.setdefault(r["dim"], []).append((r["i"], r["n"], (int(r["high"]) << 32) + int(r["low"])))
    for d, sums in found.items():
        centres[d] = _Centre(sums[0][1], [s for _, _, s in sorted(sums)])
    factors: dict[int, list[np.ndarray]] = {d: [] for d in centres}
    grams: dict[int, np.ndarray] = {}
    waiting = set(centres)
    for k in range(PASSES + 1):
        if not waiting:
            break
        of = {d: (lambda x, c=centres[d], f=tuple(factors[d]): solved(c.centred(x), list(f))) for d in waiting}
        grams |= _gram_matrices(fit, of)
        for d in list(waiting):
            off = np.abs(grams[d] - np.eye(d)).max() if k else np.inf
            if not grams[d].any() or k == PASSES or off <= ORTHONORMAL * d:
                waiting.discard(d)
            else:
                factors[d].append(_factor(grams[d], centres[d].n, not k))
    models = {d: _Whitening(centres[d], factors[d], grams[d], components) for d in centres if grams[d].any()}
    errors = _identity_errors(fit, models)
    kind = spark.createDataFrame([], rows.select("vec_id").schema).toArrow().schema.field(0).type
    name = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(_output(models, errors, kind), f"vec_id {name}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _identity_errors(fit: DataFrame, models: dict[int, _Whitening]) -> dict[int, float]:
    """How far the whitened fit list's covariance is from the identity, measured by one more pass (a column of ones adds the means)."""
    usable = {d: m for d, m in models.items() if m.count}
    if not usable:
        return {}
    of = {d: (lambda x, m=m: np.hstack([m.project(x), np.ones((len(x), 1))])) for d, m in usable.items()}
    out = {}
    for d, g in _gram_matrices(fit, of).items():
        n, means = usable[d].centre.n, g[-1, :-1] / usable[d].centre.n
        out[d] = float(np.abs(g[:-1, :-1] / n - np.outer(means, means) - np.eye(usable[d].count)).max())
    return out
