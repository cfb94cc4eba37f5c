"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to principal axes, so that a few leading dimensions hold most of a
dot product. A tile of vectors meets the tiles that can hold a partner; dot products grow
block by block of dimensions, and a pair is dropped as soon as its partial sum plus the
product of the two suffix norms cannot reach the threshold. What is left is decided by the
cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.graph import components, local_roots
from clausework.llm.scratch import materialize

TILE = 1024
GRID = 2
SLACK = 1e-7


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else (width or 1))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of outer products of the unit vectors of one partition, one row per dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            m = _matrix(batch.column(1).filter(pa.array(dims == d)))
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            total[int(d)] = total.get(int(d), 0) + m.T @ m
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "i", "row"])


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the principal axes in falling order. The driver gets dim * dim sums."""
    parts = vectors.select("cls", "embedding").mapInArrow(_moments, "dim int, i int, row array<double>")
    sums = parts.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    out = {}
    for dim, own in sums.toPandas().groupby("dim"):
        m = np.zeros((dim, dim))
        m[own["i"], own["j"]] = own["x"]
        out[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


def _turned(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the principal axes."""
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ axes


def _rotate(axes: dict[int, np.ndarray], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                turned = _turned(_matrix(part.column(2)), axes[int(d)])
                lead = np.floor(turned[:, :GRID] / width).astype(np.int32)
                if lead.shape[1] < GRID:
                    lead = np.pad(lead, ((0, 0), (0, GRID - lead.shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(lead[:, 0]), pa.array(lead[:, 1])],
                    names=["cls", "label", "embedding", "n", "g0", "g1"],
                )

    return run


def _survivors(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two sets of unit vectors that may reach the threshold."""
    dim = x.shape[1]
    at = min(8, dim)
    rest_x, rest_y = (np.sqrt(np.maximum(0, np.cumsum(m[:, ::-1] ** 2, axis=1)[:, ::-1])) for m in (x, y))
    part = x[:, :at] @ y[:, :at].T
    bound = part + np.outer(rest_x[:, at], rest_y[:, at]) if at < dim else part
    i, j = np.nonzero(bound >= threshold - SLACK)
    part = part[i, j]
    while at < dim and len(i):
        to = min(dim, 2 * at)
        part = part + np.einsum("ij,ij->i", x[i, at:to], y[j, at:to])
        bound = part + rest_x[i, to] * rest_y[j, to] if to < dim else part
        keep = bound >= threshold - SLACK
        i, j, part, at = i[keep], j[keep], part[keep], to
    return i, j


def _compare(threshold: float, axes: dict[int, np.ndarray]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, own in pdf.groupby(pdf["embedding"].map(len)):
            own = own.drop_duplicates(["cls", "side"]).sort_values("cls")
            left, right = own[own["side"] == 0], own[own["side"] == 1]
            same = not len(right) and (own["same"] == 1).all()
            right = left if same else right
            if not len(left) or not len(right) or not dim:
                continue
            # tiles travel as they are and are turned here: one copy of the vectors crosses the shuffle
            ox, oy = (np.stack(t["embedding"].to_numpy()).astype(np.float64) for t in (left, right))
            i, j = _survivors(_turned(ox, axes[dim]), _turned(oy, axes[dim]), threshold)
            if same:
                i, j = i[i < j], j[i < j]
            nx, ny = (np.sqrt((m * m).sum(axis=1)) for m in (ox, oy))
            keep = np.einsum("ij,ij->i", ox[i], oy[j]) / (nx[i] * ny[j]) >= threshold
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            nl, nr = left["n"].to_numpy(), right["n"].to_numpy()
            ids = left["cls"].to_numpy() if same else np.concatenate([left["cls"].to_numpy(), right["cls"].to_numpy()])
            b = j if same else j + len(left)
            counts = np.zeros(len(ids), dtype=np.int64)
            np.add.at(counts, i, nr[j])
            np.add.at(counts, b, nl[i])
            roots = local_roots(ids, i, b)
            hit = counts > 0
            out.append(pd.DataFrame({"cls": ids[hit], "links": counts[hit], "root": roots[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"cls": [], "links": [], "root": []}).astype("int64")

    return run


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links between vectors (vec_id, embedding, label) of the same label with a cosine of at least ``threshold``.

    Returns one row per input row: vec_id, n_links (other vectors linked directly, copies
    included), component_id (smallest vec_id reachable, its own included), kept
    (vec_id = component_id).

    A null label, and a vector that is null, empty, zero or holds a null or non-finite
    component, links with nothing; vectors of different lengths don't link. Repeated rows
    count as further vectors. A null vec_id is counted as a partner and keeps a null
    component_id. Values are compared in double precision; an empty table gives no rows.

    Equal vectors of a label are one class. Linked unit vectors lie within
    sqrt(2 - 2 * threshold), so that on the leading axes only the same and the next cells of
    that width can hold partners; cells are split into tiles of about TILE classes by hash, and
    each pair of tiles is one small group, which returns counts and local roots, never pairs.
    """
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # by its largest component, so that no square over- or underflows; a power of two keeps all digits
    largest = F.array_max(F.transform("embedding", F.abs))
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(F.when(usable, largest > 0), F.lit(False)))
    power = F.floor(F.log2(largest))
    scaled = F.transform("embedding", lambda x: x * F.pow(F.lit(2.0), -F.floor(power / 2)) * F.pow(F.lit(2.0), F.floor(power / 2) - power))
    rows = rows.withColumn("embedding", F.when(F.col("ok") & ~power.between(-300, 300), scaled).otherwise(F.col("embedding")))
    # +0.0 makes the two zeros one
    rows = rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))), 256)))
    rows = materialize(rows, "vectors")
    good = rows.where("ok")
    classes = good.groupBy("label", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    # numbers given while the table is written are read back as they are: unlike hashes they cannot fall together
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    axes = _axes(classes)
    turned = classes.select("cls", "label", "embedding", "n").mapInArrow(_rotate(axes, width), f"cls long, label {classes.schema['label'].dataType.simpleString()}, embedding array<double>, n long, g0 int, g1 int")
    turned = materialize(turned, "celled")
    cells = turned.groupBy("label", "g0", "g1").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    near = F.explode(F.expr("array(struct(0 as d0, 0 as d1), struct(0 as d0, 1 as d1), struct(1 as d0, -1 as d1), struct(1 as d0, 0 as d1), struct(1 as d0, 1 as d1))"))
    other = cells.select(F.col("label").alias("l2"), F.col("g0").alias("h0"), F.col("g1").alias("h1"), F.col("tiles").alias("tiles2"))
    pairs = cells.withColumn("d", near).selectExpr("*", "g0 + d.d0 as e0", "g1 + d.d1 as e1").join(other, F.expr("label = l2 and e0 = h0 and e1 = h1"))
    pairs = pairs.select("label", "g0", "g1", "h0", "h1", "tiles2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("s"))
    pairs = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1))).where("g0 != h0 or g1 != h1 or s <= t")
    pairs = pairs.withColumn("pair", F.monotonically_increasing_id()).withColumn("same", F.expr("cast(g0 = h0 and g1 = h1 and s = t as int)"))
    pairs = materialize(pairs, "tile-pairs")
    ends = pairs.select("label", "g0", "g1", "s", "pair", "same", F.lit(0).alias("side"))
    ends = ends.unionByName(pairs.where("same = 0").select("label", F.col("h0").alias("g0"), F.col("h1").alias("g1"), F.col("t").alias("s"), "pair", "same", F.lit(1).alias("side")))
    counted = turned.join(cells, ["label", "g0", "g1"]).withColumn("s", F.expr("cast(pmod(xxhash64(cls), tiles) as int)"))
    members = counted.join(ends, ["label", "g0", "g1", "s"]).select("pair", "side", "same", "cls", "n", "embedding")
    found = materialize(members.groupBy("pair").applyInPandas(_compare(threshold, axes), "cls long, links long, root long"), "vector-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found, "cls", "root").withColumnsRenamed({"node": "cls", "component_id": "group"})
    owned = classes.select("cls", "label", "key", "n", "least").join(groups, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    least = owned.groupBy("group").agg(F.min("least").alias("component_id"))
    owned = owned.join(least, "group").join(links, "cls", "left").select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(owned.hint("shuffle_merge"), ["label", "key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
