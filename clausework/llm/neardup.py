"""MinHash near-deduplication with HyperMinHash registers.

A text's set of five-word shingles is hashed into registers, one minimum per bucket;
a register keeps the minimum's leading-zero count and the mantissa bits after it.
Bands of compressed registers give candidates, the collision-corrected estimate of the
Jaccard similarity drops the hopeless ones, and the full sets decide the rest exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.graph import components, local_roots
from clausework.llm.joins import LEAST_HOT, MOST_HOT, hot_keys, spread_join
from clausework.llm.scratch import materialize
from clausework.llm.words import as_bytes, mix, shingle_set, word_hashes

ROWS = 4
BANDS = 48
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Bands of up to this many different sets compare all pairs at once; larger ones go by a hub and by blocks.
SMALL_BAND = 8
#: Classes on either side of a block pair, about.
BLOCK = 512

_EMPTY = np.uint16(0xFFFF)
_PROBES = 96
_RNG = np.random.default_rng(5)
_PROBE = np.stack([_RNG.integers(0, REGISTERS, REGISTERS) for _ in range(_PROBES)])


def _compress(least: np.ndarray) -> np.ndarray:
    """Leading-zero count (6 bits) and the MANTISSA bits that follow the leading one."""
    zeros = (63 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64)))).clip(0, 62).astype(np.uint64)
    after = (least << zeros) << np.uint64(1)
    return ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS compressed registers per set.

    A bucket without elements borrows from the bucket that a fixed probe sequence names,
    so that two sets' registers agree with a probability of their Jaccard similarity.
    Empty sets keep empty registers.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    if sizes.sum():
        h = np.concatenate(sets)
        bucket = (((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
        at = np.repeat(np.arange(len(sets), dtype=np.int64) * REGISTERS, sizes) + bucket
        np.minimum.at(least, at, mix(h, salt=11) >> np.uint64(1))
    least = least.reshape(len(sets), REGISTERS)
    filled = least != np.iinfo(np.uint64).max
    out = np.where(filled, _compress(least), _EMPTY)
    todo = np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1))
    if not len(todo):
        return out
    own, had = out[todo].copy(), filled[todo]
    rows, missing = own.copy(), ~had
    for probe in _PROBE:
        if not missing.any():
            break
        take = missing & had[:, probe]
        rows[take] = own[:, probe][take]
        missing &= ~take
    for i in np.flatnonzero(missing.any(axis=1)):  # few elements: the next bucket that has one
        have = np.flatnonzero(had[i])
        gaps = np.flatnonzero(missing[i])
        rows[i, gaps] = own[i, have[np.searchsorted(have, gaps) % len(have)]]
    out[todo] = rows
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
        packed: list[bytes | None] = [None] * len(texts)
        sums = np.zeros((2, len(texts)), dtype=np.uint64)
        held: list[int] = []

        def flush(held: list[int], sets: list = sets, packed: list = packed) -> None:
            for i, row in zip(held, registers([sets[i] for i in held]), strict=True):
                packed[i] = row.tobytes() if len(sets[i]) else None
                sets[i] = sets[i][:0]

        sizes = np.zeros(len(texts), dtype=np.int64)
        kept = 0
        for i, words in word_hashes(texts):
            sets[i] = s = shingle_set(words)
            sizes[i] = len(s)
            sums[0, i], sums[1, i] = mix(s, 21).sum(dtype=np.uint64), mix(s, 22).sum(dtype=np.uint64)
            held.append(i)
            kept += len(s)
            if len(held) >= 512 or kept >= 1 << 20:
                flush(held)
                held, kept = [], 0
        flush(held)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(packed, pa.binary())],
            names=["doc_id", "n_shingles", "f1", "f2", "registers"],
        )


def _with_set_keys(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``docs`` with two columns that together name each text's set of shingles, as in _sign."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), dtype=np.uint64)
            for i, words in word_hashes(as_bytes(batch.column(at))):
                s = shingle_set(words)
                sums[0, i], sums[1, i] = mix(s, 21).sum(dtype=np.uint64), mix(s, 22).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in sums)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(len(ids), BANDS)
        for at in range(0, len(ids), 2000):
            keys = np.stack([mix(rows[at : at + 2000, b], salt=1000 + b) for b in range(BANDS)], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at : at + 2000], BANDS))], names=["band", "rep"])


def _hopeful(threshold: float):
    chance = 2.0**-MANTISSA / 3  # two different minima agree in all kept bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t[c].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            agree = (x == y).mean(axis=1)
            estimate = np.maximum(0, (agree - chance) / (1 - chance))
            na, nb = (t[c].to_numpy().astype(np.float64) for c in ("na", "nb"))
            least, most = np.minimum(na, nb), np.maximum(na, nb)
            # five standard deviations of the estimate at the threshold; few elements add to it
            slack = 5 * np.sqrt(threshold * (1 - threshold) * (1 / REGISTERS + 0.5 / least))
            keep = (estimate >= threshold - slack) & (least >= threshold * most - 1e-9)
            yield from t.select(["a", "b"]).filter(pa.array(keep)).to_batches()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = as_bytes(batch.column(1)), batch.column(0).to_pylist()
        got, out, held = [], [], 0
        for i, words in word_hashes(texts):
            s = shingle_set(words).view(np.int64)
            got.append(ids[i])
            out.append(s)
            held += len(s)
            if held >= 1 << 19 or i == len(texts) - 1:
                lengths = np.fromiter(map(len, out), dtype=np.int32, count=len(out))
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))], names=["rep", "shingles"])
                got, out, held = [], [], 0


def _hopeful_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    side = reps.select("rep", "n_shingles", "registers")
    first = materialize(spread_join(pairs, "a", side.toDF("a", "na", "ra")), "half-pairs")
    both = spread_join(first, "b", side.toDF("b", "nb", "rb"))
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_hopeful(percent / 100), "a long, b long")


def _linked(hopeful: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Each side's hot members are dealt over several tasks."""
    hot = {c: hot_keys(hopeful, c) for c in ("a", "b")}
    both = hopeful
    if hot["a"].isEmpty() and hot["b"].isEmpty():
        both, hot = hopeful.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b"), {}
    for c, name in (("a", "sa"), ("b", "sb")) if hot else ():
        both = both.join(F.broadcast(hot[c].withColumnRenamed("_ways", f"_ways_{c}")), c, "left").withColumn(f"_deal_{c}", F.pmod(F.xxhash64("a", "b"), F.coalesce(f"_ways_{c}", F.lit(1))).cast("int")).drop(f"_ways_{c}")
        side = sets.toDF(c, name).join(F.broadcast(hot[c]), c, "left").withColumn(f"_deal_{c}", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
        both = both.join(side, [c, f"_deal_{c}"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def _block_links(percent: int):
    """Exact links between the two sides of a block pair, as (a, b) to the smallest member of each local group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["side"] == k] for k in (0, 1))
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        sides = []
        for part in (left, right):
            sizes = part["shingles"].map(len).to_numpy()
            sides.append((part["rep"].to_numpy(), part["component"].to_numpy(), sizes, np.concatenate(part["shingles"].to_numpy()), np.repeat(np.arange(len(part)), sizes)))
        (ids, comps, nl, xs, xr), (jds, jomps, nr, ys, yr) = sides
        both = np.intersect1d(xs, ys)
        common = np.zeros((len(ids), len(jds)), dtype=np.float32)
        if len(both):
            at = [np.searchsorted(both, v).clip(max=len(both) - 1) for v in (xs, ys)]
            (xr, xc), (yr, yc) = ((r[k], c[k]) for v, r, c in ((xs, xr, at[0]), (ys, yr, at[1])) for k in [both[c] == v])
            for lo in range(0, len(both), 4096):
                dense = []
                for n, r, c in ((len(ids), xr, xc), (len(jds), yr, yc)):
                    m = np.zeros((n, min(4096, len(both) - lo)), dtype=np.float32)
                    k = (c >= lo) & (c < lo + 4096)
                    m[r[k], c[k] - lo] = 1
                    dense.append(m)
                common += dense[0] @ dense[1].T
        near = 100 * common.astype(np.float64) >= percent * (nl[:, None] + nr[None, :] - common.astype(np.float64))
        i, j = np.nonzero(near & (comps[:, None] != jomps[None, :]))
        if not len(i):
            return none
        nodes, back = np.unique(np.concatenate([ids[i], jds[j]]), return_inverse=True)
        roots = local_roots(nodes, back[: len(i)], back[len(i) :])
        out = pd.DataFrame({"a": nodes, "b": roots})
        return out[out["a"] != out["b"]]

    return run


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of ``docs``, all columns, for each near-duplicate group: that of its smallest doc_id.

    Rows with a null doc_id stay. Where ids repeat, each different text of an id is judged by
    itself, so that no text goes for what another text of its id is like; of rows of one group the
    first by doc_id and all columns stays. The common case of unique ids is one anti join on slim rows.
    """
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        drop = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
        return docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")
    taken = {c.lower() for c in docs.columns}
    one, two, row, group = (next(n for n in (f"{'_' * k}{c}" for k in range(1, 99)) if n not in taken) for c in ("f1", "f2", "row", "group"))
    keyed = materialize(_with_set_keys(docs.where("doc_id is not null"), (one, two)), "keyed")
    # numbers given while the table is written: unlike a hash of id and text they cannot fall together
    names = materialize(keyed.select("doc_id", one, two).distinct().withColumn(row, F.monotonically_increasing_id()), "row-names")
    keyed = keyed.join(names, ["doc_id", one, two]).drop(one, two)
    near = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text").dropDuplicates(["doc_id"]), percent)
    grouped = keyed.join(near.select(F.col("doc_id").alias(row), F.col("component_id").alias(group)), row)
    columns = ["doc_id", *(c for c in docs.columns if c != "doc_id")]
    first = grouped.groupBy(group).agg(F.min(F.struct(*columns)).alias(row)).select(f"{row}.*")
    return docs.where("doc_id is null").unionByName(first)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text, more columns are ignored).

    Returns one row per input row: doc_id, n_shingles (size of the text's set of five-word
    shingles), component_id (smallest doc_id that can be reached by links of a Jaccard
    similarity of at least ``percent`` / 100, its own included), kept (doc_id = component_id).

    Texts without words, and null texts, have no shingles and link with nothing. Rows of the
    same doc_id and different texts each get the group of their own text; a doc_id that is the
    smallest of several classes joins them. A null doc_id keeps a
    null component_id and is kept; its text stands for no group. An empty table gives no rows.

    Equal sets form a class, for which its smallest doc_id stands, so copies never make pairs.
    Bands of few classes compare all pairs. In a larger band the hub is compared with all
    others; members that are not in the hub's component by then meet the whole band in block
    pairs, each one task that counts common shingles of the full sets and returns a spanning
    forest. Hot bands are found by their counts and joined by broadcast, hubs' pairs are dealt over
    several tasks; SMALL_BAND only tells which of two exact ways is cheaper. No pair of candidates is dropped but by the estimate, which leaves five standard
    deviations, or because its ends are connected already.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_sign, "doc_id long, n_shingles long, f1 long, f2 long, registers binary"), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    # registers of one row per class: rows of the same doc_id and set are equal
    reps = signed.join(classes.hint("shuffle_merge"), ["f1", "f2", "n_shingles"]).where("doc_id = rep")
    reps = materialize(reps.dropDuplicates(["f1", "f2", "n_shingles"]).select("rep", "n_shingles", "registers"), "reps")
    banded = reps.select("rep", "registers").mapInArrow(_bands, "band long, rep long")
    sizes = materialize(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    # the few hot bands are told apart by a broadcast and not shuffled by band
    least_hot = max(LEAST_HOT, BANDS * reps.count() // MOST_HOT)
    hot = F.broadcast(sizes.where(F.col("n") > least_hot))
    cold = banded.join(hot.select("band"), "band", "left_anti").join(sizes.where(F.col("n") <= least_hot), "band")
    shared = materialize(cold.unionByName(banded.join(hot, "band")), "bands")
    few = shared.where(f"n <= {SMALL_BAND}").select("band", "rep")
    pairs = few.select("band", F.col("rep").alias("a")).join(few.select("band", F.col("rep").alias("b")), "band").where("a < b").select("a", "b")
    many = shared.where(f"n > {SMALL_BAND}").select("band", "rep", "n")
    # the hub of a band is the class that is in most large bands: of variants of a text, the one nearest to all
    often = many.groupBy("rep").agg(F.count("*").alias("bands"))
    hubs = many.join(often, "rep").groupBy("band").agg(F.max(F.struct("bands", "rep"))["rep"].alias("hub"))
    hubs = materialize(hubs, "hubs")
    hot_hubs = F.broadcast(hubs.join(hot.select("band"), "band"))
    many = many.where(F.col("n") <= least_hot).join(hubs, "band").unionByName(many.where(F.col("n") > least_hot).join(hot_hubs, "band"))
    many = materialize(many, "large-bands")
    stars = many.where("rep != hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "pairs")
    hopeful = materialize(_hopeful_pairs(pairs, reps, percent), "hopeful")
    needed = hopeful.select(F.explode(F.array("a", "b")).alias("needed")).unionByName(many.select(F.col("rep").alias("needed"))).distinct()
    texts = docs.join(needed.hint("shuffle_merge"), docs["doc_id"] == needed["needed"], "left_semi")
    sets = materialize(texts.mapInArrow(_sets, "rep long, shingles array<long>"), "sets")
    links = materialize(_linked(hopeful, sets, percent), "links")
    own = components(links, "a", "b").toDF("rep", "component")
    # members outside the component of their band's hub may link with any member of the band
    named = many.join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    hub_parts = hubs.join(own.toDF("hub", "hub_component"), "hub", "left").select("band", F.coalesce("hub_component", "hub").alias("hub_component"))
    hub_parts = materialize(hub_parts, "hub-components")
    hot_parts = F.broadcast(hub_parts.join(hot.select("band"), "band"))
    named = named.where(F.col("n") <= least_hot).join(hub_parts, "band").unionByName(named.where(F.col("n") > least_hot).join(hot_parts, "band"))
    named = materialize(named.select("band", "n", "rep", "component", (F.col("component") != F.col("hub_component")).alias("outside")), "members")
    blocks = named.groupBy("band").agg(F.max("n").alias("n"), F.count_if("outside").alias("out")).where("out > 0")
    blocks = materialize(blocks.select("band", (F.col("n") > least_hot).alias("hot"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n"), F.ceil(F.col("out") / BLOCK).cast("int").alias("out")), "blocks")
    own_parts = named.drop("n")
    placed = own_parts.join(blocks.where("not hot").drop("hot"), "band").unionByName(own_parts.join(F.broadcast(blocks.where("hot").drop("hot")), "band")).withColumn("h", F.xxhash64("rep", "band"))
    inner = placed.where("outside").select("band", F.expr("cast(pmod(h, out) as int)").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), "rep", "component", F.lit(0).alias("side"))
    outer = placed.select("band", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("i"), F.expr("cast(pmod(h, n) as int)").alias("j"), "rep", "component", F.lit(1).alias("side"))
    facing = inner.unionByName(outer).join(sets, "rep").groupBy("band", "i", "j").applyInPandas(_block_links(percent), "a long, b long")
    links = links.unionByName(materialize(facing.distinct(), "block-links"))
    groups = components(links, "a", "b")
    rows = signed.select("doc_id", "n_shingles", "f1", "f2").join(classes.hint("shuffle_merge"), ["f1", "f2", "n_shingles"], "left")
    rows = rows.join(groups.withColumnRenamed("node", "rep").hint("shuffle_merge"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
