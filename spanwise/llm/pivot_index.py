"""Operator 5, embedding near-duplicates: a pivot-permutation index.

Every distinct vector is described by its PREFIX nearest pivots, in order of distance.  Pivots are a
hashed sample of the vectors, about 2 * sqrt(n) of them and at most MAX_PIVOTS per dimension (only the
index is fitted on a sample; every vector is indexed).  Inverted lists hold, per pivot, the vectors
that have it in their description; a pair is retrieved when it shares at least SHARED pivots.  Such a
pair meets in one of the first ``PREFIX - SHARED + 1`` lists of either vector when pivots are ordered
by list size, shortest first, so only these are kept; it is verified once, at its first common pivot,
by cosine in double precision.

Lists are cut into blocks of BLOCK vectors and compared block against block in numpy; a task returns
link counts per vector and a spanning forest of its links, never the pairs.  Equal vectors collapse
before all this and count with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import Tables
from spanwise.llm.components import components, forest

THRESHOLD = 0.95
PREFIX, SHARED = 8, 3
MAX_PIVOTS = 4096
PIVOT_GAP = 0.8  # pivots of a higher cosine than this to an earlier one are dropped
BLOCK = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-sized list column to unit rows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(reps: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivot vectors per dimension; at most about MAX_PIVOTS rows of each reach the driver."""
    share = F.lit(1.0)
    for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect():
        want = min(MAX_PIVOTS, max(16, int(2 * math.sqrt(r["n"]))))
        if r["n"] > want:
            share = F.when(F.col("dim") == r["dim"], F.lit(want / r["n"])).otherwise(share)
    chosen = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)).select("dim", "rep", "vec").orderBy("dim", "rep").toArrow()
    out = {}
    for dim in set(chosen["dim"].to_pylist()):
        rows = chosen.filter(pc.equal(chosen["dim"], dim))["vec"].combine_chunks()
        points = _matrix(rows)
        close = np.zeros(len(points), dtype=bool)  # a crowd of near copies is described by one pivot
        for i in range(len(points)):
            if not close[i]:
                close[i + 1 :] |= points[i + 1 :] @ points[i] >= PIVOT_GAP
        out[dim] = points[~close]
    return out


def _described(reps: DataFrame, pivots) -> DataFrame:
    """(rep, size, dim, vec, near): near = the nearest pivots, closest first."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            near = np.empty(batch.num_rows, dtype=object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = pivots.value.get(int(dim))
                if points is None or len(points) < PREFIX:
                    for i in at:
                        near[i] = np.zeros(1, np.int32)  # too few pivots: one list for all
                    continue
                for part in np.array_split(at, len(at) // 2048 + 1):
                    close = _matrix(batch.column("vec").take(pa.array(part))) @ points.T
                    best = np.argpartition(-close, PREFIX - 1, axis=1)[:, :PREFIX]
                    order = np.take_along_axis(best, np.argsort(-np.take_along_axis(close, best, axis=1), axis=1, kind="stable"), axis=1)
                    for i, row in zip(part, order.astype(np.int32), strict=True):
                        near[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    return reps.mapInArrow(run, "rep long, size long, dim int, vec array<float>, near array<int>")


def _compare(links_at: float):
    """Block against block: rows (a, null, links of a) and (a, b, 0) of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pivot, x, y = (table[c][0].as_py() for c in ("pivot", "x", "y"))
        block = table["block"].to_numpy()
        vec = _matrix(table["vec"].chunk(0))
        near = table["near"].to_pylist()
        names, local = np.unique(np.concatenate(near), return_inverse=True)
        has = np.zeros((len(near), len(names)), dtype=np.float32)
        has[np.repeat(np.arange(len(near)), [len(n) for n in near]), local] = 1
        rank = {p: r for p, r in zip(table["near"].chunk(0).flatten().to_pylist(), table["ranks"].chunk(0).flatten().to_pylist(), strict=True)}
        earlier = np.array([rank[p] < rank[pivot] for p in names.tolist()])
        need = min(SHARED, len(near[0]))
        rep, size = table["rep"].to_numpy(), table["size"].to_numpy()
        i, j = (np.flatnonzero(block == x), np.flatnonzero(block == y))
        found = (has[i] @ has[j].T >= need) & (has[i][:, earlier] @ has[j][:, earlier].T == 0)
        if x == y:
            found &= np.triu(np.ones(found.shape, dtype=bool), 1)
        a, b = np.nonzero(found & (vec[i] @ vec[j].T >= links_at))
        a, b = i[a], j[b]
        count = np.bincount(a, weights=size[b], minlength=len(rep)) + np.bincount(b, weights=size[a], minlength=len(rep))
        at = np.flatnonzero(count)
        edges = [(n, r) for n, r in forest(zip(rep[a].tolist(), rep[b].tolist(), strict=True)).items() if n != r]
        return pa.table({"a": pa.array(rep[at].tolist() + [n for n, _ in edges], pa.int64()), "b": pa.array([None] * len(at) + [r for _, r in edges], pa.int64()), "links": pa.array(count[at].astype(np.int64).tolist() + [0] * len(edges), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
    link with nothing; vectors of different lengths do not link.  Rows that repeat an id and a vector
    count as separate vectors of one id.  kept: the row's id is the smallest of its component.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "pivot-index")
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<float>").alias("vec"))
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("vec", lambda v: v != 0)
    base = base.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = base.where("good").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    reps = tables.store(classes.select("rep", "size", F.size("vec").alias("dim"), "vec"), "classes")
    pivots = spark.sparkContext.broadcast(_pivots(reps))
    described = tables.store(_described(reps, pivots), "described")

    lists = described.select("dim", F.explode("near").alias("pivot")).groupBy("dim", "pivot").agg(F.count("*").alias("n")).collect()  # one row per pivot
    order = {(r["dim"], r["pivot"]): k for k, r in enumerate(sorted(lists, key=lambda r: (r["n"], r["dim"], r["pivot"])))}
    kept = PREFIX - SHARED + 1
    sizes: dict[tuple[int, int], int] = {(r["dim"], r["pivot"]): r["n"] for r in lists}
    blocks = spark.sparkContext.broadcast((order, {k: -(-n // BLOCK) for k, n in sizes.items()}))

    def deal(batches):
        order, counts = blocks.value
        for batch in batches:
            dims, near, reps = batch.column("dim").to_pylist(), batch.column("near").to_pylist(), batch.column("rep").to_pylist()
            out: dict[str, list] = {c: [] for c in ("pivot", "x", "y", "block", "ranks", "row")}
            for row, (dim, pivots, rep) in enumerate(zip(dims, near, reps, strict=True)):
                ranks = [order[dim, p] for p in pivots]
                for p in sorted(pivots, key=lambda p: order[dim, p])[:kept]:
                    n = counts[dim, p]
                    own = hash((rep, p)) % n
                    for other in range(n):
                        for c, v in zip(out, (p, min(own, other), max(own, other), own, ranks, row), strict=True):
                            out[c].append(v)
                if len(out["row"]) > 20_000:
                    yield dealt(batch, out)
                    out = {c: [] for c in out}
            if out["row"]:
                yield dealt(batch, out)

    def dealt(batch, out):
        rows = batch.take(pa.array(out["row"]))
        return pa.RecordBatch.from_arrays(
            [rows.column("dim"), pa.array(out["pivot"], pa.int32()), pa.array(out["x"], pa.int32()), pa.array(out["y"], pa.int32()), pa.array(out["block"], pa.int32()),
             rows.column("rep"), rows.column("size"), rows.column("vec"), rows.column("near"), pa.array(out["ranks"], pa.list_(pa.int32()))],
            ["dim", "pivot", "x", "y", "block", "rep", "size", "vec", "near", "ranks"])

    schema = "dim int, pivot int, x int, y int, block int, rep long, size long, vec array<float>, near array<int>, ranks array<int>"
    found = described.mapInArrow(deal, schema).groupBy("dim", "pivot", "x", "y").applyInArrow(_compare(threshold), "a long, b long, links long")
    found = tables.store(found, "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"), tables)
    of_class = classes.select("vec", "rep", "size").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(F.col("vec").alias("class"), "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = base.where("good").join(of_class, F.col("vec") == F.col("class"))
    out = joined.select("vec_id", (F.col("size") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    rest = base.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
