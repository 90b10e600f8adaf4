"""Connected components of links, as alternating large-star and small-star rounds.

Each round rewires every link towards the smallest neighbour of its ends until the links form stars;
a round is two aggregations and two joins, no neighbour list is ever gathered, and a hub is an
ordinary skewed join key.  Links are first thinned inside each task to a spanning forest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanwise.llm.common import Tables


def forest(pairs: list[tuple[int, int]] | zip) -> dict[int, int]:
    """Union-find: every node that occurs -> the smallest node it is connected with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _thin(batches):
    """Spanning forest of a task's links, thinned again whenever many have been read."""
    kept: list[tuple[int, int]] = []
    limit = 1 << 20
    for batch in batches:
        kept += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(kept) > limit:
            kept = [(x, r) for x, r in forest(kept).items() if x != r]
            limit = max(limit, 2 * len(kept))
    links = [(x, r) for x, r in forest(kept).items() if x != r]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], ["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v.  Large star links each larger neighbour of u to the smallest of u's neighbours
    and u itself; small star does it with u and its smaller neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stored(links: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, tuple]:
    """The links as a table, and their number and checksum, observed while it is written."""
    seen = Observation()
    sums = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")]
    table = tables.store(links.observe(seen, *sums), name)
    return table, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, tables: Tables, name: str = "components") -> DataFrame:
    """(node, component): every node that has a link, with the smallest node of its component.

    ``links``: two long columns, any order, repeats allowed; links of a node to itself and nulls do
    nothing.  An empty table gives an empty result.
    """
    a, b = links.columns[:2]
    clean = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    links, now = _stored(clean.mapInArrow(_thin, "u long, v long").distinct(), tables, f"{name}-0")
    mark, step = None, 0
    while now != mark and now[0]:
        mark, step = now, step + 1
        links, now = _stored(_star(_star(links, large=True), large=False), tables, f"{name}-{step}")
        tables.free(f"{name}-{step - 1}")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
