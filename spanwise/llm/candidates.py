"""From lists of items that share a key to components of verified links.

Two passes instead of all pairs of a list.  First every item is compared with its list's head and
the verified links are connected.  Then, in lists whose items still lie in several components, the
items outside the list's main component are compared with the items of other components.  A pair
inside one component can add nothing, so no link that joins two components is lost; a group of n
near copies costs about n pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import Tables
from spanwise.llm.components import components, forest


BLOCK = 2048  # items of a list compared with as many others at a time
CELLS = 1 << 23  # of the incidence matrix held at a time


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shared keys of every left with every right set: a sparse product in blocks of keys
    (only keys that occur more than once take part)."""
    sizes = [len(x) for x in left] + [len(x) for x in right]
    flat = np.concatenate([np.empty(0, np.uint64), *left, *right])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = count[column] > 1
    names, column = np.unique(column[keep], return_inverse=True)
    row, total = row[keep], np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(1, CELLS // max(1, len(sizes)))
    for start in range(0, len(names), width):
        at = (column >= start) & (column < start + width)
        part = np.zeros((len(sizes), min(width, len(names) - start)), dtype=np.float32)
        part[row[at], column[at] - start] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def block_links(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): groups g of ``marked`` (h, doc, g, main) that a pair at Jaccard 0.75 in some list h connects.

    Items outside a list's main group meet all items of the list, BLOCK by BLOCK; a block returns a
    spanning forest of the groups it connects, never pairs of items."""
    counts = marked.groupBy("h").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("ny"), F.ceil(F.count_if(F.col("g") != F.col("main")) / BLOCK).cast("int").alias("nx"))
    rows = marked.join(counts, "h").join(sets, "doc")
    of = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    places = lambda n, own, side: F.transform(
        F.sequence(F.lit(0), F.col(n) - 1),
        lambda k: F.struct((of(own) if side == "x" else k).alias("x"), (k if side == "x" else of(own)).alias("y"), F.lit(side == "x").alias("left")))
    as_y = places("nx", "ny", "y")
    as_x = F.when(F.col("g") != F.col("main"), F.concat(places("ny", "nx", "x"), as_y)).otherwise(as_y)
    rows = rows.select("h", "g", "keys", F.explode(as_x).alias("p")).select("h", "p.x", "p.y", "p.left", "g", "keys")

    def compare(group):
        left, right = ([(g, k) for side, g, k in group if side is want] for want in (True, False))
        if not left or not right:
            return {}
        a, b = ([np.frombuffer(k, np.uint64) for _, k in part] for part in (left, right))
        both, na, nb = overlaps(a, b), np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ga, gb = np.array([g for g, _ in left]), np.array([g for g, _ in right])
        i, j = np.nonzero((4 * both >= 3 * (na[:, None] + nb[None, :] - both)) & (ga[:, None] != gb[None, :]))
        return forest(zip(ga[i].tolist(), gb[j].tolist(), strict=True))

    def run(batches):
        now, group = None, []
        for batch in batches:
            for *at, left, g, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now and group:
                    yield from found(compare(group))
                    group = []
                now = at
                group.append((left, g, keys))
        yield from found(compare(group))

    def found(roots):
        links = [(n, r) for n, r in roots.items() if n != r]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], ["a", "b"])

    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(run, "a long, b long")


def linked_components(lists: DataFrame, verify: Callable[[DataFrame, str], DataFrame], tables: Tables,
                      near: Callable[[str, str], Column] | None = None, sets: DataFrame | None = None) -> DataFrame:
    """(node, component) of all items that have a verified link.

    ``lists``: (h, doc, ...) with items that share key h; ``verify(pairs, name)``: the linked ones of
    pairs (a, b); ``near(x, y)``: a condition on two lists' rows that every linked pair meets at some h.
    With ``sets`` (doc, keys), for small sets, the second pass compares lists block against block
    (``block_links``) instead of making rows of their pairs.
    """
    near = near or (lambda x, y: F.lit(True))
    others = [c for c in lists.columns if c not in ("h", "doc")]
    heads = lists.groupBy("h").agg(F.min(F.struct("doc", *others)).alias("x"))
    star = lists.alias("y").join(heads, "h").where("y.doc <> x.doc").where(near("x", "y"))
    star = tables.store(star.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct(), "star")
    links = verify(star, "star")
    groups = components(links, tables, "star-groups")

    group = F.coalesce("component", "doc").alias("g")
    marked = lists.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("h", "doc", *others, group)
    per = marked.groupBy("h", "g").agg(F.count("*").alias("c"))
    per = per.groupBy("h").agg(F.max_by("g", F.struct("c", "g")).alias("main"), F.count("*").alias("gs"))
    marked = tables.store(marked.join(per.where("gs > 1").select("h", "main"), "h"), "mixed")
    stars = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    if sets is not None:
        more = tables.store(block_links(marked, sets), "cross-links")
        tables.free("mixed", "star")
        return components(stars.union(more), tables, "groups")
    cross = marked.where("g <> main").alias("x").join(marked.alias("y"), "h").where("x.g <> y.g").where(near("x", "y"))
    cross = cross.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    cross = tables.store(cross.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross")
    more = verify(cross, "cross")
    tables.free("mixed", "star", "cross")
    return components(stars.union(more.select("a", "b")), tables, "groups")
