"""Connected components and the shared helpers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm.common import Tables, bloom_build, bloom_has, without
from spanwise.llm.components import components, forest


def brute(links):
    group = {x: {x} for link in links for x in link}
    for a, b in links:
        joined = group[a] | group[b]
        group.update(dict.fromkeys(joined, joined))
    return {x: min(g) for x, g in group.items()}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(250)]
    links += [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 6000 + i) for i in range(200)]  # a chain and a hub
    rng.shuffle(links)
    df = spark.createDataFrame(links + links[:20] + [(7, 7)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df, Tables(spark, "t")).collect()}
    want = {x: c for x, c in brute(links).items()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: c for x, c in want.items() if x in linked}
    assert components(df.limit(0), Tables(spark, "t")).count() == 0
    assert forest(links) == want


def test_bloom_and_without(spark):
    ids = spark.range(0, 3000, 3).select(F.col("id"))
    bloom = bloom_build(ids, "id")
    keys = np.arange(30_000, dtype=np.int64)
    hit = bloom_has(bloom, keys.view(np.uint64))
    assert hit[:3000:3].all() and hit.sum() < 1100
    docs = spark.range(100).select(F.when(F.col("id") < 98, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    left = without(docs, ids.where("id < 60")).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted([str(i) for i in range(98) if i >= 60 or i % 3] + ["None", "None"])
