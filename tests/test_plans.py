"""Plan guard: no registered query plans a cartesian product or a nested-loop join, neither in its own
plan nor in the jobs that run while it is built."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from spanwise.plans import catalog

SMOKE = "/root/testdata/sf0.001"
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def fresh_tables():
    catalog._TABLES.clear()  # so that the ingest is built, and seen, here


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_no_cartesian_or_nested_loop(spark, name, monkeypatch):
    plans = []
    collect, parquet = DataFrame.collect, DataFrameWriter.parquet

    def seen_collect(self):
        plans.append(plan_of(self))
        return collect(self)

    def seen_parquet(self, *args, **kwargs):
        plans.append(plan_of(self._df))
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "collect", seen_collect)
    monkeypatch.setattr(DataFrameWriter, "parquet", seen_parquet)
    plans.append(plan_of(catalog.REGISTRY[name][0](spark, SMOKE)))
    assert not [b for b in BAD if any(b in p for p in plans)]
