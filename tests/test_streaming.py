import os
import tempfile

from spanwise.config import DEFAULT
from spanwise.streaming.refresh import start_refresh

HEADER = "oblast,raion,hromada,level,started_at,finished_at,source\n"


def test_refresh_stream_rebuilds_episodes(spark):
    root = tempfile.mkdtemp(prefix="spanwise-stream-", dir="/tmp")
    inp, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(inp)
    with open(os.path.join(inp, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write(HEADER + "Сумська область,,,oblast,2024-01-01 10:00:00+00:00,2024-01-01 11:00:00+00:00,a\n")
    q = start_refresh(spark, inp, out, DEFAULT, checkpoint=ck)
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(out, "episodes")).count() == 1
    with open(os.path.join(inp, "b.csv"), "w", encoding="utf-8") as fh:
        fh.write(HEADER + "Сумська область,Сумський,,raion,2024-01-01 10:30:00+00:00,2024-01-01 12:00:00+00:00,a\n"
                 "Одеська область,,,oblast,2024-01-02 10:00:00+00:00,2024-01-02 10:10:00+00:00,a\n")
    q = start_refresh(spark, inp, out, DEFAULT, checkpoint=ck)
    q.awaitTermination(120)
    eps = {(r.region, r.started_at.hour, r.finished_at.hour) for r in spark.read.parquet(os.path.join(out, "episodes")).collect()}
    assert eps == {("Сумська", 10, 12), ("Одеська", 10, 10)}
