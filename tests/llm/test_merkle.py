"""Merkle manifest against a tree built with hashlib, node by node."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spanwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, key string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def paths(nodes):
    """Root of a list of nodes, and per node its (left, right) flanks from the node up."""
    flanks, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for k, p in enumerate(at):
            run = runs[p // 2]
            flanks[k].append(("".join(run[: p % 2]), "".join(run[p % 2 + 1 :])))
            at[k] = p // 2
        nodes = [h(*run) for run in runs]
    return nodes[0], flanks


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text); what ``verified_copy`` returns, sorted."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subs, found = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, flanks = paths([leaf_of(r) for r in mine])
        subs.append(root)
        found.append((mine, flanks))
    root, upper = paths(subs)
    out = []
    for (mine, flanks), sub, up in zip(found, subs, upper, strict=True):
        for r, own in zip(mine, flanks, strict=True):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            for left, right in own + up:
                acc = h(left, acc, right)
            out.append((r[0], leaf_of(r), sub, root, h(*[x for f in own + up for x in f]), acc, acc == root))
    return sorted(out, key=repr)


def rows_for(rng, n):
    texts = ["", None, "a", "žluť €", "x" * 100_000, "line\nline"]
    rows = [(rng.choice([None, *range(40)]) if i % 9 == 0 else i * 3, rng.choice([None, "s1", "s2"]), rng.choice([None, "", "de", "en", "en", "en", "ž"]),
             rng.choice([None, 0, 17, 2**40]), rng.choice(texts)) for i in range(n)]
    rows += rows[:5] + rows[:2]  # repeated rows
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "block"), [(1, 256), (2, 2), (70, 4), (151, 2), (300, 256)])
def test_against_hashlib(spark, n, block):
    rows = rows_for(random.Random(n), n)
    got = sorted(map(tuple, merkle.verified_copy(frame(spark, rows), block).collect()), key=repr)
    assert got == brute(rows)
    assert all(x[-1] for x in got) == (not any(x[5] != x[3] for x in got))


def test_proof_finds_every_change(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, f"text {i}") for i in range(50)]
    df = frame(spark, rows)
    kept = merkle.manifest(df)
    assert {r.verified for r in kept.collect()} == {True}
    bad = merkle.manifest(df, suspect={"text": F.when(F.col("doc_id") == 31, "other").otherwise(F.col("text"))})
    assert [r.doc_id for r in bad.collect() if not r.verified] == [31]


def test_empty_table(spark):
    assert merkle.verified_copy(frame(spark, []).limit(0)).collect() == []


def test_block_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        merkle.manifest(frame(spark, [(1, "s", "en", 1, "t")]), block=3)


def test_against_sql_with_nulls(spark):
    rows = [r for r in rows_for(random.Random(5), 60) if r[0] is not None and r[4] != "x" * 100_000]
    got = sorted(map(tuple, merkle.verified_copy(frame(spark, rows)).collect()), key=repr)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(merkle.oracle()).fetchall(), key=repr) == got
