"""The pipeline on a fixture with known decisions, and the registered queries."""

import random
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece  # noqa: F401
from spanwise.llm import queries
from spanwise.llm.common import BATCH_BYTES, FILE_BYTES, Tables, shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, stem):
    return ". ".join(" ".join(f"{stem}{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(10)) for _ in range(words // 10)) + "."


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(11)
    en = lambda n: prose(rng, n, "the")
    base, passage, item = en(100), en(60), en(40)
    near = base.split(" ")
    near[50] = "edited"
    rows = [(i, en(60), "en" if i % 3 else None, "s") for i in range(1, 30)] + [(i, prose(rng, 60, "ñañ"), "es", "s") for i in range(30, 50)]
    rows += [(100, base, "en", "a"), (101, base, "en", "b"), (102, " ".join(near), "en", None), (103, base.upper(), "en", "b")]
    rows += [(110 + k, en(40) + "\n" + passage + "\n" + en(40), "en", "c") for k in range(4)]
    rows += [(120, en(30) + " " + item + " " + en(30), "en", "d"), (130, None, "en", "e"), (131, "", "en", "e"), (132, "12 34 !!", "en", "e")]
    rows += [(140, "short text", "en", "f"), (140, "short text", "en", "f"), (None, en(50), "en", "g")]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, en(40))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, passage


def test_stages_take_effect(spark, fixture):
    folder, rows, passage = fixture
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = ids(docs)
    everything = sorted(str(r[0]) for r in rows)
    gone = lambda a, b: sorted(set(a) - set(b))
    assert gone(everything, kept["language_id"]) == ["130", "131", "132"]
    assert gone(kept["language_id"], kept["ngram_jaccard"]) == ["101", "102", "103"]
    assert kept["ngram_jaccard"].count("140") == 1 and "None" in kept["ngram_jaccard"]
    assert kept["substring_dedup"] == kept["ngram_jaccard"]
    assert gone(kept["substring_dedup"], kept["decontamination"]) == ["120"]
    left = {r.doc_id: r for r in docs.collect()}
    assert [passage in left[110 + k].text for k in range(4)] == [True, False, False, False]
    assert all(r.n_chars == len(r.text) and r.lang for r in left.values())


def test_run_is_the_stages_in_order(spark, fixture):
    folder, rows, _ = fixture
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == len({r.doc_id for r in out}) == len(rows) - 3 - 3 - 1 - 1
    assert all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in out)


def test_rows_that_share_an_id_or_have_none(spark):
    """Different texts of one id are documents of their own; a copy goes, the other text of its id stays."""
    rng = random.Random(21)
    m, n, q, o = (prose(rng, 60, "the") for _ in range(4))
    cases = [
        ([(7, m), (7, n), (8, q)], [(7, m), (7, n), (8, q)]),
        ([(5, m), (7, m), (7, n)], [(5, m), (7, n)]),
        ([(None, m), (None, m), (None, n), (3, n)], [(3, n), (None, m)]),
        ([(1, m), (1, m), (1, None), (1, None), (2, o)], [(1, None), (1, m), (2, o)]),
        ([(1, m), (2, m), (3, n)], [(1, m), (3, n)]),
    ]
    for rows, want in cases:
        docs = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(rows)], SCHEMA)
        out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark, fixture, tmp_path):
    folder, _, _ = fixture
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "decontamination", "sentencepiece"]
    assert public_tokenizers.path("piece_bpe_32k.model")


def test_stages_hand_python_small_batches_and_leave_nothing_behind(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    rows = spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 400) as text", "'en' as lang", "'s' as source", "0L as n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    def coders(batches):
        from spanwise.llm import sentencepiece_codec

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepiece_codec._coders)], pa.int64())], ["n"])

    try:
        assert dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, str(tmp_path)).count() == 4000
        assert dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, str(tmp_path)).where("round_trip").count() == 4000
        got = [r.n for r in docs.coalesce(1).mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 2 * BATCH_BYTES and max(got) < 2 * BATCH_BYTES
        assert {r.n for r in spark.range(64, numPartitions=16).mapInArrow(coders, "n long").collect()} == {0}
    finally:
        spark.conf.set(key, old)


def test_language_is_predicted_once_for_every_text(spark, fixture, capsys):
    folder, _, _ = fixture
    out = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("EvalPython") == 1


def test_tokenize_takes_smaller_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    rows = spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 400) as text", "'en' as lang", "'s' as source", "0L as n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    try:
        corpus_pipeline.tokenize(spark, docs, str(tmp_path))
        got = [r.n for r in docs.coalesce(1).mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 8 << 20 and max(got) < 1 << 20
    finally:
        spark.conf.set(key, old)


def test_many_shuffle_partitions_make_few_files(spark):
    """Tables of little data take a file per core at most, whatever the number of shuffle partitions; rows stay the same."""
    rng = random.Random(31)
    texts = [prose(rng, 60, "the") for _ in range(90)]
    passage = prose(rng, 60, "the")
    near = [" ".join(w if i != k % 50 else "edited" for i, w in enumerate(t.split(" "))) for k, t in enumerate(texts[:40])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + near + [f"{t}\n{passage}" for t in texts[60:]])]
    docs = spark.createDataFrame(rows, SCHEMA)
    folder = Path(shared_folder(spark).removeprefix("file://"))

    def run():
        out = {}
        for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages):
            found = stage(spark, docs, "")
            out[stage.__name__] = sorted(map(tuple, found.collect()))
        return out, found.rdd.getNumPartitions()

    want, _ = run()
    cores = spark.sparkContext.defaultParallelism
    many = {"spark.sql.shuffle.partitions": str(cores + 5), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in (*many, "spark.sql.execution.arrow.maxBytesPerBatch")}
    before = set(folder.rglob("part-*.parquet"))
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got, parts = run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and len(want["drop_near_duplicates"]) < len(rows)
    files = Counter(p.parent for p in folder.rglob("part-*.parquet") if p not in before)
    assert len(files) > 10 and max(files.values()) <= cores
    assert parts < cores + 5 + docs.rdd.getNumPartitions()


def test_tables_of_much_text_take_more_files(spark):
    tables, df = Tables(spark, "t"), spark.range(0, 100, numPartitions=40)
    assert tables.store(df, "plain").count() == 100 and tables.fitted(df).rdd.getNumPartitions() == 40
    tables.fit(30 * FILE_BYTES)
    assert tables.fitted(df).rdd.getNumPartitions() == 30
    tables.fit(3000 * FILE_BYTES)
    assert tables.fitted(df).rdd.getNumPartitions() == 40
    tables.fit(0)
    assert tables.fitted(df).rdd.getNumPartitions() == min(40, spark.sparkContext.defaultParallelism)
