"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read back.

1. language ID: documents without a recognised language go;
2. n-gram Jaccard join: one document (the smallest id) of each near-duplicate group stays;
3. substring dedup: repeated passages are cut from the texts, texts that were nothing else go;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece encoding: token ids of what is left, checked by decoding.

All stages but the last return the columns of ``documents``.  Empty tables, null ids, null and empty
texts and repeated rows pass as the operators define; a row without any letter is rejected by the
first stage; the second keeps one of the rows that are equal in id and text, and treats different texts of one id,
and rows without an id, as documents of their own.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import decontaminate, language_id, ngram_join, paragraph_dedup, sentencepiece_codec
from spanwise.llm.common import Tables, bloom_build, maybe_in, without

LEAST_SCORE = 0.5
STAGE_BYTES = 1 << 20  # of a record batch; Python and the JVM each hold some of them for every task
TOKEN_BYTES = 1 << 19  # texts encoded together: their words, ids and decoded bytes take many times their size


def lean(stage, size: int = STAGE_BYTES):
    """The stage with its tables handed to Python in record batches of about ``size`` bytes: stages follow one another
    in the same executors, where larger ones would be held on both sides."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
        return stage(spark, docs, sf_dir)

    return run


@lean
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a null ``lang`` is filled with the prediction."""
    rows = docs.where(~language_id.held_out()).select("text", "lang", F.col("doc_id").alias("key"))
    model = language_id.train(rows)
    if not model.langs:  # nothing to learn from: only texts without a letter are rejected
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = language_id.predicted(docs, model)
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


ODD = 1 << 62  # keys from here on stand for rows that have no id of their own


def own_keys(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: the id, or, where the id is null or several rows have it, a hash of id and text."""
    odd = Tables(spark, "pipeline-keys").store(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "odd")
    key = F.col("doc_id").cast("long")
    if odd.isEmpty():
        return docs.withColumn("__key", key)
    own = F.lit(ODD) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(ODD))
    twice = odd.select(F.col("doc_id").alias("__twice"))
    maybe = docs.withColumn("__maybe", maybe_in(spark.sparkContext.broadcast(bloom_build(odd, "doc_id")), F.col("doc_id")))
    plain = maybe.where("not __maybe").withColumn("__key", F.coalesce(key, own))
    some = maybe.where("__maybe").join(twice, F.col("doc_id") == F.col("__twice"), "left")
    some = some.withColumn("__key", F.when(F.col("__twice").isNull(), key).otherwise(own)).drop("__twice")
    return plain.unionByName(some).drop("__maybe")


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.  Rows that share an id are documents of their own as
    long as their texts differ; of rows equal in id and text the least one stays."""
    keyed = own_keys(spark, docs)
    found = Tables(spark, "pipeline-groups").store(ngram_join.jaccard_components(keyed, id_col="__key"), "groups")
    kept = without(keyed, found.where("doc_id <> component_id").select("doc_id"), "__key")
    several = kept.where(F.col("__key") >= ODD)
    least = several.groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return kept.where(F.col("__key") < ODD).select(*docs.columns).unionByName(least)


@lean
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; ``n_chars`` follows the text."""
    clean = paragraph_dedup.drop_repeats(docs).where("not (removed_words > 0 and text = '')")
    size = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id"))


@functools.partial(lean, size=TOKEN_BYTES)
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether they decode to the text."""
    both = sentencepiece_codec.encoded(docs.select("doc_id", "lang", "source", "text"), check_col="round_trip")
    return both.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
