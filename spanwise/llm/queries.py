"""Registered queries of the training-data operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import (
    decontaminate,
    html_text,
    language_id,
    license_scan,
    merkle,
    ngram_join,
    paragraph_dedup,
    pivot_index,
    quality_fm,
    sentencepiece_codec,
    token_counts,
    token_files,
    whitening,
)
from spanwise.llm.common import Tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, with its layout."""
    return html_text.rendered(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    return license_scan.scanned(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated passages, and what was removed."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return paragraph_dedup.drop_repeats(docs).withColumn("has_repeat", F.col("removed_words") > 0)


def op5_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return pivot_index.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram ids of every document, and whether decoding gives its text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_codec.encoded(docs, check_col="round_trip")
    return both.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    folder = Tables(spark, "token-files").folder
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), folder)
    return token_files.read_tokens(manifest, folder)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the items and the best coverage."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered copy folds to."""
    return merkle.verified_copy(_table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every vector."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_license_scan, op3_token_counts, op4_substring_dedup, op5_pivot_dedup, op6_language_id,
              op7_sentencepiece, op8_ngram_jaccard, op9_token_files, op10_decontamination, op11_merkle,
              op12_quality, op13_whitening)
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op5_pivot_dedup": """WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
    node AS (SELECT vec_id AS id FROM embeddings),
    walk(id, pos) AS (SELECT id, id FROM node UNION SELECT walk.id, links.b FROM walk JOIN links ON walk.pos = links.a)
    SELECT n.id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = n.id) AS BIGINT) AS n_links, min(walk.pos) AS component_id, n.id = min(walk.pos) AS kept
    FROM node n JOIN walk ON walk.id = n.id GROUP BY n.id""",
    "op8_ngram_jaccard": r"""WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
    walk(id, pos) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.id, links.b FROM walk JOIN links ON walk.pos = links.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(pos) AS component_id FROM walk GROUP BY id) c ON c.id = d.doc_id""",
    "op11_merkle": merkle.oracle(),
}
