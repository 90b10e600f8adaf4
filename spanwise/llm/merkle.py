"""Operator 11, Merkle dataset manifest: concatenated-level strings.

Every row is a leaf, every partition (by default: every language) a binary tree of its leaves in
ascending id order, and the partitions' roots, in order, the leaves of one more tree.  A level of an
aligned block of BLOCK nodes is one string of their 64-character digests side by side: the parents
are the hashes of its substrings of 128 characters, and a node's siblings are the substrings that
flank it in its run.  The block roots are the nodes of the next round, until one block is left.

Leaves are ranked by range splitting (no window over a partition): rows are range partitioned on
(partition, id, leaf), numbered where they lie, and shifted by the counts of the ranges before.  Only
ids and digests are shuffled, never texts, and no group holds more than BLOCK rows.

Defined results: a null field is ``-``; null ids come first; rows of one id follow each other by leaf;
equal rows are leaves of their own; a null partition comes first; an empty table gives no row.  The
columns' names are parameters, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import Tables

BLOCK = 256  # nodes whose levels are strings of one row: 16,384 characters
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW = (1 << 33) - 1  # row number within its task, in monotonically_increasing_id


def field(value: Column) -> Column:
    """A leaf's field: UTF-8 byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(x) for x in fields]), 256)


def ranked(rows: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within ``key``, by ``order``) and ``n`` (rows of the key).

    Rows that are equal in key and order are split between ranges by the row number of the scan."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, "key", *order, "__tie")
    lying = tables.store(split.sortWithinPartitions("key", *order, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(_ROW)
    counts = lying.groupBy("key", part.alias("__part")).agg(F.count("*").alias("__c"), F.min(row).alias("__first"))
    of_key = Window.partitionBy("key")  # one row per key and range
    before = F.coalesce(F.sum("__c").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("key", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__c").over(of_key).alias("n"))
    out = lying.withColumn("__part", part).join(shift, ["key", "__part"])
    return out.withColumn("pos", row + F.col("__shift")).drop("__at", "__part", "__shift")


# all levels of a block, from its nodes' string up: one hash per 128 characters
_LEVELS = f"""aggregate(sequence(0, {{top}}), array(__nodes), (acc, l) -> if(l = 0, acc, concat(acc, array(
    array_join(transform(sequence(0, cast((length(element_at(acc, -1)) - 1) div 128 as int)),
        i -> sha2(substring(element_at(acc, -1), i * 128 + 1, 128), 256)), '')))))"""
# what stands left and right of node number __i in its run, level by level, below the block's root
_FLANKS = """if(size(__levels) < 2, cast(array() as array<struct<l: string, r: string>>),
    transform(sequence(0, greatest(size(__levels) - 2, 0)), l -> named_struct(
        'l', if(shiftright(__i, l) % 2 = 1, substring(__levels[l], (shiftright(__i, l) - 1) * 64 + 1, 64), ''),
        'r', if(shiftright(__i, l) % 2 = 0, substring(__levels[l], (shiftright(__i, l) + 1) * 64 + 1, 64), ''))))"""
FOLD = "aggregate({flanks}, {start}, (acc, f) -> sha2(concat(f.l, acc, f.r), 256))"


def trees(nodes: DataFrame, carried: list[str], tables: Tables, name: str = "round0", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Climb from ranked nodes (key, pos, n, digest, carried...) to the root of each key.

    Returns per node: key, pos, digest, carried..., ``flanks`` (array of what stands left and right of
    the path, from the node up) and ``top`` (the key's root; a lone node itself); and per key: key, top.
    Only the blocks are stored, the nodes' paths are cut from them as they are read."""
    if block < 2 or block & (block - 1):
        raise ValueError("block must be a power of two")
    depth = block.bit_length() - 1
    levels = F.when(F.col("__n") > block, F.lit(depth)).otherwise(F.ceil(F.log2(F.col("__n").cast("double")))).cast("int")
    member = F.struct("pos", "digest", *carried)
    blocks = nodes.groupBy("key", F.expr(f"pos div {block}").alias("__block")).agg(
        F.sort_array(F.collect_list(member)).alias("__members"), F.max("n").alias("__n"))
    blocks = blocks.withColumn("__nodes", F.array_join(F.transform("__members", lambda m: m["digest"]), ""))
    blocks = blocks.withColumn("__top", levels).withColumn("__levels", F.expr(_LEVELS.format(top="__top"))).drop("__nodes", "__top")
    blocks = tables.store(blocks, name)
    root = F.element_at("__levels", -1)
    if (blocks.agg(F.max("__n")).first()[0] or 0) > block:
        above = blocks.select("key", F.col("__block").alias("pos"), F.expr(f"(__n + {block - 1}) div {block}").alias("n"), root.alias("digest"))
        above = trees(above, [], tables, f"{name}-up", block)[0].select(
            F.col("key"), F.col("pos").alias("__block"), F.col("flanks").alias("__above"), "top")
        blocks = blocks.join(above, ["key", "__block"])
    else:
        none = F.expr("cast(array() as array<struct<l: string, r: string>>)")
        blocks = blocks.withColumns({"__above": none, "top": root})
    out = blocks.select("key", "__levels", "__above", "top", F.explode("__members").alias("__m"))
    out = out.withColumn("__i", F.expr(f"cast(__m.pos % {block} as int)"))
    paths = out.select("key", "__m.pos", "__m.digest", *[f"__m.{c}" for c in carried],
                       F.concat(F.expr(_FLANKS), "__above").alias("flanks"), "top")
    return paths, blocks.where("__block = 0").select("key", "top")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", part_col: str = "lang",
             block: int = BLOCK, suspect: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, part, leaf, subroot, root, siblings, proof_sha256, folded_root, verified) of every row.

    ``siblings`` is the row's inclusion proof (array of digests left and right of its path); folding the
    leaf over it gives ``folded_root``, and ``verified`` tells whether that is the root.  ``suspect``: what some
    fields hold in the copy to be verified against this manifest; the folded leaf is made from them."""
    tables = Tables(docs.sparkSession, "merkle")
    cols = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_hash(list(cols.values()))
    changed = F.lit(False)
    for c, x in (suspect or {}).items():
        changed = changed | ~x.eqNullSafe(cols[c])
    other = F.when(changed, leaf_hash([(suspect or {}).get(c, x) for c, x in cols.items()]))
    part = F.col(f"`{part_col}`").cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("v"), part), F.lit("n")).alias("key"), F.col(f"`{id_col}`").alias("doc_id"),
                         leaf.alias("digest"), other.alias("other"))
    rows, tops = trees(ranked(leaves, ["doc_id", "digest"], tables, "leaves"), ["doc_id", "other"], tables, "leaf-blocks", block)
    tops = tops.select(F.lit("").alias("key"), F.col("key").alias("part"), F.col("top").alias("digest"))
    tops = trees(ranked(tops, ["part"], tables, "tops"), ["part"], tables, "top-blocks", block)[0].select(
        F.col("part").alias("key"), F.col("flanks").alias("__upper"), F.col("top").alias("root"))
    out = rows.join(tops, "key").withColumn("siblings", F.concat("flanks", "__upper"))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda f: F.concat(f["l"], f["r"])), ""), 256)
    out = out.withColumns({"proof_sha256": proof, "folded_root": F.expr(FOLD.format(flanks="siblings", start="coalesce(other, digest)"))})
    return out.select("doc_id", F.expr("if(key = 'n', null, substring(key, 2))").alias("part"), F.col("digest").alias("leaf"),
                      F.col("top").alias("subroot"), "root", "siblings", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


TAMPER_EVERY = 7


def tampered(id_col: str = "doc_id") -> Column:
    """Where 7 divides crc32 of the decimal id; never for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))


def verified_copy(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The manifest of ``documents``, checked against a copy where some rows' n_chars is one higher."""
    more = F.when(tampered(), F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    return manifest(docs, block=block, suspect={"n_chars": more}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle() -> str:
    """DuckDB text of ``verified_copy``: lists of nodes per level, and one step a level for the paths."""
    enc = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(enc.format(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = """list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
        lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END, CAST(4294967295 AS BIGINT))"""
    up = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))"
    return f"""WITH RECURSIVE docs AS (
        SELECT doc_id, coalesce('v' || lang, 'n') AS k, {leaf('n_chars')} AS leaf,
            CASE WHEN n_chars IS NOT NULL AND xor({crc}, 4294967295) % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS held FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
    lv(k, l, nodes) AS (SELECT k, 0, list(leaf ORDER BY pos) FROM placed GROUP BY k
        UNION ALL SELECT k, l + 1, {up} FROM lv WHERE len(nodes) > 1),
    sub AS (SELECT k, nodes[1] AS subroot, l AS depth, row_number() OVER (ORDER BY k) - 1 AS kpos FROM lv WHERE len(nodes) = 1),
    tv(l, nodes) AS (SELECT 0, list(subroot ORDER BY kpos) FROM sub UNION ALL SELECT l + 1, {up} FROM tv WHERE len(nodes) > 1),
    path(doc_id, leaf, k, pos, l, h, sib) AS (
        SELECT doc_id, leaf, k, pos, 0, held, '' FROM placed
        UNION ALL SELECT p.doc_id, p.leaf, p.k, p.pos // 2, p.l + 1,
            CASE WHEN p.pos % 2 = 1 THEN sha256(lv.nodes[p.pos] || p.h) ELSE sha256(p.h || coalesce(lv.nodes[p.pos + 2], '')) END,
            p.sib || CASE WHEN p.pos % 2 = 1 THEN lv.nodes[p.pos] ELSE coalesce(lv.nodes[p.pos + 2], '') END
        FROM path p JOIN lv ON lv.k = p.k AND lv.l = p.l WHERE len(lv.nodes) > 1),
    upper(doc_id, leaf, k, pos, l, h, sib) AS (
        SELECT p.doc_id, p.leaf, p.k, s.kpos, 0, p.h, p.sib FROM path p JOIN sub s ON s.k = p.k AND p.l = s.depth
        UNION ALL SELECT p.doc_id, p.leaf, p.k, p.pos // 2, p.l + 1,
            CASE WHEN p.pos % 2 = 1 THEN sha256(tv.nodes[p.pos] || p.h) ELSE sha256(p.h || coalesce(tv.nodes[p.pos + 2], '')) END,
            p.sib || CASE WHEN p.pos % 2 = 1 THEN tv.nodes[p.pos] ELSE coalesce(tv.nodes[p.pos + 2], '') END
        FROM upper p JOIN tv ON tv.l = p.l WHERE len(tv.nodes) > 1)
    SELECT u.doc_id, u.leaf, s.subroot, r.nodes[1] AS root, sha256(u.sib) AS proof_sha256, u.h AS folded_root, u.h = r.nodes[1] AS verified
    FROM upper u JOIN sub s ON s.k = u.k JOIN tv r ON len(r.nodes) = 1 AND r.l = u.l"""
