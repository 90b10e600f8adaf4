"""File sources and sinks.

Readers declare their schema (never inferred): raw interval records are text
in, parsing happens in ``operators.clean`` per row.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.config import FEATURE_NAME_OVERRIDES, Profile
from spanwise.operators import clean

RAW_COLUMNS = ["oblast", "raion", "hromada", "level", "started_at", "finished_at", "source"]


def _text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def _headers(spark: SparkSession, path: str, threads: int = 16) -> dict[str, list[str]]:
    """Header line -> files that begin with it, of the files Spark reads under ``path`` (the first line of each
    is fetched, through any of Spark's file systems; empty files are left out)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first_line(uri: str) -> tuple[str, str | None]:
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = file.getFileSystem(conf).open(file)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
            source = codec.createInputStream(stream) if codec is not None else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
        finally:
            stream.close()
        return file.toString(), line

    found: dict[str, list[str]] = {}
    with ThreadPoolExecutor(threads) as pool:
        for file, line in pool.map(first_line, sorted(spark.read.text(path).inputFiles())):
            if line is not None:
                found.setdefault(line, []).append(file)
    return found


def _scan_csv(spark: SparkSession, path: str, required, where: str, multi_line: bool) -> DataFrame:
    """Header CSV files, columns by name, all as text, NA markers -> NULL.

    Spark assigns CSV columns by position.  So files are grouped by their header (other orders, other
    extra columns), every group is scanned with its own columns, and the groups are united by name; an extra column
    that a file lacks is NULL in its rows, a required one raises.  ``enforceSchema`` off compares each file's header
    with the declared columns again as it is read.  Quotes inside a quoted field are doubled.
    """
    def reader():
        return spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", multi_line)

    groups, out = _headers(spark, path), None
    for line in sorted(groups) or [None]:
        part = groups[line] if len(groups) > 1 else path
        header = reader().csv(groups[line][:1]).columns if line is not None else []
        df = reader().option("enforceSchema", False).option("ignoreLeadingWhiteSpace", False).schema(_text_schema(header)).csv(part)
        df = df.toDF(*[c.strip().lower() for c in header])
        clean.require_columns(df, required, where if line is None else f"{where}: {groups[line][0]}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return clean.null_tokens(out)


def read_alerts_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Interval records; columns in any order, extra ones are fine, missing required ones raise.

    ``multi_line``: fields may hold line breaks (a file is then one task)."""
    return _scan_csv(spark, path, clean.RAW_REQUIRED, "load", multi_line)


def read_second_source_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S2 scan: every column as text (the reconciliation needs ``region`` and ``started_at``)."""
    return _scan_csv(spark, path, ["region", "started_at"], "second source", multi_line)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text columns as header CSV files that ``read_alerts_csv`` reads back (NULL as an empty field)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


FEATURE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.VariantType()),
    ]))),
])


def read_features(spark: SparkSession, path: str, profile: Profile, admin: str = "Ukraine") -> DataFrame:
    """S3: FeatureCollection -> features of one country with a canonical ``region``:
    English-name override, else alias of the local name, else the local name."""
    fc = spark.read.option("multiLine", True).schema(FEATURE_SCHEMA).json(path)
    f = fc.select(F.explode("features").alias("f")).select("f.*")
    f = f.filter(F.col("properties")["admin"] == admin)
    name_en = F.coalesce(F.col("properties")["name"], F.lit(""))
    name_uk = F.coalesce(F.col("properties")["name_uk"], F.lit(""))
    overrides = clean.alias_map_column(FEATURE_NAME_OVERRIDES)
    aliases = clean.alias_map_column(profile.aliases)
    region = F.coalesce(F.try_element_at(overrides, name_en), F.try_element_at(aliases, name_uk), name_uk)
    return f.select(region.alias("region"), name_uk.alias("name_uk"), name_en.alias("name_en"), "geometry")


def write_features(features: DataFrame, path: str) -> None:
    """One FeatureCollection document (features sorted by region, geometry as nested JSON).

    The collection is a single JSON document by format; it holds one feature per
    region (a dimension-sized table), so it is assembled in one task.
    """
    feat = F.struct(
        F.lit("Feature").alias("type"), F.col("region").alias("id"),
        F.struct("region", "name_uk", "name_en").alias("properties"),
        F.col("geometry").alias("geometry"),
    )
    one = F.struct(F.col("region").alias("_k"), F.to_json(feat).alias("f"))
    doc = features.agg(F.sort_array(F.collect_list(one)).alias("fs")).select(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}"),
    ).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def write_episodes(frame: DataFrame, path: str, partition_by: str = "year") -> None:
    """Processed analysis table as parquet partitioned by year."""
    frame.write.mode("overwrite").partitionBy(partition_by).parquet(path)
