"""Periodic refresh as a Structured Streaming job.

The original keeps one raw file and rebuilds everything from it when the file is
newer than a few hours.  Here new raw CSV files dropped into a folder are picked
up by a file stream; each micro-batch appends the new raw text rows to the raw
table and rebuilds the episode table from the whole raw table (the union is
order-dependent per region, so a full rebuild is the exact form).  Run it with
``availableNow`` from a scheduler, or with a processing-time trigger.

Checkpoints and tables live under the shared ``spark.checkpoint.dir`` unless
explicit paths are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanwise.config import Profile
from spanwise.operators import clean
from spanwise.plans import pipeline
from spanwise.session import ensure_checkpoint_dir
from spanwise.sources.files import RAW_COLUMNS, _text_schema


def start_refresh(spark: SparkSession, input_dir: str, table_dir: str, profile: Profile,
                  checkpoint: str | None = None, available_now: bool = True,
                  interval: str = "6 hours") -> StreamingQuery:
    """Start the refresh stream; returns the query (call ``awaitTermination`` or ``processAllAvailable``)."""
    root = table_dir.rstrip("/")
    ckpt = checkpoint or ensure_checkpoint_dir(spark).rstrip("/") + "/streams/refresh"
    raw_path, eps_path = f"{root}/raw", f"{root}/episodes"

    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        rows = clean.null_tokens(clean.normalise_headers(batch))
        rows.write.mode("append").parquet(raw_path)
        raw = batch.sparkSession.read.parquet(raw_path)
        eps = pipeline.episodes(raw, profile)
        frame = pipeline.analysis_frame(eps, profile)
        frame.write.mode("overwrite").parquet(eps_path)

    # files must have exactly these columns in this order: another header raises (see read_alerts_csv)
    stream = (
        spark.readStream.schema(_text_schema(RAW_COLUMNS)).option("header", True).option("enforceSchema", False)
        .option("encoding", "UTF-8").option("escape", '"').csv(input_dir)
    )
    writer = stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
