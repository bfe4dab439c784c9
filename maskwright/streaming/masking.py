"""The masking plan on streams, and windows over usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.masking import PipelineConfig, mask_documents


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def mask_stream(docs: DataFrame, masked_path: str, mapping_path: str | None, checkpoint: str, config: PipelineConfig | None = None, id_col: str = "doc_id") -> StreamingQuery:
    """Masks each micro-batch once and writes it to two places: masked texts, and the restricted mappings (none if mapping_path is None or
    the configuration is irreversible). A batch that is tried again overwrites its own folder, so results come exactly once. Stop the
    query to cancel."""
    config = config or PipelineConfig()

    def write(batch: DataFrame, epoch: int) -> None:
        results = batch.persist()
        try:
            results.select(id_col, "masked", "summary", "preexisting").write.mode("overwrite").parquet(f"{masked_path}/batch={epoch}")
            if mapping_path is not None and not config.irreversible:
                results.select(id_col, "mapping").write.mode("overwrite").parquet(f"{mapping_path}/batch={epoch}")
        finally:
            results.unpersist()

    return mask_documents(docs, config, id_col).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events: ts timestamp, kind, seconds, tokens. Calls, seconds and tokens by kind and window; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"))


def expired_jobs(jobs: DataFrame, ttl: str = "600 seconds") -> DataFrame:
    """jobs: job_id, created timestamp, status. A job's last event within its time to live; once the watermark passes it, its state is dropped."""
    return jobs.withWatermark("created", ttl).groupBy(F.session_window("created", ttl), "job_id").agg(F.max_by("status", "created").alias("status"))
