"""Structured Streaming around the landing folders; the table logic is in ``operators.state``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUPPORTED = r"(?i)\.(pdf|png|jpe?g|tiff?)$"


# J01
def landing_stream(spark: SparkSession, folder: str, accepted: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """New files of a folder: supported, non-empty, visible ones are listed under ``accepted`` with their hash, others under ``quarantine``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    good = F.col("path").rlike(SUPPORTED) & ~name.rlike(r"^\.|\.(tmp|part)$") & (F.col("length") > 0)
    rows = files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("file_hash"), good.alias("good"))

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        batch.where("good").drop("good").write.mode("append").parquet(accepted)
        batch.where("NOT good").drop("good").write.mode("append").parquet(quarantine)
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# J03
def dedupe_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each content once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_hash"])


# J08
def progress_counts(stream: DataFrame) -> DataFrame:
    """Running totals by batch, for update mode."""
    return stream.groupBy("batch").agg(F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"))


# J09
def audit_append(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
