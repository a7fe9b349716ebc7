"""Incremental forms: file-source streams with state, and upserts per micro-batch.

The same frames run as a continuous query over a growing folder; ``hourly`` and ``seen_once`` drive
one over what is there (``availableNow``) and hand back its table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import ensure_checkpoint_dir, table


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, directory: str, name: str = "events") -> DataFrame:
    """A file-source stream over a table's files."""
    reader = spark.readStream.schema(table(spark, directory, name).schema)
    if _is_folder(spark, directory, name):
        stream = reader.parquet(f"{directory}/{name}.parquet")
    else:
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs a zone


def _is_folder(spark: SparkSession, directory: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def first_sight(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, however often its file is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _drain(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there into a table of the shared folder."""
    spark = df.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, name + "-state")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def hourly(spark: SparkSession, directory: str) -> DataFrame:
    """Events per hour and type, by a windowed streaming aggregation."""
    return _drain(counts_by_window(event_stream(spark, directory)), "hourly", "complete")


def seen_once(spark: SparkSession, directory: str) -> DataFrame:
    """Events by a de-duplicating stream: what a monitor that polls a folder reports."""
    return _drain(first_sight(event_stream(spark, directory)).select("event_id", "event_type"), "once", "append")


def upsert_stream(source: DataFrame, target: str, keys: list[str], order: str, state: str):
    """Keep the newest row per key in ``target``: each batch is merged into a new version of the table."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        version = f"{target}/v={epoch}"
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
        if epoch:
            old = spark.read.parquet(f"{target}/v={epoch - 1}")
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(version)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", state).outputMode("append")
