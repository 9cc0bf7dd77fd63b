"""Streaming forms of the weekly aggregates; results equal the batch ones."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rebaja.functions import columns as X


def week_window(ts: str) -> Column:
    """Monday-based weeks: the epoch is a Thursday, so weeks start four days on."""
    return F.window(ts, "7 days", startTime="4 days")


def stream_weekly_sales(lines: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Units, revenue and pickup lines per week of a stream of POS lines. A week leaves the state when the watermark passes its end; later lines are dropped."""
    return (
        lines.where("cantidad > 0").withWatermark("fecha", lateness)
        .groupBy(week_window("fecha").alias("_w"), "brand", "sku", "centro")
        .agg(F.sum("cantidad").alias("units_sold"), F.sum("precio_final").alias("gross_revenue"),
             F.count_if(X.is_click_collect()).alias("click_collect_units"))
        .select("brand", "sku", "centro", F.col("_w.start").cast("date").alias("week"), "units_sold", "gross_revenue",
                "click_collect_units")
    )


def stream_weekly_folios(lines: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Distinct sales folios per week: each folio of an open week is kept in state once, and leaves it with its week."""
    week = week_window("fecha").alias("_w")
    first = lines.where("cantidad > 0 AND folio IS NOT NULL").withWatermark("fecha", lateness).select(week, "brand", "sku", "centro", "folio").dropDuplicates(["_w", "brand", "sku", "centro", "folio"])
    return (first.groupBy("_w", "brand", "sku", "centro").agg(F.count(F.lit(1)).alias("txn_count"))
            .select("brand", "sku", "centro", F.col("_w.start").cast("date").alias("week"), "txn_count"))


def stream_traffic_weekly(traffic: DataFrame, lateness: str = "7 days") -> DataFrame:
    return (
        traffic.withWatermark("fecha", lateness).groupBy(week_window("fecha").alias("_w"), "tienda_id")
        .agg(F.sum("entradas").alias("weekly_entries"), F.sum("salidas").alias("weekly_exits"),
             F.avg("tiempo_permanencia_prom").alias("avg_dwell_time"))
        .select(F.col("tienda_id").alias("centro"), F.col("_w.start").cast("date").alias("week"), "weekly_entries", "weekly_exits",
                "avg_dwell_time")
    )


def stream_audit_counts(audit: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events per brand, action and week; repeated deliveries of an event count once."""
    keys = ["brand", "user_email", "action", "key", "timestamp"]
    return (
        audit.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(keys)
        .groupBy(week_window("timestamp").alias("_w"), "brand", "action").agg(F.count(F.lit(1)).alias("n"))
        .select("brand", "action", F.col("_w.start").cast("date").alias("week"), "n")
    )


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """Files of a folder as they come, at most ``files`` a batch (None: all that are there)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).format(kind).load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str, keys: Sequence[str], progress: list | None = None) -> DataFrame:
    """Process what is there and stop; returns the result table. A later run goes on from the state and offsets in ``checkpoint``. ``progress`` collects the reports of the batches.

    In update mode each micro-batch rewrites the rows it changed: batches are
    kept as they come and the last one of a key is read back.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    query = (df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    spark = df.sparkSession
    schema = T.StructType(list(df.schema.fields) + [T.StructField("_batch", T.IntegerType())])
    out = spark.read.schema(schema).parquet(path)
    rest = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def replay(source: DataFrame, time: str, stream, keys: Sequence[str], folder: str, deliveries: int = 6, progress: list | None = None) -> DataFrame:
    """A table as a stream: delivered in order of ``time``, one stretch after the other, each processed by a run that takes up the state of the run before.

    ``stream`` maps the file stream to its result. Stretches are of equal
    length, so the watermark passes all but the newest weeks and their state
    is dropped long before the end; no row is late.
    """
    spark = source.sparkSession
    first, last = source.agg(F.min(time).cast("double"), F.max(time).cast("double")).first()
    stretch = F.lit(0) if first is None or first == last else F.least(F.floor((F.col(time).cast("double") - first) / (last - first) * deliveries), F.lit(deliveries - 1))
    out = None
    for n in range(deliveries):
        source.where(F.coalesce(stretch, F.lit(0)) == n).write.mode("append").parquet(f"{folder}/in")
        out = run_available(stream(file_stream(spark, f"{folder}/in", source.schema)), f"{folder}/out", f"{folder}/checkpoint", "update", keys, progress)
    return out
