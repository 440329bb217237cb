"""Observation ledgers as streams: windowed counts with late data, exactly-once inserts, keyed upserts.

The state of each stream is kept by Spark under the query's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import upsert
from ..registry import query
from ..sources.views import table


def observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON observations as files arrive."""
    return spark.readStream.schema(schema).json(path)


def first_observations(stream: DataFrame, key: str = "raw_sha256", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key's first row; a repeat within the watermark is dropped, so its state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, width: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """(by, start, n) by tumbling windows; for batches and streams alike."""
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def upsert_stream(stream: DataFrame, store_path: str, checkpoint: str, key: str, set_cols: list[str], last_col: str, order: str):
    """Merges each batch into a Parquet store, as a new version beside the old ones.

    A batch's number names its version, so a batch that is run again after a failure writes the
    same version and nothing counts twice."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, *[F.array(c).alias(c) for c in set_cols], last_col, order)
        if number > 0:
            rows = spark.read.parquet(f"{store_path}/v={number - 1}").unionByName(rows)
        flat = rows
        for c in set_cols:
            flat = flat.withColumn(c, F.explode(c))
        merged = upsert(flat, flat.limit(0), key, set_cols, last_col, order).drop("n_merged").join(rows.groupBy(key).agg(F.max(order).alias(order)), key)
        merged.write.mode("overwrite").parquet(f"{store_path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query(
    "ST_windowed_counts",
    "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL",
)
def st_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the stream's aggregate over the whole table."""
    rows = windowed_counts(table(spark, sf, "events").select("ts", "event_type"), "ts", "1 hour", "event_type")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))
