"""Changed pages as a stream: the page table is brought up to date, and only changed pages are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sections import read_pages
from ..sources.cache import PageCache, latest

CHANGES = "title string, wikitext string, fetched_at timestamp"


def changes(spark: SparkSession, path: str, kind: str = "json", per_trigger: int = 100) -> DataFrame:
    """A folder of change files as a stream of (title, wikitext, found, fetched_at)."""
    raw = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)
    return raw.withColumn("found", F.col("wikitext").isNotNull())


def follow(stream: DataFrame, cache: PageCache, read_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert each batch into the cache and append what its pages say to ``read_path``, by batch.

    A batch that is run again after a failure writes the same folder again.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = latest(df)
        cache.store(newest)
        read_pages(newest).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{read_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, read_path: str) -> DataFrame:
    """The last reading of each page from the batches so far."""
    rows = spark.read.parquet(read_path)
    newest = rows.groupBy("title").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["title", "batch"]).select("title", "read", "refs")


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes per window of event time, with a watermark; ``events`` has title and fetched_at."""
    return events.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window)).agg(F.count(F.lit(1)).alias("changes"), F.approx_count_distinct("title").alias("pages"))
