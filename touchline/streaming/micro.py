"""Micro-batches: keyed state that only moves forward, and windowed counts; each also as a batch over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.store import Store


def daily(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts and totals of days; with late (how long rows may lag) as a stream whose state is dropped behind the watermark."""
    rows = events.withWatermark("ts", late) if late else events
    day = F.window("ts", "1 day") if events.isStreaming else F.to_date("ts")
    out = rows.groupBy(day.alias("_d"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select((F.to_date("_d.start") if events.isStreaming else F.col("_d")).alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Events of the same user in the time up to each."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", F.count("*").over(order).alias("n"))


def keep_fixtures(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts each micro-batch into the store's fixtures, of which it rewrites the buckets that it touches. A batch that is run again
    is known by its number and changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        store.upsert("fixtures", batch, tag=f"fixtures-{number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
