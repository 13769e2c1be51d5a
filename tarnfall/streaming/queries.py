"""Streaming counterparts: trailing usage, running counters, idle sessions, cursor batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records and sum per key and window; rows later than ``late`` are left out."""
    t = F.col(time).cast("timestamp")
    return events.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", width), key).agg(F.count(F.lit(1)).alias("records"), F.sum(value).alias("total")).select(F.col("window.start").alias("started"), key, "records", "total")


def running_errors(events: DataFrame, kind: str, keys: list[str], time: str) -> DataFrame:
    """Running count, first and last time per error pattern; for the update or complete mode."""
    return events.filter(F.col(kind) == "error").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def idle_sessions(events: DataFrame, time: str, key: str, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions that ended with ``gap`` of silence."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.session_window("_t", gap), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), key, "events")


def run_once(spark: SparkSession, stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote as a table.

    The sink is Parquet; in complete mode, each batch replaces it. A later call with the
    same folders goes on where this one ended.
    """
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(sink)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


class BadBatch(Exception):
    """Raised by ``apply`` for a batch whose content can't be read, whoever tries."""


def cursor_batches(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], most_failures: int = 3) -> None:
    """Hand every new batch to ``apply`` once it is there; the cursor moves when ``apply`` returns.

    ``apply`` gets the batch's number and should write under it, so that a repeated batch
    replaces itself. If it raises :class:`BadBatch` it is tried again, ``most_failures``
    times in all, and then the batch is passed over; any other error ends the run and
    leaves the cursor, so the batch comes again.
    """

    def run(df: DataFrame, number: int) -> None:
        for _ in range(most_failures):
            try:
                return apply(df, number)
            except BadBatch:
                continue
        return None

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def numbered_writer(sink: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number, in place of what an earlier try left."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{sink}/batch-{number:09d}")


def last_writer_wins(entries: DataFrame, key: str, value: str, version: str, actor: str) -> DataFrame:
    """Per key the value of the highest version, of equal ones that of the greater actor."""
    return entries.groupBy(key).agg(F.max_by(value, F.struct(version, actor)).alias(value), F.max(version).alias(version))
