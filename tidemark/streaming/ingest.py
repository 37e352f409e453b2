"""Streaming ingest and the worker that keeps tiers fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.engine import Engine


def ingest(engine: Engine, name: str, stream: DataFrame, checkpoint: str, refresh: bool = True, every: str | None = None) -> StreamingQuery:
    """Late rows are never dropped: they dirty their bucket, and queries read raw rows there until it is refreshed.

    A micro-batch that is replayed after a failure is known by the checkpoint and its number and adds nothing.
    every: a processing-time trigger such as "1 second"; unset, what is there is handled and the query ends.
    """

    def batch(rows: DataFrame, number: int) -> None:
        engine.insert(name, rows, batch=(checkpoint, number))
        if refresh:
            engine.refresh(name)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def work(engine: Engine, batch: int = 100) -> list[str]:
    """One turn of the worker: refreshes the pipelines among the `batch` oldest dirty (pipeline, scope) entries, oldest first; their names."""
    oldest = engine.status(0).orderBy("oldest", "base", "scope").limit(batch).groupBy("base").agg(F.min("oldest").alias("oldest")).orderBy("oldest", "base")
    names = [r["base"] for r in oldest.collect()]
    for name in names:
        engine.refresh(name)
    return names


def heartbeat(engine: Engine, name: str, rows_per_second: int, shape, checkpoint: str, every: str = "1 second") -> StreamingQuery:  # noqa: ANN001
    """Feeds a pipeline with made-up rows: `shape` turns the rate source's (timestamp, value) into rows of the base table."""
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ingest(engine, name, shape(ticks), checkpoint, every=every)


def bootstrap(engine: Engine, name: str, rows: int, end: int, lookback: int, shape) -> None:  # noqa: ANN001
    """Inserts `rows` made-up rows spread evenly over the `lookback` seconds before `end`."""
    at = F.timestamp_seconds(F.lit(end - lookback) + F.floor(F.col("id") * lookback / rows))
    engine.insert(name, shape(engine.spark.range(rows).select(at.alias("timestamp"), F.col("id").alias("value"))))
