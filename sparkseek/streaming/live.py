"""Structured Streaming forms of the event-driven operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def query_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Queries by tumbling window of a stream ``(ts, query)``; empty queries are no events."""
    rows = events.where(F.trim("query") != "").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), F.trim("query").alias("query")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "query", "n")


def quiet_bursts(changes: DataFrame, gap: str = "150 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Debounce: one row for each burst of changes of a page, once it has been quiet for ``gap``."""
    rows = changes.withWatermark("ts", late).groupBy("url", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("changes")).select("url", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def rescans(changes: DataFrame, most: int = 30, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Changes of a stream ``(url, ts)`` that may start a rescan: at most ``most`` in any ``seconds`` for each page.

    Refused changes do not count. The state of a page is its last admitted times, and goes once the watermark has
    passed them by ``seconds``.
    """

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for ms in sorted(t for f in frames for t in f["ms"].tolist()):
            times = [t for t in times if t > ms - seconds * 1000]
            if len(times) < most:
                times.append(ms)
                out.append(ms)
        state.update((times,))
        state.setTimeoutTimestamp(max((times[-1] if times else 0) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"url": [key[0]] * len(out), "ms": out})

    rows = changes.withWatermark("ts", late).select("url", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("url").applyInPandasWithState(admit, "url string, ms long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def reindexed(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Re-extract the pages of each micro-batch and write their records, a folder for each batch."""

    def batch(rows: DataFrame, epoch: int) -> None:
        extract(rows).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def tracked(log: DataFrame, path: str, checkpoint: str, ring: int = 100):
    """Keep the last ``ring`` entries of a stream ``(at, query)``: each batch writes a folder of them, from the one before and its own.

    ``latest`` reads the newest, from which ``logs.popular_queries`` counts. A batch that is run again writes the same folder.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.where(F.trim("query") != "").select("at", "query")
        if epoch:
            rows = rows.unionByName(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/n={epoch - 1}"))
        rows.orderBy(F.desc("at")).limit(ring).write.mode("overwrite").parquet(f"{path}/n={epoch}")

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the newest batch of :func:`tracked`."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("n")).first()[0]
    return rows.where(F.col("n") == newest).drop("n")
