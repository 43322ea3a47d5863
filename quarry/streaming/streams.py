"""Streams: numbered events, idempotent requests, moving averages, leases, windows, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.ordered import LEVELS, NEW, OLD, START

#: Sorted by time, an event log's rows are handed out in the order of arrival.


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def numbered(events: DataFrame, key: str, order: list[str], name: str = "sequence_no") -> DataFrame:
    """Events with the next number of their key, from 0, in order within a batch and by batches. The state of a key is one number."""

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows[name] = range(n, n + len(rows))
        state.update((n + len(rows),))
        yield rows

    return events.groupBy(key).applyInPandasWithState(run, f"{_schema(events)}, {name} long", "n long", "append", GroupStateTimeout.NoTimeout)


def running_mastery(events: DataFrame, key: str, order: list[str], ratio: str) -> DataFrame:
    """key, n, level after each batch that has rows of the key: the moving average, streak and mastery status of its ratios so far."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level, streak, before = state.get if state.exists else (0, int(START * LEVELS), 0, None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = before
        for r in rows[ratio].dropna():
            n, before, last = n + 1, last, float(r)
            level = round(min(1.0, max(0.0, OLD * (level / LEVELS) + NEW * last)) * LEVELS)
            streak = streak + 1 if last >= 0.8 else 0
        state.update((n, level, streak, last))
        good = before is not None and last is not None and n > 1 and min(before, last) >= 0.8
        yield pd.DataFrame({key: [k[0]], "n": [n], "level": [level / LEVELS], "streak": [streak], "status": ["mastered" if good else "pending"]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long, level double, streak long, status string", "n long, level long, streak long, last double", "update", GroupStateTimeout.NoTimeout)


def leases(jobs: DataFrame, key: str = "job_id", seconds: int = 300) -> DataFrame:
    """key, status of job messages (claim, heartbeat, done): running until done, pending again when no message comes in time."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["pending"]})
            return
        kinds = [m for f in frames for m in f["message"]]
        if "done" in kinds:
            state.remove() if state.exists else None
            yield pd.DataFrame({key: [k[0]], "status": ["succeeded"]})
            return
        new = not state.exists
        state.update((len(kinds),))
        state.setTimeoutDuration(seconds * 1000)
        if new:
            yield pd.DataFrame({key: [k[0]], "status": ["running"]})

    kind = jobs.schema[key].dataType.simpleString()
    return jobs.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, status string", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def once(requests: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first request of each key that arrives; with a time column keys are remembered for ``late``."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else requests.dropDuplicates(keys)


def windowed(events: DataFrame, time: str, width: str, slide: str | None, by: list[str], late: str, *sums: Column) -> DataFrame:
    """Aggregates of event-time windows; rows later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(*sums)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str, *sums: Column) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*sums)


def replay(events: DataFrame, since: int, key: str | None = None, value=None) -> DataFrame:
    """Events after a number, in order: what a reader that comes back missed."""
    rows = events.where(F.col("sequence_no") > since)
    return (rows if key is None else rows.where(F.col(key) == value)).orderBy("sequence_no")


def to_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Each batch to ``handle``; every so often, or once over all there is."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All there is, as a table: appended rows, or the last batch's whole result in complete mode."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else f'batch={n}'}")

    to_batches(stream, save, checkpoint, mode=mode).awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/all")
    return spark.read.parquet(path)
