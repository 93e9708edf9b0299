"""Resumable block processing and series with a kept state, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def process_blocks(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Work off the block files of ``source`` once, whatever was finished before; a repeated batch replaces its own files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(blocks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("blk_z", "blk_y", "blk_x")) -> DataFrame:
    return blocks.join(done.select(*keys), list(keys), "left_anti")


class SeriesState(StatefulProcessor):
    """Of each tag the exponential average, the last step and its time; a tag that has been idle for too long is forgotten.

    A micro-batch brings the rows of a tag in any order: their numbers (not the rows) are put in order of steps. Rows not
    after the last step are late and left out, so that steps that come again after a restart count once.
    """

    def __init__(self, alpha: float, idle_seconds: float | None):
        self.alpha, self.idle = alpha, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", "ema double, step long, seconds double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [np.array([p["step"], p["value"], p["seconds"]], np.float64) for p in rows]
        step, value, seconds = (x for x in np.concatenate(parts, axis=1))
        ema, last, at = self.state.get() if self.state.exists() else (None, None, None)
        rate = None
        for i in np.lexsort((seconds, step)):
            if last is not None and step[i] <= last:
                continue
            ema = value[i] if ema is None else self.alpha * ema + (1 - self.alpha) * value[i]
            rate = None if last is None else (step[i] - last) / max(seconds[i] - at, 1e-6)
            last, at = step[i], seconds[i]
        self.state.update((float(ema), int(last), float(at)))
        if self.idle is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield pd.DataFrame({"tag": [key[0]], "step": [int(last)], "ema": [float(ema)], "rate": pd.array([rate], "Float64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


#: The state store that keeps such states.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def online_series(metrics: DataFrame, alpha: float = 0.98, idle_seconds: float | None = None) -> DataFrame:
    """(tag, step, ema, rate) after each micro-batch of (tag, step, value, ts): the average so far, and the steps a second since
    the step before. The state is three numbers a tag; works on a whole table, too."""
    metrics.sparkSession.conf.set(*STATE_STORE)
    _ = metrics.sparkSession.streams  # starts what keeps track of states, which a whole table needs as well
    rows = metrics.select("tag", "step", F.col("value").cast("double").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    mode = "None" if idle_seconds is None else "ProcessingTime"
    return rows.groupBy("tag").transformWithStateInPandas(SeriesState(alpha, idle_seconds), "tag string, step long, ema double, rate double", "Update", mode)


def windowed_rates(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and tag, late rows allowed for as long as the watermark says."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "tag").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
