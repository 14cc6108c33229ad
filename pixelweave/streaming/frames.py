"""Frames as streams: image files that arrive, a cursor over frames, windows by event time, and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def frame_stream(spark: SparkSession, path: str, schema, per_batch: int = 1000) -> DataFrame:
    """Frames from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def frame_statistics(frames: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and means by window; rows later than the watermark are dropped."""
    timed = frames.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def gaps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The frame numbers missing between those seen, series by series; the last number seen is the state."""
    last = state.get[0] if state.exists else None
    numbers = sorted(int(n) for f in frames for n in f["frame"])
    out = []
    for n in numbers:
        if last is not None and n > last + 1:
            out.append((key[0], last + 1, n - 1))
        last = n if last is None else max(last, n)
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["series", "first_missing", "last_missing"])


def missing_frames(frames: DataFrame) -> DataFrame:
    """frames (series, frame), a stream, as the stretches of frames that were skipped."""
    kind = frames.schema["series"].dataType.simpleString()
    return frames.groupBy("series").applyInPandasWithState(gaps, f"series {kind}, first_missing long, last_missing long", "last long", "append", GroupStateTimeout.NoTimeout)


def write_frames(frames: DataFrame, path: str, checkpoint: str, bad: str | None = None, is_bad=None):
    """Frames into Parquet, each batch once: a batch that runs again replaces its own folder. With is_bad, bad frames go to
    a folder of their own instead of stopping the stream."""

    def put(batch: DataFrame, number: int) -> None:
        good = batch if is_bad is None else batch.where(~is_bad)
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if is_bad is not None and bad:
            batch.where(is_bad).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls back for progress and errors; what the callback returns as false stops the stream."""

    def __init__(self, progress: Callable[[int, int], bool | None], error: Callable[[str], None] | None = None, spark: SparkSession | None = None):
        self.progress, self.error, self.spark, self.rows = progress, error, spark, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        if self.progress(event.progress.batchId, self.rows) is False and self.spark:
            query = self.spark.streams.get(event.progress.id)
            if query:
                query.stop()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception and self.error:
            self.error(event.exception)


class FrameCursor:
    """next, step and seek over a table of frames; each read is a filter on the frame number."""

    def __init__(self, frames: DataFrame, order: str = "frame"):
        self.frames, self.order, self.at = frames, order, -1

    def seek(self, n: int) -> DataFrame:
        self.at = n
        return self.frames.where(F.col(self.order) == n)

    def step(self, n: int) -> DataFrame:
        return self.seek(self.at + n)

    def next(self) -> DataFrame:
        return self.step(1)
