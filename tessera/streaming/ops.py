"""Structured Streaming: fitted models on streams, windowed aggregates, and stateful lags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.base import FittedModel


def read_parquet_stream(table: DataFrame, max_files: int = 100) -> DataFrame:
    """The files of a Parquet table as a stream: its folder, or for a single file the folder it lies in and its name."""
    files = table.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    if len(folders) != 1:
        raise ValueError("a stream needs a table in one folder")
    r = table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files)
    if len(files) == 1:
        r = r.option("pathGlobFilter", files[0].rsplit("/", 1)[1])
    return r.parquet(folders.pop())


def transform_stream(model: FittedModel, stream: DataFrame) -> DataFrame:
    """Models of expressions and lookups are stateless, so a stream passes like a table."""
    return model.transform(stream)


def windowed_stats(stream: DataFrame, time_col: str, value: str, keys: list[str], window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Tumbling or sliding windows with a watermark; zoneless times are taken as UTC."""
    s = stream.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", window, slide) if slide else F.window("__t", window)
    g = s.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean", "least", "most")


def session_stats(stream: DataFrame, time_col: str, value: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = stream.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    g = s.groupBy(F.session_window("__t", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n", "total")


def stateful_lag(stream: DataFrame, key: str, time_col: str, value: str) -> DataFrame:
    """Each row's previous value of its key, across micro-batches: state is one value per key."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(time_col, kind="stable")
        before = [last, *rows[value].tolist()[:-1]]
        state.update((float(rows[value].iloc[-1]),))
        yield pd.DataFrame({key: k[0], time_col: rows[time_col].to_numpy(), value: rows[value].to_numpy(), f"{value}_lag_1": pd.array(before, dtype="Float64").to_numpy(float, na_value=float("nan"))})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time_col} {kinds[time_col]}, {value} double, {value}_lag_1 double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, into a table in memory; for tests and small results."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
