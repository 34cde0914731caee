"""Nodes as keyed state over a stream of facts.

The batch engine is the main way; these are for facts that keep arriving.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def facts_from(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Facts that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def state_machine(facts: DataFrame, key: str, event: str, order: str, start: str = "start") -> DataFrame:
    """(key, order, state, event): each event meets the state that the one before left at its node."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        frame = pd.concat(list(frames)).sort_values([order, event])  # a key's events may come in several frames of one batch
        before = [now, *frame[event].tolist()[:-1]]
        state.update((frame[event].iloc[-1],))
        yield pd.DataFrame({key: frame[key].values, order: frame[order].values, "state": before, event: frame[event].values})

    out = T.StructType([facts.schema[key], facts.schema[order], T.StructField("state", T.StringType()), facts.schema[event]])
    return facts.groupBy(key).applyInPandasWithState(step, out, "state string", "append", GroupStateTimeout.NoTimeout)


def running_min(facts: DataFrame, key: str, value: str) -> DataFrame:
    """A min aggregate kept up to date: in update mode only changed nodes come out."""
    return facts.groupBy(key).agg(F.min(value).alias(value))


def windowed(facts: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are left out."""
    return facts.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return it as a table; for tests and backfills."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
