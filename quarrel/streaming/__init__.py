"""Incremental forms of the roll-ups: the batch plan over a stream of new facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.operators.metrics import merged, rollup_by


def rollup_stream(functions: DataFrame, *keys: str) -> DataFrame:
    """The complexity roll-up of a streaming table of functions; write it in complete or update mode."""
    return rollup_by(functions, *keys)


def merge_into(state: DataFrame | None, batch: DataFrame, *keys: str) -> DataFrame:
    """For foreachBatch: earlier roll-ups and a batch of new functions as one roll-up."""
    fresh = rollup_by(batch, *keys)
    return merged(state.unionByName(fresh), *keys) if state is not None else fresh


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per kind and window with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
