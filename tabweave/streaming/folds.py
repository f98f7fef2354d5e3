"""Folds over streams of delimited files: typed as in batch, kept as state, with exactly-once results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import convert
from ..functions.spec import ColumnSpec, RowSpec, typed
from ..sources.delimited import stream_typed


def typed_stream(spark: SparkSession, path: str, columns: list[str], specs: tuple[ColumnSpec, ...], **source) -> DataFrame:
    """A stream of typed rows; specs are bound to ``columns`` by name. Rows have no numbers in a stream, so errors tell row 0."""
    RowSpec(specs)
    text = stream_typed(spark, path, columns, **source)
    return text.select(*[typed(convert.text_cell(F.col(f"`{c.name}`")), c, F.lit(0), False).alias(c.name) for c in specs])


def group_fold(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Min, max, sum and count by key."""
    return stream.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("total"), F.count(value).alias("n"))


def windowed_fold(stream: DataFrame, time: str, late: str, size: str, keys: list[str], value: str) -> DataFrame:
    """The same by window of event time, late rows beyond ``late`` dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def run_available(result: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into an in-memory table ``name``, then stop."""
    q = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
