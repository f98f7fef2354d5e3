"""Row dataflow: filters, ordered parses, folds, batches, previews."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shipping import scratch, ship


def skip_rows(df: DataFrame, keep: Column) -> DataFrame:
    """The row predicate: rows for which ``keep`` isn't true are skipped."""
    return df.where(F.coalesce(keep, F.lit(False)))


def ordered(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows in sheet order, for callers that observe it; the scan itself is parallel and unordered."""
    return df.orderBy(order)


def fold(df: DataFrame, order: str, seed: Callable[[], Any], add: Callable[[Any, dict], Any], combine: Callable[[Any, Any], Any]) -> Any:
    """A custom fold whose ``combine`` needn't commute.

    Rows are put in order by ranges, each range is folded where it lies, and only the states, one for each
    range, come to the driver, where they are combined from left to right. No rows give ``seed()``. Where
    Catalyst has the aggregate, ``df.groupBy(...).agg(...)`` is the better fold.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = None, None
        for b in batches:
            for row in b.to_pylist():
                if first is None:
                    state, first = seed(), row[order]
                state = add(state, row)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(first)]), pa.array([pickle.dumps(state)])], names=["first", "state"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    rows = ranged.mapInArrow(run, "first binary, state binary").collect()  # a row for each range
    states = sorted(((pickle.loads(r["first"]), pickle.loads(r["state"])) for r in rows), key=lambda x: x[0])
    return functools.reduce(combine, [s for _, s in states]) if states else seed()


def for_each(df: DataFrame, action: Callable[[Any], None]) -> None:
    """``action`` on every row, in parallel and without order; a retried task calls it again."""
    df.foreach(action)


def batches(df: DataFrame, size: int = 0) -> Iterator[pa.Table]:
    """Arrow tables of at most ``size`` rows (0: as many as the session's Arrow batches), a partition at a time on the driver."""
    rows: list = []
    if size <= 0:
        size = max(1, int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
    schema = df.limit(0).toArrow().schema
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r.asDict())
        if len(rows) == size:
            yield pa.Table.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.Table.from_pylist(rows, schema)


def batch_numbers(df: DataFrame, order: str, size: int, name: str = "batch") -> DataFrame:
    """``df`` with the number of each row's batch of ``size`` in the order of the unique column ``order``.

    Row numbers come from ranges and their counted sizes, so no task sees all rows.
    """
    return numbered(df, order, "__n").withColumn(name, F.floor(F.col("__n") / size).cast("long")).drop("__n")


def numbered(df: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """``df`` with row numbers from 0 in the order of ``order``, of any orderable type; nulls come first, ties in any order.

    The rows are dealt out by range and sorted once, and written to the shared folder, which fixes their places; only
    the sizes of the ranges come to the driver.
    """
    spark = df.sparkSession
    path, at = scratch(spark), "__at"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, F.col(order).asc()).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(StructType([*df.schema.fields]).add(at, "long")).parquet(path)
    part = F.shiftright(F.col(at), 33).cast("int")
    sizes = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
    starts, before = [], 0
    for p in range(parts):
        starts.append(F.lit(before).cast("long"))
        before += sizes.get(p, 0)
    return placed.withColumn(name, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.get(F.array(*starts), part)).drop(at)


def preview(df: DataFrame, rows: int, order: str = "row_idx", fast: bool = False) -> tuple[list, list, int | None]:
    """(head, tail, total): half the rows from the start, the rest from the end, and the exact count; ``fast``: only a head, and no count if more remain."""
    if fast:
        head = df.orderBy(order).limit(rows + 1).collect()
        return head[:rows], [], len(head) if len(head) <= rows else None
    total = df.count()
    if total <= rows:
        return df.orderBy(order).collect(), [], total
    head = -(-rows // 2)
    return df.orderBy(order).limit(head).collect(), list(reversed(df.orderBy(F.desc(order)).limit(rows - head).collect())), total
