"""Shared helpers: column idioms, tokenising, and checkpoints that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words of a-z, digits and every character beyond ASCII.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    A plain alias may be inlined by the optimizer into a lambda and then be computed again for
    every element; a lambda variable can't be.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the byte-wise ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def spaced_words(text: Column) -> Column:
    """Array of words between white space; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    """Array of lower-cased (A-Z) words; a null text has none.

    Splitting at gaps takes an eighth of the time of extracting the words, whose negated class is tried at each character.
    """
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PLAIN_GAP), "")


def conf(spark: SparkSession, key: str) -> str | None:
    return spark.sparkContext.getConf().get(key)


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session that doesn't set it gets a temporary folder.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or conf(spark, "spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tabweave-")
    return _local_dir


class Scratch:
    """Tables written to the shared folder to cut lineage; Spark removes them when its JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it as read back: no lineage, and a retry reads files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until ``df`` has no such column (in any case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


#: Most bytes of a side that is broadcast, as ``row_bytes`` measures them, and most rows of two numbers each.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = BROADCAST_BYTES // 64


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in a broadcast table: 48 bytes and its values."""
    out = F.lit(48).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            out += F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            out += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
        else:
            out += 8
    return out


def small(df: DataFrame, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``size`` bytes, which is measured first; otherwise as it is, for a join by shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (BROADCAST_BYTES if size is None else size) else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent.parent
    name = f"{tempfile.mkdtemp(prefix='tabweave-ship-')}/{package.name}"
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
    _shipped.add(app)
