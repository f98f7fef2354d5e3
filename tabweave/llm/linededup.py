"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs go.

Lines with a word are numbered along each document (blank lines don't count and go with the line before
them). Level k ranks every suffix by its first 2**k lines, from pairs of ranks of level k-1; ranks are
order-preserving, so a level is the suffix array sorted to depth 2**k. A suffix whose block is unique
drops out, as no longer block of it can repeat. Suffixes of equal rank are a longest-common-prefix
interval; an interval of any depth m is named by two overlapping ranks, of the first and the last 2**k of
its m lines. A line is deleted if it lies in a run of lines with ``min_words`` words or more that also
occurs earlier, by (doc_id, text hash, line). Every such run is a union of minimal blocks that start or
end at each of its lines, so only intervals of those depths (at most ``min_words``) are looked at.

Nothing is gathered by line or run: ranks are joined back (or broadcast if few), minima are partial aggregates.

Defined cases: null or blank texts have no lines and stay as they are. Rows of equal doc_id and text are one
document. Null doc_ids come first in the order. A run may overlap its earlier copy (a line repeated n times in
a row keeps the first). Texts of any length are used whole. Empty tables give empty results. Input columns named
like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, Scratch, let, small

MIN_WORDS = 50


def _has_word(x: Column) -> Column:
    return x.rlike(r"[^\x20\x09-\x0D]")


def _block_lengths(words: Column, min_words: int) -> Column:
    """For each line, the least number of lines from it (f) and up to it (b) that hold ``min_words`` words, else null."""

    def reach(w: Column, i: Column, step: int) -> Column:
        # most blocks are of one or two lines
        one, two = F.get(w, i), F.get(w, i + step)
        at = F.sequence(F.lit(1), F.lit(min_words))
        far = F.aggregate(
            F.transform(at, lambda m: F.coalesce(F.get(w, i + step * (m - 1)), F.lit(0))),
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m")),
            lambda acc, x: F.when(acc["sum"] >= min_words, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["m"] + 1).alias("m"))),
            lambda acc: F.when(acc["sum"] >= min_words, acc["m"]),
        )
        return F.when(one >= min_words, 1).when(one + two >= min_words, 2).otherwise(far)

    return F.transform(words, lambda _, i: F.struct(reach(words, i, 1).alias("f"), reach(words, i, -1).alias("b")))


def line_table(docs: DataFrame, text: str, doc_id: str, min_words: int, scratch: Scratch) -> DataFrame:
    """(sid, id, h, at, left, a, b, forward, backward): a row for each line with a word; sid + 1 is the next line."""
    kept = F.filter(F.split(F.col("t"), "\n", -1), _has_word)

    def rows(ls: Column) -> Column:
        sizes = F.transform(ls, lambda x: F.regexp_count(x, F.lit(SPACED_WORD)))
        return let(
            sizes,
            lambda w: F.zip_with(
                ls,
                _block_lengths(w, min_words),
                lambda x, m: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), m["f"].alias("forward"), m["b"].alias("backward")),
            ),
        )

    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    base = base.select("id", F.xxhash64("t").alias("h"), let(kept, rows).alias("ls"))
    lines = base.select("id", "h", F.size("ls").alias("n"), F.posexplode("ls").alias("at", "l"))
    return scratch.write(lines.select(F.monotonically_increasing_id().alias("sid"), "id", "h", "at", (F.col("n") - F.col("at")).alias("left"), "l.*"), "lines")


def _ranked(keyed: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``keyed`` with rank r in the order of ``keys``, without rows of unique keys."""
    spark = keyed.sparkSession
    repeated = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number along sorted ranges keeps the order; writing it fixes it
    ranks = scratch.write(repeated.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id()), "ranks")
    return scratch.write(keyed.join(small(ranks), keys).select("sid", "left", "r"), "level")


def prefix_doubling(lines: DataFrame, depth: int, scratch: Scratch) -> Iterator[tuple[int, DataFrame]]:
    """Levels k = 0, 1, ... while 2**k <= depth and blocks repeat: (sid, left, r) of all suffixes with a repeated block."""
    # repeated rows are one document; their lines carry other sids, so only distinct documents must come here
    level, k = _ranked(lines.select("sid", "left", "a", "b"), ["a", "b"], scratch), 0
    while True:
        yield k, level
        k += 1
        if 1 << k > depth or not level.limit(1).count():
            return
        half = 1 << (k - 1)
        tail = level.select((F.col("sid") - half).alias("sid"), F.col("r").alias("r2"))
        pairs = level.where(F.col("left") >= 2 * half).join(tail, "sid").select("sid", "left", F.col("r").alias("r1"), "r2")
        level = _ranked(pairs, ["r1", "r2"], scratch)


def repeated_blocks(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(id, h, at, len): minimal blocks of lines that occur earlier."""
    place = F.struct("id", "h", "at").alias("place")
    blocks = lines.where("forward is not null").select("sid", place, F.col("forward").alias("len")).union(
        lines.where("backward is not null").select(
            (F.col("sid") - F.col("backward") + 1).alias("sid"), F.struct("id", "h", (F.col("at") - F.col("backward") + 1).alias("at")).alias("place"), F.col("backward").alias("len")
        )
    ).distinct()
    found = None
    for k, level in prefix_doubling(lines, min_words, scratch):
        size = 1 << k
        own = blocks.where((F.col("len") >= size) & (F.col("len") < 2 * size))
        ends = level.select(F.col("sid").alias("end"), F.col("r").alias("r2"))
        named = own.join(level.select("sid", F.col("r").alias("r1")), "sid").withColumn("end", F.col("sid") + F.col("len") - size)
        named = scratch.write(named.join(ends, "end").select("r1", "r2", "len", "place"), "named")
        firsts = named.groupBy("r1", "r2", "len").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        later = named.join(small(firsts), ["r1", "r2", "len"]).where(~F.col("place").eqNullSafe(F.col("first"))).select("place.*", "len")
        found = later if found is None else found.union(later)
    return found


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``text`` less the deleted lines, and n_lines (with a word) and n_deleted of them."""
    scratch = scratch or Scratch(docs.sparkSession)
    single = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t"))
    lines = line_table(single, "__t", "__id", min_words, scratch)
    # of rows of one doc_id and text, the lines of one stay
    repeats = lines.where("at = 0").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("keep")).where("n > 1")
    repeats = scratch.write(repeats.select(F.col("id").alias("rid"), F.col("h").alias("rh"), "keep"), "repeats")
    if repeats.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh")) & (F.col("sid") - F.col("at") != F.col("keep"))
        lines = scratch.write(lines.join(small(repeats), same, "left_anti"), "lines")
    blocks = repeated_blocks(lines, min_words, scratch)
    gone = blocks.select("id", "h", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("i")).groupBy("id", "h").agg(F.collect_set("i").alias("gone"))
    gone = scratch.write(gone.select(F.col("id").alias("__gid"), F.col("h").alias("__gh"), F.col("gone").alias("__gone")), "gone")
    joined = docs.join(small(gone), docs[doc_id].eqNullSafe(F.col("__gid")) & (F.xxhash64(docs[text]) == F.col("__gh")), "left")

    def rest(ls: Column) -> Column:
        full = F.filter(F.transform(ls, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())

        def kept(p: Column) -> Column:
            cut = F.flatten(F.transform("__gone", lambda d: F.sequence(F.get(p, d), F.coalesce(F.get(p, d + 1), F.size(ls)) - 1)))
            keep = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), cut)
            return F.array_join(F.transform(keep, lambda i: F.get(ls, i)), "\n")

        return let(full, kept)

    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return joined.withColumns(
        {
            "n_lines": F.size(F.filter(split, _has_word)).cast("long"),
            "n_deleted": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(let(split, rest)),
        }
    ).drop("__gid", "__gh", "__gone")


def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """The documents with later copies of runs deleted and their own columns only; a document that loses all its lines goes."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = dedupe(rows, **params).where("n_lines = 0 or n_deleted < n_lines")
    return out.select(*[(F.col("text") if c == text else F.col("__row")[c]).alias(c) for c in docs.columns])
