"""Quality rules: base counts and an n-gram log-likelihood ratio.

Two multinomials over word unigrams and bigrams, told apart by hashes, are estimated: one from a trusted target
set, one from the raw corpus (all documents). A document's score is the mean, over its n-grams, of
``log p_target - log p_raw``; documents under a threshold are rejected, every one decided the same way.

All n-grams of all documents are counted, in ``BUCKETS`` times as many buckets as the cube root of their number:
the table grows with the corpus, yet even 100 TB of text make under eight million buckets, two numbers each, so
that every task holds it whole. As an n-gram's frequency falls with its rank, the buckets of frequent n-grams
stand out and are few. A bucket with less than twice the mean has rare n-grams only, of all kinds alike: they count as ones that the
target lacks, and have the floor. So distinct junk, however much, doesn't come to look like the target's text.

The threshold lies midway between the score to expect of a text of n-grams never seen (the mean over all buckets, as
such n-grams fall into them evenly) and the score that 95 % of the target's own documents reach, each without its own occurrences; so it moves with the
corpus's size.

Defined cases: a null or blank text has no words, all counts 0, a null ratio, and fails the base rules.
A null doc_id is scored like any other but never belongs to the target. With an empty target or an
empty corpus every ratio is 0, and only the base rules reject; so too if no document of the target has ten
words. Repeated rows are scored alike, each counted in the corpus. Texts of any length are used whole. ``score`` replaces
input columns named like an output; ``apply`` keeps all input columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, spaced_words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Weight, in n-grams, of the raw distribution as the target's prior.
PRIOR = float(1 << 14)
#: Share of the target's documents that may score under the upper end of the threshold's interval.
LOW_SHARE = 0.05
#: N-grams of a text of ten words; shorter ones fail the base rules and don't set the threshold.
LEAST_NGRAMS = 19
#: Buckets, times the cube root of the number of n-gram occurrences; and the cutoff, in mean loads.
BUCKETS, CUT = 128, 2


def ngram_hashes(words: Column) -> Column:
    """64-bit hashes of all unigrams and bigrams of an array of words."""

    def both(h: Column) -> Column:
        bi = F.when(
            F.size(h) >= 2,
            F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1))),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.concat(h, bi)

    return let(F.transform(words, lambda x: F.xxhash64(x)), both)


def n_buckets(size: int) -> int:
    """Buckets for texts of ``size`` bytes, at about three bytes for each n-gram: 1,280 for a thousand n-grams, 128,000 for 10**9."""
    return max(64, round(BUCKETS * (size / 3) ** (1 / 3)))


def ngram_buckets(words: Column, n: int) -> Column:
    return F.transform(ngram_hashes(words), lambda x: F.pmod(x, F.lit(n).cast("long")).cast("int"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in the text.

    Windows are compared by 64-bit hashes. Only texts with a repeated window are sorted.
    """

    def covered(hp: Column) -> Column:
        def flagged(s: Column) -> Column:
            hits = F.filter(
                s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            )
            starts = F.array_sort(F.transform(hits, lambda x: x["p"]))
            return let(
                starts,
                lambda p: F.aggregate(
                    F.transform(p, lambda a, i: F.least(F.coalesce(F.get(p, i + 1) - a, F.lit(window)), F.lit(window))),
                    F.lit(0).cast("long"),
                    lambda acc, x: acc + x,
                ),
            )

        return let(F.array_sort(hp), flagged)

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - window),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]),
        )

    def count(h: Column) -> Column:
        return F.when(F.size(h) < window + 1, F.lit(0).cast("long")).otherwise(
            let(
                windows(h),
                lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
                    covered(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
                ),
            )
        )

    return let(F.transform(words, lambda x: F.xxhash64(x)), count)


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
    )


@dataclass
class Ratios:
    """Log ratios of the buckets over the floor, in units of 1e-6 (sums are exact), for documents outside the target and inside."""

    n: int
    floor: int
    unseen: float  # score to expect of a text of n-grams never seen
    outside: Column
    inside: Column

    def mean(self, words: Column, target: Column) -> Column:
        """A text's score; null without words."""

        def total(b: Column, ratios: Column) -> Column:
            return F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.get(ratios, x))

        def score(b: Column) -> Column:
            return F.when(F.size(b) > 0, (F.when(target, total(b, self.inside)).otherwise(total(b, self.outside)) / F.size(b) + self.floor) / 1e6)

        return let(ngram_buckets(words, self.n), score)


def log_ratios(docs: DataFrame, target: Column, text: str, prior: float) -> Ratios:
    """Count the n-grams of all documents. ``target``: true for documents of the target.

    Every n-gram of a document of the target is scored without one occurrence in the target, its own. Otherwise rare
    n-grams would speak for the documents of the target and against all others.
    """
    n = n_buckets(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    rows = docs.select(F.when(target, 1).otherwise(0).alias("t"), F.explode(ngram_buckets(spaced_words(F.col(text)), n)).alias("b"))
    counted = rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("hit")).toPandas()  # n rows at most
    raw, hit = np.zeros(n), np.zeros(n)
    raw[counted["b"]], hit[counted["b"]] = counted["raw"], counted["hit"]
    n_raw, n_hit = raw.sum(), hit.sum()
    floor = round(math.log(prior / (n_hit + prior)) * 1e6)

    def over(own: int) -> np.ndarray:
        known = (raw >= max(2, CUT * n_raw / n)) & (hit > own)
        p_raw = np.where(known, raw, 1) / max(n_raw, 1)
        p_hit = (hit - own + prior * p_raw) / (n_hit + prior)
        return np.where(known, np.rint(np.log(np.where(known, p_hit, 1) / p_raw) * 1e6) - floor, 0).astype(int)

    def literal(ratio: np.ndarray) -> Column:
        """Folded, it reaches the executors with the tasks."""
        return F.split(F.lit(",".join(map(str, ratio.tolist()))), ",").cast("array<int>")

    outside, inside = over(0), over(1)
    return Ratios(n, floor, (floor + outside.mean()) / 1e6, literal(outside), literal(inside))


def derived_threshold(docs: DataFrame, target: Column, text: str, ratios: Ratios) -> float:
    """Midway between the score of the unseen and the least score of all but ``LOW_SHARE`` of the target's documents, to a thousandth of the floor."""
    if not ratios.floor:
        return 0.0
    width = -ratios.floor / 1e6 / 1000
    words = spaced_words(F.col(text))
    own = docs.where(target).select(F.when(F.size(words) * 2 - 1 >= LEAST_NGRAMS, ratios.mean(words, F.lit(True))).alias("llr")).where("llr is not null")
    # bins of ratios: as many as the range of logarithms holds, whatever the corpus
    bins = own.groupBy(F.floor(F.col("llr") / width).alias("b")).count().orderBy("b").collect()
    left = LOW_SHARE * sum(r["count"] for r in bins)
    for r in bins:
        left -= r["count"]
        if left < 0:
            return (r["b"] * width + ratios.unseen) / 2
    return -math.inf


def score(docs: DataFrame, target: Column, text: str = "text", prior: float = PRIOR, threshold: float | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    ``target`` marks the trusted documents by a boolean column expression over ``docs``. ``threshold``: in place of
    the derived one.
    """
    ratios = log_ratios(docs, target, text, prior)
    threshold = derived_threshold(docs, target, text, ratios) if threshold is None else threshold
    key = free_name(docs, "words")
    w, col = F.col(key), F.col(text)
    counted = docs.withColumn(key, spaced_words(col)).withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(col, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": duplicate_lines(col),
            "n_repeat_words": repeated_words(w),
            "llr": ratios.mean(w, target),
        }
    )
    return (
        counted.drop(key)
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
    )


#: Most ids of trusted documents that are broadcast (about 150 MB in memory); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def trusted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", mark: str = "__trusted", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with a boolean ``mark``: labelled quality 1 and not toxic. Repeated labels add no rows.

    The ids are counted first. Up to ``broadcast_ids`` of them are broadcast, so that the texts stay where they are.
    """
    good = (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("__good"))
        .distinct()
    )
    if good.count() <= broadcast_ids:
        good = F.broadcast(good)
    return docs.join(good, docs[doc_id] == F.col("__good"), "left").withColumn(mark, F.col("__good").isNotNull()).drop("__good")


def apply(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """The documents that pass, with their own columns only."""
    key = free_name(docs, "row_struct")
    packed = trusted(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(key), F.col(text).alias("__text"), F.col(doc_id).alias("__id")), labels, "__id")
    return score(packed, F.col("__trusted"), "__text", **params).where("kept").select(*[F.col(key)[c].alias(c) for c in docs.columns])
