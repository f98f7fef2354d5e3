"""Benchmark decontamination by a distributed positional inverted index.

1. The corpus frequency of every benchmark word is counted over all documents.
2. Every window (10 consecutive item words, or a whole shorter item) names its two rarest words.
3. The index stores the postings (word, document, position) of those words only.
4. Postings are adjusted by their offset in the item: equal (document, item, diagonal) is an alignment.
   It survives where both rare words of some window lie on it: the intersection of their lists.
5. Survivors are verified word by word against the document, which gives exact window occurrences.
   ``proximity`` instead returns items whose rare words stand near one another.

A document word inside any occurrence of a window is hit. No list is gathered by word: the postings of a
frequent word stay spread, and the benchmark side is broadcast only if its counted size allows.

Defined cases: null or empty texts have no words and are never hit; null or empty items are ignored; a
null item_id is the empty string; documents of one (doc_id, text) are judged alike and each keeps its row; empty
tables give empty or all-clean results; an input column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, plain_words, small

WINDOW = 10


class PositionalIndex:
    """The benchmark's rare words and their postings in a corpus."""

    def __init__(self, docs: DataFrame, bench: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", scratch: Scratch | None = None):
        self.window = window
        self.scratch = scratch or Scratch(docs.sparkSession)
        self.docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
        items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), plain_words(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct()
        items = self.scratch.write(items.withColumn("it", F.xxhash64("item", "words")), "items")
        terms = items.select("it", F.posexplode("words").alias("q", "term"))
        vocabulary = small(terms.select("term").distinct())
        counts = self.docs.select(F.explode(plain_words(F.col("t"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
        freqs = self.scratch.write(terms.select("term").distinct().join(counts, "term", "left").na.fill(0, ["freq"]), "freqs")
        ranked = terms.join(freqs, "term").groupBy("it").agg(F.array_sort(F.collect_list(F.struct("q", "freq", "term"))).alias("r"))
        self.items = self.scratch.write(items.join(ranked, "it").withColumn("pairs", self._rare_pairs(F.col("r"))).drop("r"), "pairs")
        rare = self.items.select("it", "words", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["q1"], p["q2"]))))).alias("q"))
        self.rare = self.scratch.write(rare.select("it", "q", F.get("words", F.col("q")).alias("term")), "rare")
        posted = self.docs.select("id", F.xxhash64("t").alias("h"), F.posexplode(plain_words(F.col("t"))).alias("pos", "term"))
        self.postings = self.scratch.write(posted.join(small(self.rare.select("term").distinct()), "term", "left_semi"), "postings")

    def _rare_pairs(self, ranked: Column) -> Column:
        """For each window, the item positions of its rarest and second rarest word; distinct."""

        def pair(s: Column) -> Column:
            best = F.array_sort(F.transform(F.slice(ranked, s + 1, self.window), lambda x: F.struct(x["freq"].alias("f"), x["term"].alias("t"), x["q"].alias("q"))))
            return let(best, lambda b: F.struct(F.get(b, F.lit(0))["q"].alias("q1"), F.coalesce(F.get(b, F.lit(1))["q"], F.get(b, F.lit(0))["q"]).alias("q2")))

        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ranked) - self.window, F.lit(0))), pair))

    def alignments(self) -> DataFrame:
        """(id, h, it, diagonal, qs): item positions whose rare words lie on one diagonal of a document."""
        return (
            self.postings.join(small(self.rare), "term")
            .groupBy("id", "h", "it", (F.col("pos") - F.col("q")).alias("diagonal"))
            .agg(F.collect_set("q").alias("qs"))
        )

    def hits(self) -> DataFrame:
        """(id, h, n_words, hit: sorted positions, items: sorted item ids) for every hit document."""
        both = F.exists("pairs", lambda p: F.array_contains("qs", p["q1"]) & F.array_contains("qs", p["q2"]))
        found = self.alignments().join(small(self.items), "it").where(both)
        found = self.scratch.write(found.groupBy("id", "h").agg(F.collect_list(F.struct("item", "diagonal", "words")).alias("found")), "found")
        near = self.docs.withColumn("h", F.xxhash64("t"))
        ids = found.select("id", "h")
        near = near.join(small(ids), near["id"].eqNullSafe(ids["id"]) & (near["h"] == ids["h"]), "left_semi").distinct()
        f = found.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "found")
        near = near.join(f, near["id"].eqNullSafe(f["fid"]) & (near["h"] == f["fh"])).select("id", "h", "found", plain_words(F.col("t")).alias("w"))

        def occurrences(w: Column, c: Column) -> Column:
            size = F.least(F.size(c["words"]), F.lit(self.window))
            same = F.transform(c["words"], lambda x, j: F.coalesce(F.get(w, c["diagonal"] + j) == x, F.lit(False)))
            starts = let(same, lambda s: F.filter(F.sequence(F.lit(0), F.size(c["words"]) - size), lambda i: F.forall(F.slice(s, i + 1, size), lambda x: x)))
            return F.struct(c["item"].alias("item"), F.flatten(F.transform(starts, lambda i: F.sequence(c["diagonal"] + i, c["diagonal"] + i + size - 1))).alias("at"))

        checked = let(F.col("w"), lambda w: F.filter(F.transform("found", lambda c: occurrences(w, c)), lambda x: F.size(x["at"]) > 0))
        return near.select("id", "h", checked.alias("o")).where(F.size("o") > 0).select(
            "id",
            "h",
            F.array_sort(F.array_distinct(F.flatten(F.transform("o", lambda x: x["at"])))).alias("hit"),
            F.array_sort(F.array_distinct(F.transform("o", lambda x: x["item"]))).alias("items"),
        )

    def proximity(self, slop: int, least: int = 2) -> DataFrame:
        """(id, item, first, last, n_terms): ``least`` or more rare words of an item whose diagonals differ by at most ``slop``.

        Diagonals are put in overlapping bins of twice the slop, so no pair of them is missed.
        """
        aligned = self.alignments().select("id", "h", "it", "diagonal", F.explode("qs").alias("q"))
        wide = 2 * slop + 2
        bins = F.array_distinct(F.array(F.floor(F.col("diagonal") / wide), F.floor((F.col("diagonal") + slop + 1) / wide) + F.lit(0.5)))
        binned = aligned.withColumn("bin", F.explode(bins)).groupBy("id", "h", "it", "bin").agg(
            F.array_sort(F.collect_set(F.struct("diagonal", "q"))).alias("a")
        )
        near = F.transform("a", lambda x: F.filter("a", lambda y: (y["diagonal"] >= x["diagonal"]) & (y["diagonal"] <= x["diagonal"] + slop)))
        rows = binned.select("id", "h", "it", F.explode(near).alias("g")).select(
            "id", "h", "it", F.size(F.array_distinct(F.transform("g", lambda x: x["q"]))).alias("n_terms"),
            F.array_min(F.transform("g", lambda x: x["diagonal"] + x["q"])).alias("first"), F.array_max(F.transform("g", lambda x: x["diagonal"] + x["q"])).alias("last"),
        ).where(F.col("n_terms") >= least).distinct()
        return rows.join(small(self.items.select("it", "item")), "it").select("id", "item", "first", "last", "n_terms")


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with n_words, hit (positions), items (ids) and contaminated."""
    hits = PositionalIndex(docs, bench, window, text, doc_id, scratch=scratch).hits()
    hits = (scratch or Scratch(docs.sparkSession)).write(hits, "hits")
    found = small(hits.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("hit").alias("__hit"), F.col("items").alias("__items")))
    joined = docs.join(found, docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__h")), "left")
    return joined.withColumns(
        {
            "n_words": F.size(plain_words(F.col(text))).cast("long"),
            "hit": F.coalesce("__hit", F.array().cast("array<int>")),
            "items": F.coalesce("__items", F.array().cast("array<string>")),
            "contaminated": F.col("__hit").isNotNull(),
        }
    ).drop("__id", "__h", "__hit", "__items")


def apply(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their own columns only."""
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id"), F.col("text"))
    return scan(key, bench, **params).where(~F.col("contaminated")).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
