"""Near-duplicates: one-permutation hashing, optimal densification, banded buckets, star candidates.

1. A document's set is its distinct 4-word shingles, as 64-bit hashes. Documents of equal sets form a
   class; only the class's smallest doc_id goes on, so copies cost nothing further.
2. One hash per shingle fills 256 bins (its top bits choose the bin, the least hash in a bin stays). Empty
   bins borrow from non-empty ones in an order that depends on the bin alone, the same for all documents.
3. 42 bands of 6 bins make buckets: a pair at similarity 0.8 shares none with probability 3e-6.
4. Each bucket's hub is its member that shares most buckets; edges go from the hub to the other members
   only. They are confirmed on full sets: 100 * intersection >= 80 * union.
5. Components of confirmed edges. Members of a bucket that are still in different components get a second pass: a
   prefix index of their differences from the bucket's hub. Two sets differ in as many shingles as their differences do.
   If two members are similar enough but not both linked with the hub, their differences share shingles; in one order
   of a hub's shingles, rare ones first, the first of these is among the first quarter (of the set's size) of the greater
   difference and the first eighth of the smaller; a member of the hub's own component needs about half its difference
   only, as its partner lies further from the hub. Of the members of one shingle only pairs across components are made,
   and of its largest component no pairs among itself; sizes and places in the order bound what the differences share,
   and what is left is confirmed on full sets. So no link inside a bucket is lost, while texts that share a template,
   and those just too far from a large group of near copies to be linked with its hub, are hardly ever paired.

Defined cases: null, empty or blank texts have an empty set: linked with nothing, kept, component their own
doc_id. Fewer than 4 words: the whole sequence is the one shingle. Repeated rows share a class. A null doc_id
is linked with nothing and kept, with a null component. Texts of any length are used whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, let, small, spaced_words
from .components import connected_components

SHINGLE = 4
BIN_BITS = 8
ROWS, BANDS = 6, 42
PROBES = 8
#: similarity at least NUM / DEN
NUM, DEN = 80, 100


def shingle_set(words: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of ``size`` consecutive words; of the whole sequence if shorter; none without words."""

    def shingles(h: Column) -> Column:
        return (
            F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
            .when(F.size(h) < size, F.array(F.xxhash64(h)))
            .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))))
        )

    return let(F.transform(words, lambda x: F.xxhash64(x)), shingles)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")


def signature(hashes: Column, bits: int = BIN_BITS) -> Column:
    """2**bits minima of the hashes by their top bits, empty bins densified. Needs a hash at least."""
    n, shift = 1 << bits, 64 - bits

    def top(b: Column) -> Column:
        """The greatest hash of a bin, which marks it as empty."""
        return F.shiftleft(b, shift).bitwiseOR(F.lit((1 << shift) - 1))

    bins = range(-(n // 2), n // 2)  # a hash's bin is its signed value shifted: sorted hashes are sorted by bin
    empty = F.transform(F.sequence(F.lit(bins[0]).cast("long"), F.lit(bins[-1]).cast("long")), lambda b: top(b))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, shift)

    probes = F.split(F.lit(",".join(str(_number(f"{b} {k}") % n) for b in range(n) for k in range(PROBES))), ",").cast("array<int>")

    def minima(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def densify(d: Column) -> Column:
        full = F.transform(d, lambda x: F.when(x != top(bin_of(x)), x))

        def filled(v: Column) -> Column:
            some = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].isNotNull())

            def borrow(have: Column) -> Column:
                def last(i: Column) -> Column:
                    return F.array_min(F.transform(have, lambda s: F.struct(F.xxhash64(i, s["i"]).alias("r"), s["x"].alias("x"))))["x"]

                return F.transform(v, lambda x, i: F.coalesce(x, *[F.get(v, F.get(probes, i * PROBES + k)) for k in range(PROBES)], last(i)))

            return let(some, borrow)

        return let(full, filled)

    return let(let(F.sort_array(F.concat(hashes, empty)), minima), densify)


def band_hashes(sig: Column, rows: int = ROWS, bands: int = BANDS) -> Column:
    return let(sig, lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *[F.get(s, b * rows + k) for k in range(rows)])))


def _size_fits(n: Column, m: Column) -> Column:
    """Sets of such sizes can be similar enough."""
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def _similar(n: Column, m: Column, both: Column) -> Column:
    return DEN * both >= NUM * (n + m - both)


def _digest(s: Column) -> Column:
    """128 bits that name a set."""
    return let(F.array_sort(s), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")))


#: A shingle in the differences of more members of a hub than this has its frequency looked up; the others count as equally rare.
FREQUENT = 8


def _far(n: Column, m: Column, apart: Column) -> Column:
    """Sets of such sizes that differ in so many shingles aren't similar enough."""
    return (DEN + NUM) * apart > (DEN - NUM) * (n + m)


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with ``lacks`` and ``extra``, the numbers of shingles that only the hub or only the node has, and ``diff``, all these."""
    both = members.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("s").alias("hs")), "hub")
    both = both.withColumns({"l": F.array_except("hs", "s"), "e": F.array_except("s", "hs")})
    return both.select(*members.columns, F.size("hs").alias("hn"), F.size("l").alias("lacks"), F.size("e").alias("extra"), F.concat("l", "e").alias("diff"))


def _in_order(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with a row for each of the first shingles of their difference in the hub's common order, rare ones first.

    ``i``: the place, ``short``: the number of places that a partner of no smaller difference needs. ``d``: the difference's size.
    """
    diffs = scratch.write(_differences(members, sets).withColumn("d", F.col("lacks") + F.col("extra")), "differences")
    tokens = diffs.select("hub", "node", F.explode("diff").alias("token"))
    frequent = scratch.write(tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > FREQUENT), "frequent")
    ranked = tokens.join(small(frequent), ["hub", "token"], "left").groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "token"))).alias("o"))
    # similar sets differ in at most ``most``, as the partner has at most DEN / NUM times the size
    most = F.floor(F.col("n") * (DEN - NUM) / NUM + 1e-9)
    # a partner of a node of the hub's own component isn't linked with the hub: so many at least both differences share
    home = F.floor((F.col("d") + (F.col("hn") - F.col("n")) * (DEN - NUM) / (DEN + NUM)) / 2 - 1e-9) + 1
    limit = F.when(F.col("c") == F.col("ch"), F.col("d") - F.greatest(home, F.lit(1)) + 1).otherwise(F.col("d"))
    long, short = F.least(limit, most + 1), F.least(limit, F.floor(most / 2) + 1)
    lengths = diffs.select(*members.columns, "d", "lacks", "extra", long.cast("int").alias("long"), short.cast("int").alias("short")).where("long > 0")
    first = F.posexplode(F.transform(F.slice("o", F.lit(1), F.col("long")), lambda x: x["token"])).alias("i", "token")
    return scratch.write(lengths.join(ranked, ["hub", "node"]).select(*[c for c in lengths.columns if c != "long"], first), "prefix")


def prefix_candidates(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y, cx, cy): pairs of members of one hub and of different components that may be similar enough.

    ``members``: (hub, ch, node, n, c), ``c`` and ``ch`` the components of node and hub after the stars; ``sets``: (node, s).
    """
    prefix = _in_order(members, sets, scratch)
    # of each shingle, the component of most sets
    by_token = prefix.groupBy("hub", "token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("hub", "token").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("cs"))
    mixed = scratch.write(by_token.where("cs > 1").select("hub", "token", "top"), "mixed")
    p = scratch.write(prefix.join(small(mixed), ["hub", "token"]).withColumn("other", F.col("c") != F.col("top")).drop("top", "ch"), "places")
    x, y = p.alias("x"), p.where(F.col("i") < F.col("short")).alias("y")
    # at the first shingle that the two share, no more can be shared than what is left
    rest = F.least(F.col("x.d") - F.col("x.i"), F.col("y.d") - F.col("y.i"))
    signs = F.abs(F.col("x.lacks") - F.col("y.lacks")) + F.abs(F.col("x.extra") - F.col("y.extra"))
    fits = (
        (F.col("x.hub") == F.col("y.hub"))
        & (F.col("x.token") == F.col("y.token"))
        & (F.col("x.c") != F.col("y.c"))
        & ((F.col("y.d") < F.col("x.d")) | ((F.col("y.d") == F.col("x.d")) & (F.col("y.node") < F.col("x.node"))))
        & ~_far(F.col("x.n"), F.col("y.n"), F.greatest(signs, F.col("x.d") + F.col("y.d") - 2 * rest))
    )
    out = [F.col("x.node").alias("x"), F.col("y.node").alias("y"), F.col("x.c").alias("cx"), F.col("y.c").alias("cy")]
    pairs = x.where("x.other").join(y, fits).select(out).union(x.where("not x.other").join(y.where("y.other"), fits).select(out))
    return pairs.distinct()


def prefix_links(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): components that a link between two members joins."""
    if not members.limit(1).count():
        return members.select(F.col("c").alias("a"), F.col("c").alias("b"))
    pairs = scratch.write(prefix_candidates(members, sets, scratch), "candidates")
    full = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y")
    links = full.where(_similar(F.size("sx"), F.size("sy"), F.size(F.array_intersect("sx", "sy"))))
    return links.select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct()


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(id, n, component): every document with its set's size and smallest reachable doc_id, a row for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    words = spaced_words(ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    base = docs.select(F.col(doc_id).alias("id"), words.alias("w"))

    def described(s: Column) -> Column:
        return F.struct(F.size(s).cast("long").alias("n"), _digest(s).alias("h"), F.when(F.size(s) > 0, band_hashes(signature(s))).alias("bands"))

    table = scratch.write(base.select("id", let(shingle_set(F.col("w")), described).alias("d")).select("id", "d.*"), "signatures")
    linked = table.where("n > 0 and id is not null")
    # a node is a class of equal sets
    classes = linked.groupBy("n", "h").agg(F.min("id").alias("rep"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("node"), "n", "h", "rep"), "classes")
    reps = linked.join(classes.withColumnRenamed("rep", "id"), ["n", "h", "id"]).dropDuplicates(["node"])

    # buckets of two nodes or more
    banded = reps.select("node", "id", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = scratch.write(banded.join(shared, "bucket"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = buckets.join(weight, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("light"), "node")).alias("hub"))
    spokes = buckets.join(hubs.select("bucket", F.col("hub.node").alias("hub")), "bucket").where("node <> hub")
    spokes = scratch.write(spokes.select("bucket", "hub", "node", "n"), "spokes")

    wanted = buckets.select("node", "id").distinct()
    ids = wanted.select("id").distinct()
    sets = docs.where(F.col(doc_id).isNotNull()).join(small(ids), docs[doc_id] == ids["id"], "left_semi")
    # written before the join by set, whose null filter would otherwise compute the sets of all documents
    sets = scratch.write(sets.select(F.col(doc_id).alias("id"), shingle_set(words).alias("s")), "texts")
    sets = sets.withColumns({"n": F.size("s").cast("long"), "h": _digest(F.col("s"))}).join(classes.join(wanted.select("node"), "node", "left_semi").select("node", "n", "h"), ["n", "h"])
    sets = scratch.write(sets.select("node", "s").dropDuplicates(["node"]), "sets")

    # stars: from hub to spokes, on full sets
    stars = spokes.select("hub", "node").distinct().join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("s").alias("hs")), "hub")
    linked_stars = stars.where(_similar(F.size("hs"), F.size("s"), F.size(F.array_intersect("hs", "s")))).select("hub", "node")
    found = scratch.write(connected_components(linked_stars, scratch).withColumnRenamed("component", "c"), "found")

    # second pass: spokes of one bucket in different components
    placed = spokes.join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
    split = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    members = placed.join(split, "bucket", "left_semi").select("hub", "node", "n", "c").distinct()
    hub_of = found.select(F.col("node").alias("hub"), F.col("c").alias("ch"))
    members = scratch.write(members.join(hub_of, "hub", "left").withColumn("ch", F.coalesce("ch", "hub")), "members")
    merged = scratch.write(connected_components(prefix_links(members, sets, scratch), scratch), "merged")

    nodes = classes.select("node", "n", "h", "rep").join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
    nodes = nodes.join(merged.withColumnRenamed("node", "c"), "c", "left").withColumn("c", F.coalesce("component", "c")).select("n", "h", "rep", "c")
    nodes = scratch.write(nodes, "nodes")
    least = nodes.groupBy("c").agg(F.min("rep").alias("component"))
    by_set = nodes.join(least, "c").select("n", "h", "component")
    alone = table.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return linked.select("id", "n", "h").join(by_set, ["n", "h"]).select("id", "n", "component").union(alone)


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One document of each component: the one whose doc_id is the component's. Rows with a null doc_id stay."""
    scratch = scratch or Scratch(docs.sparkSession)
    gone = components(docs, text, doc_id, scratch).where("id <> component").select(F.col("id").alias("__gone")).distinct()
    gone = small(scratch.write(gone, "gone"))
    return docs.join(gone, docs[doc_id] == F.col("__gone"), "left_anti")
