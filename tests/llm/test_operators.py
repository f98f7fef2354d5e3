import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm import components, decontam, langid, linededup, neardup, packing, qualityclf, qualityrules, queries, sharding, urlfilter
from tabweave.llm import license as licenses
from tabweave.llm.common import Scratch, plain_words

from ..compare import assert_same, database
from ..conftest import SF
from . import brute

LONG = " ".join(f"word{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    near = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  \n\t", "one", "one two three", LONG, near, near + " more", near.replace("w7 ", "x "), "Same text here now", "same TEXT here now", "é É ß\n\né É ß", "🙂 🙂 🙂 🙂"]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)] + [(None, "no id at all here", None, "s", 1), (3, "one", "en", None, None), (3, "one", "en", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (6, 1, 0), (7, 1, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], database(SF))


# ---- 1 sharding


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 40), st.sampled_from([101, 251, 1009]))
def test_lookup_table_is_even(n, size):
    table = sharding.lookup_table([f"s{k}" for k in range(n)], size)
    counts = Counter(table)
    assert len(table) == size and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == n


def test_lookup_table_moves_little():
    names = [f"s{k}" for k in range(20)]
    a, b = sharding.lookup_table(names, 4099), sharding.lookup_table(names[:-1], 4099)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19)
    assert moved < 0.1 * 4099
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_placement(spark, odd, empty, tmp_path):
    rows = sharding.place(odd, ["doc_id"], ["a", "b", "c"]).collect()
    table = sharding.lookup_table(["a", "b", "c"])
    assert len(rows) == odd.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 65537 and r["shard"] == table[r["slot"]]
    assert sharding.place(empty, ["doc_id"], ["a"]).count() == 0
    sharding.write(odd, f"{tmp_path}/s", ["doc_id"], ["a", "b"], salt=["text"])
    assert spark.read.parquet(f"{tmp_path}/s").count() == odd.count()


# ---- 2 language


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.op2_language_id(spark, SF).collect() if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_cases(spark, odd, empty):
    model = langid.train(["the cat and the dog"] * 10 + ["der Hund und die Katze"] * 10, ["en"] * 10 + ["de"] * 10)
    got = {r["doc_id"]: r for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 12)] == ["und"] * 4 and got[0]["score"] == 0 and got[5]["lang_pred"] in ("de", "en")
    assert model.langs[model.predict(["die Katze und der Hund"]).argmax()] == "de"
    assert langid.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0


def test_sample_has_every_language(spark):
    rows = [(i, f"text {i}", f"l{i % 1500:04d}") for i in range(4000)] + [(5, f"text {i}", "l0005") for i in range(3000)] + [(i, "more", "big") for i in range(10_000, 25_000)]
    got = langid.labelled_sample(spark.createDataFrame(rows, "id long, t string, l string"), 3002).collect()
    by = Counter(r["l"] for r in got)
    assert len(by) == 1501 and max(by.values()) == 2 and by["big"] == 2
    assert len({r["id"] for r in got}) == len(got) <= 3002
    assert sum(len(r["t"]) for r in langid.labelled_sample(spark.createDataFrame(rows, "id long, t string, l string"), 3002, size=50).collect()) < 62


def test_softmax_against_brute_force(monkeypatch):
    """A text's probabilities by their definition, also by slices and with more languages than the embedding's numbers."""
    texts = ["the quiet river", "der stille fluss", "le fleuve calme", "a"] * 12
    for dim in (2, 16):
        m = langid.train(texts, ["en", "de", "fr", "xx"] * 12, bits=10, dim=dim, epochs=2)
        assert (m.weights is None) == (dim == 16)
        monkeypatch.setattr(langid, "SLICE", 7)
        for t in set(texts):
            ids = langid.ngrams([t], 10)[0]
            mean = np.mean([m.table[i] for i in ids], 0, dtype=np.float64)
            logits = ((mean if m.weights is None else mean @ m.weights) + m.bias) / m.temperature
            want = np.exp(logits) / np.exp(logits).sum()
            assert m.predict([t])[0] == pytest.approx(want, abs=1e-6)
            assert m.predict([t, "other"])[0] == pytest.approx(want, abs=1e-6)
        monkeypatch.undo()


def test_ngrams_stay_in_their_text():
    ids, starts = langid.ngrams(["ab", "xyz"])
    alone = [set(langid.ngrams([t])[0]) for t in ("ab", "xyz")]
    parts = np.split(ids, starts[1:])
    assert [set(p) for p in parts] == alone


# ---- 3 urls


RULES = queries.RULES


def judge_plain(url):
    host = path = ""
    if url and "://" in url:
        import re

        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(brute.LOW)
    fit = [(h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
    return host, path, rule, action


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?q#f", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/a/b", "http://x.com", "http://org/", "http://myorg/", "a://b://c/d", "http://x.net/de/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, action = judge_plain(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action or "allow"), u
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


def test_url_aliases(spark):
    link = lambda u: f'<LINK href="{u}" rel=\'canonical\'>'
    pages = spark.createDataFrame(
        [
            (1, "http://a.net/x", link("http://b.com/de/x")),  # canonical of a blocked url
            (2, "https://a.net/x/#frag", None),  # another spelling of 1
            (3, "http://c.net/y", '<meta http-equiv="refresh" content="0; url=/z">'),
            (4, "http://c.net/z", link("//d.org/ok")),
            (5, "http://d.net/q", link("http://a.net/x")),
            (6, "http://e.net/q", link("http://d.org/ok")),
            (7, "http://f.net/q", None),
            (8, "http://b.com/de/y", link("http://c.net/y")),
        ],
        "page_id long, url string, html string",
    )
    redirects = spark.createDataFrame([("http://f.net/q", "http://d.net/q")], "source string, target string")
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in urlfilter.judge(pages, RULES, redirects).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("allow", "alias"), 5: ("block", "alias"), 6: ("allow", "alias"), 7: ("block", "alias"), 8: ("block", "rule")}


def test_all_declared_links(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    pages = spark.createDataFrame(
        [
            (1, "http://a.net/1", link("http://z.net/1") + link("http://z.net/2")),
            (2, "http://a.net/2", """<meta http-equiv="refresh" content="0;url='https://z.net/3'">"""),
            (3, "http://a.net/3", link("http://z.net/?a=1&amp;b=2&#38;c&#x3D;3&d=&amp;lt;")),
        ],
        "page_id long, url string, html string",
    )
    got = sorted((r["source"], r["target"]) for r in urlfilter.page_links(pages).collect())
    assert got == [("http://a.net/1", "http://z.net/1"), ("http://a.net/1", "http://z.net/2"), ("http://a.net/2", "https://z.net/3"), ("http://a.net/3", "http://z.net/?a=1&b=2&c=3&d=&lt;")]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    real = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = components.connected_components(df, Scratch(spark)).collect()
    assert sorted(map(tuple, got)) == sorted((x, root[x]) for x in real)


# ---- 4 lines


def line_result(df, **params):
    out = linededup.dedupe(df, **params)
    return {r["doc_id"]: r for r in out.collect()}


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(f"{c}{k}" for k in range(rng.randint(1, 4))) for c in "abcdef"]
    for words in (1, 4, 9):
        docs = [(i, "\n".join(rng.choice(["", *pool]) for _ in range(rng.randint(0, 14)))) for i in range(25)]
        got = line_result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=words)
        for i, gone in brute.later_copies(docs, words).items():
            assert got[i]["n_deleted"] == len(gone)
            left = [x for k, x in enumerate(y for y in docs[i][1].split("\n") if brute.spaced(y)) if k not in gone]
            assert [x for x in got[i]["text"].split("\n") if brute.spaced(x)] == left


def test_line_cases(spark, odd, empty):
    got = linededup.dedupe(odd, min_words=3).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["text"] is None and by_id[2]["text"] == "  \n\t" and by_id[5]["text"] == LONG and by_id[11]["n_deleted"] == 1
    assert linededup.dedupe(empty).count() == 0
    block = "\n".join(f"line {i} with five words" for i in range(12))
    docs = spark.createDataFrame([(1, block), (2, "head\n" + block + "\n\ntail"), (3, block), (None, "x")], "doc_id long, text string").withColumn("N_LINES", F.lit("mine"))
    kept = {r["doc_id"]: r["text"] for r in linededup.apply(docs).collect()}
    assert kept == {1: block, 2: "head\ntail", None: "x"} and linededup.apply(docs).columns == docs.columns


# ---- 5 packing


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in documents.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    check_sequences(rows, packing.TOKENS)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // packing.TOKENS) + 2


def check_sequences(rows, size):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for g in groups.values():
        at = 0
        for offset, length in sorted(g):
            assert offset == at
            at += length
        assert at <= size


def test_packing_cases(spark, odd, empty):
    rows = packing.pack_documents(odd, size=64, group=7).collect()
    check_sequences(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert all(r["length"] == 64 for r in rows if r["piece"] > 0)
    assert [r["length"] for r in rows if r["doc_id"] in (0, 1)] == [1, 1]
    assert packing.pack_documents(empty).count() == 0
    encode, special = packing._encoder(packing.default_vocabulary()), "a <|endoftext|> b"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    for text in (special, "naïve ÀÉÎ 12 don't  \n\n x", "漢字 🙂 текст", "\x00\x1c\x85\xa0 ſ"):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 6), st.integers(2500, 6000), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(lengths, documents, attention, rule):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.best_fit(np.array(lengths, int), 50, documents, attention, rule=rule)
    for b in set(bins.tolist()):
        own = [(o, n) for o, n, k in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if k == b]
        assert len(own) <= documents and sum(n for _, n in own) <= 50 and sum(n * n for _, n in own) <= attention
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n


def test_repeated_rows_are_dealt_evenly(spark):
    """30,000 equal pieces don't meet in one group."""
    table = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), *[F.lit(k).cast("long").alias(c) for c, k in (("start", 0), ("length", 1), ("ids_crc32", 7))])
    rows = packing.pack(table, group=1024).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 30_000 and len(groups) == 30 and max(groups.values()) < 1400
    places = sorted((r["sequence_id"], r["offset"]) for r in rows)
    assert len(set(places)) == 30_000 and "place" not in rows[0]


def test_best_fit_against_brute_force():
    rng = random.Random(8)
    for tokens, documents, attention in ((64, None, None), (64, 5, 1500)):
        lengths = sorted((rng.randint(1, 38) for _ in range(300)), reverse=True)
        bins, offsets = packing.best_fit(np.array(lengths), tokens, documents, attention)
        caps, weights, made, want = (tokens, documents or tokens, attention or tokens**2), (1.0, 0.01, 0.01), [], []
        for n in lengths:
            fits = [(sum(w * (c - u - d) ** 2 / c**2 for w, c, u, d in zip(weights, caps, used, (n, 1, n * n), strict=True)), k) for k, used in enumerate(made) if all(u + d <= c for u, d, c in zip(used, (n, 1, n * n), caps, strict=True))]
            best = min(fits)[0] if fits else None
            want.append([k for score, k in fits if abs(score - best) < 1e-12])
            k = int(bins[len(want) - 1])
            if not fits:
                assert k == len(made)
                made.append([0, 0, 0])
            else:
                assert k in want[-1]
            assert offsets[len(want) - 1] == made[k][0]
            made[k] = [u + d for u, d in zip(made[k], (n, 1, n * n), strict=True)]


# ---- 6 quality rules


def test_base_counts(spark, odd, documents):
    rows = odd.select("doc_id", "text").collect() + [type(odd.head())(doc_id=i, text=t) for i, t in documents.items()]
    df = spark.createDataFrame([(k, r["text"]) for k, r in enumerate(rows)], "doc_id long, text string").withColumn("t", F.lit(False))
    got = {r["doc_id"]: r for r in qualityrules.score(df, F.col("t")).collect()}
    for k, r in enumerate(rows):
        want = brute.base_counts(r["text"])
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[k]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert got[k]["kept"] == (not got[k]["base_failed"])  # without a target the ratio rejects nothing


def test_ratio_against_brute_force(spark):
    """The tables and means by their definition, with Spark's own hash of the n-grams; at the larger size the cutoff is over 2."""
    good, bad = "a quiet river runs below the old stone bridge at dawn", "buy $$$ now *** buy $$$ now *** cheap ### pills %%% fast"
    rng = random.Random(5)
    mixed = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(400)) for _ in range(100)]
    for texts in ([good if i % 2 else bad for i in range(12)], mixed):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.col("doc_id") % 2 == 1)
        got = {r["doc_id"]: r for r in qualityrules.score(docs, F.col("t"), prior=16.0).collect()}
        n = qualityrules.n_buckets(sum(map(len, texts)))
        grams = {r["doc_id"]: r["g"] for r in docs.select("doc_id", qualityrules.ngram_buckets(F.split("text", " "), n).alias("g")).collect()}
        raw, hit = Counter(x for g in grams.values() for x in g), Counter(x for i, g in grams.items() if i % 2 for x in g)
        n_raw, n_hit = sum(raw.values()), sum(hit.values())
        least = max(2, 2 * n_raw / n)
        assert (least > 2) == (texts is mixed)

        def ratio(x, own):
            h = hit[x] - own if raw[x] >= least else 0
            p = raw[x] / n_raw
            return np.log((h + 16 * p) / (n_hit + 16) / p) if h > 0 else np.log(16 / (n_hit + 16))

        for i, g in grams.items():
            assert got[i]["llr"] == pytest.approx(np.mean([ratio(x, i % 2) for x in g]), abs=1e-5)
            if texts is not mixed:
                assert got[i]["kept"] == (i % 2 == 1)


def test_ratio_rejects_junk_at_every_size(spark):
    """Distinct junk n-grams, however many, don't come to look like the target's; clean texts stay."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(60))
    junk = lambda: " ".join(f"x{rng.getrandbits(40)}$$$" for _ in range(60))
    for n in (100, 1500):
        docs = [(i, junk() if i % 3 == 0 else clean()) for i in range(n)]
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.col("doc_id") % 3 == 1)
        rows = qualityrules.score(df, F.col("t")).collect()
        assert len(rows) == n and all(not r["base_failed"] and r["kept"] == (r["doc_id"] % 3 != 0) for r in rows)


def test_table_grows_with_the_corpus():
    sizes = [qualityrules.n_buckets(10**k) for k in range(4, 16)]
    assert sizes == sorted(set(sizes)) and qualityrules.n_buckets(3 * 10**14) < 8_000_000


def test_quality_cases(spark, odd, empty, labels):
    out = qualityrules.apply(odd.withColumn("KEPT", F.lit(1)), labels)
    assert out.columns == [*odd.columns, "KEPT"] and {r["doc_id"] for r in out.collect()} <= {5, 6, 7, 8}
    assert qualityrules.apply(empty, labels).count() == 0
    wide = qualityrules.trusted(odd, labels, broadcast_ids=0)
    assert wide.count() == odd.count() and {r["doc_id"] for r in wide.where("__trusted").collect()} == {5, 6}


# ---- 7 decontamination


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 12, 25])))) for i in range(12)] + [(99, None), (1, "zz top"), (1, "zz top")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 40))]
        for _, t in rng.sample(items, 2):
            if t and rng.random() < 0.6:
                at = rng.randint(0, len(w))
                w[at:at] = t.upper().split()
        docs.append((i, ", ".join(w)))
    docs += [(60, None), (None, "zz top"), (61, "zz top"), (61, "zz top")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(df, bench).collect()
    assert len(got) == len(docs)
    for r in got:
        hit, ids = brute.contamination(r["text"], items)
        assert (set(r["hit"]), r["items"], r["contaminated"], r["n_words"]) == (hit, ids, bool(hit), len(brute.plain(r["text"])))
    clean = decontam.apply(df.withColumn("HIT", F.lit(0)), bench)
    assert clean.columns == ["doc_id", "text", "HIT"] and clean.count() == sum(not r["contaminated"] for r in got)


def test_plain_words_against_brute_force(spark):
    """Any characters, gaps first, last and alone."""
    rng = random.Random(8)
    marks = [chr(c) for c in range(128)] + ["é", "É", "İ", "ß", "\u0080", "\u00a0", "\u2028", "\ufeff", "漢", "🙂"]
    texts = ["", " ", "..", "a", " a", "a ", None] + marks + ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", plain_words(F.col("t")).alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: brute.plain(t) for i, t in enumerate(texts)}


def test_contamination_cases(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.apply(odd, none).count() == odd.count()
    bench = spark.createDataFrame([(1, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.scan(odd, bench).where("contaminated").collect()} == {5}
    assert decontam.scan(empty, bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha y y beta z"), (2, "alpha " + "y " * 50 + "beta"), (3, "beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    rows = decontam.PositionalIndex(docs, bench).proximity(3).collect()
    assert {(r["id"], r["item"], r["first"], r["last"], r["n_terms"]) for r in rows} == {(1, "7", 1, 4, 2)}


# ---- 8 licenses


def test_licenses(spark, odd, empty):
    texts = {
        1: "Text. Released under the MIT License.\nLicensed under CC BY 4.0",
        2: "licensed under the Apache License, Version 2.0. apache-license",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        5: "under the terms and a bridge by the source",
        6: "Redistribution and use in source and binary forms, with or without CHANGES, are permitted",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(odd.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [(got[k]["base_labels"], got[k]["labels"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"]) for k in texts] == [
        ("cc-by,mit", "cc-by,cc-by-4.0,mit", 2, 4, 8),
        ("apache", "apache,apache-2.0", 2, 3, 8),
        ("gpl", "gpl,gpl-3.0", 1, 6, 6),
        ("", "mit", 0, None, None),
        ("", "", 0, None, None),
        ("", "bsd", 0, None, None),
    ]
    assert all((0 <= r["score"] <= 1) and (r["score"] > 0) == (r["labels"] != "") for r in got.values())
    assert got[100]["n_words"] == 0 and got[105]["n_words"] == 30_000
    assert licenses.scan(empty).count() == 0


def test_every_template_is_looked_up(spark):
    """A text with several licences gets all of them, whichever words are rare."""
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    some = [n for label, n, _ in licenses.TEMPLATES if label in ("apache-2.0", "bsd", "mpl-2.0")]
    common = [(k, " ".join(x for n in some for x in n.split()[k % 3 :: 3])) for k in range(3, 30)]  # makes some words frequent
    df = spark.createDataFrame([(1, ". ".join(some)), (2, "\n".join(notices)), *common], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(df).collect()}
    assert got[1] >= {"apache-2.0", "bsd", "mpl-2.0"}
    assert got[2] >= {label for label, _, _ in licenses.TEMPLATES}


def test_license_labels_against_brute_force(spark):
    """Every alignment with the whole key phrase and half of the words in place, over random mixtures of notices."""
    rng = random.Random(12)
    notices = [brute.plain(n) for _, n, _ in licenses.TEMPLATES]
    texts = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 20)):
            n = list(rng.choice(notices))
            for _ in range(rng.randint(0, 6)):
                n[rng.randrange(len(n))] = rng.choice(["x", "license", "software", "the"])
            if rng.random() < 0.2:
                del n[rng.randrange(len(n))]
            w += n + ["and"] * rng.randint(0, 2)
        texts.append((i, " ".join(w)))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        w, labels, best = brute.plain(t), set(), 0.0
        for (label, _, key), n in zip(licenses.TEMPLATES, notices, strict=True):
            k = key.split()
            at = next(j for j in range(len(n)) if n[j : j + len(k)] == k)
            for start in range(-at, len(w)):
                if w[start + at : start + at + len(k)] == k:
                    share = sum(0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(n)) / len(n)
                    if share >= 0.5:
                        labels.add(label)
                        best = max(best, share)
        labels |= {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(w)} "}
        assert got[i]["labels"] == ",".join(sorted(labels)) and got[i]["score"] == pytest.approx(max(best, 0.5 if got[i]["base_labels"] else 0))


def test_license_base_against_brute_force(spark, documents):
    rows = queries.op8_license_scan(spark, SF).collect()
    for r in rows:
        w = brute.plain(documents[r["doc_id"]])
        hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in hits}))


# ---- 9 classifier


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    unary, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    marg, pair = qualityclf.forward_backward(unary, trans, sizes)
    at, want, both = 0, [], np.zeros((2, 2))
    for n in sizes:
        total, own, two = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(unary[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for i, s in enumerate(path):
                own[i, s] += p
            for a, b in itertools.pairwise(path):
                two[a, b] += p
        want.append(own / total)
        both += two / total
        at += n
    assert np.allclose(marg, np.vstack(want)) and np.allclose(pair, both)


def test_classifier_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op9_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_classifier_sample_is_bounded(spark, monkeypatch):
    """Copies of one labelled id are one row of the sample."""
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).union(spark.range(2, 30).selectExpr("id", "'other'"))
    labels = spark.range(0, 40).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    seen = []
    monkeypatch.setattr(qualityclf, "train", lambda texts, marks: seen.append((texts, marks)))
    qualityclf.fit(docs, labels, F.lit(True), bound=50)
    texts, marks = seen[0]
    assert len(texts) == 29 and texts.count("text 0") == 1 and sum(marks) == 15


def test_clashing_names(spark):
    """Input columns of the operators' output and inner names."""
    names = ["shard", "slot", "slot_of_row", "node", "component_action", "node_of_page", "lang_pred", "score", "rejected", "predicted", "hit", "__w", "base", "found", "llr", "words", "n_words", "kept"]
    docs = spark.createDataFrame([(1, "http://a.org/x", "one two three"), (None, None, None)], "doc_id long, url string, text string")
    wide = docs.withColumns({n: F.lit(-1) for n in names}).withColumn("t", F.col("doc_id") == 1)
    placed = sharding.place(wide, ["doc_id"], ["a", "b"])
    assert {*placed.columns} == {*wide.columns} and placed.where("slot >= 0 and shard >= 0 and slot_of_row = -1").count() == 2
    judged = urlfilter.judge(wide.withColumn("html", F.lit(None).cast("string")), [("block", "org", "/")])
    assert [r["verdict"] for r in judged.orderBy(F.desc("doc_id")).collect()] == ["block", "allow"] and {*wide.columns} <= {*judged.columns} and judged.where("node = -1 and component_action = -1").count() == 2
    model = langid.train(["a b", "c d"], ["x", "y"], bits=8)
    assert langid.predict(wide, model, wide.columns).columns.count("score") == 1 and langid.predict(wide, model, wide.columns).count() == 2
    assert qualityclf.predict(wide, qualityclf.train([], []), wide.columns).columns.count("score") == 1
    assert licenses.scan(wide).columns.count("base") == 1 and licenses.scan(wide).where("n_words >= 0 and score = 0").count() == 2
    scored = qualityrules.score(wide, F.col("t"))
    assert scored.columns.count("llr") == 1 and scored.where("base_failed and words = -1").count() == 2
    assert neardup.dedupe(wide).columns == wide.columns and linededup.apply(wide).columns == wide.columns


def test_classifier_cases(spark, odd, empty, labels):
    model = qualityclf.train(["A clean line of text.\nAnother one here."] * 5 + ["$$$ *** ###\n||| %%% !!!"] * 5, [1] * 5 + [0] * 5)
    got = qualityclf.predict(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    good, bad = model.score(["A fine line of text."]), model.score(["### *** $$$"])
    assert good > 0.5 > bad
    assert qualityclf.fit(odd, labels, F.lit(True)).constant == 1.0
    assert qualityclf.fit(empty, labels, F.lit(True)).constant == 0.5
    assert qualityclf.predict(empty, model, ["doc_id"]).count() == 0


# ---- 10 near duplicates


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    base = [[f"{c}{rng.randint(0, 400)}" for _ in range(rng.randint(4, 90))] for c in "abcdefgh"]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
        docs.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a")]
    got = {r["id"]: (r["n"], r["component"]) for r in neardup.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_components(docs)


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def hub_members(sets, hubs, rng):
    """(hub, ch, node, n, c) as the stars leave them: what is linked with a hub is of its component, some others share one too."""
    root = {i: i for i in sets}
    for h in hubs:
        for i in sets:
            if i != h and similar(sets[i], sets[h]):
                old, new = root[i], root[h]
                root = {k: new if v == old else v for k, v in root.items()}
    loose = [i for i in sets if root[i] == i and i not in hubs]
    for i, j in zip(loose[::7], loose[1::7]):
        root[j] = i
    return [(h, root[h], i, len(sets[i]), root[i]) for h in hubs for i in sets if i != h and rng.random() < 0.95]


def candidates_of(spark, sets, members):
    m = spark.createDataFrame(members, "hub long, ch long, node long, n long, c long")
    s = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "node long, s array<long>")
    return neardup.prefix_candidates(m, s, Scratch(spark)).collect()


def test_second_pass_against_brute_force(spark, monkeypatch):
    """Candidates miss no link, whatever the order of shingles; texts that share a template only aren't paired."""
    rng = random.Random(21)
    monkeypatch.setattr(neardup, "FREQUENT", 5)
    template = list(range(100))
    rows = [template + list(range(1000 + 50 * i, 1000 + 50 * i + rng.randint(15, 40))) for i in range(60)]  # similar by 0.56 to 0.77
    chain = rng.sample(range(20_000, 30_000), 60)
    rows += [chain[k : k + 40] for k in range(0, 20, 2)] + [template + list(range(200, 200 + k)) for k in range(5, 25)]
    base = rng.sample(range(30_000, 40_000), 70)
    for _ in range(120):  # subsets, supersets and edits of one base, at all distances from it
        cut, more = rng.randint(0, 22), rng.choice([0, 0, rng.randint(0, 22)])
        rows.append(rng.sample(base, 70 - cut) + rng.sample(range(50_000, 50_060), more))
    sets = dict(enumerate(map(frozenset, rows)))
    members = hub_members(sets, [3, 64, 75, 95, 110], rng)
    by_hub = {}
    for h, _, i, _, c in members:
        by_hub.setdefault(h, []).append((i, c))
    links = {(max(i, j), min(i, j)) for of in by_hub.values() for i, c in of for j, d in of if i < j and c != d and similar(sets[i], sets[j])}
    got = candidates_of(spark, sets, members)
    assert len(links) > 100 and links <= {(max(r["x"], r["y"]), min(r["x"], r["y"])) for r in got}
    assert not any(r["x"] < 60 and r["y"] < 60 for r in got)


def test_second_pass_beside_a_large_group(spark):
    """Texts just too far from a group of near copies aren't paired with all its members: pairs grow with the texts."""
    counts = []
    for size in (150, 600):
        rng = random.Random(5)
        base = list(range(147))
        own = iter(range(1000, 10**6))

        def edited(words):
            s = base[:]
            for at in rng.sample(range(144), words):
                for k in range(4):  # a word changed changes four shingles
                    s[at + k if at + k < 147 else at] = next(own)
            return frozenset(s)

        sets = {0: frozenset(base)} | {i: edited(rng.randint(1, 3)) for i in range(1, size)} | {i: edited(rng.randint(5, 9)) for i in range(size, 2 * size)}
        members = [(0, 0, i, len(s), 0 if similar(s, sets[0]) else i) for i, s in sets.items() if i]
        counts.append(len(candidates_of(spark, sets, members)))
    assert counts[1] <= 4 * max(counts[0], 100)


def test_near_duplicate_cases(spark, odd, empty):
    rows = neardup.components(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["id"]: r["component"] for r in rows}
    assert by_id[10] == 9 and by_id[7] == 6 and by_id[0] == 0 and by_id[None] is None and by_id[4] == 4
    kept = neardup.dedupe(odd.withColumn("N", F.lit(0)))
    assert kept.columns == [*odd.columns, "N"] and {7, 10}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert neardup.components(empty).count() == 0


def test_signature_estimates_similarity(spark):
    """Shares of equal bins estimate the similarity, also with most bins empty."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        both = [rng.getrandbits(63) - (1 << 62) for _ in range(40)]
        rows.append((k, both + [rng.getrandbits(63) for _ in range(5)], both + [rng.getrandbits(63) for _ in range(5)]))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    got = df.select(neardup.signature(F.col("a")).alias("a"), neardup.signature(F.col("b")).alias("b")).collect()
    assert all(len(r["a"]) == 256 and None not in r["a"] for r in got)
    assert abs(np.mean([x == y for r in got for x, y in zip(r["a"], r["b"], strict=True)]) - 0.8) < 0.06
