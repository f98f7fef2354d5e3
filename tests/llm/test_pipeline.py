import corpus_pipeline
from pyspark.sql import functions as F

from tabweave.llm import decontam

from ..conftest import SF
from . import brute
from .test_operators import check_sequences


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("source")))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(after) <= set(before)
        if name == "quality_rules":
            assert all(brute.base_counts(t)[0] >= 10 for t in after.values())
        elif name == "line_dedup":
            gone = brute.later_copies(list(before.items()), 50)
            assert all(len([x for x in after.get(i, "").split("\n") if brute.spaced(x)]) == len([x for x in t.split("\n") if brute.spaced(x)]) - len(gone[i]) for i, t in before.items())
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near_components(list(before.items())).items() if i == c}
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before.items() if not brute.contamination(t, items)[0]}
        seen.append(name)
    rows = out.collect()
    check_sequences(rows, 2048)
    assert {r["doc_id"] for r in rows} == set(after) and len(seen) == 5


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None
    assert decontam.WINDOW == 10
