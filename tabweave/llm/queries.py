"""The operators' registered queries (``QUERIES``) and their DuckDB equivalents (``SQL``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license as licenses
from . import decontam, langid, linededup, neardup, oracles, packing, qualityclf, qualityrules, sharding, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: op1: the shards of the production layout.
SHARDS = [f"shard-{k:04d}" for k in range(64)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, ["doc_id"], SHARDS).select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs, fold != 2)
    held = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return langid.predict(held, model, ["doc_id", "held_out"])


# op3's rules.
RULES: list[urlfilter.Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urlfilter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "via")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedupe(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = qualityrules.trusted(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return qualityrules.score(docs, F.col("__trusted")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.components(docs).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = qualityclf.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return qualityclf.predict(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model, ["doc_id", "held_out"])


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_near_duplicates": op10_near_duplicates,
}

SQL: dict[str, str] = {
    "op1_sharding": oracles.op1(SHARDS),
    "op3_url_filter": oracles.op3(RULES),
    "op4_line_dedup": oracles.OP4,
    "op7_decontamination": oracles.OP7,
    "op10_near_duplicates": oracles.OP10,
}
