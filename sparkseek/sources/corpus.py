"""Typed record corpora from the driver's tables, and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions.text import TYPES

RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        *[T.StructField(c, T.StringType()) for c in ("url", "heading", "heading_id", "breadcrumb", "body", "type", "selector")],
        T.StructField("selectors", T.ArrayType(T.StringType())),
        T.StructField("iframe_path", T.ArrayType(T.IntegerType())),
        T.StructField("destructive", T.BooleanType()),
        *[T.StructField(c, T.StringType()) for c in ("label", "value", "transcript", "structured_data")],
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a record: its first four words as the heading, language as label, source as breadcrumb."""
    kinds = F.array(*map(F.lit, TYPES))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.array_join(F.slice(F.split("text", r"\s+", 5), 1, 4), " ").alias("heading"),
        F.col("text").alias("body"),
        F.col("lang").alias("label"),
        F.col("source").alias("breadcrumb"),
        F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")).alias("type"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a record: name as heading; name, type and brand as body."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("seq"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_name").alias("heading"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("body"),
        F.col("p_brand").alias("label"),
        F.col("p_type").alias("breadcrumb"),
        F.lit("section").alias("type"),
    )


def mock(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records from partial rows, with the defaults of a test index."""
    full = [{"seq": i, "id": f"mock-{i}", "url": "/", "heading": "", "heading_id": f"mock-{i}", "breadcrumb": "", "body": "", "type": "section"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([[r.get(f.name) for f in RECORD] for r in full], RECORD)


def cms(payloads: DataFrame) -> DataFrame:
    """Records of CMS answers in ``payload``: either an array, or an object with ``records``."""
    record = "struct<id:string,url:string,heading:string,body:string,type:string>"
    shaped = F.when(F.ltrim("payload").startswith("["), F.from_json("payload", f"array<{record}>")).otherwise(F.from_json("payload", f"struct<records:array<{record}>>")["records"])
    return payloads.select(F.explode(shaped).alias("r")).select("r.*")
