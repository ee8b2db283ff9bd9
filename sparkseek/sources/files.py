"""Documents in files: plain text is read, other kinds go through a caller's function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_document(url: Column) -> Column:
    """Whether a URL names a PDF, Word, Excel or PowerPoint document."""
    return F.lower(url).rlike(r"\.(pdf|docx?|xlsx?|pptx?)($|\?)")


def file_documents(spark: SparkSession, path: str, extract: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """``path, type, text`` of the files under ``path``.

    The text of text and markup files is their content in UTF-8. ``extract`` gets the paths and bytes of the others and
    returns their texts; without it they are empty.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", kind.alias("type"), "content")
    plain = F.col("type").isin("txt", "text", "md", "csv", "json", "xml", "html", "htm", "")
    other = F.pandas_udf(extract, "string")(F.col("path"), F.when(~plain, F.col("content"))) if extract else F.lit("")
    return rows.withColumn("other", other).select("path", "type", F.when(plain, F.col("content").cast("string")).otherwise(F.coalesce("other", F.lit(""))).alias("text"))
