"""Embedding rows: which take part, and one class for each distinct vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def keyed(vectors: DataFrame, *by: str) -> DataFrame:
    """``vec_id, embedding`` and ``by`` of each row, whether it takes part, and a 128-bit key of vector and ``by``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *by)
    ok = usable(F.col("embedding"))
    for c in by:
        ok = ok & F.col(c).isNotNull()
    rows = rows.withColumn("ok", ok)
    return rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), *by, "embedding") for i in (1, 2)})


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of equal length in double precision."""
    return np.stack(column.to_numpy()).astype(np.float64)
