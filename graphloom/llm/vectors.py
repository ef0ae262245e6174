"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that can take part: id given, vector not null, not all zero, all components finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ok & some).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))


def matrix(vectors: pd.Series, dim: int | None = None) -> np.ndarray:
    rows = vectors.tolist()
    return np.array(rows, np.float64).reshape(len(rows), dim or (len(rows[0]) if rows else 0))
