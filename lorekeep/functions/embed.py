"""A vector for texts without one: signed feature hashing of words, in Arrow batches. A model can be plugged in the same way."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_vectors(rows: DataFrame, text: str, dims: int = 64, head: int = 512) -> DataFrame:
    """Adds ``embedding``, of unit length: words of the first ``head`` characters (what an embedding model takes in), each hashed to a
    signed dimension. Texts without words get a zero vector."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t):
            v = np.zeros(dims, np.float32)
            for w in (t or "")[:head].lower().split():
                h = zlib.crc32(w.encode("utf-8"))
                v[h % dims] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            return v / n if n else v

        return texts.map(one)

    return rows.withColumn("embedding", embed(F.col(text)))
