"""Vector likeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """a.b / (|a||b| + 1e-8), rounded half-even to 4 places. What is rounded to 0 keeps its sign, which ``bround`` loses."""
    return F.rint(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8) * 10000) / 10000


def score_against(df: DataFrame, query: list[float], vector: str = "embedding", out: str = "similarity") -> DataFrame:
    """df with the likeness of each row's vector to one query, as a matrix product over Arrow batches.

    The query travels with the plan, so there is no join; rows stay where they are. A null vector, or one of another
    length, has a null likeness.
    """
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt(q @ q))
    df = df.drop(out)
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
            good = lengths == len(q)
            found = np.full(batch.num_rows, np.nan)
            if good.any():
                rows = np.asarray(column.filter(pa.array(good)).flatten(), np.float64).reshape(-1, len(q))
                found[good] = np.round((rows @ q) / (np.sqrt((rows * rows).sum(axis=1)) * norm + 1e-8), 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=~good)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
