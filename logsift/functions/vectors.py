"""Dense vector expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit_vector(vector: Column) -> Column:
    """L2-normalised copy, so that a dot product is a cosine. Zero vectors stay zero."""
    return _over_length(vector, lambda x, length: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def unit_weights(weights: Column) -> Column:
    """Term weights over their length; null for null."""
    return _over_length(weights, lambda w, length: w / length)


def _over_length(values: Column, divided: Callable[[Column, Column], Column]) -> Column:
    """The length is the last step of the sum: used by the function of a value, it would be summed up anew for each value."""
    return F.aggregate(
        values, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.transform(values, lambda x: divided(x, F.sqrt(total))))


def embed_texts(
    docs: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", rows: int = 256,
) -> DataFrame:
    """Adds ``embedding``, the unit vectors of a caller's encoder.

    ``encoder`` takes a list of texts and returns one row of numbers for each; it is called
    with at most ``rows`` texts and must be importable or serialisable on the workers. A
    null text has no embedding. No encoder is shipped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                some = batch.slice(first, rows)
                texts = some.column(text).to_pylist()
                present = [t for t in texts if t is not None]
                found = iter(np.asarray(encoder(present), np.float64).tolist() if present else [])
                vectors = pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*some.columns, vectors], names=[*some.schema.names, "embedding"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.drop("embedding").dtypes)
    encoded = docs.drop("embedding").mapInArrow(run, f"{kinds}, embedding array<double>")
    return encoded.withColumn("embedding", unit_vector(F.col("embedding")))
