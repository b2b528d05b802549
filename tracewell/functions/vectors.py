"""Column functions on vectors, and the one plug-in point: the embedder."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Makes, once per worker, the function that turns texts into a (n, dims) array.
EmbedderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the cosine for vectors of unit length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def vector_norm(vector: Column) -> Column:
    return F.sqrt(inner_product(vector, vector))


def normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    norm = vector_norm(vector)
    return F.transform(
        vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))
    ).cast("array<float>")


def embed(text: Column, factory: EmbedderFactory) -> Column:
    """Unit-length float vectors of a text column, in Arrow batches.

    The model behind ``factory`` is loaded once per worker, not per batch.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("").tolist()), dtype="float64")
            vectors = vectors.reshape(len(texts), -1)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, norms, out=vectors.copy(), where=norms > 0)
            yield pd.Series(list(unit.astype("float32")), index=texts.index)

    return run(text)


def hashed_tokens(dims: int = 384) -> EmbedderFactory:
    """A model-free stand-in: token counts hashed to ``dims`` signed places."""

    def factory():
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, text in enumerate(texts):
                for token in text.lower().split():
                    code = zlib.crc32(token.encode())
                    out[row, (code >> 1) % dims] += 1.0 if code & 1 else -1.0
            return out

        return model

    return factory
