"""Vector expressions: similarity, scores, norms and a deterministic stand-in for an embedding model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column, space: str = "cosine", alpha: float = 1.0, l2: str = "inverse") -> Column:
    """A score in [0, 1] from a distance (from the dot product for "ip"); null stays null, unknown spaces count as cosine."""
    d = distance.cast("double")
    if space == "l2":
        s = F.exp(-alpha * d) if l2 == "exp" else F.coalesce(F.try_divide(F.lit(1.0), 1 + alpha * d), F.lit(1.0))
    elif space == "ip":
        s = 1 / (1 + F.exp(-d))
    else:
        s = 1 - d / 2
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def plain_similarity(distance: Column) -> Column:
    """The other score in use: 1 less the distance, kept in [0, 1]."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance.cast("double"))))


def normalised(a: Column) -> Column:
    n = norm(a) + F.lit(1e-8)
    return F.transform(a, lambda x: (x / n).cast("float"))


def confidence_softmax(scores: Column) -> Column:
    """Share of the first of up to five re-ranking scores in their softmax; 0 without any."""
    x = F.slice(scores, 1, 5)
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.when(F.size(x) > 0, F.exp(F.get(x, F.lit(0)) - top) / (total + F.lit(1e-8))).otherwise(0.0)


def confidence_minmax(scores: Column) -> Column:
    """Mean of up to three scores scaled to their range; the first if they are all one; 0 without any."""
    x = F.slice(scores, 1, 3)
    low, high = F.array_min(x), F.array_max(x)
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - low)), (high - low) * F.size(x))
    return F.when(F.size(x) == 0, 0.0).when(high - low < 1e-6, F.get(x, F.lit(0))).otherwise(mean)


def fake_vector(text: str, dim: int = 384) -> list[float]:
    seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).normal(size=dim)
    length = np.sqrt(v @ v) + 1e-8
    return np.float32(v / length).tolist()


def fake_embedder(dim: int = 384):
    """A function of a column that embeds by hash: the same text always gets the same unit vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fake_vector("" if x is None else x, dim))

    return run


def passage_input(c: Column) -> Column:
    return F.concat(F.lit("passage: "), c)


def query_input(c: Column) -> Column:
    return F.concat(F.lit("query: "), c)
