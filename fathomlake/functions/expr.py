"""Vector and scalar expressions; all of them stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def md5_key(ids: Sequence[str | Column], seed: str) -> Column:
    """The reproducible shuffle key of a row: 32 hex digits."""
    return F.md5(F.concat_ws("-", *[as_col(c).cast("string") for c in ids], F.lit(seed)))


def uniform(key: Column, at: int = 1) -> Column:
    """A number in [0, 1) from eight hex digits of an md5 key."""
    return F.conv(F.substring(key, at, 8), 16, 10).cast("double") / 4294967296.0


def dot(u: str | Column, v: str | Column) -> Column:
    products = F.zip_with(as_col(u), as_col(v), lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_distance(u: str | Column, v: str | Column) -> Column:
    gaps = F.zip_with(as_col(u), as_col(v), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def distance(u: str | Column, v: str | Column) -> Column:
    return F.sqrt(squared_distance(u, v))


def matvec(rows: Sequence[Sequence[float]], v: str | Column) -> Column:
    """A small literal matrix times a vector column."""
    return F.array(*[dot(v, lit_vector(r)) for r in rows])


def argmax(v: str | Column) -> Column:
    """Place of the largest entry from 0; the first of equals."""
    return (F.array_position(as_col(v), F.array_max(as_col(v))) - 1).cast("int")


def argmin(v: str | Column) -> Column:
    return (F.array_position(as_col(v), F.array_min(as_col(v))) - 1).cast("int")


def sigmoid(z: str | Column, limit: float = 500.0) -> Column:
    z = F.greatest(F.least(as_col(z), F.lit(limit)), F.lit(-limit))
    return 1.0 / (1.0 + F.exp(-z))


def softmax(v: str | Column) -> Column:
    """Stable softmax: the largest entry is taken off first."""
    v = as_col(v)
    shifted = F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def relu(z: str | Column) -> Column:
    return F.greatest(F.lit(0.0), as_col(z))


def one_hot(c: str | Column, classes: Sequence) -> Column:
    return F.array(*[F.coalesce((as_col(c) == F.lit(k)).cast("int"), F.lit(0)) for k in classes])


def activation(z: str | Column, name: str) -> Column:
    z = as_col(z)
    return {"relu": relu(z), "sigmoid": sigmoid(z), "tanh": F.tanh(z)}[name]


def activation_slope(z: str | Column, name: str) -> Column:
    """Derivative of ``activation`` at z; that of ReLU is 0 at 0."""
    z = as_col(z)
    if name == "relu":
        return F.when(z > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if name == "sigmoid":
        return sigmoid(z) * (1.0 - sigmoid(z))
    return 1.0 - F.tanh(z) * F.tanh(z)


def haversine(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    """Great-circle distance in kilometres of degrees."""
    la1, lo1, la2, lo2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return F.lit(radius) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(as_col(c)), as_col(c))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def log_clip(p: Column, floor: float) -> Column:
    """ln of a probability kept away from 0 and 1."""
    return F.log(F.greatest(F.least(p, F.lit(1.0 - floor)), F.lit(floor)))


LOG_2PI = math.log(2 * math.pi)
