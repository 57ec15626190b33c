"""Vector functions over array columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(as_double(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector is divided by 1e-12 and stays zero."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(as_double(v), lambda x: x / n)


def problem(v: Column, dimension: int) -> Column:
    """Why a vector is unusable: null, dimension, not_finite or zero; null where it is usable."""
    bad = F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNull(), "null").when(F.size(v) != dimension, "dimension").when(bad, "not_finite").when(F.forall(as_double(v), lambda x: x == 0), "zero")


def payload(context: Column, text: Column, prefix: str = "") -> Column:
    """prefix + context + line break + text; the context line is left out where it is null or empty."""
    head = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(prefix), head, F.coalesce(text, F.lit("")))


def cache_key(payload_: Column, model: str, config: str) -> Column:
    """Digest of the whole payload, context included, with model and configuration."""
    return F.substring(F.sha2(F.concat_ws(":", F.sha2(payload_, 256), F.lit(model), F.lit(config)), 256), 1, 32)


def quality(v: Column, dimension: int, cached: Column) -> Column:
    """Struct of dimension_ok, normalized (norm within 1e-3 of one), finite and cache_used; false where the vector is null."""
    finite = F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        no(F.size(v) == dimension).alias("dimension_ok"), no(finite & (F.abs(norm(v) - 1) <= 1e-3)).alias("normalized"), no(finite).alias("finite"), no(cached).alias("cache_used"),
    )


def cache_status(found: Column, schema: Column, model: Column, config: Column, vector: Column, want: tuple[str, str, str]) -> Column:
    """cached, stale where the entry is of another schema, model or configuration, failed where there is no entry or no vector."""
    same = schema.eqNullSafe(F.lit(want[0])) & model.eqNullSafe(F.lit(want[1])) & config.eqNullSafe(F.lit(want[2]))
    return F.when(~F.coalesce(found, F.lit(False)), "failed").when(~same, "stale").when(vector.isNull(), "failed").otherwise("cached")
