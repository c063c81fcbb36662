"""Exact quantiles of groups of any size: no task ever holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative accuracy of the sketch that names the band of values in which the rank lies: one in so many ranks.
ACCURACY = 10_000


def quantile(df: DataFrame, value: str, by: list[str], q: float = 0.5, accuracy: int = ACCURACY) -> DataFrame:
    """``*by, n, quantile``: the number of values that aren't null and their quantile, interpolated between its two neighbours in rank; null for a group without a value. Without ``by`` one row.

    A sketch of each group, made before anything is shuffled, gives two values between which the rank must lie. Values below are only counted; those between are counted by value, which also combines before the
    shuffle, and the running sum of these counts names the two values. Ties count as often as they occur; NaN is the largest value, as in Spark's order. The band holds some ``4 / accuracy`` of a group's ranks."""
    keys = by or ["__all"]
    rows = (df if by else df.withColumn("__all", F.lit(0))).select(*keys, F.col(value).cast("double").alias("__v"))
    held = rows.where("__v IS NOT NULL")
    margin = 2.0 / accuracy
    sketch = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", max(0.0, q - margin), accuracy).alias("__low"), F.percentile_approx("__v", min(1.0, q + margin), accuracy).alias("__high"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
    )
    place = (F.col("n") - 1) * q
    # small groups are their own band, and a rank next to an end is counted from there
    sketch = sketch.withColumns({"__first": F.floor(place), "__last": F.ceil(place)})
    whole = F.col("n") <= accuracy
    sketch = sketch.withColumns({"__low": F.when(whole, F.col("__min")).otherwise(F.col("__low")), "__high": F.when(whole, F.col("__max")).otherwise(F.col("__high"))})
    told = _renamed(sketch, keys)
    joined = held.join(told if by else F.broadcast(told), _same(keys)).select(*keys, "__v", "n", "__low", "__high", "__first", "__last")  # without ``by`` the sketch is one row
    inside = F.when(F.col("__v") < F.col("__low"), F.lit(None)).when(F.col("__v") > F.col("__high"), F.lit(None)).otherwise(F.col("__v"))
    kind = F.when(F.col("__v") < F.col("__low"), -1).when(F.col("__v") > F.col("__high"), 1).otherwise(0)
    counted = joined.groupBy(*keys, kind.alias("__kind"), inside.alias("__in")).agg(F.count(F.lit(1)).alias("__n"), F.first("n").alias("n"), F.first("__first").alias("__first"), F.first("__last").alias("__last"))
    ranked = Window.partitionBy(*keys).orderBy("__kind", "__in").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__before", F.coalesce(F.sum("__n").over(ranked), F.lit(0)))
    at = lambda r: F.max(F.when((F.col("__before") <= F.col(r)) & (F.col(r) < F.col("__before") + F.col("__n")), F.struct(F.col("__kind").alias("kind"), F.col("__in").alias("v"))))
    found = ranked.groupBy(*keys).agg(F.first("n").alias("n"), at("__first").alias("a"), at("__last").alias("b"))
    missed = F.raise_error(F.lit("the sketch's band misses the rank; raise the accuracy"))
    share = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    value_at = F.when((F.col("a.kind") != 0) | (F.col("b.kind") != 0), missed.cast("double")).when(F.col("a.v") == F.col("b.v"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share)
    out = found.select(*keys, "n", value_at.alias("quantile"))
    every = rows.select(*keys).distinct() if by else df.sparkSession.range(1).select(F.lit(0).alias("__all"))
    both = every.join(_renamed(out, keys), _same(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "quantile")
    return both if by else both.drop("__all")


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__of_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    """Equal keys; null is a group too."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return out
