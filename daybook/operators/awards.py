"""Money trails: awards of a client, each once, routine and discretionary apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def award_key(award: Column, group: Column, recipient: Column, amount: Column) -> Column:
    """What tells awards apart: the id, or group, recipient and amount where it is null or blank."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(F.nullif(F.trim(award.cast("string")), F.lit("")), F.concat_ws(":", none(group), none(recipient), none(amount)))


def trail(awards: DataFrame, client: str, award: Column, amount: str, recipient: str, routine: Column, order: list) -> DataFrame:
    """One row a client. Rows with an equal award key count once, the first in ``order``."""
    first = Window.partitionBy(client, "__award").orderBy(*order)
    once = awards.withColumn("__award", award).withColumn("__routine", routine).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return once.groupBy(client).agg(
        F.count(F.lit(1)).alias("n_awards"), F.round(F.sum(amount), 2).alias("total"), F.round(F.coalesce(F.sum(F.when(F.col("__routine"), F.col(amount))), F.lit(0.0)), 2).alias("routine_amount"),
        F.round(F.coalesce(F.sum(F.when(~F.col("__routine"), F.col(amount))), F.lit(0.0)), 2).alias("discretionary_amount"), F.count_distinct(recipient).alias("recipients"),
    )


def report(trails: DataFrame) -> DataFrame:
    """Totals over all clients and the share that is discretionary."""
    out = trails.agg(F.count(F.lit(1)).alias("clients"), F.round(F.sum("total"), 2).alias("grand_total"), F.round(F.sum("routine_amount"), 2).alias("routine_total"), F.sum("discretionary_amount").alias("__d"))
    return out.withColumn("pct_discretionary", F.round(F.try_divide(F.lit(100.0) * F.col("__d"), F.col("grand_total")), 4)).drop("__d")
