"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A key counts as hot when it holds at least one row in so many; hence there are at most so many hot keys.
HOT_SHARE = 1000


def lookup(big: DataFrame, small: DataFrame, key: str, count: str, total: int, columns: list[str], spread: list[str] | None = None) -> DataFrame:
    """``big`` left-joined with ``columns`` of ``small``, which has one row a key and in ``count`` the rows of ``big`` with that key.

    Hot keys are joined by broadcast: as ``count`` sums to at most ``total``, there are at most ``HOT_SHARE`` of them. The rest meets in an equi join in which every key is rare; rows that are already matched,
    and rows whose key is null, are dealt by a hash of their columns ``spread`` (all columns unless given), which a repeated task finds again.
    """
    floor = max(1.0, total / HOT_SHARE)
    hot = F.broadcast(small.where(F.col(count) >= floor).select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in columns)))
    cold = small.where(F.col(count) < floor).select(F.col(key).alias("__cold"), *(F.col(c).alias(f"__cold_{c}") for c in columns))
    first = big.join(hot, F.col(key) == F.col("__hot"), "left")
    done = F.col("__hot").isNotNull() | F.col(key).isNull()
    # beside the key a flag, so that what is dealt by its own hash meets no key
    alike = isinstance(big.schema[key].dataType, LongType) and isinstance(small.schema[key].dataType, LongType)
    deal = F.xxhash64(*(spread or big.columns))
    first = first.withColumn("__own", F.when(done, deal).otherwise(F.col(key)) if alike else F.when(done, F.hex(deal)).otherwise(F.col(key).cast("string"))).withColumn("__done", done)
    cold = cold.withColumn("__cold", F.col("__cold") if alike else F.col("__cold").cast("string")).withColumn("__open", F.lit(False))
    both = first.join(cold, (F.col("__own") == F.col("__cold")) & (F.col("__done") == F.col("__open")), "left")
    kept = [F.col(c) for c in big.columns if c not in columns]
    return both.select(*kept, *(F.coalesce(F.col(f"__hot_{c}"), F.col(f"__cold_{c}")).alias(c) for c in columns))
