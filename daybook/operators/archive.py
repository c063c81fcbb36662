"""URLs to archive: collection from nested documents, what is still recent, and the merge of new results into a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICES = ["wayback", "archive_today"]


def collect(*columns: tuple[DataFrame, Column]) -> DataFrame:
    """Distinct http(s) URLs of all given columns; array columns are exploded."""
    out = None
    for df, column in columns:
        one = df.select(column.alias("url"))
        if one.schema["url"].dataType.typeName() == "array":
            one = one.select(F.explode("url").alias("url"))
        out = one if out is None else out.unionAll(one)
    return out.where(F.startswith("url", F.lit("http://")) | F.startswith("url", F.lit("https://"))).distinct()


def due(urls: DataFrame, registry: DataFrame, now: Column, days: int) -> DataFrame:
    """URLs that some service lacks, or whose entry is older than ``days``."""
    held = registry.select(F.col("url").alias("__url"), *SERVICES, "at")
    both = F.lit(True)
    for s in SERVICES:
        both = both & F.coalesce(F.col(s) != "", F.lit(False))
    fresh = both & F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400) <= days, F.lit(False))
    return urls.join(held, F.col("url") == F.col("__url"), "left").where(~fresh).select("url")


def merge(registry: DataFrame, results: DataFrame) -> DataFrame:
    """New values over old ones, service by service; a service that failed keeps what it had."""
    new = results.select(F.col("url"), *(F.col(s).alias(f"new_{s}") for s in SERVICES), F.col("at").alias("new_at"))
    joined = registry.join(new, "url", "full_outer")
    return joined.select("url", *(F.coalesce(F.nullif(f"new_{s}", F.lit("")), s).alias(s) for s in SERVICES), F.coalesce("new_at", "at").alias("at"))


def exit_code(results: DataFrame) -> DataFrame:
    """Bit 1 where the first service failed for some URL, bit 2 for the second."""
    bits = [F.coalesce(F.max(F.when(F.coalesce(F.col(s), F.lit("")) == "", 1 << i).otherwise(0)), F.lit(0)) for i, s in enumerate(SERVICES)]
    return results.agg((bits[0] + bits[1]).cast("int").alias("exit_code"))


def canonical(html: Column) -> Column:
    """Where a meta refresh of a page leads."""
    return F.nullif(F.regexp_extract(html, r"(?i)http-equiv=[\"']?refresh[^>]*url=([^\"'>\s]+)", 1), F.lit(""))
