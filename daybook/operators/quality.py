"""Checks of loaded tables: rows, nulls, keys and casts, as one table of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SAMPLE_DIVISOR = 16


def _result(df: DataFrame, check: str, target: str, value: Column, severity: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(target).alias("target"), value.cast("double").alias("value"), severity.alias("severity"))


def _rows(one: DataFrame, table: str, low: int, high: int, sample: bool) -> DataFrame:
    floor = low // SAMPLE_DIVISOR if sample else low
    n = F.col("n")
    return _result(one, "rows", table, n, F.when(n < floor, "fail").when((n > high) & F.lit(not sample), "warn").otherwise("pass"))


def row_count(df: DataFrame, table: str, low: int, high: int, sample: bool = False) -> DataFrame:
    """Too few rows fail (a sample needs a sixteenth); too many warn, except in a sample."""
    return _rows(df.agg(F.count(F.lit(1)).alias("n")), table, low, high, sample)


def _nulls(one: DataFrame, table: str, limits: dict[str, float]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v"), F.lit(float(m)).alias("m")) for c, m in limits.items())))
    flat = one.select(rows.alias("x")).select("x.*")
    return flat.select(F.lit("nulls").alias("check"), F.concat(F.lit(f"{table}."), "c").alias("target"), F.col("v").alias("value"), F.when(F.col("v").isNull() | (F.col("v") > F.col("m")), "fail").otherwise("pass").alias("severity"))


def null_fractions(df: DataFrame, table: str, limits: dict[str, float]) -> DataFrame:
    """Share of nulls of every column in one pass; an empty table fails."""
    return _nulls(df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in limits)), table, limits)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Rows whose key the parent lacks; null keys count."""
    lost = child.join(parent.select(F.col(parent_key).alias("__k")), child[child_key] == F.col("__k"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return _result(lost, "orphans", name, F.col("n"), F.when(F.col("n") > 0, "fail").otherwise("pass"))


def _uncast(column: str, kind: str) -> Column:
    return F.col(column).isNotNull() & F.col(column).cast("string").try_cast(kind).isNull()


def _none(one: DataFrame, check: str, name: str) -> DataFrame:
    return _result(one, check, name, F.col("n"), F.when(F.col("n") > 0, "fail").otherwise("pass"))


def castable(df: DataFrame, column: str, kind: str, name: str) -> DataFrame:
    """Values that don't cast; nulls do."""
    return _none(df.agg(F.count_if(_uncast(column, kind)).alias("n")), "cast", name)


def _sentinel(one: DataFrame, name: str, low: int, high: int | None) -> DataFrame:
    n = F.col("n")
    bad = (n < low) if high is None else (n < low) | (n > high)
    return _result(one, "sentinel", name, n, F.when(bad, "fail").otherwise("pass"))


def sentinel(df: DataFrame, condition: Column, name: str, low: int, high: int | None = None) -> DataFrame:
    return _sentinel(df.agg(F.count_if(condition).alias("n")), name, low, high)


def write_checked(
    df: DataFrame, path: str, table: str, low: int, high: int, nulls: dict[str, float] | None = None, casts: dict[str, tuple[str, str]] | None = None, sentinels: dict[str, tuple[Column, int, int | None]] | None = None,
    sample: bool = False, partition_by: list[str] | None = None,
) -> DataFrame:
    """Write a table and check it in the same job: the rows of ``row_count``, ``null_fractions``, ``castable`` (``name: (column, type)``) and ``sentinel`` (``name: (condition, low, high)``) from metrics that the write observes.

    Nothing is read a second time; Spark counts a task that ran twice once. Checks that need another table (``orphans``) are apart."""
    nulls, casts, sentinels = nulls or {}, casts or {}, sentinels or {}
    counts = {"rows": F.count(F.lit(1))}
    counts |= {f"null {c}": F.count_if(F.col(c).isNull()) for c in nulls}
    counts |= {f"cast {name}": F.count_if(_uncast(c, kind)) for name, (c, kind) in casts.items()}
    counts |= {f"sentinel {name}": F.count_if(condition) for name, (condition, _, _) in sentinels.items()}
    seen = Observation()
    writer = df.observe(seen, *(c.alias(f"m{i}") for i, c in enumerate(counts.values()))).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    told = dict(zip(counts, (seen.get[f"m{i}"] or 0 for i in range(len(counts))), strict=True))
    one = lambda n: df.sparkSession.range(1).select(F.lit(int(n)).cast("long").alias("n"))
    out = _rows(one(told["rows"]), table, low, high, sample)
    if nulls:
        shares = [(F.lit(told[f"null {c}"] / told["rows"]) if told["rows"] else F.lit(None)).cast("double").alias(c) for c in nulls]
        out = out.unionByName(_nulls(df.sparkSession.range(1).select(*shares), table, nulls))
    for name in casts:
        out = out.unionByName(_none(one(told[f"cast {name}"]), "cast", name))
    for name, (_, least, most) in sentinels.items():
        out = out.unionByName(_sentinel(one(told[f"sentinel {name}"]), name, least, most))
    return out


def missing(expected: DataFrame, present: DataFrame, column: str) -> DataFrame:
    return expected.join(present.select(column).distinct(), column, "left_anti")


def verdict(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by severity and an exit code: 1 after a failure, or after a warning where that is strict."""
    out = checks.agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")))
    return out.withColumn("exit_code", F.when((F.col("n_fail") > 0) | (F.lit(strict) & (F.col("n_warn") > 0)), 1).otherwise(0))
