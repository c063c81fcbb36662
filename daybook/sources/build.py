"""Builds of the typed tables: whole or sample, tables or views alone, and single quarters anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources import filings

PRESS_YEARS = [2022, 2023, 2024, 2025]
TABLES = ["press_releases", "senate_filings", "senate_activities", "senate_lobbyists", "senate_gov_entities", "senate_foreign_entities", "senate_contributions", "house_filings", "house_activities", "house_lobbyists"]
VIEWS = {
    "revolving_door": """SELECT sl.filing_uuid, sf.filing_year, sf.filing_period, sf.registrant_name, sf.client_name, sl.lobbyist_name, sl.covered_position, sf.income, sf.expenses
        FROM senate_lobbyists sl JOIN senate_filings sf USING (filing_uuid) WHERE sl.covered_position <> ''""",
    "senate_spend_by_issue": """SELECT sa.general_issue_code, sf.filing_year, sf.filing_period, count(DISTINCT sf.filing_uuid) AS filings, count(DISTINCT sf.client_name) AS unique_clients, sum(sf.income) AS total_income, sum(sf.expenses) AS total_expenses
        FROM senate_activities sa JOIN senate_filings sf USING (filing_uuid) WHERE sa.general_issue_code IS NOT NULL GROUP BY ALL""",
}


def files(spark: SparkSession, path: str, ending: str) -> list[str]:
    """Files of one directory by name; none where there is no such directory. They are listed by the file system that Spark reads them from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found = [str(f.getPath().toString()) for f in system.listStatus(where) if f.isFile()]
    return sorted(f for f in found if f.endswith(ending))


def press_files(spark: SparkSession, root: str, sample: bool = False) -> list[str]:
    """The newest year's files lie at the root, older ones in a directory a year; a sample is the first of the root and of the last year."""
    folders = [root, *(f"{root}/{y}" for y in (PRESS_YEARS[-1:] if sample else PRESS_YEARS))]
    every = [files(spark, f, ".jsonl") for f in folders]
    return [f for group in every for f in (group[:1] if sample else group)]


def tables(spark: SparkSession, root: str, sample: bool = False) -> dict[str, DataFrame]:
    """The typed tables of the raw corpora under ``root``: ``press``, ``senate/filings/<year>``, ``senate/contributions/<year>`` and ``house/<quarter>``. A corpus that isn't there has no tables."""
    out: dict[str, DataFrame] = {}
    if press := press_files(spark, f"{root}/press", sample):
        out["press_releases"] = filings.press_releases(spark, press)
    first = lambda found: found[:1] if sample else found
    folders = lambda path: _folders(spark, path)
    senate = first([f for d in folders(f"{root}/senate/filings") for f in files(spark, d, ".json")])
    if senate:
        out |= filings.senate_tables(filings.senate_bronze(spark, senate))
    given = first([f for d in folders(f"{root}/senate/contributions") for f in files(spark, d, ".json")])
    if given:
        out["senate_contributions"] = filings.contributions(spark, given)
    house = first(folders(f"{root}/house"))
    if house:
        out |= filings.house_tables(filings.house_bronze(spark, house))
    return out


def _folders(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(f.getPath().toString()) for f in system.listStatus(where) if f.isDirectory()) if system.exists(where) else []


def register(spark: SparkSession, out: str) -> list[str]:
    """Views of the written tables and of what is derived from them; names of those that are there."""
    there = [t for t in TABLES if _folder_exists(spark, f"{out}/{t}")]
    filings.register_tables(spark, out, there)
    made = [name for name, needs in (("revolving_door", ("senate_lobbyists", "senate_filings")), ("senate_spend_by_issue", ("senate_activities", "senate_filings"))) if set(needs) <= set(there)]
    for name in made:
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)
    return there + made


def _folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def build(spark: SparkSession, root: str, out: str, sample: bool = False, write: bool = True, views: bool = True, clean: bool = False) -> list[str]:
    """Write the tables under ``out`` and register them. ``write`` and ``views`` leave one half out, ``clean`` deletes what was written before."""
    if clean and _folder_exists(spark, out):
        where = spark._jvm.org.apache.hadoop.fs.Path(out)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if write:
        filings.write_tables(tables(spark, root, sample), out)
    return register(spark, out) if views else []


def rebuild_house(spark: SparkSession, root: str, out: str, quarters: list[str]) -> DataFrame:
    """House tables of some quarters' directories anew, in partitions of their own, which replaces these alone. Returns the files and broken files of each quarter."""
    bronze = filings.house_bronze(spark, [f"{root}/house/{q}" for q in quarters])
    keys = bronze.select("house_id", "filing_year", "filing_period").distinct()
    made = filings.house_tables(bronze)
    dated = {name: df if name == "house_filings" else df.join(keys, "house_id") for name, df in made.items()}
    filings.write_tables(dated, out, {name: ["filing_year", "filing_period"] for name in dated})
    return errors(bronze)


def errors(bronze: DataFrame) -> DataFrame:
    """Files and files that don't parse, by year and quarter."""
    return bronze.groupBy("filing_year", "filing_period").agg(F.count(F.lit(1)).alias("files"), F.count_if("broken").alias("broken"))


def lacking(spark: SparkSession, names: list[str]) -> list[str]:
    """Required tables and views that the session doesn't have."""
    have = {t.name for t in spark.catalog.listTables()}
    return sorted(set(names) - have)
