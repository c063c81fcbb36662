"""Readers of the raw corpora: press releases, Senate and House filings, contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook import schemas
from daybook.functions.text import clean, money, number, quarter

# Quarters in the names of the House directories.
QUARTERS = {"1st": "Q1", "2nd": "Q2", "3rd": "Q3", "4th": "Q4"}


def press_releases(spark: SparkSession, path) -> DataFrame:
    """JSON lines, one release a line; blank and broken lines are left out."""
    raw = spark.read.schema(schemas.PRESS_JSON).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    return raw.where("coalesce(member.bioguide_id, member.name, date, title, url, text) IS NOT NULL").select(
        *(clean(F.col(f"member.{c}")).alias(n) for c, n in (("bioguide_id", "bioguide_id"), ("name", "member_name"), ("party", "party"), ("state", "state"), ("chamber", "chamber"))),
        clean(F.col("date")).alias("date"), quarter(F.col("date")).alias("filing_quarter"), *(clean(F.col(c)).alias(c) for c in ("title", "url", "domain", "text")), F.col("_metadata.file_path").alias("source_path"),
    )


def senate_bronze(spark: SparkSession, path) -> DataFrame:
    """Files that hold one JSON array of filings, nested as they are. Write this once; the five tables are projections of it."""
    return spark.read.schema(schemas.SENATE_JSON).option("multiLine", "true").json(path).withColumn("source_path", F.col("_metadata.file_path"))


def _full_name(*parts) -> F.Column:
    return F.nullif(F.concat_ws(" ", *(clean(p) for p in parts)), F.lit(""))


def senate_tables(bronze: DataFrame) -> dict[str, DataFrame]:
    """Filings, activities, lobbyists, government and foreign entities."""
    filings = bronze.select(
        *(clean(F.col(c)).alias(c) for c in ("filing_uuid", "filing_type", "filing_type_display")), "filing_year", *(clean(F.col(c)).alias(c) for c in ("filing_period", "filing_period_display")), number(F.col("income")).alias("income"), number(F.col("expenses")).alias("expenses"), clean(F.col("dt_posted")).alias("dt_posted"),
        *(clean(F.col(f"registrant.{c}")).alias(f"registrant_{c}") for c in ("id", "name", "description")), *(clean(F.coalesce(f"registrant_{c}", f"registrant.{c}")).alias(f"registrant_{c}") for c in ("country", "state")),
        clean(F.col("client.id")).alias("client_id"), clean(F.col("client.name")).alias("client_name"), clean(F.coalesce("client.general_description", "client.description")).alias("client_description"), "source_path",
    )
    each = bronze.select("filing_uuid", "source_path", F.posexplode("lobbying_activities").alias("i", "a")).where("a IS NOT NULL").withColumn("activity_idx", F.col("i").cast("long"))
    activities = each.select("filing_uuid", "activity_idx", clean(F.col("a.general_issue_code")).alias("general_issue_code"), clean(F.col("a.description")).alias("description"), "source_path")
    people = each.select("filing_uuid", "activity_idx", "source_path", F.explode("a.lobbyists").alias("p")).where("p IS NOT NULL")
    is_new = F.when(F.col("p.new"), "True").when(~F.col("p.new"), "False")
    lobbyists = people.select("filing_uuid", "activity_idx", _full_name(F.col("p.lobbyist.first_name"), F.col("p.lobbyist.last_name")).alias("lobbyist_name"), clean(F.col("p.covered_position")).alias("covered_position"), is_new.alias("is_new"), "source_path")
    entities = each.select("filing_uuid", "activity_idx", F.explode("a.government_entities").alias("e"), "source_path").where("e IS NOT NULL").select("filing_uuid", "activity_idx", clean(F.col("e.name")).alias("entity_name"), "source_path")
    foreign = bronze.select("filing_uuid", F.explode("foreign_entities").alias("e"), "source_path").where("e IS NOT NULL").select("filing_uuid", clean(F.col("e.name")).alias("entity_name"), clean(F.col("e.country")).alias("country"), clean(F.col("e.ppb_country")).alias("ppb_country"), "source_path")
    return {"senate_filings": filings, "senate_activities": activities, "senate_lobbyists": lobbyists, "senate_gov_entities": entities, "senate_foreign_entities": foreign}


def contributions(spark: SparkSession, path) -> DataFrame:
    """One row a contribution; the year is that of the path."""
    raw = spark.read.schema(schemas.CONTRIBUTIONS_JSON).option("multiLine", "true").json(path).withColumn("source_path", F.col("_metadata.file_path"))
    rows = raw.select("filing_uuid", "filer_type", clean(F.col("registrant.name")).alias("registrant_name"), F.regexp_extract("source_path", r"(20\d{2})", 1).try_cast("long").alias("filing_year"), F.explode("contribution_items").alias("c"), "source_path")
    either = lambda a, b: clean(F.coalesce(F.col(f"c.{a}"), F.col(f"c.{b}")))
    return rows.select("filing_uuid", "filer_type", "registrant_name", "filing_year", either("contribution_type", "type").alias("item_type"), number(F.col("c.amount")).alias("amount"), either("payee_name", "payee").alias("payee"), either("honoree_name", "honoree").alias("honoree"), clean(F.col("c.contributor_name")).alias("contributor_name"), "source_path")


def house_bronze(spark: SparkSession, path) -> DataFrame:
    """One XML file a filing. Year and quarter come from the directory's name, the id from the file's. Files that don't parse have a null ``x``."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).withColumn("source_path", F.col("_metadata.file_path"))
    where = F.regexp_extract("source_path", r"(\d{4})_(1st|2nd|3rd|4th)Quarter", 1), F.regexp_extract("source_path", r"(\d{4})_(1st|2nd|3rd|4th)Quarter", 2)
    period = F.lit(None).cast("string")
    for name, short in QUARTERS.items():
        period = F.when(where[1] == name, short).otherwise(period)
    parsed = F.from_xml("value", F.lit(schemas.HOUSE_XML), {"mode": "PERMISSIVE"})
    out = raw.select(F.regexp_extract("source_path", r"([^/]+)\.xml$", 1).alias("house_id"), where[0].try_cast("long").alias("filing_year"), period.alias("filing_period"), parsed.alias("x"), "source_path")
    return out.withColumn("broken", F.col("x").isNull() | F.coalesce(F.col("x.organizationName"), F.col("x.clientName"), F.col("x.senateID"), F.col("x.reportYear")).isNull())


def house_tables(bronze: DataFrame) -> dict[str, DataFrame]:
    """Filings, activities and lobbyists; broken files are left out. The modern form has a block for each activity, the older one parallel lists and lobbyists without an activity."""
    good = bronze.where("NOT broken")
    x = lambda c: clean(F.col(f"x.{c}"))
    filings = good.select(
        "house_id", x("senateID").alias("senate_id"), "filing_year", "filing_period", x("organizationName").alias("org_name"), x("clientName").alias("client_name"), x("clientGovtEntity").alias("client_is_govt_entity"), money(F.col("x.income")).alias("income"), money(F.col("x.expenses")).alias("expenses"),
        x("noLobbying").alias("no_lobbying"), x("terminationDate").alias("termination_date"), x("signedDate").alias("signed_date"), x("reportYear").alias("report_year"), x("reportType").alias("report_type"), "source_path",
    )
    modern = F.size(F.col("x.alis.ali_info")) > 0
    blocks = good.where(modern).select("house_id", "source_path", F.posexplode("x.alis.ali_info").alias("i", "b"))
    code, text = clean(F.col("b.issueAreaCode")), clean(F.col("b.specific_issues.description"))
    new = blocks.where(F.coalesce(code, text).isNotNull()).select("house_id", F.col("i").cast("long").alias("activity_idx"), code.alias("ali_code"), text.alias("description"), F.col("b.lobbyists.lobbyist").alias("people"), "source_path")
    full = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    legacy = good.where(~F.coalesce(modern, F.lit(False)))
    old = legacy.select("house_id", "source_path", F.posexplode(F.arrays_zip(full("x.alis.ali_Code").alias("code"), full("x.specific_issues.description").alias("text"))).alias("i", "b"))
    activities = new.drop("people").unionByName(old.select("house_id", F.col("i").cast("long").alias("activity_idx"), F.col("b.code").alias("ali_code"), F.col("b.text").alias("description"), "source_path"))
    people = new.select("house_id", "activity_idx", F.explode("people").alias("p"), "source_path").unionByName(legacy.select("house_id", F.lit(None).cast("long").alias("activity_idx"), F.explode("x.lobbyists.lobbyist").alias("p"), "source_path"))
    name = F.coalesce(_full_name(F.col("p.lobbyistFirstName"), F.col("p.lobbyistLastName"), F.col("p.lobbyistSuffix")), clean(F.col("p.lobbyistName")))
    lobbyists = people.select("house_id", "activity_idx", name.alias("lobbyist_name"), clean(F.col("p.coveredPosition")).alias("covered_position"), clean(F.col("p.lobbyistNew")).alias("is_new"), "source_path").where("lobbyist_name IS NOT NULL OR covered_position IS NOT NULL")
    return {"house_filings": filings, "house_activities": activities, "house_lobbyists": lobbyists}


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """zstd Parquet, one directory a table, with its schema even where it is empty. Partitioned tables replace only the partitions that they bring."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name]).option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{path}/{name}")


def register_tables(spark: SparkSession, path: str, names: list[str]) -> None:
    """Temporary views of written tables; files of different age are merged by column name."""
    for name in names:
        spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}").createOrReplaceTempView(name)
