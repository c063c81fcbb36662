"""Relational queries over filings, lobbyist rows, activities and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators import ranks
from daybook.operators.durable import save
from daybook.plans import register
from daybook.plans.bind import FILINGS, LINES, Bound, sql


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _money(column, name: str):
    return F.round(F.sum(column), 2).alias(name)


@register("o1", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "events", "lineitem", "orders", "part", "supplier")))
def table_counts(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    out = None
    for name in ("customer", "events", "lineitem", "orders", "part", "supplier"):
        one = b.table(name).agg(_count()).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@register("o2", sql("SELECT registrant_name, count(DISTINCT filing_uuid) AS filings, count(DISTINCT client_id) AS clients, round(sum(income) / 1e6, 4) AS income_m FROM filings WHERE filing_year = 1997 AND income IS NOT NULL GROUP BY 1 ORDER BY income_m DESC, 1 LIMIT 20", FILINGS))
def top_firms(spark, sf_dir) -> DataFrame:
    f = Bound(spark, sf_dir).filings.where((F.col("filing_year") == 1997) & F.col("income").isNotNull())
    return f.groupBy("registrant_name").agg(F.count_distinct("filing_uuid").alias("filings"), F.count_distinct("client_id").alias("clients"), F.round(F.sum("income") / 1e6, 4).alias("income_m")).orderBy(F.desc("income_m"), "registrant_name").limit(20)


@register("o3", sql("SELECT lobbyist_name, string_agg(DISTINCT registrant_name, ', ' ORDER BY registrant_name) AS firms, count(DISTINCT filing_uuid) AS filings FROM lines JOIN filings USING (filing_uuid) WHERE filing_uuid IN (SELECT filing_uuid FROM lines WHERE entity_name = 'Brand#13') GROUP BY 1 ORDER BY filings DESC, 1 LIMIT 20", FILINGS, LINES))
def top_lobbyists_of_agency(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    agency = b.lines.where("entity_name = 'Brand#13'").select("filing_uuid")
    rows = b.lines.select("filing_uuid", "lobbyist_name").join(agency, "filing_uuid", "left_semi").join(b.filings.select("filing_uuid", "registrant_name"), "filing_uuid")
    return rows.groupBy("lobbyist_name").agg(F.array_join(F.array_sort(F.collect_set("registrant_name")), ", ").alias("firms"), F.count_distinct("filing_uuid").alias("filings")).orderBy(F.desc("filings"), "lobbyist_name").limit(20)


@register("o4", sql("SELECT filing_uuid, filing_year, filing_period, client_name, income FROM filings WHERE registrant_name ILIKE '%nation_3%' ORDER BY filing_year DESC, filing_period, filing_uuid LIMIT 50", FILINGS))
def firm_filings(spark, sf_dir) -> DataFrame:
    f = Bound(spark, sf_dir).filings.where(F.col("registrant_name").ilike("%nation_3%"))
    return f.select("filing_uuid", "filing_year", "filing_period", "client_name", "income").orderBy(F.desc("filing_year"), F.asc_nulls_last("filing_period"), "filing_uuid").limit(50)


@register("o5", sql("SELECT lobbyist_name, covered_position, round(sum(income), 2) AS income_by_row, count(DISTINCT filing_uuid) AS filings FROM lines JOIN filings USING (filing_uuid) WHERE covered_position IS NOT NULL AND length(covered_position) > 3 AND (covered_position ILIKE '%green%' OR covered_position ILIKE '%red%') GROUP BY 1, 2 ORDER BY income_by_row DESC, 1, 2 LIMIT 50", FILINGS, LINES))
def senior_roles(spark, sf_dir) -> DataFrame:
    """Income is summed by row, as the original does; the fan-out-safe form is ``o15``."""
    b = Bound(spark, sf_dir)
    position = F.col("covered_position")
    rows = b.lines.where(position.isNotNull() & (F.length(position) > 3) & (position.ilike("%green%") | position.ilike("%red%")))
    return rows.join(b.filings, "filing_uuid").groupBy("lobbyist_name", "covered_position").agg(_money("income", "income_by_row"), F.count_distinct("filing_uuid").alias("filings")).orderBy(F.desc("income_by_row"), "lobbyist_name", "covered_position").limit(50)


SPEND = "SELECT general_issue_code, filing_year, filing_period, count(DISTINCT filing_uuid) AS filings, count(DISTINCT client_id) AS unique_clients, round(sum(income), 2) AS total_income FROM lines JOIN filings USING (filing_uuid) GROUP BY ALL"


def spend_view(b: Bound) -> DataFrame:
    rows = b.lines.select("filing_uuid", "general_issue_code").join(b.filings, "filing_uuid")
    return rows.groupBy("general_issue_code", "filing_year", "filing_period").agg(F.count_distinct("filing_uuid").alias("filings"), F.count_distinct("client_id").alias("unique_clients"), _money("income", "total_income"))


@register("o7", sql(f"SELECT * FROM ({SPEND}) ORDER BY total_income DESC NULLS LAST, general_issue_code, filing_year, filing_period LIMIT 50", FILINGS, LINES))
def spend_by_issue(spark, sf_dir) -> DataFrame:
    return spend_view(Bound(spark, sf_dir)).orderBy(F.desc_nulls_last("total_income"), "general_issue_code", "filing_year", "filing_period").limit(50)


@register("o7_view", sql(SPEND, FILINGS, LINES))
def spend_by_issue_view(spark, sf_dir) -> DataFrame:
    return spend_view(Bound(spark, sf_dir))


@register("o8", sql("SELECT lobbyist_name, covered_position, registrant_name, client_name, filing_year, filing_period, count(*) AS n FROM lines JOIN filings USING (filing_uuid) WHERE covered_position IS NOT NULL AND covered_position != '' GROUP BY ALL", FILINGS, LINES))
def revolving_door(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.lines.where("covered_position IS NOT NULL AND covered_position != ''").select("filing_uuid", "lobbyist_name", "covered_position").join(b.filings, "filing_uuid")
    return rows.groupBy("lobbyist_name", "covered_position", "registrant_name", "client_name", "filing_year", "filing_period").agg(_count())


@register("o9", sql("SELECT lobbyist_name, count(DISTINCT registrant_name) AS firms, count(DISTINCT filing_uuid) AS filings FROM lines JOIN filings USING (filing_uuid) WHERE (lower(covered_position) LIKE '%blue%' OR lower(covered_position) LIKE '%small%') AND lower(covered_position) NOT LIKE '%ring%' GROUP BY 1 HAVING count(DISTINCT filing_uuid) >= 3 ORDER BY filings DESC NULLS LAST, 1 LIMIT 100", FILINGS, LINES))
def former_members(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    low = F.lower("covered_position")
    rows = b.lines.where((low.like("%blue%") | low.like("%small%")) & ~low.like("%ring%")).join(b.filings, "filing_uuid")
    return rows.groupBy("lobbyist_name").agg(F.count_distinct("registrant_name").alias("firms"), F.count_distinct("filing_uuid").alias("filings")).where("filings >= 3").orderBy(F.desc_nulls_last("filings"), "lobbyist_name").limit(100)


@register("o10", sql("SELECT lobbyist_name, min(filing_year) AS first_year, count(DISTINCT filing_uuid) AS filings FROM lines JOIN filings USING (filing_uuid) WHERE registrant_name ILIKE '%1%' AND description ILIKE '%a%' GROUP BY 1 HAVING min(filing_year) <= 1996 AND count(DISTINCT filing_uuid) >= 2 ORDER BY first_year, filings DESC, 1 LIMIT 50", FILINGS, LINES))
def early_lobbyists(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.lines.where(F.col("description").ilike("%a%")).join(b.filings.where(F.col("registrant_name").ilike("%1%")), "filing_uuid")
    return rows.groupBy("lobbyist_name").agg(F.min("filing_year").alias("first_year"), F.count_distinct("filing_uuid").alias("filings")).where("first_year <= 1996 AND filings >= 2").orderBy(F.asc_nulls_last("first_year"), F.desc("filings"), "lobbyist_name").limit(50)


@register("o11", sql("SELECT client_name, count(DISTINCT filing_uuid) AS filings, string_agg(DISTINCT general_issue_code, ',' ORDER BY general_issue_code) AS issues FROM filings LEFT JOIN lines USING (filing_uuid) WHERE registrant_name = (SELECT min(registrant_name) FROM filings) GROUP BY 1", FILINGS, LINES))
def client_portfolio(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    first = F.broadcast(b.filings.agg(F.min("registrant_name").alias("registrant_name")))  # one row
    rows = b.filings.join(first, "registrant_name").join(b.lines.select("filing_uuid", "general_issue_code"), "filing_uuid", "left")
    issues = F.array_join(F.array_sort(F.collect_set("general_issue_code")), ",")
    return rows.groupBy("client_name").agg(F.count_distinct("filing_uuid").alias("filings"), F.when(F.count("general_issue_code") > 0, issues).alias("issues"))


@register("o12", sql("SELECT DISTINCT filing_year, registrant_name, description FROM lines JOIN filings USING (filing_uuid) WHERE suppkey = 1", FILINGS, LINES))
def issue_descriptions(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    return b.lines.where("suppkey = 1").join(b.filings, "filing_uuid").select("filing_year", "registrant_name", "description").distinct()


@register("o13", sql(", mine AS (SELECT DISTINCT filing_uuid FROM lines WHERE suppkey = 1) SELECT entity_name, count(DISTINCT filing_uuid) AS filings, string_agg(DISTINCT client_name, ' | ' ORDER BY client_name) AS clients FROM lines JOIN filings USING (filing_uuid) WHERE filing_uuid IN (SELECT filing_uuid FROM mine) GROUP BY 1", FILINGS, LINES))
def entity_profile(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    mine = b.lines.where("suppkey = 1").select("filing_uuid").distinct()
    rows = b.lines.select("filing_uuid", "entity_name").join(mine, "filing_uuid", "left_semi").join(b.filings, "filing_uuid")
    return rows.groupBy("entity_name").agg(F.count_distinct("filing_uuid").alias("filings"), F.array_join(F.array_sort(F.collect_set("client_name")), " | ").alias("clients"))


@register("o14", sql("SELECT registrant_id, registrant_name, count(DISTINCT filing_uuid) AS filings, count(DISTINCT client_name) AS clients, min(filing_year) AS first_year, max(filing_year) AS last_year, min(CAST(filing_year AS VARCHAR) || '-' || filing_period) AS first_period FROM filings GROUP BY 1, 2", FILINGS))
def firm_rollup(spark, sf_dir) -> DataFrame:
    f = Bound(spark, sf_dir).filings
    period = F.concat_ws("-", F.col("filing_year").cast("string"), "filing_period")
    return f.groupBy("registrant_id", "registrant_name").agg(F.count_distinct("filing_uuid").alias("filings"), F.count_distinct("client_name").alias("clients"), F.min("filing_year").alias("first_year"), F.max("filing_year").alias("last_year"), F.min(period).alias("first_period"))


@register("o15", sql("SELECT (SELECT round(sum(income), 2) FROM lines JOIN filings USING (filing_uuid) WHERE suppkey = 1) AS income_by_row, (SELECT round(sum(income), 2) FROM filings WHERE filing_uuid IN (SELECT filing_uuid FROM lines WHERE suppkey = 1)) AS income_by_filing, (SELECT count(*) FROM filings WHERE filing_uuid IN (SELECT filing_uuid FROM lines WHERE suppkey = 1)) AS filings", FILINGS, LINES))
def fan_out(spark, sf_dir) -> DataFrame:
    """What a join over activity rows adds up to, beside the sum over filings."""
    b = Bound(spark, sf_dir)
    mine = b.lines.where("suppkey = 1").select("filing_uuid")
    by_row = mine.join(b.filings, "filing_uuid").agg(_money("income", "income_by_row"))
    by_filing = b.filings.join(mine, "filing_uuid", "left_semi").agg(_money("income", "income_by_filing"), _count("filings"))
    return by_row.crossJoin(by_filing)  # one row each


@register("o16", sql("SELECT filing_year, registrant_name, description, count(*) AS n FROM lines JOIN filings USING (filing_uuid) WHERE description ILIKE '%ring%' AND (entity_name = 'Brand#13' OR entity_name = 'Brand#22') GROUP BY 1, 2, 3", FILINGS, LINES))
def keyword_evidence(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.lines.where(F.col("description").ilike("%ring%") & F.col("entity_name").isin("Brand#13", "Brand#22"))
    return rows.join(b.filings, "filing_uuid").groupBy("filing_year", "registrant_name", "description").agg(_count())


HOUSE = "house AS (SELECT filing_uuid AS house_id, CAST(registrant_id AS VARCHAR) || '-' || CAST(client_id AS VARCHAR) AS senate_id, registrant_name AS org_name, client_name, filing_year, filing_period, income FROM filings WHERE status = 'F')"
SENATE = "senate AS (SELECT *, CASE filing_period WHEN 'Q1' THEN 'first_quarter' WHEN 'Q2' THEN 'second_quarter' WHEN 'Q3' THEN 'third_quarter' ELSE 'fourth_quarter' END AS period_name FROM filings WHERE status <> 'F')"
#: House periods by the Senate's names.
PERIODS = {"first_quarter": "Q1", "second_quarter": "Q2", "third_quarter": "Q3", "fourth_quarter": "Q4"}


def house(b: Bound) -> DataFrame:
    f = b.filings.where("status = 'F'")
    return f.select(F.col("filing_uuid").alias("house_id"), F.concat_ws("-", F.col("registrant_id").cast("string"), F.col("client_id").cast("string")).alias("senate_id"), F.col("registrant_name").alias("org_name"), "client_name", "filing_year", "filing_period", "income")


def senate(b: Bound) -> DataFrame:
    name = F.col("filing_period")
    for long, short in PERIODS.items():
        name = F.when(F.col("filing_period") == short, long).otherwise(name)
    return b.filings.where("status <> 'F'").withColumn("period_name", name)


@register("o17", sql("SELECT lobbyist_name, count(DISTINCT house_id) AS filings, count(DISTINCT org_name) AS firms, rank() OVER (ORDER BY count(DISTINCT house_id) DESC) AS place FROM house JOIN lines ON house_id = filing_uuid GROUP BY 1 ORDER BY filings DESC, 1 LIMIT 30", FILINGS, LINES, HOUSE))
def house_ranking(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = house(b).join(b.lines.select(F.col("filing_uuid").alias("house_id"), "lobbyist_name"), "house_id")
    top = rows.groupBy("lobbyist_name").agg(F.count_distinct("house_id").alias("filings"), F.count_distinct("org_name").alias("firms")).orderBy(F.desc("filings"), "lobbyist_name").limit(30)
    return top.withColumn("place", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("filings"))).cast("long"))  # 30 rows


@register("o18", sql("SELECT s.filing_uuid, h.house_id, s.client_name, s.filing_year, s.filing_period FROM (SELECT DISTINCT senate.filing_uuid, client_name, filing_year, filing_period, period_name FROM senate JOIN lines USING (filing_uuid) WHERE suppkey = 1) s LEFT JOIN house h ON h.senate_id IS NOT NULL AND (h.org_name ILIKE '%nation_7' OR h.client_name = s.client_name) AND h.filing_year = s.filing_year AND h.filing_period = CASE s.period_name WHEN 'first_quarter' THEN 'Q1' WHEN 'second_quarter' THEN 'Q2' WHEN 'third_quarter' THEN 'Q3' ELSE 'Q4' END", FILINGS, LINES, HOUSE, SENATE))
def reconciliation(spark, sf_dir) -> DataFrame:
    """One lobbyist's Senate filings with the House filings of the same year and quarter that are of a named firm or of the same client. Each side of the OR is an equi join of its own, so neither becomes a nested loop."""
    b = Bound(spark, sf_dir)
    mapped = F.create_map(*(F.lit(x) for pair in PERIODS.items() for x in pair))
    mine = b.lines.where("suppkey = 1").select("filing_uuid")
    s = senate(b).join(mine, "filing_uuid", "left_semi").select("filing_uuid", "client_name", "filing_year", "filing_period", mapped[F.col("period_name")].alias("quarter"))
    h = house(b).where("senate_id IS NOT NULL").select("house_id", "org_name", F.col("client_name").alias("house_client"), F.col("filing_year").alias("house_year"), F.col("filing_period").alias("house_period"))
    when = (F.col("house_year") == F.col("filing_year")) & (F.col("house_period") == F.col("quarter"))
    by_client = s.join(h, when & (F.col("house_client") == F.col("client_name")))
    by_firm = s.join(h.where(F.col("org_name").ilike("%nation_7")), when & ~F.col("house_client").eqNullSafe(F.col("client_name")))
    found = by_client.unionByName(by_firm).select("filing_uuid", "house_id")
    return s.join(found, "filing_uuid", "left").select("filing_uuid", "house_id", "client_name", "filing_year", "filing_period")


@register("o18_counts", sql("SELECT (SELECT count(*) FROM house) AS house_filings, (SELECT count(*) FROM senate) AS senate_filings, (SELECT count(DISTINCT org_name) FROM house) AS house_firms", FILINGS, HOUSE, SENATE))
def chamber_counts(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    return house(b).agg(_count("house_filings"), F.count_distinct("org_name").alias("house_firms")).crossJoin(senate(b).agg(_count("senate_filings"))).select("house_filings", "senate_filings", "house_firms")


@register("o20", sql("SELECT count(*) AS n, count(income) AS disclosed, round(avg(income), 4) AS mean_income, round(median(income), 4) AS median_income, min(income) AS low, max(income) AS high FROM (SELECT DISTINCT filing_uuid, income FROM filings JOIN lines USING (filing_uuid) WHERE suppkey <= 3)", FILINGS, LINES))
def income_stats(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.filings.join(b.lines.where("suppkey <= 3").select("filing_uuid"), "filing_uuid").select("filing_uuid", "income").distinct()
    rows = save(rows, "disclosed")  # read by the quantile's sketch and by its band
    told = rows.agg(_count(), F.count("income").alias("disclosed"), F.round(F.avg("income"), 4).alias("mean_income"), F.min("income").alias("low"), F.max("income").alias("high"))
    median = ranks.quantile(rows, "income", []).select(F.round("quantile", 4).alias("median_income"))
    return told.crossJoin(F.broadcast(median))  # one row each


@register("c4", sql("SELECT a.general_issue_code, count(*) AS activities, count(b.filing_uuid) AS met, round(coalesce(sum(b.amount), 0), 2) AS amount FROM lines a LEFT JOIN (SELECT filing_uuid, activity_idx, amount FROM lines WHERE entity_name = 'Brand#13') b ON a.filing_uuid = b.filing_uuid AND a.activity_idx = b.activity_idx GROUP BY 1", LINES))
def left_on_two_columns(spark, sf_dir) -> DataFrame:
    """Activities with the entity of one agency on filing and activity, where they have it."""
    b = Bound(spark, sf_dir)
    met = b.lines.where("entity_name = 'Brand#13'").select("filing_uuid", "activity_idx", "amount", F.lit(1).alias("one"))
    rows = b.lines.select("filing_uuid", "activity_idx", "general_issue_code").join(met, ["filing_uuid", "activity_idx"], "left")
    return rows.groupBy("general_issue_code").agg(_count("activities"), F.count("one").alias("met"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("amount"))


@register("c4_constant", sql("SELECT registrant_name, count(*) AS filings, count(l.filing_uuid) AS with_first, count(*) FILTER (l.filing_uuid IS NULL) AS without FROM filings f LEFT JOIN lines l ON l.filing_uuid = f.filing_uuid AND l.activity_idx = 4 GROUP BY 1", FILINGS, LINES))
def left_on_a_constant(spark, sf_dir) -> DataFrame:
    """Filings with their fourth activity where they have one: the constant is part of the join, so filings without stay."""
    b = Bound(spark, sf_dir)
    f, one = b.filings.select("filing_uuid", "registrant_name"), b.lines.select(F.col("filing_uuid").alias("of"), "activity_idx")
    rows = f.join(one, (F.col("of") == F.col("filing_uuid")) & (F.col("activity_idx") == 4), "left")
    return rows.groupBy("registrant_name").agg(_count("filings"), F.count("of").alias("with_first"), F.count_if(F.col("of").isNull()).alias("without"))


@register("o21", sql("SELECT count(DISTINCT filing_uuid) AS agency_filings, count(DISTINCT CASE WHEN filing_uuid IN (SELECT filing_uuid FROM lines WHERE suppkey = 1) THEN filing_uuid END) AS mine, round(100.0 * count(DISTINCT CASE WHEN filing_uuid IN (SELECT filing_uuid FROM lines WHERE suppkey = 1) THEN filing_uuid END) / count(DISTINCT filing_uuid), 4) AS pct FROM lines WHERE entity_name = 'Brand#13'", LINES))
def person_share(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    flag = b.lines.where("suppkey = 1").select("filing_uuid").distinct().withColumn("mine", F.lit(1))
    rows = b.lines.where("entity_name = 'Brand#13'").select("filing_uuid").join(flag, "filing_uuid", "left")
    out = rows.agg(F.count_distinct("filing_uuid").alias("agency_filings"), F.count_distinct(F.when(F.col("mine") == 1, F.col("filing_uuid"))).alias("mine"))
    return out.withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("mine"), F.col("agency_filings")), 4))


@register("o22", sql("SELECT (SELECT count(*) FROM filings WHERE registrant_id = 7) AS firm_filings, (SELECT count(*) FROM filings) AS all_filings, round(100.0 * (SELECT count(*) FROM filings WHERE registrant_id = 7) / (SELECT count(*) FROM filings), 4) AS pct, (SELECT count(DISTINCT client_id) FROM filings WHERE registrant_id = 7) AS clients", FILINGS))
def firm_footprint(spark, sf_dir) -> DataFrame:
    f = Bound(spark, sf_dir).filings
    own = F.col("registrant_id") == 7
    out = f.agg(F.count_if(own).alias("firm_filings"), _count("all_filings"), F.count_distinct(F.when(own, F.col("client_id"))).alias("clients"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("firm_filings") / F.col("all_filings"), 4)).select("firm_filings", "all_filings", "pct", "clients")


@register("o23", sql("SELECT registrant_name, count(DISTINCT filing_uuid) AS filings, count(DISTINCT CASE WHEN entity_name = 'Brand#13' THEN filing_uuid END) AS focus, round(100.0 * count(DISTINCT CASE WHEN entity_name = 'Brand#13' THEN filing_uuid END) / count(DISTINCT filing_uuid), 4) AS pct FROM filings JOIN lines USING (filing_uuid) GROUP BY 1 HAVING focus >= 2 ORDER BY pct DESC, 1 LIMIT 20", FILINGS, LINES))
def firm_focus(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.filings.select("filing_uuid", "registrant_name").join(b.lines.select("filing_uuid", "entity_name"), "filing_uuid")
    out = rows.groupBy("registrant_name").agg(F.count_distinct("filing_uuid").alias("filings"), F.count_distinct(F.when(F.col("entity_name") == "Brand#13", F.col("filing_uuid"))).alias("focus")).where("focus >= 2")
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("focus") / F.col("filings"), 4)).orderBy(F.desc("pct"), "registrant_name").limit(20)


@register("o24", sql("SELECT lobbyist_name, string_agg(DISTINCT covered_position, '; ' ORDER BY covered_position) AS positions, count(DISTINCT registrant_name) AS firms FROM lines JOIN filings USING (filing_uuid) WHERE covered_position ILIKE '%ring%' GROUP BY 1", FILINGS, LINES))
def position_mentions(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.lines.where(F.col("covered_position").ilike("%ring%")).join(b.filings, "filing_uuid")
    return rows.groupBy("lobbyist_name").agg(F.array_join(F.array_sort(F.collect_set("covered_position")), "; ").alias("positions"), F.count_distinct("registrant_name").alias("firms"))


@register("o25", sql("SELECT lobbyist_name, count(DISTINCT covered_position) AS positions, count(covered_position) AS with_position, count(*) AS n FROM filings JOIN lines USING (filing_uuid) WHERE registrant_id = 7 GROUP BY 1", FILINGS, LINES))
def firm_lobbyists(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.lines.join(b.filings.where("registrant_id = 7").select("filing_uuid"), "filing_uuid")
    return rows.groupBy("lobbyist_name").agg(F.count_distinct("covered_position").alias("positions"), F.count("covered_position").alias("with_position"), _count())


@register("o27", sql(", mine AS (SELECT DISTINCT filing_uuid FROM lines WHERE suppkey = 2), targets AS (SELECT entity_name, count(DISTINCT filing_uuid) AS filings FROM lines JOIN mine USING (filing_uuid) GROUP BY 1), firms AS (SELECT entity_name, count(DISTINCT client_name) AS clients FROM lines JOIN mine USING (filing_uuid) JOIN filings USING (filing_uuid) GROUP BY 1) SELECT entity_name, filings, clients FROM targets JOIN firms USING (entity_name)", FILINGS, LINES))
def entity_targets(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    mine = b.lines.where("suppkey = 2").select("filing_uuid").distinct()
    rows = b.lines.select("filing_uuid", "entity_name").join(mine, "filing_uuid").join(b.filings.select("filing_uuid", "client_name"), "filing_uuid")
    return rows.groupBy("entity_name").agg(F.count_distinct("filing_uuid").alias("filings"), F.count_distinct("client_name").alias("clients"))


@register("o29", sql("SELECT split_part(h.senate_id, '-', 1) AS firm, h.house_id, s.filing_uuid FROM house h JOIN senate s ON split_part(h.senate_id, '-', 1) = CAST(s.registrant_id AS VARCHAR) AND h.client_name = s.client_name AND h.filing_year = s.filing_year AND h.filing_period = s.filing_period", FILINGS, HOUSE, SENATE))
def cross_chamber(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    h = house(b).select(F.split_part("senate_id", F.lit("-"), F.lit(1)).alias("firm"), "house_id", "client_name", "filing_year", "filing_period")
    s = senate(b).select(F.col("registrant_id").cast("string").alias("firm"), "filing_uuid", "client_name", "filing_year", "filing_period")
    return h.join(s, ["firm", "client_name", "filing_year", "filing_period"]).select("firm", "house_id", "filing_uuid")


@register("o29_firms", sql("SELECT coalesce(h.firm, s.firm) AS firm, h.n AS house_filings, s.n AS senate_filings FROM (SELECT split_part(senate_id, '-', 1) AS firm, count(*) AS n FROM house GROUP BY 1) h FULL OUTER JOIN (SELECT CAST(registrant_id AS VARCHAR) AS firm, count(*) AS n FROM senate GROUP BY 1) s ON h.firm = s.firm", FILINGS, HOUSE, SENATE))
def firm_full_outer(spark, sf_dir) -> DataFrame:
    """Filings of all clients."""
    b = Bound(spark, sf_dir)
    h = house(b).groupBy(F.split_part("senate_id", F.lit("-"), F.lit(1)).alias("firm")).agg(_count("house_filings"))
    s = senate(b).groupBy(F.col("registrant_id").cast("string").alias("firm")).agg(_count("senate_filings"))
    return h.join(s, "firm", "full_outer")


@register("o30", sql("SELECT count(*) AS row_count, count(DISTINCT filing_uuid) AS filings, count(DISTINCT lobbyist_name) AS people FROM lines JOIN filings USING (filing_uuid) WHERE filing_year = 1997", FILINGS, LINES))
def dedup_counts(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.lines.select("filing_uuid", "lobbyist_name").join(b.filings.where("filing_year = 1997").select("filing_uuid"), "filing_uuid")
    return rows.agg(_count("row_count"), F.count_distinct("filing_uuid").alias("filings"), F.count_distinct("lobbyist_name").alias("people"))


@register("o31", sql("SELECT registrant_name, CAST(filing_year AS VARCHAR) || '-' || filing_period AS quarter, round(sum(income), 2) AS income, count(*) AS filings FROM filings GROUP BY 1, 2 ORDER BY income DESC, 1, 2 LIMIT 100", FILINGS))
def firm_income(spark, sf_dir) -> DataFrame:
    """All firms."""
    f = Bound(spark, sf_dir).filings
    return f.groupBy("registrant_name", F.concat_ws("-", F.col("filing_year").cast("string"), "filing_period").alias("quarter")).agg(_money("income", "income"), _count("filings")).orderBy(F.desc("income"), "registrant_name", "quarter").limit(100)


@register("o32", "SELECT count(*) AS n, avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) AS price_null, count(DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END) AS urgent, round(100.0 * count(DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END) / count(DISTINCT o_orderkey), 4) AS pct FROM orders")
def coverage(spark, sf_dir) -> DataFrame:
    urgent = F.count_distinct(F.when(F.col("o_orderpriority").like("1%"), F.col("o_orderkey")))
    return Bound(spark, sf_dir).table("orders").agg(_count(), F.avg(F.col("o_totalprice").isNull().cast("double")).alias("price_null"), urgent.alias("urgent"), F.round(F.lit(100.0) * urgent / F.count_distinct("o_orderkey"), 4).alias("pct"))
