"""The disclosure tables as seen in the star schema: the roles that the queries speak of, as DataFrames and as the SQL that says the same.

A filing is an order of a customer, its registrant the customer's nation; a lobbyist row, an activity and a government entity
are a line of the order with its supplier, its part's type and name and its part's brand. A press release is a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources.tables import load


class Bound:
    """Lazy tables of one data directory; each access plans the scan that it needs and no more."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @property
    def filings(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
        customers = self.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        nations = F.broadcast(self.table("nation").select("n_nationkey", "n_name"))  # 25 rows at every scale
        joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("o_orderkey").alias("filing_uuid"), F.col("n_nationkey").cast("long").alias("registrant_id"), F.col("n_name").alias("registrant_name"), F.col("o_custkey").alias("client_id"), F.col("c_name").alias("client_name"),
            F.col("o_totalprice").alias("income"), F.year("o_orderdate").cast("long").alias("filing_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("filing_period"), F.col("o_orderpriority").alias("filing_type"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"),
        )

    @property
    def lines(self) -> DataFrame:
        return self.lines_with({})

    def lines_with(self, of_part: dict[str, Column]) -> DataFrame:
        """Lines with columns made from the part (``p_name, p_type, p_brand, p_size``), which are computed once a part instead of once a line."""
        items = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
        suppliers = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        parts = self.table("part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", *(c.alias(name) for name, c in of_part.items()))
        joined = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).join(parts, items["l_partkey"] == parts["p_partkey"])
        return joined.select(
            F.col("l_orderkey").alias("filing_uuid"), F.col("l_linenumber").cast("long").alias("activity_idx"), F.col("s_name").alias("lobbyist_name"), F.col("s_nationkey").cast("long").alias("home"), F.col("p_name").alias("covered_position"),
            F.col("p_type").alias("general_issue_code"), F.col("p_name").alias("description"), F.col("p_brand").alias("entity_name"), F.col("l_extendedprice").alias("amount"), F.col("l_suppkey").alias("suppkey"), F.col("p_partkey").alias("part_id"), F.col("p_size").cast("long").alias("part_size"), *of_part,
        )

    @property
    def press(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text", "lang", "source")
        return docs.select(
            "doc_id", F.col("source").alias("member_name"), F.col("lang").alias("party"), F.concat("source", F.lit(".example")).alias("domain"), "text", F.split("text", "\n")[0].alias("title"),
            F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd").alias("date"),
        )


FILINGS = """filings AS (SELECT o_orderkey AS filing_uuid, CAST(n_nationkey AS BIGINT) AS registrant_id, n_name AS registrant_name, o_custkey AS client_id, c_name AS client_name, o_totalprice AS income,
  CAST(year(o_orderdate) AS BIGINT) AS filing_year, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS filing_period, o_orderpriority AS filing_type, o_orderstatus AS status, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
LINES = """lines AS (SELECT l_orderkey AS filing_uuid, CAST(l_linenumber AS BIGINT) AS activity_idx, s_name AS lobbyist_name, CAST(s_nationkey AS BIGINT) AS home, p_name AS covered_position, p_type AS general_issue_code, p_name AS description,
  p_brand AS entity_name, l_extendedprice AS amount, l_suppkey AS suppkey, p_partkey AS part_id, CAST(p_size AS BIGINT) AS part_size FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
PRESS = """press AS (SELECT doc_id, source AS member_name, lang AS party, source || '.example' AS domain, text, split_part(text, chr(10), 1) AS title,
  strftime(DATE '2022-01-01' + CAST(doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS date FROM documents)"""


def sql(body: str, *parts: str) -> str:
    """``body`` with the role tables that it uses in front; a body that begins with a comma adds tables of its own."""
    return f"WITH {', '.join(parts)}{'' if body.startswith(',') else ' '}{body}"
