"""Case files, findings and awards."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from daybook import schemas
from daybook.sources.retry import ask


def case(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A case file as one row; a missing or empty required key raises."""
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    row = df.first()
    lacking = [c for c in required if row is None or not row[c]]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return df


# Award groups with their type codes, the one that can't be sorted by amount, the fields of an award, and the window of a press case.
AWARD_GROUPS = {"grants": ["02", "03", "04", "05"], "contracts": ["A", "B", "C", "D"], "direct": ["06", "10"], "loans": ["07", "08"]}
NO_AMOUNT_SORT = ["loans"]
FIELDS = ["Award ID", "Recipient Name", "Award Amount", "Awarding Agency", "Awarding Sub Agency", "Award Type", "Description", "Start Date"]
SINCE, UNTIL = "2022-01-01", "2026-04-01"
RETRIED = [429, 500, 502, 503]


def _each_client(path: str, row, required: list[str]) -> None:
    for i, client in enumerate(row["clients"]):
        lacking = [c for c in required if client[c] is None]
        if lacking:
            raise ValueError(f"{path}: client {i} lacks {', '.join(lacking)}")


def trace_case(spark: SparkSession, path: str) -> DataFrame:
    """An award case: every client has a label, a search and name tokens, every award group is known."""
    df = case(spark, path, schemas.TRACE_CASE, ["lobbyist", "agency", "award_groups", "clients"])
    row = df.first()
    _each_client(path, row, ["label", "search", "name_tokens"])
    unknown = [g for g in row["award_groups"] if g not in AWARD_GROUPS]
    if unknown:
        raise ValueError(f"{path}: unknown award groups {', '.join(unknown)}")
    return df


def press_case(spark: SparkSession, path: str) -> DataFrame:
    """A press case: clients without aliases go by their name, and a filter without dates covers the corpus's window."""
    df = case(spark, path, schemas.PRESS_CASE, ["label", "clients"])
    _each_client(path, df.first(), ["name"])
    named = F.transform("clients", lambda c: F.struct(c["name"].alias("name"), F.when(F.coalesce(F.size(c["aliases"]), F.lit(0)) > 0, c["aliases"]).otherwise(F.array(c["name"])).alias("aliases")))
    window = F.struct(F.coalesce("filters.since", F.lit(SINCE)).alias("since"), F.coalesce("filters.until", F.lit(UNTIL)).alias("until"), *(F.col(f"filters.{c}").alias(c) for c in ("party", "state", "chamber", "domain_contains")))
    return df.withColumn("clients", named).withColumn("filters", window)


def award_request(search: str, agency: str, group: str, start: str, end: str, limit: int = 100) -> dict:
    """The body that asks for one client's awards of one group."""
    by, order = ("Recipient Name", "asc") if group in NO_AMOUNT_SORT else ("Award Amount", "desc")
    where = {"recipient_search_text": [search], "award_type_codes": AWARD_GROUPS[group], "time_period": [{"start_date": start, "end_date": end}], "agencies": [{"type": "awarding", "tier": "toptier", "name": agency}]}
    return {"filters": where, "fields": FIELDS, "limit": limit, "sort": by, "order": order}


def post(url: str, body: dict, tries: int = 4, wait: float = 2.0) -> list[dict]:
    """Results of a request. Overload, server and network errors are tried again after ``wait``, twice it and so on; after that, and for other errors, there are none."""
    request = urllib.request.Request(url, data=json.dumps(body).encode(), headers={"Content-Type": "application/json"})
    return ask(request, RETRIED, tries, wait, read=lambda answer: json.loads(answer.read()).get("results", [])) or []


def findings(spark: SparkSession, path: str, top: int | None = None, rank: int | None = None) -> DataFrame:
    """Rows of a findings document, all, the first ``top`` by rank, or one."""
    rows = spark.read.schema(schemas.FINDINGS_JSON).option("multiLine", "true").json(path).select(F.explode("findings").alias("f")).select("f.*")
    rows = rows.where(F.col("rank") == rank) if rank is not None else rows
    return rows.orderBy("rank").limit(top) if top is not None else rows


def _award(client: str | None, r: dict) -> tuple:
    amount = r.get("Award Amount")
    return (client, r.get("Award ID"), r.get("Recipient Name"), float(amount) if amount is not None else None, r.get("Awarding Agency"), r.get("Awarding Sub Agency"), r.get("Award Type"), r.get("Description"), r.get("Start Date"))


class Awards(DataSource):
    """Awards by client and award group, a partition a group.

    Registered as ``awards``. With the option ``url`` each group is one request, as the service has no more than a first page for it; options ``search``, ``agency``, ``start``, ``end``, ``limit`` and ``wait``. With ``path`` a page is a JSON file of a
    directory that all executors see, ``<group>-<page>.json`` with ``results``. Both take ``groups`` (comma-separated) and ``client``."""

    @classmethod
    def name(cls) -> str:
        return "awards"

    def schema(self) -> str:
        return schemas.AWARD

    def reader(self, schema) -> DataSourceReader:
        return _AwardsReader(self.options)


class _Group(InputPartition):
    def __init__(self, group: str):
        self.group = group


class _AwardsReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.client, self.groups = options.get("client"), options["groups"].split(",")

    def partitions(self):
        return [_Group(g) for g in self.groups]

    def read(self, partition):
        import os

        o = self.options
        if o.get("url"):
            body = award_request(o["search"], o["agency"], partition.group, o["start"], o["end"], int(o.get("limit", 100)))
            yield from (_award(self.client, r) for r in post(o["url"], body, wait=float(o.get("wait", 2))))
            return
        page = 1
        while os.path.exists(file := f"{o['path']}/{partition.group}-{page}.json"):
            with open(file) as f:
                yield from (_award(self.client, r) for r in json.load(f)["results"])
            page += 1
