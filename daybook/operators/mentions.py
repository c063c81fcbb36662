"""Search of press releases for clients by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import framed
from daybook.operators.automaton import mentions


def filtered(press: DataFrame, since: str | None = None, until: str | None = None, party: str | None = None, state: str | None = None, chamber: str | None = None, domain_contains: str | None = None) -> DataFrame:
    """Only the filters that are given; dates compare as text, both ends included."""
    out = press
    for column, test in (("date", since and F.col("date") >= since), ("date", until and F.col("date") <= until), ("party", party and F.col("party") == party), ("state", state and F.upper("state") == state.upper()), ("chamber", chamber and F.lower("chamber") == chamber.lower()), ("domain", domain_contains and F.lower("domain").contains(domain_contains.lower()))):
        if test is not None and column in press.columns:
            out = out.where(test)
    return out


def search(press: DataFrame, clients: list[tuple[str, list[str]]], per_client: int | None = None, key: tuple[str, ...] = ("member_name", "date", "title"), tie: str = "doc_id", limit: int | None = None, ascii_words: bool = False) -> DataFrame:
    """``client`` with each matching release once a client, newest first, ``n`` at most. One pass over text and title finds all clients (``automaton``), however many there are; only rows with a mention go on, with the mention's place, from which the snippet is cut.

    The text itself has done its work then and isn't among the columns. ``limit`` keeps so many of the newest hits of each client before repeats are taken out, as the original does; by default all stay. Words and letters' case are Unicode's, or those of ASCII with ``ascii_words``."""
    rest = [c for c in press.columns if c != "text"]
    found = press.withColumn("__hits", mentions(clients, F.col("text"), F.col("title"), ascii_words=ascii_words)).where(F.size("__hits") > 0)
    hits = found.withColumn("__hit", F.explode("__hits"))
    where = F.when(F.col("__hit.source") == 0, F.col("text")).otherwise(F.col("title"))
    label = F.element_at(F.array(*(F.lit(label) for label, _ in clients)) if clients else F.array(F.lit(None).cast("string")), F.col("__hit.place") + 1)
    hits = hits.select(*rest, label.alias("client"), framed(where, F.col("__hit.at"), F.col("__hit.size")).alias("snippet"))
    newest = Window.partitionBy("client").orderBy(F.desc("date"), tie)
    if limit is not None:
        hits = hits.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit).drop("__n")
    first = Window.partitionBy("client", *key).orderBy(tie)
    hits = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if per_client is not None:
        hits = hits.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= per_client).drop("__n")
    return hits


def attribute(press: DataFrame, clients: list[tuple[str, list[str]]]) -> DataFrame:
    """``client`` of each release: the first in the list's order that the title or the text names."""
    found = press.withColumn("__hits", mentions(clients, F.col("text"), F.col("title"))).where(F.size("__hits") > 0)
    label = F.element_at(F.array(*(F.lit(label) for label, _ in clients)) if clients else F.array(F.lit(None).cast("string")), F.col("__hits")[0]["place"] + 1)
    return found.withColumn("client", label).drop("__hits")


def tallies(hits: DataFrame, person: str = "member_name", identity: str = "bioguide_id") -> DataFrame:
    """Matches, members and dates of each client; a member is told by ``identity`` where the release has one, else by name."""
    who = F.coalesce(F.nullif(F.col(identity), F.lit("")), F.col(person)) if identity in hits.columns else F.col(person)
    return hits.groupBy("client").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct(who).alias("n_members"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
