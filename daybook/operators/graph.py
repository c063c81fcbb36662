"""A typed graph of findings and its motifs: bridges, triangles and hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.durable import release_shuffles, save


def node_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.upper(F.trim(label)))


def edges(rows: DataFrame, kind: str, src: Column, dst: Column, weight: Column, order: Column | None = None) -> DataFrame:
    """One edge a pair. Weights add up; with ``order`` the last row's weight stands instead."""
    pairs = rows.select(src.alias("src"), dst.alias("dst"), weight.cast("double").alias("w"), (F.lit(0) if order is None else order).alias("at")).where("src IS NOT NULL AND dst IS NOT NULL")
    total = F.sum("w") if order is None else F.max_by("w", F.struct("at", "w"))
    return pairs.groupBy("src", "dst").agg(total.alias("weight"), F.count(F.lit(1)).alias("n")).withColumn("type", F.lit(kind))


def nodes(graph: DataFrame) -> DataFrame:
    """Every endpoint with its type and degree."""
    ends = graph.select(F.col("src").alias("id")).unionAll(graph.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).withColumn("type", F.split_part("id", F.lit(":"), F.lit(1)))


def bridges(lobbies_for: DataFrame, least: int = 2) -> DataFrame:
    """Clients of at least ``least`` lobbyists: ``client, n_lobbyists, lobbyists``."""
    return lobbies_for.groupBy(F.col("dst").alias("client")).agg(F.count_distinct("src").alias("n_lobbyists"), F.array_join(F.array_sort(F.collect_set("src")), " | ").alias("lobbyists")).where(F.col("n_lobbyists") >= least)


#: Rows of a lobbyist's offices that may be broadcast.
FEW = 200_000
#: Lobbyists with their offices as bits that may be broadcast, about a hundred bytes each.
FEW_MASKS = 500_000
#: Agencies that share a page of bits.
PAGE = 62
#: Clients times offices of a lobbyist from which on it counts as a hub; without one there is nothing to route.
HUB = 1_000_000
#: How many times the rows of the cheapest way a lobbyist's clients times its offices may be; these need no third edge before they are grouped.
SLACK = 4


def _costs(hired: DataFrame, held: DataFrame, paid: DataFrame) -> DataFrame:
    """For each lobbyist with clients and offices, the way to its triangles: its clients times its offices, unless the payments to its clients or the payments by its offices are far fewer."""
    by_client = hired.join(paid.groupBy("client").agg(F.count(F.lit(1)).alias("d")), "client").groupBy("lobbyist").agg(F.count(F.lit(1)).alias("clients"), F.sum("d").alias("to_clients"))
    by_agency = held.join(paid.groupBy("agency").agg(F.count(F.lit(1)).alias("d")), "agency").groupBy("lobbyist").agg(F.count(F.lit(1)).alias("offices"), F.sum("d").alias("by_offices"))
    both = by_client.join(by_agency, "lobbyist")
    crossed = F.col("clients") * F.col("offices")
    fewest = F.least("to_clients", "by_offices")
    way = F.when(crossed <= SLACK * fewest, "both").when(F.col("to_clients") <= F.col("by_offices"), "client").otherwise("agency")
    return both.select("lobbyist", way.alias("way"), F.when(crossed <= SLACK * fewest, crossed).otherwise(fewest).alias("rows"))


def _crossed(hired: DataFrame, held: DataFrame) -> DataFrame:
    """Clients and offices of each lobbyist. The rows multiply here, so they are dealt by client to a fixed number of tasks, which adaptive planning would make few by the size of what comes in; grouped by client later, they stay where they are."""
    n = int(hired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hired.repartition(n, "client").join(F.broadcast(held) if held.count() <= FEW else held, "lobbyist")


def linked(hired: DataFrame, held: DataFrame, paid: DataFrame) -> DataFrame:
    """``lobbyist, client, agency`` of every triangle of a lobbyist that works for the client, held office at the agency, and an agency that pays the client; beside them pairs of client and agency without
    payment for lobbyists that have few of them, which the join with the payments drops.

    Edges that end nowhere go first. A lobbyist with ten thousand clients never meets all its agencies: it goes from its clients to those who pay them (or from its offices to those they pay), and a semi-join with the third edge
    closes the triangle. So the rows made are at most ``SLACK`` times those of every lobbyist's cheapest two edges."""
    hired = save(hired.join(paid.select("client").distinct(), "client", "left_semi"), "hired")
    held = save(held.join(paid.select("agency").distinct(), "agency", "left_semi"), "held")
    routes = save(_costs(hired, held, paid).select("lobbyist", "way"), "routes")
    columns = ["lobbyist", "client", "agency"]
    ways = {r.way for r in routes.select("way").distinct().collect()}  # three at most
    of = lambda df, way: df if ways == {way} else df.join(routes.where(F.col("way") == way), "lobbyist", "left_semi")
    close = F.broadcast if held.count() <= FEW else (lambda df: df)
    made = []
    if "both" in ways or not ways:
        made.append(_crossed(of(hired, "both"), held))
    if "client" in ways:
        made.append(of(hired, "client").join(paid, "client").join(close(held), ["lobbyist", "agency"], "left_semi"))
    if "agency" in ways:
        made.append(of(held, "agency").join(paid, "agency").join(hired, ["lobbyist", "client"], "left_semi"))
    out = made[0].select(*columns)
    for more in made[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def numbered(held: DataFrame) -> DataFrame:
    """``agency, page, bit``: every agency as one bit of a page. Agencies are dealt to pages by hash and counted in each, a page of more than ``PAGE`` of them becomes several, so no task numbers all."""
    names = save(held.select("agency").distinct(), "agencies")
    pages = F.lit(-(-2 * names.count() // PAGE) or 1).cast("long")
    at = names.withColumn("page", F.pmod(F.xxhash64("agency"), pages))
    at = at.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("agency")) - 1)
    return save(at.select("agency", F.struct("page", F.floor(F.col("k") / PAGE).alias("part")).alias("page"), (F.col("k") % PAGE).alias("bit")), "numbered")


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def masks(rows: DataFrame, at: DataFrame, *by: str) -> DataFrame:
    """Agencies of ``rows`` as bits: ``*by, page, mask``."""
    return rows.join(_few(at, FEW), "agency").groupBy(*by, "page").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("mask"))


def has_hub(hired: DataFrame, held: DataFrame) -> bool:
    """Whether some lobbyist's clients times its offices are many."""
    sizes = hired.groupBy("lobbyist").agg(F.count(F.lit(1)).alias("a")).join(held.groupBy("lobbyist").agg(F.count(F.lit(1)).alias("b")), "lobbyist")
    return (sizes.agg(F.max(F.col("a") * F.col("b"))).first()[0] or 0) > HUB


def triangles(mentions: DataFrame, funded_by: DataFrame, lobbies_for: DataFrame, official_of: DataFrame) -> DataFrame:
    """A member mentions a client that an agency funds and a former official of that agency lobbies for.

    A client never meets each office of its lobbyists as a row: it gets its lobbyists once, each with its offices as bits, and every payment to it picks those whose bit is set. What is shuffled is a row for each lobbyist
    of a client (and page of agencies), whatever their offices; the list of a client is as long as all lists of lobbyists that the result has for it taken together, at most. Lobbyists with very many clients and offices are
    routed over payments and come in as bits too."""
    spark = mentions.sparkSession
    said = mentions.select(F.col("src").alias("member"), F.col("dst").alias("client"), F.col("weight").alias("mentions"))
    paid = save(funded_by.select(F.col("src").alias("agency"), F.col("dst").alias("client"), F.col("weight").alias("dollars")), "paid")
    release_shuffles(spark)
    hired = save(lobbies_for.select(F.col("src").alias("lobbyist"), F.col("dst").alias("client")).distinct(), "hired")
    release_shuffles(spark)
    held = save(official_of.select(F.col("src").alias("lobbyist"), F.col("dst").alias("agency")).distinct(), "held")
    release_shuffles(spark)
    at = numbered(held)
    routed = None
    if has_hub(hired, held):
        talked = paid.join(said.select("client").distinct(), "client", "left_semi")
        payments = save(talked.select("client", "agency").distinct(), "payments")
        wide = save(_costs(hired, held, payments).where("way <> 'both'").select("lobbyist"), "wide")
        routed = masks(linked(hired.join(wide, "lobbyist", "left_semi"), held.join(wide, "lobbyist", "left_semi"), payments), at, "client", "lobbyist")
        hired = hired.join(wide, "lobbyist", "left_anti")
    offices = save(masks(held, at, "lobbyist"), "offices")
    works = hired.join(_few(offices, FEW_MASKS), "lobbyist").select("client", "page", "lobbyist", "mask")
    if routed is not None:
        works = works.unionByName(routed.select(*works.columns))
    # all sides are dealt by client to a fixed number of tasks: what a task returns is far more than it reads, by which adaptive planning would make few of them
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = works.repartition(n, "client").groupBy("client", "page").agg(F.array_sort(F.collect_list(F.struct("lobbyist", "mask"))).alias("works"))
    asked = said.join(paid.join(_few(at, FEW), "agency"), "client")
    told = asked.join(lists, ["client", "page"]).withColumn("who", F.expr("filter(works, x -> (shiftright(x.mask, CAST(bit AS INT)) & 1L) = 1L).lobbyist")).where(F.size("who") > 0)
    return told.select("member", "client", "agency", F.array_join("who", " | ").alias("lobbyists"), "mentions", "dollars")


def hubs(mentions: DataFrame, funded_by: DataFrame) -> DataFrame:
    """Clients that are both mentioned and paid, with log10(dollars + 1) x mentions."""
    said = mentions.groupBy(F.col("dst").alias("client")).agg(F.sum("weight").alias("mentions"))
    paid = funded_by.groupBy(F.col("dst").alias("client")).agg(F.sum("weight").alias("dollars"))
    return said.join(paid, "client").where("mentions > 0 AND dollars > 0").withColumn("score", F.round(F.log10(F.col("dollars") + 1) * F.col("mentions"), 2))


def spring_layout(ids: list[str], links: list[tuple[str, str]], seed: int = 42, rounds: int = 60):
    """Positions of a few hundred nodes for drawing, by attraction along links and repulsion between all; equal for equal seeds."""
    import numpy as np

    at = np.random.default_rng(seed).random((len(ids), 2))
    place = {n: i for i, n in enumerate(ids)}
    pulls = np.array([(place[a], place[b]) for a, b in links], dtype=int).reshape(-1, 2)
    k = (1 / max(1, len(ids))) ** 0.5
    for step in range(rounds):
        gap = at[:, None] - at[None]
        far = np.maximum(np.linalg.norm(gap, axis=2), 1e-3)
        move = (gap * (k * k / far**2)[:, :, None]).sum(axis=1)
        for a, b in pulls:
            d = at[a] - at[b]
            pull = d * np.linalg.norm(d) / k
            move[a] -= pull
            move[b] += pull
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        at += move / size * np.minimum(size, 0.1 * (1 - step / rounds))
    return {n: tuple(at[i]) for n, i in place.items()}


def from_findings(findings: DataFrame, rank: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of findings with ``rank, lobbyist_name, registrant_name, agency_short, concentration, clients, trail, mentions``; all of them, or the one of a rank.

    ``clients`` is an array of names, ``trail`` one of ``label, total`` and ``mentions`` one of ``client, member`` (a member's label). Findings without lobbyist, firm or agency are left
    out. Lobbying and mentions count up; of the other edges the finding that comes last stands. A node keeps the label of the last finding that names it.
    """
    tidy = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = findings if rank is None else findings.where(F.col("rank") == rank)
    rows = rows.withColumns({"__l": tidy("lobbyist_name"), "__f": tidy("registrant_name"), "__a": F.upper(tidy("agency_short"))}).where("__l <> '' AND __f <> '' AND __a <> ''")
    of_client = lambda c: rows.select("rank", "__l", "__a", F.explode(c).alias("x"))
    hired = of_client("clients").withColumn("c", F.trim("x")).where("c <> ''")
    paid = of_client("trail").withColumn("c", F.trim("x.label")).where("c <> ''")
    said = of_client("mentions").withColumn("c", F.trim("x.client")).where("c <> '' AND x.member IS NOT NULL")
    lobbyist, firm, agency, client, member = (node_id(k, F.col(c)) for k, c in (("lobbyist", "__l"), ("firm", "__f"), ("agency", "__a"), ("client", "c"), ("legislator", "x.member")))
    order = F.col("rank")
    made = [
        edges(rows, "works_at", lobbyist, firm, F.lit(1), order), edges(rows, "former_official_of", lobbyist, agency, F.coalesce("concentration", F.lit(0.0)), order), edges(hired, "lobbies_for", lobbyist, client, F.lit(1)),
        edges(paid, "funded_by", agency, client, F.coalesce("x.total", F.lit(0.0)), order), edges(said, "mentions", member, client, F.lit(1)),
    ]
    links = made[0]
    for more in made[1:]:
        links = links.unionByName(more)
    names = None
    for df, node, label, step in ((rows, lobbyist, "__l", 0), (rows, firm, "__f", 1), (rows, agency, "__a", 2), (hired, client, "c", 3), (paid, client, "c", 4), (said, client, "c", 5), (said, member, "x.member", 6)):
        one = df.select(node.alias("id"), F.col(label).alias("label"), F.struct("rank", F.lit(step).alias("step")).alias("at"))
        names = one if names is None else names.unionByName(one)
    told = names.groupBy("id").agg(F.max_by("label", F.struct("at", "label")).alias("label"))
    return told.join(nodes(links), "id"), links


def incident(links: DataFrame, node: str) -> DataFrame:
    """Edges at a node, with the other end."""
    return links.where((F.col("src") == node) | (F.col("dst") == node)).withColumn("other", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))


def labelled(named: DataFrame, least: int = 2) -> DataFrame:
    """Nodes with the label that a drawing shows: firms of a degree below ``least`` have none."""
    return named.withColumn("shown", F.when((F.col("type") != "firm") | (F.col("degree") >= least), F.col("label")))


def document(named: DataFrame, links: DataFrame) -> str:
    """Nodes and links as the JSON that force layouts read; both are limited by the caller."""
    import json

    body = {"nodes": [r.asDict() for r in named.orderBy("id").collect()], "links": [{"source": r.src, "target": r.dst, "type": r.type, "weight": r.weight} for r in links.orderBy("src", "dst", "type").collect()]}
    return json.dumps(body, ensure_ascii=False, indent=1)
