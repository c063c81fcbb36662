"""What the reports and screens compute: evidence attached to findings, filters, pairs and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Statuses that count as sent on the front page, and the groups of the status filter.
SENT = ["sent", "acknowledged", "awaiting_substantive", "responded", "closed_response", "closed_no_response", "escalated_to_counsel", "no_response_by_deadline"]


def finding_key(lobbyist: Column, agency: Column) -> list[Column]:
    """The key by which cases name findings: names in capitals, agencies in small letters, nulls as empty."""
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return [F.upper(tidy(lobbyist)), F.lower(tidy(agency))]


def enrich(findings: DataFrame, evidence: DataFrame, column: str, order: Column, lobbyist: str = "lobbyist_name", agency: str = "agency_short") -> DataFrame:
    """``findings`` with ``column`` of the ``evidence`` row of the same key that comes last by ``order``; null without one. The evidence is one row a key before it is joined, so findings never multiply."""
    keys = finding_key(F.col(lobbyist), F.col(agency))
    last = evidence.groupBy(keys[0].alias("__l"), keys[1].alias("__a")).agg(F.max_by(column, order).alias(column))
    return findings.drop(column).join(last, (keys[0] == F.col("__l")) & (keys[1] == F.col("__a")), "left").drop("__l", "__a")


def grouped_matches(matches: DataFrame, case: str = "case_id", client: str = "client", newest: str = "date", tie: str = "doc_id", cap: int = 5) -> DataFrame:
    """One row a case: ``n_matches_total, n_clients_with_matches`` and ``by_client``, clients with most matches first, each with its number and its ``cap`` newest."""
    best = Window.partitionBy(case, client).orderBy(F.desc(newest), tie)
    first = matches.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= cap)
    count = matches.groupBy(case, client).agg(F.count(F.lit(1)).alias("n_matches"))
    listed = first.groupBy(case, client).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", F.col(newest).alias("date"), F.col(tie).alias("id")))), lambda m: F.struct(m["date"], m["id"])).alias("matches"))
    clients = count.join(listed, [case, client]).withColumn("__order", F.struct((-F.col("n_matches")).alias("n"), F.col(client).alias("c")))
    by_client = F.transform(F.array_sort(F.collect_list(F.struct("__order", F.col(client).alias("client"), "n_matches", "matches"))), lambda c: F.struct(c["client"], c["n_matches"], c["matches"]))
    return clients.groupBy(case).agg(F.sum("n_matches").alias("n_matches_total"), F.count(F.lit(1)).alias("n_clients_with_matches"), by_client.alias("by_client"))


def overlaps(names: Column, clients: list[str]) -> Column:
    """Whether some of ``names`` (an array) contains one of ``clients`` or lies in it, letters' case aside. The clients of a case file are literals, so nothing is joined."""
    wanted = [c.upper() for c in clients if c]
    either = lambda t: F.lit(False) if not wanted else F.greatest(*(F.contains(F.upper(t), F.lit(c)) | F.contains(F.lit(c), F.upper(t)) for c in wanted), F.lit(False))
    return F.coalesce(F.exists(names, either), F.lit(False))


def fallback(findings: DataFrame, entries: DataFrame, payload: str, firm: str = "registrant_name", rank: str = "rank", entry_firm: str = "firm", ranks: str = "scan_rank", pos: str = "pos") -> DataFrame:
    """``findings`` with ``payload`` of the first entry of the same firm, or else of the first that names the finding's rank."""
    name = lambda c: F.upper(F.trim(c))
    by_firm = entries.groupBy(name(F.col(entry_firm)).alias("__firm")).agg(F.min_by(payload, pos).alias("__by_firm"))
    by_rank = entries.select(F.explode(ranks).alias("__rank"), payload, pos).groupBy("__rank").agg(F.min_by(payload, pos).alias("__by_rank"))
    both = findings.join(by_firm, name(F.col(firm)) == F.col("__firm"), "left").join(by_rank, F.col(rank) == F.col("__rank"), "left")
    return both.withColumn(payload, F.coalesce("__by_firm", "__by_rank")).drop("__firm", "__by_firm", "__rank", "__by_rank")


def entries_with(entries: DataFrame, query: str = "", kind: str = "all") -> DataFrame:
    """Entries (``type, name, hint, summary, tags``) of a kind whose name, hint, summary or a tag contains the query, letters' case aside."""
    out = entries if kind == "all" else entries.where(F.col("type") == kind)
    q = query.strip().upper()
    if not q:
        return out
    has = lambda c: F.contains(F.upper(c), F.lit(q))
    return out.where(F.coalesce(has(F.col("name")), F.lit(False)) | F.coalesce(has(F.col("hint")), F.lit(False)) | F.coalesce(has(F.col("summary")), F.lit(False)) | F.coalesce(F.exists("tags", has), F.lit(False)))


def visible_graph(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given types, and the edges between them."""
    shown = nodes.where(F.col("type").isin(kinds))
    ids = shown.select("id")
    return shown, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def pairs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``<key>, a, b`` (``a < b``): the different values that go by one key, two at a time."""
    once = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).alias("a")).distinct()
    return once.join(once.withColumnRenamed("a", "b"), key).where("a < b")


def neighbours(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Hard negatives ``a, b``: values of different keys that stand next to each other among those with the same first word, in order of a hash; one pair a value at most."""
    once = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct().withColumn("__w", F.split_part(F.lower(value), F.lit(" "), F.lit(1)))
    along = Window.partitionBy("__w").orderBy(F.xxhash64(key, value), key, value)
    return once.withColumn("b", F.lead(value).over(along)).withColumn("__k", F.lead(key).over(along)).where(F.col("__k") != F.col(key)).select(F.col(value).alias("a"), "b")


def figures(rows: DataFrame, expected: Column, got: Column, *by: str) -> DataFrame:
    """True and false positives and negatives, precision, recall and F1 by group; a ratio of nothing is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counted = rows.groupBy(*by).agg(F.count_if(expected & got).alias("tp"), F.count_if(expected & ~got).alias("fn"), F.count_if(~expected & got).alias("fp"), F.count_if(~expected & ~got).alias("tn"))
    out = counted.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def coverage(positions: DataFrame, position: str, keywords: dict[str, str], senior: str, caught: Column) -> DataFrame:
    """``agency, pool, matched, coverage``: of the distinct senior positions that name an agency by its keywords, those that ``caught`` (an array of agencies) has too."""
    once = positions.select(position).distinct().withColumn("__caught", caught)
    named = F.array_compact(F.array(*(F.when(F.col(position).rlike("(?iu)" + words), F.lit(agency)) for agency, words in keywords.items())))
    rows = once.where((F.length(position) > 10) & F.col(position).rlike("(?iu)" + senior)).select("__caught", F.explode(named).alias("agency"))
    out = rows.groupBy("agency").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.array_contains("__caught", F.col("agency"))).alias("matched"))
    return out.withColumn("coverage", F.col("matched") / F.col("pool"))


def fragment_coverage(entities: DataFrame, name: str, fragments: list[tuple[str, str]]) -> DataFrame:
    """``short, n, example, n_rows``: distinct entity names that hold a fragment, and the most frequent of them; 0 and null where none does."""
    counted = entities.groupBy(name).agg(F.count(F.lit(1)).alias("c"))
    found = F.array_compact(F.array(*(F.when(F.col(name).ilike(f"%{fragment}%"), F.lit(short)) for short, fragment in fragments)))
    hits = counted.select(name, "c", F.explode(found).alias("short")).groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("c", name)).alias("top"))
    every = entities.sparkSession.createDataFrame([(s,) for s, _ in fragments], "short string")  # the registry
    return every.join(hits, "short", "left").select("short", F.coalesce("n", F.lit(0)).alias("n"), F.col(f"top.{name}").alias("example"), F.col("top.c").alias("n_rows"))


def landing(findings: DataFrame, trails: DataFrame, matches: DataFrame, entries: DataFrame, sent: list[str] | None = None) -> DataFrame:
    """The front page's numbers, one row."""
    one = findings.agg(F.count_distinct("agency").alias("agencies"))
    two = trails.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("traced"), F.coalesce(F.sum("discretionary_amount"), F.lit(0.0)).alias("discretionary"))
    three = matches.agg(F.count(F.lit(1)).alias("press_matches"), F.count_distinct("member_name").alias("legislators"))
    four = entries.agg(F.count_if(F.col("status").isin(sent or SENT)).alias("sent"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)  # one row each


def usd(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def hundredths(x: Column) -> Column:
    """A positive double to two digits, by its hundredths as doubles: ``format_string`` rounds the shortest decimal instead, which takes 8.495 up although the double is less."""
    y = x * 100
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / 100


def compact_usd(amount: Column) -> Column:
    return F.when(amount >= 1_000_000_000, F.format_string("$%.2fB", hundredths(amount / 1_000_000_000))).when(amount >= 1_000_000, F.format_string("$%.0fM", amount / 1_000_000)).otherwise(usd(amount))


def member_label(name: Column, party: Column, state: Column, chamber: Column) -> Column:
    """``Name (P-ST-C)``, question marks for what is unknown."""
    initial = lambda c: F.coalesce(F.nullif(F.substring(c, 1, 1), F.lit("")), F.lit("?"))
    return F.concat(name, F.lit(" ("), initial(party), F.lit("-"), F.coalesce(F.nullif(state, F.lit("")), F.lit("??")), F.lit("-"), initial(chamber), F.lit(")"))


def sample(df: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """``n`` rows drawn evenly; equal for equal rows and seed, since a row's draw is a hash of its contents."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))), *df.columns).limit(n)


def catalog(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """``table_name, column_name, data_type, position`` of the session's views and tables."""
    found = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() if names is None or t.name in names for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(found, "table_name string, column_name string, data_type string, position int")
