"""Reports and screens on the star schema: evidence on findings, filters, quality figures, the registry scan, and the graph built from findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions import registry
from daybook.functions import text as T
from daybook.operators import graph, mentions, reports, scan
from daybook.operators.durable import save
from daybook.plans import register
from daybook.plans.bind import FILINGS, LINES, PRESS, Bound, sql

#: Offices that parts stand for: the brand's agency as positions name it, and a title by the part's size. The last brand has no agency.
_NAMES = ["NASA", "EPA", "FDA", "FCC", "SEC", "FTC", "Department of Defense", "Treasury", "HHS", "DHS", "Interior", "DOE", "State Department", "DOT", "FAA", "FERC", "CFTC", "CFPB", "USDA", "Veterans Affairs", "SBA", "OMB", "USTR", "CMS", "Widget Bureau"]
_TITLES = ["Chief of Staff", "General Counsel", "Aide", "Clerk"]
_SHORT = [e[0] for e in registry.AGENCIES] + ["none"]
_FRAGMENT = [e[1] for e in registry.AGENCIES] + ["Widgets"]
_REGISTRY = _SHORT[:-1]
_SENIORITY = [e[2] for e in registry.AGENCIES] + [0]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + "]"
_BRAND = "CAST(substr(entity_name, 7) AS INTEGER) % 25 + 1"
OFFICES = f"offices AS (SELECT filing_uuid, lobbyist_name, amount, {_LIST(_TITLES)}[part_size % 4 + 1] || ', ' || {_LIST(_NAMES)}[{_BRAND}] AS position, {_BRAND} AS brand, {_LIST(_FRAGMENT)}[{_BRAND}] || ' (' || entity_name || ')' AS entity FROM lines)"
#: What the positions of the table above mean, for the SQL; the plan reads them with the registry's patterns.
MEANING = f"meaning AS (SELECT t || ', ' || {_LIST(_NAMES)}[i] AS position, {_LIST(_SHORT)}[i] AS agency_short, {_LIST(_FRAGMENT)}[i] AS fragment, {_LIST(_SENIORITY)}[i] AS seniority FROM (SELECT unnest({_LIST(_TITLES[:2])}) AS t), (SELECT unnest(range(1, 25)) AS i))"
MIN_FILINGS, MIN_CONC = 5, 0.10


def _pick(values: list, at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int"))


def offices(b: Bound) -> DataFrame:
    """``filing_uuid, lobbyist_name, amount, position, entity``: lines with an office in place of the part, and the masks of the registry's agencies that the entity names, read once a part."""
    brand = F.substring("p_brand", 7, 9).cast("int") % 25 + 1
    position = F.concat(_pick(_TITLES, F.col("p_size") % 4 + 1), F.lit(", "), _pick(_NAMES, brand))
    entity = F.concat(_pick(_FRAGMENT, brand), F.lit(" ("), "p_brand", F.lit(")"))
    targets = F.array_compact(F.array(*(F.when(entity.ilike(f"%{fragment}%"), F.lit(short)) for short, fragment, *_ in registry.AGENCIES)))
    marks = scan.masks(targets, _REGISTRY)
    return b.lines_with({"position": position, "entity": entity, **marks}).select("filing_uuid", "lobbyist_name", "amount", "position", "entity", *marks)


_FOUND = f""", once AS (SELECT DISTINCT lobbyist_name, registrant_name, filing_uuid, client_name FROM offices JOIN filings USING (filing_uuid)),
prof AS (SELECT lobbyist_name, registrant_name, max(position) AS position, count(DISTINCT filing_uuid) AS total_filings, max(CAST(filing_uuid AS VARCHAR)) AS sample_uuid, max('filings/' || filing_year || '/' || filing_period || '/' || filing_uuid || '.json') AS sample_source, sum(income) AS total_income FROM offices JOIN filings USING (filing_uuid) GROUP BY 1, 2),
told AS (SELECT * FROM prof JOIN meaning USING (position) WHERE total_filings >= {MIN_FILINGS}),
named AS (SELECT DISTINCT filing_uuid, m.agency_short FROM offices JOIN (SELECT DISTINCT agency_short, fragment FROM meaning) m ON entity ILIKE '%' || m.fragment || '%'),
cc AS (SELECT lobbyist_name, registrant_name, agency_short, client_name, count(*) AS n FROM once JOIN named USING (filing_uuid) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY lobbyist_name, registrant_name, agency_short ORDER BY n DESC, client_name) AS k, sum(n) OVER (PARTITION BY lobbyist_name, registrant_name, agency_short) AS agency_filings FROM cc),
tops AS (SELECT lobbyist_name, registrant_name, agency_short, CAST(max(agency_filings) AS BIGINT) AS agency_filings, string_agg(client_name, ' | ' ORDER BY k) AS top_clients_str FROM rk WHERE k <= 5 GROUP BY 1, 2, 3),
cand AS (SELECT *, CAST(agency_filings AS DOUBLE) / total_filings AS share FROM told JOIN tops USING (lobbyist_name, registrant_name, agency_short))
, found AS (SELECT lobbyist_name, registrant_name, agency_short, position AS covered_position, sample_uuid, sample_source, total_filings, agency_filings, top_clients_str, round(total_income, 2) AS total_income, round(share, 4) AS concentration, round(share * ln(total_filings + 1) * seniority, 4) AS score FROM cand WHERE share >= {MIN_CONC})
, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, lobbyist_name, registrant_name, agency_short) AS rank FROM found ORDER BY score DESC, lobbyist_name, registrant_name, agency_short LIMIT 40)"""
_SCAN = (FILINGS, LINES, OFFICES, MEANING)


_KEYS = "lobbyist_name", "registrant_name", "agency_short"


def findings(b: Bound, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Appearances (with the columns ``more``), and the findings of the registry scan: positions name agencies by the registry's patterns, filings by its fragments, and seniority is the registry's."""
    filings = b.filings.select("filing_uuid", "registrant_name", "client_name", "income", "filing_year", "filing_period", *(c for c in more if c == "segment"))
    lines = offices(b).withColumnRenamed("position", "covered_position").drop("entity", *({"amount"} - set(more)))
    once = scan.appearances(lines, filings, *_KEYS[:2], "filing_uuid")
    marks = F.explode(registry.agencies_of(F.col("covered_position")))
    meant = once.select("covered_position").distinct().select("covered_position", marks.alias("m")).select("covered_position", F.col("m.agency").alias("agency_short"), "m.seniority")
    meant = save(meant, "positions")  # each position is read once; few of them are broadcast
    passed = scan.shares(once, _REGISTRY, *_KEYS, MIN_FILINGS, MIN_CONC).join(meant, ["covered_position", "agency_short"])
    return once, scan.scored(passed, F.col("seniority")).drop("seniority")


def _best(found: DataFrame) -> DataFrame:
    return save(scan.ranked(found, [F.desc("score"), *_KEYS], 40), "best")


def top_findings(b: Bound) -> DataFrame:
    once, found = findings(b)
    path = F.concat(F.lit("filings/"), F.col("filing_year").cast("string"), F.lit("/"), "filing_period", F.lit("/"), F.col("filing_uuid").cast("string"), F.lit(".json"))
    out = scan.detailed(once, _REGISTRY, _best(found), *_KEYS, "filing_uuid", path).withColumn("total_income", F.round("total_income", 2))
    return out.select(*_KEYS, "covered_position", "sample_uuid", "sample_source", "total_filings", "agency_filings", "top_clients_str", "total_income", "concentration", "score", "rank")


@register("o34_registry", sql(_FOUND + " SELECT * FROM ranked", *_SCAN))
def registry_scan(spark, sf_dir) -> DataFrame:
    return top_findings(Bound(spark, sf_dir))


@register("j2", sql(_FOUND + " SELECT agency_short, count(*) AS n FROM found GROUP BY 1", *_SCAN))
def registry_hits(spark, sf_dir) -> DataFrame:
    return findings(Bound(spark, sf_dir))[1].groupBy("agency_short").agg(F.count(F.lit(1)).alias("n"))


@register("d18", sql(f" SELECT agency_short AS agency, count(*) AS pool, count(*) FILTER (position NOT LIKE 'Clerk%') AS matched, count(*) FILTER (position NOT LIKE 'Clerk%') / count(*) AS coverage FROM (SELECT DISTINCT position, {_LIST(_SHORT)}[brand] AS agency_short FROM offices WHERE brand < 25 AND position NOT LIKE 'Aide%' AND length(position) > 10) GROUP BY 1", LINES, OFFICES))
def registry_coverage(spark, sf_dir) -> DataFrame:
    """Of the positions that name an agency and a title of rank, how many the registry catches; clerks are none of its titles."""
    words = {short: rf"\b{name}\b" for short, name in zip(_SHORT[:24], _NAMES[:24], strict=True)}
    caught = F.transform(registry.agencies_of(F.col("position")), lambda a: a["agency"])
    return reports.coverage(offices(Bound(spark, sf_dir)), "position", words, r"\b(Chief of Staff|General Counsel|Clerk)\b", caught)


@register("m8", sql(f" SELECT short, coalesce(n, 0) AS n, example, n_rows FROM (SELECT unnest({_LIST(_SHORT[:24])}) AS short) LEFT JOIN (SELECT {_LIST(_SHORT)}[brand] AS short, count(*) AS n, max({{'c': c, 'e': entity}}).e AS example, max({{'c': c, 'e': entity}}).c AS n_rows FROM (SELECT brand, entity, count(*) AS c FROM offices GROUP BY 1, 2) GROUP BY 1) USING (short)", LINES, OFFICES))
def fragment_coverage(spark, sf_dir) -> DataFrame:
    return reports.fragment_coverage(offices(Bound(spark, sf_dir)), "entity", [(e[0], e[1]) for e in registry.AGENCIES])


# Cases: every client's trail of awards belongs to the case of its segment, which names the finding of one lobbyist and agency.
_CASES = ", trails AS (SELECT segment AS case_id, client_name AS label, round(sum(amount), 2) AS total FROM lines JOIN filings USING (filing_uuid) GROUP BY 1, 2), cases AS (SELECT case_id, count(*) AS n_clients, round(sum(total), 2) AS dollars FROM trails GROUP BY 1), matched AS (SELECT DISTINCT segment AS case_id, lobbyist_name, agency_short FROM ranked JOIN offices USING (lobbyist_name) JOIN filings USING (filing_uuid, registrant_name))"


def _evidence(once: DataFrame, found: DataFrame) -> DataFrame:
    cases = once.groupBy("segment", "client_name").agg(F.round(F.sum("amount"), 2).alias("total")).groupBy("segment").agg(F.struct(F.count(F.lit(1)).alias("n_clients"), F.round(F.sum("total"), 2).alias("dollars")).alias("trail"))
    matched = once.join(F.broadcast(found.select("lobbyist_name", "registrant_name", "agency_short")), ["lobbyist_name", "registrant_name"])  # forty findings
    return matched.select("segment", F.lower("lobbyist_name").alias("lobbyist_name"), F.upper("agency_short").alias("agency_short")).distinct().join(cases, "segment")


@register("c18", sql(_FOUND + _CASES + ", last AS (SELECT lobbyist_name, agency_short, max(case_id) AS case_id FROM matched GROUP BY 1, 2) SELECT rank, ranked.lobbyist_name, ranked.agency_short, case_id, n_clients, dollars FROM ranked LEFT JOIN last USING (lobbyist_name, agency_short) LEFT JOIN cases USING (case_id)", *_SCAN))
def enriched_findings(spark, sf_dir) -> DataFrame:
    """Findings with the trail of the last case that names them; cases write names in another case than the scan does."""
    once, found = findings(Bound(spark, sf_dir), ("amount", "segment"))
    found = _best(found)
    evidence = _evidence(once, found).select("lobbyist_name", "agency_short", F.struct("segment", "trail").alias("evidence"))
    out = reports.enrich(found, evidence, "evidence", F.col("evidence.segment"))
    return out.select("rank", "lobbyist_name", "agency_short", F.col("evidence.segment").alias("case_id"), F.col("evidence.trail.n_clients").alias("n_clients"), F.col("evidence.trail.dollars").alias("dollars"))


_OVERLAP = " OR ".join(f"contains(upper(t), '{c}') OR contains('{c}', upper(t))" for c in ("CUSTOMER#00000001", "THE CUSTOMER#000000002 COMPANY"))


@register("c19", sql(_FOUND + f" SELECT rank, lobbyist_name FROM ranked WHERE list_bool_or(list_transform(string_split(top_clients_str, ' | '), lambda t: {_OVERLAP}))", *_SCAN))
def overlapping_findings(spark, sf_dir) -> DataFrame:
    """Findings with a top client that a case's client contains or lies in."""
    found = top_findings(Bound(spark, sf_dir))
    return found.where(reports.overlaps(F.split("top_clients_str", r" \| "), ["Customer#00000001", "the Customer#000000002 company"])).select("rank", "lobbyist_name")


@register("c20", sql(_FOUND + ", e AS (SELECT n_nationkey AS pos, lower(n_name) AS firm, n_nationkey * 2 AS a, n_nationkey * 2 + 1 AS b FROM nation WHERE n_nationkey % 2 = 0), by_firm AS (SELECT upper(firm) AS k, min(pos) AS p FROM e GROUP BY 1), by_rank AS (SELECT r, min(pos) AS p FROM (SELECT pos, a AS r FROM e UNION ALL SELECT pos, b FROM e) GROUP BY 1) SELECT rank, registrant_name, CAST(coalesce(f.p, r.p) AS BIGINT) AS entry FROM ranked LEFT JOIN by_firm f ON f.k = upper(registrant_name) LEFT JOIN by_rank r ON r.r = rank", *_SCAN))
def findings_with_entries(spark, sf_dir) -> DataFrame:
    """The log entry of a finding's firm, or else one that lists its rank. Every second nation has an entry, with two ranks."""
    b = Bound(spark, sf_dir)
    key = F.col("n_nationkey").cast("long")
    entries = b.table("nation").where("n_nationkey % 2 = 0").select(key.alias("pos"), key.alias("entry"), F.lower("n_name").alias("firm"), F.array(key * 2, key * 2 + 1).alias("scan_rank"))
    return reports.fallback(top_findings(b), entries, "entry").select("rank", "registrant_name", "entry")


_ENTRIES = "WITH e AS (SELECT 'client' AS type, c_name AS name, c_mktsegment AS hint, n_name AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'agency', p_brand, p_type, p_name FROM part)"


def _entries(b: Bound) -> DataFrame:
    clients = b.table("customer").join(F.broadcast(b.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("client").alias("type"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("hint"), F.lit(None).cast("string").alias("summary"), F.array("n_name").alias("tags"))
    return clients.unionByName(b.table("part").select(F.lit("agency").alias("type"), F.col("p_brand").alias("name"), F.col("p_type").alias("hint"), F.lit(None).cast("string").alias("summary"), F.array("p_name").alias("tags")))


@register("b14", _ENTRIES + " SELECT type, name, hint, tag FROM e WHERE contains(upper(name), 'RING') OR contains(upper(hint), 'RING') OR contains(upper(tag), 'RING')")
def search_entries(spark, sf_dir) -> DataFrame:
    return reports.entries_with(_entries(Bound(spark, sf_dir)), " ring ").select("type", "name", "hint", F.col("tags")[0].alias("tag"))


_MADE = ", hired AS (SELECT DISTINCT 'lobbyist:' || upper(lobbyist_name) AS src, 'client:' || upper(trim(c)) AS dst, rank FROM (SELECT rank, lobbyist_name, unnest(string_split(top_clients_str, '|')) AS c FROM ranked)), made AS (SELECT 'works_at' AS type, 'lobbyist:' || upper(lobbyist_name) AS src, 'firm:' || upper(registrant_name) AS dst, 1.0 AS w, rank FROM ranked UNION ALL SELECT 'former_official_of', 'lobbyist:' || upper(lobbyist_name), 'agency:' || upper(agency_short), concentration, rank FROM ranked UNION ALL SELECT 'lobbies_for', src, dst, 1.0, rank FROM hired), graph AS (SELECT type, src, dst, CAST(CASE WHEN type = 'lobbies_for' THEN sum(w) ELSE arg_max(w, rank) END AS DOUBLE) AS weight FROM made GROUP BY 1, 2, 3)"


def _graph(b: Bound, rank: int | None = None) -> tuple[DataFrame, DataFrame]:
    none = lambda kind: F.array().cast(kind)
    found = save(top_findings(b), "findings").select("rank", "lobbyist_name", "registrant_name", "agency_short", "concentration", F.split("top_clients_str", r"\|").alias("clients"), none("array<struct<label:string,total:double>>").alias("trail"), none("array<struct<client:string,member:string>>").alias("mentions"))
    return graph.from_findings(found, rank)


@register("k1", sql(_FOUND + _MADE + " SELECT * FROM graph", *_SCAN))
def findings_graph(spark, sf_dir) -> DataFrame:
    return _graph(Bound(spark, sf_dir))[1].select("type", "src", "dst", "weight")


_EVIDENCE = ", of_finding AS (SELECT rank, agency_short, trim(c) AS c FROM (SELECT rank, agency_short, unnest(string_split(top_clients_str, '|')) AS c FROM ranked)), paid AS (SELECT client_name AS c, sum(income) AS total FROM filings GROUP BY 1), firms AS (SELECT DISTINCT client_name AS c, registrant_name AS m FROM filings), evidence AS (SELECT 'funded_by' AS type, 'agency:' || upper(agency_short) AS src, 'client:' || upper(c) AS dst, arg_max(total, rank) AS weight FROM of_finding JOIN paid USING (c) GROUP BY 1, 2, 3 UNION ALL SELECT 'mentions', 'legislator:' || upper(m), 'client:' || upper(c), CAST(count(*) AS DOUBLE) FROM of_finding JOIN firms USING (c) GROUP BY 1, 2, 3)"


def _with_evidence(b: Bound) -> DataFrame:
    """Findings with a trail and mentions: what each of their clients reported, and the firms that filed for it in the members' place. At most five clients a finding."""
    found = save(top_findings(b), "findings")
    clients = found.select("rank", F.explode(T.pieces(F.col("top_clients_str"))).alias("client_name"))
    filings = save(b.filings.join(F.broadcast(clients.select("client_name").distinct()), "client_name", "left_semi").select("client_name", "registrant_name", "income"), "filings")
    paid = filings.groupBy("client_name").agg(F.sum("income").alias("total"))
    trail = clients.join(paid, "client_name").groupBy("rank").agg(F.collect_list(F.struct(F.col("client_name").alias("label"), "total")).alias("trail"))
    firms = filings.select("client_name", F.col("registrant_name").alias("member")).distinct()
    said = clients.join(firms, "client_name").groupBy("rank").agg(F.collect_list(F.struct(F.col("client_name").alias("client"), "member")).alias("mentions"))
    return found.select("rank", "lobbyist_name", "registrant_name", "agency_short", "concentration", T.pieces(F.col("top_clients_str")).alias("clients")).join(trail, "rank", "left").join(said, "rank", "left")


@register("k1_evidence", sql(_FOUND + _MADE + _EVIDENCE + " SELECT type, src, dst, round(weight, 2) AS weight FROM (SELECT * FROM graph UNION ALL SELECT * FROM evidence)", *_SCAN))
def evidence_graph(spark, sf_dir) -> DataFrame:
    """The graph with edges of all five kinds."""
    return graph.from_findings(_with_evidence(Bound(spark, sf_dir)))[1].select("type", "src", "dst", F.round("weight", 2).alias("weight"))


@register("k9", sql(_FOUND + _MADE.replace("FROM ranked", "FROM ranked WHERE rank = 3") + ", ends AS (SELECT src AS id FROM graph UNION ALL SELECT dst FROM graph) SELECT id, count(*) AS degree FROM ends GROUP BY 1", *_SCAN))
def one_finding_graph(spark, sf_dir) -> DataFrame:
    return _graph(Bound(spark, sf_dir), 3)[0].select("id", "degree")


@register("b15", sql(_FOUND + _MADE + " SELECT type, src, dst, weight FROM graph WHERE type IN ('works_at', 'lobbies_for') AND split_part(dst, ':', 1) = 'firm'", *_SCAN))
def shown_edges(spark, sf_dir) -> DataFrame:
    """The edges between nodes of the types that are switched on."""
    named, links = _graph(Bound(spark, sf_dir))
    return reports.visible_graph(named, links, ["lobbyist", "firm"])[1].select("type", "src", "dst", "weight")


@register("d8", "SELECT DISTINCT a.c_nationkey, a.c_mktsegment AS a, b.c_mktsegment AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment < b.c_mktsegment")
def name_pairs(spark, sf_dir) -> DataFrame:
    return reports.pairs(Bound(spark, sf_dir).table("customer"), "c_nationkey", "c_mktsegment")


@register("d17", "SELECT lang, tp, fn, fp, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 0 AND n_chars <= 1000) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def quality_figures(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.table("documents").select("doc_id", "lang", "n_chars").join(b.table("labels"), "doc_id")
    out = reports.figures(rows, F.col("quality") == 1, F.col("n_chars") > 1000, "lang")
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


@register("d16", sql(_FOUND + " SELECT (SELECT count(DISTINCT agency_short) FROM ranked) AS agencies, (SELECT round(sum(amount), 2) FROM lines) AS traced, (SELECT round(coalesce(sum(amount) FILTER (general_issue_code NOT LIKE 'PROMO%'), 0), 2) FROM lines) AS discretionary, (SELECT count(*) FROM press WHERE text ILIKE '%license%') AS press_matches, (SELECT count(DISTINCT member_name) FROM press WHERE text ILIKE '%license%') AS legislators, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'signup') AS sent", *_SCAN, PRESS))
def front_page(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    trails = b.lines.agg(F.sum("amount").alias("total"), F.coalesce(F.sum(F.when(~F.col("general_issue_code").startswith("PROMO"), F.col("amount"))), F.lit(0.0)).alias("discretionary_amount"))
    entries = b.table("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", "sent").otherwise("draft")).alias("status"))
    out = reports.landing(_best(findings(b)[1]).withColumnRenamed("agency_short", "agency"), trails, b.press.where(F.col("text").ilike("%license%")), entries)
    return out.withColumn("traced", F.round("traced", 2)).withColumn("discretionary", F.round("discretionary", 2))


@register("f4", "SELECT doc_id, lang FROM documents ORDER BY coalesce(lang, '') DESC, doc_id LIMIT 50")
def substituted_order(spark, sf_dir) -> DataFrame:
    return Bound(spark, sf_dir).table("documents").select("doc_id", "lang").orderBy(F.desc(F.coalesce("lang", F.lit(""))), "doc_id").limit(50)


@register("h21", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '$-' ELSE '$' END || trim(format('{:,.0f}', abs(round_even(c_acctbal, 0)))) AS usd, CASE WHEN c_acctbal * 1e6 >= 1e9 THEN format('${:.2f}B', round(c_acctbal * 1e6 / 1e9, 2)) WHEN c_acctbal * 1e6 >= 1e6 THEN format('${:.0f}M', round(c_acctbal * 1e6 / 1e6)) END AS compact, c_name || ' (' || substr(c_mktsegment, 1, 1) || '-' || substr(n_name, 1, 2) || '-?)' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def formatted(spark, sf_dir) -> DataFrame:
    b = Bound(spark, sf_dir)
    rows = b.table("customer").join(F.broadcast(b.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    big = F.col("c_acctbal") * 1e6
    label = reports.member_label(F.col("c_name"), F.col("c_mktsegment"), F.substring("n_name", 1, 2), F.lit(None).cast("string"))
    return rows.select("c_custkey", reports.usd(F.col("c_acctbal")).alias("usd"), F.when(big >= 1e6, reports.compact_usd(big)).alias("compact"), label.alias("label"))


@register("a25", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('17|' || o_orderkey || '|' || o_custkey), 1, 2 LIMIT 5")
def sampled(spark, sf_dir) -> DataFrame:
    """Five rows drawn by a digest of each row, so the same ones every time."""
    return reports.sample(Bound(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey"), 5)


@register("b7", sql("SELECT doc_id, member_name, party, date FROM press WHERE date >= '2022-06-01' AND date <= '2023-12-31' AND party = 'en' AND lower(domain) LIKE '%e%'", PRESS))
def filtered_press(spark, sf_dir) -> DataFrame:
    return mentions.filtered(Bound(spark, sf_dir).press, since="2022-06-01", until="2023-12-31", party="en", domain_contains="E").select("doc_id", "member_name", "party", "date")
