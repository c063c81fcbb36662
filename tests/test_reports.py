"""Builds, cases, reports, evidence on findings, the findings graph, the log's growth and the stream's deadline."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from daybook.operators import awards, graph, reports, resolve, status
from daybook.sources import build, cases, filings, sinks
from daybook.streaming.status import statuses
from tests.test_sources import FILING, LEGACY, MODERN


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "raw"
    for name, n in (("press/a.jsonl", 1), ("press/b.jsonl", 1), ("press/2024/c.jsonl", 2), ("press/2025/d.jsonl", 1), ("press/2025/e.jsonl", 1), ("press/2019/f.jsonl", 5)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("\n".join(json.dumps({"title": f"{name} {i}", "date": "2025-01-02"}) for i in range(n)))
    for year in (2024, 2025):
        (root / f"senate/filings/{year}").mkdir(parents=True)
        (root / f"senate/filings/{year}/f.json").write_text(json.dumps([FILING | {"filing_uuid": f"u{year}"}]))
    for quarter in ("2025_1stQuarter_XML", "2025_2ndQuarter_XML"):
        (root / f"house/{quarter}").mkdir(parents=True)
        for i, body in enumerate((MODERN, LEGACY, "<broken")):
            (root / f"house/{quarter}/{quarter[5]}{i}.xml").write_text(body)
    return str(root), str(tmp_path / "out")


def test_build_modes(spark, corpus):
    root, out = corpus
    assert len(build.press_files(spark, f"{root}/press")) == 5 and len(build.press_files(spark, f"{root}/press", sample=True)) == 2
    assert build.build(spark, root, out, sample=True, views=False) == []
    assert spark.read.parquet(f"{out}/senate_filings").count() == 1 and spark.read.parquet(f"{out}/press_releases").count() == 2
    names = build.build(spark, root, out, clean=True)
    assert {"revolving_door", "senate_spend_by_issue", "house_filings"} <= set(names) and "senate_contributions" not in names
    assert spark.table("senate_filings").count() == 2 and spark.table("press_releases").count() == 6 and spark.table("house_filings").count() == 4
    assert {(r.general_issue_code, r.filings) for r in spark.table("senate_spend_by_issue").collect()} == {("AGR", 2), ("TAX", 2)}
    assert spark.table("revolving_door").count() == 0  # its one position is blank
    assert build.lacking(spark, ["senate_filings", "nowhere", "revolving_door"]) == ["nowhere"]
    assert {(r.column_name, r.data_type) for r in reports.catalog(spark, ["senate_gov_entities"]).collect()} >= {("entity_name", "string"), ("activity_idx", "bigint")}
    assert build.build(spark, root, out, write=False) == names


def test_rebuild_of_a_quarter(spark, corpus):
    root, out = corpus
    told = build.rebuild_house(spark, root, out, ["2025_1stQuarter_XML", "2025_2ndQuarter_XML"])
    assert {(r.filing_period, r.files, r.broken) for r in told.collect()} == {("Q1", 3, 1), ("Q2", 3, 1)}
    build.rebuild_house(spark, root, out, ["2025_2ndQuarter_XML"])
    rows = {r.filing_period: r.n for r in spark.read.parquet(f"{out}/house_filings").groupBy("filing_period").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows == {"Q1": 2, "Q2": 2} and spark.read.parquet(f"{out}/house_lobbyists").count() == 4


def test_files_of_different_age(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, old string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(2, 3.0)], "id int, fresh double").write.mode("append").parquet(str(tmp_path / "t"))
    filings.register_tables(spark, str(tmp_path), ["t"])
    assert sorted(tuple(r) for r in spark.table("t").select("id", "old", "fresh").collect()) == [(1, "a", None), (2, None, 3.0)]


def test_cases_are_filled_and_checked(spark, tmp_path):
    def write(**more):
        body = {"label": "l", "lobbyist": "L", "agency": "usda", "award_groups": ["loans"], "clients": [{"name": "N", "label": "n", "search": "s", "name_tokens": ["N"]}]} | more
        (tmp_path / "c.json").write_text(json.dumps(body))
        return str(tmp_path / "c.json")

    row = cases.press_case(spark, write(filters={"party": "D"})).first()
    assert (row.clients[0].aliases, row.filters.since, row.filters.until, row.filters.party, row.filters.state) == (["N"], "2022-01-01", "2026-04-01", "D", None)
    assert cases.press_case(spark, write(clients=[{"name": "N", "aliases": ["A", "B"]}])).first().clients[0].aliases == ["A", "B"]
    assert cases.trace_case(spark, write()).first().agency == "usda"
    for more, said in (({"award_groups": ["gifts"]}, "gifts"), ({"clients": [{"label": "n"}]}, "client 0 lacks search"), ({"clients": []}, "clients")):
        with pytest.raises(ValueError, match=said):
            cases.trace_case(spark, write(**more))
    with pytest.raises(ValueError, match="client 0 lacks name"):
        cases.press_case(spark, write(clients=[{"aliases": ["A"]}]))


def test_awards_over_http(spark):
    """Overload is tried again, other errors give nothing; each group is one request with its own codes and order."""
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            group = next(g for g, codes in cases.AWARD_GROUPS.items() if codes == body["filters"]["award_type_codes"])
            code = 503 if group == "grants" and sum(b["filters"]["award_type_codes"] == cases.AWARD_GROUPS["grants"] for b in asked) < 3 else 404 if group == "direct" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"Award ID": group, "Award Amount": 5}]}).encode() if code == 200 else b"no")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(cases.Awards)
        options = {"url": f"http://127.0.0.1:{server.server_port}/", "groups": "grants,loans,direct", "client": "c", "search": "s", "agency": "A", "start": "2022-01-01", "end": "2023-01-01", "wait": "0.01"}
        got = spark.read.format("awards").options(**options).load().collect()
    finally:
        server.shutdown()
    assert sorted((r.client, r.award_id, r.amount) for r in got) == [("c", "grants", 5.0), ("c", "loans", 5.0)]
    assert {b["sort"] for b in asked if b["filters"]["award_type_codes"] == ["07", "08"]} == {"Recipient Name"} and len(asked) == 5
    assert asked[0]["limit"] == 100 and asked[0]["fields"] == cases.FIELDS


FOUND = "rank long, lobbyist_name string, registrant_name string, agency_short string, concentration double, clients array<string>, trail array<struct<label:string,total:double>>, mentions array<struct<client:string,member:string>>"


def found(spark):
    rows = [
        (1, "Ann", "Firm", "epa", 0.5, ["Acme", "Bolt"], [("Acme", 10.0)], [("Acme", "M (D-WI-S)"), ("Acme", "M (D-WI-S)")]),
        (2, "ann ", "Firm", "epa", 0.7, ["ACME", " "], [("acme", 30.0)], []),
        (3, "Bob", "Firm", "", 0.9, ["Acme"], [], []),
        (4, "Cid", "Firm", "nasa", None, ["Acme"], None, None),
    ]
    return spark.createDataFrame(rows, FOUND)


def test_graph_from_findings(spark):
    nodes, links = graph.from_findings(found(spark))
    got = {(r.type, r.src, r.dst): r.weight for r in links.collect()}
    assert got == {
        ("works_at", "lobbyist:ANN", "firm:FIRM"): 1.0, ("works_at", "lobbyist:CID", "firm:FIRM"): 1.0, ("former_official_of", "lobbyist:ANN", "agency:EPA"): 0.7, ("former_official_of", "lobbyist:CID", "agency:NASA"): 0.0,
        ("lobbies_for", "lobbyist:ANN", "client:ACME"): 2.0, ("lobbies_for", "lobbyist:ANN", "client:BOLT"): 1.0, ("lobbies_for", "lobbyist:CID", "client:ACME"): 1.0,
        ("funded_by", "agency:EPA", "client:ACME"): 30.0, ("mentions", "legislator:M (D-WI-S)", "client:ACME"): 2.0,
    }
    named = {r.id: (r.label, r.degree) for r in nodes.collect()}
    assert named["client:ACME"] == ("Acme", 4) and named["lobbyist:ANN"] == ("ann", 4) and named["firm:FIRM"] == ("Firm", 2)
    assert {r.shown for r in graph.labelled(nodes, 3).where("type = 'firm'").collect()} == {None}
    assert {r.other for r in graph.incident(links, "client:BOLT").collect()} == {"lobbyist:ANN"}
    one, few = graph.from_findings(found(spark), rank=4)
    assert {r.id for r in one.collect()} == {"lobbyist:CID", "firm:FIRM", "agency:NASA", "client:ACME"} and few.count() == 3
    body = json.loads(graph.document(one, few))
    assert len(body["nodes"]) == 4 and {x["type"] for x in body["links"]} == {"works_at", "former_official_of", "lobbies_for"}
    shown, inner = reports.visible_graph(nodes, links, ["lobbyist", "client"])
    assert {r.type for r in inner.collect()} == {"lobbies_for"} and shown.count() == 4


def test_evidence_on_findings(spark):
    rows = spark.createDataFrame([(1, "ANN", "epa", "F1 "), (2, "BOB", "EPA", "f2"), (3, None, "epa", "f3")], "rank int, lobbyist_name string, agency_short string, registrant_name string")
    proof = spark.createDataFrame([("Ann", "EPA ", 1, "old"), (" ann", "epa", 2, "new"), ("Cid", "epa", 3, "x")], "lobbyist_name string, agency_short string, at int, trail string")
    assert {r["rank"]: r.trail for r in reports.enrich(rows, proof, "trail", F.col("at")).collect()} == {1: "new", 2: None, 3: None}
    entries = spark.createDataFrame([(0, "f1", "a", []), (1, "other", "b", [2, 1]), (2, "F1", "c", [])], "pos int, firm string, entry string, scan_rank array<int>")
    assert {r["rank"]: r.entry for r in reports.fallback(rows, entries, "entry").collect()} == {1: "a", 2: "b", 3: None}
    tops = spark.createDataFrame([(["Acme Corp", "x"],), (["Ac"],), (["none"],), (None,)], "t array<string>")
    assert [r[0] for r in tops.select(reports.overlaps(F.col("t"), ["ACME", ""])).collect()] == [True, True, False, False]
    hits = spark.createDataFrame([("k", c, d, i) for i, (c, d) in enumerate([("A", "2024-01-01"), ("A", "2024-03-01"), ("B", "2024-02-01"), ("A", "2024-02-01")])], "case_id string, client string, date string, doc_id int")
    got = reports.grouped_matches(hits, cap=2).first()
    assert (got.n_matches_total, got.n_clients_with_matches) == (4, 2)
    assert [(c.client, c.n_matches, [m.date for m in c.matches]) for c in got.by_client] == [("A", 3, ["2024-03-01", "2024-02-01"]), ("B", 1, ["2024-02-01"])]


def test_search_and_samples(spark):
    rows = [("client", "Acme", "h", None, ["steel"]), ("agency", "EPA", "water", "s", []), ("client", None, None, None, None)]
    df = spark.createDataFrame(rows, "type string, name string, hint string, summary string, tags array<string>")
    names = lambda *a: sorted(str(r.name) for r in reports.entries_with(df, *a).collect())
    assert names("STEEL") == ["Acme"] and names("water", "client") == [] and names("") == ["Acme", "EPA", "None"] and names(" epa ", "agency") == ["EPA"]
    many = spark.range(200)
    one = [r.id for r in reports.sample(many, 7).collect()]
    assert one == [r.id for r in reports.sample(many.repartition(5), 7).collect()] and len(set(one)) == 7 and one != [r.id for r in reports.sample(many, 7, seed=1).collect()]


def test_formats(spark):
    row = spark.createDataFrame([(1234567.0, 2.5e9, 0.5, "N", "Democrat", "WI", None)], "a double, b double, c double, n string, p string, s string, h string").select(
        reports.usd(F.col("a")), reports.compact_usd(F.col("a")), reports.compact_usd(F.col("b")), reports.percent(F.col("c")), reports.member_label(F.col("n"), F.col("p"), F.col("s"), F.col("h"))
    )
    assert tuple(row.first()) == ("$1,234,567", "$1M", "$2.50B", "50.0%", "N (D-WI-?)")


def test_log_grows(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    events = spark.createDataFrame([("a", 0, "draft", None, at(1))], "key string, pos long, kind string, response_kind string, at timestamp")
    entries = spark.createDataFrame([("a", None), ("b", dt.date(2024, 5, 5)), ("c", None)], "key string, deadline date")
    new = spark.createDataFrame([("a", "sent", None, at(2), None), ("a", "ack", None, at(3), None), ("b", "sent", None, at(2), None), ("c", "sent", None, at(2), dt.date(2024, 3, 3)), ("zz", "sent", None, at(2), None)], "key string, kind string, response_kind string, at timestamp, deadline date")
    grown, dated = status.append(events, entries, new, "key")
    assert {(r.key, r.pos, r.kind) for r in grown.collect()} == {("a", 0, "draft"), ("a", 1, "sent"), ("a", 2, "ack"), ("b", 0, "sent"), ("c", 0, "sent")}
    assert {r.key: str(r.deadline) for r in dated.collect()} == {"a": "2024-01-09", "b": "2024-05-05", "c": "2024-03-03"}
    told = status.summaries(grown.join(dated, "key"), "key", F.lit("2024-02-01").cast("timestamp"), F.col("deadline").cast("timestamp"))
    assert [r.key for r in status.by_urgency(told, "key").collect()] == ["a", "b", "c"] and {r.key: r.status for r in told.collect()} == {"a": "no_response_by_deadline", "b": "sent", "c": "sent"}


def test_stream_deadline(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    schema = "user_id long, pos long, kind string, response_kind string, ts timestamp"
    days = [[(1, 0, "sent", None, at(1)), (2, 0, "sent", None, at(1))], [(2, 1, "response", "substantive", at(2)), (3, 0, "sent", None, at(6))], [(9, 0, "ack", None, at(10))], [(9, 1, "followup", None, at(11))]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = statuses(stream, days=7).writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        part = next((tmp_path / f"d{i}").glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.sql("select * from late").collect():
        seen.setdefault(r.user_id, []).append(r.status)
    assert seen[1] == ["sent", "no_response_by_deadline"] and seen[2] == ["sent", "responded"] and seen[3] == ["sent"] and seen[9][-1] == "followed_up"


def test_resolver_figures(spark, tmp_path):
    """Spellings of one registrant against names of others with the same first word."""
    words = ["Apex", "Border", "Cobalt", "Dune", "Eastern", "Falcon", "Granite", "Harbor", "Iron", "Juniper"]
    kinds = ["Energy Partners", "Water Alliance", "Steel Institute", "Medical Devices", "Rail Systems", "Grain Growers", "Software", "Defense Works", "Mining Council", "Farm Bureau"]
    named = []
    for i, w in enumerate(words):
        for j, k in enumerate(kinds):
            base, key = f"{w} {k}", 10 * i + j
            named += [(key, base), (key, f"{base.upper()}, INC."), (key, f"The {base} LLC"), (key, f"{base} (FKA {w[::-1]}ton {k[::-1]})")]
    rows = spark.createDataFrame(named, "id long, name string")
    mapped = resolve.write_entity_map(resolve.resolve_orgs(rows.select(F.col("name").alias("raw"), F.lit(1).alias("weight"))), str(tmp_path / "map"))
    same, other = reports.pairs(rows, "id", "name"), reports.neighbours(rows, "id", "name")
    figures = resolve.evaluate(mapped, same, other).first()
    assert same.count() == 600 and other.count() > 50 and figures.f1 >= 0.96 and figures.precision >= 0.99


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(9.5, "epa", "ANN", "F", "Chief", 0.5, 5, 10, "A | B", "u1")], "score double, agency_short string, lobbyist_name string, registrant_name string, covered_position string, concentration double, agency_filings int, total_filings int, top_clients_str string, sample_uuid string")
    sinks.findings_csv(rows, str(tmp_path / "f"))
    text = next((tmp_path / "f").glob("*.csv")).read_text().splitlines()
    assert text[0] == ",".join(sinks.FINDING) and text[1].startswith("9.5,epa,ANN") and len(sinks.FINDING) == 15
    assert "ANN — epa" in sinks.findings_draft(rows) and "5 of 10 filings at F (50.0%)" in sinks.findings_draft(rows)
    trails = spark.createDataFrame([("c", 2, 100.0, 40.0)], "client_name string, n_awards int, total double, discretionary_amount double")
    totals = spark.createDataFrame([(100.0, 60.0, 40.0)], "grand_total double, routine_total double, pct_discretionary double")
    assert "| c | 2 | $100 | $40 |" in sinks.money_trail(trails, totals)
    hits = spark.createDataFrame([("A", "2024-01-01", "M", 1, "**A** x")], "client string, date string, member_name string, doc_id int, snippet string")
    tallies = spark.createDataFrame([("A", 1, 1, "2024-01-01", "2024-01-01")], "client string, n_matches int, n_members int, first_date string, last_date string")
    assert "- 2024-01-01 M: **A** x" in sinks.press_report(tallies, hits)
    nodes, links = graph.from_findings(found(spark))
    pick = lambda kind: links.where(F.col("type") == kind)
    summary = sinks.graph_summary(nodes, links, graph.bridges(pick("lobbies_for")), graph.triangles(pick("mentions"), pick("funded_by"), pick("lobbies_for"), pick("former_official_of")), graph.hubs(pick("mentions"), pick("funded_by")))
    assert "client: client:ACME, n_lobbyists: 2" in summary and "- works_at: 2" in summary and "member: legislator:M (D-WI-S)" in summary
    sinks.trail_csv(spark.createDataFrame([("k", [("a", 1.0)]), ("e", [])], "case_id string, clients array<struct<label:string,total:double>>"), str(tmp_path / "t"))
    assert len(next((tmp_path / "t").glob("*.csv")).read_text().splitlines()) == 3


def test_award_key_falls_back(spark):
    rows = spark.createDataFrame([("A1", "grants", "R", 1.5), (" ", "grants", "R", 1.5), (None, "grants", "R", 1.5), ("", None, None, None)], "id string, g string, r string, a double")
    assert [r.k for r in rows.select(awards.award_key(F.col("id"), F.col("g"), F.col("r"), F.col("a")).alias("k")).collect()] == ["A1", "grants:R:1.5", "grants:R:1.5", "::"]


def test_status_groups(spark):
    rows = spark.createDataFrame([(s,) for s in status.URGENCY], "status string")
    told = [sorted(r.status for r in status.in_group(rows, g).collect()) for g in status.GROUPS]
    assert sorted(s for g in told for s in g) == sorted(status.URGENCY)
    assert status.in_group(rows, None).count() == status.in_group(rows, "no such").count() == len(status.URGENCY)


def test_findings_document(spark):
    found = spark.createDataFrame([(2.0, "B", "f", "X", "u2", 5), (3.0, "A", "f", "X", None, 7), (1.0, "C", "f", "X", "u1", 9)], "score double, lobbyist_name string, registrant_name string, agency_short string, sample_uuid string, total_income long")
    made = json.loads(sinks.findings_document(found, 2))["findings"]
    assert [(r["rank"], r["lobbyist_name"], r["senate_lda_url"], r["total_income"]) for r in made] == [(1, "A", None, 7.0), (2, "B", "https://lda.senate.gov/filings/public/filing/u2/print/", 5.0)]
