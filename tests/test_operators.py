import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from daybook.operators import archive, graph, lint, quality, resolve, status
from daybook.operators.components import connected_components
from daybook.operators.skew import lookup


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)] + [(500, 500), (None, 3)] + [(901 + k, 900) for k in range(50)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {i: root(i) for i in up}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lookup_hot_cold_null(spark):
    big = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("z", 3)], "k string, i int")
    small = spark.createDataFrame([("h", 50, 7), ("c", 1, 8)], "k string, n long, v int")
    got = sorted((r.k or "", r.i, r.v or 0) for r in lookup(big, small, "k", "n", 53_000, ["v"]).collect())
    assert got == sorted([("h", i, 7) for i in range(50)] + [("c", 1, 8), ("", 2, 0), ("z", 3, 0)])


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.raw_name)
    return sorted(map(sorted, out.values()))


def test_organisations(spark):
    names = ["ACME CORP", "Acme Corporation", "Acme Inc (FKA Zeta Works)", "Zeta Works LLC", "Other Org", "American Steel Institute", "American Steele Institute", "American Water Works"]
    got = resolve.resolve_orgs(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "raw string, weight long"))
    assert clusters(got) == sorted(map(sorted, [["ACME CORP", "Acme Corporation", "Acme Inc (FKA Zeta Works)", "Zeta Works LLC"], ["Other Org"], ["American Steel Institute", "American Steele Institute"], ["American Water Works"]]))
    rows = {r.raw_name: r for r in got.collect()}
    assert rows["Other Org"].match_method == "singleton" and rows["Other Org"].confidence == 1.0
    assert rows["ACME CORP"].canonical_name == "Zeta Works LLC" and rows["ACME CORP"].n_variants == 4
    assert rows["American Steel Institute"].match_method in ("fuzzy_high", "fuzzy_low")


def test_people(spark):
    names = ["John Smith", "Smith, John A.", "John Smyth", "Hon. John B. Smith", "Jane Smith", "", None]
    got = resolve.resolve_people(spark.createDataFrame([(n, 1) for n in names], "raw string, weight long"))
    assert clusters(got) == [["Hon. John B. Smith", "John Smith", "Smith, John A."], ["Jane Smith"], ["John Smyth"]]


LOG = "key string, pos long, kind string, response_kind string, at timestamp, stored string"


def told(spark, events, deadline, stored=None):
    rows = [("k", i, k, r, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), stored) for i, (k, r, d) in enumerate(events)] or [("k", None, None, None, None, stored)]
    df = spark.createDataFrame(rows, LOG)
    return status.summaries(df, "key", F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit(deadline).cast("timestamp"), stored="stored").first()


def test_status(spark):
    late, far = "2024-01-08 00:00:00", "2024-01-10 00:00:00"
    assert told(spark, [], late, "drafted").status == "drafted"
    assert told(spark, [("sent", None, 0)], far).status == "sent"
    assert told(spark, [("sent", None, 0)], late).status == "no_response_by_deadline"
    assert told(spark, [("sent", None, 0), ("response", "substantive", 3)], late).status == "responded"
    assert told(spark, [("sent", None, 0), ("response", "legal_threat", 3), ("closed", None, 4)], late).status == "escalated"
    assert told(spark, [("closed", "letter", 5), ("closed", None, 2), ("sent", None, 9)], late).status == "closed_no_response"
    row = told(spark, [("sent", None, 4), ("followup", None, 2), ("sent", None, 0)], far)
    assert row.days_since_sent == 5 and row.followups == 1 and row.days_left == 0


def test_invalid_events(spark):
    rows = spark.createDataFrame([("a", "sent", "x"), ("b", "odd", "x"), ("c", None, None)], "key string, kind string, at string")
    assert sorted((r.key, r.rule) for r in status.invalid(rows, "key", ["sent"]).collect()) == [("b", "unknown kind"), ("c", "missing kind"), ("c", "missing time")]


def test_graph_motifs(spark):
    rows = lambda *x: spark.createDataFrame(x, "src string, dst string, weight double")
    got = graph.triangles(rows(("m", "c", 2.0)), rows(("a", "c", 9.0), ("b", "c", 1.0)), rows(("l", "c", 1.0), ("k", "c", 1.0)), rows(("l", "a", 1.0), ("k", "a", 1.0))).collect()
    assert [tuple(r) for r in got] == [("m", "c", "a", "k | l", 2.0, 9.0)]
    assert graph.hubs(rows(("m", "c", 2.0)), rows(("a", "c", 9.0))).first().score == 2.0
    assert graph.bridges(rows(("l", "c", 1.0), ("k", "c", 1.0), ("l", "d", 1.0))).count() == 1
    edge = graph.edges(spark.createDataFrame([("x", "y", 1, 1.0), ("x", "y", 2, 5.0)], "s string, d string, r int, w double"), "t", F.col("s"), F.col("d"), F.col("w"), F.col("r")).first()
    assert edge.weight == 5.0 and edge.n == 2


def test_quality(spark):
    t = spark.createDataFrame([(1, "5"), (2, "x"), (None, None)], "id int, v string")
    nulls = quality.null_fractions(t, "t", {"id": 0.5, "v": 0.1}).collect()
    assert [r.severity for r in nulls] == ["pass", "fail"]
    assert quality.null_fractions(t.where("false"), "t", {"id": 1.0}).first().severity == "fail"
    assert quality.castable(t, "v", "double", "v").first().value == 1.0
    assert quality.orphans(t, spark.createDataFrame([(1,)], "k int"), "id", "k", "x").first().value == 2.0
    assert quality.row_count(t, "t", 32, 40, sample=True).first().severity == "pass"
    assert quality.row_count(t, "t", 0, 2).first().severity == "warn"
    assert quality.verdict(quality.row_count(t, "t", 0, 2), strict=True).first().exit_code == 1


def test_lint_state(spark):
    text = "---\n3 cats\n---\nHe saw 3 cats.\n```\n4 dogs\n```\n# 5 titles\n"
    got = lint.lint(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.line, r.rule) for r in got] == [(4, "number under 10")]


def test_archive(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    held = spark.createDataFrame([("http://a", "x", "y", dt.datetime(2024, 1, 30)), ("http://b", "x", None, dt.datetime(2024, 1, 30)), ("http://c", "x", "y", dt.datetime(2023, 1, 1))], "url string, wayback string, archive_today string, at timestamp")
    urls = archive.collect((spark.createDataFrame([(["http://a", "ftp://x", "http://b"],), (["http://c", "https://d"],)], "u array<string>"), F.col("u")))
    assert sorted(r.url for r in archive.due(urls, held, now, 7).collect()) == ["http://b", "http://c", "https://d"]
    new = spark.createDataFrame([("http://b", "", "z", dt.datetime(2024, 2, 1))], held.schema)
    row = archive.merge(held, new).where("url = 'http://b'").first()
    assert (row.wayback, row.archive_today) == ("x", "z")
    assert archive.exit_code(new).first().exit_code == 1


def test_search_of_releases(spark):
    from daybook.operators import mentions

    rows = [(1, "Ann", "A1", "2024-01-01", "t", "ACME built it"), (2, "Ann", "A1", "2024-01-01", "t", "again Acme"), (3, "Bob", "", "2024-02-01", "about acme", "x"), (4, "B. Bob", None, "2024-03-01", "t", "Acmeville and o’Neil's"), (5, "Ann", "A1", "2024-04-01", "u", "acme and O'Neil")]
    press = spark.createDataFrame(rows, "doc_id int, member_name string, bioguide_id string, date string, title string, text string")
    case = [("Acme", []), ("ONeil", ["O'Neil"]), ("None", ["nobody"])]
    hits = mentions.search(press, case)
    assert sorted((r.client, r.doc_id) for r in hits.collect()) == [("Acme", 1), ("Acme", 3), ("Acme", 5), ("ONeil", 4), ("ONeil", 5)] and "text" not in hits.columns
    assert {r.client: (r.n_matches, r.n_members) for r in mentions.tallies(hits).collect()} == {"Acme": (3, 2), "ONeil": (2, 2)}
    assert sorted((r.client, r.doc_id) for r in mentions.search(press, case, per_client=1).collect()) == [("Acme", 5), ("ONeil", 5)]
    assert sorted(r.doc_id for r in mentions.search(press, case[:1], limit=2).collect()) == [3, 5]
    assert mentions.search(press, []).count() == 0 and next(r.snippet for r in hits.collect() if r.doc_id == 1) == "**ACME** built it"


def test_resolved_names_against_union_find(spark):
    """The query over names of parts and hosts, against blocks, ratios and a union by hand."""
    from daybook import plans
    from daybook.functions import text as T
    from daybook.plans import catalogue

    catalogue.load_all()
    sf = "/root/testdata/sf0.001"
    raws = {r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()} | {r.h for r in spark.read.parquet(f"{sf}/pages.parquet").select(F.parse_url("url", F.lit("HOST")).alias("h")).collect()}
    raws -= {None, ""}
    forms = spark.createDataFrame([(r, n) for r in raws for n in T.other_names(r)], "raw string, name string").select("raw", T.organisation(F.col("name")).alias("norm")).where("norm <> ''").collect()
    norms, up = sorted({r.norm for r in forms}), {}
    root = lambda n: n if up.get(n, n) == n else root(up[n])
    join = lambda a, b: up.__setitem__(max(root(a), root(b)), min(root(a), root(b)))
    by_raw = {}
    for r in forms:
        by_raw.setdefault(r.raw, []).append(r.norm)
    for group in by_raw.values():
        for n in group[1:]:
            join(group[0], n)
    for a in norms:
        for b in norms:
            if a < b and a.split(" ")[0] == b.split(" ")[0] and abs(len(a) - len(b)) <= max(len(a), len(b)) // 2 and T.indel(T.sorted_words(a), T.sorted_words(b)) >= 92:
                join(a, b)
    want = {}
    for raw, group in by_raw.items():
        want.setdefault(root(group[0]), set()).add(raw)
    assert clusters(plans.QUERIES["i_orgs"](spark, sf)) == sorted(map(sorted, want.values()))


def test_registry_names_every_agency(spark):
    """Each agency's own words in either order, and titles too far away."""
    from daybook.functions import registry

    rows = [("General Counsel, FERC",), ("FERC, General Counsel",), ("General Counsel " + "x" * 61 + " FERC",), ("Chief of Staff " + "x" * 70 + " FERC",), ("Secretary, VA Approps",), ("Chairwoman of the SEC and Commissioner, FTC",), ("SEC",)]
    got = spark.createDataFrame(rows, "p string").select("p", registry.agencies_of(F.col("p")).alias("a")).collect()
    assert [sorted(x.agency for x in r.a) for r in got] == [["ferc"], ["ferc"], [], ["ferc"], [], ["ftc", "sec"], []]
    years = spark.createDataFrame([("Aide 2011-2014, 1999",), ("Aide",)], "p string").select(registry.end_year(F.col("p")).alias("y"))
    assert [r.y for r in years.collect()] == [2014, None]
    assert [r[0] for r in years.select(registry.fast_pivot(F.col("y"), F.lit(2016))).collect()] == [True, False]


def test_small_functions(spark):
    from daybook.functions import text as T

    row = spark.createDataFrame([("a | |b ", "Rural Housing Service (x)", ["Ac"], "the ACME co")], "p string, s string, t array<string>, r string").select(T.pieces(F.col("p")), T.routine(F.col("s")), T.names_recipient(F.col("t"), F.col("r"))).first()
    assert tuple(row) == (["a", "b"], True, True)
    html = spark.createDataFrame([('<meta http-equiv="refresh" content="0; url=https://x.org/a">',), ("<p>",)], "h string").select(archive.canonical(F.col("h")).alias("u"))
    assert [r.u for r in html.collect()] == ["https://x.org/a", None]
    t = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert [quality.sentinel(t, F.col("v") > 1, "s", low, high).first().severity for low, high in ((2, 2), (3, None), (1, None))] == ["pass", "fail", "pass"]
    assert [r.v for r in quality.missing(t, t.where("v < 3"), "v").collect()] == [3]


def test_scratch_tables_go(spark):
    from pathlib import Path

    from daybook.operators.durable import save, scratch

    there = lambda df: Path(df._daybook_path.removeprefix("file:")).exists()
    with scratch() as keep:
        a, b = save(spark.range(3), "a"), keep(save(spark.range(4), "b"))
        with scratch() as inner:
            c, d = save(spark.range(5), "c"), inner(save(spark.range(6), "d"))
        assert not there(c) and there(d) and d.count() == 6
    assert [there(x) for x in (a, b, d)] == [False, True, False] and b.count() == 4
    e = save(spark.range(2), "e")
    assert there(e)


def test_house_style_by_sql_and_by_rule():
    """The SQL of the rules against the rules, on lines that try each of them and what it excepts."""
    import duckdb

    from daybook.plans import ORACLES, catalogue

    catalogue.load_all()
    lines = [
        "He saw 3 cats.", "3 cats and 4 dogs", "it costs $5 or 7%", "v2 has 3 bugs", "`a 3 b` and 4", "see [x 5](http://a/6 7) 8", "A, B, and C are, well, and fine", "over 5 and OVER $6", "10 percent of 5 percent", "in AL AK, ÉAL and TX", "|AL|",
        "\"a’ b", "January 5 and March 6 February 12th August 3", "x9 9x 9 9.", "---", "6 hidden", "---", "```", "7 hidden", "```", "# 8 title", "é7 7é 7", "1. list 5", "8 years 8 cats",
    ]
    docs = [(i, "\n".join(lines[:i])) for i in range(1, len(lines) + 1)] + [(100 + i, x) for i, x in enumerate(lines)] + [(200, None), (201, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = {}
    for d, text in docs:
        for f in lint.document_findings(text or ""):
            want.setdefault(f["rule"], []).append(d)
    assert dict((rule, (n, k)) for rule, n, k in con.execute(ORACLES["h24"]).fetchall()) == {rule: (len(x), len(set(x))) for rule, x in want.items()} and len(want) == 7


@pytest.mark.parametrize("hub", [0, 10**9])
def test_triangles_of_a_hub_stay_near_the_result(spark, monkeypatch, hub):
    """A lobbyist with 10,000 clients and 200 offices, either routed or not, of whose clients few are paid by few agencies; beside it some with few edges, and an agency that pays all of one lobbyist's clients."""
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(6)
    hired = [("hub", f"c{i}") for i in range(10_000)] + [(f"l{i}", f"c{rng.randrange(10_000)}") for i in range(300) for _ in range(3)] + [("wide", f"c{i}") for i in range(0, 10_000, 3)]
    held = [("hub", f"a{i}") for i in range(200)] + [(f"l{i}", f"a{rng.randrange(200)}") for i in range(300)] + [("wide", "a0"), ("idle", "a1")]
    paid = list({(f"a{rng.randrange(260)}", f"c{rng.randrange(11_000)}") for _ in range(9000)} | {("a0", f"c{i}") for i in range(0, 10_000, 30)})
    said = [("m", f"c{i}", 2.0) for i in range(0, 10_000, 2)]
    edges = lambda rows: spark.createDataFrame([(*r, 1.0)[:3] for r in rows], "src string, dst string, weight double")
    want = {}
    of = {}
    for lobbyist, agency in held:
        of.setdefault(agency, set()).add(lobbyist)
    works = set(hired)
    talked = {c for _, c, _ in said}
    for agency, client in paid:
        who = sorted(x for x in of.get(agency, ()) if (x, client) in works)
        if who and client in talked:
            want[client, agency] = " | ".join(who)
    got = graph.triangles(edges(said), edges(paid), edges(hired), edges(held)).collect()
    assert {(r.client, r.agency): r.lobbyists for r in got} == want and len(got) == len(want)
    pairs = lambda rows, *names: spark.createDataFrame(rows, [*names])
    payments = pairs([p for p in paid if p[1] in talked], "agency", "client")
    made = graph.linked(pairs(hired, "lobbyist", "client").distinct(), pairs(held, "lobbyist", "agency").distinct(), payments)
    assert made.count() <= 4 * sum(len(x.split(" | ")) for x in want.values())
    assert graph._costs(pairs(hired, "lobbyist", "client"), pairs(held, "lobbyist", "agency"), payments).agg(F.sum("rows")).first()[0] < 20_000  # of two million pairs


def test_triangles_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    one = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert graph.triangles(none, one, one, one).count() == 0 and graph.triangles(one, one, none, none).count() == 0


def _most_rows(df) -> int:
    """Rows of the operator that makes most, in the plan that ran."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("page", [62, 5])
def test_triangles_make_no_row_for_each_office_of_a_lobbyist(spark, monkeypatch, page):
    """Sixty lobbyists with 20 clients and 40 offices each, 48,000 pairs; with pages of the usual size no step of the last plan makes a tenth of them. Agencies fill several pages, small ones by more than a page holds."""
    monkeypatch.setattr(graph, "PAGE", page, raising=False)
    monkeypatch.setattr(graph, "FEW", 0)
    rng = random.Random(3)
    hired = [(f"l{i}", f"c{c}") for i in range(60) for c in rng.sample(range(30), 20)]
    held = [(f"l{i}", f"a{a}") for i in range(60) for a in rng.sample(range(70), 40)] + [("idle", "a1")]
    paid = [(f"a{a}", f"c{c}") for c in range(32) for a in range(72) if rng.random() < 0.5]
    said = [(f"m{c % 3}", f"c{c}") for c in range(0, 30, 2)]
    edges = lambda rows: spark.createDataFrame([(*r, 1.0) for r in rows], "src string, dst string, weight double")
    clients, offices = set(hired), set(held)
    want = {(m, c, a): " | ".join(sorted(f"l{i}" for i in range(60) if (f"l{i}", c) in clients and (f"l{i}", a) in offices)) for m, c in said for a, x in paid if x == c}
    found = graph.triangles(edges(said), edges(paid), edges(hired), edges(held))
    got = found.collect()
    assert {(r.member, r.client, r.agency): r.lobbyists for r in got} == {k: v for k, v in want.items() if v} and len(got) == len({k for k, v in want.items() if v})
    assert _most_rows(found) < (4800 if page == 62 else 48_000)
