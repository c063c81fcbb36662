"""Queries over whole tables, against rows counted here; on sf0.01, where ids go beyond the cuts that the queries once made."""

import datetime as dt
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from daybook import plans
from daybook.plans import catalogue

catalogue.load_all()
SF = "/root/testdata/sf0.01"


def rows(table, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{table}.parquet", columns=list(columns))[c].to_pylist() for c in columns), strict=True))


@pytest.fixture(scope="module")
def tables():
    """``filings``: key -> (registrant id, firm, client, income, year, quarter, status); ``lines``: (key, lobbyist, agency, amount)."""
    firms = dict(rows("nation", "n_nationkey", "n_name"))
    clients = {k: (name, nation) for k, name, nation in rows("customer", "c_custkey", "c_name", "c_nationkey")}
    filings = {k: (clients[c][1], firms[clients[c][1]], clients[c][0], price, day.year, f"Q{(day.month + 2) // 3}", status) for k, c, price, day, status in rows("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")}
    people, brands = dict(rows("supplier", "s_suppkey", "s_name")), dict(rows("part", "p_partkey", "p_brand"))
    return filings, [(k, people[s], brands[p], amount) for k, s, p, amount in rows("lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice")]


@pytest.fixture(scope="module")
def whole_graph(tables):
    filings, lines = tables
    hired, paid, said, held = set(), defaultdict(float), defaultdict(int), set()
    for _, firm, client, *_ in filings.values():
        said[f"member:{firm.upper()}", f"client:{client.upper()}"] += 1
    for k, person, agency, amount in lines:
        held.add((f"lobbyist:{person.upper()}", f"agency:{agency.upper()}"))
        if k in filings:
            client = f"client:{filings[k][2].upper()}"
            hired.add((f"lobbyist:{person.upper()}", client))
            paid[f"agency:{agency.upper()}", client] += amount
    return hired, paid, said, held


def test_graph_edges_and_nodes(spark, whole_graph):
    kinds = dict(zip(("lobbies_for", "funded_by", "mentions", "former_official_of"), whole_graph, strict=True))
    assert {r.type: r.n for r in plans.QUERIES["k6"](spark, SF).collect()} == {k: len(e) for k, e in kinds.items()}
    degree = defaultdict(int)
    for e in whole_graph:
        for pair in e:
            for end in pair:
                degree[end] += 1
    assert {r.id: r.degree for r in plans.QUERIES["k7"](spark, SF).collect()} == degree


def test_graph_motifs(spark, whole_graph):
    hired, paid, said, held = whole_graph
    by_client = defaultdict(set)
    for person, client in hired:
        by_client[client].add(person)
    assert {r.client: r.lobbyists for r in plans.QUERIES["k3"](spark, SF).collect()} == {c: " | ".join(sorted(p)) for c, p in by_client.items() if len(p) > 1}
    dollars, mentions = defaultdict(float), defaultdict(int)
    for (_, c), w in paid.items():
        dollars[c] += w
    for (_, c), w in said.items():
        mentions[c] += w
    got = {r.client: (r.mentions, r.dollars) for r in plans.QUERIES["k5"](spark, SF).collect()}
    assert got.keys() == {c for c in dollars if c in mentions} and all(got[c] == (mentions[c], pytest.approx(dollars[c], abs=0.02)) for c in got)
    members = defaultdict(list)
    for m, c in said:
        members[c].append(m)
    officials = defaultdict(set)
    for person, agency in held:
        officials[agency].add(person)
    want = {(m, c, a): " | ".join(sorted(by_client[c] & officials[a])) for a, c in paid for m in members[c] if by_client[c] & officials[a]}
    assert {(r.member, r.client, r.agency): r.lobbyists for r in plans.QUERIES["o37"](spark, SF).collect()} == want


def test_search_index_has_every_name(spark):
    want = set()
    for kind, table, column in (("lobbyist", "supplier", "s_name"), ("firm", "nation", "n_name"), ("client", "customer", "c_name"), ("agency", "part", "p_brand")):
        want |= {(kind, name) for (name,) in rows(table, column)}
    got = [(r.type, r.name) for r in plans.QUERIES["o40"](spark, SF).collect()]
    assert len(got) == len(want) > 500 and set(got) == want
    places = ["lobbyist", "firm", "client", "agency"]
    assert got == sorted(got, key=lambda r: (places.index(r[0]), r[1]))


def test_role_scan_ranks_all_lobbyists(spark, tables):
    """Income of every row, as the original adds it; seniority and the year of the first position; five more for a pivot within two years."""
    filings, _ = tables
    part = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    name = {r.s_suppkey: r.s_name for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    seen = defaultdict(lambda: (set(), set(), [], []))
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        if r.l_orderkey in filings:
            _, firm, client, income, year, _, _ = filings[r.l_orderkey]
            clients, years, incomes, positions = seen[name[r.l_suppkey], firm]
            clients.add(client)
            years.add(year)
            incomes.append(income)
            positions.append((r.l_orderkey, r.l_linenumber, r.l_partkey, part[r.l_partkey]))
    score = {}
    for pair, (clients, years, incomes, positions) in seen.items():
        _, _, key, size = min(positions)
        score[pair] = 10 * [5, 5, 4, 3, 1][key % 5] + sum(incomes) / 1e6 + 0.5 * len(clients) + 5 * (min(years) + 25 - (2000 + size) <= 2)
    want = sorted(score.items(), key=lambda x: (-round(x[1], 4), x[0]))[:50]
    got = plans.QUERIES["o39"](spark, SF).collect()
    assert [(r.lobbyist_name, r.registrant_name) for r in got] == [pair for pair, _ in want]
    assert all(r.score == pytest.approx(s, abs=1e-4) and r.clients == len(seen[p][0]) and r.first_year == min(seen[p][1]) for r, (p, s) in zip(got, want, strict=True))



def test_firm_counts_have_all_clients(spark, tables):
    want = defaultdict(lambda: [0, 0])
    for number, *_, status in tables[0].values():
        want[str(number)][status != "F"] += 1
    assert {r.firm: [r.house_filings, r.senate_filings] for r in plans.QUERIES["o29_firms"](spark, SF).collect()} == want


def test_firm_income_ranks_all_firms(spark, tables):
    income, n = defaultdict(float), defaultdict(int)
    for _, firm, _, price, year, quarter, _ in tables[0].values():
        income[firm, f"{year}-{quarter}"] += price
        n[firm, f"{year}-{quarter}"] += 1
    want = sorted(income, key=lambda k: (-round(income[k], 2), k))[:100]
    got = plans.QUERIES["o31"](spark, SF).collect()
    assert [(r.registrant_name, r.quarter) for r in got] == want
    assert all(r.filings == n[k] and r.income == pytest.approx(income[k], abs=0.02) for r, k in zip(got, want, strict=True))


def test_status_has_all_events(spark):
    got = {r.user_id: r.n_events for r in plans.QUERIES["o38"](spark, SF).collect()}
    assert got == Counter(user for (user,) in rows("events", "user_id"))


def test_status_of_small_logs(spark, tmp_path):
    logs = {3: [("signup", 0), ("purchase", 99)], 6: [("signup", 0), ("error", 200)], 9: [("signup", 0), ("error", 50)], 12: [("signup", 0), ("error", 1)], 15: [("signup", 0)], 18: [("signup", 0), ("view", 0)], 21: [("signup", 0), ("click", 0)], 24: [("signup", 0), ("view", 0)]}
    late = {24}
    at = [(u, kind, value, dt.datetime(2024, 1, 1 if u in late else 30)) for u, events in logs.items() for kind, value in events]
    user, kind, value, ts = map(list, zip(*at, strict=True))
    schema = pq.read_schema(f"{SF}/events.parquet")
    made = {"event_id": range(len(at)), "user_id": user, "event_type": kind, "value": value, "ts": ts}
    pq.write_table(pa.table({f.name: pa.array(list(made[f.name]), f.type) if f.name in made else pa.nulls(len(at), f.type) for f in schema}), str(tmp_path / "events.parquet"))
    got = {r.user_id: r.status for r in plans.QUERIES["o38"](spark, str(tmp_path)).collect()}
    assert got == {3: "responded", 6: "escalated", 9: "closed_response", 12: "closed_no_response", 15: "sent", 18: "acknowledged", 21: "followed_up", 24: "no_response_by_deadline"}
