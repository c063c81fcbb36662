"""Bucketed tables, versions, checked writes, submission, exact ranks and table functions."""

import datetime as dt
import http.server
import random
import statistics
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from daybook.functions import tables
from daybook.functions.text import other_names
from daybook.operators import lint, quality, ranks
from daybook.sources import storage, submit


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    rng = random.Random(1)
    filings = spark.createDataFrame([(f"f{i}" if i else None, f"firm {i % 7}") for i in range(300)], "filing_uuid string, registrant_name string")
    people = spark.createDataFrame([(f"f{rng.randrange(320)}", i % 3, f"p{rng.randrange(40)}") for i in range(1500)] + [(None, 0, "x")], "filing_uuid string, activity_idx int, lobbyist_name string")
    a = storage.write_bucketed(filings, "bucketed_filings", "filing_uuid", 4, str(tmp_path / "a"))
    b = storage.write_bucketed(people, "bucketed_people", "filing_uuid", 4, str(tmp_path / "b"), sort=["activity_idx"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = b.join(a, "filing_uuid")
        per_filing = joined.groupBy("filing_uuid", "registrant_name").agg(F.count_distinct("lobbyist_name").alias("n"))
        for df in (joined, per_filing):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in people.join(filings, "filing_uuid")._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, people.join(filings, "filing_uuid").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_filings")
        spark.sql("drop table bucketed_people")


TRAIL = "case_id string, total double"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_versions_are_old_or_new(spark, tmp_path):
    table = storage.Versions(spark, str(tmp_path / "t"))
    assert table.read() is None and table.latest() == 0
    of = lambda *r: spark.createDataFrame(r, TRAIL)
    order = [F.desc("total"), "case_id"]
    assert table.upsert(of(("a", 1.0), ("b", 5.0)), "case_id", order) == 1
    assert table.upsert(of(("a", 9.0), ("c", 2.0), (None, 0.5)), "case_id", order) == 2
    assert rows(table.read()) == [("a", 9.0), ("b", 5.0), ("c", 2.0), (None, 0.5)]  # sorted again, as the files are read in order
    assert rows(table.read(1)) == [("b", 5.0), ("a", 1.0)]
    # a writer dies between data and mark: nothing changes, and its data goes with the next cleaning
    lost = table.prepare(of(("z", 0.0)), order)
    assert table.latest() == 2 and lost in table._names("data")
    # two writers from one version: the second is told, tries again on top of the first and loses nothing
    mine = table.prepare(of(("m", 1.0)), order)
    table.write(of(("y", 1.0)), order)
    with pytest.raises(storage.Conflict):
        table.commit(mine, 2)
    assert rows(table.read()) == [("y", 1.0)]
    real, raced = table.commit, []

    def commit(name, after):
        if not raced:
            raced.append(real(table.prepare(of(("first", 3.0), ("y", 1.0)), order), after))
        return real(name, after)

    table.commit = commit
    assert table.upsert(of(("second", 2.0)), "case_id", order) == 5
    assert rows(table.read()) == [("first", 3.0), ("second", 2.0), ("y", 1.0)]
    assert {lost, mine} <= set(table.clean(keep=1)) and table.versions() == [5] and table.read().count() == 3


def test_checks_of_one_write(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            read.add(len(b))
            yield b

    raw = spark.createDataFrame([(i if i % 4 else None, str(i) if i % 5 else "x", i) for i in range(40)], "id int, v string, n int").repartition(3)
    counted = raw.mapInPandas(through, raw.schema)
    told = quality.write_checked(counted, str(tmp_path / "t"), "t", 10, 30, {"id": 0.1, "v": 0.1}, {"v is a number": ("v", "double")}, {"some n": (F.col("n") > 37, 1, 5), "no n": (F.col("n") > 99, 1, None)})
    assert read.value == 40
    t = spark.read.parquet(str(tmp_path / "t"))
    want = quality.row_count(t, "t", 10, 30).unionByName(quality.null_fractions(t, "t", {"id": 0.1, "v": 0.1})).unionByName(quality.castable(t, "v", "double", "v is a number"))
    want = want.unionByName(quality.sentinel(t, F.col("n") > 37, "some n", 1, 5)).unionByName(quality.sentinel(t, F.col("n") > 99, "no n", 1))
    assert sorted(rows(told)) == sorted(rows(want)) and read.value == 40
    assert {r.severity for r in told.collect()} == {"pass", "warn", "fail"}
    none = quality.write_checked(raw.where("false"), str(tmp_path / "e"), "t", 0, 30, {"id": 1.0}).collect()
    assert [(r.value, r.severity) for r in none] == [(0.0, "pass"), (None, "fail")]


class Service(http.server.BaseHTTPRequestHandler):
    """Refuses each URL once, some always; says where the copy is by one of three headers."""

    seen: list = []

    def do_POST(self):  # noqa: N802
        url = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["url"][0]
        Service.seen.append((self.path, url))
        code = 404 if "gone" in url else 503 if "down" in url else 429 if Service.seen.count((self.path, url)) == 1 else 200
        self.send_response(code)
        if code == 200:
            copy = f"/copy{self.path}/{url[-1]}"
            name, value = [("Content-Location", copy), ("Location", copy), ("Refresh", f"0;url={copy}")][ord(url[-1]) % 3]
            self.send_header(name, value)
        self.send_header("Content-Length", "0")
        self.end_headers()

    def log_message(self, *args):
        pass


def test_submission(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    Service.seen.clear()
    now, old = dt.datetime(2024, 2, 1), dt.datetime(2023, 1, 1)
    registry = spark.createDataFrame([("http://a", "x", "y", now), ("http://b", "x", None, now), ("http://c", "x", "y", old), ("http://down", "kept", None, old)], "url string, wayback string, archive_today string, at timestamp")
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("http://c",), ("http://d",), ("http://gone",), ("http://down",)], "url string")
    endpoints = {"wayback": f"{root}/w", "archive_today": f"{root}/t"}
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    merged, mask = submit.submit(urls, registry, str(tmp_path), endpoints, at, rate="1000", tries="2", wait="0.01")
    got = {r.url: (r.wayback, r.archive_today) for r in merged.collect()}
    server.shutdown()
    copy = lambda path, url: f"{root}/copy{path}/{url[-1]}"
    assert got == {
        "http://a": ("x", "y"), "http://b": ("x", copy("/t", "http://b")), "http://c": (copy("/w", "c"), copy("/t", "c")), "http://d": (copy("/w", "d"), copy("/t", "d")),
        "http://gone": (None, None), "http://down": ("kept", None),
    }
    sent = set(Service.seen)
    assert ("/w", "http://b") not in sent and not any(u == "http://a" for _, u in sent)  # only what is missing
    assert Service.seen.count(("/w", "http://gone")) == 1 and Service.seen.count(("/w", "http://down")) == 2 and mask == 3
    assert len(list(tmp_path.glob("submission-*/run-*/*.json"))) <= 2


def test_pace_and_abort(tmp_path):
    pace = submit.Pace(50)
    began = submit.time.monotonic()
    for _ in range(6):
        pace.wait("one")
    pace.wait("other")
    assert 0.09 <= submit.time.monotonic() - began < 0.5
    writer = submit.Writer({"path": str(tmp_path)})
    done = writer.write(iter([]))
    writer.abort([done])
    assert list(tmp_path.iterdir()) == []
    kept, twice = writer.write(iter([])), writer.write(iter([]))
    writer.commit([kept, None])
    assert [p.stem for p in tmp_path.glob("run-*/*")] == [kept.name] and twice.name != kept.name


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_quantiles(spark, q):
    rng = random.Random(int(q * 100))
    data = {"one": [4.0], "two": [1.0, 2.0], "ties": [7.0] * 500, "many": [rng.gauss(0, 1) for _ in range(3000)], "few values": [float(rng.randrange(3)) for _ in range(2500)], "none": [None], None: [1.0, 5.0, None]}
    table = spark.createDataFrame([(k, v, "x") for k, vs in data.items() for v in vs], "k string, v double, n string").repartition(5)
    got = {r.k: (r.n, r.quantile) for r in ranks.quantile(table, "v", ["k"], q, accuracy=200).collect()}
    for k, values in data.items():
        s = sorted(v for v in values if v is not None)
        at = (len(s) - 1) * q
        want = None if not s else s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))
        assert got[k][0] == len(s) and (got[k][1] == want or abs(got[k][1] - want) < 1e-12)
    assert len(got) == len(data)


def test_quantile_of_one_group_is_never_held(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("v"))
    out = ranks.quantile(rows, "v", [], accuracy=1000)
    assert out.first().quantile == statistics.median(r.v for r in rows.collect())
    assert ranks.quantile(rows.where("false"), "v", []).collect()[0].asDict() == {"n": 0, "quantile": None}


def test_table_functions(spark):
    tables.register(spark)
    text = "---\n3 cats\n---\nHe saw 3 cats.\n```\n4 dogs\n```\n# 5 titles\nover $5 and 10 percent"
    docs = spark.createDataFrame([(1, text), (2, "8 dogs"), (3, "")], "doc_id long, text string")
    docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "line")).select(F.col("doc_id").alias("d"), (F.col("i") + 1).alias("n"), "line", F.lit(0).alias("col")).repartition(4).createOrReplaceTempView("lines_of_docs")
    got = rows(spark.sql("SELECT d, n, col, rule, found FROM house_style(TABLE(lines_of_docs), 'd', 'n', 'line')"))
    assert sorted(got) == sorted(rows(lint.lint(docs).select("doc_id", "line", "col", "rule", "found"))) and len(got) >= 4
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM house_style(TABLE(lines_of_docs), 'd', 'n', 'nothing')").collect()
    names = ["Acme Inc (FKA Zeta Works)", "Beta f/k/a Gamma on behalf of Delta", "", None]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, raw string").createOrReplaceTempView("raw_names")
    got = rows(spark.sql("SELECT id, place, name FROM raw_names, LATERAL other_names(raw)"))
    assert sorted(got) == [(i, p, x) for i, n in enumerate(names) for p, x in enumerate(other_names(n), 1)]
