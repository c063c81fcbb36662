"""The stream that goes on from a batch, and the ledger that its events go through."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import status
from daybook.streaming import ledger, tracked

LOG = "user_id long, pos long, kind string, response_kind string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def some_log(seed=4):
    rng, rows = random.Random(seed), []
    for user in range(30):
        at = START + dt.timedelta(hours=rng.randrange(200))
        for pos in range(rng.randrange(1, 9)):
            kind = rng.choice(["sent", "sent", "ack", "followup", "response", "closed"])
            answer = rng.choice([None, "substantive", "letter"]) if kind in ("response", "closed") else None
            rows.append((user, pos, kind, "legal_threat" if rng.random() < 0.03 else answer, at + dt.timedelta(minutes=pos)))
    return rows


def test_stream_goes_on_from_batch(spark, tmp_path):
    """The first half of each key's events is the batch; the rest comes in three files out of order, with events of the batch and of other files again."""
    for name, value in tracked.PROVIDER.items():
        spark.conf.set(name, value)
    rows, rng = some_log(), random.Random(1)
    first = [r for r in rows if r[1] % 2 == 0 or r[0] % 5 == 0]
    rest = [r for r in rows if r not in first] + rng.sample(first, 20)
    rest += rng.sample(rest, 10)
    rng.shuffle(rest)
    for i in range(3):
        spark.createDataFrame(rest[i::3], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seeded = tracked.seed(spark.createDataFrame(first + first[:5], LOG))
    out = tracked.tracked(stream, seeded, days=3650, late="400 days", keep_days=3650)
    q = out.writeStream.outputMode("update").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: (r.n, r.status) for r in spark.sql("select user_id, max(n_events) as n, max_by(status, n_events) as status from tracked group by 1").collect()}
    never = F.lit("2000-01-01").cast("timestamp")
    want = {r.user_id: (r.n_events, r.status) for r in status.summaries(spark.createDataFrame(rows, LOG), "user_id", never, F.lit("2001-01-01").cast("timestamp"), at="ts").collect()}
    assert set(got) == {r[0] for r in rest} and len({s for _, s in want.values()}) >= 4
    assert got == {u: want[u] for u in got}


def test_deadlines_and_ends_of_state(spark, tmp_path):
    for name, value in tracked.PROVIDER.items():
        spark.conf.set(name, value)
    days = lambda n: START + dt.timedelta(days=n)
    files = [[(1, 0, "sent", None, days(0)), (2, 0, "sent", None, days(0)), (2, 1, "closed", "letter", days(1))], [(3, 0, "sent", None, days(20))], [(3, 1, "ack", None, days(90))], [(2, 2, "ack", None, days(90))], [(9, 0, "ack", None, days(91))]]
    schema = spark.createDataFrame([], LOG).schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seeded = tracked.seed(spark.createDataFrame([(4, 0, "sent", None, days(1))], LOG))
    q = tracked.tracked(stream, seeded, days=7, late="1 minute", keep_days=30).writeStream.outputMode("update").format("memory").queryName("deadlines").option("checkpointLocation", str(tmp_path / "c"))
    q = q.start()
    for rows in files:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    told = [tuple(r) for r in spark.table("deadlines").collect()]
    assert (1, 1, "sent") in told and (1, 1, "no_response_by_deadline") in told
    assert (4, 1, "no_response_by_deadline") in told  # known from the batch alone
    assert (2, 2, "closed_response") in told and (2, 1, "acknowledged") in told  # the closed key's state had gone
    assert (3, 1, "sent") in told


def test_ranges():
    r = tracked.Ranges()
    for n in (5, 1, 2, 9, 3, 4, 2):
        r.add(n)
    assert str(r) == "1-5,9-9" and len(r) == 6 and 4 in r and 6 not in r and str(tracked.Ranges(str(r))) == str(r)


EVENTS = "key string, at timestamp, kind string"


def snapshot(log):
    return sorted(map(tuple, log.read().select("key", "at", "kind", "pos").collect()))


def test_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    at = lambda n: START + dt.timedelta(hours=n)
    batch = lambda *rows: spark.createDataFrame(rows, EVENTS)
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    assert log.read() is None
    assert log.append(batch(("a", at(1), "sent"), ("b", at(0), "sent"), ("a", at(2), "ack")), 0)
    assert log.append(batch(("a", at(3), "closed"), ("c", at(3), "sent"), ("a", at(3), "ack"), ("a", at(3), "ack")), 1)
    before = snapshot(log)
    assert [(k, p) for k, _, _, p in before] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0), ("c", 0)]
    assert not log.append(batch(("a", at(3), "closed")), 1) and snapshot(log) == before
    # killed after the rows and before the mark: unseen, and the second try gives the same rows
    third = batch(("a", at(5), "followup"), ("d", at(5), "sent"))
    with monkeypatch.context() as m:
        m.setattr(type(log), "_system", property(lambda self: (_ for _ in ()).throw(RuntimeError("killed"))))
        with pytest.raises(RuntimeError):
            log.append(third, 2)
    log.placed(third, log.read()).write.parquet(str(tmp_path / "log" / "batches" / "main-000000000002"))
    assert snapshot(log) == before
    assert log.append(third, 2) and len(snapshot(log)) == 9 and ("a", at(5), "followup", 5) in snapshot(log)


def test_ledger_under_a_stream_that_restarts(spark, tmp_path):
    rows = [(f"k{i % 3}", START + dt.timedelta(minutes=i), "sent") for i in range(12)]
    for i in range(3):
        spark.createDataFrame(rows[4 * i : 4 * i + 4], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    fails = {"once": True}

    def flaky(batch, number):
        log.append(batch, number)
        if number == 1 and fails.pop("once", False):
            raise RuntimeError("killed after the mark, before the stream's own")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(flaky).option("checkpointLocation", str(tmp_path / "c")).start()

    q = run()
    with pytest.raises(Exception, match="killed"):
        q.processAllAvailable()
    q = run()
    q.processAllAvailable()
    q.stop()
    got = snapshot(log)
    assert len(got) == 12 and sorted(p for k, _, _, p in got if k == "k0") == [0, 1, 2, 3]
