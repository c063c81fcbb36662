"""Every registered query of this package against its SQL on the smallest tables; and the stream against the batch."""

import math
import os

import duckdb
import pytest

from daybook import plans
from daybook.operators import status as batch
from daybook.plans import catalogue
from daybook.streaming.status import statuses

catalogue.load_all()
SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from daybook.plans.bind import Bound
    from daybook.plans.investigations import log

    rows = log(Bound(spark, SF)).select("user_id", F.col("pos").cast("long").alias("pos"), "kind", "response_kind", "ts")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = statuses(stream).writeStream.outputMode("update").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: r.status for r in spark.sql("select user_id, max_by(status, n_events) as status from told group by 1").collect()}
    never = F.lit("2000-01-01").cast("timestamp")
    want = {r.user_id: r.status for r in batch.summaries(rows, "user_id", never, F.lit("2001-01-01").cast("timestamp"), at="ts").collect()}
    assert got == want
