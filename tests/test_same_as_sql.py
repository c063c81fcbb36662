"""Rows on which the queries once differed from their SQL, made here."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from daybook import plans
from daybook.plans import catalogue

catalogue.load_all()
SF = "/root/testdata/sf0.001"


def told(spark, folder, name, **tables):
    """Rows by Spark and by SQL, over the smallest tables with ``tables`` in place of theirs."""
    duck = duckdb.connect()
    for f in os.listdir(SF):
        to, table = folder / f, f.removesuffix(".parquet")
        pq.write_table(tables[table], to) if table in tables else to.symlink_to(f"{SF}/{f}")
        duck.sql(f"create view {table} as select * from read_parquet('{to}')")
    df, want = plans.QUERIES[name](spark, str(folder)), duck.sql(plans.ORACLES[name])
    columns = sorted(df.columns)
    return sorted(tuple(r[c] for c in columns) for r in df.collect()), sorted(want.select(*columns).fetchall())


def test_halves_of_a_cent(spark, tmp_path):
    sums = [x / 1000 * 1000 for x in range(1005, 10000, 10)] + [999.5, 1.5, 0.5, -0.5, 2.5, 1000.5, 8494.99, 8495.01]
    n = len(sums)
    customer = pa.table({"c_custkey": pa.array(range(n), pa.int64()), "c_name": [f"c{i}" for i in range(n)], "c_nationkey": pa.array([i % 25 for i in range(n)], pq.read_schema(f"{SF}/customer.parquet").field("c_nationkey").type), "c_acctbal": sums, "c_mktsegment": ["A"] * n})
    got, want = told(spark, tmp_path, "h21", customer=customer)
    assert got == want and len(got) == n
    assert {r[2].split()[0]: r[1] for r in got}["c749"] == "$8.49B"


def test_words_end_before_letters_beyond_ascii(spark, tmp_path):
    names = ["Bergech zu den", "Der der die", "foo bar baz"]
    texts = ["x Bergech zu denébla", "éDer der die", "DER DER DIE\nmore", "der der dies", "_foo bar baz", "foo bar baz9 Foo Bar Baź", "ſfoo bar baz", "nothing", ""]
    benchmark = pa.table({"item_id": pa.array(range(3), pa.int64()), "text": [f"{n}é tail" for n in names]})
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["web"] * len(texts), "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    got, want = told(spark, tmp_path, "o35_many", benchmark=benchmark, documents=documents)
    assert got == want
    assert {r[0]: r[3] for r in got} == {"Bergech zu den": 1, "Der der die": 2, "foo bar baz": 2}


def test_registries_beyond_one_number_and_repeated_filings(spark, tmp_path):
    part, orders = (pq.read_table(f"{SF}/{t}.parquet") for t in ("part", "orders"))
    brands = [f"Brand#{k % 130 + 1}" for k in part["p_partkey"].to_pylist()]
    made = {"part": part.set_column(part.schema.get_field_index("p_brand"), "p_brand", pa.array(brands)), "orders": pa.concat_tables([orders, orders.slice(0, 300)]), "supplier": None}
    supplier = pq.read_table(f"{SF}/supplier.parquet")
    made["supplier"] = supplier.set_column(supplier.schema.get_field_index("s_name"), "s_name", pa.array([f"s{i % 3}" for i in range(len(supplier))]))
    lineitem = pq.read_table(f"{SF}/lineitem.parquet")
    same = pa.array([k % 20 if k % 3 else k for k in lineitem["l_partkey"].to_pylist()], lineitem.schema.field("l_partkey").type)
    made["lineitem"] = lineitem.set_column(lineitem.schema.get_field_index("l_partkey"), "l_partkey", same)
    for name in ("o34", "j7", "j2", "c18", "k1_evidence", "d16"):
        (tmp_path / name).mkdir()
        got, want = told(spark, tmp_path / name, name, **made)
        near = lambda rows: [tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows]
        assert near(got) == near(want) and (got or name in ("o34", "j7")), name


def test_scan_counts_after_one_shuffle(spark):
    for name, after in (("j7", "entity_name"), ("j2", "agency_short")):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
        assert len(dealt) == 2 and "lobbyist_name" in dealt[1] and after in dealt[0], dealt
