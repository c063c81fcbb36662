import json

import pytest

from daybook import schemas
from daybook.sources import cases, filings, sinks


def test_press(spark, tmp_path):
    rows = [{"member": {"bioguide_id": "A1", "name": "N", "party": "D", "state": "WI", "chamber": "Senate"}, "date": "2025-04-15", "title": "t", "text": "x"}, {"member": None, "date": None, "title": "only"}]
    (tmp_path / "2025").mkdir()
    (tmp_path / "2025/a.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{broken", json.dumps(rows[1])]))
    got = filings.press_releases(spark, str(tmp_path)).orderBy("title").collect()
    assert [r.title for r in got] == ["only", "t"] and got[1].filing_quarter == "2025-Q2" and got[0].bioguide_id is None


FILING = {
    "filing_uuid": "u1", "filing_year": 2025, "filing_period": "first_quarter", "income": "1000.50", "expenses": "None", "registrant": {"id": "7", "name": " Firm "}, "client": {"id": "9", "name": "C"},
    "lobbying_activities": [
        {"general_issue_code": "AGR", "description": "d", "lobbyists": [{"lobbyist": {"first_name": "A", "last_name": None}, "covered_position": "", "new": True}], "government_entities": [{"name": "SENATE"}]},
        {"general_issue_code": "TAX", "description": None, "lobbyists": [], "government_entities": []},
    ],
    "foreign_entities": [{"name": "F", "country": "DE", "ppb_country": "DE"}],
}


def test_senate(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([FILING, {"filing_uuid": "u2", "filing_year": 2025, "income": ""}]))
    t = filings.senate_tables(filings.senate_bronze(spark, str(tmp_path)))
    f = {r.filing_uuid: r for r in t["senate_filings"].collect()}
    assert f["u1"].income == 1000.5 and f["u1"].expenses is None and f["u1"].registrant_name == "Firm" and f["u2"].income is None
    assert [(r.activity_idx, r.general_issue_code) for r in t["senate_activities"].orderBy("activity_idx").collect()] == [(0, "AGR"), (1, "TAX")]
    person = t["senate_lobbyists"].first()
    assert (person.lobbyist_name, person.covered_position, person.is_new) == ("A", None, "True")
    assert t["senate_gov_entities"].count() == 1 and t["senate_foreign_entities"].first().country == "DE"
    filings.write_tables(t, str(tmp_path / "out"))
    filings.register_tables(spark, str(tmp_path / "out"), ["senate_filings"])
    assert spark.table("senate_filings").count() == 2


def test_contributions(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024/c.json").write_text(json.dumps([{"filing_uuid": "u", "registrant": {"name": "R"}, "contribution_items": [{"contribution_type": "feca", "amount": "5.00", "payee_name": "P"}, {"amount": "x"}]}]))
    got = filings.contributions(spark, str(tmp_path / "2024/c.json")).collect()
    assert [(r.filing_year, r.amount) for r in got] == [(2024, 5.0), (2024, None)]


MODERN = "<LOBBYINGDISCLOSURE2><senateID>7-9</senateID><organizationName>O</organizationName><income>$60,000</income><alis><ali_info><issueAreaCode>AGR</issueAreaCode><specific_issues><description>d</description></specific_issues><lobbyists><lobbyist><lobbyistFirstName>A</lobbyistFirstName><lobbyistLastName>B</lobbyistLastName></lobbyist></lobbyists></ali_info><ali_info><issueAreaCode> </issueAreaCode></ali_info><ali_info><issueAreaCode>TAX</issueAreaCode></ali_info></alis></LOBBYINGDISCLOSURE2>"
LEGACY = "<LOBBYINGDISCLOSURE2><organizationName>L</organizationName><alis><ali_Code>AGR</ali_Code><ali_Code>TAX</ali_Code></alis><specific_issues><description>only</description></specific_issues><lobbyists><lobbyist><lobbyistName>Z Y</lobbyistName></lobbyist></lobbyists></LOBBYINGDISCLOSURE2>"


def test_house(spark, tmp_path):
    d = tmp_path / "2025_1stQuarter_XML"
    d.mkdir()
    for name, body in (("1", MODERN), ("2", LEGACY), ("3", "<broken")):
        (d / f"{name}.xml").write_text(body)
    bronze = filings.house_bronze(spark, str(tmp_path))
    t = filings.house_tables(bronze)
    assert {(r.house_id, r.filing_year, r.filing_period, r.income) for r in t["house_filings"].collect()} == {("1", 2025, "Q1", 60000.0), ("2", 2025, "Q1", None)}
    assert bronze.where("broken").count() == 1
    assert {(r.house_id, r.activity_idx, r.ali_code, r.description) for r in t["house_activities"].collect()} == {("1", 0, "AGR", "d"), ("1", 2, "TAX", None), ("2", 0, "AGR", "only"), ("2", 1, "TAX", None)}
    assert {(r.house_id, r.activity_idx, r.lobbyist_name) for r in t["house_lobbyists"].collect()} == {("1", 0, "A B"), ("2", None, "Z Y")}


def test_cases_and_findings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"lobbyist": "L", "agency": "usda", "award_groups": ["g"], "clients": [{"label": "c", "search": "c", "name_tokens": ["C"]}]}))
    assert cases.case(spark, str(tmp_path / "c.json"), schemas.TRACE_CASE, ["lobbyist", "clients"]).first().agency == "usda"
    with pytest.raises(ValueError, match="match"):
        cases.case(spark, str(tmp_path / "c.json"), schemas.TRACE_CASE, ["match"])
    (tmp_path / "f.json").write_text(json.dumps({"findings": [{"rank": 2, "lobbyist_name": "b"}, {"rank": 1, "lobbyist_name": "a"}]}))
    assert [r.lobbyist_name for r in cases.findings(spark, str(tmp_path / "f.json"), top=1).collect()] == ["a"]
    assert cases.findings(spark, str(tmp_path / "f.json"), rank=2).count() == 1


def test_awards_source(spark, tmp_path):
    for page in (1, 2):
        (tmp_path / f"grants-{page}.json").write_text(json.dumps({"results": [{"Award ID": f"x{page}", "Award Amount": 5}, {"Recipient Name": "R"}]}))
    spark.dataSource.register(cases.Awards)
    got = spark.read.format("awards").option("path", str(tmp_path)).option("groups", "grants,loans").option("client", "c").load()
    assert got.count() == 4 and got.where("amount = 5").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b"', None), (1, "x|y", 3.0)], "rank int, name string, v double")
    sinks.csv(df, str(tmp_path / "c"))
    assert json.loads(sinks.document(df, ["rank"]))["findings"][0] == {"rank": 1, "name": "x|y", "v": 3.0}
    assert "x\\|y" in sinks.markdown(df, ["rank"], "T")
    assert {r.name for r in sinks.upsert(df, spark.createDataFrame([(2, "new")], "rank int, name string"), "rank").collect()} == {"x|y", "new"}
    edges = spark.createDataFrame([("a", "b", "t")], "src string, dst string, type string")
    assert '"a" -- "b"' in sinks.dot(edges) and "<circle" in sinks.svg(edges) and sinks.svg(edges) == sinks.svg(edges)
