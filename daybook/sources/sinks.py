"""Small reports out of large plans: CSV, JSON, Markdown and graph drawings. Callers limit the rows first; only these reach the driver."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Columns of the findings file, in order.
FINDING = ["score", "agency_short", "lobbyist_name", "registrant_name", "covered_position", "concentration", "agency_filings", "total_filings", "n_clients", "total_income", "first_year", "last_year", "top_clients_str", "sample_uuid", "sample_source"]


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """RFC 4180, one file with a header."""
    df.select(*(columns or df.columns)).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def findings_csv(found: DataFrame, path: str) -> None:
    """The findings with their fixed columns, best first; a column that the scan lacks is empty."""
    named = found.select(*(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in FINDING))
    csv(named.orderBy(F.desc("score"), "lobbyist_name", "registrant_name", "agency_short"), path)


def trail_csv(trails: DataFrame, path: str) -> None:
    """A row a client of each trail; a trail without clients keeps one."""
    csv(trails.select("case_id", F.explode_outer("clients").alias("c")).select("case_id", F.coalesce("c.label", F.lit("")).alias("label"), F.coalesce("c.total", F.lit(0.0)).alias("total")), path)


def document(df: DataFrame, order: list, name: str = "findings") -> str:
    """All rows as one JSON document, in order."""
    rows = [json.loads(r[0]) for r in df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
    return json.dumps({name: rows}, ensure_ascii=False, indent=1)


def findings_document(found: DataFrame, top: int = 40) -> str:
    """The first findings as a JSON document, each with the address of its sample filing; only they reach the driver."""
    order = [F.desc("score"), "lobbyist_name", "registrant_name", "agency_short"]
    best = found.drop("rank").orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    address = F.when(F.col("sample_uuid").isNotNull(), F.concat(F.lit("https://lda.senate.gov/filings/public/filing/"), "sample_uuid", F.lit("/print/")))
    money = [F.col(c).cast("double").alias(c) for c in ("total_income",) if c in found.columns]
    rest = [c for c in best.columns if c not in ("rank", "total_income")]
    return document(best.select("rank", *rest, *money, address.alias("senate_lda_url")), ["rank"])


def markdown(df: DataFrame, order: list, title: str) -> str:
    rows = df.orderBy(*order).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows)]) + "\n"


def findings_draft(found: DataFrame, top: int = 10) -> str:
    """A draft that tells the first findings one by one; only they reach the driver."""
    out = ["# Structural patterns", ""]
    for r in found.orderBy(F.desc("score"), "lobbyist_name", "registrant_name", "agency_short").limit(top).collect():
        out += [f"## {r.lobbyist_name} — {r.agency_short}", "", f"{r.agency_filings} of {r.total_filings} filings at {r.registrant_name} ({100 * r.concentration:.1f}%) name the agency; score {r.score:.2f}.", "", f"- Position: {r.covered_position}", f"- Clients: {r.top_clients_str}", f"- Sample filing: {r.sample_uuid}", ""]
    return "\n".join(out)


def money_trail(trails: DataFrame, totals: DataFrame, top: int = 50) -> str:
    """A report of trails with their totals in front."""
    t = totals.first()
    head = ["# Money trail", "", f"- Total: ${t.grand_total or 0:,.0f}", f"- Routine: ${t.routine_total or 0:,.0f}", f"- Discretionary: {t.pct_discretionary or 0:.1f}%", ""]
    rows = trails.orderBy(F.desc("total"), "client_name").limit(top).collect()
    return "\n".join([*head, "| Client | Awards | Total | Discretionary |", "|---|---|---|---|", *(f"| {r.client_name} | {r.n_awards} | ${r.total:,.0f} | ${r.discretionary_amount:,.0f} |" for r in rows)]) + "\n"


def press_report(tallies: DataFrame, matches: DataFrame, per_client: int = 10) -> str:
    """Clients by number of matches, each with its newest releases."""
    from pyspark.sql import Window

    newest = Window.partitionBy("client").orderBy(F.desc("date"), "doc_id")
    rows = matches.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= per_client).orderBy("client", "k").collect()
    out = ["# Press releases", ""]
    for t in tallies.orderBy(F.desc("n_matches"), "client").collect():
        out += [f"## {t.client}", "", f"{t.n_matches} matches by {t.n_members} members, {t.first_date} to {t.last_date}", "", *(f"- {r.date} {r.member_name}: {r.snippet}" for r in rows if r.client == t.client), ""]
    return "\n".join(out)


def graph_summary(named: DataFrame, links: DataFrame, bridges: DataFrame, triangles: DataFrame, hubs: DataFrame) -> str:
    """Counts by type, then the strongest bridges, triangles and hubs."""
    part = lambda title, df, order, n: [f"## {title}", "", *("- " + ", ".join(f"{c}: {r[c]}" for c in df.columns) for r in df.orderBy(*order).limit(n).collect()), ""]
    kinds = [f"- {r.type}: {r.n}" for df in (named, links) for r in df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type").collect()]
    return "\n".join(["# Graph", "", *kinds, "", *part("Bridges", bridges, [F.desc("n_lobbyists"), "client"], 15), *part("Triangles", triangles, [F.desc("mentions"), F.desc("dollars"), "member", "client", "agency"], 25), *part("Hubs", hubs, [F.desc("score"), "client"], 15)])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't among the new ones, and the new ones; a document of them is sorted by its writer."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def dot(edges: DataFrame) -> str:
    quote = lambda s: '"' + s.replace('"', '\\"') + '"'
    return "graph g {\n" + "".join(f"  {quote(r.src)} -- {quote(r.dst)} [label={quote(r.type)}];\n" for r in edges.orderBy("src", "dst", "type").collect()) + "}\n"


def svg(edges: DataFrame, size: int = 800) -> str:
    from daybook.operators.graph import spring_layout

    links = [(r.src, r.dst) for r in edges.orderBy("src", "dst", "type").collect()]
    at = spring_layout(sorted({n for pair in links for n in pair}), links)
    lo = [min((p[k] for p in at.values()), default=0) for k in (0, 1)]
    hi = [max((p[k] for p in at.values()), default=1) for k in (0, 1)]
    xy = {n: [20 + (size - 40) * (p[k] - lo[k]) / max(hi[k] - lo[k], 1e-9) for k in (0, 1)] for n, p in at.items()}
    lines = "".join(f'<line x1="{xy[a][0]:.1f}" y1="{xy[a][1]:.1f}" x2="{xy[b][0]:.1f}" y2="{xy[b][1]:.1f}" stroke="#999"/>' for a, b in links)
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="5"><title>{escape(n)}</title></circle>' for n, (x, y) in xy.items())
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{lines}{dots}</svg>'
