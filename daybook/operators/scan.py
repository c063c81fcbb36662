"""Concentration scan: who lobbies the agency that they once held office in, and how exclusively."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.durable import release_shuffles, save


#: Agencies in one number of a mask.
BITS = 60


def masks(agencies: Column, names: list[str]) -> dict[str, Column]:
    """The agencies of an array as bits of numbers, by their place in ``names``, the registry: ``BITS`` a number, as many numbers as the registry needs."""
    bit = lambda i: F.when(F.array_contains(agencies, names[i]), F.lit(1 << i % BITS)).otherwise(F.lit(0))
    return {f"mask{k // BITS}": F.coalesce(reduce(Column.__add__, (bit(i) for i in range(k, min(k + BITS, len(names))))), F.lit(0)).cast("long") for k in range(0, len(names), BITS)}


def _masks(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("mask")]


def appearances(rows: DataFrame, filings: DataFrame, person: str, firm: str, filing: str) -> DataFrame:
    """One row a person, firm and filing, written once: what of ``income, client_name, filing_year, filing_period, segment`` the filing has, ``times`` (the person's rows), the last ``covered_position``, the sum of ``amount`` where rows have one, and the ``masks`` of the agencies that any row of the filing names.

    Profiles and agency counts both come from it, so lobbyists and filings meet in one join. Rows are shuffled by filing and sorted once, for the rows of a person, the masks of the filing and the join alike. The shuffle files go before the table is used."""
    marks, amount = _masks(rows), [c for c in ("amount",) if c in rows.columns]
    facts = [c for c in ("income", "client_name", "filing_year", "filing_period", "segment") if c in filings.columns]
    dealt = rows.select(filing, person, "covered_position", *amount, *marks).repartition(F.col(filing))
    own = dealt.groupBy(filing, person).agg(F.count(F.lit(1)).alias("times"), F.max("covered_position").alias("covered_position"), *(F.sum(c).alias(c) for c in amount), *(F.bit_or(c).alias(c) for c in marks))
    named = own.withColumns({c: F.bit_or(c).over(Window.partitionBy(filing)) for c in marks})
    one = filings.select(filing, firm, *facts).repartition(F.col(filing)).groupBy(filing, firm).agg(*(F.max(c).alias(c) for c in facts), F.count(F.lit(1)).alias("__n"))
    once = named.join(one, filing).withColumns({c: F.col(c) * F.col("__n") for c in ["times", *amount]}).drop("__n")
    out = save(once, "appearances")
    release_shuffles(out.sparkSession)
    return out


def shares(once: DataFrame, names: list[str], person: str, firm: str, agency: str, min_filings: int, min_conc: float) -> DataFrame:
    """Persons, firms and agencies that pass both limits, with ``total_filings, agency_filings, covered_position`` and the exact ``share``.

    Appearances are shuffled once, by person and firm, and counted as they come, all agencies side by side; a row an agency is made of the counts that pass."""
    dealt = once.select(person, firm, "covered_position", *_masks(once)).repartition(F.col(person), F.col(firm))
    n = [F.sum(F.getbit(f"mask{i // BITS}", F.lit(i % BITS)).cast("long")).alias(f"__{i}") for i in range(len(names))]
    pairs = dealt.groupBy(person, firm).agg(F.count(F.lit(1)).alias("total_filings"), F.max("covered_position").alias("covered_position"), *n).where(F.col("total_filings") >= min_filings)
    share = lambda x: x.cast("double") / F.col("total_filings").cast("double")
    found = F.array_compact(F.array(*(F.when((F.col(f"__{i}") > 0) & (share(F.col(f"__{i}")) >= min_conc), F.struct(F.lit(name).alias("name"), F.col(f"__{i}").alias("n"))) for i, name in enumerate(names))))
    told = pairs.select(person, firm, "total_filings", "covered_position", F.explode(found).alias("__f"))
    told = told.select(person, firm, "total_filings", "covered_position", F.col("__f.name").alias(agency), F.col("__f.n").alias("agency_filings"))
    return told.withColumn("share", share(F.col("agency_filings")))


def scored(passed: DataFrame, seniority: Column) -> DataFrame:
    """Candidates with ``concentration`` and ``score`` in place of the share, unsorted."""
    score = F.round(F.col("share") * F.ln(F.col("total_filings") + F.lit(1.0)) * seniority, 4)
    return passed.withColumn("score", score).withColumn("concentration", F.round("share", 4)).drop("share")


def profiles(once: DataFrame, chosen: DataFrame, person: str, firm: str, filing: str, source: Column | None = None) -> DataFrame:
    """One row a person and firm of ``chosen``, a short list that is broadcast: clients, years, and income both by row (``total_income``, inflated by fan-out as the original has it) and by filing (``total_income_dedup``); the sample filing's parts, and the position unless ``chosen`` has it, are maxima, each by itself."""
    more = ([] if source is None else [F.max(source).alias("sample_source")]) + ([] if "covered_position" in chosen.columns else [F.max("covered_position").alias("covered_position")])
    rows = once.join(F.broadcast(chosen.select(person, firm).distinct()), [person, firm], "left_semi")
    return rows.groupBy(person, firm).agg(
        F.count_distinct("client_name").alias("n_clients"), F.sum(F.col("income") * F.col("times")).alias("total_income"), F.sum("income").alias("total_income_dedup"),
        F.min("filing_year").alias("first_year"), F.max("filing_year").alias("last_year"), F.max(F.col(filing).cast("string")).alias("sample_uuid"), *more,
    )


def top_clients(once: DataFrame, names: list[str], chosen: DataFrame, person: str, firm: str, agency: str, n: int = 5) -> DataFrame:
    """The ``n`` clients with most filings that name the agency, ties by name, as one string, for the ``chosen`` persons, firms and agencies only, a short list that is broadcast. The window ranks and nothing else, so Spark keeps ``n`` rows a group while it sorts."""
    keys = [person, firm, agency]
    wanted = chosen.select(*keys, (F.array_position(F.array(*map(F.lit, names)), F.col(agency)) - 1).cast("int").alias("__i"))
    mask = F.element_at(F.array(*_masks(once)), F.expr(f"__i div {BITS}").cast("int") + 1)
    rows = once.select(person, firm, "client_name", *_masks(once)).join(F.broadcast(wanted), [person, firm]).where(F.getbit(mask, F.col("__i") % BITS) == 1)
    counts = rows.groupBy(*keys, "client_name").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "client_name")
    ranked = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("place", "client_name")))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["client_name"]), " | ").alias("top_clients_str"))


def detailed(once: DataFrame, names: list[str], chosen: DataFrame, person: str, firm: str, agency: str, filing: str, source: Column | None = None) -> DataFrame:
    """``chosen`` with profile and clients; the ranking comes first, so these are found for as many rows as are shown."""
    return chosen.join(profiles(once, chosen, person, firm, filing, source), [person, firm]).join(top_clients(once, names, chosen, person, firm, agency), [person, firm, agency])


def ranked(candidates: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows with their rank; only they meet in one task."""
    best = candidates.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
