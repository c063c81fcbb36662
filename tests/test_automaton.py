"""Mentions of many names in one pass against a pattern for each."""

import random

from pyspark.sql import functions as F

from daybook.functions.text import snippet, term_pattern
from daybook.operators import automaton, mentions

rng = random.Random(3)
PARTS = ["Acme", "Land O'Lakes", "AT&T", "A&M (Texas)", "(old) Co.", "Straße", "Müller", "Σας", "K2", "St. “Mary”", "İzmir", "O'", "_under", "9th", "foo bar", "foo", "bar baz", "é", "x"]
CLIENTS = [(f"client {i}", [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(0, 4))]) for i in range(120)] + [("Acme", []), ("same", ["foo", "foo bar"]), ("other", ["foo bar", "foo"]), ("nothing", [" ", ""]), ("Land O’Lakes", [])]


def some_text():
    words = [rng.choice([*PARTS, "acme's", "ACMEs", "land o’lakes", "at&tx", "MÜLLER", "strasse", "ΣΑΣ", "K2", "fóo", "é", "́x", "İZMİR", "izmir", "\n", "FOO\tBAR", "word"]) for _ in range(rng.randrange(12))]
    return rng.choice(["", " ", "-", "("]).join(words) if rng.random() < 0.3 else " ".join(words)


def test_many_names_against_one_pattern_each(spark):
    rows = [(i, f"m{i % 7}", f"2024-01-{i % 28 + 1:02d}", some_text() if i % 9 else None, some_text() if i % 5 else None, "kept") for i in range(400)]
    press = spark.createDataFrame(rows, "doc_id long, member_name string, date string, title string, text string, client_note string")
    got = {(r.client, r.doc_id): r.snippet for r in mentions.search(press, CLIENTS, key=("doc_id",)).collect()}
    marks = [(label, term_pattern(aliases or [label])) for label, aliases in CLIENTS]
    cells = [F.when(F.col("text").rlike(m), snippet(F.col("text"), m)).when(F.col("title").rlike(m), snippet(F.col("title"), m)).alias(f"c{i}") for i, (_, m) in enumerate(marks) if m]
    labels = [label for label, m in marks if m]
    want = {}
    for r in press.select("doc_id", *cells).collect():
        want |= {(label, r[0]): s for label, s in zip(labels, r[1:], strict=True) if s is not None}
    assert got == want and len(got) > 1000
    first = {r.doc_id: r.client for r in mentions.attribute(press, CLIENTS).collect()}
    place = {label: i for i, (label, _) in enumerate(CLIENTS)}
    best = {}
    for label, doc in want:
        best[doc] = min(best.get(doc, label), label, key=place.get)
    assert first == best


def test_one_pass_of_python(spark):
    press = spark.createDataFrame([(1, "m", "d", "t", "Acme")], "doc_id long, member_name string, date string, title string, text string")
    plan = mentions.search(press, CLIENTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan.upper()
    assert mentions.search(press.where("false"), CLIENTS).count() == 0 and mentions.attribute(press, []).count() == 0


def test_folding_is_by_character():
    for c in "aZ’“ßſİıΣςµKé😀":
        assert len(automaton.fold(c + "A")) == 2
    assert automaton.fold("KſςΣ") == "ksσσ"
