"""The segment index against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from daybook.functions.text import indel, sorted_words
from daybook.operators import fuzzy

WORDS = ["steel", "institute", "american", "assoc", "water", "works", "of", "the", "group", "energy", "health", "farm", "bureau", "trade", "council", "co", "a", "zz", "national"]


def some_names(count, seed=2):
    """Names of four first words, each with a copy that some letters were changed in."""
    rng, names = random.Random(seed), set()
    while len(names) < count:
        name = f"{rng.choice(['american', 'acme', 'zeta', 'a'])} {' '.join(rng.choice(WORDS) for _ in range(rng.randrange(5)))}".strip()
        changed = list(name)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(changed) + 1)
            if rng.random() < 0.5 and len(changed) > 3 and at < len(changed):
                changed.pop(at)
            else:
                changed.insert(at, rng.choice("abcde "))
        names |= {name, " ".join("".join(changed).split())}
    return sorted(names)[:count]


def all_pairs(names, threshold):
    out, blocks = {}, {}
    for n in names:
        blocks.setdefault(n.split(" ")[0], []).append(n)
    for members in blocks.values():
        forms = [sorted_words(n) for n in members]
        for i, a in enumerate(forms):
            for j in range(i + 1, len(forms)):
                ratio = indel(a, forms[j])
                if ratio >= threshold:
                    out[members[i], members[j]] = ratio
    return out


def joined(spark, names, threshold):
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,), ("",)], "norm string")
    form = F.array_join(F.array_sort(F.split("norm", " ")), " ")
    return fuzzy.similar(df, threshold, F.split_part("norm", F.lit(" "), F.lit(1)), form)


@pytest.mark.parametrize(("count", "threshold", "hot"), [(2000, 92.0, 50), (400, 80.0, 2), (400, 97.0, 50), (200, 45.0, 10), (300, 100.0, 1)])
def test_against_all_pairs(spark, monkeypatch, count, threshold, hot):
    monkeypatch.setattr(fuzzy, "HOT", hot)
    names = some_names(count)
    want = all_pairs(names, threshold)
    assert {(r.a, r.b): r.ratio for r in joined(spark, names, threshold).collect()} == want
    assert want or threshold == 100.0


def test_pairs_that_meet_stay_near_the_result(spark):
    """One first word and one last word for all: of two million pairs few are looked at."""
    rng = random.Random(7)
    syllables = [a + b + c for a in "bcdfghklmnprstvw" for b in "aeiou" for c in ("", "n", "r")]
    names = sorted({"american " + " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(1, 4))) + " council" for _ in range(2000)})
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    rows = fuzzy.described(df, F.split_part("norm", F.lit(" "), F.lit(1)), F.array_join(F.array_sort(F.split("norm", " ")), " "), "norm")
    assert fuzzy.candidates(rows, 92.0).count() <= 4 * len(all_pairs(names, 92.0)) + 500


def test_edges(spark):
    assert joined(spark, [], 92.0).count() == 0
    assert joined(spark, ["only one"], 92.0).count() == 0
    same_form = joined(spark, ["a b c", "a c b"], 92.0).collect()
    assert [(r.a, r.b, r.ratio, r.gap) for r in same_form] == [("a b c", "a c b", 100.0, 0)]
