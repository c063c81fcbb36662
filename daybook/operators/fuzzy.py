"""Similarity join of short names by a segment index: no pair is looked at that shares none of its segments.

Two names are alike from ``threshold`` (above 0, to 100) on when ``100 * (1 - d / (l + m)) >= threshold``, with ``l`` and ``m`` their lengths and ``d`` the insertions and deletions between them. So they
may be at most ``k = (1 - threshold / 100) * (l + m)`` apart. The shorter one is cut into segments; each insertion or deletion spoils at most one of them, so of any ``k + 2`` segments two
stand unspoilt in the longer name, moved by at most the insertions or deletions before them. Hence the index:

- of each name the ``k + 2`` rarest of its segments, by block, length, number of the segment and content (an integer digest of these). A segment that many names of a block have, such as
  the block's own word, is left out as long as there are others. Those that at most ``HOT`` names have are entries by themselves, of the others every two together: either a
  rare segment stands unspoilt, or two frequent ones do.
- each name looks up what it has at the places where a shorter or equally long name could have its segments, and every two of the frequent ones that it finds.

Names that meet are first compared by the parities of their letters and pairs of letters, which ``d`` changes bound, then by the built-in edit distance, which is at most ``d``, and only what is left by
the longest common subsequence. All three, and the digests, let through too much, never too little: the result is that of comparing all pairs.

A null block or form is alike to nothing, and so is an empty form. Equal rows count once. The rows that are looked up grow with the names' lengths, not with a block's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import indel_ratio
from daybook.operators.durable import save
from daybook.operators.skew import lookup

#: Letters of a segment where a name has more segments than it needs.
SEGMENT = 3
#: Names that may share a segment which is an entry by itself.
HOT = 50


def _apart(lengths: Column, threshold: float) -> Column:
    """How far names whose lengths sum to ``lengths`` may be apart; a hair more against rounding."""
    return F.floor(lengths * ((100 - threshold) / 100) + 1e-6).cast("int")


def _most(length: Column, threshold: float) -> Column:
    """How far a name may be apart from the longest one that it can be alike to."""
    return _apart(length + F.floor(length * ((200 - threshold) / threshold) + 1e-6), threshold)


def _count(length: Column, threshold: float) -> Column:
    """Into how many segments a name is cut."""
    return F.greatest(_most(length, threshold) + 2, F.floor(length / SEGMENT).cast("int"))


def _begin(i: Column, length: Column, n: Column) -> Column:
    return F.floor(i * length / n).cast("int")


def _parity(items: Column) -> Column:
    """A bit for each class of ``items`` (numbers): whether it occurs an odd number of times."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))


def _digest(length: Column, i: Column, content: Column) -> Column:
    return F.xxhash64("block", length.cast("int"), i.cast("int"), content)


def described(names: DataFrame, block: Column, form: Column, key: str) -> DataFrame:
    """A row a distinct name, written once: number, key, block, form, length and parities."""
    rows = names.select(F.col(key).alias("key"), block.cast("string").alias("block"), form.alias("form")).where("block IS NOT NULL AND form <> ''").distinct()
    place = F.sequence(F.lit(1), F.greatest(F.length("form") - 1, F.lit(1)))
    rows = rows.withColumns({
        "l": F.length("form"),
        "letters": _parity(F.transform(F.split("form", ""), lambda c: F.xxhash64(c))),
        "pairs": _parity(F.transform(place, lambda i: F.xxhash64(F.substring(F.col("form"), i, F.lit(2))))),
        "id": F.monotonically_increasing_id(),
    })
    return save(rows, "names")


def _twos(found: Column) -> Column:
    """A digest for every two of ``found``, an array of ``i, digest`` in order, that are of different segments."""
    behind = lambda x, at: F.transform(F.filter(found, lambda y: y["i"] > x["i"]), lambda y: F.xxhash64(x["digest"], y["digest"]))
    return F.flatten(F.transform(found, behind))


def index(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``digest, id`` of as many of each name's segments, the rarest ones, as must be looked at; and the ``digest`` of frequent segments among them."""
    n = _count(F.col("l"), threshold)
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    at, stop = _begin(F.col("i"), F.col("l"), n), _begin(F.col("i") + 1, F.col("l"), n)
    cut = cut.select("id", "l", "i", _digest(F.col("l"), F.col("i"), F.substring(F.col("form"), at + 1, stop - at)).alias("digest"))
    counts = save(cut.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "segments")
    total = counts.agg(F.sum("n")).first()[0] or 0
    told = lookup(cut, counts, "digest", "n", total, ["n"])
    chosen = told.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "i", "digest"))), 1, _most(F.first("l"), threshold) + 2).alias("all"))  # at most the name's length
    rare = F.transform(F.filter("all", lambda x: x["n"] <= HOT), lambda x: x["digest"])
    frequent = F.array_sort(F.transform(F.filter("all", lambda x: x["n"] > HOT), lambda x: F.struct(x["i"].alias("i"), x["digest"].alias("digest"))))
    chosen = save(chosen.select("id", rare.alias("rare"), frequent.alias("frequent")), "index")
    entries = chosen.select(F.explode(F.concat("rare", _twos(F.col("frequent")))).alias("digest"), "id")
    return entries, chosen.select(F.explode(F.col("frequent")["digest"]).alias("digest")).distinct()


def lookups(rows: DataFrame, threshold: float, frequent: DataFrame) -> DataFrame:
    """``digest, id`` of everything that stands in each name where a segment of a name that is not longer could have moved to, and of every two frequent segments found so."""
    l, s = F.col("l"), F.col("s")  # noqa: E741
    shortest = F.greatest(F.lit(1), F.ceil(l * (threshold / (200 - threshold)) - 1e-6).cast("int"))
    each = rows.select("id", "block", "form", "l", F.explode(F.sequence(shortest, l)).alias("s")).withColumn("k", _apart(l + s, threshold)).where("l - s <= k").withColumn("n", _count(s, threshold))
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at, stop = _begin(F.col("i"), s, F.col("n")), _begin(F.col("i") + 1, s, F.col("n"))
    # of k changes that make a name l - s longer, so many are insertions and so many deletions at most
    moved = F.sequence(-F.floor((F.col("k") - (l - s)) / 2).cast("int"), F.floor((F.col("k") + (l - s)) / 2).cast("int"))
    each = each.withColumns({"at": at, "size": stop - at}).withColumn("move", F.explode(moved)).where("at + move >= 0 AND at + move + size <= l")
    each = each.select("id", "s", "i", _digest(s, F.col("i"), F.substring(F.col("form"), F.col("at") + F.col("move") + 1, F.col("size"))).alias("digest"))
    twos = each.join(frequent, "digest", "left_semi").groupBy("id", "s").agg(F.array_sort(F.collect_set(F.struct("i", "digest"))).alias("found"))
    return each.select("digest", "id").unionByName(twos.select(F.explode(_twos(F.col("found"))).alias("digest"), "id"))


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of numbers ``x < y`` of names that share an entry of the index and whose parities and edit distance allow them to be alike, once each."""
    entries, frequent = index(rows, threshold)
    told = lambda df, n: df.join(rows.select("id", "form", "l", "letters", "pairs"), "id").select("digest", *(F.col(c).alias(f"{c}_{n}") for c in ("id", "form", "l", "letters", "pairs")))
    have, want = told(entries, "x"), told(lookups(rows, threshold, frequent).join(entries.select("digest").distinct(), "digest", "left_semi").distinct(), "y")
    k = _apart(F.col("l_x") + F.col("l_y"), threshold)
    differ = lambda c: F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y")))
    met = have.join(want, (have["digest"] == want["digest"]) & (F.col("id_x") != F.col("id_y")) & (differ("letters") <= k) & (differ("pairs") <= 3 * k) & (F.call_function("levenshtein", "form_x", "form_y", k) >= 0))
    return met.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct()


def similar(names: DataFrame, threshold: float, block: Column, form: Column, key: str = "norm") -> DataFrame:
    """``a, b, ratio, gap`` of every pair of keys ``a < b`` in one block whose forms are alike from ``threshold`` on; ``gap`` is how much longer one form is."""
    rows = described(names, block, form, key)
    side = lambda n, k: rows.select(F.col("id").alias(n), F.col("key").alias(k), F.col("form").alias(f"{k}_form"))
    both = candidates(rows, threshold).join(side("x", "one"), "x").join(side("y", "two"), "y").where("one <> two")
    told = both.withColumn("ratio", indel_ratio("one_form", "two_form")).where(F.col("ratio") >= threshold)
    return told.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "ratio", F.abs(F.length("one_form") - F.length("two_form")).alias("gap"))
