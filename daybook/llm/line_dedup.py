"""Line dedup: later copies of repeated runs of lines are deleted. DataFrame operations only.

A document is the sequence of its lines. A run of consecutive lines with at least ``min_words`` words that
occurs earlier too (in an earlier document by id, or further up in the same one) is deleted line by line; the first
occurrence stays. Runs are compared by the ranks of prefix doubling: the rank of the ``2^k`` lines from a position is the first position
with the same lines, and comes from two ranks of the level below, so one rank pair names a run of any length: its first and its last ``2^k`` lines.

A longest repeated run need not be searched for: whether a line lies in some repeated run with enough words is settled
by the shortest run with enough words that starts at each position and the shortest one that ends there. Each line of a repeated run lies in such
a shortest run inside it, and equal runs have equal shortest runs, so the first position of each group of equal shortest runs decides. Deleted lines therefore make up
exactly the maximal repeated runs.

Lines that occur once split the sequences before anything else, which leaves a fraction of the rows; counts combine on the map side and rows find their rank by a join that broadcasts hot lines only.

Null texts stay null, empty ones have one empty line; a text all of whose lines go becomes empty. Rows with equal id and
text are one document and get the same deletions. Null ids come last. An empty table gives an empty one. Extra columns pass through; the
columns ``n_lines`` and ``n_removed`` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.durable import drop, save, shrink_driver
from daybook.operators.skew import lookup

MIN_WORDS = 50


def _positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``pos, doc, i, id, __h, line, words`` of every line. Positions follow the order of ids and of lines, are consecutive in a document and ``doc`` is its first one."""
    lines = F.split(F.col(text), "\n", -1)
    narrow = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.unhex(F.md5(text)).alias("__h"), F.transform(lines, lambda x: F.struct(F.unhex(F.md5(x)).alias("line"), F.regexp_count(x, F.lit(r"\S+")).alias("words"))).alias("lines"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = narrow.dropDuplicates(["id", "__h"]).repartitionByRange(n, F.col("id").asc_nulls_last(), "__h").sortWithinPartitions(F.col("id").asc_nulls_last(), "__h")
    rows = dealt.select("id", "__h", F.posexplode("lines").alias("i", "x")).select(F.monotonically_increasing_id().alias("pos"), "i", "id", "__h", "x.line", "x.words")
    return save(rows.withColumn("doc", F.col("pos") - F.col("i")), "lines")


def _first(rows: DataFrame, pair: list, total: int) -> DataFrame:
    """``rows`` whose ``pair`` occurs more than once, with the smallest ``pos`` of the pair as ``rank``."""
    named = rows.withColumn("__k", F.xxhash64(*pair) if len(pair) > 1 else F.col(pair[0]))
    groups = named.groupBy(*(pair if len(pair) > 1 else ["__k"])).agg(F.min("pos").alias("rank"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if len(pair) > 1:
        # the pair itself is the key; its text form keeps the lookup to one column
        text = F.concat_ws(",", *(F.col(c).cast("string") for c in pair))
        named, groups = rows.withColumn("__k", text), groups.withColumn("__k", text)
    else:
        named, groups = rows.withColumn("__k", F.hex(pair[0])), groups.withColumn("__k", F.hex("__k"))
    found = lookup(named, save(groups.select("__k", "rank", "n"), "ranks"), "__k", "n", total, ["rank"])
    return found.where("rank is not null").drop("__k")


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """``start, stop`` of the shortest runs with enough words from each position and up to each position, inside stretches of repeated lines."""
    by_doc = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(by_doc))
    so_far = Window.partitionBy("doc", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("words").over(so_far)).withColumn("before", F.col("upto") - F.col("words"))
    # marks and targets in one sorted pass: the first stop whose count reaches a target, the last start whose count is low enough
    ends = rows.select("doc", "run", F.col("upto").alias("v"), F.col("pos").alias("mark"), F.lit(None).cast("long").alias("of"))
    wanted = rows.select("doc", "run", (F.col("before") + min_words).alias("v"), F.lit(None).cast("long").alias("mark"), F.col("pos").alias("of"))
    down = Window.partitionBy("doc", "run").orderBy(F.desc("v"), F.col("mark").isNull(), F.desc("mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ends.unionByName(wanted).withColumn("stop", F.min("mark").over(down)).where("of is not null and stop is not null").select(F.col("of").alias("start"), "stop")
    begins = rows.select("doc", "run", F.col("before").alias("v"), F.col("pos").alias("mark"), F.lit(None).cast("long").alias("of"))
    needed = rows.select("doc", "run", (F.col("upto") - min_words).alias("v"), F.lit(None).cast("long").alias("mark"), F.col("pos").alias("of"))
    up = Window.partitionBy("doc", "run").orderBy("v", F.col("mark").isNull(), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = begins.unionByName(needed).withColumn("start", F.max("mark").over(up)).where("of is not null and start is not null").select("start", F.col("of").alias("stop"))
    return ahead.unionByName(back).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, __h, i`` of every line to delete."""
    lines = _positions(docs, key, text)
    total = lines.count()
    alone = save(_first(lines.select("pos", "doc", "i", "line", "words"), ["line"], total).select("pos", "doc", "words", "rank"), "level")
    windows = save(_windows(alone.select("pos", "doc", "words"), min_words).withColumn("size", F.col("stop") - F.col("start") + 1), "runs")
    longest = windows.agg(F.max("size")).first()[0] or 0
    rank = alone.drop("words")
    gone = None
    k = 0
    none = F.lit(None).cast("long")
    while 1 << k <= longest:
        span = 1 << k
        level = windows.where(F.col("size").between(span, 2 * span - 1))
        a = rank.select(F.col("pos").alias("start"), F.col("rank").alias("a"))
        b = rank.select((F.col("pos") + span).alias("after"), F.col("rank").alias("b"))
        named = level.withColumn("after", F.col("stop") + 1).join(a, "start").join(b, "after")
        rows = named.select(F.col("start").alias("pos"), none.alias("doc"), "stop", "size", "a", "b")
        k += 1
        if 1 << k <= longest:
            follows = rank.withColumn("next", F.lead("rank", span).over(Window.partitionBy("doc").orderBy("pos"))).withColumn("at", F.lead("pos", span).over(Window.partitionBy("doc").orderBy("pos")))
            # the row ``span`` rows on is the line ``span`` lines on only if all lines between are repeated too
            both = follows.where(F.col("at") == F.col("pos") + span)
            # the runs of this level and the ranks of the next are named in one go, told apart by the size: half the plans, which is what the driver's memory goes to
            rows = rows.unionByName(both.select("pos", "doc", none.alias("stop"), F.lit(0).cast("long").alias("size"), F.col("rank").alias("a"), F.col("next").alias("b")))
        found = save(_first(rows, ["size", "a", "b"], max(1, total)).select("pos", "doc", "stop", "rank"), "level")
        repeats = found.where("stop is not null and rank < pos").select(F.col("pos").alias("start"), "stop")
        gone = repeats if gone is None else gone.unionByName(repeats)
        if span == 1:
            drop(alone)
        rank = found.where("stop is null").select("pos", "doc", "rank")
        shrink_driver(docs.sparkSession)
    if gone is None:
        return lines.select("id", "__h", "i").where("false")
    # starts and stops of deleted runs, summed along the document; a stop counts from the line after it
    zero, one = F.lit(0), F.lit(1)
    edges = gone.select(F.col("start").alias("pos"), one.alias("begun"), zero.alias("ended")).unionByName(gone.select(F.col("stop").alias("pos"), zero.alias("begun"), one.alias("ended"))).groupBy("pos").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    touched = lines.join(edges, "pos", "left").na.fill(0, ["begun", "ended"])
    along = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return touched.withColumn("open", F.sum(F.col("begun") - F.col("ended")).over(along) + F.col("ended")).where("open > 0").select("id", "__h", "i")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deleted lines gone from ``text``, and ``n_lines`` (before) and ``n_removed``."""
    gone = repeated_lines(docs, key, text, min_words).groupBy(F.col("id").alias("__id"), F.col("__h").alias("__gone_h")).agg(F.collect_set("i").alias("__gone"))  # at most the lines of one document
    own = docs.drop("n_lines", "n_removed").withColumn("__h", F.unhex(F.md5(text)))
    both = own.join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__gone_h")), "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = both.withColumn("n_lines", n_lines).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(F.lit(0).cast("long")))
    return out.withColumn(text, F.when(F.col("__gone").isNotNull(), left).otherwise(F.col(text))).drop("__h", "__id", "__gone_h", "__gone")


def oracle(min_words: int = MIN_WORDS, source: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, text, n_lines, n_removed`` of a table with distinct integer ids: every shortest run by its text."""
    return f"""
WITH src AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {source}),
l AS (SELECT doc_id, u.i AS i, lines[u.i] AS line, len(regexp_extract_all(lines[u.i], '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM src, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) u),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM l),
rep AS (SELECT c.*, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c WHERE line IN (SELECT line FROM l GROUP BY line HAVING count(*) > 1)),
win AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM rep a JOIN rep b ON a.doc_id = b.doc_id AND a.run = b.run AND b.i >= a.i AND b.upto - a.upto + a.w >= {min_words} GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM rep a JOIN rep b ON a.doc_id = b.doc_id AND a.run = b.run AND b.i >= a.i AND b.upto - a.upto + a.w >= {min_words} GROUP BY b.doc_id, b.i),
named AS (SELECT win.doc_id, s, e, list(rep.line ORDER BY rep.i) AS body FROM win JOIN rep ON rep.doc_id = win.doc_id AND rep.i BETWEEN s AND e GROUP BY 1, 2, 3),
firsts AS (SELECT *, min({{'d': doc_id, 's': s}}) OVER (PARTITION BY body) AS f FROM named),
gone AS (SELECT DISTINCT firsts.doc_id, g.i FROM firsts, LATERAL (SELECT unnest(range(s, e + 1)) AS i) g WHERE f.d < firsts.doc_id OR f.s < s),
cut AS (SELECT src.doc_id, list(gone.i) AS drops FROM src JOIN gone USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN drops IS NULL THEN text ELSE array_to_string([lines[j] FOR j IN range(1, len(lines) + 1) IF NOT list_contains(drops, j)], chr(10)) END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(drops), 0) AS BIGINT) AS n_removed
FROM src LEFT JOIN cut USING (doc_id)"""
