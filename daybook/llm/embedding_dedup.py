"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of one label link when their cosine is at least ``threshold``, that is when the unit vectors lie within ``eps`` of
each other. Equal vectors are one representative with a count. Representatives are rotated onto principal directions (a rotation keeps distances, so
directions fitted on a bounded sample do), sorted by label and by the grid cells of their leading coordinates, and cut into
blocks with bounding boxes. The join recurses on intervals of this sequence: a label's whole sequence is joined with itself, an interval is cut into some ``2 ^ FANOUT`` smaller ones, and pairs
of intervals whose boxes are further apart than ``eps`` are skipped with all that is in them. Down to blocks the levels of intervals are tables of boxes, joined level by level; a pair of
blocks is halved again and again in one task, and small rests are compared in double precision. Products within ``CLOSE`` of the threshold are taken anew in one fixed order of sums, so a pair at the threshold
is told alike wherever it is met.

A block pair gives one row for each vector that links in it, its number of links and the smallest id that it hangs together with; pairs of
vectors are never written. Components are those rows' connected components. What a hot label or a
large group of copies adds is more block pairs, dealt over all tasks.

Vectors that are null, empty or zero, hold null or non-finite components, or have no label or id, link with nothing and are their own
component; so do vectors of different length. Rows with an equal id count as vectors each. An empty table gives an empty one. Columns beside the three are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.components import connected_components
from daybook.operators.durable import save, scratch
from daybook.operators.skew import lookup

#: Bytes of vectors in a block, about; rows that are compared without halving them further, leading coordinates that cells and boxes have.
BLOCK, LEAF, LEADING = 1 << 18, 64, 12
#: Smaller intervals in an interval, as a power of two, and blocks that meet one other block in one task.
FANOUT, STAR = 5, 16
CLOSE = 1e-12
#: Representatives that the principal directions are fitted on, at most; those with the smallest hashes.
FIT_ROWS = 20_000


def representatives(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, k, v`` of every row; ``k`` names the label and the exact vector, null where the row can't link."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"), F.when(F.coalesce(sound, F.lit(False)), F.md5(F.concat_ws("|", F.col(label).cast("string"), F.array_join(v.cast("array<string>"), ",")))).alias("k"))


def directions(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, an orthonormal matrix whose first rows are the principal directions of a bounded sample of unit vectors."""
    rows = reps.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).toPandas()
    out = {}
    for size in {len(v) for v in rows["v"]}:
        x = np.stack([v for v in rows["v"] if len(v) == size])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x = x - x.mean(axis=0)
        out[size] = np.linalg.eigh(x.T @ x)[1].T[::-1].copy()
    return out


def _leading(x: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    """Leading rotated coordinates of unit vectors, zeros where there are fewer; a length that the sample missed keeps its own axes."""
    axes = turn.get(x.shape[1])
    y = x @ axes[:LEADING].T if axes is not None else x[:, :LEADING]
    return np.pad(y, ((0, 0), (0, LEADING - y.shape[1])))


def _unit(flat: np.ndarray) -> np.ndarray:
    big = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / big  # squares of huge and tiny components stay finite
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def grid_order(reps: DataFrame, eps: float, turn: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of consecutive representatives in grid order: ``label, dim, lo, hi, ids, counts, vectors`` with the box of the leading coordinates."""
    cells = ", ".join(f"c{i} int" for i in range(LEADING))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.asarray(lists.value_lengths())
            values, ends = np.asarray(lists.flatten()), np.cumsum(sizes)
            grid = np.zeros((len(sizes), LEADING), dtype=np.int32)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = _unit(values[(ends[rows] - size)[:, None] + np.arange(size)])
                grid[rows] = np.floor(_leading(x, turn) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), *(pa.array(grid[:, i]) for i in range(LEADING))], names=[*batch.schema.names, "dim", *(f"c{i}" for i in range(LEADING))])

    keys = ["label", "dim", *(f"c{i}" for i in range(LEADING)), "rep"]
    n = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = reps.select("rep", "label", "n", "v").mapInArrow(place, f"rep long, label string, n long, v array<double>, dim int, {cells}")
    ordered = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("rep", "label", "n", "v", "dim")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x = np.array([r[3] for r in held], dtype=np.float64)
            y = _leading(_unit(x), turn)
            out = [[held[0][1]], [held[0][4]], [y.min(axis=0)], [y.max(axis=0)], [np.array([r[0] for r in held], dtype="<i8").tobytes()], [np.array([r[2] for r in held], dtype="<i8").tobytes()], [x.tobytes()]]
            kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["label", "dim", "lo", "hi", "ids", "counts", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("rep", "label", "n", "v", "dim")), strict=True):
                if held and (len(held) >= max(LEAF, BLOCK // (8 * held[0][4])) or (row[1], row[4]) != (held[0][1], held[0][4])):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    made = ordered.mapInArrow(cut, "label string, dim int, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary")
    return save(made.withColumn("block", F.monotonically_increasing_id()), "grid")


def _levels(blocks: DataFrame) -> tuple[list[DataFrame], list[tuple[int, int]]]:
    """Tables of intervals from blocks up to one interval a label and length, ``label, dim, p, n, lo, hi`` with an interval's numbers (of the partition and of the place in it) and its box; and by how many bits both numbers shrink from each table to the next."""
    place = F.col("block")
    at = blocks.select("label", "dim", F.shiftright(place, 33).alias("p"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("n"), "lo", "hi")
    most = at.agg(F.max("p").alias("p"), F.max("n").alias("n")).first()
    tables, shifts, p, n = [at], [], most.p or 0, most.n or 0
    while p or n:  # places are taken together first, then partitions
        shifts.append((0, FANOUT) if n else (FANOUT, 0))
        up = tables[-1].select("label", "dim", F.shiftright("p", shifts[-1][0]).alias("p"), F.shiftright("n", shifts[-1][1]).alias("n"), "lo", "hi")
        box = [F.array(*(least(F.col(c)[i]) for i in range(LEADING))).alias(c) for c, least in (("lo", F.min), ("hi", F.max))]
        tables.append(save(up.groupBy("label", "dim", "p", "n").agg(*box), "intervals"))
        p, n = p >> shifts[-1][0], n >> shifts[-1][1]
    return tables, shifts


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``a, b`` (``a <= b``) of blocks of one label and length whose boxes are within ``eps``, from the whole sequences down."""
    tables, shifts = _levels(blocks)
    pairs = tables[-1].select("label", "dim", F.col("p").alias("a_p"), F.col("n").alias("a_n"), F.col("p").alias("b_p"), F.col("n").alias("b_n"))
    apart = F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(apart, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * (1 + 1e-9)
    once = (F.col("a_p") < F.col("b_p")) | (F.col("a_p") == F.col("b_p")) & (F.col("a_n") <= F.col("b_n"))
    for table, (by_p, by_n) in zip(reversed(tables[:-1]), reversed(shifts), strict=True):
        parents = pairs.toDF("label", "dim", "a_up_p", "a_up_n", "b_up_p", "b_up_n")
        for side in ("a", "b"):
            inner = table.select("label", "dim", *(F.col(c).alias(f"{side}_{c}") for c in ("p", "n", "lo", "hi")), F.shiftright("p", by_p).alias(f"{side}_up_p"), F.shiftright("n", by_n).alias(f"{side}_up_n"))
            parents = parents.join(inner, ["label", "dim", f"{side}_up_p", f"{side}_up_n"])
        pairs = save(parents.where(once & near).select("label", "dim", "a_p", "a_n", "b_p", "b_n"), "pairs")
    number = lambda side: F.shiftleft(f"{side}_p", 33).bitwiseOR(F.col(f"{side}_n")).alias(side)
    return pairs.select(number("a"), number("b"))


class _Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def join_blocks(a: np.ndarray, b: np.ndarray | None, counts_a: np.ndarray, counts_b: np.ndarray | None, threshold: float, eps: float, turn: dict[int, np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Links of each row of ``a`` and then of ``b`` (of ``a`` alone with itself where ``b`` is None), weighted by the other's count, and each row's root in the forest of links."""
    same = b is None
    x = a if same else np.concatenate([a, b])
    counts = counts_a if same else np.concatenate([counts_a, counts_b])
    unit = _unit(x)
    y = _leading(unit, turn)
    links, forest = np.zeros(len(x), dtype=np.int64), _Forest(len(x))

    def visit(lo: int, hi: int, low: int, high: int) -> None:
        p, q = y[lo:hi], y[low:high]
        gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
        if gap @ gap > eps * eps * (1 + 1e-9):
            return
        if hi - lo <= LEAF and high - low <= LEAF:
            product = unit[lo:hi] @ unit[low:high].T
            near = product >= threshold
            for i, j in np.argwhere(np.abs(product - threshold) <= CLOSE).tolist():
                near[i, j] = math.fsum((unit[lo + i] * unit[low + j]).tolist()) >= threshold
            if lo == low:
                near &= ~np.eye(hi - lo, dtype=bool)
            links[lo:hi] += near @ counts[low:high]
            if lo != low:
                links[low:high] += counts[lo:hi] @ near
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                there = low + np.flatnonzero(near[i])
                for j in there[forest.up[there] != forest.root(lo + i)].tolist():
                    forest.union(lo + i, j)
            return
        mid, middle = (lo + hi) // 2, (low + high) // 2
        if lo == low:
            visit(lo, mid, lo, mid)
            visit(mid, hi, mid, hi)
            visit(lo, mid, mid, hi)
        elif hi - lo >= high - low:
            visit(lo, mid, low, high)
            visit(mid, hi, low, high)
        else:
            visit(lo, hi, low, middle)
            visit(lo, hi, middle, high)

    if same:
        visit(0, len(x), 0, len(x))
    else:
        visit(0, len(a), len(a), len(x))
    return links, [forest.root(i) for i in range(len(x))]


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """``<key>, n_links, component_id, kept`` of every row."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    rows = representatives(vectors, key, vector, label)
    sound = rows.where("k is not null")
    with scratch() as keep:
        reps = save(sound.groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "reps")
        turn = directions(reps)
        blocks = grid_order(reps, eps, turn)
        load = blocks.select("block", "dim", "ids", "counts", "vectors")
        pairs = save(block_pairs(blocks, eps), "pairs")
        # a block is sent once for every ``STAR`` blocks that it meets
        stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
        members = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"), F.col("b").alias("block"))
        heads = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("a").alias("block"))
        n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = members.unionByName(heads).join(load, "block").select("a", "part", "member", "block", "dim", "ids", "counts", "vectors")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
            for batch in batches:
                for a, member, block, dim, *payload in zip(*(batch.column(c) for c in ("a", "member", "block", "dim", "ids", "counts", "vectors")), strict=True):
                    ids, counts, x = (np.frombuffer(p.as_buffer(), dtype=kind) for p, kind in zip(payload, ("<i8", "<i8", "<f8"), strict=True))
                    x = x.reshape(-1, dim.as_py())
                    if not member.as_py():
                        first = ids, counts, x
                        continue
                    own, own_counts, own_x = first
                    same = a == block
                    links, roots = join_blocks(own_x, None if same else x, own_counts, None if same else counts, threshold, eps, turn)
                    every = own if same else np.concatenate([own, ids])
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(links[at]), pa.array(every[np.array(roots, dtype=np.int64)[at]])], names=["rep", "links", "other"])

        found = save(dealt.repartition(n, "a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(compare, "rep long, links long, other long"), "links")
        total = found.groupBy("rep").agg(F.sum("links").alias("links"))
        parts = connected_components(found, "rep", "other").select(F.col("node").alias("rep"), "component")
        told = reps.select("k", "rep", "n").join(total, "rep", "left").join(parts, "rep", "left")
        told = keep(save(told.select("k", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "told"))
    members = rows.select("id", "k")
    done = lookup(members, told, "k", "n", vectors.count(), ["n_links", "component_id"])
    out = done.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def oracle(source: str = "embeddings") -> str:
    """DuckDB SQL for ``vec_id, n_links, component_id, kept`` of a table with distinct integer ids: the cosine of every pair of a label. For small tables."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {source} WHERE label IS NOT NULL AND len(embedding) > 0),
sound AS (SELECT * FROM v WHERE list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
ends AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS root FROM {source} UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.id WHERE reach.root < ends.b),
links AS (SELECT a, count(*) AS n FROM ends GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept FROM {source} e LEFT JOIN links l ON l.a = e.vec_id JOIN (SELECT id, min(root) AS root FROM reach GROUP BY 1) r ON r.id = e.vec_id"""
