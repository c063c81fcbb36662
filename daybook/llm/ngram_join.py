"""Similarity join of documents by their word 5-gram sets, as a T-occurrence search with skipped long lists.

Two documents link when their sets' Jaccard similarity is at least ``percent`` / 100, so two sets of sizes ``x`` and ``y`` must share
``T = ceil(percent * (x + y) / (100 + percent))`` shingles. An inverted list holds the documents of a shingle. As in DivideSkip, long lists (shingles of
many documents) aren't merged as far as ``T`` allows: each document leaves ``T - 1`` of its lists out, ``T`` the least that any partner shares, and
a partner must then turn up in one of the others, the shortest. Those are merged, by sorting over the
cluster. A pair that turns up is settled by binary probes of the larger sorted set, long lists included, against ``T``.

1. Equal sets become one representative; only it goes on.
2. Which lists are long is told by counts of hashed shingles, in a bitmap of fixed size. A bit only decides the order in which lists are used, so
   neither a missed nor a wrong bit can lose a link.
3. Representatives that agree on the smallest hash of a part of the hash space are compared with the head of their group, one comparison a
   member. The head is the member whose other groups are largest, that is the one least changed in its family, which nearly everything in
   the family that links at all links to. That ties near copies together before candidates are formed.
4. Lists are merged, and only those that hold documents of different parts go on. Two documents of such a list become a pair only if their
   sketches allow it: a sketch has the parity of the shingles in each of some two to four classes a shingle, so the classes in which two sketches
   differ are at most the shingles in which the sets do, and more of them than ``x + y - 2 T`` rule a link out. A pair that met in an
   earlier list isn't formed again: every document brings the first ``HEAD`` lists that it shares, and a list before the present one in both
   says so. Families of look-alikes below the threshold therefore don't become pairs. Lists of more than ``CHUNK`` documents are met chunk by chunk, in tasks of their own.
5. Pairs that wider sketches allow too are compared as stars, a centre with its partners, large stars in several parts.
6. Links found in 3 and 5 give the components. A pair left out in 4 is already connected, can't link or was formed elsewhere, so no component changes.

Null texts and texts without words have an empty set and link with nothing; fewer than five words are one shingle. Rows without an id are returned with a null component. Rows that
share an id are one node. Ids are integers; others raise. An empty table gives an empty one. Columns beside the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from daybook.llm.text import WordTable, text_steps
from daybook.operators.components import connected_components
from daybook.operators.durable import save, scratch
from daybook.operators.skew import lookup

WIDTH, PERCENT = 5, 75
#: Bits of the table of long lists, and how far above a bucket's mean count one task's and all tasks' must be for its lists to be long.
BITS, LOCAL, LONG = 24, 3, 8
#: Share of all documents from which a bucket's lists are dealt to ``SALT`` tasks, and the least number for it.
HOT_SHARE, HOT_LEAST, SALT = 200, 4096, 64
#: Parts of the hash space whose smallest hashes group likely copies.
PARTS = 6
#: Partners of one centre that are compared in one task.
STAR = 128
#: Documents of a list that meet in one task, each with as many others at most.
CHUNK = 2000
#: Documents of a list up to which all its pairs are looked at in one step.
SMALL_LIST = 32
#: Bits of a sketch for each shingle, at least, and of the smallest and the largest one: of those that go with every list, and of those that candidates are tried with before their texts are read.
SKETCH, WIDE = (2, 128, 2048), (4, 128, 1 << 15)
#: Lists that a document names to its partners, first ones first.
HEAD = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], table: WordTable, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in UTF-8. ``bytes.lower`` and ``bytes.split`` touch A-Z and the white space ``[\\x20\\x09-\\x0D]`` only."""
    lists = [t.lower().split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    words = np.fromiter((table[w] for ws in lists for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        joined = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(width if n > 0 else 0):
            joined = joined * _MIX + words[k : k + n]
        joined = _finish(joined)
        at = 0
        for size in sizes.tolist():
            if size >= width:
                h = np.sort(joined[at : at + size - width + 1])
                out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif size:
                whole = np.zeros(1, dtype=np.uint64)
                for w in words[at : at + size]:
                    whole = whole * _MIX + w
                out.append(_finish(whole + np.uint64(size)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += size
    return out


def required(x, y, percent: int = PERCENT):
    """``T``: shingles that sets of these sizes must share to link."""
    return -(-percent * (x + y) // (100 + percent))


def _bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags ``at`` of a bitmap of eight flags a byte."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def short_prefix(shingles: np.ndarray, long_lists: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Names of the ``n - T + 1`` lists that a document looks for partners in, ``T`` the least that any partner shares: short lists first, each kind by hash. A name is the highest 63 bits of the hash, below zero for short lists, so names sort in this order.

    Of the shingles that two sets share, the first in this order has at least ``T - 1`` shared ones after it in either set, so both prefixes hold it."""
    n = len(shingles)
    keep = n + percent * n // -100 + 1
    is_long = _bit(long_lists, (shingles >> np.uint64(64 - BITS)).astype(np.int64))
    names = (shingles >> np.uint64(1)).astype(np.int64)
    short = names[~is_long] + np.iinfo(np.int64).min
    return short[:keep] if len(short) >= keep else np.concatenate([short, names[is_long][: keep - len(short)]])


def sketch(shingles: np.ndarray, kind: tuple[int, int, int] = SKETCH) -> bytes:
    """Parity of the number of shingles in each of ``B`` classes, ``B`` a power of two. Halves of a sketch, taken together by exclusive or, make the sketch of half as many classes."""
    each, least, most = kind
    bits = min(max(least, 1 << (each * len(shingles) - 1).bit_length()), most)
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, sig, mins, sketch, wide`` of every row: the set's size, a 128-bit digest of the set and, unless it is empty, its smallest hash in each part of the hash space and its sketches; and rows of ``bucket, seen`` for crowded buckets of shingles of a task, counted above the task's mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crowd = WordTable(_word, 300_000), np.zeros(1 << BITS, dtype=np.uint16)
        names, kinds = ["id", "n", "sig", "mins", "sketch", "wide", "bucket", "seen"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        none = lambda k, m: pa.nulls(m, k)
        for batch in text_steps(batches, text, 2_000_000):
            sets = shingle_sets(_texts(batch, text), table)
            mins, sigs = [], []
            for s in sets:
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    mins.append(None)
                    continue
                mixed = _finish(s)  # another order than that of the lists
                part = (mixed >> np.uint64(32)) % np.uint64(PARTS)
                row = np.full(PARTS, np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(row, part.astype(np.int64), mixed)
                mins.append(row.view(np.int64))
            if sets:
                every = np.concatenate(sets) >> np.uint64(64 - BITS)
                at, n = np.unique(every, return_counts=True)
                crowd[at.astype(np.int64)] = np.minimum(crowd[at.astype(np.int64)] + n, 65535)  # enough to tell a long list
            sketches = [pa.array([sketch(s, kind) if len(s) else None for s in sets], pa.binary()) for kind in (SKETCH, WIDE)]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(mins, kinds[3]), *sketches, none(kinds[6], len(sets)), none(kinds[7], len(sets))], names=names)
        usual = int(crowd.mean())
        at = np.flatnonzero(crowd >= usual + 2 * usual**0.5 + LOCAL)
        yield pa.RecordBatch.from_arrays([*(none(k, len(at)) for k in kinds[:6]), pa.array(at.astype(np.int32)), pa.array(crowd[at].astype(np.int64) - usual)], names=names)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "id long, n long, sig binary, mins array<long>, sketch binary, wide binary, bucket int, seen long")


def long_lists(found: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of ``2 ^ BITS`` flags, whatever the corpus: buckets of long lists, and those of lists that are dealt to several tasks. Their rows reach the driver packed by 4096 buckets, so as many rows at most."""
    hot = max(HOT_LEAST, rows // HOT_SHARE)
    crowded = found.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= LONG)
    packed = crowded.groupBy(F.floor(F.col("bucket") / 4096).alias("page")).agg(F.collect_list("bucket").alias("at"), F.collect_list(F.when(F.col("seen") >= hot, F.col("bucket"))).alias("hot"))
    out = np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS, dtype=bool)
    for r in packed.toLocalIterator():
        out[0][r["at"]] = True
        out[1][r["hot"]] = True
    return out


def merged_lists(docs: DataFrame, bitmaps: tuple[np.ndarray, np.ndarray], key: str, text: str, percent: int) -> DataFrame:
    """``h, id``: lists of at least two documents, among the short prefixes of all documents. Lists are sorted over the cluster and read one after another; of hot lists, dealt to several tasks, every row stays."""
    packed = [np.packbits(x) for x in bitmaps]  # 4 MB

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (flags, hot) = WordTable(_word, 300_000), packed
        for batch in text_steps(batches, text, 1_000_000):
            prefixes = [short_prefix(s, flags, percent) for s in shingle_sets(_texts(batch, text), table)]
            ids = np.asarray(batch.column(key).cast(pa.int64()))
            if prefixes:
                h, own = np.concatenate(prefixes), np.repeat(ids, [len(p) for p in prefixes])
                salt = np.where(_bit(hot, (h & np.iinfo(np.int64).max) >> np.int64(63 - BITS)), (_finish(own.view(np.uint64)) % np.uint64(SALT)).astype(np.int32), -1)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(own), pa.array(salt.astype(np.int32))], names=["h", "id", "salt"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose neighbour has the same hash, and salted ones; a batch waits for the first row of the next one."""
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)]
        last = None  # hash of the row before those held
        for batch in batches:
            held = [np.concatenate([x, np.asarray(batch.column(c))]) for x, c in zip(held, ("h", "id", "salt"), strict=True)]
            h, ids, salt = held
            if len(h) < 2:
                continue
            after, before = h[:-1] == h[1:], np.concatenate([[h[0] == last], h[1:-1] == h[:-2]])
            keep = np.flatnonzero(after | before | (salt[:-1] >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(ids[keep])], names=["h", "id"])
            last, held = h[-2], [x[-1:] for x in held]
        h, ids, salt = held
        if len(h) and (h[0] == last or salt[0] >= 0):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids)], names=["h", "id"])

    rows = docs.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(lists, "h long, id long, salt int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "h", "salt").sortWithinPartitions("h").mapInArrow(shared, "h long, id long")


def mixed_lists(lists: DataFrame, nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``h, i, j, c, id, n, part, sketch, head``: the lists (``h, id``) that hold different parts, a list of more than ``chunk`` documents once for each pair (``i, j``) of its chunks ``c``; ``head`` has the document's first such lists."""
    met = save(lists.join(nodes.select("id", "n", "part"), "id").select("h", "id", "n", "part"), "met")
    several = met.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("h", "size")
    rows = save(met.join(several, "h").withColumn("k", F.ceil(F.col("size") / chunk).cast("int")), "mixed")
    heads = rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("h")), 1, HEAD).alias("head"))  # at most a document's lists
    told = save(nodes.select("id", "n", "sketch").join(heads, "id"), "heads")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = rows.select("h", "id", "n", "part", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).join(told, ["id", "n"])
    return dealt.select("h", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "id", "n", "part", "sketch", "head")


class _Sketches:
    """Sketches of some rows as one matrix of 64-bit words for each width, wider ones folded."""

    def __init__(self, sketches: list[bytes]):
        widths = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
        self.level = np.log2(widths).astype(np.int64) if len(widths) else widths
        self.place: dict[int, np.ndarray] = {}
        self.words: dict[int, np.ndarray] = {}
        wide, rows = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for level in sorted(set(self.level.tolist()), reverse=True):
            while len(rows) and wide.shape[1] > 1 << level - 3:
                half = wide.shape[1] // 2
                wide = wide[:, :half] ^ wide[:, half:]
            own = np.flatnonzero(self.level == level)
            there = np.frombuffer(b"".join(sketches[i] for i in own.tolist()), dtype="<u8").reshape(len(own), -1)
            wide, rows = (np.concatenate([wide, there]), np.concatenate([rows, own])) if len(rows) else (there, own)
            self.place[level] = np.full(len(sketches), -1)
            self.place[level][rows] = np.arange(len(rows))
            self.words[level] = wide

    def differ(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows differ, at the narrower width."""
        out, both = np.zeros(len(left), dtype=np.int64), np.minimum(self.level[left], self.level[right])
        for level, words in self.words.items():
            at = np.flatnonzero(both == level)
            place = self.place[level]
            step = max(1, 1_000_000 // words.shape[1])
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                out[some] = np.bitwise_count(words[place[left[some]]] ^ words[place[right[some]]]).sum(axis=1, dtype=np.int64)
        return out


def _list_pairs(rows: np.ndarray, chunk: np.ndarray, starts: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (``id, n, part``) of one list whose sizes allow a link and whose parts differ; lists begin at ``starts`` and are sorted by ``n``. In a list of two chunks only rows of different ones meet."""
    stops = np.append(starts[1:], len(rows))
    n, part = rows[:, 1], rows[:, 2]
    two = np.minimum.reduceat(chunk, starts) != np.maximum.reduceat(chunk, starts)
    fits = lambda x, y, cross: (part[x] != part[y]) & (100 * n[x] >= percent * n[y]) & (~cross | (chunk[x] != chunk[y]))  # noqa: E731 - x is the smaller
    small = np.repeat(stops - starts <= SMALL_LIST, stops - starts)
    end, cross = np.repeat(stops, stops - starts), np.repeat(two, stops - starts)
    for step in range(1, SMALL_LIST):
        left = np.flatnonzero(small & (np.arange(len(rows)) + step < end))
        if not len(left):
            break
        left = left[fits(left, left + step, cross[left])]
        yield left, left + step
    for g in np.flatnonzero(stops - starts > SMALL_LIST).tolist():
        lo, hi = int(starts[g]), int(stops[g])
        kinds, which, counts = np.unique(part[lo:hi], return_inverse=True, return_counts=True)
        largest = which == counts.argmax()
        some, size = [], 0
        for i in (np.flatnonzero(~largest) + lo).tolist():
            a, b = np.searchsorted(n[lo:hi], [-(-percent * n[i] // 100), 100 * n[i] // percent + 1])
            others = np.arange(a, b) + lo
            others = others[(part[others] != part[i]) & (largest[a:b] | (others > i)) & (~two[g] | (chunk[others] != chunk[i]))]
            some.append((np.full(len(others), i), others))
            size += len(others)
            if size >= 500_000:
                yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
                some, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _met_before(heads: np.ndarray, here: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the heads of two rows name a common list before the one they are met in; rows of ``heads`` are filled with the largest number."""
    a, b = heads[left], heads[right]
    a = np.where(a < here[:, None], a, np.iinfo(np.int64).max)
    out = np.zeros(len(left), dtype=bool)
    for k in range(heads.shape[1]):
        out |= ((a == b[:, k : k + 1]) & (a < np.iinfo(np.int64).max)).any(axis=1)
    return out


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b`` from ``mixed_lists``: documents of different parts whose sizes and sketches allow a link. In each list the largest part isn't compared with itself, whatever its size."""
    columns = ["h", "i", "j", "c", "id", "n", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(rows: np.ndarray, sketches: list[bytes], heads: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of complete lists, many in a batch."""
            starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
            told, own = _Sketches(sketches), rows[:, 4:7]
            for left, right in _list_pairs(own, rows[:, 3], starts, percent):
                new = ~_met_before(heads, rows[left, 0], left, right)
                left, right = left[new], right[new]
                x, y = own[left, 1], own[right, 1]
                ok = np.flatnonzero(told.differ(left, right) <= x + y - 2 * required(x, y, percent))
                if len(ok):
                    a, b = own[left[ok], 0], own[right[ok], 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[bytes] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in columns], axis=1)
            if not len(rows):
                continue
            named = batch.column("head")
            sizes = np.asarray(named.value_lengths())
            heads = np.full((len(rows), HEAD), np.iinfo(np.int64).max)
            heads[np.arange(HEAD) < sizes[:, None]] = np.asarray(named.flatten())
            held.append((rows, heads))
            words += batch.column("sketch").to_pylist()
            last = rows[-1, :3]
            if (held[0][0][0, :3] == last).all():
                continue  # still the same list
            rows, heads = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.flatnonzero((rows[:, :3] != last).any(axis=1))[-1]) + 1
            yield from whole(rows[:cut], words[:cut], heads[:cut])
            held, words = [(rows[cut:], heads[cut:])], words[cut:]
        if held:
            rows, heads = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from whole(rows, words, heads)

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "id").mapInArrow(run, "a long, b long").distinct()


def plausible(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose wide sketches allow a link. An id with several texts is tried with each."""

    @F.pandas_udf("boolean")
    def allows(n_a: pd.Series, w_a: pd.Series, n_b: pd.Series, w_b: pd.Series) -> pd.Series:
        x, y = n_a.to_numpy(), n_b.to_numpy()
        at = np.arange(len(x))
        return pd.Series(_Sketches([*w_a, *w_b]).differ(at, at + len(x)) <= x + y - 2 * required(x, y, percent))

    own = lambda k: wide.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"w_{k}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    return both.where(allows("n_a", "w_a", "n_b", "w_b")).select("a", "b").distinct()


def compare(docs: DataFrame, pairs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that link. Each centre's text meets its partners' texts in one task, ``STAR`` partners at a time, so a centre of many partners is spread."""
    dealt = pairs.select(F.col("a").alias("centre"), F.col("b").alias("id"))
    sizes = dealt.groupBy("centre").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / STAR)).cast("long").alias("parts"))
    spread = lookup(dealt, save(sizes.withColumn("rows", F.col("parts") * STAR), "stars"), "centre", "rows", pairs.count(), ["parts"])
    members = spread.select("centre", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(1).alias("member"))
    heads = sizes.select("centre", F.col("centre").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rows = own.join(members.unionByName(heads), "id").select("centre", "part", "member", "id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, star, sets = WordTable(_word, 300_000), None, []
        for batch in text_steps(batches, "text", 1_000_000):
            found = shingle_sets(_texts(batch, "text"), table)
            a, b = [], []
            for centre, part, member, i, mine in zip(*(batch.column(c).to_pylist() for c in ("centre", "part", "member", "id")), found, strict=True):
                if (centre, part) != star:
                    star, sets = (centre, part), []
                if not member:
                    sets.append(mine)
                elif any(links(mine, other, percent) for other in sets):
                    a.append(centre)
                    b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = rows.repartition(n, "centre", "part").sortWithinPartitions("centre", "part", "member")
    return ordered.mapInArrow(run, "a long, b long")


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sorted sets share as many shingles as they must: each shingle of the smaller one is a binary probe of the larger one."""
    if len(x) > len(y):
        x, y = y, x
    need = required(len(x), len(y), percent)
    if not len(x) or need > len(x):
        return False
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) >= need


def _likely(reps: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each representative ``b`` with the heads of its groups, where sizes allow a link."""
    keyed = reps.select("id", "n", F.posexplode("mins").alias("p", "least")).where(F.col("least") != -1).select("id", "n", F.xxhash64("p", "least").alias("g"))
    keyed = save(keyed, "keyed")
    groups = save(keyed.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    total = keyed.count()
    grouped = lookup(keyed, groups, "g", "size", total, ["size"]).where("size is not null")
    weighed = grouped.groupBy("id", "n").agg(F.sum(F.log2("size")).alias("weight"), F.collect_list("g").alias("gs"))  # at most ``PARTS`` groups
    weighed = save(weighed.select("id", "n", "weight", F.explode("gs").alias("g")), "weighed")
    heads = weighed.groupBy("g").agg(F.max_by(F.struct("id", "n"), F.struct("weight", -F.col("id"))).alias("head"), F.count(F.lit(1)).alias("size"))
    near = lookup(weighed.select("id", "n", "g"), save(heads, "heads"), "g", "size", total, ["head"]).where("head.id <> id")
    fits = (F.col("n") * percent <= F.col("head.n") * 100) & (F.col("head.n") * percent <= F.col("n") * 100)
    return near.where(fits).select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``id, n, sig, component`` of every row."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} isn't an integer column")
    with scratch() as keep:
        found = keep(save(profiles(docs, key, text), "profiles"))
        rows = found.where("bucket is null").select("id", "n", "sig", "mins", "sketch", "wide")
        reps = save(rows.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "mins", "sketch", "wide"))), "reps")
        total = rows.count()
        bitmaps = long_lists(found, total)
        # likely copies, each compared with the head of its group
        with scratch() as out:
            first_links = out(save(compare(docs, save(plausible(_likely(reps, percent), reps, percent), "likely"), key, text, percent), "links"))
        tied = connected_components(first_links, "a", "b")
        sizes = reps.select("id", "n", "sketch").distinct()  # an id with several texts has several sizes
        nodes = save(sizes.join(tied, sizes["id"] == tied["node"], "left").select("id", "n", "sketch", F.coalesce("component", "id").alias("part")), "nodes")
        # every other link
        with scratch() as out:
            lists = save(merged_lists(docs, bitmaps, key, text, percent), "lists")
            more = out(save(plausible(candidates(mixed_lists(lists, nodes, chunk), percent), reps, percent), "candidates"))
        all_links = first_links.unionByName(save(compare(docs, more, key, text, percent), "links"))
        final = connected_components(all_links, "a", "b")
        parts = reps.join(final, reps["id"] == final["node"], "left").select("sig", "copies", F.coalesce("component", "id").alias("component"))
        told = keep(save(parts.select(F.hex("sig").alias("k"), "copies", "component"), "parts"))
    named = rows.select("id", "n", "sig", F.hex("sig").alias("k"))
    done = lookup(named, told, "k", "copies", total, ["component"])
    return done.select("id", "n", "sig", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, n_shingles, component_id`` of a table with distinct integer ids: every pair that shares a shingle. For small tables; the pairs of a family grow with its square."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[u.i : u.i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) u WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
ends AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS id, doc_id AS root FROM {source} UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.id WHERE reach.root < ends.b)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id FROM {source} d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT id, min(root) AS root FROM reach GROUP BY 1) r ON r.id = d.doc_id"""
