"""Packing of tokenised documents into fixed windows by non-negative least squares on the length histogram.

1. Every document is tokenised once; its ids are written out. Full windows leave it as they are, only the rest (shorter than
   a window) has to be packed.
2. The rests' lengths are counted. Shallow combinations that fill a window exactly (two equal-role lengths ``l`` and
   ``window - l``, and for each length a few splits of what is left into two) are the columns of a non-negative least
   squares problem: how often to repeat each so that the histogram is used up. The solution is rounded by largest remainders, as far as
   the histogram lasts.
3. What that leaves over is packed greedily from the histogram, longest first, each window filled by the longest
   lengths that still fit; a plan repeats until one of its lengths runs out. Windows that stay more than ``waste`` empty are
   given up: their pieces are laid end to end and cut at the window's edges.

The plan is made from the histogram alone (at most ``window`` lengths), so it doesn't grow with the corpus. A piece finds its place from its
rank among the pieces of equal length, counted in hash buckets so that a length which most documents share is still
spread over the cluster; no window is ever gathered in one task.

Null and empty texts are documents of one id, the end mark. Equal texts and repeated rows are packed each; rows with
equal ids keep apart by a row number of their own. An empty table gives no piece. A column that the input has beside the id and the text is ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import kept, text_steps
from daybook.operators.durable import save

WINDOW = 4096
END_ID = 2
#: Rows of one length class and hash bucket that one sort may hold, on average at most.
BUCKET_ROWS = 20_000
#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 100_000


#: Distinct parts of words that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Characters that Python and Arrow take for white space and the tokenizer does not.
_CONTROLS = "[\x1c-\x1f]"
#: Letters whose lower case is one letter in every library, and the marks that a plain word may end with; an apostrophe can begin a token of its own.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131\u0134-\u0137\u0139-\u0148\u014a-\u017e"
_LOWER = "".join(chr(c) for c in range(97, 0x180) if chr(c).isalpha())
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = f"^[{_LETTERS}]*[^'\\x00-\\x20A-Za-z0-9\\x7f-\\x{{10FFFF}}]*$"


class Encoder:
    """Ids of whole texts from a tokenizer that never joins over white space.

    A batch's distinct words are told by Arrow. A plain word, Latin letters and then marks, is lower-cased and cut there; its two parts go to a
    copy of the tokenizer that has only the merges left, many in one call, and come apart again at the ids that end a word. Every other word, and every text
    with control characters that Arrow takes for white space and the tokenizer does not, is encoded by the tokenizer itself. The ids of all words of a batch are gathered at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
        self.shown = {b: c for b, c in shown.items() if b != 32}  # the characters that stand for bytes in the vocabulary
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, int] = {"": 0}  # part of a word, or a whole other word after a space, to its place
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(2, np.int64)  # ids of all parts, and where each begins

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of new parts."""
        if parts:
            text = " ".join(parts).encode().decode("latin-1").translate(self.shown)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(parts):
                raise ValueError("the tokenizer's words don't end where they should")
            self.parts.update(zip(parts, range(len(self.begin) - 1, len(self.begin) - 1 + len(parts)), strict=True))
            self.begin = np.concatenate([self.begin, self.begin[-1] + stops])
            self.flat = np.concatenate([self.flat, ids])

    def _learn_whole(self, words: list[str]) -> None:
        """Remember the ids of other words."""
        if words:
            found = [self._encode(w) for w in words]
            self.parts.update((" " + w, len(self.begin) - 1 + i) for i, w in enumerate(words))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in found])])
            self.flat = np.concatenate([self.flat, *found])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Place of each of ``parts``."""
        told = parts.dictionary_encode()
        known = told.dictionary.to_pylist()
        self._learn([x for x in known if x not in self.parts])
        return np.fromiter(map(self.parts.__getitem__, known), dtype=np.int64, count=len(known))[told.indices.to_numpy()] if known else np.zeros(0, np.int64)

    def _words(self, words: pa.Array) -> np.ndarray:
        """Places of the two parts of each distinct word."""
        if len(self.parts) > REMEMBERED:
            self._forget()
        plain = pc.match_substring_regex(words, _PLAIN)
        out = np.zeros((len(words), 2), dtype=np.int64)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        low = pc.utf8_lower(words.filter(plain))
        core = pc.utf8_rtrim(low, characters=_TAIL)
        tailed = np.flatnonzero((pc.binary_length(low).to_numpy() != pc.binary_length(core).to_numpy()))
        out[at, 0] = self._places(core)
        some = low.take(pa.array(tailed))
        out[at[tailed], 1] = self._places(pc.utf8_ltrim(some, characters=_LOWER))
        others = words.filter(pc.invert(plain)).to_pylist()
        self._learn_whole([w for w in others if " " + w not in self.parts])
        out[~plain.to_numpy(zero_copy_only=False), 0] = [self.parts[" " + w] for w in others]
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; there are no nulls."""
        odd = pc.match_substring_regex(texts, _CONTROLS).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        counts = np.diff(split.offsets.to_numpy())
        told = split.flatten().dictionary_encode()
        pairs = self._words(told.dictionary)[told.indices.to_numpy()].ravel()
        sizes = (self.begin[1:] - self.begin[:-1])[pairs]
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[pairs] - (ends - sizes), sizes)
        every = self.flat[where]
        stops = np.concatenate(([0], ends))[2 * np.cumsum(counts)] if len(counts) else []
        found = np.split(every, stops[:-1]) if len(counts) else []
        return [self._encode(t.as_py()) if o else x for t, o, x in zip(texts, odd.tolist(), found, strict=True)]


def tokenize(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``row_id, <key>, n_ids, rest, full_crc, rest_crc, ids``: ids as little-endian 16-bit numbers (32 where they need it), the length that is left after full windows, and the crc32 of the 32-bit ids of every full window and of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"encoder {tokenizer_path}"
        own, end, step = kept(name, lambda: Encoder(tokenizer_path)), np.array([END_ID], dtype=np.uint32), 4 * window
        for batch in text_steps(batches, text, 5_000_000, keep=name):
            ids = [np.concatenate([x, end]).astype("<u4") for x in own.ids(pc.fill_null(batch.column(text).cast(pa.string()), ""))]
            sizes, found = [len(x) for x in ids], [x.tobytes() for x in ids]
            narrow = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else y for x, y in zip(ids, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__row"),
                    batch.column(key),
                    pa.array(sizes, pa.int64()),
                    pa.array([n % window for n in sizes], pa.int32()),
                    pa.array([[zlib.crc32(x[i * step : i * step + step]) for i in range(n // window)] for x, n in zip(found, sizes, strict=True)], pa.list_(pa.int64())),
                    pa.array([zlib.crc32(x[n // window * step :]) for x, n in zip(found, sizes, strict=True)], pa.int64()),
                    pa.array(narrow, pa.binary()),
                ],
                names=["row_id", key, "n_ids", "rest", "full_crc", "rest_crc", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), key, text)
    return rows.mapInArrow(run, f"row_id long, {key} {kind}, n_ids long, rest int, full_crc array<long>, rest_crc long, ids binary")


@dataclass
class Plan:
    """``windows[i]`` is a tuple of lengths that ``repeats[i]`` windows hold in that order; ``loose`` counts the lengths that are laid end to end."""

    windows: list[tuple[int, ...]]
    repeats: list[int]
    loose: np.ndarray


def combinations(window: int, splits: int = 6) -> np.ndarray:
    """Combinations of two or three lengths with exactly ``window`` ids; zero means none."""
    lengths = np.arange(1, window)
    pairs = np.stack([lengths, window - lengths, np.zeros_like(lengths)], axis=1)
    out = [pairs]
    for j in range(1, splits + 1):
        second = (window - lengths) * j // (2 * splits)
        third = window - lengths - second
        ok = (second > 0) & (third > 0)
        out.append(np.stack([lengths, second, third], axis=1)[ok])
    return np.unique(-np.sort(-np.concatenate(out), axis=1), axis=0)


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """``x >= 0`` that brings the lengths used by ``columns`` (rows of lengths) close to ``target``, by accelerated projected gradient with a step for each unknown."""
    used = (columns > 0).sum(axis=1)
    shared = np.bincount(columns.ravel(), minlength=len(target)).astype(float)
    shared[0] = 0
    step = 1.0 / np.maximum(sum(np.where(columns[:, k] > 0, shared[columns[:, k]], 0) for k in range(columns.shape[1])) / np.maximum(used, 1) * used, 1.0)
    goal = target.astype(float).copy()
    goal[0] = 0
    x, ahead, t = np.zeros(len(columns)), np.zeros(len(columns)), 1.0
    for _ in range(rounds):
        total = sum(np.bincount(columns[:, k], weights=ahead, minlength=len(target)) for k in range(columns.shape[1]))
        total[0] = 0
        gap = goal - total
        moved = np.maximum(ahead + step * sum(gap[columns[:, k]] * (columns[:, k] > 0) for k in range(columns.shape[1])), 0)
        if (moved - x) @ (ahead - moved) > 0:  # it overshoots: start the acceleration anew
            t = 1.0
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = moved + (before - 1) / t * (moved - x)
        x = moved
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, waste: float = 0.004) -> Plan:
    """Windows for ``histogram[length]`` pieces, ``length < window``."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    windows: list[tuple[int, ...]] = []
    repeats: list[int] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        windows.append(lengths)
        repeats.append(times)
        for n in lengths:
            left[n] -= times

    columns = combinations(window)
    columns = columns[np.all((columns == 0) | (left[columns] > 0), axis=1)]
    if len(columns):
        x = non_negative_least_squares(columns, left)
        counts = x.astype(np.int64)
        # whole parts first, then one more where the remainder is largest, as long as the lengths last
        for i, more in [*((i, counts[i]) for i in np.argsort(-x, kind="stable") if counts[i]), *((i, 1) for i in np.argsort(counts - x, kind="stable") if x[i] - counts[i] > 1e-3)]:
            lengths = tuple(int(n) for n in columns[i] if n)
            times = min(int(more), *(int(left[n]) // lengths.count(n) for n in lengths))
            if times > 0:
                take(lengths, times)
    loose = np.zeros(window, dtype=np.int64)
    while left.any():
        have = np.flatnonzero(left)
        room, lengths = window, []
        spare = left.copy()
        while room:
            at = np.searchsorted(have, room, side="right") - 1
            while at >= 0 and not spare[have[at]]:
                at -= 1
            if at < 0:
                break
            n = int(have[at])
            lengths.append(n)
            spare[n] -= 1
            room -= n
        times = min(int(left[n]) // lengths.count(n) for n in lengths)
        if room <= waste * window:
            take(tuple(lengths), times)
        else:
            loose[lengths[0]] += left[lengths[0]]
            left[lengths[0]] = 0
    return Plan(windows, repeats, loose)


def _slots(made: Plan) -> pd.DataFrame:
    """For each length, consecutive intervals of ranks: ``each`` pieces of every window of one plan entry, from ``first_seq`` on, at ``offsets``. At most some ten thousand rows: entries are bounded by the number of lengths."""
    rows, taken, base = [], {}, 0
    for lengths, times in zip(made.windows, made.repeats, strict=True):
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            lo = taken.get(n, 0)
            rows.append((n, lo, lo + times * len(where), len(where), base, where))
            taken[n] = lo + times * len(where)
        base += times
    for n in np.flatnonzero(made.loose):
        lo = taken.get(int(n), 0)
        rows.append((int(n), lo, lo + int(made.loose[n]), 0, -1, []))
    return pd.DataFrame(rows, columns=["rest", "lo", "hi", "each", "first_seq", "offsets"]), base


def _ranked(pieces: DataFrame, by: str, total: int) -> DataFrame:
    """``rank`` of each row among rows of equal ``by``, from 0. Ranks inside (``by``, hash bucket) start from the bucket's offset, so no sort holds a whole hot class."""
    buckets = max(1, total // BUCKET_ROWS)
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    inside = Window.partitionBy(by, "__b").orderBy("row_id")
    counts = dealt.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return dealt.withColumn("__i", F.row_number().over(inside) - 1).join(offsets, [by, "__b"]).withColumn("rank", F.col("__o") + F.col("__i")).drop("__b", "__i", "__o")


def pack(tokens: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``<key>, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of a table that ``tokenize`` made and ``save`` wrote."""
    spark = tokens.sparkSession
    counted = tokens.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``window`` rows
    histogram = np.zeros(window, dtype=np.int64)
    for r in counted:
        histogram[r["rest"]] = r["n"]
    made = plan(histogram, window)
    slots, n_planned = _slots(made)
    head = tokens.select("row_id", key, F.col("n_ids").alias("doc_tokens"), "rest", "rest_crc")
    rests = head.where("rest > 0").withColumn("start", F.col("doc_tokens") - F.col("rest"))
    out = []

    # full windows
    full = tokens.select(key, F.col("n_ids").alias("doc_tokens"), "row_id", F.posexplode("full_crc").alias("i", "ids_crc32"))
    out.append(full.select(key, (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", F.lit("full").alias("kind"), F.struct("row_id", F.col("i").cast("long").alias("i")).alias("where"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset")))

    loose_pieces = None
    if len(slots):
        table = F.broadcast(spark.createDataFrame(slots, "rest int, lo long, hi long, each int, first_seq long, offsets array<int>"))  # bounded by the number of lengths
        placed = save(_ranked(rests, "rest", int(histogram.sum())).join(table, "rest").where("rank >= lo and rank < hi"), "placed")
        fixed = placed.where("each > 0").withColumn("__k", F.col("rank") - F.col("lo"))
        out.append(
            fixed.select(
                key, "start", F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", F.lit("planned").alias("kind"), F.struct(F.lit(0).cast("long").alias("row_id"), F.lit(0).cast("long").alias("i")).alias("where"),
                (F.col("first_seq") + F.floor(F.col("__k") / F.col("each"))).cast("long").alias("seq"),
                F.element_at("offsets", (F.col("__k") % F.col("each") + 1).cast("int")).cast("long").alias("offset"),
            )
        )
        loose_pieces = _loose(placed.where("each = 0"), tokens, made, key, window)
    n_loose = 0
    if made.loose.any():
        out.append(loose_pieces)
        n_loose = -(-int((made.loose * np.arange(window)).sum()) // window)
    pieces = out[0]
    for more in out[1:]:
        pieces = pieces.unionByName(more)
    # planned windows come first, then the loose ones, then the full ones, numbered without collecting them anywhere
    base = n_planned + n_loose
    numbered = _number_full(tokens, window, base)
    full_ids = pieces.where("kind = 'full'").join(numbered, F.col("where.row_id") == F.col("__row"), "inner").withColumn("sequence_id", F.col("__first") + F.col("where.i"))
    rest_ids = pieces.where("kind <> 'full'").withColumn("sequence_id", F.when(F.col("kind") == "loose", F.col("seq") + n_planned).otherwise(F.col("seq")))
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full_ids.select(*columns).unionByName(rest_ids.select(*columns))


def _number_full(tokens: DataFrame, window: int, base: int) -> DataFrame:
    """First sequence id of each document's full windows: running counts inside hash buckets of rows, from the bucket's offset."""
    rows = tokens.where(F.col("n_ids") >= window).select(F.col("row_id").alias("__row"), F.floor(F.col("n_ids") / window).cast("long").alias("__n"))
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64("__row"), F.lit(1024)))
    inside = Window.partitionBy("__b").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__b").agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows
    offsets = offsets.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    return dealt.withColumn("__i", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(F.broadcast(offsets), "__b").select("__row", (F.col("__o") + F.col("__i") + base).alias("__first"))


def _loose(rows: DataFrame, tokens: DataFrame, made: Plan, key: str, window: int) -> DataFrame:
    """Pieces of the documents laid end to end, in order of length and rank, and cut at the windows' edges. Their positions follow from the histogram: all shorter lengths come before."""
    spark = rows.sparkSession
    total = np.cumsum(made.loose * np.arange(window)) - made.loose * np.arange(window)
    bases = pd.DataFrame([(int(n), int(total[n])) for n in np.flatnonzero(made.loose)], columns=["rest", "__base"])
    lay = rows.join(F.broadcast(spark.createDataFrame(bases, "rest int, __base long")), "rest").withColumn("at", F.col("__base") + (F.col("rank") - F.col("lo")) * F.col("rest"))
    edge = (F.floor((F.col("at") + F.col("rest") - 1) / window) * window).cast("long")
    lay = lay.withColumn("__cut", F.greatest(edge - F.col("at"), F.lit(0)))  # ids before the edge, 0 where the piece stays whole
    whole = lay.where("__cut = 0").select(key, "start", F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "at")
    halves = lay.where("__cut > 0").select("row_id", key, "start", "rest", "doc_tokens", "at", "__cut")
    edges = int((made.loose * np.arange(window)).sum()) // window + 1  # at most one document is cut at each
    halves = tokens.select("row_id", "ids").join(F.broadcast(halves) if edges <= BROADCAST_ROWS else halves, "row_id")

    @F.pandas_udf("first long, second long")
    def both_crcs(ids: pd.Series, n_ids: pd.Series, rest: pd.Series, cut: pd.Series) -> pd.DataFrame:
        out = []
        for x, n, r, c in zip(ids, n_ids, rest, cut, strict=True):
            wide = np.frombuffer(x, dtype="<u2" if len(x) == 2 * n else "<u4")[n - r :].astype("<u4")
            out.append((zlib.crc32(wide[:c].tobytes()), zlib.crc32(wide[c:].tobytes())))
        return pd.DataFrame(out, columns=["first", "second"], dtype="int64")

    halves = halves.withColumn("__crc", both_crcs("ids", "doc_tokens", "rest", "__cut"))
    left = halves.select(key, "start", F.col("__cut").cast("long").alias("length"), F.col("__crc.first").alias("ids_crc32"), "doc_tokens", "at")
    right = halves.select(key, (F.col("start") + F.col("__cut")).alias("start"), (F.col("rest") - F.col("__cut")).cast("long").alias("length"), F.col("__crc.second").alias("ids_crc32"), "doc_tokens", (F.col("at") + F.col("__cut")).alias("at"))
    return whole.unionByName(left).unionByName(right).select(
        key, "start", "length", "ids_crc32", "doc_tokens", F.lit("loose").alias("kind"), F.struct(F.lit(0).cast("long").alias("row_id"), F.lit(0).cast("long").alias("i")).alias("where"),
        F.floor(F.col("at") / window).cast("long").alias("seq"), (F.col("at") % window).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Tokenise, write the ids to the shared folder, and place every piece. The id may have any name but those of the result's other columns."""
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    return pack(save(tokenize(own, tokenizer_path, "__key", "text", window), "tokens"), "__key", window).withColumnRenamed("__key", key)
