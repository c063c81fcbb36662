"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case letters and digits with single spaces between. Benchmark items are matched whole, or, where they are longer than
``window`` characters, by windows of that length at half that distance; and all by windows of ``SHORT`` characters, ``STRIDE`` apart,
so that every verbatim quotation of at least ``SURE`` characters holds a whole window. A window of ``m`` characters within ``e`` edits of a region of a text
shares at least ``m - q + 1 - q * e`` character q-grams with it, all on diagonals that differ by at most ``e``. So shared q-grams are
counted in overlapping bands of diagonals, bands that reach the bound are kept, and a banded alignment verifies them.

``e`` is ``rate`` of the window's length, less where the bound would fall below one. Windows shorter than ``q`` must occur as
they are, between spaces. Items without a letter or digit match nothing.

The texts are scanned whole. The benchmark's q-grams are indexed once a place, some 13 bytes a character, whatever number of windows cover the place; the index is
broadcast in blocks of ``BLOCK_CHARS`` characters, which a worker keeps for all its tasks. A benchmark is a bounded table: more than ``MOST_CHARS`` characters raise. Null and
empty texts match nothing, repeated rows are treated each, and equal items all match. Other columns pass through; ``leaks`` of the input is
replaced.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import kept, release, steps

#: Benchmark characters that are matched in one pass over the documents.
BLOCK_CHARS = 4_000_000
#: Characters of a benchmark, at most; about 1 GB in each worker.
MOST_CHARS = 64_000_000
Q, RATE, WINDOW = 16, 0.05, 200
#: Windows for partial quotations, and the length from which a quotation is sure to hold one.
SHORT, STRIDE = 64, 16
SURE = SHORT + STRIDE - 1
_BITS = 22
#: Entries that are counted together.
PORTION = 2_000_000
_kept: np.ndarray | None = None


def _keep_table() -> np.ndarray:
    """For each code point itself if it is a letter, mark or digit, else a space; built once in a worker."""
    global _kept
    if _kept is None:
        _kept = np.fromiter((c if unicodedata.category(chr(c))[0] in "LMN" else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)
    return _kept


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Reduced code points, and the place of each in the lower-cased text."""
    points = _keep_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = points == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    where = np.flatnonzero(keep)
    return points[where], where


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, ``q`` a power of two, each level joining two of the level below."""
    h = points.astype(np.uint64) + np.uint64(1)
    base, span = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while span < q:
            h = h[:-span] * base + h[span:]
            base *= base
            span *= 2
        return h * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Windows:
    """Windows of one block of items, in order of items, and the sorted q-grams of the items with their places: ``of`` the text, ``at`` the character. ``grids`` tells which windows cover a place."""

    item: list
    part: list[bool]  # a short window
    points: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    start: np.ndarray
    short: list[tuple[object, str]]
    gram: np.ndarray
    of: np.ndarray
    at: np.ndarray
    grids: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]  # per kind: first window of each text, number of windows, start of the last; size and stride

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, dtype=bool)
        out[self.gram >> np.uint64(64 - _BITS)] = True
        return out

    def covering(self, entry: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """``(index, window)`` of the windows that hold whole the q-grams at ``entry``; ``index`` counts in ``entry``."""
        out = []
        of, at = self.of[entry].astype(np.int64), self.at[entry].astype(np.int64)
        for first, count, last, size, stride in self.grids:
            n, tail = count[of], last[of]
            # evenly spaced windows 0 .. n - 2, and the last one, which ends where its text does
            lo = np.maximum(-((size - q - at) // stride), 0)
            hi = np.minimum(at // stride, n - 2)
            times = np.maximum(hi - lo + 1, 0)
            index = np.repeat(np.arange(len(entry)), times)
            out.append((index, first[of[index]] + lo[index] + np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)))
            ends = np.flatnonzero((n > 0) & (at >= tail))
            out.append((ends, first[of[ends]] + n[ends] - 1))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def prepare(items: list[tuple[object, str]], q: int = Q, rate: float = RATE, window: int = WINDOW) -> Windows:
    out = Windows([], [], [], np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), [], np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), [])
    budget, least, start, gram, of, at, texts = [], [], [], [], [], [], []
    for item, text in items:
        points = _trim(normalise((text or "").lower())[0])
        if 0 < len(points) < q:
            out.short.append((item, _text(points)))
        elif len(points):
            h = grams(points, q)
            gram.append(h)
            of.append(np.full(len(h), len(texts), dtype=np.int32))
            at.append(np.arange(len(h), dtype=np.int32))
            texts.append((item, points))
    for size, stride in ((window, window // 2), (SHORT, STRIDE)):
        first, count, last = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        for k, (item, points) in enumerate(texts):
            if size < window and len(points) <= size:
                continue  # the item is one window already
            cuts = _starts(len(points), size, stride)
            first[k], count[k], last[k] = len(out.item), len(cuts), cuts[-1]
            for s in cuts:
                part = points[s : s + size]
                m = len(part)
                e = min(int(rate * m), (m - q) // q)
                out.item.append(item)
                out.part.append(size < window)
                out.points.append(part)
                budget.append(e)
                least.append(m - q + 1 - q * e)
                start.append(s)
        out.grids.append((first, count, last, size, stride))
    if gram:
        every = np.concatenate(gram)
        order = np.argsort(every, kind="stable")
        out.gram, out.of, out.at = every[order], np.concatenate(of)[order], np.concatenate(at)[order]
        out.budget, out.least, out.start = np.array(budget), np.array(least), np.array(start)
    return out


def _starts(n: int, window: int, stride: int) -> list[int]:
    return [0] if n <= window else sorted({*range(0, n - window, stride), n - window})


def _trim(points: np.ndarray) -> np.ndarray:
    solid = np.flatnonzero(points != 32)
    return points[solid[0] : solid[-1] + 1] if len(solid) else points[:0]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _band(pattern: np.ndarray, region: np.ndarray, most: int, anchored: bool) -> tuple[int, int] | None:
    """Fewest edits of the whole pattern against a part of the region, if at most ``most``, and where the part ends. One row a pattern letter, one cell a diagonal; ``anchored`` parts begin at the region's start."""
    k = len(region) - len(pattern) + 2 * most + 1  # diagonals from ``most`` before the region's start
    if k <= 0:
        return None
    cells = np.arange(k)
    padded = np.concatenate([np.zeros(most, region.dtype), region, np.zeros(most + 1, region.dtype)])
    far = 2 * (len(pattern) + len(region) + most)
    row = np.where(cells < most, far, cells - most) if anchored else np.maximum(most - cells, 0)
    for i, c in enumerate(pattern):
        there = padded[i : i + k]
        step = np.minimum(row + (there != c), np.concatenate([row[1:] + 1, [far]]))
        row = np.minimum.accumulate(step - cells) + cells
        if row.min() > most:
            return None
    stops = cells + len(pattern) - most
    row = row + far * ((stops > len(region)) | (stops < 0))  # parts must end inside the region
    best = int(row.argmin())
    return (int(row[best]), int(stops[best])) if row[best] <= most else None


def align(pattern: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """``(edits, start, stop)`` of the pattern's best place in the region, within ``most`` edits."""
    exact = _text(region).find(_text(pattern))
    if exact >= 0:
        return 0, exact, exact + len(pattern)
    found = _band(pattern, region, most, False)
    if not found:
        return None
    edits, stop = found
    back = _band(pattern[::-1], region[:stop][::-1][: len(pattern) + most], most, True)
    return edits, stop - back[1], stop


def _portions(whose: np.ndarray, n: np.ndarray) -> Iterator[slice]:
    """Slices of the hits, whole documents each, with about ``PORTION`` entries; a document with more is one slice."""
    if not len(whose):
        return
    ends = np.append(np.flatnonzero(np.diff(whose)) + 1, len(whose))  # where each document's hits end
    total = np.cumsum(n)[ends - 1]
    at = done = 0
    for k, end in enumerate(ends.tolist()):
        if total[k] - done >= PORTION or end == len(whose):
            yield slice(at, end)
            at, done = end, int(total[k])


def find_leaks(texts: list[str], windows: Windows, bitmap: np.ndarray, q: int = Q) -> list[list[dict]]:
    """For each text its matched items, each at its best place, that of a short window only where no other matches: ``item, edits`` and the range of characters of the text."""
    low = [t.lower() for t in texts]
    parts = [normalise(t) for t in low]
    sizes = np.array([len(p) + 1 for p, _ in parts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.concatenate([x for p, _ in parts for x in (p, np.zeros(1, np.uint32))]) if parts else np.zeros(0, np.uint32)
    best: list[dict[object, tuple[bool, int, int, int]]] = [{} for _ in texts]
    if len(flat) >= q and len(windows.gram):
        h = grams(flat, q)
        hit = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(windows.gram, h[hit], "left"), np.searchsorted(windows.gram, h[hit], "right")
        n = hi - lo
        width = int(max(32, 2 * (windows.budget.max() + 1)))
        wide = (int(sizes.max()) + 2 * WINDOW) // width + 3
        kept = []
        # a q-gram that many places share makes many entries; some at a time are counted, whole documents together
        whose = np.searchsorted(begins, hit, "right") - 1
        for some in _portions(whose, n):
            where, number = np.repeat(hit[some], n[some]), n[some]
            entry = np.repeat(lo[some] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
            index, of = windows.covering(entry, q)
            where, inside = where[index], windows.at[entry[index]] - windows.start[of]
            doc = np.searchsorted(begins, where, "right") - 1
            diagonal = where - begins[doc] - inside + WINDOW  # not negative
            band = diagonal // width
            lower = diagonal % width <= windows.budget[of]  # also in the overlap with the band before
            doc, of, band = np.concatenate([doc, doc[lower]]), np.concatenate([of, of[lower]]), np.concatenate([band, band[lower] - 1])
            keys, counts = np.unique((doc * len(windows.item) + of) * wide + band + 1, return_counts=True)
            kept += keys[counts >= windows.least[keys // wide % len(windows.item)]].tolist()
        for key in kept:
            b, w, d = key % wide - 1, key // wide % len(windows.item), key // wide // len(windows.item)
            points, e = parts[d][0], int(windows.budget[w])
            start = max(0, b * width - WINDOW - e)
            region = points[start : b * width - WINDOW + width + 2 * e + len(windows.points[w])]
            found = align(windows.points[w], region, e)
            if found:
                this = (windows.part[w], found[0], start + found[1], start + found[2])
                best[d][windows.item[w]] = min(best[d].get(windows.item[w], this), this)
    for item, short in windows.short:
        for d, (points, _) in enumerate(parts):
            at = f" {_text(points)} ".find(f" {short} ")
            if at >= 0:
                best[d].setdefault(item, (False, 0, at, at + len(short)))
    out = []
    for d, found in enumerate(best):
        place, same = parts[d][1], len(low[d]) == len(texts[d])
        rows = []
        for item, (_, edits, s, t) in found.items():
            stop = max(s + 1, min(t, len(place)))
            rows.append({"item": item, "edits": edits, "start": int(place[s]) if same else None, "stop": int(place[stop - 1]) + 1 if same else None})
        out.append(sorted(rows, key=lambda r: (r["item"] is None, r["item"])))
    return out


def _index(blocks: list[list[tuple[object, str]]], rate: float) -> tuple[list[Windows], list[np.ndarray]]:
    """The index of a benchmark and its bitmaps, block by block."""
    windows = [prepare(block, rate=rate) for block in blocks]
    return windows, [w.bitmap() for w in windows]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with ``leaks``: an array of the benchmark items found, with edits and character range (null where lower-casing changes the text's length)."""
    spark = docs.sparkSession
    kind = benchmark.schema[item].dataType.simpleString()
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("body"))
    chars = int(items.agg(F.sum(F.length("body"))).first()[0] or 0)
    if chars > MOST_CHARS:
        raise ValueError(f"a benchmark of {chars} characters; {MOST_CHARS} at most")
    rows = [(r["item"], r["body"]) for r in items.orderBy("item", "body").collect()]  # bounded just above
    blocks: list[list[tuple[object, str]]] = [[]]
    size = 0
    for row in rows:
        if size >= BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += len(row[1])
    name, sent = f"benchmark {uuid.uuid4().hex}", spark.sparkContext.broadcast(blocks)

    @F.pandas_udf(f"leaks array<struct<item:{kind},edits:int,start:int,stop:int>>")
    def scan(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows, bitmaps = kept(name, lambda: _index(sent.value, rate))
        for column in series:
            texts = column.fillna("").tolist()
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 64
            found: list[list[dict]] = []
            for s in steps(sizes, 1_000_000):
                each = [find_leaks(texts[s], w, b) for w, b in zip(windows, bitmaps, strict=True)]
                found += [[x for block in parts for x in block] for parts in zip(*each, strict=True)]
            yield pd.DataFrame({"leaks": found})
        release(name)

    return docs.drop("leaks").withColumn("leaks", scan(F.col(text))["leaks"])
