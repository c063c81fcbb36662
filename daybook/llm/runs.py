"""Runs: maximal stretches of words with a period, in linear time over an ordered alphabet.

A text is words over an ordered alphabet (numbers of distinct words; any order will do, only order and equality are used). Every run has a position at which the longest Lyndon word
that begins there is its root, in the alphabet's order or in the reverse one. So for both orders the next smaller suffix of each position is found from left to right, over a chain of
previous smaller suffixes, and each pair of suffixes that is compared has the length of its common prefix kept. That length is never matched twice:

- Inside the match that reaches furthest so far (``a`` and ``b`` agree up to ``stop``) a pair is the image of one that was compared before, whose length it takes over.
- Going down the chain, the lengths between neighbours on it give the next one where they differ, and a lower bound where they don't.

Symbols are only matched where both end, which moves ``stop`` on; hence linear time. There are no suffix arrays or trees, and no hashes of stretches. A root whose period fits is extended to the left
by less than one period, once a run.

A run counts when it has at least ``least`` words and ``repeats`` periods. The words of a run behind its first period are dropped from the collapsed text.

Words are what stands between ASCII white space. Null and empty texts have no word and no run, and collapse to the empty text. Repeated rows give repeated results, an empty table none.
Columns beside id and text are ignored; the id may have any name but those of the result's other columns. A text is held whole by its task: some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import text_steps

#: Words and periods that a run has at least.
LEAST, REPEATS = 24, 3


def lyndon_candidates(symbols: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """``(start, period, match)`` of the longest Lyndon words that match what follows them for long enough to be roots of runs that count. A text that is a beginning of another comes before it.

    ``symbols`` are not negative."""
    n = len(symbols)
    s = [*symbols, -1]
    smaller, smaller_match = [n] * n, [0] * n  # next smaller suffix, and the match with it
    before, before_match = [-1] * n, [0] * n  # previous smaller suffix, and the match with it
    found = []
    a = b = stop = 0
    for i in range(1, n):
        own, j = s[i], i - 1
        match, link = -1, 0  # of the last suffix taken from the chain: its match with i, and with its neighbour on the chain
        while j >= 0:
            other = s[j]
            if other != own:
                if other < own:
                    before[i] = j
                    break
                smaller[j] = i
                match, link = 0, before_match[j]
                j = before[j]
                continue
            known, certain = 1, False
            if match >= 0 and match != link:
                known, certain = (match, True) if match < link else (link, True)
            elif j >= b and i < stop:
                image, k = j - b + a, i - b + a
                if smaller[image] == k:
                    known = smaller_match[image]
                elif before[k] == image:
                    known = before_match[k]
                if i + known < stop:
                    certain = True
                else:
                    known = stop - i
            elif match > 0:
                known = match
            if not certain:
                while s[j + known] == s[i + known]:
                    known += 1
            if i + known >= stop:
                a, b, stop = j, i, i + known
            if s[j + known] < s[i + known]:
                before[i], before_match[i] = j, known
                break
            smaller[j], smaller_match[j] = i, known
            period = i - j
            if known > (repeats - 2) * period and known > least - 2 * period:
                found.append((j, period, known))
            match, link = known, before_match[j]
            j = before[j]
    return found


def runs(symbols: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs with at least ``least`` symbols and ``repeats >= 2`` periods, by start, then period."""
    top = max(symbols, default=0)
    out = set()
    for text in (symbols, [top - x for x in symbols]):
        done = set()  # a run's roots come from left to right; the first one is less than a period from its beginning
        for at, period, match in lyndon_candidates(text, least, repeats):
            stop = at + period + match
            if (stop, period) not in done:
                done.add((stop, period))
                start = at
                while start and text[start - 1] == text[start + period - 1]:
                    start -= 1
                if stop - start >= max(least, repeats * period):
                    out.add((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of ``n`` words whose draw is ``h``; None where all stay."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS, draw: Column | None = None) -> DataFrame:
    """``<key>, n_words, runs, collapsed``: the runs by start and period as ``start, length, period``, and the words that stay, joined by one space.

    With ``draw``, a number for each row, words of a tenth of the texts are first replaced so that they have a period (``planted``), which makes a test of known runs of real words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "__text"):
            split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(batch.column("__text"), "")))
            words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
            blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # of a blank text there is one empty word
            told = words.dictionary_encode()
            codes, at, keep = told.indices.to_numpy(), np.arange(len(words)), ~blank
            found = []
            for d, h in enumerate(batch.column("__draw").to_pylist()):
                lo, hi = int(offsets[d]), int(offsets[d + 1])
                if blank[lo:hi].any():
                    hi = lo
                moved = None if h is None else planted(hi - lo, h)
                if moved is not None:
                    at[lo:hi] = lo + moved
                mine = runs(codes[at[lo:hi]].tolist(), least, repeats) if hi - lo >= least else []
                for start, length, period in mine:
                    keep[lo + start + period : lo + start + length] = False
                found.append(mine)
            counts = np.concatenate(([0], np.cumsum(keep)))[offsets]
            left = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), words.take(pa.array(at[keep])))
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            table = np.array([r for x in found for r in x], dtype=np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
            n_words = np.diff(np.concatenate(([0], np.cumsum(~blank)))[offsets])
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(n_words), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), struct), pc.binary_join(left, " ")], names=["__key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), (F.lit(None) if draw is None else draw).cast("long").alias("__draw"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("__key", key)


def strongest(found: Column) -> Column:
    """The run with the most periods, exactly compared; ties go to the smaller start, then the smaller period. Null where there is none."""
    first = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).when(x["length"] * y["period"] < y["length"] * x["period"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    return F.get(F.array_sort(found, first), F.lit(0))
