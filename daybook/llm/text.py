"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that one step inside a Python worker handles at once; a longer single text is a step of its own.
STEP_BYTES = 4_000_000


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the rule that holds rows out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def crc_sql(column: str) -> str:
    """DuckDB SQL for crc32 of an integer as text, byte by byte and bit by bit."""
    digits = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    byte = "list_reduce([xor(c, b)] || [CAST(x AS BIGINT) FOR x IN range(8)], lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {digits}, lambda c, b: {byte}), 4294967295)"


def steps(lengths: np.ndarray, budget: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows whose lengths sum to about ``budget``."""
    edges = np.cumsum(lengths, dtype=np.int64) // budget
    cuts = np.flatnonzero(np.diff(edges)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)], strict=True):
        if hi > lo:
            yield slice(lo, hi)


_kept: dict[str, object] = {}


def kept(name: str, make):
    """This worker's object of that name, which later tasks find again until another operator begins in the worker."""
    release(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release(keep: str | None = None) -> None:
    """Drop what other operators kept, and give back to the system what earlier tasks of this worker have freed. A worker outlives its tasks, and what is left of one stage would count beside the next."""
    for name in [k for k in _kept if k != keep]:
        del _kept[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have none
    if trim:
        trim(0)


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = STEP_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that their texts sum to about ``budget`` bytes; nulls count as empty. What the worker kept under another name than ``keep`` goes."""
    release(keep)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for s in steps(sizes.astype(np.int64) + 64, budget):
            yield batch.slice(s.start, s.stop - s.start)
    release(keep)  # an idle worker counts beside stages that need none


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts, the number of each word of the texts among them, and how many words each text has. Words are those of ``str.split``, which Arrow splits alike."""
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(texts, pa.string())))
    words, sizes = split.flatten(), np.diff(split.offsets.to_numpy()).astype(np.int64)
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # of a blank text there is one empty word
    if blank.any():
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[blank], minlength=len(sizes))
        words = words.filter(pa.array(~blank))
    told = words.dictionary_encode()
    return told.dictionary.to_pylist(), told.indices.to_numpy().astype(np.int64), sizes


class WordTable(dict):
    """Word to value, computed once a word; emptied when it reaches ``limit`` words, so a worker's memory is bounded."""

    def __init__(self, value, limit: int = 1_000_000):
        super().__init__()
        self.value, self.limit = value, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = self.value(word)
        return out
