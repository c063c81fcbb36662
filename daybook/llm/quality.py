"""Quality classifier: random-indexing word vectors pooled per document, then a small network with calibrated output.

Random indexing: every word bucket owns a sparse random index vector; a bucket's word vector is the sum of the index
vectors of its neighbours over the whole corpus. Each word is two buckets, its letters and its shape (case and
punctuation), hashed into a fixed table, so vectors of all documents add up to one table of ``BUCKETS x DIM`` integers
however large the corpus is. A document is the mean of its word vectors with a few pooled moments. A two-layer
network trained on labelled documents scores it; a temperature fitted on rows left out of training calibrates the
probability.

Null and empty texts pool to zeros and get the network's score for that. Rows without a label are scored but not
learnt from; with fewer than two classes every score is the share of ones (0.5 without labels). Several labels for one
document all count. Other columns pass through; ``score`` and ``predicted`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import STEP_BYTES, distinct_words, kept, steps, text_steps

BUCKETS, DIM, NONZERO = 1 << 14, 32, 2
#: Labelled documents that the network learns from, at most; those with the smallest hashes of their ids.
FIT_ROWS = 20_000


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(7)
    where = np.stack([rng.permutation(DIM)[:NONZERO] for _ in range(BUCKETS)])
    return where, rng.choice(np.array([-1, 1]), size=where.shape)


class Buckets(dict):
    """Word to its two buckets, letters above shape, for the distinct words of a batch at once; emptied when it reaches ``limit`` words, so a worker's memory is bounded.

    The letters are the word's letters and digits in lower case. The shape is its case pattern and punctuation, with runs of a kind of letter or of digits as one: ``Th,`` is ``Xx,``."""

    def __init__(self, limit: int = 700_000):
        super().__init__()
        self.limit = limit

    def learn(self, words: list[str]) -> None:
        column = pa.array(words, pa.string())
        letters = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{N}]+", "")
        shape = column
        for runs, mark in ((r"\p{Lu}+", "X"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "x"), (r"\p{N}+", "9")):
            shape = pc.replace_substring_regex(shape, runs, mark)
        number = lambda c, salt: pd.util.hash_array(np.array(c.to_pylist(), dtype=object), hash_key=salt, categorize=False) % np.uint64(BUCKETS)
        self.update(zip(words, (number(letters, "letters of words") << np.uint64(32) | number(shape, "shapes of a word")).astype(np.int64).tolist(), strict=True))

    def of(self, words: list[str]) -> np.ndarray:
        """Buckets of distinct words."""
        if len(self) > self.limit:
            self.clear()
        fresh = [w for w in words if w not in self]
        if fresh:
            self.learn(fresh)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


#: The name under which a worker keeps its table.
TABLE = "buckets of words"


def _words(texts: list[str], table: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter and shape bucket of every word of all texts, and the number of words of each text."""
    words, at, sizes = distinct_words(texts)
    both = table.of(words)[at]
    return both >> 32, both & 0xFFFFFFFF, sizes


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The corpus's word vectors, unit length where a bucket occurs. Workers add up their own texts; sums of integers don't depend on order."""
    columns = [f"v{i}" for i in range(DIM)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, sign = _index_vectors()
        entries = (2 * where + (sign < 0)).T.copy()  # places of ones, each with a place for minus ones behind it
        table, counts = kept(TABLE, Buckets), np.zeros(2 * BUCKETS * DIM, dtype=np.int64)
        for batch in text_steps(batches, text, keep=TABLE):
            texts = [t for t in batch.column(text).to_pylist() if t]
            core, shape, sizes = _words(texts, table)
            if len(core) < 2:
                continue
            inner = np.ones(len(core) - 1, dtype=bool)
            inner[np.cumsum(sizes)[:-1][sizes[:-1] > 0] - 1] = False  # no context across documents
            left, right = np.flatnonzero(inner), np.flatnonzero(inner) + 1
            theirs = [column[ids] for ids in (core, shape) for column in entries]
            for mine in (core * (2 * DIM), shape * (2 * DIM)):
                for a, b in ((left, right), (right, left)):
                    base = mine[a]
                    for column in theirs:
                        counts += np.bincount(base + column[b], minlength=len(counts))
        grid = (counts[0::2] - counts[1::2]).reshape(BUCKETS, DIM)
        used = np.flatnonzero(grid.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(grid[used, i]) for i in range(DIM))], names=["bucket", *columns])

    schema = "bucket int, " + ", ".join(f"{c} long" for c in columns)
    rows = docs.select(text).mapInArrow(count, schema).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    if len(rows):
        values = rows[columns].to_numpy(dtype=np.float64)
        out[rows["bucket"].to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out


def pool(texts: list[str], vectors: np.ndarray, table: Buckets) -> np.ndarray:
    """One row a text: mean letter vector, mean shape vector, and pooled moments (length of the means, likeness of neighbours, distinct share, log length)."""
    core, shape, sizes = _words(texts, table)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = np.maximum(sizes, 1)[:, None].astype(np.float64)
    out = [np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM))]
    distinct = np.zeros(len(texts))
    for i, (mean, ids) in enumerate(zip(out, (core, shape), strict=True)):
        kinds, times = np.unique(owner * BUCKETS + ids, return_counts=True)  # each word of a text once, with its number
        whose, begins = np.unique(kinds // BUCKETS, return_index=True)
        if len(kinds):
            mean[whose] = np.add.reduceat(vectors[kinds % BUCKETS].astype(np.float64) * times[:, None], begins, axis=0)
        mean /= n
        if not i:
            distinct[whose] = np.diff(np.append(begins, len(kinds))) / n[whose, 0]
    near = np.zeros(len(texts))
    if len(core) > 1:
        same = owner[1:] == owner[:-1]
        like = np.einsum("ij,ij->i", vectors[core[1:]], vectors[core[:-1]])
        near = np.bincount(owner[1:][same], weights=like[same], minlength=len(texts)) / n[:, 0]
    more = np.stack([np.linalg.norm(out[0], axis=1), np.linalg.norm(out[1], axis=1), near, distinct, np.log1p(sizes)], axis=1)
    return np.concatenate([*out, more], axis=1)


def _pooled(docs: DataFrame, vectors: np.ndarray, text: str, finish, schema: str):
    """A pandas UDF over the text that pools each step of rows and hands the matrix to ``finish``."""

    @F.pandas_udf(schema)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = kept(TABLE, Buckets)
        for column in series:
            texts = column.fillna("").tolist()
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 64
            yield pd.concat([finish(pool(texts[s], vectors, table)) for s in steps(sizes, STEP_BYTES)], ignore_index=True) if texts else finish(np.zeros((0, 2 * DIM + 5)))

    return run(F.col(text))


@dataclass
class Network:
    """Two dense layers, a scaling of the inputs and a temperature."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c[:, 0] + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _cross_entropy(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, seed: int = 11) -> Network:
    """Adam on four fifths of the rows; the temperature that suits the other fifth best."""
    if not len(y) or y.min() == y.max():
        return Network(prior=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    net = Network(float(y.mean()), x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3)
    z = (x - net.mean) / net.scale
    net.layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in net.layers], [np.zeros_like(w) for w in net.layers]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        mixed = rng.permutation(fit)
        for lo in range(0, len(mixed), batch):
            rows = mixed[lo : lo + batch]
            a, b, c, d = net.layers
            h = np.tanh(z[rows] @ a + b)
            error = (1 / (1 + np.exp(-np.clip(h @ c[:, 0] + d[0], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(error, c[:, 0]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * a, back.sum(axis=0), h.T @ error[:, None] + 1e-4 * c, np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                net.layers[i] = net.layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    scores = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: _cross_entropy(scores / t, y[held])))
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Network:
    """Network from at most ``rows`` labelled documents; ``labels`` holds only rows that may be learnt from."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("double").alias("__y")).orderBy(F.xxhash64(key), key, "__y").limit(rows)
    width = 2 * DIM + 5
    schema = ", ".join(f"f{i} double" for i in range(width))
    found = docs.select(key, text).join(F.broadcast(chosen), key)  # at most ``rows`` ids
    table = found.select("__y", key, _pooled(found, vectors, text, lambda m: pd.DataFrame(m, columns=[f"f{i}" for i in range(width)]), schema).alias("f")).select(key, "__y", "f.*").toPandas()
    table = table.sort_values([key, "__y"])
    return train(table[[f"f{i}" for i in range(width)]].to_numpy(), table["__y"].to_numpy())


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    out = docs.withColumn("__q", _pooled(docs, vectors, text, lambda m: pd.DataFrame({"p": net.probability(m)}), "p double"))
    return out.withColumn("score", F.col("__q.p")).withColumn("predicted", (F.col("__q.p") >= threshold).cast("int")).drop("__q")
