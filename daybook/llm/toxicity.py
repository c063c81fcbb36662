"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals add up to document scores.

Labels mark documents, the field needs labelled tokens. Words whose document frequency is significantly higher in toxic
than in clean labelled documents mark the tokens of toxic documents as toxic; every other token is clean. The field has
two states, one weight for each hashed word and for each hashed word beginning, and a full transition table, and is
trained by gradient steps on its exact likelihood. Word statistics are counted in the cluster; only the words that pass, bucket numbers of a bounded number of pieces of texts, and
five features a labelled document reach the driver, never a text. Forward and backward passes give each token's marginal; a logistic
layer turns a document's largest marginal, their sum and share and its length into its score.

Null and empty texts have no token and get the logistic layer's score for that. Without both classes among the
labels every score is the share of toxic ones (0 without labels). Other columns pass through; ``score``, ``predicted`` and ``spans`` of
the input are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import STEP_BYTES, WordTable, distinct_words, release, steps, text_steps
from daybook.operators.durable import drop, save

BUCKETS = 1 << 17
#: Labelled clean and toxic documents that word statistics and the logistic layer are taken from, at most; those with the smallest hashes of their ids.
FIT_ROWS = (8_000, 4_000)
#: Words of a piece, and pieces of clean and of toxic documents that the field trains on, at most; those with the smallest hashes. A piece is a sequence of its own.
PIECE, PIECES = 400, 2_000
#: Letters of a word's beginning.
HEAD = 4
#: Log odds of the toxic state for a word that no toxic document has.
BIAS = -4.0


def normal(word: str) -> str:
    return "".join(filter(str.isalnum, word)).lower()


def _bucket(word: str) -> int:
    """Bucket of the word and, in the upper half, of its beginning."""
    core = normal(word)
    if not core:
        return 0
    head = zlib.crc32(b"\1" + core[:HEAD].encode("utf-8", "replace")) % (BUCKETS - 1) + 1 if len(core) > HEAD else 0
    return head << 32 | zlib.crc32(core.encode("utf-8", "replace")) % (BUCKETS - 1) + 1


def _tokens(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets for each word of all texts (2 x words), and the number of words of each text."""
    words, at, sizes = distinct_words(texts)
    both = np.fromiter((table[w] for w in words), dtype=np.int64, count=len(words))[at]
    return np.stack([both & 0xFFFFFFFF, both >> 32]), sizes


@dataclass
class Field:
    """``emission`` holds the log odds of the toxic state for each bucket, ``transition`` log potentials between the states (the first row also starts a sequence), ``doc`` the logistic layer."""

    emission: np.ndarray
    transition: np.ndarray
    doc: np.ndarray
    prior: float = 0.0
    fitted: bool = False


def forward_backward(field: Field, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios toxic : clean of the forward message and of the backward message at each token, and of its emission.

    All documents advance together, longest first, so one step works on every document that is long enough. With two states a message is one
    number, its ratio, and stays finite."""
    e = np.exp(np.clip(BIAS + field.emission[ids[0]] + field.emission[ids[1]], -30, 30))
    t = np.exp(field.transition)
    order = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    ahead, back = np.empty(len(e)), np.ones(len(e))
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # documents longer than each step
    r = np.zeros(0)
    for step in range(longest):
        at = begin[: alive[step]] + step
        came = np.full(len(at), t[0, 1] / t[0, 0]) if step == 0 else (t[0, 1] + r[: len(at)] * t[1, 1]) / (t[0, 0] + r[: len(at)] * t[1, 0])
        r = ahead[at] = e[at] * came
    for step in range(longest - 2, -1, -1):
        at = begin[: alive[step + 1]] + step
        weight = e[at + 1] * back[at + 1]
        back[at] = (t[1, 0] + t[1, 1] * weight) / (t[0, 0] + t[0, 1] * weight)
    return ahead, back, e


def marginals(field: Field, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ahead, back, _ = forward_backward(field, ids, sizes)
    odds = ahead * back
    return odds / (1 + odds)


def lexicon(found: DataFrame, clean: int, toxic: int, text: str, least: int = 4, odds: float = 5.0, sure: float = 3.0) -> set[str]:
    """Words that at least ``least`` toxic documents hold, ``odds`` times as often as clean ones (with half a document added to both) and by ``sure`` standard errors of the log ratio. ``found`` has the text and the label ``__y``; each task counts its own documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        core = WordTable(normal, 300_000)
        for batch in text_steps(batches, text):
            for t, y in zip(batch.column(text).to_pylist(), batch.column("__y").to_pylist(), strict=True):
                for w in {core[w] for w in (t or "").split()} - {""}:
                    seen.setdefault(w, [0, 0])[y] += 1
            if len(seen) > 500_000:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    words = found.select(text, "__y").mapInArrow(count, "word string, m long, n long").groupBy("word").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    ratio = F.ln((F.col("n") + 0.5) / toxic) - F.ln((F.col("m") + 0.5) / clean)
    error = F.sqrt(1 / (F.col("n") + 0.5) + 1 / (F.col("m") + 0.5))
    passed = words.where((F.col("n") >= least) & (ratio >= float(np.log(odds))) & (ratio >= sure * error))  # words of a bounded number of toxic documents
    return {r["word"] for r in passed.select("word").collect()}


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    clean, toxic = zip(*seen.values(), strict=True) if seen else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["word", "m", "n"])


def pieces(found: DataFrame, words: set[str], key: str, text: str, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets (2 x words) and token labels of at most ``most`` pieces of documents of each class, in an order of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, marked = WordTable(_bucket, 300_000), WordTable(lambda w: normal(w) in words, 300_000)
        for batch in text_steps(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            held, at, sizes = distinct_words(texts)
            both = np.fromiter((table[w] for w in held), dtype=np.int64, count=len(held))[at]
            sure = np.fromiter((marked[w] for w in held), dtype=bool, count=len(held))[at]
            ids = np.stack([both & 0xFFFFFFFF, both >> 32]).astype("<i4")
            rows, begin = [], 0
            for k, y, size in zip(batch.column("__k").to_pylist(), batch.column("__y").to_pylist(), sizes.tolist(), strict=True):
                for i in range(0, size, PIECE):
                    part = slice(begin + i, begin + min(i + PIECE, size))
                    rows.append((k, i, y, ids[:, part].tobytes(), (sure[part] & bool(y)).astype(np.uint8).tobytes()))
                begin += size
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["k", "i", "y", "ids", "marks"])

    cuts = found.select(F.xxhash64(key).alias("__k"), text, "__y").mapInArrow(cut, "k long, i long, y int, ids binary, marks binary")
    rows = [r for y in (0, 1) for r in cuts.where(F.col("y") == y).orderBy(F.xxhash64("k", "i"), "k", "i", "ids").limit(most).collect()]  # some bytes a word
    return [(np.frombuffer(r["ids"], "<i4").astype(np.int64).reshape(2, -1), np.frombuffer(r["marks"], np.uint8).astype(bool)) for r in rows]


def _doc_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, weights=p, minlength=len(sizes))
    most = np.zeros(len(sizes))
    np.maximum.at(most, owner[p > 0.01], p[p > 0.01])
    return np.stack([np.ones(len(sizes)), most, np.log1p(total), np.sqrt(total / np.maximum(sizes, 1)), np.log1p(sizes) / 10], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(parts: list[tuple[np.ndarray, np.ndarray]], field: Field, updates: int = 96, group: int = 128, rate: float = 0.3) -> None:
    """About ``updates`` adaptive gradient steps of the field on the likelihood of groups of pieces."""
    rng = np.random.default_rng(5)
    square_e, square_t = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(-(-updates // max(1, -(-len(parts) // group)))):
        order = rng.permutation(len(parts))
        for lo in range(0, len(order), group):
            chosen = [parts[i] for i in order[lo : lo + group]]
            ids, y = np.concatenate([i for i, _ in chosen], axis=1), np.concatenate([m for _, m in chosen])
            sizes = np.array([len(m) for _, m in chosen])
            ahead, back, e = forward_backward(field, ids, sizes)
            p = ahead * back / (1 + ahead * back)
            slope = sum(np.bincount(kind, weights=y - p, minlength=BUCKETS) for kind in ids) - 1e-3 * field.emission
            inner = np.ones(ids.shape[1], dtype=bool)
            inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
            now = np.flatnonzero(inner)
            t, came = np.exp(field.transition), ahead[now - 1]
            pull = e[now] * back[now]
            pairs = np.stack([np.full(len(now), t[0, 0]), t[0, 1] * pull, t[1, 0] * came, t[1, 1] * came * pull])
            pairs /= pairs.sum(axis=0)
            real = np.bincount(2 * y[now - 1] + y[now], minlength=4)
            turn = (real - pairs.sum(axis=1)).reshape(2, 2)
            square_e += slope * slope
            square_t += turn * turn
            field.emission += rate * slope / np.sqrt(square_e)
            field.transition += 0.3 * rate * turn / np.sqrt(square_t)
            field.emission.clip(-12, 12, out=field.emission)
            field.transition.clip(-6, 6, out=field.transition)


def train_layer(x: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Logistic layer on document features, weighted to the classes' shares in all labels: Newton steps with a small ridge."""
    weight = np.where(toxic == 1, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean())) / len(toxic)
    doc = np.zeros(x.shape[1])
    for _ in range(60):
        q = _sigmoid(x @ doc)
        slope = x.T @ (weight * (toxic - q)) - 1e-4 * doc
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(doc))
        doc = doc + np.linalg.solve(curve, slope)
    return doc


def _features(field: Field):
    """A pandas UDF from texts to document features."""

    @F.pandas_udf(", ".join(f"f{i} double" for i in range(5)))
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        table = WordTable(_bucket, 400_000)
        for column in series:
            texts = column.fillna("").tolist()
            lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 64
            out = np.zeros((len(texts), 5))
            for s in steps(lengths, 4 * STEP_BYTES):
                ids, sizes = _tokens(texts[s], table)
                out[s] = _doc_features(marginals(field, ids, sizes), sizes)
            yield pd.DataFrame(out, columns=[f"f{i}" for i in range(5)])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: tuple[int, int] = FIT_ROWS) -> Field:
    """Field from at most ``rows`` labelled documents, clean and toxic; ``labels`` holds only rows that may be learnt from."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("__y"))
    prior = float(usable.agg(F.avg("__y")).first()[0] or 0.0)
    field = Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(5), prior)
    by_class = [usable.where(F.col("__y") == y).orderBy(F.xxhash64(key), key).limit(rows[y]) for y in (0, 1)]
    chosen = F.broadcast(by_class[0].unionByName(by_class[1]))  # at most sum(rows) ids
    found = save(docs.select(key, text).join(chosen, key), "labelled")
    sizes = {r["__y"]: r["n"] for r in found.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) == 2:
        train(pieces(found, lexicon(found, sizes[0], sizes[1], text), key, text, PIECES), field)
        table = found.select(key, "__y", _features(field)(F.col(text)).alias("f")).select(key, "__y", "f.*").toPandas().sort_values([key, "__y"])  # seven numbers a document
        field.doc, field.fitted = train_layer(table[[f"f{i}" for i in range(5)]].to_numpy(), table["__y"].to_numpy(dtype=np.int64), prior), True
    drop(found)
    return field


def score(docs: DataFrame, field: Field, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``spans``: the character ranges (end excluded) of words whose toxic marginal is at least a half, with that marginal."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def tag(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        table = WordTable(_bucket, 400_000)
        for column in series:
            texts = column.fillna("").tolist()
            scores, spans = np.full(len(texts), field.prior), [[] for _ in texts]
            lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 64
            for s in steps(lengths, 4 * STEP_BYTES) if field.fitted else ():
                ids, sizes = _tokens(texts[s], table)
                p = marginals(field, ids, sizes)
                scores[s] = _sigmoid(_doc_features(p, sizes) @ field.doc)
                ends = np.cumsum(sizes)
                bad = np.flatnonzero(p >= 0.5)
                for i in np.unique(np.searchsorted(ends, bad, side="right")):
                    lo = ends[i] - sizes[i]
                    where = [m.span() for m in _WORD.finditer(texts[s.start + i])]
                    spans[s.start + i] = [{"start": where[k - lo][0], "end": where[k - lo][1], "p": float(p[k])} for k in bad[(bad >= lo) & (bad < ends[i])]]
            yield pd.DataFrame({"score": scores, "spans": spans})

    out = docs.withColumn("__tox", tag(F.col(text)))
    return out.withColumn("score", F.col("__tox.score")).withColumn("predicted", (F.col("__tox.score") >= threshold).cast("int")).withColumn("spans", F.col("__tox.spans")).drop("__tox")


#: The words of ``str.split``: what separates them is what ``str.isspace`` accepts.
_WORD = re.compile(r"[^\s\x1c-\x1f\x85]+")
