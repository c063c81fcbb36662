"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is a language's most frequent letter n-grams (one to three characters, words padded by a gap), in order of
frequency. A document is compared by the ranks of its own most frequent n-grams: each costs the difference between its
two ranks, or the whole profile's depth where the language lacks it. N-grams that no profile holds would cost every
language the same, so they are left out of the document's ranking.

Nulls and texts without a letter are ``und`` with score 0. Ties between languages go to the name that sorts first. An
empty training table gives a model that answers ``und``. Other columns pass through; ``lang_pred`` and ``score`` of the
input are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import STEP_BYTES, crc_sql, release, steps, text_steps

GAP = " "
UNKNOWN = "und"
#: Entries of a direct table of n-grams, at most.
DIRECT = 1 << 22
_letter_table: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """One flag for each code point; built once in a worker."""
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter_table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with a zero after each and one before the first, so that every text begins and ends at a gap, and each text's length with its zeros."""
    if not texts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    low = [t.lower() for t in texts]
    joined = "\0" + "\0".join(low) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1
    lengths[0] += 1
    return points, lengths


def _ngrams(ids: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(n, code, start)`` of the n-grams; 0 is the gap. Bigrams of two gaps and trigrams around a gap don't count."""
    start = np.flatnonzero(ids)
    yield 1, ids[start], start
    pair = ids[:-1] * width + ids[1:]
    start = np.flatnonzero(pair)
    yield 2, pair[start], start
    start = np.flatnonzero(ids[1:-1])
    yield 3, pair[start] * width + ids[start + 2], start


def _decode(code: int, n: int, width: int, letters: list[str]) -> str:
    out = []
    for _ in range(n):
        out.append(letters[code % width])
        code //= width
    return "".join(reversed(out))


def count_ngrams(texts: list[str]) -> Counter:
    """Counts of the n-grams of all texts together."""
    points, _ = code_points(texts)
    if not len(points):
        return Counter()
    points = np.where(_is_letter()[points], points, 0)
    present = np.flatnonzero(np.bincount(points))
    present = np.concatenate(([0], present[present > 0]))
    to_id = np.zeros(int(points.max()) + 1, dtype=np.int64)
    to_id[present] = np.arange(len(present))
    letters, width = [GAP, *(chr(c) for c in present[1:])], len(present)
    total: Counter = Counter()
    for n, code, _ in _ngrams(to_id[points], width):
        if width**n <= 1 << 22:
            counts = np.bincount(code)
            values = np.flatnonzero(counts)
            counts = counts[values]
        else:
            values, counts = np.unique(code, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            total[_decode(v, n, width, letters)] += c
    return total


@dataclass
class Profiles:
    """Ranks of each language's n-grams. Its size is bounded by ``languages * depth`` n-grams of three letters."""

    languages: list[str]
    ranks: dict[str, dict[str, int]]
    depth: int


def fit(docs: DataFrame, depth: int = 400, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all rows with a language. Every worker counts its texts; the counts are summed by n-gram, and only the top ``depth`` of each language reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in text_steps(batches, text, STEP_BYTES // 4):
            by_lang: dict[str, list[str]] = {}
            for t, g in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                by_lang.setdefault(g, []).append(t)
            for g, texts in by_lang.items():
                total.setdefault(g, Counter()).update(count_ngrams(texts))
        for g, counts in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [g] * len(counts), "gram": list(counts), "n": list(counts.values())}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < depth).collect()
    ranks: dict[str, dict[str, int]] = {}
    for r in top:
        ranks.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return Profiles(sorted(ranks), ranks, depth)


class _Scorer:
    """Profiles laid out as arrays, made once in a worker."""

    def __init__(self, model: Profiles):
        grams = sorted({g for p in model.ranks.values() for g in p}, key=lambda g: (min(p.get(g, model.depth) for p in model.ranks.values()), g))
        letters = [GAP, *sorted({c for g in grams for c in g} - {GAP})]
        self.width = len(letters) + 1  # one more for letters that no profile has
        self.to_id = np.zeros(0x110000, dtype=np.int64)
        self.to_id[_is_letter()] = self.width - 1
        for i, c in enumerate(letters):
            self.to_id[ord(c)] = i if c != GAP else 0
        place = {c: i for i, c in enumerate(letters)}
        self.codes, self.values, self.direct = {}, {}, {}
        for n in (1, 2, 3):
            own = [(self._code(g, place), v) for v, g in enumerate(grams) if len(g) == n]
            self.codes[n], self.values[n] = (np.array(x, dtype=np.int64) for x in zip(*sorted(own), strict=True)) if own else (np.zeros(0, np.int64),) * 2
            if self.width**n <= DIRECT:
                self.direct[n] = np.full(self.width**n, -1, dtype=np.int64)
                self.direct[n][self.codes[n]] = self.values[n]
        self.size, self.depth, self.languages = len(grams), model.depth, model.languages
        self.ranks = np.full((len(model.languages), len(grams)), model.depth, dtype=np.int64)
        for i, name in enumerate(model.languages):
            for v, g in enumerate(grams):
                self.ranks[i, v] = model.ranks[name].get(g, model.depth)

    def _code(self, gram: str, place: dict[str, int]) -> int:
        code = 0
        for c in gram:
            code = code * self.width + place[c]
        return code

    def known(self, n: int, code: np.ndarray) -> np.ndarray:
        """Number of each n-gram, -1 for those of no profile: by a direct table while one stays small, else by binary search among the profiles' n-grams, with the same result."""
        if n in self.direct:
            return self.direct[n][code]
        if not len(self.codes[n]):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes[n], code), len(self.codes[n]) - 1)
        return np.where(self.codes[n][at] == code, self.values[n][at], -1)

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance to each language over the worst possible, and whether a text has a letter."""
        points, lengths = code_points(texts)
        ids = self.to_id[points]
        owner = np.repeat(np.arange(len(texts)), lengths)
        lettered = np.bincount(owner[ids > 0], minlength=len(texts)) > 0
        counts = np.zeros(len(texts) * self.size, dtype=np.int64)
        for n, code, start in _ngrams(ids, self.width):
            known = self.known(n, code)
            keep = known >= 0
            # a gram that starts on the zero after a text belongs to the next one
            whose = owner[np.minimum(start[keep] + (n > 1) * (ids[start[keep]] == 0), len(owner) - 1)]
            counts += np.bincount(whose * self.size + known[keep], minlength=len(counts))
        counts = counts.reshape(len(texts), self.size)
        order = np.argsort(-counts, axis=1, kind="stable")[:, : self.depth]
        used = np.take_along_axis(counts, order, axis=1) > 0
        place = np.arange(order.shape[1])
        out = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            theirs = self.ranks[i][order]
            cost = np.where(theirs < self.depth, np.abs(theirs - place), self.depth)
            out[:, i] = (cost * used).sum(axis=1) / np.maximum(used.sum(axis=1) * self.depth, 1)
        out[used.sum(axis=1) == 0] = 1.0
        return out, lettered


def identify(docs: DataFrame, model: Profiles, text: str = "text", sharpness: float = 25.0) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the nearest profile, and its share when nearness falls off exponentially."""

    @F.pandas_udf("lang string, score double")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        scorer = _Scorer(model) if model.languages else None
        for column in series:
            texts = column.fillna("").tolist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for s in steps(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 4000, STEP_BYTES // 8) if scorer else ():
                far, lettered = scorer.distances(texts[s])
                best = far.argmin(axis=1)
                share = np.exp(-sharpness * (far - far.min(axis=1, keepdims=True)))
                scores[s] = np.where(lettered, 1 / share.sum(axis=1), 0.0)
                for i in np.flatnonzero(lettered):
                    names[s.start + i] = scorer.languages[best[i]]
            yield pd.DataFrame({"lang": names, "score": scores})
        release()

    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    out = docs.withColumn("__lang_id", predict(F.col(text)))
    return out.withColumn("lang_pred", F.col("__lang_id.lang")).withColumn("score", F.col("__lang_id.score")).drop("__lang_id")


def oracle(source: str = "documents", depth: int = 400, sharpness: float = 25.0) -> str:
    """DuckDB SQL for ``doc_id, held_out, lang_pred, score`` with the score rounded to six digits: profiles from documents whose crc32 is no multiple of five, all documents compared. For tables with distinct integer ids."""
    return f"""
WITH d AS (SELECT doc_id, lang, text IS NOT NULL AND lang IS NOT NULL AND {crc_sql("doc_id")} % 5 <> 0 AS learnt, {crc_sql("doc_id")} % 5 = 0 AS held_out, string_split(' ' || regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]', ' ', 'g') || ' ', '') AS cs FROM {source}),
z AS (SELECT doc_id, unnest(list_zip(cs, cs[2:], cs[3:])) AS t FROM d),
g AS (SELECT doc_id, t[1] AS gram FROM z WHERE t[1] <> ' ' UNION ALL SELECT doc_id, t[1] || t[2] FROM z WHERE t[1] || t[2] <> '  ' UNION ALL SELECT doc_id, t[1] || t[2] || t[3] FROM z WHERE t[2] <> ' ' AND t[3] IS NOT NULL),
c AS MATERIALIZED (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2),
ranks AS MATERIALIZED (SELECT lang, gram, k - 1 AS r FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS k FROM c JOIN d USING (doc_id) WHERE learnt GROUP BY 1, 2) WHERE k <= {depth}),
firsts AS (SELECT gram, min(r) AS f FROM ranks GROUP BY 1),
mine AS (SELECT doc_id, gram, k - 1 AS place FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, gram) AS k FROM c JOIN firsts USING (gram)) WHERE k <= {depth}),
langs AS (SELECT DISTINCT lang FROM ranks),
far AS (SELECT doc_id, l.lang, sum(CASE WHEN r IS NULL THEN {depth} ELSE abs(r - place) END) / (count(*) * {depth}.0) AS x FROM mine CROSS JOIN langs l LEFT JOIN ranks ON ranks.lang = l.lang AND ranks.gram = mine.gram GROUP BY 1, 2),
every AS (SELECT d.doc_id, l.lang, coalesce(far.x, 1.0) AS x, min(coalesce(far.x, 1.0)) OVER (PARTITION BY d.doc_id) AS best FROM d CROSS JOIN langs l LEFT JOIN far ON far.doc_id = d.doc_id AND far.lang = l.lang WHERE list_bool_or(list_transform(cs, lambda ch: ch <> ' '))),
told AS (SELECT doc_id, min(lang) FILTER (x = best) AS lang_pred, 1 / sum(exp(-{sharpness} * (x - best))) AS score FROM every GROUP BY 1)
SELECT doc_id, held_out, coalesce(lang_pred, '{UNKNOWN}') AS lang_pred, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score FROM d LEFT JOIN told USING (doc_id)"""
