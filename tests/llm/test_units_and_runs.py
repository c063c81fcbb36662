"""Fill-in-middle, BPE and runs of words against plain versions."""

import hashlib
import json
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daybook.llm import bpe, infill, queries, runs

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(5)
ODD = [
    None, "", " ", "a", "\n", "one two\nthree", "x<P>y", "<S>", "<M><M>", "tail <", "<P", "S>", "ünï cödé Straße", "日本語 テキスト 12345", "😀👩‍👩‍👧 é", "a" * 5000, "ab" * 4000, "\x00\x01 \x1f\x1c", "it's we'll 'S x'd''s 'salt I'VE",
    "<|endoftext|>a<|startoftext|> A<|ENDOFTEXT|>B", "Σας ΣΑΣ İstanbul ﬁ x\x85w v", "w " * 200, "a b c " * 40 + "a b", "p q " * 30 + "z " + "p q " * 30, "the end " * 3000,
]


def table(spark, texts, first=0):
    """Texts with an id, columns that clash with names of the operators, and one row twice."""
    rows = [(first + i, t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, output string, n long").repartition(3)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain_infill(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_against_unit_arrays(spark):
    texts = ODD + ["".join(rng.choice("ab <>PSM.é\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    out = infill.transform(table(spark, texts)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(texts) + 1 and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "")


def test_infill_edges(spark):
    assert infill.transform(table(spark, ["a"]).where("false")).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), ("k", "a b c"), ("k", "a b c")], "name string, body string")
    out = infill.transform(rows, "name", "body").collect()
    assert len(out) == 3 and len({tuple(r) for r in out}) == 2 and out[0].n == 5
    assert infill.places("ab c", 0, 0) == (0, 0) and infill.places("ab c", 3, 3) == (4, 4) and infill.places("ab c", 1, 2) == (2, 3)


def test_query_of_infill_against_sql(spark, tmp_path):
    docs = table(spark, ODD).select("doc_id", "text")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_fill_in_middle(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [tuple(r) for r in docs.collect()])
    assert sorted(map(str, c.execute(infill.oracle()).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_bpe_against_the_library(spark):
    own = ["".join(rng.choice(s) for _ in range(rng.randrange(1, 80))) for s in ("etaonihs", "abeinth rs'1!<|>é") for _ in range(1500)]
    texts = ODD + own
    library = Tokenizer.from_file(TOKENIZER)
    coded = bpe.encode(table(spark, texts), TOKENIZER, decoded=True)
    apart = {r.doc_id: r.decoded for r in bpe.decode(coded, TOKENIZER).collect()}
    out = coded.collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == apart[r.doc_id] == library.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark):
    assert bpe.encode(table(spark, ["a"]).where("false"), TOKENIZER).count() == 0
    none = spark.createDataFrame([(1, None), (2, bytearray())], "k long, ids binary")
    assert {r.decoded for r in bpe.decode(none, TOKENIZER, "k").collect()} == {""}


def merge_by_rank(symbols, pairs):
    """Merging as it is defined: the first of the lowest rank, until none is left."""
    ids = list(symbols)
    while True:
        ranked = [(pairs[a, b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (a, b) in pairs]
        if not ranked:
            return ids
        _, i = min(ranked)
        ids[i : i + 2] = [pairs[ids[i], ids[i + 1]][1]]


@pytest.mark.parametrize("seed", range(40))
def test_speculation_on_random_vocabularies(seed):
    """Every pair test and both exact merges against the definition; merges of any two entries, so that many greedy proposals are wrong and some entries can't be reached."""
    draw = random.Random(seed)
    letters = draw.choice([1, 2, 3])
    vocabulary = {(s,): s for s in range(letters)}
    merges = []
    for _ in range(draw.randrange(1, 14)):
        a, b = draw.choice(list(vocabulary)), draw.choice(list(vocabulary))
        if a + b not in vocabulary:
            vocabulary[a + b] = len(vocabulary)
            merges.append((vocabulary[a], vocabulary[b], vocabulary[a + b]))
    model = bpe.Merges(vocabulary, merges)
    words = [[draw.randrange(letters) for _ in range(draw.randrange(1, 45))] for _ in range(200)]
    stops = np.cumsum([len(w) for w in words])
    # words end at white space in real files, so their last symbols are of their own; here entries would join words
    singles = [model.words(np.array(w), np.array([len(w)]))[0].tolist() for w in words]
    want = [merge_by_rank(w, model.pairs) for w in words]
    assert singles == want
    assert [model.merge(w) for w in words] == want
    flat, sizes = model.exact(np.array([s for w in words for s in w]), np.concatenate(([0], stops[:-1])), np.diff(stops, prepend=0))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
    for a in vocabulary:
        for b in vocabulary:
            if merge_by_rank(a, model.pairs) == [vocabulary[a]] and merge_by_rank(b, model.pairs) == [vocabulary[b]]:
                assert model.compatible(np.array([vocabulary[a]]), np.array([vocabulary[b]]))[0] == (merge_by_rank(a + b, model.pairs) == [vocabulary[a], vocabulary[b]])


def test_merges_out_of_order_are_exact():
    vocabulary = {(0,): 0, (1,): 1, (0, 1): 2, (0, 1, 1): 3}
    model = bpe.Merges(vocabulary, [(2, 1, 3), (0, 1, 2)])
    assert not model.ordered and model.words(np.array([0, 1, 1, 0]), np.array([3, 4]))[0].tolist() == [3, 0]


def test_plain_words_are_those_of_the_library():
    library = Tokenizer.from_file(TOKENIZER)
    stretches = ["", "it's", "'salt", "x'd''s", "''ll", "5's", "don't!!", "'", "'s'", "a1b22", "straße's", "…", "'re", "'r", "'ve'll", "--'m--"]
    stretches = [s for s in stretches if re.fullmatch(r"[\x21-\x7eß]*", s)] + ["".join(rng.choice("'stmdrevl1-a") for _ in range(9)) for _ in range(500)]
    words, sizes = bpe.plain_words(pa.array(stretches, pa.string()))
    shown, at = bpe.byte_characters(), 0
    for s, n in zip(stretches, sizes, strict=True):
        got = ["".join(shown[b] for b in w) for w in words.to_pylist()[at : at + n]]
        assert got == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(s)]
        at += n


def brute_runs(s, least=24, repeats=3):
    n, out = len(s), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            whole = s[i : j + p]
            if j > i and len(whole) >= max(least, repeats * p) and not any(all(whole[x] == whole[x + q] for x in range(len(whole) - q)) for q in range(1, p)):
                out.append((i, len(whole), p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(400):
        s = [draw.randrange(draw.choice([1, 2, 3, 4])) for _ in range(draw.randrange(1, 12))]
        for _ in range(draw.randrange(5)):
            s = draw.choice([lambda: s + s, lambda: [*s, draw.randrange(3)], lambda: s[: draw.randrange(1, len(s) + 1)] + s, lambda: s + s[draw.randrange(len(s)) :]])()
        s = s[:120]
        for least, repeats in ((2, 2), (5, 3), (24, 3)):
            assert runs.runs(s, least, repeats) == brute_runs(s, least, repeats)


def test_matching_is_linear():
    """No symbol is matched twice: counted by symbols that count their comparisons, against the matches that a plain loop over the same pairs would need."""

    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    fib = ([0], [0, 1])
    while len(fib[1]) < 6000:
        fib = fib[1], fib[1] + fib[0]
    for s in ([0] * 6000, fib[1], [0, 0, 1] * 2000, ([0] * 99 + [1]) * 60, [x for k in range(100) for x in [1] + [0] * k]):
        for text in (s, [1 - x for x in s]):
            Counted.seen = 0
            runs.lyndon_candidates([Counted(x) for x in text])
            assert Counted.seen <= 6 * len(text)


def plain_runs_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *one, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_of_runs_against_brute_force(spark, tmp_path):
    draw = random.Random(9)
    texts = [t for t in ODD if t is None or len(t) < 5000] + ["x " * 300 + "y x " * 100]
    for _ in range(250):
        s = [draw.choice("abcd") for _ in range(draw.randrange(1, 30))]
        for _ in range(draw.randrange(4)):
            s = draw.choice([lambda: s + s, lambda: s * 3, lambda: s[: len(s) // 2] + s, lambda: [*s, "z"]])()
        texts.append(draw.choice([" ", "\n", " \t\x0b", "  "]).join(s[:300]) + draw.choice(["", " "]))
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = [plain_runs_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_runs > 0 for r in got) > 50 and sum(r.n_runs > 1 for r in got) > 5


def test_runs_edges(spark):
    assert runs.find_runs(table(spark, ["a"]).where("false")).count() == 0
    rows = {r.doc_id: r for r in runs.find_runs(table(spark, [None, "", " \n", "a " * 24, "a " * 23, "x y " * 30])).collect()}
    assert [rows[i].n_words for i in range(6)] == [0, 0, 0, 24, 23, 30] and [rows[i].collapsed for i in (0, 1, 2, 3)] == ["", "", "", "a"]
    assert [tuple(r) for r in rows[3].runs] == [(0, 24, 1)] and rows[4].runs == [] and rows[5].collapsed == "x y"
    ties = spark.createDataFrame([([(5, 30, 5), (1, 60, 10), (1, 30, 5), (9, 29, 5)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    got = [r.b for r in ties.select(runs.strongest(F.col("runs")).alias("b")).collect()]
    assert tuple(got[0]) == (1, 30, 5) and got[1] is None


def test_bpe_query_gives_digests_of_ids(spark, tmp_path):
    texts = [t for t in ODD if t is None or len(t) < 3000]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    library = Tokenizer.from_file(TOKENIZER)
    for r in queries.op12_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))
    assert json.load(open(TOKENIZER))["decoder"] is None
