"""Line dedup, n-gram join, decontamination, packing and the pipeline against brute force."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from daybook.llm import decontaminate, line_dedup, ngram_join, packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def brute_lines(docs, least):
    """Deleted lines by trying every run of lines."""
    pos = [(d, i) for d, lines in docs for i in range(len(lines))]
    seen, gone = {}, set()
    for d, lines in docs:
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                seen.setdefault(tuple(lines[i:j]), (d, i))
    for d, lines in docs:
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = lines[i:j]
                if sum(len(x.split()) for x in run) >= least and seen[tuple(run)] < (d, i):
                    gone |= {(d, k) for k in range(i, j)}
    assert pos
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_against_every_run(spark, seed):
    rng = random.Random(seed)
    pool = ["", "a", "b b", "c c c", "d d d d", "e e", "f"]
    docs = [(d, [rng.choice(pool) if rng.random() < 0.9 else f"own {d} {i}" for i in range(rng.randrange(1, 14))]) for d in range(30)]
    docs[7] = (7, docs[3][1])
    gone = brute_lines(docs, 5)
    df = spark.createDataFrame([(d, "\n".join(lines), "x") for d, lines in docs], "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=5).collect()}
    for d, lines in docs:
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        assert got[d].text == "\n".join(kept) and got[d].n_removed == len(lines) - len(kept)
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [(d, "\n".join(lines)) for d, lines in docs])
    assert sorted(c.execute(line_dedup.oracle(5)).fetchall()) == sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.values())


def test_line_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "w " * 60), (3, "w " * 60), (None, "w " * 60), (4, "w " * 60 + "\nown")]
    got = sorted((r.doc_id or 99, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text is not None)
    assert got == sorted([(2, ""), (3, "w " * 60), (3, "w " * 60), (99, ""), (4, "own")])
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_writes_two_tables_a_level(spark, monkeypatch):
    """Runs of five lines take three levels; every level names its runs and the next level's lines together."""
    made, write = [], line_dedup.save
    monkeypatch.setattr(line_dedup, "save", lambda df, label, *a: made.append(label) or write(df, label, *a))
    rows = [(d, "\n".join("abcdefg" if d < 3 else f"own{d}")) for d in range(6)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {0: 0, 1: 7, 2: 7, 3: 0, 4: 0, 5: 0}
    assert len(made) <= 4 + 2 * 3


def brute_sets(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(docs):
    sets = {d: brute_sets(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_ngram_join_against_all_pairs(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        if base % 3 == 0:
            words[5:5] = passage
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(999)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(200, None), (201, ""), (202, "a B c"), (203, "A b C"), (204, "a b"), (205, " \t\n"), (206, "é É"), (207, "É É"), (208, docs[0][1].upper())]
    got = {r.id: (r.n, r.component) for r in ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_ngram_join_large_group_and_edges(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:59], f"x{i % 40}"])) for i in range(300)] + [(1000, " ".join(base[:30] + [f"y{i}" for i in range(30)])), (None, "a b"), (7, "other text of an id that repeats")]
    rows = ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component for r in rows if r.id is not None and r.id < 300} == {0} and len(rows) == len(docs)
    assert [r.component for r in rows if r.id == 1000] == [1000] and [r.component for r in rows if r.id is None] == [None]
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def family(n, edits, words=60, seed=1):
    """Texts that differ from one base in some words each."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(words), edits(i)):
            copy[k] = f"e{i}.{k}"
        out.append(" ".join(copy))
    return out


def test_ngram_join_with_chunks_salted_lists_and_large_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 20)
    texts = family(150, lambda i: i % 4) + family(90, lambda i: 3 + i % 2, words=50, seed=2)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    for chunk in (7, ngram_join.CHUNK):
        assert {r.id: (r.n, r.component) for r in ngram_join.components(df, chunk=chunk).collect()} == want


def test_look_alikes_below_the_threshold_make_no_pairs(spark):
    docs = list(enumerate(family(400, lambda i: 4)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = ngram_join.save(ngram_join.profiles(df, "doc_id", "text"), "profiles")
    bitmaps = ngram_join.long_lists(found, len(docs))
    lists = ngram_join.merged_lists(df, bitmaps, "doc_id", "text", 75)
    nodes = found.where("sig is not null").select("id", "n", "sketch", found["id"].alias("part"))
    pairs = ngram_join.candidates(ngram_join.mixed_lists(lists, nodes), 75)
    sets = {d: brute_sets(t) for d, t in docs}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {(r.a, r.b) for r in pairs.collect()}
    assert {(a, b) for a in sets for b in sets if a < b and like(a, b) >= 0.75} <= got and len(got) < 0.02 * 400 * 399 / 2


@pytest.mark.parametrize("seed", range(3))
def test_sketches_never_rule_out_what_differs_less(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 1 << 63, size=n).astype(np.uint64)) for n in (1, 5, 60, 300, 3000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, size=len(s) // 9).astype(np.uint64)])) for s in sets]
    told = ngram_join._Sketches([ngram_join.sketch(s) for s in sets])
    left, right = np.triu_indices(len(sets), 1)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)])
    assert (told.differ(left, right) <= real).all() and told.differ(left, right).sum() > 0


@pytest.mark.parametrize("seed", range(3))
def test_list_pairs_against_every_pair(seed):
    rng = np.random.default_rng(seed)
    rows, chunk, starts, want = [], [], [], set()
    for size in (1, 2, 5, ngram_join.SMALL_LIST, ngram_join.SMALL_LIST + 1, 90):
        n = np.sort(rng.integers(40, 90, size=size))
        own = np.stack([np.arange(size) + 1000 * len(starts), n, rng.integers(0, 4, size=size)], axis=1)
        c = rng.integers(0, 2, size=size) if size % 2 else np.zeros(size, int)
        starts.append(len(rows))
        for i in range(size):
            for j in range(i + 1, size):
                if own[i, 2] != own[j, 2] and 100 * n[i] >= 75 * n[j] and (c[i] != c[j] or c.min() == c.max()):
                    want.add((len(rows) + i, len(rows) + j))
        rows += own.tolist()
        chunk += c.tolist()
    got = [tuple(sorted(p)) for a, b in ngram_join._list_pairs(np.array(rows), np.array(chunk), np.array(starts), 75) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_probe_against_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 30, size=rng.integers(1, 25)).astype(np.uint64)) for _ in range(2))
        same = len(np.intersect1d(x, y))
        assert ngram_join.links(x, y) == (100 * same >= 75 * (len(x) + len(y) - same))


WORDS = "amber birch cedar delta ember fjord grove hazel inlet jetty knoll larch maple north olive pine quartz ridge slate tundra".split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_band_against_full_alignment():
    rng = random.Random(8)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(12))
        region = "".join(rng.choice("abc") for _ in range(rng.randrange(8, 24)))
        best = min(edits(pattern, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        got = decontaminate.align(code(pattern), code(region), 4)
        assert (got[0] if got else None) == (best if best <= 4 else None)
        if got:
            assert edits(pattern, region[got[1] : got[2]]) == got[0]


def test_decontamination(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(20 + 10 * i)) for i in range(6)] + [(10, "tiny item"), (11, ""), (12, None), (13, "?!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = items[3][1].replace("a", "A", 1)[:-3] + "zzz"
    docs = [(0, say(300)), (1, f"{say(50)}. {items[2][1]}! {say(20)}"), (2, f"{say(9)} {near} {say(9)}"), (3, items[5][1][:60]), (4, None), (5, ""), (6, "a Tiny, item."), (7, items[1][1]), (7, items[1][1]), (8, say(20000) + " " + items[0][1])]
    got = decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", __import__("pyspark").sql.functions.lit(1)), bench).collect()
    found = [(r.doc_id, [x["item"] for x in r.leaks]) for r in got]
    assert sorted(found) == sorted([(0, []), (1, [2]), (2, [3]), (3, []), (4, []), (5, []), (6, [10]), (7, [1]), (7, [1]), (8, [0])])
    hit = next(r for r in got if r.doc_id == 1).leaks[0]
    assert docs[1][1][hit.start : hit.stop] in items[2][1] and hit.stop - hit.start > 150 and hit.edits == 0  # of a long item, its best window
    assert decontaminate.mark(spark.createDataFrame(docs[:1], "doc_id long, text string"), bench.where("false")).first().leaks == []


@pytest.mark.parametrize("size", [81, 195, 246, 384])
def test_quotations_at_every_offset(size):
    rng = random.Random(size)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    item = " ".join(words)[:size].strip().ljust(size, "z")
    other = lambda: " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(30))
    windows = decontaminate.prepare([(7, item)])
    docs = [f"{other()} {item[i : i + decontaminate.SURE]} {other()}" for i in range(size - decontaminate.SURE + 1)] + [other() for _ in range(20)]
    found = [[x["item"] for x in r] for r in decontaminate.find_leaks(docs, windows, windows.bitmap())]
    assert found == [[7]] * (size - decontaminate.SURE + 1) + [[]] * 20
    assert decontaminate.find_leaks([item], windows, windows.bitmap())[0][0]["stop"] == min(size, decontaminate.WINDOW)


def fewest_edits(pattern, text):
    """Edits of the pattern against its best substring, by the full table."""
    row = np.zeros(len(text) + 1, dtype=int)
    for i, c in enumerate(pattern, 1):
        step = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.concatenate([[i], step])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row.min())


@pytest.mark.parametrize("seed", range(4))
def test_filter_misses_nothing_that_full_alignment_finds(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    items = [(i, say(n)[:size].strip()) for i, (n, size) in enumerate([(60, 20), (60, 31), (60, 64), (60, 90), (80, 200), (90, 203), (120, 330)])]
    items.append((90, items[4][1]))  # equal items both match
    windows = decontaminate.prepare(items)
    assert all(windows.gram[k] == decontaminate.grams(decontaminate.normalise(items[windows.of[k]][1])[0])[windows.at[k]] for k in range(0, len(windows.gram), 37))

    def edited(text, n):
        chars = list(text)
        for _ in range(n):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], [rng.choice("abcdefgh ")], [chars[k], rng.choice("abcdefgh")]])
        return "".join(chars)

    docs = [say(40)]
    for _, body in items:
        docs += [f"{say(10)} {edited(body, n)} {say(10)}" for n in (0, 1, 2, 5, 9, 14)] + [f"{say(5)} {edited(body[len(body) // 3 :], 2)} {say(30)} {body[: len(body) // 2]}"]
    got = [[x["item"] for x in found] for found in decontaminate.find_leaks(docs, windows, windows.bitmap())]
    for text, found in zip(docs, got, strict=True):
        points = decontaminate.normalise(text)[0]
        want = {windows.item[w] for w, part in enumerate(windows.points) if fewest_edits(part, points) <= windows.budget[w]}
        assert set(found) == want


def test_blocks_of_a_benchmark_and_clashing_names(spark, monkeypatch):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))
    items = [(i, say(30)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{say(20)} {items[i][1]} {say(20)}" if i % 2 else say(50), "x", "y") for i in range(12)], "doc_id long, text string, item string, __leaks0 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: ([x["item"] for x in r.leaks], r.item, r["__leaks0"]) for r in decontaminate.mark(docs, bench).collect()}
    assert whole == {i: ([i] if i % 2 else [], "x", "y") for i in range(12)}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert {r.doc_id: ([x["item"] for x in r.leaks], r.item, r["__leaks0"]) for r in decontaminate.mark(docs, bench).collect()} == whole
    monkeypatch.setattr(decontaminate, "MOST_CHARS", 300)
    with pytest.raises(ValueError, match="at most"):
        decontaminate.mark(docs, bench)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 50, 400, 2500, 9000])))) for i in range(60)] + [(100, None), (101, ""), (105, "twice"), (105, "twice"), (102, "Ünïcode “quotes” don't 12 字 \x1c x" * 50)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), TOKENIZER).toPandas()
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in docs}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in got.itertuples())
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) * (2 if i == 105 else 1) for i, x in ids.items()}
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows.offset + rows.length).tolist()[:-1] == rows.offset.tolist()[1:] and rows.offset.iloc[0] == 0 and rows.length.sum() <= packing.WINDOW
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert got.sequence_id.nunique() * packing.WINDOW < 1.05 * got.length.sum() + packing.WINDOW  # little padding
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(256, dtype=np.int64)
    at, n = np.unique(rng.integers(1, 256, size=2000), return_counts=True)
    histogram[at] = n
    made = packing.plan(histogram, 256)
    used = made.loose.copy()
    for lengths, times in zip(made.windows, made.repeats, strict=True):
        assert sum(lengths) <= 256
        for x in lengths:
            used[x] += times
    assert (used == histogram).all()


def test_packing_by_join_and_by_broadcast_and_a_clashing_id(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([2500, 2600, 2700, 2800])))) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    few = {tuple(r) for r in packing.pack_documents(df, TOKENIZER, key="row_id").collect()}
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    again = packing.pack_documents(df, TOKENIZER, key="row_id")
    assert {tuple(r) for r in again.collect()} == few and again.columns[0] == "row_id"
    assert sum(r[2] for r in few) == sum({r[0]: r[4] for r in few}.values())


def test_most_windows_come_from_the_least_squares():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.minimum(rng.lognormal(6, 1, size=20000).astype(int) + 1, 4095), minlength=4096)
    made = packing.plan(histogram)
    left, exact = histogram.copy(), 0
    for lengths, times in zip(made.windows, made.repeats, strict=True):
        exact += times * (len(lengths) <= 3 and sum(lengths) == packing.WINDOW)
        for n in lengths:
            left[n] -= times
    assert (left == made.loose).all() and made.loose.sum() < 100
    short = sum(n * histogram[n] for n in range(4096)) / packing.WINDOW
    assert sum(made.repeats) <= short * 1.01 + 1 and exact > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, no rows, and a column of a clashing name through every stage."""
    import shutil

    import corpus_pipeline as c

    for name in ("documents", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    base = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(40)
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n ", "en", "s", 3), (903, "the that with from and " * 30_000, None, "s", 1), (904, "12 34", None, None, 5), (905, "the that with from and this is said of all", "en", "s", 1), (905, "the that with from and this is said of all", "en", "s", 1), (None, "the that with from and this is said of none", "en", "s", 2)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumn("component", F.lit(1)).withColumn("leaks", F.lit(2))
    ids = {r.doc_id for r in base.collect()} | {903, 905, None}
    for rows, want in ((docs, True), (docs.where("false"), False)):
        for name, stage in c.STAGES:
            rows = c.save(stage(spark, rows, str(tmp_path)), name)
            if name != "packing":
                assert set(c.COLUMNS) <= set(rows.columns)
            if name == "language_id":
                kept = {r.doc_id for r in rows.collect()}
                assert (kept == ids) if want else not kept
        got = {r.doc_id for r in rows.select("doc_id").collect()}
        assert ({903, 905, None} <= got <= ids) if want else not got


def test_every_registered_query_of_this_part(spark):
    """The registered queries themselves, on the smallest tables: contracts' columns and one row a document, page, vector or piece."""
    import __spark_entry__
    from daybook.llm import registry

    sf = "/root/testdata/sf0.001"
    size = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    want = {
        "op2_ngram_join": ("documents", ["doc_id", "n_shingles", "component_id"]), "op4_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted", "spans"]), "op6_html_text": ("pages", ["page_id", "url", "text", "n_chars"]),
        "op7_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score"]), "op8_embedding_dedup": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]), "op9_warc": ("pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
        "op10_quality": ("documents", ["doc_id", "held_out", "score", "predicted"]), "op1_line_dedup": ("documents", ["doc_id", "text"]),
    }
    queries = __spark_entry__.queries()
    assert set(registry.QUERIES) | {"pipeline"} <= set(queries)
    rows = {}
    for name, (table, columns) in want.items():
        out = queries[name](spark, sf)
        assert set(columns) <= set(out.columns)
        rows[name] = out.collect()
        assert len(rows[name]) == size[table]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows["op2_ngram_join"]} == brute_components(docs)
    assert queries["op5_decontaminate"](spark, sf).columns[:2] == ["doc_id", "item_id"]
    pieces = queries["op3_packing"](spark, sf).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == pieces.groupby("doc_id").doc_tokens.first().to_dict() and len(pieces.doc_id.unique()) == size["documents"]


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    one = c.language(spark, docs, sf)
    assert one.columns == docs.columns and one.count() == len(text)
    two = c.save(c.lines(spark, one, sf), "two")
    left = {r.doc_id: r.text for r in two.collect()}
    gone = brute_lines([(d, text[d].split("\n")) for d in sorted(text)], line_dedup.MIN_WORDS)
    want = {d: [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone] for d, t in text.items()}
    assert left == {d: "\n".join(x) for d, x in want.items() if x}
    three = c.save(c.near_duplicates(spark, two, sf), "three")
    assert {r.doc_id for r in three.collect()} == {d for d, (_, root) in brute_components(sorted(left.items())).items() if d == root}
    four = c.save(c.benchmarks(spark, three, sf), "four")
    squeeze = lambda s: " ".join("".join(x if x.isalnum() else " " for x in s.lower()).split())
    items = [squeeze(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect() if not any(i in squeeze(r.text) for i in items)}
    five = c.sequences(spark, four, sf)
    assert {r.doc_id for r in five.select("doc_id").collect()} == {r.doc_id for r in four.collect()}
