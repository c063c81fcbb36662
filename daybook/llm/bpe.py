"""BPE encoding by speculation and verification, and decoding.

Text is cut into words as the tokenizer file says. The words of a batch that haven't been seen before are encoded together, as one long array of symbols:

1. *Propose.* The longest vocabulary entry that begins at each symbol is found by walking a trie from all symbols at once; following those lengths from the first symbol on gives each
   word's greedy tokens.
2. *Verify.* A sequence of tokens is what merging by rank gives exactly if no merge would ever have joined across a border between two neighbours. All adjacent pairs are tested at once: both
   tokens are taken apart along the border in the reverse order of their merges, and a merge of the two pieces that stand there which comes before either of them grows on refutes the pair.
3. *Merge.* Only words with a refuted pair are merged exactly, by rank and place.

Tokens that merging would not give for their own text are never proposed. Where merges don't come after the merges that make their parts, step 2 would not be conclusive and every word is merged exactly.

Null and empty texts have no id. Repeated rows give repeated results, an empty table none. Columns beside id and text are ignored; the id may have any name but those of the result's other
columns. A text is held whole by the task that encodes it; what a worker remembers of words is bounded (``REMEMBERED``, ``REMEMBERED_IDS``).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.packing import _LETTERS
from daybook.llm.text import kept, text_steps

#: Distinct words, and ids of them, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_IDS = 500_000, 8_000_000
#: Symbols of an alphabet: 256 bytes, and 256 that end a word.
SYMBOLS = 512
#: Words up to this many symbols are merged many at once.
SHORT = 32
_LAST, _NEVER = 1 << 30, 1 << 31
#: Stretches whose words need no table of characters: visible ASCII, and Latin letters that have one lower case and no other form.
_PLAIN = f"^[\\x21-\\x7e{_LETTERS}]*$"
#: Letters are 1, digits 2, marks 3; bytes beyond ASCII are parts of letters.
_KIND = np.where(np.arange(256) >= 128, 1, 3).astype(np.uint8)
_KIND[97:123], _KIND[48:58] = 1, 2
# Endings behind an apostrophe that are words with it, of one letter and of two.
_ENDINGS_1 = np.frombuffer(b"stmd", dtype=np.uint8)
_ENDINGS_2 = np.array([int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabularies of bytes: itself where it shows, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a BPE model over symbols; ``words`` takes many words as one array."""

    def __init__(self, vocabulary: dict[tuple[int, ...], int], merges: list[tuple[int, int, int]]):
        """``vocabulary`` gives the id of a sequence of symbols; ``merges`` are left, right and joined id by rank."""
        n = max(vocabulary.values(), default=0) + 1
        self.size = n
        self.rank, self.left, self.right = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        table = np.array(merges, dtype=np.int64).reshape(-1, 3)
        ranks = np.arange(len(table))
        self.rank[table[:, 2]], self.left[table[:, 2]], self.right[table[:, 2]] = ranks, table[:, 0], table[:, 1]
        keys = table[:, 0] * n + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.joined = table[:, 2]
        self.pairs = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(table)}
        self.ordered = bool(np.all(self.rank[table[:, 0]] < ranks) and np.all(self.rank[table[:, 1]] < ranks)) and len({c for _, _, c in merges}) == len(merges)
        self.symbol = np.full(SYMBOLS, -1)
        self.symbol[[s[0] for s in vocabulary if len(s) == 1]] = [i for s, i in vocabulary.items() if len(s) == 1]
        self._trie(vocabulary, self._own(table))

    def _own(self, table: np.ndarray) -> np.ndarray:
        """Ids that merging gives for their own symbols."""
        own = self.rank < 0
        made = table[self.compatible(table[:, 0], table[:, 1], np.arange(len(table)))]
        for a, b, c in made.tolist():  # parts come before what is made of them
            own[c] = own[a] and own[b]
        return own

    def _trie(self, vocabulary: dict[tuple[int, ...], int], own: np.ndarray) -> None:
        """Nodes of all beginnings of entries, as sorted keys ``node * SYMBOLS + symbol``."""
        children: dict[int, int] = {}
        ids = [-1]
        for symbols, token in vocabulary.items():
            if own[token]:
                node = 0
                for s in symbols:
                    node = children.setdefault(node * SYMBOLS + s, len(ids))
                    if node == len(ids):
                        ids.append(-1)
                ids[node] = token
        keys = np.fromiter(children, dtype=np.int64, count=len(children))
        order = np.argsort(keys)
        self.trie_keys = keys[order]
        self.trie_nodes = np.fromiter(children.values(), dtype=np.int64, count=len(children))[order]
        self.trie_ids = np.array(ids, dtype=np.int64)

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and length of the longest entry that begins at each symbol. An entry with a symbol that ends a word has it last, so none reaches into the next word."""
        found, lengths = self.symbol[symbols], np.ones(len(symbols), dtype=np.int64)
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), dtype=np.int64), 0
        while len(at):
            key = node * SYMBOLS + symbols[at + depth]
            place = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            hit = self.trie_keys[place] == key
            at, node, depth = at[hit], self.trie_nodes[place[hit]], depth + 1
            token = self.trie_ids[node]
            entry = token >= 0
            found[at[entry]], lengths[at[entry]] = token[entry], depth
            more = at + depth < len(symbols)
            at, node = at[more], node[more]
        return found, lengths

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``_NEVER`` where there is none."""
        if not len(self.pair_keys):
            return np.full(len(a), _NEVER)
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place], _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the border between each pair alone, at all or until the rank ``before``.

        Going back in time, the pieces at the border are the last part of the left token and the first part of the right one. A merge of two pieces happens if it comes before the merge that
        takes the left one away, and not after the one that takes the right one away: equal merges go from left to right."""
        x, y = left.astype(np.int64), right.astype(np.int64)
        until_x = np.full(len(x), _LAST) if before is None else before.astype(np.int64)
        until_y = until_x - (before is not None)
        good, live = np.ones(len(x), dtype=bool), np.arange(len(x))
        while len(live):
            merge = self._ranks(x[live], y[live])
            crossed = (merge < until_x[live]) & (merge <= until_y[live])
            good[live[crossed]] = False
            live = live[~crossed]
            made_x, made_y = self.rank[x[live]], self.rank[y[live]]
            more = (made_x >= 0) | (made_y >= 0)
            live, made_x, made_y = live[more], made_x[more], made_y[more]
            later = made_y >= made_x  # of equal merges the right one came later
            a, b = live[~later], live[later]
            until_x[a], until_y[b] = made_x[~later], made_y[later]
            x[a], y[b] = self.right[x[a]], self.left[y[b]]
        return good

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word by rank and place, with a heap over a linked list."""
        ids = [int(self.symbol[s]) for s in symbols]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (p := self.pairs.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has grown since
            ids[i], ids[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (p := self.pairs.get((ids[k], ids[m]))):
                    heapq.heappush(heap, (p[0], k, ids[k], ids[m]))
        return [i for i in ids if i >= 0]

    def _merge_short(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: each round makes the next merge of every word. Ids one behind another, and how many each word has."""
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        grid = np.full((len(sizes), width + 1), -1)
        grid[:, :-1][inside] = self.symbol[symbols[np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]]
        ranks = np.full((len(sizes), width + 1), _NEVER)
        pair = inside[:, 1:].nonzero()
        ranks[pair] = self._ranks(grid[pair], grid[pair[0], pair[1] + 1])
        live = np.arange(len(sizes))
        columns = np.arange(width)
        while True:
            at = ranks[live].argmin(axis=1)
            low = ranks[live, at]
            live, at, low = live[low < _NEVER], at[low < _NEVER], low[low < _NEVER]
            if not len(live):
                return grid[grid >= 0], (grid >= 0).sum(axis=1)
            moved = columns + (columns > at[:, None])
            grid[live, :-1] = np.take_along_axis(grid[live], moved, axis=1)
            ranks[live, :-1] = np.take_along_axis(ranks[live], moved, axis=1)
            grid[live, at] = self.joined[low]
            for k in (at - 1, at):
                some = (k >= 0) & (k + 1 < width)
                r, c = live[some], k[some]
                both = grid[r, c + 1] >= 0
                ranks[r, c] = _NEVER
                ranks[r[both], c[both]] = self._ranks(grid[r[both], c[both]], grid[r[both], c[both] + 1])

    def exact(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words: short ones together, long ones one by one with a heap."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= SHORT]
        for i in range(0, len(short), 20_000):  # of about equal lengths
            some = short[i : i + 20_000]
            flat, counts = self._merge_short(symbols, begins[some], sizes[some])
            for w, ids in zip(some.tolist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                out[w] = ids
        for w in order[len(short) :].tolist():
            out[w] = np.array(self.merge(symbols[begins[w] : begins[w] + sizes[w]].tolist()), dtype=np.int64)
        return np.concatenate([np.zeros(0, np.int64), *out]), np.array([len(x) for x in out], dtype=np.int64)

    def words(self, symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind another, and how many each has; ``stops`` says where each word ends in ``symbols``. No word is empty."""
        begins = np.concatenate(([0], stops[:-1])).astype(np.int64)
        if not self.ordered or not len(stops):
            return self.exact(symbols, begins[: len(stops)], stops - begins[: len(stops)])
        found, lengths = self.longest(symbols)
        steps, at, n = lengths.tolist(), 0, len(symbols)
        chosen = []
        while at < n:
            chosen.append(at)
            at += steps[at]
        chosen = np.array(chosen, dtype=np.int64)
        ids, word = found[chosen], np.searchsorted(stops, chosen, side="right")
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        bad = np.unique(word[inner[~self.compatible(pairs // self.size, pairs % self.size)[which]]])
        sizes = np.bincount(word, minlength=len(stops))
        if not len(bad):
            return ids, sizes
        where = np.cumsum(sizes) - sizes
        merged, sizes[bad] = self.exact(symbols, begins[bad], stops[bad] - begins[bad])
        where[bad] = len(ids) + np.cumsum(sizes[bad]) - sizes[bad]
        return _stretches(np.concatenate([ids, merged]), where, sizes)[0], sizes


class Codec:
    """A tokenizer file whose words end at white space, as ids and back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)  # for its rules of words beyond ASCII only
        shown = byte_characters()
        self.byte_of = {ord(c): b for b, c in enumerate(shown)}
        end = model["end_of_word_suffix"]
        symbols = {w: self._symbols(w, end) for w in model["vocab"]}
        vocabulary = {s: model["vocab"][w] for w, s in symbols.items() if s}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(vocabulary, [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs])
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        names = [""] * (max([*model["vocab"].values(), *special.values()]) + 1)
        for name, i in [*model["vocab"].items(), *special.items()]:
            names[i] = name
        self.names = pa.array(names, pa.string())
        self._forget()

    def _symbols(self, entry: str, end: str) -> tuple[int, ...]:
        last = entry.endswith(end) and entry != end
        out = [self.byte_of[ord(c)] for c in (entry[: -len(end)] if last else entry)]
        return (*out[:-1], out[-1] + 256) if last else tuple(out)

    def _forget(self) -> None:
        self.known: dict[bytes | int, int] = {i: n for n, i in enumerate(self.special.values())}  # word, or a special token's id, to its place
        self.flat, self.begin = np.array([*self.special.values()], dtype=np.uint32), np.arange(len(self.special) + 1)

    def _words(self, stretch: str) -> list[bytes | int]:
        """Words of any stretch as bytes, special tokens as ids, by the library's own rules."""
        if self.marks and self.marks.search(stretch):
            return [w for part in self.marks.split(stretch) for w in ([self.special[part]] if part in self.special else self._words(part))]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in found]

    def _places(self, words: list[bytes | int]) -> np.ndarray:
        """Where the ids of each of ``words`` are remembered; new ones are encoded together."""
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            stops = np.cumsum([len(w) for w in new], dtype=np.int64)
            symbols = np.frombuffer(b"".join(new), dtype=np.uint8).astype(np.int64)
            symbols[stops - 1] += 256
            ids, sizes = self.merges.words(symbols, stops)
            self.known.update(zip(new, range(len(self.begin) - 1, len(self.begin) - 1 + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def _split(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of each of ``stretches`` one behind another, and how many words each has."""
        plain = pc.match_substring_regex(stretches, _PLAIN)
        for name in self.special:
            plain = pc.and_not(plain, pc.match_substring(stretches, name))
        words, sizes = plain_words(pc.utf8_lower(stretches.filter(plain)))
        told = words.dictionary_encode()
        others = [self._words(s) for s in stretches.filter(pc.invert(plain)).to_pylist()]
        names = told.dictionary.to_pylist()
        places = self._places(names + [w for x in others for w in x])
        flat = np.concatenate([places[: len(names)][told.indices.to_numpy()] if len(names) else places[:0], places[len(names) :]])
        counts = np.concatenate([sizes, np.array([len(x) for x in others], dtype=np.int64)])
        is_plain = plain.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        where, some = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        where[order], some[order] = np.cumsum(counts) - counts, counts
        return _stretches(flat, where, some)[0], some

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind another, and where each text's end; there are no nulls."""
        if len(self.known) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self._forget()
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        counts = np.diff(split.offsets.to_numpy())
        told = split.flatten().dictionary_encode()
        places, some = self._split(told.dictionary)
        flat, ends = _stretches(self.flat, self.begin[places], self.begin[places + 1] - self.begin[places])
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(some)))]  # of the ids of each distinct stretch
        at = told.indices.to_numpy()
        flat, ends = _stretches(flat, edges[at], edges[at + 1] - edges[at])
        return flat, np.concatenate(([0], ends))[np.cumsum(counts)]

    def decode(self, flat: np.ndarray, stops: np.ndarray) -> pa.Array:
        """Texts of ids one behind another: the vocabulary's entries with a space between, as the library has it for a file without decoder."""
        offsets = pa.array(np.concatenate(([0], stops)).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(flat.astype(np.int64)))), " ")


def _stretches(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` from ``begin`` on of ``sizes``, one behind another, and where each ends."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)], ends


def plain_words(stretches: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of stretches of lower-case Latin letters, digits and marks, as the tokenizer file cuts them, and how many each stretch has: letters together, each digit, marks together, and the seven endings behind an apostrophe."""
    offsets = np.frombuffer(stretches.buffers()[1], dtype=np.int32)[stretches.offset : stretches.offset + len(stretches) + 1].astype(np.int64) if len(stretches) else np.zeros(1, np.int64)
    data = np.frombuffer(stretches.buffers()[2], dtype=np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    kind = _KIND[data]
    first = np.zeros(len(data) + 3, dtype=bool)  # of a stretch
    first[offsets] = True
    start = first.copy()
    start[1 : len(data)] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    ahead = np.concatenate([data, np.zeros(3, np.uint8)])
    mark = np.flatnonzero((data == 39) & start[: len(data)])
    one, two = ahead[mark + 1], ahead[mark + 2]
    short = mark[~first[mark + 1] & np.isin(one, _ENDINGS_1)]
    long = mark[~first[mark + 1] & ~first[mark + 2] & np.isin(one.astype(np.int64) * 256 + two, _ENDINGS_2)]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    starts = np.flatnonzero(start[: len(data)])
    edges = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())])
    return words, np.diff(np.searchsorted(starts, offsets))


def _packed(flat: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Little-endian 32-bit ids of each text as binary."""
    offsets = np.concatenate(([0], 4 * stops)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``<key>, n_tokens, ids``, the ids as little-endian 32-bit numbers; with ``decoded`` also the text that ``decode`` gives for them, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"codec {tokenizer_path}"
        codec = kept(name, lambda: Codec(tokenizer_path))
        for batch in text_steps(batches, "__text", keep=name):
            flat, stops = codec.encode(pc.fill_null(batch.column("__text"), ""))
            packed = _packed(flat, stops)
            columns = [batch.column("__key"), pa.array(np.diff(stops, prepend=0)), packed]
            if decoded:
                columns.append(codec.decode(*_unpacked(packed)))
            yield pa.RecordBatch.from_arrays(columns, names=["__key", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, n_tokens long, ids binary" + (", decoded string" if decoded else "")).withColumnRenamed("__key", key)


def _unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(x for x in ids.to_pylist() if x), dtype="<u4"), np.cumsum(sizes) // 4


def decode(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``<key>, decoded``: the text of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"codec {tokenizer_path}"
        codec = kept(name, lambda: Codec(tokenizer_path))
        for batch in text_steps(batches, "__ids", keep=name):
            yield pa.RecordBatch.from_arrays([batch.column("__key"), codec.decode(*_unpacked(batch.column("__ids")))], names=["__key", "decoded"])

    rows = encoded.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, decoded string").withColumnRenamed("__key", key)
