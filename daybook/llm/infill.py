"""Fill-in-middle: a text is cut at two ranks of its units, and its middle goes to the end behind marks.

A unit is a run of ASCII letters or any one other code point. The matcher is lazy and reads a text twice: the first pass only counts its units, the second advances one
iterator of matches to both ranks and keeps the two places it reached. No array of units exists at any time, so beside the text a row needs constant memory.

The ranks come from a digest of the id, which Spark's own functions compute; hence a repeated task cuts alike, whatever order rows come in. ``restored`` gives the text back from
output and form alone: a text that holds one of the marks stays plain, so each mark of an output occurs exactly once.

Null and empty texts are plain and of no unit; a null id draws as the empty string. Equal ids draw alike, so repeated rows give repeated results. An empty table gives none. Columns
beside id and text are ignored; the id may have any type that casts to text, and any name but those of the result's other columns.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import text_steps

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
#: Of a hundred documents, from which on they stay plain, and below which the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20


def count_units(text: str) -> int:
    """First pass: how many units there are."""
    counter = itertools.count()
    deque(zip(UNIT.finditer(text), counter), maxlen=0)
    return next(counter)


def places(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where ``first`` and ``second >= first`` units end."""
    matches = UNIT.finditer(text)

    def behind(more: int, at: int) -> int:
        return next(itertools.islice(matches, more - 1, None)).end() if more else at

    low = behind(first, 0)
    return low, behind(second - first, low)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``<key>, n, form, prefix_chars, middle_chars, output``: number of units, ``plain``, ``psm`` or ``spm``, code points of prefix and middle (null where plain), and the text in that form."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low, high, keep, turn = draws(F.col(key), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(body, F.lit(mark))
    form = F.when((body == "") | marked | (keep % 100 >= plain_from), "plain").when(turn % 100 < suffix_first, "spm").otherwise("psm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "__text"):
            counts, prefixes, middles, outputs = [], [], [], []
            for text, form, one, two in zip(*(batch.column(c).to_pylist() for c in ("__text", "__form", "__one", "__two")), strict=True):
                n = count_units(text)
                counts.append(n)
                if form == "plain":
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                one, two = sorted((one % (n + 1), two % (n + 1)))
                i, j = places(text, one, two)
                prefixes.append(i)
                middles.append(j - i)
                outputs.append(PREFIX + text[:i] + SUFFIX + text[j:] + MIDDLE + text[i:j] if form == "psm" else SUFFIX + text[j:] + PREFIX + text[:i] + MIDDLE + text[i:j])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pa.array(counts, pa.int64()), batch.column("__form"), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                names=["__key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(key).alias("__key"), body.alias("__text"), form.alias("__form"), low.alias("__one"), high.alias("__two"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("__key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""

    def parts(head: str, inner: str) -> tuple[Column, Column, Column]:
        """What stands behind ``head`` at the beginning, behind ``inner``, and behind the middle's mark."""
        i, m = F.instr(output, inner), F.instr(output, MIDDLE)
        begin, stop = len(head) + 1, i + len(inner)
        return F.substring(output, F.lit(begin), i - begin), F.substring(output, stop, m - stop), F.substring(output, m + len(MIDDLE), F.length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_, middle_, suffix_))


def oracle() -> str:
    """DuckDB SQL for ``op11_fill_in_middle``: units as lists."""
    h = [f"CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    marked = " OR ".join(f"contains(body, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    cut = lambda lo, hi: f"array_to_string(units[{lo}:{hi}], '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
f AS (SELECT *, CAST(len(units) AS BIGINT) AS n, {h[0]} AS a, {h[1]} AS b, CASE WHEN body = '' OR {marked} OR {h[2]} % 100 >= {PLAIN_FROM} THEN 'plain' WHEN {h[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(a % (n + 1), b % (n + 1)) AS lo, greatest(a % (n + 1), b % (n + 1)) AS hi FROM f),
p AS (SELECT doc_id, body, n, form, {cut(1, "lo")} AS prefix, {cut("lo + 1", "hi")} AS middle, {cut("hi + 1", "n")} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(body) AS restored_sha256 FROM p"""
