"""WARC archives: writing, reading back, and a capture index merged from sorted runs.

Archives are WARC/1.1 files written by Spark's text writer with an end of two line breaks after each record, so they go to whatever
store Spark writes to. A record's block is an HTTP header and the payload. Records that repeat a payload become
``revisit`` records with the header alone and refer to the response.

The index is built by an external merge: each archive gives one run of captures, sorted by URL key and time; ranges of
(URL key, time, page) are dealt over the cluster by the shuffle, which is the merge's external storage, and in each range a loser tree merges the runs, ``FAN`` at a time in as many passes as that takes. Ranges
cut through hosts and URLs, so a host with a third of all pages is spread over many of them, and there are so many that a range holds about ``RANGE_ROWS`` captures whatever the corpus.

A capture's time is that of the column ``captured``, or ``started`` for all where the pages have none. Ids are integers of any size; other ids raise.
Archives are bounded by bytes: records are written in classes of size, each with its own number of records a file, so no file is larger than ``ARCHIVE_BYTES`` unless one record is.

Null html is an empty payload, a null url an empty key; payloads below ``least`` bytes are never revisits. Rows that share the smallest page id of a payload are all
responses. Null page ids are kept, as responses when nothing smaller has the payload. Columns beside the id, url and html are ignored. An empty table gives no archive and no row.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from daybook.operators.durable import save, shared_dir
from daybook.operators.skew import lookup

BREAK = "\r\n"
#: Records and bytes in one archive file, at most; it is read into a worker's memory whole. Each class of sizes holds payloads ``CLASS`` times as large as the one before.
ARCHIVE_RECORDS, ARCHIVE_BYTES, CLASS = 5_000, 128 << 20, 16
#: Runs that one tree merges, and captures of a range, about.
FAN, RANGE_ROWS = 256, 200_000
#: What a record takes beside its payload and its URL, about.
HEAD_BYTES = 2_000


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, captured: str | None = None) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, captured, refers_to`` with null ``refers_to`` for responses and null ``captured`` without such a column."""
    if not isinstance(pages.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} isn't an integer column")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(F.encode(body, "UTF-8"), 256).alias("payload_digest"), (F.col(captured) if captured else F.lit(None)).cast("timestamp").alias("captured"))
    counts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = save(counts.where("n > 1"), "payloads")
    total = pages.count()
    found = lookup(rows, repeated, "payload_digest", "n", total, ["first"], ["page_id", "url", "payload_bytes"])
    return found.select(*rows.columns, F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _record(rows: DataFrame, started: str) -> DataFrame:
    """One string a record, without the two breaks that end it."""
    revisit = F.col("refers_to").isNotNull()
    taken = F.date_format(F.coalesce("captured", F.lit(started).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK + BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{BREAK}WARC-Record-ID: <urn:x-page:"), identity, F.lit(f">{BREAK}WARC-Date: "), taken,
        F.lit(f"{BREAK}WARC-Target-URI: "), link, F.lit(f"{BREAK}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{BREAK}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{BREAK}WARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{BREAK}Content-Type: application/http; msgtype=response{BREAK}Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK + BREAK), block,
    )
    return rows.select(head.alias("value"))


def size_class(payload_bytes) -> F.Column:
    """0 for records of which ``ARCHIVE_RECORDS`` fit into a file, then one more for each ``CLASS`` times the size."""
    at = F.lit(0)
    for k in range(len(_records_by_class()) - 1):
        at = at + (payload_bytes > ARCHIVE_BYTES // ARCHIVE_RECORDS * CLASS**k - HEAD_BYTES).cast("int")
    return at


def _records_by_class() -> list[int]:
    """Records in a file of each class; one in the last."""
    out = [ARCHIVE_RECORDS]
    while out[-1] > 1:
        out.append(max(1, out[-1] // CLASS))
    return out


def write_archives(records: DataFrame, path: str, started: str = "2024-01-01 00:00:00", sizes: DataFrame | None = None) -> None:
    """WARC files under ``path``, a folder a class of sizes. ``sizes`` may give the column ``payload_bytes`` where it is cheaper to read than from the records."""
    classed = records.withColumn("class", size_class(F.col("payload_bytes")))
    present = sorted(r["class"] for r in (sizes or records).select(size_class(F.col("payload_bytes")).alias("class")).distinct().collect())  # at most five
    for k in present:
        own = classed.where(F.col("class") == k) if len(present) > 1 else classed
        _record(own, started).write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", _records_by_class()[k]).text(f"{path}/class-{k}")


_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_PAGE = re.compile(rb"<urn:x-page:(-?\d+)>")


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """``(offset, length, headers, block)`` of every record of an archive, by Content-Length. A cut or foreign record raises."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        stop = data.find(b"\r\n\r\n", at)
        headers = {m[1].lower(): m[2] for m in _LINE.finditer(data, data.find(b"\r\n", at) + 2, stop + 2)} if stop >= 0 else {}
        begin = stop + 4
        end = begin + int(headers[b"content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it should")
        yield at, end + 4 - at, headers, data[begin:end]
        at = end + 4


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query in lower case, without scheme, leading www, port, fragment or last slash."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).partition("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].partition(":")[0])
    return ",".join(reversed(host.split("."))) + ")/" + (path.rstrip("/") if slash else "")


INDEX = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in INDEX.split(", ")])


def _capture(name: str, at: int, length: int, headers: dict[bytes, bytes], block: bytes) -> tuple:
    import hashlib

    page, refers = _PAGE.search(headers[b"warc-record-id"]), _PAGE.search(headers.get(b"warc-refers-to", b""))
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers[b"warc-type"].decode()
    digest = headers[b"warc-payload-digest"].partition(b":")[2].decode()
    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {page and page[1]} in {name} isn't what its header says")
    return (url_key(headers.get(b"warc-target-uri", b"").decode("utf-8", "replace")), headers[b"warc-date"].decode(), int(page[1]) if page else None, kind, int(refers[1]) if refers else None, size, digest, name, at, length)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures for each archive under ``path``. Payload digests are computed anew from what was read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = sorted((_capture(name, *record) for record in read_records(data.as_py())), key=_order)
                for lo in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 5000], strict=True), _ARROW, strict=True)], schema=_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, INDEX)


class LoserTree:
    """Tournament tree over ``k`` cursors: each inner node keeps the loser of its match, the root the overall winner; replacing the winner plays one path of matches."""

    def __init__(self, cursors: list[Iterator]):
        self.k = max(1, len(cursors))
        self.cursors = cursors
        self.heads = [next(c, None) for c in cursors] or [None]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            at = self.winner
            self.heads[at] = next(self.cursors[at], None)
            node = (at + self.k) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _rows(blocks: list[bytes]) -> Iterator[tuple]:
    """Captures of a run with their order, a block at a time."""
    for block in blocks:
        for row in pickle.loads(block):
            yield _order(row), row


def _packed(rows: Iterator[tuple], block: int) -> list[bytes]:
    out, held = [], []
    for row in rows:
        held.append(row)
        if len(held) == block:
            out.append(pickle.dumps(held, pickle.HIGHEST_PROTOCOL))
            held = []
    return [*out, pickle.dumps(held, pickle.HIGHEST_PROTOCOL)] if held else out


def merge_sorted(rows: Iterator[tuple], run_of, block: int = 256, fan: int = FAN) -> Iterator[tuple]:
    """Sorted rows from rows that come run by run, each run sorted. Runs are kept packed; while there are more than ``fan``, passes merge ``fan`` neighbours each into longer ones."""
    runs = [_packed(run, block) for _, run in groupby(rows, run_of)]
    while len(runs) > fan:
        runs = [_packed(iter(LoserTree([_rows(r) for r in runs[lo : lo + fan]])), block) for lo in range(0, len(runs), fan)]
    yield from LoserTree([_rows(r) for r in runs])


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures of all runs in the order of (URL key, time, page), ascending within and across partitions."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in _COLUMNS), strict=True))
        out: list[tuple] = []
        for row in merge_sorted(rows, lambda r: r[7]):
            out.append(row)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    n = ranges or max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    order = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "offset"]
    dealt = runs.repartitionByRange(n, *order).sortWithinPartitions("archive", *order[:3], "offset")
    return dealt.select(*_COLUMNS).mapInArrow(merge, INDEX)


def archive_and_index(pages: DataFrame, path: str | None = None, captured: str | None = None) -> DataFrame:
    """Write archives of ``pages``, read them back and return the merged capture index."""
    import uuid

    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages, captured=captured), path, sizes=pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("payload_bytes")))
    if not any_file(spark, path):
        return spark.createDataFrame([], INDEX)
    return merge_runs(save(read_runs(spark, path), "runs"))


def any_file(spark: SparkSession, path: str) -> bool:
    """Whether something was written: an empty table has no archive."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def oracle(source: str = "pages", least: int = 100) -> str:
    """DuckDB SQL for ``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a table with distinct ids."""
    return f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {source}),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {least} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""
