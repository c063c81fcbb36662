"""Submission of URLs to archive services as a sink: ``df.write.format("archive_submission")``.

Rows are ``url`` and, where a service already has it, what it gave (columns named as in ``archive.SERVICES``): only what is missing is sent. Each task keeps to ``rate`` requests a second and host and waits longer after each
refusal. Its results go to a file of its own aside; when all tasks have ended they become the result, with one rename, and are nothing when the job fails. A task that is run again sends its URLs again, which the services allow.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from daybook.operators.archive import SERVICES, due, exit_code, merge
from daybook.sources.retry import ask

# Statuses that are tried again.
RETRIED = (429, 500, 502, 503, 504)
RESULT = f"url string, {', '.join(f'{s} string' for s in SERVICES)}, at timestamp"


class Pace:
    """At most ``rate`` requests a second to each host."""

    def __init__(self, rate: float):
        self.gap, self.next = (1 / rate if rate > 0 else 0.0), {}

    def wait(self, host: str) -> None:
        now = time.monotonic()
        at = max(now, self.next.get(host, now))
        self.next[host] = at + self.gap
        time.sleep(at - now)


def location(answer, url: str) -> str:
    """Where the answer says that the copy is: its Content-Location or Location, relative to where the answer came from, a link after a refresh, else where redirects led."""
    came_from = answer.geturl()
    for name in ("Content-Location", "Location"):
        if answer.headers.get(name):
            return urllib.parse.urljoin(came_from, answer.headers[name])
    refresh = answer.headers.get("Refresh", "")
    return urllib.parse.urljoin(came_from, refresh.split("url=", 1)[1].strip()) if "url=" in refresh else came_from


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.endpoints = {s: options[s] for s in SERVICES if s in options}
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.rate, self.tries, self.pause = float(options.get("rate", 1)), int(options.get("tries", 3)), float(options.get("wait", 5))

    def _send(self, service: str, url: str, pace: Pace) -> str | None:
        endpoint = self.endpoints[service]
        pace.wait(urllib.parse.urlsplit(endpoint).netloc)
        request = urllib.request.Request(endpoint, data=urllib.parse.urlencode({"url": url}).encode(), method="POST")
        return ask(request, RETRIED, self.tries, self.pause, read=lambda answer: location(answer, url))

    def write(self, rows: Iterator[Row]) -> Written:
        pace, name, n = Pace(self.rate), uuid.uuid4().hex, 0
        folder = Path(self.path) / f".aside-{self.run}"
        folder.mkdir(parents=True, exist_ok=True)
        with open(folder / f"{name}.json", "w", encoding="utf-8") as out:
            for row in rows:
                held = row.asDict()
                told = {s: held.get(s) or self._send(s, row.url, pace) for s in self.endpoints}
                out.write(json.dumps({"url": row.url, **told, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}) + "\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        """Only files of tasks that counted stay: a task that ran twice leaves one result."""
        folder = Path(self.path) / f".aside-{self.run}"
        folder.mkdir(parents=True, exist_ok=True)
        good = {f"{m.name}.json" for m in messages if m is not None}
        for file in folder.iterdir():
            if file.name not in good:
                file.unlink()
        folder.rename(Path(self.path) / f"run-{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        folder = Path(self.path) / f".aside-{self.run}"
        for file in folder.iterdir() if folder.exists() else ():
            file.unlink()
        if folder.exists():
            folder.rmdir()


class Submission(DataSource):
    """Options: ``path`` (a folder that driver and executors share), an endpoint for each service, ``rate``, ``tries`` and ``wait``."""

    @classmethod
    def name(cls) -> str:
        return "archive_submission"

    def schema(self) -> str:
        return "url string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def submit(urls: DataFrame, registry: DataFrame, folder: str, endpoints: dict[str, str], now, days: int = 30, parts: int = 2, **options: str) -> tuple[DataFrame, int]:
    """The registry after all URLs that are due have been sent to the services that lack them, and the exit mask: 0 where all went well, bit 1 and bit 2 for the services that failed. ``parts`` tasks send at a time."""
    spark: SparkSession = urls.sparkSession
    spark.dataSource.register(Submission)
    wanted = due(urls, registry, now, days).join(registry.select("url", *SERVICES, F.col("at").alias("__at")), "url", "left")
    stale = F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp("__at")) / 86400) > days, F.lit(False))
    rows = wanted.select("url", *(F.when(~stale, F.nullif(F.col(s), F.lit(""))).alias(s) for s in SERVICES)).repartition(parts, "url")
    run = f"{folder.rstrip('/')}/submission-{uuid.uuid4().hex}"
    writer = rows.write.format("archive_submission").option("path", run)
    for name, value in {**endpoints, **options}.items():
        writer = writer.option(name, value)
    writer.mode("append").save()
    results = spark.read.schema(RESULT).json(f"{run}/run-*")
    return merge(registry, results), exit_code(results).first().exit_code
