"""Where pages come from: mappings, files, dumps and a wiki's API.

A page table has title, wikitext (null if there is no such page), found and
fetched_at. Absent and empty are different things; a fetch that failed is
neither, and has no row.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "title string, wikitext string, found boolean, fetched_at timestamp"
# The API's codes for a page that isn't there.
ABSENT = frozenset({"missingtitle", "invalidtitle", "nosuchsection"})


def from_dict(spark: SparkSession, pages: dict[str, str | None]) -> DataFrame:
    rows = [(t, w, w is not None) for t, w in pages.items()]
    return spark.createDataFrame(rows, "title string, wikitext string, found boolean").withColumn("fetched_at", F.current_timestamp())


def from_files(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Parquet, ORC, JSON or CSV with title and wikitext, and the other columns where they exist."""
    df = spark.read.format(kind).options(**options).load(path)
    found = F.col("found").cast("boolean") if "found" in df.columns else F.col("wikitext").isNotNull()
    at = F.col("fetched_at").cast("timestamp") if "fetched_at" in df.columns else F.current_timestamp()
    return df.select("title", "wikitext", found.alias("found"), at.alias("fetched_at"))


def from_dump(spark: SparkSession, path: str) -> DataFrame:
    """A wiki's XML export; redirects take the text of their target's page, where the dump has it."""
    schema = "title string, ns int, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    flat = raw.select("title", F.col("redirect._title").alias("target"), F.coalesce(F.col("revision.text._VALUE"), F.lit("")).alias("own"))
    there = flat.where("target IS NULL").select(F.col("title").alias("target"), F.col("own").alias("its"))
    text = F.when(F.col("target").isNull(), F.col("own")).otherwise(F.col("its"))
    return flat.join(there, "target", "left").select("title", text.alias("wikitext"), text.isNotNull().alias("found"), F.current_timestamp().alias("fetched_at"))


class SourceError(RuntimeError):
    """The answer says nothing about the page."""


def read_answer(payload: object) -> str | None:
    """The wikitext in an API's answer, None for a page that isn't there; anything else is an error."""
    if not isinstance(payload, dict):
        raise SourceError("the answer is not an object")
    error = payload.get("error")
    if error is not None:
        if isinstance(error, dict) and error.get("code") in ABSENT:
            return None
        raise SourceError(f"the API reports {error!r}")
    parsed = payload.get("parse")
    if not isinstance(parsed, dict) or "wikitext" not in parsed:
        raise SourceError("the answer has no text")
    return parsed["wikitext"] if isinstance(parsed["wikitext"], str) else None


def answers(raw: DataFrame) -> DataFrame:
    """(title, status, wikitext) of stored JSON answers (title, body); only found and absent may be kept."""
    parsed = F.from_json("body", "struct<error: struct<code: string>, parse: struct<wikitext: string>>")
    rows = raw.withColumn("a", parsed)
    status = F.when(F.col("a.error.code").isin(*sorted(ABSENT)), "absent").when(F.get_json_object("body", "$.error").isNotNull(), "error").when(F.get_json_object("body", "$.parse.wikitext").isNotNull(), "found").otherwise("error")
    return rows.select("title", F.coalesce(status, F.lit("error")).alias("status"), F.col("a.parse.wikitext").alias("wikitext"))


class Client:
    """One title a call, spaced, with retries that wait longer each time or as long as they are told."""

    def __init__(self, endpoint: str, *, min_interval: float = 0.5, timeout: float = 15.0, attempts: int = 4, backoff: float = 2.0, max_backoff: float = 60.0, user_agent: str = "stemma", opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.endpoint, self.min_interval, self.timeout, self.attempts = endpoint, min_interval, timeout, attempts
        self.backoff, self.max_backoff, self.user_agent = backoff, max_backoff, user_agent
        self.opener, self.sleep, self.clock = opener, sleep, clock
        self.last: float | None = None
        self.requests_made = 0

    def wikitext(self, title: str) -> str | None:
        query = {"action": "parse", "page": title, "prop": "wikitext", "redirects": 1, "format": "json", "formatversion": 2}
        return read_answer(self._fetch(f"{self.endpoint}?{urllib.parse.urlencode(query)}"))

    def _fetch(self, url: str) -> object:
        wait = self.backoff
        for attempt in range(1, self.attempts + 1):
            if self.last is not None:
                self.sleep(max(0.0, self.min_interval - (self.clock() - self.last)))
            self.last = self.clock()
            self.requests_made += 1
            told = None
            try:
                request = urllib.request.Request(url, headers={"User-Agent": self.user_agent, "Accept-Encoding": "gzip"})
                with self.opener(request, timeout=self.timeout) as response:
                    body = response.read()
                    if response.headers.get("Content-Encoding") == "gzip":
                        body = gzip.decompress(body)
                    return json.loads(body.decode())
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise SourceError(f"HTTP {e.code}") from e
                problem, told = e, e.headers.get("Retry-After") if e.headers else None
            except (OSError, EOFError, ValueError) as e:
                problem = e
            if attempt < self.attempts:
                if told and told.strip().isdigit():
                    wait = float(told)
                self.sleep(min(wait, self.max_backoff))
                wait *= 2
        raise SourceError(f"no answer after {self.attempts} attempts: {problem}") from problem


class WikiApi(DataSource):
    """``spark.read.format("wiki_api").option("titles", JSON list)``: title, status, wikitext.

    One partition, since the interval between calls holds for all of them.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki_api"

    def schema(self) -> str:
        return "title string, status string, wikitext string"

    def reader(self, schema) -> DataSourceReader:
        return _ApiReader(dict(self.options))


class _ApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        client = Client(self.options["endpoint"], min_interval=float(self.options.get("min_interval", 0.5)), attempts=int(self.options.get("attempts", 4)))
        for title in json.loads(self.options["titles"]):
            try:
                text = client.wikitext(title)
                yield title, "absent" if text is None else "found", text
            except SourceError:
                yield title, "error", None
