"""A page table kept between runs: rows go out of date, absences are remembered, errors are not."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pages import PAGES
from .scratch import materialize

TTL_DAYS = 30.0


def default_path() -> str:
    return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "stemma", "pages")


def latest(pages: DataFrame) -> DataFrame:
    """One row per title: the last fetched."""
    order = Window.partitionBy("title").orderBy(F.desc("fetched_at"), F.desc("wikitext"))
    return pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fresh(pages: DataFrame, ttl_days: float = TTL_DAYS, now: Column | None = None) -> DataFrame:
    """Rows fetched at most ``ttl_days`` ago."""
    now = F.current_timestamp() if now is None else now
    age = now.cast("double") - F.col("fetched_at").cast("double")
    return pages.where(age <= ttl_days * 86400)


class PageCache:
    """Versioned Parquet folders under a path; a new version is complete before the old one goes."""

    def __init__(self, spark: SparkSession, path: str | None = None, ttl_days: float = TTL_DAYS):
        self.spark, self.path, self.ttl_days = spark, (path or default_path()).rstrip("/"), ttl_days

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        return sorted((s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")), key=lambda p: int(p.rpartition("/v")[2]))

    def read(self) -> DataFrame:
        """All rows; a cache that can't be read counts as empty, with a warning."""
        try:
            versions = self._versions()
            if versions:
                df = self.spark.read.schema(PAGES).parquet(versions[-1])
                df.limit(1).collect()
                return df
        except (PySparkException, Py4JError) as e:
            warnings.warn(f"the page cache at {self.path} can't be read: {type(e).__name__}", stacklevel=2)
        return self.spark.createDataFrame([], PAGES)

    def _replace(self, df: DataFrame) -> None:
        fs, _ = self._fs()
        old = self._versions()
        number = int(old[-1].rpartition("/v")[2]) + 1 if old else 1
        df.select("title", "wikitext", "found", "fetched_at").write.parquet(f"{self.path}/v{number}")
        for path in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def store(self, pages: DataFrame) -> None:
        """Add pages; of a title's rows the last stays."""
        self._replace(latest(self.read().unionByName(pages.select("title", "wikitext", "found", "fetched_at"))))

    def get(self, titles: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Pages of these titles; those that are missing or out of date go to ``fetch``, once each.

        ``fetch`` takes titles and gives (title, status, wikitext); errors come
        back as neither found nor absent, and are not stored.
        """
        wanted = titles.select("title").where("title IS NOT NULL").distinct()
        # Written out: the files read here are replaced below.
        held = materialize(fresh(self.read(), self.ttl_days).join(wanted, "title", "left_semi"), "cached-pages")
        got = materialize(fetch(wanted.join(held, "title", "left_anti")), "fetched-pages")
        kept = got.where("status IN ('found', 'absent')").select("title", "wikitext", (F.col("status") == "found").alias("found"), F.current_timestamp().alias("fetched_at"))
        kept = materialize(kept, "kept-pages")
        self.store(kept)
        return held.unionByName(kept)

    def prune(self) -> tuple[int, float]:
        """(rows removed, MB freed): rows that are out of date go."""
        before, size = self.stats()
        self._replace(fresh(self.read(), self.ttl_days))
        after, rest = self.stats()
        return before - after, max(0.0, size - rest)

    def stats(self) -> tuple[int, float]:
        """(rows, MB); nothing if the cache can't be read."""
        try:
            fs, path = self._fs()
            if not fs.exists(path):
                return 0, 0.0
            return self.read().count(), fs.getContentSummary(path).getLength() / 1e6
        except (PySparkException, Py4JError):
            return 0, 0.0

    def clear(self) -> tuple[bool, str]:
        """Delete the cache; a missing one counts as deleted."""
        fs, path = self._fs()
        if not fs.exists(path):
            return True, "there was no cache"
        return bool(fs.delete(path, True)), f"removed {self.path}"
