"""The library's front door: one word or many, over a page table."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.etymology import parse
from .functions.model import Form
from .operators import views
from .operators.histories import closure, histories, senses
from .operators.sections import read_pages
from .operators.walk import MAX_DEPTH, MAX_HOPS, History, Library, history, sense_rows
from .sources.pages import from_dict
from .sources.scratch import materialize

__all__ = ["Engine", "Result", "parse"]


@dataclass
class Result:
    """A walked word with its views."""

    history: History
    requests: int
    seconds: float

    @property
    def steps(self) -> int:
        return views.depth(self.history.rows)

    def tree(self, color: bool = False) -> str:
        return views.tree_text(self.history, color, requests=self.requests, seconds=self.seconds)

    def chain(self, color: bool = False) -> str:
        return views.chain_text(self.history, color, requests=self.requests, seconds=self.seconds)

    def json(self, indent: int | None = 2, senses: list | None = None) -> str:
        return views.as_json(self.history, indent, senses, requests=self.requests)


class Engine:
    """Words over pages. The pages are read once, at the first use."""

    def __init__(self, spark: SparkSession, pages: DataFrame | dict[str, str | None], *, max_depth: int = MAX_DEPTH, follow_compounds: bool = True):
        if not 1 <= max_depth <= 100:
            raise ValueError("the depth must be from 1 to 100")
        self.spark, self.max_depth, self.follow_compounds = spark, max_depth, follow_compounds
        self.pages = from_dict(spark, pages) if isinstance(pages, dict) else pages
        self._read: DataFrame | None = None

    @property
    def read(self) -> DataFrame:
        if self._read is None:
            self._read = materialize(read_pages(self.pages), "read")
        return self._read

    def walk(self, words: DataFrame, **options) -> DataFrame:
        """Histories of all words, as a DataFrame."""
        defaults = {"max_depth": self.max_depth, "follow_compounds": self.follow_compounds}
        return histories(self.pages, words, read=self.read, **(defaults | options))

    def _library(self, lemma: str, language: str, variants: tuple[str, ...]) -> Library:
        spellings = [(str(k), x, language) for k, x in enumerate((lemma, *variants))]
        words = self.spark.createDataFrame(spellings, "word_id string, lemma string, language string")
        titles = closure(self.read, words, self.max_depth + MAX_HOPS + 1).select("title").distinct()
        return Library({r.title: json.loads(r.read) for r in self.read.join(titles, "title").collect()})  # one word's pages

    def reconstruct(self, lemma: str, language: str = "it", *, sense: int = 1, follow_lemma: bool = True, as_lemma: str | None = None, variants: tuple[str, ...] = ()) -> Result:
        began = time.monotonic()
        library = self._library(lemma, language, variants)
        form = Form(lemma, language, variants=tuple(variants))
        walked = history(library, form, sense=sense, follow_lemma=follow_lemma, as_lemma=as_lemma, max_depth=self.max_depth, follow_compounds=self.follow_compounds)
        return Result(walked, len(library.pages), time.monotonic() - began)

    def senses(self, lemma: str, language: str = "it") -> list:
        return sense_rows(self._library(lemma, language, ()), Form(lemma, language))

    def senses_of(self, words: DataFrame) -> DataFrame:
        return senses(self.read, words)

    def register(self) -> None:
        """Views and functions for SQL: wiki_pages, wiki_read, parse_etymology(text, language) as JSON."""
        self.pages.createOrReplaceTempView("wiki_pages")
        self.read.createOrReplaceTempView("wiki_read")
        self.spark.udf.register("parse_etymology", F.udf(lambda text, code: None if text is None else json.dumps(parse(text, code or "").pack(), ensure_ascii=False), "string"))
