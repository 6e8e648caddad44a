"""Pages to headings, sections, definition lines, templates and read sections."""

from __future__ import annotations

import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entries
from ..functions import vocab as V
from ..functions.etymology import clean, template_name
from ..functions.markup import all_templates, templates
from ..functions.model import Form, Statement, Step
from .walk import titles_of

HEADINGS = "(?m)^(={2,6})\\s*(.+?)\\s*\\1[ \\t]*$"
_CODES: dict[str, list[str]] = defaultdict(list)
for _code, _name in V.LANGUAGES.items():
    _CODES[_name].append(_code)


def headings(pages: DataFrame) -> DataFrame:
    """(title, ord, level, heading) of each page, by SQL functions only."""
    marks = F.regexp_extract_all("wikitext", F.lit(HEADINGS), F.lit(1))
    names = F.regexp_extract_all("wikitext", F.lit(HEADINGS), F.lit(2))
    zipped = F.arrays_zip(marks.alias("mark"), names.alias("heading"))
    return pages.select("title", F.posexplode(zipped).alias("ord", "h")).select("title", "ord", F.length("h.mark").alias("level"), F.trim("h.heading").alias("heading"))


def definition_lines(pages: DataFrame) -> DataFrame:
    """(title, ord, line): lines with a single number sign."""
    lines = F.regexp_extract_all("wikitext", F.lit("(?m)^#(?![#*:])\\s*(.+)$"), F.lit(1))
    return pages.select("title", F.posexplode(lines).alias("ord", "line"))


def _rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` takes the values of one row and gives rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            out = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in fn(*row)]
            cols = zip(*out) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def sections(pages: DataFrame) -> DataFrame:
    """(title, ord, level, heading, body) with bodies up to the next heading of the level or above."""

    def cut(title, text):
        found = entries.headings(text or "")
        bodies = [body for _, body in entries.sections(text or "")]
        return [(title, k, h[2], h[3], b) for k, (h, b) in enumerate(zip(found, bodies))]

    return _rows(pages.select("title", "wikitext"), cut, "title string, ord int, level int, heading string, body string")


def language_sections(pages: DataFrame, code: str) -> DataFrame:
    """(title, body) of pages that have the language; the first of several counts."""

    def one(title, text):
        body = entries.language_section(text or "", code)
        return [] if body is None else [(title, body)]

    return _rows(pages.select("title", "wikitext"), one, "title string, body string")


def etymology_sections(bodies: DataFrame) -> DataFrame:
    """(title, ord, label, text) of the etymologies in language sections."""
    return _rows(bodies.select("title", "body"), lambda t, b: [(t, k, x, y) for k, (x, y) in enumerate(entries.etymology_sections(b))], "title string, ord int, label string, text string")


def extract_templates(texts: DataFrame, column: str = "text", nested: bool = False) -> DataFrame:
    """(title, ord, name, params): templates of a text; inner ones follow their outer one if ``nested``."""

    def find(title, text):
        found = all_templates(text or "") if nested else templates(text or "")
        return [(title, k, template_name(t), [{"key": p.key, "value": clean(p.value)} for p in t.params]) for k, t in enumerate(found)]

    return _rows(texts.select("title", column), find, "title string, ord int, name string, params array<struct<key: string, value: string>>")


def _named(section: dict) -> list[Form]:
    """All forms that a walk may look up after this section."""
    forms = [f for a in section["analyses"] for s in a["steps"] for f in Step.unpack(s).forms]
    return forms + [f for s in section["statements"] for f in Statement.unpack(s).forms]


def read_page(title: str, text: str) -> dict[str, dict]:
    """Every level-2 section of a page by language code; a heading that names no language stands for itself."""
    out: dict[str, dict] = {}
    for name, body in entries.sections(text, level=2):
        for code in _CODES.get(name) or [name]:
            if code not in out:
                out[code] = entries.read_section(body, code)
    return out


def read_pages(pages: DataFrame) -> DataFrame:
    """(title, read, refs): each found page's sections as JSON, and the titles it leads to.

    This is the only place that parses text; each page is parsed once however
    many words lead to it. Pages that are absent or in error have no row here.
    """

    def one(title, text):
        got = read_page(title, text)
        refs = sorted({t for s in got.values() for f in _named(s) for t in titles_of(f)})
        return [(title, json.dumps(got, ensure_ascii=False), refs)]

    found = pages.where("title IS NOT NULL AND wikitext IS NOT NULL")
    if "found" in pages.columns:
        found = found.where("found")
    if "fetched_at" in pages.columns:
        latest = Window.partitionBy("title").orderBy(F.desc("fetched_at"), F.desc("wikitext"))
        found = found.withColumn("_latest", F.row_number().over(latest)).where("_latest = 1")
    else:
        found = found.groupBy("title").agg(F.max("wikitext").alias("wikitext"))
    return _rows(found.select("title", "wikitext"), one, "title string, read string, refs array<string>")


def statements(read: DataFrame, code: str) -> DataFrame:
    """(title, ord, kind, wording, relation, part_of_speech, gloss, target, target_language, variants), a row for each form."""

    def one(title, packed):
        section = json.loads(packed).get(code)
        out = []
        for k, s in enumerate(Statement.unpack(x) for x in (section or {"statements": []})["statements"]):
            out += [(title, k, s.kind, s.wording, s.relation, s.part_of_speech, s.gloss, f.lemma, f.language, list(f.variants)) for f in s.forms]
        return out

    schema = "title string, ord int, kind string, wording string, relation string, part_of_speech string, gloss string, target string, target_language string, variants array<string>"
    return _rows(read.select("title", "read"), one, schema)


def steps(read: DataFrame, code: str) -> DataFrame:
    """(title, sense, ord, relation, distant, place, lemma, language, gloss): the forms of all steps."""

    def one(title, packed):
        section = json.loads(packed).get(code) or {"analyses": []}
        out = []
        for sense, a in enumerate(section["analyses"], 1):
            for k, s in enumerate(Step.unpack(x) for x in a["steps"]):
                out += [(title, sense, k, s.relation, s.distant, p, f.lemma, f.language, f.gloss) for p, f in enumerate(s.forms)]
        return out

    return _rows(read.select("title", "read"), one, "title string, sense int, ord int, relation string, distant boolean, place int, lemma string, language string, gloss string")


def analyses(read: DataFrame, code: str) -> DataFrame:
    """(title, sense, label, steps, hypotheses, notes, uncertain, imitative, eponym, root, text): a row for each etymology."""

    def one(title, packed):
        section = json.loads(packed).get(code) or {"analyses": [], "labels": []}
        out = []
        for k, (label, a) in enumerate(zip(section["labels"], section["analyses"]), 1):
            named = [{"lemma": h[0][0], "language": h[0][1], "attribution": h[1]} for h in a["hypotheses"]]
            out.append((title, k, label, len(a["steps"]), named, a["notes"], a["uncertain"], a["imitative"], a["eponym"], (a["root"] or [None])[0], a["text"]))
        return out

    schema = "title string, sense int, label string, steps int, hypotheses array<struct<lemma: string, language: string, attribution: string>>, notes array<string>, uncertain boolean, imitative boolean, eponym string, root string, text string"
    return _rows(read.select("title", "read"), one, schema)
