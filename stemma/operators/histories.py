"""Histories of many words at once.

First the titles that each word can lead to are collected, one level of the graph
a round, by joins on titles that carry no text. Then each word gets the read
sections of its titles and is walked exactly, as one row. What a word can lead to
is bounded by the depth and by what entries name; titles that many words share
are the hot keys of a join, which adaptive execution splits.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Form
from ..sources.scratch import materialize, shuffled
from . import views
from .sections import _rows, read_pages
from .walk import MAX_DEPTH, MAX_HOPS, History, Library, SourceError, history, sense_rows, titles_of

NODE = "struct<path: array<int>, lemma: string, language: string, gloss: string, transliteration: string, variants: array<string>, relation: string, terminal: string, note: string, source_text: string, from_definition: boolean, skips_stages: boolean, hypotheses: array<struct<lemma: string, language: string, gloss: string, attribution: string>>>"
OPTION = "struct<lemma: string, language: string, wording: string, part_of_speech: string, gloss: string>"
HISTORY = f"word_id string, lemma string, language string, start_lemma string, start_language string, senses int, sense int, label string, resolution string, options array<{OPTION}>, error string, nodes array<{NODE}>"
VIEWS = "tree string, chain string, json string"


def _words(words: DataFrame) -> DataFrame:
    """word_id, lemma, language, sense, as_lemma with their defaults; rows without a lemma are left out."""
    def col(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)).alias(name) if name in words.columns else F.lit(default).alias(name)

    ids = F.col("word_id").cast("string") if "word_id" in words.columns else F.concat_ws(":", F.coalesce(F.col("language"), F.lit("it")) if "language" in words.columns else F.lit("it"), "lemma")
    as_lemma = F.col("as_lemma") if "as_lemma" in words.columns else F.lit(None).cast("string")
    return words.where("lemma IS NOT NULL").select(ids.alias("word_id"), "lemma", col("language", "it"), col("sense", 1), as_lemma.alias("as_lemma"))


def closure(read: DataFrame, words: DataFrame, rounds: int) -> DataFrame:
    """(word_id, title) of every page that the walk of a word may look at."""
    start = _rows(words.select("word_id", "lemma", "language"), lambda w, x, c: [(w, t) for t in titles_of(Form(x, c))], "word_id string, title string")
    refs = shuffled(read.select("title", "refs"))
    frontier = materialize(start.distinct(), "frontier")
    seen = frontier
    for _ in range(rounds):
        step = frontier.join(refs, "title").select("word_id", F.explode("refs").alias("title")).distinct()
        frontier = materialize(step.join(shuffled(seen), ["word_id", "title"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def _pack(word_id: str, h: History, views_too: bool) -> tuple:
    root = next(r for r in h.rows if not r.path).form
    nodes = []
    for r in h.rows:
        named = [{"lemma": x.form.lemma, "language": x.form.language, "gloss": x.form.gloss, "attribution": x.attribution} for x in r.hypotheses]
        node = {k: getattr(r, k) for k in ("relation", "terminal", "note", "source_text", "from_definition", "skips_stages")}
        node |= {"path": list(r.path), "lemma": r.form.lemma, "language": r.form.language, "gloss": r.form.gloss, "transliteration": r.form.transliteration, "variants": list(r.form.variants), "hypotheses": named}
        nodes.append(node)
    options = [{"lemma": o.forms[0].lemma, "language": o.forms[0].language, "wording": o.wording, "part_of_speech": o.part_of_speech, "gloss": o.gloss} for o in h.options]
    out = (word_id, h.asked.lemma, h.asked.language, root.lemma, root.language, h.senses, h.sense, h.label, h.resolution, options, None, nodes)
    return (*out, views.tree_text(h), views.chain_text(h), views.as_json(h, None)) if views_too else out


def histories(pages: DataFrame, words: DataFrame, *, max_depth: int = MAX_DEPTH, follow_lemma: bool = True, follow_compounds: bool = True, with_views: bool = False, read: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row per word with its walked tree.

    ``words`` has lemma and optionally word_id, language, sense and as_lemma;
    ``read`` may give pages read before; ``errors`` titles that could not be
    fetched. A word whose own page is in error has the error and no nodes.
    """
    asked = materialize(_words(words).dropDuplicates(["word_id"]), "words")
    read = materialize(read_pages(pages), "read") if read is None else read
    seen = closure(read, asked, max_depth + MAX_HOPS + 1)
    known = read.select("title", "read")
    if errors is not None:
        known = known.unionAll(errors.select("title", F.lit(None).cast("string").alias("read")))
    held = seen.join(shuffled(known), "title").groupBy("word_id").agg(F.collect_list(F.struct("title", "read")).alias("held"))
    rows = asked.join(held, "word_id", "left").select("word_id", "lemma", "language", "sense", "as_lemma", "held")

    def walk(word_id, lemma, language, sense, as_lemma, held):
        library = Library({x["title"]: json.loads(x["read"]) for x in held or () if x["read"] is not None}, {x["title"] for x in held or () if x["read"] is None})
        try:
            h = history(library, Form(lemma, language), sense=sense, follow_lemma=follow_lemma, as_lemma=as_lemma, max_depth=max_depth, follow_compounds=follow_compounds)
        except SourceError as e:
            return [(word_id, lemma, language, lemma, language, 0, sense, "", None, [], str(e), [], *([None] * 3 if with_views else []))]
        return [_pack(word_id, h, with_views)]

    return _rows(rows, walk, f"{HISTORY}, {VIEWS}" if with_views else HISTORY)


def senses(read: DataFrame, words: DataFrame) -> DataFrame:
    """(word_id, sense, label, part_of_speech, definition, ancestor, ancestor_language, carries_etymology): homographs."""
    asked = _words(words).select("word_id", "lemma", "language")
    titled = _rows(asked, lambda w, x, c: [(w, x, c, t) for t in titles_of(Form(x, c))], "word_id string, lemma string, language string, title string")

    def one(word_id, lemma, language, title, packed):
        found = sense_rows(Library({title: json.loads(packed)}), Form(lemma, language))
        return [(word_id, k, label, pos, text, f.lemma if f else None, f.language if f else None, c) for k, label, pos, text, f, c in found]

    schema = "word_id string, sense int, label string, part_of_speech string, definition string, ancestor string, ancestor_language string, carries_etymology boolean"
    return _rows(titled.join(read.select("title", "read"), "title").select("word_id", "lemma", "language", "title", "read"), one, schema)


def nodes(walked: DataFrame) -> DataFrame:
    """One row per node; ``depth`` is the number of links from the root."""
    out = walked.select("word_id", F.explode("nodes").alias("n")).select("word_id", "n.*")
    return out.withColumn("depth", F.size("path")).withColumn("parent_path", F.when(F.size("path") > 0, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))


def leaves(node_rows: DataFrame) -> DataFrame:
    parents = node_rows.where("parent_path IS NOT NULL").select("word_id", F.col("parent_path").alias("path")).distinct()
    return node_rows.join(parents, ["word_id", "path"], "left_anti")


def main_chains(node_rows: DataFrame) -> DataFrame:
    """The nodes reached by first children only."""
    return node_rows.where(F.forall("path", lambda x: x == 0))


def depths(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("word_id").agg(F.max("depth").alias("steps"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("skips_stages").cast("int")).alias("skips"))


def terminal_tally(node_rows: DataFrame, terminals: DataFrame) -> DataFrame:
    """(label, n) over all leaves that have a terminal."""
    named = leaves(node_rows).where("terminal IS NOT NULL").join(F.broadcast(terminals), F.col("terminal") == F.col("name"))
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def coverage(walked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares of words with a chain, with a chain or text, and by what their root ends on."""
    root = F.filter("nodes", lambda n: F.size(n["path"]) == 0)[0]
    flat = walked.select(*(by or []), (F.size("nodes") > 1).alias("chain"), ((F.size("nodes") > 1) | root["source_text"].isNotNull()).alias("told"), (root["terminal"] == "ETYMOLOGY_MISSING").alias("silent"), (root["terminal"] == "ENTRY_MISSING").alias("missing"))
    counts = [F.count(F.lit(1)).alias("words"), *(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("chain", "told", "silent", "missing"))]
    return flat.rollup(*by).agg(*counts) if by else flat.agg(*counts)
