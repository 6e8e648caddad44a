"""Invariants of walked trees; each query gives the rows that break one, so an empty result is good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.languages import impossible_pairs
from ..sources.scratch import shuffled


def markup_in_lemma(nodes: DataFrame) -> DataFrame:
    """C1: no markup in a lemma."""
    return nodes.where(F.col("lemma").rlike("\\[\\[|\\]\\]|\\{\\{|\\}\\}|''|<[^>]*>"))


def colon_in_lemma(nodes: DataFrame) -> DataFrame:
    """C2: no language prefix left in a lemma."""
    return nodes.where(F.col("lemma").contains(":"))


def impossible_links(nodes: DataFrame, languages: DataFrame) -> DataFrame:
    """C3: no drawn link runs against the chronology."""
    child = nodes.where("parent_path IS NOT NULL").select("word_id", F.col("parent_path").alias("path"), F.col("language").alias("ancestor"), F.col("lemma").alias("ancestor_lemma"))
    drawn = child.join(shuffled(nodes.select("word_id", "path", F.col("language").alias("descendant"))), ["word_id", "path"])
    return drawn.join(F.broadcast(impossible_pairs(languages)), ["ancestor", "descendant"])


def proposals_drawn(nodes: DataFrame, analyses: DataFrame) -> DataFrame:
    """C4: what an entry proposes only is not drawn under it. ``analyses`` has title and hypotheses."""
    proposed = analyses.where("steps = 0").select("title", F.explode("hypotheses").alias("h")).select(F.col("title").alias("parent"), F.col("h.lemma").alias("lemma"), F.col("h.language").alias("language"))
    child = nodes.where("parent_path IS NOT NULL AND note IS NULL").select("word_id", F.col("parent_path").alias("path"), "lemma", "language")
    drawn = child.join(shuffled(nodes.select("word_id", "path", F.col("lemma").alias("parent"))), ["word_id", "path"])
    return drawn.join(shuffled(proposed), ["parent", "lemma", "language"])


def forms_lost(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """C5: every form that a walked entry names is a node or a proposal of the tree, or told in a note.

    ``named`` has word_id, lemma and language.
    """
    shown = nodes.select("word_id", F.lower(F.regexp_replace("lemma", "^\\*+", "")).alias("key"))
    told = nodes.select("word_id", F.explode("hypotheses").alias("h")).select("word_id", F.lower(F.regexp_replace("h.lemma", "^\\*+", "")).alias("key"))
    noted = nodes.where("note IS NOT NULL").select("word_id", F.explode(F.regexp_extract_all("note", F.lit("«([^»]*)»"), F.lit(1))).alias("x")).select("word_id", F.lower(F.regexp_replace("x", "^\\*+", "")).alias("key"))
    wanted = named.select("word_id", "lemma", F.lower(F.regexp_replace("lemma", "^\\*+", "")).alias("key"))
    return wanted.join(shown.unionAll(told).unionAll(noted).distinct(), ["word_id", "key"], "left_anti")


def unread_findings(nodes: DataFrame) -> DataFrame:
    """C6: a finding about the language rests on a form."""
    findings = [t for t, row in V.TERMINALS.items() if row[2] and t != "RECONSTRUCTED_ROOT"]
    return nodes.where(F.col("terminal").isin(findings) & (F.col("lemma") == ""))


def repeated_on_branch(nodes: DataFrame) -> DataFrame:
    """C7: no form repeats on a branch."""
    key = F.struct("language", F.lower(F.regexp_replace("lemma", "^\\*+", "")))
    keyed = nodes.select("word_id", "path", key.alias("key"))
    above = keyed.select("word_id", F.col("path").alias("upper"), F.col("key"))
    pairs = keyed.join(shuffled(above), ["word_id", "key"])
    return pairs.where((F.size("upper") < F.size("path")) & (F.slice("path", 1, F.greatest(F.size("upper"), F.lit(0))) == F.col("upper")))
