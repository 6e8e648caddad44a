"""Substring deduplication over windows of 50 words.

Each window of ``WINDOW`` words has a Rabin-Karp hash. Window hashes are counted
in Spark; a word goes if a window over it also starts in a document of a smaller
id. Removed windows merge into maximal intervals.

Two exact shortcuts keep the shuffle in proportion to what is repeated, instead
of one row per word of the corpus. Copies of a whole text are settled by its
digest. And every window has an anchor, the least hash among its runs of
``ANCHOR`` words: equal windows have equal anchors, so the windows whose anchor
occurs in one text only are known to occur once and need no row of their own.
A window is counted under (anchor, hash), 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, small_batches, table
from .rolling import signed, windows, word_hashes

WINDOW, ANCHOR = 50, 20


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window: the least hash of the runs of ANCHOR words in it."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.uint64)
    return sliding_window_view(windows(hashes, ANCHOR), WINDOW - ANCHOR + 1).min(axis=1)


def _map(rows: DataFrame, fn, schema: str) -> DataFrame:
    from .common import _arrow

    arrow = _arrow(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = fn({c: part.column(k).to_pylist() for k, c in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _first_pass(cols: dict) -> dict:
    out = {"doc_id": cols["doc_id"], "th": cols["th"], "digest": [], "n_words": [], "sha": [], "anchors": []}
    for text in cols["text"]:
        raw = (text or "").encode()
        words = raw.split()
        found = np.unique(anchors(word_hashes(words))) if len(words) >= WINDOW else np.empty(0, np.uint64)
        out["digest"].append(xxhash.xxh3_128_digest(raw))
        out["n_words"].append(len(words))
        out["sha"].append(_sha(words))
        out["anchors"].append(signed(found))
    return out


def _window_rows(cols: dict) -> dict:
    out: dict[str, list] = {"anchor": [], "h": [], "doc_id": []}
    for doc, text, shared in zip(cols["doc_id"], cols["text"], cols["shared"]):
        hashes = word_hashes(text.encode().split())
        a, h = signed(anchors(hashes)), signed(windows(hashes, WINDOW))
        keep = np.isin(a, np.array(shared, np.int64))
        both = np.unique(np.stack([a[keep], h[keep]], axis=1), axis=0)
        out["anchor"].append(both[:, 0])
        out["h"].append(both[:, 1])
        out["doc_id"].append(np.full(len(both), doc))
    return {k: np.concatenate(v) if v else [] for k, v in out.items()}


def removal_intervals(n_words: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals that the windows at these starts (ascending) cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return [(int(part[0]), int(part[-1]) + WINDOW) for part in np.split(starts, cut)]


def _cut(text: str, gone: list[int] | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    words = text.encode().split()
    if not gone:
        return words, []
    h = signed(windows(word_hashes(words), WINDOW))
    spans = removal_intervals(len(words), np.flatnonzero(np.isin(h, np.array(gone, np.int64))))
    kept, at = [], 0
    for s, e in spans:
        kept += words[at:s]
        at = e
    return kept + words[at:], spans


def _last_pass(cols: dict) -> dict:
    out: dict[str, list] = {"doc_id": cols["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
    for text, gone in zip(cols["text"], cols["gone"]):
        kept, spans = _cut(text, gone)
        removed = sum(e - s for s, e in spans)
        out["n_words"].append(len(kept) + removed)
        out["n_removed"].append(removed)
        out["kept_sha256"].append(_sha(kept))
        out["spans"].append([{"start": s, "end": e} for s, e in spans])
    return out


REPEATS = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def repeated_windows(docs: DataFrame) -> DataFrame:
    """One row per document: words, words removed, digest of the kept words and the removal intervals.

    Words are the runs without ASCII white space; a null text has none. A row
    with a null id removes nothing and nothing is removed from it. Rows of equal
    id do not remove each other's words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    first = materialize(_map(rows, _first_pass, "doc_id long, th long, digest binary, n_words long, sha string, anchors array<long>"), "repeats-texts")
    # What a join reads is written before, so that its hot keys can be split at run time.
    earliest = materialize(first.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("earliest")), "repeats-earliest")
    # Copies: only the earliest of equal texts takes part below.
    seen = first.select("doc_id", "th", "digest", "n_words", "sha").join(earliest, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("earliest"), F.lit(False))
    owners = first.where("doc_id IS NOT NULL AND n_words >= 50").select("doc_id", "th", "digest", "anchors")
    owners = owners.join(earliest.withColumnRenamed("earliest", "doc_id"), ["digest", "doc_id"], "left_semi")
    places = materialize(owners.select("doc_id", "th", F.explode("anchors").alias("anchor")), "repeats-anchors")
    shared = materialize(places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "repeats-shared")
    wanted = places.join(shared, "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("shared"))
    touched = materialize(rows.where("text IS NOT NULL").join(wanted, ["doc_id", "th"]), "repeats-touched")
    discard(places, shared)
    counted = materialize(_map(touched.select("doc_id", "text", "shared"), _window_rows, "anchor long, h long, doc_id long"), "repeats-windows")
    firsts = materialize(counted.groupBy("anchor", "h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor", "h", "a"), "repeats-firsts")
    gone = counted.join(firsts, ["anchor", "h"]).where("doc_id > a").groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    cut = _map(touched.select("doc_id", "text").join(gone, "doc_id", "left"), _last_pass, REPEATS)
    whole = (F.col("n_words") >= WINDOW) & copy
    span = F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    none = F.array().cast("array<struct<start: long, end: long>>")
    plain = seen.join(touched.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_sha([]))).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.array(span)).otherwise(none).alias("spans"),
    )
    return cut.unionByName(plain)


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
