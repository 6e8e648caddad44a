"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts and items are reduced to words (lower-cased; ASCII punctuation separates).
An item of n words matches a document if some passage, of any length, is within
k = ``RATE`` * n word edits of it, rounded down: items of up to four words match
by the same words only. Windows of n words are embedded by the random walk of
Chakraborty, Goldenberg and Koucky: a pointer reads a word at each of 3n steps
and moves on if a random bit, chosen by step and word, says so. Few edits then
change few embedded positions. Each repetition samples ``BITS`` positions of an
embedding as a bucket key; ``REPEATS`` of them meet the target recall, which
the tests measure. What collides is verified by exact edit distance: the least
over all passages that lie within k words of the window.

Before embedding, a lossless test: within k edits of an item, all but k of the
item's words stand in the window. So n - k of the window's words must be words
of some item; and of the rarer words that items of n words have, the window must
have all but k of the fewest that one of them has. Few windows pass both; equal
ones among them are embedded once per batch. A passage within k edits lies in, or
around, a window that passes: what a passage of more than n words has beyond the
window are as many words as were inserted, less those dropped. Windows hang over
the ends of a document by up to k words, so that a text shorter than an item has one.

The items, their words and their bucket keys are Spark tables. What a worker
holds of them are three sieves, bitmaps of at most ``MOST_BITS`` bits (words of
items, rarer words by item length, bucket keys), and the number of rarer words
by item length. A sieve lets pass all that it should, and a little more. The
windows that pass, with the words around them (a region), are written out; their
keys meet the items' by a join, and each pair is verified where the join puts it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow, broadcast_if_small, materialize, new_name, slices, small_batches, table
from .rolling import mix, prefix_sums, signed, window_at, word_hashes

RATE = 0.2
EMBEDDINGS, REPEATS, BITS = 6, 96, 3
SEED = 7
#: Bits of a sieve: so many for each thing in it, the next power of two, and never more than the last figure.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 30
#: Words of documents handled by one array operation, and different words that a worker keeps.
RUN_WORDS, KEPT_WORDS = 400_000, 200_000
#: A word is common if more than this share of the items has it.
COMMON = 0.02
_SPLIT = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def edit_distance(masks: dict[int, int], n: int, window: list[int]) -> int:
    """Edits between an item (n words; for each word the bits of its places) and a window (bit-parallel)."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    for w in window:
        eq = masks.get(w, 0)
        x = eq | down
        diagonal = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & last:
            distance += 1
        if minus & last:
            distance -= 1
        plus = (plus << 1) | 1
        minus = minus << 1
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal & full
    return distance


def best_passage(masks: dict[int, int], n: int, region: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, start, words) of the passage of ``region`` nearest to an item, if within ``most``: the earliest, then shortest, of equals."""
    turned = {w: int(format(m, f"0{n}b")[::-1], 2) for w, m in masks.items()}
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance, best = full, 0, n, (most + 1, 0)
    for s in range(len(region) - 1, -1, -1):  # backwards, where a match may begin at any word: the distance is that of the best passage from s
        eq = turned.get(region[s], 0)
        x = eq | down
        diagonal = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & last:
            distance += 1
        if minus & last:
            distance -= 1
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal & full
        best = min(best, (distance, s))
    edits, start = best
    if edits > most:
        return None
    words = next(m for m in range(max(1, n - edits), n + edits + 1) if edit_distance(masks, n, region[start : start + m]) == edits)
    return edits, start, words


def embed(flat: np.ndarray, starts: np.ndarray, n: int, steps: list[np.ndarray]) -> list[np.ndarray]:
    """For each embedding its values of the windows flat[s:s+n] at the given steps (ascending); 0 past the end."""
    out = [np.zeros((len(starts), len(s)), np.uint64) for s in steps]
    wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for e, mine in enumerate(steps):
        for k, s in enumerate(mine.tolist()):
            wanted[s].append((e, k))
    base, at = starts.astype(np.int64), np.zeros((len(steps), len(starts)), np.int64)
    seeds = [1000003 * e for e in range(len(steps))]
    for step in range(max(wanted) + 1):
        inside = at < n
        value = np.where(inside, flat[base + np.minimum(at, n - 1)], np.uint64(0))
        for e, k in wanted.get(step, ()):
            out[e][:, k] = value[e]
        # the top bit of a random odd multiple is the coin of this step and word
        odd = np.array([((0x9E3779B97F4A7C15 * (s + step + 1) ^ 0xD1B54A32D192ED03) | 1) & 0xFFFFFFFFFFFFFFFF for s in seeds], np.uint64)
        at += ((value * odd[:, None]) >> np.uint64(63)).astype(np.int64) & inside
    return out


def _starts(mine: np.ndarray, least: int, n: int, size: int) -> np.ndarray:
    """Starts of the runs of n places with at least ``least`` of these spots."""
    if size < n:
        return np.empty(0, np.int64)
    if least <= 0:
        return np.arange(size - n + 1)
    if len(mine) < least:
        return np.empty(0, np.int64)
    # a run over spots j to j + least - 1 starts after the last of them less n, and not after the first
    low, high = np.maximum(mine[least - 1 :] - n + 1, 0), np.minimum(mine[: len(mine) - least + 1], size - n)
    low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1] + 1]))
    count = np.maximum(high - low + 1, 0)
    return np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def masks_of(words: np.ndarray) -> dict[int, int]:
    """For each word the bits of its places."""
    out: dict[int, int] = defaultdict(int)
    for k, w in enumerate(words.tolist()):
        out[w] |= 1 << k
    return dict(out)


_plans: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}


def _plan(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each embedding of windows of n words: the steps that are sampled, the columns of each repetition, and its first key."""
    if n not in _plans:
        if len(_plans) > 1000:
            _plans.clear()
        rng, per, out = np.random.default_rng([SEED, n]), -(-REPEATS // EMBEDDINGS), []
        for e in range(EMBEDDINGS):
            # a walk ends after about 2n of its 3n steps; later ones would all agree
            picks = [np.sort(rng.choice(2 * n, min(BITS, 2 * n), replace=False)) for _ in range(per)]
            steps = np.unique(np.concatenate(picks))
            first = mix((np.arange(per, dtype=np.uint64) + np.uint64(1 + e * per)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            out.append((steps, np.array([np.searchsorted(steps, p) for p in picks]), first))
        _plans[n] = out
    return _plans[n]


def bucket_keys(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A row of ``REPEATS`` bucket keys, or a few more, for each window flat[s:s+n]."""
    plan, out = _plan(n), []
    for (_, columns, first), values in zip(plan, embed(flat, starts, n, [steps for steps, _, _ in plan])):
        picked = values[:, columns]  # window, repetition, position
        keys = np.broadcast_to(first, picked.shape[:2])
        for k in range(picked.shape[2]):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + picked[:, :, k])
        out.append(keys)
    return np.concatenate(out, axis=1)


def _mapped(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` takes a column dict and gives one; texts come in slices."""
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch) if "text" in batch.schema.names else [batch]:
                if part.num_rows:
                    out = fn({c: part.column(k).to_pylist() for k, c in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            del batch
            pa.default_memory_pool().release_unused()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _item_rows(cols: dict) -> dict:
    out: dict[str, list] = {"item_id": [], "n": [], "words": [], "keys": []}
    for i, text in zip(cols["item_id"], cols["text"]):
        words = words_of(text)
        if words:
            flat = word_hashes(words)
            out["item_id"].append(i)
            out["n"].append(len(words))
            out["words"].append(signed(flat))
            out["keys"].append(signed(bucket_keys(flat, np.zeros(1, np.int64), len(words))[0]))
    return out


@dataclass
class Sieve:
    """A set of 64-bit numbers as bits; ``probes`` of them for each number."""

    bits: np.ndarray
    probes: int

    def has(self, x: np.ndarray, shift: int = 0) -> np.ndarray:
        mask = np.uint64(8 * len(self.bits) - 1)
        out = np.ones(x.shape, bool)
        for p in range(self.probes):
            at = ((x >> np.uint64(17 * p)) & mask) + np.uint64(shift) & mask
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def make_sieve(numbers: DataFrame, probes: int, shift: Column | None = None) -> Sieve:
    """The sieve of column x; the driver and each worker hold at most ``MOST_BITS`` bits of it. ``shift`` turns the places of a row."""
    size = LEAST_BITS
    wanted = numbers.count() * BITS_EACH
    while size < min(wanted, MOST_BITS):
        size *= 2
    places = [F.shiftrightunsigned("x", 17 * p).bitwiseAND(F.lit(size - 1)) for p in range(probes)]
    rows = numbers.select(F.explode(F.array(*[(p + (F.lit(0) if shift is None else shift)).bitwiseAND(F.lit(size - 1)) + 1 for p in places])).alias("p"))
    parts = rows.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return Sieve(bits, probes)


def _turn(n):
    """What sets apart the places of equal words in items of different lengths."""
    return n * 40503


@dataclass
class Index:
    """A benchmark: its items as a table (ref, item_id, n, words, keys), and what workers hold of them."""

    items: DataFrame
    words: Sieve
    rare: Sieve
    own: Sieve
    keys: Sieve
    #: rarer words that a window of this length must have
    least: dict[int, int]


def index_benchmark(benchmark: DataFrame) -> Index:
    """Null ids and texts, and texts without words, match nothing; an item with several texts is found by any of them."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    made = _mapped(rows, _item_rows, "item_id long, n int, words array<long>, keys array<long>").withColumn("ref", F.monotonically_increasing_id())
    items = materialize(made, "decon-items")
    words = items.select("ref", "n", F.explode("words").alias("x"))
    common = max(2.0, COMMON * items.count())
    spread = materialize(words.distinct().groupBy("x").agg(F.count(F.lit(1)).alias("spread")), "decon-words")
    rarer = words.join(spread.where(F.col("spread") <= common), "x")
    counted = rarer.groupBy("ref").agg(F.count(F.lit(1)).alias("rarer"))
    fewest = items.select("ref", "n").join(counted, "ref", "left").groupBy("n").agg(F.min(F.coalesce("rarer", F.lit(0))).alias("least"))
    least = {r.n: r.least - int(RATE * r.n) for r in fewest.toLocalIterator()}  # one row for each length that an item has
    return Index(
        items,
        make_sieve(spread.select("x"), 1),
        make_sieve(spread.where(F.col("spread") <= common).select("x"), 1),
        make_sieve(rarer.select("x", "n").distinct(), 1, _turn(F.col("n").cast("long"))),
        make_sieve(items.select(F.explode("keys").alias("x")).distinct(), 3),
        least,
    )


class Scanner:
    """Finds the regions of texts where windows may match an item."""

    def __init__(self, words: Sieve, rare: Sieve, own: Sieve, keys: Sieve, least: dict[int, int]):
        self.words, self.rare, self.own, self.keys, self.least = words, rare, own, keys, least
        self.tail = int(RATE * max(least, default=0)) + 1
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.hash, self.code = np.empty(0, np.uint64), np.empty(0, np.int8)

    def _numbers(self, run: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of a run, one text after the other."""
        if len(self.number) > KEPT_WORDS:
            self.forget()
        old = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, chain.from_iterable(run)), np.int64, sum(map(len, run)))
        hashes = word_hashes(list(islice(reversed(self.number), len(self.number) - old))[::-1])
        self.hash = np.concatenate([self.hash, hashes])
        self.code = np.concatenate([self.code, self.words.has(hashes).astype(np.int8) + self.rare.has(hashes)])
        return out

    def regions(self, rows: Iterable[tuple]) -> Iterator[list[tuple]]:
        """Of (row, text): (row, item length, first word, hashes of the words, bucket keys) where some window passes all sieves; a list for each run of texts."""
        run: list[tuple[object, list[bytes]]] = []
        held = 0
        for row, text in rows:
            words = words_of(text)
            if words:
                run.append((row, words))
                held += len(words)
            if held >= RUN_WORDS:
                yield list(self._scan(run))
                run, held = [], 0
        if run:
            yield list(self._scan(run))

    def _scan(self, run: list[tuple[int, list[bytes]]]) -> Iterator:
        if not self.least:
            return
        numbers = self._numbers([w for _, w in run])
        lengths = np.array([len(w) for _, w in run])
        # Unknown words around each text, as many as a window that can match may hang over its ends:
        # before it foreign ones, after it none, where a walk stays, as past the end of an item.
        around = np.minimum(self.tail, lengths // 4 + 2)
        begins = np.cumsum(lengths + 2 * around) - lengths - around
        ends = begins + lengths
        size = int(ends[-1] + around[-1])
        at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(len(numbers))
        flat, codes = np.zeros(size, np.uint64), np.zeros(size, np.int8)
        flat[at], codes[at] = self.hash[numbers], self.code[numbers]
        before = np.repeat(begins - around - np.cumsum(around) + around, around) + np.arange(around.sum())
        flat[before] = mix((np.repeat(begins, around) - before).astype(np.uint64))
        total = np.zeros(size + 1, np.int32)
        np.cumsum(codes > 0, out=total[1:])
        spots = np.flatnonzero(codes > 1)
        spot_hashes = flat[spots]
        sums = None
        for n, least in self.least.items():
            starts = _starts(spots[self.own.has(spot_hashes, _turn(n))] if least > 0 else spots, least, n, size)
            most = int(RATE * n)
            starts = starts[total[starts + n] - total[starts] >= n - most]
            doc = np.minimum(np.searchsorted(ends, starts + n // 2, side="right"), len(ends) - 1)
            over = np.minimum(most, around[doc])
            starts = starts[(starts >= begins[doc] - over) & (starts + n <= ends[doc] + over)]
            if not len(starts):
                continue
            sums = prefix_sums(flat) if sums is None else sums
            _, one, back = np.unique(window_at(sums, starts, n), return_index=True, return_inverse=True)
            found: dict[int, np.ndarray] = {}
            for a in range(0, len(one), 20_000):
                keys = bucket_keys(flat, starts[one[a : a + 20_000]], n)
                hit = self.keys.has(keys)
                found |= {a + r: keys[r][hit[r]] for r in np.flatnonzero(hit.any(axis=1)).tolist()}
            if found:
                mine = np.flatnonzero(np.isin(back, list(found)))
                yield from self._merged(n, starts[mine], [found[w] for w in back[mine].tolist()], flat, begins, ends, run)

    @staticmethod
    def _merged(n: int, at: np.ndarray, keys: list, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, run: list) -> Iterator:
        """Windows with the words around them; those whose surroundings overlap are one region."""
        most = int(RATE * n)
        doc = np.minimum(np.searchsorted(ends, at + n // 2, side="right"), len(ends) - 1)
        low, high = np.maximum(at - most, begins[doc]), np.minimum(at + n + most, ends[doc])
        new = np.concatenate([[True], (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])])
        cut = [*np.flatnonzero(new).tolist(), len(at)]
        for a, b in zip(cut, cut[1:]):
            d, begin = int(doc[a]), int(low[a])
            yield run[d][0], n, begin - int(begins[d]), flat[begin : int(high[b - 1])], np.unique(np.concatenate(keys[a:b]))


REGIONS = "doc_id long, th long, n int, begin long, rid binary, words array<long>, keys array<long>"
MATCHES = "doc_id long, item_id long, start_word long, n_words long, edits long"


def _regions(docs: DataFrame, index: Index) -> DataFrame:
    """The regions of all texts, written; rid tells different ones apart."""
    name = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast((index.words, index.rare, index.own, index.keys, index.least))
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))

    arrow = _arrow(docs.sparkSession, REGIONS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _scanner
        if _scanner is None or _scanner[0] != name:
            _scanner = name, Scanner(*held.value)
        parts = (part.to_pydict() for batch in batches for part in slices(batch))
        texts = (((i, h), t) for cols in parts for i, h, t in zip(cols["doc_id"], cols["th"], cols["text"]))
        for found in _scanner[1].regions(texts):
            made = [(i, h, n, begin, xxhash.xxh3_128_digest(words.tobytes(), n), signed(words), signed(keys)) for (i, h), n, begin, words, keys in found]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in made], f.type) for k, f in enumerate(arrow)], schema=arrow)
        _scanner[1].forget()
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return materialize(rows.mapInArrow(scan, REGIONS), "decon-regions")


_scanner: tuple[str, Scanner] | None = None


def _verify(cols: dict) -> dict:
    out: dict[str, list] = {c: [] for c in ("rid", "item_id", "edits", "start", "n_words")}
    masks: dict[bytes, dict[int, int]] = {}
    for rid, item, n, words, region in zip(cols["rid"], cols["item_id"], cols["n"], cols["item_words"], cols["words"]):
        own = np.array(words, np.int64).view(np.uint64)
        name = own.tobytes()
        if name not in masks:
            if len(masks) > 1000:
                masks.clear()
            masks[name] = masks_of(own)
        best = best_passage(masks[name], n, np.array(region, np.int64).view(np.uint64).tolist(), int(RATE * n))
        if best:
            for values, x in zip(out.values(), (rid, item, best[0], best[1], best[2])):
                values.append(x)
    return out


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, edits, start_word, n_words) of the best passage of each region and item."""
    index = index_benchmark(benchmark)
    regions = _regions(docs, index)
    keyed = materialize(regions.select("rid", F.explode("keys").alias("key")).distinct(), "decon-keyed")
    buckets = materialize(index.items.select("ref", F.explode("keys").alias("key")), "decon-buckets")
    pairs = materialize(keyed.join(buckets, "key").select("rid", "ref").distinct(), "decon-pairs")
    items = index.items.select("ref", "item_id", "n", F.col("words").alias("item_words"))
    distinct = regions.select("rid", "words").dropDuplicates(["rid"])  # rows of one rid have the same words
    joined = pairs.join(items, "ref").join(distinct, "rid").select("rid", "item_id", "n", "item_words", "words")
    verified = materialize(_mapped(joined, _verify, "rid binary, item_id long, edits long, start long, n_words long"), "decon-verified")
    return regions.select("rid", "doc_id", "th", "begin").join(verified, "rid").select("doc_id", "th", "item_id", "edits", (F.col("begin") + F.col("start")).alias("start_word"), "n_words")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that match: the passage with the fewest edits, of equals the earliest, then shortest.

    Null and empty texts match nothing. An id stands for one document: rows that
    repeat an id, with the same or other texts, give one row for an item, the best
    of all; a null id counts as an id.
    """
    best = F.min(F.struct("edits", "start_word", "n_words")).alias("best")
    out = _found(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.start_word", "best.n_words", "best.edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; other rows of their ids stay."""
    row, hash_ = new_name(docs, "_row"), new_name(docs, "_hash")
    hits = materialize(_found(docs, benchmark).select(F.col("doc_id").alias(row), F.col("th").alias(hash_)).distinct(), "decon-hits")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(row)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hash_))
    return docs.join(broadcast_if_small(hits), same, "left_anti").select(*docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
