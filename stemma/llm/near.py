"""Near-duplicate classes by DartMinHash and banded joining.

A text is the multiset of its runs of five words (lower-cased; ASCII punctuation
separates); shorter texts are one run. A run that stands m times has weight m, so
that weighted Jaccard similarity is that of the multisets.

DartMinHash: the plane of an element's weights and ranks is cut into regions, by
weight at 1, 2, 4 and so on, by rank likewise from a small fraction up. In each
region the element has its own darts, a Poisson number by the region's area, each
with a weight, a rank and one of K coordinates. A text throws the darts of its
elements region by region of rank, keeps those below the element's weight, and
stops when all coordinates are hit; the earliest dart of each is the signature.
Two signatures agree in a coordinate with probability equal to the weighted
similarity, and the work follows the number of elements, not their weights.

Texts that agree on all coordinates of a band are candidates. Copies of one word
sequence are one text here. In a bucket, every text is linked to a pivot, the
bucket's text with the most companions over all its buckets; links are verified
by exact similarity. What stays apart within a clump (texts joined by buckets)
is then compared exactly, block against block, so that no link of a bucket is
lost though no bucket's pairs are written out.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow, broadcast_if_small, discard, materialize, new_name, slices, small_batches, table
from .decontaminate import Sieve, make_sieve, words_of
from .rolling import mix, prefix_sums, window_at

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
#: The first region of the rank axis ends at 2 ** -LAYERS; each later one is as long as all before it.
LAYERS = 8
#: Texts of a clump compared as one block.
BLOCK = 192
CELL_TEXTS = 500


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the runs of five words, with repetitions; of the whole if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(SHINGLE, len(words))
    return np.sort(window_at(prefix_sums(hashes), np.arange(len(words) - size + 1), size))


def units(sorted_shingles: np.ndarray) -> np.ndarray:
    """A hash for each (shingle, occurrence number)."""
    n = len(sorted_shingles)
    if not n:
        return sorted_shingles
    first = np.concatenate([[True], sorted_shingles[1:] != sorted_shingles[:-1]])
    at = np.arange(n)
    occurrence = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.where(occurrence == 0, sorted_shingles, mix(sorted_shingles + occurrence * np.uint64(0x9E3779B97F4A7C15)))


def weights(sorted_shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles and how often each stands."""
    elements, counts = np.unique(sorted_shingles, return_counts=True)
    return elements, counts.astype(float)


def _doubling(k: int, first: float) -> tuple[float, float]:
    """Start and length of the k-th region of an axis."""
    return (0.0, first) if k == 0 else (first * 2.0 ** (k - 1), first * 2.0 ** (k - 1))


@functools.cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson law, up to where they end."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 40))
    return np.cumsum(np.exp(n * math.log(mean) - mean - np.array([math.lgamma(k + 1) for k in n.tolist()])))


_UNIT = 2.0**-64


def _salt(k: int, j: int) -> np.uint64:
    return np.uint64((0xA0761D6478BD642F * (64 * k + j + 1)) & 0xFFFFFFFFFFFFFFFF)


def _throw(elements: np.ndarray, weight: np.ndarray, owner: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, coordinate, rank) of the darts of weighted elements in the k-th region of rank, by regions of weight."""
    start, length = _doubling(k, 2.0**-LAYERS)
    j = 0
    while len(elements):
        low, span = _doubling(j, 1.0)
        seed = mix(elements ^ _salt(k, j))
        count = np.searchsorted(_poisson(span * length), seed * _UNIT, side="right")
        hit = np.flatnonzero(count)
        which = np.repeat(hit, count[hit])
        number = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        dart = mix(seed[which] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        second = mix(dart)
        rank, at = start + length * (dart * _UNIT), low + span * (mix(second) * _UNIT)
        coordinate = (((second >> np.uint64(32)) * np.uint64(K)) >> np.uint64(32)).astype(np.int64)
        kept = at < weight[which]
        yield owner[which[kept]], coordinate[kept], rank[kept]
        above = weight > low + span
        elements, weight, owner = elements[above], weight[above], owner[above]
        j += 1


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each weighted set (elements, positive weights) the earliest rank per coordinate (as its 64 bits), and which sets were empty."""
    sizes = np.array([len(e) for e, _ in sets], int)
    best = np.full((len(sets), K), np.inf)
    open_ = np.flatnonzero(sizes)
    elements = np.concatenate([e for e, _ in sets]) if len(sets) else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if len(sets) else np.empty(0)
    owner = np.repeat(np.arange(len(sets)), sizes)
    k = 0
    while len(open_):
        for o, c, r in _throw(elements, weight, owner, k):
            np.minimum.at(best.ravel(), o * K + c, r)
        k += 1
        full = ~np.isinf(best[open_]).any(axis=1)
        if full.any():
            open_ = open_[~full]
            alive = np.zeros(len(sets), bool)
            alive[open_] = True
            keep = alive[owner]
            elements, weight, owner = elements[keep], weight[keep], owner[keep]
    return best.view(np.uint64), sizes == 0


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band for each row, different between bands."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), BANDS)).copy()
    rows = signature.reshape(len(signature), BANDS, ROWS)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two unit arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _arrow_map(rows: DataFrame, fn, schema: str) -> DataFrame:
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch) if "text" in batch.schema.names else [batch]:
                if part.num_rows:
                    out = fn({c: part.column(k).to_pylist() for k, c in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _sign(cols: dict) -> dict:
    digest: list = []
    bands: list = []
    for at in range(0, len(cols["text"]), 256):
        texts = cols["text"][at : at + 256]
        words = [words_of(t) for t in texts]
        # a text without words is equal to its copies and like nothing else
        digest += [xxhash.xxh3_128_digest(b" ".join(w) if w else b"\0" + t.encode()) if t else None for w, t in zip(words, texts)]
        signature, empty = signatures([weights(shingles(w)) for w in words])
        bands += [None if none else key for key, none in zip(band_keys(signature), empty)]
    return {"row": cols["row"], "th": cols["th"], "digest": digest, "bands": bands}


def _asked_for(rows: DataFrame, sieve: Sieve) -> DataFrame:
    """(row, th, units) of the rows whose text hash is in the sieve."""
    held = rows.sparkSession.sparkContext.broadcast(sieve)
    arrow = _arrow(rows.sparkSession, "row long, th long, units binary")

    def run(batches):
        for batch in batches:
            hashes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in slices(batch.filter(pa.array(held.value.has(hashes)))):
                made = [np.sort(units(shingles(words_of(t)))).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], schema=arrow)

    small_batches(rows.sparkSession)
    return rows.where("row IS NOT NULL").select("row", "th", "text").mapInArrow(run, "row long, th long, units binary")


def _verify(cols: dict) -> dict:
    out: dict[str, list] = {"a": [], "b": []}
    for a, b, x, y in zip(cols["a"], cols["b"], cols["ua"], cols["ub"]):
        if similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY:
            out["a"].append(a)
            out["b"].append(b)
    return out


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right unit array."""
    _, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(x) for x in (*left, *right)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n, out = int(codes.max(initial=-1)) + 1, np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for low in range(0, n, 8192):
        s, e = np.searchsorted(codes, [low, low + 8192])
        grid = np.zeros((len(sizes), 8192), np.float32)
        grid[owner[s:e], codes[s:e] - low] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def links_between(left: list[tuple], right: list[tuple]) -> list[tuple]:
    """(a, b) links that join (node, component, units) of the left to the right, without those that add nothing."""
    if not left or not right:
        return []
    sizes_l, sizes_r = (np.array([len(x[2]) for x in side], float) for side in (left, right))
    both = _overlaps([x[2] for x in left], [x[2] for x in right])
    hit = both / (sizes_l[:, None] + sizes_r[None, :] - both) >= SIMILARITY
    seen, out = _Union(), []
    for i, j in np.argwhere(hit):
        if left[i][0] != right[j][0] and seen.join(left[i][1], right[j][1]):
            out.append((left[i][0], right[j][0]))
    return out


def _block_links(table_: pa.Table) -> pa.Table:
    """Links between components of the clumps in one cell, from the sides that were dealt to it."""
    clumps: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    cols = [table_.column(c).to_pylist() for c in ("clump", "side", "node", "component", "units")]
    for clump, side, node, component, u in zip(*cols):
        clumps[clump][side].append((node, component, np.frombuffer(u, np.uint64)))
    found = [x for rest, all_ in clumps.values() for x in links_between(rest, all_)]
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def components(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(node, component) with the least node of each component, for every node; edges have a and b.

    Each round hooks every node to its least neighbour, follows the hooks to
    their roots, and goes on with the edges between different roots, which are
    far fewer; it ends when there are none.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = materialize(edges.where("a <> b").select(low, high).distinct(), f"{label}-edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionAll(left.selectExpr("b AS a", "a AS b"))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root")), label)
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            after = materialize(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), label)
            settled = after.where("moved").isEmpty()
            discard(up)
            up = after
            if settled:
                break
        of_a, of_b = up.selectExpr("node AS a", "root AS ra"), up.selectExpr("node AS b", "root AS rb")
        ends = left.join(of_a, "a").join(of_b, "b").selectExpr("ra AS a", "rb AS b").where("a <> b")
        rest = materialize(ends.select(low, high).distinct(), f"{label}-edges")
        here = up.select("node", "root")
        if found is not None:
            later = here.selectExpr("node AS root", "root AS above")
            here = found.join(later, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        known, found = found, materialize(here, label)
        discard(left, up, *([] if known is None else [known]))
        left = rest
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _verified(pairs: DataFrame, unit_rows: DataFrame) -> DataFrame:
    left = unit_rows.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    right = unit_rows.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    return _arrow_map(left.join(broadcast_if_small(pairs), "a").join(right, "b").select("a", "b", "ua", "ub"), _verify, "a long, b long")


def _classes(docs: DataFrame, id_col: str) -> DataFrame:
    """(row, th, digest, class_id, one) for every row that has an id: the id and text hash of the row, the digest
    of its words, the least id of its class, and the text hash of the row of that id that stands for the class."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    signed = materialize(_arrow_map(rows, _sign, "row long, th long, digest binary, bands array<long>"), "near-bands")
    # One node for each word sequence, with a number of its own once it is written. What a join reads is
    # written before, so that its hot keys (a digest or bucket of very many texts) can be split at run time.
    known = signed.where("digest IS NOT NULL AND row IS NOT NULL")
    first = F.min(F.struct("row", "th")).alias("first")
    owner = materialize(known.groupBy("digest").agg(first).withColumn("node", F.monotonically_increasing_id()), "near-owners")
    chosen = owner.select("digest", "node", F.col("first.row").alias("row"), F.col("first.th").alias("th"))
    # rows of one id and text hash have the same bands
    alike = known.join(chosen, ["digest", "row", "th"]).groupBy("node").agg(F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    alike = materialize(alike, "near-alike")
    held = materialize(alike.select("node", F.explode("bands").alias("bucket")), "near-buckets")
    sizes = materialize(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    shared = materialize(held.join(sizes, "bucket"), "near-shared")
    discard(held, sizes)
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    ranked = shared.join(fame, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("node")).alias("low"))).alias("top")).select("bucket", (-F.col("top.low")).alias("b"))
    pivots = materialize(pivots, "near-pivots")
    star = materialize(shared.join(pivots, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "near-star")
    discard(shared, pivots)
    inside = materialize(star.select(F.col("a").alias("node")).unionAll(star.select("b")).distinct(), "near-inside")
    wanted = chosen.join(inside, "node").join(alike.select("node", "copies"), "node").select("node", "row", "th", "copies")
    wanted = materialize(wanted, "near-wanted")
    # Texts that aren't asked for stay where they are: a sieve of bounded size tells nearly all of them.
    read = materialize(_asked_for(rows, make_sieve(wanted.select(F.col("th").alias("x")), 1)), "near-read")
    read = read.join(broadcast_if_small(wanted), ["row", "th"])
    # only rows that repeat an id and its text are there more than once
    once = read.where("copies > 1").select("node", "units").dropDuplicates(["node"])
    unit_rows = materialize(read.where("copies = 1").select("node", "units").unionAll(once), "near-units")
    discard(alike)
    links = materialize(_verified(star, unit_rows), "near-links")
    joined = links.unionAll(_links_within(inside, star, links, unit_rows))
    final = materialize(components(inside, joined, "near-final"), "near-final")
    # The least id of a class, and of that id's texts in the class the one of least hash.
    of = chosen.join(final, "node", "left").select("digest", "row", "th", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min(F.struct("row", "th")).alias("least"))
    named = materialize(of.join(least, "component").select("digest", F.col("least.row").alias("class_id"), F.col("least.th").alias("one")), "near-named")
    discard(star, inside, wanted, unit_rows, links, final)
    alone = signed.where("digest IS NULL AND row IS NOT NULL").select("row", "th", "digest", F.col("row").alias("class_id"), F.col("th").alias("one"))
    return known.select("row", "th", "digest").join(named, "digest").select("row", "th", "digest", "class_id", "one").unionAll(alone)


def _links_within(inside: DataFrame, star: DataFrame, links: DataFrame, unit_rows: DataFrame) -> DataFrame:
    """Links between texts of a clump that the links to pivots leave apart.

    The texts outside a clump's main component are cut into blocks, and so is the
    whole clump; each block of the former meets each of the latter. A row goes to
    as many cells as the other side has blocks: (texts outside) x (blocks of the
    clump) + (clump) x (blocks of texts outside).
    """
    first = materialize(components(inside, links, "near-first"), "near-first")
    clumps = components(inside, star, "near-clump").select("node", F.col("component").alias("clump"))
    split = first.join(clumps, "node")
    parts = split.groupBy("clump", "component").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("clump").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    about = top.select("clump", F.col("top.component").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("whole"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("outer"))
    torn = materialize(split.join(about, "clump"), "near-torn")
    # Small clumps share a cell, of some CELL_TEXTS texts; a large one is dealt over outer x whole cells.
    shared_cells = max(64, torn.count() // CELL_TEXTS)
    lot = F.when(F.col("whole") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("clump"), F.lit(shared_cells)).cast("string"))).otherwise(F.concat(F.lit("c"), F.col("clump").cast("string")))

    def dealt(rows: DataFrame, side: int, own: str, others: str) -> DataFrame:
        mine, other = F.pmod(F.xxhash64("node"), F.col(own)).cast("string"), F.col("other").cast("string")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return rows.select("clump", "node", "component", F.lit(side).alias("side"), F.concat_ws(":", lot, *([mine, other] if side == 0 else [other, mine])).alias("cell"))

    cells = dealt(torn.where("component <> main"), 0, "outer", "whole").unionAll(dealt(torn, 1, "whole", "outer"))
    cells = cells.join(unit_rows, "node").select("cell", "clump", "side", "node", "component", "units")
    found = materialize(cells.groupBy("cell").applyInArrow(_block_links, "a long, b long"), "near-more")
    discard(torn, first)
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``row`` (the id) and ``class_id``, the least id of its class, for every row of ``docs``.

    Rows are compared, not ids: those of an id with several texts may be of
    several classes, and rows that repeat an id and its text share one. Texts
    without words are of one class with their exact copies; null and empty texts
    are like nothing else, each id a class of its own. A null id gets a null class
    and takes no part.
    """
    without = docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("class_id"))
    return _classes(docs, id_col).select("row", "class_id").unionAll(without)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of its least id, and of that id's texts in the class the one of least hash.

    Rows that repeat this id and text are one: the least by hash of all columns
    stays. Null and empty texts and rows with a null id stay as they are.
    """
    row, hash_ = new_name(docs, "_row"), new_name(docs, "_hash")
    classes = _classes(docs, "doc_id").where("digest IS NOT NULL")
    gone = classes.where("row <> class_id OR th <> one").select(F.col("row").alias(row), F.col("th").alias(hash_)).distinct()
    many = classes.where("row = class_id AND th = one").groupBy("row", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = many.select(F.col("row").alias(row), F.col("th").alias(hash_))
    gone, many = materialize(gone, "near-gone"), materialize(many, "near-many")
    same = (F.col("doc_id").cast("long") == F.col(row)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hash_))
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    if many.isEmpty():
        return kept.select(*docs.columns)
    whole, order = new_name(docs, "_whole"), F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))])
    many = broadcast_if_small(many)
    one = kept.join(many, same).groupBy(row, hash_).agg(F.min_by(F.struct(*docs.columns), order).alias(whole)).select(f"{whole}.*")
    return kept.join(many, same, "left_anti").select(*docs.columns).unionAll(one)


def op10_near(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).withColumnRenamed("row", "doc_id")
