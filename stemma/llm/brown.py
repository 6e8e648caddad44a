"""Language-model scores by a class-based bigram model.

Training counts every token of every training text. Every word that stands
``LEAST_COUNT`` times or more gets a class of its own by Brown clustering, however
many there are; rarer words are pooled by form (length, last two bytes, digits),
and a form has a class. Exchange goes in two steps:

- seeds: the ``TOP`` most frequent words, the end of a text and the forms of all
  other words. Their transition counts fit the driver, which moves each to the
  class that raises the class-bigram likelihood most, until a sweep moves none.
- all other frequent words: Spark counts, for each, the seeds' classes before and
  after it, and each word moves to the class that raises the likelihood of these
  counts most. All move at once, later by turns, and a sweep that doesn't raise
  the likelihood is undone. Words and their counts stay in Spark.

A token's probability mixes the class model, P(class | class of the seed before)
P(word | class), with smoothed word frequencies. Texts and the counts and classes
of the words they have meet in chunks of rows, whose number follows the corpus.
Words travel as lists, one for each group of words (by their CRC) that a task holds.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain, count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow, discard, materialize, slices, small_batches, table
from .decontaminate import Sieve, make_sieve

TOP, CLASSES, SWEEPS = 600, 64, 8
LENGTHS, TAILS = 2, 150
FORMS = LENGTHS * TAILS * 2
END = FORMS + TOP
UNITS = END + 1
#: Occurrences from which a word is clustered by itself, and sweeps over such words.
LEAST_COUNT, WORD_SWEEPS = 100, 3
#: Events (a word beside a context) that a task holds before it counts them and passes the counts on, and words of a group that adds them up.
HELD_EVENTS, GROUP_WORDS = 12_000_000, 20_000
#: Context counts of the words that a sweep weighs at once, each against all classes.
SWEEP_EVENTS = 1 << 14
#: Weight of the class model in the mixture.
SHARE = 0.95
#: Training tokens that make one more chunk of documents.
CHUNK_TOKENS, LEAST_CHUNKS = 2_000_000, 64
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 400_000
#: Bytes of text for each group of words that is counted in one go.
COUNT_BYTES = 8 << 20
#: Known words of a group that is looked up, and chunks that ask one group.
LOOK_UP_WORDS, LOOK_UP_CHUNKS = 100_000, 8
#: Different words that a worker keeps numbers of.
KEPT_WORDS = 800_000
#: The end of a text as a word; no word is white space.
END_WORD = b"\n"

_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_DIGITS = frozenset(b"0123456789")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def form(word: bytes) -> int:
    """The unit of a word that isn't among the most frequent."""
    digit = not _DIGITS.isdisjoint(word)
    return (min(LENGTHS - 1, len(word) // 7) * TAILS + int.from_bytes(word.rstrip(b".,;:!?")[-2:]) % TAILS) * 2 + digit


def _map(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` takes an iterator of column dicts and gives column dicts."""
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches):
        parts = ({c: p.column(k).to_pylist() for k, c in enumerate(p.schema.names)} for b in batches for p in (slices(b) if "text" in b.schema.names else [b]))
        for out in fn(parts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _group_of(words: list[bytes], groups: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words)) % groups


def _packed(words: list[bytes], groups: int, **others) -> pa.RecordBatch:
    """A row for each group with its words, and what ``others`` has for them, as lists."""
    group = _group_of(words, groups)
    order = np.argsort(group, kind="stable")
    present, cut = np.unique(group[order], return_index=True)
    offsets, take = pa.array(np.append(cut, len(words)), pa.int32()), pa.array(order)
    lists = {"words": pa.array(words, pa.binary()), **others}
    return pa.RecordBatch.from_pydict({"g": pa.array(present, pa.int32())} | {c: pa.ListArray.from_arrays(offsets, v.take(take)) for c, v in lists.items()})


def _count_words(groups: int):
    def emit(counts: Counter) -> pa.RecordBatch:
        return _packed(list(counts), groups, n=pa.array(counts.values(), pa.int64()))

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    counts.update(words_of(text))
                    counts[END_WORD] += 1
                if len(counts) > HELD_WORDS:
                    yield emit(counts)
                    counts = Counter()
        if counts:
            yield emit(counts)

    return run


def _sum_counts(table_: pa.Table) -> pa.Table:
    """One row for each word of a group, with the sum of its counts."""
    flat = pa.table({"word": table_["words"].combine_chunks().flatten(), "c": table_["n"].combine_chunks().flatten()})
    return flat.group_by("word").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])


def _unit_map(top: list[bytes]) -> dict[bytes, int]:
    return {w: FORMS + k for k, w in enumerate(top)} | {END_WORD: END}


class _Units(dict):
    """The unit of each word; forms are found at the first question."""

    def __missing__(self, word: bytes) -> int:
        self[word] = unit = form(word)
        return unit


def _with_ends(cut: list[list[bytes]], number, end: int) -> np.ndarray:
    """The numbers of all words, with that of an end before the first text and after each."""
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    out = np.full(lengths.sum() + len(cut) + 1, end, np.int64)
    at = np.ones(len(out), bool)
    at[0] = False
    at[np.cumsum(lengths + 1)] = False
    out[at] = np.fromiter(map(number, chain.from_iterable(cut)), np.int64, lengths.sum())
    return out


def _count_pairs(top: list[bytes]):
    known = _unit_map(top)

    def run(parts):
        total = np.zeros(UNITS * UNITS, np.int64)
        units = _Units(known)
        for cols in parts:
            if len(units) > KEPT_WORDS:
                units = _Units(known)
            seen = _with_ends([words_of(t) for t in cols["text"]], units.__getitem__, END)
            total += np.bincount(seen[:-1] * UNITS + seen[1:], minlength=UNITS * UNITS)
        at = np.flatnonzero(total)
        if len(at):
            yield {"pair": at, "n": total[at]}

    return run


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, by exchange moves on the class-bigram likelihood.

    Starts from units dealt by frequency. The likelihood is the sum of n log n
    over class pairs, less that over classes before and after.
    """
    units = len(pairs)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    classes = min(classes, units)
    of = np.empty(units, np.int64)
    of[order] = np.minimum(np.arange(units), classes - 1) if units <= classes else np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1

    def xlog(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    table_ = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        out_to, in_from = pairs @ member, (pairs.T @ member)  # unit -> class counts, class -> unit counts
        for u in order:
            if not total[u]:
                continue
            old, to, came, own = of[u], out_to[u].copy(), in_from[u].copy(), pairs[u, u]
            rest = table_.copy()
            rest[old, :] -= to
            rest[:, old] -= came
            rest[old, old] += own  # taken off twice
            to[old] -= own
            came[old] -= own
            # gain of putting u in each class k, on top of the table without u
            # what others have to and from u stays in their sums wherever u goes
            rows, cols = rest.sum(axis=1) + came, rest.sum(axis=0) + to
            plain = xlog(rest)
            gain = (xlog(rest + to[None, :]) - plain).sum(axis=1) + (xlog(rest + came[:, None]) - plain).sum(axis=0)
            d = np.arange(classes)
            diag = rest[d, d]
            gain += xlog(diag + to + came + own) - xlog(diag + to) - xlog(diag + came) + plain[d, d]
            n_to, n_came = to.sum() + own, came.sum() + own
            gain -= xlog(rows + n_to) - xlog(rows) + xlog(cols + n_came) - xlog(cols)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table_ = rest
            table_[new, :] += to
            table_[:, new] += came
            table_[new, new] += own
            if new != old:
                moved += 1
                of[u] = new
                member[u, old], member[u, new] = 0, 1
                out_to[:, old] -= pairs[:, u]
                out_to[:, new] += pairs[:, u]
                in_from[:, old] -= pairs[u, :]
                in_from[:, new] += pairs[u, :]
        if not moved:
            break
    return of


class _Numbers:
    """Words of slices as numbers, with the class as context and the target of each number.

    Targets are forms, the end, and from END_TARGET + 1 on words that are clustered themselves.
    """

    def __init__(self, context: dict[bytes, int], form_class: np.ndarray, sieve: Sieve):
        self.context, self.form_class, self.sieve = context, form_class, sieve
        self.forget()

    def forget(self) -> None:
        self.number = defaultdict(count().__next__)  # a new word gets the next number
        self.number[END_WORD]
        self.words: list[bytes] = []
        self.ctx, self.target = np.array([self.context[END_WORD]]), np.array([FORMS])

    def flat(self, texts: list) -> np.ndarray:
        """The words of the texts, an end before the first and after each."""
        old = len(self.number)
        flat = _with_ends([words_of(t) for t in texts], self.number.__getitem__, 0)
        new = list(islice(reversed(self.number), len(self.number) - old))[::-1]
        forms = np.fromiter(map(form, new), np.int64, len(new))
        ctx = np.fromiter((self.context.get(w, -1) for w in new), np.int64, len(new))
        often = self.sieve.has(word_keys(new))
        target = np.where(often, FORMS + 1 + len(self.words) + np.cumsum(often) - 1, forms)
        self.words += [w for w, x in zip(new, often.tolist()) if x]
        self.ctx = np.concatenate([self.ctx, np.where(ctx >= 0, ctx, self.form_class[forms])])
        self.target = np.concatenate([self.target, target])
        return flat


def word_keys(words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for these words."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)


def _target_name(t: int, words: list[bytes]) -> bytes:
    return words[t - FORMS - 1] if t > FORMS else END_WORD if t == FORMS else b"\n%d" % t


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, where each begins, and how often it stands."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[begin], begin, np.diff(np.append(begin, len(values)))


EVENTS = "g int, words array<binary>, sizes array<int>, at array<smallint>, n array<int>"


def _contexts(context: dict[bytes, int], form_class: np.ndarray, held, groups: int):
    """For each group of targets its words, and for each how often each class stood before (at < CLASSES) and after it; ``sizes`` cuts the lists."""

    def emit(events: list[np.ndarray], words: list[bytes]) -> pa.RecordBatch:
        every = np.concatenate(events)
        events.clear()  # not held beside their sorted copy
        every.sort()
        every, _, n = _runs(every)
        target, at = np.divmod(every, 2 * CLASSES)
        used, begin, sizes = _runs(target)
        names = [_target_name(t, words) for t in used.tolist()]
        group = word_keys(names).view(np.int64) % groups
        order = np.argsort(group, kind="stable")
        present, cut = np.unique(group[order], return_index=True)
        lengths = sizes[order]
        take = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin[order], lengths)
        by_word = pa.array(np.append(cut, len(order)), pa.int32())
        by_event = pa.array(np.append(0, np.cumsum(lengths))[np.append(cut, len(order))], pa.int32())
        lists = [pa.ListArray.from_arrays(by_word, pa.array([names[k] for k in order.tolist()], pa.binary())), pa.ListArray.from_arrays(by_word, pa.array(lengths, pa.int32()))]
        lists += [pa.ListArray.from_arrays(by_event, pa.array(v[take], k)) for v, k in ((at, pa.int16()), (n, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), *lists], names=["g", "words", "sizes", "at", "n"])

    def run(batches):
        numbers, events = _Numbers(context, form_class, held.value), []
        for batch in batches:
            for part in slices(batch):
                flat = numbers.flat(part.column(0).to_pylist())
                ctx, target = numbers.ctx[flat], numbers.target[flat] * (2 * CLASSES)
                events += [(target[1:] + ctx[:-1]).astype(np.int32), (target[:-1] + CLASSES + ctx[1:]).astype(np.int32)]
                if sum(map(len, events)) > HELD_EVENTS or len(numbers.number) > KEPT_WORDS:
                    yield emit(events, numbers.words)
                    numbers.forget()
                    events = []
        if events:
            yield emit(events, numbers.words)

    return run


def _add_up(table_: pa.Table) -> pa.Table:
    """One row for each word of a group: the sums of its context counts."""
    flat = {c: table_[c].combine_chunks().flatten() for c in ("words", "sizes", "at", "n")}
    words = flat["words"].dictionary_encode()
    row = np.repeat(words.indices.to_numpy(zero_copy_only=False), flat["sizes"].to_numpy(zero_copy_only=False))
    key = row.astype(np.int64) * (2 * CLASSES) + flat["at"].to_numpy(zero_copy_only=False)
    dense = np.bincount(key, flat["n"].to_numpy(zero_copy_only=False))  # some GROUP_WORDS x 2 CLASSES
    seen = np.flatnonzero(dense)
    sums = dense[seen].astype(np.int64)
    offsets = pa.array(np.searchsorted(seen // (2 * CLASSES), np.arange(len(words.dictionary) + 1)), pa.int32())
    made = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((seen % (2 * CLASSES), pa.int16()), (sums, pa.int64()))]
    return pa.table([words.dictionary, *made], names=["word", "at", "n"])


def _begin(known: dict[bytes, int]):
    """Sums of a group with the first classes, in one step: another one behind it would keep a second worker for each task."""

    def run(table_: pa.Table) -> pa.Table:
        out = _add_up(table_)
        of = pa.array([known.get(w, -1) for w in out["word"].to_pylist()], pa.int32())
        return out.append_column("class", of).append_column("fixed", pc.greater_equal(of, 0))

    return run


def _xlog(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def context_likelihood(totals: np.ndarray) -> float:
    """Log likelihood of the classes before and after all tokens, but for a constant; totals has a row for each context and a column for each class."""
    return float(_xlog(totals).sum() - _xlog(totals[:CLASSES].sum(axis=0)).sum() - _xlog(totals[CLASSES:].sum(axis=0)).sum())


def best_classes(totals: np.ndarray, at: np.ndarray, n: np.ndarray, starts: np.ndarray, now: np.ndarray) -> np.ndarray:
    """For each word (its counts n at contexts ``at``, from ``starts`` on) the class where the likelihood gains most; -1 in ``now`` for none yet."""
    word = np.repeat(np.arange(len(now)), np.diff(np.append(starts, len(at))))
    n = n.astype(float)
    own = np.flatnonzero(now[word] >= 0)  # counts that are in the totals of their word's class
    in_own = at[own], now[word][own]
    with_, without = totals[at] + n[:, None], _xlog(totals)[at]
    with_[own, in_own[1]] = totals[in_own]
    without[own, in_own[1]] = _xlog(totals[in_own] - n[own])
    gain = np.add.reduceat(with_ * np.log(with_) - without, starts, axis=0)
    mine = now[:, None] == np.arange(CLASSES)[None, :]
    for side, all_ in ((at < CLASSES, totals[:CLASSES].sum(axis=0)), (at >= CLASSES, totals[CLASSES:].sum(axis=0))):
        count = np.bincount(word, np.where(side, n, 0), len(now))[:, None]
        others = all_[None, :] - np.where(mine, count, 0)
        gain -= _xlog(others + count) - _xlog(others)
    best = gain.argmax(axis=1)
    stay = (now >= 0) & (gain[np.arange(len(now)), best] <= gain[np.arange(len(now)), np.maximum(now, 0)] + 1e-9)
    return np.where(stay, now, best)


def _blocks(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of words that have at most so many counts together, or one word."""
    ends, out, start = np.cumsum(lengths), [], 0
    while start < len(lengths):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        out.append((start, stop := max(stop, start + 1)))
        start = stop
    return out


def _sweep(vectors: DataFrame, totals: np.ndarray, turn: int | None) -> DataFrame:
    """``vectors`` with new classes; with a turn, only words of that parity move, and fixed ones never."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, fixed = batch.column(0).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False)
            at, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            now = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.append(0, np.cumsum(lengths))
            parts = [(slice(a, b), slice(begin[a], begin[b])) for a, b in _blocks(lengths, SWEEP_EVENTS)]
            new = np.concatenate([best_classes(totals, at[e], n[e], begin[w] - begin[w.start], now[w]) for w, e in parts])
            still = fixed if turn is None else fixed | ((word_keys(words) & np.uint64(1)).astype(int) != turn % 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(still, now, new), pa.int32()), batch.column(4)], names=batch.schema.names)

    small_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, VECTORS)


VECTORS = "word binary, at array<smallint>, n array<bigint>, class int, fixed boolean"


def _totals(vectors: DataFrame) -> np.ndarray:
    """Counts of each context (row) and class (column) over all words that have a class; at most 2 CLASSES ** 2 rows come to the driver."""
    out = np.zeros((2 * CLASSES, CLASSES))
    pairs = vectors.where("class >= 0").select("class", F.explode(F.arrays_zip("at", "n")).alias("e"))
    for r in pairs.groupBy("class", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n")).collect():
        out[r["at"], r["class"]] = r.n
    return out


@dataclass
class ClassModel:
    context: dict[bytes, int]  # class of each seed word and the end
    form_class: np.ndarray  # class of each form
    step: np.ndarray  # P(class | class of the seed before)
    size: np.ndarray  # mass of each class
    tokens: np.ndarray  # training tokens of each form's rare words
    types: np.ndarray  # distinct such words
    n: int
    v: int

    def of_words(self, forms: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of these forms, own classes (-1 for rare words) and training counts: P(word) by frequency, the class, and P(word | class)."""
        plain, of = (counts + 1) / (self.n + self.v + 1), np.where(classes >= 0, classes, self.form_class[forms])
        pooled = (self.tokens[forms] + 0.5) * (counts + 1) / (self.tokens[forms] + self.types[forms] + 1)
        return plain, of, np.where(classes >= 0, counts, pooled) / self.size[of]

    def log10(self, classes: np.ndarray, before: np.ndarray, plain: np.ndarray, within: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens by their classes, the classes of the seeds before them, and ``of_words``."""
        return np.log10(SHARE * self.step[before, classes] * within + (1 - SHARE) * plain)


def make_model(context: dict[bytes, int], form_class: np.ndarray, totals: np.ndarray, tokens: np.ndarray, types: np.ndarray, n: int, v: int) -> ClassModel:
    between = totals[:CLASSES]
    after = between.sum(axis=0)
    back = (after + 0.5) / (after + 0.5).sum()
    kinds = (between > 0).sum(axis=1)  # Witten and Bell's weight of what follows in general
    step = (between + kinds[:, None] * back[None, :] + back[None, :]) / (between.sum(axis=1) + kinds + 1)[:, None]
    return ClassModel(context, form_class, step, after + np.bincount(form_class, minlength=CLASSES) * 0.5, tokens, types, n, v)


def held_out(column: str = "doc_id"):
    """Whether a row is kept from training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) of all tokens, the ends of texts too."""
    small_batches(train.sparkSession)
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = train.select("text").mapInArrow(_count_words(max(LEAST_CHUNKS, size // COUNT_BYTES)), "g int, words array<binary>, n array<bigint>")
    return counted.groupBy("g").applyInArrow(_sum_counts, "word binary, c bigint")


def _described(held, context: dict[bytes, int], form_class: np.ndarray, groups: int):
    """Words and counts with their group, their form, their class as context, and whether they are pooled by form."""

    def run(parts):
        for cols in parts:
            words = [bytes(w) for w in cols["word"]]
            f = np.fromiter(map(form, words), np.int64, len(words))
            ctx = np.fromiter((context.get(w, -1) for w in words), np.int64, len(words))
            rare = ~held.value.has(word_keys(words)) & np.array([w != END_WORD for w in words], bool)
            yield cols | {"g": _group_of(words, groups), "form": f, "ctx": np.where(ctx >= 0, ctx, form_class[f]), "rare": rare}

    return run


def seed_classes(texts: DataFrame, top: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Classes of the seed words and the end, and of the forms, by exchange on their transition counts."""
    pairs = np.zeros(UNITS * UNITS)
    found = _map(texts, _count_pairs(top), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most UNITS ** 2 rows
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    of = exchange(pairs.reshape(UNITS, UNITS))
    return {w: int(of[u]) for w, u in _unit_map(top).items()}, of[:FORMS]


def word_classes(texts: DataFrame, context: dict[bytes, int], form_class: np.ndarray, held, n_often: int) -> tuple[DataFrame, np.ndarray]:
    """(word, class) of all words that are clustered, written, and the final counts of contexts and classes."""
    spark = texts.sparkSession
    small_batches(spark)
    groups = max(64, n_often // GROUP_WORDS)
    seen = texts.mapInArrow(_contexts(context, form_class, held, groups), EVENTS)
    known = {w: c for w, c in context.items()} | {b"\n%d" % f: int(c) for f, c in enumerate(form_class.tolist())}  # at most UNITS words
    vectors = materialize(seen.groupBy("g").applyInArrow(_begin(known), VECTORS), "brown-vectors")
    totals = _totals(vectors)
    best = -math.inf
    for k in range(WORD_SWEEPS):
        moved = materialize(_sweep(vectors, totals, k if k else None), "brown-vectors")
        after = _totals(moved)
        score = context_likelihood(after)
        if score <= best:
            discard(moved)
            break
        discard(vectors)
        vectors, totals, best = moved, after, score
    out = materialize(vectors.select("word", "class"), "brown-classes")
    discard(vectors)
    return out, totals


def train(docs: DataFrame) -> tuple[DataFrame, ClassModel]:
    """All training words with c, group, form, ctx, rare and class, written in the shared folder (class is null for rare words), and the model; from rows that are not held out."""
    texts = docs.where(~held_out()).select("text")
    counts = materialize(count_words(texts), "brown-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    best = counts.where(F.col("word") != F.lit(END_WORD)).orderBy(F.desc("c"), "word").limit(TOP).collect()
    top = [bytes(r.word) for r in best]
    often = counts.where((F.col("c") >= LEAST_COUNT) | F.col("word").isin(top)).where(F.col("word") != F.lit(END_WORD))
    held = docs.sparkSession.sparkContext.broadcast(make_sieve(often.select(F.xxhash64("word").alias("x")), 2))
    context, form_class = seed_classes(texts, top)
    classes, totals = word_classes(texts, context, form_class, held, often.count())
    told = _map(counts, _described(held, context, form_class, _look_up_groups(n, v)), "word binary, c long, g int, form smallint, ctx smallint, rare boolean")
    known = materialize(told.join(classes, "word", "left"), "brown-words")
    tokens, types = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    for r in known.where("rare").groupBy("form").agg(F.sum("c").alias("a"), F.count(F.lit(1)).alias("b")).collect():
        tokens[r.form], types[r.form] = r.a, r.b
    model = make_model(context, form_class, totals, tokens, types, int(n), int(v))
    discard(counts, classes)
    return known, model


def _chunks(tokens: int) -> int:
    return max(LEAST_CHUNKS, tokens // CHUNK_TOKENS)


def _look_up_groups(tokens: int, words: int) -> int:
    return max(LEAST_CHUNKS, words // LOOK_UP_WORDS, _chunks(tokens) // LOOK_UP_CHUNKS)


def _chunk_words(groups: int):
    """The distinct words of a chunk, by group."""

    def run(table_: pa.Table) -> pa.Table:
        found: set[bytes] = {END_WORD}
        for batch in table_.select(["text"]).to_batches(max_chunksize=256):
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
        packed = pa.Table.from_batches([_packed(list(found), groups)])
        return packed.add_column(1, "chunk", pa.array([table_["chunk"][0].as_py()] * packed.num_rows, pa.int32()))

    return run


#: What is told of a word that training has not seen.
UNSEEN = {"c": 0, "class": -1, "form": -1, "ctx": -1}
TOLD = "chunk int, words array<binary>, c array<bigint>, class array<int>, form array<smallint>, ctx array<smallint>"


def _look_up(schema: pa.Schema):
    """For the words of a group, chunk by chunk, what ``known`` has of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        asked = left["words"].combine_chunks()
        flat, offsets = asked.flatten(), np.append(0, np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False)))
        at = pc.index_in(flat, value_set=right["word"].combine_chunks().cast(pa.binary())).fill_null(right.num_rows)
        out = {"chunk": left["chunk"].combine_chunks(), "words": asked}
        for c, unseen in UNSEEN.items():
            values = right[c].combine_chunks().fill_null(unseen)
            told = pa.concat_arrays([values, pa.array([unseen], values.type)]).take(at)
            out[c] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), told)
        return pa.table([out[f.name].cast(f.type) for f in schema], schema=schema)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(model: ClassModel, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in schema})
        words = right["words"].combine_chunks().flatten().to_pylist()
        place = {w: k for k, w in enumerate(words)}
        counts, own, forms, context = (np.array(right[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)) for c in UNSEEN)
        counts, own, forms, context = counts.astype(np.float64), own.astype(np.int64), forms.astype(np.int64), context.astype(np.int64)
        new = np.flatnonzero(forms < 0)  # words that training has not seen
        forms[new] = np.fromiter((form(words[k]) for k in new.tolist()), np.int64, len(new))
        context[new] = model.form_class[forms[new]]
        context[place[END_WORD]] = model.context[END_WORD]
        plain, classes, within = model.of_words(forms, own, counts)
        base, seen = np.log10(plain), counts > 0
        end = place[END_WORD]
        out: dict[str, list] = {f.name: [] for f in schema}
        out["doc_id"], out["held_out"] = left["doc_id"].to_pylist(), left["held_out"].to_pylist()
        for batch in left.select(["text"]).to_batches(max_chunksize=256):
            cut = [words_of(text) for text in batch.column(0).to_pylist()]
            lengths = np.fromiter(map(len, cut), np.int64, len(cut)) + 1
            starts = np.cumsum(lengths) - lengths
            at = _with_ends(cut, place.__getitem__, end)
            token = at[1:]
            mixed = model.log10(classes[token], context[at[:-1]], plain[token], within[token])
            out["n_tokens"] += lengths.tolist()
            for name, values in (("n_known", seen[token].astype(np.int64)), ("base_score", base[token]), ("score", mixed)):
                out[name] += np.add.reduceat(values, starts).tolist()
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema})

    return run


def class_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, repeated ones too, with its log10 probabilities and perplexity.

    Null and empty texts have one token, their end. Without training rows every
    token is unknown. Words of scored texts meet their counts and classes group
    by group, once for each chunk that has them. Rows are dealt over the
    chunks by their place, so that equal rows don't meet in one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, model = train(rows)
    chunks, groups, spark = _chunks(model.n), _look_up_groups(model.n, model.v), docs.sparkSession
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    chunked = rows.select(place.alias("chunk"), "doc_id", held_out().alias("held_out"), "text").repartition(chunks, "chunk")
    words = chunked.groupBy("chunk").applyInArrow(_chunk_words(groups), "g int, chunk int, words array<binary>")
    told = words.groupBy("g").cogroup(known.select("g", "word", *UNSEEN).groupBy("g")).applyInArrow(_look_up(_arrow(spark, TOLD)), TOLD).repartition(chunks, "chunk")
    scored = chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scorer(model, _arrow(spark, SCORES)), SCORES)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.withColumn("train_tokens", F.lit(model.n).cast("long")).withColumn("perplexity", perplexity)


def op7_brown(spark, sf_dir: str) -> DataFrame:
    out = class_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
