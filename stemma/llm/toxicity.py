"""Toxicity by weak supervision.

Many voters look at a text: lexicons written by hand, patterns, and lexicons
mined from labelled rows (words and word beginnings that are far more common in
toxic rows than chance allows, dealt over several voters). A generative model of
the votes, fitted by EM, has a hidden label, each voter's firing rate under
either label, and a tree of dependences between voters (Chow and Liu's tree on
the conditional mutual information), so that correlated voters do not count
twice. Gold labels take part as one more voter of known accuracy. A linear
classifier is then trained on the posterior labels and scores all texts.

Fitting uses a bounded sample, ``SAMPLE`` labelled rows of either class taken in
hash order, of those whose remainder allows it; scoring covers every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_texts, table

#: At most so many toxic and so many other rows are used to fit.
SAMPLE = {1: 2000, 0: 4000}
THRESHOLD = 0.7
GOLD_ACCURACY = 0.98
PREFIXES = (4, 5, 6, 7, 8)
MINED_VOTERS = 5
#: Labelled texts of more bytes are not fitted on, so that at most sum(SAMPLE) times as many come to the driver.
SAMPLE_BYTES = 65_536

_SPLIT = bytes(32 if c < 48 or 58 <= c < 97 or 123 <= c < 128 else c for c in range(256))

LEXICONS = {
    "insult_en": "idiot idiots moron morons stupid loser losers dumb dumbass fool imbecile cretin clown pathetic worthless scum trash disgusting jerk dimwit halfwit",
    "profanity_en": "fuck fucking fucker motherfucker shit shitty bullshit bitch bastard asshole arsehole crap cunt dick prick piss wanker twat",
    "threat_en": "kill murder strangle stab lynch hang rape slaughter exterminate",
    "hate_en": "vermin subhuman parasite parasites filth degenerate degenerates savages inferior cockroach cockroaches",
    "insult_de": "arschloch idiot vollidiot dummkopf trottel schwachkopf abschaum hurensohn wichser scheisse scheiße blödmann drecksack missgeburt",
    "insult_fr": "connard connasse salope putain merde imbécile crétin débile enculé abruti ordure bâtard salaud",
    "insult_es": "idiota imbécil estúpido estúpida pendejo cabrón puta mierda gilipollas basura maldito asqueroso inútil",
}
PATTERNS = {
    "you_are": re.compile(rb"\byou(?: are|'re|r)? (?:a |an |such a |so )?(?:\w+ )?(?:idiot|moron|stupid|loser|fool|pathetic|worthless|scum|trash|clown|disgusting)"),
    "censored": re.compile(rb"\b[fsbcd](?:[*@#$]{2,}|[*@#$]+[a-z])[a-z]*"),
    "command": re.compile(rb"\b(?:shut up|go to hell|drop dead|get lost|screw you|kill yourself)\b"),
    "shouting": re.compile(rb"(?:\b[A-Z]{3,}\b[ ,]+){4,}.*!{2,}"),
}
_HAND = {name: frozenset(words.encode().split()) for name, words in LEXICONS.items()}


def features(text: str | None) -> set[bytes]:
    """Words of the lower-cased text, their beginnings (bytes) marked by a caret, and beginnings of two different words by two."""
    words = set((text or "").lower().encode().translate(_SPLIT).split())
    out = set(words)
    for n in PREFIXES:
        starts = sorted([w[:n] for w in words if len(w) > n])
        out.update([b"^" + w for w in starts])
        out.update([b"^^" + a for a, b in zip(starts, starts[1:]) if a == b])
    return out


def pattern_votes(text: str | None) -> list[str]:
    raw = (text or "").encode()
    lower = raw.lower()
    out = []
    if b"you" in lower and PATTERNS["you_are"].search(lower):
        out.append("you_are")
    if (b"*" in raw or b"@" in raw or b"$" in raw) and PATTERNS["censored"].search(lower):
        out.append("censored")
    if any(k in lower for k in (b"shut up", b"go to hell", b"drop dead", b"get lost", b"screw you", b"kill yourself")):
        out.append("command")
    if b"!!" in raw and PATTERNS["shouting"].search(raw):
        out.append("shouting")
    return out


def _excess(a: int, b: int, share: float) -> float:
    """Upper bound of log P(at least a of a + b rows are toxic) by chance (Chernoff)."""
    n, p = a + b, a / (a + b)
    if p <= share:
        return 0.0
    rest = (1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0
    return -n * (p * math.log(p / share) + rest)


def mine(texts: list, gold: np.ndarray, rate: float = 1.0) -> list[bytes]:
    """Features that are commoner in toxic rows than chance allows, over all features tried; best first.

    Only features of three or more toxic rows are counted in the others, so that
    memory follows the toxic rows' vocabulary. ``rate`` is how many times a row of
    the others stands for as many rows as a toxic one; chance is that of the sample.
    """
    share = float(gold.mean()) if len(gold) else 0.0
    if not 0 < share < 1:
        return []
    toxic: Counter = Counter()
    for t, y in zip(texts, gold):
        if y:
            toxic.update(features(t))
    tried = max(1, len(toxic))
    toxic = Counter({f: n for f, n in toxic.items() if n >= 3})
    clean: Counter = Counter()
    for t, y in zip(texts, gold):
        if not y:
            clean.update(toxic.keys() & features(t))
    cut, n_clean = math.log(0.01 / tried), max(1, int((gold == 0).sum()))
    scored = [(_excess(a, clean[f], share), f) for f, a in toxic.items() if clean[f] <= min(0.1 * a / rate, 0.01 * n_clean)]
    return [f for s, f in sorted(scored) if s < cut]


@dataclass
class LabelModel:
    """Firing rates of voters given the label and, for all but roots, another voter's vote."""

    prior: float = 0.1
    parent: list[int] = field(default_factory=list)
    rate: np.ndarray | None = None  # [label, parent's vote, voter]

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for i, p in enumerate(self.parent):
            seen = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            one, zero = self.rate[1, seen, i], self.rate[0, seen, i]
            out += np.where(votes[:, i] == 1, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return out

    def _estimate(self, votes: np.ndarray, post: np.ndarray, weights: np.ndarray) -> None:
        self.prior = float(np.clip(np.average(post, weights=weights), 1e-3, 1 - 1e-3))
        m = votes.shape[1]
        self.rate = np.empty((2, 2, m))
        for i in range(m):
            seen = votes[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(votes), int)
            for y, w in ((0, weights * (1 - post)), (1, weights * post)):
                for v in (0, 1):
                    k = w * (seen == v)
                    guess = 0.01 if y == 0 else 0.2
                    self.rate[y, v, i] = (k @ votes[:, i] + 2 * guess) / (k.sum() + 2)
        self.rate = np.clip(self.rate, 1e-4, 1 - 1e-4)

    def fit(self, votes: np.ndarray, gold: np.ndarray, rounds: int = 12, weights: np.ndarray | None = None) -> np.ndarray:
        """Posterior probability of the label for each row; weights say how many rows each stands for."""
        weights = np.ones(len(gold)) if weights is None else weights * (len(gold) / weights.sum())
        anchor = np.where(gold == 1, 1, -1) * math.log(GOLD_ACCURACY / (1 - GOLD_ACCURACY))
        post = 1 / (1 + np.exp(-anchor))
        # Dependences come first: taken as independent, voters that agree would outweigh the gold labels.
        self.parent = dependence_tree(votes, post)
        for _ in range(rounds):
            self._estimate(votes, post, weights)
            post = 1 / (1 + np.exp(-np.clip(self.log_odds(votes) + anchor, -40, 40)))
        return post


def dependence_tree(votes: np.ndarray, post: np.ndarray, least: float = 0.002) -> list[int]:
    """Parent of each voter in the maximum spanning forest of conditional mutual information."""
    n, m = votes.shape
    total = np.zeros((m, m))
    v = votes.astype(float)
    for w in (post, 1 - post):
        mass = w.sum()
        if mass < 5:
            continue
        both = (v * w[:, None]).T @ v + 0.05
        one = np.diag(both)
        cells = {(1, 1): both, (1, 0): one[:, None] - both + 0.05, (0, 1): one[None, :] - both + 0.05, (0, 0): mass - one[:, None] - one[None, :] + both + 0.05}
        share = one / mass
        for (a, b), c in cells.items():
            pa, pb = (share if a else 1 - share)[:, None], (share if b else 1 - share)[None, :]
            q = np.maximum(c, 1e-9) / mass
            total += mass / n * q * np.log(q / np.maximum(pa * pb, 1e-12))
    parent, placed = [-1] * m, set()
    for root in range(m):
        if root in placed:
            continue
        placed.add(root)
        while True:
            options = [(total[i, j], i, j) for i in placed for j in range(m) if j not in placed and total[i, j] > least]
            if not options:
                break
            _, i, j = max(options)
            parent[j] = i
            placed.add(j)
    return parent


@dataclass
class Model:
    weights: dict[bytes, float]
    votes: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text)
        z = self.bias + sum(self.weights[f] for f in self.weights.keys() & found)
        for name, words in _HAND.items():
            if not words.isdisjoint(found):
                z += self.votes.get(name, 0.0)
        for name in pattern_votes(text):
            z += self.votes.get(name, 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def default_model() -> Model:
    """What holds without usable labels: a hit of any hand-written voter is taken as toxic."""
    strong = math.log(THRESHOLD / (1 - THRESHOLD)) + 1
    return Model({}, {name: strong + 3 for name in [*_HAND, *PATTERNS]}, -3.0)


def fit(texts: list, gold: np.ndarray, weights: np.ndarray | None = None) -> Model:
    """Fit voters, label model and classifier on labelled texts; weights, the same within a label, say how many rows each stands for."""
    if len(gold) < 20 or not 0 < gold.sum() < len(gold):
        return default_model()
    stands = np.ones(len(gold)) if weights is None else weights
    mined = mine(texts, gold, float(stands[gold == 0][0] / stands[gold == 1][0]))
    hand = list(_HAND)
    own = sorted(set(mined) | set().union(*_HAND.values()))
    index = {f: k for k, f in enumerate(own)}
    found = [index.keys() & features(t) for t in texts]
    lexicons = [_HAND[h] for h in hand] + [frozenset(mined[k::MINED_VOTERS]) for k in range(MINED_VOTERS)]
    votes = np.zeros((len(texts), len(lexicons) + len(PATTERNS)), int)
    names = list(PATTERNS)
    for r, (f, t) in enumerate(zip(found, texts)):
        for k, words in enumerate(lexicons):
            votes[r, k] = not words.isdisjoint(f)
        for name in pattern_votes(t):
            votes[r, len(lexicons) + names.index(name)] = 1
    post = LabelModel().fit(votes, gold, weights=stands)
    x = np.zeros((len(texts), len(own) + len(hand) + len(names)), np.float32)
    for r, f in enumerate(found):
        x[r, [index[w] for w in f]] = 1
    x[:, len(own) : len(own) + len(hand)] = votes[:, : len(hand)]
    x[:, len(own) + len(hand) :] = votes[:, len(lexicons) :]
    weights, bias = logistic(x, post)
    z = x @ weights + bias
    shift = best_cut(z, gold, stands) - math.log(THRESHOLD / (1 - THRESHOLD))
    plain = {f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 1e-6}
    return Model(plain, {n: float(weights[len(own) + k]) for k, n in enumerate([*hand, *names])}, float(bias - shift))


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear classifier on soft labels, both classes weighted alike, by accelerated gradient steps."""
    one, zero = target.sum(), (1 - target).sum()
    w = target / max(one, 1e-9) + (1 - target) / max(zero, 1e-9)
    w /= w.sum()
    step = 4.0 / (1 + float((x * x).sum(axis=1) @ w))
    beta, bias = np.zeros(x.shape[1], np.float32), 0.0
    ahead, ahead_bias = beta, bias
    for t in range(1, steps + 1):
        g = w * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30))) - target)
        new, new_bias = ahead - step * (x.T @ g.astype(np.float32) + ridge * ahead), ahead_bias - step * float(g.sum())
        momentum = (t - 1) / (t + 2)
        ahead, ahead_bias = new + momentum * (new - beta), new_bias + momentum * (new_bias - bias)
        beta, bias = new, new_bias
    return beta.astype(float), float(bias)


def best_cut(z: np.ndarray, gold: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The middle of the widest range of cuts with the best F1, of rows that stand for as many as ``weights`` says."""
    weights = np.ones(len(z)) if weights is None else weights
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum((weights * gold)[order])
    f1 = 2 * hits / (np.cumsum(weights[order]) + weights @ gold)
    z = z[order]
    inner = np.append(z[:-1] > z[1:], True)  # a cut lies between different scores
    top = f1[inner].max()
    low = np.append(z[1:], z[-1] - 1)
    best = max((k for k in np.flatnonzero(inner & (f1 >= top - 1e-12))), key=lambda k: z[k] - low[k])
    return float((z[best] + low[best]) / 2)


def remainder(column: str = "doc_id"):
    """What decides whether a row's label may be learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``SAMPLE`` labelled rows with remainder 0 or 2; rows with null ids or labels are left out.

    Where a label has more rows, those picked stand for all of them, so that the
    shares of the labels are the same at every size. An id stands for one row: of
    several texts that of least hash, of both labels toxic; texts of more than
    ``SAMPLE_BYTES`` bytes are not fitted on.
    """
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(remainder() != 1)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {int(r.toxic): r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y, most in SAMPLE.items():
        rows = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = rows if picked is None else picked.unionAll(rows)
    # At most sum(SAMPLE) ids are broadcast, and as many texts, each of bounded size, come to the driver.
    text = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    found = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = found.select("doc_id", "text", "toxic").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))), key=lambda r: (r[0], r[2], r[1] or ""))
    stands = {y: max(1.0, total.get(y, 0) / most) for y, most in SAMPLE.items()}
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], int), np.array([stands[r[2]] for r in rows]))


SCORES = "doc_id long, score double"


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score; null and empty texts get the score of a text without features."""

    def score(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "score": [model.score(t) for t in texts]}

    return map_texts(docs, score, SCORES)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more."""
    return filter_texts(docs, lambda texts: [model.score(t) < THRESHOLD for t in texts])


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
