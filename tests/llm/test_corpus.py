"""Repeats, near duplicates, decontamination, toxicity, language model, shards and the pipeline."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import brown, decontaminate, near, queries, repeats, sharding, toxicity

from .conftest import WORDS, prose


def plain_repeats(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_repeats(spark, docs, texts, nothing):
    rows = repeats.repeated_windows(docs).collect()
    wanted = plain_repeats(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256) == wanted[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in itertools.pairwise(r.spans))
    assert any(0 < w[1] < w[0] for w in wanted.values())
    assert repeats.repeated_windows(nothing).count() == 0
    same = [(None, "w " * 60), (None, "w " * 60), (3, "w " * 60), (3, "w " * 60)]
    got = repeats.repeated_windows(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0, 0, 0]


# --- near duplicates -------------------------------------------------------


def multiset(text):
    w = decontaminate.words_of(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain_classes(rows):
    sets = {i: multiset(t) for i, t in rows}
    up = near._Union()
    for i in sets:
        up.find(i)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and weighted(sets[a], sets[b]) >= 0.8:
            up.join(a, b)
    return {i: up.find(i) for i in sets}


def test_near_classes(spark, docs, texts, nothing):
    wanted = plain_classes(texts)
    rows = near.near_classes(docs).collect()
    assert len(rows) == len(texts) and {r.row: r.class_id for r in rows} == wanted
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in texts if wanted[i] == i)
    assert near.near_classes(nothing).count() == 0


def test_a_large_clump_keeps_its_links(spark):
    """A star of edits around a text that is not the first, with edits of edits."""
    rng = random.Random(2)
    center = prose(rng, 200).split()

    def edit(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = rng.choice(WORDS) + str(rng.random())
        return words

    rows = [(k, " ".join(edit(center, 3))) for k in range(80)] + [(500, " ".join(center))]
    rows += [(600 + k, " ".join(edit(rows[k][1].split(), 3))) for k in range(40)]
    wanted = plain_classes(rows)
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.row: r.class_id for r in got.collect()} == wanted


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 40)] + [(500, rng.randrange(400, 600)) for _ in range(80)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(120)] + [(3, 3), (5, 4)]
    up = near._Union()
    for a, b in edges:
        up.join(a, b)
    nodes = spark.range(1000).withColumnRenamed("id", "node")
    got = {r.node: r.component for r in near.components(nodes, spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {k: up.find(k) for k in range(1000)}
    assert near.components(nodes, spark.createDataFrame([], "a long, b long"), "test").where("node <> component").isEmpty()


def test_signatures_estimate_weighted_similarity():
    """Real weights, of less than 1 and of thousands; the work follows the elements."""
    rng = np.random.default_rng(0)
    for share, top in ((0.3, 1.0), (0.6, 3.0), (0.9, 40.0), (0.5, 5000.0)):
        found, true = [], []
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
            w = rng.random(len(a)) ** 3 * top + 0.01
            v = np.where(rng.random(len(a)) < share, w, w * rng.random(len(a)))
            s, empty = near.signatures([(a, w), (a[5:], v[5:]), (a[:0], w[:0])])
            assert empty.tolist() == [False, False, True]
            both, either = np.minimum(w, np.append(np.zeros(5), v[5:])), np.maximum(w, np.append(np.zeros(5), v[5:]))
            found.append((s[0] == s[1]).mean())
            true.append(both.sum() / either.sum())
        assert abs(np.mean(found) - np.mean(true)) < 0.03
    a = np.arange(1, 50, dtype=np.uint64)
    darts = sum(len(o) for k in range(3) for o, _, _ in near._throw(a, np.full(49, 1e4), np.zeros(49, int), k))
    assert 0.8 < darts / (49 * 1e4 * 4 * 2**-near.LAYERS) < 1.2
    one = near.weights(near.shingles(b"a b c d e a b c d e a b c d e".split()))
    assert sorted(one[1].tolist()) == [2.0, 2.0, 2.0, 2.0, 3.0]


def test_ids_with_several_texts_and_copies_without_words(spark):
    rng = random.Random(7)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a, 1), (7, a.upper(), 2), (7, b, 3), (7, b, 3), (7, b, 4), (9, b, 5), (3, "!!!", 6), (4, "!!!", 7), (6, "?", 8), (8, "", 9), (8, "", 9), (10, None, 1), (None, a, 1), (None, a, 1), (7, c, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    for d in (df.repartition(1), df.repartition(5)):
        got = Counter((r.row, r.class_id) for r in near.near_classes(d).collect())
        assert got == Counter([(5, 5), (7, 5), (7, 7), (7, 7), (7, 7), (9, 7), (3, 3), (4, 3), (6, 6), (8, 8), (8, 8), (10, 10), (None, None), (None, None), (7, 7)])
        kept = near.keep_one(d)
        assert kept.columns == df.columns
        left = Counter((r.doc_id, r.text) for r in kept.collect())
        assert left == Counter([(5, a), (7, b), (3, "!!!"), (6, "?"), (8, ""), (8, ""), (10, None), (None, a), (None, a), (7, c)])


def test_a_clump_with_few_outside_makes_few_rows(spark, monkeypatch):
    """The main component of a clump goes to as many cells as the texts outside it have blocks."""
    monkeypatch.setattr(near, "BLOCK", 4)
    deal = near._block_links
    rng = random.Random(2)
    nodes = list(range(100))
    star = spark.createDataFrame([(k, 0) for k in nodes[1:]], "a long, b long")
    links = spark.createDataFrame([(k, 0) for k in nodes[1:98]], "a long, b long")
    units = {k: near.units(near.shingles(prose(rng, 30).encode().split())) for k in nodes}
    units[98] = units[50]
    unit_rows = spark.createDataFrame([(k, bytearray(np.sort(u).tobytes())) for k, u in units.items()], "node long, units binary")
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(near, "_block_links", lambda t: (counted.add(t.num_rows), deal(t))[1])
    found = near._links_within(spark.createDataFrame([(k,) for k in nodes], "node long"), star, links, unit_rows).collect()
    assert {(min(r), max(r)) for r in found} == {(50, 98)}
    assert counted.value == 100 * 1 + 2 * 25


# --- decontamination -------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 70))] for _ in range(2))
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontaminate.edit_distance(masks, len(a), b) == plain_distance(a, b)


def test_contaminated(spark, nothing):
    rng = random.Random(9)
    rare = [f"{a}{b}" for a in "bcdfghjklm" for b in WORDS[:40]]
    items = [(k, " ".join(rng.choice(WORDS if rng.random() < 0.5 else rare) for _ in range(rng.randint(6, 45)))) for k in range(25)]
    rows = []
    for k in range(60):
        words = items[k % 25][1].split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            p = rng.randrange(len(words))
            words[p : p + 1] = rng.choice([[], ["x"], [words[p], "y"]])
        body = " ".join(words).upper() if k % 3 else "! ".join(words)
        rows.append((k, f"{prose(rng, rng.randint(0, 40))} {body} {prose(rng, rng.randint(0, 40))}"))
    rows += [(100 + k, prose(rng, 60)) for k in range(10)] + [(200, None), (201, "")]
    items += [(50, "too short"), (53, "find"), (54, "x y"), (55, "the of and to")]
    rows += [(210, "much Too, short!"), (211, "x y"), (212, "to the of and to"), (213, "too")]
    bench = spark.createDataFrame([(*r, "x") for r in [*items, (51, None), (None, "a b c d e f g"), (52, "")]], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    wanted = plain_passages(rows, items)
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) <= set(wanted)
    assert sum(got.get(k) == v for k, v in wanted.items()) >= 0.95 * len(wanted)  # the target recall
    assert all(k in got for k, v in wanted.items() if v <= 1)
    assert {(210, 50), (211, 54), (212, 55)} <= set(got) and any(j == 53 for _, j in got)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in got} and clean.columns == docs.columns
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def plain_passages(texts, items):
    """The least edits between an item and any passage of a text, where within the bound."""
    out = {}
    for i, t in texts:
        for j, item in items:
            x = decontaminate.words_of(item)
            row = [0] * (len(w := decontaminate.words_of(t)) + 1)
            for k, a in enumerate(x, 1):
                new = [k]
                for m, b in enumerate(w, 1):
                    new.append(min(row[m] + 1, new[-1] + 1, row[m - 1] + (a != b)))
                row = new
            if min(row) <= int(decontaminate.RATE * len(x)):
                out[i, j] = min(row)
    return out


def test_passages_of_any_length(spark, tmp_path):
    rng = random.Random(12)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(rng.randint(10, 45)))) for k in range(30)]
    rows = []
    for k in range(120):
        words = items[k % 30][1].split()
        for _ in range(rng.randint(1, len(words) // 5)):
            p = rng.randrange(len(words))
            words[p : p + 1] = [] if k % 2 else [words[p], f"q{k}"]
        rows.append((k, " ".join(words) if k % 3 == 0 else f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}"))
    rows += [(200 + k, items[k][1].split(" ", 1)[1]) for k in range(30)] + [(300, None), (301, ""), (302, prose(rng, 300))]
    wanted = plain_passages(rows, items)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op8_decontaminate"](spark, str(tmp_path)).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(wanted) and len(found) == len(got)
    assert sum(found.get(k) == v for k, v in wanted.items()) >= 0.95 * len(wanted)  # the target recall
    assert all(found.get((200 + k, k)) == 1 for k in range(30))  # a text that is shorter than its item
    texts, passages = dict(rows), dict(items)
    for r in got:
        passage = decontaminate.words_of(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]
        assert len(passage) == r.n_words and plain_distance(decontaminate.words_of(passages[r.item_id]), passage) == r.edits
    clean = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_the_same_matches_for_any_partitioning_batch_and_repetition(spark, monkeypatch):
    """Ids with several texts, repeated rows, items with several texts, null ids; small batches; sieves that let all pass."""
    rng = random.Random(1)
    items = [(k % 9, prose(rng, 3 + 3 * k)) for k in range(12)] + [(3, "find")]
    rows = [(k % 20, f"{prose(rng, 10)} {items[k % 12][1]} {prose(rng, 10)}" if k % 2 else prose(rng, 50)) for k in range(40)]
    rows += [rows[1], rows[1], (None, items[4][1]), (None, items[5][1]), (None, None)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    place = lambda d: sorted(tuple(-1 if x is None else x for x in r) for r in decontaminate.contaminated(d, bench).collect())
    got = place(docs.repartition(1))
    best = {}
    for (i, j), x in ((k, v) for i, t in rows for (_, j0), v in plain_passages([(i, t)], items).items() for k in [((-1 if i is None else i), j0)]):
        best[i, j] = min(x, best.get((i, j), x))
    assert {(r[0], r[1]): r[4] for r in got} == best and len(got) == len(best)
    monkeypatch.setattr(decontaminate, "RUN_WORDS", 70)
    assert place(docs.repartition(7)) == got
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(decontaminate, "BITS_EACH", 1)
    assert place(docs) == got
    kept = decontaminate.drop_contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t in rows if not plain_passages([(i, t)], items))


def test_recall_by_length(spark):
    """At least 0.9 of the passages at a fifth of edits, for items of each length, by brute force."""
    rng = random.Random(21)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))) for k, n in enumerate([5, 8, 10, 15, 20, 30, 50, 80, 120] * 30)]
    rows = []
    for k, t in items:
        words = t.split()
        for _ in range(len(words) // 5):
            p = rng.randrange(len(words))
            words[p : p + 1] = rng.choice([[], [words[p], f"q{k}"], [f"z{k}"]])
        rows.append((k, f"{prose(rng, 15)} {' '.join(words)} {prose(rng, 15)}"))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id for r in got if r.doc_id == r.item_id}
    for n in sorted({len(t.split()) for _, t in items}):
        mine = [k for k, t in items if len(t.split()) == n and plain_passages([rows[k]], [items[k]])]
        assert len(mine) > 20 and sum(k in found for k in mine) >= 0.9 * len(mine), n


# --- toxicity --------------------------------------------------------------


def labelled(n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(10, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorblak", "zorbling", "vextrod"]))
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, nothing):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, model).collect()}
    assert len(scores) == len(rows) + 2 and all(0 <= s <= 1 for s in scores.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.98
    assert scores[2000] == scores[2001] < 0.7
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.7}
    # labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(docs, turned).weights == model.weights
    bare = toxicity.fit_toxicity(docs, marks.limit(0))
    assert bare.score("you are an idiot") >= 0.7 > bare.score("a fine day")
    assert toxicity.toxicity_scores(nothing, model).count() == 0


def test_repeated_ids_and_long_texts_do_not_grow_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, gold, weights=None: seen.append(texts))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    rows = [(k, f"text {k % 3}{'!' * (j % 4)}", "clash") for k in range(60) for j in range(200)] + [(900, "long " * 1000, "x"), (None, "x", "x")]
    labels = [(k, 1, k % 2) for k in range(60) if k != 5] + [(900, 1, 1), (5, 1, 0), (5, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    for d in (docs, docs.repartition(7)):
        toxicity.fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen[0] == seen[1] and len(seen[0]) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(60)) and max(map(len, seen[0])) < 1000


def test_toxicity_query(spark, tmp_path):
    """The registered query on held-out labels, with repeated rows, nulls and columns that clash."""
    rows, labels = labelled()
    docs = [(*r, 1, "x") for r in rows] + [(3, rows[3][1], 1, "x"), (None, None, 1, "x"), (9000, "the calm of words " * 30000, 1, "x"), (9001, "", 1, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score int, held_out string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    marks = dict((i, t) for i, _, t in labels)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.98 and not any(r.predicted for r in got if r.doc_id in (9000, 9001, None))


def test_sampled_labels_stand_for_all(spark, monkeypatch):
    """The cut, the prior and the mining filter are those of all rows, whatever the sample's shares."""
    rng = np.random.default_rng(4)
    gold = np.repeat([1, 0], [300, 2400])
    z = np.where(gold == 1, rng.normal(1.5, 1, 2700), rng.normal(-1, 1, 2700))
    part = np.concatenate([np.arange(300), 300 + np.arange(0, 2400, 4)])
    weights = np.where(gold == 1, 1.0, 4.0)[part]
    whole, sampled = toxicity.best_cut(z, gold), toxicity.best_cut(z[part], gold[part], weights)
    assert abs(sampled - whole) < 0.25 < whole - toxicity.best_cut(z[part], gold[part])
    model = toxicity.LabelModel()
    model.fit((z[part] > whole).astype(int)[:, None], gold[part], weights=weights)
    assert abs(model.prior - 1 / 9) < 0.03
    texts = ["vextrod mild"] * 60 + ["mild"] * 4 + ["calm"] * 600
    y = np.repeat([1, 0], [60, 604])
    assert b"mild" in toxicity.mine(texts, y) and b"mild" not in toxicity.mine(texts, y, 4.0) and b"vextrod" in toxicity.mine(texts, y, 4.0)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, gold, weights=None: seen.append((gold, weights)))
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 20, 0: 40})
    rows, labels = labelled()
    toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = Counter(t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    assert {y: round(float(seen[0][1][seen[0][0] == y].sum())) for y in (0, 1)} == learned


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(int)
    votes = np.stack([(rng.random(4000) < np.where(y, a, b)).astype(int) for a, b in ((0.9, 0.05), (0.6, 0.02), (0.5, 0.3))], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a voter that repeats another
    gold = np.where(rng.random(4000) < 0.98, y, 1 - y)
    model = toxicity.LabelModel()
    post = model.fit(votes, gold)
    assert ((post > 0.5) == y).mean() > 0.97
    assert model.parent[3] == 0
    assert abs(model.rate[1, 0, 0] - 0.9) < 0.03 and abs(model.rate[0, 0, 0] - 0.05) < 0.03


# --- language model --------------------------------------------------------


def test_class_model(docs, texts, nothing):
    out = brown.class_scores(docs).collect()
    unique = [*dict(texts).items(), (401, "")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in unique}
    counts = Counter()
    for i, t in unique:
        if not held[i]:
            counts.update([*brown.words_of(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    plain = dict(unique)
    assert len(out) == len(unique)
    for r in out:
        tokens = [*brown.words_of(plain[r.doc_id]), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
        assert r.score < 0
    assert brown.class_scores(nothing).count() == 0


def plain_scores(rows, known, model):
    """Scores from the words' classes alone: transitions, class sizes and pools are counted here."""
    own = {w: c for w, _, c in known if c is not None}
    counts = {w: c for w, c, _ in known}
    context = lambda w: model.context.get(w, model.form_class[brown.form(w)])
    of = lambda w: own.get(w, model.form_class[brown.form(w)])
    tokens, types, steps, mass = Counter(), Counter(), Counter(), Counter(model.form_class.tolist())
    mass = Counter({c: k * 0.5 for c, k in mass.items()})
    for w, c in counts.items():
        mass[of(w)] += c
        if w not in own:
            tokens[brown.form(w)] += c
            types[brown.form(w)] += 1
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            words = [b"\n", *brown.words_of(t), b"\n"]
            steps.update((context(a), of(b)) for a, b in zip(words, words[1:]))
    after, total = Counter(), Counter()
    for (a, b), k in steps.items():
        after[b] += k
        total[a] += k
    kinds = Counter(a for a, _ in steps)
    back = lambda c: (after[c] + 0.5) / (sum(after.values()) + 0.5 * brown.CLASSES)
    n, v, out = sum(counts.values()), len(counts), []
    for i, t in rows:
        words, score = [b"\n", *brown.words_of(t), b"\n"], 0.0
        for a, w in zip(words, words[1:]):
            f, c, k = brown.form(w), counts.get(w, 0), context(a)
            step = (steps[k, of(w)] + (kinds[k] + 1) * back(of(w))) / (total[k] + kinds[k] + 1)
            within = (c if w in own else (tokens[f] + 0.5) * (c + 1) / (tokens[f] + types[f] + 1)) / mass[of(w)]
            score += math.log10(brown.SHARE * step * within + (1 - brown.SHARE) * (c + 1) / (n + v + 1))
        out.append((-1 if i is None else i, len(words) - 1, round(score, 6)))
    return sorted(out)


def test_scores_equal_a_plain_version(spark, texts, tmp_path, monkeypatch):
    """The registered query, with repeated rows and null ids; words are clustered beyond the seeds."""
    monkeypatch.setattr(brown, "LEAST_COUNT", 3)
    monkeypatch.setattr(brown, "TOP", 20)
    monkeypatch.setattr(brown, "END", brown.FORMS + 20)
    monkeypatch.setattr(brown, "UNITS", brown.FORMS + 21)
    rows = [*[r for r in texts if r[0] != 404], (7, texts[7][1]), (None, "all alone"), (None, None), (9, "kkkk " * 5 + "jjjj\u3000 x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_brown"](spark, str(tmp_path)).collect()
    known, model = brown.train(docs.select("doc_id", "text"))
    known = [(bytes(r.word), r.c, r["class"]) for r in known.collect()]
    clustered = [w for w, _, c in known if c is not None]
    assert len(clustered) > 60 and all(c is not None for w, k, c in known if k >= 3) and len({c for _, _, c in known if c is not None}) > 10
    want = plain_scores(rows, known, model)
    assert [x[:2] for x in sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in got)] == [x[:2] for x in want]
    for a, b in zip(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 6)) for r in got), want):
        assert abs(a[2] - b[2]) < 1e-4
    for r in got:
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens))


def test_word_sweeps_find_classes_and_raise_the_likelihood():
    """Words of two kinds, told apart by what stands around them, though none is a seed."""
    rng = np.random.default_rng(2)
    near_a, near_b = rng.integers(0, 8, 64), rng.integers(8, 16, 64)
    vectors = []
    for k in range(60):
        side = near_a if k % 2 else near_b
        x = np.bincount(rng.choice(side, 40), minlength=2 * brown.CLASSES) + np.bincount(brown.CLASSES + rng.choice(side, 40), minlength=2 * brown.CLASSES)
        vectors.append(x)
    totals = np.zeros((2 * brown.CLASSES, brown.CLASSES))
    totals[:8, 0], totals[8:16, 1] = 200, 200
    totals[brown.CLASSES : brown.CLASSES + 8, 0], totals[brown.CLASSES + 8 : brown.CLASSES + 16, 1] = 200, 200
    totals[:16, 2:], totals[brown.CLASSES : brown.CLASSES + 16, 2:] = 100, 100  # no class is empty
    at = np.concatenate([np.flatnonzero(x) for x in vectors])
    n = np.concatenate([x[x > 0] for x in vectors])
    lengths = np.array([(x > 0).sum() for x in vectors])
    starts = np.cumsum(lengths) - lengths
    of = brown.best_classes(totals, at, n, starts, np.full(60, -1))
    assert set(of[1::2]) == {0} and set(of[::2]) == {1}
    # one word moved by itself changes the likelihood as the gains say, and never for the worse
    now = rng.integers(0, 4, 60)
    full = lambda c: totals + sum(np.outer(x, np.eye(brown.CLASSES)[k]) for x, k in zip(vectors, c))
    new = brown.best_classes(full(now), at, n, starts, now)
    for k in range(60):
        tried = [brown.context_likelihood(full([*now[:k], c, *now[k + 1 :]])) for c in range(6)]
        moved = brown.context_likelihood(full([*now[:k], new[k], *now[k + 1 :]]))
        assert moved >= max(tried) - 1e-6


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = rng.poisson(rng.random((40, 40)) * 5).astype(float)

    def likelihood(of):
        m = np.eye(int(of.max()) + 1)[of]
        t = m.T @ pairs @ m
        x = lambda a: (a[a > 0] * np.log(a[a > 0])).sum()
        return x(t) - x(t.sum(0)) - x(t.sum(1))

    values = [likelihood(brown.exchange(pairs, 6, k)) for k in range(6)]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(values)) and values[-1] > values[0]


# --- shards ----------------------------------------------------------------


def test_shards(spark, docs, texts, nothing):
    out = sharding.shuffle_into_shards(docs, 16)
    rows = out.collect()
    assert len(rows) == len(texts) and out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(16)) <= 1
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    again = sharding.shuffle_into_shards(docs.repartition(5), 16).collect()
    place = lambda rs: sorted((r.doc_id, r.text or "", r.shard, r.slot) for r in rs)
    assert place(again) == place(rows)
    assert sharding.shuffle_into_shards(nothing, 16).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs, 0)


def test_shards_take_from_everywhere(spark):
    rows = sharding.shuffle_into_shards(spark.range(16000).withColumnRenamed("id", "doc_id"), 16).collect()
    means = [np.mean([r.doc_id for r in rows if r.shard == k]) for k in range(16)]
    assert np.abs(np.array(means) - 8000).max() < 6 * 16000 / math.sqrt(12 * 1000)
    first = np.array([r.doc_id for r in sorted(rows, key=lambda r: r.slot)[:1600]])
    assert abs(first.mean() - 8000) < 6 * 16000 / math.sqrt(12 * 1600)


def test_equal_rows_are_spread(spark, monkeypatch):
    """A row that makes half of a table: no logical partition or bucket gets all of it, and places don't depend on partitioning."""
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    rows = [(7, "same", None)] * 400 + [(None, None, None)] * 100 + [(1000 + k, f"t{k}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    place = lambda d: sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in sharding.shuffle_into_shards(d, 4).collect())
    got = place(df.repartition(3))
    assert got == place(df.repartition(11)) and Counter((i, t) for i, t, _, _ in got) == Counter((i or -1, t or "") for i, t, _ in rows)
    for k in range(4):
        assert sorted(s for _, _, x, s in got if x == k) == list(range(250))
        slots = sorted(s for i, _, x, s in got if x == k and i == 7)
        assert 70 < len(slots) < 130 and slots[-1] - slots[0] > 180
    keyed = sharding._spread(df.withColumn("h", sharding.F.xxhash64("doc_id", "text")), "h", 20)
    assert max(r["count"] for r in keyed.groupBy("h").count().collect()) <= 20


def test_shards_query(spark, texts, tmp_path):
    spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op9_shards(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16 for r in got)


def test_hypergeometric():
    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert abs(sharding.hypergeometric(rng, 10**9, 10**9, 10**9) - 5 * 10**8) < 10**6
    m = sharding.communication_matrix([10, 0, 25, 7], sharding.shard_sizes(42, 5), 1)
    assert [sum(r) for r in m] == [10, 0, 25, 7] and [sum(c) for c in zip(*m)] == [9, 9, 8, 8, 8]


# --- registry and pipeline -------------------------------------------------


def test_registry():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = labelled(400)
    rng = random.Random(8)
    items = [(k, prose(rng, 30)) for k in range(3)]
    rows += [(1000, rows[1][1]), (1001, f"{prose(rng, 20)} {items[0][1]}"), (1002, prose(rng, 40) + " password=abcdef123"), (1003, None), (1004, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1000 not in got and 1001 not in got and 1 in got and 1002 in got and got[1003].n_tokens == got[1004].n_tokens == 0
    clean = [i for i, _ in rows[:400] if i % 5]
    assert sum(i in got for i in clean) >= len(clean) - 2 and sum(i in got for i in range(0, 400, 5)) <= 4
    from stemma.llm.bpe import decode_ids

    text = {r.doc_id: r.text for r in decode_ids(corpus_pipeline.run(spark, str(tmp_path))).collect()}
    assert text[1002].endswith("[secret]") and text[1] == rows[1][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_words_meet_their_counts_group_by_group():
    words, groups = [b"w%d" % k for k in range(500)] + [b"\n", b"", "\u00e9".encode()], 7
    packed = brown._packed(words, groups, n=pa.array(range(len(words)), pa.int64()))
    rows = packed.to_pylist()
    assert sorted(r["g"] for r in rows) == sorted(set(brown._group_of(words, groups).tolist()))
    assert {w: n for r in rows for w, n in zip(r["words"], r["n"])} == {w: n for n, w in enumerate(words)}
    twice = pa.Table.from_batches([packed, packed])
    summed = brown._sum_counts(twice).to_pylist()
    assert {r["word"]: r["c"] for r in summed} == {w: 2 * n for n, w in enumerate(words)} and len(summed) == len(words)

    lists = {"c": pa.list_(pa.int64()), "class": pa.list_(pa.int32()), "form": pa.list_(pa.int16()), "ctx": pa.list_(pa.int16())}
    schema = pa.schema([("chunk", pa.int32()), ("words", pa.list_(pa.binary())), *lists.items()])
    run = brown._look_up(schema)
    left = pa.table({"g": pa.array([1, 1], pa.int32()), "chunk": pa.array([3, 9], pa.int32()), "words": pa.array([[b"a", b"new"], [b"b"]], pa.list_(pa.binary()))})
    columns = {"g": pa.int32(), "word": pa.binary(), "c": pa.int64(), "class": pa.int32(), "form": pa.int16(), "ctx": pa.int16()}
    known = pa.table({c: pa.array(v, t) for (c, t), v in zip(columns.items(), ([1, 1], [b"b", b"a"], [5, 6], [None, 2], [7, 8], [1, 0]))})
    assert run(left, known).to_pylist() == [
        {"chunk": 3, "words": [b"a", b"new"], "c": [6, 0], "class": [2, -1], "form": [8, -1], "ctx": [0, -1]},
        {"chunk": 9, "words": [b"b"], "c": [5], "class": [-1], "form": [7], "ctx": [1]},
    ]
    assert run(left.slice(0, 0), known).num_rows == 0
    assert run(left, known.slice(0, 0)).to_pylist()[1] == {"chunk": 9, "words": [b"b"], "c": [0], "class": [-1], "form": [-1], "ctx": [-1]}


def test_sweep_holds_little_and_changes_nothing(spark):
    import tracemalloc

    class Vectors:  # gives the function that a worker runs
        sparkSession = spark

        def mapInArrow(self, fn, schema):
            return fn

    rng, words, k = np.random.default_rng(3), 1000, 2 * brown.CLASSES
    n, now = rng.integers(1, 500, words * k), rng.integers(-1, brown.CLASSES, words)
    totals = rng.integers(10**6, 10**7, (k, brown.CLASSES)).astype(float)
    at, offsets = np.tile(np.arange(k), words), pa.array(np.arange(words + 1) * k, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((at, pa.int16()), (n, pa.int64()))]
    batch = pa.record_batch([pa.array([b"w%d" % x for x in range(words)]), *lists, pa.array(now, pa.int32()), pa.array([False] * words)], names=["word", "at", "n", "class", "fixed"])
    run = brown._sweep(Vectors(), totals, None)
    tracemalloc.start()
    (moved,) = run([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    assert moved.column(3).to_pylist() == brown.best_classes(totals, at, n, np.arange(words) * k, now).tolist()


def test_first_classes_take_no_second_worker(spark, monkeypatch):
    plans, write = {}, brown.materialize

    def noted(df, label):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(brown, "materialize", noted)
    docs = spark.createDataFrame([(k, "some words stand here") for k in range(20)], "doc_id long, text string")
    known, _ = brown.train(docs)
    assert known.where("NOT rare AND class IS NULL").isEmpty()
    sums = plans["brown-vectors"].index("FlatMapGroupsInArrow")
    assert "MapInArrow" not in plans["brown-vectors"][:sums]


def test_runs_and_blocks():
    values, begin, n = brown._runs(np.array([2, 2, 5, 7, 7, 7], np.int32))
    assert (values.tolist(), begin.tolist(), n.tolist()) == ([2, 5, 7], [0, 2, 3], [2, 1, 3])
    assert brown._blocks(np.array([3, 4, 9, 0, 2, 5]), 7) == [(0, 2), (2, 3), (3, 6)]
    assert brown._blocks(np.array([], np.int64), 7) == []
