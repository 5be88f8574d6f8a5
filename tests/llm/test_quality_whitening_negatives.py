"""The quality classifier, whitening and hard negatives against brute force, exact fractions, held-out labels and odd rows."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.llm import dual_tree, nb_svm, whitening

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# quality


def test_features_are_those_of_the_whole_text():
    assert len(nb_svm.features(None)) == len(nb_svm.features("")) == 0
    a, b = set(nb_svm.features("alpha beta gamma ")), set(nb_svm.features("alpha beta gamma " * 5000).tolist())
    assert a < b and len(b) - len(a) <= 25  # what is new: n-grams over the seams
    late = "alpha beta gamma " * 5000 + "$$$"
    assert set(nb_svm.features(late).tolist()) - b
    one, two = (set(nb_svm.features(t).tolist()) for t in ("uno dos", "dos uno"))
    assert one != two
    same, other = (set(nb_svm.features(t).tolist()) for t in ("abc abc", "abc abd"))
    assert same - other  # a word that repeats the one before has a shape of its own
    assert all(0 <= f < nb_svm.FEATURES for f in b)


def test_ratios_by_hand():
    ones, zeros = np.array([3.0, 0.0, 1.0]), np.array([0.0, 2.0, 1.0])
    got = nb_svm.log_count_ratios(ones, zeros)
    want = [math.log((p + 1) / 7) - math.log((q + 1) / 6) for p, q in ((3, 0), (0, 2), (1, 1))]
    assert np.allclose(got, want)


def test_dual_coordinate_descent_reaches_the_optimum():
    random_ = np.random.default_rng(5)
    rows = [np.sort(random_.choice(60, 12, replace=False)) for _ in range(80)]
    y = np.array([1 if (x < 20).sum() > 3 else -1 for x in rows])
    y[:5] *= -1  # not separable
    ratios = random_.normal(size=nb_svm.FEATURES)
    values = nb_svm.scaled(rows, ratios)
    w = nb_svm.dual_coordinate_descent(rows, values, y, epochs=4000, tolerance=1e-9)
    x = np.zeros((80, 61))
    for i, (at, v) in enumerate(zip(rows, values, strict=True)):
        x[i, at] = v
    x[:, 60] = 1.0
    n, ones = 80, (y > 0).sum()
    cost = np.where(y > 0, n / (2 * ones), n / (2 * (n - ones)))
    held = np.append(w[:60], w[-1])
    primal = lambda u: 0.5 * u @ u + (cost * np.maximum(0, 1 - y * (x @ u))).sum()
    best = primal(held)
    u = np.zeros(61)
    for step in range(1, 20001):  # subgradients find nothing better
        active = y * (x @ u) < 1
        u -= (u - x.T @ (cost * y * active)) / step
        assert best <= primal(u) + 1e-6 if step % 500 == 0 else True
    assert primal(u) - best < 0.05 * best


def test_logistic_curve_meets_the_weights():
    random_ = np.random.default_rng(1)
    m = random_.normal(size=20000)
    y = (random_.random(20000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(int)
    a, b = nb_svm.logistic_curve(m, y, np.ones(20000))
    assert abs(a - 2) < 0.1 and abs(b + 1) < 0.1
    kept = (y == 1) | (random_.random(20000) < 0.2)
    a, b = nb_svm.logistic_curve(m[kept], y[kept], np.where(y[kept] == 1, 1.0, 5.0))
    assert abs(a - 2) < 0.15 and abs(b + 1) < 0.15
    a, b = nb_svm.logistic_curve(np.array([-1.0, 1.0]), np.array([0, 1]), np.ones(2))
    assert math.isfinite(a) and math.isfinite(b)


def test_quality_counts_and_scores_by_hand(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(150)
    marks = pd.read_parquet(f"{SF}/labels.parquet")
    known = nb_svm.counts_and_sample(nb_svm.labelled_texts(spark.createDataFrame(docs), spark.createDataFrame(marks)), F.col("id") % 2 == 0)
    text, want = dict(zip(docs.doc_id, docs.text, strict=True)), Counter()
    for i, q in zip(marks.doc_id, marks.quality, strict=True):
        if i in text and q in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            want.update((int(f), int(q)) for f in nb_svm.features(text[i]))
    ones, zeros = nb_svm.feature_counts(known)
    assert {(f, 1): int(c) for f, c in enumerate(ones) if c} | {(f, 0): int(c) for f, c in enumerate(zeros) if c} == dict(want)
    packed = Counter((r.y, bytes(r.x)) for r in known.where("x IS NOT NULL").collect())
    learnt = [(i, q) for i, q in zip(marks.doc_id, marks.quality, strict=True) if i in text and q in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    assert packed == Counter((q, nb_svm._packed(nb_svm.features(text[i]))) for i, q in learnt if i % 2 == 0)
    assert all((nb_svm._unpacked(nb_svm._packed(x)) == x).all() for x in (np.arange(0), np.arange(7), np.arange(0, 65536, 3), nb_svm.features(text[1])))


def test_quality_of_held_out_documents(spark):
    got = nb_svm.op11_nb_svm(spark, SF).toPandas()
    again = nb_svm.op11_nb_svm(spark, SF).toPandas()
    assert got.sort_values("doc_id").equals(again.sort_values("doc_id")) or np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_quality_odd_rows(spark):
    good, bad = "a calm line of plain words. ", "x | y | z $$$ !!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7), "en", "s", 1) for i in range(60)]
    rows += [(None, good, None, None, None), (100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "word " * 60_000, "en", "s", 0), (1, good, "en", "s", 1), (1, bad, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("y", F.lit("x")).withColumn("id", F.lit(1)).withColumn("score", F.lit(2)).withColumn("f", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (8, 5), (9, 0), (9, 1), (9, 1)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    got = nb_svm.score(docs, nb_svm.train(docs, labels)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    by_id = got.dropna().groupby("doc_id").score.max()
    assert by_id.loc[11] > 0.5 > by_id.loc[12] and by_id.loc[100] == by_id.loc[101]
    ids = [r.id for r in nb_svm.labelled_texts(docs, labels).collect()]
    assert len(ids) == len(set(ids)) and 9 not in ids
    for some, want in ((labels.where("quality = 1"), lambda n: (n + 1) / (n + 2)), (labels.limit(0), lambda n: 0.5)):
        n = nb_svm.labelled_texts(docs, some).count()
        assert {r.score for r in nb_svm.score(docs, nb_svm.train(docs, some)).collect()} == {want(n)}
    empty = docs.limit(0)
    assert nb_svm.score(empty, nb_svm.train(empty, labels)).count() == 0


# whitening


@pytest.mark.parametrize("bits,block", [(whitening.LIMB_BITS, whitening.BLOCK), (5, 7), (3, 100)])
@pytest.mark.parametrize("size", [1, 90, 1 << 21, 1 << 40, 1 << 55, 1 << 80])
def test_digit_slices_are_exact(bits, block, size):
    rng = random.Random(size)
    rows = [[rng.randrange(-size, size + 1) for _ in range(6)] for _ in range(40)] + [[0] * 6, [size] * 6, [-size] * 6]
    z = np.array(rows, np.int64 if size < 1 << 62 else object)
    parts = whitening.limbs(z, bits)
    assert all(np.abs(p).max() <= 1 << (bits - 1) for p in parts)
    assert (sum(p.astype(np.int64).astype(object) << (bits * i) for i, p in enumerate(parts)) == z.astype(object)).all()
    want = z.astype(object).T @ z.astype(object)
    assert (whitening.recombined(whitening.products(z, bits, block), bits) == want).all()


def _whiten(spark, rows, top=16):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(3)).withColumn("n", F.lit("n"))
    vectors = whitening.whole_vectors(df, "vec_id", "embedding")
    model = whitening.fit_whitening(vectors, top)
    return model, whitening.whiten(vectors, model).collect()


def test_whitening_as_fractions(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1 + j) for j in range(5)] for _ in range(60)]
    rows = [(i, base[i % 60]) for i in range(90)] + [(200, base[0])] * 40
    model, got = _whiten(spark, rows)
    xs = {i: [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(x) for x in xs.values()})
    n = len(fit)
    mean = [Fraction(sum(c), n) for c in zip(*fit, strict=True)]
    v = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(5)] for i in range(5)]
    values, vectors = np.linalg.eigh(np.array(v, float))
    trace = float(sum(v[i][i] for i in range(5)))
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {n} and model["identity_error"] < 1e-9
    assert (model["sums"], model["n"]) == ([sum(c) for c in zip(*fit, strict=True)], n)
    for r in got:
        x = [a - m for a, m in zip(xs[r.id], mean, strict=True)]
        assert int(r.deviation) == sum((n * a) ** 2 for a in x)
        want = float(np.array(x, float) @ vectors[:, -r.component]) / math.sqrt(values[-r.component])
        assert abs(abs(r.whitened) - abs(want)) < 1e-8 and abs(r.explained * trace / values[-r.component] - 1) < 1e-9


def test_whitening_odd_rows(spark):
    odd = [(1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0])]
    assert _whiten(spark, odd)[1] == [] and _whiten(spark, [])[1] == []
    assert _whiten(spark, [(1, [1.0, 2.0])] * 3)[1] == []  # one distinct vector has no direction
    assert _whiten(spark, [(1, []), (2, [])])[1] == []
    model, got = _whiten(spark, [*odd, (5, [1.0, 2.0]), (None, [3.0]), (7, []), (5, [1.0, 2.0]), (8, [-4.0, 9.0, 0.0])])
    assert model["n"] == 4 and len(model["sums"]) == 3 and Counter(r.id for r in got) == {5: 2 * 2, None: 2, 7: 2, 8: 2}
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]  # one direction only
    model, got = _whiten(spark, line)
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    big = [(i, [float(i) * 2**33, -float(i * i)]) for i in range(30)]  # products beyond 63 bits
    model, got = _whiten(spark, big, 1)
    x = [math.floor(64 * float(np.float32(i * 2.0**33))) + 1_000_000 for i in range(30)], [math.floor(-64.0 * i * i) + 1_000_000 for i in range(30)]
    deviation = [sum((30 * c[i] - sum(c)) ** 2 for c in x) for i in range(30)]
    assert max(deviation) > 1 << 63 and [int(r.deviation) for r in sorted(got, key=lambda r: r.id)] == deviation
    with pytest.raises(Exception, match="too long"):
        _whiten(spark, [(1, [1e30]), (2, [0.0])])


def test_whitening_query(spark):
    got = whitening.op12_whitening(spark, SF).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert wide.shape == (500, 16) and str(got.deviation.dtype) == "int64"
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(16)).max() < 1e-9 and (np.abs(wide.mean(0)) < 1e-9).all()


# hard negatives


def _by_hand(rows, positives=5, negatives=5):
    """rows: (id, label, vector); the anchors are those whose id is divisible by 10."""
    found = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for at, (i, label, v) in enumerate(rows):
        if i % 10:
            continue
        others = sorted(((-dot(v, w), j, other) for to, (j, other, w) in enumerate(rows) if to != at), key=lambda r: r[:2])
        for p, j in [(-s, j) for s, j, other in others if other == label][:positives]:
            fine = [(-s, m) for s, m, other in others if other != label and 80 * p <= -100 * s <= 100 * p]
            found += [(i, j, rank, m, p, s) for rank, (s, m) in enumerate(fine[:negatives], 1)]
    return Counter(found)


def _mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0)).withColumn("key", F.lit(0))
    whole = dual_tree.integer_rows(df, "vec_id", F.col("label"), "embedding", 1)
    got = dual_tree.hard_negatives(whole, whole.where("id % 10 = 0"), **sizes)
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 30, "block_rows": 5, "leaf": 4, "tasks": 7}])
@pytest.mark.parametrize("spread", [2, 40])
def test_hard_negatives_as_brute_force(spark, sizes, spread):
    rng = random.Random(spread)
    rows = [(rng.randrange(150), rng.choice([0, 0, 0, 1, 2, 3]), [float(rng.randrange(-spread, spread + 3)) for _ in range(rng.choice([4, 4, 4, 3]))]) for _ in range(180)]
    rows += [(10, 0, [1.0, 1.0, 1.0, 1.0])] * 3 + [(20, 9, [1.0, 2.0, 0.0, 1.0])]
    assert _mined(spark, rows, **sizes) == _by_hand(rows)


def test_hard_negatives_odd_rows(spark):
    rows = [(None, 1, [1.0]), (10, None, [1.0]), (20, 1, None), (30, 1, [None, 1.0]), (40, 1, [float("nan")]), (50, 1, [float("inf")])]
    assert _mined(spark, rows) == _mined(spark, []) == Counter()
    fine = [(60, 1, []), (61, 1, []), (62, 2, []), (70, 1, [3.0]), (71, 1, [3.0, 0.0]), (72, 2, [3.0, 0.0, 9.0]), (80, 5, [1.0])]
    assert _mined(spark, rows + fine) == _by_hand(fine)
    with pytest.raises(Exception, match="too long"):
        _mined(spark, [(10, 1, [1e12]), (11, 1, [1.0])])


def test_node_pairs_prune_groups_of_anchors():
    random_ = np.random.default_rng(2)
    centres = random_.normal(size=(40, 8)) * 1000
    v = np.concatenate([c + random_.normal(size=(50, 8)) * 5 for c in centres]).astype(np.int64)
    rows = pd.DataFrame({"id": np.arange(len(v)), "label": np.repeat(np.arange(40) // 4, 50), "v": list(v), "key": np.arange(len(v))})
    import pickle

    tree, seen = pickle.loads(dual_tree.plant(rows, 16)), [0]
    lanes = dual_tree.Lanes(np.full((len(v), 1), dual_tree.NONE + 1), np.full((len(v), 1), dual_tree.CLOSED), 6)
    dual_tree.search(tree, tree, lanes, True, seen)
    ids = tree["columns"]["id"]
    for at in range(0, len(v), 97):
        i = ids[at]
        s = v @ v[i]
        mine = sorted((-s[j], j) for j in np.flatnonzero(rows.label == rows.label[i]))[:6]
        assert [(-a, b) for a, b in mine] == list(zip(lanes.scores[at, 0], lanes.ids[at, 0], strict=True))
    assert seen[0] < len(v) ** 2 / 15  # a tenth by labels alone
    ceilings = lanes.scores[:, :, -1].copy()
    seen, other = [0], dual_tree.Lanes(-(-80 * np.maximum(ceilings, 0) // 100), ceilings, 5)
    dual_tree.search(tree, tree, other, False, seen)
    assert seen[0] < len(v) ** 2 / 4


def test_grid():
    assert dual_tree.grid(1, 13, 12) == (12, 1) and dual_tree.grid(1, 3, 12) == (3, 1)
    g, h = dual_tree.grid(2000, 250_000, 16_000)
    assert h == 11 and g * h >= 16_000
