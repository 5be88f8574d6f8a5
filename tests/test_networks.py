"""Graph networks against loops over single numbers, the contrastive loss against all pairs, and stored states."""

import glob
import math
import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kinelake.operators import networks as n
from kinelake.operators.pose import BRANCHES, JOINT_SETS, channels
from kinelake.plans import network_plans as plans
from kinelake.sources import views as v

SF = "/root/testdata/sf0.001"


def test_windows_hold_every_frame(spark):
    frames = v.v_frames(spark, SF)
    names = [c for cs in BRANCHES.values() for c in cs]
    held = {(r.run, r.t, r.j): [r[c] for c in names] for r in channels(frames, "body").collect()}
    last = {}
    for run, t, _ in held:
        last[run] = max(last.get(run, 0), t)
    got = n.window_tensors(frames, "body", 40, 20).collect()
    want = {(run, s) for run, t in last.items() for s in range(0, max(1, math.ceil((t + 1 - 40) / 20) + 1) * 20, 20)}
    assert {(r.run, r.start) for r in got} == want
    for r in got[:5]:
        x = np.array(r.x).reshape(40, 9, len(names))
        assert r.real == min(40, last[r.run] + 1 - r.start) and not x[r.real :].any()
        assert all((x[t, i] == held[r.run, r.start + t, j]).all() for t in range(r.real) for i, j in enumerate(JOINT_SETS["body"]))
    assert {t for r in got for t in [(r.run, r.start + k) for k in range(r.real)]} == {(run, t) for run, t, _ in held}
    assert n.window_tensors(frames.limit(0), "body", 40, 20).count() == 0


def _norm(x, w, name, c):
    return (x - w[f"{name}.mean"][c]) / math.sqrt(w[f"{name}.var"][c] + 1e-5) * w[f"{name}.scale"][c] + w[f"{name}.shift"][c]


def _conv(x, w, name, stride=1, dilation=1):
    """Number by number: x is a dict (t, v, c), taps are centred."""
    kernel, bias = w[f"{name}.w"], w[f"{name}.b"]
    kernel = kernel[None] if kernel.ndim == 2 else kernel
    t_, v_, c_ = (max(k[i] for k in x) + 1 for i in range(3))
    pad = dilation * (len(kernel) - 1) // 2
    out = {}
    for t in range((t_ - 1) // stride + 1):
        for v_at in range(v_):
            for o in range(kernel.shape[2]):
                out[t, v_at, o] = bias[o] + sum(kernel[k][c][o] * x[s, v_at, c] for k in range(len(kernel)) if 0 <= (s := t * stride + k * dilation - pad) < t_ for c in range(c_))
    return out


def _mix(x, graph):
    v_ = len(graph)
    return {(t, j, c): sum(graph[i][j] * x[t, i, c] for i in range(v_)) for t, j, c in x}


def _each(x, f):
    return {k: f(value, k[2]) for k, value in x.items()}


def _random_norms(w, random):
    for k in w:
        if k.endswith((".mean", ".shift")):
            w[k] = random.normal(size=w[k].shape)
        elif k.endswith((".var", ".scale")):
            w[k] = random.uniform(0.5, 2, w[k].shape)
    return w


def _loop_input(x, w):
    return {(t, j, c): _norm(x[t, j, c], w, "data", j * x.shape[2] + c) for t in range(x.shape[0]) for j in range(x.shape[1]) for c in range(x.shape[2])}


def test_residual_network_as_a_loop():
    random = np.random.default_rng(1)
    graph = random.random((3, 3))
    w = _random_norms(n.residual_weights(graph, 2, 2, (3, 3, 4), (1, 1, 2), 5), random)
    x, real = random.normal(size=(2, 11, 3, 2)), np.array([11, 6])
    got = n.residual_embedding(x, real, w)
    for b in range(2):
        a = _loop_input(x[b], w)
        for i, stride in enumerate((1, 1, 2)):
            at = f"block{i}"
            short = {k: _norm(value, w, f"{at}.norm3", k[2]) for k, value in _conv(a, w, f"{at}.short", stride).items()} if f"{at}.short.w" in w else a
            y = _each(_mix(_conv(a, w, f"{at}.space"), graph), lambda value, c: max(0.0, _norm(value, w, f"{at}.norm1", c)))
            y = _conv(y, w, f"{at}.time", stride)
            a = {k: max(0.0, _norm(value, w, f"{at}.norm2", k[2]) + short[k]) for k, value in y.items()}
        t_ = max(k[0] for k in a) + 1
        kept = [t for t in range(t_) if t * 11 // t_ < real[b]]
        pool = np.array([sum(a[t, j, c] for t in kept for j in range(3)) / (3 * len(kept)) for c in range(4)])
        assert np.allclose(got[b], pool @ w["embed.w"] + w["embed.b"], atol=1e-9)


def test_branched_network_as_a_loop():
    random = np.random.default_rng(2)
    parts = random.random((3, 3, 3))
    w = _random_norms(n.branched_weights(parts, 2, 2, ((8, 1), (8, 1), (13, 2))), random)
    x = random.normal(size=(1, 9, 3, 2))
    got = n.branched_embedding(x, np.array([9]), w)[0]
    a = _loop_input(x[0], w)
    for i, (width, stride) in enumerate(((8, 1), (8, 1), (13, 2))):
        at = f"block{i}"
        down = _each(_conv(a, w, f"{at}.down"), lambda value, c: _norm(value, w, f"{at}.down_norm", c)) if f"{at}.down.w" in w else a
        spread = _conv(a, w, f"{at}.space")
        sums = {}
        for p in range(3):
            for k, value in _mix({(t, j, c - p * width): value for (t, j, c), value in spread.items() if p * width <= c < (p + 1) * width}, parts[p]).items():
                sums[k] = sums.get(k, 0.0) + value
        y = {k: max(0.0, _norm(value, w, f"{at}.norm1", k[2]) + down[k]) for k, value in sums.items()}
        joined, offset = {}, 0
        for b in range(6):
            name = f"{at}.branch{b}"
            if b == 5:
                out = _conv(y, w, name, stride)
            else:
                inner = _each(_conv(y, w, name), lambda value, c: max(0.0, _norm(value, w, f"{name}.norm", c)))
                if b < 4:
                    out = _conv(inner, w, f"{name}.time", stride, b + 1)
                else:
                    t_ = max(k[0] for k in inner) + 1
                    out = {(t, j, c): max(inner[s, j, c] for s in range(t * stride - 1, t * stride + 2) if 0 <= s < t_) for (t, j, c) in inner if t <= (t_ - 1) // stride}
            joined |= {(t, j, c + offset): value for (t, j, c), value in out.items()}
            offset = max(k[2] for k in joined) + 1
        joined = _each(joined, lambda value, c: max(0.0, _norm(value, w, f"{at}.join_norm", c)))
        z = _each(_conv(joined, w, f"{at}.join"), lambda value, c: _norm(value, w, f"{at}.norm2", c))
        short = {k: 0.0 for k in z} if i == 0 else a if f"{at}.short.w" not in w else _each(_conv(a, w, f"{at}.short", stride), lambda value, c: _norm(value, w, f"{at}.norm3", c))
        a = {k: max(0.0, value + short[k]) for k, value in z.items()}
    assert offset == 13
    t_ = max(k[0] for k in a) + 1
    assert np.allclose(got, [sum(a[t, j, c] for t in range(t_) for j in range(3)) / (3 * t_) for c in range(13)], atol=1e-9)


def test_scores_of_windows_do_not_depend_on_batches(spark):
    w = n.window_tensors(v.v_frames(spark, SF), "body", 40, 20)
    weights = n.with_data_norm(w, n.residual_weights(plans._adjacency(spark), plans._C, 5, (8, 8), (1, 2)), 40)
    real = [(np.array(r.x).reshape(40, 9, -1)[: r.real]) for r in w.collect()]
    every = np.concatenate(real).reshape(-1, 9 * plans._C)
    assert np.allclose(weights["data.mean"], every.mean(0)) and np.allclose(weights["data.var"], every.var(0))
    table = n.to_table(spark, weights)
    assert all(np.allclose(a, n.from_table(table)[k]) for k, a in weights.items())
    one = {(r.run, r.start): r for r in n.network_scores(w, table, 9, 40, block=1).collect()}
    many = {(r.run, r.start): r for r in n.network_scores(w.repartition(3), table, 9, 40, block=50).collect()}
    assert set(one) == set(many) and all(np.allclose(one[k].p, many[k].p) and abs(sum(one[k].p) - 1) < 1e-9 for k in one)
    r = w.first()
    direct = n.residual_embedding(np.array(r.x).reshape(1, 40, 9, -1), np.array([r.real]), weights)[0]
    assert np.allclose(direct, one[r.run, r.start].embedding)


def test_graph_parts_and_hops(spark):
    links = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 2)], "child int, parent int")
    assert {(r.j, r.hop) for r in n.hop_distances(links, 0).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    got = {(r.part, r.i, r.j): r.w for r in n.graph_parts(links, 4).collect()}
    want = {("root", i, i): 1.0 for i in range(4)} | {("inward", 0, 1): 1.0, ("inward", 0, 2): 1.0, ("inward", 1, 3): 0.5, ("inward", 2, 3): 0.5}
    assert got == want | {("outward", 1, 0): 0.5, ("outward", 2, 0): 0.5, ("outward", 3, 1): 1.0, ("outward", 3, 2): 1.0}
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rows = {tuple(sorted(r.asDict().items())) for r in plans.graph_parts(spark, SF).collect()}
    cur = c.execute(plans.ORACLES["graph_parts"])
    names = [d[0] for d in cur.description]
    assert rows == {tuple(sorted(zip(names, r, strict=True))) for r in cur.fetchall()}


def test_contrastive_loss_and_gradient_as_all_pairs():
    random = np.random.default_rng(3)
    x, y, w, tau = random.normal(size=(9, 4)), np.array([0, 0, 1, 1, 1, 2, 0, 3, 3]), random.normal(size=(4, 3)), 0.3

    def loss(w):
        z = [[sum(a * b for a, b in zip(row, col, strict=True)) for col in w.T] for row in x]
        z = [[a / math.sqrt(sum(b * b for b in row)) for a in row] for row in z]
        sim = [[sum(a * b for a, b in zip(p, q, strict=True)) / tau for q in z] for p in z]
        each = []
        for i in range(9):
            mates = [j for j in range(9) if j != i and y[j] == y[i]]
            if mates:
                whole = math.log(sum(math.exp(sim[i][j]) for j in range(9) if j != i))
                each.append(-sum(sim[i][j] - whole for j in mates) / len(mates))
        return sum(each) / len(each)

    got, gradient = n.encoder_gradient(x, y, w, tau)
    assert abs(got - loss(w)) < 1e-12
    for i in range(4):
        for j in range(3):
            step = np.zeros_like(w)
            step[i, j] = 1e-6
            assert abs((loss(w + step) - loss(w - step)) / 2e-6 - gradient[i, j]) < 1e-6
    alone, none = n.contrastive(np.eye(2), np.array([0, 1]), 0.1)
    assert alone == 0.0 and not none.any()


def test_encoder_learns_and_reruns_agree(spark):
    random = np.random.default_rng(4)
    rows = [(i, i % 3, (np.eye(6)[i % 3] * 0.7 + random.normal(0, 0.4, 6)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, y int, features array<double>")
    w, losses = n.train_encoder(df, 4, ("i",), epochs=12, batch=40)
    again, same = n.train_encoder(df.repartition(5), 4, ("i",), epochs=12, batch=40)
    assert losses == same and (w == again).all() and losses[-1] < losses[0] - 0.3
    table = n.to_table(spark, {"encoder": w})
    got = {r.i: r.features for r in n.encoded(df, table, ("i",)).collect()}
    u = np.array(rows[7][2]) @ w
    assert np.allclose(got[7], u / np.linalg.norm(u))
    assert n.train_encoder(df.limit(0), 4, ("i",))[1] == []


def test_state_is_stored_and_scores_other_runs(spark, tmp_path):
    random = np.random.default_rng(5)
    rows = []
    for run in range(12):
        for s in range(4):
            x = random.normal(size=(8, 3, 2)) + (run % 2) * np.array([1.5, -1.0])
            rows.append((run, s, 8 if s else 5, np.where(np.arange(8)[:, None, None] < (8 if s else 5), x, 0).ravel().tolist()))
    w = spark.createDataFrame(rows, "run long, start int, real int, x array<double>")
    labels = spark.createDataFrame([(r, r % 2) for r in range(8)], "run long, y int")
    path = f"{tmp_path}/state"
    losses = n.fit_state(w.where("run < 8"), labels, n.residual_weights(np.eye(3), 2, 2, (6, 6), (1, 2), 12), 3, 8, path, 2, epochs=6)
    assert losses[-1] < losses[0]
    got = {r.run: r for r in n.vote_of_runs(n.score_runs(w.where("run >= 8"), path, 3, 8)).collect()}
    assert {r: x.pred for r, x in got.items()} == {8: 0, 9: 1, 10: 0, 11: 1} and all(x.windows == 4 for x in got.values())


def test_queries_of_networks(spark):
    for query in (plans.residual_scores, plans.branched_scores):
        rows = query(spark, SF).collect()
        assert {len(r.p) for r in rows} == {plans.CLASSES} and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
        assert len({(r.run, r.start) for r in rows}) == len(rows) == n.window_tensors(v.v_frames(spark, SF), "body", 40, 20).count()
    held = {r.run for r in plans.held_out_runs(spark, SF).collect()}
    assert held == {r.run for r in v.v_frames(spark, SF).select("run").distinct().where(F.col("run") % 5 >= 3).collect()}
    losses = [r.loss for r in sorted(plans.contrastive_encoder(spark, SF).collect())]
    assert len(losses) == 8 and losses[-1] < losses[0]
