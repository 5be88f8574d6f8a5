"""Graph networks on windows of frames: inference, contrastive training and scoring of held-out runs.

A window is a row (run, start, real, x): length frames of joints of channels, flat, zeros behind the first `real`. Weights
are a table (name, shape, values), bounded by the model, so a fitted state is written, read and joined like any other; it is
broadcast to the tasks, where layers are products of blocks (window, frame, joint, channel) in Arrow batches. Windows are
rows, so inference shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kinelake.operators.pose import BRANCHES, JOINT_SETS, channels
from kinelake.runtime import cut, ship, tidy

# windows


def window_tensors(frames: DataFrame, joint_set: str, length: int, step: int, use: tuple[str, ...] = tuple(BRANCHES)) -> DataFrame:
    """(run, start, real, x array<double>) of frames(run, t, joints): windows begin every `step` frames until the run's last frame is in one; the last may have fewer real frames."""
    names = [c for b, cs in BRANCHES.items() if b in use for c in cs]
    rows = channels(frames, joint_set, use)
    place = F.array_position(F.array(*[F.lit(j) for j in JOINT_SETS[joint_set]]), F.col("j"))
    whole = rows.groupBy("run", "t").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.array(*names).alias("c")))).alias("js"))
    whole = whole.select("run", "t", F.flatten(F.transform("js", lambda j: j["c"])).alias("v"))
    sizes = frames.groupBy("run").agg(F.count("*").alias("n"))
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - length) / step) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - length + 1) / step))
    last = F.least(F.floor(F.col("t") / step), count - 1)
    each = whole.join(sizes, "run").withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    held = each.groupBy("run", (F.col("k") * step).alias("start")).agg(F.count("*").cast("int").alias("real"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("fs"))
    width = len(names) * len(JOINT_SETS[joint_set])
    flat = F.concat(F.flatten(F.transform("fs", lambda f: f["v"])), F.array_repeat(F.lit(0.0), (length - F.col("real")) * width))
    return held.select("run", "start", "real", flat.alias("x"))


# graphs


def hop_distances(edges: DataFrame, root: int) -> DataFrame:
    """(j, hop) of the joints that edges(child, parent) tie to root, breadth first; joints are few, each round is a small join."""
    both = cut(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(edges.select("parent", "child")).distinct())
    found = edges.sparkSession.createDataFrame([(root, 0)], "j int, hop int")
    hop = 0
    while True:
        hop += 1
        near = both.join(found.where(F.col("hop") == hop - 1), both.a == F.col("j")).select(F.col("b").alias("j")).distinct()
        fresh = cut(near.join(found, "j", "left_anti").select("j", F.lit(hop).alias("hop")))
        if fresh.isEmpty():
            return found
        found = cut(found.union(fresh))


def inward(joint_set: str, spark: SparkSession, coordination: bool = False) -> DataFrame:
    """(child, parent), positions in the set: each joint to its parent; ties beside the tree go from the smaller position to the larger."""
    from kinelake.operators.pose import graph_edges, parents

    joints = JOINT_SETS[joint_set]
    tree = [(joints.index(c), joints.index(p)) for c, p in parents(joint_set).items() if c != p]
    links = spark.createDataFrame(tree, "child int, parent int")
    both = links.union(links.select("parent", "child"))
    beside = graph_edges(spark, joint_set, coordination).select(F.col("i").alias("child"), F.col("j").alias("parent")).join(both, ["child", "parent"], "left_anti")
    return links.unionByName(beside)


def graph_parts(links: DataFrame, n: int) -> DataFrame:
    """(part, i, j, w): the root part is each joint's own; inward holds parent i of child j, outward child i of parent j; the columns j of each sum to 1."""
    own = links.sparkSession.range(n).select(F.lit("root").alias("part"), F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"))
    into = links.select(F.lit("inward").alias("part"), F.col("parent").alias("i"), F.col("child").alias("j"))
    out = links.select(F.lit("outward").alias("part"), F.col("child").alias("i"), F.col("parent").alias("j"))
    every = own.unionByName(into).unionByName(out).distinct()
    return every.join(every.groupBy("part", "j").agg((1 / F.count("*")).alias("w")), ["part", "j"]).select("part", "i", "j", "w")


def as_matrix(weights: DataFrame, n: int) -> np.ndarray:
    """weights(i, j, w) of a graph of n joints as a matrix."""
    made = np.zeros((n, n))
    for r in weights.collect():
        made[r.i, r.j] = r.w
    return made


# weights

Weights = dict[str, np.ndarray]


def to_table(spark: SparkSession, weights: Weights) -> DataFrame:
    return spark.createDataFrame([(k, list(a.shape), a.ravel().astype(float).tolist()) for k, a in sorted(weights.items())], "name string, shape array<int>, values array<double>")


def from_table(table: DataFrame) -> Weights:
    """The model's weights; their number is the model's, whatever the data."""
    return {r.name: np.array(r["values"]).reshape(r["shape"]) for r in table.collect()}


def _draw(random: np.random.Generator, *shape: int) -> np.ndarray:
    bound = 1 / np.sqrt(max(1, int(np.prod(shape[:-1]))))
    return random.uniform(-bound, bound, shape)


def _norm(w: Weights, name: str, n: int) -> None:
    w.update({f"{name}.scale": np.ones(n), f"{name}.shift": np.zeros(n), f"{name}.mean": np.zeros(n), f"{name}.var": np.ones(n)})


def _dense(w: Weights, name: str, random: np.random.Generator, *shape: int) -> None:
    w[f"{name}.w"], w[f"{name}.b"] = _draw(random, *shape), np.zeros(shape[-1])


# layers, on blocks (window, frame, joint, channel)


def dense(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """By the statistics that the model holds, not the batch's: a window's result doesn't depend on its neighbours."""
    return (x - w[f"{name}.mean"]) / np.sqrt(w[f"{name}.var"] + 1e-5) * w[f"{name}.scale"] + w[f"{name}.shift"]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def mixed(x: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """Joint j gets the sum over i of graph[i, j] times joint i."""
    return graph.T @ x


def _taps(x: np.ndarray, taps: int, stride: int, dilation: int, fill: float) -> Iterator[np.ndarray]:
    """The frames that each tap of a centred kernel sees, `fill` beyond both ends."""
    pad = dilation * (taps - 1) // 2
    wide = np.pad(x, ((0, 0), (pad, pad), (0, 0), (0, 0)), constant_values=fill)
    n = (x.shape[1] - 1) // stride + 1
    for k in range(taps):
        yield wide[:, k * dilation : k * dilation + (n - 1) * stride + 1 : stride]


def temporal(x: np.ndarray, w: Weights, name: str, stride: int = 1, dilation: int = 1) -> np.ndarray:
    kernel = w[f"{name}.w"]
    return sum(seen @ kernel[k] for k, seen in enumerate(_taps(x, len(kernel), stride, dilation, 0.0))) + w[f"{name}.b"]


def highest(x: np.ndarray, taps: int, stride: int) -> np.ndarray:
    return np.max(np.stack(list(_taps(x, taps, stride, 1, -np.inf))), axis=0)


def pooled(x: np.ndarray, real: np.ndarray, length: int) -> np.ndarray:
    """Mean over joints and those frames that stand for real ones; a frame of a shortened window stands for the nearest earlier one of the full window."""
    stands = np.arange(x.shape[1]) * length // x.shape[1]
    mask = (stands < real[:, None]).astype(float)
    return (x * mask[:, :, None, None]).sum((1, 2)) / (np.maximum(mask.sum(1), 1.0) * x.shape[2])[:, None]


# residual graph network

WIDTHS, STRIDES, TAPS, EMBED = (32, 32, 64, 64, 96, 96), (1, 1, 2, 1, 2, 1), 9, 128


def residual_weights(graph: np.ndarray, n_channels: int, classes: int, widths: tuple[int, ...] = WIDTHS, strides: tuple[int, ...] = STRIDES, embed: int = EMBED, seed: int = 0) -> Weights:
    """Untrained weights: blocks of spatial and temporal convolution, an embedding and a head; graph is the edges' starting weight."""
    random, w, held = np.random.default_rng(seed), {}, n_channels
    _norm(w, "data", len(graph) * n_channels)
    for i, (width, stride) in enumerate(zip(widths, strides, strict=True)):
        at = f"block{i}"
        w[f"{at}.graph"] = graph
        _dense(w, f"{at}.space", random, held, width)
        _dense(w, f"{at}.time", random, TAPS, width, width)
        _norm(w, f"{at}.norm1", width)
        _norm(w, f"{at}.norm2", width)
        w[f"{at}.stride"] = np.array([float(stride)])
        if held != width or stride != 1:
            _dense(w, f"{at}.short", random, held, width)
            _norm(w, f"{at}.norm3", width)
        held = width
    _dense(w, "embed", random, held, embed)
    _dense(w, "head", random, embed, classes)
    return w


def _blocks(w: Weights) -> list[str]:
    return sorted({k.split(".")[0] for k in w if k.startswith("block")}, key=lambda k: int(k[5:]))


def _normed_input(x: np.ndarray, w: Weights) -> np.ndarray:
    b, t, v, c = x.shape
    return norm(x.reshape(b, t, v * c), w, "data").reshape(b, t, v, c)


def residual_embedding(x: np.ndarray, real: np.ndarray, w: Weights) -> np.ndarray:
    length, x = x.shape[1], _normed_input(x, w)
    for at in _blocks(w):
        stride = int(w[f"{at}.stride"][0])
        short = norm(dense(x[:, ::stride], w, f"{at}.short"), w, f"{at}.norm3") if f"{at}.short.w" in w else x
        y = relu(norm(mixed(dense(x, w, f"{at}.space"), w[f"{at}.graph"]), w, f"{at}.norm1"))
        x = relu(norm(temporal(y, w, f"{at}.time", stride), w, f"{at}.norm2") + short)
    return dense(pooled(x, real, length), w, "embed")


# network of directed graph parts and branches of time scales

#: Kernel and dilation of the branches; beside them one takes the maximum of 3 frames and one the frame itself.
SCALES = ((3, 1), (3, 2), (3, 3), (3, 4))
STAGES = ((64, 1), (64, 1), (64, 1), (64, 1), (128, 2), (128, 1), (128, 1), (256, 2), (256, 1), (256, 1))


def branched_weights(parts: np.ndarray, n_channels: int, classes: int, stages: tuple[tuple[int, int], ...] = STAGES, seed: int = 0) -> Weights:
    """parts: the stacked graph parts (k, n, n), which each stage may change."""
    random, w, held = np.random.default_rng(seed), {}, n_channels
    _norm(w, "data", parts.shape[1] * n_channels)
    for i, (width, stride) in enumerate(stages):
        at, each = f"block{i}", width // (len(SCALES) + 2)
        w[f"{at}.parts"], w[f"{at}.stride"] = parts, np.array([float(stride)])
        _dense(w, f"{at}.space", random, held, len(parts) * width)
        _norm(w, f"{at}.norm1", width)
        if held != width:
            _dense(w, f"{at}.down", random, held, width)
            _norm(w, f"{at}.down_norm", width)
        for b in range(len(SCALES) + 2):
            inside = width - each * (len(SCALES) + 1) if b == 0 else each
            _dense(w, f"{at}.branch{b}", random, width, inside)
            if b <= len(SCALES):
                _norm(w, f"{at}.branch{b}.norm", inside)
            if b < len(SCALES):
                _dense(w, f"{at}.branch{b}.time", random, SCALES[b][0], inside, inside)
        _norm(w, f"{at}.join_norm", width)
        _dense(w, f"{at}.join", random, width, width)
        _norm(w, f"{at}.norm2", width)
        if i and (held != width or stride != 1):
            _dense(w, f"{at}.short", random, held, width)
            _norm(w, f"{at}.norm3", width)
        held = width
    _dense(w, "head", random, held, classes)
    return w


def branches(x: np.ndarray, w: Weights, at: str, stride: int) -> np.ndarray:
    """The time scales side by side, then joined."""
    out = []
    for b in range(len(SCALES) + 2):
        name = f"{at}.branch{b}"
        if b == len(SCALES) + 1:
            out.append(dense(x[:, ::stride], w, name))
            continue
        y = relu(norm(dense(x, w, name), w, f"{name}.norm"))
        out.append(temporal(y, w, f"{name}.time", stride, SCALES[b][1]) if b < len(SCALES) else highest(y, 3, stride))
    return norm(dense(relu(norm(np.concatenate(out, axis=-1), w, f"{at}.join_norm")), w, f"{at}.join"), w, f"{at}.norm2")


def branched_embedding(x: np.ndarray, real: np.ndarray, w: Weights) -> np.ndarray:
    """The mean over all frames and joints of the last stage; padding counts, as it does in training."""
    x = _normed_input(x, w)
    for number, at in enumerate(_blocks(w)):
        stride, parts = int(w[f"{at}.stride"][0]), w[f"{at}.parts"]
        down = norm(dense(x, w, f"{at}.down"), w, f"{at}.down_norm") if f"{at}.down.w" in w else x
        spread = np.split(dense(x, w, f"{at}.space"), len(parts), axis=-1)
        y = relu(norm(sum(mixed(s, p) for s, p in zip(spread, parts, strict=True)), w, f"{at}.norm1") + down)
        short = 0.0 if number == 0 else norm(dense(x[:, ::stride], w, f"{at}.short"), w, f"{at}.norm3") if f"{at}.short.w" in w else x
        x = relu(branches(y, w, at, stride) + short)
    return x.mean((1, 2))


# inference


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _embedded(batches: Iterator[pd.DataFrame], w: Weights, network: Callable, joint_count: int, length: int, block: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows of windows, their embeddings), `block` rows at a time."""
    for b in batches:
        for at in range(0, len(b), block):
            part = b.iloc[at : at + block]
            yield part, network(np.stack(part.x.to_numpy()).reshape(len(part), length, joint_count, -1), part.real.to_numpy(), w)


def network_scores(windows: DataFrame, weights: DataFrame, joint_count: int, length: int, network: Callable = residual_embedding, keys: tuple[str, ...] = ("run", "start"), block: int = 16) -> DataFrame:
    """(keys, embedding, p) of every window: one row in, one row out; `block` windows go through the network at once."""
    spark = windows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(from_table(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for part, e in _embedded(batches, w, network, joint_count, length, block):
            yield part[list(keys)].assign(embedding=list(e), p=list(softmax(dense(e, w, "head"))))

    schema = windows.select(*keys).schema.add("embedding", ArrayType(DoubleType())).add("p", ArrayType(DoubleType()))
    return windows.select(*keys, "real", "x").mapInPandas(tidy(run), schema)


def with_data_norm(windows: DataFrame, weights: Weights, length: int) -> Weights:
    """weights whose input statistics are those of all real frames of all windows: an aggregate by joint and channel."""
    n = len(weights["data.mean"])
    seen = windows.select("real", F.posexplode("x").alias("at", "v")).where(F.col("at") < F.col("real") * n)
    rows = seen.groupBy((F.col("at") % n).alias("i")).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var")).collect()
    if len(rows) < n:
        return weights
    held = {r.i: r for r in rows}
    return weights | {"data.mean": np.array([held[i].mean for i in range(n)]), "data.var": np.array([held[i].var for i in range(n)])}


# contrastive training


def contrastive(z: np.ndarray, y: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """(loss, its gradient by z) of unit rows z: rows of a class attract, all others repel. A row without another of its class doesn't count."""
    same = (y[:, None] == y) & ~np.eye(len(y), dtype=bool)
    partners = same.sum(1)
    ok = partners > 0
    if not ok.any():
        return 0.0, np.zeros_like(z)
    s = z @ z.T / tau
    np.fill_diagonal(s, -np.inf)
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    whole = e.sum(1, keepdims=True)
    log_p = np.where(same, s - top - np.log(whole), 0.0)
    loss = -(log_p.sum(1)[ok] / partners[ok]).mean()
    g = (e / whole - same / np.maximum(partners, 1)[:, None]) * ok[:, None] / ok.sum()
    return float(loss), (g + g.T) @ z / tau


def encoder_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """(loss, gradient by w) of the encoder z = x w at unit length."""
    u = x @ w
    length = np.maximum(np.sqrt((u**2).sum(1, keepdims=True)), 1e-12)
    z = u / length
    loss, dz = contrastive(z, y, tau)
    return loss, x.T @ ((dz - z * (z * dz).sum(1, keepdims=True)) / length)


def train_encoder(rows: DataFrame, width: int, keys: tuple[str, ...], epochs: int = 20, batch: int = 256, rate: float = 0.05, tau: float = 0.1, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """(weights, mean loss of each epoch) of a linear encoder of rows(keys, y, features array<double>), trained by Adam on the contrastive loss.

    Rows are dealt once, by a hash of their keys, to batches of about `batch` rows, a stored row each. An epoch is one job: tasks
    compute their batches' gradients and add them up, and Spark sums the parts as whole numbers of 2^-40, so reruns agree to the bit whatever the order. Only
    sums of the model's size come to the driver. A batch's pairs are all in it, and no two batches meet.
    """
    spark = rows.sparkSession
    ship(spark)
    n_batches = max(1, -(-rows.count() // batch))
    of = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_batches))
    one = F.struct(*keys, F.col("y").cast("int").alias("y"), F.col("features").alias("f"))
    dealt = cut(rows.select(of.alias("b"), one.alias("r")).groupBy("b").agg(F.sort_array(F.collect_list("r")).alias("rs")).select(F.transform("rs", lambda r: r["y"]).alias("y"), F.transform("rs", lambda r: r["f"]).alias("x")))
    first = dealt.select(F.size(F.get("x", 0)).alias("d")).first()
    if first is None:
        return np.zeros((0, width)), []
    w = np.random.default_rng(seed).normal(0, 1 / np.sqrt(first.d), (first.d, width))
    mean, square, losses, unit = np.zeros_like(w), np.zeros_like(w), [], 2.0**40
    for epoch in range(1, epochs + 1):

        def run(batches: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            total, loss, n = np.zeros(w.shape, np.int64), 0, 0
            for b in batches:
                for y, x in zip(b.y, b.x, strict=True):
                    part, gradient = encoder_gradient(np.stack(x), np.asarray(y), w, tau)
                    total, loss, n = total + np.rint(gradient * unit).astype(np.int64), loss + round(part * unit), n + 1
            yield pd.DataFrame({"i": np.arange(-2, total.size), "v": np.concatenate([[n, loss], total.ravel()])})

        found = {r.i: int(r.v) for r in dealt.mapInPandas(run, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
        n = found[-2]
        gradient = np.array([found[i] for i in range(w.size)], float).reshape(w.shape) / unit / n
        losses.append(found[-1] / unit / n)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w = w - rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    return w, losses


def _unit(u: np.ndarray) -> np.ndarray:
    return u / np.maximum(np.sqrt((u**2).sum(1, keepdims=True)), 1e-12)


def encoded(rows: DataFrame, weights: DataFrame, keys: tuple[str, ...], name: str = "encoder") -> DataFrame:
    """rows(keys, features) with features replaced by their unit encodings, by the stored weights."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(from_table(weights.where(F.col("name") == name))[name])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = np.stack(b.features.to_numpy()) @ shared.value if len(b) else np.zeros((0, 1))
            yield b[list(keys)].assign(features=list(_unit(u)))

    return rows.select(*keys, "features").mapInPandas(tidy(run), rows.select(*keys, "features").schema)


# scoring of other runs


def fit_state(windows: DataFrame, labels: DataFrame, weights: Weights, joint_count: int, length: int, path: str, classes: int, **training) -> list[float]:
    """Fits an encoder and a head to the network's embeddings of the windows of labels(run, y), and writes network, encoder and head as one table of weights at path; returns the encoder's losses."""
    from kinelake.operators.probes import fit_classes

    spark = windows.sparkSession
    network = to_table(spark, with_data_norm(windows, weights, length))
    marked = network_scores(windows, network, joint_count, length).join(labels, "run").select("run", "start", "y", F.col("embedding").alias("features"))
    marked = cut(marked)
    encoder, losses = train_encoder(marked, 32, ("run", "start"), **training)
    held = to_table(spark, {"encoder": encoder})
    model = fit_classes(encoded(marked, held, ("run", "start", "y")), penalty=1e-3)
    scaler, head = model.stages
    spread = np.array(scaler.std)
    by = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0)
    matrix = head.coefficientMatrix.toArray() * by
    state = {"encoder": encoder, "classes.w": matrix.T, "classes.b": head.interceptVector.toArray() - matrix @ np.array(scaler.mean)}
    network.unionByName(to_table(spark, state)).write.mode("errorifexists").parquet(path)
    return losses


def score_runs(windows: DataFrame, path: str, joint_count: int, length: int, network: Callable = residual_embedding, block: int = 16) -> DataFrame:
    """(run, start, p) of windows by the state stored at path, alone. Network, encoder and head are one step, so a task has one Python worker and not one for each."""
    spark = windows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(from_table(spark.read.parquet(path)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for part, e in _embedded(batches, w, network, joint_count, length, block):
            yield part[["run", "start"]].assign(p=list(softmax(dense(_unit(e @ w["encoder"]), w, "classes"))))

    schema = windows.select("run", "start").schema.add("p", ArrayType(DoubleType()))
    return windows.select("run", "start", "real", "x").mapInPandas(tidy(run), schema)


def vote_of_runs(scored: DataFrame) -> DataFrame:
    """(run, windows, p, pred): the mean of the windows' probabilities of a run, and the first largest."""
    each = scored.select("run", F.posexplode("p").alias("k", "p"))
    means = each.groupBy("run", "k").agg(F.count("*").alias("windows"), F.avg("p").alias("p"))
    top = means.withColumn("at", F.row_number().over(W.partitionBy("run").orderBy(F.desc(F.round("p", 9)), "k"))).where("at = 1")
    return top.select("run", "windows", "p", F.col("k").alias("pred"))
