"""Queries of graph networks, and the oracles of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.operators import networks as n
from kinelake.operators.pose import JOINT_SETS, graph_edges, normalized_adjacency
from kinelake.runtime import checkpoint_dir
from kinelake.sources import views as v
from kinelake.sources.views import duck

SET, LENGTH, STEP, CLASSES = "body", 40, 20, 5
_N = len(JOINT_SETS[SET])
_C = sum(len(c) for c in n.BRANCHES.values())


def _windows(spark, d):
    return n.window_tensors(v.v_frames(spark, d), SET, LENGTH, STEP)


def _adjacency(spark):
    return n.as_matrix(normalized_adjacency(graph_edges(spark, SET), _N), _N)


def residual_scores(spark, d):
    """Class probabilities of every window by the residual graph network, untrained, its input norm fitted to all windows."""
    w = _windows(spark, d)
    weights = n.with_data_norm(w, n.residual_weights(_adjacency(spark), _C, CLASSES), LENGTH)
    return n.network_scores(w, n.to_table(spark, weights), _N, LENGTH).select("run", "start", "p")


def branched_scores(spark, d):
    """The same by the network of graph parts and time scales."""
    w, parts = _windows(spark, d), n.graph_parts(n.inward(SET, spark), _N)
    stacked = n.np.stack([n.as_matrix(parts.where(F.col("part") == p), _N) for p in ("root", "inward", "outward")])
    weights = n.with_data_norm(w, n.branched_weights(stacked, _C, CLASSES), LENGTH)
    return n.network_scores(w, n.to_table(spark, weights), _N, LENGTH, n.branched_embedding).select("run", "start", "p")


def graph_parts(spark, d):
    """The directed parts of the body's graph, each entry with its joints' hops from the root and their mean distance in each run."""
    links = n.inward(SET, spark)
    hops = n.hop_distances(links, JOINT_SETS[SET].index(5))
    at = lambda c: hops.select(F.col("j").alias(c), F.col("hop").alias(f"hop_{c}"))
    parts = n.graph_parts(links, _N).join(at("i"), "i").join(at("j"), "j")
    place = F.array(*[F.lit(j) for j in JOINT_SETS[SET]])
    held = [F.struct(*[F.lit(x).alias(c) for c, x in r.asDict().items()]) for r in parts.collect()]  # a few dozen rows, fixed by the joint set
    both = v.v_frames(spark, d).select("run", F.transform(place, lambda j: F.get("joints", j)).alias("js"), F.explode(F.array(*held)).alias("e")).select("run", "js", "e.*")
    a, b = F.get("js", F.col("i")), F.get("js", F.col("j"))
    reach = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    per = both.groupBy("run", "part", "i", "j").agg(F.max("w").alias("w"), F.max("hop_i").alias("hop_i"), F.max("hop_j").alias("hop_j"), F.avg(reach).alias("reach"))
    return per.select("run", "part", "i", "j", F.round("w", 6).alias("w"), "hop_i", "hop_j", F.round("reach", 6).alias("reach"))


def contrastive_encoder(spark, d):
    """Loss of each epoch of an encoder of faces trained to tell conductors apart."""
    rows = v.v_faces(spark, d).select("vec_id", F.col("conductor").alias("y"), F.col("emb").alias("features"))
    _, losses = n.train_encoder(rows, 16, ("vec_id",), epochs=8)
    return spark.createDataFrame([(i, round(x, 9)) for i, x in enumerate(losses)], "epoch int, loss double")


def held_out_runs(spark, d):
    """Runs whose number leaves 3 or 4 modulo 5, scored by a state that was fitted to the others and stored: their parity is to be told."""
    w, path = _windows(spark, d), f"{checkpoint_dir(spark)}/state_{uuid.uuid4().hex}"
    labels = w.where("run % 5 < 3").select("run", (F.col("run") % 2).cast("int").alias("y")).distinct()
    n.fit_state(w.join(labels.select("run"), "run", "left_semi"), labels, n.residual_weights(_adjacency(spark), _C, 2), _N, LENGTH, path, 2, epochs=8)
    return n.vote_of_runs(n.score_runs(w.where("run % 5 >= 3"), path, _N, LENGTH)).select("run", "windows", F.round("p", 6).alias("p"), "pred")


QUERIES = {f.__name__: f for f in (residual_scores, branched_scores, graph_parts, contrastive_encoder, held_out_runs)}

_LIST = "[" + ", ".join(map(str, JOINT_SETS[SET])) + "]"


def _links() -> str:
    from kinelake.operators.pose import parents

    joints = JOINT_SETS[SET]
    return ", ".join(f"({joints.index(c)}, {joints.index(p)})" for c, p in [*parents(SET).items(), (0, 6)] if c != p)


ORACLES = {
    "graph_parts": duck("v_frames")
    + f""", links(child, parent) AS (VALUES {_links()}),
both_ways AS (SELECT child AS a, parent AS b FROM links UNION SELECT parent, child FROM links),
walk AS (SELECT {JOINT_SETS[SET].index(5)} AS j, 0 AS hop UNION SELECT b, hop + 1 FROM walk JOIN both_ways ON a = j WHERE hop < {_N}),
hops AS (SELECT j, min(hop) AS hop FROM walk GROUP BY j),
parts AS (SELECT 'root' AS part, j AS i, j FROM hops UNION SELECT 'inward', parent, child FROM links UNION SELECT 'outward', child, parent FROM links),
weighed AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY part, j) AS w FROM parts),
held AS (SELECT run, t, CAST(list_position({_LIST}, j) - 1 AS INTEGER) AS j, x, y FROM v_frames WHERE j IN ({_LIST[1:-1]}))
SELECT a.run, part, CAST(weighed.i AS INTEGER) AS i, CAST(weighed.j AS INTEGER) AS j, round(max(w), 6) AS w, CAST(max(p.hop) AS INTEGER) AS hop_i, CAST(max(q.hop) AS INTEGER) AS hop_j,
       round(avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS reach
FROM weighed JOIN hops p ON p.j = weighed.i JOIN hops q ON q.j = weighed.j JOIN held a ON a.j = weighed.i JOIN held b ON b.j = weighed.j AND a.run = b.run AND a.t = b.t
GROUP BY a.run, part, weighed.i, weighed.j""",
}
