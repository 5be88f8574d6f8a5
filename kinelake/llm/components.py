"""Connected components of an edge table by alternating star contraction, each round cut to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.runtime import cut

ROUNDS = 64
#: Tasks over which the members of one component are dealt when they get what belongs to it.
SALTS = 32
#: A key with over one in so many of all rows is hot.
HOT_SHARE = 5000
#: Rows up to which a side of a join is broadcast, once they were counted (about 100 bytes each, made ready to look up).
BROADCAST_ROWS = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges(a, b) of comparable, non-null values; nodes without an edge aren't returned.

    Large-star and small-star alternate until nothing changes; every round has at most as many edges as nodes and
    edges before it, and nothing but counts comes to the driver. A hub's edges are aggregated (minimum) and joined on
    the hub, where adaptive skew joins split it.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    state = None
    for _ in range(ROUNDS):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # each larger neighbour to the smallest
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = cut(low.select("a", F.col("m").alias("b")).union(small).where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def with_value(members: DataFrame, values: DataFrame, node: str = "node", key: str = "component", salts: int = SALTS) -> DataFrame:
    """members(node, key, ...) joined to values(key, ...), one row per key; a key's members are dealt over salts tasks by their node."""
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64(node), F.lit(salts)).cast("int"))
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def with_lowest(found: DataFrame) -> DataFrame:
    """Components with the row of each one's smallest node, which names itself."""
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def join_hot(rows: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to values, unique in on. Keys with over one in HOT_SHARE of all rows, so fewer than HOT_SHARE keys, are broadcast; the others are shuffled."""
    sizes = cut(rows.groupBy(*on).count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    hot = sizes.where(F.col("count") * HOT_SHARE > total).select(*on)
    hot_values, others = values.join(F.broadcast(hot), on), values.join(F.broadcast(hot), on, "left_anti")
    near = rows.join(F.broadcast(hot_values), on)
    return near.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(others, on))


def counted(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys, cut, as the side of a join that is broadcast if it has no more rows than ``most``, and shuffled otherwise: texts stay where they are while few of them are meant."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= most else keys
