"""Where to intervene first: scores from a building's place in the network, and picks that keep their distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import _checkpoint
from .graphs import both_ways, hop_distance

#: Weights of the parts of a score, and distances beyond so many hops count as so many.
LOCAL, NETWORK, POSITION, CASCADE, DIVERSITY, BOUNDARY, FAR = 0.3, 0.7, 0.2, 0.3, 0.2, 0.5, 10


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (t, v) -> t + v)"


def _cosine(a: str, b: str) -> Column:
    return F.expr(f"coalesce(try_divide({_dot(a, b)}, sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})), 0D)")


def _scaled(df: DataFrame, *cols: str) -> DataFrame:
    """cols, each over its largest value where that is above 0; df is evaluated once."""
    df = _checkpoint(df)
    top = df.agg(*(F.max(c).alias(f"_top_{c}") for c in cols))
    over = {c: F.when(F.col(f"_top_{c}") > 0, F.col(c) / F.col(f"_top_{c}")).otherwise(F.col(c)) for c in cols}
    return df.crossJoin(F.broadcast(top)).withColumns(over).select(*df.columns)  # one row


def position_value(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, position): half the degree, half how much the embeddings (node, embedding) of its neighbours differ from its own, each over the largest."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()  # each pair is compared once
    v = nodes.select("node", F.col("embedding").cast("array<double>").alias("v")).withColumn("n", F.expr(f"sqrt({_dot('v', 'v')})"))
    j = e.join(v.withColumnsRenamed({"node": "src", "v": "x", "n": "nx"}), "src").join(v.withColumnsRenamed({"node": "dst", "v": "y", "n": "ny"}), "dst")
    j = j.select("src", "dst", F.expr(f"1 - coalesce(try_divide({_dot('x', 'y')}, nx * ny), 0D)").alias("bridge"))
    ends = j.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "bridge")
    g = ends.groupBy("node").agg(F.count("*").cast("double").alias("degree"), F.sum("bridge").alias("bridge"))
    g = _scaled(g, "degree", "bridge")
    return g.select("node", (0.5 * F.col("degree") + 0.5 * F.col("bridge")).alias("position"))


def cascade_potential(hops: DataFrame) -> DataFrame:
    """(node, cascade): the variance of a node's features at each hop (node, hop, features), half of it from the second hop on, over the largest sum."""
    n, mean = "size(features)", "aggregate(features, 0D, (t, x) -> t + x) / size(features)"
    var = F.expr(f"CASE WHEN {n} > 1 THEN aggregate(transform(features, x -> pow(x - {mean}, 2)), 0D, (t, x) -> t + x) / ({n} - 1) ELSE 0D END")
    h = hops.select("node", "hop", F.col("features").cast("array<double>").alias("features")).withColumn("_v", var * F.when(F.col("hop") <= 1, 1.0).otherwise(0.5))
    return _scaled(h.groupBy("node").agg(F.sum("_v").alias("cascade")), "cascade")


def rank_interventions(nodes: DataFrame, edges: DataFrame, impacts: DataFrame, hops: DataFrame, existing: DataFrame | None = None, spacing: int = 2) -> DataFrame:
    """(node, local, network, position, cascade, bonus, score): every node's worth, the network's part weighing most.

    nodes: node, label_score, roof, embedding, violation (0 to 1). impacts: node, hop, impact, summed over the hops. hops: node, hop,
    features. existing: node. Nodes in ``existing`` score minus infinity; those nearer than ``spacing`` hops to one keep a
    tenth; a node that breaks transformer boundaries loses half of the violation.
    """
    local = _scaled(nodes.select("node", F.col("roof").cast("double").alias("roof"), "label_score", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce("violation", F.lit(0.0)).alias("violation")), "roof")
    n = local.withColumn("local", 0.5 * F.col("label_score") + 0.5 * F.col("roof")).drop("roof", "label_score")
    n = n.join(impacts.groupBy("node").agg(F.sum("impact").alias("network")), "node", "left").join(position_value(nodes, edges), "node", "left").join(cascade_potential(hops), "node", "left").fillna(0.0, ["network", "position", "cascade"])
    bonus, near = F.lit(0.0), F.lit(None).cast("int")
    if existing is not None:
        mean = nodes.select("node", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).join(existing.select("node").distinct(), "node", "left_semi").groupBy("i").agg(F.avg("x").alias("m"))
        mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))  # a row a dimension
        n = n.crossJoin(F.broadcast(mean)).join(hop_distance(edges, existing, FAR), "node", "left")  # one row
        near = F.coalesce("hop", F.lit(FAR))
        bonus = F.when(F.size("mean") > 0, 0.7 * (1 - _cosine("embedding", "mean")) + 0.3 * near / float(FAR)).otherwise(0.0)
    n = n.withColumn("bonus", bonus)
    score = LOCAL * F.col("local") + NETWORK * F.col("network") + POSITION * F.col("position") + CASCADE * F.col("cascade") + DIVERSITY * F.col("bonus")
    if existing is not None:
        score = F.when(near == 0, float("-inf")).otherwise(score * F.when(near < spacing, 0.1).otherwise(1.0))
    return n.select("node", "local", "network", "position", "cascade", "bonus", (score * (1 - BOUNDARY * F.col("violation"))).alias("score"))


def _between(edges: DataFrame, left: DataFrame, distance: int) -> DataFrame:
    """The edges (both ways) on paths of at most ``distance`` hops between nodes of ``left``."""
    near = left.select("node", F.lit(0).alias("h"))
    for _ in range(distance - 1):
        step = edges.join(near.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("h") + 1).alias("h"))
        near = _checkpoint(near.unionByName(step).groupBy("node").agg(F.min("h").alias("h")))
    j = edges.join(near.withColumnsRenamed({"node": "src", "h": "_a"}), "src").join(near.withColumnsRenamed({"node": "dst", "h": "_b"}), "dst")
    return j.where(F.col("_a") + F.col("_b") < distance).select("src", "dst")


def spaced_selection(nodes: DataFrame, edges: DataFrame, distance: int = 2, rounds: int = 200) -> DataFrame:
    """(node, score, round): the picks of a walk by falling score (ties: smaller node) that skips what lies within ``distance`` hops of an earlier pick.

    nodes: node, score; edges: src, dst; paths may pass any node. It is the greedy weighted independent set of the ``distance``-hop
    graph, found without building that graph: in a round every undecided node that is the best undecided one within
    ``distance`` hops is picked and those around it are out, as in the walk. A round is ``distance`` steps of a maximum over
    neighbours and as many of spreading the picks, each one aggregate with a partial sum on the map side, so a hub costs its
    edges and not their pairs. Only edges on some path of ``distance`` hops between undecided nodes are kept for the next round, so
    rounds shrink. Nodes of score minus infinity or null are never picked. Raises if ``rounds`` do not suffice.
    """
    e = _checkpoint(both_ways(edges.select("src", "dst")).where("src <> dst").distinct())
    worth = F.round("score", 9)
    left = _checkpoint(nodes.where(F.col("score").isNotNull() & (F.col("score") > float("-inf"))).groupBy("node").agg(F.max(worth).alias("score")))
    out = None
    for r in range(rounds):
        best = left.select("node", F.struct("score", (-F.col("node")).alias("n")).alias("top"))
        for _ in range(distance):
            near = e.join(best.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "top")
            best = best.unionByName(near).groupBy("node").agg(F.max("top").alias("top"))
        picks = left.join(best, "node").where(F.col("node") == -F.col("top.n"))
        picks = _checkpoint(picks.select("node", "score", F.lit(r + 1).alias("round")))
        out = picks if out is None else out.unionByName(picks)
        gone = picks.select("node")
        for _ in range(distance):
            gone = gone.unionByName(e.join(gone.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))).distinct()
        left = _checkpoint(left.join(gone, "node", "left_anti"))
        if left.isEmpty():
            return out
        e = _checkpoint(_between(e, left, distance))
    raise RuntimeError("spaced_selection did not converge")
