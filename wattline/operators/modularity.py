"""Communities of largest modularity over weighted pairs: local moves, then contraction, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _checkpoint, small_broadcasts


def modularity_of(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity of (node, c) over edges (src, dst, weight), each once; a loop counts its weight once inside."""
    j = edges.join(communities.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(communities.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst")
    inside = j.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("w"))
    vol = j.select(F.explode(F.array("cs", "cd")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("v2"))
    r = inside.crossJoin(vol).first()  # one-row frames
    return r.w / r.m - r.v2 / (4 * r.m * r.m) if r.m else 0.0


def _moved(edges: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """((node, c), did any node move): rounds of local moves that all raise the modularity.

    Each node names the neighbouring community that gains most. A move touches the community left and the one joined; in a
    round those moves are made that are the best one for both communities they touch (ties: smaller node). No
    community is then touched twice, so the gains add up exactly and the modularity rises with every round; the best move
    of all is always among them, so a round without a move is a local optimum.
    """
    both = edges.where("src <> dst").select("src", "dst", "weight").union(edges.where("src <> dst").select("dst", "src", "weight"))
    both = _checkpoint(both)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")  # a loop has both ends at its node
    deg = _checkpoint(ends.groupBy("node").agg(F.sum("weight").alias("d")))
    m2 = deg.agg(F.sum("d").alias("m2"))
    now = _checkpoint(deg.select("node", F.col("node").alias("c")))
    moved = False
    for _ in range(rounds):
        vol = now.join(deg, "node").groupBy("c").agg(F.sum("d").alias("vol"))
        link = both.join(now.withColumnsRenamed({"node": "dst"}), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("weight").alias("k"))
        own = now.withColumnRenamed("c", "own").join(deg, "node").join(vol.withColumnsRenamed({"c": "own", "vol": "own_vol"}), "own").crossJoin(F.broadcast(m2))  # one row
        stay = link.join(now, ["node", "c"]).select("node", F.col("k").alias("own_k"))
        j = link.join(own, "node").where("c <> own").join(stay, "node", "left").join(vol, "c").fillna(0.0, ["own_k"])
        gain = F.round(2 * (F.col("k") - F.col("own_k")) / F.col("m2") - 2 * F.col("d") * (F.col("vol") - F.col("own_vol") + F.col("d")) / (F.col("m2") * F.col("m2")), 12)
        best = j.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c", "own")).alias("b")).select("node", F.col("b.g").alias("g"), F.col("b.c").alias("to"), F.col("b.own").alias("own"))
        best = _checkpoint(best)
        if best.isEmpty():
            return now, moved
        moved = True
        rank = F.struct("g", "node")
        touch = best.select(F.explode(F.array("to", "own")).alias("c"), rank.alias("r")).groupBy("c").agg(F.min("r.node").alias("x"), F.min("r").alias("r")).select("c", F.col("r.node").alias("first"))
        go = best.join(touch.withColumnsRenamed({"c": "to", "first": "f1"}), "to").join(touch.withColumnsRenamed({"c": "own", "first": "f2"}), "own").where("f1 = node AND f2 = node").select("node", "to")
        now = _checkpoint(now.join(go, "node", "left").select("node", F.coalesce("to", "c").alias("c")))
    raise RuntimeError("modularity_communities did not converge")


def modularity_levels(pairs: DataFrame, rounds: int = 500, levels: int = 30) -> tuple[DataFrame, list[float]]:
    """((building_id, cluster_id), modularity after each level) of pairs (a, b, weight), cluster_id its smallest building.

    A level moves single nodes until none gains, then contracts every community to one node whose loop has the weight
    inside, and the next level moves those; it ends when a level moves nothing. Rows of one pair add up; those of no or
    negative weight, null ends or two equal ends are left out. A hub costs its edges: all steps are joins on a node or community and
    aggregates with a partial sum on the map side. Raises if the rounds do not suffice.
    """
    p = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b AND weight > 0")
    e = first = _checkpoint(p.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum(F.round("weight", 9)).alias("weight")))
    whole, found = None, []
    for _ in range(levels):
        with small_broadcasts(e.sparkSession):
            now, moved = _moved(e, rounds)
        whole = now if whole is None else _checkpoint(whole.withColumnRenamed("c", "_n").join(now.withColumnRenamed("node", "_n"), "_n").select("node", "c"))
        found.append(modularity_of(first, whole))
        if not moved:
            break
        c = lambda side: now.withColumnsRenamed({"node": side, "c": f"c{side}"})  # noqa: B023, E731
        up = e.join(c("src"), "src").join(c("dst"), "dst")
        e = _checkpoint(up.groupBy(F.least("csrc", "cdst").alias("src"), F.greatest("csrc", "cdst").alias("dst")).agg(F.sum("weight").alias("weight")))
    else:
        raise RuntimeError("modularity_communities did not converge")
    low = whole.groupBy("c").agg(F.min("node").alias("cluster_id"))
    return whole.join(low, "c").select(F.col("node").alias("building_id"), "cluster_id"), found


def modularity_communities(pairs: DataFrame, rounds: int = 500) -> DataFrame:
    """(building_id, cluster_id): the communities of ``modularity_levels``."""
    return modularity_levels(pairs, rounds)[0]
