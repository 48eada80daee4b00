"""Bounded graph operators on edge lists (src, dst[, weight]); every hop is one join.

Walks store each hop in the checkpoint folder, so the plan does not grow with the hops, and end early on an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import _checkpoint


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select("dst", "src", *rest))


def degree(edges: DataFrame) -> DataFrame:
    """Degree of every node, also over the largest one."""
    d = both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("degree"))
    top = d.agg(F.max("degree").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("node", "degree", (F.col("degree") / F.col("top")).alias("normalised"))  # top: one row


def hop_distance(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(node, hop) of the nodes within ``hops`` of any source; a node keeps its first hop."""
    e = _checkpoint(both_ways(edges.select("src", "dst")).distinct())
    edge = seen = _checkpoint(sources.select("node", F.lit(0).alias("hop")).distinct())
    for h in range(1, hops + 1):
        edge = _checkpoint(e.join(edge.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(h).alias("hop")))
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def cascade(edges: DataFrame, sources: DataFrame, hops: int = 3, decay: float = 0.7, least: float = 0.1) -> DataFrame:
    """(node, impact): a node gets the mean impact of its neighbours times ``decay``, hop by hop; its largest counts, if above ``least``.

    Edges count once whatever their weight; nothing is pruned between hops, as many small impacts can add up.
    """
    e = both_ways(edges.select("src", "dst")).distinct()
    own = e.groupBy("src").agg(F.count("*").alias("d"))
    w = _checkpoint(e.join(own, "src").select(F.col("src").alias("node"), F.col("dst").alias("from"), (1 / F.col("d")).alias("w")))
    now = _checkpoint(sources.select("node", F.lit(1.0).alias("impact")))
    found = [now]
    for _ in range(hops):
        now = _checkpoint(w.join(now.withColumnRenamed("node", "from"), "from").groupBy("node").agg((F.sum(F.col("w") * F.col("impact")) * decay).alias("impact")))
        if now.isEmpty():
            break
        found.append(now)
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("impact").alias("impact")).where(F.col("impact") > least)


def cascade_benefits(hops: DataFrame, impacts: DataFrame, kwp: float) -> DataFrame:
    """One row: what one installation of kwp brings the network, from its hop distances and impacts."""
    h = hops.agg(F.count_if(F.col("hop") == 1).alias("one"), F.count_if(F.col("hop") == 2).alias("two"))
    i = impacts.agg(F.sum("impact").alias("total"), F.count("*").alias("affected"))
    volt = 0.02 + 0.01 * F.col("one") / 100 + 0.005 * F.col("two") / 100
    return h.crossJoin(i).select(F.lit(kwp * 0.6).alias("peak_cut_kw"), F.least(F.lit(5.0), volt * 100).alias("voltage_pct"), F.lit(kwp * 0.6 / 1000).alias("relief_mw"), (F.col("total") * kwp * 100).alias("network_value"), "affected")  # one-row frames


def yearly_cascade(impacts: DataFrame, years: int, keep: float = 0.95) -> DataFrame:
    """(year, new, cumulative, growth) of impacts (node, year, impact): what is left of each year's impact falls by ``keep``."""
    y = impacts.groupBy("year").agg(F.sum("impact").alias("new"))
    grid = y.select(F.explode(F.sequence(F.col("year"), F.lit(years))).alias("at"), "year", "new")
    c = grid.groupBy(F.col("at").alias("year")).agg(F.sum(F.col("new") * F.pow(F.lit(keep), F.col("at") - F.col("year"))).alias("cumulative"), F.sum(F.when(F.col("at") == F.col("year"), F.col("new")).otherwise(0.0)).alias("new"))
    w = Window.orderBy("year")  # a row a year
    return c.withColumn("growth", F.try_divide(F.col("cumulative") - F.lag("cumulative").over(w), F.lag("cumulative").over(w)))


def impact_bands(impacts: DataFrame, least: float = 0.1) -> DataFrame:
    i = F.col("impact")
    return impacts.agg(F.count_if(i > 0.7).alias("high"), F.count_if((i > 0.3) & (i <= 0.7)).alias("medium"), F.count_if((i > least) & (i <= 0.3)).alias("low"))


def cascade_windows(history: DataFrame, days: int = 365) -> DataFrame:
    """(window, installations, impact, cumulative) of a history (ts, impact) in windows of ``days`` from its first date."""
    first = history.agg(F.min("ts").alias("_first"))
    g = history.crossJoin(F.broadcast(first)).groupBy(F.floor(F.datediff("ts", "_first") / days).alias("window")).agg(F.count("*").alias("installations"), F.sum("impact").alias("impact"))  # one row
    return g.withColumn("cumulative", F.sum("impact").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, 0)))  # a row a window


def neighbour_dissimilarity(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, dissimilarity): mean distance of a node's value from its neighbours'."""
    e = both_ways(edges.select("src", "dst")).distinct()
    j = e.join(values.select(F.col("node").alias("src"), F.col("value").alias("a")), "src").join(values.select(F.col("node").alias("dst"), F.col("value").alias("b")), "dst")
    return j.groupBy(F.col("src").alias("node")).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("dissimilarity"))


def correlation_by_hop(edges: DataFrame, values: DataFrame, hops: int = 3) -> DataFrame:
    """(hop, pairs, correlation): correlation of the values of nodes that are so many hops apart."""
    e = _checkpoint(both_ways(edges.select("src", "dst")).distinct())
    start = e.select("src").distinct().select(F.col("src").alias("a"), F.col("src").alias("b"), F.lit(0).alias("hop"))
    seen = edge = _checkpoint(start)
    for h in range(1, hops + 1):
        edge = _checkpoint(edge.join(e.select(F.col("src").alias("b"), "dst"), "b").select("a", F.col("dst").alias("b")).distinct().join(seen, ["a", "b"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(edge)
    v = values.select("node", "value")
    j = seen.where("hop > 0 AND a < b").join(v.withColumnsRenamed({"node": "a", "value": "x"}), "a").join(v.withColumnsRenamed({"node": "b", "value": "y"}), "b")
    return j.groupBy("hop").agg(F.count("*").alias("pairs"), F.corr("x", "y").alias("correlation"))


def cluster_closeness(edges: DataFrame, clusters: DataFrame, hops: int = 4) -> DataFrame:
    """Per cluster (of bounded size): reachable pairs over paths inside it of at most ``hops``, efficiency (mean 1 / length) and closeness."""
    c = clusters.select("node", "cluster_id")
    e = both_ways(edges.select("src", "dst")).distinct().join(c.withColumnsRenamed({"node": "src", "cluster_id": "k"}), "src").join(c.withColumnsRenamed({"node": "dst", "cluster_id": "k2"}), "dst").where("k = k2").select("src", "dst", "k")
    e = _checkpoint(e)
    seen = edge = _checkpoint(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "k", F.lit(1).alias("hop")))
    for h in range(2, hops + 1):
        edge = _checkpoint(edge.join(e.select(F.col("src").alias("b"), "dst"), "b").where("a <> dst").select("a", F.col("dst").alias("b"), "k").distinct().join(seen, ["a", "b"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(edge)
    size = c.groupBy("cluster_id").agg(F.count("*").alias("n"))
    g = seen.groupBy(F.col("k").alias("cluster_id")).agg(F.count("*").alias("pairs"), F.sum(1 / F.col("hop")).alias("inverse"), F.avg("hop").alias("mean_hop"))
    return size.join(g, "cluster_id").select("cluster_id", "n", "pairs", F.try_divide(F.col("inverse"), F.col("n") * (F.col("n") - 1)).alias("efficiency"), (1 / F.col("mean_hop")).alias("closeness"))


def two_hop_share(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, share): the share of nodes exactly two hops away that are in the same cluster."""
    e = _checkpoint(both_ways(edges.select("src", "dst")).distinct())
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m").where("a <> b").select("a", "b").distinct()
    two = two.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    c = clusters.select("node", "cluster_id")
    j = two.join(c.withColumnsRenamed({"node": "a", "cluster_id": "ca"}), "a").join(c.withColumnsRenamed({"node": "b", "cluster_id": "cb"}), "b")
    return j.groupBy(F.col("a").alias("node")).agg(F.avg((F.col("ca") == F.col("cb")).cast("int")).alias("share"))


def conductance(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster the weight that leaves it over the smaller of its own and the others' volume."""
    n = normalised_cut(edges, clusters)
    total = n.agg(F.sum("volume").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("cluster_id", F.try_divide(F.col("cut"), F.least("volume", F.col("_all") - F.col("volume"))).alias("conductance"))  # one row


def disagreement(edges: DataFrame, clusters: DataFrame, least: float) -> DataFrame:
    """One row: edges of at least ``least`` that clusters cut, lighter ones that they keep, and the share of both in all."""
    c = clusters.select("node", "cluster_id")
    j = edges.join(c.withColumnsRenamed({"node": "src", "cluster_id": "a"}), "src").join(c.withColumnsRenamed({"node": "dst", "cluster_id": "b"}), "dst")
    heavy, same = F.col("weight") >= least, F.col("a") == F.col("b")
    return j.agg(F.count_if(heavy & ~same).alias("cut"), F.count_if(~heavy & same).alias("kept"), F.count("*").alias("edges")).withColumn("disagreement", F.try_divide((F.col("cut") + F.col("kept")).cast("double"), F.col("edges")))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Modularity of a clustering (node, cluster_id) over undirected weighted edges."""
    c = clusters.select("node", "cluster_id")
    j = edges.join(c.withColumnsRenamed({"node": "src", "cluster_id": "cs"}), "src").join(c.withColumnsRenamed({"node": "dst", "cluster_id": "cd"}), "dst")
    inside = j.where("cs = cd").groupBy(F.col("cs").alias("cluster_id")).agg(F.sum("weight").alias("within"))
    deg = both_ways(edges.select("src", "dst", "weight")).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")).join(c, "node").groupBy("cluster_id").agg(F.sum("d").alias("d"))
    m = edges.agg(F.sum("weight").alias("m"))
    return deg.join(inside, "cluster_id", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce(F.col("within"), F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))  # m: one row


def neighbourhood_agreement(edges: DataFrame, labels: DataFrame, least: float = 0.6) -> DataFrame:
    """Nodes whose neighbours share their label at a rate of at least ``least``."""
    e = both_ways(edges.select("src", "dst")).distinct()
    j = e.join(labels.withColumnsRenamed({"node": "src", "label": "own"}), "src").join(labels.withColumnsRenamed({"node": "dst", "label": "other"}), "dst")
    return j.groupBy(F.col("src").alias("node")).agg(F.avg((F.col("own") == F.col("other")).cast("int")).alias("agreement")).where(F.col("agreement") >= least)


def boundary_nodes(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes with an edge into another group."""
    e = both_ways(edges.select("src", "dst")).distinct()
    j = e.join(groups.withColumnsRenamed({"node": "src", "cluster_id": "cs"}), "src").join(groups.withColumnsRenamed({"node": "dst", "cluster_id": "cd"}), "dst")
    return j.where("cs <> cd").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("crossing"))


def hop_metrics(hops: DataFrame) -> DataFrame:
    """Nodes reached per hop and their share of all reached (hop 0 are the sources)."""
    g = hops.groupBy("hop").agg(F.count("*").alias("nodes"))
    total = g.where("hop > 0").agg(F.sum("nodes").alias("total"))
    return g.where("hop > 0").crossJoin(F.broadcast(total)).select("hop", "nodes", (F.col("nodes") / F.col("total")).alias("share"))  # total: one row


def normalised_cut(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Weight that leaves each cluster over the weight of all its ends."""
    c = clusters.select("node", "cluster_id")
    j = both_ways(edges.select("src", "dst", "weight")).join(c.withColumnsRenamed({"node": "src", "cluster_id": "cs"}), "src").join(c.withColumnsRenamed({"node": "dst", "cluster_id": "cd"}), "dst")
    return j.groupBy(F.col("cs").alias("cluster_id")).agg(F.sum(F.when(F.col("cs") != F.col("cd"), F.col("weight")).otherwise(0.0)).alias("cut"), F.sum("weight").alias("volume")).withColumn("normalised", F.try_divide("cut", "volume"))


def label_propagation(edges: DataFrame, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label): unlabelled nodes take their neighbours' heaviest label each round (ties: smaller label).

    seeds (node, label) keep theirs; every round is one join and two aggregations with map-side combine.
    """
    e = both_ways(edges.select("src", "dst", "weight"))
    known = seeds.select("node", "label")
    for _ in range(rounds):
        votes = e.join(known.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))
        known = seeds.select("node", "label").unionByName(best.join(seeds.select("node"), "node", "left_anti"))
    return known
