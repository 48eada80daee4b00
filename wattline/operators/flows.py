"""Energy flow records (ts, from_id, to_id, energy_kwh) and surplus-to-deficit matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sharing_matrix(flows: DataFrame) -> DataFrame:
    return flows.groupBy("from_id", "to_id").agg(F.sum("energy_kwh").alias("energy_kwh"))


def active_pairs(flows: DataFrame, n: int = 5) -> DataFrame:
    return sharing_matrix(flows).orderBy(F.desc("energy_kwh"), "from_id", "to_id").limit(n)


def node_stats(flows: DataFrame) -> DataFrame:
    """Energy and transactions out of and into every node."""
    out = flows.select(F.col("from_id").alias("node"), F.col("energy_kwh").alias("sent"), F.lit(None).cast("double").alias("got"))
    got = flows.select(F.col("to_id").alias("node"), F.lit(None).cast("double").alias("sent"), F.col("energy_kwh").alias("got"))
    return out.unionByName(got).groupBy("node").agg(F.coalesce(F.sum("sent"), F.lit(0.0)).alias("sent_kwh"), F.coalesce(F.sum("got"), F.lit(0.0)).alias("received_kwh"), F.count("sent").alias("n_sent"), F.count("got").alias("n_received"))


def flow_summary(flows: DataFrame) -> DataFrame:
    """Totals and the busiest sender and receiver (ties: smaller id)."""
    total = flows.agg(F.sum("energy_kwh").alias("total_kwh"), F.count("*").alias("transactions"), F.max("energy_kwh").alias("largest"))
    top = lambda c, name: flows.groupBy(c).agg(F.sum("energy_kwh").alias("e")).agg(F.max_by(c, F.struct("e", -F.col(c))).alias(name))
    return total.crossJoin(top("from_id", "top_sender")).crossJoin(top("to_id", "top_receiver"))  # one-row frames


def congestion_alerts(impacts: DataFrame, limit: float = 0.8) -> DataFrame:
    """Impacts (id, load_kw, capacity_kw) above a utilisation; stateless, so also for streams."""
    return impacts.withColumn("utilisation", F.col("load_kw") / F.col("capacity_kw")).where(F.col("utilisation") > limit)


def match_surplus(states: DataFrame, least: float = 1e-6) -> DataFrame:
    """Peer-to-peer flows inside an LV group and slot: largest surplus first to largest deficit (ties: smaller id).

    states: lv_group, slot, building_id, net (positive: needs). Surpluses, laid end to end in their order, and deficits in
    theirs are two rulers over the same energy: between two marks of either, one sender feeds one receiver. So one
    ordered window a group and slot gives all flows, in the JVM and in time linear in the buildings.
    """
    key = ["lv_group", "slot"]
    s = states.where("net <> 0").withColumn("gives", F.col("net") < 0).withColumn("kwh", F.abs("net"))
    laid = Window.partitionBy(*key, "gives").orderBy(F.desc("kwh"), "building_id").rowsBetween(Window.unboundedPreceding, 0)
    marks = s.withColumn("end", F.sum("kwh").over(laid))
    on = Window.partitionBy(*key).orderBy("end", "gives", "building_id")
    ahead = on.rowsBetween(0, Window.unboundedFollowing)
    of = lambda c: F.first(F.when(c, F.col("building_id")), ignorenulls=True).over(ahead)
    cut = marks.select(*key, of(F.col("gives")).alias("from_id"), of(~F.col("gives")).alias("to_id"), (F.col("end") - F.coalesce(F.lag("end").over(on), F.lit(0.0))).alias("energy_kwh"))
    return cut.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("energy_kwh") > least))


def delivered(flows: DataFrame, nodes: DataFrame, loss_per_100m: float = 0.02, inverter: float = 0.95) -> DataFrame:
    """flows with tier (1: same cluster within 200 m, 2: same cluster, 3: other), distance, efficiency and energy that arrives.

    nodes: building_id, cluster_id, x, y. Flows whose ends are more than 1000 m apart are not possible and go.
    """
    side = lambda c: nodes.select(F.col("building_id").alias(f"{c}_id"), F.col("cluster_id").alias(f"{c}_c"), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    j = flows.join(side("from"), "from_id").join(side("to"), "to_id")
    d = F.sqrt(F.pow(F.col("from_x") - F.col("to_x"), 2) + F.pow(F.col("from_y") - F.col("to_y"), 2))
    j = j.withColumn("distance_m", d).where(F.col("distance_m") <= 1000)
    same = F.col("from_c") == F.col("to_c")
    efficiency = F.greatest(F.least(1 - F.col("distance_m") / 100 * loss_per_100m, F.lit(1.0)), F.lit(0.0)) * inverter
    return j.select(*flows.columns, F.when(same & (F.col("distance_m") < 200), 1).when(same, 2).otherwise(3).alias("tier"), "distance_m", efficiency.alias("efficiency")).withColumn("arrives_kwh", F.col("energy_kwh") * F.col("efficiency"))


def balance(flows: DataFrame, groups: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per LV group: energy out, in, crossing its border, imbalance and whether it is within the tolerance."""
    g = groups.select("building_id", "lv_group")
    j = flows.join(g.withColumnsRenamed({"building_id": "from_id", "lv_group": "gf"}), "from_id").join(g.withColumnsRenamed({"building_id": "to_id", "lv_group": "gt"}), "to_id")
    out = j.select(F.col("gf").alias("lv_group"), F.col("energy_kwh").alias("o"), F.lit(0.0).alias("i"), F.when(F.col("gf") != F.col("gt"), F.col("energy_kwh")).otherwise(0.0).alias("x"))
    into = j.select(F.col("gt").alias("lv_group"), F.lit(0.0).alias("o"), F.col("energy_kwh").alias("i"), F.lit(0.0).alias("x"))
    s = out.unionByName(into).groupBy("lv_group").agg(F.sum("o").alias("sent"), F.sum("i").alias("received"), F.sum("x").alias("crossing"))
    off = F.try_divide(F.abs(F.col("sent") - F.col("received")), F.greatest("sent", "received"))
    return s.withColumns({"imbalance": F.coalesce(off, F.lit(0.0)), "balanced": F.coalesce(off, F.lit(0.0)) <= tolerance})


def grid_impact_summary(i: DataFrame, limit: float = 0.8, hours: float = 0.25) -> DataFrame:
    """One row over impacts (transformer_id, load_kw, capacity_kw, voltage_pu, losses_kw, congestion_level)."""
    u = F.col("load_kw") / F.col("capacity_kw")
    return i.agg(F.avg(u).alias("avg_utilisation"), F.max(u).alias("peak_utilisation"), (F.sum("losses_kw") * hours).alias("losses_kwh"), F.avg("voltage_pu").alias("voltage_pu"), F.count_if(F.col("congestion_level") > limit).alias("congested"), F.count_distinct("transformer_id").alias("transformers"))


def community_flow_stats(f: DataFrame) -> DataFrame:
    """Per cluster: community energy, transactions, mean and worth of its flows."""
    return f.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sum(F.when(F.col("flow_type") == "community", F.col("energy_kwh")).otherwise(0.0)).alias("shared"), F.count("*").alias("transactions"), F.avg("energy_kwh").alias("mean"), F.sum(F.col("energy_kwh") * F.col("price_per_kwh")).alias("worth"))


def community_summary(e: DataFrame) -> DataFrame:
    """Per cluster over exchanges (generation_kwh, consumption_kwh, shared_kwh, self_sufficiency, n_buildings)."""
    return e.groupBy("cluster_id").agg(F.avg("self_sufficiency").alias("self_sufficiency"), (F.sum("shared_kwh") / 1000).alias("shared_mwh"), F.avg("n_buildings").alias("buildings"), F.max("generation_kwh").alias("peak_generation"), F.max("consumption_kwh").alias("peak_consumption"))


def peak_hours(flows: DataFrame, n: int = 3) -> DataFrame:
    """The n hours of day in which most energy flows."""
    return flows.groupBy(F.hour("ts").alias("hour")).agg(F.sum("energy_kwh").alias("energy_kwh")).orderBy(F.desc("energy_kwh"), "hour").limit(n)


def shareable(states: DataFrame) -> DataFrame:
    """What matching can move at most per LV group and slot: the smaller of surplus and deficit."""
    g = states.groupBy("lv_group", "slot").agg(F.sum(F.greatest(-F.col("net"), F.lit(0.0))).alias("surplus"), F.sum(F.greatest(F.col("net"), F.lit(0.0))).alias("deficit"))
    return g.withColumn("shareable", F.least("surplus", "deficit"))
