"""Yearly solar roadmaps, intervention mixes and rankings of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import running

#: Weights of the years of a cascade roadmap.
CASCADE_WEIGHTS = (2.0, 1.8, 1.5, 1.2, 1.0)


def roadmap(spark: SparkSession, total_area: float, years: int, strategy: str = "linear") -> DataFrame:
    """(year, area, capacity_mw): how a target area is spread over the years; 150 W a square metre."""
    if strategy == "cascade":
        weights = CASCADE_WEIGHTS[:years]
    else:
        weights = [1.5**i if strategy == "accelerated" else 1.0 for i in range(years)]
    w = F.array(*map(F.lit, [float(x) for x in weights]))
    plan = spark.range(1).select(F.posexplode(w).alias("year", "w"))
    return plan.select("year", (F.lit(float(total_area)) * F.col("w") / sum(weights)).alias("area")).withColumn("capacity_mw", F.col("area") * 0.15 / 1000)


def cluster_priorities(b: DataFrame) -> DataFrame:
    """(cluster_id, priority): clusters with a small share of solar per roof area first; sums to 1."""
    g = b.groupBy("cluster_id").agg((F.sum(F.col("has_solar").cast("int")) / (F.sum("roof") + 1e-10)).alias("p")).withColumn("q", 1 / (F.col("p") + 0.1))
    total = g.agg(F.sum("q").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("cluster_id", (F.col("q") / F.col("t")).alias("priority"))  # one row


def installation_plan(candidates: DataFrame, plan: DataFrame, smallest: float = 2.0, largest: float = 50.0, gain: float = 0.02) -> DataFrame:
    """(year, building_id, roof, kwp): candidates (building_id, roof, score) by falling score fill the years in turn.

    The whole region's order is a running sum, so this is the prefix form: a building belongs to the year in whose
    cumulative area its own running area ends; the fold that skips a too large one is ``planning.budgeted_selection``.
    """
    bound = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    years = plan.withColumn("until", F.sum("area").over(bound)).agg(F.array_sort(F.collect_list(F.struct("until", "year"))).alias("years"))  # a few years
    run = running(candidates, [], "score", "building_id", "roof").withColumnRenamed("upto", "end")
    placed = run.crossJoin(F.broadcast(years)).withColumn("y", F.try_element_at(F.filter("years", lambda s: s["until"] >= F.col("end")), F.lit(1)))  # one row
    kwp = F.greatest(F.least(F.col("roof") * 0.15, F.lit(largest)), F.lit(smallest)) * (1 + gain * F.col("y.year"))
    return placed.where("y IS NOT NULL").select(F.col("y.year").alias("year"), "building_id", "roof", kwp.alias("kwp"))


def plan_years(plan: DataFrame, consumption_kwh: float, cost: float = 1200.0, learning: float = 0.05) -> DataFrame:
    """Per year: capacity, budget with learning, cumulative capacity, energy, CO2, peak cut and self-sufficiency."""
    y = plan.groupBy("year").agg(F.count("*").alias("buildings"), F.sum("kwp").alias("kwp"))
    y = y.withColumns({"budget": F.col("kwp") * cost * F.pow(F.lit(1 - learning), F.col("year")), "total_kwp": F.sum("kwp").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0))})
    kwh = F.col("total_kwp") * 1200
    return y.withColumns({"energy_gwh": kwh / 1e6, "co2_tons": kwh / 1e6 * 1000 * 0.4, "peak_cut_mw": F.col("total_kwp") * 0.6 / 1000, "self_sufficiency": F.least(kwh / (F.lit(consumption_kwh) + 1e-10), F.lit(1.0))})


def intervention_mix(items: DataFrame, budget: float, group: str = "lv_group") -> DataFrame:
    """Items (group, item_id, value, cost) taken by value for cost while the group's budget lasts.

    With one budget row and bounds of 0 and 1 the linear optimum is this prefix and a share of the next item, which is
    taken too if it is more than half.
    """
    w = Window.partitionBy(group).orderBy(F.desc(F.round(F.col("value") / F.col("cost"), 9)), "item_id")
    run = items.withColumns({"rank": F.row_number().over(w), "spent": F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    share = F.least(F.lit(1.0), (budget - (F.col("spent") - F.col("cost"))) / F.col("cost"))
    return run.withColumn("share", share).where(F.col("share") > 0.5).withColumn("phase", F.when(F.col("spent") <= budget / 3, 1).when(F.col("spent") <= 2 * budget / 3, 2).otherwise(3))


def dependency_closure(chosen: DataFrame, needs: DataFrame, rounds: int = 1000) -> DataFrame:
    """(item_id): chosen items and what they need (item_id, needs_id), level by level, each level stored; raises if it does not end."""
    from .components import _checkpoint

    found = edge = _checkpoint(chosen.select("item_id").where("item_id IS NOT NULL").distinct())
    needs = _checkpoint(needs.select("item_id", "needs_id").where("needs_id IS NOT NULL").distinct())
    for _ in range(rounds):
        edge = _checkpoint(needs.join(edge, "item_id", "left_semi").select(F.col("needs_id").alias("item_id")).distinct().join(found, "item_id", "left_anti"))
        if edge.isEmpty():
            return found
        found = _checkpoint(found.unionByName(edge))
    raise RuntimeError("dependency_closure did not end")


def recommend_next(b: DataFrame, kind: str, lagging: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The n buildings without solar that serve a target best; those of lagging clusters (cluster_id) count half more."""
    score = {"area": F.col("roof"), "buildings": F.lit(1.0), "capacity": F.col("roof") * (1 + F.col("orientation_score") * 0.2), "energy": F.col("annual_kwh")}[kind]
    c = b.where(~F.col("has_solar")).withColumn("score", score)
    if lagging is not None:
        c = c.join(lagging.select("cluster_id", F.lit(1.5).alias("_more")), "cluster_id", "left").withColumn("score", F.col("score") * F.coalesce("_more", F.lit(1.0))).drop("_more")
    return c.select("building_id", "score").orderBy(F.desc("score"), "building_id").limit(n)


def solar_system_metrics(b: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: coverage now and planned, capacity, cost, generation, CO2, payback and renewable fraction."""
    now = b.agg(F.count("*").alias("buildings"), F.count_if("has_solar").alias("with_solar"), F.sum(F.col("avg_kw") * 24 * 365).alias("consumption"))
    new = candidates.agg(F.count("*").alias("new"), F.sum("kw").alias("new_kw"), F.sum("cost").alias("cost"), F.sum("kwh").alias("kwh"), F.sum("co2").alias("co2"), F.avg("years").alias("years"))
    j = now.crossJoin(new)  # one-row frames
    return j.withColumns({"coverage": F.col("with_solar") / F.col("buildings"), "planned": (F.col("with_solar") + F.col("new")) / F.col("buildings"), "renewable": F.try_divide("kwh", "consumption")})


def deployment_stats(d: DataFrame) -> DataFrame:
    """(label, n, avg_years, best, worst): labelled installations (building_id, label, roi_years) by label."""
    key = lambda sign: F.struct(F.col("roi_years") * sign, F.col("building_id"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.avg("roi_years").alias("avg_years"), F.min_by("building_id", key(1)).alias("best"), F.min_by("building_id", key(-1)).alias("worst"))


def cluster_economics(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Investment, savings, ten-year return, 20-year present value at 5 % and viability of each cluster (cluster_id, buildings)."""
    g = items.groupBy("cluster_id").agg(F.sum("cost").alias("investment"), F.sum(F.when(F.col("kind") == "solar", F.col("cost"))).alias("solar"), F.sum("saving").alias("saving"), F.sum("co2").alias("co2"), F.avg(F.try_divide("cost", "saving")).alias("payback"))
    j = sizes.join(g, "cluster_id", "left").fillna(0.0, ["investment", "solar", "saving", "co2", "payback"])
    annuity = (1 - 1.05**-20) / 0.05
    per = lambda c: F.try_divide(c, F.col("buildings"))
    some = F.col("investment") > 0
    viability = F.when(F.col("payback") <= 0, "Unknown").when(F.col("payback") < 5, "Excellent").when(F.col("payback") < 8, "Good").when(F.col("payback") < 12, "Moderate").otherwise("Marginal")
    return j.withColumns({"per_building": per(F.col("investment")), "roi_10": F.when(some, (F.col("saving") * 10 - F.col("investment")) / F.col("investment")).otherwise(0.0), "npv_20": F.when(some, F.col("saving") * annuity - F.col("investment")).otherwise(0.0), "viability": viability})


def global_rank(c: DataFrame) -> DataFrame:
    """Candidates with their rank by falling score (ties: smaller id) and priority."""
    return running(c, [], "score", "building_id").withColumn("priority", F.when(F.col("score") > 0.8, "HIGH").otherwise("MEDIUM"))


def rank_by_cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, score): 0.4 degree share + 0.3 nearness to the centre + 0.3 roof / 100 - half the share of neighbours with solar.

    nodes: node, x, y, roof, has_solar. Degrees are normalised by row, so the degree term is 1 for a node with edges.
    """
    e = edges.select("src", "dst").distinct()
    near = e.join(nodes.select(F.col("node").alias("dst"), F.col("has_solar").cast("double").alias("s")), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("s").alias("solar"), F.lit(1.0).alias("linked"))
    centre = nodes.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    n = nodes.crossJoin(F.broadcast(centre)).withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)))  # one row
    far = n.agg(F.max("d").alias("far"))
    j = n.crossJoin(F.broadcast(far)).join(near, "node", "left")  # one row
    score = 0.4 * F.coalesce("linked", F.lit(0.0)) + 0.3 * (1 - F.coalesce(F.try_divide("d", "far"), F.lit(0.0))) + 0.3 * F.col("roof") / 100 - 0.5 * F.coalesce("solar", F.lit(0.0))
    return j.select("node", score.alias("score"))


def solar_plan_scorecard(b: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: coverage now and planned, type diversity, feasible share, renewable fraction, balance over clusters."""
    p = plan.select("building_id", "kwp").join(b, "building_id")
    types = b.agg(F.size(F.collect_set("building_type")).alias("all_types"))
    now = b.agg(F.count("*").alias("buildings"), F.count_if("has_solar").alias("with_solar"), F.sum("annual_kwh").alias("kwh"))
    new = p.agg(F.count("*").alias("planned"), F.sum("kwp").alias("kwp"), F.size(F.collect_set("building_type")).alias("types"), F.avg((F.col("roof") > 20).cast("int")).alias("feasible"))
    shares = b.join(plan.select("building_id", F.lit(1).alias("_p")), "building_id", "left").groupBy("cluster_id").agg(F.avg(F.coalesce("_p", F.lit(0))).alias("s")).agg((1 - F.stddev_pop("s")).alias("balance"))
    j = reduce(DataFrame.crossJoin, [now, new, types, shares])  # one-row frames
    return j.select((F.col("with_solar") / F.col("buildings")).alias("coverage"), ((F.col("with_solar") + F.col("planned")) / F.col("buildings")).alias("planned_coverage"), (F.col("types") / F.col("all_types")).alias("diversity"), "feasible", F.least(F.col("kwp") * 1200 / F.col("kwh"), F.lit(1.0)).alias("renewable"), "balance")


def retrofit_plan_scorecard(items: DataFrame, payback: float = 15.0) -> DataFrame:
    """One row: energy and CO2 saved, cost, share that pays back in time, clusters reached."""
    years: Column = F.try_divide("investment", "saving")
    return items.agg(F.count("*").alias("buildings"), F.sum("saved_kwh").alias("kwh"), F.sum("co2_tons").alias("co2_tons"), F.sum("investment").alias("investment"), F.avg((years <= payback).cast("int")).alias("in_time"), F.count_distinct("cluster_id").alias("clusters"))


def recommendations(b: DataFrame) -> DataFrame:
    """(building_id, kind, priority): six rule sets over the same buildings, as one list."""
    rule = lambda kind, keep, priority: b.where(keep).select("building_id", F.lit(kind).alias("kind"), priority.alias("priority"))
    poor, roof = F.col("label").isin("E", "F", "G"), F.col("roof_flat") + F.col("roof_sloped")
    rules = [
        rule("solar", ~F.col("has_solar") & (roof > 50), F.when(roof > 100, "high").otherwise("medium")), rule("storage", F.col("has_solar") & ~F.col("has_battery"), F.lit("medium")), rule("retrofit", poor, F.when(F.col("label") == "G", "high").otherwise("medium")),
        rule("demand_response", F.col("peak_hour").between(17, 21), F.lit("low")), rule("grid", F.col("is_problematic"), F.lit("high")), rule("smart_meter", F.col("annual_kwh") > 20000, F.lit("low")),
    ]
    return reduce(DataFrame.unionByName, rules)


def select_k(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(node, rank, score): k times the best node is taken; its neighbours' scores then count 0.56, those two hops away 1.2 times.

    k is a small parameter; each round is one broadcast of the last pick and one pass over its neighbours.
    """
    from .components import _checkpoint

    e = _checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    left, out = nodes.select("node", "score"), None
    for i in range(k):
        left = _checkpoint(left)
        best = left.orderBy(F.desc(F.round("score", 9)), "node").limit(1)
        row = _checkpoint(best.withColumn("rank", F.lit(i + 1)))
        out = row if out is None else out.unionByName(row)
        one = e.join(F.broadcast(row.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()  # one row
        two = e.join(one.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(one, "node", "left_anti")
        factor = one.select("node", F.lit(0.56).alias("f")).unionByName(two.select("node", F.lit(1.2).alias("f")))
        left = left.join(F.broadcast(row.select("node")), "node", "left_anti").join(factor, "node", "left").select("node", (F.col("score") * F.coalesce("f", F.lit(1.0))).alias("score"))  # one row
    return out
