"""Where solar pays: scored candidates, the set a cluster takes, and priorities with learnt weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kWh a kWp and year, scores by orientation, multipliers by cluster quality, scores by label, and the weights of a priority.
IRRADIANCE = {"north": 900, "south": 1200, "east": 1050, "west": 1050, "flat": 1100, "unknown": 1000}
ORIENTATION = {"south": 0.3, "south-east": 0.25, "south-west": 0.25, "east": 0.2, "west": 0.2, "flat": 0.25, "north": 0.1, "unknown": 0.15}
QUALITY = {"poor": 1.5, "fair": 1.2, "good": 1.0, "excellent": 0.9}
LABELS = {"G": 1.0, "F": 0.9, "E": 0.8, "D": 0.6, "C": 0.4, "B": 0.2, "A": 0.1, "A+": 0.05, "A++": 0.02, "A+++": 0.01, "A++++": 0.0}
FACING = {"south": 1.0, "south-east": 0.95, "south-west": 0.95, "east": 0.85, "west": 0.85, "flat": 0.9, "north-east": 0.65, "north-west": 0.65, "north": 0.5}
YIELD = {"south": 1.0, "east": 0.85, "west": 0.85}
WEIGHTS = {"energy_label": 0.3, "roof_potential": 0.2, "cascade_impact": 0.2, "demand_match": 0.2, "cluster_benefit": 0.1}
LOSSES, COST_KWP, PRICE, FEED_IN, UPKEEP = 0.14, 1000.0, 0.25, 0.08, 20.0
#: A cluster with more candidates that could be taken than this is walked by rounds of aggregates instead of one array.
FOLD = 256


def picked(col: Column, values: dict, other: float) -> Column:
    out = F.when(F.lit(False), F.lit(float(other)))
    for k, v in values.items():
        out = out.when(col == k, float(v))
    return out.otherwise(float(other))


def _function(*words: str) -> Column:
    return F.lower("function").rlike("|".join(words))


def technical_score(smallest: float = 20.0) -> Column:
    """Roof, orientation, height and use together, 0 to 1; 0 where the suitable area is too small."""
    area = F.col("suitable_area")
    roof = F.when(area >= 100, 0.3).when(area >= 50, 0.2).when(area >= smallest, 0.1)
    height = F.when(F.col("height") > 15, 0.2).when(F.col("height") > 10, 0.15).otherwise(0.1)
    use = F.when(_function("commercial", "office"), 0.2).when(_function("industrial"), 0.15).otherwise(0.1)
    return F.when(roof.isNull(), 0.0).otherwise(F.least(F.lit(1.0), roof + picked(F.lower("orientation"), ORIENTATION, 0.15) + height + use))


def solar_candidates(b: DataFrame, daytime: DataFrame | None = None, pairs: DataFrame | None = None, quality: DataFrame | None = None, least: float = 0.6, largest: float = 100.0) -> DataFrame:
    """Buildings whose technical score is at least ``least``, with size, yield, economics and total score.

    b: building_id, cluster_id, suitable_area, orientation, height, function, has_solar, solar_kw, avg_kw. daytime: building_id,
    ratio of the mean load from 9 to 17 to the mean load. pairs: a, b, complementarity; what a building gains is
    summed over its cluster's residential buildings without solar, each pair counting for both ends. quality: cluster_id,
    quality. Buildings with more than 10 kW have enough.
    """
    share = b.groupBy("cluster_id").agg((F.avg(F.coalesce("has_solar", F.lit(False)).cast("int")) < 0.3).alias("_needs"))
    c = b.where(~(F.coalesce("has_solar", F.lit(False)) & (F.coalesce("solar_kw", F.lit(0)) > 10))).withColumn("technical", technical_score())
    c = c.where(F.round("technical", 9) >= least).join(share, "cluster_id", "left")
    if daytime is None:
        c = c.withColumn("self_consumption", F.lit(0.3))
    else:
        ratio = daytime.select("building_id", F.least(F.lit(0.7), F.col("ratio") * 1.2).alias("self_consumption"))
        c = c.join(ratio, "building_id", "left").fillna(0.3, ["self_consumption"])
    if pairs is None:
        c = c.withColumn("_gain", F.lit(0.0))
    else:
        evening = b.where(~F.coalesce("has_solar", F.lit(False)) & _function("residential")).select(F.col("building_id").alias("other"), F.col("cluster_id").alias("_k"))
        both = pairs.where("complementarity > 0").select(F.col("a").alias("building_id"), F.col("b").alias("other"), "complementarity").union(pairs.where("complementarity > 0").select("b", "a", "complementarity"))
        place = b.select("building_id", F.col("cluster_id").alias("_own"))
        gain = both.join(evening, "other").join(place, "building_id").where("_own = _k").groupBy("building_id").agg((0.1 * F.sum("complementarity")).alias("_gain"))
        c = c.join(gain, "building_id", "left").fillna(0.0, ["_gain"])
    factor = F.lit(1.0)
    if quality is not None:
        c = c.join(quality.select("cluster_id", F.lower("quality").alias("_quality")), "cluster_id", "left")
        factor = picked(F.col("_quality"), QUALITY, 1.0)
    size = F.least(F.col("suitable_area") / 7.0, F.col("avg_kw") * 0.7, F.lit(largest))
    c = c.withColumn("capacity_kw", F.greatest(F.lit(3.0), F.bround(size * 2, 0) / 2))
    c = c.withColumn("generation_kwh", F.col("capacity_kw") * picked(F.lower("orientation"), IRRADIANCE, 1000) * (1 - LOSSES))
    own = F.col("self_consumption")
    c = c.withColumn("savings", F.col("generation_kwh") * (own * PRICE + (1 - own) * FEED_IN) - F.col("capacity_kw") * UPKEEP).withColumn("cost", F.col("capacity_kw") * COST_KWP)
    c = c.withColumn("roi_years", F.when(F.col("savings") > 0, F.col("cost") / F.col("savings")).otherwise(999.0))
    years = F.round("roi_years", 9)
    c = c.withColumn("economic", F.when(years <= 5, 1.0).when(years <= 8, 0.8).when(years <= 12, 0.6).when(years <= 15, 0.4).otherwise(0.2))
    match = F.when(_function("office", "commercial"), 0.3).otherwise(0.0) + F.col("_gain") + F.when(F.col("_needs"), 0.2).otherwise(0.0)
    c = c.withColumn("complementarity", F.least(F.lit(1.0), match))
    total = (0.3 * F.col("technical") + 0.3 * F.col("economic") + 0.4 * F.col("complementarity")) * factor
    return c.select("cluster_id", "building_id", "technical", "economic", "complementarity", total.alias("score"), "capacity_kw", "generation_kwh", "self_consumption", "cost", "savings", "roi_years", (F.col("generation_kwh") * 0.3 / 1000).alias("co2_tons"))


_TOTAL = "aggregate({}, 0D, (t, x) -> t + x)"
_USED = _TOTAL.format("zip_with({}, consumption, (x, y) -> least(x, y))")


def greedy_solar_set(candidates: DataFrame, consumption: DataFrame, least: float = 0.3, enough: float = 0.8, fading: float = 0.1, fold: int = FOLD) -> DataFrame:
    """(cluster_id, building_id, pick, benefit, generation): candidates by falling score (ties: smaller id), each taken if it still helps enough.

    candidates: cluster_id, building_id, score, generation (array, a value a slot, none negative). consumption: cluster_id,
    consumption (array). What a candidate adds is the rise of the share of consumption that generation meets, slot by
    slot, less ``fading`` for each earlier pick; it is taken above ``least``. The walk ends once more than ``enough`` of the
    consumption is generated. ``generation`` is the sum of the picks so far. With one slot a year this is the
    yearly balance.

    A candidate that alone does not reach ``least`` never can, because what it adds only falls, so it is left out before
    anything is gathered. What remains of a cluster is folded as one array. As each pick adds more than ``least``, there are
    fewer than 1 / ``least`` of them: clusters with more than ``fold`` candidates left take that many rounds of
    aggregates instead, each finding the best next one, and no array of them is built.
    """
    c = candidates.select("cluster_id", "building_id", F.round("score", 9).alias("score"), F.col("generation").cast("array<double>").alias("generation"))
    c = c.join(consumption.select("cluster_id", F.col("consumption").cast("array<double>").alias("consumption")), "cluster_id").withColumn("total", F.expr(_TOTAL.format("consumption")))
    viable = c.where(F.round(F.expr(_USED.format("generation")) / F.col("total"), 9) > least)
    size = viable.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    small = viable.join(size.where(F.col("_n") <= fold), "cluster_id").drop("_n")
    out = _folded(small, least, enough, fading)
    large = viable.join(size.where(F.col("_n") > fold), "cluster_id").drop("_n")
    return out.unionByName(_by_rounds(large, least, enough, fading))


def _folded(viable: DataFrame, least: float, enough: float, fading: float) -> DataFrame:
    pick = "struct<building_id: bigint, benefit: double, generation: double>"
    state = f"struct<g: array<double>, used: double, done: boolean, picks: array<{pick}>>"
    grown = "zip_with(s.g, c.generation, (x, y) -> x + y)"
    benefit = f"round(({_USED.format(grown)} - s.used) / total * (1 - {fading} * size(s.picks)), 9)"
    taken = f"cast(struct({grown}, {_USED.format(grown)}, {_TOTAL.format(grown)} > {enough} * total, concat(s.picks, array(cast(struct(c.building_id, {benefit}, {_TOTAL.format(grown)}) AS {pick})))) AS {state})"
    start = f"cast(struct(transform(consumption, x -> 0D), 0D, false, cast(array() AS array<{pick}>)) AS {state})"
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "building_id", "generation")))
    g = viable.groupBy("cluster_id").agg(order.alias("items"), F.first("consumption").alias("consumption"), F.first("total").alias("total"))
    g = g.withColumn("s", F.expr(f"aggregate(items, {start}, (s, c) -> IF(NOT s.done AND {benefit} > {least}, {taken}, s))"))
    return g.select("cluster_id", F.posexplode("s.picks").alias("i", "p")).select("cluster_id", "p.building_id", (F.col("i") + 1).alias("pick"), "p.benefit", "p.generation")


def _by_rounds(viable: DataFrame, least: float, enough: float, fading: float) -> DataFrame:
    from .components import _checkpoint

    viable = _checkpoint(viable)
    grown = F.expr("zip_with(g, generation, (x, y) -> x + y)")
    now = viable.groupBy("cluster_id").agg(F.transform(F.first("consumption"), lambda x: F.lit(0.0)).alias("g"), F.lit(0.0).alias("used"), F.lit(0).alias("picks"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("long").alias("last_id"))
    out = None
    while True:
        j = viable.join(now, "cluster_id").where("last IS NULL OR score < last OR score = last AND building_id > last_id").withColumn("grown", grown)
        j = j.withColumn("now_used", F.expr(_USED.format("grown"))).withColumn("benefit", F.round((F.col("now_used") - F.col("used")) / F.col("total") * (1 - fading * F.col("picks")), 9))
        best = F.min_by(F.struct("building_id", "score", "benefit", "grown", "now_used", "total", "picks"), F.struct((-F.col("score")).alias("s"), "building_id"))
        took = _checkpoint(j.where(F.col("benefit") > least).groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", "b.*"))
        row = took.select("cluster_id", "building_id", (F.col("picks") + 1).alias("pick"), "benefit", F.expr(_TOTAL.format("grown")).alias("generation"))
        out = row if out is None else out.unionByName(row)
        now = took.where(F.expr(_TOTAL.format("grown")) <= enough * F.col("total")).select("cluster_id", F.col("grown").alias("g"), F.col("now_used").alias("used"), (F.col("picks") + 1).alias("picks"), F.col("score").alias("last"), F.col("building_id").alias("last_id"))
        if now.isEmpty():
            return out


def solar_priority(b: DataFrame, impacts: DataFrame | None = None, clusters: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Buildings without solar with their priority, expected size and years to pay back.

    b: building_id, cluster_id, label, roof, orientation, has_solar, annual_kwh. impacts: node, impact (0.5 where unknown). clusters:
    cluster_id, self_sufficiency (0.5 where unknown). weights: one row of the five weights, as ``streaming.feedback``
    keeps them; the fixed ones if not given.
    """
    c = b.where(~F.coalesce("has_solar", F.lit(False)))
    impact = F.lit(0.5)
    if impacts is not None:
        c = c.join(impacts.select(F.col("node").alias("building_id"), F.col("impact").alias("_impact")), "building_id", "left")
        impact = F.coalesce("_impact", F.lit(0.5))
    need = F.lit(0.5)
    if clusters is not None:
        c = c.join(clusters.select("cluster_id", F.col("self_sufficiency").alias("_met")), "cluster_id", "left")
        need = 1 - F.coalesce("_met", F.lit(0.5))
    if weights is None:
        w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    else:
        c = c.crossJoin(F.broadcast(weights.limit(1).select(*(F.col(k).alias(f"_w_{k}") for k in WEIGHTS))))  # one row
        w = {k: F.col(f"_w_{k}") for k in WEIGHTS}
    facing = F.lower("orientation")
    roof = F.least(F.col("roof") / 100 * picked(facing, FACING, 0.8), F.lit(1.0))
    parts = {"energy_label": picked(F.col("label"), LABELS, 0.4), "roof_potential": roof, "cascade_impact": F.least(impact, F.lit(1.0)), "demand_match": F.least(F.col("annual_kwh") / 10000, F.lit(1.0)), "cluster_benefit": need}
    kwp = F.col("roof") * 0.15 * picked(facing, YIELD, 0.8)
    made = kwp * 1200
    worth = F.least(made, F.col("annual_kwh")) * PRICE + F.greatest(F.lit(0.0), made - F.col("annual_kwh")) * FEED_IN
    return c.select("building_id", "cluster_id", sum((w[k] * parts[k] for k in WEIGHTS), F.lit(0.0)).alias("priority"), kwp.alias("kwp"), (kwp * 1200.0 / (worth + 1e-6)).alias("roi_years"))
