"""Roll-ups of buildings over LV groups, districts and MV stations.

Input: one row per building with building_id, lv_group, mv_station, district, area, label, build_year,
function, has_solar, has_battery, has_heat_pump, distance_m, peak_kw. All are single aggregates with map-side
combine; multi-level ones reuse the finer level instead of reading the buildings again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import running

#: Labels that the summaries count as poor, and those that call for a retrofit.
POOR = ("D", "E", "F", "G")
URGENT = ("E", "F", "G")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def mv_station_summary(b: DataFrame) -> DataFrame:
    """Counts, conditional counts and a text line per MV station."""
    return b.groupBy("mv_station").agg(
        F.count_distinct("lv_group").alias("lv_groups"),
        F.count("*").alias("buildings"),
        F.count_if(F.col("has_solar")).alias("solar"),
        F.count_if(F.col("label").isin(*POOR)).alias("poor_label"),
        F.count_if(F.col("function") == "residential").alias("residential"),
        F.sum("area").alias("total_area"),
        F.avg("distance_m").alias("avg_distance"),
        F.max("peak_kw").alias("max_peak"),
    ).withColumn("summary", F.concat_ws(", ", F.concat(F.col("lv_groups"), F.lit(" groups")), F.concat(F.col("buildings"), F.lit(" buildings"))))


def lv_group_summary(b: DataFrame) -> DataFrame:
    """Most frequent attributes (ties: smallest value) and extremes per LV group."""
    return b.groupBy("mv_station", "lv_group").agg(
        F.count("*").alias("buildings"), *(F.mode(c, True).alias(f"top_{c}") for c in ("label", "function", "district")), F.max("distance_m").alias("max_distance"), F.min("build_year").alias("oldest")
    )


def station_breakdown(b: DataFrame, n: int = 10) -> DataFrame:
    """The n stations with most buildings, with their districts as text and their LV groups' size."""
    per = b.groupBy("mv_station", "lv_group").agg(F.count("*").alias("k"), F.collect_set("district").alias("d"))
    top = per.groupBy("mv_station").agg(F.sum("k").alias("buildings"), F.count("*").alias("lv_groups"), F.max("k").alias("largest_group"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("d")))), ",").alias("districts"))
    return top.orderBy(F.desc("buildings"), "mv_station").limit(n)


def station_rollup(b: DataFrame) -> DataFrame:
    """Per station and in total; is_total tells the total from a null station."""
    return b.rollup("mv_station").agg(F.grouping("mv_station").alias("is_total"), F.count("*").alias("buildings"), F.sum("area").alias("area"))


def district_rollup(b: DataFrame) -> DataFrame:
    """(station, LV group, district) subtotals by grouping id, not by null tests."""
    return b.rollup("mv_station", "district", "function").agg(F.grouping_id().alias("level"), F.count("*").alias("buildings"), F.avg("peak_kw").alias("avg_peak"))


def station_comparison(b: DataFrame, least: int = 50) -> DataFrame:
    s = b.groupBy("mv_station").agg(F.count("*").alias("buildings"), F.count_distinct("lv_group").alias("groups"), share(F.col("has_solar")).alias("solar_share"), share(F.col("label").isin(*POOR)).alias("poor_share"))
    return s.where(F.col("buildings") > least).withColumn("per_group", F.col("buildings") / F.col("groups"))


def share_of_parent(b: DataFrame) -> DataFrame:
    """Each LV group's share of its station's buildings."""
    g = b.groupBy("mv_station", "lv_group").agg(F.count("*").alias("buildings"))
    total = F.sum("buildings").over(Window.partitionBy("mv_station"))
    return g.withColumn("station_total", total).withColumn("share_pct", 100 * F.col("buildings") / total)


def level_summary(b: DataFrame) -> DataFrame:
    """Averages of per-unit figures at LV and MV level."""
    lv = b.groupBy("mv_station", "lv_group").agg(F.count("*").alias("n"), share(F.col("has_solar")).alias("s"))
    mv = b.groupBy("mv_station").agg(F.count("*").alias("n"), share(F.col("has_solar")).alias("s"))
    one = lambda d, name: d.agg(F.lit(name).alias("level"), F.count("*").alias("units"), F.avg("n").alias("avg_buildings"), F.avg("s").alias("avg_solar_share"))
    return one(lv, "LV").unionByName(one(mv, "MV"))


def grid_totals(b: DataFrame) -> DataFrame:
    return b.agg(F.count_distinct("mv_station").alias("stations"), F.count_distinct("lv_group").alias("lv_groups"), F.count("*").alias("buildings"), F.sum("area").alias("area"))


def grid_kpis(b: DataFrame) -> DataFrame:
    """(metric, value) rows from one pass."""
    k = {"buildings": F.count("*"), "solar": F.count_if(F.col("has_solar")), "battery": F.count_if(F.col("has_battery")), "too_far": F.count_if(F.col("distance_m") > 150), "avg_distance": F.avg("distance_m")}
    return b.agg(*(v.cast("double").alias(n) for n, v in k.items())).unpivot([], list(k), "metric", "value")


def connection_type_summary(b: DataFrame) -> DataFrame:
    """Buildings by connection class, with their share of all."""
    kind = F.when(F.col("distance_m") <= 5, "ENDED").when(F.col("distance_m") <= 50, "ENTERED").when(F.col("distance_m") <= 150, "BY_DISTANCE").otherwise("TOO_FAR")
    g = b.groupBy(kind.alias("connection_type")).agg(F.count("*").alias("buildings"), F.avg("distance_m").alias("avg_distance"), F.max("distance_m").alias("max_distance"))
    return g.withColumn("pct", 100 * F.col("buildings") / F.sum("buildings").over(Window.partitionBy(F.lit(1))))  # four rows


def problematic_connections(b: DataFrame, limit_m: float = 150.0) -> DataFrame:
    return b.where(F.col("distance_m") > limit_m).select("building_id", "lv_group", "distance_m").orderBy(F.desc("distance_m"), "building_id")


def capability_matrix(b: DataFrame) -> DataFrame:
    large, office = F.col("area") > 100, F.col("function") != "residential"
    return b.agg(F.count_if(large & office).alias("large_other"), F.count_if(large & ~office).alias("large_home"), F.count_if(~large & office).alias("small_other"), F.count_if(~large & ~office).alias("small_home"))


def mv_district_metrics(b: DataFrame) -> DataFrame:
    """Spread and banded scores per station and district (sample standard deviation)."""
    g = b.groupBy("mv_station", "district").agg(
        F.count("*").alias("buildings"), F.count_distinct("function").alias("functions"), F.stddev_samp("peak_kw").alias("peak_std"), share(F.col("has_solar")).alias("solar_share"), share(F.col("label").isin(*POOR)).alias("poor_share"), F.avg(F.lit(2024) - F.col("build_year")).alias("avg_age")
    )
    band = lambda c, lo, hi: F.when(c >= hi, 3).when(c >= lo, 2).otherwise(1)
    return g.withColumns({"diversity_score": band(F.col("functions"), 2, 3), "need_score": band(F.col("poor_share"), 0.3, 0.5), "solar_score": band(F.col("solar_share"), 0.15, 0.3)})


def ranked_districts(metrics: DataFrame, n: int = 20) -> DataFrame:
    """The n station-districts with the largest combined score and a pattern label."""
    score = F.col("diversity_score") + F.col("need_score") + F.col("solar_score")
    pattern = F.when((F.col("need_score") == 3) & (F.col("diversity_score") == 3), "high need, mixed").when(F.col("need_score") == 3, "high need").otherwise("regular")
    return metrics.select("mv_station", "district", score.alias("score"), pattern.alias("pattern")).orderBy(F.desc("score"), "mv_station", "district").limit(n)


def opportunity_stations(b: DataFrame) -> DataFrame:
    """LV groups with mixed use and with high need, counted per station, and their class."""
    g = b.groupBy("mv_station", "lv_group").agg(F.count_distinct("function").alias("f"), share(F.col("label").isin(*POOR)).alias("poor"))
    s = g.groupBy("mv_station").agg(F.count_if(F.col("f") >= 3).alias("mixed"), F.count_if(F.col("poor") >= 0.5).alias("needy"), F.count_if((F.col("f") >= 3) & (F.col("poor") >= 0.5)).alias("overlap"))
    return s.withColumn("opportunity", F.when(F.col("overlap") >= 10, "HIGH").when(F.col("overlap") >= 1, "MEDIUM").otherwise("LOW"))


def split_districts(metrics: DataFrame) -> DataFrame:
    """Districts that more than one station serves."""
    return metrics.groupBy("district").agg(F.count("*").alias("stations"), F.stddev_samp("poor_share").alias("poor_std"), F.sum("buildings").alias("buildings")).where("stations > 1")


def entropy(b: DataFrame, group: str, category: str, classes: int | None = None) -> DataFrame:
    """Shannon entropy of a category per group, over ln(observed) or ln(classes)."""
    c = b.groupBy(group, category).agg(F.count("*").alias("k"))
    g = c.groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("s"), F.count("*").alias("observed"))
    h = F.log("n") - F.col("s") / F.col("n")
    top = F.log(F.lit(float(classes))) if classes else F.log("observed")
    return g.select(group, "n", h.alias("entropy"), F.when(top > 0, h / top).otherwise(0.0).alias("normalised"))


def intervention_metrics(b: DataFrame) -> DataFrame:
    """Shares of retrofit, solar, heat-pump and battery candidates per LV group and their weighted score."""
    g = b.groupBy("lv_group").agg(
        F.count("*").alias("buildings"), share(F.col("label").isin(*URGENT)).alias("retrofit"), share(~F.col("has_solar") & (F.col("area") > 100)).alias("solar"), share(~F.col("has_heat_pump") & F.col("label").isin("A", "B", "C")).alias("heat_pump"), share(F.col("has_solar") & ~F.col("has_battery")).alias("battery")
    )
    return g.withColumn("score", 0.35 * F.col("retrofit") + 0.3 * F.col("solar") + 0.2 * F.col("heat_pump") + 0.15 * F.col("battery"))


def lv_portfolio(metrics: DataFrame, least: int = 3) -> DataFrame:
    """LV groups of at least ``least`` buildings, classed by ordered rules and ranked."""
    kind = F.when(F.col("retrofit") >= 0.5, "retrofit").when(F.col("solar") >= 0.5, "solar").when(F.col("heat_pump") >= 0.4, "electrify").otherwise("monitor")
    kept = metrics.where(F.col("buildings") >= least).withColumn("program", kind)
    return running(kept, ["program"], "score", "lv_group").select("lv_group", "buildings", "score", "program", F.col("rank").cast("int").alias("rank"))


def transformer_loading(b: DataFrame, capacity_kva: float = 630.0) -> DataFrame:
    g = b.groupBy("lv_group").agg(F.sum("peak_kw").alias("peak_kw"))
    return g.select("lv_group", "peak_kw", F.least(F.col("peak_kw") / capacity_kva, F.lit(1.0)).alias("loading"), (F.col("peak_kw") > 0.8 * capacity_kva).alias("over_80"))


def fairness(b: DataFrame, value: str = "peak_kw") -> DataFrame:
    """Jain's index of a value over all rows, and the stability 1 / (1 + cv) of group sizes."""
    j = b.agg((F.pow(F.sum(value), 2) / (F.count(value) * F.sum(F.col(value) * F.col(value)))).alias("jain"))
    s = b.groupBy("lv_group").count().agg((1 / (1 + F.stddev_pop("count") / F.avg("count"))).alias("size_stability"))
    return j.crossJoin(s)  # two one-row frames


def penetration(b: DataFrame) -> DataFrame:
    s = F.col("has_solar")
    return b.agg(share(s).alias("by_building"), (F.sum(F.when(s, F.col("area"))) / F.sum("area")).alias("by_area"), (F.sum(F.when(s, F.col("peak_kw"))) / F.sum("peak_kw")).alias("by_capacity"))


def distribute_target(b: DataFrame, target: float, floor: float = 0.0) -> DataFrame:
    """A target spread over LV groups by their area, at least floor each."""
    g = b.groupBy("lv_group").agg(F.sum("area").alias("area"))
    total = b.agg(F.sum("area").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("lv_group", F.greatest(F.lit(target) * F.col("area") / F.col("total"), F.lit(floor)).alias("target"))  # total: one row


def label_distribution(b: DataFrame) -> DataFrame:
    return b.groupBy("label").agg(F.count("*").alias("buildings"))


def topology_counts(groups: DataFrame, b: DataFrame) -> DataFrame:
    """Buildings per LV group, empty groups included."""
    return groups.select("lv_group").distinct().join(b.groupBy("lv_group").agg(F.count("*").alias("n")), "lv_group", "left").select("lv_group", F.coalesce("n", F.lit(0)).alias("buildings"))


def data_quality(b: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(check, n) rows: nulls and range breaches of each column from one pass."""
    checks = {}
    for c, (lo, hi) in ranges.items():
        checks[f"{c}_null"] = F.count_if(F.col(c).isNull())
        checks[f"{c}_range"] = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
    return b.agg(*(v.alias(k) for k, v in checks.items())).unpivot([], list(checks), "check", "n")


def unassigned(groups: DataFrame, b: DataFrame) -> DataFrame:
    """LV groups without a building."""
    return groups.select("lv_group").distinct().join(b, "lv_group", "left_anti")


def coefficient_of_variation(b: DataFrame) -> DataFrame:
    """Population cv of peaks and prosumer mix 2p(1-p) per LV group."""
    p = share(F.col("has_solar") | F.col("has_battery"))
    return b.groupBy("lv_group").agg((F.stddev_pop("peak_kw") / F.avg("peak_kw")).alias("cv"), (2 * p * (1 - p)).alias("prosumer_mix"))
