"""Scores of LV groups, districts and MV stations for planning.

Input: one row per building with lv_group, mv_station, district, function, building_type, label, area, build_year, orientation, roof_flat,
roof_sloped, has_solar, has_battery, has_heat_pump, peak_hour, peak_kw, annual_kwh, distance_m. Everything of a unit comes from one
aggregate, category entropies from one more on (unit, category).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import simple

#: Labels that count as poor here, and the score of each label.
POOR = ("E", "F", "G")
LABEL_SCORE = {"A": 1.0, "B": 2.0, "C": 3.0, "D": 4.0, "E": 5.0, "F": 6.0, "G": 7.0}


def _share(c: Column) -> Column:
    return F.avg(c.cast("int"))


def _cv(c: str, most: float | None = 1.0) -> Column:
    v = F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    return F.least(v, F.lit(most)) if most else v


def use(function: Column, kind: Column) -> Column:
    """residential, office, retail, industrial or other."""
    other = F.when(kind.contains("Office"), "office").when(kind.contains("Retail"), "retail").when(kind.contains("Industrial"), "industrial").otherwise("other")
    return F.when(function == "non_residential", other).otherwise("residential")


def _entropy(b: DataFrame, unit: list[str], category: Column) -> DataFrame:
    """(unit, h, k): entropy of a category and the number of its values."""
    c = b.groupBy(*unit, category.alias("_c")).agg(F.count("*").alias("n"))
    g = c.groupBy(*unit).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("k"))
    return g.select(*unit, (F.log("t") - F.col("s") / F.col("t")).alias("h"), "k")


def _readiness() -> Column:
    """Roofs of 40 square metres and more without solar, by orientation and label."""
    o = F.when(F.col("orientation").isin("S", "SE", "SW"), 1.0).when(F.col("orientation").isin("E", "W"), 0.7).otherwise(0.3)
    lab = simple(F.col("label"))
    w = F.when(lab.isin("E", "F", "G"), 1.0).when(lab.isin("C", "D"), 0.7).when(lab.isin("A", "B"), 0.3).otherwise(0.5)
    roof = F.coalesce("roof_flat", F.lit(0.0)) + F.coalesce("roof_sloped", F.lit(0.0))
    return F.when(~F.col("has_solar") & (roof >= 40), o * w).otherwise(0.0)


def lv_planning(b: DataFrame) -> DataFrame:
    """Diversities, poor labels, solar readiness, complementarity and planning score (at most 10) of each LV group."""
    lab = simple(F.col("label"))
    score = F.coalesce(*(F.when(lab == k, v) for k, v in LABEL_SCORE.items()), F.lit(4.0))
    peaks = b.groupBy("mv_station", "lv_group", "peak_hour").agg(F.count("*").alias("n")).groupBy("mv_station", "lv_group").agg((F.max("n") / F.sum("n")).alias("coincidence"))
    g = b.groupBy("mv_station", "lv_group").agg(F.count("*").alias("buildings"), (F.size(F.collect_set(lab)) / 7).alias("label_diversity"), F.least(F.stddev_pop("peak_hour") / 12, F.lit(1.0)).alias("temporal_diversity"), _cv("area").alias("size_diversity"), _share(lab.isin(*POOR)).alias("poor_ratio"), F.avg(score).alias("label_score"), F.avg(_readiness()).alias("solar_readiness"))
    e = _entropy(b, ["mv_station", "lv_group"], use(F.col("function"), F.col("building_type")))
    g = g.join(e, ["mv_station", "lv_group"]).join(peaks, ["mv_station", "lv_group"]).withColumn("function_diversity", F.greatest(F.least(F.col("h") / F.log(F.lit(5.0)), F.lit(1.0)), F.lit(0.0))).drop("h", "k")
    return g.withColumn("complementarity", F.col("function_diversity") * 0.4 + F.col("temporal_diversity") * 0.4 + (1 - F.col("coincidence")) * 0.2).withColumn("planning_score", planning_score())


def planning_score() -> Column:
    """Three points for diversity, four for poor labels, two for solar, one for peaks that do not coincide."""
    d = (F.col("function_diversity") + F.col("temporal_diversity")) / 2
    return F.least(d * 3.0 + F.col("poor_ratio") * 4.0 + F.col("solar_readiness") * 2.0 + (1 - F.col("coincidence")), F.lit(10.0))


def mv_planning(lv: DataFrame) -> DataFrame:
    """Means over a station's LV groups, their variety, urgency and priority, the best three and the problematic ones."""
    d = (F.col("function_diversity") + F.col("temporal_diversity")) / 2
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("planning_score", 9)).alias("s"), "lv_group", "poor_ratio")))
    g = lv.groupBy("mv_station").agg(F.count("*").alias("lv_groups"), F.sum("buildings").alias("buildings"), F.avg(d).alias("diversity"), F.avg("poor_ratio").alias("poor_ratio"), F.avg("complementarity").alias("complementarity"), _cv("planning_score", None).alias("variety"), ranked.alias("r"))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["lv_group"].cast("string")), ",")
    g = g.withColumns({"urgency": F.col("poor_ratio") * 0.6 + (1 - F.col("diversity")) * 0.4, "best": names(F.slice("r", 1, 3)), "problematic": F.size(F.filter("r", lambda x: x["poor_ratio"] > 0.5))}).drop("r")
    return g.withColumn("priority", F.least(F.col("diversity") * 2.0 + F.col("poor_ratio") * 3.0 + F.col("complementarity") * 2.0 + F.col("variety") + F.col("urgency") * 2.0, F.lit(10.0)))


def lv_assessment(b: DataFrame, least: int = 3) -> DataFrame:
    """The second model: diversity over the types found, demand, solar, spreads of LV groups of ``least`` buildings."""
    unit = ["mv_station", "lv_group"]
    e = _entropy(b, unit, F.col("building_type")).withColumn("function_diversity", F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(0.0)).select(*unit, "function_diversity")
    types = b.groupBy(*unit, "building_type").agg(F.count("*").alias("n")).groupBy(*unit).agg((F.max("n") / F.sum("n")).alias("correlation"))
    lab = simple(F.col("label"))
    turn = F.when(F.col("orientation") == "S", 1.0).when(F.col("orientation").isin("SE", "SW"), 0.95).when(F.col("orientation").isin("E", "W"), 0.85).when(F.col("orientation").isin("NE", "NW"), 0.65).when(F.col("orientation") == "N", 0.5).otherwise(0.8)
    kw = (F.col("roof_flat") + F.col("roof_sloped")) * 0.15 * turn * F.when(lab.isin("A", "B"), 1.2).otherwise(1.0)
    g = b.groupBy(*unit).agg(F.count("*").alias("buildings"), _share(lab.isin(*POOR)).alias("poor_ratio"), _cv("area").alias("size_variance"), (F.sum("annual_kwh") / 1000).alias("demand_mwh"), F.sum("peak_kw").alias("peak_kw"), F.sum(F.when(~F.col("has_solar"), kw).otherwise(0.0)).alias("solar_potential"), F.least((F.max("peak_hour") - F.min("peak_hour")) / 12, F.lit(1.0)).alias("temporal_diversity"), _share(F.col("has_solar")).alias("prosumers"), _cv("distance_m").alias("distance_spread"))
    return g.where(F.col("buildings") >= least).join(e, unit).join(types, unit)


def mv_assessment(lv: DataFrame) -> DataFrame:
    """Station totals and the strategy with the largest score (ties: the first of the list)."""
    g = lv.groupBy("mv_station").agg(F.count("*").alias("lv_groups"), F.sum("buildings").alias("buildings"), F.avg("function_diversity").alias("diversity"), F.avg("poor_ratio").alias("poor_ratio"), F.sum("demand_mwh").alias("demand_mwh"), (F.sum("peak_kw") * 0.8).alias("peak_kw"), F.sum("solar_potential").alias("solar_potential"), F.avg(1 - F.abs("correlation")).alias("complementarity"))
    d, p, c = F.col("diversity"), F.col("poor_ratio"), F.col("complementarity")
    scores = [("energy_community", d * 0.5 + c * 0.5), ("retrofit_focus", p), ("solar_priority", F.least(F.col("solar_potential") / 1000, F.lit(1.0))), ("mixed", (d + p + c) / 3)]
    best = F.array_max(F.array(*(F.struct(F.round(s, 9).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores))))
    return g.withColumn("strategy", best["n"])


def district_assessment(b: DataFrame) -> DataFrame:
    """Type, mixed use, prosumers, homogeneity, urgency, readiness and complementarity of each district."""
    b = b.where("district IS NOT NULL").withColumns({"_use": use(F.col("function"), F.col("building_type")), "_lab": simple(F.col("label"))})
    top = lambda c, name: b.groupBy("district", c).agg(F.count("*").alias("n")).groupBy("district").agg((F.max("n") / F.sum("n")).alias(name))
    roof = F.col("roof_flat") + F.col("roof_sloped")
    g = b.groupBy("district").agg(
        F.count("*").alias("buildings"), _share(F.col("_use") == "residential").alias("res"), _share(F.col("_use").isin("office", "retail")).alias("com"), _share(F.col("_use") == "industrial").alias("ind"), _share(F.col("has_solar")).alias("prosumers"),
        _share((roof > 50) & ~F.col("has_solar")).alias("potential"), _cv("area", None).alias("area_cv"), F.stddev_pop("peak_hour").alias("peak_std"), (F.max("peak_hour") - F.min("peak_hour")).alias("peak_spread"), _share(F.col("_lab").isin(*POOR)).alias("urgent"), _share(2024 - F.col("build_year") > 40).alias("old"),
        _share((roof > 40) & ~F.col("has_solar")).alias("solar_ready"), _share(F.col("_lab").isin("A", "B", "C") & ~F.col("has_heat_pump")).alias("pump_ready"), _share(F.col("has_solar") & ~F.col("has_battery")).alias("battery_ready"), _share(F.col("_lab").isin("D", "E", "F", "G") & (F.col("area") > 60)).alias("retrofit_ready"), F.size(F.collect_set("_lab")).alias("labels"),
    ).join(top("_use", "same_use"), "district").join(top("_lab", "same_label"), "district")
    one = lambda c: F.least(c, F.lit(1.0))
    mixed = 1.0 - F.abs(0.65 - F.col("res")) - F.abs(0.25 - F.col("com"))
    g = g.withColumns({
        "district_type": F.when(F.col("res") > 0.8, "predominantly_residential").when(F.col("com") > 0.6, "predominantly_commercial").when((F.col("res") > 0.4) & (F.col("com") > 0.2), "mixed_use").otherwise("diverse_mixed"),
        "mixed_use": F.greatest(mixed, F.lit(0.0)), "prosumer_benefit": F.col("prosumers") * (1 - F.col("prosumers")) * 4,
        "homogeneity": (F.col("same_use") + F.col("same_label") + (1 - one(F.col("area_cv"))) + (1 - one(F.col("peak_std") / 12))) / 4,
        "is_homogeneous": (F.col("same_use") > 0.8) | (F.col("same_label") > 0.7) | (F.col("area_cv") < 0.2) | (F.col("peak_std") < 2),
        "urgency": F.least((F.col("urgent") + F.col("old")) / 2 * 10, F.lit(10.0)), "immediate": (F.col("urgent") > 0.3) | (F.col("old") > 0.5),
        "readiness": (F.col("solar_ready") + F.col("pump_ready") + F.col("battery_ready") + F.col("retrofit_ready")) / 4, "coordinated": F.least("solar_ready", "pump_ready", "battery_ready"), "temporal": one(F.col("peak_spread") / 12),
    })
    return g.withColumn("complementarity", F.col("mixed_use") * 0.3 + F.col("prosumer_benefit") * 0.25 + (1 - F.col("homogeneity")) * 0.25 + F.col("temporal") * 0.2)


def select_station(mv: DataFrame, by: str = "priority") -> DataFrame:
    """The station with the largest value (ties: the first name)."""
    return mv.orderBy(F.desc(by), "mv_station").limit(1)


def best_buildings(b: DataFrame, n: int = 10) -> DataFrame:
    """The n largest roofs without solar, poor labels first."""
    roof = F.col("roof_flat") + F.col("roof_sloped")
    return b.where(~F.col("has_solar")).select("building_id", "label", roof.alias("roof"), simple(F.col("label")).isin(*POOR).alias("poor")).orderBy(F.desc("poor"), F.desc("roof"), "building_id").limit(n)


def group_aggregate(b: DataFrame) -> DataFrame:
    """Counts, areas, systems and mean label score (A is 7, G is 1) of each LV group."""
    lab = simple(F.col("label"))
    score = F.coalesce(*(F.when(lab == k, 8 - v) for k, v in LABEL_SCORE.items()), F.lit(0.0))
    return b.groupBy("lv_group").agg(F.count("*").alias("buildings"), F.sum("area").alias("area"), F.sum(F.col("roof_flat") + F.col("roof_sloped")).alias("roof"), F.count_if("has_solar").alias("solar"), F.count_if("has_battery").alias("battery"), F.count_if("has_heat_pump").alias("heat_pump"), F.avg(score).alias("label_score"))


def systems_installed(b: DataFrame) -> DataFrame:
    """(system, n, share) of solar, battery and heat pump."""
    kinds = ("has_solar", "has_battery", "has_heat_pump")
    one = b.agg(F.count("*").alias("total"), *(F.count_if(F.col(k)).alias(k) for k in kinds)).unpivot("total", list(kinds), "system", "n")
    return one.select("system", "n", (F.col("n") / F.col("total")).alias("share"))


def retrofit_candidates(b: DataFrame, labels: tuple[str, ...] = POOR, age_part: str = "19") -> DataFrame:
    """LV groups by the number of buildings with a poor label and an age class that contains a text."""
    keep = simple(F.col("label")).isin(*labels) & F.col("age_range").contains(age_part)
    return b.where(keep).groupBy("lv_group").agg(F.count("*").alias("buildings"), F.sum("area").alias("area"), F.array_join(F.transform(F.array_sort(F.collect_list("building_id")), lambda x: x.cast("string")), ",").alias("ids"))
