"""Summary reports over the grid hierarchy, with the reference's columns, bands and text.

Input: one row per (MV station, MV group, LV group, building) with the building's attributes: mv_station, mv_group, lv_group,
building_id, district, function, building_type, area, age_range, label, connection_type, distance_m, is_mv_capable,
is_problematic. A building repeats where its LV group hangs under several MV groups: building counts are distinct,
counts of types are of rows. ``per_building`` folds the repeats first, so that every distinct count is a plain one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels that count as poor, age classes that count as old, types of each use.
POOR = ("D", "E", "F", "G")
OLD = ("< 1945", "1945-1975")
NEW = ("2005-2015", "> 2015")
DIRECT = ("ENDED", "ENTERED", "CROSSED")
KINDS = ("ENDED", "ENTERED", "CROSSED", "BY_DISTANCE", "TOO_FAR")
AGES = ("< 1945", "1945-1975", "1975-1990", "1990-2005", "2005-2015", "> 2015")
OFFICE, RETAIL, SCHOOL, INDUSTRY = ("Office", "office", "Kantoor"), ("Retail", "retail", "Winkel"), ("Education", "education", "School"), ("Industrial", "industrial")
TOP = {"vrijstaand", "twee_onder_1_kap", "rijtjeswoning", "appartement"}


def simple(label: Column) -> Column:
    """A with any number of plus signs is A; what is no label is Unknown."""
    return F.when(label.rlike(r"\AA\+{0,4}\z"), "A").when(label.isin("B", "C", "D", "E", "F", "G"), label).otherwise("Unknown")


def per_building(h: DataFrame, *keys: str) -> DataFrame:
    """h with one row per keys and building; ``n`` rows each."""
    rest = [c for c in h.columns if c not in ("mv_group", *keys)]
    return h.where("building_id IS NOT NULL").groupBy(*keys, *rest).agg(F.count("*").alias("n"))


def _rows(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))


def _mean(c: str) -> Column:
    return F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("/", *(p.cast("string") for p in parts))


def _res() -> Column:
    return F.col("function") == "residential"


def _non() -> Column:
    return F.col("function") == "non_residential"


def station_summary(h: DataFrame, n: int = 20) -> DataFrame:
    """The n stations with most buildings: counts by use, type, connection, age and label."""
    groups = h.groupBy("mv_station").agg(F.count_distinct("mv_group").alias("mv_groups"))
    s = per_building(h, "mv_station", "lv_group").groupBy("mv_station").agg(
        F.count_distinct("lv_group").alias("lv_groups"), F.count("*").alias("buildings"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"),
        *(F.count_if(F.col("building_type") == t).alias(t) for t in sorted(TOP)), *(_rows(F.col("connection_type") == k).alias(k.lower()) for k in KINDS), _joined(*(_rows(F.col("age_range") == a) for a in AGES)).alias("ages"),
        F.count_if(F.col("is_mv_capable")).alias("mv_capable"), F.count_if(F.col("is_problematic")).alias("problematic"), F.sum(F.col("area") * F.col("n")).alias("total_area"), _mean("area").alias("avg_area"), _mean("distance_m").alias("avg_distance"),
        _joined(_rows(simple(F.col("label")) == "A"), _rows(F.col("label") == "B"), _rows(F.col("label") == "C"), _rows(F.col("label").isin(*POOR))).alias("labels"),
    ).join(groups, "mv_station")
    s = s.withColumns({"res_nonres": _joined(F.col("residential"), F.col("non_residential")), "res_pct": 100 * F.col("residential") / F.col("buildings")})
    return s.orderBy(F.desc("buildings"), "mv_station").limit(n)


def group_summary(h: DataFrame, n: int = 30) -> DataFrame:
    """The n LV groups with most buildings, with their most frequent age, label, type and district (ties: smallest)."""
    b = h.where("building_id IS NOT NULL")
    modes = b.groupBy("mv_station", "lv_group").agg(*(F.mode(c, True).alias(f"main_{c}") for c in ("age_range", "label", "building_type", "district")))
    s = per_building(h, "mv_station", "lv_group").groupBy("mv_station", "lv_group").agg(
        F.count("*").alias("buildings"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), _joined(*(_rows(F.col("connection_type") == k) for k in KINDS)).alias("connections"),
        F.count_if(F.col("is_mv_capable")).alias("mv_capable"), F.count_if(F.col("is_problematic")).alias("problematic"), F.sum(F.col("area") * F.col("n")).alias("total_area"), _mean("area").alias("avg_area"), _mean("distance_m").alias("avg_distance"), F.max("distance_m").alias("max_distance"),
    ).orderBy(F.desc("buildings"), "mv_station", "lv_group").limit(n)
    return s.join(modes, ["mv_station", "lv_group"])


def station_breakdown(h: DataFrame, n: int = 10) -> DataFrame:
    """The LV groups of the n stations with most buildings."""
    p = per_building(h, "mv_station", "lv_group")
    top = p.groupBy("mv_station").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "mv_station").limit(n).select("mv_station")
    g = p.groupBy("mv_station", "lv_group").agg(F.count("*").alias("buildings"), _rows(_res()).alias("residential"), _rows(_non()).alias("non_residential"), _rows(F.col("is_mv_capable")).alias("mv_capable"), _rows(F.col("is_problematic")).alias("problematic"), _mean("area").alias("avg_area"), _mean("distance_m").alias("avg_distance"), F.array_join(F.array_sort(F.collect_set("connection_type")), ", ").alias("connections"), F.mode("age_range", True).alias("main_age"), F.mode("building_type", True).alias("main_type"))
    return g.join(F.broadcast(top), "mv_station", "left_semi")  # n rows


def station_rollup(h: DataFrame) -> DataFrame:
    """Each station and the whole grid."""
    r = per_building(h, "mv_station", "lv_group").rollup("mv_station").agg(F.grouping("mv_station").alias("g"), F.count_distinct("lv_group").alias("lv_groups"), F.count("*").alias("buildings"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), F.count_if(F.col("is_mv_capable")).alias("mv_capable"), F.count_if(F.col("is_problematic")).alias("problematic"), _mean("area").alias("avg_area"), _mean("distance_m").alias("avg_distance"))
    return r.withColumn("level", F.when(F.col("g") == 1, "TOTAL GRID").otherwise(F.concat(F.lit("MV Station "), F.col("mv_station").cast("string")))).drop("g", "mv_station")


def level_rollup(h: DataFrame) -> DataFrame:
    """Station, LV group and district subtotals by grouping id; ``level`` names the row, nulls first in order."""
    r = per_building(h, "mv_station", "lv_group").rollup("mv_station", "lv_group", "district").agg(F.grouping_id().alias("depth"), F.count("*").alias("buildings"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), _rows(F.col("label").isin(*POOR)).alias("poor_labels"), _mean("distance_m").alias("avg_distance"))
    text = F.when(F.col("depth") == 7, "TOTAL GRID").when(F.col("depth") == 3, F.concat(F.lit("MV "), "mv_station")).when(F.col("depth") == 1, F.concat(F.lit("  LV "), F.col("lv_group").cast("string"))).otherwise(F.concat(F.lit("    "), "district"))
    return r.withColumn("level", text).orderBy(F.asc_nulls_first("mv_station"), F.asc_nulls_first("lv_group"), F.asc_nulls_first("district"))


def station_comparison(h: DataFrame, least: int = 50) -> DataFrame:
    """Percentages of stations with more than ``least`` buildings."""
    pct = lambda c: 100 * F.count_if(c) / F.count("*")
    of_rows = lambda c: 100 * _rows(c) / F.sum("n")
    s = per_building(h, "mv_station", "lv_group").groupBy("mv_station").agg(F.count_distinct("lv_group").alias("lv_groups"), F.count("*").alias("buildings"), pct(_res()).alias("res_pct"), pct(F.col("is_mv_capable")).alias("mv_pct"), pct(F.col("is_problematic")).alias("problem_pct"), of_rows(F.col("connection_type").isin(*DIRECT)).alias("direct_pct"), of_rows(F.col("age_range").isin(*OLD)).alias("old_pct"), of_rows(simple(F.col("label")).isin("A", "B", "C")).alias("efficient_pct"))
    return s.where(F.col("buildings") > least)


def groups_of_stations(h: DataFrame, least: int = 100) -> DataFrame:
    """LV groups as a share of their station, for stations with more than ``least`` buildings."""
    g = per_building(h, "mv_station", "lv_group").groupBy("mv_station", "lv_group").agg(F.count("*").alias("buildings"), _rows(_res()).alias("residential"), _rows(_non()).alias("non_residential"), _rows(F.col("is_mv_capable")).alias("mv_capable"), _rows(F.col("is_problematic")).alias("problematic"), _mean("distance_m").alias("avg_distance"))
    w = Window.partitionBy("mv_station")
    g = g.withColumns({"station_groups": F.count("*").over(w), "station_buildings": F.sum("buildings").over(w)})
    return g.where(F.col("station_buildings") > least).withColumn("pct", 100 * F.col("buildings") / F.col("station_buildings"))


def level_summary(h: DataFrame) -> DataFrame:
    """Averages of per-unit percentages for stations and for LV groups."""
    p = per_building(h, "mv_station", "lv_group")
    pct = lambda c: 100 * F.count_if(c) / F.count("*")
    shares = [pct(_res()).alias("r"), pct(F.col("is_mv_capable")).alias("m"), pct(F.col("is_problematic")).alias("p")]
    mv = p.groupBy("mv_station").agg(F.count_distinct("lv_group").alias("lv"), F.count("*").alias("k"), *shares)
    lv = p.drop("mv_station", "n").distinct().groupBy("lv_group").agg(F.lit(None).cast("long").alias("lv"), F.count("*").alias("k"), *shares)
    one = lambda d, name: d.agg(F.lit(name).alias("level"), F.count("*").alias("units"), F.avg("lv").alias("avg_lv_groups"), F.avg("k").alias("avg_buildings"), F.avg("r").alias("avg_res_pct"), F.avg("m").alias("avg_mv_pct"), F.avg("p").alias("avg_problem_pct"))
    return one(mv, "Per MV Station").unionByName(one(lv, "Per LV Group"))


def grid_totals(h: DataFrame) -> DataFrame:
    ids = h.agg(F.count_distinct("mv_station").alias("stations"), F.count_distinct("mv_group").alias("mv_groups"), F.count_distinct("lv_group").alias("lv_groups"), F.avg("distance_m").alias("avg_distance"))
    b = h.where("building_id IS NOT NULL").select("building_id", "function", "is_mv_capable", "is_problematic").distinct()
    return ids.crossJoin(b.agg(F.count("*").alias("buildings"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), F.count_if(F.col("is_mv_capable")).alias("mv_capable"), F.count_if(F.col("is_problematic")).alias("problematic")))  # one-row frames


def _band(c: Column, *limits: tuple[float, int], other: int) -> Column:
    out = F.lit(other)
    for limit, score in reversed(limits):
        out = F.when(c > limit, score).otherwise(out)
    return out


def district_metrics(h: DataFrame) -> DataFrame:
    """Aggregates per station and district, four diversity scores and two scores of need, with their sums."""
    kind = lambda names: F.count_if(F.col("building_type").isin(*names))
    g = per_building(h.where("district IS NOT NULL"), "mv_station", "district").groupBy("mv_station", "district").agg(
        F.count_distinct("lv_group").alias("lv_groups"), F.count("*").alias("buildings"), F.sum(F.col("area") * F.col("n")).alias("total_area"), F.size(F.collect_set("function")).alias("function_types"), F.size(F.collect_set("building_type")).alias("types"),
        F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), kind(OFFICE).alias("offices"), kind(RETAIL).alias("retail"), kind(SCHOOL).alias("schools"), kind(INDUSTRY).alias("industrial"),
        F.sum("n").alias("k"), F.sum(F.col("area") * F.col("area") * F.col("n")).alias("squares"), _rows(F.col("area") < 100).alias("small"), _rows(F.col("area") > 1000).alias("large"), F.size(F.collect_set("age_range")).alias("age_ranges"),
        _rows(F.col("age_range").isin(*OLD)).alias("old"), _rows(F.col("age_range").isin(*NEW)).alias("new"), _rows(simple(F.col("label")).isin(*POOR)).alias("poor_labels"), _rows(F.col("is_mv_capable")).alias("mv_capable"), _mean("distance_m").alias("avg_distance"), _rows(F.col("is_problematic")).alias("problematic"),
    )
    spread = F.when(F.col("k") > 1, F.round(F.sqrt(F.greatest((F.col("squares") - F.col("total_area") * F.col("total_area") / F.col("k")) / (F.col("k") - 1), F.lit(0.0))), 0))
    g = g.withColumns({"area_std": spread, "poor_pct": F.round(100 * F.col("poor_labels") / F.col("k"), 1)})
    both = (F.col("residential") > 0) & (F.col("non_residential") > 0)
    beside = F.col("residential") > 5
    g = g.withColumns({
        "type_score": F.least(F.lit(10.0), F.col("types") * 1.5),
        "size_score": _band(F.col("area_std"), (500, 10), (300, 8), (150, 6), other=3),
        "mix_score": F.when(both & (F.abs(F.col("residential") - F.col("non_residential")) < F.col("buildings") * 0.5), 10).when(both, 6).otherwise(2),
        "temporal_score": F.when((F.col("offices") > 0) & beside, 10).when((F.col("retail") > 0) & beside, 9).when((F.col("schools") > 0) & beside, 8).when(F.col("age_ranges") >= 4, 6).otherwise(3),
        "energy_need": _band(F.col("poor_pct"), (70, 10), (50, 8), (30, 6), other=3),
        "age_need": F.when(F.col("old") > F.col("buildings") * 0.6, 10).when(F.col("old") > F.col("buildings") * 0.4, 7).when(F.col("old") > F.col("buildings") * 0.25, 5).otherwise(2),
        "pattern": F.when((F.col("offices") > 0) & beside, "Office+Res").when((F.col("retail") > 0) & beside, "Retail+Res").when((F.col("schools") > 0) & beside, "Edu+Res").when(F.col("age_ranges") >= 4, "Age Mix").otherwise("Basic"),
    })
    return g.drop("k", "squares").withColumns({"ec_score": F.col("type_score") + F.col("size_score") + F.col("mix_score") + F.col("temporal_score"), "int_score": F.col("energy_need") + F.col("age_need")})


def group_district_metrics(h: DataFrame) -> DataFrame:
    """Diversity and need of each LV group in each district."""
    g = per_building(h.where("district IS NOT NULL"), "mv_station", "lv_group", "district").groupBy("mv_station", "lv_group", "district").agg(F.count("*").alias("buildings"), F.size(F.collect_set("building_type")).alias("types"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), F.size(F.collect_set("age_range")).alias("age_ranges"), _rows(F.col("age_range").isin(*OLD)).alias("old"), _rows(simple(F.col("label")).isin(*POOR)).alias("poor_labels"), _rows(F.col("is_mv_capable")).alias("mv_capable"), F.sum("n").alias("k"))
    mixed = F.when((F.col("residential") > 0) & (F.col("non_residential") > 0), 5).otherwise(0)
    poor = F.round(100 * F.col("poor_labels") / F.col("k"), 1)
    # the cited rule divides by nullif(buildings, 1): a single building has no need score
    need = poor / 10 + F.when(F.col("buildings") != 1, F.col("old") * 10.0 / F.col("buildings"))
    return g.withColumns({"poor_pct": poor, "diversity": (F.col("types") * 2 + mixed + F.col("age_ranges")) / 2.0, "need": need}).drop("k")


def station_scores(metrics: DataFrame, n: int = 15) -> DataFrame:
    """Report A: stations with their best and mean scores and the start of their district list."""
    s = metrics.groupBy("mv_station").agg(F.count("*").alias("districts"), F.sum("buildings").alias("buildings"), F.array_join(F.array_sort(F.collect_set("district")), ", ").alias("list"), F.max("ec_score").alias("best_ec"), F.max("int_score").alias("max_need"), F.avg("ec_score").alias("avg_ec"), F.avg("int_score").alias("avg_need"))
    short = F.concat(F.left("list", F.lit(50)), F.when(F.length("list") > 50, "...").otherwise(""))
    return s.withColumn("served", short).drop("list").orderBy(F.desc("buildings"), "mv_station").limit(n)


def best_districts(metrics: DataFrame, by: str = "ec_score", least: int = 20, n: int = 20) -> DataFrame:
    """Reports B and C: the n station-districts of at least ``least`` buildings with the largest score."""
    return metrics.where(F.col("buildings") >= least).select("mv_station", "district", "buildings", "lv_groups", by, "types", "mv_capable", "pattern", "poor_labels", "old").orderBy(F.desc(by), "mv_station", "district").limit(n)


def diverse_groups(metrics: DataFrame, least: int = 10, n: int = 30) -> DataFrame:
    """Report D: the n most diverse LV groups by district."""
    return metrics.where(F.col("buildings") >= least).orderBy(F.desc("diversity"), "lv_group", "mv_station", "district").limit(n)


def opportunity_stations(metrics: DataFrame, least: int = 50) -> DataFrame:
    """Report E: stations by their districts of high diversity (25 and more), high need (12 and more) and both."""
    ec, need = F.col("ec_score") >= 25, F.col("int_score") >= 12
    s = metrics.groupBy("mv_station").agg(F.count("*").alias("districts"), F.count_if(ec).alias("high_ec"), F.count_if(need).alias("high_need"), F.count_if(ec & need).alias("both"), F.sum("buildings").alias("buildings"), F.avg("ec_score").alias("avg_ec"), F.avg("int_score").alias("avg_need"))
    kind = F.when(F.col("both") > 0, "EXCELLENT").when((F.col("high_ec") > 0) & (F.col("high_need") > 0), "VERY GOOD").when((F.col("high_ec") > 0) | (F.col("high_need") > 0), "GOOD").otherwise("MODERATE")
    return s.where(F.col("buildings") >= least).withColumn("opportunity", kind)


def split_districts(metrics: DataFrame) -> DataFrame:
    """Report F: districts that more than one station serves, with the spread of their scores."""
    return metrics.groupBy("district").agg(F.count("*").alias("stations"), F.sum("buildings").alias("buildings"), F.avg("ec_score").alias("avg_ec"), F.avg("int_score").alias("avg_need"), F.stddev_samp("ec_score").alias("ec_std")).where("stations > 1")


def connection_overview(c: DataFrame, stats: DataFrame) -> DataFrame:
    """(metric, value): fifteen figures of connections and segments, from one pass over each."""
    kinds = {k.lower(): F.count_if(F.col("connection_type") == k) for k in KINDS}
    one = c.agg(
        F.count("*").alias("total_buildings"), F.count_if(_res()).alias("residential"), F.count_if(_non()).alias("non_residential"), F.count_if(F.col("is_mv_capable")).alias("mv_capable"), F.count_if(F.col("is_mv_capable") & F.col("has_mv_nearby")).alias("mv_capable_with_mv_nearby"),
        *(v.alias(k) for k, v in kinds.items()), F.count_if(F.col("is_problematic")).alias("problematic_connections"), F.avg("distance_m").alias("avg_connection_m"), F.max("distance_m").alias("max_connection_m"),
    )
    two = stats.agg(F.count_if(F.col("buildings") > 0).alias("segments_with_buildings"), F.count_if(F.col("has_problem")).alias("segments_with_problems"))
    both = one.crossJoin(two)  # one-row frames
    return both.select(*(F.col(k).cast("double").alias(k) for k in both.columns)).unpivot([], both.columns, "metric", "value")


def connection_types(c: DataFrame) -> DataFrame:
    g = c.groupBy("connection_type").agg(F.count("*").alias("buildings"), F.avg("distance_m").alias("avg_distance"), F.max("distance_m").alias("max_distance"), F.count_if(F.col("is_mv_capable")).alias("mv_capable"), F.count_if(F.col("is_problematic")).alias("problematic"))
    total = c.agg(F.count("*").alias("_total"))
    return g.crossJoin(F.broadcast(total)).withColumn("pct", 100 * F.col("buildings") / F.col("_total")).drop("_total")  # one row


def capability_matrix(c: DataFrame) -> DataFrame:
    """Buildings by being MV-capable and by having an MV cable near."""
    m, near = F.col("is_mv_capable"), F.col("has_mv_nearby")
    return c.agg(F.count_if(m & near).alias("capable_near"), F.count_if(m & ~near).alias("capable_far"), F.count_if(~m & near).alias("other_near"), F.count_if(~m & ~near).alias("other_far"))
