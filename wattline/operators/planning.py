"""Plans over candidates, and the quality of repeated predictions.

Ordered folds run on one LV group's buildings at a time; the grid bounds their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def budgeted_selection(c: DataFrame, budget: float, group: str = "lv_group", over: float = 1.1, enough: float = 0.9) -> DataFrame:
    """Candidates (group, building_id, score, cost) taken by falling score until 0.9 x budget is spent.

    One that would pass 1.1 x budget is skipped and later ones still count, so this is a fold and
    not a running sum.
    """
    ranked = c.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "building_id", "cost"))).alias("items"))
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda a, x: (a["spent"] < budget * enough) & (a["spent"] + x["cost"] <= budget * over)
    step = lambda a, x: F.when(fits(a, x), F.struct((a["spent"] + x["cost"]).alias("spent"), F.concat(a["taken"], F.array(x["building_id"].cast("bigint"))).alias("taken"))).otherwise(a)
    return ranked.select(group, F.aggregate("items", start, step).alias("r")).select(group, F.posexplode("r.taken").alias("rank", "building_id"))


def cumulative_plan(b: DataFrame, group: str = "mv_station") -> DataFrame:
    """Solar buildings by year and their cumulative share of the group's buildings."""
    y = b.groupBy(group, F.col("build_year").alias("year")).agg(F.count_if(F.col("has_solar")).alias("added"), F.count("*").alias("k"))
    w = Window.partitionBy(group)
    return y.withColumns({"total": F.sum("added").over(w.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(w)}).select(group, "year", "added", "total", (F.col("total") / F.col("n")).alias("penetration"))


def rank_agreement(c: DataFrame, one: str, other: str, group: str) -> DataFrame:
    """Spearman correlation of two orders of a group's candidates (ties: smaller id), and falling steps of the second."""
    place = lambda col: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(col), "building_id"))
    r = c.withColumns({"a": place(one), "b": place(other)})
    r = r.withColumn("last", F.lag("b").over(Window.partitionBy(group).orderBy("a")))
    return r.groupBy(group).agg(F.count("*").alias("n"), F.corr("a", "b").alias("spearman"), F.count_if(F.col("b") < F.col("last")).alias("inversions")).where("n > 1")


def progress(b: DataFrame, target: float, elapsed: float, group: str = "mv_station") -> DataFrame:
    """Solar share against a target after a share of the time: complete, on track, projected linearly."""
    p = b.groupBy(group).agg(F.avg(F.col("has_solar").cast("int")).alias("achieved"))
    return p.withColumns({"complete_pct": 100 * F.col("achieved") / target, "on_track": F.col("achieved") >= 0.9 * target * elapsed, "projected": F.col("achieved") / elapsed})


def violation_rates(b: DataFrame, capacity_kva: float, smallest: int = 3, largest: int = 20, power_factor: float = 0.9) -> DataFrame:
    """One row: shares of groups that overload their transformer, have a wrong size or vary by more than their mean."""
    g = b.groupBy("lv_group").agg(F.sum("peak_kw").alias("p"), F.count("*").alias("n"), (F.stddev_pop("peak_kw") / F.avg("peak_kw")).alias("cv"))
    share = lambda c: F.avg(c.cast("int"))
    room = capacity_kva * power_factor
    return g.agg(F.count("*").alias("groups"), share(F.col("p") > room).alias("overload"), share(~F.col("n").between(smallest, largest)).alias("size"), share(F.col("cv") > 1).alias("variability"), F.max(F.col("p") / room).alias("highest_loading"))


def quick_solar_candidates(b: DataFrame, roof: float = 50.0, n: int = 50) -> DataFrame:
    """The n largest roofs of poorly labelled buildings without solar; a report, hence the limit."""
    size = F.col("roof_flat") + F.col("roof_sloped")
    return b.where(F.col("label").isin("E", "F", "G") & ~F.col("has_solar") & (size > roof)).select("building_id", "label", size.alias("roof")).orderBy(F.desc("roof"), "building_id").limit(n)


def calibration_bins(p: DataFrame, n: int = 10) -> DataFrame:
    """Predictions (prob, hit) in n equal bins: mean confidence, accuracy and their gap."""
    bin_ = F.least(F.floor(F.col("prob") * n), F.lit(n - 1)).cast("int")
    g = p.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("confidence"), F.avg(F.col("hit").cast("int")).alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def expected_calibration_error(p: DataFrame, n: int = 10) -> DataFrame:
    return calibration_bins(p, n).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def ensemble_uncertainty(p: DataFrame) -> DataFrame:
    """Repeated predictions (run, node_id, class, prob): entropy, mutual information and variation ratio per node.

    Every run's probabilities are scaled to sum 1; a run votes for its likeliest class (ties: smaller).
    """
    r = p.groupBy("node_id", "run", "class").agg(F.round(F.sum("prob"), 9).alias("q"))
    run = Window.partitionBy("node_id", "run")
    r = r.withColumns({"v": F.col("q") / F.sum("q").over(run), "k": F.row_number().over(run.orderBy(F.desc("q"), "class"))})
    c = r.groupBy("node_id", "class").agg(F.sum("v").alias("s"), F.count_if(F.col("k") == 1).alias("votes"), F.sum(-F.col("v") * F.log("v")).alias("own"))
    c = c.withColumn("runs", F.sum("votes").over(Window.partitionBy("node_id")))  # each run votes once
    share = F.col("s") / F.col("runs")
    g = c.groupBy("node_id").agg(F.max("runs").alias("runs"), F.sum(-share * F.log(share)).alias("entropy"), F.sum(F.col("own") / F.col("runs")).alias("own"), (1 - F.max("votes") / F.max("runs")).alias("variation_ratio"))
    return g.select("node_id", "runs", "entropy", (F.col("entropy") - F.col("own")).alias("mutual_information"), "variation_ratio")
