"""Load profiles: energy states per building and time, rolled up over time, groups and clusters.

Input: building_id, lv_group, cluster_id, ts, demand, generation. Powers are averages of a slot of
``slot_hours``. Totals are re-aggregated from the finer result where the figure allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def derive(s: DataFrame) -> DataFrame:
    """Net demand and export potential of each state."""
    net = F.col("demand") - F.col("generation")
    return s.withColumns({"net": net, "export": F.greatest(F.lit(0.0), -net)})


def timeslots(s: DataFrame) -> DataFrame:
    """The distinct slots with their calendar columns (Monday is 0)."""
    t = s.select(F.date_trunc("hour", "ts").alias("slot")).distinct()
    m, h = F.month("slot"), F.hour("slot")
    season = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    return t.select(F.date_format("slot", "yyyyMMdd_HHmm").alias("slot_id"), F.year("slot").alias("year"), m.alias("month"), h.alias("hour"), F.weekday("slot").alias("dow"), (F.weekday("slot") >= 5).alias("is_weekend"), season.alias("season"), part.alias("part"))


def daily(s: DataFrame, slot_hours: float = 1.0) -> DataFrame:
    return s.groupBy("building_id", F.to_date("ts").alias("day")).agg(F.avg("demand").alias("avg_kw"), F.max("demand").alias("peak_kw"), (F.sum("demand") * slot_hours).alias("kwh"), (F.sum("generation") * slot_hours).alias("solar_kwh"))


def monthly(d: DataFrame) -> DataFrame:
    """From daily profiles: the average of daily averages."""
    return d.groupBy("building_id", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("avg_kw").alias("avg_kw"), F.max("peak_kw").alias("peak_kw"), F.sum("kwh").alias("kwh"))


def baseline(s: DataFrame) -> DataFrame:
    """Peak, average, load factor and variability (sample) of each building."""
    g = s.groupBy("building_id", "lv_group").agg(F.max("demand").alias("peak"), F.avg("demand").alias("avg"), F.stddev_samp("demand").alias("std"), F.sum(F.least("demand", "generation")).alias("own"), F.sum("generation").alias("gen"))
    return g.select("building_id", "lv_group", "peak", "avg", (F.col("avg") / F.col("peak")).alias("load_factor"), "std", F.try_divide("own", "gen").alias("self_consumption"))


def group_baseline(b: DataFrame) -> DataFrame:
    return b.groupBy("lv_group").agg(F.count("*").alias("buildings"), F.sum("peak").alias("sum_peaks"), F.sum("avg").alias("sum_avg"), F.avg("load_factor").alias("load_factor"))


def slots(s: DataFrame, group: str) -> DataFrame:
    """Demand and generation of a group per hour slot."""
    return s.groupBy(group, F.date_trunc("hour", "ts").alias("slot")).agg(F.sum("demand").alias("demand"), F.sum("generation").alias("generation"))


def cluster_time_series(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    net = F.col("demand") - F.col("generation")
    return slots(s, group).withColumns({"deficit": F.greatest(net, F.lit(0.0)), "surplus": F.greatest(-net, F.lit(0.0))})


def energy_metrics(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Self-sufficiency and self-consumption from slot sums, with import, export and shared energy."""
    d, g = F.col("demand"), F.col("generation")
    return slots(s, group).groupBy(group).agg(F.sum(d).alias("demand"), F.sum(g).alias("generation"), F.sum(F.least(d, g)).alias("shared"), F.sum(F.greatest(d - g, F.lit(0.0))).alias("imported"), F.sum(F.greatest(g - d, F.lit(0.0))).alias("exported")).withColumns({"self_sufficiency": F.try_divide("shared", "demand"), "self_consumption": F.try_divide("shared", "generation")})


def peak_metrics(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """The sum of own peaks against the peak of the sum."""
    own = s.groupBy(group, "building_id", F.date_trunc("hour", "ts").alias("slot")).agg(F.sum("demand").alias("d"))
    per = own.groupBy(group, "building_id").agg(F.max("d").alias("peak")).groupBy(group).agg(F.sum("peak").alias("sum_peaks"))
    both = own.groupBy(group, "slot").agg(F.sum("d").alias("d")).groupBy(group).agg(F.max("d").alias("peak"), F.avg("d").alias("avg"))
    return per.join(both, group).select(group, "sum_peaks", "peak", (1 - F.col("peak") / F.col("sum_peaks")).alias("peak_reduction"), (F.col("sum_peaks") / F.col("peak")).alias("diversity_factor"), (F.col("avg") / F.col("peak")).alias("load_factor"))


def energy_balance(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    r = F.try_divide(F.sum("generation"), F.sum("demand"))
    return s.groupBy(group).agg(r.alias("ratio")).withColumn("balance", F.when(F.col("ratio") <= 1, F.col("ratio")).otherwise(1 / F.col("ratio")))


def load_diversity(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Distinct peak hours of the buildings over their number (ties: earliest hour)."""
    h = s.groupBy(group, "building_id", F.hour("ts").alias("hour")).agg(F.avg("demand").alias("m"))
    p = h.groupBy(group, "building_id").agg(F.max_by("hour", F.struct("m", -F.col("hour"))).alias("peak_hour"))
    return p.groupBy(group).agg((F.count_distinct("peak_hour") / F.count("*")).alias("diversity"))


def bottlenecks(s: DataFrame, capacity: float, threshold: float = 0.8, group: str = "lv_group") -> DataFrame:
    m = slots(s, group).groupBy(group).agg(F.max("demand").alias("peak")).withColumn("loading", F.col("peak") / capacity)
    return m.where(F.col("loading") > threshold).withColumn("criticality", F.when(F.col("loading") > 1.2, "critical").when(F.col("loading") > 1.0, "high").otherwise("medium"))


def peak_hours(s: DataFrame, n: int = 3, least: int = 20) -> DataFrame:
    """The n hours of day with the largest mean demand of each building with more than ``least`` states."""
    h = s.groupBy("building_id", F.hour("ts").alias("hour")).agg(F.avg("demand").alias("m"), F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy("building_id"))
    rank = F.row_number().over(Window.partitionBy("building_id").orderBy(F.desc("m"), "hour"))
    return h.withColumns({"total": total, "rank": rank}).where((F.col("total") > least) & (F.col("rank") <= n)).select("building_id", "rank", "hour", "m")


def rolling(s: DataFrame, window: int = 24) -> DataFrame:
    """Mean, max and min of the last ``window`` states; 0 until there are so many."""
    w = Window.partitionBy("building_id").orderBy("ts", "event_id").rowsBetween(1 - window, 0)
    full = F.count("*").over(w) >= window
    roll = lambda f: F.when(full, f("demand").over(w)).otherwise(0.0)
    return s.select("building_id", "event_id", roll(F.avg).alias("mean"), roll(F.max).alias("max"), roll(F.min).alias("min"))


def energy_gaps(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Hours of day in which a cluster's mean net demand is positive, with their class."""
    h = s.groupBy(group, F.hour("ts").alias("hour")).agg((F.avg("demand") - F.avg("generation")).alias("net"))
    kind = F.when(F.col("hour").between(6, 9), "morning").when(F.col("hour").between(17, 21), "evening").otherwise("base")
    return h.where("net > 0").select(group, "hour", "net", kind.alias("gap_type"))


def merged_gaps(gaps: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Contiguous hours of one gap type as one interval with its largest magnitude."""
    w = Window.partitionBy(group, "gap_type").orderBy("hour")
    cut = gaps.withColumn("new", (F.coalesce(F.col("hour") - F.lag("hour").over(w), F.lit(99)) > 1).cast("int"))
    return cut.withColumn("island", F.sum("new").over(w)).groupBy(group, "gap_type", "island").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.max("net").alias("magnitude")).drop("island")


def pattern_features(s: DataFrame) -> DataFrame:
    """Hours of the largest and smallest mean net demand, export hours, demand and solar peak mismatch."""
    h = s.groupBy("building_id", F.hour("ts").alias("hour")).agg(F.avg("demand").alias("d"), F.avg("generation").alias("g"))
    first = lambda c: F.struct(c, -F.col("hour"))
    p = h.groupBy("building_id").agg(F.max_by("hour", first(F.col("d"))).alias("demand_peak"), F.max_by("hour", first(F.col("g"))).alias("solar_peak"), F.min_by("hour", F.struct("d", "hour")).alias("demand_low"), F.count_if(F.col("g") > F.col("d")).alias("export_hours"))
    return p.withColumn("mismatch", F.abs(F.col("demand_peak") - F.col("solar_peak")))


def day_parts(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    h = F.hour("ts")
    within = lambda lo, hi: F.when(h.between(lo, hi), F.col("demand"))
    return s.groupBy(group).agg(F.max(within(6, 9)).alias("morning_peak"), F.max(within(17, 21)).alias("evening_peak"), F.min(F.when((h < 6) | (h >= 22), F.col("demand"))).alias("night_min"))


def lookback(s: DataFrame, hours: int) -> DataFrame:
    """The states of the last hours before the newest one: (latest - hours, latest]."""
    latest = s.agg(F.max("ts").alias("latest"))
    return s.crossJoin(F.broadcast(latest)).where(F.col("ts") > F.col("latest") - F.expr(f"INTERVAL {hours} HOURS")).drop("latest")  # latest: one row


def resample(m: DataFrame, every: str, name: str = "event_type", value: str = "demand") -> DataFrame:
    g = m.groupBy(name, F.window("ts", every).alias("w")).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    return g.select(name, F.col("w.start").alias("start"), "mean", "min", "max", "n")


def moving_average(m: DataFrame, n: int, name: str = "event_type", value: str = "demand", every: str = "DAY") -> DataFrame:
    """Mean of the last n values of each metric; few metrics with many rows are cut by time.

    Each period is a task of its own: it is given the last n - 1 rows of the periods before it.
    """
    d = m.select(name, "event_id", "ts", F.col(value).alias("v"), F.date_trunc(every, "ts").alias("_p"))
    rows = F.struct("ts", "event_id", "v")
    last = d.withColumn("_r", F.row_number().over(Window.partitionBy(name, "_p").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("_r") < n)
    tails = last.groupBy(name, "_p").agg(F.array_sort(F.collect_list(rows)).alias("t"))  # at most n - 1 rows a period
    if n < 2:
        return d.select(name, "event_id", F.col("v").alias("moving_avg"))
    earlier = F.flatten(F.collect_list("t").over(Window.partitionBy(name).orderBy("_p").rowsBetween(1 - n, -1)))
    before = tails.select(name, "_p", earlier.alias("e")).where(F.size("e") > 0)
    carried = before.select(name, "_p", F.explode(F.slice("e", F.greatest(F.size("e") - n + 2, F.lit(1)), F.lit(n - 1))).alias("x")).select(name, "x.event_id", "x.ts", "x.v", "_p", F.lit(False).alias("_own"))
    w = Window.partitionBy(name, "_p").orderBy("ts", "event_id").rowsBetween(1 - n, 0)
    return d.withColumn("_own", F.lit(True)).unionByName(carried).withColumn("moving_avg", F.avg("v").over(w)).where("_own").select(name, "event_id", "moving_avg")


def trend(m: DataFrame, name: str = "event_type", value: str = "demand") -> DataFrame:
    """Slope of a value per day by least squares."""
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6 - 19700
    return m.groupBy(name).agg(F.regr_slope(F.col(value), x).alias("slope"))


def ramp_violations(m: DataFrame, value: str = "demand") -> DataFrame:
    """Steps of a building above half the sum of both magnitudes."""
    last = F.lag(value).over(Window.partitionBy("building_id").orderBy("ts", "event_id"))
    return m.withColumn("last", last).where(F.abs(F.col(value) - F.col("last")) > 0.5 * (F.abs(value) + F.abs("last"))).groupBy("building_id").agg(F.count("*").alias("violations"))


def pairwise_complementarity(s: DataFrame, group: str = "lv_group") -> DataFrame:
    """(1 - corr) / 2 of mean day profiles for building pairs of a group.

    Each building is one row with its centred unit profile, so a pair costs one dot product; pairs
    are formed inside a group only. A constant profile has no correlation and gives null.
    """
    h = s.groupBy(group, "building_id", F.hour("ts").alias("hour")).agg(F.avg("demand").alias("d"))
    p = h.groupBy(group, "building_id").agg(F.map_from_entries(F.collect_list(F.struct("hour", "d"))).alias("m"), F.avg("d").alias("mu"))
    line = p.select(group, "building_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 24
    centred = line.withColumn("c", F.transform("v", lambda x: x - mean))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    unit = centred.withColumn("n", norm).select(group, "building_id", F.when(F.col("n") > 0, F.transform("c", lambda x: x / F.col("n"))).alias("u"))
    a, b = unit.withColumnsRenamed({"building_id": "a", "u": "ua"}), unit.withColumnsRenamed({"building_id": "b", "u": "ub"})
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return a.join(b, group).where("a < b").select(group, "a", "b", ((1 - dot) / 2).alias("complementarity"))


def changed_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """The share of buildings whose cluster differs between two snapshots."""
    j = before.join(after.withColumnRenamed("cluster_id", "now"), "building_id")
    return j.agg(F.avg((F.col("cluster_id") != F.col("now")).cast("int")).alias("changed"), F.count("*").alias("buildings"))


def quantile_flags(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Slots above the 90th and below the 10th percentile of their cluster's demand."""
    t = slots(s, group)
    q = t.groupBy(group).agg(F.percentile("demand", F.array(F.lit(0.9), F.lit(0.1))).alias("q"))
    return t.join(q, group).groupBy(group).agg(F.count_if(F.col("demand") > F.col("q")[0]).alias("peaks"), F.count_if(F.col("demand") < F.col("q")[1]).alias("valleys"))


def time_shares(column: str) -> list[Column]:
    """Sine and cosine of the hour of day."""
    return cyclic(F.hour(column), 24, "hour")


def cyclic(value: Column, period: int, name: str) -> list[Column]:
    x = 2 * F.pi() * value / period
    return [F.sin(x).alias(f"{name}_sin"), F.cos(x).alias(f"{name}_cos")]


def calendar_shares(column: str) -> list[Column]:
    """Sine and cosine of hour of day, day of week (Monday 0) and month."""
    return [*cyclic(F.hour(column), 24, "hour"), *cyclic(F.weekday(column), 7, "dow"), *cyclic(F.month(column), 12, "month")]


def hour_peaks(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Hours of day at and above the 80th and at and below the 20th percentile of a group's mean demand, and the largest over the smallest."""
    h = slots(s, group).groupBy(group, F.hour("slot").alias("hour")).agg(F.avg("demand").alias("m"))
    q = h.groupBy(group).agg(F.percentile("m", F.array(F.lit(0.8), F.lit(0.2))).alias("q"), F.max("m").alias("hi"), F.min("m").alias("lo"))
    hours = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("hour")))), lambda x: x.cast("string")), ",")
    return h.join(q, group).groupBy(group).agg(hours(F.col("m") >= F.col("q")[0]).alias("peak_hours"), hours(F.col("m") <= F.col("q")[1]).alias("valley_hours"), F.max(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(0.0)).alias("ratio"))


def opportunities(clusters: DataFrame, gaps: DataFrame) -> DataFrame:
    """(kind, cluster_id, priority): clusters worth building up, the five largest midday gaps, three largest evening gaps, flat-load candidates.

    clusters: cluster_id, self_sufficiency, complementarity, load_factor; gaps: cluster_id, gap_type, hour, net.
    """
    one = lambda df, kind, p: df.select(F.lit(kind).alias("kind"), "cluster_id", p.alias("priority"))
    build = one(clusters.where("self_sufficiency < 0.3 AND complementarity > 0.5"), "high_potential_cluster", F.col("complementarity") * (1 - F.col("self_sufficiency")))
    solar = one(gaps.where("hour BETWEEN 9 AND 16").orderBy(F.desc("net"), "cluster_id", "hour").limit(5), "solar_opportunity", F.col("net"))
    store = one(gaps.where("gap_type = 'evening'").orderBy(F.desc("net"), "cluster_id", "hour").limit(3), "storage_opportunity", F.col("net"))
    flat = one(clusters.where("load_factor < 0.4"), "load_management", 1 - F.col("load_factor"))
    return build.unionByName(solar).unionByName(store).unionByName(flat)


def cluster_energy(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Building averages summed per cluster; 80 % of the export can be shared."""
    m = s.groupBy(group, "building_id").agg(F.avg("demand").alias("d"), F.avg("generation").alias("g"), F.avg(F.greatest(F.col("generation") - F.col("demand"), F.lit(0.0))).alias("e"))
    g = m.groupBy(group).agg(F.count("*").alias("buildings"), F.sum("d").alias("demand"), F.sum("g").alias("generation"), (0.8 * F.sum("e")).alias("shareable"))
    return g.withColumn("self_sufficiency", F.least(F.try_divide("generation", "demand"), F.lit(1.0)))


def energy_intensity(s: DataFrame, b: DataFrame) -> DataFrame:
    """Totals and peak of each building, per square metre where its area is known."""
    e = s.groupBy("building_id").agg(F.sum("demand").alias("kwh"), F.max("demand").alias("peak"))
    return e.join(b.select("building_id", "area"), "building_id", "left").withColumn("kwh_per_m2", F.try_divide("kwh", "area"))


def peak_coincidence(s: DataFrame, capacity: float = 630.0, group: str = "lv_group") -> DataFrame:
    """The share of buildings whose peak hour is the group's commonest one, and the group's loading."""
    h = s.groupBy(group, "building_id", F.hour("ts").alias("hour")).agg(F.avg("demand").alias("m"))
    p = h.groupBy(group, "building_id").agg(F.max_by("hour", F.struct("m", -F.col("hour"))).alias("hour"))
    top = p.groupBy(group, "hour").agg(F.count("*").alias("k")).groupBy(group).agg((F.max("k") / F.sum("k")).alias("coincidence"), F.sum("k").alias("buildings"))
    return top.join(slots(s, group).groupBy(group).agg((F.max("demand") / capacity).alias("loading")), group)


def hourly_self_sufficiency(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Spread of self-sufficiency over the hours of day (population standard deviation)."""
    h = slots(s, group).groupBy(group, F.hour("slot").alias("hour")).agg(F.try_divide(F.sum(F.least("demand", "generation")), F.sum("demand")).alias("q"))
    return h.groupBy(group).agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), F.min("q").alias("lowest"), F.max("q").alias("highest"))


def energy_waterfall(s: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Each building's demand and generation as own use, sharing inside its cluster, import and export.

    In a slot the smaller of the cluster's surplus and deficit is shared, in proportion to what each
    building gives or lacks. Slot totals are aggregated and joined back.
    """
    zero = F.lit(0.0)
    o = s.groupBy(group, F.date_trunc("hour", "ts").alias("slot"), "building_id").agg(F.sum("demand").alias("d"), F.sum("generation").alias("g"))
    o = o.withColumns({"own": F.least("d", "g"), "spare": F.greatest(F.col("g") - F.col("d"), zero), "lack": F.greatest(F.col("d") - F.col("g"), zero)})
    t = o.groupBy(group, "slot").agg(F.sum("spare").alias("ts"), F.sum("lack").alias("tl"))
    j = o.join(t, [group, "slot"])
    part = lambda c, total: F.coalesce(F.try_divide(F.col(c) * F.least("ts", "tl"), F.col(total)), zero)
    g = j.groupBy(group, "building_id").agg(F.sum("own").alias("own_use"), F.sum(part("spare", "ts")).alias("given"), F.sum(part("lack", "tl")).alias("received"), F.sum("spare").alias("spare"), F.sum("lack").alias("lack"))
    return g.select(group, "building_id", "own_use", "given", "received", (F.col("spare") - F.col("given")).alias("exported"), (F.col("lack") - F.col("received")).alias("imported"))


def fixed_profile(s: DataFrame, n: int = 96) -> DataFrame:
    """The first n states of each building as an array; a short series is padded with its mean."""
    w = Window.partitionBy("building_id").orderBy("ts", "event_id")
    f = s.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n).groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("i", "demand"))).alias("v"), F.avg("demand").alias("mean"))
    own = F.transform("v", lambda x: x["demand"])
    return f.select("building_id", F.size("v").alias("n_own"), F.concat(own, F.array_repeat("mean", F.lit(n) - F.size("v"))).alias("profile"))
