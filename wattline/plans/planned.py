"""Queries of the planning operators: solar candidates and sets, interventions, clusterings, matching, budgets, profiles of data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import auction as au
from ..operators import budget as bu
from ..operators import communities as co
from ..operators import data_profile as dp
from ..operators import graphs as gr
from ..operators import interventions as iv
from ..operators import modularity as md
from ..operators import profiles as pr
from ..operators import solar as so
from ..operators.components import _checkpoint as _stored
from ..operators.components import fresh_folder as fresh
from ..sources import publication as pb
from ..sources import star
from ..streaming import feedback as fb
from ..streaming import membership as mh
from . import bindings as at
from .registry import _BOUND, _PC, _add

_BOUND["so"] = at.by_sql("so", "customer")

_CLASS = lambda d: d.select("cluster_id", F.element_at(F.array(*map(F.lit, ("poor", "fair", "good", "excellent", "new"))), (F.col("cluster_id") % 5 + 1).cast("int")).alias("quality")).distinct()
_DAYTIME = lambda s: s.groupBy("building_id").agg(F.try_divide(F.avg(F.when(F.hour("ts").between(9, 17), F.col("demand"))), F.avg("demand")).alias("ratio"))
#: What a building gains from another is the opposite of their profiles' correlation.
_OPPOSED = lambda s: pr.pairwise_complementarity(s).select("a", "b", F.round(2 * F.col("complementarity") - 1, 6).alias("complementarity"))
_CANDIDATES = lambda b, s: so.solar_candidates(b, _DAYTIME(s), _OPPOSED(s), _CLASS(b))


def _case(col: str, values: dict, other: float) -> str:
    return f"CASE {col} {' '.join(f"WHEN '{k}' THEN {float(v)}::double" for k, v in values.items())} ELSE {float(other)}::double END"


_X19 = f"""{_PC}, o AS (SELECT a, b, round(2 * c - 1, 6) AS v FROM c),
w AS (SELECT a AS building_id, b AS other, v FROM o WHERE v > 0 UNION ALL SELECT b, a, v FROM o WHERE v > 0),
gain AS (SELECT w.building_id, 0.1 * sum(v) AS gain FROM w JOIN so x ON x.building_id = w.building_id JOIN so y ON y.building_id = w.other WHERE x.cluster_id = y.cluster_id AND NOT y.has_solar AND y.function = 'residential' GROUP BY 1),
dt AS (SELECT building_id, least(0.7::double, 1.2::double * avg(demand) FILTER (WHERE hour(ts) BETWEEN 9 AND 17) / avg(demand)) AS own FROM s GROUP BY 1),
need AS (SELECT cluster_id, avg(CASE WHEN has_solar THEN 1.0::double ELSE 0 END) < 0.3 AS needs FROM so GROUP BY 1),
t AS (SELECT *, least(1.0, CASE WHEN suitable_area >= 100 THEN 0.3::double WHEN suitable_area >= 50 THEN 0.2 ELSE 0.1 END + {_case('lower(orientation)', so.ORIENTATION, 0.15)} + CASE WHEN height > 15 THEN 0.2::double WHEN height > 10 THEN 0.15 ELSE 0.1 END
  + CASE WHEN lower(function) IN ('commercial', 'office') THEN 0.2::double WHEN function = 'light industrial' THEN 0.15 ELSE 0.1 END) AS technical FROM so WHERE suitable_area >= 20 AND NOT (has_solar AND solar_kw > 10)),
k AS (SELECT t.*, coalesce(own, 0.3::double) AS own, coalesce(gain, 0) AS gain, needs, greatest(3.0::double, round_even(2 * least(suitable_area / 7, avg_kw * 0.7, 100.0), 0) / 2) AS cap FROM t LEFT JOIN dt USING (building_id) LEFT JOIN gain USING (building_id) JOIN need USING (cluster_id) WHERE round(technical, 9) >= 0.6),
y AS (SELECT *, cap * {_case('lower(orientation)', so.IRRADIANCE, 1000)} * 0.86 AS kwh FROM k),
z AS (SELECT *, kwh * (own * 0.25 + (1 - own) * 0.08) - cap * 20 AS savings FROM y),
e AS (SELECT *, CASE WHEN savings > 0 THEN cap * 1000 / savings ELSE 999.0::double END AS years FROM z),
f AS (SELECT *, CASE WHEN round(years, 9) <= 5 THEN 1.0::double WHEN round(years, 9) <= 8 THEN 0.8 WHEN round(years, 9) <= 12 THEN 0.6 WHEN round(years, 9) <= 15 THEN 0.4 ELSE 0.2 END AS economic,
  least(1.0::double, CASE WHEN lower(function) IN ('commercial', 'office') THEN 0.3::double ELSE 0 END + gain + CASE WHEN needs THEN 0.2::double ELSE 0 END) AS comp FROM e),
q AS (SELECT *, (0.3::double * technical + 0.3::double * economic + 0.4::double * comp) * CASE cluster_id % 5 WHEN 0 THEN 1.5::double WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 ELSE 1.0 END AS score FROM f)"""
_add("x19_solar_candidates", "so s", _CANDIDATES, f"{_X19} SELECT cluster_id, building_id, r(technical) AS technical, r(economic) AS economic, r(comp) AS complementarity, r(score) AS score, r(cap) AS capacity_kw, r(kwh) AS generation_kwh, r(own) AS self_consumption, r(cap * 1000) AS cost, r(savings) AS savings, r(years) AS roi_years, r(kwh * 0.3 / 1000) AS co2_tons FROM q")

_YEARLY = lambda b: b.groupBy("cluster_id").agg(F.array(F.sum(F.col("avg_kw") * 24 * 365) * 0.02).alias("consumption"))  # noqa: E731  the part that solar is meant to meet
_add(
    "x20_greedy_solar_set", "so s", lambda b, s: so.greedy_solar_set(_CANDIDATES(b, s).withColumn("generation", F.array("generation_kwh")), _YEARLY(b)),
    f"RECURSIVE{_X19}, total AS (SELECT cluster_id, sum(avg_kw * 24 * 365) * 0.02 AS c FROM so GROUP BY 1), "
    "o2 AS (SELECT cluster_id, building_id, kwh, c, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, building_id) AS n FROM q JOIN total USING (cluster_id)), "
    "walk AS (SELECT cluster_id, 0::bigint AS n, NULL::bigint AS building_id, false AS took, 0.0::double AS benefit, 0.0::double AS gen, 0 AS picks, false AS done FROM total UNION ALL "
    "SELECT cluster_id, n, building_id, took, benefit, CASE WHEN took THEN gen + kwh ELSE gen END, CASE WHEN took THEN picks + 1 ELSE picks END, done OR (took AND gen + kwh > 0.8 * c) FROM "
    "(SELECT w.cluster_id, o2.n, o2.building_id, o2.kwh, o2.c, w.gen, w.picks, w.done, round((least(o2.c, w.gen + o2.kwh) - least(o2.c, w.gen)) / o2.c * (1 - 0.1::double * w.picks), 9) AS benefit, NOT w.done AND round((least(o2.c, w.gen + o2.kwh) - least(o2.c, w.gen)) / o2.c * (1 - 0.1::double * w.picks), 9) > 0.3 AS took FROM walk w JOIN o2 ON o2.cluster_id = w.cluster_id AND o2.n = w.n + 1)) "
    "SELECT cluster_id, building_id, picks AS pick, r(benefit) AS benefit, r(gen) AS generation FROM walk WHERE took",
)
_HOURLY = lambda s: s.groupBy("cluster_id", "building_id", F.hour("ts").alias("hour")).agg(F.round(F.sum("demand"), 6).alias("d"), F.round(F.sum("generation"), 6).alias("g"))
_SLOTS = lambda x: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.struct(F.col("hour"), F.col(x)))), h), F.lit(0.0)))


def _slot_set(s: DataFrame) -> DataFrame:
    h = _HOURLY(s)
    own = h.groupBy("cluster_id", "building_id").agg(_SLOTS("g").alias("generation"), F.sum("g").alias("score"))
    per = h.groupBy("cluster_id", "hour").agg(F.sum(F.col("d") * 0.5).alias("d"))
    return so.greedy_solar_set(own, per.groupBy("cluster_id").agg(_SLOTS("d").alias("consumption")), least=0.05, enough=0.6)


_add(
    "x20_solar_set_by_hour", "s", _slot_set,
    "RECURSIVE+h AS (SELECT cluster_id, building_id, hour(ts) AS hour, round(sum(demand), 6) AS d, round(sum(generation), 6) AS g FROM s GROUP BY ALL), "
    "k AS (SELECT cluster_id, building_id, list_transform(range(24), lambda i: coalesce(map_from_entries(list((hour, g)))[i], 0.0)) AS g, round(sum(g), 9) AS score FROM h GROUP BY 1, 2), "
    "p AS (SELECT cluster_id, hour, sum(d * 0.5::double) AS d FROM h GROUP BY 1, 2), t AS (SELECT cluster_id, list_transform(range(24), lambda i: coalesce(map_from_entries(list((hour, d)))[i], 0.0)) AS c, sum(d) AS all_d FROM p GROUP BY 1), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, building_id) AS n FROM k JOIN t USING (cluster_id)), "
    "walk AS (SELECT cluster_id, 0::bigint AS n, NULL::bigint AS building_id, false AS took, 0.0::double AS benefit, list_transform(c, lambda x: 0.0::double) AS gen, 0 AS picks, false AS done FROM t UNION ALL "
    "SELECT cluster_id, n, building_id, took, benefit, CASE WHEN took THEN more ELSE gen END, CASE WHEN took THEN picks + 1 ELSE picks END, done OR (took AND list_sum(more) > 0.6 * all_d) FROM "
    "(SELECT *, NOT done AND benefit > 0.05 AS took FROM (SELECT *, round((list_sum(list_transform(range(1, 25), lambda i: least(more[i], c[i]))) - list_sum(list_transform(range(1, 25), lambda i: least(gen[i], c[i])))) / all_d * (1 - 0.1::double * picks), 9) AS benefit FROM "
    "(SELECT w.cluster_id, o.n, o.building_id, o.c, o.all_d, w.gen, w.picks, w.done, list_transform(range(1, 25), lambda i: w.gen[i] + o.g[i]) AS more FROM walk w JOIN o ON o.cluster_id = w.cluster_id AND o.n = w.n + 1)))) "
    "SELECT cluster_id, building_id, picks AS pick, r(benefit) AS benefit, r(list_sum(gen)) AS generation FROM walk WHERE took",
)
_X36 = f"SELECT *, roof * 0.15::double * {_case('lower(orientation)', so.YIELD, 0.8)} AS kwp, 0.3::double * {_case('label', so.LABELS, 0.4)} + 0.2::double * least(roof / 100 * {_case('lower(orientation)', so.FACING, 0.8)}, 1) + 0.2::double * 0.5 + 0.2::double * least(annual_kwh / 10000, 1) + 0.1::double * (1 - (cluster_id % 11) / 10.0::double) AS priority FROM so WHERE NOT has_solar"
_add("x36_solar_priority", "so", lambda b: so.solar_priority(b, None, b.select("cluster_id", (F.col("cluster_id") % 11 / 10).alias("self_sufficiency")).distinct()), f"SELECT building_id, cluster_id, r(priority) AS priority, r(kwp) AS kwp, r(kwp * 1200 / (least(kwp * 1200, annual_kwh) * 0.25::double + greatest(0, kwp * 1200 - annual_kwh) * 0.08::double + 1e-6)) AS roi_years FROM ({_X36})")

_LINKED = lambda e: gr.both_ways(e.select("src", "dst")).select(F.col("src").alias("node")).distinct()
#: Stand-ins by arithmetic on the id, the same in both engines: label, roof, a vector of three, impact at two hops and a set of installations.
_NODES = lambda n: n.select("node", (F.col("node") % 7 / 6).alias("label_score"), (F.col("node") % 97).cast("double").alias("roof"), F.array(*((F.col("node") * k % 13 + 1).cast("double") for k in (3, 5, 11))).alias("embedding"), F.when(F.col("node") % 10 == 0, 1.0).otherwise(0.0).alias("violation"))
_AT = lambda n: n.withColumn("hop", F.explode(F.array(F.lit(1), F.lit(2))))
_IMPACTS = lambda n: _AT(n).select("node", "hop", ((F.col("node") + F.col("hop")) % 5 / 10).alias("impact"))
_HOPS = lambda n: _AT(n).select("node", "hop", F.array(*((F.col("node") * F.col("hop") % k).cast("double") for k in (4, 6, 9))).alias("features"))
_DONE = lambda e: e.select(F.col("src").alias("node")).where("node % 50 = 7").distinct()


def _ranked(e: DataFrame) -> DataFrame:
    n = _stored(_LINKED(e))
    return iv.rank_interventions(_NODES(n), e, _IMPACTS(n), _HOPS(n), _DONE(e))


_RANKED = lambda e: _ranked(_stored(e))  # noqa: E731  an edge is summed up from its rows once
_DOT = "list_sum(list_transform(range(1, 4), lambda i: {0}[i] * {1}[i]))".format
_COS = lambda x, y: f"{_DOT(x, y)} / (sqrt({_DOT(x, x)}) * sqrt({_DOT(y, y)}))"
_VAR = "list_sum(list_transform({0}, lambda x: pow(x - list_sum({0}) / 3.0, 2))) / 2".format
_X21 = f"""RECURSIVE+u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT src AS node, list_transform([3, 5, 11], lambda k: (src * k % 13 + 1)::double) AS v, count(*) AS d FROM u GROUP BY src),
br AS (SELECT src AS node, sum(1 - {_COS('a.v', 'b.v')}) AS bridge FROM u JOIN n a ON a.node = src JOIN n b ON b.node = dst GROUP BY 1), z AS (SELECT DISTINCT src AS node FROM e WHERE src % 50 = 7),
w AS (SELECT node, 0 AS hop FROM z UNION SELECT u.dst, w.hop + 1 FROM w JOIN u ON u.src = w.node WHERE w.hop < 10), h AS (SELECT node, min(hop) AS hop FROM w GROUP BY 1),
m AS (SELECT [avg(v[1]), avg(v[2]), avg(v[3])] AS m FROM n JOIN z USING (node)),
cv AS (SELECT node, {_VAR('list_transform([4, 6, 9], lambda k: (node % k)::double)')} + 0.5 * {_VAR('list_transform([4, 6, 9], lambda k: (node * 2 % k)::double)')} AS cv FROM n),
p AS (SELECT node, v, 0.5 * (node % 7 / 6.0) + 0.5 * (node % 97) / max(node % 97) OVER () AS local, (node + 1) % 5 / 10.0 + (node + 2) % 5 / 10.0 AS network, 0.5 * d / max(d) OVER () + 0.5 * bridge / max(bridge) OVER () AS position, cv / max(cv) OVER () AS cascade, coalesce(hop, 10) AS hop,
  0.7 * (1 - {_COS('v', 'm.m')}) + 0.3 * coalesce(hop, 10) / 10.0 AS bonus, CASE WHEN node % 10 = 0 THEN 0.5 ELSE 1 END AS keep FROM n JOIN br USING (node) JOIN cv USING (node) LEFT JOIN h USING (node) CROSS JOIN m)"""
_add("x21_rank_interventions", "e", lambda e: _RANKED(e).where("score > double('-inf')"), f"{_X21} SELECT node, r(local) AS local, r(network) AS network, r(position) AS position, r(cascade) AS cascade, r(bonus) AS bonus, r((0.3 * local + 0.7 * network + 0.2 * position + 0.3 * cascade + 0.2 * bonus) * CASE WHEN hop < 2 THEN 0.1 ELSE 1 END * keep) AS score FROM p WHERE hop > 0")
# a walk over all nodes in one order has no SQL of use; tests/test_planning.py holds it against that walk
_add("x21_spaced_selection", "e", lambda e: (lambda e: iv.spaced_selection(_ranked(e).select("node", "score"), e, 1))(_stored(e)))


# ---- clusterings, matching and one budget
_OPPOSING = lambda s: pr.pairwise_complementarity(s).select("a", "b", co.opposing_weight(F.col("complementarity")).alias("weight"))
# communities, matchings and pivots have no SQL; tests/test_planning.py and tests/test_communities.py hold them against plain Python
_add("x8_modularity_communities", "s", lambda s: md.modularity_communities(_OPPOSING(s)))
_add("x9_correlation_clusters", "s", lambda s: co.correlation_clusters(_OPPOSING(s).where("weight > 0.1")))
_PROFILE = lambda s: s.groupBy(F.floor(F.col("building_id") / 50).cast("long").alias("lv_group"), "building_id").agg(_SLOTS_OF("demand").alias("profile"))  # noqa: E731  fifty buildings a group, so that groups have several clusters
_SLOTS_OF = lambda x: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.aggregate(F.filter(F.collect_list(F.struct(F.hour("ts").alias("h"), F.col(x).alias("v"))), lambda p: p["h"] == h), F.lit(0.0), lambda t, p: t + p["v"]), F.lit(0.0)))
_add("x12_lv_group_clusters", "s", lambda s: co.lv_group_clustering(_PROFILE(s)))
#: Three producers and three consumers to each six neighbours; whole euros, so the slack leaves one least total.
_COSTS = lambda b: b.where("building_id % 6 < 3").select(F.floor(F.col("building_id") / 6).alias("g"), F.col("building_id").alias("a"), F.col("avg_kw").alias("x")).join(b.where("building_id % 6 >= 3").select(F.floor(F.col("building_id") / 6).alias("g"), F.col("building_id").alias("b"), F.col("avg_kw").alias("y")), "g").select("g", "a", "b", (F.floor(F.abs(F.col("x") - F.col("y"))) + (F.col("a") * 7 + F.col("b") * 5) % 11).cast("double").alias("cost"))
_add(
    "x15_assignment", "so", lambda b: au.assignment_matching(_COSTS(b), ["g"], precision=0.01, step=20.0).groupBy("g").agg(F.count("*").alias("pairs"), F.sum("cost").alias("cost")),
    "+k AS (SELECT floor(building_id / 6.0) AS g, * FROM so), c AS (SELECT x.g, x.building_id % 6 AS i, y.building_id % 6 - 3 AS j, floor(abs(x.avg_kw - y.avg_kw)) + (x.building_id * 7 + y.building_id * 5) % 11 AS cost FROM k x JOIN k y ON x.g = y.g AND x.building_id % 6 < 3 AND y.building_id % 6 >= 3) "
    "SELECT p.g::bigint AS g, 3::bigint AS pairs, min(p.cost + q.cost + t.cost)::double AS cost FROM c p JOIN c q ON q.g = p.g AND q.i = 1 AND q.j <> p.j JOIN c t ON t.g = p.g AND t.i = 2 AND t.j <> p.j AND t.j <> q.j WHERE p.i = 0 GROUP BY p.g",
)
_ITEMS = lambda b: b.select(F.col("building_id").alias("item_id"), (F.col("peak_kw") * (1 + F.col("building_id") % 7)).alias("value"), F.ceil("area").cast("double").alias("cost"))
_add(
    "x24_regional_mix", "b", lambda b: bu.regional_mix(_ITEMS(b), 50000.0).select("item_id", "value", "cost"),
    "+i AS (SELECT building_id AS item_id, peak_kw * (1 + building_id % 7) AS value, ceil(area)::double AS cost FROM b), k AS (SELECT *, row_number() OVER w AS rank, sum(cost) OVER w AS upto FROM i WINDOW w AS (ORDER BY round(value / cost, 9) DESC, item_id ROWS UNBOUNDED PRECEDING)) SELECT item_id, r(value) AS value, cost FROM k WHERE upto <= 50000.0",
)

# ---- profiles of data
_NUMBERS = ["demand", "generation", "building_id"]
_MOMENTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, r(100.0::double * (count(*) - count({c})) / count(*)) AS missing_pct, r(avg({c})) AS mean, r(stddev_samp({c})) AS std, min({c})::double AS min, max({c})::double AS max FROM s" for c in _NUMBERS)
_DAILY = lambda s: dp.merged(dp.sketches(s.withColumn("day", F.to_date("ts")), _NUMBERS, ["event_type"], ["day"]))  # noqa: E731  day by day, then merged
_add("r74_column_moments", "s", lambda s: dp.column_profile(_DAILY(s), _NUMBERS).select("column", "n", "missing_pct", "mean", "std", "min", "max"), _MOMENTS)
_add("r74_correlated_pairs", "s", lambda s: dp.correlated_pairs(_DAILY(s), _NUMBERS), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, r(corr({a}, {b})) AS correlation FROM s" for a, b in (("demand", "generation"), ("demand", "building_id"), ("generation", "building_id"))))
_add("r74_frequent_values", "s", lambda s: dp.frequent_values(_DAILY(s), "event_type", 3), "SELECT event_type AS value, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC LIMIT 3")
# quartiles, distinct counts and outliers come from sketches; tests/test_tables.py bounds their error
_add("r74_column_profile", "s", lambda s: dp.column_profile(_DAILY(s), _NUMBERS))


# ---- tables that are written and read again, and streams over them
def _star(s: DataFrame, b: DataFrame) -> DataFrame:
    path = fresh(s.sparkSession, "states")
    star.write_states(s.select("building_id", "ts", "demand", "generation"), path)
    slots = star.slots_of(s).where("is_weekend AND part IN ('morning', 'evening')")
    j = star.star_join(s.sparkSession, path, slots, b.where("function = 'residential'").select("building_id", "function", "cluster_id"), since="2024-01-03 05:00:00", until="2024-01-27 20:00:00")
    return j.groupBy("cluster_id", "part").agg(F.count("*").alias("n"), F.sum("demand").alias("demand"), F.count_distinct("building_id").alias("buildings"))


_add("j21_star_join", "s so", _star, "SELECT cluster_id, part, count(*) AS n, r(sum(demand)) AS demand, count(DISTINCT building_id) AS buildings FROM (SELECT so.cluster_id, s.*, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) >= 18 THEN 'evening' END AS part FROM s JOIN so USING (building_id) WHERE function = 'residential' AND isodow(ts) >= 6 AND ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-27 20:00:00') WHERE part IS NOT NULL GROUP BY ALL")
_RESULTS = lambda b: b.select("building_id", F.col("suitable_area").alias("capacity"), (F.col("avg_kw") * (1 + F.col("building_id") % 3)).alias("score"), (5 + F.col("building_id") % 9).cast("double").alias("roi_years"))
_add("a10_publish_ranked", "so", lambda b: pb.publish_ranked(_RESULTS(b), "solar", "score")[0], "SELECT building_id, row_number() OVER (ORDER BY avg_kw * (1 + building_id % 3) DESC, building_id) AS solar_rank, suitable_area AS solar_capacity, r(avg_kw * (1 + building_id % 3)) AS solar_score, (5 + building_id % 9)::double AS solar_roi_years FROM so")
_add("a10_program", "so", lambda b: pb.publish_ranked(_RESULTS(b), "solar", "score")[1], "SELECT 'SOLAR' AS program, count(*) AS num, r(sum(suitable_area)) AS total_capacity_kwp, r(avg(5 + building_id % 9)) AS avg_roi_years FROM so")


def _lineage(b: DataFrame) -> DataFrame:
    spark, path = b.sparkSession, fresh(b.sparkSession, "lineage")
    for i, (run, kind) in enumerate((("r1", "office"), ("r2", "residential"), ("r1", "office"))):  # the first run again
        rows = b.where(F.col("function") == kind).select(F.col("building_id").alias("id"))
        pb.append_lineage(spark, path, run, f"plan-{kind}", {"kind": kind}, {}, rows, f"2024-01-0{2 - i % 2} 00:00:00")
    return pb.affected_by(spark, path).groupBy("run_id", "task").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("day"))


_add("a7_lineage", "so", _lineage, "SELECT CASE WHEN function = 'office' THEN 'r1' ELSE 'r2' END AS run_id, 'plan-' || function AS task, count(*) AS n, min(building_id) AS first, CASE WHEN function = 'office' THEN '2024-01-02' ELSE '2024-01-01' END AS day FROM so WHERE function IN ('office', 'residential') GROUP BY function")


def _streamed(df: DataFrame, name: str, by: str) -> tuple[str, DataFrame]:
    """(folder, stream) of df's rows as files, a batch a value of ``by``."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    for i, r in enumerate(df.select(by).distinct().orderBy(by).collect()):  # a few batches
        df.where(F.col(by) == r[0]).coalesce(1).write.parquet(f"{path}/in/batch={i}")
    return path, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in/*")


def _history(m: DataFrame) -> DataFrame:
    """The newest state of each cluster after three batches of snapshots."""
    spark = m.sparkSession
    spark.conf.set(*mh.STATE_STORE)
    rows = m.select("cluster_id", F.col("snapshot").cast("timestamp").alias("snapshot"), "building_id", (F.dayofmonth("snapshot") % 3).alias("part"))
    path, stream = _streamed(rows, "history", "part")
    out = f"{path}/out"
    q = mh.membership_history(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda d, i: d.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}"))
    q.start().awaitTermination()
    done = spark.read.schema("cluster_id long, newest timestamp, snapshots long, members long, stability double, batch int").parquet(f"{out}/*")
    last = done.groupBy("cluster_id").agg(F.max_by(F.struct("newest", "snapshots", "members", "stability"), "batch").alias("s"))
    return last.select("cluster_id", F.to_date("s.newest").alias("newest"), "s.snapshots", "s.members", "s.stability")


_add(
    "st6_membership_history", "m", _history,
    "+n AS (SELECT cluster_id, snapshot, count(*) AS n, dense_rank() OVER (PARTITION BY cluster_id ORDER BY snapshot DESC) AS k, lag(snapshot) OVER (PARTITION BY cluster_id ORDER BY snapshot) AS was FROM m GROUP BY 1, 2), "
    "b AS (SELECT x.cluster_id, x.snapshot, count(*) AS both_in FROM m x JOIN n USING (cluster_id, snapshot) JOIN m y ON y.cluster_id = x.cluster_id AND y.building_id = x.building_id AND y.snapshot = n.was GROUP BY 1, 2), "
    "j AS (SELECT n.cluster_id, n.k, coalesce(both_in, 0)::double / (n.n + o.n - coalesce(both_in, 0)) AS j FROM n JOIN n o ON o.cluster_id = n.cluster_id AND o.snapshot = n.was LEFT JOIN b ON b.cluster_id = n.cluster_id AND b.snapshot = n.snapshot WHERE n.k < 10) "
    "SELECT n.cluster_id, max(snapshot) AS newest, least(count(*), 10)::bigint AS snapshots, arg_max(n, snapshot) AS members, (SELECT r(avg(j)) FROM j WHERE j.cluster_id = n.cluster_id) AS stability FROM n GROUP BY n.cluster_id",
)


def _weights(b: DataFrame) -> DataFrame:
    """The weights after three batches of deployments, the second of which is run twice."""
    spark, n = b.sparkSession, F.col("building_id")
    d = b.select((1000 + n % 400).cast("double").alias("predicted_generation"), (1000 + n * 7 % 900).cast("double").alias("actual_generation"), (5 + n % 6).cast("double").alias("predicted_roi_years"), (5 + n % 5).cast("double").alias("actual_roi_years"), (n % 10 / 10).alias("predicted_sufficiency"), (n % 8 / 10).alias("actual_sufficiency"), (n % 3).alias("part"))
    path, stream = _streamed(d, "feedback", "part")
    fb.start(spark, f"{path}/weights")
    learn = fb.learn(f"{path}/weights", rate=0.001)

    def batch(rows: DataFrame, i: int) -> None:
        learn(rows, i)
        if i == 1:
            learn(rows, i)

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return fb.weights_before(spark, f"{path}/weights").select(*so.WEIGHTS)


_add(
    "st8_weight_feedback", "so", _weights,
    "+d AS (SELECT building_id AS n, (abs(1000 + n % 400 - (1000 + n * 7 % 900)) / (1000 + n * 7 % 900 + 1e-6::double) + abs(n % 6 - n % 5) / (5 + n % 5 + 1e-6::double)) / 2 AS err FROM so), "
    "f AS (SELECT count(*) FILTER (WHERE round(err, 9) > 0.2 AND n % 8 > n % 10) AS s, count(*) FILTER (WHERE round(err, 9) > 0.2 AND n % 5 < n % 6) AS o FROM d), "
    "w AS (SELECT 0.3 * exp(s * ln(1 - 0.0005::double)) AS energy_label, 0.2 * exp(o * ln(1.001::double)) AS roof_potential, 0.2 * exp(o * ln(1 - 0.0005::double)) AS cascade_impact, 0.2 * exp(s * ln(1.001::double)) AS demand_match, 0.1::double AS cluster_benefit FROM f), "
    "t AS (SELECT *, energy_label + roof_potential + cascade_impact + demand_match + cluster_benefit AS a FROM w) SELECT r(energy_label / a) AS energy_label, r(roof_potential / a) AS roof_potential, r(cascade_impact / a) AS cascade_impact, r(demand_match / a) AS demand_match, r(cluster_benefit / a) AS cluster_benefit FROM t",
)
