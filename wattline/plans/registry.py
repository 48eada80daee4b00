"""All registered queries of the grid library with their SQL.

Each query binds driver tables to an operator and rounds its doubles; the SQL says the same for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import building as fb
from ..operators import flows as fl
from ..operators import graphs as gr
from ..operators import hierarchy as hi
from ..operators import memberships as me
from ..operators import planning as pl
from ..operators import profiles as pr
from ..operators import spatial as sp
from . import bindings as at

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_BOUND = {"b": at.buildings, "g": at.groups, "s": at.states, "f": at.flows, "sup": at.suppliers, "cus": at.customers, "par": at.parts, "e": at.edges, "m": at.memberships, "p": at.predictions} | {n: at.by_sql(n, *t.split()) for n, t in {"h": "orders customer nation", "c": "orders customer nation", "gs": "lineitem", "sg": "supplier", "fp": "customer", "wl": "orders"}.items()}


#: Added before rounding, so that values half way between two results round alike in both engines.
NUDGE = 3.3e-7


def scaled_round(c: Column, digits: int) -> Column:
    """round(c, digits) as DuckDB has it: of the scaled double, half way away from zero.

    Spark's own round takes the decimal digits, which differs half way and costs more than all else where a row is short.
    """
    t = c * 10.0**digits
    return F.when(F.abs(t - F.rint(t)) == 0.5, t + 0.5 * F.signum(t)).otherwise(F.rint(t) + 0.0) / 10.0**digits  # + 0.0: no negative zero


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(scaled_round(F.col(c) + NUDGE, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _add(name: str, needs: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """needs: the bindings that build takes, in order; sql may use them as tables and ``r(x)`` for rounding."""
    bound = needs.split()
    _QUERIES[name] = lambda spark, sf_dir: rounded(build(*(_BOUND[n](spark, sf_dir) for n in bound)))
    if sql:
        head = ", ".join(f"{n} AS ({at.SQL[n]})" for n in dict.fromkeys(bound))
        body = re.sub(r"\br\(", "round4(", sql)
        word, body = ("WITH RECURSIVE", body[9:]) if body.startswith("RECURSIVE") else ("WITH", body)
        _SQL[name] = f"{word} {head}{', ' if body.startswith('+') else ' '}{body.lstrip('+')}"  # + continues the list of tables


def queries() -> dict[str, Query]:
    from . import grid, planned  # noqa: F401  they add their queries

    return dict(_QUERIES)


def _round(sql: str) -> str:
    """round4(x) spelled as round(x + NUDGE, 4), x up to its own closing parenthesis."""
    while (i := sql.find("round4(")) >= 0:
        depth, j = 1, i + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:i]}round({sql[i + 7 : j - 1]} + {NUDGE}, 4){sql[j:]}"
    return sql


def oracle_sql() -> dict[str, str]:
    from . import grid, planned  # noqa: F401

    return {k: _round(v) for k, v in _SQL.items()}


POOR = "label IN ('D', 'E', 'F', 'G')"
_URGENT = "label IN ('E', 'F', 'G')"
SH = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)".format
N = "count(*) FILTER (WHERE {})".format

_add("r9_mv_station_summary", "b", hi.mv_station_summary, f"SELECT *, lv_groups || ' groups, ' || buildings || ' buildings' AS summary FROM (SELECT mv_station, count(DISTINCT lv_group) AS lv_groups, count(*) AS buildings, {N('has_solar')} AS solar, {N(POOR)} AS poor_label, {N("function = 'residential'")} AS residential, r(sum(area)) AS total_area, r(avg(distance_m)) AS avg_distance, r(max(peak_kw)) AS max_peak FROM b GROUP BY mv_station)")
_TOP = "SELECT lv_group, {0} AS top_{0} FROM (SELECT lv_group, {0}, row_number() OVER (PARTITION BY lv_group ORDER BY count(*) DESC, {0}) AS n FROM b GROUP BY lv_group, {0}) WHERE n = 1"
_add("r10_lv_group_summary", "b", hi.lv_group_summary, f"SELECT mv_station, lv_group, buildings, top_label, top_function, top_district, max_distance, oldest FROM (SELECT mv_station, lv_group, count(*) AS buildings, r(max(distance_m)) AS max_distance, min(build_year) AS oldest FROM b GROUP BY mv_station, lv_group) JOIN ({_TOP.format('label')}) USING (lv_group) JOIN ({_TOP.format('function')}) USING (lv_group) JOIN ({_TOP.format('district')}) USING (lv_group)")
_add("r11_station_breakdown", "b", hi.station_breakdown, "SELECT mv_station, sum(k)::bigint AS buildings, count(*) AS lv_groups, max(k) AS largest_group, (SELECT string_agg(district, ',' ORDER BY district) FROM (SELECT DISTINCT district FROM b x WHERE x.mv_station = p.mv_station)) AS districts FROM (SELECT mv_station, lv_group, count(*) AS k FROM b GROUP BY ALL) p GROUP BY mv_station ORDER BY buildings DESC, mv_station LIMIT 10")
_add("r12_station_rollup", "b", hi.station_rollup, "SELECT mv_station, grouping(mv_station)::tinyint AS is_total, count(*) AS buildings, r(sum(area)) AS area FROM b GROUP BY ROLLUP (mv_station)")
_add("r13_district_rollup", "b", hi.district_rollup, "SELECT mv_station, district, function, grouping(mv_station, district, function) AS level, count(*) AS buildings, r(avg(peak_kw)) AS avg_peak FROM b GROUP BY ROLLUP (mv_station, district, function)")
_add("r14_station_comparison", "b", hi.station_comparison, f"SELECT *, r(buildings / groups) AS per_group FROM (SELECT mv_station, count(*) AS buildings, count(DISTINCT lv_group) AS groups, r({SH('has_solar')}) AS solar_share, r({SH(POOR)}) AS poor_share FROM b GROUP BY mv_station HAVING count(*) > 50)")
_add("r15_share_of_parent", "b", hi.share_of_parent, "SELECT mv_station, lv_group, count(*) AS buildings, sum(count(*)) OVER (PARTITION BY mv_station)::bigint AS station_total, r(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY mv_station)) AS share_pct FROM b GROUP BY mv_station, lv_group")
_add("r16_level_summary", "b", hi.level_summary, f"+lv AS (SELECT mv_station, lv_group, count(*) AS n, {SH('has_solar')} AS s FROM b GROUP BY ALL), mv AS (SELECT mv_station, count(*) AS n, {SH('has_solar')} AS s FROM b GROUP BY ALL) SELECT 'LV' AS level, count(*) AS units, r(avg(n)) AS avg_buildings, r(avg(s)) AS avg_solar_share FROM lv UNION ALL SELECT 'MV', count(*), r(avg(n)), r(avg(s)) FROM mv")
_add("r17_grid_totals", "b", hi.grid_totals, "SELECT count(DISTINCT mv_station) AS stations, count(DISTINCT lv_group) AS lv_groups, count(*) AS buildings, r(sum(area)) AS area FROM b")
_add("r5_grid_kpis", "b", hi.grid_kpis, "SELECT metric, r(value) AS value FROM (SELECT unnest(['buildings', 'solar', 'battery', 'too_far', 'avg_distance']) AS metric, unnest([count(*)::double, count_if(has_solar)::double, count_if(has_battery)::double, count_if(distance_m > 150)::double, avg(distance_m)]) AS value FROM b)")
_add("r6_connection_types", "b", hi.connection_type_summary, "SELECT *, r(100.0 * buildings / sum(buildings) OVER ()) AS pct FROM (SELECT CASE WHEN distance_m <= 5 THEN 'ENDED' WHEN distance_m <= 50 THEN 'ENTERED' WHEN distance_m <= 150 THEN 'BY_DISTANCE' ELSE 'TOO_FAR' END AS connection_type, count(*) AS buildings, r(avg(distance_m)) AS avg_distance, max(distance_m) AS max_distance FROM b GROUP BY 1)")
_add("r7_problematic_connections", "b", hi.problematic_connections, "SELECT building_id, lv_group, distance_m FROM b WHERE distance_m > 150")
_add("r8_capability_matrix", "b", hi.capability_matrix, "SELECT count_if(area > 100 AND function <> 'residential')::bigint AS large_other, count_if(area > 100 AND function = 'residential')::bigint AS large_home, count_if(area <= 100 AND function <> 'residential')::bigint AS small_other, count_if(area <= 100 AND function = 'residential')::bigint AS small_home FROM b")
_MDM = f"SELECT *, CASE WHEN functions >= 3 THEN 3 WHEN functions >= 2 THEN 2 ELSE 1 END AS diversity_score, CASE WHEN poor_share >= 0.5 THEN 3 WHEN poor_share >= 0.3 THEN 2 ELSE 1 END AS need_score, CASE WHEN solar_share >= 0.3 THEN 3 WHEN solar_share >= 0.15 THEN 2 ELSE 1 END AS solar_score FROM (SELECT mv_station, district, count(*) AS buildings, count(DISTINCT function) AS functions, stddev_samp(peak_kw) AS peak_std, {SH('has_solar')} AS solar_share, {SH(POOR)} AS poor_share, avg(2024 - build_year) AS avg_age FROM b GROUP BY mv_station, district)"
_add("r18_mv_district_metrics", "b", hi.mv_district_metrics, f"SELECT mv_station, district, buildings, functions, r(peak_std) AS peak_std, r(solar_share) AS solar_share, r(poor_share) AS poor_share, r(avg_age) AS avg_age, diversity_score, need_score, solar_score FROM ({_MDM})")
_add("r21_ranked_districts", "b", lambda b: hi.ranked_districts(hi.mv_district_metrics(b)), f"SELECT mv_station, district, diversity_score + need_score + solar_score AS score, CASE WHEN need_score = 3 AND diversity_score = 3 THEN 'high need, mixed' WHEN need_score = 3 THEN 'high need' ELSE 'regular' END AS pattern FROM ({_MDM}) ORDER BY score DESC, mv_station, district LIMIT 20")
_add("r22_opportunity_stations", "b", hi.opportunity_stations, f"SELECT *, CASE WHEN overlap >= 10 THEN 'HIGH' WHEN overlap >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS opportunity FROM (SELECT mv_station, count_if(f >= 3)::bigint AS mixed, count_if(poor >= 0.5)::bigint AS needy, count_if(f >= 3 AND poor >= 0.5)::bigint AS overlap FROM (SELECT mv_station, lv_group, count(DISTINCT function) AS f, {SH(POOR)} AS poor FROM b GROUP BY ALL) GROUP BY mv_station)")
_add("r23_split_districts", "b", lambda b: hi.split_districts(hi.mv_district_metrics(b)), f"SELECT district, count(*) AS stations, r(stddev_samp(poor_share)) AS poor_std, sum(buildings)::bigint AS buildings FROM ({_MDM}) GROUP BY district HAVING count(*) > 1")
_ENT = "SELECT {0}, n, r(h) AS entropy, r(CASE WHEN {1} > 0 THEN h / {1} ELSE 0 END) AS normalised FROM (SELECT {0}, sum(k)::bigint AS n, ln(sum(k)) - sum(k * ln(k)) / sum(k) AS h, count(*) AS c FROM (SELECT {0}, {2}, count(*) AS k FROM b GROUP BY ALL) GROUP BY {0})"
_add("r43_entropy_observed", "b", lambda b: hi.entropy(b, "mv_station", "function"), _ENT.format("mv_station", "ln(c)", "function"))
_add("r43_entropy_fixed", "b", lambda b: hi.entropy(b, "lv_group", "label", 7), _ENT.format("lv_group", "ln(7)", "label"))
_add("r44_variation", "b", hi.coefficient_of_variation, "SELECT lv_group, r(stddev_pop(peak_kw) / avg(peak_kw)) AS cv, r(2 * avg(p) * (1 - avg(p))) AS prosumer_mix FROM (SELECT *, CASE WHEN has_solar OR has_battery THEN 1.0 ELSE 0.0 END AS p FROM b) GROUP BY lv_group")
_IM = f"SELECT *, 0.35 * retrofit + 0.3 * solar + 0.2 * heat_pump + 0.15 * battery AS score FROM (SELECT lv_group, count(*) AS buildings, {SH(_URGENT)}::double AS retrofit, {SH('NOT has_solar AND area > 100')}::double AS solar, {SH("NOT has_heat_pump AND label IN ('A', 'B', 'C')")}::double AS heat_pump, {SH('has_solar AND NOT has_battery')}::double AS battery FROM b GROUP BY lv_group)"
_add("r45_intervention_metrics", "b", hi.intervention_metrics, f"SELECT lv_group, buildings, r(retrofit) AS retrofit, r(solar) AS solar, r(heat_pump) AS heat_pump, r(battery) AS battery, r(score) AS score FROM ({_IM})")
_add("r47_lv_portfolio", "b", lambda b: hi.lv_portfolio(hi.intervention_metrics(b).withColumn("score", scaled_round(F.col("score"), 9))), f"SELECT lv_group, buildings, r(sc) AS score, program, row_number() OVER (PARTITION BY program ORDER BY sc DESC, lv_group)::int AS rank FROM (SELECT *, round(score, 9) AS sc, CASE WHEN retrofit >= 0.5 THEN 'retrofit' WHEN solar >= 0.5 THEN 'solar' WHEN heat_pump >= 0.4 THEN 'electrify' ELSE 'monitor' END AS program FROM ({_IM}) WHERE buildings >= 3)")
_add("r52_transformer_loading", "b", lambda b: hi.transformer_loading(b, 300.0), "SELECT lv_group, r(sum(peak_kw)) AS peak_kw, r(least(sum(peak_kw) / 300.0, 1.0)) AS loading, sum(peak_kw) > 240.0 AS over_80 FROM b GROUP BY lv_group")
_add("r54_fairness", "b", hi.fairness, "SELECT r((SELECT pow(sum(peak_kw), 2) / (count(*) * sum(peak_kw * peak_kw)) FROM b)) AS jain, r((SELECT 1 / (1 + stddev_pop(n) / avg(n)) FROM (SELECT count(*) AS n FROM b GROUP BY lv_group))) AS size_stability")
_add("r56_label_distribution", "b", hi.label_distribution, "SELECT label, count(*) AS buildings FROM b GROUP BY label")
_add("r63_penetration", "b", hi.penetration, f"SELECT r({SH('has_solar')}) AS by_building, r(sum(area) FILTER (WHERE has_solar) / sum(area)) AS by_area, r(sum(peak_kw) FILTER (WHERE has_solar) / sum(peak_kw)) AS by_capacity FROM b")
_add("r64_distribute_target", "b", lambda b: hi.distribute_target(b, 100000.0, 5.0), "SELECT lv_group, r(greatest(100000.0 * sum(area) / (SELECT sum(area) FROM b), 5.0)) AS target FROM b GROUP BY lv_group")
_add("r69_data_quality", "b", lambda b: hi.data_quality(b, {"area": (10, 400), "build_year": (1910, 2010), "distance_m": (0, 150)}), "SELECT unnest(['area_null', 'area_range', 'build_year_null', 'build_year_range', 'distance_m_null', 'distance_m_range']) AS \"check\", unnest([count_if(area IS NULL), count_if(area < 10 OR area > 400), count_if(build_year IS NULL), count_if(build_year < 1910 OR build_year > 2010), count_if(distance_m IS NULL), count_if(distance_m < 0 OR distance_m > 150)])::bigint AS n FROM b")
_add("r72_topology_counts", "g b", hi.topology_counts, "SELECT lv_group, count(building_id) AS buildings FROM (SELECT DISTINCT lv_group FROM g) LEFT JOIN b USING (lv_group) GROUP BY lv_group")
_LATE = lambda g, b: hi.unassigned(g, b.where("build_year >= 2000"))  # noqa: E731  groups without a recent building: some are
_add("j16_unassigned_groups", "g b", _LATE, "SELECT DISTINCT lv_group FROM g WHERE lv_group NOT IN (SELECT lv_group FROM b WHERE build_year >= 2000)")
_ROOF = "(roof_flat + roof_sloped * CASE WHEN orientation IN ('S', 'SE', 'SW') THEN 0.6 ELSE 0.3 END)"
_LAB = "CASE WHEN label LIKE 'A%' THEN 'A' ELSE label END"
_SOL = f"CASE WHEN {_ROOF} > 100 THEN 'high' WHEN {_ROOF} > 50 THEN 'medium' WHEN {_ROOF} > 25 THEN 'low' ELSE 'none' END"
_add("p2_p10_building_features", "c", fb.features, f"SELECT building_id, least(200, greatest(0, 2024 - build_year)) AS age, label, CASE WHEN label = 'A' THEN 'excellent' WHEN label = 'B' THEN 'good' WHEN label IN ('C', 'D') THEN 'fair' WHEN label IN ('E', 'F') THEN 'poor' ELSE 'very_poor' END AS insulation, CASE label WHEN 'A' THEN 4.2::double WHEN 'B' THEN 3.7 WHEN 'C' THEN 3.2 WHEN 'D' THEN 2.7 WHEN 'E' THEN 2.3 WHEN 'F' THEN 2.0 ELSE 1.7 END AS cop, r({_ROOF}) AS roof, r({_ROOF} * 0.175 * 0.85) AS kwp, s AS roof_class, CASE WHEN s IN ('high', 'medium') THEN 'ready' WHEN is_mv_capable OR function = 'non_residential' THEN 'conditional' ELSE 'not_ready' END AS battery, CASE WHEN label IN ('F', 'G') THEN 'upgrade_needed' WHEN label IN ('D', 'E') THEN 'conditional' ELSE 'immediate' END AS electrification, has_solar OR has_battery OR s IN ('high', 'medium') AS prosumer FROM (SELECT * REPLACE ({_LAB} AS label), {_SOL} AS s FROM c)")
_BAT = "CASE WHEN area < 100 THEN 5.0::double WHEN area < 150 THEN 7.5 WHEN area < 200 THEN 10.0 WHEN area < 300 THEN 13.5 ELSE 15.0 END"
_PUMP = "area * CASE age_range WHEN '< 1945' THEN 0.075::double WHEN '1945-1975' THEN 0.065 WHEN '1975-1990' THEN 0.055 WHEN '1990-2005' THEN 0.045 WHEN '2005-2015' THEN 0.035 ELSE 0.025 END"
_add("p12_asset_opportunities", "c", fb.asset_opportunities, f"+q AS (SELECT * REPLACE ({_LAB} AS label), {_SOL} AS s FROM c) SELECT building_id, 'solar' AS asset, CASE WHEN area < 150 THEN 4.0::double WHEN area < 300 THEN 6.0 ELSE 10.0 END AS size, CASE WHEN s = 'high' THEN 0.9::double ELSE 0.7 END AS feasibility, 'medium' AS priority FROM q WHERE s IN ('high', 'medium') AND NOT has_solar UNION ALL SELECT building_id, 'battery', {_BAT}, CASE WHEN has_solar OR s IN ('high', 'medium') THEN 0.8 ELSE 0.6 END, 'low' FROM q WHERE (s IN ('high', 'medium') OR function = 'non_residential') AND NOT has_battery UNION ALL SELECT building_id, 'heat_pump', r({_PUMP}), NULL, CASE label WHEN 'G' THEN '1' WHEN 'F' THEN '2' WHEN 'E' THEN '3' ELSE '4' END FROM q WHERE label IN ('D', 'E', 'F', 'G') AND NOT has_heat_pump")
_add("p11_asset_sizing", "c", fb.asset_sizing, f"SELECT building_id, {_BAT} AS battery_kwh, CASE WHEN area < 100 THEN 2.5::double WHEN area < 150 THEN 3.5 WHEN area < 200 THEN 5.0 WHEN area < 300 THEN 6.5 ELSE 7.5 END AS battery_kw, r({_PUMP}) AS pump_kw, CASE orientation WHEN 'S' THEN 1.0::double WHEN 'SW' THEN 0.95 WHEN 'E' THEN 0.85 WHEN 'W' THEN 0.85 ELSE 0.7 END AS orientation_efficiency FROM c")
_add("p13_semantic_classes", "c", lambda c: fb.semantic_classes(c, F.col("roof_flat") * 0.15), "SELECT building_id, CASE WHEN annual_kwh > 50000 THEN 'HighConsumer' WHEN annual_kwh < 10000 THEN 'LowConsumer' ELSE 'NormalConsumer' END AS consumer, CASE WHEN substr(label, 1, 1) IN ('A', 'B', 'C') THEN 'Efficient' WHEN label = 'D' THEN 'Moderate' ELSE 'Inefficient' END AS efficiency, roof_flat * 0.15 > 10 AS renewable_ready FROM c")
_add("p14_adjacency_type", "b", lambda b: b.select("building_id", fb.adjacency_type(*(F.col("building_id") % k for k in (2, 3, 5, 7))).alias("adjacency")), "SELECT building_id, CASE WHEN n = 0 THEN 'ISOLATED' WHEN (a AND c) OR (b AND d) THEN 'MIDDLE_ROW' WHEN n = 2 THEN 'CORNER' WHEN n = 1 THEN 'END_ROW' ELSE 'COURTYARD' END AS adjacency FROM (SELECT *, a::int + b::int + c::int + d::int AS n FROM (SELECT building_id, building_id % 2 > 0 AS a, building_id % 3 > 0 AS b, building_id % 5 > 0 AS c, building_id % 7 > 0 AS d FROM b))")
_PV = "list_sum(list_transform(range(1, 21), lambda y: {0} * pow(1.02, y) / pow(1.05, y)))"
_add("e1_solar_roi", "c", fb.solar_roi, f"SELECT building_id, r(k) AS kwp, r(n) AS investment, r(v) AS revenue, r(f) AS benefit, r(CASE WHEN f > 0 THEN n / f END) AS payback, r({_PV.format('f')} - n) AS npv, r({_PV.format('f')} / n) AS profitability, r(v * 20) AS lifetime_revenue, r(k * 900 * 0.5 * 20 / 1000) AS co2_tons FROM (SELECT *, v - k * 20 AS f FROM (SELECT *, k * 1200 * 0.7 AS n, own * 0.25 + (k * 900 - own) * 0.08 AS v FROM (SELECT *, least(k * 900 * 0.3, annual_kwh) AS own FROM (SELECT building_id, annual_kwh, {_ROOF} * 0.175 * 0.85 AS k FROM c)))) WHERE k > 0")
_add("e4_retrofit_economics", "c", fb.retrofit_economics, f"SELECT building_id, n AS steps, r(area * n * 150) AS investment, r(s) AS saved_kwh, r(s * 0.25) AS saving, r(area * n * 150 / (s * 0.25)) AS payback, r({_PV.format('s * 0.25')} - area * n * 150) AS npv, r(s * 0.5 / 1000) AS co2_tons, r(s * 0.25 + s * 0.5 / 1000 * 50) AS benefit FROM (SELECT *, annual_kwh * n * 0.15 AS s FROM (SELECT *, (ascii(label) - 66)::int AS n FROM c)) WHERE n > 0")
_FLOW = "list_prepend(-1000.0::double, list_transform(range(20), lambda t: (60 + building_id % 200)::double))"


def _irr(b: DataFrame) -> DataFrame:
    """The rate of each yearly saving is found once and looked up by its buildings."""
    b = b.select("building_id", (60 + F.col("building_id") % 200).alias("yearly"))
    rates = b.select("yearly").distinct().select("yearly", fb.irr(F.lit(1000.0), F.col("yearly")).alias("irr"))
    return b.join(F.broadcast(rates), "yearly", "left").select("building_id", "irr")  # 200 rows


_add("e6_irr", "b", _irr, f"SELECT building_id, r(list_reduce(list_prepend(0.1::double, list_transform(range(30), lambda t: 0.0::double)), lambda x, y: x + list_sum(list_transform(f, lambda c, i: c / pow(1 + x, i - 1))) / list_sum(list_transform(f, lambda c, i: (i - 1) * c / pow(1 + x, i))))) AS irr FROM (SELECT building_id, {_FLOW} AS f FROM b)")

_SLOT = "SELECT {0}, date_trunc('hour', ts) AS slot, sum(demand) AS demand, sum(generation) AS generation FROM s GROUP BY ALL"
_add("p15_energy_state", "s", lambda s: pr.derive(s).select("event_id", "net", "export"), "SELECT event_id, r(demand - generation) AS net, r(greatest(0, generation - demand)) AS export FROM s")
_add("p16_timeslots", "s", pr.timeslots, "SELECT strftime(slot, '%Y%m%d_%H%M') AS slot_id, year(slot)::int AS year, month(slot)::int AS month, hour(slot)::int AS hour, (isodow(slot) - 1)::int AS dow, isodow(slot) >= 6 AS is_weekend, CASE WHEN month(slot) IN (12, 1, 2) THEN 'winter' WHEN month(slot) <= 5 THEN 'spring' WHEN month(slot) <= 8 THEN 'summer' ELSE 'autumn' END AS season, CASE WHEN hour(slot) < 6 THEN 'night' WHEN hour(slot) < 12 THEN 'morning' WHEN hour(slot) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM (SELECT DISTINCT date_trunc('hour', ts) AS slot FROM s)")
_add("p19_cyclic_time", "s", lambda s: s.select("event_id", *pr.time_shares("ts")), "SELECT event_id, r(sin(2 * pi() * hour(ts) / 24)) + 0.0 AS hour_sin, r(cos(2 * pi() * hour(ts) / 24)) + 0.0 AS hour_cos FROM s")
_DAY = "SELECT building_id, ts::date AS day, avg(demand) AS avg_kw, max(demand) AS peak_kw, sum(demand) AS kwh, sum(generation) AS solar_kwh FROM s GROUP BY ALL"
_add("r24_daily_profiles", "s", pr.daily, f"SELECT building_id, day, r(avg_kw) AS avg_kw, peak_kw, r(kwh) AS kwh, r(solar_kwh) AS solar_kwh FROM ({_DAY})")
_add("r25_monthly_profiles", "s", lambda s: pr.monthly(pr.daily(s)), f"SELECT building_id, year(day)::int AS year, month(day)::int AS month, r(avg(avg_kw)) AS avg_kw, max(peak_kw) AS peak_kw, r(sum(kwh)) AS kwh FROM ({_DAY}) GROUP BY ALL")
_BASE = "SELECT building_id, lv_group, max(demand) AS peak, avg(demand) AS avg, stddev_samp(demand) AS std, sum(least(demand, generation)) AS own, sum(generation) AS gen FROM s GROUP BY ALL"
_add("r29_building_baseline", "s", pr.baseline, f"SELECT building_id, lv_group, peak, r(avg) AS avg, r(avg / peak) AS load_factor, r(std) AS std, r(CASE WHEN gen <> 0 THEN own / gen END) AS self_consumption FROM ({_BASE})")
_add("r30_group_baseline", "s", lambda s: pr.group_baseline(pr.baseline(s)), f"SELECT lv_group, count(*) AS buildings, r(sum(peak)) AS sum_peaks, r(sum(avg)) AS sum_avg, r(avg(avg / peak)) AS load_factor FROM ({_BASE}) GROUP BY lv_group")
_add("r33_cluster_time_series", "s", pr.cluster_time_series, f"SELECT cluster_id, slot, r(demand) AS demand, r(generation) AS generation, r(greatest(demand - generation, 0)) AS deficit, r(greatest(generation - demand, 0)) AS surplus FROM ({_SLOT.format('cluster_id')})")
_add("r39_energy_metrics", "s", pr.energy_metrics, f"SELECT cluster_id, r(sum(demand)) AS demand, r(sum(generation)) AS generation, r(sum(least(demand, generation))) AS shared, r(sum(greatest(demand - generation, 0))) AS imported, r(sum(greatest(generation - demand, 0))) AS exported, r(sum(least(demand, generation)) / sum(demand)) AS self_sufficiency, r(CASE WHEN sum(generation) <> 0 THEN sum(least(demand, generation)) / sum(generation) END) AS self_consumption FROM ({_SLOT.format('cluster_id')}) GROUP BY cluster_id")
_add("r40_peak_metrics", "s", pr.peak_metrics, "+own AS (SELECT cluster_id, building_id, date_trunc('hour', ts) AS slot, sum(demand) AS d FROM s GROUP BY ALL), per AS (SELECT cluster_id, sum(p) AS sp FROM (SELECT cluster_id, building_id, max(d) AS p FROM own GROUP BY ALL) GROUP BY 1), tot AS (SELECT cluster_id, max(d) AS pk, avg(d) AS av FROM (SELECT cluster_id, slot, sum(d) AS d FROM own GROUP BY ALL) GROUP BY 1) SELECT cluster_id, r(sp) AS sum_peaks, r(pk) AS peak, r(1 - pk / sp) AS peak_reduction, r(sp / pk) AS diversity_factor, r(av / pk) AS load_factor FROM per JOIN tot USING (cluster_id)")
_add("r41_energy_balance", "s", pr.energy_balance, "SELECT cluster_id, r(q) AS ratio, r(CASE WHEN q <= 1 THEN q ELSE 1 / q END) AS balance FROM (SELECT cluster_id, sum(generation) / sum(demand) AS q FROM s GROUP BY 1)")
_add("r42_load_diversity", "s", pr.load_diversity, "SELECT cluster_id, r(count(DISTINCT h)::double / count(*)) AS diversity FROM (SELECT cluster_id, building_id, h FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY m DESC, h) AS n FROM (SELECT cluster_id, building_id, hour(ts) AS h, avg(demand) AS m FROM s GROUP BY ALL)) WHERE n = 1) GROUP BY 1")
_add("r53_bottlenecks", "s", lambda s: pr.bottlenecks(s, 500.0), f"SELECT lv_group, r(p) AS peak, r(p / 500.0) AS loading, CASE WHEN p / 500.0 > 1.2 THEN 'critical' WHEN p / 500.0 > 1.0 THEN 'high' ELSE 'medium' END AS criticality FROM (SELECT lv_group, max(demand) AS p FROM ({_SLOT.format('lv_group')}) GROUP BY 1) WHERE p / 500.0 > 0.8")
_HOUR = "SELECT building_id, hour(ts)::int AS hour, avg(demand) AS m, avg(generation) AS g, count(*) AS k FROM s GROUP BY ALL"
_add("w3_peak_hours", "s", pr.peak_hours, f"SELECT building_id, rank::int AS rank, hour, r(m) AS m FROM (SELECT *, sum(k) OVER (PARTITION BY building_id) AS total, row_number() OVER (PARTITION BY building_id ORDER BY m DESC, hour) AS rank FROM ({_HOUR})) WHERE total > 20 AND rank <= 3")
_ROLL = "CASE WHEN count(*) OVER w >= 24 THEN {0}(demand) OVER w ELSE 0 END"
_add("w4_rolling_features", "s", pr.rolling, f"SELECT building_id, event_id, r({_ROLL.format('avg')}) AS mean, r({_ROLL.format('max')}) AS max, r({_ROLL.format('min')}) AS min FROM s WINDOW w AS (PARTITION BY building_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
_add("w5_moving_average", "s", lambda s: pr.moving_average(s, 10), "SELECT event_type, event_id, r(avg(demand) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS moving_avg FROM s")
_GAP = "SELECT cluster_id, hour(ts)::int AS hour, avg(demand) - avg(generation) AS net, CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'morning' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'base' END AS gap_type FROM s GROUP BY ALL HAVING avg(demand) - avg(generation) > 0"
_add("x17_energy_gaps", "s", pr.energy_gaps, f"SELECT cluster_id, hour, r(net) AS net, gap_type FROM ({_GAP})")
_add("w6_merged_gaps", "s", lambda s: pr.merged_gaps(pr.energy_gaps(s)), f"SELECT cluster_id, gap_type, min(hour) AS first_hour, max(hour) AS last_hour, r(max(net)) AS magnitude FROM (SELECT *, hour - row_number() OVER (PARTITION BY cluster_id, gap_type ORDER BY hour) AS i FROM ({_GAP})) GROUP BY cluster_id, gap_type, i")
_add("w7_ramp_violations", "s", pr.ramp_violations, "SELECT building_id, count(*) AS violations FROM (SELECT building_id, demand, lag(demand) OVER (PARTITION BY building_id ORDER BY ts, event_id) AS last FROM s) WHERE abs(demand - last) > 0.5 * (abs(demand) + abs(last)) GROUP BY 1")
_SNAP = lambda s, k: s.select("building_id", ((F.col("building_id") * k) % 25).alias("cluster_id")).distinct()
_add("w8_assignment_changes", "s", lambda s: pr.changed_share(_SNAP(s, 1), _SNAP(s, 6)), "SELECT r(avg(CASE WHEN building_id % 25 <> (building_id * 6) % 25 THEN 1.0 ELSE 0.0 END)) AS changed, count(*) AS buildings FROM (SELECT DISTINCT building_id FROM s)")
_add("w13_instant_flags", "s", pr.quantile_flags, f"+t AS ({_SLOT.format('cluster_id')}), q AS (SELECT cluster_id, quantile_cont(demand, 0.9) AS hi, quantile_cont(demand, 0.1) AS lo FROM t GROUP BY 1) SELECT cluster_id, count_if(demand > hi)::bigint AS peaks, count_if(demand < lo)::bigint AS valleys FROM t JOIN q USING (cluster_id) GROUP BY 1")
_add("w14_day_parts", "s", pr.day_parts, "SELECT cluster_id, max(demand) FILTER (WHERE hour(ts) BETWEEN 6 AND 9) AS morning_peak, max(demand) FILTER (WHERE hour(ts) BETWEEN 17 AND 21) AS evening_peak, min(demand) FILTER (WHERE hour(ts) < 6 OR hour(ts) >= 22) AS night_min FROM s GROUP BY 1")
_add("w15_pattern_features", "s", pr.pattern_features, f"+h AS ({_HOUR}), d AS (SELECT building_id, hour FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY m DESC, hour) AS n FROM h) WHERE n = 1), l AS (SELECT building_id, hour FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY m, hour) AS n FROM h) WHERE n = 1), p AS (SELECT building_id, hour FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY g DESC, hour) AS n FROM h) WHERE n = 1) SELECT building_id, d.hour AS demand_peak, p.hour AS solar_peak, l.hour AS demand_low, (SELECT count(*) FROM h WHERE h.building_id = d.building_id AND g > m) AS export_hours, abs(d.hour - p.hour) AS mismatch FROM d JOIN l USING (building_id) JOIN p USING (building_id)")
_add("w18_trend", "s", pr.trend, "SELECT event_type, r(regr_slope(demand, epoch_us(ts) / 86400e6 - 19700)) AS slope FROM s GROUP BY 1")
_add("j22_lookback", "s", lambda s: pr.lookback(s, 48).select("event_id", "demand"), "SELECT event_id, demand FROM s WHERE ts > (SELECT max(ts) FROM s) - INTERVAL 48 HOURS")
_add("r68_resample", "s", lambda s: pr.resample(s, "6 hours"), "SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, r(avg(demand)) AS mean, min(demand) AS min, max(demand) AS max, count(*) AS n FROM s GROUP BY ALL")
_PC = "+h AS (SELECT lv_group, building_id, hour(ts) AS hour, avg(demand) AS d FROM s GROUP BY ALL), u AS (SELECT DISTINCT lv_group, building_id FROM s), p AS (SELECT u.lv_group, u.building_id, x.hour, coalesce(h.d, 0.0) AS d FROM u CROSS JOIN (SELECT unnest(range(24)) AS hour) x LEFT JOIN h ON h.building_id = u.building_id AND h.hour = x.hour), c AS (SELECT a.lv_group, a.building_id AS a, b.building_id AS b, (1 - corr(a.d, b.d)) / 2 AS c FROM p a JOIN p b ON a.lv_group = b.lv_group AND a.hour = b.hour AND a.building_id < b.building_id GROUP BY ALL) "
_add("x1_pairwise_complementarity", "s", pr.pairwise_complementarity, _PC + "SELECT lv_group, a, b, r(c) AS complementarity FROM c")
_add("x2_group_complementarity", "s", lambda s: pr.pairwise_complementarity(s).groupBy("lv_group").agg(F.avg("complementarity").alias("complementarity"), F.count("*").alias("pairs")), _PC + "SELECT lv_group, r(avg(c)) AS complementarity, count(*) AS pairs FROM c GROUP BY 1")
_add("x3_complementary_pairs", "s", lambda s: pr.pairwise_complementarity(s).where(F.round("complementarity", 6) >= 0.6).select("a", "b"), _PC + "SELECT a, b FROM c WHERE round(c, 6) >= 0.6")

_add("r73_sharing_matrix", "f", fl.sharing_matrix, "SELECT from_id, to_id, r(sum(energy_kwh)) AS energy_kwh FROM f GROUP BY ALL")
_add("k2_active_pairs", "f", lambda f: fl.active_pairs(f, 5), "SELECT from_id, to_id, r(sum(energy_kwh)) AS energy_kwh FROM f GROUP BY ALL ORDER BY sum(energy_kwh) DESC, from_id, to_id LIMIT 5")
_add("r59_node_stats", "f", fl.node_stats, "SELECT node, r(coalesce(sum(o), 0)) AS sent_kwh, r(coalesce(sum(i), 0)) AS received_kwh, count(o) AS n_sent, count(i) AS n_received FROM (SELECT from_id AS node, energy_kwh AS o, NULL::double AS i FROM f UNION ALL SELECT to_id, NULL, energy_kwh FROM f) GROUP BY node")
_add("r58_flow_summary", "f", fl.flow_summary, "SELECT r(sum(energy_kwh)) AS total_kwh, count(*) AS transactions, r(max(energy_kwh)) AS largest, (SELECT from_id FROM f GROUP BY 1 ORDER BY sum(energy_kwh) DESC, from_id LIMIT 1) AS top_sender, (SELECT to_id FROM f GROUP BY 1 ORDER BY sum(energy_kwh) DESC, to_id LIMIT 1) AS top_receiver FROM f")
_NET = lambda s: s.groupBy("lv_group", F.date_trunc("hour", "ts").cast("timestamp").alias("slot"), "building_id").agg(F.round(F.sum(F.col("demand") - F.col("generation")), 6).alias("net"))
_add("x14_shareable_energy", "s", lambda s: fl.match_surplus(_NET(s)).groupBy("lv_group").agg(F.sum("energy_kwh").alias("moved")), "SELECT lv_group, r(sum(least(u, v))) AS moved FROM (SELECT lv_group, slot, sum(greatest(-net, 0)) AS u, sum(greatest(net, 0)) AS v FROM (SELECT lv_group, date_trunc('hour', ts) AS slot, building_id, round(sum(demand - generation), 6) AS net FROM s GROUP BY ALL) GROUP BY ALL) WHERE u > 0 AND v > 0 GROUP BY 1")
_add("x14_surplus_matches", "s", lambda s: fl.match_surplus(_NET(s)), "+n AS (SELECT lv_group, date_trunc('hour', ts) AS slot, building_id, round(sum(demand - generation), 6) AS net FROM s GROUP BY ALL), m AS (SELECT *, net < 0 AS gives, sum(abs(net)) OVER (PARTITION BY lv_group, slot, net < 0 ORDER BY abs(net) DESC, building_id ROWS UNBOUNDED PRECEDING) AS hi FROM n WHERE net <> 0), x AS (SELECT *, hi - abs(net) AS lo FROM m) SELECT g.lv_group, g.slot, g.building_id AS from_id, t.building_id AS to_id, r(least(g.hi, t.hi) - greatest(g.lo, t.lo)) AS energy_kwh FROM x g JOIN x t ON g.lv_group = t.lv_group AND g.slot = t.slot AND g.gives AND NOT t.gives AND least(g.hi, t.hi) - greatest(g.lo, t.lo) > 1e-6")

_D = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))"
_add("j2_knn_within", "sup cus", lambda a, b: sp.knn_within(a, b, 2.0, 3), f"SELECT left_id, right_id, r(d) AS distance, n::int AS rank FROM (SELECT l.id AS left_id, r.id AS right_id, {_D} AS d, row_number() OVER (PARTITION BY l.id ORDER BY {_D}, r.id) AS n FROM sup l JOIN cus r ON abs(l.x - r.x) <= 2 AND abs(l.y - r.y) <= 2 WHERE {_D} <= 2) WHERE n <= 3")
_add("j1_snap_pairs", "par", lambda p: sp.snap_pairs(p, 0.55), f"SELECT l.id AS left_id, r.id AS right_id FROM par l JOIN par r ON l.x = r.x AND l.id < r.id AND abs(l.y - r.y) <= 0.55")
_add("gr1_snapped_groups", "par", lambda p: sp.snapped_groups(p, 0.55), "SELECT id, min(id) OVER (PARTITION BY x, i) AS group_id FROM (SELECT *, sum(new) OVER (PARTITION BY x ORDER BY y, id) AS i FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY x ORDER BY y, id) <= 0.55 THEN 0 ELSE 1 END AS new FROM par))")
_add("j7_match_confidence", "sup cus", lambda a, b: sp.within(a, b, 2.0).select("left_id", "right_id", sp.match_confidence(F.col("distance"), [(0.5, 1.0), (1.0, 0.8), (1.5, 0.6)]).alias("confidence")), f"SELECT left_id, right_id, CASE WHEN d <= 0.5 THEN 1.0 WHEN d <= 1 THEN 0.8 WHEN d <= 1.5 THEN 0.6 ELSE 0.2 END::double AS confidence FROM (SELECT l.id AS left_id, r.id AS right_id, {_D} AS d FROM sup l JOIN cus r ON abs(l.x - r.x) <= 2 AND abs(l.y - r.y) <= 2) WHERE d <= 2")
_add("a8_clip", "cus", lambda c: sp.clip(c, 10.0, 3.0, 60.0, 12.0), "SELECT id, round(x, 4) AS x, y FROM cus WHERE x BETWEEN 10 AND 60 AND y BETWEEN 3 AND 12")
_add("r1_group_extent", "cus", lambda c: sp.group_extent(c.withColumn("group_id", F.col("y").cast("long"))), "SELECT y::bigint AS group_id, count(*) AS n, r(min(x)) AS xmin, r(max(x)) AS xmax, min(y) AS ymin, max(y) AS ymax, r(avg(x)) AS cx, r(avg(y)) AS cy FROM cus GROUP BY y")
_BOTH = "+u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) "
_add("gr11_degree", "e", gr.degree, _BOTH + "SELECT src AS node, count(DISTINCT dst) AS degree, r(count(DISTINCT dst) / max(count(DISTINCT dst)) OVER ()) AS normalised FROM u GROUP BY src")
_add("gr8_hop_distance", "e", lambda e: gr.hop_distance(e, e.agg(F.min("src").alias("node")), 2), _BOTH + ", z AS (SELECT min(src) AS node FROM e), h1 AS (SELECT DISTINCT dst AS node FROM u JOIN z ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM u JOIN h1 ON src = node) SELECT node, min(hop)::int AS hop FROM (SELECT node, 0 AS hop FROM z UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node")
_CASC = _BOTH + ", n AS (SELECT DISTINCT src AS node, dst AS f FROM u), d AS (SELECT node, count(*) AS d FROM n GROUP BY 1), i0 AS (SELECT DISTINCT src AS node, 1.0::double AS i FROM e), i1 AS (SELECT n.node, 0.7 * sum(i / d) AS i FROM n JOIN d USING (node) JOIN i0 ON i0.node = f GROUP BY 1), i2 AS (SELECT n.node, 0.7 * sum(i / d) AS i FROM n JOIN d USING (node) JOIN i1 ON i1.node = f GROUP BY 1), i3 AS (SELECT n.node, 0.7 * sum(i / d) AS i FROM n JOIN d USING (node) JOIN i2 ON i2.node = f GROUP BY 1) SELECT node, r(max(i)) AS impact FROM (SELECT * FROM i0 UNION ALL SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3) GROUP BY node HAVING max(i) > 0.1"
_SOURCES = lambda e: e.select(F.col("src").alias("node")).distinct()
_add("gr9_cascade", "e", lambda e: gr.cascade(e, _SOURCES(e), 3, 0.7, 0.1), _CASC)
# the whole depth of the survey; the SQL above unrolls fewer hops, so tests/test_hops.py walks these by brute force
_FAR = lambda e: gr.hop_distance(e, e.agg(F.min("src").alias("node")), 10)
_WALK = "RECURSIVE+u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT min(src) AS node, 0 AS hop FROM e UNION SELECT u.dst, w.hop + 1 FROM w JOIN u ON u.src = w.node WHERE w.hop < 10), k AS (SELECT node, min(hop)::int AS hop FROM w GROUP BY node) "
_add("gr8_hop_distance_10", "e", _FAR, _WALK + "SELECT node, hop FROM k")
_add("gr9_cascade_3", "e", lambda e: gr.cascade(e, _SOURCES(e), 3, 0.7, 0.1), _CASC)
_add("gr13_hop_metrics_10", "e", lambda e: gr.hop_metrics(_FAR(e)), _WALK + "SELECT hop, count(*) AS nodes, r(count(*) / sum(count(*)) OVER ()) AS share FROM k WHERE hop > 0 GROUP BY hop")
_CL = lambda e: gr.both_ways(e.select("src", "dst")).select(F.col("src").alias("node"), (F.col("src") % 10).alias("cluster_id")).distinct()
_add("gr16_modularity", "e", lambda e: gr.modularity(e, _CL(e)), _BOTH + ", m AS (SELECT sum(weight) AS m FROM e), d AS (SELECT src % 10 AS c, sum(weight) AS d FROM u GROUP BY 1), w AS (SELECT src % 10 AS c, sum(weight) AS w FROM e WHERE src % 10 = dst % 10 GROUP BY 1) SELECT r(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2))) AS modularity FROM d LEFT JOIN w USING (c) CROSS JOIN m")
_add("gr20_boundary_nodes", "e", lambda e: gr.boundary_nodes(e, _CL(e)), _BOTH + "SELECT src AS node, count(DISTINCT dst) AS crossing FROM u WHERE src % 10 <> dst % 10 GROUP BY 1")
_add("gr22_neighbourhood_agreement", "e", lambda e: gr.neighbourhood_agreement(e, _CL(e).withColumnRenamed("cluster_id", "label"), 0.2), _BOTH + "SELECT src AS node, r(avg(CASE WHEN src % 10 = dst % 10 THEN 1.0 ELSE 0.0 END)) AS agreement FROM (SELECT DISTINCT src, dst FROM u) GROUP BY 1 HAVING avg(CASE WHEN src % 10 = dst % 10 THEN 1.0 ELSE 0.0 END) >= 0.2")

_LAST = "+o AS (SELECT building_id, arg_min(cluster_id, snapshot) AS c FROM m GROUP BY 1), w AS (SELECT building_id, arg_max(cluster_id, snapshot) AS c FROM m GROUP BY 1), ov AS (SELECT o.c AS old_id, w.c AS new_id, count(*) AS shared FROM o JOIN w USING (building_id) GROUP BY ALL), so AS (SELECT c, count(*) AS n FROM o GROUP BY 1), sw AS (SELECT c, count(*) AS n FROM w GROUP BY 1)"
_HOME = lambda m: m.select("building_id", (F.col("building_id") % 3).alias("lv_group")).distinct()
_add("w9_temporal_stability", "m", me.temporal_stability, "+z AS (SELECT *, lag(snapshot) OVER (PARTITION BY cluster_id ORDER BY snapshot) AS was FROM (SELECT cluster_id, snapshot, count(*) AS n FROM m GROUP BY ALL)), q AS (SELECT z.cluster_id, z.snapshot, z.n, (SELECT count(*) FROM m x WHERE x.cluster_id = z.cluster_id AND x.snapshot = z.was) AS k, (SELECT count(*) FROM m x JOIN m y USING (building_id, cluster_id) WHERE x.cluster_id = z.cluster_id AND x.snapshot = z.snapshot AND y.snapshot = z.was) AS i FROM z WHERE was IS NOT NULL) SELECT cluster_id, r(avg(i / (n + k - i))) AS stability, count(*) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY snapshot DESC) AS b FROM q) WHERE b <= 10 GROUP BY 1")
_add("w10_cluster_matching", "m", lambda m: me.cluster_matching(*me.first_and_last(m)), f"{_LAST}, j AS (SELECT old_id, new_id, shared / (so.n + sw.n - shared) AS j FROM ov JOIN so ON so.c = old_id JOIN sw ON sw.c = new_id), k AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY j DESC, new_id) AS a, row_number() OVER (PARTITION BY new_id ORDER BY j DESC, old_id) AS b FROM j) SELECT old_id, new_id, r(j) AS jaccard, j > 0.7 AS same FROM k WHERE a = 1 AND b = 1")
_add("x34_cluster_transition", "m", lambda m: me.cluster_transition(*me.first_and_last(m)), f"{_LAST} SELECT r(sum(shared) FILTER (WHERE old_id = new_id) / sum(shared)) AS stability, coalesce(sum(shared) FILTER (WHERE old_id <> new_id), 0)::bigint AS changed, (SELECT count(*) FROM (SELECT old_id FROM ov JOIN so ON so.c = old_id GROUP BY old_id, n HAVING max(shared) < 0.5 * n)) AS split, (SELECT count(*) FROM so WHERE c NOT IN (SELECT c FROM sw)) AS vanished FROM ov")
_add("x13_split_by_group", "m", lambda m: me.split_by_group(me.first_and_last(m)[1], _HOME(m)), f"{_LAST} SELECT * FROM (SELECT building_id, c AS cluster_id, building_id % 3 AS lv_group, count(*) OVER (PARTITION BY c, building_id % 3) AS n FROM w) WHERE n >= 3")
_add("r78_cluster_structure", "m", lambda m: me.cluster_structure(me.first_and_last(m)[1], _HOME(m)), f"{_LAST}, g AS (SELECT c, count(*) AS n, count(DISTINCT building_id % 3) AS lv FROM w GROUP BY c) SELECT count(*) AS clusters, sum(n)::bigint AS buildings, r(avg(n)) AS mean_size, r(stddev_pop(n)) AS size_std, r({SH('n BETWEEN 3 AND 20')}) AS valid_share, r({SH('n = 1')}) AS single_share, r({SH('lv <= 1')}) AS lv_compliance FROM g")

_COST = lambda b: b.select("lv_group", "building_id", F.col("peak_kw").alias("score"), F.col("area").alias("cost"))
_add("w17_budgeted_selection", "b", lambda b: pl.budgeted_selection(_COST(b), 500.0), "RECURSIVE+k AS (SELECT lv_group, building_id, area, row_number() OVER (PARTITION BY lv_group ORDER BY peak_kw DESC, building_id) AS n FROM b), t AS (SELECT lv_group, n, building_id, area <= 550 AS took, CASE WHEN area <= 550 THEN area ELSE 0.0 END AS spent FROM k WHERE n = 1 UNION ALL SELECT k.lv_group, k.n, k.building_id, t.spent < 450 AND t.spent + area <= 550, CASE WHEN t.spent < 450 AND t.spent + area <= 550 THEN t.spent + area ELSE t.spent END FROM t JOIN k ON k.lv_group = t.lv_group AND k.n = t.n + 1) SELECT lv_group, building_id, (row_number() OVER (PARTITION BY lv_group ORDER BY n) - 1)::int AS rank FROM t WHERE took")
_add("w16_cumulative_plan", "b", pl.cumulative_plan, "SELECT mv_station, year, added, total::bigint AS total, r(total / n) AS penetration FROM (SELECT *, sum(added) OVER (PARTITION BY mv_station ORDER BY year) AS total, sum(k) OVER (PARTITION BY mv_station) AS n FROM (SELECT mv_station, build_year AS year, count_if(has_solar)::bigint AS added, count(*) AS k FROM b GROUP BY ALL))")
_add("w20_rank_agreement", "b", lambda b: pl.rank_agreement(b, "peak_kw", "distance_m", "lv_group"), "SELECT lv_group, count(*) AS n, r(corr(x, y)) AS spearman, count_if(y < last)::bigint AS inversions FROM (SELECT *, lag(y) OVER (PARTITION BY lv_group ORDER BY x) AS last FROM (SELECT lv_group, row_number() OVER (PARTITION BY lv_group ORDER BY peak_kw DESC, building_id) AS x, row_number() OVER (PARTITION BY lv_group ORDER BY distance_m DESC, building_id) AS y FROM b)) GROUP BY lv_group HAVING count(*) > 1")
_add("r65_progress", "b", lambda b: pl.progress(b, 0.3, 0.5), "SELECT mv_station, r(a) AS achieved, r(100 * a / 0.3) AS complete_pct, a >= 0.9 * 0.3 * 0.5 AS on_track, r(a / 0.5) AS projected FROM (SELECT mv_station, avg(CASE WHEN has_solar THEN 1.0::double ELSE 0.0 END) AS a FROM b GROUP BY 1)")
_add("r75_violation_rates", "b", lambda b: pl.violation_rates(b, 200.0), f"SELECT count(*) AS groups, r({SH('p > 180')}) AS overload, r({SH('n NOT BETWEEN 3 AND 20')}) AS size, r({SH('cv > 1')}) AS variability, r(max(p / 180)) AS highest_loading FROM (SELECT sum(peak_kw) AS p, count(*) AS n, stddev_pop(peak_kw) / avg(peak_kw) AS cv FROM b GROUP BY lv_group)")
_add("x37_quick_solar", "b", pl.quick_solar_candidates, f"SELECT building_id, label, roof_flat + roof_sloped AS roof FROM b WHERE {_URGENT} AND NOT has_solar AND roof_flat + roof_sloped > 50 ORDER BY roof DESC, building_id LIMIT 50")
_CAL = "SELECT least(floor(prob * 10), 9)::int AS bin, count(*) AS n, avg(prob) AS c, avg(CASE WHEN hit THEN 1.0::double ELSE 0.0 END) AS a FROM p GROUP BY 1"
_add("r61_calibration_bins", "p", pl.calibration_bins, f"SELECT bin, n, r(c) AS confidence, r(a) AS accuracy, r(abs(c - a)) AS gap FROM ({_CAL})")
_add("r61_calibration_error", "p", pl.expected_calibration_error, f"SELECT r(sum(n * abs(c - a)) / sum(n)) AS ece, sum(n)::bigint AS n FROM ({_CAL})")
_add("r62_ensemble_uncertainty", "p", pl.ensemble_uncertainty, "+q AS (SELECT node_id, run, class, round(sum(prob), 9) AS q FROM p GROUP BY ALL), v AS (SELECT *, q / sum(q) OVER (PARTITION BY node_id, run) AS v, row_number() OVER (PARTITION BY node_id, run ORDER BY q DESC, class) AS k FROM q), n AS (SELECT node_id, count(DISTINCT run) AS runs, -sum(v * ln(v)) / count(DISTINCT run) AS own FROM v GROUP BY 1), c AS (SELECT node_id, class, sum(v) AS s, count_if(k = 1) AS votes FROM v GROUP BY ALL) SELECT node_id, runs, r(-sum(s / runs * ln(s / runs))) AS entropy, r(-sum(s / runs * ln(s / runs)) - own) AS mutual_information, r(1 - max(votes) / runs) AS variation_ratio FROM c JOIN n USING (node_id) GROUP BY node_id, runs, own")

_add("r26_group_profile", "s", lambda s: pr.peak_metrics(s, "lv_group").select("lv_group", "sum_peaks", "peak", "diversity_factor"), f"+own AS (SELECT lv_group, building_id, max(d) AS p FROM (SELECT lv_group, building_id, date_trunc('hour', ts) AS slot, sum(demand) AS d FROM s GROUP BY ALL) GROUP BY ALL), per AS (SELECT lv_group, sum(p) AS sp FROM own GROUP BY 1), tot AS (SELECT lv_group, max(demand) AS pk FROM ({_SLOT.format('lv_group')}) GROUP BY 1) SELECT lv_group, r(sp) AS sum_peaks, r(pk) AS peak, r(sp / pk) AS diversity_factor FROM per JOIN tot USING (lv_group)")
_add("r27_cluster_energy", "s", pr.cluster_energy, "SELECT cluster_id, count(*) AS buildings, r(sum(d)) AS demand, r(sum(g)) AS generation, r(0.8 * sum(e)) AS shareable, r(least(sum(g) / sum(d), 1.0)) AS self_sufficiency FROM (SELECT cluster_id, building_id, avg(demand) AS d, avg(generation) AS g, avg(greatest(generation - demand, 0.0)) AS e FROM s GROUP BY ALL) GROUP BY 1")
_add("r28_energy_intensity", "s b", pr.energy_intensity, "SELECT building_id, r(k) AS kwh, r(p) AS peak, r(area) AS area, r(k / area) AS kwh_per_m2 FROM (SELECT building_id, sum(demand) AS k, max(demand) AS p FROM s GROUP BY 1) LEFT JOIN (SELECT building_id, area FROM b) USING (building_id)")
_add("r46_peak_coincidence", "s", pr.peak_coincidence, f"+h AS (SELECT lv_group, building_id, hour(ts) AS hour, avg(demand) AS m FROM s GROUP BY ALL), p AS (SELECT lv_group, hour, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lv_group, building_id ORDER BY m DESC, hour) AS n FROM h) WHERE n = 1 GROUP BY ALL), l AS (SELECT lv_group, max(demand) / 630 AS l FROM ({_SLOT.format('lv_group')}) GROUP BY 1) SELECT lv_group, r(max(k) / sum(k)) AS coincidence, sum(k)::bigint AS buildings, r(l) AS loading FROM p JOIN l USING (lv_group) GROUP BY lv_group, l")
_add("x31_hourly_self_sufficiency", "s", pr.hourly_self_sufficiency, f"SELECT cluster_id, r(avg(q)) AS mean, r(stddev_pop(q)) AS std, r(min(q)) AS lowest, r(max(q)) AS highest FROM (SELECT cluster_id, hour(slot) AS h, CASE WHEN sum(demand) <> 0 THEN sum(least(demand, generation)) / sum(demand) END AS q FROM ({_SLOT.format('cluster_id')}) GROUP BY ALL) GROUP BY 1")
_add("x35_energy_waterfall", "s", pr.energy_waterfall, "+o AS (SELECT cluster_id, date_trunc('hour', ts) AS slot, building_id, sum(demand) AS d, sum(generation) AS g FROM s GROUP BY ALL), t AS (SELECT *, least(d, g) AS own, greatest(g - d, 0.0) AS spare, greatest(d - g, 0.0) AS lack, sum(greatest(g - d, 0.0)) OVER w AS ts, sum(greatest(d - g, 0.0)) OVER w AS tl FROM o WINDOW w AS (PARTITION BY cluster_id, slot)), x AS (SELECT cluster_id, building_id, sum(own) AS own_use, sum(CASE WHEN ts <> 0 THEN spare * least(ts, tl) / ts ELSE 0 END) AS gi, sum(CASE WHEN tl <> 0 THEN lack * least(ts, tl) / tl ELSE 0 END) AS re, sum(spare) AS sp, sum(lack) AS la FROM t GROUP BY ALL) SELECT cluster_id, building_id, r(own_use) AS own_use, r(gi) AS given, r(re) AS received, r(sp - gi) AS exported, r(la - re) AS imported FROM x")
_add("w19_fixed_profile", "s", lambda s: pr.fixed_profile(s).select("building_id", "n_own", F.size("profile").alias("n"), F.col("profile")[0].alias("first"), F.col("profile")[95].alias("last"), F.aggregate("profile", F.lit(0.0), lambda a, x: a + x).alias("total")), "+f AS (SELECT * FROM (SELECT building_id, demand, row_number() OVER (PARTITION BY building_id ORDER BY ts, event_id) AS i FROM s) WHERE i <= 96) SELECT building_id, count(*)::int AS n_own, 96::int AS n, r(arg_min(demand, i)) AS first, r(CASE WHEN count(*) = 96 THEN arg_max(demand, i) ELSE avg(demand) END) AS last, r(avg(demand) * 96) AS total FROM f GROUP BY 1")

_add("gr13_hop_metrics", "e", lambda e: gr.hop_metrics(gr.hop_distance(e, e.agg(F.min("src").alias("node")), 2)), _BOTH + ", z AS (SELECT min(src) AS node FROM e), h1 AS (SELECT DISTINCT dst AS node FROM u JOIN z ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM u JOIN h1 ON src = node WHERE dst NOT IN (SELECT node FROM h1) AND dst NOT IN (SELECT node FROM z)), k AS (SELECT 1 AS hop, count(*) AS nodes FROM h1 UNION ALL SELECT 2, count(*) FROM h2) SELECT hop::int AS hop, nodes, r(nodes / sum(nodes) OVER ()) AS share FROM k WHERE nodes > 0")
_add("gr17_normalised_cut", "e", lambda e: gr.normalised_cut(e, _CL(e)), _BOTH + "SELECT src % 10 AS cluster_id, r(sum(CASE WHEN src % 10 <> dst % 10 THEN weight ELSE 0 END)) AS cut, r(sum(weight)) AS volume, r(sum(CASE WHEN src % 10 <> dst % 10 THEN weight ELSE 0 END) / sum(weight)) AS normalised FROM u GROUP BY 1")
_SEED = lambda e: e.where("src % 3 = 0").select(F.col("src").alias("node"), (F.col("src") % 5).alias("label")).distinct()
_add("gr15_label_propagation", "e", lambda e: gr.label_propagation(e, _SEED(e), 2), _BOTH + ", z AS (SELECT DISTINCT src AS node, src % 5 AS label FROM e WHERE src % 3 = 0), v1 AS (SELECT dst AS node, label, round(sum(weight), 6) AS w FROM u JOIN z ON src = node WHERE dst NOT IN (SELECT node FROM z) GROUP BY ALL), k1 AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, label) AS n FROM v1) WHERE n = 1 UNION ALL SELECT node, label FROM z), v2 AS (SELECT dst AS node, label, round(sum(weight), 6) AS w FROM u JOIN k1 ON src = node WHERE dst NOT IN (SELECT node FROM z) GROUP BY ALL) SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, label) AS n FROM v2) WHERE n = 1 UNION ALL SELECT node, label FROM z")
_add("e2_battery_economics", "b", lambda b: b.select("building_id", *fb.battery_economics(F.col("area") / 10, 0.5 + F.col("building_id") % 4, F.col("peak_kw") / 5, F.col("area") / 100)), "SELECT building_id, r(i) AS investment, r(l) AS lifetime, r(y) AS benefit, r(i / y) AS payback, r(y * (1 - pow(1.05, -floor(l))) / 0.05 - i) AS npv FROM (SELECT building_id, area / 10 * 500 AS i, least(5000.0 / ((0.5 + building_id % 4)::double * 365), 10.0) AS l, peak_kw / 5 * 50 * 12 + area / 100 * 365 AS y FROM b)")
_add("e3_community_benefits", "b", lambda b: b.groupBy("lv_group").agg(F.count("*").alias("n"), F.sum("area").alias("a"), F.avg("peak_kw").alias("k")).select("lv_group", *fb.community_benefits(F.col("n"), F.col("a"), F.lit(0.2), F.col("k") * 100)), "+g AS (SELECT lv_group, count(*) AS n, sum(area) AS a, count(*) * (avg(peak_kw) * 100) AS t FROM b GROUP BY 1), y AS (SELECT *, a * 0.17 AS s, t / 8760 * 3 * 0.2 * 50 * 12 AS p, a * 0.25 * 0.1 + t * 0.02 * 0.25 AS rest FROM g) SELECT lv_group, r(s) AS sharing, r(p) AS peak, r(s + p + rest) AS total, r((s + p + rest) / n) AS per_building FROM y")
