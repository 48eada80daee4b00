"""Registered queries of the hierarchy reports, geometry, adjacency, assessments, roadmaps and communities, with their SQL.

The SQL is written from the rules themselves, not from the operators: distinct counts over the repeated rows, plain
distances for every pair, unrolled steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import building as fb
from ..functions import scores as sc
from ..operators import adjacency as ad
from ..operators import assessment as asm
from ..operators import communities as co
from ..operators import connections as cn
from ..operators import flows as fl
from ..operators import geometry as ge
from ..operators import graphs as gr
from ..operators import profiles as pr
from ..operators import reports as re_
from ..operators import roadmap as rm
from ..operators import topology as tp
from .registry import _BOTH, _CL, _NET, _PC, _PV, _SLOT, SH, _add

# ---- hierarchy reports
_B = "count(DISTINCT CASE WHEN {} THEN building_id END)".format
_C = "count(CASE WHEN {} THEN 1 END)".format
_RES, _NON = "function = 'residential'", "function = 'non_residential'"
_KINDS = ("ENDED", "ENTERED", "CROSSED", "BY_DISTANCE", "TOO_FAR")
_AGES = ("< 1945", "1945-1975", "1975-1990", "1990-2005", "2005-2015", "> 2015")
_POOR, _OLD = "label IN ('D', 'E', 'F', 'G')", "age_range IN ('< 1945', '1945-1975')"
_LAB = "CASE WHEN label LIKE 'A%' THEN 'A' ELSE label END"
_slash = " || '/' || ".join
_CONN = ", ".join(f"{_C(f"connection_type = '{k}'")} AS {k.lower()}" for k in _KINDS)
_COUNTS = f"count(DISTINCT building_id) AS buildings, {_B(_RES)} AS residential, {_B(_NON)} AS non_residential, {_B('is_mv_capable')} AS mv_capable, {_B('is_problematic')} AS problematic"
_add("r9_station_report", "h", re_.station_summary, f"SELECT *, residential || '/' || non_residential AS res_nonres, r(100.0 * residential / buildings) AS res_pct FROM (SELECT mv_station, count(DISTINCT mv_group) AS mv_groups, count(DISTINCT lv_group) AS lv_groups, {_COUNTS}, {', '.join(f"{_B(f"building_type = '{t}'")} AS {t}" for t in ('vrijstaand', 'twee_onder_1_kap', 'rijtjeswoning', 'appartement'))}, {_CONN}, {_slash(_C(f"age_range = '{a}'") for a in _AGES)} AS ages, r(sum(area)) AS total_area, r(avg(area)) AS avg_area, r(avg(distance_m)) AS avg_distance, {_slash([_C("label LIKE 'A%'"), _C("label = 'B'"), _C("label = 'C'"), _C(_POOR)])} AS labels FROM h GROUP BY mv_station ORDER BY buildings DESC, mv_station LIMIT 20)")
_MODE = lambda c: f"(SELECT {c} FROM h x WHERE x.mv_station = t.mv_station AND x.lv_group = t.lv_group AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS main_{c}"
_add("r10_group_report", "h", re_.group_summary, f"SELECT *, {', '.join(map(_MODE, ('age_range', 'label', 'building_type', 'district')))} FROM (SELECT mv_station, lv_group, {_COUNTS}, {_slash(_C(f"connection_type = '{k}'") for k in _KINDS)} AS connections, r(sum(area)) AS total_area, r(avg(area)) AS avg_area, r(avg(distance_m)) AS avg_distance, max(distance_m) AS max_distance FROM h GROUP BY mv_station, lv_group ORDER BY buildings DESC, mv_station, lv_group LIMIT 30) t")
_add("r11_station_groups", "h", re_.station_breakdown, f"+top AS (SELECT mv_station FROM h GROUP BY 1 ORDER BY count(DISTINCT building_id) DESC, mv_station LIMIT 10), u AS (SELECT DISTINCT * EXCLUDE (mv_group) FROM h) SELECT mv_station, lv_group, count(DISTINCT building_id) AS buildings, {_C(_RES)} AS residential, {_C(_NON)} AS non_residential, {_C('is_mv_capable')} AS mv_capable, {_C('is_problematic')} AS problematic, r(avg(area)) AS avg_area, r(avg(distance_m)) AS avg_distance, string_agg(DISTINCT connection_type, ', ' ORDER BY connection_type) AS connections, (SELECT age_range FROM u x WHERE x.lv_group = h.lv_group AND x.mv_station = h.mv_station GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS main_age, (SELECT building_type FROM u x WHERE x.lv_group = h.lv_group AND x.mv_station = h.mv_station GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS main_type FROM h WHERE mv_station IN (SELECT mv_station FROM top) GROUP BY mv_station, lv_group")
_add("r12_grid_rollup", "h", re_.station_rollup, f"SELECT CASE WHEN grouping(mv_station) = 1 THEN 'TOTAL GRID' ELSE 'MV Station ' || mv_station END AS level, count(DISTINCT lv_group) AS lv_groups, {_COUNTS}, r(avg(area)) AS avg_area, r(avg(distance_m)) AS avg_distance FROM h GROUP BY ROLLUP (mv_station)")
_add("r13_level_rollup", "h", re_.level_rollup, f"SELECT mv_station, lv_group, district, grouping(mv_station, lv_group, district) AS depth, count(DISTINCT building_id) AS buildings, {_B(_RES)} AS residential, {_B(_NON)} AS non_residential, {_C(_POOR)} AS poor_labels, r(avg(distance_m)) AS avg_distance, CASE grouping(mv_station, lv_group, district) WHEN 7 THEN 'TOTAL GRID' WHEN 3 THEN 'MV ' || mv_station WHEN 1 THEN '  LV ' || lv_group ELSE '    ' || district END AS level FROM h GROUP BY ROLLUP (mv_station, lv_group, district)")
_add("r14_comparison_matrix", "h", re_.station_comparison, f"SELECT mv_station, count(DISTINCT lv_group) AS lv_groups, count(DISTINCT building_id) AS buildings, r(100.0 * {_B(_RES)} / count(DISTINCT building_id)) AS res_pct, r(100.0 * {_B('is_mv_capable')} / count(DISTINCT building_id)) AS mv_pct, r(100.0 * {_B('is_problematic')} / count(DISTINCT building_id)) AS problem_pct, r(100.0 * {_C("connection_type IN ('ENDED', 'ENTERED', 'CROSSED')")} / count(*)) AS direct_pct, r(100.0 * {_C(_OLD)} / count(*)) AS old_pct, r(100.0 * {_C("label LIKE 'A%' OR label IN ('B', 'C')")} / count(*)) AS efficient_pct FROM h GROUP BY mv_station HAVING count(DISTINCT building_id) > 50")
_add("r15_groups_of_stations", "h", re_.groups_of_stations, f"+l AS (SELECT mv_station, lv_group, count(DISTINCT building_id) AS buildings, {_C(_RES)} AS residential, {_C(_NON)} AS non_residential, {_C('is_mv_capable')} AS mv_capable, {_C('is_problematic')} AS problematic, avg(distance_m) AS d FROM h GROUP BY ALL), t AS (SELECT mv_station, count(*) AS station_groups, sum(buildings)::bigint AS station_buildings FROM l GROUP BY 1) SELECT mv_station, lv_group, buildings, residential, non_residential, mv_capable, problematic, r(d) AS avg_distance, station_groups, station_buildings, r(100.0 * buildings / station_buildings) AS pct FROM l JOIN t USING (mv_station) WHERE station_buildings > 100")
_PCT = f"100.0 * {_B(_RES)} / count(DISTINCT building_id) AS x, 100.0 * {_B('is_mv_capable')} / count(DISTINCT building_id) AS m, 100.0 * {_B('is_problematic')} / count(DISTINCT building_id) AS p"
_add("r16_hierarchy_levels", "h", re_.level_summary, f"SELECT 'Per MV Station' AS level, count(*) AS units, r(avg(lv)) AS avg_lv_groups, r(avg(k)) AS avg_buildings, r(avg(x)) AS avg_res_pct, r(avg(m)) AS avg_mv_pct, r(avg(p)) AS avg_problem_pct FROM (SELECT mv_station, count(DISTINCT lv_group) AS lv, count(DISTINCT building_id) AS k, {_PCT} FROM h GROUP BY 1) UNION ALL SELECT 'Per LV Group', count(*), NULL, r(avg(k)), r(avg(x)), r(avg(m)), r(avg(p)) FROM (SELECT lv_group, count(DISTINCT building_id) AS k, {_PCT} FROM h GROUP BY 1)")
_add("r17_grid_overview", "h", re_.grid_totals, f"SELECT count(DISTINCT mv_station) AS stations, count(DISTINCT mv_group) AS mv_groups, count(DISTINCT lv_group) AS lv_groups, r(avg(distance_m)) AS avg_distance, {_COUNTS} FROM h")
_KIND = lambda *names: _B(f"building_type IN ({', '.join(f"'{n}'" for n in names)})")
_DM = f"""+dm0 AS (SELECT mv_station, district, count(DISTINCT lv_group) AS lv_groups, count(DISTINCT building_id) AS buildings, sum(area) AS total_area, count(DISTINCT function) AS function_types, count(DISTINCT building_type) AS types, {_B(_RES)} AS residential, {_B(_NON)} AS non_residential, {_KIND('Office', 'office', 'Kantoor')} AS offices, {_KIND('Retail', 'retail', 'Winkel')} AS retail, {_KIND('Education', 'education', 'School')} AS schools, {_KIND('Industrial', 'industrial')} AS industrial, round(stddev_samp(area), 0) AS area_std, {_C('area < 100')} AS small, {_C('area > 1000')} AS large, count(DISTINCT age_range) AS age_ranges, {_C(_OLD)} AS old, {_C("age_range IN ('2005-2015', '> 2015')")} AS "new", {_C(_POOR)} AS poor_labels, round(100.0 * {_C(_POOR)} / count(*), 1) AS poor_pct, {_C('is_mv_capable')} AS mv_capable, avg(distance_m) AS avg_distance, {_C('is_problematic')} AS problematic FROM h WHERE district IS NOT NULL GROUP BY mv_station, district), dm1 AS (SELECT *, least(10.0, types * 1.5)::double AS type_score, CASE WHEN area_std > 500 THEN 10 WHEN area_std > 300 THEN 8 WHEN area_std > 150 THEN 6 ELSE 3 END AS size_score, CASE WHEN residential > 0 AND non_residential > 0 AND abs(residential - non_residential) < buildings * 0.5 THEN 10 WHEN residential > 0 AND non_residential > 0 THEN 6 ELSE 2 END AS mix_score, CASE WHEN offices > 0 AND residential > 5 THEN 10 WHEN retail > 0 AND residential > 5 THEN 9 WHEN schools > 0 AND residential > 5 THEN 8 WHEN age_ranges >= 4 THEN 6 ELSE 3 END AS temporal_score, CASE WHEN poor_pct > 70 THEN 10 WHEN poor_pct > 50 THEN 8 WHEN poor_pct > 30 THEN 6 ELSE 3 END AS energy_need, CASE WHEN old > buildings * 0.6 THEN 10 WHEN old > buildings * 0.4 THEN 7 WHEN old > buildings * 0.25 THEN 5 ELSE 2 END AS age_need, CASE WHEN offices > 0 AND residential > 5 THEN 'Office+Res' WHEN retail > 0 AND residential > 5 THEN 'Retail+Res' WHEN schools > 0 AND residential > 5 THEN 'Edu+Res' WHEN age_ranges >= 4 THEN 'Age Mix' ELSE 'Basic' END AS pattern FROM dm0), dm AS (SELECT *, type_score + size_score + mix_score + temporal_score AS ec_score, energy_need + age_need AS int_score FROM dm1) """
_add("r18_district_metrics", "h", re_.district_metrics, _DM + "SELECT * REPLACE (r(total_area) AS total_area, r(area_std) AS area_std, r(poor_pct) AS poor_pct, r(avg_distance) AS avg_distance) FROM dm")
_GD = f"+gd AS (SELECT *, (types * 2 + CASE WHEN residential > 0 AND non_residential > 0 THEN 5 ELSE 0 END + age_ranges) / 2.0 AS diversity, poor_pct / 10 + old * 10.0 / nullif(buildings, 1) AS need FROM (SELECT mv_station, lv_group, district, count(DISTINCT building_id) AS buildings, count(DISTINCT building_type) AS types, {_B(_RES)} AS residential, {_B(_NON)} AS non_residential, count(DISTINCT age_range) AS age_ranges, {_C(_OLD)} AS old, {_C(_POOR)} AS poor_labels, {_C('is_mv_capable')} AS mv_capable, round(100.0 * {_C(_POOR)} / count(*), 1) AS poor_pct FROM h WHERE district IS NOT NULL GROUP BY ALL)) SELECT * REPLACE (r(poor_pct) AS poor_pct, r(diversity) AS diversity, r(need) AS need) FROM gd"
_add("r19_group_district_metrics", "h", re_.group_district_metrics, _GD)
_add("r20_station_scores", "h", lambda h: re_.station_scores(re_.district_metrics(h)), _DM + "SELECT mv_station, count(*) AS districts, sum(buildings)::bigint AS buildings, max(ec_score) AS best_ec, max(int_score) AS max_need, r(avg(ec_score)) AS avg_ec, r(avg(int_score)) AS avg_need, left(string_agg(district, ', ' ORDER BY district), 50) || CASE WHEN length(string_agg(district, ', ' ORDER BY district)) > 50 THEN '...' ELSE '' END AS served FROM dm GROUP BY 1 ORDER BY sum(buildings) DESC, mv_station LIMIT 15")
_BEST = "SELECT mv_station, district, buildings, lv_groups, {0}, types, mv_capable, pattern, poor_labels, old FROM dm WHERE buildings >= 20 ORDER BY {0} DESC, mv_station, district LIMIT 20"
_add("r21_best_communities", "h", lambda h: re_.best_districts(re_.district_metrics(h)), _DM + _BEST.format("ec_score"))
_add("r21_most_needy", "h", lambda h: re_.best_districts(re_.district_metrics(h), "int_score"), _DM + _BEST.format("int_score"))
_add("r21_diverse_groups", "h", lambda h: re_.diverse_groups(re_.group_district_metrics(h), 2), _GD + " WHERE buildings >= 2 ORDER BY diversity DESC, lv_group, mv_station, district LIMIT 30")
_add("r22_opportunities", "h", lambda h: re_.opportunity_stations(re_.district_metrics(h)), _DM + "SELECT *, CASE WHEN \"both\" > 0 THEN 'EXCELLENT' WHEN high_ec > 0 AND high_need > 0 THEN 'VERY GOOD' WHEN high_ec > 0 OR high_need > 0 THEN 'GOOD' ELSE 'MODERATE' END AS opportunity FROM (SELECT mv_station, count(*) AS districts, count_if(ec_score >= 25)::bigint AS high_ec, count_if(int_score >= 12)::bigint AS high_need, count_if(ec_score >= 25 AND int_score >= 12)::bigint AS \"both\", sum(buildings)::bigint AS buildings, r(avg(ec_score)) AS avg_ec, r(avg(int_score)) AS avg_need FROM dm GROUP BY 1) WHERE buildings >= 50")
_add("r23_shared_districts", "h", lambda h: re_.split_districts(re_.district_metrics(h)), _DM + "SELECT district, count(*) AS stations, sum(buildings)::bigint AS buildings, r(avg(ec_score)) AS avg_ec, r(avg(int_score)) AS avg_need, r(stddev_samp(ec_score)) AS ec_std FROM dm GROUP BY 1 HAVING count(*) > 1")
_add("r6_connection_classes", "c", re_.connection_types, f"SELECT connection_type, count(*) AS buildings, r(avg(distance_m)) AS avg_distance, max(distance_m) AS max_distance, {_C('is_mv_capable')} AS mv_capable, {_C('is_problematic')} AS problematic, r(100.0 * count(*) / (SELECT count(*) FROM c)) AS pct FROM c GROUP BY 1")
_add("r8_mv_matrix", "c", re_.capability_matrix, "SELECT count_if(is_mv_capable AND has_mv_nearby)::bigint AS capable_near, count_if(is_mv_capable AND NOT has_mv_nearby)::bigint AS capable_far, count_if(NOT is_mv_capable AND has_mv_nearby)::bigint AS other_near, count_if(NOT is_mv_capable AND NOT has_mv_nearby)::bigint AS other_far FROM c")

# ---- geometry, segments, connections
_p = lambda x, y: ge.point(F.col(x), F.col(y))


def _lines(sg: DataFrame) -> DataFrame:
    return sg.select("segment_id", "voltage_level", "group_id", (F.col("segment_id") % 7).alias("original_fid"), F.array(_p("x0", "y0"), _p("x1", "y1"), _p("x2", "y2")).alias("geom"))


def _prints(fp: DataFrame) -> DataFrame:
    c = lambda sx, sy: ge.point(F.col("cx") + sx * F.col("half"), F.col("cy") + sy * F.col("half"))
    return fp.select("building_id", "lv_group", (4 * F.col("half") * F.col("half")).alias("area"), F.when(F.col("non_residential"), "non_residential").otherwise("residential").alias("function"), F.array(c(-1, -1), c(1, -1), c(1, 1), c(-1, 1)).alias("geom"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def _len(a: str, b: str) -> str:
    return f"sqrt(pow(x{b} - x{a}, 2) + pow(y{b} - y{a}, 2))"


def _t(px: str, py: str, a: str, b: str) -> str:
    return f"least(greatest((({px} - x{a}) * (x{b} - x{a}) + ({py} - y{a}) * (y{b} - y{a})) / (pow(x{b} - x{a}, 2) + pow(y{b} - y{a}, 2)), 0), 1)"


def _far(px: str, py: str, a: str, b: str) -> str:
    t = _t(px, py, a, b)
    return f"sqrt(pow(x{a} + {t} * (x{b} - x{a}) - {px}, 2) + pow(y{a} + {t} * (y{b} - y{a}) - {py}, 2))"


_L01, _L12 = _len("0", "1"), _len("1", "2")
_add("g3_lengths", "sg", lambda s: _lines(s).select("segment_id", ge.length(F.col("geom")).alias("length_m"), ge.start_point(F.col("geom"))["x"].alias("sx"), ge.end_point(F.col("geom"))["y"].alias("ey")), f"SELECT segment_id, r({_L01} + {_L12}) AS length_m, r(x0) AS sx, r(y2) AS ey FROM sg")
_add("g8_centres", "sg", lambda s: _lines(s).select("segment_id", ge.centroid(F.col("geom"))["x"].alias("cx"), ge.centroid(F.col("geom"))["y"].alias("cy"), ge.envelope(F.col("geom"))["ymin"].alias("ymin"), ge.envelope(F.col("geom"))["xmax"].alias("xmax")), f"SELECT segment_id, r(({_L01} * (x0 + x1) / 2 + {_L12} * (x1 + x2) / 2) / ({_L01} + {_L12})) AS cx, r(({_L01} * (y0 + y1) / 2 + {_L12} * (y1 + y2) / 2) / ({_L01} + {_L12})) AS cy, r(least(y0, y1, y2)) AS ymin, r(greatest(x0, x1, x2)) AS xmax FROM sg")
_BOX = (20.0, 10.0, 60.0, 60.0)


def _clipped(a: str, b: str) -> str:
    """Length of the part of a segment inside _BOX."""
    lo = f"greatest(0, least(({_BOX[0]} - x{a}) / (x{b} - x{a}), ({_BOX[2]} - x{a}) / (x{b} - x{a})), least(({_BOX[1]} - y{a}) / (y{b} - y{a}), ({_BOX[3]} - y{a}) / (y{b} - y{a})))"
    hi = f"least(1, greatest(({_BOX[0]} - x{a}) / (x{b} - x{a}), ({_BOX[2]} - x{a}) / (x{b} - x{a})), greatest(({_BOX[1]} - y{a}) / (y{b} - y{a}), ({_BOX[3]} - y{a}) / (y{b} - y{a})))"
    return f"greatest({hi} - {lo}, 0) * {_len(a, b)}"


_add("g9_clip_lines", "sg", lambda s: ge.clip(_lines(s), _BOX).select("segment_id", F.aggregate("geom", F.lit(0.0), lambda t, x: t + ge.planar(x["a"], x["b"])).alias("length_m")), f"SELECT segment_id, r(l) AS length_m FROM (SELECT segment_id, {_clipped('0', '1')} + {_clipped('1', '2')} AS l FROM sg) WHERE l > 0")
_add("u1_endpoints", "sg", lambda s: tp.endpoints(_lines(s)), "SELECT segment_id, voltage_level, 'START' AS point_type, r(x0) AS x, r(y0) AS y FROM sg UNION ALL SELECT segment_id, voltage_level, 'END', r(x2), r(y2) FROM sg")
_SGRP = f"+g AS (SELECT group_id, voltage_level, count(*) AS segments, sum({_L01} + {_L12}) AS l, count(DISTINCT segment_id % 7) AS cables, min(least(x0, x1, x2)) AS xmin, min(least(y0, y1, y2)) AS ymin, max(greatest(x0, x1, x2)) AS xmax, max(greatest(y0, y1, y2)) AS ymax, sum({_L01} * (x0 + x1) / 2 + {_L12} * (x1 + x2) / 2) AS sx, sum({_L01} * (y0 + y1) / 2 + {_L12} * (y1 + y2) / 2) AS sy FROM sg GROUP BY ALL) "
_add("r1_segment_groups", "sg", lambda s: tp.segment_groups(_lines(s)), _SGRP + "SELECT group_id, voltage_level, segments, r(l) AS length_m, cables, r(xmin) AS xmin, r(ymin) AS ymin, r(xmax) AS xmax, r(ymax) AS ymax, r(sx / l) AS cx, r(sy / l) AS cy FROM g")
_add("r2_voltage_summary", "sg", lambda s: tp.voltage_summary(tp.segment_groups(_lines(s))), _SGRP + "SELECT voltage_level, count(DISTINCT group_id) AS groups, sum(segments)::bigint AS segments, r(avg(l)) AS avg_length, r(sum(l)) AS length_m FROM g GROUP BY 1")
_add("k1_longest_groups", "sg", lambda s: tp.longest_groups(tp.segment_groups(_lines(s))), _SGRP + "SELECT group_id, voltage_level, segments, r(l) AS length_m FROM g ORDER BY l DESC, group_id, voltage_level LIMIT 5")
_add("w1_segment_order", "sg", lambda s: tp.segment_order(_lines(s)), "SELECT segment_id, group_id, voltage_level, (row_number() OVER (PARTITION BY group_id, voltage_level ORDER BY segment_id))::int AS position FROM sg")
_NEAR = f"""SELECT * FROM (SELECT fp.*, sg.segment_id, sg.voltage_level, sg.group_id, sg.x0, sg.y0, sg.x1, sg.y1, sg.x2, sg.y2, least({_far('cx', 'cy', '0', '1')}, {_far('cx', 'cy', '1', '2')}) AS d FROM fp JOIN sg ON cx BETWEEN x0 - 10 AND x2 + 10 AND cy BETWEEN y0 - 10 AND y0 + 10) WHERE d <= """


def _inside(a: str, b: str) -> str:
    lo = f"greatest(0, least((cx - half - x{a}) / (x{b} - x{a}), (cx + half - x{a}) / (x{b} - x{a})), least((cy - half - y{a}) / (y{b} - y{a}), (cy + half - y{a}) / (y{b} - y{a})))"
    hi = f"least(1, greatest((cx - half - x{a}) / (x{b} - x{a}), (cx + half - x{a}) / (x{b} - x{a})), greatest((cy - half - y{a}) / (y{b} - y{a}), (cy + half - y{a}) / (y{b} - y{a})))"
    return f"({lo} < {hi})"


_CONNS = f"""+lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY d, segment_id) AS n FROM ({_NEAR} 5.0) WHERE voltage_level = 'LV') WHERE n = 1), mv AS (SELECT building_id, segment_id AS ms, d AS md FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY d, segment_id) AS n FROM ({_NEAR} 3.0) WHERE voltage_level = 'MV') WHERE n = 1), k AS (SELECT lv.*, ms, md, 4 * half * half AS area, non_residential AND 4 * half * half > 10 AS cap, CASE WHEN (abs(x0 - cx) < half AND abs(y0 - cy) < half) OR (abs(x2 - cx) < half AND abs(y2 - cy) < half) THEN 'ENDED' WHEN {_inside('0', '1')} OR {_inside('1', '2')} THEN 'CROSSED' WHEN d > 4 THEN 'TOO_FAR' ELSE 'BY_DISTANCE' END AS kind FROM lv LEFT JOIN mv ON mv.building_id = lv.building_id AND non_residential AND 4 * half * half > 10) """
_CON = lambda fp, sg: cn.building_connections(_prints(fp), _lines(sg), 5.0, 3.0, 10.0, 4.0)
_add("j8_building_segments", "fp sg", lambda fp, sg: _CON(fp, sg).select("building_id", "segment_id", "group_id", "distance_m", "connection_type"), _CONNS + "SELECT building_id, segment_id, group_id, r(d) AS distance_m, kind AS connection_type FROM k")
_add("j9_building_mv", "fp sg", lambda fp, sg: _CON(fp, sg).where("has_mv_nearby").select("building_id", "nearest_mv_segment_id", "nearest_mv_distance_m"), _CONNS + "SELECT building_id, ms AS nearest_mv_segment_id, r(md) AS nearest_mv_distance_m FROM k WHERE ms IS NOT NULL")
_add("j10_building_connections", "fp sg", lambda fp, sg: _CON(fp, sg).drop("x", "y"), _CONNS + "SELECT building_id, r(area) AS area, CASE WHEN non_residential THEN 'non_residential' ELSE 'residential' END AS function, segment_id, group_id, r(d) AS distance_m, kind AS connection_type, cap AS is_mv_capable, ms IS NOT NULL AS has_mv_nearby, ms AS nearest_mv_segment_id, r(md) AS nearest_mv_distance_m, kind = 'TOO_FAR' AS is_problematic, CASE WHEN kind = 'ENDED' THEN 'Cable endpoint in building' WHEN kind = 'CROSSED' THEN 'Cable crosses through building' WHEN kind = 'TOO_FAR' THEN 'WARNING: Distance > 4m (' || round(d)::bigint || 'm)' WHEN cap AND ms IS NOT NULL THEN 'LV connection (MV-capable, MV available at ' || round(md)::bigint || 'm)' WHEN cap THEN 'LV connection (MV-capable, no MV nearby)' WHEN NOT non_residential THEN 'Residential - Standard LV' ELSE 'Standard LV connection at ' || round(d)::bigint || 'm' END AS reason FROM k")
_T0, _T1 = _t("cx", "cy", "0", "1"), _t("cx", "cy", "1", "2")
_add("j11_connection_points", "fp sg", lambda fp, sg: cn.connection_points(_CON(fp, sg), _lines(sg)), _CONNS + f"SELECT building_id, segment_id, r(CASE WHEN one THEN x0 + t * (x1 - x0) ELSE x1 + t * (x2 - x1) END) AS px, r(CASE WHEN one THEN y0 + t * (y1 - y0) ELSE y1 + t * (y2 - y1) END) AS py, r(CASE WHEN one THEN t * l ELSE l + t * m END) AS along_m, r(CASE WHEN one THEN t * l ELSE l + t * m END / (l + m)) AS fraction, kind IN ('ENDED', 'ENTERED', 'CROSSED') AS is_direct FROM (SELECT *, CASE WHEN one THEN {_T0} ELSE {_T1} END AS t FROM (SELECT *, {_far('cx', 'cy', '0', '1')} <= {_far('cx', 'cy', '1', '2')} AS one, {_L01} AS l, {_L12} AS m FROM k))")
_STATS = "SELECT sg.segment_id, sg.group_id, sg.voltage_level, count(building_id) AS buildings, coalesce(count_if(NOT non_residential), 0)::bigint AS residential, coalesce(count_if(non_residential), 0)::bigint AS non_residential, coalesce(count_if(cap), 0)::bigint AS mv_capable, coalesce(count_if(kind = 'ENDED'), 0)::bigint AS ended, coalesce(count_if(kind = 'ENTERED'), 0)::bigint AS entered, coalesce(count_if(kind = 'CROSSED'), 0)::bigint AS crossed, coalesce(count_if(kind = 'BY_DISTANCE'), 0)::bigint AS by_distance, coalesce(count_if(kind = 'TOO_FAR'), 0)::bigint AS too_far, r(avg(d)) AS avg_distance, r(max(d)) AS max_distance, r(min(d)) AS min_distance, bool_or(kind = 'TOO_FAR') AS has_problem FROM sg LEFT JOIN k ON k.segment_id = sg.segment_id GROUP BY ALL"
_SEGS = lambda fp, sg: cn.segment_stats(_CON(fp, sg), _lines(sg))
_add("r4_segment_stats", "fp sg", _SEGS, _CONNS + _STATS)
_add("k1_busiest_segments", "fp sg", lambda fp, sg: cn.busiest_segments(_SEGS(fp, sg)), _CONNS + f", st AS ({_STATS}) SELECT segment_id, voltage_level, buildings, too_far FROM st WHERE buildings > 0 ORDER BY buildings DESC, segment_id LIMIT 5")
_add("r5_connection_overview", "fp sg", lambda fp, sg: (lambda k: re_.connection_overview(k, cn.segment_stats(k, _lines(sg))))(_CON(fp, sg)), _CONNS + f", st AS ({_STATS}) SELECT metric, r(value) AS value FROM (SELECT unnest(['total_buildings', 'residential', 'non_residential', 'mv_capable', 'mv_capable_with_mv_nearby', 'ended', 'entered', 'crossed', 'by_distance', 'too_far', 'problematic_connections', 'avg_connection_m', 'max_connection_m', 'segments_with_buildings', 'segments_with_problems']) AS metric, unnest([count(*)::double, count_if(NOT non_residential), count_if(non_residential), count_if(cap), count_if(cap AND ms IS NOT NULL), count_if(kind = 'ENDED'), count_if(kind = 'ENTERED'), count_if(kind = 'CROSSED'), count_if(kind = 'BY_DISTANCE'), count_if(kind = 'TOO_FAR'), count_if(kind = 'TOO_FAR'), avg(d), max(d), (SELECT count(*) FROM st WHERE buildings > 0), (SELECT count(*) FROM st WHERE has_problem)]) AS value FROM k)")

# ---- stations and levels
_PAR = "SELECT child_group_id, '{0}' AS child_voltage, parent_group_id, '{1}' AS parent_voltage, '{2}' AS connection_via, via_station_fid, distance_m, confidence_score FROM (SELECT c.group_id AS child_group_id, p.group_id AS parent_group_id, c.station_fid AS via_station_fid, c.distance_m + p.distance_m AS distance_m, (c.confidence_score + p.confidence_score) / 2 AS confidence_score, row_number() OVER (PARTITION BY c.group_id ORDER BY c.confidence_score + p.confidence_score DESC, c.distance_m + p.distance_m, p.group_id, c.station_fid) AS n FROM gs c JOIN gs p USING (station_fid) WHERE c.station_type = '{2}' AND p.station_type = '{2}' AND c.voltage_level = '{0}' AND p.voltage_level = '{1}') WHERE n = 1"
_LVP, _MVP = _PAR.format("LV", "MV", "TRANSFORMER"), _PAR.format("MV", "HV", "SUBSTATION")
_HIE = f"+lvp AS ({_LVP}), mvp AS (SELECT *, parent_group_id || ' -> ' || child_group_id AS hierarchy_path FROM ({_MVP})), hy AS (SELECT * FROM mvp UNION ALL SELECT lvp.*, coalesce(m.hierarchy_path, lvp.parent_group_id) || ' -> ' || lvp.child_group_id FROM lvp LEFT JOIN mvp m ON m.child_group_id = lvp.parent_group_id), grp AS (SELECT DISTINCT group_id, voltage_level FROM gs) "
_GRP = lambda gs: gs.select("group_id", "voltage_level").distinct()
_add("j12_lv_parents", "gs", lambda gs: tp.via_station_parent(gs, "LV", "MV", "TRANSFORMER"), f"SELECT * REPLACE (r(distance_m) AS distance_m, r(confidence_score) AS confidence_score) FROM ({_LVP})")
_add("j12_group_hierarchy", "gs", tp.group_hierarchy, _HIE + "SELECT * REPLACE (r(distance_m) AS distance_m, r(confidence_score) AS confidence_score) FROM hy")
_add("gr2_hierarchy_tree", "gs", lambda gs: tp.hierarchy_tree(_GRP(gs), tp.group_hierarchy(gs)), "RECURSIVE" + _HIE + ", tree AS (SELECT 0 AS level, voltage_level, group_id, NULL::varchar AS parent_group, group_id AS path FROM grp WHERE voltage_level = 'HV' AND group_id NOT IN (SELECT child_group_id FROM hy) UNION ALL SELECT t.level + 1, h.child_voltage, h.child_group_id, h.parent_group_id, t.path || ' -> ' || h.child_group_id FROM hy h JOIN tree t ON h.parent_group_id = t.group_id) SELECT level::int AS level, voltage_level, group_id, parent_group, path FROM tree")
_add("j16_roots_and_orphans", "gs", lambda gs: tp.roots_and_orphans(_GRP(gs), tp.group_hierarchy(gs)), _HIE + "SELECT group_id, voltage_level, CASE WHEN voltage_level = 'HV' THEN 'root' ELSE 'orphan' END AS kind FROM grp WHERE group_id NOT IN (SELECT child_group_id FROM hy)")
_add("j13_mv_lv_mapping", "gs", tp.mv_lv_mapping, "SELECT DISTINCT m.station_fid AS mv_station_id, m.group_id AS mv_group_id, l.group_id AS lv_group_id FROM gs m JOIN gs l ON m.station_fid = l.station_fid AND m.station_type = 'TRANSFORMER' AND l.station_type = 'TRANSFORMER' AND m.voltage_level = 'MV' AND l.voltage_level = 'LV'")
_ARR = "(SELECT string_agg(DISTINCT group_id, ',' ORDER BY group_id) FROM gs x WHERE x.station_fid = t.station_fid AND x.station_type = '{1}' AND x.voltage_level = '{0}')"
_flat = lambda d: d.withColumns({c: F.array_join(c, ",") for c in ("from_groups", "to_groups")})
_add("j15_voltage_transitions", "gs", lambda gs: _flat(tp.voltage_transitions(gs, "LV", "MV", "TRANSFORMER").unionByName(tp.voltage_transitions(gs, "MV", "HV", "SUBSTATION"))), " UNION ALL ".join(f"SELECT '{a}' AS from_voltage, '{b}' AS to_voltage, '{s}' AS transition_type, station_fid, {_ARR.format(a, s)} AS from_groups, {_ARR.format(b, s)} AS to_groups FROM (SELECT DISTINCT station_fid FROM gs WHERE station_type = '{s}' AND voltage_level IN ('{a}', '{b}')) t" for a, b, s in (("LV", "MV", "TRANSFORMER"), ("MV", "HV", "SUBSTATION"))))
_add("r3_station_links", "gs", tp.station_link_summary, "SELECT voltage_level, station_type, count(DISTINCT group_id) AS groups, count(*) AS links, r(avg(distance_m)) AS avg_distance, r(avg(confidence_score)) AS avg_confidence FROM gs GROUP BY ALL")
_CHAIN = lambda gs, c: tp.supply_chain(tp.group_hierarchy(gs), c.select("building_id", F.concat(F.lit("LV_"), (F.col("lv_group") % 100).cast("string")).alias("lv_group")))
_CH = _HIE + ", ch AS (SELECT parent_group_id AS mv_group, via_station_fid AS transformer, child_group_id AS lv_group, building_id FROM c JOIN hy ON child_voltage = 'LV' AND child_group_id = 'LV_' || (c.lv_group % 100)) "
_add("j20_supply_chain", "gs c", _CHAIN, _CH + "SELECT * FROM ch")
_add("r38_hierarchy_stats", "gs c", lambda gs, c: tp.hierarchy_stats(_CHAIN(gs, c)), _CH + "SELECT mv_group, count(DISTINCT lv_group) AS lv_groups, count(DISTINCT transformer)::int AS transformers, count(*) AS buildings FROM ch GROUP BY 1")
_DOWN = lambda gs: tp.group_hierarchy(gs).select(F.col("parent_group_id").alias("src"), F.col("child_group_id").alias("dst"))
_add("gr6_reachability", "gs", lambda gs: tp.reachability(_DOWN(gs), _GRP(gs).where("voltage_level = 'HV'").select(F.col("group_id").alias("node"))), _HIE + "SELECT source, node, min(n)::int AS path_length FROM (SELECT parent_group_id AS source, child_group_id AS node, 1 AS n FROM hy WHERE parent_voltage = 'HV' UNION ALL SELECT a.parent_group_id, b.child_group_id, 2 FROM hy a JOIN hy b ON b.parent_group_id = a.child_group_id WHERE a.parent_voltage = 'HV') GROUP BY ALL")

# ---- shared walls
_W = "+w AS (SELECT *, (north > 0)::int + (east > 0)::int + (south > 0)::int + (west > 0)::int AS k, CASE WHEN north = 0 AND east = 0 AND south = 0 AND west = 0 THEN 'ISOLATED' WHEN (north > 0 AND south > 0) OR (east > 0 AND west > 0) THEN 'MIDDLE_ROW' WHEN (north > 0)::int + (east > 0)::int + (south > 0)::int + (west > 0)::int = 2 THEN 'CORNER' WHEN (north > 0)::int + (east > 0)::int + (south > 0)::int + (west > 0)::int = 1 THEN 'END_ROW' ELSE 'COURTYARD' END AS adjacency_type FROM wl), "
_FACE = " ".join(f"WHEN a.{m} > 0 AND b.{t} > 0 AND b.{ax} {op} a.{ax} AND abs(b.{ot} - a.{ot}) < 3 THEN {{{i}}}" for i, (m, t, ax, ot, op) in enumerate((("north", "south", "y", "x", ">"), ("south", "north", "y", "x", "<"), ("east", "west", "x", "y", ">"), ("west", "east", "x", "y", "<"))))
_case = lambda *v: "CASE " + _FACE.format(*v) + " END"
_PAIRS = _W + f"""p AS (SELECT * FROM (SELECT a.building_id AS a, b.building_id AS b, a.lv_group, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d, {_case("'north'", "'south'", "'east'", "'west'")} AS m, {_case("'south'", "'north'", "'west'", "'east'")} AS t, {_case(*(f'least(a.{m}, b.{t}) / greatest(a.{m}, b.{t})' for m, t in ad.FACING))} AS q, {_case(*(f'(a.{m} + b.{t}) / 2' for m, t in ad.FACING))} AS s, CASE WHEN a.function <> b.function THEN 2.0 WHEN a.housing_type <> b.housing_type THEN 1.5 ELSE 1.0 END AS fd, CASE WHEN a.has_solar <> b.has_solar THEN 2.0 WHEN a.solar_potential <> b.solar_potential THEN 1.5 ELSE 1.0 END AS sd FROM w a JOIN w b ON a.lv_group = b.lv_group AND a.building_id < b.building_id AND a.k > 0 AND b.k > 0 AND abs(a.x - b.x) < 5 AND abs(a.y - b.y) < 5) WHERE d < 5 AND q > 0.5), ae AS (SELECT a AS src, b AS dst, m AS my_wall, t AS their_wall, * FROM p UNION ALL SELECT b, a, t, m, * FROM p) """
_add("j17_adjacent_pairs", "wl", lambda w: ad.adjacent_pairs(w.select("building_id", "lv_group", "x", "y", *(m for m, _ in ad.FACING))).select(F.col("a_building_id").alias("a"), F.col("b_building_id").alias("b"), "lv_group", "distance_m", F.col("match.mine").alias("my_wall"), F.col("match.quality").alias("quality")), _PAIRS + "SELECT a, b, lv_group, r(d) AS distance_m, m AS my_wall, r(q) AS quality FROM p")
_POT = "fd * sd * q"
_add("j18_adjacency_edges", "wl", ad.adjacency_edges, _PAIRS + f"SELECT src, dst, my_wall, their_wall, lv_group, r(d) AS distance_m, r(s) AS strength, r(d * 0.5) AS cable_distance, r(d * 0.001) AS loss_factor, d < 3 AS sharing_viable, fd::double AS function_diversity, sd::double AS solar_diversity, r(q) AS match_quality, r({_POT}) AS potential, CASE WHEN {_POT} > 2.5 THEN 'VERY_HIGH' WHEN {_POT} > 2.0 THEN 'HIGH' WHEN {_POT} > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, r(0.1 * q) AS resistance_cut FROM ae")
_BM = f", bm AS (SELECT w.building_id, w.lv_group, housing_type, adjacency_type, coalesce(n, 0) AS n, s, pot, ws FROM w LEFT JOIN (SELECT src, count(*) AS n, avg(s) AS s, max({_POT}) AS pot, string_agg(DISTINCT my_wall, ',' ORDER BY my_wall) AS ws FROM ae GROUP BY 1) ON src = building_id) "
_add("r34_adjacency_metrics", "wl", ad.building_metrics, _PAIRS + _BM + "SELECT building_id, n AS neighbours, r(coalesce(s, 0)) AS avg_strength, r(coalesce(pot, 0)) AS best_potential, coalesce(ws, '') AS walls, CASE n WHEN 0 THEN 1.0::double WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 ELSE 0.6 END AS isolation, CASE n WHEN 0 THEN 1.0::double WHEN 1 THEN 1.15 WHEN 2 THEN 1.3 ELSE 1.4 END AS thermal_boost FROM bm")
_add("r35_edge_potential", "wl", ad.potential_by_priority, _PAIRS + f"SELECT CASE WHEN {_POT} > 2.5 THEN 'VERY_HIGH' WHEN {_POT} > 2.0 THEN 'HIGH' WHEN {_POT} > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, count(*) AS edges, r(avg({_POT})) AS potential FROM ae GROUP BY 1")
_VAL = "SELECT '{0}' AS \"check\", count(*) AS total, count_if(n = {2})::bigint AS correct, avg(n) AS m FROM bm WHERE {1} HAVING count(*) > 0"
_add("r70_adjacency_validation", "wl", ad.validation, _PAIRS + _BM + "SELECT \"check\", total, correct, r(m) AS avg_neighbours, r(correct / total) AS accuracy FROM (" + " UNION ALL ".join(_VAL.format(*x) for x in (("row_houses", "housing_type = 'rijtjeswoning'", 2), ("detached", "housing_type = 'vrijstaand'", 0), ("semi_detached", "housing_type = 'twee_onder_1_kap'", 1), ("middle_row_type", "adjacency_type = 'MIDDLE_ROW'", 2))) + " UNION ALL SELECT 'reciprocal', count(*), count(*), NULL FROM p)")
_add("r37_adjacency_report", "wl", ad.report, _PAIRS + _BM + "SELECT 'totals' AS section, 'buildings' AS key, count(*) AS n, r(avg(n)) AS value FROM bm UNION ALL SELECT 'adjacency_type', adjacency_type, count(*), r(avg(n)) FROM bm GROUP BY 2 UNION ALL SELECT 'housing_type', housing_type, count(*), r(avg(n)) FROM bm GROUP BY 2 UNION ALL SELECT 'edges', my_wall || '-' || their_wall, count(*), r(avg(q)) FROM ae GROUP BY 2")
_add("k3_adjacency_ratio", "wl", ad.top_groups, _PAIRS + _BM + "SELECT lv_group, count(*) AS buildings, count_if(n > 0)::bigint AS with_neighbour, r(count_if(n > 0) / count(*)) AS ratio FROM bm GROUP BY 1 ORDER BY count_if(n > 0) / count(*) DESC, lv_group LIMIT 10")
_ROWC = ", rn AS (SELECT building_id, adjacency_type FROM w WHERE adjacency_type IN ('MIDDLE_ROW', 'END_ROW', 'CORNER')), re AS (SELECT DISTINCT src, dst FROM ae WHERE src IN (SELECT building_id FROM rn) AND dst IN (SELECT building_id FROM rn)), rc AS (SELECT src AS a, src AS b FROM re UNION SELECT rc.a, re.dst FROM rc JOIN re ON re.src = rc.b), rk AS (SELECT a AS building_id, min(b) AS cluster_id FROM rc GROUP BY 1), rows_ AS (SELECT building_id, cluster_id FROM rk WHERE cluster_id IN (SELECT cluster_id FROM rk JOIN rn USING (building_id) GROUP BY 1 HAVING count(*) >= 3 AND bool_or(adjacency_type <> 'CORNER'))) "
_add("gr3_row_clusters", "wl", ad.row_clusters, "RECURSIVE" + _PAIRS + _ROWC + "SELECT * FROM rows_")
_add("gr4_corner_clusters", "wl", lambda w: ad.corner_clusters(w, ad.row_clusters(w), 1), "RECURSIVE" + _PAIRS + _ROWC + ", fr AS (SELECT building_id, adjacency_type FROM w WHERE building_id NOT IN (SELECT building_id FROM rows_)), nn AS (SELECT DISTINCT src, dst FROM ae WHERE src IN (SELECT building_id FROM fr WHERE adjacency_type IN ('CORNER', 'COURTYARD')) AND dst IN (SELECT building_id FROM fr)) SELECT dst AS building_id, src AS cluster_id, 'MEMBER' AS role FROM nn UNION ALL SELECT DISTINCT src, src, 'CENTER' FROM nn")
_add("gr5_apartment_clusters", "wl", lambda w: ad.apartment_clusters(w, w.limit(0)), "+q AS (SELECT a.building_id AS a, b.building_id AS b, a.lv_group, a.district FROM wl a JOIN wl b ON a.lv_group = b.lv_group AND a.district = b.district AND a.building_id < b.building_id AND a.housing_type = 'appartement' AND b.housing_type = 'appartement' WHERE sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) < 50) SELECT lv_group, district, min(i) AS cluster_id, count(DISTINCT i) AS members FROM (SELECT lv_group, district, a AS i FROM q UNION SELECT lv_group, district, b FROM q) GROUP BY ALL")
_TEN = lambda w: w.select("building_id", (F.col("building_id") % 10).alias("cluster_id"))
_add("r36_cluster_penetration", "wl", lambda w: ad.penetration(w, _TEN(w)), f"SELECT *, CASE WHEN functions > 1 AND solar > 0 THEN 'HIGH' WHEN solar > 0 OR battery > 0 THEN 'MEDIUM' ELSE 'LOW' END AS sharing FROM (SELECT building_id % 10 AS cluster_id, count(*) AS members, r({SH('has_solar')}) AS solar, r({SH('has_battery')}) AS battery, r({SH('has_heat_pump')}) AS heat_pump, count(DISTINCT function)::int AS functions FROM wl GROUP BY 1)")
_add("x33_thermal_savings", "wl", lambda w: ad.thermal_savings(_TEN(w), w), _PAIRS + "SELECT building_id, building_id % 10 AS cluster_id, r(least(0.2, 0.05 * (SELECT count(DISTINCT dst) FROM ae WHERE src = building_id AND src % 10 = dst % 10))) AS saving FROM wl")

# ---- assessments
_POORX = "lab IN ('E', 'F', 'G')"
_C1 = f"+c1 AS (SELECT *, {_LAB} AS lab, roof_flat + roof_sloped AS roof, CASE WHEN function = 'residential' THEN 'residential' WHEN building_type = 'Office' THEN 'office' WHEN building_type = 'Retail' THEN 'retail' WHEN building_type = 'Industrial' THEN 'industrial' ELSE 'other' END AS use FROM c), "
_LVP1 = _C1 + f"e1 AS (SELECT mv_station, lv_group, -sum(p * ln(p)) / ln(5) AS fd FROM (SELECT mv_station, lv_group, use, count(*) / sum(count(*)) OVER (PARTITION BY mv_station, lv_group) AS p FROM c1 GROUP BY mv_station, lv_group, use) GROUP BY ALL), k1 AS (SELECT mv_station, lv_group, max(n) / sum(n) AS pc FROM (SELECT mv_station, lv_group, peak_hour, count(*) AS n FROM c1 GROUP BY ALL) GROUP BY ALL), lv1 AS (SELECT *, fd * 0.4 + td * 0.4 + (1 - pc) * 0.2 AS cp, least((fd + td) / 2 * 3 + pr * 4 + sr * 2 + (1 - pc), 10) AS ps FROM (SELECT mv_station, lv_group, count(*) AS buildings, count(DISTINCT lab) / 7 AS ld, least(stddev_pop(peak_hour) / 12, 1) AS td, least(coalesce(stddev_pop(area) / avg(area), 0), 1) AS sd, {SH(_POORX)}::double AS pr, avg(ascii(lab) - 64) AS ls, avg(CASE WHEN has_solar OR roof < 40 THEN 0.0::double ELSE CASE WHEN orientation IN ('S', 'SE', 'SW') THEN 1.0 WHEN orientation IN ('E', 'W') THEN 0.7 ELSE 0.3 END * CASE WHEN {_POORX} THEN 1.0 WHEN lab IN ('C', 'D') THEN 0.7 ELSE 0.3 END END) AS sr FROM c1 GROUP BY ALL) JOIN e1 USING (mv_station, lv_group) JOIN k1 USING (mv_station, lv_group)) "
_add("r49_lv_planning", "c", asm.lv_planning, _LVP1 + "SELECT mv_station, lv_group, buildings, r(ld) AS label_diversity, r(td) AS temporal_diversity, r(sd) AS size_diversity, r(pr) AS poor_ratio, r(ls) AS label_score, r(sr) AS solar_readiness, r(pc) AS coincidence, r(fd) AS function_diversity, r(cp) AS complementarity, r(ps) AS planning_score FROM lv1")
_MV1 = ", mv1 AS (SELECT *, pr * 0.6 + (1 - dv) * 0.4 AS ur, least(dv * 2 + pr * 3 + cp * 2 + va + (pr * 0.6 + (1 - dv) * 0.4) * 2, 10) AS pri FROM (SELECT mv_station, count(*) AS lv_groups, sum(buildings)::bigint AS buildings, avg((fd + td) / 2) AS dv, avg(pr) AS pr, avg(cp) AS cp, coalesce(stddev_pop(ps) / avg(ps), 0) AS va, array_to_string(list_slice(list(lv_group ORDER BY round(ps, 9) DESC, lv_group), 1, 3), ',') AS best, count_if(pr > 0.5)::int AS pb FROM lv1 GROUP BY 1)) "
_add("r50_mv_planning", "c", lambda c: asm.mv_planning(asm.lv_planning(c)), _LVP1 + _MV1 + "SELECT mv_station, lv_groups, buildings, r(dv) AS diversity, r(pr) AS poor_ratio, r(cp) AS complementarity, r(va) AS variety, r(ur) AS urgency, best, pb AS problematic, r(pri) AS priority FROM mv1")
_add("k4_best_station", "c", lambda c: asm.select_station(asm.mv_planning(asm.lv_planning(c))).select("mv_station", "priority"), _LVP1 + _MV1 + "SELECT mv_station, r(pri) AS priority FROM mv1 ORDER BY pri DESC, mv_station LIMIT 1")
_add("k4_best_buildings", "c", asm.best_buildings, f"SELECT building_id, label, roof_flat + roof_sloped AS roof, {_LAB} IN ('E', 'F', 'G') AS poor FROM c WHERE NOT has_solar ORDER BY poor DESC, roof DESC, building_id LIMIT 10")
_LA = _C1 + f"e2 AS (SELECT mv_station, lv_group, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS fd, max(p) AS co FROM (SELECT mv_station, lv_group, building_type, count(*) / sum(count(*)) OVER (PARTITION BY mv_station, lv_group) AS p FROM c1 GROUP BY mv_station, lv_group, building_type) GROUP BY ALL), la AS (SELECT * FROM (SELECT mv_station, lv_group, count(*) AS buildings, {SH(_POORX)}::double AS pr, least(stddev_pop(area) / avg(area), 1) AS sv, sum(annual_kwh) / 1000 AS dm, sum(peak_kw) AS pk, sum(CASE WHEN has_solar THEN 0.0::double ELSE roof * 0.15 * CASE orientation WHEN 'S' THEN 1.0::double WHEN 'SW' THEN 0.95 WHEN 'E' THEN 0.85 WHEN 'W' THEN 0.85 WHEN 'N' THEN 0.5 ELSE 0.8 END * CASE WHEN lab IN ('A', 'B') THEN 1.2::double ELSE 1.0 END END) AS sp, least((max(peak_hour) - min(peak_hour)) / 12, 1) AS td, {SH('has_solar')}::double AS ps, least(coalesce(stddev_pop(distance_m) / nullif(avg(distance_m), 0), 0), 1) AS ds FROM c1 GROUP BY ALL HAVING count(*) >= 3) JOIN e2 USING (mv_station, lv_group)) "
_add("r51_lv_assessment", "c", asm.lv_assessment, _LA + "SELECT mv_station, lv_group, buildings, r(pr) AS poor_ratio, r(sv) AS size_variance, r(dm) AS demand_mwh, r(pk) AS peak_kw, r(sp) AS solar_potential, r(td) AS temporal_diversity, r(ps) AS prosumers, r(ds) AS distance_spread, r(fd) AS function_diversity, r(co) AS correlation FROM la")
_add("r51_mv_assessment", "c", lambda c: asm.mv_assessment(asm.lv_assessment(c)), _LA + "SELECT mv_station, lv_groups, buildings, r(d) AS diversity, r(p) AS poor_ratio, r(dm) AS demand_mwh, r(pk) AS peak_kw, r(sp) AS solar_potential, r(c) AS complementarity, CASE WHEN round(d * 0.5 + c * 0.5, 9) >= greatest(round(p, 9), round(least(sp / 1000, 1), 9), round((d + p + c) / 3, 9)) THEN 'energy_community' WHEN round(p, 9) >= greatest(round(least(sp / 1000, 1), 9), round((d + p + c) / 3, 9)) THEN 'retrofit_focus' WHEN round(least(sp / 1000, 1), 9) >= round((d + p + c) / 3, 9) THEN 'solar_priority' ELSE 'mixed' END AS strategy FROM (SELECT mv_station, count(*) AS lv_groups, sum(buildings)::bigint AS buildings, avg(fd) AS d, avg(pr) AS p, sum(dm) AS dm, sum(pk) * 0.8 AS pk, sum(sp) AS sp, avg(1 - co) AS c FROM la GROUP BY 1)")
_DA = _C1 + f"da AS (SELECT *, greatest(1 - abs(0.65 - res) - abs(0.25 - com), 0) AS mu, pro * (1 - pro) * 4 AS pb, (su + sl + (1 - least(cv, 1)) + (1 - least(ps / 12, 1))) / 4 AS ho FROM (SELECT district, count(*) AS buildings, {SH("use = 'residential'")}::double AS res, {SH("use IN ('office', 'retail')")}::double AS com, {SH("use = 'industrial'")}::double AS ind, {SH('has_solar')}::double AS pro, {SH('roof > 50 AND NOT has_solar')}::double AS pot, stddev_pop(area) / avg(area) AS cv, stddev_pop(peak_hour) AS ps, max(peak_hour) - min(peak_hour) AS sp, {SH(_POORX)}::double AS ur, {SH('2024 - build_year > 40')}::double AS od, {SH('roof > 40 AND NOT has_solar')}::double AS a, {SH("lab IN ('A', 'B', 'C') AND NOT has_heat_pump")}::double AS b, {SH('has_solar AND NOT has_battery')}::double AS g, {SH("lab IN ('D', 'E', 'F', 'G') AND area > 60")}::double AS f, count(DISTINCT lab) AS labels FROM c1 WHERE district IS NOT NULL GROUP BY 1) JOIN (SELECT district, max(n) / sum(n) AS su FROM (SELECT district, use, count(*) AS n FROM c1 GROUP BY ALL) GROUP BY 1) USING (district) JOIN (SELECT district, max(n) / sum(n) AS sl FROM (SELECT district, lab, count(*) AS n FROM c1 GROUP BY ALL) GROUP BY 1) USING (district)) "
_add("r48_district_assessment", "c", asm.district_assessment, _DA + "SELECT district, buildings, r(res) AS res, r(com) AS com, r(ind) AS ind, r(pro) AS prosumers, r(pot) AS potential, r(cv) AS area_cv, r(ps) AS peak_std, sp AS peak_spread, r(ur) AS urgent, r(od) AS old, r(a) AS solar_ready, r(b) AS pump_ready, r(g) AS battery_ready, r(f) AS retrofit_ready, labels::int AS labels, r(su) AS same_use, r(sl) AS same_label, CASE WHEN res > 0.8 THEN 'predominantly_residential' WHEN com > 0.6 THEN 'predominantly_commercial' WHEN res > 0.4 AND com > 0.2 THEN 'mixed_use' ELSE 'diverse_mixed' END AS district_type, r(mu) AS mixed_use, r(pb) AS prosumer_benefit, r(ho) AS homogeneity, su > 0.8 OR sl > 0.7 OR cv < 0.2 OR ps < 2 AS is_homogeneous, r(least((ur + od) / 2 * 10, 10)) AS urgency, ur > 0.3 OR od > 0.5 AS immediate, r((a + b + g + f) / 4) AS readiness, r(least(a, b, g)) AS coordinated, r(least(sp / 12, 1)) AS temporal, r(mu * 0.3 + pb * 0.25 + (1 - ho) * 0.25 + least(sp / 12, 1) * 0.2) AS complementarity FROM da")
_add("r31_group_aggregate", "c", asm.group_aggregate, f"SELECT lv_group, count(*) AS buildings, r(sum(area)) AS area, r(sum(roof_flat + roof_sloped)) AS roof, count_if(has_solar)::bigint AS solar, count_if(has_battery)::bigint AS battery, count_if(has_heat_pump)::bigint AS heat_pump, r(avg(8 - (ascii({_LAB}) - 64))) AS label_score FROM c GROUP BY 1")
_add("r32_systems_installed", "c", asm.systems_installed, " UNION ALL ".join(f"SELECT '{k}' AS system, count_if({k})::bigint AS n, r(count_if({k}) / count(*)) AS share FROM c" for k in ("has_solar", "has_battery", "has_heat_pump")))
_add("p17_retrofit_candidates", "c", asm.retrofit_candidates, f"SELECT lv_group, count(*) AS buildings, r(sum(area)) AS area, string_agg(building_id, ',' ORDER BY building_id) AS ids FROM c WHERE {_LAB} IN ('E', 'F', 'G') AND age_range LIKE '%19%' GROUP BY 1")

# ---- derived scores
_add("p3_p6_scores", "c", lambda c: sc.solar_potential(c, "roof_flat", "roof_sloped", "distance_m").select("building_id", "solar_potential", sc.insulation_score(None, F.col("build_year")).alias("insulation"), sc.daily_consumption(F.col("annual_kwh")).alias("daily"), sc.daily_consumption(area=F.col("area")).alias("by_area"), sc.compactness(F.col("area"), F.lit(6.0)).alias("compactness"), sc.shared_wall_ratio(F.col("roof_flat"), F.col("area")).alias("shared_ratio")), "SELECT building_id, r(least(least((roof_flat + roof_sloped) / 200, 1) + distance_m / (SELECT max(distance_m) FROM c) * 0.2, 1)) AS solar_potential, r(least(greatest((build_year - 1900) / 120, 0), 1)) AS insulation, r(annual_kwh / 365) AS daily, r(least(greatest(area * 150 / 365, 10), 1000)) AS by_area, r(least(area * 6 / (2 * area + 4 * sqrt(area) * 6 + 1e-6), 10) / 10) AS compactness, r(roof_flat / (area + roof_flat + 1e-6)) AS shared_ratio FROM c")
_add("p22_scaled", "c", lambda c: sc.scale(c.select("building_id", "area", "roof_flat"), ["area", "roof_flat"])[0], "SELECT building_id, r((area - (SELECT avg(area) FROM c)) / (SELECT stddev_pop(area) FROM c)) AS area, r((roof_flat - (SELECT avg(roof_flat) FROM c)) / (SELECT stddev_pop(roof_flat) FROM c)) AS roof_flat FROM c")
_i = lambda c: F.col(c).cast("int")
_add("p20_building_features", "c", lambda c: c.select("building_id", *sc.building_features(F.col("area") / 1000, F.col("peak_kw"), F.lit(0.5), F.lit(0.4), F.col("build_year") / 2000, F.col("roof_flat") / 100, F.lit(0.8), F.lit(0.6), _i("has_solar"), _i("has_battery"), _i("has_heat_pump"), F.col("peak_kw") * 2, F.lit(1))), "SELECT building_id, r((peak_kw + 0.5) / (area / 1000 + 1e-6)) AS intensity, r(0.6 * 0.6 + build_year / 2000 * 0.4) AS retrofit, r(roof_flat / 100 * 0.8 * (1 - has_solar::int * 0.5)) AS solar_fit, r(0.6 * 0.5 * (1 - has_heat_pump::int * 0.5)) AS electrify_fit, r((has_solar::int + has_battery::int + has_heat_pump::int) / 3.0) AS systems, r(peak_kw * 2 / ((peak_kw + 0.5) / 2 + 1e-6)) AS peak_ratio, 1::int AS shared_walls FROM c")
_add("p21_group_features", "c", lambda c: c.groupBy("lv_group").agg(F.count("*").alias("n"), F.sum("roof_flat").alias("roof"), F.avg("peak_kw").alias("k"), F.sum("peak_kw").alias("p"), F.sum(_i("has_solar") + _i("has_battery") + _i("has_heat_pump")).alias("s")).select("lv_group", *sc.group_features(F.lit(1.5), F.col("n"), F.col("roof"), F.col("k"), F.col("p"), F.lit(200.0), F.col("s")), *sc.cluster_features(F.lit(0.4), F.lit(0.2), F.lit(0.1), F.lit(0.3), F.col("k"), F.col("p"), F.lit(0.5), F.lit(0.6), F.col("roof"), F.col("n"))[2:]), "SELECT lv_group, r(1.5 * ln(1 + n) / 10) AS diversity_efficiency, r(roof / (k * 100 + 1e-6)) AS self_supply, r(p / (200 + 1e-6)) AS stress, r(s / (n + 1e-6)) AS penetration, r(k / (p + 1e-6)) AS sharing, r((1.1 + roof / 1000) / 3) AS economic, r(ln(1 + n) / 10) AS density FROM (SELECT lv_group, count(*) AS n, sum(roof_flat) AS roof, avg(peak_kw) AS k, sum(peak_kw) AS p, sum(has_solar::int + has_battery::int + has_heat_pump::int) AS s FROM c GROUP BY 1)")
_add("p24_roi_labels", "c", lambda c: c.where("has_solar").select("building_id", *sc.label_roi(F.col("annual_kwh") / 100, F.col("building_id") % 60, F.col("roof_flat") * 0.15, F.col("roof_flat") * 180, F.lit(0.75), F.lit(0.2))), "SELECT building_id, r(CASE WHEN net > 0 THEN roof_flat * 180 / net END) AS roi_years, CASE WHEN dd < 30 THEN 'unknown' WHEN net > 0 AND roof_flat * 180 / net < 5 THEN 'excellent' WHEN net > 0 AND roof_flat * 180 / net < 7 THEN 'good' WHEN net > 0 AND roof_flat * 180 / net < 10 THEN 'fair' ELSE 'poor' END AS label, CASE WHEN dd < 30 THEN 0.0::double ELSE 1.0 END AS confidence FROM (SELECT *, y * 0.75 * 0.25 + y * 0.25 * 0.08 - roof_flat * 0.15 * 20 AS net FROM (SELECT *, CASE WHEN dd >= 30 THEN annual_kwh / 100 / dd * 365 ELSE roof_flat * 0.15 * 1200 END AS y FROM (SELECT *, building_id % 60 AS dd FROM c WHERE has_solar)))")
_add("p19_calendar", "s", lambda s: s.select("event_id", *pr.calendar_shares("ts")), "SELECT event_id, " + ", ".join(f"r({f}(2 * pi() * {v} / {p})) + 0.0 AS {n}_{f}" for n, v, p in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)) for f in ("sin", "cos")) + " FROM s")

# ---- plans
_CAND = lambda c: c.where("NOT has_solar").select("building_id", (F.col("roof_flat") + F.col("roof_sloped")).alias("roof"), ((F.col("roof_flat") + F.col("roof_sloped")) * 1.1).alias("score"))
_PLAN = lambda c: rm.installation_plan(_CAND(c), rm.roadmap(c.sparkSession, 200000.0, 5, "accelerated"))
_RUN = "+yr AS (SELECT y AS year, 200000.0 * pow(1.5, y) / (1 + 1.5 + 2.25 + 3.375 + 5.0625) AS area FROM (SELECT unnest(range(5)) AS y)), yc AS (SELECT year, sum(area) OVER (ORDER BY year) AS until FROM yr), cd AS (SELECT *, sum(roof) OVER (ORDER BY roof DESC, building_id ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT building_id, roof_flat + roof_sloped AS roof FROM c WHERE NOT has_solar)), ip AS (SELECT y AS year, building_id, roof, greatest(least(roof * 0.15, 50), 2) * (1 + 0.02 * y) AS kwp FROM (SELECT *, (SELECT min(year) FROM yc WHERE until >= e) AS y FROM cd) WHERE y IS NOT NULL) "
_add("x25_installation_plan", "c", _PLAN, _RUN + "SELECT year::int AS year, building_id, roof, r(kwp) AS kwp FROM ip")
_add("x25_plan_years", "c", lambda c: rm.plan_years(_PLAN(c), 5e7), _RUN + "SELECT year, buildings, r(kwp) AS kwp, r(kwp * 1200 * pow(0.95, year)) AS budget, r(t) AS total_kwp, r(t * 1200 / 1e6) AS energy_gwh, r(t * 1200 / 1e6 * 400) AS co2_tons, r(t * 0.6 / 1000) AS peak_cut_mw, r(least(t * 1200 / 5e7, 1)) AS self_sufficiency FROM (SELECT year::int AS year, count(*) AS buildings, sum(kwp) AS kwp, sum(sum(kwp)) OVER (ORDER BY year) AS t FROM ip GROUP BY year)")
_CLU = lambda c: c.withColumns({"cluster_id": F.col("building_id") % 8, "roof": F.col("roof_flat") + F.col("roof_sloped")})
_add("x25_cluster_priorities", "c", lambda c: rm.cluster_priorities(_CLU(c)), "SELECT cluster_id, r(q / sum(q) OVER ()) AS priority FROM (SELECT building_id % 8 AS cluster_id, 1 / (sum(has_solar::int) / (sum(roof_flat + roof_sloped) + 1e-10) + 0.1) AS q FROM c GROUP BY 1)")
_add("x24_intervention_mix", "c", lambda c: rm.intervention_mix(c.select("lv_group", F.col("building_id").alias("item_id"), "peak_kw", (F.col("roof_flat") + 1).alias("value"), (F.col("area") + 1).alias("cost")), 9000.0).select("lv_group", "item_id", "rank", "share", "phase"), "SELECT lv_group, item_id, rank::int AS rank, r(share) AS share, CASE WHEN s <= 3000 THEN 1 WHEN s <= 6000 THEN 2 ELSE 3 END AS phase FROM (SELECT *, least(1, (9000 - (s - cost)) / cost) AS share FROM (SELECT lv_group, building_id AS item_id, area + 1 AS cost, row_number() OVER w AS rank, sum(area + 1) OVER (PARTITION BY lv_group ORDER BY round((roof_flat + 1) / (area + 1), 9) DESC, building_id ROWS UNBOUNDED PRECEDING) AS s FROM c WINDOW w AS (PARTITION BY lv_group ORDER BY round((roof_flat + 1) / (area + 1), 9) DESC, building_id))) WHERE share > 0.5")
_add("k7_recommend_next", "c", lambda c: rm.recommend_next(_CLU(c), "energy", c.sparkSession.range(3).withColumnRenamed("id", "cluster_id")), "SELECT building_id, r(s) AS score FROM (SELECT building_id, annual_kwh * CASE WHEN building_id % 8 < 3 THEN 1.5 ELSE 1 END AS s FROM c WHERE NOT has_solar) ORDER BY s DESC, building_id LIMIT 10")
_add("r66_solar_system", "c", lambda c: rm.solar_system_metrics(c.withColumn("avg_kw", F.col("peak_kw") / 4), c.where("NOT has_solar AND roof_flat > 50").select((F.col("roof_flat") * 0.15).alias("kw"), (F.col("roof_flat") * 180).alias("cost"), (F.col("roof_flat") * 150).alias("kwh"), (F.col("roof_flat") * 0.06).alias("co2"), (F.col("roof_flat") / 10).alias("years"))), "SELECT buildings, with_solar, r(consumption) AS consumption, n AS new, r(f * 0.15) AS new_kw, r(f * 180) AS cost, r(f * 150) AS kwh, r(f * 0.06) AS co2, r(f / n / 10) AS years, r(with_solar / buildings) AS coverage, r((with_solar + n) / buildings) AS planned, r(f * 150 / consumption) AS renewable FROM (SELECT count(*) AS buildings, count_if(has_solar)::bigint AS with_solar, sum(peak_kw / 4 * 24 * 365) AS consumption, count(*) FILTER (WHERE NOT has_solar AND roof_flat > 50) AS n, sum(roof_flat) FILTER (WHERE NOT has_solar AND roof_flat > 50) AS f FROM c)")
_add("r67_deployment_stats", "c", lambda c: rm.deployment_stats(c.select("building_id", "label", (F.col("roof_flat") + 1).alias("roi_years"))), "SELECT label, count(*) AS n, r(avg(roof_flat + 1)) AS avg_years, arg_min(building_id, roof_flat * 1e9 + building_id) AS best, arg_min(building_id, -roof_flat * 1e9 + building_id) AS worst FROM c GROUP BY 1")
_ITEMS = lambda c: _CLU(c).where("label IN ('F', 'G')").select("cluster_id", F.when(F.col("building_id") % 2 == 0, "solar").otherwise("retrofit").alias("kind"), (F.col("area") * 2).alias("cost"), (F.col("area") * F.col("roof_flat") / 200).alias("saving"), (F.col("area") / 100).alias("co2"))
_add("r71_cluster_economics", "c", lambda c: rm.cluster_economics(_ITEMS(c), _CLU(c).groupBy("cluster_id").agg(F.count("*").alias("buildings"))), f"SELECT cluster_id, buildings, r(i) AS investment, r(so) AS solar, r(s) AS saving, r(co) AS co2, r(pb) AS payback, r(i / buildings) AS per_building, r((s * 10 - i) / i) AS roi_10, r({_PV.format('s').replace('pow(1.02, y)', '1')} - i) AS npv_20, CASE WHEN pb < 5 THEN 'Excellent' WHEN pb < 8 THEN 'Good' WHEN pb < 12 THEN 'Moderate' ELSE 'Marginal' END AS viability FROM (SELECT building_id % 8 AS cluster_id, count(*) AS buildings FROM c GROUP BY 1) JOIN (SELECT building_id % 8 AS cluster_id, sum(area * 2) AS i, coalesce(sum(area * 2) FILTER (WHERE building_id % 2 = 0), 0) AS so, sum(area * roof_flat / 200) AS s, sum(area / 100) AS co, avg(CASE WHEN roof_flat > 0 THEN area * 2 / (area * roof_flat / 200) END) AS pb FROM c WHERE label IN ('F', 'G') GROUP BY 1) USING (cluster_id)")
_add("w11_global_rank", "c", lambda c: rm.global_rank(c.select("building_id", (F.col("peak_kw") / 50).alias("score"))), "SELECT building_id, r(s) AS score, row_number() OVER (ORDER BY s DESC, building_id) AS rank, CASE WHEN s > 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM (SELECT building_id, peak_kw / 50 AS s FROM c)")
_add("x23_recommendations", "c", rm.recommendations, " UNION ALL ".join(["SELECT building_id, 'solar' AS kind, CASE WHEN roof_flat + roof_sloped > 100 THEN 'high' ELSE 'medium' END AS priority FROM c WHERE NOT has_solar AND roof_flat + roof_sloped > 50", "SELECT building_id, 'storage', 'medium' FROM c WHERE has_solar AND NOT has_battery", "SELECT building_id, 'retrofit', CASE label WHEN 'G' THEN 'high' ELSE 'medium' END FROM c WHERE label IN ('E', 'F', 'G')", "SELECT building_id, 'demand_response', 'low' FROM c WHERE peak_hour BETWEEN 17 AND 21", "SELECT building_id, 'grid', 'high' FROM c WHERE is_problematic", "SELECT building_id, 'smart_meter', 'low' FROM c WHERE annual_kwh > 20000"]))
_add("r76_solar_scorecard", "c", lambda c: rm.solar_plan_scorecard(_CLU(c), _PLAN(c)), _RUN + "SELECT r((SELECT avg(has_solar::int) FROM c)) AS coverage, r((SELECT (count_if(has_solar) + (SELECT count(*) FROM ip)) / count(*) FROM c)) AS planned_coverage, r((SELECT count(DISTINCT building_type) FROM c JOIN ip USING (building_id)) / (SELECT count(DISTINCT building_type) FROM c)) AS diversity, r((SELECT avg((roof > 20)::int) FROM ip)) AS feasible, r(least((SELECT sum(kwp) FROM ip) * 1200 / (SELECT sum(annual_kwh) FROM c), 1)) AS renewable, r((SELECT 1 - stddev_pop(s) FROM (SELECT avg(CASE WHEN ip.building_id IS NULL THEN 0 ELSE 1 END) AS s FROM c LEFT JOIN ip USING (building_id) GROUP BY c.building_id % 8))) AS balance")
_add("r77_retrofit_scorecard", "c", lambda c: rm.retrofit_plan_scorecard(fb.retrofit_economics(c).withColumn("cluster_id", F.col("building_id") % 8), 60.0), "SELECT count(*) AS buildings, r(sum(k)) AS kwh, r(sum(k) * 0.5 / 1000) AS co2_tons, r(sum(i)) AS investment, r(avg((i / (k * 0.25) <= 60)::int)) AS in_time, count(DISTINCT building_id % 8) AS clusters FROM (SELECT building_id, annual_kwh * n * 0.15 AS k, area * n * 150 AS i FROM (SELECT *, ascii(label) - 66 AS n FROM c) WHERE n > 0)")
_add("e5_grid_deferral", "b", lambda b: b.groupBy("lv_group").agg(F.count("*").alias("n"), F.sum("peak_kw").alias("p")).select("lv_group", *fb.grid_deferral(F.col("p") * 0.1, F.lit(0.3), F.col("n"))), "SELECT lv_group, r(p * 20) AS transformer, r(n * 10 * 0.3 * 150) AS line, r(p * 20 + n * 450) AS deferral, r((p * 20 + n * 450) / 10) AS annual_value, r(n * 15.0) AS maintenance, r((p * 20 + n * 450) / 10 + n * 15) AS benefit FROM (SELECT lv_group, count(*) AS n, sum(peak_kw) AS p FROM b GROUP BY 1)")
_add("e5_financial_summary", "b", lambda b: b.groupBy("lv_group").agg(F.sum("area").alias("a"), F.sum("peak_kw").alias("p")).select("lv_group", *fb.financial_summary([F.col("a"), F.col("p") * 10], [F.col("a") / 10, F.col("p")], F.col("a") / 1000)), "SELECT lv_group, r(i) AS investment, r(f) AS benefit, r(i / f) AS payback, r(f / i * 100) AS roi_pct, r(a / 1000) AS co2_tons, r(a / 20) AS co2_value FROM (SELECT lv_group, sum(area) AS a, sum(area) + sum(peak_kw) * 10 AS i, sum(area) / 10 + sum(peak_kw) AS f FROM b GROUP BY 1)")

# ---- flows, profiles, communities
_NODES = lambda s: s.select("building_id", "cluster_id", (F.col("building_id") % 30 * 20.0).alias("x"), (F.col("building_id") % 7 * 25.0).alias("y")).distinct()
_MATCH = "+n AS (SELECT lv_group, date_trunc('hour', ts) AS slot, building_id, round(sum(demand - generation), 6) AS net FROM s GROUP BY ALL), m AS (SELECT *, net < 0 AS gives, sum(abs(net)) OVER (PARTITION BY lv_group, slot, net < 0 ORDER BY abs(net) DESC, building_id ROWS UNBOUNDED PRECEDING) AS hi FROM n WHERE net <> 0), x AS (SELECT *, hi - abs(net) AS lo FROM m), fw AS (SELECT g.lv_group, g.slot, g.building_id AS from_id, t.building_id AS to_id, least(g.hi, t.hi) - greatest(g.lo, t.lo) AS k, sqrt(pow((g.building_id % 30 - t.building_id % 30) * 20.0, 2) + pow((g.building_id % 7 - t.building_id % 7) * 25.0, 2)) AS d FROM x g JOIN x t ON g.lv_group = t.lv_group AND g.slot = t.slot AND g.gives AND NOT t.gives AND least(g.hi, t.hi) - greatest(g.lo, t.lo) > 1e-6) "
_add("x14_delivered", "s", lambda s: fl.delivered(fl.match_surplus(_NET(s)), _NODES(s)).groupBy("tier").agg(F.count("*").alias("flows"), F.sum("energy_kwh").alias("sent"), F.sum("arrives_kwh").alias("arrived")), _MATCH + "SELECT CASE WHEN from_id % 25 = to_id % 25 AND d < 200 THEN 1 WHEN from_id % 25 = to_id % 25 THEN 2 ELSE 3 END AS tier, count(*) AS flows, r(sum(k)) AS sent, r(sum(k * greatest(least(1 - d / 100 * 0.02, 1), 0) * 0.95)) AS arrived FROM fw WHERE d <= 1000 GROUP BY 1")
_add("x16_lv_balance", "s", lambda s: fl.balance(fl.match_surplus(_NET(s)), s.select("building_id", (F.col("building_id") % 4).alias("lv_group")).distinct()), _MATCH + "SELECT *, r(CASE WHEN greatest(a, b) > 0 THEN abs(a - b) / greatest(a, b) ELSE 0 END) AS imbalance, CASE WHEN greatest(a, b) > 0 THEN abs(a - b) / greatest(a, b) ELSE 0 END <= 0.05 AS balanced FROM (SELECT g AS lv_group, sum(o) AS a, sum(i) AS b, r(sum(o)) AS sent, r(sum(i)) AS received, r(sum(c)) AS crossing FROM (SELECT from_id % 4 AS g, k AS o, 0.0 AS i, CASE WHEN from_id % 4 <> to_id % 4 THEN k ELSE 0 END AS c FROM fw UNION ALL SELECT to_id % 4, 0.0, k, 0 FROM fw) GROUP BY 1)".replace("SELECT *, r(", "SELECT lv_group, sent, received, crossing, r("))
_add("k2_flow_hours", "f", lambda f: fl.peak_hours(f.withColumn("ts", F.col("ts") + F.make_interval(hours=(F.col("to_id") % 24).cast("int")))), "SELECT hour(ts + to_hours((to_id % 24)::int))::int AS hour, r(sum(energy_kwh)) AS energy_kwh FROM f GROUP BY 1 ORDER BY sum(energy_kwh) DESC, hour LIMIT 3")
_add("r60_community_flows", "f", lambda f: fl.community_flow_stats(f.withColumns({"cluster_id": F.col("to_id") % 9, "flow_type": F.when(F.col("from_id") % 2 == 0, "community").otherwise("grid"), "price_per_kwh": F.lit(0.15)})), "SELECT to_id % 9 AS cluster_id, r(coalesce(sum(energy_kwh) FILTER (WHERE from_id % 2 = 0), 0)) AS shared, count(*) AS transactions, r(avg(energy_kwh)) AS mean, r(sum(energy_kwh) * 0.15) AS worth FROM f GROUP BY 1")
_add("r60_grid_impacts", "f", lambda f: fl.grid_impact_summary(f.select(F.col("from_id").alias("transformer_id"), F.col("energy_kwh").alias("load_kw"), F.lit(60.0).alias("capacity_kw"), F.lit(1.0).alias("voltage_pu"), (F.col("energy_kwh") / 50).alias("losses_kw"), (F.col("energy_kwh") / 100).alias("congestion_level"))), "SELECT r(avg(energy_kwh / 60)) AS avg_utilisation, r(max(energy_kwh / 60)) AS peak_utilisation, r(sum(energy_kwh) / 200) AS losses_kwh, 1.0::double AS voltage_pu, count_if(energy_kwh / 100 > 0.8)::bigint AS congested, count(DISTINCT from_id) AS transformers FROM f")
_add("r60_communities", "s", lambda s: fl.community_summary(pr.slots(s, "cluster_id").select("cluster_id", F.col("generation").alias("generation_kwh"), F.col("demand").alias("consumption_kwh"), F.least("demand", "generation").alias("shared_kwh"), (F.least("demand", "generation") / F.col("demand")).alias("self_sufficiency"), F.lit(4).alias("n_buildings"))), f"SELECT cluster_id, r(avg(least(demand, generation) / demand)) AS self_sufficiency, r(sum(least(demand, generation)) / 1000) AS shared_mwh, 4.0::double AS buildings, r(max(generation)) AS peak_generation, r(max(demand)) AS peak_consumption FROM ({_SLOT.format('cluster_id')}) GROUP BY 1")
_add("w12_hour_peaks", "s", pr.hour_peaks, f"+hp AS (SELECT cluster_id, hour(slot)::int AS hour, avg(demand) AS m FROM ({_SLOT.format('cluster_id')}) GROUP BY ALL), hq AS (SELECT cluster_id, quantile_cont(m, 0.8) AS a, quantile_cont(m, 0.2) AS b, max(m) AS x, min(m) AS y FROM hp GROUP BY 1) SELECT cluster_id, coalesce(string_agg(hour, ',' ORDER BY hour) FILTER (WHERE m >= a), '') AS peak_hours, coalesce(string_agg(hour, ',' ORDER BY hour) FILTER (WHERE m <= b), '') AS valley_hours, r(max(CASE WHEN y > 0 THEN x / y ELSE 0 END)) AS ratio FROM hp JOIN hq USING (cluster_id) GROUP BY 1")
_add("x4_similar_profiles", "s", lambda s: co.profile_similarity(pr.pairwise_complementarity(s), 0.3), _PC + "SELECT a, b, r(1 - 2 * c) AS similarity FROM c WHERE 1 - 2 * c > 0.3")
_PL = lambda s: s.select("building_id", F.col("lv_group").alias("transformer"), (F.col("building_id") % 3 + F.col("lv_group") * 10).alias("cable_group")).distinct()
_PLS = "pl AS (SELECT DISTINCT building_id, lv_group AS transformer, building_id % 3 + lv_group * 10 AS cable_group FROM s)"
_add("j24_topology_pairs", "s", lambda s: co.topology_pairs(_PL(s)), f"+{_PLS} SELECT x.building_id AS a, y.building_id AS b, CASE WHEN x.cable_group = y.cable_group THEN 1 ELSE 2 END::int AS electrical_distance FROM pl x JOIN pl y ON x.transformer = y.transformer AND x.building_id < y.building_id")
_add("j27_hierarchy_affinity", "s", lambda s: co.hierarchy_affinity(pr.pairwise_complementarity(s), _PL(s)), _PC + f", {_PLS} SELECT c.a, c.b, CASE WHEN x.cable_group = y.cable_group THEN 1 ELSE 2 END AS electrical_distance, r(c * CASE WHEN x.cable_group = y.cable_group THEN exp(-0.5) ELSE 0.5 * exp(-1.0) END) AS weight FROM c JOIN pl x ON x.building_id = c.a JOIN pl y ON y.building_id = c.b")
_add("x5_mutual_information", "s", lambda s: co.mutual_information(s.groupBy("lv_group", "building_id", F.hour("ts").alias("slot")).agg(F.avg("demand").alias("demand"))), "+z AS (SELECT lv_group, building_id, hour(ts) AS slot, avg(demand) AS d FROM s GROUP BY ALL), zb AS (SELECT *, least(floor((d - min(d) OVER w) / CASE WHEN max(d) OVER w > min(d) OVER w THEN max(d) OVER w - min(d) OVER w ELSE 1.0 END * 4), 3) AS bin FROM z WINDOW w AS (PARTITION BY building_id)), zj AS (SELECT x.building_id AS a, y.building_id AS b, x.bin AS x, y.bin AS y, count(*) AS n FROM zb x JOIN zb y ON x.lv_group = y.lv_group AND x.slot = y.slot AND x.building_id < y.building_id GROUP BY ALL), hx AS (SELECT a, b, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT a, b, x, sum(n) AS n FROM zj GROUP BY ALL) GROUP BY ALL), hz AS (SELECT a, b, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT a, b, y, sum(n) AS n FROM zj GROUP BY ALL) GROUP BY ALL), hj AS (SELECT a, b, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM zj GROUP BY ALL) SELECT a, b, r(hx.h) AS h_a, r(hz.h) AS h_b, r(hj.h) AS h, r(hx.h + hz.h - hj.h) AS mi FROM hx JOIN hz USING (a, b) JOIN hj USING (a, b)")
_add("r55_violations", "s", lambda s: co.violations(s.select("building_id", "cluster_id").distinct(), s.select("building_id", "lv_group").distinct()), "+v AS (SELECT DISTINCT building_id, cluster_id, lv_group FROM s) SELECT (SELECT count(*) FROM (SELECT cluster_id FROM v GROUP BY 1 HAVING count(DISTINCT lv_group) > 1)) AS lv_violations, (SELECT count(*) FROM (SELECT cluster_id FROM v GROUP BY 1 HAVING count(*) NOT BETWEEN 3 AND 20)) AS size_violations, (SELECT count(*) FROM (SELECT lv_group FROM v GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1)) AS split_groups")
_add("x30_spatial_compactness", "s", lambda s: co.spatial_compactness(_NODES(s), s.select("building_id", "cluster_id").distinct()), "+v AS (SELECT DISTINCT building_id, cluster_id, building_id % 30 * 20.0 AS x, building_id % 7 * 25.0 AS y FROM s), pd AS (SELECT a.cluster_id, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM v a JOIN v b ON a.cluster_id = b.cluster_id AND a.building_id < b.building_id GROUP BY 1) SELECT cluster_id, count(*) AS buildings, r(avg(x)) AS cx, r(avg(y)) AS cy, r(coalesce(max(d), 0)) AS distance, r(greatest(0, 1 - coalesce(max(d), 0) / 500)) AS compactness, r(1 / (1 + coalesce(max(d), 0) / 100)) AS nearness FROM v LEFT JOIN pd USING (cluster_id) GROUP BY 1")
_CEN = lambda s: s.groupBy("cluster_id", F.hour("ts").alias("hour")).agg(F.avg(F.col("demand") - F.col("generation")).alias("net"))
_add("x32_reassignment", "s", lambda s: co.temporal_reassignment(s, _CEN(s)), "+ce AS (SELECT cluster_id, hour(ts) AS hour, avg(demand - generation) AS net FROM s GROUP BY ALL), bl AS (SELECT building_id, hour(ts) AS hour, avg(demand - generation) AS load FROM s GROUP BY ALL) SELECT building_id, hour::int AS hour, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY building_id, hour ORDER BY round(abs(load - net), 9), cluster_id) AS n FROM bl JOIN ce USING (hour)) WHERE n = 1")
_METRICS = lambda s: pr.energy_metrics(s).select("cluster_id", F.col("self_sufficiency").alias("score"))


def _cards(s: DataFrame) -> DataFrame:
    m = pr.energy_metrics(s).join(pr.peak_metrics(s), "cluster_id").join(pr.load_diversity(s), "cluster_id").select("cluster_id", "self_sufficiency", "self_consumption", "peak_reduction", F.col("diversity").alias("load_diversity"), "diversity", F.lit(0.5).alias("complementarity"), F.lit(0.9).alias("fairness"), F.lit(1).alias("violations"), F.lit(1).alias("lv_violations"), F.lit(0).alias("size_violations"))
    m = co.scorecard(co.enhanced_quality(co.quality_label(co.overall_score(m), F.lit(10))))
    return m.select("cluster_id", "overall", "score", "quality", "confidence", "enhanced", "enhanced_class", "card", "strengths")


_CARD = f"+em AS (SELECT cluster_id, sum(least(demand, generation)) / sum(demand) AS ss, CASE WHEN sum(generation) <> 0 THEN sum(least(demand, generation)) / sum(generation) END AS sc FROM ({_SLOT.format('cluster_id')}) GROUP BY 1), ow AS (SELECT cluster_id, building_id, date_trunc('hour', ts) AS slot, sum(demand) AS d FROM s GROUP BY ALL), pk AS (SELECT cluster_id, 1 - (SELECT max(d) FROM (SELECT sum(d) AS d FROM ow y WHERE y.cluster_id = x.cluster_id GROUP BY slot)) / sum(p) AS pr FROM (SELECT cluster_id, building_id, max(d) AS p FROM ow GROUP BY ALL) x GROUP BY 1), ld AS (SELECT cluster_id, count(DISTINCT h)::double / count(*) AS ld FROM (SELECT cluster_id, building_id, arg_min(h, -m * 1e6 + h) AS h FROM (SELECT cluster_id, building_id, hour(ts) AS h, avg(demand) AS m FROM s GROUP BY ALL) GROUP BY ALL) GROUP BY 1), al AS (SELECT *, (ss * 0.3 + 0.15 + pr * 0.2 + ld * 0.05) / 0.85 AS q, (ss + pr + ld) / 3 AS mm, least((ss * 0.2 + 0.1 + pr * 0.15 + sc * 0.1 + ld * 0.1) * 100, 100) AS en FROM em JOIN pk USING (cluster_id) JOIN ld USING (cluster_id)) "
_add("x26_x27_cluster_scores", "s", _cards, _CARD + "SELECT cluster_id, r(q * 0.1) AS overall, r(q) AS score, CASE WHEN q >= 0.8 THEN 'excellent' WHEN q >= 0.6 THEN 'good' WHEN q >= 0.4 THEN 'fair' ELSE 'poor' END AS quality, r(least(0.7 * least(1, 0.7 + 10 / 28) + 0.3 * CASE WHEN mm > 0.8 OR mm < 0.2 THEN 0.9 ELSE 0.7 END, 0.95)) AS confidence, r(en) AS enhanced, CASE WHEN en >= 80 THEN 'excellent' WHEN en >= 60 THEN 'good' WHEN en >= 40 THEN 'fair' ELSE 'poor' END AS enhanced_class, r(pr * 0.25 + ss * 0.25 + 0.1 + 0.09 + ld * 0.05 + 0.075) AS card, concat_ws(', ', CASE WHEN pr > 0.15 THEN 'High peak reduction' END, CASE WHEN ss > 0.3 THEN 'Good self-sufficiency' END, 'Fair benefit distribution') AS strengths FROM al")
_add("x18_opportunities", "s", lambda s: pr.opportunities(pr.energy_metrics(s).join(pr.peak_metrics(s), "cluster_id").select("cluster_id", "self_sufficiency", F.lit(0.6).alias("complementarity"), "load_factor"), pr.energy_gaps(s)), f"+em AS (SELECT cluster_id, sum(least(demand, generation)) / sum(demand) AS ss, avg(demand) / max(demand) AS lf FROM ({_SLOT.format('cluster_id')}) GROUP BY 1), gp AS (SELECT cluster_id, hour(ts) AS hour, avg(demand) - avg(generation) AS net FROM s GROUP BY ALL HAVING avg(demand) - avg(generation) > 0) SELECT 'high_potential_cluster' AS kind, cluster_id, r(0.6 * (1 - ss)) AS priority FROM em WHERE ss < 0.3 UNION ALL SELECT * FROM (SELECT 'solar_opportunity', cluster_id, r(net) FROM gp WHERE hour BETWEEN 9 AND 16 ORDER BY net DESC, cluster_id, hour LIMIT 5) UNION ALL SELECT * FROM (SELECT 'storage_opportunity', cluster_id, r(net) FROM gp WHERE hour BETWEEN 17 AND 21 ORDER BY net DESC, cluster_id, hour LIMIT 3) UNION ALL SELECT 'load_management', cluster_id, r(1 - lf) FROM em WHERE lf < 0.4")
_add("j25_before_after", "s", lambda s: co.before_after(*(pr.energy_metrics(s.where(c)).agg(F.sum("demand").alias("demand"), F.sum("shared").alias("shared")).unpivot([], ["demand", "shared"], "metric", "value") for c in ("building_id % 2 = 0", "building_id % 2 = 1"))), f"+ba AS (SELECT p, sum(demand) AS demand, sum(least(demand, generation)) AS shared FROM (SELECT building_id % 2 AS p, cluster_id, date_trunc('hour', ts) AS slot, sum(demand) AS demand, sum(generation) AS generation FROM s GROUP BY ALL) GROUP BY 1), m2 AS (UNPIVOT ba ON demand, shared INTO NAME metric VALUE v) SELECT x.metric, r(x.v) AS before, r(y.v) AS after, r((y.v - x.v) / abs(x.v) * 100) AS change_pct FROM m2 x JOIN m2 y ON x.metric = y.metric AND x.p = 0 AND y.p = 1")

# ---- more of the graph
_add("gr16_conductance", "e", lambda e: gr.conductance(e, _CL(e)), _BOTH + ", k AS (SELECT src % 10 AS c, sum(CASE WHEN src % 10 <> dst % 10 THEN weight ELSE 0 END) AS cut, sum(weight) AS vol FROM u GROUP BY 1) SELECT c AS cluster_id, r(cut / least(vol, sum(vol) OVER () - vol)) AS conductance FROM k")
_add("gr16_disagreement", "e", lambda e: gr.disagreement(e, _CL(e), 40.0), "SELECT *, r((cut + kept) / edges) AS disagreement FROM (SELECT count_if(weight >= 40 AND src % 10 <> dst % 10)::bigint AS cut, count_if(weight < 40 AND src % 10 = dst % 10)::bigint AS kept, count(*) AS edges FROM e)")
_VAL2 = lambda e: gr.both_ways(e.select("src", "dst")).select(F.col("src").alias("node"), (F.col("src") % 17).cast("double").alias("value")).distinct()
_add("gr11_dissimilarity", "e", lambda e: gr.neighbour_dissimilarity(e, _VAL2(e)), _BOTH + "SELECT src AS node, r(avg(abs(src % 17 - dst % 17))) AS dissimilarity FROM (SELECT DISTINCT src, dst FROM u) GROUP BY 1")
_add("gr19_cascade_windows", "f", lambda f: gr.cascade_windows(f.select("ts", F.col("energy_kwh").alias("impact"))), "SELECT w AS \"window\", n AS installations, r(x) AS impact, r(sum(x) OVER (ORDER BY w)) AS cumulative FROM (SELECT w, count(*) AS n, sum(energy_kwh) AS x FROM (SELECT energy_kwh, floor(date_diff('day', (SELECT min(ts)::date FROM f), ts::date) / 365)::bigint AS w FROM f) GROUP BY w)")
_add("gr10_yearly_cascade", "f", lambda f: gr.yearly_cascade(f.select(F.col("to_id").alias("node"), (F.col("from_id") % 5).cast("int").alias("year"), F.col("energy_kwh").alias("impact")), 6), "+yy AS (SELECT from_id % 5 AS y, sum(energy_kwh) AS n FROM f GROUP BY 1), cu AS (SELECT t AS year, sum(n * pow(0.95, t - y)) AS c, coalesce(sum(n) FILTER (WHERE t = y), 0) AS n FROM yy JOIN (SELECT unnest(range(7)) AS t) ON t >= y AND t >= (SELECT min(y) FROM yy) GROUP BY 1) SELECT year::int AS year, r(c) AS cumulative, r(n) AS new, r((c - lag(c) OVER (ORDER BY year)) / lag(c) OVER (ORDER BY year)) AS growth FROM cu")
