"""Voltage levels and the stations between them.

links: group_id, voltage_level, station_type, station_fid, distance_m, confidence_score. Everything joins on the station.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import geometry as ge
from .components import _checkpoint


def _of(links: DataFrame, level: str, station: str) -> DataFrame:
    return links.where((F.col("voltage_level") == level) & (F.col("station_type") == station))


def _candidates(p: DataFrame, c: DataFrame) -> DataFrame:
    """The parents of a station that can be a child's best: those as sure as the surest and, among equally sure ones, as near as the nearest.

    Sums keep the order of their terms, but rounding can make unlike sums equal, so all within a few units of the last
    place stay. Children with a confidence or distance that does not compare (null, NaN) are left to the whole list.
    """
    size = c.groupBy("station_fid").agg(F.max(F.abs("cc")).alias("most_c"), F.max(F.abs("cd")).alias("most_d"))
    one = p.groupBy("station_fid", "pc", "pd").agg(F.min("parent_group_id").alias("parent_group_id"))
    top = one.groupBy("station_fid").agg(F.max("pc").alias("top"))
    margin = lambda a, b: 1e-15 * (F.abs(a) + F.abs(b))
    sure = one.join(size, "station_fid").join(top, "station_fid").where(F.col("pc") >= F.col("top") - margin(F.col("top"), F.col("most_c")))
    near = sure.groupBy("station_fid", "pc").agg(F.min("pd").alias("near"))
    return sure.join(near, ["station_fid", "pc"]).where(F.col("pd") <= F.col("near") + margin(F.col("near"), F.col("most_d"))).select("station_fid", "parent_group_id", "pd", "pc")


def via_station_parent(links: DataFrame, child: str, parent: str, station: str) -> DataFrame:
    """The one parent of every child group over a shared station: highest mean confidence, then shortest, then smallest ids.

    Only the few parents of a station that can be best meet its children, so rows grow with the links and not with their pairs.
    """
    links = _checkpoint(links.where((F.col("station_type") == station) & F.col("voltage_level").isin(child, parent)))
    c = _of(links, child, station).select("station_fid", F.col("group_id").alias("child_group_id"), F.col("distance_m").alias("cd"), F.col("confidence_score").alias("cc"))
    p = _of(links, parent, station).select("station_fid", F.col("group_id").alias("parent_group_id"), F.col("distance_m").alias("pd"), F.col("confidence_score").alias("pc"))
    plain = lambda *names: reduce(Column.__and__, (F.col(n).isNotNull() & ~F.isnan(n) for n in names))
    odd = p.where(~plain("pd", "pc"))  # null or NaN: kept whole
    few = _candidates(p.where(plain("pd", "pc")), c.where(plain("cd", "cc"))).unionByName(odd)
    match = c.where(plain("cd", "cc")).join(few, "station_fid").unionByName(c.where(~plain("cd", "cc")).join(p, "station_fid"))
    j = match.select("child_group_id", F.struct((-(F.col("cc") + F.col("pc")) / 2).alias("c"), (F.col("cd") + F.col("pd")).alias("d"), "parent_group_id", "station_fid").alias("m"))
    best = _checkpoint(j.groupBy("child_group_id").agg(F.min("m").alias("m")))  # one row a child, read again by each level
    return best.select("child_group_id", F.lit(child).alias("child_voltage"), "m.parent_group_id", F.lit(parent).alias("parent_voltage"), F.lit(station).alias("connection_via"), F.col("m.station_fid").alias("via_station_fid"), F.col("m.d").alias("distance_m"), (-F.col("m.c")).alias("confidence_score"))


def group_hierarchy(links: DataFrame) -> DataFrame:
    """LV groups under MV groups under HV groups, with the path as text."""
    lv, mv = via_station_parent(links, "LV", "MV", "TRANSFORMER"), via_station_parent(links, "MV", "HV", "SUBSTATION")
    arrow = F.lit(" -> ")
    mv = mv.withColumn("hierarchy_path", F.concat("parent_group_id", arrow, "child_group_id"))
    up = mv.select(F.col("child_group_id").alias("parent_group_id"), F.col("hierarchy_path").alias("above"))
    lv = lv.join(up, "parent_group_id", "left").withColumn("hierarchy_path", F.concat(F.coalesce("above", "parent_group_id"), arrow, "child_group_id")).drop("above")
    return mv.unionByName(lv)


def hierarchy_tree(groups: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(level, voltage_level, group_id, parent_group, path) from the HV groups without a parent down; three levels, hence two joins."""
    roots = groups.where("voltage_level = 'HV'").join(hierarchy.select(F.col("child_group_id").alias("group_id")), "group_id", "left_anti")
    tree = level = roots.select(F.lit(0).alias("level"), "voltage_level", "group_id", F.lit(None).cast("string").alias("parent_group"), F.col("group_id").alias("path"))
    for n in (1, 2):
        above = level.select(F.col("group_id").alias("parent_group_id"), F.col("path").alias("above"))
        level = hierarchy.join(above, "parent_group_id").select(F.lit(n).alias("level"), F.col("child_voltage").alias("voltage_level"), F.col("child_group_id").alias("group_id"), F.col("parent_group_id").alias("parent_group"), F.concat("above", F.lit(" -> "), "child_group_id").alias("path"))
        tree = tree.unionByName(level)
    return tree


def roots_and_orphans(groups: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(group_id, voltage_level, kind): HV groups without a parent are roots, others orphans."""
    alone = groups.join(hierarchy.select(F.col("child_group_id").alias("group_id")), "group_id", "left_anti")
    return alone.select("group_id", "voltage_level", F.when(F.col("voltage_level") == "HV", "root").otherwise("orphan").alias("kind"))


def mv_lv_mapping(links: DataFrame) -> DataFrame:
    """(mv_station_id, mv_group_id, lv_group_id): groups that share a transformer."""
    mv, lv = _of(links, "MV", "TRANSFORMER"), _of(links, "LV", "TRANSFORMER")
    side = lambda df, name: df.select(F.col("station_fid").alias("mv_station_id"), F.col("group_id").alias(name)).distinct()
    return side(mv, "mv_group_id").join(side(lv, "lv_group_id"), "mv_station_id")  # distinct sides: no shuffle of the pairs


def voltage_transitions(links: DataFrame, low: str, high: str, station: str) -> DataFrame:
    """Stations with the groups on each side; both sides are aggregated before they meet."""
    side = lambda level, name: _of(links, level, station).groupBy("station_fid").agg(F.array_sort(F.collect_set("group_id")).alias(name))
    return side(low, "from_groups").join(side(high, "to_groups"), "station_fid", "full").select(F.lit(low).alias("from_voltage"), F.lit(high).alias("to_voltage"), F.lit(station).alias("transition_type"), "station_fid", "from_groups", "to_groups")


def station_link_summary(links: DataFrame) -> DataFrame:
    return links.groupBy("voltage_level", "station_type").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("links"), F.avg("distance_m").alias("avg_distance"), F.avg("confidence_score").alias("avg_confidence"))


def with_length(segments: DataFrame) -> DataFrame:
    return segments.withColumn("length_m", ge.length(F.col("geom")))


def segment_groups(segments: DataFrame) -> DataFrame:
    """Count, length, distinct cables, bounding box (widened by 0.1 where it has no area) and length-weighted centre of each group."""
    e, c = ge.envelope(F.col("geom")), ge.centroid(F.col("geom"))
    s = with_length(segments).select("group_id", "voltage_level", "original_fid", "length_m", "geom", e.alias("e"), c.alias("c"))
    g = s.groupBy("group_id", "voltage_level").agg(
        F.count("*").alias("segments"), F.sum("length_m").alias("length_m"), F.count_distinct("original_fid").alias("cables"), F.min("e.xmin").alias("xmin"), F.min("e.ymin").alias("ymin"), F.max("e.xmax").alias("xmax"), F.max("e.ymax").alias("ymax"),
        F.try_divide(F.sum(F.col("c.x") * F.col("length_m")), F.sum("length_m")).alias("cx"), F.try_divide(F.sum(F.col("c.y") * F.col("length_m")), F.sum("length_m")).alias("cy"),
    )
    flat: Column = (F.col("xmin") == F.col("xmax")) | (F.col("ymin") == F.col("ymax"))
    pad = F.when(flat, 0.1).otherwise(0.0)
    return g.withColumns({"xmin": F.col("xmin") - pad, "ymin": F.col("ymin") - pad, "xmax": F.col("xmax") + pad, "ymax": F.col("ymax") + pad})


def voltage_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("voltage_level").agg(F.count_distinct("group_id").alias("groups"), F.sum("segments").alias("segments"), F.avg("length_m").alias("avg_length"), F.sum("length_m").alias("length_m"))


def longest_groups(groups: DataFrame, n: int = 5) -> DataFrame:
    return groups.select("group_id", "voltage_level", "segments", "length_m").orderBy(F.desc("length_m"), "group_id", "voltage_level").limit(n)


def segment_order(segments: DataFrame) -> DataFrame:
    return segments.select("segment_id", "group_id", "voltage_level", F.row_number().over(Window.partitionBy("group_id", "voltage_level").orderBy("segment_id")).alias("position"))


def endpoints(segments: DataFrame) -> DataFrame:
    """(segment_id, voltage_level, point_type, x, y): START and END of each segment."""
    ends = F.array(F.struct(F.lit("START").alias("t"), ge.start_point(F.col("geom")).alias("p")), F.struct(F.lit("END").alias("t"), ge.end_point(F.col("geom")).alias("p")))
    return segments.select("segment_id", "voltage_level", F.explode(ends).alias("e")).select("segment_id", "voltage_level", F.col("e.t").alias("point_type"), "e.p.x", "e.p.y")


def supply_chain(hierarchy: DataFrame, connections: DataFrame) -> DataFrame:
    """(mv_group, transformer, lv_group, building_id): the whole path of each building."""
    lv = hierarchy.where("child_voltage = 'LV'").select(F.col("child_group_id").alias("lv_group"), F.col("parent_group_id").alias("mv_group"), F.col("via_station_fid").alias("transformer"))
    return connections.select("building_id", "lv_group").join(lv, "lv_group").select("mv_group", "transformer", "lv_group", "building_id")


def hierarchy_stats(chain: DataFrame) -> DataFrame:
    """LV groups, transformers and buildings per MV group."""
    g = chain.groupBy("mv_group", "transformer", "lv_group").agg(F.count("*").alias("k"))
    return g.groupBy("mv_group").agg(F.count_distinct("lv_group").alias("lv_groups"), F.size(F.collect_set("transformer")).alias("transformers"), F.sum("k").alias("buildings"))


def reachability(edges: DataFrame, sources: DataFrame, hops: int = 3) -> DataFrame:
    """(source, node, path_length): nodes at the end of a directed path of 1 to ``hops`` edges; each by its shortest."""
    at = sources.select(F.col("node").alias("source"), "node")
    found = None
    for n in range(1, hops + 1):
        at = at.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("source", F.col("dst").alias("node")).distinct()
        one = at.withColumn("path_length", F.lit(n))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("source", "node").agg(F.min("path_length").alias("path_length"))
