"""Buildings and the cable segments that serve them.

segments: segment_id, voltage_level, group_id, geom (line). footprints: building_id, area, function, geom (ring), and x, y, the
point that distances are taken from. A segment is copied to the cells of side r that it passes or comes close to, so every
segment within r meets a building in one cell. Segments of one shape meet it once. A cell is searched inside its task, in
squares that are quartered down to the smallest of the radii, so neither copies nor stored pairs grow with the density.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as ge
from .components import _checkpoint

LV_RADIUS, MV_RADIUS, FAR, MV_AREA, BROAD = 500.0, 100.0, 150.0, 3000.0, 1000.0


PER_CELL, HALVINGS = 16, 8
TASKS = 96  # over which cells are dealt: what is done in one outgrows what is shuffled
CROWD = 20_000  # buildings of a cell that are searched together
BLOCK = 20_000  # distances of a square that are compared without quartering it


def _cells(parts: DataFrame, r: float, around: int = 0) -> DataFrame:
    """Every part (a, b) once for each cell that its envelope touches, or that is at most ``around`` cells from those."""
    span = lambda v: F.explode(F.sequence(F.floor(F.least(f"a.{v}", f"b.{v}") / r) - around, F.floor(F.greatest(f"a.{v}", f"b.{v}") / r) + around))
    return parts.withColumn("cx", span("x")).withColumn("cy", span("y"))


def _radii(parts: DataFrame, r: float) -> list[float]:
    """r and, before it, its halves down to where about PER_CELL parts share a cell."""
    n, cells = _cells(parts, r).agg(F.count("*"), F.count_distinct("cx", "cy")).first()
    k = next((k for k in range(HALVINGS) if n <= PER_CELL * 2**k * cells), HALVINGS)  # parts are lines: half as many in half a cell
    return [r / 2**i for i in range(k, -1, -1)]


def _likely(r: float, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a cell's buildings (x, y) and parts (ax, ay, bx, by): every building with each part that can be its nearest within r.

    A part stays with a square of buildings if its distance from the centre leaves that open for some place in the square.
    """

    def pairs(homes: pa.Table, parts: pa.Table) -> pa.Table:
        x, y = (homes.column(c).to_numpy() for c in ("x", "y"))
        ax, ay, bx, by = (parts.column(c).to_numpy() for c in ("ax", "ay", "bx", "by"))
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        size = np.where(size > 0, size, 1.0)

        def away(px: np.ndarray | float, py: np.ndarray | float, of: np.ndarray) -> np.ndarray:
            t = np.clip(((px - ax[of]) * dx[of] + (py - ay[of]) * dy[of]) / size[of], 0.0, 1.0)
            return np.hypot(ax[of] + t * dx[of] - px, ay[of] + t * dy[of] - py)

        of_home, of_part = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        squares = []
        if len(x) and len(ax):
            spare = 1e-9 * max(1.0, *(np.abs(v).max() for v in (x, y, ax, ay, bx, by)))  # more than rounding can change a distance
            squares.append((np.arange(len(x)), np.arange(len(ax)), x.min(), y.min(), max(np.ptp(x), np.ptp(y))))
        while squares:
            mine, near, left, low, side = squares.pop()
            d = away(left + side / 2, low + side / 2, near)
            near = near[d <= min(d.min() + side * 2**0.5, r + side / 2**0.5) + spare]
            if len(near) and (side <= least or len(mine) * len(near) <= BLOCK):
                rows = max(1, BLOCK // len(near))
                for some in (mine[i : i + rows] for i in range(0, len(mine), rows)):
                    d = away(x[some, None], y[some, None], near)
                    i, j = np.nonzero(d <= np.minimum(d.min(axis=1, keepdims=True), r) + spare)
                    of_home.append(some[i])
                    of_part.append(near[j])
            elif len(near):
                half = side / 2
                quarter = 2 * (x[mine] >= left + half) + (y[mine] >= low + half)
                squares += [(m, near, left + half * (q // 2), low + half * (q % 2), half) for q in range(4) if len(m := mine[quarter == q])]
        found = homes.select(["building_id", "x", "y"]).take(pa.array(np.concatenate(of_home)))
        for name, column in zip((c := ["segment_id", "ax", "ay", "bx", "by"]), parts.select(c).take(pa.array(np.concatenate(of_part))).columns):
            found = found.append_column(name, column)
        return found

    return pairs


def nearest_segment(footprints: DataFrame, segments: DataFrame, r: float) -> DataFrame:
    """(building_id, segment_id, distance): the nearest segment within r of each building (ties: smaller id)."""
    finite = lambda *names: reduce(Column.__and__, (F.abs(n) < float("inf") for n in names))  # noqa: E731  nor null
    s = segments.select("segment_id", F.explode(ge.steps(F.col("geom"))).alias("s")).select("segment_id", "s.a", "s.b").where(finite("a.x", "a.y", "b.x", "b.y"))
    parts = _checkpoint(s.groupBy("a", "b").agg(F.min("segment_id").alias("segment_id")))  # of one shape the smallest id is nearest
    homes = footprints.where(finite("x", "y")).select("building_id", "x", "y", F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy"))
    key = ["cx", "cy", "share"]
    shares = homes.groupBy("cx", "cy").agg(F.ceil(F.count("*") / CROWD).alias("shares"))
    homes = homes.join(shares, ["cx", "cy"]).select("building_id", "x", "y", "cx", "cy", F.pmod(F.xxhash64("building_id"), "shares").alias("share"))
    centre = ge.point((F.col("cx") + 0.5) * r, (F.col("cy") + 0.5) * r)
    close = _cells(parts, r, 1).where(ge.segment_distance(F.struct("a", "b"), centre) < 1.71 * r)  # r and half a cell's diagonal
    close = close.join(shares, ["cx", "cy"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    close = close.select("segment_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), *key)
    kinds = {f.name: f.dataType.simpleString() for f in homes.schema.fields} | {f.name: f.dataType.simpleString() for f in close.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("building_id", "x", "y", "segment_id", "ax", "ay", "bx", "by"))
    dealt = homes.repartition(TASKS, *key).groupBy(*key).cogroup(close.repartition(TASKS, *key).groupBy(*key))
    few = dealt.applyInArrow(_likely(r, _radii(parts, r)[0]), schema)
    d = few.select("building_id", "segment_id", ge.segment_distance(F.struct(ge.point(F.col("ax"), F.col("ay")).alias("a"), ge.point(F.col("bx"), F.col("by")).alias("b")), ge.point(F.col("x"), F.col("y"))).alias("distance"))
    best = d.where(F.col("distance") <= r).groupBy("building_id").agg(F.min(F.struct("distance", "segment_id")).alias("m"))
    return _checkpoint(best).select("building_id", "m.segment_id", "m.distance")


def connection_type(line: Column, ring: Column, distance: Column, far: float = FAR) -> Column:
    """How a cable reaches a building: the first rule that fits."""
    ends = ge.point_in_polygon(ring, ge.start_point(line)) | ge.point_in_polygon(ring, ge.end_point(line))
    return F.when(ends, "ENDED").when(ge.line_crosses_polygon(line, ring), "CROSSED").when(ge.line_intersects_polygon(line, ring), "ENTERED").when(distance > far, "TOO_FAR").otherwise("BY_DISTANCE")


def building_connections(footprints: DataFrame, segments: DataFrame, lv_radius: float = LV_RADIUS, mv_radius: float = MV_RADIUS, mv_area: float = MV_AREA, far: float = FAR) -> DataFrame:
    """Every building with an LV cable near it: class, MV capability and the reason as text."""
    f = footprints.withColumn("is_mv_capable", (F.col("function") == "non_residential") & (F.col("area") > mv_area))
    lv = nearest_segment(f, segments.where("voltage_level = 'LV'"), lv_radius)
    mv = nearest_segment(f.where("is_mv_capable"), segments.where("voltage_level = 'MV'"), mv_radius).select("building_id", F.col("segment_id").alias("nearest_mv_segment_id"), F.col("distance").alias("nearest_mv_distance_m"))
    j = f.join(lv.where(F.col("distance") < BROAD), "building_id").join(segments.select("segment_id", "group_id", F.col("geom").alias("line")), "segment_id")
    j = j.withColumn("connection_type", connection_type(F.col("line"), F.col("geom"), F.col("distance"), far)).join(mv, "building_id", "left")
    m = lambda c: F.concat(F.round(c, 0).cast("bigint").cast("string"), F.lit("m"))
    near, capable = F.col("nearest_mv_distance_m").isNotNull(), F.col("is_mv_capable")
    reason = (
        F.when(F.col("connection_type") == "ENDED", "Cable endpoint in building").when(F.col("connection_type") == "ENTERED", "Cable enters building").when(F.col("connection_type") == "CROSSED", "Cable crosses through building")
        .when(F.col("connection_type") == "TOO_FAR", F.concat(F.lit(f"WARNING: Distance > {far:g}m ("), m(F.col("distance")), F.lit(")")))
        .when(capable & near, F.concat(F.lit("LV connection (MV-capable, MV available at "), m(F.col("nearest_mv_distance_m")), F.lit(")"))).when(capable, "LV connection (MV-capable, no MV nearby)")
        .when(F.col("function") == "residential", "Residential - Standard LV").otherwise(F.concat(F.lit("Standard LV connection at "), m(F.col("distance"))))
    )
    return j.select("building_id", "area", "function", "segment_id", "group_id", F.col("distance").alias("distance_m"), "connection_type", "is_mv_capable", near.alias("has_mv_nearby"), "nearest_mv_segment_id", "nearest_mv_distance_m", (F.col("connection_type") == "TOO_FAR").alias("is_problematic"), reason.alias("reason"), "x", "y")


def connection_points(connections: DataFrame, segments: DataFrame) -> DataFrame:
    """Where each building meets its segment: the closest point, metres and share along the segment."""
    p = ge.point(F.col("x"), F.col("y"))
    j = connections.join(segments.select("segment_id", F.col("geom").alias("line")), "segment_id")
    at = ge.closest_point(F.col("line"), p)
    return j.select("building_id", "segment_id", at["x"].alias("px"), at["y"].alias("py"), ge.along(F.col("line"), p).alias("along_m"), ge.fraction(F.col("line"), p).alias("fraction"), F.col("connection_type").isin("ENDED", "ENTERED", "CROSSED").alias("is_direct"))


def segment_stats(connections: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts and distances of every segment's buildings; segments without any have zeros and nulls."""
    kind = lambda k: F.count_if(F.col("connection_type") == k)
    g = connections.groupBy("segment_id").agg(
        F.count("*").alias("buildings"), F.count_if(F.col("function") == "residential").alias("residential"), F.count_if(F.col("function") == "non_residential").alias("non_residential"), F.count_if(F.col("is_mv_capable")).alias("mv_capable"),
        *(kind(k).alias(k.lower()) for k in ("ENDED", "ENTERED", "CROSSED", "BY_DISTANCE", "TOO_FAR")), F.avg("distance_m").alias("avg_distance"), F.max("distance_m").alias("max_distance"), F.min("distance_m").alias("min_distance"), F.bool_or("is_problematic").alias("has_problem"),
    )
    counts = ["buildings", "residential", "non_residential", "mv_capable", "ended", "entered", "crossed", "by_distance", "too_far"]
    return segments.select("segment_id", "group_id", "voltage_level").join(g, "segment_id", "left").fillna(0, counts)


def busiest_segments(stats: DataFrame, n: int = 5) -> DataFrame:
    return stats.where("buildings > 0").select("segment_id", "voltage_level", "buildings", "too_far").orderBy(F.desc("buildings"), "segment_id").limit(n)
