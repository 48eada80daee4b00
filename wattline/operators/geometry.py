"""Planar geometry as Column expressions: a point is struct<x, y>, a line or ring an array of points.

No row functions: everything is built from array functions, so it stays in the JVM and fuses with the joins around it.
A ring need not repeat its first point. Nulls give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def planar(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def parse_wkt(text: Column) -> tuple[Column, Column]:
    """(kind, points) of POINT, LINESTRING and POLYGON text; of a polygon the outer ring; else nulls."""
    kind = F.upper(F.regexp_extract(text, r"(?i)^\s*(POINT|LINESTRING|POLYGON)\b", 1))
    body = F.regexp_extract(text, r"\(\(?([^()]*)\)", 1)
    pairs = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda s: F.split(F.trim(s), r"\s+"))
    points = F.transform(pairs, lambda v: point(F.get(v, F.lit(0)).try_cast("double"), F.get(v, F.lit(1)).try_cast("double")))
    known = kind != ""
    return F.when(known, kind), F.when(known, points)


def steps(line: Column) -> Column:
    """Its segments: an array of struct<a, b>."""
    return F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges(ring: Column) -> Column:
    return steps(F.concat(ring, F.slice(ring, 1, 1)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def length(line: Column) -> Column:
    return _sum(F.transform(steps(line), lambda s: planar(s["a"], s["b"])))


def start_point(line: Column) -> Column:
    return F.element_at(line, 1)


def end_point(line: Column) -> Column:
    return F.element_at(line, -1)


def _along(s: Column, p: Column) -> Column:
    """The share of segment s at which its point closest to p lies."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    t = F.try_divide((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy, dx * dx + dy * dy)
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def _at(s: Column, t: Column) -> Column:
    return point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))


def segment_distance(s: Column, p: Column) -> Column:
    return planar(_at(s, _along(s, p)), p)


def distance(line: Column, p: Column) -> Column:
    return F.array_min(F.transform(steps(line), lambda s: segment_distance(s, p)))


def locate(line: Column, p: Column) -> Column:
    """struct<d, i, t, p>: distance, segment, share of it and the point of the line closest to p (ties: the first)."""
    return F.array_min(F.transform(steps(line), lambda s, i: F.struct(segment_distance(s, p).alias("d"), i.alias("i"), _along(s, p).alias("t"), _at(s, _along(s, p)).alias("p"))))


def closest_point(line: Column, p: Column) -> Column:
    return locate(line, p)["p"]


def along(line: Column, p: Column) -> Column:
    """Metres along the line to its point closest to p."""
    at = locate(line, p)
    before = _sum(F.transform(F.slice(steps(line), F.lit(1), at["i"]), lambda s: planar(s["a"], s["b"])))
    here = F.element_at(steps(line), at["i"] + 1)
    return before + at["t"] * planar(here["a"], here["b"])


def fraction(line: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(along(line, p), length(line)), F.lit(0.0))


def connector(line: Column, p: Column) -> Column:
    return F.array(p, closest_point(line, p))


def point_in_polygon(ring: Column, p: Column) -> Column:
    """Ray casting: an odd number of edges cross the ray to the right."""
    crosses = lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _meets(s: Column, e: Column) -> Column:
    """Whether two segments have a point in common."""
    on = lambda a, b, p: (_side(a, b, p) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    a, b, c, d = s["a"], s["b"], e["a"], e["b"]
    proper = (F.signum(_side(a, b, c)) * F.signum(_side(a, b, d)) < 0) & (F.signum(_side(c, d, a)) * F.signum(_side(c, d, b)) < 0)
    return proper | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def line_intersects_polygon(line: Column, ring: Column) -> Column:
    return F.exists(line, lambda p: point_in_polygon(ring, p)) | F.exists(steps(line), lambda s: F.exists(edges(ring), lambda e: _meets(s, e)))


def _cuts(s: Column, ring: Column) -> Column:
    """The shares of segment s at which it meets the ring's edges, with 0 and 1, in order."""
    def share(e: Column) -> Column:
        p, q = _side(e["a"], e["b"], s["a"]), _side(e["a"], e["b"], s["b"])
        return F.try_divide(p, p - q)

    inner = F.filter(F.transform(edges(ring), share), lambda t: (t > 0) & (t < 1))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))


def line_crosses_polygon(line: Column, ring: Column) -> Column:
    """Whether a part of the line of some length is inside and another outside."""
    middles = lambda s: F.zip_with(F.slice(_cuts(s, ring), F.lit(1), F.size(_cuts(s, ring)) - 1), F.slice(_cuts(s, ring), F.lit(2), F.size(_cuts(s, ring)) - 1), lambda t, u: _at(s, (t + u) / 2))
    parts = F.flatten(F.transform(steps(line), middles))
    return F.exists(parts, lambda p: point_in_polygon(ring, p)) & F.exists(parts, lambda p: ~point_in_polygon(ring, p))


def envelope(line: Column, buffer: float = 0.0) -> Column:
    """struct<xmin, ymin, xmax, ymax>; one without area is widened by ``buffer``."""
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    lo, hi = (F.array_min(x), F.array_min(y)), (F.array_max(x), F.array_max(y))
    pad = F.when((lo[0] == hi[0]) | (lo[1] == hi[1]), buffer).otherwise(0.0)
    return F.struct((lo[0] - pad).alias("xmin"), (lo[1] - pad).alias("ymin"), (hi[0] + pad).alias("xmax"), (hi[1] + pad).alias("ymax"))


def centroid(line: Column) -> Column:
    """The middle of a line, weighted by length; of a line without length its first point."""
    total = length(line)
    mean = lambda f: _sum(F.transform(steps(line), lambda s: planar(s["a"], s["b"]) * (f(s["a"]) + f(s["b"])) / 2)) / total
    return F.when(total > 0, point(mean(lambda p: p["x"]), mean(lambda p: p["y"]))).otherwise(start_point(line))


def _window(s: Column, box: Box) -> tuple[Column, Column]:
    """The shares between which segment s is in the box (first > last: nowhere)."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for axis, least, most in (("x", box[0], box[2]), ("y", box[1], box[3])):
        a, d = s["a"][axis], s["b"][axis] - s["a"][axis]
        t, u = (least - a) / F.when(d != 0, d), (most - a) / F.when(d != 0, d)
        inside = a.between(least, most)
        lo = F.greatest(lo, F.coalesce(F.least(t, u), F.when(inside, F.lit(0.0)).otherwise(2.0)))
        hi = F.least(hi, F.coalesce(F.greatest(t, u), F.when(inside, F.lit(1.0)).otherwise(-1.0)))
    return lo, hi


def clip_steps(line: Column, box: Box) -> Column:
    """The parts of the line's segments that are in the box, of some length: an array of struct<a, b>."""
    def cut(s: Column) -> Column:
        lo, hi = _window(s, box)
        return F.when(lo < hi, F.struct(_at(s, lo).alias("a"), _at(s, hi).alias("b")))

    return F.filter(F.transform(steps(line), cut), lambda s: s.isNotNull())


def dump_lines(df: DataFrame, geom: str = "geom", least: float = 0.01) -> DataFrame:
    """A row per line of a multi-line column, numbered, without those no longer than ``least``."""
    rest = [c for c in df.columns if c != geom]
    return df.select(*rest, F.posexplode(geom).alias("part", geom)).where(length(F.col(geom)) > least)


def clip(df: DataFrame, box: Box, geom: str = "geom") -> DataFrame:
    """Features that meet the box, cut to it: geom becomes an array of the segments left."""
    e = envelope(F.col(geom))
    near = (e["xmin"] <= box[2]) & (e["xmax"] >= box[0]) & (e["ymin"] <= box[3]) & (e["ymax"] >= box[1])
    return df.where(near).withColumn(geom, clip_steps(F.col(geom), box)).where(F.size(geom) > 0)


def mapped(df: DataFrame, name: str, make: Callable[[Column], Column], geom: str = "geom") -> DataFrame:
    return df.withColumn(name, make(F.col(geom)))
