"""Distance joins on planar points: cell keys turn radius predicates into equi-joins.

Every point goes to the square cell of side r that holds it; the probing side is copied to the 3 x 3 cells
around it, so all partners within r meet in one cell and an exact filter decides. Rows grow nine-fold,
never with the other side's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import _checkpoint, connected_components


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _cells(df: DataFrame, r: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("x") / r), "cy": F.floor(F.col("y") / r)})


def _around(df: DataFrame, r: float) -> DataFrame:
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return _cells(df, r).withColumn("o", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")


def within(left: DataFrame, right: DataFrame, r: float) -> DataFrame:
    """(id, x, y) x (id, x, y) -> (left_id, right_id, distance) of all pairs at most r apart."""
    a = _around(left.select(F.col("id").alias("left_id"), F.col("x"), F.col("y")), r).withColumnsRenamed({"x": "ax", "y": "ay"})
    b = _cells(right.select(F.col("id").alias("right_id"), F.col("x"), F.col("y")), r).withColumnsRenamed({"x": "bx", "y": "by"})
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    # No broadcast: the nine-fold side is larger than its source's size tells.
    return a.hint("merge").join(b, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= r).select("left_id", "right_id", "distance")


def _places(points: DataFrame) -> DataFrame:
    """(id, x, y) of each place that has points, named by its smallest id; points without finite coordinates are nowhere."""
    somewhere = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return points.where(somewhere).groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y")


def knn_within(left: DataFrame, right: DataFrame, r: float, k: int) -> DataFrame:
    """The k nearest right points within r of each left point (ties: smaller id), with their rank.

    Places are compared, not points: each left place once, with the k smallest ids of each right place.
    """
    few = right.withColumn("_n", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("_n") <= k)
    rank = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("left_id").orderBy("distance", "right_id"))).where(F.col("rank") <= k)
    places = _checkpoint(_places(left))
    near = rank(within(places, few, r)).drop("rank").join(places.withColumnRenamed("id", "left_id"), "left_id").drop("left_id")
    return rank(left.select(F.col("id").alias("left_id"), "x", "y").join(near, ["x", "y"]).select("left_id", "right_id", "distance"))


def snap_pairs(points: DataFrame, r: float) -> DataFrame:
    """Pairs left_id < right_id of one table at most r apart."""
    pairs = within(points, points, r).where("left_id < right_id").select("left_id", "right_id")
    once = points.groupBy("id").count().where("count > 1").isEmpty()
    return pairs if once else pairs.distinct()  # only a repeated id can repeat a pair


def snapped_groups(points: DataFrame, r: float) -> DataFrame:
    """(id, group_id) of all points; a group is what snapping at r connects, named by its smallest id.

    Points of one place are linked to its smallest id, and only places are compared.
    """
    places = _checkpoint(_places(points))
    here = points.join(places.withColumnRenamed("id", "left_id"), ["x", "y"]).select("left_id", F.col("id").alias("right_id")).where("left_id < right_id")
    found = connected_components(snap_pairs(places, r).unionByName(here), "left_id", "right_id")
    return points.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def match_confidence(d: Column, bands: list[tuple[float, float]], beyond: float = 0.2) -> Column:
    """The score of the first (limit, score) band that a distance falls in."""
    out = F.lit(beyond)
    for limit, score in reversed(bands):
        out = F.when(d <= limit, score).otherwise(out)
    return out


def group_extent(points: DataFrame) -> DataFrame:
    """Count, bounding box and centroid of each group of (group_id, x, y)."""
    return points.groupBy("group_id").agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def clip(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def best_parent(links: DataFrame) -> DataFrame:
    """One parent per child over a shared station: highest average confidence, then shortest, then smallest id."""
    c = links.where("level = 'LV'").select("station", F.col("group_id").alias("child"), F.col("distance").alias("cd"), F.col("confidence").alias("cc"))
    p = links.where("level = 'MV'").select("station", F.col("group_id").alias("parent"), F.col("distance").alias("pd"), F.col("confidence").alias("pc"))
    j = c.join(p, "station").select("child", "parent", "station", ((F.col("cc") + F.col("pc")) / 2).alias("confidence"), (F.col("cd") + F.col("pd")).alias("distance"))
    w = Window.partitionBy("child").orderBy(F.desc("confidence"), "distance", "parent", "station")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def wkt_points(df: DataFrame, column: str) -> DataFrame:
    """x and y of POINT text."""
    pattern = r"(?i)POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)"
    return df.withColumns({"x": F.regexp_extract(column, pattern, 1).try_cast("double"), "y": F.regexp_extract(column, pattern, 2).try_cast("double")})
