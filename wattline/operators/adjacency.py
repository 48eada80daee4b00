"""Buildings that share walls: pairs, edges, clusters, metrics.

walls: building_id, lv_group, x, y, north, east, south, west (shared lengths), function, housing_type, has_solar, solar_potential.
Pairs are looked for in one LV group and in 5 m cells, never over a whole group; all houses of a place face another place alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.building import adjacency_type
from .components import _checkpoint, connected_components

REACH, OFFSET, LEAST_MATCH = 5.0, 3.0, 0.5
CROWD = 1000  # houses of a place that are held together
TASKS = 96  # over which cells of places are dealt: their pairs outgrow what is shuffled
FACING = (("north", "south"), ("south", "north"), ("east", "west"), ("west", "east"))


def wall_counts(walls: DataFrame) -> DataFrame:
    sides = [F.col(c) for c in ("north", "east", "south", "west")]
    n = sum(((F.coalesce(c, F.lit(0)) > 0).cast("int") for c in sides), F.lit(0))
    return walls.withColumns({"shared_walls": n, "adjacency_type": adjacency_type(*(F.coalesce(c, F.lit(0)) for c in sides))})


def _houses(walls: DataFrame, place: list[str]) -> DataFrame:
    """(place, houses): the houses of each place as an array, those of a crowded place in several of about ``CROWD``."""
    rest = [c for c in walls.columns if c not in place]
    crowded = walls.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD)
    part = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("building_id"), F.ceil(F.col("_n") / CROWD))).otherwise(0)
    return walls.join(crowded, place, "left").groupBy(*place, part.alias("_part")).agg(F.collect_list(F.struct(*rest)).alias("houses")).drop("_part")


def adjacent_pairs(walls: DataFrame) -> DataFrame:
    """Pairs of one LV group whose facing walls match: the first facing that fits, of lengths at least half alike.

    Places are compared first, which settles distance and facing; only houses of places that face each other are paired.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    w = wall_counts(walls).where("shared_walls > 0").where(finite).select(*walls.columns)
    place = ["lv_group", "x", "y"]
    rest = [c for c in walls.columns if c not in place]
    houses = _checkpoint(_houses(w, place))
    near = _near_places(houses.withColumnRenamed("houses", "mine"), houses.withColumnsRenamed({"x": "their_x", "y": "their_y", "houses": "theirs"}), ["lv_group"])

    # the steps are kept short, as the JVM leaves a method of more than 8,000 bytes uncompiled
    known, bs = ["lv_group", "distance_m", "upright", "level"], [f"b_{c}" for c in rest]
    ahead, right = F.col("upright") == "north", F.col("level") == "east"
    p = near.where("upright <> '' OR level <> ''").select(*known, "theirs", F.inline("mine").alias(*(f"a_{c}" for c in rest)))
    p = p.withColumns({"up": F.when(ahead, F.col("a_north")).when(F.col("upright") == "south", F.col("a_south")), "flat": F.when(right, F.col("a_east")).when(F.col("level") == "west", F.col("a_west"))}).where("up > 0 OR flat > 0")
    p = p.select(*known, "up", "flat", *(f"a_{c}" for c in rest), F.inline("theirs").alias(*bs)).where("a_building_id < b_building_id")
    stands = (F.col("up") > 0) & (F.when(ahead, F.col("b_south")).otherwise(F.col("b_north")) > 0)
    p = p.withColumn("stands", F.coalesce(stands, F.lit(False)))
    p = p.withColumns({"my_length": F.expr("if(stands, up, flat)"), "their_length": F.expr("CASE WHEN stands THEN if(upright = 'north', b_south, b_north) WHEN level = 'east' THEN b_west ELSE b_east END")})
    p = p.where("my_length > 0 AND their_length > 0").withColumn("quality", _quality()).where(F.col("quality") > LEAST_MATCH)
    mine = F.expr("if(stands, upright, level)")
    match = F.struct(mine.alias("mine"), _facing(mine).alias("theirs"), "my_length", "their_length", "quality")
    return p.select("lv_group", *(f"{side}_{c}" for side in "ab" for c in rest), "distance_m", match.alias("match"))


def adjacency_edges(walls: DataFrame) -> DataFrame:
    """Each pair, found once, in both directions with strength, losses, diversity and potential."""
    differ = lambda c, once: F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), once)
    needed = walls.select("building_id", "lv_group", "x", "y", *(m for m, _ in FACING), "function", "housing_type", "has_solar", "solar_potential")
    p = adjacent_pairs(needed).withColumns({
        "strength": (F.col("match.my_length") + F.col("match.their_length")) / 2, "cable_distance": F.col("distance_m") * 0.5, "loss_factor": F.col("distance_m") * 0.001, "sharing_viable": F.col("distance_m") < 3,
        "function_diversity": F.coalesce(differ("function", 2.0), differ("housing_type", 1.5), F.lit(1.0)), "solar_diversity": F.coalesce(differ("has_solar", 2.0), differ("solar_potential", 1.5), F.lit(1.0)),
    })
    kept = ["lv_group", "distance_m", "strength", "cable_distance", "loss_factor", "sharing_viable", "function_diversity", "solar_diversity", F.col("match.quality").alias("match_quality")]
    way = lambda src, dst, mine, theirs: F.struct(F.col(f"{src}_building_id").alias("src"), F.col(f"{dst}_building_id").alias("dst"), F.col(f"match.{mine}").alias("my_wall"), F.col(f"match.{theirs}").alias("their_wall"))
    both = F.inline(F.array(way("a", "b", "mine", "theirs"), way("b", "a", "theirs", "mine")))
    return edge_potential(p.select(*kept, both).select("src", "dst", "my_wall", "their_wall", *kept[:-1], "match_quality"))


def edge_potential(edges: DataFrame) -> DataFrame:
    p = F.col("function_diversity") * F.col("solar_diversity") * F.col("match_quality")
    return edges.withColumns({"potential": p, "priority": F.when(p > 2.5, "VERY_HIGH").when(p > 2.0, "HIGH").when(p > 1.5, "MEDIUM").otherwise("LOW"), "resistance_cut": 0.1 * F.col("match_quality")})


def _sides(walls: DataFrame, rest: list[str]) -> DataFrame:
    """A row for every wall with a length: rest, x, y, wall, length, and for east and west whether the house has north and south walls."""
    has = lambda c, w: F.lit(w in ("east", "west")) & F.coalesce(F.col(c) > 0, F.lit(False))
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("wall"), F.col(w).alias("length"), has("north", w).alias("north"), has("south", w).alias("south")) for w, _ in FACING)))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return walls.where(finite).select(*rest, "x", "y", each.alias("w")).select(*rest, "x", "y", "w.*").where("length > 0")


def _facing(wall: str | Column) -> Column:
    wall = F.col(wall) if isinstance(wall, str) else wall
    return F.when(wall == "north", "south").when(wall == "south", "north").when(wall == "east", "west").otherwise("east")


def _near_places(mine: DataFrame, theirs: DataFrame, same: list[str]) -> DataFrame:
    """Rows of two places (same, x, y and their_x, their_y) less than REACH apart (distance_m), with the walls that can face: upright first, else level.

    Both are dealt by cells, so what follows for a place of ``mine`` stays in one task.
    """
    cell = lambda c: F.floor(F.col(c) / REACH)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    key = [*same, "cx", "cy"]
    here = mine.withColumns({"cx": cell("x"), "cy": cell("y")}).repartition(TASKS, *key)
    there = theirs.withColumn("o", around).withColumns({"cx": cell("their_x") + F.col("o.i"), "cy": cell("their_y") + F.col("o.j")}).drop("o").repartition(TASKS, *key)
    dx, dy = F.col("their_x") - F.col("x"), F.col("their_y") - F.col("y")
    upright = F.when(F.abs(dx) < OFFSET, F.when(dy > 0, "north").when(dy < 0, "south"))
    level = F.when(F.abs(dy) < OFFSET, F.when(dx > 0, "east").when(dx < 0, "west"))
    near = here.hint("merge").join(there, key).withColumn("distance_m", F.sqrt(dx * dx + dy * dy)).where((F.col("distance_m") < REACH) & ((dx != 0) | (dy != 0)))
    return near.withColumns({"upright": F.coalesce(upright, F.lit("")), "level": F.coalesce(level, F.lit(""))}).drop("their_x", "their_y")


def _quality() -> Column:
    return F.least("my_length", "their_length") / F.greatest("my_length", "their_length")


def edge_bundles(walls: DataFrame, by: list[str] | None = None, same: list[str] | None = None) -> DataFrame:
    """The edges of adjacency_edges counted and not listed: ``copies`` houses alike at a place have ``n`` neighbours alike each.

    Houses are alike in place, wall, length and ``by`` (a_ and b_); neighbours are added up over their places, so rows grow
    with places and kinds of houses and not with pairs of houses.
    """
    by, same = by or [], same or ["lv_group"]
    kinds = _checkpoint(_sides(walls, [*same, *by]).groupBy(*same, "x", "y", "wall", "length", "north", "south", *by).agg(F.count("*").alias("k")))
    mine = kinds.withColumnsRenamed({"wall": "my_wall", "length": "my_length", "k": "copies"} | {c: f"a_{c}" for c in by})
    other = F.struct(_facing("wall").alias("my_wall"), F.col("wall").alias("their_wall"), F.col("length").alias("their_length"), F.col("north").alias("b_north"), F.col("south").alias("b_south"), *(F.col(c).alias(f"b_{c}") for c in by), "k")
    theirs = kinds.groupBy(*same, F.col("x").alias("their_x"), F.col("y").alias("their_y")).agg(F.collect_list(other).alias("kinds"))
    near = _near_places(kinds.select(*same, "x", "y").distinct(), theirs, same).select(*same, "cx", "cy", "x", "y", "upright", "level", F.inline("kinds"))
    flat = F.col("my_wall") == F.col("level")
    barred = F.when(flat & (F.col("upright") == "north") & F.col("b_south"), "north").when(flat & (F.col("upright") == "south") & F.col("b_north"), "south").otherwise("")
    seen = near.where(flat | (F.col("my_wall") == F.col("upright"))).withColumn("barred", barred)
    seen = seen.groupBy(*same, "cx", "cy", "x", "y", "my_wall", "their_wall", "their_length", "barred", *(f"b_{c}" for c in by)).agg(F.sum("k").alias("n")).drop("cx", "cy")
    open_ = ~((F.col("barred") == "north") & F.col("north") | (F.col("barred") == "south") & F.col("south"))
    return mine.join(seen, [*same, "x", "y", "my_wall"]).where(open_ & (_quality() > LEAST_MATCH)).drop("barred").withColumns({"match_quality": _quality(), "strength": (F.col("my_length") + F.col("their_length")) / 2})


def potential_bundles(walls: DataFrame) -> DataFrame:
    """edge_bundles with diversity and potential."""
    differ = lambda c, once: F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), once)
    b = edge_bundles(walls, ["function", "housing_type", "has_solar", "solar_potential"])
    return edge_potential(b.withColumns({"function_diversity": F.coalesce(differ("function", 2.0), differ("housing_type", 1.5), F.lit(1.0)), "solar_diversity": F.coalesce(differ("has_solar", 2.0), differ("solar_potential", 1.5), F.lit(1.0))}))


def potential_by_priority(walls: DataFrame) -> DataFrame:
    """(priority, edges, potential): edges of each priority in both directions and their mean potential."""
    n = F.col("copies") * F.col("n")
    return potential_bundles(walls).groupBy("priority").agg(F.sum(n).alias("edges"), (F.sum(n * F.col("potential")) / F.sum(n)).alias("potential"))


def _per_building(walls: DataFrame, bundles: DataFrame, by: list[str], same: list[str], *totals: Column) -> DataFrame:
    """totals of bundles for each house's wall: building_id, wall and the totals; houses without an edge are missing."""
    key = [*same, "x", "y", "wall", "length", "north", "south", *by]
    g = bundles.withColumnsRenamed({"my_wall": "wall", "my_length": "length"} | {f"a_{c}": c for c in by}).groupBy(*key).agg(*totals)
    alike = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in key]
    return _sides(walls, ["building_id", *same, *by]).alias("s").join(g.alias("g"), alike).select("s.building_id", "s.wall", *(f"g.{c}" for c in g.columns if c not in key))


def neighbour_counts(walls: DataFrame, bundles: DataFrame | None = None, same: list[str] | None = None) -> DataFrame:
    """(building_id, neighbours) of the buildings that have some."""
    same = same or ["lv_group"]
    w = _per_building(walls, edge_bundles(walls, same=same) if bundles is None else bundles, [], same, F.sum("n").alias("n"))
    return w.groupBy("building_id").agg(F.sum("n").alias("neighbours"))


def building_metrics(walls: DataFrame) -> DataFrame:
    """Neighbours, mean strength, wall set, isolation and thermal factors of every building."""
    kinds = ["function", "housing_type", "has_solar", "solar_potential"]
    w = _per_building(walls, potential_bundles(walls), kinds, ["lv_group"], F.sum("n").alias("n"), F.sum(F.col("n") * F.col("strength")).alias("strength"), F.max("potential").alias("potential"))
    g = w.groupBy("building_id").agg(F.sum("n").alias("neighbours"), (F.sum("strength") / F.sum("n")).alias("avg_strength"), F.max("potential").alias("best_potential"), F.array_join(F.array_sort(F.collect_set("wall")), ",").alias("walls"))
    n = F.coalesce("neighbours", F.lit(0))
    step = lambda a, b, c, d: F.when(n == 0, a).when(n == 1, b).when(n == 2, c).otherwise(d)
    return walls.select("building_id").join(g, "building_id", "left").select("building_id", n.alias("neighbours"), F.coalesce("avg_strength", F.lit(0.0)).alias("avg_strength"), F.coalesce("best_potential", F.lit(0.0)).alias("best_potential"), F.coalesce("walls", F.lit("")).alias("walls"), step(1.0, 0.85, 0.7, 0.6).alias("isolation"), step(1.0, 1.15, 1.3, 1.4).alias("thermal_boost"))


def _with_neighbours(walls: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    return walls.join(neighbour_counts(walls, bundles), "building_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def validation(walls: DataFrame) -> DataFrame:
    """How many buildings of a kind have the number of neighbours that its name promises, and how many edges are two-way.

    Edges are two-way if as many lead back by the same two walls and lengths in the group.
    """
    bundles = _checkpoint(edge_bundles(walls))
    b = _with_neighbours(wall_counts(walls).select(*walls.columns, "adjacency_type"), bundles)
    checks = (("row_houses", F.col("housing_type") == "rijtjeswoning", 2), ("detached", F.col("housing_type") == "vrijstaand", 0), ("semi_detached", F.col("housing_type") == "twee_onder_1_kap", 1), ("middle_row_type", F.col("adjacency_type") == "MIDDLE_ROW", 2))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("counts"), (F.col("neighbours") == k).alias("right")) for n, c, k in checks))).alias("r")
    kinds = b.select("neighbours", rows).where("r.counts").groupBy("r.check").agg(F.count("*").alias("total"), F.count_if(F.col("r.right")).alias("correct"), F.avg("neighbours").alias("avg_neighbours"))
    ahead = F.col("my_wall").isin("north", "east")
    there = F.struct(F.when(ahead, F.col("my_wall")).otherwise(F.col("their_wall")).alias("wall"), F.when(ahead, F.col("my_length")).otherwise(F.col("their_length")).alias("near"), F.when(ahead, F.col("their_length")).otherwise(F.col("my_length")).alias("far"))
    n = F.col("copies") * F.col("n")
    two = bundles.groupBy("lv_group", there.alias("there")).agg(F.sum(F.when(ahead, n).otherwise(0)).alias("out"), F.sum(F.when(ahead, 0).otherwise(n)).alias("back"))
    both = two.agg(F.lit("reciprocal").alias("check"), F.coalesce(F.sum("out"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.least("out", "back")), F.lit(0)).alias("correct"), F.lit(None).cast("double").alias("avg_neighbours"))
    return kinds.unionByName(both).withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("total")))


def _components(walls: DataFrame) -> DataFrame:
    """(building_id, cluster_id) of all walls that share an edge: houses alike in place, wall and length stand for each other.

    Each such hub with an edge is first joined to its least neighbour; then only edges between what is still apart are kept.
    """
    same = ["lv_group"]
    sides = _sides(walls, ["building_id", *same])
    key = [*same, "x", "y", "wall", "length", "north", "south"]
    hubs = _checkpoint(sides.groupBy(*key).agg(F.min("building_id").alias("hub")))

    def links(named: DataFrame) -> DataFrame:
        a = F.struct(F.col("wall").alias("my_wall"), F.col("length").alias("my_length"), "north", "south", "hub", "part")
        b = F.struct(F.col("wall").alias("their_wall"), F.col("length").alias("their_length"), F.col("north").alias("b_north"), F.col("south").alias("b_south"), F.col("hub").alias("b_hub"), F.col("part").alias("b_part"))
        mine = named.groupBy(*same, "x", "y").agg(F.collect_list(a).alias("mine"))
        theirs = named.groupBy(*same, F.col("x").alias("their_x"), F.col("y").alias("their_y")).agg(F.collect_list(b).alias("theirs"))
        near = _near_places(mine, theirs, same).select("upright", "level", "theirs", F.inline("mine")).where("my_wall = upright OR my_wall = level")
        near = near.select("upright", "level", "my_wall", "my_length", "north", "south", "hub", "part", F.inline("theirs")).where(F.col("their_wall") == _facing("my_wall"))
        both = (F.col("upright") == "north") & F.col("north") & F.col("b_south") | (F.col("upright") == "south") & F.col("south") & F.col("b_north")
        return near.where(~((F.col("my_wall") == F.col("level")) & both) & (_quality() > LEAST_MATCH))

    wall = F.col("my_wall").alias("wall")
    first = _checkpoint(links(hubs.withColumn("part", F.col("hub"))).groupBy("hub", wall).agg(F.min("b_hub").alias("least")))  # a hub's first house has one such wall
    home = sides.join(hubs, key).join(first.select("hub", "wall"), ["hub", "wall"], "left_semi").select("building_id", "hub")
    parts = _checkpoint(connected_components(first.select(F.col("hub").alias("src"), F.col("least").alias("dst")).unionByName(home.select(F.col("building_id").alias("src"), F.col("hub").alias("dst")))))
    named = hubs.join(first.select("hub", "wall"), ["hub", "wall"], "left_semi").join(parts.select(F.col("node").alias("hub"), F.col("component").alias("part")), "hub")
    apart = links(named).where("part < b_part").select(F.col("part").alias("src"), F.col("b_part").alias("dst")).distinct()
    tops = connected_components(apart).select(F.col("component").alias("top"), F.col("node").alias("component"))
    return parts.join(tops, "component", "left").select(F.col("node").alias("building_id"), F.coalesce("top", "component").alias("cluster_id"))


def row_clusters(walls: DataFrame, least: int = 3) -> DataFrame:
    """(building_id, cluster_id): connected rows of middle, end and corner houses with a middle or end house and ``least`` houses."""
    w = _checkpoint(wall_counts(walls).where(F.col("adjacency_type").isin("MIDDLE_ROW", "END_ROW", "CORNER")).select("building_id", "lv_group", "x", "y", *(m for m, _ in FACING), "adjacency_type"))
    parts = _checkpoint(_components(w))
    good = parts.join(w, "building_id").groupBy("cluster_id").agg(F.count("*").alias("n"), F.bool_or(F.col("adjacency_type") != "CORNER").alias("row")).where((F.col("n") >= least) & F.col("row"))
    return parts.join(good.select("cluster_id"), "cluster_id", "left_semi").select("building_id", "cluster_id")


def corner_clusters(walls: DataFrame, taken: DataFrame, least: int = 2) -> DataFrame:
    """(building_id, cluster_id, role): corner and courtyard buildings outside ``taken`` with ``least`` neighbours outside it."""
    free = _checkpoint(wall_counts(walls.join(taken.select("building_id"), "building_id", "left_anti")))
    centre = free.where(F.col("adjacency_type").isin("CORNER", "COURTYARD")).select(F.col("building_id").alias("src"))
    near = adjacency_edges(free.select(*walls.columns)).select("src", "dst").distinct().join(centre, "src")
    good = near.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("src")
    members = near.join(good, "src", "left_semi").select(F.col("dst").alias("building_id"), F.col("src").alias("cluster_id"), F.lit("MEMBER").alias("role"))
    return members.unionByName(good.select(F.col("src").alias("building_id"), F.col("src").alias("cluster_id"), F.lit("CENTER").alias("role")))


def apartment_clusters(walls: DataFrame, taken: DataFrame, r: float = 50.0) -> DataFrame:
    """(lv_group, district, cluster_id, members): apartments outside ``taken`` of one group and district with another within r.

    Two that share a cell of side 0.7 r are less than r apart; only an apartment alone in its cell is compared with others.
    """
    a = walls.where("housing_type = 'appartement'").join(taken.select("building_id"), "building_id", "left_anti").select("building_id", "lv_group", "district", "x", "y").distinct()
    same, side = ["lv_group", "district"], 0.7 * r
    a = _checkpoint(a.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}))
    cells = a.groupBy(*same, "cx", "cy").agg(F.count("*").alias("n"), F.min("building_id").alias("first"))
    full = cells.where("n > 1").groupBy(*same).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0))))
    alone = a.join(cells.where("n = 1").select(F.col("first").alias("building_id")), "building_id", "left_semi").select(*same, F.col("building_id").alias("one"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", around.alias("o"))
    near = alone.select(*same, "one", "ox", "oy", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).hint("merge").join(a, [*same, "cx", "cy"])
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    lone = near.where(d < r).groupBy(*same, "one").agg(F.lit(1).alias("k")).groupBy(*same).agg(F.count("*").alias("n"), F.min("one").alias("first"))
    return full.unionByName(lone).groupBy(*same).agg(F.min("first").alias("cluster_id"), F.sum("n").alias("members"))


def penetration(walls: DataFrame, clusters: DataFrame) -> DataFrame:
    """Solar, battery and heat-pump shares of each cluster and its potential to share."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    g = clusters.join(walls, "building_id").groupBy("cluster_id").agg(F.count("*").alias("members"), share("has_solar").alias("solar"), share("has_battery").alias("battery"), share("has_heat_pump").alias("heat_pump"), F.size(F.collect_set("function")).alias("functions"))
    return g.withColumn("sharing", F.when((F.col("functions") > 1) & (F.col("solar") > 0), "HIGH").when((F.col("solar") > 0) | (F.col("battery") > 0), "MEDIUM").otherwise("LOW"))


def report(walls: DataFrame) -> DataFrame:
    """(section, key, n, value): totals, buildings by adjacency type and housing type, edges by wall pair."""
    bundles = _checkpoint(edge_bundles(walls))
    b = _with_neighbours(wall_counts(walls), bundles)
    mean = F.avg("neighbours").alias("value")
    section = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), mean).select(F.lit(name).alias("section"), "key", "n", "value")
    total = b.agg(F.lit("totals").alias("section"), F.lit("buildings").alias("key"), F.count("*").alias("n"), mean)
    k = F.col("copies") * F.col("n")
    pairs = bundles.groupBy(F.concat_ws("-", "my_wall", "their_wall").alias("key")).agg(F.sum(k).alias("n"), (F.sum(k * F.col("match_quality")) / F.sum(k)).alias("value")).select(F.lit("edges").alias("section"), "key", "n", "value")
    return total.unionByName(section(b, "adjacency_type", F.col("adjacency_type"))).unionByName(section(b, "housing_type", F.col("housing_type"))).unionByName(pairs)


def top_groups(walls: DataFrame, n: int = 10) -> DataFrame:
    """The n LV groups with the largest share of buildings that have a neighbour."""
    b = _with_neighbours(walls)
    return b.groupBy("lv_group").agg(F.count("*").alias("buildings"), F.count_if(F.col("neighbours") > 0).alias("with_neighbour")).withColumn("ratio", F.col("with_neighbour") / F.col("buildings")).orderBy(F.desc("ratio"), "lv_group").limit(n)


def thermal_savings(clusters: DataFrame, walls: DataFrame) -> DataFrame:
    """(building_id, saving): 5 % for each neighbour in the same cluster, at most 20 %."""
    c = clusters.select("building_id", "cluster_id")
    near = neighbour_counts(walls.join(c, "building_id"), same=["lv_group", "cluster_id"]).withColumnRenamed("neighbours", "k")
    return c.join(near, "building_id", "left").select("building_id", "cluster_id", F.least(F.lit(0.2), 0.05 * F.coalesce("k", F.lit(0))).alias("saving"))
