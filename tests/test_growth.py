"""Steps whose work must grow with their input and not with the pairs in it, against plain Python."""

import random

import duckdb
from pyspark.sql import functions as F

from wattline.operators import adjacency as ad
from wattline.operators import budget
from wattline.operators import communities as co
from wattline.operators import components as cc
from wattline.operators import connections as cn
from wattline.operators import interventions as iv
from wattline.operators import ranking, spatial
from wattline.operators import topology as tp
from wattline.plans import bindings as at
from wattline.plans import registry

LINKS = "group_id string, voltage_level string, station_type string, station_fid long, distance_m double, confidence_score double"


def test_parents_meet_only_those_that_can_be_best(spark):
    rng = random.Random(3)
    rows = [(f"{v}_{i}", v, "TRANSFORMER", rng.randrange(6), float(rng.randrange(4)), rng.choice((0.1, 0.2, 0.30000000000000004, 0.3))) for v in ("LV", "MV") for i in range(90)]
    rows += [("LV_null", "LV", "TRANSFORMER", 1, 2.0, None), ("MV_null", "MV", "TRANSFORMER", 2, None, 0.2), ("LV_far", "LV", "TRANSFORMER", 3, 1e17, 0.3)]
    first = lambda v: (v is not None, v or 0.0)  # noqa: E731  nulls come first
    plus = lambda a, b: None if a is None or b is None else a + b
    want = {}
    for c in (r for r in rows if r[1] == "LV"):
        sums = [(plus(c[5], p[5]), plus(c[4], p[4]), p[0], c[3]) for p in rows if p[1] == "MV" and p[3] == c[3]]
        want[c[0]] = min((first(None if s is None else -s / 2), first(d), p, f) for s, d, p, f in sums)[2:]
    got = tp.via_station_parent(spark.createDataFrame(rows, LINKS), "LV", "MV", "TRANSFORMER").collect()
    assert {r.child_group_id: (r.parent_group_id, r.via_station_fid) for r in got} == want
    many = spark.range(5000).selectExpr("1L AS station_fid", "cast(id AS string) AS parent_group_id", "cast(id % 50 AS double) AS pd", "0.5 + id % 11 / 100 AS pc").withColumn("pc", tp.F.col("pc").cast("double"))
    children = spark.createDataFrame([(1, "a", 3.0, 0.9)], "station_fid long, child_group_id string, cd double, cc double")
    assert tp._candidates(many, children).count() == 1


def test_nearest_segments_are_looked_for_near_first_and_once_a_shape(spark):
    rng = random.Random(5)
    point = lambda: (rng.uniform(0, 20), rng.uniform(0, 20))
    lines = [[a, (a[0] + rng.uniform(-2, 2), a[1] + rng.uniform(-2, 2))] for a in (point() for _ in range(2500))]
    lines += [[(100.0, 100.0), (104.0, 100.0)]]
    rows = [(i, lines[i % len(lines)]) for i in range(2 * len(lines))]
    s = spark.createDataFrame(rows, "segment_id long, geom array<struct<x:double,y:double>>")
    homes = [(i, *point()) for i in range(60)] + [(60, 102.0, 104.9), (61, 102.0, 105.1)]

    def away(line, x, y):
        (ax, ay), (bx, by) = line
        t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0), 1)
        return ((ax + t * (bx - ax) - x) ** 2 + (ay + t * (by - ay) - y) ** 2) ** 0.5

    want = {i: min(range(len(lines)), key=lambda k: (away(lines[k], x, y), k)) for i, x, y in homes[:61]}
    assert len(cn._radii(s.selectExpr("geom[0] AS a", "geom[1] AS b"), 5.0)) > 2
    got = cn.nearest_segment(spark.createDataFrame(homes, "building_id long, x double, y double"), s, 5.0).collect()
    assert {r.building_id: r.segment_id for r in got} == want


def test_places_are_compared_and_not_copies(spark):
    copies = spark.range(30000).selectExpr("id", "cast(id % 3 AS double) AS x", "0.0D AS y")
    apart = spark.createDataFrame([(30000, None, 1.0), (30001, float("nan"), 1.0), (30002, 2.5, 0.0), (30003, 9.0, 9.0)], "id long, x double, y double")
    points = copies.unionByName(apart)
    got = {r.group_id: r["count"] for r in spatial.snapped_groups(points, 0.55).groupBy("group_id").count().collect()}
    assert got == {0: 10000, 1: 10000, 2: 10001, 30000: 1, 30001: 1, 30003: 1}
    near = spatial.knn_within(points, points, 0.55, 2)
    assert near.count() == 2 * 30001 + 1 and {r.right_id for r in near.where("left_id = 30002").collect()} == {30002, 2}


def test_dense_segments_are_not_copied_to_small_cells(spark, monkeypatch):
    rng = random.Random(8)
    start = lambda: (rng.uniform(0, 30), rng.uniform(0, 30))
    lines = [(i, [a, (a[0] + rng.uniform(2, 6), a[1] - rng.uniform(2, 6))]) for i, a in enumerate(start() for _ in range(1500))]
    odd = [(1500, [(80.0, 80.0), (80.0, 80.0)]), (1501, [(80.0, 80.0), (80.0, 80.0)]), (1502, [(float("nan"), 1.0), (2.0, 2.0)])]
    homes = [(i, *start()) for i in range(400)] + [(400, 80.0, 85.0), (401, 80.0, 85.001), (402, None, 1.0), (403, float("nan"), 1.0), (404, -3.0, -4.0)]
    sides, cells = [], cn._cells
    monkeypatch.setattr(cn, "_cells", lambda parts, r, around=0: sides.append(r) or cells(parts, r, around))
    monkeypatch.setattr(cn, "BLOCK", 500)
    monkeypatch.setattr(cn, "CROWD", 7)
    frames = spark.createDataFrame(homes, "building_id long, x double, y double"), spark.createDataFrame(lines + odd, "segment_id long, geom array<struct<x:double,y:double>>")
    got = {r.building_id: (r.segment_id, round(r.distance, 9)) for r in cn.nearest_segment(*frames, 5.0).collect()}

    def away(line, x, y):
        (ax, ay), (bx, by) = line
        t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0), 1)
        return ((ax + t * (bx - ax) - x) ** 2 + (ay + t * (by - ay) - y) ** 2) ** 0.5

    want = {i: min((away(line, x, y), k) for k, line in lines) for i, x, y in homes[:400] + homes[404:]}
    assert got == {i: (k, round(d, 9)) for i, (d, k) in want.items() if d <= 5} | {400: (1500, 5.0)}
    assert set(sides) == {5.0}  # halves of r would copy a part to ever more cells


def test_apartments_that_share_a_cell_are_not_paired(spark):
    flats = spark.range(20000).selectExpr("id AS building_id", "1L AS lv_group", "'A' AS district", "'appartement' AS housing_type", "id % 30 / 1.0D AS x", "0.0D AS y")
    lone = [(20000, 1, "A", "appartement", 78.0, 0.0), (20001, 1, "A", "appartement", 200.0, 0.0), (5, 2, "A", "appartement", 0.0, 0.0), (6, 2, "A", "appartement", 50.0, 0.0), (7, 3, "A", "appartement", 34.0, 0.0), (8, 3, "A", "appartement", 83.9, 0.0)]
    walls = flats.unionByName(spark.createDataFrame(lone, flats.schema))
    got = {(r.lv_group, r.cluster_id, r.members) for r in ad.apartment_clusters(walls, walls.limit(0)).collect()}
    assert got == {(1, 0, 20001), (3, 7, 2)}


def test_scores_round_half_way_as_in_duckdb(spark):
    values = [0.35 * k / 256 + 0.3 * j / 256 for k in range(0, 257, 4) for j in range(0, 257, 4)]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", registry.scaled_round(F.col("v"), 9).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [r[0] for r in duckdb.connect().execute("SELECT round(v, 9) FROM (SELECT unnest(?) AS v)", [values]).fetchall()]


def test_results_round_the_scaled_double_as_in_duckdb(spark):
    rng = random.Random(2)
    values = [0.17324967, 0.72324967, -0.00001, -0.25005, 1e15 + 0.3, 123456789.12345, float("inf"), float("nan"), 0.0] + [rng.uniform(-1000, 1000) for _ in range(3000)] + [k / 8e4 - registry.NUDGE for k in range(2000)]
    got = registry.rounded(spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")).orderBy("i").collect()
    want = duckdb.connect().execute(f"SELECT round(v + {registry.NUDGE}, 4) FROM (SELECT unnest(?) AS v)", [[*values, None]]).fetchall()
    assert [str(r.v) for r in got] == [str(r[0] + 0.0 if r[0] is not None else None) for r in want]


def test_ranks_hold_though_quantiles_come_out_differently_each_time(spark, monkeypatch):
    again = F.udf(lambda q: [x + 50 * random.SystemRandom().random() for x in q], "array<double>").asNondeterministic()
    approx = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: again(approx(*a)))  # blocks of a shuffle arrive in any order
    rows = spark.range(5000).selectExpr("id", "id % 2 AS program", "cast(id * 7919 % 701 AS double) AS score")
    spark.conf.set("spark.sql.exchange.reuse", "false")  # the quantiles themselves are computed behind the exchange, once a use
    got = {(r.program, r.rank): (-r.score, r.id) for r in ranking.running(rows, ["program"], "score", "id").collect()}
    spark.conf.unset("spark.sql.exchange.reuse")
    want = {p: sorted((-float(i * 7919 % 701), i) for i in range(p, 5000, 2)) for p in (0, 1)}
    assert got == {(p, n): v for p, all_ in want.items() for n, v in enumerate(all_, 1)}


def test_bins_and_their_range_come_from_one_evaluation(spark):
    s = spark.range(240).selectExpr("1L AS lv_group", "id % 4 AS building_id", "cast(id % 24 AS int) AS slot", "id / 7.0D AS v").groupBy("lv_group", "building_id", "slot").agg(F.avg("v").alias("demand"))
    plan = co.mutual_information(s)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(demand" in plan and all("Window" in line for line in plan.splitlines() if "min(demand" in line)


def test_a_rate_is_found_once_for_each_saving(spark):
    b = spark.range(3000).withColumnRenamed("id", "building_id")
    plan = registry._irr(b)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "sequence(" in line or "aggregate(" in line)
    assert any("Aggregate [yearly" in line for line in plan[first:]) and registry._irr(b).count() == 3000


WALLS = "building_id long, lv_group long, x double, y double, north double, east double, south double, west double, function string, housing_type string, has_solar boolean, solar_potential string"


def test_shared_walls_are_counted_by_kinds_of_houses(spark):
    rng = random.Random(11)
    length = lambda: rng.choice((0.0, 0.0, 1.0, 2.0, 3.0, 4.5))
    rows = [(i, i % 2, rng.randrange(40) * 0.8 + 30 * (i % 3), rng.randrange(40) * 0.8, length(), length(), length(), length(), rng.choice("ab"), rng.choice(("rijtjeswoning", "vrijstaand")), rng.random() < 0.5, rng.choice("hl")) for i in range(500)]
    rows += [(600, 0, None, 1.0, 1.0, 1.0, 1.0, 1.0, "a", "b", True, "h"), (601, 0, float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0, "a", "b", True, "h"), (602, 0, 1.0, 1.0, None, 1.0, None, 1.0, None, "b", True, "h")]
    walls = spark.createDataFrame(rows, WALLS)
    edges = [r for r in ad.adjacency_edges(walls.where("building_id <> 601")).collect()]
    want = {}
    for r in edges:
        want.setdefault(r.src, []).append(r)
    got = {r.building_id: r for r in ad.building_metrics(walls).collect()}
    assert len(got) == len(rows) and sum(r.neighbours for r in got.values()) == len(edges) > 500
    for i, r in got.items():
        e = want.get(i, [])
        assert r.neighbours == len(e) and r.walls == ",".join(sorted({x.my_wall for x in e})) and r.best_potential == max((x.potential for x in e), default=0.0)
        assert abs(r.avg_strength - (sum(x.strength for x in e) / len(e) if e else 0)) < 1e-9
    assert {r.priority: r.edges for r in ad.potential_by_priority(walls).collect()} == {p: sum(x.priority == p for x in edges) for p in {x.priority for x in edges}}
    both = next(r for r in ad.validation(walls).collect() if r.check == "reciprocal")
    assert both.total == both.correct == len(edges) // 2
    ok = {r.building_id for r in ad.wall_counts(walls).where("adjacency_type IN ('MIDDLE_ROW', 'END_ROW', 'CORNER')").collect()}
    parts = {r.node: r.component for r in ad.connected_components(spark.createDataFrame([(x.src, x.dst) for x in edges if x.src in ok and x.dst in ok], "src long, dst long")).collect()}
    kinds = {r.building_id: r.adjacency_type for r in ad.wall_counts(walls).collect()}
    groups = {}
    for i, c in parts.items():
        groups.setdefault(c, []).append(i)
    assert len(groups) > 2
    assert {(r.building_id, r.cluster_id) for r in ad.row_clusters(walls).collect()} == {(i, c) for c, m in groups.items() if len(m) >= 3 and any(kinds[j] != "CORNER" for j in m) for i in m}


def test_copies_of_houses_make_no_more_bundles(spark):
    walls = spark.range(60000).selectExpr("id AS building_id", "0L AS lv_group", "id % 3 * 2.0D AS x", "0.0D AS y", "0.0D AS north", "1.0D AS east", "0.0D AS south", "1.0D AS west")
    bundles = ad.edge_bundles(walls)
    assert bundles.count() == 4 and bundles.selectExpr("sum(copies * n) AS n").first().n == 6 * 20000**2
    assert {r.neighbours for r in ad.neighbour_counts(walls, bundles).collect()} == {40000}
    assert ad.row_clusters(walls).where("cluster_id = 0").count() == 60000


def test_edges_are_dealt_over_tasks_by_their_number(spark, tmp_path, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(at, "TASK_ROWS", 500)
    spark.range(20000).selectExpr("id % 100 AS l_suppkey", "id AS l_partkey", "1.0D AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    was = spark.conf.get(key, None)
    try:
        assert at.edges(spark, str(tmp_path)).count() == 20000 and int(spark.conf.get(key)) == 40
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def test_prices_without_groups_are_tried_without_a_shuffle(spark, monkeypatch):
    items = spark.range(200).selectExpr("id AS item_id", "cast(1 + id * 7 % 101 AS double) AS value", "cast(1 + id % 13 AS double) AS cost")
    seen, frame = [], type(items)
    was = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *c: seen.append(c) or was(self, *c))
    got, bound, gap = budget.budgeted_mix(items, 300.0)
    assert not [c for c in seen if c == ("g",)]
    rows = got.collect()
    assert sum(r.cost for r in rows) <= 300 and abs(sum(r.value for r in rows) + gap - bound) < 1e-6 and gap < 102


def test_houses_are_paired_by_places_that_face_each_other(spark, monkeypatch):
    monkeypatch.setattr(ad, "CROWD", 4)
    rng = random.Random(12)
    length = lambda: rng.choice((0.0, None, 1.0, 2.0, 3.0))
    rows = [(i, i % 2, rng.randrange(6) * 1.3, rng.randrange(6) * 1.3, length(), length(), length(), length(), rng.choice("ab"), "v", rng.random() < 0.5, rng.choice("hl")) for i in range(400)]
    facing = (("north", 4, 6), ("south", 6, 4), ("east", 5, 7), ("west", 7, 5))

    def match(a, b):
        dx, dy = b[2] - a[2], b[3] - a[3]
        for name, m, t in facing:
            ahead = {"north": dy > 0, "south": dy < 0, "east": dx > 0, "west": dx < 0}[name]
            if ahead and (a[m] or 0) > 0 and (b[t] or 0) > 0 and abs(dx if name in ("north", "south") else dy) < 3:
                return (name, min(a[m], b[t]) / max(a[m], b[t])) if min(a[m], b[t]) / max(a[m], b[t]) > 0.5 else None

    want = {(a[0], b[0]): match(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and ((b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2) ** 0.5 < 5 and match(a, b)}
    walls = spark.createDataFrame(rows, WALLS)
    got = ad.adjacent_pairs(walls).collect()
    assert len(got) == len(want) > 1000 and {(r.a_building_id, r.b_building_id): (r.match.mine, r.match.quality) for r in got} == want
    edges = ad.adjacency_edges(walls)
    assert edges.count() == 2 * len(want) and edges.select("src", "dst").distinct().count() == 2 * len(want)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join") == 1  # pairs are found once


def test_interventions_compare_a_pair_once_and_rounds_shrink(spark, monkeypatch):
    pairs = [(a, b) for a in range(12) for b in range(a, 12) if (a * 7 + b * 5) % 3 == 0]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:20]], "src long, dst long")
    vector = {n: [float(n % 3), float(n % 5), 1.0] if n else [0.0, 0.0, 0.0] for n in range(12)}
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in range(12)}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)) if norm(a) and norm(b) else 0.0
    bridge = {n: sum(1 - cosine(vector[n], vector[m]) for m in near[n]) for n in range(12)}
    nodes = spark.createDataFrame(list(vector.items()), "node long, embedding array<double>")
    got = {r.node: r.position for r in iv.position_value(nodes, edges).collect()}
    most, widest = max(map(len, near.values())), max(bridge.values())
    assert {n: round(p, 9) for n, p in got.items()} == {n: round(0.5 * len(near[n]) / most + 0.5 * bridge[n] / widest, 9) for n in range(12) if near[n]}
    sizes, was = [], iv._between
    monkeypatch.setattr(iv, "_between", lambda e, left, d: sizes.append(e.count()) or was(e, left, d))
    path = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    scored = spark.range(61).selectExpr("id AS node", "cast(id * 11 % 61 AS double) AS score")
    for distance in (1, 2):
        del sizes[:]
        want = []
        for n in sorted(range(61), key=lambda n: -(n * 11 % 61)):
            if all(abs(n - m) > distance for m in want):
                want.append(n)
        assert {r.node for r in iv.spaced_selection(scored, path, distance).collect()} == set(want)
        assert distance > 1 or len(sizes) > 1 and sizes[-1] < sizes[0]


def test_rounds_broadcast_only_small_tables(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    was = [spark.conf.get(k, None) for k in keys]
    plan = lambda n: spark.range(10**6).join(spark.range(n), "id")._jdf.queryExecution().executedPlan().toString()
    with cc.small_broadcasts(spark):
        assert "BroadcastHashJoin" in plan(1000) and "BroadcastHashJoin" not in plan(100_000)
    assert [spark.conf.get(k, None) for k in keys] == was and "BroadcastHashJoin" in plan(100_000)


def test_dealt_edges_are_not_merged_into_few_tasks(spark, tmp_path, monkeypatch):
    keys = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    was = [spark.conf.get(k, None) for k in keys]
    monkeypatch.setattr(at, "TASK_ROWS", 500)
    monkeypatch.setattr(at, "TASK_BYTES", 8 << 10, raising=False)
    spark.conf.unset(keys[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    spark.range(40000).selectExpr("id % 100 AS l_suppkey", "id AS l_partkey", "1.0D AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    try:
        e = at.edges(spark, str(tmp_path))
        tasks = e.groupBy("dst").count().select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 20
        spark.conf.set(keys[1], "64m")
        at.edges(spark, str(tmp_path))
        assert spark.conf.get(keys[1]) == "64m"  # the session's own stays
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        for k, v in zip(keys, was, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
