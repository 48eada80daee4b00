"""Hand-made cases for operators that SQL does not hold to account."""

import itertools
import math

from pyspark.sql import functions as F

from wattline.functions import building as fb
from wattline.operators import flows, memberships, planning, profiles, spatial
from wattline.operators.components import connected_components
from wattline.sources import tables
from wattline.streaming import energy


def test_components_of_a_long_chain_a_ring_and_nulls(spark):
    rows = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (None, 5), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_snap_at_cell_borders(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.49, 0.0), (3, 0.99, 0.0), (4, -0.5, 0.0), (5, 5.0, 5.0)], "id long, x double, y double")
    assert {(r.left_id, r.right_id) for r in spatial.snap_pairs(points, 0.5).collect()} == {(1, 2), (2, 3), (1, 4)}
    assert {r.id: r.group_id for r in spatial.snapped_groups(points, 0.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_knn_equals_brute_force(spark):
    pts = [(i, (i * 37 % 101) / 10, (i * 53 % 97) / 10) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r.left_id, r["rank"]): r.right_id for r in spatial.knn_within(df, df, 1.5, 3).collect()}
    exp = {}
    for i, x, y in pts:
        near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in pts)
        for k, (d, j) in enumerate([n for n in near if n[0] <= 1.5][:3], 1):
            exp[i, k] = j
    assert got == exp


def test_matching_never_moves_more_than_there_is(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, -5.0), (1, "2024-01-01 00:00:00", 2, 3.0), (1, "2024-01-01 00:00:00", 3, 3.0), (2, "2024-01-01 00:00:00", 4, 9.0)]
    df = spark.createDataFrame(rows, "lv_group long, slot string, building_id long, net double").withColumn("slot", F.to_timestamp("slot"))
    got = [(r.from_id, r.to_id, r.energy_kwh) for r in flows.match_surplus(df).collect()]
    assert sorted(got) == [(1, 2, 3.0), (1, 3, 2.0)]  # nothing flows to group 2


def test_irr_finds_the_rate(spark):
    df = spark.createDataFrame([(1000.0, 100.0), (1000.0, 50.0)], "c double, y double").select(fb.irr(F.col("c"), F.col("y")).alias("r"), "c", "y")
    for r in df.collect():
        worth = r.y * 20 if abs(r.r) < 1e-9 else r.y * (1 - (1 + r.r) ** -20) / r.r
        assert abs(worth - r.c) < 1e-3


def test_adjacency_rules(spark):
    walls = list(itertools.product((0, 1), repeat=4))
    df = spark.createDataFrame(walls, "n int, e int, s int, w int")
    got = {(r.n, r.e, r.s, r.w): r.a for r in df.select("*", fb.adjacency_type(*map(F.col, "nesw")).alias("a")).collect()}
    assert got[0, 0, 0, 0] == "ISOLATED" and got[1, 0, 1, 0] == got[0, 1, 0, 1] == "MIDDLE_ROW" and got[1, 1, 0, 0] == "CORNER" and got[0, 0, 0, 1] == "END_ROW"
    assert got[1, 1, 1, 0] == got[1, 1, 1, 1] == "MIDDLE_ROW"  # opposite walls come before their number


def test_upsert_and_counts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert {(r.k, r.v) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert {(r.layer, r.n) for r in tables.layer_counts(a=old, b=old.limit(0)).collect()} == {("a", 2), ("b", 0)}


def test_stream_equals_batch(spark, tmp_path):
    states = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("building_id"), F.col("value").alias("demand"))
    states.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(states.schema).parquet(str(tmp_path / "in"))
    q = energy.hourly_energy(stream, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.building_id): round(r.demand, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.building_id): round(r.demand, 6) for r in energy.hourly_energy(states).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_wkt(spark):
    r = spatial.wkt_points(spark.createDataFrame([("POINT (1.5 -2)",), ("x",)], "g string"), "g").collect()
    assert (r[0].x, r[0].y) == (1.5, -2.0) and r[1].x is None


def test_selection_skips_what_does_not_fit_and_goes_on(spark):
    rows = [(1, 10, 9.0, 60.0), (1, 11, 8.0, 70.0), (1, 12, 7.0, 35.0), (1, 13, 6.0, 5.0), (2, 20, 1.0, 200.0), (3, None, None, None)]
    got = planning.budgeted_selection(spark.createDataFrame(rows, "lv_group long, building_id long, score double, cost double"), 100.0)
    assert [(r.lv_group, r["rank"], r.building_id) for r in got.orderBy("lv_group", "rank").collect()] == [(1, 0, 10), (1, 1, 12)]


def test_matching_of_clusters_needs_both_sides(spark):
    before = spark.createDataFrame([(i, 1 if i < 6 else 2) for i in range(10)], "building_id long, cluster_id long")
    after = spark.createDataFrame([(i, 5 if i < 5 else 6) for i in range(10)], "building_id long, cluster_id long")
    got = {(r.old_id, r.new_id): (round(r.jaccard, 4), r.same) for r in memberships.cluster_matching(before, after).collect()}
    assert got == {(1, 5): (0.8333, True), (2, 6): (0.8, True)}
    r = memberships.cluster_transition(before, after).first()
    assert (r.stability, r.changed, r.split, r.vanished) == (0.0, 10, 0, 2)
    empty = memberships.cluster_transition(before.limit(0), after).first()
    assert (empty.stability, empty.changed, empty.split, empty.vanished) == (None, None, 0, 0)


def test_agreeing_runs_carry_no_mutual_information(spark):
    rows = [(r, n, c, p) for r in (1, 2) for n, ps in ((1, (0.5, 0.5)), (2, (0.9, 0.1) if r == 1 else (0.1, 0.9))) for c, p in zip("ab", ps, strict=True)]
    got = {r.node_id: r for r in planning.ensemble_uncertainty(spark.createDataFrame(rows, "run int, node_id int, class string, prob double")).collect()}
    assert abs(got[1].entropy - math.log(2)) < 1e-9 and abs(got[1].mutual_information) < 1e-9 and got[1].variation_ratio == 0
    assert abs(got[2].entropy - math.log(2)) < 1e-9 and got[2].mutual_information > 0.3 and got[2].variation_ratio == 0.5


def test_waterfall_keeps_energy(spark):
    states = spark.createDataFrame([(1, 1, "2024-01-01 10:00:00", 1.0, 5.0), (1, 2, "2024-01-01 10:00:00", 3.0, 0.0), (1, 3, "2024-01-01 11:00:00", 2.0, 0.0)], "cluster_id long, building_id long, ts string, demand double, generation double").withColumn("ts", F.to_timestamp("ts"))
    got = {r.building_id: (r.own_use, r.given, r.received, r.exported, r.imported) for r in profiles.energy_waterfall(states).collect()}
    assert got == {1: (1.0, 3.0, 0.0, 1.0, 0.0), 2: (0.0, 0.0, 3.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.0, 2.0)}
