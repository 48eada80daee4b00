"""Iterative community operators against hand-made cases and invariants."""

from pyspark.sql import functions as F

from wattline.functions import scores
from wattline.operators import communities as co
from wattline.operators import flows, geometry, roadmap
from wattline.streaming import energy


def two_cliques(spark):
    rows = [(a, b, 1.0) for part in ((0, 1, 2, 3), (10, 11, 12, 13)) for a in part for b in part if a < b] + [(3, 10, 0.1)]
    return spark.createDataFrame(rows, "a long, b long, weight double")


def test_communities_of_two_cliques(spark):
    pairs = two_cliques(spark)
    got = {r.building_id: r.cluster_id for r in co.modularity_communities(pairs).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(10, 14)}) == 1 and got[0] != got[10]
    pivots = {r.building_id: r.cluster_id for r in co.correlation_clusters(pairs).collect()}
    near = {frozenset(p) for p in ((r.a, r.b) for r in pairs.collect())}
    assert set(pivots) == set(got) and all(c == i or frozenset((i, c)) in near for i, c in pivots.items())  # everyone is its pivot's neighbour


def test_matching_is_stable(spark):
    rows = [(p, c, float((p * 7 + c * 13) % 11)) for p in range(4) for c in range(100, 112)]
    s = spark.createDataFrame(rows, "producer long, consumer long, score double")
    m = co.stable_matching(s, 3)
    got = m.collect()
    assert len(got) == 12 == len({r.consumer for r in got}) and all(sum(r.producer == p for r in got) <= 3 for p in range(4))
    assert co.blocking_pairs(s, m, 3).first().blocking == 0
    assert co.blocking_pairs(s, m.where("producer <> 0"), 3).first().blocking > 0
    one = co.assignment_matching(s.select(F.lit(1).alias("g"), F.col("producer").alias("a"), F.col("consumer").alias("b"), F.col("score").alias("cost")), ["g"]).collect()
    assert len(one) == 4 == len({r.a for r in one}) == len({r.b for r in one}) and sum(r.cost for r in one) == 0


def test_profiles_cluster_inside_their_group(spark):
    day = [float(i % 24 < 12) for i in range(24)]
    rows = [(g, g * 100 + i, day if i % 2 else [1 - x for x in day]) for g in (1, 2) for i in range(8)]
    p = spark.createDataFrame(rows, "lv_group long, building_id long, profile array<double>")
    got = co.lv_group_clustering(p, 3, 4).collect()
    size = {}
    for r in got:
        size.setdefault((r.lv_group, r.cluster_id), []).append(r.building_id)
    assert len(got) == 16 and all(len(v) <= 4 and len({b // 100 for b in v}) == 1 for v in size.values())
    k = {r.building_id: r.cluster_id for r in co.kmeans_profiles(p, 2).collect()}
    assert len({k[100], k[102], k[200]}) == 1 and len({k[101], k[103]}) == 1 and k[100] != k[101]


def test_walks_follow_edges(spark):
    e = two_cliques(spark).withColumnsRenamed({"a": "src", "b": "dst"})
    edge = {frozenset((r.src, r.dst)) for r in e.collect()}
    walks = [r.walk for r in co.random_walks(e, 5, 2).collect()]
    assert len(walks) == 16 and all(frozenset((int(x), int(y))) in edge for w in walks for x, y in zip(w, w[1:], strict=False))


def test_method_comparison_bounds(spark):
    rows = [(m, i, v + i % 5 / 10) for m, v in (("base", 0.4), ("new", 0.6)) for i in range(60)]
    got = {r.method: r for r in co.method_comparison(spark.createDataFrame(rows, "method string, cluster_id long, score double"), "base").collect()}
    assert got["base"].gain_pct == 0 and abs(got["new"].gain_pct - 100 * 0.2 / 0.6) < 1e-6 and got["new"].low < got["new"].mean < got["new"].high


def test_intervals_match_in_order(spark):
    rows = [(1, 1, b, n) for b, n in ((1, -5.0), (2, -2.0), (3, 4.0), (4, 4.0), (5, 0.0))] + [(2, 1, 6, 3.0)]
    got = flows.match_surplus(spark.createDataFrame(rows, "lv_group long, slot long, building_id long, net double")).collect()
    assert sorted((r.from_id, r.to_id, r.energy_kwh) for r in got) == [(1, 3, 4.0), (1, 4, 1.0), (2, 4, 2.0)]


def test_lines_and_polygons(spark):
    def of(*points):
        return F.array(*(geometry.point(F.lit(x), F.lit(y)) for x, y in points))

    square = of((0, 0), (4, 0), (4, 4), (0, 4))
    cases = {"through": of((-1, 2), (5, 2)), "inside": of((1, 1), (2, 2)), "outside": of((6, 6), (7, 7)), "touches": of((-1, 4), (5, 4)), "ends": of((2, 2), (9, 9))}
    row = spark.range(1).select(*(F.struct(geometry.line_intersects_polygon(v, square).alias("i"), geometry.line_crosses_polygon(v, square).alias("c")).alias(k) for k, v in cases.items())).first()
    assert {k: (row[k].i, row[k].c) for k in cases} == {"through": (True, True), "inside": (True, False), "outside": (False, False), "touches": (True, False), "ends": (True, True)}
    kind, points = geometry.parse_wkt(F.col("w"))
    r = spark.createDataFrame([("LINESTRING (0 0, 3 4)",), ("POLYGON((0 0,1 0,1 1))",), ("x",)], "w string").select(kind.alias("k"), points.alias("p"), geometry.length(points).alias("l")).collect()
    assert (r[0].k, r[0].l) == ("LINESTRING", 5.0) and len(r[1].p) == 3 and r[2].k is None
    multi = spark.createDataFrame([(1,)], "id long").withColumn("geom", F.array(of((0, 0), (0, 0.001)), of((0, 0), (2, 0))))
    assert [(x.part, len(x.geom)) for x in geometry.dump_lines(multi).collect()] == [(1, 2)]


def test_synonyms_and_selection(spark):
    raw = spark.createDataFrame([("12.5", "A++", 1980), (None, "?", None)], "Oppervlakte string, meestvoorkomendelabel string, bouwjaar int")
    got = [(r.area, r.energy_label, r.build_year) for r in scores.canonicalize(raw).collect()]
    assert got == [(12.5, 7, 1980.0), (0.0, 0, 0.0)]
    nodes = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.8), (4, 0.6)], "node long, score double")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert [(r.node, round(r.score, 3)) for r in roadmap.select_k(nodes, edges, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 0.96), (4, 0.6)]
    needs = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "item_id long, needs_id long")
    assert {r.item_id for r in roadmap.dependency_closure(spark.createDataFrame([(1,)], "item_id long"), needs).collect()} == {1, 2, 3}


def test_streams_equal_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 1.5, "2024-01-01 00:00:00"), (1, 2, 2.5, "2024-01-01 00:05:00"), (3, 2, 1.0, "2024-01-02 00:00:00"), (3, 2, 1.0, "2024-01-02 00:00:00")], "from_id long, to_id long, energy_kwh double, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(r.from_id, r.to_id): (r.energy_kwh, r.n) for r in run(energy.pair_totals(stream()), "totals", "complete").collect()}
    assert got == {(1, 2): (4.0, 2), (3, 2): (2.0, 2)}
    assert run(energy.deduplicated(stream(), "ts"), "once", "append").count() == 3
    hot = flows.congestion_alerts(stream().select(F.col("from_id").alias("id"), F.col("energy_kwh").alias("load_kw"), F.lit(2.0).alias("capacity_kw")))
    assert run(hot, "alerts", "append").count() == 1
    w = energy.metric_windows(stream(), "1 day", watermark="0 seconds", name="to_id", value="energy_kwh")
    assert [(r["mean"], r["max"]) for r in energy.alerts(run(w, "windows", "complete"), 2.0).collect()] == [(2.0, 2.5)]
    assert energy.retained(rows, 1, "2024-01-02 12:00:00").count() == 2
