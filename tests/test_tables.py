"""Readers, the star join's scan, the log of runs, sketches against exact figures, and streams that are restarted."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattline.operators import data_profile as dp
from wattline.operators import memberships
from wattline.sources import publication, star, tables
from wattline.streaming import feedback, membership


def test_network_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "lv.csv").write_text('id,component_id,x,y,mv_transformer_id,capacity_kva,geometry\nL1,1,100350.0,450100.0,M1,250,POINT (1 2)\nL2,2,,,M1,x,"POINT (100125 450229.5)"\nL2,2,5,,M1,,\n')
    (tmp_path / "mv.csv").write_text("id,x,y,capacity_kva,substation_id,geometry\nM1,450100.0,1000.0,630,SUB_001,POINT (450100 1000)\n")
    (tmp_path / "odd.csv").write_text("GEOMETRY,extra,id\nPOINT (7 8),1,M9\n")
    lv = [tuple(r) for r in tables.read_network_csv(spark, str(tmp_path / "lv.csv")).orderBy("id", "x").collect()]
    assert lv == [("L1", 1, 100350.0, 450100.0, "M1", 250, "POINT (1 2)"), ("L2", 2, 5.0, None, "M1", None, None), ("L2", 2, 100125.0, 450229.5, "M1", None, "POINT (100125 450229.5)")]
    assert tuple(tables.read_network_csv(spark, str(tmp_path / "mv.csv"), tables.TRANSFORMERS).first()) == ("M1", 450100.0, 1000.0, 630, "SUB_001", "POINT (450100 1000)")
    assert tuple(tables.read_network_csv(spark, str(tmp_path / "odd.csv"), tables.TRANSFORMERS).first()) == ("M9", 7.0, 8.0, None, None, "POINT (7 8)")


def test_profiles_history_and_results(spark, tmp_path):
    spark.createDataFrame([(1, 1704067200000)], "id long, timestamp long").write.parquet(str(tmp_path / "millis"))
    spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, timestamp timestamp").write.parquet(str(tmp_path / "stamps"))
    for name in ("millis", "stamps"):
        assert tables.read_energy_profiles(spark, str(tmp_path / name)).first().timestamp == datetime(2024, 1, 1)
    (tmp_path / "snap").mkdir()
    for day in ("20240101_000000", "20240109_120000"):
        (tmp_path / "snap" / f"metrics_{day}.json").write_text(json.dumps({"kpi": day}))
    assert [r.kpi for r in tables.read_metric_history(spark, str(tmp_path / "snap"), "2024-01-05").collect()] == ["20240109_120000"]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for fmt in ("parquet", "json", "csv"):
        tables.write_results(df, str(tmp_path / fmt), fmt, ["v"])
        tables.write_results(df, str(tmp_path / fmt), fmt, ["v"])  # again
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 2 and (tmp_path / fmt / "v=a").is_dir()


def scans(df) -> list:
    """The file scans of an executed plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            found.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_star_join_reads_only_the_days_it_needs(spark, tmp_path):
    rows = [(b, datetime(2024, 1, d, h), 1.0) for d in range(1, 15) for b in range(40) for h in (3, 19)]
    s = spark.createDataFrame(rows, "building_id long, ts timestamp, demand double")
    path = str(tmp_path / "fact")
    star.write_states(s, path)
    homes = spark.createDataFrame([(b, b % 2 == 0) for b in range(40)], "building_id long, home boolean")
    slots = star.slots_of(s)
    weekend = slots.where("is_weekend AND hour = 19")
    df = star.star_join(spark, path, weekend, homes.where("home"))
    got = df.select("building_id", "ts", "demand", "is_weekend").collect()
    assert len(got) == 4 * 20 and {r.ts.day for r in got} == {6, 7, 13, 14}
    plan = df._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    counted = star.star_join(spark, path, weekend, homes.where("home"))
    counted.collect()
    files = [x.metrics().apply("numFiles").value() for x in scans(counted) if "fact" in x.toString()]
    assert files == [4]  # of 14 days
    ranged = star.star_join(spark, path, slots, homes, ids=[3, 5], since="2024-01-03 10:00:00", until="2024-01-05 10:00:00")
    assert sorted((r.building_id, r.ts.day, r.ts.hour) for r in ranged.collect()) == [(b, d, h) for b in (3, 5) for d, h in ((3, 19), (4, 3), (4, 19), (5, 3))]
    static = next(x for x in scans(ranged) if "fact" in x.toString())
    assert static.metrics().apply("numFiles").value() == 3 and "building_id" in static.dataFilters().toString()
    many = star.star_join(spark, path, slots, homes, ids=[3, 3, *range(1000, 2200)])
    assert {r.building_id for r in many.collect()} == {3}


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    path = str(tmp_path)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    publication.append_lineage(spark, path, "a", "solar", {"k": 1}, {"n": 2}, ids(1, 2, None, 2), "2024-01-01 00:00:00")
    publication.append_lineage(spark, path, "b", "retrofit", {}, {}, ids(), "2024-01-03 00:00:00")
    publication.append_lineage(spark, path, "a", "solar", {"k": 1}, {"n": 2}, ids(2, 3), "2024-01-02 00:00:00")
    spark.createDataFrame([("9",)], "id string").write.parquet(f"{path}/affected/run_id=dead")  # died before its run was written
    assert [(r.run_id, r.affected, json.loads(r.inputs)) for r in publication.lineage_history(spark, path).collect()] == [("b", 0, {}), ("a", 2, {"k": 1})]
    assert sorted((r.run_id, r.id) for r in publication.affected_by(spark, path).collect()) == [("a", "2"), ("a", "3")]
    assert publication.lineage_history(spark, path, task="solar").count() == 1 == publication.lineage_history(spark, path, 1).count()


@pytest.mark.parametrize("task", publication.TASKS)
def test_every_task_publishes_its_ranks(spark, task):
    columns, totals, _ = publication.TASKS[task]
    by = columns[0]
    rows = spark.createDataFrame([(i, *(float(i * 7 % 5) for _ in columns)) for i in range(9)] + [(99, *(None for _ in columns))], "building_id long, " + ", ".join(f"{c} double" for c in columns))
    ranked, program = publication.publish_ranked(rows, task, by)
    got = {r.building_id: r[f"{task}_rank"] for r in ranked.collect()}
    want = sorted(range(9), key=lambda i: (-(i * 7 % 5), i))
    assert got == {b: n + 1 for n, b in enumerate(want)} and program.first().num == 9 and set(totals) <= set(program.columns)


def test_profile_is_within_the_sketches_error(spark):
    r = random.Random(1)
    rows = [(r.gauss(10, 3) if i % 50 else None, float(i % 1000), r.choice("aaabbc"), i % 7) for i in range(40_000)] + [(1000.0, float("nan"), None, 8)] * 40
    df = spark.createDataFrame(rows, "x double, y double, t string, day int")
    numbers = ["x", "y"]
    once = dp.sketches(df, numbers, ["t"])
    stored = dp.sketches(df, numbers, ["t"], ["day"])
    for sketch in (once, dp.merged(stored), dp.merged(dp.merged(stored.withColumn("half", F.col("day") % 2), ["half"]))):
        p = {v.column: v for v in dp.column_profile(sketch, numbers).collect()}
        for c, k in (("x", 0), ("y", 1)):
            v = sorted(row[k] for row in rows if row[k] is not None and row[k] == row[k])
            n = len(v)
            assert p[c].n == n and p[c].min == v[0] and p[c].max == v[-1] and p[c].mean == pytest.approx(sum(v) / n)
            assert p[c].std == pytest.approx((sum((a - sum(v) / n) ** 2 for a in v) / (n - 1)) ** 0.5)
            assert p[c].missing_pct == pytest.approx(100 * (len(rows) - n) / len(rows))
            for q, at in ((p[c].q1, 0.25), (p[c].median, 0.5), (p[c].q3, 0.75)):
                assert abs(sum(a <= q for a in v) / n - at) < 0.015
            assert p[c].distinct == pytest.approx(len(set(v)), rel=0.05)
            lo, hi = v[n // 4], v[3 * n // 4]
            beyond = sum(a < lo - 1.5 * (hi - lo) or a > hi + 1.5 * (hi - lo) for a in v)
            assert abs(p[c].outliers - beyond) < 0.015 * n
        pair = dp.correlated_pairs(sketch, numbers).first()
        both = [(a, b) for a, b, *_ in rows if a is not None and b == b]
        mx, my = (sum(z) / len(both) for z in zip(*both, strict=True))
        want = sum((a - mx) * (b - my) for a, b in both) / (sum((a - mx) ** 2 for a, _ in both) * sum((b - my) ** 2 for _, b in both)) ** 0.5
        assert pair.n == len(both) and pair.correlation == pytest.approx(want, abs=1e-9)
        assert [(x.value, x.n) for x in dp.frequent_values(sketch, "t", 2).collect()] == [(k, sum(t == k for _, _, t, _ in rows)) for k in "ab"]
    none = dp.column_profile(dp.sketches(df.limit(0), numbers), numbers).collect()
    assert [x.n for x in none] == [0, 0] and none[0].median is None


def test_membership_history_goes_on_after_a_restart(spark, tmp_path):
    before = spark.conf.get(membership.STATE_STORE[0], None)
    spark.conf.set(*membership.STATE_STORE)
    r = random.Random(2)
    days = [[(c, datetime(2024, 1, d), b) for c in range(3) for b in r.sample(range(12), r.randint(1, 9)) if (c, d) != (2, 9)] for d in range(1, 20)]
    schema, path = "cluster_id long, snapshot timestamp, building_id long", str(tmp_path)
    seen = {}

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        keep = lambda d, i: seen.update({(x.cluster_id, i): x for x in d.collect()})
        membership.membership_history(stream, 5).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    late = days[17][:1]
    for some in (days[:9], days[9:12], [*days[12:], late]):
        spark.createDataFrame([row for day in some for row in day], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run()  # a new query each time, from the checkpoint
    last = {c: seen[max(k for k in seen if k[0] == c)] for c in range(3)}
    table = spark.createDataFrame([row for day in days for row in day], schema).distinct()
    want = {x.cluster_id: x for x in memberships.temporal_stability(table, 4).collect()}
    assert all(last[c].snapshots == 5 and last[c].stability == pytest.approx(want[c].stability) and last[c].newest.day == 19 for c in range(3))
    spark.conf.set(membership.STATE_STORE[0], before) if before else spark.conf.unset(membership.STATE_STORE[0])


def test_expired_clusters_are_forgotten(spark, tmp_path):
    spark.conf.set(*membership.STATE_STORE)
    schema, path, seen = "cluster_id long, snapshot timestamp, building_id long", str(tmp_path), []
    for day in (1, 2):
        spark.createDataFrame([(1, datetime(2024, 1, day), 5)], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        membership.membership_history(stream, 5, ttl_hours=1e-6).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(once=True).foreachBatch(lambda d, i: seen.extend(d.collect())).start().awaitTermination(60)
    assert [x.snapshots for x in seen] == [1, 1]
    spark.conf.unset(membership.STATE_STORE[0])


def by_walk(weights, rows, rate):
    w = dict(weights)
    for pg, ag, pr, ar, ps, as_ in rows:
        if round((abs(pg - ag) / (ag + 1e-6) + abs(pr - ar) / (ar + 1e-6)) / 2, 9) > 0.2:
            if as_ > ps:
                w["demand_match"] *= 1 + rate
                w["energy_label"] *= 1 - rate / 2
            if ar < pr:
                w["roof_potential"] *= 1 + rate
                w["cascade_impact"] *= 1 - rate / 2
            total = sum(w.values())
            w = {k: v / total for k, v in w.items()}
    return w


def test_weights_learn_once_a_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [tuple(r.uniform(1, 9) for _ in range(6)) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0, 1.0)], "predicted_generation double, actual_generation double, predicted_roi_years double, actual_roi_years double, predicted_sufficiency double, actual_sufficiency double")
    path = str(tmp_path / "w")
    feedback.start(spark, path)
    learn = feedback.learn(path)
    learn(df.limit(0), 0)
    assert feedback.weights_before(spark, path).first().demand_match == pytest.approx(0.2)
    learn(df, 1)
    first = feedback.weights_before(spark, path).first()
    learn(df, 1)  # the same batch again
    again = feedback.weights_before(spark, path).first()
    assert first == again and again.version == 1 and again.deployments == 400
    want = by_walk(feedback.WEIGHTS, rows, feedback.RATE)
    assert all(again[k] == pytest.approx(want[k]) for k in want)
    learn(df, 2)
    assert feedback.weights_before(spark, path).first().demand_match == pytest.approx(by_walk(want, rows, feedback.RATE)["demand_match"])
    assert feedback.weights_before(spark, path, 2).first().version == 1
