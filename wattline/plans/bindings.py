"""Driver tables renamed to the library's schemas, as DataFrames and as SQL common table expressions.

The column expressions are written once and run in both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BUILDINGS = [
    "o_orderkey AS building_id", "o_custkey AS lv_group", "n_name AS mv_station", "c_mktsegment AS district", "o_totalprice / 1000.0 AS area",
    "substr('ABCDEFG', cast(1 + o_orderkey % 7 AS int), 1) AS label", "cast(1900 + o_orderkey % 121 AS int) AS build_year",
    "CASE o_orderstatus WHEN 'F' THEN 'residential' WHEN 'O' THEN 'office' ELSE 'retail' END AS function",
    "o_orderkey % 5 = 0 AS has_solar", "o_orderkey % 11 = 0 AS has_battery", "o_orderkey % 13 = 0 AS has_heat_pump",
    "cast(o_orderkey % 180 AS double) AS distance_m", "o_totalprice / 10000.0 AS peak_kw", "cast(o_orderkey % 97 AS double) AS roof_flat", "cast(o_orderkey % 71 AS double) AS roof_sloped",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'S' WHEN o_orderkey % 4 = 1 THEN 'N' ELSE 'E' END AS orientation",
]
STATES = [
    "event_id", "user_id AS building_id", "cast(floor(user_id / 15.0) AS bigint) AS lv_group", "user_id % 25 AS cluster_id", "ts", "event_type", "value AS demand",
    "CASE WHEN event_type IN ('view', 'click') THEN value * 1.5 ELSE 0.0 END AS generation",
]
FLOWS = ["l_shipdate AS ts", "l_suppkey AS from_id", "o_custkey AS to_id", "l_extendedprice / 1000.0 AS energy_kwh"]
SUPPLIERS = ["s_suppkey AS id", "s_acctbal / 100.0 AS x", "cast(s_nationkey AS double) AS y"]
CUSTOMERS = ["c_custkey AS id", "c_acctbal / 100.0 AS x", "cast(c_nationkey AS double) AS y"]
PARTS = ["p_partkey AS id", "cast(p_size AS double) AS x", "p_retailprice AS y"]
MEMBERSHIPS = ["cast(ts AS date) AS snapshot", "user_id AS building_id", "(user_id + CASE WHEN (user_id + day(ts)) % 7 = 0 THEN 3 ELSE 0 END) % 25 AS cluster_id"]
PREDICTIONS = ["l_linenumber AS run", "l_orderkey AS node_id", "l_returnflag AS class", "0.05 + l_discount * 9 AS prob", "l_linestatus = 'O' AS hit"]
EDGES = ["l_suppkey AS src", "1000000 + l_partkey AS dst", "l_quantity AS weight"]

SQL = {
    "b": f"SELECT {', '.join(BUILDINGS)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "g": "SELECT c_custkey AS lv_group, n_name AS mv_station FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "s": f"SELECT {', '.join(STATES)} FROM events",
    "f": f"SELECT {', '.join(FLOWS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "sup": f"SELECT {', '.join(SUPPLIERS)} FROM supplier",
    "cus": f"SELECT {', '.join(CUSTOMERS)} FROM customer",
    "par": f"SELECT {', '.join(PARTS)} FROM part",
    "m": f"SELECT DISTINCT {', '.join(MEMBERSHIPS)} FROM events",
    "p": f"SELECT {', '.join(PREDICTIONS)} FROM lineitem",
    "e": f"SELECT src, dst, sum(weight) AS weight FROM (SELECT {', '.join(EDGES)} FROM lineitem) GROUP BY src, dst",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).selectExpr(*BUILDINGS)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = (_read(spark, sf_dir, t) for t in ("customer", "nation"))
    return c.join(n, c.c_nationkey == n.n_nationkey).selectExpr("c_custkey AS lv_group", "n_name AS mv_station")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*STATES)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).selectExpr(*FLOWS)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").selectExpr(*SUPPLIERS)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(*CUSTOMERS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(*PARTS)


#: Rows of a table for each task of the shuffles over it.
TASK_ROWS = 250_000
#: Shuffled bytes that Spark puts together for one task of such tables, unless the session says how many: a few hundred thousand rows of two numbers.
TASK_BYTES = 16 << 20


def tasks_for(spark: SparkSession, df: DataFrame) -> int:
    """Tasks for shuffles over all of df, so that a task's share does not grow with it; later shuffles start from as many and are merged up to ``TASK_BYTES``."""
    key, merged = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(merged, None) is None:
        spark.conf.set(merged, str(TASK_BYTES))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // TASK_ROWS)
    if n > int(spark.conf.get(key, None) or 0):
        spark.conf.set(key, n)
    return n


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.selectExpr(*EDGES).repartition(tasks_for(spark, li), "src", "dst").groupBy("src", "dst").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "weight")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*MEMBERSHIPS).distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.selectExpr(*PREDICTIONS).repartition(tasks_for(spark, li), "node_id")


AGE_RANGE = "CASE WHEN {0} < 1945 THEN '< 1945' WHEN {0} < 1975 THEN '1945-1975' WHEN {0} < 1990 THEN '1975-1990' WHEN {0} < 2005 THEN '1990-2005' WHEN {0} < 2015 THEN '2005-2015' ELSE '> 2015' END"
HIERARCHY = [
    "o_orderkey AS building_id", "o_custkey AS lv_group", "n_name AS mv_station", "cast(g AS int) AS mv_group", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS district",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'non_residential' ELSE 'residential' END AS function",
    "CASE WHEN o_orderkey % 3 = 0 THEN CASE cast(o_custkey % 4 AS int) WHEN 0 THEN 'Office' WHEN 1 THEN 'Retail' WHEN 2 THEN 'School' ELSE 'Industrial' END ELSE CASE cast(o_orderkey % 4 AS int) WHEN 0 THEN 'vrijstaand' WHEN 1 THEN 'twee_onder_1_kap' WHEN 2 THEN 'rijtjeswoning' ELSE 'appartement' END END AS building_type",
    "o_totalprice / 100.0 AS area", "CASE WHEN o_orderkey % 19 = 0 THEN 'A++' ELSE substr('ABCDEFG', cast(1 + o_orderkey % 7 AS int), 1) END AS label", AGE_RANGE.format("1900 + o_orderkey % 121") + " AS age_range",
    "CASE cast(o_orderkey % 9 AS int) WHEN 0 THEN 'ENDED' WHEN 1 THEN 'ENTERED' WHEN 2 THEN 'CROSSED' WHEN 3 THEN 'TOO_FAR' ELSE 'BY_DISTANCE' END AS connection_type", "cast(o_orderkey % 180 AS double) AS distance_m",
    "o_orderkey % 3 = 0 AND o_totalprice > 200000 AS is_mv_capable", "o_orderkey % 4 = 0 AS has_mv_nearby", "o_orderkey % 9 = 3 AS is_problematic",
    "o_orderkey % 5 = 0 AS has_solar", "o_orderkey % 11 = 0 AS has_battery", "o_orderkey % 13 = 0 AS has_heat_pump", "o_totalprice / 10000.0 AS peak_kw", "o_totalprice / 10.0 AS annual_kwh",
    "cast(o_orderkey % 97 AS double) AS roof_flat", "cast(o_orderkey % 71 AS double) AS roof_sloped", "CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN 'S' WHEN 1 THEN 'N' WHEN 2 THEN 'E' WHEN 3 THEN 'SW' ELSE 'W' END AS orientation",
    "cast(o_orderkey % 24 AS int) AS peak_hour", "cast(1900 + o_orderkey % 121 AS int) AS build_year",
]
#: Every fifth LV group hangs under two MV groups, so its buildings repeat.
_TWICE = "(SELECT 0 AS g UNION ALL SELECT 1 AS g) AS gs"
SQL["h"] = f"SELECT {', '.join(HIERARCHY)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey CROSS JOIN {_TWICE} WHERE g = 0 OR o_custkey % 5 = 0"
#: The same buildings once, as connections.
SQL["c"] = f"SELECT {', '.join(HIERARCHY)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS g) AS gs"
#: Line numbers are 1 to 7; four kinds of links are dealt over all of them.
_KIND = "(l_linenumber - 1) % 4 + 1"
_LEVEL = f"CASE {_KIND} WHEN 1 THEN 'LV' WHEN 4 THEN 'HV' ELSE 'MV' END"
LINKS = [
    f"concat({_LEVEL}, '_', cast(l_suppkey AS varchar(20))) AS group_id", f"{_LEVEL} AS voltage_level", f"CASE WHEN {_KIND} <= 2 THEN 'TRANSFORMER' ELSE 'SUBSTATION' END AS station_type",
    "l_partkey % 997 AS station_fid", "min(l_quantity) AS distance_m", "max(1 - l_discount) AS confidence_score",
]
SQL["gs"] = f"SELECT {', '.join(LINKS)} FROM lineitem GROUP BY {_KIND}, l_suppkey, l_partkey % 997"
SEGMENTS = [
    "s_suppkey AS segment_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'MV' ELSE 'LV' END AS voltage_level", "s_suppkey % 20 AS group_id", "s_acctbal / 100.0 AS x0", "cast(s_suppkey % 50 AS double) * 2 AS y0",
    "s_acctbal / 100.0 + 3 + s_suppkey % 5 AS x1", "cast(s_suppkey % 50 AS double) * 2 + 1.25 AS y1", "s_acctbal / 100.0 + 5 + s_suppkey % 5 AS x2", "cast(s_suppkey % 50 AS double) * 2 - 3.5 AS y2",
]
SQL["sg"] = f"SELECT {', '.join(SEGMENTS)} FROM supplier"
FOOTPRINTS = ["c_custkey AS building_id", "c_acctbal / 100.0 + 0.137 AS cx", "cast(c_custkey % 53 AS double) * 2 + 0.271 AS cy", "0.8 + c_custkey % 3 AS half", "c_mktsegment = 'BUILDING' AS non_residential", "c_custkey % 40 AS lv_group"]
SQL["fp"] = f"SELECT {', '.join(FOOTPRINTS)} FROM customer"
WALLS = [
    "o_orderkey AS building_id", "o_custkey % 10 AS lv_group", "cast(o_orderkey % 179 AS double) * 0.9 AS x", "cast((o_orderkey * 7) % 167 AS double) * 0.9 AS y", "cast(o_orderkey % 4 AS double) AS north", "cast((o_orderkey + 1) % 3 AS double) AS east", "cast((o_orderkey + 2) % 5 AS double) AS south", "cast(o_orderkey % 2 AS double) AS west",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'non_residential' ELSE 'residential' END AS function", "CASE cast(o_orderkey % 4 AS int) WHEN 0 THEN 'vrijstaand' WHEN 1 THEN 'twee_onder_1_kap' WHEN 2 THEN 'rijtjeswoning' ELSE 'appartement' END AS housing_type",
    "o_orderkey % 5 = 0 AS has_solar", "o_orderkey % 11 = 0 AS has_battery", "o_orderkey % 13 = 0 AS has_heat_pump", "CASE WHEN o_orderkey % 7 < 3 THEN 'high' ELSE 'low' END AS solar_potential", "o_orderpriority AS district",
]
SQL["wl"] = f"SELECT {', '.join(WALLS)} FROM orders"


def by_sql(name: str, *tables: str):
    """The binding of SQL[name] over driver tables, for Spark."""

    def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: _read(spark, sf_dir, t) for t in tables}
        text = SQL[name]
        for t in tables:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **frames)

    return bound


#: Customers as buildings that might take solar: twelve to a cluster, with all that its rules read.
SOLAR = [
    "c_custkey AS building_id", "cast(floor(c_custkey / 12.0) AS bigint) AS cluster_id", "cast(5 + (c_custkey * 37) % 160 AS double) AS suitable_area", "cast(5 + c_custkey % 17 AS double) AS height",
    "CASE cast(c_custkey % 8 AS int) WHEN 0 THEN 'North' WHEN 1 THEN 'south-east' WHEN 2 THEN 'east' WHEN 3 THEN 'flat' WHEN 4 THEN 'north-east' WHEN 5 THEN 'west' ELSE 'south' END AS orientation",
    "CASE c_mktsegment WHEN 'MACHINERY' THEN 'light industrial' WHEN 'FURNITURE' THEN 'Commercial' WHEN 'AUTOMOBILE' THEN 'office' ELSE 'residential' END AS function",
    "c_custkey % 7 = 0 AS has_solar", "cast(c_custkey % 23 AS double) AS solar_kw", "(c_acctbal + 1100) / 400.0 AS avg_kw", "(c_acctbal + 1100) * 1.5 AS annual_kwh", "cast(20 + (c_custkey * 29) % 110 AS double) AS roof",
    "CASE cast(c_custkey % 9 AS int) WHEN 0 THEN 'A+' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' WHEN 5 THEN 'E' WHEN 6 THEN 'F' WHEN 7 THEN 'G' END AS label",
]
SQL["so"] = f"SELECT {', '.join(SOLAR)} FROM customer"
