"""Derived score columns of raw building tables; which columns exist decides the expression, not a pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Synonyms of canonical building columns, the first that exists counts.
SYNONYMS = {
    "area": ("area", "floor_area", "oppervlakte"), "build_year": ("build_year", "bouwjaar", "construction_year"), "height": ("height", "gem_hoogte", "hoogte"), "energy_label": ("energy_label", "meestvoorkomendelabel", "label"),
    "roof_flat": ("roof_flat", "b3_opp_dak_plat", "flat_roof_area"), "roof_sloped": ("roof_sloped", "b3_opp_dak_schuin", "sloped_roof_area"), "annual_kwh": ("annual_kwh", "annual_consumption_kwh"), "peak_kw": ("peak_kw", "peak_demand_kw"),
}
LABELS = "ABCDEFG"


def canonicalize(df: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """df with its canonical columns: the first synonym found exactly, else without regard to case; numbers are
    coerced (null: 0), labels become 7 (A) to 1 (G), 0 where unknown. Other columns stay; absent ones are left out."""
    low = {c.lower(): c for c in reversed(df.columns)}
    out = {}
    for name, others in synonyms.items():
        found = next((c for c in others if c in df.columns), None) or next((low[c.lower()] for c in others if c.lower() in low), None)
        if found:
            v = F.col(f"`{found}`")
            place = F.instr(F.lit(LABELS), F.substring(v, 1, 1)) if name == "energy_label" else None
            out[name] = F.coalesce(v.try_cast("double"), F.lit(0.0)) if place is None else F.when(v.rlike(r"\A(A\+{0,4}|[B-G])\z"), 8 - place).otherwise(0)
    return df.withColumns(out)


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def solar_potential(df: DataFrame, flat: str, sloped: str, south: str) -> DataFrame:
    """(flat + sloped) / 200 within 0 and 1, plus a fifth of the south facade over the largest one."""
    top = df.agg(F.max(south).alias("_top"))
    base = unit((F.coalesce(F.col(flat), F.lit(0.0)) + F.coalesce(F.col(sloped), F.lit(0.0))) / 200)
    return df.crossJoin(F.broadcast(top)).withColumn("solar_potential", unit(base + F.coalesce(F.try_divide(F.coalesce(F.col(south), F.lit(0.0)), F.col("_top")), F.lit(0.0)) * 0.2)).drop("_top")  # one row


def insulation_score(label_value: Column | None, build_year: Column | None) -> Column:
    """Label / 7, or (year - 1900) / 120 (unknown year: 1970) where only that is known; else a half."""
    if label_value is not None:
        return F.coalesce(label_value, F.lit(0)) / 7.0
    return unit((F.coalesce(build_year, F.lit(1970)) - 1900) / 120) if build_year is not None else F.lit(0.5)


def daily_consumption(annual: Column | None = None, peak: Column | None = None, area: Column | None = None) -> Column:
    """Annual / 365, else peak x 8, else 150 kWh per square metre and year within 10 and 1000; 50 without any."""
    if annual is not None:
        return F.coalesce(annual, F.lit(0.0)) / 365
    if peak is not None:
        return F.coalesce(peak, F.lit(0.0)) * 8
    return F.least(F.greatest(F.coalesce(area, F.lit(100.0)) * 150 / 365, F.lit(10.0)), F.lit(1000.0)) if area is not None else F.lit(50.0)


def compactness(area: Column, height: Column) -> Column:
    """Volume over surface, a tenth of it within 0 and 1."""
    a, h = F.coalesce(area, F.lit(100.0)), F.coalesce(height, F.lit(3.0))
    return F.least(F.greatest(a * h / (2 * a + 4 * F.sqrt(a) * h + 1e-6), F.lit(0.0)), F.lit(10.0)) / 10


def shared_wall_ratio(shared: Column, wall: Column) -> Column:
    s, w = F.coalesce(shared, F.lit(0.0)), F.coalesce(wall, F.lit(1.0))
    return unit(s / (w + s + 1e-6))


def scale(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with z-scores of the columns, the one-row frame of means and population deviations to reuse or store)."""
    fit = fitted if fitted is not None else df.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.stddev_pop(c).alias(f"{c}_std") for c in columns))
    z = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") != 0, F.col(f"{c}_std")).otherwise(1.0) for c in columns}
    return df.crossJoin(F.broadcast(fit)).withColumns(z).select(*df.columns), fit  # one row


def building_features(area: Column, elec: Column, heat: Column, energy_score: Column, age: Column, roof: Column, solar_score: Column, electrify: Column, solar: Column, battery: Column, pump: Column, peak: Column, walls: Column) -> list[Column]:
    """Seven ratios and products of scaled columns; flags are 0 or 1."""
    return [
        ((elec + heat) / (area + 1e-6)).alias("intensity"), ((1 - energy_score) * 0.6 + age * 0.4).alias("retrofit"), (roof * solar_score * (1 - solar * 0.5)).alias("solar_fit"), (electrify * heat * (1 - pump * 0.5)).alias("electrify_fit"),
        ((solar + battery + pump) / 3.0).alias("systems"), (peak / ((elec + heat) / 2 + 1e-6)).alias("peak_ratio"), walls.alias("shared_walls"),
    ]


def group_features(diversity: Column, buildings: Column, roof: Column, avg_kw: Column, peak_kw: Column, length_m: Column, systems: Column) -> list[Column]:
    return [(diversity * F.log1p(buildings) / 10).alias("diversity_efficiency"), (roof / (avg_kw * 100 + 1e-6)).alias("self_supply"), (peak_kw / (length_m + 1e-6)).alias("stress"), (systems / (buildings + 1e-6)).alias("penetration")]


def cluster_features(self_sufficiency: Column, solar: Column, pump: Column, battery: Column, export: Column, demand: Column, thermal: Column, cable: Column, sharing: Column, members: Column) -> list[Column]:
    return [
        (self_sufficiency * (1 + solar + battery) / 3).alias("self_supply"), ((solar + pump + battery) / 3).alias("systems"), (export / (demand + 1e-6)).alias("sharing"),
        ((thermal + cable + sharing / 1000) / 3).alias("economic"), (F.log1p(F.greatest(members, F.lit(0))) / 10).alias("density"),
    ]


#: The columns that each planning task looks at.
TASKS = {
    "retrofit": ("building_id", "area", "label", "build_year", "annual_kwh"), "solar": ("building_id", "roof_flat", "roof_sloped", "orientation", "has_solar"), "electrification": ("building_id", "area", "label", "age_range", "has_heat_pump"),
    "battery": ("building_id", "area", "has_solar", "has_battery", "peak_kw"), "congestion": ("building_id", "lv_group", "peak_kw", "distance_m"),
}


def task_features(df: DataFrame, task: str) -> DataFrame:
    """df's columns for a task, in the task's order; those it lacks are left out."""
    return df.select(*(c for c in TASKS[task] if c in df.columns))


def label_roi(generation_kwh: Column, days: Column, kw: Column, cost: Column, own_rate: Column, peak_cut: Column, least_days: int = 30, price: float = 0.25, feed_in: float = 0.08, upkeep: float = 20.0) -> list[Column]:
    """Years to pay back from observed generation (1200 kWh a kW before ``least_days``), class and confidence."""
    yearly = F.when(days >= least_days, generation_kwh / F.when(days > 0, days) * 365).otherwise(kw * 1200.0)
    net = yearly * own_rate * price + yearly * (1 - own_rate) * feed_in - kw * upkeep
    years = F.when(net > 0, cost / net)
    label = F.when(days < least_days, "unknown").when(years < 5, "excellent").when(years < 7, "good").when(years < 10, "fair").otherwise("poor")
    boost = F.when(peak_cut > 0.3, 1.1).otherwise(1.0) * F.when(own_rate > 0.7, 1.1).otherwise(1.0)
    return [years.alias("roi_years"), label.alias("label"), F.when(days < least_days, 0.0).otherwise(F.least(F.least(days / F.lit(least_days), F.lit(1.0)) * boost, F.lit(1.0))).alias("confidence")]
