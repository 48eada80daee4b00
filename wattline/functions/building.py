"""Derived building columns: every function takes and returns Columns, so they fuse into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age(build_year: Column, year: int = 2024) -> Column:
    """Years since construction within [0, 200]; unknown is 50."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(200), F.lit(year) - build_year)), F.lit(50))


#: The label that a building of an age class has if its own is unknown.
LABEL_OF_AGE = {"< 1945": "F", "1945-1975": "E", "1975-1990": "D", "1990-2005": "C", "2005-2015": "B", "> 2015": "A"}
#: Insulation quality and heat-pump performance by label.
INSULATION = {"A": "excellent", "B": "good", "C": "fair", "D": "fair", "E": "poor", "F": "poor", "G": "very_poor", "Unknown": "unknown"}
COP = {"A": 4.2, "B": 3.7, "C": 3.2, "D": 2.7, "E": 2.3, "F": 2.0, "G": 1.7, "Unknown": 2.5}
#: Heat-pump kW per square metre by age class.
PUMP_KW = {"< 1945": 0.075, "1945-1975": 0.065, "1975-1990": 0.055, "1990-2005": 0.045, "2005-2015": 0.035, "> 2015": 0.025}


def _lookup(table: dict, key: Column, other: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return found if other is None else F.coalesce(found, other)


def simple_label(label: Column, age_range: Column | None = None) -> Column:
    """A with any plus signs is A; what is no label is estimated from the age class (D without one), or Unknown if none is given."""
    known = F.when(label.rlike(r"\AA\+{0,4}\z"), "A").when(label.isin("B", "C", "D", "E", "F", "G"), label)
    return F.coalesce(known, F.lit("Unknown") if age_range is None else _lookup(LABEL_OF_AGE, age_range, F.lit("D")))


def insulation_class(label: Column) -> Column:
    return _lookup(INSULATION, label)


def expected_cop(label: Column) -> Column:
    return _lookup(COP, label)


def battery_readiness(solar_class: Column, mv_capable: Column, function: Column) -> Column:
    return F.when(solar_class.isin("high", "medium"), "ready").when(mv_capable | (function == "non_residential"), "conditional").otherwise("not_ready")


def electrification_feasibility(label: Column) -> Column:
    return F.when(label.isin("F", "G"), "upgrade_needed").when(label.isin("D", "E"), "conditional").otherwise("immediate")


def battery_size(area: Column) -> Column:
    return F.when(area < 100, 5.0).when(area < 150, 7.5).when(area < 200, 10.0).when(area < 300, 13.5).otherwise(15.0)


def battery_power(area: Column) -> Column:
    return F.when(area < 100, 2.5).when(area < 150, 3.5).when(area < 200, 5.0).when(area < 300, 6.5).otherwise(7.5)


def pump_capacity(area: Column, age_range: Column) -> Column:
    return area * _lookup(PUMP_KW, age_range, F.lit(0.05))


def orientation_efficiency(orientation: Column) -> Column:
    return F.when(orientation == "S", 1.0).when(orientation.isin("SE", "SW"), 0.95).when(orientation.isin("E", "W"), 0.85).otherwise(0.7)


def suitable_roof(flat: Column, sloped: Column, orientation: Column) -> Column:
    return flat + sloped * F.when(orientation.isin("S", "SE", "SW"), 0.6).otherwise(0.3)


def solar_capacity_kwp(roof: Column) -> Column:
    return roof * 0.175 * 0.85


def roof_class(roof: Column) -> Column:
    return F.when(roof > 100, "high").when(roof > 50, "medium").when(roof > 25, "low").otherwise("none")


def adjacency_type(north: Column, east: Column, south: Column, west: Column) -> Column:
    """Row position from the shared lengths of the four walls; the first rule that fits counts."""
    on = [c > 0 for c in (north, east, south, west)]
    n = sum((c.cast("int") for c in on), F.lit(0))
    return F.when(n == 0, "ISOLATED").when((on[0] & on[2]) | (on[1] & on[3]), "MIDDLE_ROW").when(n == 2, "CORNER").when(n == 1, "END_ROW").otherwise("COURTYARD")


def features(b: DataFrame, year: int = 2024) -> DataFrame:
    """Age, label, insulation, COP, roof and solar classes, readiness of battery and heat pump, prosumer flag."""
    roof, label = suitable_roof(F.col("roof_flat"), F.col("roof_sloped"), F.col("orientation")), simple_label(F.col("label"), F.col("age_range"))
    solar = roof_class(roof)
    return b.select(
        "building_id", age(F.col("build_year"), year).alias("age"), label.alias("label"), insulation_class(label).alias("insulation"), expected_cop(label).alias("cop"), roof.alias("roof"), solar_capacity_kwp(roof).alias("kwp"), solar.alias("roof_class"),
        battery_readiness(solar, F.col("is_mv_capable"), F.col("function")).alias("battery"), electrification_feasibility(label).alias("electrification"), (F.col("has_solar") | F.col("has_battery") | solar.isin("high", "medium")).alias("prosumer"),
    )


def asset_sizing(b: DataFrame) -> DataFrame:
    """Size and power of a battery, heat-pump capacity and the roof's orientation efficiency."""
    return b.select("building_id", battery_size(F.col("area")).alias("battery_kwh"), battery_power(F.col("area")).alias("battery_kw"), pump_capacity(F.col("area"), F.col("age_range")).alias("pump_kw"), orientation_efficiency(F.col("orientation")).alias("orientation_efficiency"))


def asset_opportunities(b: DataFrame) -> DataFrame:
    """Solar, battery and heat-pump candidates as one list: size, feasibility (heat pumps: none) and priority."""
    roof, label, area = suitable_roof(F.col("roof_flat"), F.col("roof_sloped"), F.col("orientation")), simple_label(F.col("label"), F.col("age_range")), F.col("area")
    solar = roof_class(roof)
    part = lambda keep, kind, size, feasible, priority: b.where(keep).select("building_id", F.lit(kind).alias("asset"), size.alias("size"), feasible.alias("feasibility"), priority.alias("priority"))
    some = solar.isin("high", "medium")
    panels = part(some & ~F.col("has_solar"), "solar", F.when(area < 150, 4.0).when(area < 300, 6.0).otherwise(10.0), F.when(solar == "high", 0.9).otherwise(0.7), F.lit("medium"))
    storage = part((some | (F.col("function") == "non_residential")) & ~F.col("has_battery"), "battery", battery_size(area), F.when(F.col("has_solar") | some, 0.8).otherwise(0.6), F.lit("low"))
    pumps = part(label.isin("D", "E", "F", "G") & ~F.col("has_heat_pump"), "heat_pump", pump_capacity(area, F.col("age_range")), F.lit(None).cast("double"), F.when(label == "G", "1").when(label == "F", "2").when(label == "E", "3").otherwise("4"))
    return panels.unionByName(storage).unionByName(pumps)


def semantic_classes(b: DataFrame, solar_kw: Column) -> DataFrame:
    """Consumer class by annual kWh, efficiency class by label, and whether more than 10 kW of solar fit."""
    use, label = F.col("annual_kwh"), simple_label(F.col("label"))
    return b.select("building_id", F.when(use > 50000, "HighConsumer").when(use < 10000, "LowConsumer").otherwise("NormalConsumer").alias("consumer"), F.when(label.isin("A", "B", "C"), "Efficient").when(label == "D", "Moderate").otherwise("Inefficient").alias("efficiency"), (solar_kw > 10).alias("renewable_ready"))


def present_value(yearly: Column, years: int = 20, growth: float = 0.02, rate: float = 0.05) -> Column:
    """Today's worth of a yearly benefit that grows from the first year on."""
    q = (1 + growth) / (1 + rate)
    return yearly * (q * (1 - q**years) / (1 - q))


def solar_economics(kwp: Column, yearly_kwh: Column, own_share: Column, demand_kwh: Column, cost: float = 1200.0, subsidy: float = 0.3, price: float = 0.25, feed_in: float = 0.08, upkeep: float = 20.0, carbon: float = 0.5, years: int = 20) -> list[Column]:
    """Investment, revenue, benefit, payback, present value, profitability and tons of CO2 of a solar system."""
    net = kwp * cost * (1 - subsidy)
    own = F.least(yearly_kwh * own_share, demand_kwh)
    revenue = own * price + (yearly_kwh - own) * feed_in
    benefit = revenue - kwp * upkeep
    worth = present_value(benefit, years)
    return [
        net.alias("investment"), revenue.alias("revenue"), benefit.alias("benefit"), F.when(benefit > 0, net / benefit).alias("payback"), (worth - net).alias("npv"),
        F.when(net > 0, worth / net).otherwise(0.0).alias("profitability"), (revenue * years).alias("lifetime_revenue"), (yearly_kwh * carbon * years / 1000).alias("co2_tons"),
    ]


def solar_roi(b: DataFrame, yield_kwh: float = 900.0, own_share: float = 0.3) -> DataFrame:
    """solar_economics of each building's roof."""
    kwp = solar_capacity_kwp(suitable_roof(F.col("roof_flat"), F.col("roof_sloped"), F.col("orientation")))
    out = b.select("building_id", kwp.alias("kwp"), "annual_kwh").where("kwp > 0")
    return out.select("building_id", "kwp", *solar_economics(F.col("kwp"), F.col("kwp") * yield_kwh, F.lit(own_share), F.col("annual_kwh")))


def retrofit_economics(b: DataFrame, to: str = "B", price: float = 0.25, carbon: float = 0.5, carbon_price: float = 50.0) -> DataFrame:
    """Label steps to a target at 150 per square metre and step; each saves 15 % of today's consumption."""
    steps = F.ascii(simple_label(F.col("label"), F.col("age_range"))) - ord(to)
    out = b.select("building_id", "area", "annual_kwh", steps.alias("steps")).where("steps > 0")
    saved = F.col("annual_kwh") * F.col("steps") * 0.15
    cost, yearly = F.col("area") * F.col("steps") * 150.0, saved * price
    tons = saved * carbon / 1000
    return out.select("building_id", "steps", cost.alias("investment"), saved.alias("saved_kwh"), yearly.alias("saving"), F.when(yearly > 0, cost / yearly).alias("payback"), (present_value(yearly) - cost).alias("npv"), tons.alias("co2_tons"), (yearly + tons * carbon_price).alias("benefit"))


def irr_of(flows: Column, steps: int = 100, tolerance: float = 1e-4) -> Column:
    """Internal rate of return of an array of yearly flows, the first today, by Newton steps from 10 %.

    It ends when a step is below the tolerance, or where the slope is; the rate found so far is the result then.
    """
    total = lambda r, f: F.aggregate(F.transform(flows, lambda c, t: f(c, t.cast("double"), r)), F.lit(0.0), lambda a, v: a + v)
    worth = lambda r: total(r, lambda c, t, r: c / F.pow(1 + r, t))
    slope = lambda r: total(r, lambda c, t, r: -t * c / F.pow(1 + r, t + 1))
    state = lambda r, d: F.struct(r.alias("rate"), d.alias("done"))

    def step(a: Column, _: Column) -> Column:
        s = slope(a["rate"])
        new = a["rate"] - worth(a["rate"]) / F.when(s != 0, s)
        return F.when(a["done"] | (F.abs(s) < tolerance), state(a["rate"], F.lit(True))).otherwise(state(new, F.abs(new - a["rate"]) < tolerance))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(0.1), F.lit(False)), step, lambda a: a["rate"])


def irr(net: Column, yearly: Column, years: int = 20) -> Column:
    """irr_of a cost today and a level saving."""
    return irr_of(F.concat(F.array(-net.cast("double")), F.array_repeat(yearly.cast("double"), years)))


def grid_deferral(peak_cut_kw: Column, self_sufficiency: Column, buildings: Column) -> list[Column]:
    """What a lower peak (200 a kW) and local supply (150 a kW, 10 kW a building) defer over ten years, and saved upkeep."""
    transformer, line = peak_cut_kw * 200.0, buildings * 10.0 * self_sufficiency * 150.0
    yearly, upkeep = (transformer + line) / 10, buildings * 50.0 * self_sufficiency
    return [transformer.alias("transformer"), line.alias("line"), (transformer + line).alias("deferral"), yearly.alias("annual_value"), upkeep.alias("maintenance"), (yearly + upkeep).alias("benefit")]


def financial_summary(investments: list[Column], benefits: list[Column], tons: Column, carbon_price: float = 50.0) -> list[Column]:
    """Totals over all measures: investment, yearly benefit, payback, return in percent, carbon and its worth."""
    cost, yearly = sum(investments[1:], investments[0]), sum(benefits[1:], benefits[0])
    return [cost.alias("investment"), yearly.alias("benefit"), F.when(yearly > 0, cost / yearly).alias("payback"), F.when(cost > 0, yearly / cost * 100).otherwise(0.0).alias("roi_pct"), tons.alias("co2_tons"), (tons * carbon_price).alias("co2_value")]


def battery_economics(kwh: Column, cycles_a_day: Column, shaved_kw: Column, arbitrage_a_day: Column, cost_per_kwh: float = 500.0, peak_charge: float = 50.0, cycles: float = 5000.0, rate: float = 0.05) -> list[Column]:
    """Investment, lifetime (at most 10 years), yearly benefit, payback and present value over whole years."""
    investment, lifetime = kwh * cost_per_kwh, F.least(F.lit(cycles) / (cycles_a_day * 365), F.lit(10.0))
    yearly = shaved_kw * peak_charge * 12 + arbitrage_a_day * 365
    worth = yearly * (1 - F.pow(F.lit(1 + rate), -F.floor(lifetime))) / rate - investment
    return [investment.alias("investment"), lifetime.alias("lifetime"), yearly.alias("benefit"), F.when(yearly > 0, investment / yearly).alias("payback"), worth.alias("npv")]


def community_benefits(buildings: Column, shared_kwh: Column, peak_cut: Column, mean_kwh: Column, price: float = 0.25, feed_in: float = 0.08, peak_charge: float = 50.0, bonus: float = 0.1) -> list[Column]:
    """Yearly benefit of sharing, a lower peak (three times the mean), the community bonus and saved losses (2 %)."""
    total = buildings * mean_kwh
    sharing, peak = shared_kwh * (price - feed_in), total / 8760 * 3 * peak_cut * peak_charge * 12
    yearly = sharing + peak + shared_kwh * price * bonus + total * 0.02 * price
    return [sharing.alias("sharing"), peak.alias("peak"), yearly.alias("total"), F.try_divide(yearly, buildings).alias("per_building")]
