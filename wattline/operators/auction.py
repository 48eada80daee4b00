"""One-to-one assignment of least total cost inside groups, by auctions whose rounds are joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import _checkpoint, small_broadcasts


def _doubled(costs: DataFrame) -> DataFrame:
    """(g, person, object, value, scale): a balanced instance that always has a perfect assignment and is as sparse as the given one.

    Beside a -> b stands its mirror b' -> a'; a -> a' leaves a alone at a cost above any that pairing could save, and b' -> b
    leaves b alone at none. Each half of a best assignment is a best one of the group.
    """
    size = costs.groupBy("g").agg((F.max("cost") - F.min("cost")).alias("range"), F.max(F.abs("cost")).alias("most"), F.least(F.count_distinct("a"), F.count_distinct("b")).alias("n"))
    c = costs.join(size, "g")
    alone = (F.col("most") * 2 + F.col("range") + 1) * (F.col("n") + 1)
    scale = F.greatest("range", F.lit(1e-6))
    end = lambda kind, col: F.struct(F.lit(kind).alias("k"), F.col(col).alias("id"))
    pairs = c.select("g", F.explode(F.array(F.struct(end(0, "a").alias("person"), end(1, "b").alias("object")), F.struct(end(3, "b").alias("person"), end(2, "a").alias("object")))).alias("e"), (-F.col("cost")).alias("value"), scale.alias("scale"), alone.alias("alone")).select("g", "e.*", "value", "scale", "alone")
    single = c.groupBy("g", F.col("a").alias("x")).agg(F.first(alone).alias("alone"), F.first(scale).alias("scale")).select("g", end(0, "x").alias("person"), end(2, "x").alias("object"), (-F.col("alone")).alias("value"), "scale", "alone")
    other = c.groupBy("g", F.col("b").alias("x")).agg(F.first(alone).alias("alone"), F.first(scale).alias("scale")).select("g", end(3, "x").alias("person"), end(1, "x").alias("object"), F.lit(0.0).alias("value"), "scale", "alone")
    return pairs.unionByName(single).unionByName(other)


def assignment_matching(costs: DataFrame, key: list[str], precision: float = 1e-3, step: float = 6.0, rounds: int = 5000) -> DataFrame:
    """(key, a, b, cost, slack): for each group as many pairs as can be matched one to one, at the least total cost up to ``slack``.

    Every unassigned person bids for the object of best value less price, up to where its second choice is as good, plus
    epsilon; each object goes to its highest bid and takes that price. Epsilon starts at a quarter of what leaving one alone costs and is
    divided by ``step`` when all are assigned, prices staying, until it is ``precision`` times the range of costs over the persons. All groups run in the same rounds; a
    round joins the bidders' pairs with prices and takes two best values a person, then one best bid an object, so
    neither a large group nor a hub is gathered anywhere. ``slack`` is persons x epsilon, the most by which the total may exceed
    the least. Pairs not in ``costs`` cannot be matched; of pairs given twice the cheaper counts; null ends or costs are left out. Raises if
    the rounds do not suffice.
    """
    group = F.struct(*key)
    c = costs.where("a IS NOT NULL AND b IS NOT NULL AND cost IS NOT NULL").groupBy(group.alias("g"), "a", "b").agg(F.min(F.round("cost", 9)).alias("cost"))
    c = _checkpoint(c)
    e = _checkpoint(_doubled(c).repartition("g", "person"))
    people = _checkpoint(e.groupBy("g").agg(F.count_distinct("person").alias("n"), F.first("scale").alias("scale"), F.max("alone").alias("alone")))
    last = F.col("scale") * precision / F.col("n")
    now = _checkpoint(e.select("g", "object").distinct().select("g", "object", F.lit(0.0).alias("price"), F.lit(None).cast(e.schema["person"].dataType).alias("owner")))
    persons = _checkpoint(e.select("g", "person").distinct())
    phase, used = 0, 0
    while True:
        eps = _checkpoint(people.select("g", F.greatest(F.col("alone") / 4 / step**phase, last).alias("eps"), last.alias("last")))
        now = now.withColumn("owner", F.lit(None).cast(e.schema["person"].dataType))
        with small_broadcasts(e.sparkSession):
            while True:
                free = persons.join(now.where("owner IS NOT NULL").select("g", F.col("owner").alias("person")), ["g", "person"], "left_anti")
                v = e.join(free, ["g", "person"]).join(now.select("g", "object", "price"), ["g", "object"]).withColumn("net", F.col("value") - F.col("price"))
                order = Window.partitionBy("g", "person").orderBy(F.desc("net"), "object")
                two = v.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("g", "person").agg(F.max("net").alias("best"), F.min("net").alias("second"), F.count("*").alias("k"), F.max(F.when(F.col("r") == 1, F.struct("object", "price", "alone"))).alias("o"))
                bid = F.col("o.price") + F.when(F.col("k") > 1, F.col("best") - F.col("second")).otherwise(F.col("o.alone")) + F.col("eps")
                bids = two.join(eps, "g").select("g", F.col("o.object").alias("object"), bid.alias("bid"), "person").groupBy("g", "object").agg(F.max(F.struct("bid", "person")).alias("b"))
                after = now.join(bids, ["g", "object"], "left").select("g", "object", F.coalesce("b.bid", "price").alias("price"), F.coalesce("b.person", "owner").alias("owner"), F.col("b").isNotNull().alias("_new"))
                after = _checkpoint(after)
                used += 1
                if used > rounds:
                    raise RuntimeError("assignment_matching did not converge")
                now = after.drop("_new")
                if after.where("_new").isEmpty():
                    break
        phase += 1
        if eps.where("eps > last").isEmpty():
            break
    pairs = now.where("object.k = 1 AND owner.k = 0").select("g", F.col("owner.id").alias("a"), F.col("object.id").alias("b"))
    slack = people.select("g", (F.col("n") * last).alias("slack"))
    return pairs.join(c, ["g", "a", "b"]).join(slack, "g").select("g.*", "a", "b", "cost", "slack")
