"""Energy communities: clusterings of buildings and the measures that compare them.

Pairs (group, a, b, weight) are formed inside LV groups only, whose size the grid bounds; every clustering takes such pairs (or
profiles) and gives (building_id, cluster_id). Rounds are joins and aggregates whose results are stored, so plans stay short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .auction import assignment_matching  # noqa: F401  part of this module's surface
from .components import _checkpoint, connected_components
from .graphs import both_ways
from .modularity import modularity_communities  # noqa: F401  part of this module's surface
from .ranking import running


def _both(pairs: DataFrame, *more: str) -> DataFrame:
    return both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), *more))


def profile_similarity(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs (a, b, complementarity) whose profiles correlate above ``least``: correlation = 1 - 2 x complementarity."""
    return pairs.withColumn("similarity", 1 - 2 * F.col("complementarity")).where(F.col("similarity") > least).select("a", "b", "similarity")


def similar_groups(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(building_id, cluster_id): what profile_similarity connects."""
    return connected_components(profile_similarity(pairs, least), "a", "b").select(F.col("node").alias("building_id"), F.col("component").alias("cluster_id"))


def kmeans_profiles(profiles: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(building_id, cluster_id): k-means over standardised profiles (building_id, profile array)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = profiles.select("building_id", array_to_vector("profile").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=k, seed=seed).fit(scaled).transform(scaled).select("building_id", F.col("prediction").cast("long").alias("cluster_id"))


def spectral_communities(affinity: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(building_id, cluster_id): power iteration over non-negative affinities (a, b, weight)."""
    from pyspark.ml.clustering import PowerIterationClustering

    p = PowerIterationClustering(k=k, maxIter=rounds, srcCol="a", dstCol="b", weightCol="weight")
    return p.assignClusters(affinity.select("a", "b", "weight")).select(F.col("id").alias("building_id"), F.col("cluster").cast("long").alias("cluster_id"))


def affinity(pairs: DataFrame, adjacency: DataFrame, mix: float = 0.7) -> DataFrame:
    """0.7 x similarity within 0 and 1 + 0.3 x adjacency (a, b) of pairs (a, b, complementarity)."""
    near = adjacency.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1.0).alias("n")).distinct()
    return pairs.join(near, ["a", "b"], "left").select("a", "b", (mix * (1 - F.col("complementarity")) + (1 - mix) * F.coalesce("n", F.lit(0.0))).alias("weight"))


def opposing_weight(complementarity: Column) -> Column:
    """1 - |correlation| where profiles oppose each other, else 0.1."""
    r = 1 - 2 * complementarity
    return F.when(r < 0, 1 - F.abs(r)).otherwise(0.1)


def hierarchy_affinity(pairs: DataFrame, places: DataFrame, same_transformer: float = 0.5, other: float = 0.1, decay: float = 0.5) -> DataFrame:
    """(a, b, weight): complementarity x (1 in one cable group, ``same_transformer`` under one transformer, else ``other``) x exp(-decay x electrical distance).

    places: building_id, cable_group, transformer. The distance is 1 in a cable group, 2 under a transformer, else 3.
    """
    side = lambda c: places.select(F.col("building_id").alias(c), F.col("cable_group").alias(f"g{c}"), F.col("transformer").alias(f"t{c}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    d = F.when(F.col("ga") == F.col("gb"), 1).when(F.col("ta") == F.col("tb"), 2).otherwise(3)
    share = F.when(d == 1, 1.0).when(d == 2, same_transformer).otherwise(other)
    return j.select("a", "b", d.alias("electrical_distance"), (F.col("complementarity") * share * F.exp(-decay * d)).alias("weight"))


def correlation_clusters(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(building_id, cluster_id): parallel pivot over opposing pairs (a, b); nodes alone keep their own id.

    The free nodes whose hash is below those of all their free neighbours are pivots; neighbours join the pivot of smallest hash.
    """
    e = _checkpoint(_both(pairs).distinct())
    h = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("n"))
    free = _checkpoint(e.select(F.col("src").alias("node")).distinct())
    done = None
    for _ in range(rounds):
        near = e.join(free.select(F.col("node").alias("src")), "src", "left_semi").join(free.select(F.col("node").alias("dst")), "dst", "left_semi")
        low = near.groupBy("src").agg(F.min(h("dst")).alias("m"))
        pivots = free.join(low.select(F.col("src").alias("node"), "m"), "node", "left").where(F.col("m").isNull() | (h("node") < F.col("m"))).select("node")
        pivots = _checkpoint(pivots)
        joined = near.join(pivots.select(F.col("node").alias("dst")), "dst").join(pivots.select(F.col("node").alias("src")), "src", "left_anti").groupBy(F.col("src").alias("node")).agg(F.min(h("dst")).alias("m")).select("node", F.col("m.n").alias("c"))
        got = _checkpoint(joined.unionByName(pivots.select("node", F.col("node").alias("c"))))
        done = got if done is None else done.unionByName(got)
        free = _checkpoint(free.join(got, "node", "left_anti"))
        if free.isEmpty():
            break
    else:
        raise RuntimeError("correlation_clusters did not converge")
    return done.select(F.col("node").alias("building_id"), F.col("c").alias("cluster_id"))


def stable_matching(scores: DataFrame, capacity: int = 5, rounds: int = 1000) -> DataFrame:
    """(producer, consumer, score): deferred acceptance; consumers propose, a producer keeps its ``capacity`` best (ties: smaller ids)."""
    s = _checkpoint(scores.select("producer", "consumer", F.round("score", 9).alias("score")))
    open_, held = s, None
    for _ in range(rounds):
        first = open_.groupBy("consumer").agg(F.min(F.struct((-F.col("score")).alias("s"), "producer")).alias("m")).select("consumer", F.col("m.producer").alias("producer"), (-F.col("m.s")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("producer").orderBy(F.desc("score"), "consumer"))
        ranked = _checkpoint(first.withColumn("r", rank))
        held = ranked.where(F.col("r") <= capacity).select("producer", "consumer", "score")
        refused = ranked.where(F.col("r") > capacity).select("producer", "consumer")
        if refused.isEmpty():
            break
        open_ = _checkpoint(open_.join(refused, ["producer", "consumer"], "left_anti"))
    else:
        raise RuntimeError("stable_matching did not converge")
    return held


def blocking_pairs(scores: DataFrame, matches: DataFrame, capacity: int = 5) -> DataFrame:
    """One row: pairs outside the matching whose both sides would rather have each other."""
    c = matches.select("consumer", F.col("score").alias("mine"))
    p = matches.groupBy("producer").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    j = scores.select("producer", "consumer", F.round("score", 9).alias("score")).join(matches.select("producer", "consumer"), ["producer", "consumer"], "left_anti").join(c, "consumer", "left").join(p, "producer", "left")
    wants = F.col("mine").isNull() | (F.col("score") > F.col("mine"))
    room = F.col("n").isNull() | (F.col("n") < capacity) | (F.col("score") > F.col("worst"))
    return j.agg(F.count_if(wants & room).alias("blocking"))


def random_walks(edges: DataFrame, length: int = 8, walks: int = 4, seed: int = 7) -> DataFrame:
    """(walk array): from every node, each step to a neighbour picked by hash in proportion to weight."""
    e = _checkpoint(both_ways(edges.select("src", "dst", "weight")))
    w = Window.partitionBy("src").orderBy("dst")
    e = _checkpoint(e.withColumns({"hi": F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("weight").over(Window.partitionBy("src"))}).withColumns({"lo": (F.col("hi") - F.col("weight")) / F.col("all"), "hi": F.col("hi") / F.col("all")}))
    at = e.select(F.col("src").alias("node")).distinct().select("node", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.array("node").alias("path"))
    at = at.withColumn("start", F.col("node"))
    for i in range(length - 1):
        u = F.pmod(F.xxhash64("start", "walk", F.lit(i), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        at = _checkpoint(at.withColumn("u", u).join(e, F.col("node") == F.col("src")).where("u >= lo AND u < hi").select("start", "walk", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
    return at.select(F.transform("path", lambda n: n.cast("string")).alias("walk"))


def walk_clusters(edges: DataFrame, k: int, dims: int = 16, seed: int = 7) -> DataFrame:
    """(building_id, cluster_id): k-means over embeddings that random walks give."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dims, minCount=0, seed=seed, inputCol="walk", outputCol="v").fit(random_walks(edges, seed=seed))
    v = model.getVectors().withColumnRenamed("vector", "features")
    return KMeans(k=k, seed=seed).fit(v).transform(v).select(F.col("word").cast("long").alias("building_id"), F.col("prediction").cast("long").alias("cluster_id"))


#: A group of more buildings than this is cut into parts of alike profiles before its distances are taken.
GROUP_ROWS = 1500


def _chain(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage merges (i, j, distance) of a distance matrix by nearest-neighbour chains, in n squared steps; the merged cluster keeps the smaller index."""
    d, n = d.copy(), len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        j = int(np.argmin(np.where(alive, d[i], np.inf)))
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
            chain = chain[:-2]
            lo, hi = min(i, j), max(i, j)
            merges.append((lo, hi, float(d[i, j])))
            mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            mean[[lo, hi]] = np.inf
            d[lo], d[:, lo], size[lo], alive[hi] = mean, mean, size[i] + size[j], False
        else:
            chain.append(j)
    return sorted(merges, key=lambda m: m[2])


def _sized(parts: list[list[int]], d: np.ndarray, smallest: int, largest: int) -> list[list[int]]:
    """Parts of ``smallest`` to ``largest`` members: large ones halved along their own tree, small ones joined to the nearest with room."""
    done: list[list[int]] = []
    queue = [sorted(p) for p in parts]
    while queue:
        p = queue.pop()
        if len(p) <= largest:
            done.append(p)
            continue
        halves = _cut(p, _chain(d[np.ix_(p, p)]), 2)
        queue += halves
    done.sort()
    while len(done) > 1 and (small := min(done, key=lambda p: (len(p), p))) and len(small) < smallest:
        others = [p for p in done if p is not small]
        near = lambda p: (float(d[np.ix_(small, p)].mean()), p)  # noqa: B023, E731
        room = [p for p in others if len(p) + len(small) <= largest]
        if room:
            host = min(room, key=near)
            done = sorted([p for p in done if p is not small and p is not host] + [sorted(host + small)])
        else:  # all others are full: one gives its nearest members
            host = min((p for p in others if len(p) - 1 >= smallest), key=near)
            give = min(host, key=lambda x: (float(d[x, small].mean()), x))
            done = sorted([p for p in done if p is not small and p is not host] + [sorted([*small, give]), [x for x in host if x != give]])
    return done


def _cut(members: list[int], merges: list[tuple[int, int, float]], k: int) -> list[list[int]]:
    """The k clusters that are left when the last k - 1 merges are not made."""
    part = {i: [m] for i, m in enumerate(members)}
    for i, j, _ in merges[: len(members) - k]:
        part[i] = part[i] + part.pop(j)
    return [sorted(p) for p in part.values()]


def group_clusters(x: np.ndarray, smallest: int, largest: int) -> list[list[int]]:
    """The clusters of one group's profiles: for every possible number of clusters the tree is cut and the sizes are mended; the best by the rule of the validity index is taken (ties: fewer).

    The index is the sum over clusters of the mean opposite correlation inside, less half the squared variation of their sizes.
    """
    n = len(x)
    if n <= largest:
        return [list(range(n))]
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    x = x / np.where(norm > 0, norm, 1)[:, None]
    r = np.round(x @ x.T, 9)
    d = 1 + r  # 0: opposite, 2: alike
    merges, best = _chain(d), None
    for k in range(max(2, n // largest), max(2, n // smallest) + 1):
        parts = _sized(_cut(list(range(n)), merges, min(k, n)), d, smallest, largest)
        size = np.array([len(p) for p in parts])
        inside = sum((len(p) - r[np.ix_(p, p)].sum()) / (len(p) * (len(p) - 1)) for p in parts if len(p) > 1)
        score = round(float(inside - 0.5 * size.var() / size.mean() ** 2), 9)
        if best is None or score > best[0]:
            best = score, parts
    return best[1]


def lv_group_clustering(profiles: DataFrame, smallest: int = 3, largest: int = 20) -> DataFrame:
    """(lv_group, building_id, cluster_id): clusters of ``smallest`` to ``largest`` opposing profiles inside each LV group, cluster_id the smallest building.

    profiles: lv_group, building_id, profile (arrays of one length in a group). A group of at most ``largest`` buildings is one cluster, however
    small; in every other all clusters have a size between the two (``largest`` should be at least twice ``smallest``).
    The number of clusters is the one whose index is best, see ``group_clusters``. An LV group is what one transformer
    feeds; should a group have over ``GROUP_ROWS`` buildings, its order by the mean of the first less the second half of the profile
    is cut into parts of that size first, by ranges and without gathering the group, so no task holds more.
    """
    half = "aggregate(slice({0}, {1}, greatest(1, size({0}) div 2)), 0D, (t, x) -> t + x)"
    p = profiles.where("profile IS NOT NULL AND building_id IS NOT NULL").select("lv_group", "building_id", F.col("profile").cast("array<double>").alias("profile"))
    size = p.groupBy("lv_group").agg(F.count("*").alias("group_size"))
    p = p.join(size, "lv_group").withColumn("_lean", F.expr(half.format("profile", "1") + " - " + half.format("profile", "1 + size(profile) div 2")))
    small = p.where(F.col("group_size") <= GROUP_ROWS).withColumn("_part", F.lit(0).cast("long"))
    ranked = running(p.where(F.col("group_size") > GROUP_ROWS), ["lv_group"], "_lean", "building_id")
    parts = F.ceil(F.col("group_size") / GROUP_ROWS)
    large = ranked.withColumn("_part", F.floor((F.col("rank") - 1) * parts / F.col("group_size")).cast("long")).drop("rank")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("building_id")
        ids = rows["building_id"].to_numpy()
        label = np.empty(len(rows), np.int64)
        for c in group_clusters(np.stack(rows["profile"].to_numpy()).astype(float), smallest, largest):
            label[c] = ids[min(c)]
        return pd.DataFrame({"lv_group": rows["lv_group"].to_numpy(), "building_id": ids, "cluster_id": label})

    return small.unionByName(large).groupBy("lv_group", "_part").applyInPandas(fit, "lv_group long, building_id long, cluster_id long")


def mutual_information(s: DataFrame, bins: int = 4, group: str = "lv_group") -> DataFrame:
    """(a, b, h_a, h_b, h, mi) of building pairs of a group: loads in equal-width bins of each building's range, joint over common slots."""
    own = Window.partitionBy("building_id")  # over the same rows: means added up twice in another order would fall below their own least
    place = F.least(F.floor((F.col("demand") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins), F.lit(bins - 1))
    x = s.withColumns({"lo": F.min("demand").over(own), "hi": F.max("demand").over(own)}).select(group, "building_id", "slot", place.alias("bin"))
    j = x.select(group, "slot", F.col("building_id").alias("a"), F.col("bin").alias("x")).join(x.select(group, "slot", F.col("building_id").alias("b"), F.col("bin").alias("y")), [group, "slot"]).where("a < b")
    c = j.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    h = lambda keys, name: c.groupBy("a", "b", *keys).agg(F.sum("n").alias("n")).groupBy("a", "b").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name))
    out = h(["x"], "h_a").join(h(["y"], "h_b"), ["a", "b"]).join(h(["x", "y"], "h"), ["a", "b"])
    return out.withColumn("mi", F.col("h_a") + F.col("h_b") - F.col("h"))


#: Weights of the cluster scores.
OVERALL = {"self_sufficiency": 0.3, "complementarity": 0.3, "peak_reduction": 0.2, "compactness": 0.1, "energy_balance": 0.05, "load_diversity": 0.05}
ENHANCED = {"self_sufficiency": 0.20, "complementarity": 0.20, "peak_reduction": 0.15, "temporal_stability": 0.15, "self_consumption": 0.10, "diversity": 0.10, "size": 0.05, "compactness": 0.05}
SCORECARD = {"peak_reduction": 0.25, "self_sufficiency": 0.25, "complementarity": 0.20, "fairness": 0.10, "diversity": 0.05}


def _weighted(columns: list[str], weights: dict[str, float]) -> tuple[Column, float]:
    some = {k: w for k, w in weights.items() if k in columns}
    return sum((F.col(k) * w for k, w in some.items()), F.lit(0.0)), sum(some.values())


def overall_score(m: DataFrame) -> DataFrame:
    """m with ``overall``: weighted mean of its measures, a tenth of it across LV borders, 0.8 of it out of size."""
    s, total = _weighted(m.columns, OVERALL)
    cut = F.when(F.col("lv_violations") > 0, 0.1).otherwise(1.0) * F.when(F.col("size_violations") > 0, 0.8).otherwise(1.0)
    return m.withColumn("overall", F.least(F.greatest(s * cut / (total or 1.0), F.lit(0.0)), F.lit(1.0)))


def quality_label(m: DataFrame, days: Column, least_days: int = 7) -> DataFrame:
    """m with score, class (0.8, 0.6, 0.4) and confidence, which grows with the days observed up to 0.95."""
    s, total = _weighted(m.columns, OVERALL)
    score = F.least(F.greatest(s / (total or 1.0), F.lit(0.0)), F.lit(1.0))
    others = [F.col(c) for c in OVERALL if c in m.columns and c != "complementarity"]
    mean = sum(others[1:], others[0]) / len(others)
    time = F.when(days >= least_days, F.least(F.lit(1.0), 0.7 + days / (least_days * 4))).otherwise(days / least_days * 0.7)
    sure = F.when((mean > 0.8) | (mean < 0.2), 0.9).otherwise(0.7)
    return m.withColumns({"score": score, "quality": F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor"), "confidence": F.least(0.7 * time + 0.3 * sure, F.lit(0.95))})


def enhanced_quality(m: DataFrame) -> DataFrame:
    """m with a score of 0 to 100 and its class (80, 60, 40)."""
    s, _ = _weighted(m.columns, ENHANCED)
    score = F.least(s * 100, F.lit(100.0))
    return m.withColumns({"enhanced": score, "enhanced_class": F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")})


def scorecard(m: DataFrame) -> DataFrame:
    """m with ``card``, the weighted score with 0.15 / (1 + violations), and its strengths as text."""
    s, _ = _weighted(m.columns, SCORECARD)
    good = F.concat_ws(", ", F.when(F.col("peak_reduction") > 0.15, "High peak reduction"), F.when(F.col("self_sufficiency") > 0.3, "Good self-sufficiency"), F.when(F.col("violations") == 0, "No constraint violations"), F.when(F.col("fairness") > 0.8, "Fair benefit distribution"))
    return m.withColumns({"card": F.least(F.lit(1.0), F.greatest(F.lit(0.0), s + 0.15 / (1 + F.col("violations")))), "strengths": good})


def violations(assignment: DataFrame, groups: DataFrame, smallest: int = 3, largest: int = 20) -> DataFrame:
    """One row: clusters over several LV groups, clusters out of size, LV groups split over clusters."""
    j = assignment.join(groups.select("building_id", "lv_group"), "building_id")
    c = j.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("lv_group").alias("g"))
    one = c.agg(F.count_if(F.col("g") > 1).alias("lv_violations"), F.count_if(~F.col("n").between(smallest, largest)).alias("size_violations"))
    split = j.groupBy("lv_group").agg(F.count_distinct("cluster_id").alias("k")).agg(F.count_if(F.col("k") > 1).alias("split_groups"))
    return one.crossJoin(split)  # one-row frames


def method_comparison(scores: DataFrame, base: str, replicates: int = 100, seed: int = 5) -> DataFrame:
    """(method, mean, low, high, gain_pct) of scores (method, cluster_id, score): means, 95 % bootstrap bounds, improvement over a base.

    A replicate gives each row a Poisson weight from a hash, so rows are never drawn or collected.
    """
    u = F.pmod(F.xxhash64("method", "cluster_id", "r", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    limits, p, total = [], np.exp(-1.0), 0.0
    for k in range(6):
        total += p
        limits.append(float(total))
        p /= k + 1
    weight = sum(((F.col("u") >= c).cast("int") for c in limits), F.lit(0))
    reps = scores.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u).withColumn("w", weight)
    boot = reps.groupBy("method", "r").agg(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")).alias("m")).groupBy("method").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = scores.groupBy("method").agg(F.avg("score").alias("mean"))
    of = mean.where(F.col("method") == base).select(F.col("mean").alias("base"))
    return mean.join(boot, "method").crossJoin(F.broadcast(of)).select("method", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.when(F.col("base") != 0, (F.col("mean") - F.col("base")) / F.col("base") * 100).alias("gain_pct"))  # one row


def embedding_quality(points: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row over points (id, v array): mean distance to the own centroid, mean distance between centroids and their mean, and the ratio."""
    j = points.join(assignment.select(F.col("building_id").alias("id"), "cluster_id"), "id")
    long = j.select("id", "cluster_id", F.posexplode("v").alias("i", "x"))
    centre = long.groupBy("cluster_id", "i").agg(F.avg("x").alias("c"))
    own = long.join(centre, ["cluster_id", "i"]).groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("c"), 2))).alias("d")).agg(F.avg("d").alias("cohesion"))
    mean = centre.groupBy("i").agg(F.avg("c").alias("m"))
    apart = centre.join(mean, "i").groupBy("cluster_id").agg(F.sqrt(F.sum(F.pow(F.col("c") - F.col("m"), 2))).alias("d")).agg(F.avg("d").alias("separation"))
    return own.crossJoin(apart).withColumn("ratio", F.try_divide("separation", "cohesion"))  # one-row frames


def silhouette(points: DataFrame, assignment: DataFrame) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    j = points.join(assignment.select(F.col("building_id").alias("id"), "cluster_id"), "id").select(array_to_vector("v").alias("features"), F.col("cluster_id").cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(j)


def spatial_compactness(places: DataFrame, assignment: DataFrame, reach: float = 500.0) -> DataFrame:
    """Per cluster (of bounded size): centre, mean distance of its pairs, 1 - d / reach and 1 / (1 + d / 100)."""
    j = places.select("building_id", "x", "y").join(assignment.select("building_id", "cluster_id"), "building_id")
    a, b = j.withColumnsRenamed({"building_id": "a", "x": "ax", "y": "ay"}), j.withColumnsRenamed({"building_id": "b", "x": "bx", "y": "by"})
    d = a.join(b, "cluster_id").where("a < b").groupBy("cluster_id").agg(F.avg(F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))).alias("distance"))
    g = j.groupBy("cluster_id").agg(F.count("*").alias("buildings"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).join(d, "cluster_id", "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    return g.withColumns({"compactness": F.greatest(F.lit(0.0), 1 - F.col("distance") / reach), "nearness": 1 / (1 + F.col("distance") / 100)})


def temporal_reassignment(s: DataFrame, centres: DataFrame) -> DataFrame:
    """(building_id, hour, cluster_id): the cluster whose centre (cluster_id, hour, net) is nearest to a building's mean net load of the hour; centres are few."""
    h = s.groupBy("building_id", F.hour("ts").alias("hour")).agg(F.avg(F.col("demand") - F.col("generation")).alias("load"))
    j = h.join(centres.select("hour", "cluster_id", "net"), "hour")
    return j.groupBy("building_id", "hour").agg(F.min(F.struct(F.round(F.abs(F.col("load") - F.col("net")), 9).alias("d"), "cluster_id")).alias("m")).select("building_id", "hour", "m.cluster_id")


def topology_pairs(places: DataFrame) -> DataFrame:
    """(a, b, electrical_distance): pairs in one cable group (1) or under one transformer (2); all others are 3 and are not listed."""
    p = places.select("building_id", "cable_group", "transformer")
    a, b = p.withColumnsRenamed({"building_id": "a", "cable_group": "ga"}), p.withColumnsRenamed({"building_id": "b", "cable_group": "gb"})
    j = a.join(b, "transformer").where("a < b").select("a", "b", F.when(F.col("ga") == F.col("gb"), 1).otherwise(2).alias("d"))
    return j.groupBy("a", "b").agg(F.min("d").alias("electrical_distance"))


def must_link(clusters: DataFrame, strength: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b): pairs of one adjacency cluster whose strength (cluster_id, strength) is above ``least``."""
    c = clusters.join(strength.where(F.col("strength") > least).select("cluster_id"), "cluster_id", "left_semi").select("building_id", "cluster_id")
    return c.withColumnRenamed("building_id", "a").join(c.withColumnRenamed("building_id", "b"), "cluster_id").where("a < b").select("a", "b").distinct()


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change_pct) of two metric lists (metric, value)."""
    j = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    return j.withColumn("change_pct", F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.abs("before") * 100))
