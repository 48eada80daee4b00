"""Solar sets, spaced picks, budgets, matching and clusterings against plain Python."""

import itertools
import random

import numpy as np
import pytest

from wattline.operators import auction, budget, communities, interventions, modularity, roadmap, solar


def walked(items, cons, least, enough):
    """The greedy walk of one cluster: (building, pick) in order."""
    gen, out = [0.0] * len(cons), []
    used = lambda g: sum(map(min, g, cons))
    for _, b, g in sorted(((-round(s, 9), b, g) for s, b, g in items), key=lambda x: x[:2]):
        more = [x + y for x, y in zip(gen, g, strict=True)]
        if round((used(more) - used(gen)) / sum(cons) * (1 - 0.1 * len(out)), 9) > least:
            out.append((b, len(out) + 1))
            gen = more
            if sum(gen) > enough * sum(cons):
                break
    return out


def solar_case(spark, seed):
    r = random.Random(seed)
    items = [(c, 100 * c + i, r.choice([0.2, 0.5, r.random()]), [r.random() * r.choice([1, 4]) for _ in range(4)]) for c in range(8) for i in range(r.randint(1, 40))]
    cons = [(c, [1 + 3 * r.random() for _ in range(4)]) for c in range(8)]
    return items, cons, spark.createDataFrame(items, "cluster_id long, building_id long, score double, generation array<double>"), spark.createDataFrame(cons, "cluster_id long, consumption array<double>")


@pytest.mark.parametrize(("seed", "least", "fold"), [(1, 0.1, 256), (1, 0.1, 0), (2, 0.05, 256), (2, 0.05, 5)])
def test_solar_set_is_the_walk_folded_or_by_rounds(spark, seed, least, fold):
    items, cons, c, k = solar_case(spark, seed)
    got = {}
    for x in solar.greedy_solar_set(c, k, least, 0.8, fold=fold).orderBy("cluster_id", "pick").collect():
        got.setdefault(x.cluster_id, []).append((x.building_id, x.pick))
    want = {n: w for n, v in cons if (w := walked([(s, b, g) for cc, b, s, g in items if cc == n], v, least, 0.8))}
    assert got == want and max(map(len, got.values())) > 1


def test_skipped_candidate_lets_a_later_one_in(spark):
    c = spark.createDataFrame([(1, 1, 0.9, [4.0, 0.0]), (1, 2, 0.8, [5.0, 0.0]), (1, 3, 0.7, [0.0, 4.0])], "cluster_id long, building_id long, score double, generation array<double>")
    k = spark.createDataFrame([(1, [5.0, 5.0])], "cluster_id long, consumption array<double>")
    assert [x.building_id for x in solar.greedy_solar_set(c, k, 0.3, 0.95).orderBy("pick").collect()] == [1, 3]
    stopped = solar.greedy_solar_set(c, k, 0.3, 0.3).collect()
    assert [x.building_id for x in stopped] == [1]
    empty = solar.greedy_solar_set(c.limit(0), k)
    assert empty.count() == 0


def test_small_roofs_and_large_systems_are_no_candidates(spark):
    rows = [(1, 1, 19.0, "south", 20.0, "office", False, 0.0, 9.0), (2, 1, 120.0, None, 5.0, None, None, None, 9.0), (3, 1, 120.0, "south", 20.0, "office", True, 11.0, 9.0), (4, 1, 120.0, "South", 20.0, "Office", True, 10.0, 9.0), (5, None, 120.0, "flat", 12.0, "x", False, 0.0, None)]
    b = spark.createDataFrame(rows, "building_id long, cluster_id long, suitable_area double, orientation string, height double, function string, has_solar boolean, solar_kw double, avg_kw double")
    got = {x.building_id: x for x in solar.solar_candidates(b).collect()}
    assert set(got) == {2, 4, 5} - {i for i in (2,) if 0.3 + 0.15 + 0.1 + 0.1 < 0.6}
    assert got[4].technical == pytest.approx(1.0) and got[4].capacity_kw == 6.5


def distances(edges, start):
    near, seen, frontier = {}, {start: 0}, [start]
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while frontier:
        frontier = [m for n in frontier for m in near.get(n, ()) if m not in seen and not seen.update({m: seen[n] + 1})]
    return seen


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_spaced_picks_are_the_greedy_walk(spark, distance):
    r = random.Random(distance)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(0, i) for i in range(40, 55)]
    score = {n: r.choice([0.5, r.random(), float("-inf")]) for n in range(62)}
    got = {x.node for x in interventions.spaced_selection(spark.createDataFrame(list(score.items()), "node long, score double"), spark.createDataFrame(edges, "src long, dst long"), distance).collect()}
    want = set()
    for n in sorted((n for n in score if score[n] > float("-inf")), key=lambda n: (-round(score[n], 9), n)):
        if not any(d <= distance for m, d in distances([e for e in edges if e[0] != e[1]], n).items() if m in want):
            want.add(n)
    assert got == want
    far = [distances(edges, a) for a in got]
    assert all(d.get(b, 99) > distance for a, d in zip(got, far, strict=True) for b in got if a != b)


def test_spaced_picks_say_when_they_do_not_end(spark):
    chain = [(i, i + 1) for i in range(12)]
    nodes = spark.createDataFrame([(i, float(i)) for i in range(13)], "node long, score double")
    with pytest.raises(RuntimeError):
        interventions.spaced_selection(nodes, spark.createDataFrame(chain, "src long, dst long"), 1, rounds=3)


def test_boundaries_spacing_and_existing_lower_a_score(spark):
    nodes = spark.createDataFrame([(i, 0.5, 10.0, [1.0, float(i)], v) for i, v in ((1, 0.0), (2, 0.0), (3, 1.0), (4, None))], "node long, label_score double, roof double, embedding array<double>, violation double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    impacts = spark.createDataFrame([(i, 1, 0.4) for i in (1, 2, 3, 4)], "node long, hop int, impact double")
    hops = spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in (1, 2, 3, 4)], "node long, hop int, features array<double>")
    got = {x.node: x for x in interventions.rank_interventions(nodes, edges, impacts, hops, spark.createDataFrame([(1,)], "node long")).collect()}
    free = {x.node: x for x in interventions.rank_interventions(nodes, edges, impacts, hops).collect()}
    whole = lambda x: 0.3 * x.local + 0.7 * x.network + 0.2 * x.position + 0.3 * x.cascade + 0.2 * x.bonus
    assert got[1].score == float("-inf") and got[2].score == pytest.approx(0.1 * whole(got[2])) and got[3].score == pytest.approx(0.5 * whole(got[3])) and got[4].score == pytest.approx(whole(got[4]))
    assert free[1].score == pytest.approx(whole(free[1])) and free[1].bonus == 0


def test_assignment_is_the_cheapest(spark):
    r, rows = random.Random(3), []
    for g in range(6):
        for a in range(r.randint(1, 4)):
            rows += [(g, a, b, round(r.random() * 10, 3)) for b in range(100, 100 + 2 + g % 3)]
    rows += [(6, 0, 0, 5.0), (6, 1, 0, 1.0), (6, 1, 1, 9.0), (6, 1, 1, 9.5), (6, None, 1, 0.0)]  # sparse: the dear pairs match more
    got = auction.assignment_matching(spark.createDataFrame(rows, "g long, a long, b long, cost double"), ["g"], step=10.0).collect()
    for g in range(7):
        cost = {}
        for k, a, b, c in rows:
            if k == g and a is not None:
                cost[a, b] = min(c, cost.get((a, b), c))
        left, right = sorted({a for a, _ in cost}), sorted({b for _, b in cost})
        best = max((sum((a, b) in cost for a, b in zip(p, q)), -sum(cost.get((a, b), 0) for a, b in zip(p, q))) for k in range(1, min(len(left), len(right)) + 1) for p in itertools.combinations(left, k) for q in itertools.permutations(right, k) if all((a, b) in cost for a, b in zip(p, q)))
        own = [x for x in got if x.g == g]
        assert len(own) == best[0] == len({x.a for x in own}) == len({x.b for x in own})
        assert -best[1] - 1e-6 <= sum(x.cost for x in own) <= -best[1] + own[0].slack
        assert all(cost[x.a, x.b] == x.cost for x in own)


def louvain(pairs):
    """The same rule in plain Python: levels of single best moves that touch no community twice."""
    edges = {}
    for a, b, w in pairs:
        k = (min(a, b), max(a, b))
        edges[k] = edges.get(k, 0) + round(w, 9)
    nodes = sorted({n for e in edges for n in e})
    whole = {n: n for n in nodes}
    while True:
        deg, m2 = {}, 0.0
        for (a, b), w in edges.items():
            for n in (a, b):  # a loop has both ends at its node
                deg[n] = deg.get(n, 0) + w
            m2 += 2 * w
        now, moved = {n: n for n in deg}, False
        while True:
            vol, link = {}, {}
            for n, c in now.items():
                vol[c] = vol.get(c, 0) + deg[n]
            for (a, b), w in edges.items():
                if a != b:
                    for x, y in ((a, b), (b, a)):
                        link[x, now[y]] = link.get((x, now[y]), 0) + w
            best = {}
            for (n, c), k in link.items():
                if c != now[n]:
                    gain = round(2 * (k - link.get((n, now[n]), 0)) / m2 - 2 * deg[n] * (vol[c] - vol[now[n]] + deg[n]) / m2**2, 12)
                    if gain > 0:
                        best[n] = min(best.get(n, (0, 0)), (-gain, c))
            if not best:
                break
            moved, first = True, {}
            for n, (g, c) in best.items():
                for t in (c, now[n]):
                    first[t] = min(first.get(t, (g, n)), (g, n))
            for n, (g, c) in best.items():
                if first[c] == first[now[n]] == (g, n):
                    best[n] = (g, c, True)
            now = {n: best[n][1] if len(best.get(n, ())) == 3 else c for n, c in now.items()}
        whole = {n: now[c] for n, c in whole.items()}
        if not moved:
            low = {}
            for n, c in whole.items():
                low[c] = min(low.get(c, n), n)
            return {n: low[c] for n, c in whole.items()}
        up = {}
        for (a, b), w in edges.items():
            k = (min(now[a], now[b]), max(now[a], now[b]))
            up[k] = up.get(k, 0) + w
        edges = up


def test_modularity_rises_by_level_and_equals_brute_force(spark):
    r = random.Random(4)
    pairs = [(a, b, 1.0 + r.random()) for base in range(0, 48, 6) for a in range(base, base + 6) for b in range(a + 1, base + 6) if r.random() < 0.8]
    pairs += [(r.randrange(48), r.randrange(48), 0.2 + r.random() / 2) for _ in range(40)] + [(5, 4, 0.3), (4, 5, 0.3)]
    pairs = [p for p in pairs if p[0] != p[1]] + [(i, i + 1, 1.0 + i % 3 / 10) for i in range(200, 232)]
    df = spark.createDataFrame([*pairs, (1, 1, 5.0), (None, 2, 1.0), (3, 4, -1.0), (100, 101, 1.0)], "a long, b long, weight double")
    got, levels = modularity.modularity_levels(df)
    found = {x.building_id: x.cluster_id for x in got.collect()}
    assert found == louvain([*pairs, (100, 101, 1.0)])
    assert levels == sorted(levels) and len(levels) > 2 and levels[1] > levels[0]
    m = sum(w for *_, w in pairs) + 1.0
    vol, inside = {}, 0.0
    for a, b, w in [*pairs, (100, 101, 1.0)]:
        inside += w * (found[a] == found[b])
        for n in (a, b):
            vol[found[n]] = vol.get(found[n], 0) + w
    assert levels[-1] == pytest.approx(inside / m - sum(v * v for v in vol.values()) / (4 * m * m))


@pytest.mark.parametrize("grouped", [False, True])
def test_budget_is_used_up_to_the_gap(spark, grouped):
    for seed in range(3):
        r = random.Random(seed)
        items = [(i, i // 3 if grouped else i, float(r.randint(1, 30)), float(r.randint(1, 12))) for i in range(12)]
        money = 25.0 if seed else 1000.0
        rows, bound, gap = budget.budgeted_mix(spark.createDataFrame(items, "item_id long, g long, value double, cost double"), money, "g" if grouped else None)
        got = rows.collect()
        sets = [[]]
        for k in sorted({g for _, g, _, _ in items}):
            sets = [s + more for s in sets for more in ([[]] + [[i] for i in items if i[1] == k])]
        best = max(sum(i[2] for i in s) for s in sets if sum(i[3] for i in s) <= money)
        value = sum(x.value for x in got)
        assert sum(x.cost for x in got) <= money and len({x.g for x in got}) == len(got)
        assert value <= best <= bound + 1e-6 and bound - value == pytest.approx(gap, abs=1e-6) and best - value <= gap + 1e-6
        if seed == 0:
            assert value == best and gap < 1e-6
        elif not grouped:
            assert gap <= max(i[2] for i in items)
    assert budget.budgeted_mix(spark.createDataFrame([], "item_id long, value double, cost double"), 5.0)[0].count() == 0


def test_what_is_needed_comes_along(spark):
    needs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(3, 50), (50, 3), (7, None)], "item_id long, needs_id long")
    assert {x.item_id for x in roadmap.dependency_closure(spark.createDataFrame([(3,), (3,), (None,)], "item_id long"), needs).collect()} == {*range(3, 31), 50}


def naive_merges(d):
    part = {i: [i] for i in range(len(d))}
    heights = []
    while len(part) > 1:
        h, i, j = min((np.mean(d[np.ix_(part[i], part[j])]), i, j) for i, j in itertools.combinations(part, 2))
        heights.append(h)
        part[i] += part.pop(j)
    return heights


def test_chains_give_the_average_linkage_tree():
    for seed in range(6):
        x = np.random.default_rng(seed).normal(size=(17, 5))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        assert np.allclose([m[2] for m in communities._chain(d)], naive_merges(d))


def test_clusters_keep_their_sizes(spark):
    r = np.random.default_rng(1)
    rows = [(g, g * 1000 + i, r.normal(size=6).tolist()) for g, n in ((1, 2), (2, 20), (3, 21), (4, 47), (5, 100)) for i in range(n)] + [(6, 6000 + i, [1.0, 2.0, 1.0]) for i in range(43)]
    got = communities.lv_group_clustering(spark.createDataFrame([*rows, (7, 7000, None)], "lv_group long, building_id long, profile array<double>"), 3, 20).collect()
    assert sorted(x.building_id for x in got) == sorted(b for _, b, _ in rows)
    size = {}
    for x in got:
        size.setdefault((x.lv_group, x.cluster_id), []).append(x.building_id)
    assert all(k[1] == min(v) and k[0] == v[0] // 1000 for k, v in size.items())
    assert all(3 <= len(v) <= 20 for k, v in size.items() if k[0] > 2) and sum(k[0] <= 2 for k in size) == 2


def test_a_very_large_group_is_cut_first(spark, monkeypatch):
    monkeypatch.setattr(communities, "GROUP_ROWS", 60)
    r = np.random.default_rng(2)
    rows = [(1, i, r.normal(size=6).tolist()) for i in range(400)]
    got = communities.lv_group_clustering(spark.createDataFrame(rows, "lv_group long, building_id long, profile array<double>"), 3, 20)
    sizes = [x["count"] for x in got.groupBy("cluster_id").count().collect()]
    assert sum(sizes) == 400 and all(3 <= n <= 20 for n in sizes)


def test_priorities_follow_learnt_weights(spark):
    b = spark.createDataFrame([(1, 1, "G", 100.0, "south", False, 10000.0), (2, 1, "A", 100.0, "south", False, 10000.0), (3, 1, "G", 100.0, "south", True, 1.0), (4, 2, None, 0.0, None, None, 0.0)], "building_id long, cluster_id long, label string, roof double, orientation string, has_solar boolean, annual_kwh double")
    got = {x.building_id: x for x in solar.solar_priority(b).collect()}
    assert set(got) == {1, 2, 4} and got[1].priority == pytest.approx(0.3 + 0.2 + 0.1 + 0.2 + 0.05) and got[1].priority - got[2].priority == pytest.approx(0.27)
    w = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0)], ", ".join(f"{k} double" for k in solar.WEIGHTS))
    assert {x.building_id: x.priority for x in solar.solar_priority(b, weights=w).collect()} == {1: 1.0, 2: pytest.approx(0.1), 4: pytest.approx(0.4)}
