"""Walks over their whole depth against plain Python."""

import collections

import pytest

from wattline.operators import graphs as gr
from wattline.plans import bindings, registry

SF = "/root/testdata/sf0.001"


def walk(edges, sources, hops):
    near = collections.defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    hop, now = dict.fromkeys(sources, 0), set(sources)
    for h in range(1, hops + 1):
        now = {b for a in now for b in near[a]} - set(hop)
        hop |= dict.fromkeys(now, h)
    return hop


def spread(edges, sources, hops, decay, least):
    near = collections.defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    now = dict.fromkeys(sources, 1.0)
    top = dict(now)
    for _ in range(hops):
        now = {a: decay * sum(now.get(b, 0.0) for b in far) / len(far) for a, far in near.items()}
        for b, v in now.items():
            top[b] = max(top.get(b, 0), v)
    return {b: v for b, v in top.items() if v > least}


def test_registered_walks_have_their_whole_depth(spark):
    edges = [(r.src, r.dst, r.weight) for r in bindings.edges(spark, SF).collect()]
    want = walk(edges, [min(a for a, _, _ in edges)], 10)
    q = registry.queries()
    assert {r.node: r.hop for r in q["gr8_hop_distance_10"](spark, SF).collect()} == want
    assert {r.hop: r.nodes for r in q["gr13_hop_metrics_10"](spark, SF).collect()} == collections.Counter(h for h in want.values() if h)
    got = {r.node: r.impact for r in q["gr9_cascade_3"](spark, SF).collect()}
    assert got == pytest.approx(spread(edges, {a for a, _, _ in edges}, 3, 0.7, 0.1), abs=1e-3)


def test_walks_on_a_chain(spark):
    chain = [(i, i + 1, 1.0) for i in range(20)]
    e = spark.createDataFrame(chain, "src long, dst long, weight double")
    start = e.where("src = 0").selectExpr("src AS node")
    assert {r.node: r.hop for r in gr.hop_distance(e, start, 10).collect()} == {i: i for i in range(11)}
    assert {r.node: r.hop for r in gr.hop_distance(e.where("src < 4"), start, 10).collect()} == {i: i for i in range(5)}
    got = {r.node: r.impact for r in gr.cascade(e, start).collect()}
    assert got == pytest.approx(spread(chain, [0], 3, 0.7, 0.1)) and set(got) == {0, 1, 2}
    assert {r.node for r in gr.cascade(e, start, least=0.01).collect()} == {0, 1, 2, 3}
    star = spark.createDataFrame([(0, i, 9.0) for i in range(1, 9)], "src long, dst long, weight double")
    assert {r.node: round(r.impact, 4) for r in gr.cascade(star, start, 1).collect()} == {0: 1.0} | {i: 0.7 for i in range(1, 9)}  # the receiver's degree counts
