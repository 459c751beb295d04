"""Walks of many seeds and shortest paths against brute force, with cycles, loops, repeated edges and null ends."""

import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import paths


def brute_hops(edges, start):
    hops, level = {start: 0}, [start]
    while level:
        level = sorted({b for a, b in edges if a in level and b not in hops})
        hops |= {n: hops[max((a for a, b in edges if b == n and a in hops), key=lambda a: -hops[a])] + 1 for n in level}
    return hops


def brute_paths(edges, start, end):
    hops = brute_hops(edges, start)
    found = [[start]] if end in hops else []
    for _ in range(hops.get(end, 0)):
        found = [[*p, b] for p in found for a, b in edges if a == p[-1] and hops[b] == hops[a] + 1]
    return sorted(p for p in found if p[-1] == end)


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)} | {("n0", "n0"), ("x", "y"), ("y", "z"), ("z", "x")})


@pytest.mark.parametrize("small", [100_000, 0])
def test_walks_of_many_seeds(spark, monkeypatch, small):
    monkeypatch.setattr(paths, "SMALL", small)
    edges = graph(3, 40, 60)
    frame = spark.createDataFrame([*edges, *edges[:5], (None, "n1"), ("n1", None)], "src string, dst string")
    seeds = sorted({a for a, _ in edges})[:9] + ["nowhere"]
    real = {(a, b) for a, b in edges if a != b}
    want = sorted((s, n, h) for s in seeds for n, h in brute_hops(real, s).items() if h)
    asked = spark.createDataFrame([(s,) for s in [*seeds, None, seeds[0]]], "seed string")
    for most in (62, 4):
        assert sorted(map(tuple, paths.reach_many(frame, asked, most=most).collect())) == want
    assert sorted(map(tuple, paths.reach_many(frame, asked, 2).collect())) == [w for w in want if w[2] <= 2]
    assert paths.reach_many(frame, asked.limit(0)).count() == 0 and paths.reach_many(frame.limit(0), asked).count() == 0
    walked = spark.createDataFrame(want, "seed string, node string, hops int")
    most = {s: max(h for x, _, h in want if x == s) for s, _, _ in want}
    assert sorted((r["seed"], r["node"]) for r in paths.furthest(walked).collect()) == sorted((s, n) for s, n, h in want if h == most[s])


def test_all_shortest_paths(spark):
    for k, (nodes, many) in enumerate([(12, 26), (30, 50), (8, 40)]):
        edges = graph(k, nodes, many)
        real = {(a, b) for a, b in edges if a != b}
        frame = paths.simple_edges(spark.createDataFrame([*edges, (None, "n1")], "src string, dst string"))
        for start, end in [("n0", "n5"), ("n3", "n1"), ("x", "z"), ("x", "n1"), ("n2", "n2")]:
            steps, length = paths.shortest_edges(frame, start, end)
            want = brute_paths(real, start, end)
            assert sorted(r["path"] for r in paths.all_paths(steps, length, start).collect()) == want
            assert length == (len(want[0]) - 1 if want else None)
            assert sorted(map(tuple, steps.collect())) == sorted({(i, p[i], p[i + 1]) for p in want for i in range(len(p) - 1)})
    assert paths.shortest_edges(frame, "x", "z", depth=1)[1] is None and paths.shortest_edges(frame, "x", "z", depth=2)[1] == 2


def test_links_of_odd_pages(spark):
    html = [None, "", "<a href='/x'>", '<a class="b" href = "/y?a=1&b"><A HREF="/z"><a href=""><link href="/no">', '<a href="/x"><a href="/x">' * 3, "<a href"]
    pages = spark.createDataFrame([*enumerate(html), (None, "<a href='/x'>")], "page_id long, html string").withColumn("target", F.lit("mine"))
    assert sorted(map(tuple, paths.page_links(pages).collect())) == [("page:2", "/x"), ("page:3", "/y?a=1&b"), ("page:4", "/x")]
    assert paths.both_ways(paths.page_links(pages.limit(0))).count() == 0
