"""Graph rounds on chains longer than any fixed number of rounds."""

import random
from itertools import combinations

import pytest

from tidewell.operators import communities, graph


def chain(spark, n):
    return spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, weight double")


def test_shortest_paths_of_many_hops(spark):
    edges = chain(spark, 54).unionByName(spark.createDataFrame([(0, 53, 100.0)], "src long, dst long, weight double")).coalesce(1)
    got = {r["node"]: r["distance"] for r in graph.shortest_paths(edges, 0).collect()}
    assert got == {i: float(i) for i in range(55)}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, 0, max_rounds=3)


def test_closeness_of_far_nodes(spark):
    got = {r["node"]: r["closeness"] for r in graph.closeness(chain(spark, 24).coalesce(1)).collect()}
    assert got == {i: pytest.approx(2 / (25 - i)) for i in range(24)}  # hops 1 to 24 - i


def brute_dfs(links, start):
    out, stack = [], [start]
    while stack:
        node = stack.pop()
        if node not in out:
            out.append(node)
            stack += sorted((b for a, b in links if a == node and b not in out), reverse=True)
    return out


def random_graph(spark, n, m, seed):
    rng = random.Random(seed)
    links = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    weights = {p: float(rng.randint(1, 9)) for p in links}
    return links, weights, spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, weight double").coalesce(1)


def test_depth_first(spark):
    links, _, edges = random_graph(spark, 14, 30, 3)
    want = brute_dfs({(a, b) for a, b in links if a != b}, 0)
    assert [r["node"] for r in graph.dfs(edges, 0, ahead=3).orderBy("position").collect()] == want
    assert [r["node"] for r in graph.dfs(edges, 0, 4).orderBy("position").collect()] == want[:4]


def simple_paths(weights, a, b, most):
    found, stack = [], [([a], 0.0)]
    while stack:
        path, cost = stack.pop()
        if path[-1] == b and len(path) > 1:
            found.append((cost, len(path) - 1, path))
            continue
        if len(path) <= most:
            stack += [([*path, y], cost + w) for (x, y), w in weights.items() if x == path[-1] and y not in path]
    return sorted(found)


def test_cheapest_paths_and_routes(spark):
    _, weights, edges = random_graph(spark, 9, 26, 5)
    for target in (3, 7):
        for hops in (1, 4, 5):
            got = [(r["cost"], r["length"], r["path"]) for r in communities.cheapest_paths(edges, 0, target, 6, hops).collect()]
            assert got == simple_paths(weights, 0, target, hops)[:6]
        best = simple_paths(weights, 0, target, 9)[:1]
        assert [(r["cost"], r["length"], r["path"]) for r in graph.shortest_route(edges, 0, target).collect()] == best
    far = {b: min((simple_paths(weights, b, 7, 9)[:1] or [(1e9,)])[0][0] for b in [b]) for b in range(9) if b != 7}
    bounds = spark.createDataFrame([(b, 0.9 * c) for b, c in far.items()], "node long, least double")
    assert graph.shortest_route(edges, 0, 7, least=bounds).collect() == graph.shortest_route(edges, 0, 7).collect()
    assert graph.shortest_route(edges, 0, 99).count() == 0


def test_cliques(spark):
    links, _, edges = random_graph(spark, 12, 60, 8)
    both = {frozenset(p) for p in links if p[0] != p[1]}
    nodes = range(12)
    for k in (3, 4):
        want = sorted(list(c) for c in combinations(nodes, k) if all(frozenset(p) in both for p in combinations(c, 2)))
        assert sorted(r["nodes"] for r in graph.cliques(edges, k).collect()) == want


def test_times_of_edges(spark):
    edges = spark.createDataFrame([(1, 2, 1, 5), (2, 3, 4, None), (1, 3, 9, 10), (3, 4, 2, 9)], "src long, dst long, valid_from int, valid_to int")
    assert {(r["src"], r["dst"]) for r in graph.as_of(edges, 5).collect()} == {(2, 3), (3, 4)}
    starts = spark.createDataFrame([(1,)], "node long")
    assert {r["node"]: r["arrival"] for r in graph.temporal_paths(edges, starts, 3).collect()} == {1: None, 2: 1, 3: 4}


def test_empty_graph_has_no_ranks(spark):
    none = chain(spark, 1).limit(0)
    assert graph.pagerank(none).count() == graph.label_propagation(none).count() == graph.cliques(none, 3).count() == 0


def test_mesh_is_nearest_neighbours(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.random() for _ in range(4)] if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = {}
    for i, v in vectors:
        if v and i % 4 == 0:
            far = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in vectors if w and j != i)[:3]
            want |= {(i, j): 1 / (1 + d) for d, j in far}
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.knn_mesh(df, 3, query_where="vec_id % 4 = 0", block=5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    both = {(r["src"], r["dst"]) for r in graph.knn_mesh(df, 3, query_where="vec_id % 4 = 0", both_ways=True).collect()}
    assert both == want.keys() | {(b, a) for a, b in want}
