"""Graph communities and the vector index against brute force on small inputs."""

import random
from itertools import permutations

import numpy as np

from tidewell.operators import ann, communities


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def hops(pairs, nodes):
    far = {(a, b): 0 if a == b else 10**6 for a in nodes for b in nodes} | {p: 1 for p in pairs if p[0] != p[1]}
    for m in nodes:
        far |= {(a, b): min(far[a, b], far[a, m] + far[m, b]) for a in nodes for b in nodes}
    return far


def test_strong_components_and_betweenness(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(22)})
    nodes = sorted({n for p in pairs for n in p})
    far = hops(pairs, nodes)
    got = {r["node"]: r["component"] for r in communities.strongly_connected(edges_of(spark, pairs)).collect()}
    assert got == {a: min(b for b in nodes if far[a, b] < 10**6 and far[b, a] < 10**6) for a in nodes}
    ways = {(a, a): 1 for a in nodes}
    for d in range(1, 13):
        for a, b in permutations(nodes, 2):
            if far[a, b] == d:
                ways[a, b] = sum(ways[a, c] for c in nodes if (c, b) in pairs and far[a, c] == d - 1)
    want = {v: sum(ways[a, v] * ways[v, b] / ways[a, b] for a, b in permutations(nodes, 2) if v not in (a, b) and far[a, b] < 10**6 and far[a, v] + far[v, b] == far[a, b]) for v in nodes}
    for r in communities.betweenness(edges_of(spark, pairs)).collect():
        assert abs(r["betweenness"] - want[r["node"]]) < 1e-9


def test_betweenness_of_trees_takes_no_pairs(spark, monkeypatch):
    """Trees that hang on a circle with one-way links, against all pairs; and a tree of 3,000 nodes whose pairs would be nine million rows."""
    rng = random.Random(6)
    pairs = {(0, 1), (1, 2), (2, 3), (3, 0), (1, 0), (0, 2), (4, 1)} | {(90, 91), (91, 90)}
    for x in range(10, 22):
        u = rng.choice([0, 1, 2, 3, *range(10, x)])
        pairs |= {(u, x), (x, u)}
    nodes = sorted({n for p in pairs for n in p})
    far = hops(pairs, nodes)
    ways = {(a, a): 1 for a in nodes}
    for d in range(1, len(nodes)):
        for a, b in permutations(nodes, 2):
            if far[a, b] == d:
                ways[a, b] = sum(ways[a, c] for c in nodes if (c, b) in pairs and far[a, c] == d - 1)
    want = {v: sum(ways[a, v] * ways[v, b] / ways[a, b] for a, b in permutations(nodes, 2) if v not in (a, b) and far[a, b] < 10**6 and far[a, v] + far[v, b] == far[a, b]) for v in nodes}
    got = {r["node"]: r["betweenness"] for r in communities.betweenness(edges_of(spark, sorted(pairs))).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in nodes)

    most, plain = [], communities.staged

    def staged(df, name):
        out = plain(df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(communities, "staged", staged)
    star = [p for x in range(1, 3000) for p in ((x, x % 5 if x > 4 else 0), (x % 5 if x > 4 else 0, x))]
    got = {r["node"]: r["betweenness"] for r in communities.betweenness(edges_of(spark, star)).collect()}
    sizes = [1 + sum(x % 5 == k for x in range(5, 3000)) for k in range(5)]  # hubs with their leaves
    assert max(most) <= len(star)
    assert got[1] == (sizes[1] - 1) * (sizes[1] - 2) + 2 * (sizes[1] - 1) * (3000 - sizes[1])
    assert got[7] == 0 and len(got) == 3000


def test_louvain_finds_cliques(spark):
    cliques = [range(0, 6), range(6, 12), range(12, 18)]
    pairs = [(a, b) for c in cliques for a in c for b in c if a < b] + [(0, 6), (6, 12)]
    got = {r["node"]: r["community"] for r in communities.louvain(edges_of(spark, pairs)).collect()}
    assert got == {n: c[0] for c in cliques for n in c}


def test_empty_graphs(spark):
    none = edges_of(spark, [])
    assert communities.strongly_connected(none).count() == communities.betweenness(none).count() == communities.louvain(none).count() == 0


def test_index_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    ann.save(ann.build(rows, 11), str(tmp_path))
    found = ann.search(ann.load(spark, str(tmp_path)), rows, rows.where("vec_id % 20 = 0"), k=10, probes=9, again=60).collect()
    ids, x = zip(*[(r["vec_id"], r["embedding"]) for r in rows.where("embedding IS NOT NULL").collect()], strict=True)
    ids, x = np.array(ids), np.array(x)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        near = set(ids[np.lexsort((ids, d))][1:11].tolist())
        hits, total = hits + len(near & {r["key"] for r in found if r["query"] == q}), total + 10
    assert hits / total >= 0.9, hits / total
