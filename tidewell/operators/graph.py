"""Graph operators over edge tables (src, dst, weight), as bounded rounds of joins staged in the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.stages import discard, staged


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    e = edges.select("src", "dst")
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": e, "in": turned, "both": e.unionByName(turned)}[direction].distinct()


def neighbors(edges: DataFrame, node, limit: int | None = None) -> DataFrame:
    found = edges.where(F.col("src") == F.lit(node)).orderBy("dst")
    return found.limit(limit) if limit else found


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int = 10, direction: str = "out") -> DataFrame:
    """node, depth: hops from the nearest start (a table with column node). Each level joins the frontier only."""
    e = staged(directed(edges, direction), "bfs-edges")
    seen = staged(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = seen
    for depth in range(1, max_depth + 1):
        fresh = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = staged(fresh.withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:  # one table again, so that plans stay short on long chains
            seen = staged(seen, "bfs-seen")
    return seen


def traverse(edges: DataFrame, starts: DataFrame, least: int = 1, most: int = 1, direction: str = "out") -> DataFrame:
    return bfs(edges, starts, most, direction).where(F.col("depth").between(least, most))


def paths(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """All cycle-free paths of least to most hops: path array of nodes, cost (sum of weights), length."""
    level = starts.select(F.array("node").alias("path"), F.lit(0.0).alias("cost"))
    out = None
    for hop in range(1, most + 1):
        level = staged(level.join(edges, F.element_at("path", -1) == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost")), "paths")
        if hop >= least:
            part = level.withColumn("length", F.lit(hop))
            out = part if out is None else out.unionByName(part)
    return out


def shortest_paths(edges: DataFrame, source, max_rounds: int | None = None) -> DataFrame:
    """node, distance by weights from one source: relaxation rounds with a minimum per node until nothing improves.

    Without cycles of negative weight that takes at most as many rounds as there are nodes; more, or more than max_rounds, raise an error.
    """
    best = staged(edges.sparkSession.createDataFrame([(source, 0.0)], f"node {edges.schema['src'].dataType.simpleString()}, distance double"), "sssp")
    frontier, rounds = best, 0
    most = _nodes(edges).count() + 1 if max_rounds is None else max_rounds
    while True:
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("_d"))
        frontier = staged(step.join(best, "node", "left").where("distance IS NULL OR _d < distance").select("node", F.col("_d").alias("distance")), "sssp")
        if frontier.isEmpty():
            return best
        rounds += 1
        if rounds > most:
            raise RuntimeError(f"distances have not settled after {most} rounds")
        best = staged(best.unionByName(frontier).groupBy("node").agg(F.min("distance").alias("distance")), "sssp")


def shortest_route(edges: DataFrame, source, target, max_rounds: int | None = None, least: DataFrame | None = None) -> DataFrame:
    """path (array of nodes), cost, length of a cheapest way from source to target; no row where there is none. Of equal costs the fewest hops, then the least nodes.

    Each round extends the best ways that the round before improved, and leaves out those that already cost more than the best way to the target. ``least``
    (node, least) is what the rest of the way from a node costs at least, such as its distance as the crow flies; ways that can't beat the best by it are
    left out as well, as A* does. It must not be more than the true cost; nodes without a row have 0.
    """
    kind = edges.schema["src"].dataType.simpleString()
    best = staged(edges.sparkSession.createDataFrame([([source], 0.0)], f"path array<{kind}>, cost double").select(F.element_at("path", -1).alias("node"), F.struct("cost", F.size("path").alias("n"), "path").alias("way")), "route")
    frontier, rounds = best, 0
    most = _nodes(edges).count() + 1 if max_rounds is None else max_rounds
    while True:
        bound = best.where(F.col("node") == F.lit(target)).agg(F.min("way.cost")).first()[0]
        live = frontier if bound is None else frontier.where(F.col("way.cost") <= bound)
        if bound is not None and least is not None:
            live = live.join(least.select("node", "least"), "node", "left").where(F.col("way.cost") + F.coalesce("least", F.lit(0.0)) <= bound + 1e-9).drop("least")
        longer = live.join(edges, live["node"] == edges["src"]).where(~F.array_contains("way.path", F.col("dst")))
        step = longer.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("way.cost") + F.col("weight")).alias("cost"), (F.col("way.n") + 1).alias("n"), F.array_append("way.path", F.col("dst")).alias("path"))).alias("new"))
        fresh = staged(step.join(best, "node", "left").where("way IS NULL OR new < way").select("node", F.col("new").alias("way")), "route")
        if fresh.isEmpty():
            return best.where(F.col("node") == F.lit(target)).select("way.path", "way.cost", (F.col("way.n") - 1).alias("length"))
        rounds += 1
        if rounds > most:
            raise RuntimeError(f"routes have not settled after {most} rounds")
        after = staged(best.join(fresh.select("node"), "node", "left_anti").unionByName(fresh), "route")
        discard(best, *([frontier] if frontier is not best else []))
        best, frontier = after, fresh


def dfs(edges: DataFrame, start, limit: int = 1000, ahead: int = 512) -> DataFrame:
    """position, node: the first ``limit`` nodes of a depth-first walk, neighbours in their order.

    Such a walk is one sequence, so the driver walks; neighbours are fetched for the next ``ahead`` nodes of the stack at a time, of each no more than
    the walk can need.
    """
    kind = edges.schema["src"].dataType.simpleString()
    links, spark = edges.select("src", "dst").where("src != dst").distinct(), edges.sparkSession
    out, seen, known, stack = [], set(), {}, [start]
    while stack and len(out) < limit:
        node = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append(node)
        if node not in known:
            asked = [node, *dict.fromkeys(n for n in reversed(stack) if n not in known and n not in seen)][:ahead]
            ranked = links.join(F.broadcast(spark.createDataFrame([(n,) for n in asked], f"src {kind}")), "src").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
            got = ranked.where(F.col("r") <= 2 * limit).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")).collect()
            known |= {n: [] for n in asked} | {r["src"]: r["to"] for r in got}
        stack += [n for n in reversed(known[node]) if n not in seen]
    return spark.createDataFrame(list(enumerate(out)), f"position int, node {kind}")


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """nodes (sorted array) of each clique of so many nodes: each round joins a clique with common later neighbours along the orientation by degree."""
    e = directed(edges, "both").where("src != dst")
    deg = e.groupBy("src").agg(F.count("*").alias("d"))
    und = e.join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    o = staged(und.where("ds < dd OR ds = dd AND src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")), "oriented")
    own = o.select(F.array("u", "v").alias("nodes"))
    for have in range(2, size):
        grown = own.join(o, F.get("nodes", F.lit(0)) == F.col("u")).where(~F.array_contains("nodes", F.col("v")))
        for k in range(1, have):
            grown = grown.join(o.select(F.col("u").alias("_u"), F.col("v").alias("_v")), (F.get("nodes", F.lit(k)) == F.col("_u")) & (F.col("v") == F.col("_v")), "left_semi")
        own = staged(grown.select(F.array_append("nodes", F.col("v")).alias("nodes")), "cliques")
    return own.select(F.array_sort("nodes").alias("nodes"))


def as_of(edges: DataFrame, at, since: str = "valid_from", until: str = "valid_to") -> DataFrame:
    """Edges that are valid at a time: from ``since`` on, up to but not including ``until``; a null end is open."""
    return edges.where((F.col(since) <= F.lit(at)) & (F.col(until).isNull() | (F.col(until) > F.lit(at))))


def temporal_paths(edges: DataFrame, starts: DataFrame, most: int, time: str = "valid_from") -> DataFrame:
    """node, arrival: the earliest time at which each node can be reached along edges of rising time, within so many hops."""
    best = staged(starts.select("node", F.lit(None).cast(edges.schema[time].dataType).alias("arrival")).distinct(), "temporal")
    frontier = best
    for _ in range(most):
        step = frontier.join(edges, frontier["node"] == edges["src"]).where(F.col("arrival").isNull() | (F.col(time) >= F.col("arrival"))).groupBy(F.col("dst").alias("node")).agg(F.min(time).alias("_t"))
        frontier = staged(step.join(best, "node", "left").join(starts.select("node"), "node", "left_anti").where("arrival IS NULL OR _t < arrival").select("node", F.col("_t").alias("arrival")), "temporal")
        if frontier.isEmpty():
            break
        best = staged(best.unionByName(frontier).groupBy("node").agg(F.min("arrival").alias("arrival")), "temporal")
    return best


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, stage_every: int = 4) -> DataFrame:
    """rank = (1 - d) / n + d * sum(rank / outdegree), from 1 / n, without redistribution of dangling ranks."""
    e = edges.select("src", "dst")
    nodes = staged(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), "nodes")
    n = nodes.count()
    links = staged(e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src"), "links")
    ranks, done = nodes.withColumn("rank", F.lit(1.0 / max(1, n))), None
    for i in range(iterations):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = nodes.join(given, "node", "left").select("node", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % stage_every == stage_every - 1 or i == iterations - 1:
            after = staged(ranks, "ranks")
            discard(done)
            ranks = done = after
    return ranks


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, label: each round every node takes its neighbours' most frequent label, the least on ties."""
    e = staged(directed(edges, "both"), "lp-edges")
    labels = e.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = e.join(labels, e["dst"] == labels["node"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        new = votes.groupBy("src").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label")).select(F.col("src").alias("node"), "label")
        after = staged(new, "labels")
        discard(labels)
        labels = after
    return labels


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c of each triangle of the undirected graph; pairs grow from the end of lower degree, so hubs don't multiply."""
    e = directed(edges, "both").where("src != dst")
    deg = e.groupBy("src").agg(F.count("*").alias("d"))
    und = e.where("src < dst").join(deg.select(F.col("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    low = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = staged(und.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v")), "oriented")
    wedge = o.alias("p").join(o.alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.v") < F.col("q.v"))).select(F.col("p.u").alias("x"), F.col("p.v").alias("y"), F.col("q.v").alias("z"))
    closing = e.where("src < dst").select(F.col("src").alias("y"), F.col("dst").alias("z"))
    abc = F.array_sort(F.array("x", "y", "z"))
    return wedge.join(closing, ["y", "z"], "left_semi").select(abc[0].alias("a"), abc[1].alias("b"), abc[2].alias("c"))


def graph_lookup(edges: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """start, node, depth: everything reachable from each start separately, with least depth, at most max_depth where given."""
    e = staged(directed(edges), "lookup-edges")
    seen = staged(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)), "lookup")
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        fresh = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = staged(fresh.withColumn("depth", F.lit(depth)), "lookup")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def closeness(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, closeness: reached nodes over the sum of hops to them; all that a node reaches, or those within max_depth where given."""
    return graph_lookup(edges, _nodes(edges), max_depth).where("node != start").groupBy(F.col("start").alias("node")).agg((F.count("*") / F.sum("depth")).alias("closeness"))


def knn_mesh(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_where: str = "true", block: int = 1024, both_ways: bool = False) -> DataFrame:
    """src, dst, weight = 1 / (1 + |score|): each query row linked to its k nearest by L2; with both_ways each link also backward.

    The stated queries meet all rows in blocks: a block of queries is sent to every task in its turn, which keeps the k nearest of its own rows
    by one matrix product a batch, so only k rows a query and task are ever emitted. Rows without a vector have no links.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    have = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    asked = staged(vectors.where(query_where).where(F.col(vector).isNotNull()).select(F.col(key).alias("src"), F.col(vector).cast("array<double>").alias("vector")), "mesh-queries")
    kind = have.schema["key"].dataType.simpleString()
    count, found = asked.count(), None
    blocks = max(1, -(-count // block))
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("src"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        ids, x = part["src"].to_numpy(), np.array(part["vector"].to_pylist(), float).reshape(part.num_rows, -1)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, x))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            keys, far = np.empty((len(ids), 0), object), np.empty((len(ids), 0))
            for rows in batches:
                if not rows.num_rows or not len(ids):
                    continue
                own, y = rows.column(0).to_numpy(zero_copy_only=False), np.array(rows.column(1).to_pylist(), float)
                d = ((x[:, None] - y[None]) ** 2).sum(2) if len(x) * y.size < 1 << 22 else (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None]
                d = np.where(ids[:, None] == own[None], np.inf, np.maximum(d, 0))
                keys, far = np.concatenate([keys, np.broadcast_to(own.astype(object), d.shape)], axis=1), np.concatenate([far, d], axis=1)
                at = np.argsort(far, axis=1, kind="stable")[:, : k + 8]
                keys, far = np.take_along_axis(keys, at, 1), np.take_along_axis(far, at, 1)
            fits = np.isfinite(far)
            if fits.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, fits.sum(1))), pa.array(keys[fits].tolist()), pa.array(far[fits])], names=["src", "dst", "d"])

        own = have.mapInArrow(nearest, f"src {kind}, dst {kind}, d double")
        found = own if found is None else found.unionByName(own)
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("_r") <= k)
    out = near.select("src", "dst", (1 / (1 + F.abs("d"))).alias("weight"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight")) if both_ways else out
