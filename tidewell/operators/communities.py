"""Strongly connected components, betweenness, modularity communities and k cheapest paths, as rounds of joins staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import paths
from tidewell.sources.stages import staged


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (least node of it). Each round the greatest node that reaches a node is its colour; what reaches a colour's own node
    within the colour is one component and leaves. Every round settles at least one component of each colour."""
    e = staged(edges.select("src", "dst").where("src != dst").distinct(), "scc-edges")
    left, done = staged(_nodes(edges), "scc-nodes"), None
    while not left.isEmpty():
        colours = left.select("node", F.col("node").alias("colour"))
        fresh = colours
        while not fresh.isEmpty():
            given = fresh.join(e, fresh["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
            both = staged(colours.join(given, "node", "left").select("node", F.greatest("colour", "got").alias("colour"), (F.col("got") > F.col("colour")).alias("new")), "scc-colours")
            colours, fresh = both.select("node", "colour"), both.where("new").select("node", "colour")
        within = e.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other")
        within = staged(within.select("src", "dst"), "scc-within")
        found = fresh = staged(colours.where("node = colour"), "scc-found")
        while not fresh.isEmpty():
            back = fresh.join(within, fresh["node"] == within["dst"]).select(F.col("src").alias("node"), "colour").distinct()
            fresh = staged(back.join(found, "node", "left_anti"), "scc-found")
            found = found.unionByName(fresh)
        done = found if done is None else done.unionByName(found)
        left = staged(left.join(found, "node", "left_anti"), "scc-nodes")
        e = staged(e.join(left, e["src"] == left["node"], "left_semi").join(left, e["dst"] == left["node"], "left_semi"), "scc-edges")
    if done is None:
        return left.withColumn("component", F.col("node"))
    return done.join(done.groupBy("colour").agg(F.min("node").alias("component")), "colour").select("node", "component")


def betweenness(edges: DataFrame) -> DataFrame:
    """node, betweenness: over all ordered pairs, the share of shortest paths by hops that pass through the node.

    A node whose only neighbour, both ways, is one other is folded into that one, round by round, until none is left; what passes through folded
    nodes and between what is folded into one node follows from numbers of nodes alone, as there is only one way. So trees take rows in proportion to
    their nodes. Of the rest, levels of all starts grow together with their numbers of paths, then shares flow back level by level, with nodes that weigh as many as were
    folded into them. These rows are pairs of a start and a node it reaches, which the measure itself asks for.
    """
    e = staged(edges.select("src", "dst").where("src != dst").distinct(), "between-edges")
    # weight: itself and all folded into it; squares: of the weights of its branches, summed
    nodes = staged(_nodes(edges).select("node", F.lit(1.0).alias("weight"), F.lit(0.0).alias("squares")), "between-nodes")
    folded = []
    while True:
        ends = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"), F.max("dst").alias("most")).where("parent = most")
        back = e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("first"), F.max("src").alias("last")).where("first = last")
        leaves = ends.join(back, "node").where("parent = first").select("node", "parent")
        # of two that have only each other the smaller one stays
        pairs = leaves.select(F.col("node").alias("parent"), F.col("parent").alias("node"))
        leaves = leaves.join(pairs, ["node", "parent"], "left_semi").where("node > parent").unionByName(leaves.join(pairs, ["node", "parent"], "left_anti"))
        leaves = staged(leaves.join(nodes, "node"), "between-folded")
        if leaves.isEmpty():
            break
        folded.append(leaves)
        more = leaves.groupBy(F.col("parent").alias("node")).agg(F.sum("weight").alias("more"), F.sum(F.col("weight") * F.col("weight")).alias("own"))
        nodes = nodes.join(leaves.select("node"), "node", "left_anti").join(more, "node", "left")
        nodes = staged(nodes.select("node", (F.col("weight") + F.coalesce("more", F.lit(0.0))).alias("weight"), (F.col("squares") + F.coalesce("own", F.lit(0.0))).alias("squares")), "between-nodes")
        gone = leaves.select("node")
        e = staged(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "between-edges")

    weights = nodes.select("node", "weight")
    seen = level = staged(nodes.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("ways"), "weight", F.col("weight").alias("starts")).where(F.lit(not e.isEmpty())), "between")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        step = level.join(e, level["node"] == e["src"]).groupBy("start", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"), F.max("starts").alias("starts"))
        level = staged(step.join(seen, ["start", "node"], "left_anti").join(weights, "node").select("start", "node", "ways", "weight", "starts"), "between")
        seen = seen.unionByName(level)
    none = F.lit(0.0)
    shares, below = nodes.select("node", none.alias("share"), none.alias("out"), none.alias("into")), None
    for level in reversed(levels[1:]):
        if below is not None:
            flow = below.join(e, below["node"] == e["dst"]).select("start", F.col("src").alias("node"), ((F.col("weight") + F.col("share")) / F.col("ways")).alias("part")).groupBy("start", "node").agg(F.sum("part").alias("part"))
            below = staged(level.join(flow, ["start", "node"], "left").select("start", "node", "ways", "weight", "starts", F.coalesce(F.col("ways") * F.col("part"), none).alias("share")), "between-back")
        else:
            below = level.withColumn("share", none)
        shares = shares.unionByName(below.select("node", (F.col("starts") * F.col("share")).alias("share"), none.alias("out"), F.col("starts").alias("into")))
        shares = shares.unionByName(below.select(F.col("start").alias("node"), none.alias("share"), F.col("weight").alias("out"), none.alias("into")))
    # out and into: how many nodes outside what is folded into a node it reaches, and reach it
    core = staged(shares.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("share", "out", "into")]).join(nodes, "node"), "between-core")
    own = lambda df: df.select("node", "weight", "squares", "share", "out", "into")
    done = known = own(core)
    for leaves in reversed(folded):
        above = known.select(F.col("node").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("weight", "out", "into")])
        beyond = lambda c: (F.col(f"p_{c}") + F.col("p_weight") - F.col("weight")).alias(c)
        found = staged(own(leaves.join(above, "parent").select("node", "weight", "squares", F.lit(0.0).alias("share"), beyond("out"), beyond("into"))), "between-done")
        done = known = done.unionByName(found)
    branches = F.col("weight") - 1
    return done.select("node", (F.col("share") + branches * branches - F.col("squares") + branches * (F.col("out") + F.col("into"))).alias("betweenness"))


def louvain(edges: DataFrame, rounds: int = 8, levels: int = 3) -> DataFrame:
    """node, community (least node of it): nodes move to the neighbouring community that gains most modularity, then communities become nodes.

    In a round half of the nodes, by hash, may move, so that neighbours don't swap for ever; ties go to the least community. Edges are taken both ways.
    ``rounds`` a level and ``levels`` are the method's limits: it may stop while some node would still gain by moving.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    e = staged(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "louvain-edges")
    whole = e.agg(F.sum("w")).first()[0] or 1.0
    member = staged(_nodes(edges).withColumn("community", F.col("node")), "louvain")
    for _ in range(levels):
        degree = staged(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "louvain-degrees")
        place = degree.select("node", "k", F.col("node").alias("c"))
        for turn in range(rounds):
            total = place.groupBy("c").agg(F.sum("k").alias("tot"))
            links = e.where("src != dst").join(place.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("to"))
            own = place.select("node", "c", F.lit(0.0).alias("to"))
            offers = links.unionByName(own).groupBy("node", "c").agg(F.sum("to").alias("to")).join(total, "c").join(place.select("node", "k", F.col("c").alias("home")), "node")
            offers = offers.withColumn("gain", F.round(F.col("to") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("home"), F.col("k")).otherwise(0.0)) / whole, 9))
            best = offers.groupBy("node", "k", "home").agg(F.max_by("c", F.struct("gain", (F.col("c") == F.col("home")), -F.col("c"))).alias("c"))
            free = F.xxhash64(F.col("node"), F.lit(turn)) % 2 == 0
            new = staged(best.select("node", "k", F.when(free, F.col("c")).otherwise(F.col("home")).alias("c"), (F.col("c") != F.col("home")).alias("wants")), "louvain")
            place = new.drop("wants")
            if new.where("wants").isEmpty():
                break
        moved = place.select(F.col("node").alias("community"), F.col("c").alias("_c"))
        member = staged(member.join(moved, "community").select("node", F.col("_c").alias("community")), "louvain")
        to = place.select("node", "c")
        e = staged(e.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "louvain-edges")
        if place.where("node != c").isEmpty():
            break
    return member.join(member.groupBy("community").agg(F.min("node").alias("least")), "community").select("node", F.col("least").alias("community"))


def cheapest_paths(edges: DataFrame, source, target, k: int, max_hops: int) -> DataFrame:
    """path, cost, length: the k cycle-free paths of least cost from source to target within max_hops; ties by hops, then by nodes.

    Paths grow from both ends, half of the hops each, and meet in a join on the node between, so rows grow with half the hops.
    """
    kind, spark = edges.schema["src"].dataType.simpleString(), edges.sparkSession
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ahead, back = -(-max_hops // 2), max_hops // 2
    here = lambda node, e, n: spark.createDataFrame([([node], 0.0)], f"path array<{kind}>, cost double").unionByName(paths(e, spark.createDataFrame([(node,)], f"node {kind}"), 1, n).select("path", "cost")) if n else spark.createDataFrame([([node], 0.0)], f"path array<{kind}>, cost double")
    left, right = here(source, edges, ahead), here(target, turned, back)
    left = left.select(F.element_at("path", -1).alias("mid"), F.col("path").alias("a"), F.col("cost").alias("x"))
    right = right.select(F.element_at("path", -1).alias("mid"), F.slice(F.reverse("path"), 2, F.size("path")).alias("b"), F.col("cost").alias("y"))
    met = left.join(right, "mid").where(~F.arrays_overlap("a", "b") | (F.size("b") == 0))
    # a path of n hops is met once: with as many hops behind the middle as there can be
    met = met.where((F.size("a") - 1 == F.lit(ahead)) | (F.size("b") == 0))
    whole = met.select(F.concat("a", "b").alias("path"), (F.col("x") + F.col("y")).alias("cost"))
    return whole.withColumn("length", F.size("path") - 1).where("length > 0").orderBy("cost", "length", "path").limit(k)
