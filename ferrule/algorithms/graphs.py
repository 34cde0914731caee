"""Graph algorithms as rules over edge relations (node, dst[, w])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.aggregates import head_aggregate
from ..plans.fixpoint import NoFixpoint, iterate, lattice, semi_naive, until, with_counts
from ..plans.storage import Steps


def settled(edges: DataFrame) -> DataFrame:
    """Edges written once, dealt out by node: every round of a recursion reads them from there."""
    return Steps(edges.sparkSession, "edges").put(edges.repartition("node"))


def shortest_paths(edges: DataFrame, start: DataFrame, bucket: float | None = None) -> DataFrame:
    """(node, d): least cost from any start node; recursion through a min aggregate."""

    edges = settled(edges)

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(edges, "node").select(F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"))

    first = start.select("node", F.lit(0).cast("long").alias("d"))
    return lattice(first, ["node"], "d", step, bucket=bucket)


def shortest_routes(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, d, route): least cost with the route that comes first among equals."""

    edges = settled(edges)

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(edges, "node").select(F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.concat("route", F.array("dst")).alias("route"))

    first = start.select("node", F.lit(0).cast("long").alias("d"), F.array("node").alias("route"))
    return lattice(first, ["node"], "d", step)


def all_pairs(edges: DataFrame) -> DataFrame:
    """(src, node, d) of every pair joined by a path of one edge or more."""

    edges = settled(edges)

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(edges, "node").select("src", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"))

    first = edges.select(F.col("node").alias("src"), F.col("dst").alias("node"), F.col("w").cast("long").alias("d"))
    return lattice(first, ["src", "node"], "d", step)


def shortest_cycle(edges: DataFrame) -> DataFrame:
    """(node, d): the least cost of a way back to each node."""
    return all_pairs(edges).where("src = node").select("node", "d")


def a_star(edges: DataFrame, start: DataFrame, goal: DataFrame, estimate: Column) -> DataFrame:
    """(node, d) of the goals.  ``estimate`` (over node) must not exceed the true rest; only paths whose
    estimate beats the best goal so far go on."""
    spark = edges.sparkSession
    steps = Steps(spark, "astar")
    edges = settled(edges)
    full = steps.put(start.select("node", F.lit(0).cast("long").alias("d")))
    delta = full
    for _ in range(10_000):
        best = full.join(goal, "node", "left_semi").agg(F.min("d")).first()[0]
        if best is not None:
            delta = delta.where(F.col("d") + estimate < F.lit(best))
        made = delta.join(edges, "node").select(F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d")).groupBy("node").agg(F.min("d").alias("nd"))
        merged = steps.put(full.join(made, "node", "full_outer").select("node", F.least("d", "nd").alias("d"), (F.col("nd") < F.coalesce("d", F.col("nd") + 1)).alias("new")))
        delta = merged.where("new").select("node", "d")
        full = merged.select("node", "d")
        if delta.isEmpty():
            return full.join(goal, "node", "left_semi")
    raise RuntimeError("A* did not end")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that the start nodes reach, themselves included."""
    edges = settled(edges.select("node", "dst"))
    return semi_naive(start.select("node"), lambda d: d.join(edges, "node").select(F.col("dst").alias("node")))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(node, dst) joined by a path."""
    first = settled(edges.select("node", "dst"))
    step = first.select(F.col("node").alias("dst"), F.col("dst").alias("to"))
    return semi_naive(first, lambda d: d.join(step, "dst").select("node", F.col("to").alias("dst")))


def connectivity_counts(edges: DataFrame) -> DataFrame:
    """(node, dst, cnt): paths with how often each was derived."""
    first = settled(edges.select("node", "dst"))
    step = first.select(F.col("node").alias("dst"), F.col("dst").alias("to"))
    return with_counts(first, lambda d: d.join(step, "dst").select("node", F.col("to").alias("dst")))


def bounded_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, d): least cost over at most so many edges; one unrolled plan over written edges."""
    edges = settled(edges)
    best = start.select("node", F.lit(0).cast("long").alias("d"))
    for _ in range(hops):
        more = best.join(edges, "node").select(F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        best = best.unionByName(more).groupBy("node").agg(F.min("d").alias("d"))
    return best


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component; edges count both ways.

    Each round hooks every node to its least neighbour, follows the hooks to their roots and
    contracts the edges.  Rounds after the first compare hashes that change with the round, so
    their number grows with the logarithm of the nodes, not with the diameter.
    """
    steps = Steps(edges.sparkSession, "components")
    nodes = edges.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    left = steps.put(edges.where("node <> dst").select(F.least("node", "dst").alias("a"), F.greatest("node", "dst").alias("b")).distinct())
    labels, turn = steps.put(nodes.select("node", F.col("node").alias("root"))), 0
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, other = (F.xxhash64(c, F.lit(turn)) if turn else F.col(c) for c in "ab")
        hook = ends.groupBy("a").agg(F.min_by("b", other).alias("b"), F.min(other).alias("least"))
        hook = steps.put(hook.select(F.col("a").alias("v"), F.when(F.col("least") < own, F.col("b")).otherwise(F.col("a")).alias("p")))
        moving = True
        while moving:  # the distance to the root halves with each hop
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook = steps.put(hook.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moving = not hook.where("moved").isEmpty()
        moved = hook.select(F.col("v").alias("root"), F.col("p").alias("to"))
        labels = steps.put(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = steps.put(left.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        turn += 1
    least = labels.groupBy("root").agg(F.min("node").alias("label"))
    return labels.join(least, "root").select("node", "label")


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85, digits: int = 12) -> DataFrame:
    """(node, rank) after so many synchronous rounds over nodes of either end of an edge.

    A node without out-edges passes nothing on.  Ranks are kept to ``digits`` decimals, so the
    order of summing doesn't show.
    """
    nodes = edges.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    degree = edges.groupBy("node").agg(F.count("*").alias("deg"))
    steps = Steps(edges.sparkSession, "pagerank")
    links = steps.put(edges.join(degree, "node").select("node", "dst", "deg"))
    nodes = steps.put(nodes)
    n = nodes.count()
    kind = f"decimal(38,{digits + 4})"

    def step(state: DataFrame, _: int) -> DataFrame:
        sent = links.join(state, "node").groupBy(F.col("dst").alias("node")).agg(F.sum((F.col("rank") / F.col("deg")).cast(kind)).alias("in"))
        got = nodes.join(sent, "node", "left")
        return got.select("node", F.round((1 - damping) / F.lit(n) + damping * F.coalesce(F.col("in").cast("double"), F.lit(0.0)), digits).alias("rank"))

    return iterate(nodes.select("node", F.round(F.lit(1.0) / n, digits).alias("rank")), step, rounds)


def pagerank_until(edges: DataFrame, threshold: float, damping: float = 0.85) -> DataFrame:
    """Rounds until no rank moves by more than ``threshold``."""
    nodes = edges.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    degree = edges.groupBy("node").agg(F.count("*").alias("deg"))
    links = Steps(edges.sparkSession, "links").put(edges.join(degree, "node").select("node", "dst", "deg"))
    n = nodes.count()

    def step(state: DataFrame, _: int) -> DataFrame:
        sent = links.join(state, "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        return state.select("node").join(sent, "node", "left").select("node", ((1 - damping) / F.lit(n) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))

    def done(a: DataFrame, b: DataFrame) -> bool:
        moved = a.join(b.withColumnRenamed("rank", "r2"), "node").agg(F.max(F.abs(F.col("rank") - F.col("r2")))).first()[0]
        return moved is None or moved <= threshold

    return until(nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank")), step, done)


def greedy_coloring(edges: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(node, color): each node takes the smallest color free among smaller-numbered neighbours.

    A node is ready when all of those have a color; every round colors all ready nodes at once.
    """
    steps = Steps(edges.sparkSession, "coloring")
    both = edges.where("node <> dst").select("node", "dst").unionByName(edges.where("node <> dst").select(F.col("dst").alias("node"), F.col("node").alias("dst"))).distinct()
    earlier = steps.put(both.where("dst < node"))
    nodes = steps.put(edges.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    need = steps.put(earlier.groupBy("node").agg(F.count("*").alias("need")))
    colored = steps.put(nodes.join(need, "node", "left_anti").select("node", F.lit(0).alias("color")))
    total = nodes.count()
    for _ in range(rounds):
        if colored.count() == total:
            return colored
        seen = earlier.join(colored.withColumnRenamed("node", "dst"), "dst").groupBy("node").agg(F.count("*").alias("have"), F.sort_array(F.collect_set("color")).alias("taken"))
        ready = seen.join(need, "node").where("have = need").join(colored, "node", "left_anti")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        colored = steps.put(colored.unionByName(ready.select("node", free.alias("color"))))
    raise NoFixpoint(f"not all nodes have a color after {rounds} rounds")


def valid_coloring(edges: DataFrame, colors: DataFrame) -> bool:
    a, b = colors.select("node", F.col("color").alias("ca")), colors.select(F.col("node").alias("dst"), F.col("color").alias("cb"))
    return edges.where("node <> dst").join(a, "node").join(b, "dst").where("ca = cb").isEmpty()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degree and total weight of every node; a node without edges gets zeros."""
    return head_aggregate(nodes, edges, ["node"], degree=F.count("*"), weight=F.sum(F.col("w").cast("long")))


def max_flow(edges: DataFrame, source: int, sink: int, rounds: int = 100_000) -> int:
    """Value of a largest flow: breadth-first augmenting paths over residual capacities (node, dst, cap)."""
    steps = Steps(edges.sparkSession, "flow")
    back = edges.select(F.col("dst").alias("node"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("cap"))
    rest = steps.put(edges.select("node", "dst", F.col("cap").cast("long").alias("cap")).unionByName(back).groupBy("node", "dst").agg(F.sum("cap").alias("cap")))
    total = 0
    for _ in range(rounds):
        level = steps.put(edges.sparkSession.createDataFrame([(source, [source], 1 << 62)], "node long, path array<long>, room long"))
        visited = level.select("node")
        found = None
        while not level.isEmpty():
            hit = level.where(F.col("node") == sink).orderBy("path").first()
            if hit:
                found = hit
                break
            nxt = level.join(rest.where("cap > 0"), "node").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.least("room", "cap").alias("room"))
            nxt = nxt.join(visited, "node", "left_anti")
            nxt = nxt.withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy("path"))).where("rn = 1").drop("rn")
            level = steps.put(nxt)
            visited = visited.unionByName(level.select("node"))
        if found is None:
            return total
        total += found["room"]
        pairs = list(zip(found["path"], found["path"][1:]))
        change = edges.sparkSession.createDataFrame([(a, b, -found["room"]) for a, b in pairs] + [(b, a, found["room"]) for a, b in pairs], "node long, dst long, delta long")
        rest = steps.put(rest.join(F.broadcast(change.groupBy("node", "dst").agg(F.sum("delta").alias("delta"))), ["node", "dst"], "left").select("node", "dst", (F.col("cap") + F.coalesce("delta", F.lit(0))).alias("cap")))
    raise NoFixpoint(f"the flow still grows after {rounds} paths")
