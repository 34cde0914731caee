"""Search problems by level expansion: every level is one set-oriented step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..plans.storage import Steps


def queens(spark: SparkSession, n: int) -> DataFrame:
    """(board): all ways to place n queens; the latest row's column first."""
    columns = spark.range(n).select(F.col("id").cast("int").alias("c"))
    boards = columns.select(F.array("c").alias("board"))
    steps = Steps(spark, "queens")
    for k in range(1, n):
        tried = boards.select("board", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
        boards = tried.where(~B.queens_violation(F.col("c"), F.col("board"))).select(F.concat(F.array("c"), "board").alias("board"))
        if k % 4 == 0:
            boards = steps.put(boards)
    return boards


def minimax(spark: SparkSession, board: list[int], player: int = 1) -> DataFrame:
    """(move, score): value of each first move on a 3 x 3 board for ``player`` (1 or 2), both playing best."""
    me, other = player, 3 - player
    empty = [i for i, x in enumerate(board) if x == 0]
    start = spark.createDataFrame([([], board)], "path array<int>, board array<int>")
    steps = Steps(spark, "minimax")
    levels = [start]
    for depth in range(len(empty)):
        who = me if depth % 2 == 0 else other
        open_ = levels[-1].where(B.minimax_score(F.col("board"), me) == 0)
        moves = open_.select("path", "board", F.posexplode("board").alias("i", "x")).where("x = 0")
        levels.append(steps.put(moves.select(F.concat("path", F.array("i")).alias("path"), B.array_set(F.col("board"), F.col("i"), who).alias("board"))))
    value = None
    for depth in range(len(empty), 0, -1):
        leaf = levels[depth].select("path", B.minimax_score(F.col("board"), me).alias("own"))
        if value is not None:
            leaf = leaf.join(value, "path", "left").select("path", F.coalesce("best", "own").alias("own"))
        if depth == 1:
            return leaf.select(F.col("path")[0].alias("move"), F.col("own").alias("score"))
        pick = F.max("own") if depth % 2 == 1 else F.min("own")
        value = leaf.groupBy(F.slice("path", 1, depth - 1).alias("path")).agg(pick.alias("best"))
    return spark.createDataFrame([], "move int, score int")


def tree_lookups(tree: DataFrame, root: int, queries: DataFrame) -> DataFrame:
    """(key, value) by walking a binary search tree (node, key, value, left, right) level by level.

    All queries between two bounds walk together: what goes down the tree is one row a node with the bounds of the keys
    that get there, so a level costs its nodes, not all queries.  The tree is dealt by node once and kept where it is.
    """
    spark = tree.sparkSession
    steps = Steps(spark, "lookups")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    named = tree.select("node", F.col("key").alias("k"), "value", "left", "right").repartition(parts, "node").sortWithinPartitions("node").persist()
    try:
        most, kind = named.count(), named.schema["k"].dataType
        bound = F.lit(None).cast(kind)
        at = steps.put(spark.range(1).select(F.lit(root).cast("long").alias("node"), bound.alias("lo"), bound.alias("hi")))
        found, level = None, 0
        while not at.isEmpty():
            if level > most:
                raise ValueError("the nodes don't form a tree")
            level += 1
            here = steps.put(at.join(named, "node"))
            hit = here.where("(lo is null or k > lo) and (hi is null or k < hi)").select("k", "value")
            found = hit if found is None else found.unionByName(hit)
            less = F.struct(F.col("left").alias("node"), "lo", F.least("hi", "k").alias("hi"))
            more = F.struct(F.col("right").alias("node"), F.greatest("lo", "k").alias("lo"), "hi")
            at = here.where("k is not null").select(F.explode(F.array(less, more)).alias("to")).select("to.*").where("node is not null and (lo is null or hi is null or lo < hi)")
    finally:
        named.unpersist()
    return queries.join(found, F.col("key") == F.col("k")).select("key", "value")


def exchange_sort(lists: DataFrame) -> DataFrame:
    """(node, xs) with each list sorted by odd and even exchanges, element facts at their positions."""
    facts = lists.select("node", F.posexplode("xs").alias("pos", "x"), F.size("xs").alias("n"))
    longest = facts.agg(F.max("n")).first()[0] or 0
    steps = Steps(lists.sparkSession, "exchange")
    for k in range(longest):
        low = F.floor((F.col("pos") + k % 2) / 2)
        pairs = facts.groupBy("node", "n", low.alias("g")).agg(F.sort_array(F.collect_list("x")).alias("xs"), F.min("pos").alias("p"))
        facts = pairs.select("node", "n", F.posexplode("xs").alias("i", "x"), "p").select("node", (F.col("p") + F.col("i")).alias("pos"), "x", "n")
        if k % 4 == 3:
            facts = steps.put(facts)
    return facts.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("l")).select("node", F.col("l.x").alias("xs"))


def share_power(capacities: DataFrame, demands: DataFrame) -> DataFrame:
    """(consumer, generator): consumers, largest demand first, take the first generator with room, by turns.

    Each round offers every waiting consumer its next generator; a generator accepts, in order, as
    many as fit; who fits nowhere stays out.  capacities (generator, total), demands (consumer, power).
    """
    from pyspark.sql import Window as W

    from ..operators.aggregates import number_from

    steps = Steps(capacities.sparkSession, "power")
    numbered = steps.put(number_from(capacities.select("generator", F.col("total").cast("long").alias("room")), 0, ["generator"], lanes=8))
    n = numbered.count()
    waiting = steps.put(demands.select("consumer", F.col("power").cast("long").alias("power")))
    empty = waiting.limit(0).join(numbered.select("generator"), F.lit(False)).select("consumer", "generator")
    room = numbered
    placed = None
    for turn in range(n):
        offers = waiting.withColumn("id", F.pmod(F.xxhash64("consumer") % F.lit(n) + turn, F.lit(n))).join(room, "id")
        running = F.sum("power").over(W.partitionBy("generator").orderBy(F.desc("power"), "consumer").rowsBetween(W.unboundedPreceding, 0))
        taken = steps.put(offers.withColumn("run", running).where("run <= room").select("consumer", "generator", "power"))
        placed = taken if placed is None else placed.unionByName(taken)
        used = taken.groupBy("generator").agg(F.sum("power").alias("used"))
        room = steps.put(room.join(used, "generator", "left").select("id", "generator", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")))
        waiting = steps.put(waiting.join(taken, "consumer", "left_anti"))
        if waiting.isEmpty():
            break
    return placed.select("consumer", "generator") if placed is not None else empty


