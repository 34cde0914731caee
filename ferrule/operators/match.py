"""Rule bodies as joins: consuming, keeping, selecting.

Greedy matching in a canonical order stands for the order a rule would try facts in:
candidates are ordered by the columns given, ties by fact ids.  Two ways to consume:

``pair_by_rank``  both sides pair off in order inside a key: the n-th with the n-th.
``first_matches`` candidates are arbitrary combinations; a candidate wins when none before
                  it, among those still standing, shares a fact with it.  Repeated to the end that
                  gives what trying them one after another would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import Steps


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def pair_by_rank(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """Consuming join: every fact of either side is in one pair at most."""
    a, b = ranked(left, keys, left_order, "__rn"), ranked(right, keys, right_order, "__rn")
    return a.join(b, [*keys, "__rn"]).drop("__rn")


def all_pairs(left: DataFrame, right: DataFrame, on: list[str], where: Column | None = None, lanes: int = 32, block: int = 1 << 14) -> DataFrame:
    """Node-local product: every left row with every right row of its key, or those that ``where`` holds for.

    Few keys with many rows each would leave the pairs to one task a key, or to one a file where the right side is sent
    around.  Left rows are dealt over ``lanes`` and right rows, gathered in arrays of about ``block``, are given to every
    lane: no task holds a key's pairs or all of its right rows at once, and what is shuffled grows with the input alone.
    ``where`` may read columns of both sides.  Equal rows share a lane or a block.
    """
    spark = left.sparkSession
    rest = [c for c in right.columns if c not in on]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    deal = F.pmod(F.xxhash64(*rest), F.lit(right.count() // block + 1))
    many = right.groupBy(*on, deal.alias("__block")).agg(F.collect_list(F.struct(*rest)).alias("__many"))
    many = many.select(*on, *[F.col("__many")[c].alias(f"__{c}") for c in rest], F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("__lane"))
    dealt = left.withColumn("__lane", F.pmod(F.xxhash64(*left.columns), F.lit(lanes)).cast("int")).repartition(parts, *on, "__lane")
    met = dealt.join(many, [*on, "__lane"]).select(*left.columns, *[f"__{c}" for c in rest[1:]], F.posexplode(f"__{rest[0]}").alias("__at", rest[0]))
    out = met.select(*left.columns, rest[0], *[F.get(f"__{c}", "__at").alias(c) for c in rest[1:]])
    return out if where is None else out.where(where)


def pair_within(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Self-join without reuse: neighbours in order pair off, an odd last fact stays alone.

    The second fact's columns get the suffix ``_2``.
    """
    rn = ranked(df, keys, order, "__rn").withColumn("__pair", F.expr("(__rn - 1) div 2"))
    rest = [c for c in df.columns if c not in keys]
    first = rn.where("__rn % 2 = 1").drop("__rn")
    second = rn.where("__rn % 2 = 0").select(*keys, "__pair", *[F.col(c).alias(f"{c}_2") for c in rest])
    return first.join(second, [*keys, "__pair"]).drop("__pair")


def first_match(left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], order: list) -> DataFrame:
    """Linear fact with persistent facts: each left fact takes its first matching row only."""
    return ranked(left.join(right, on), left_id, order, "__rn").where("__rn = 1").drop("__rn")


def select_min(candidates: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """Ordered selector over rows that already satisfy the whole body: the first ``k`` of each key."""
    return ranked(candidates, keys, order, "__rn").where(F.col("__rn") <= k).drop("__rn")


def select_random(candidates: DataFrame, keys: list[str], ids: list[str], seed: int, k: int = 1) -> DataFrame:
    """Random selector that any engine can repeat: ordered by a hash of seed and ids."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    return select_min(candidates, keys, [key, *ids], k)


def first_matches(candidates: DataFrame, facts: list[str], order: list[str], kinds: list[str] | None = None, rounds: int = 1000) -> DataFrame:
    """The candidates that greedy matching in order takes; ``facts`` are their fact-id columns.

    Columns of one kind draw on the same facts (by default each column is a kind of its own), so
    a fact is used once wherever it stands.  Raises when ``rounds`` don't suffice; nothing is
    cut off silently.
    """
    kinds = kinds or facts
    steps = Steps(candidates.sparkSession, "matches")
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for k, c in zip(kinds, facts)])
    rank = F.struct(*order, *facts)
    left = steps.put(candidates.withColumn("__rank", rank).withColumn("__facts", named))
    chosen = None
    for _ in range(rounds):
        if left.isEmpty():
            return chosen if chosen is not None else candidates.limit(0)
        each = left.select("__rank", F.explode("__facts").alias("fact"))
        first = each.groupBy("fact").agg(F.min("__rank").alias("first"))
        win = each.join(first, "fact").groupBy("__rank").agg(F.min(F.col("__rank") == F.col("first")).alias("won")).where("won").select("__rank")
        win = steps.put(left.join(win, "__rank", "left_semi"))
        taken = win.select(*candidates.columns)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        used = win.select(F.explode("__facts").alias("fact")).distinct()
        lost = each.join(used, "fact", "left_semi").select("__rank").distinct()
        left = steps.put(left.join(lost, "__rank", "left_anti"))
    raise RuntimeError(f"matching did not end in {rounds} rounds")


def remote_upsert(state: DataFrame, edits: DataFrame, keys: list[str], values: list[str], order: list) -> DataFrame:
    """Edits replace values at their keys: one each, the last in order; other rows stay."""
    last = ranked(edits, keys, order, "__rn").where("__rn = 1").select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__hit"))
    out = state.join(last, keys, "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in state.columns])


def scatter(facts: DataFrame, edges: DataFrame, on: str = "node", to: str = "dst") -> DataFrame:
    """Comprehension over edges: each fact is sent along every edge of its node."""
    rest = [c for c in facts.columns if c != on]
    return facts.join(edges, on).select(F.col(to).alias(on), *rest, *[c for c in edges.columns if c not in (on, to)])


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Conditional head: rows for the one head and rows for the other; unknown counts as no."""
    yes = F.coalesce(condition, F.lit(False))
    return df.where(yes), df.where(~yes)
