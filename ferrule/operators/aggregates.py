"""Predicate aggregates and head aggregates.

Predicate aggregates group by the fields before the aggregated one; fields behind it come
from the winning fact.  Ties are settled by all columns in order, so results don't depend
on arrival.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.relation import CNT


def _winner(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first fact of each key; a null comes after every value."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [x for i, o in enumerate(order) for x in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))]
    best = F.min(F.struct(*ranks, *[F.col(c).alias(c) for c in rest])).alias("w")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("w")[c].alias(c) for c in rest])


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The fact that comes first in ``order``, then by its other columns."""
    return _winner(df, keys, [F.col(c) for c in order])


def min_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The whole fact with the smallest value; map-side combined.  A null wins only where there is nothing else."""
    return _winner(df, keys, [F.col(value)])


def max_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The whole fact with the largest value, of any type that has an order."""
    kind = df.schema[value].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):  # the smallest long has no opposite among longs
        return _winner(df, keys, [-F.col(value).cast("decimal(20,0)")])
    if kind in ("float", "double") or kind.startswith("decimal"):
        return _winner(df, keys, [-F.col(value)])
    top = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    right = top.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], "__top")
    hit = reduce(lambda x, y: x & y, [*same, F.col(value).eqNullSafe(F.col("__top"))])
    return _winner(df.join(right, hit).select(*df.columns), keys, [])


def sum_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum weighted by derivation counts; the other fields come from the smallest fact."""
    weight = F.col(CNT) if CNT in df.columns else F.lit(1)
    rest = [c for c in df.columns if c not in (*keys, value, CNT)]
    aggs = [F.sum(F.col(value) * weight).alias(value)]
    if rest:
        aggs.append(F.min(F.struct(*rest)).alias("w"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, value, *[F.col("w")[c].alias(c) for c in rest]) if rest else out


def sum_lists(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element-wise sum of lists: positions are summed apart, then gathered again.  A shorter list adds nothing at the
    positions that it lacks; a null list is an empty one."""
    flat = df.select(*keys, F.posexplode(value).alias("pos", "x"))
    sums = flat.groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    return sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("l")).select(*keys, F.col("l.x").alias(value))


def head_aggregate(groups: DataFrame, matches: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates over the matches of every group; a group without matches fires once, with 0 for sums and counts and
    null for all else."""
    got = matches.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    out = groups.select(*keys).distinct().join(got, keys, "left")
    kinds = {f.name: f.dataType for f in got.schema}
    zero = {n: F.lit(0).cast(kinds[n]) for n, a in aggs.items() if re.match(r"Column<'(sum|count)\(", str(a))}
    return out.select(*keys, *[F.coalesce(F.col(n), zero[n]).alias(n) if n in zero else F.col(n) for n in aggs])


def collect_desc(value) -> Column:
    """Collected list in descending order: a definite order for what arrival would decide."""
    return F.sort_array(F.collect_list(value), asc=False)


def fold(values: Column, initial: Column, step, finish=None) -> Column:
    """Custom fold over a collected list, in ascending order of its elements."""
    ordered = F.sort_array(values)
    return F.aggregate(ordered, initial, step, finish) if finish else F.aggregate(ordered, initial, step)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Retract-and-insert pairs of an aggregate that changed: sign -1 the old result, +1 the new."""
    values = [c for c in new.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*values).alias("o")), new.select(*keys, F.struct(*values).alias("n"))
    both = a.join(b, keys, "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    minus = both.where("o is not null").select(*keys, *[F.col("o")[v].alias(v) for v in values], F.lit(-1).alias("sign"))
    plus = both.where("n is not null").select(*keys, *[F.col("n")[v].alias(v) for v in values], F.lit(1).alias("sign"))
    return minus.unionByName(plus)


def number_from(df: DataFrame, start: int, order: list[str], lanes: int = 64) -> DataFrame:
    """Fresh consecutive ids from ``start`` in a definite order without one task seeing all rows.

    Rows are ranged by ``order``; each range's first number comes from the counts of those before.
    """
    spark = df.sparkSession
    from ..plans.storage import Steps

    placed = Steps(spark, "numbers").put(df.repartitionByRange(lanes, *order).withColumn("__lane", F.spark_partition_id()))
    at, starts = start, []
    for r in sorted(placed.groupBy("__lane").count().collect()):  # one row a lane
        starts.append((r["__lane"], at))
        at += r["count"]
    first = spark.createDataFrame(starts or [(0, start)], "__lane int, __start long")
    rank = F.row_number().over(W.partitionBy("__lane").orderBy(*order))
    return placed.withColumn("__rn", rank).join(F.broadcast(first), "__lane").withColumn("id", F.col("__start") + F.col("__rn") - 1).drop("__lane", "__rn", "__start")
