"""Recursion to a fixpoint as a driver loop over DataFrames.

Each round is one plan that Catalyst optimises: the delta joins the full relation, partial
aggregation runs before the shuffle, and the result is a written table, so neither lineage
nor memory grows with the rounds.  A loop that does not end within ``rounds`` raises.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relation import CNT, absent, persistent
from .storage import Steps


class NoFixpoint(RuntimeError):
    pass


def semi_naive(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Least fixpoint of ``all = start union step(delta)`` as a set."""
    steps = Steps(start.sparkSession, "fixpoint")
    every = delta = steps.put(start.distinct())
    for _ in range(rounds):
        delta = steps.put(absent(step(delta).select(*every.columns).distinct(), every, every.columns))
        if delta.isEmpty():
            return every
        every = every.unionByName(delta)
        if steps.count % 8 == 0:  # keep the union short
            every = steps.put(every)
    raise NoFixpoint(f"no fixpoint in {rounds} rounds")


def with_counts(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Semi-naive recursion that keeps derivation counts.

    A fact is processed once, when it is new; deriving it again only raises its count.
    """
    steps = Steps(start.sparkSession, "counted")
    every = steps.put(persistent(start))
    keys = [c for c in every.columns if c != CNT]
    delta = every.select(*keys)
    for _ in range(rounds):
        got = persistent(step(delta).select(*keys))
        both = steps.put(every.withColumn("old", F.lit(1)).unionByName(got.withColumn("old", F.lit(0))).groupBy(*keys).agg(F.sum(CNT).alias(CNT), F.max("old").alias("old")))
        delta = both.where("old = 0").select(*keys)
        every = both.drop("old")
        if delta.isEmpty():
            return every
        steps.drop_before(2)
    raise NoFixpoint(f"no fixpoint in {rounds} rounds")


def lattice(start: DataFrame, keys: list[str], value: str, step: Callable[[DataFrame], DataFrame], better: str = "min", rounds: int = 1000, bucket: float | None = None) -> DataFrame:
    """Recursion through a min or max aggregate: the best row of each key, improved until nothing improves.

    ``value`` decides, the other columns come along and break ties.  Retraction is implied:
    a better row replaces the worse one and only the changed rows go on; a round writes what it
    improves, not the whole state.  ``bucket`` handles
    the improved rows in bands of that width, the best band first (a priority; same result).
    """
    steps = Steps(start.sparkSession, "lattice")
    columns = start.columns
    rest = [c for c in columns if c not in (*keys, value)]
    sign = 1 if better == "min" else -1

    def best(df: DataFrame) -> DataFrame:
        row = F.min(F.struct((sign * F.col(value)).alias("k"), *[F.col(c) for c in [value, *rest]])).alias("w")
        return df.groupBy(*keys).agg(row).select(*keys, *[F.col("w")[c].alias(c) for c in [value, *rest]]).select(*columns)

    def state() -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    parts = [steps.put(best(start))]  # a compact state and the improvements since, each the size of its round
    waiting = delta = parts[0]
    for n in range(rounds):
        if bucket is not None:
            low = waiting.agg(F.min(sign * F.col(value))).first()[0]
            if low is None:
                break
            ready = sign * F.col(value) <= low + bucket
            delta, later = waiting.where(ready), waiting.where(~ready)
        old = F.min(F.when(F.col("__old"), sign * F.col(value))).alias("__had")
        row = F.min(F.struct((sign * F.col(value)).alias("k"), *[F.col(c) for c in [value, *rest]])).alias("w")
        met = state().withColumn("__old", F.lit(True)).unionByName(step(delta).select(*columns).withColumn("__old", F.lit(False)))
        met = met.groupBy(*keys).agg(old, row).where(F.col("__had").isNull() | (F.col("w.k") < F.col("__had")))
        improved = steps.put(met.select(*keys, *[F.col("w")[c].alias(c) for c in [value, *rest]]).select(*columns))
        if bucket is None and improved.isEmpty():
            break
        delta = improved
        if bucket is not None:
            waiting = steps.put(best(later.unionByName(improved)))
        parts.append(improved)
        if len(parts) > 8:
            parts = [steps.put(best(state()))]
    else:
        raise NoFixpoint(f"no fixpoint in {rounds} rounds")
    return steps.put(best(state()))


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, unroll: int = 1) -> DataFrame:
    """A fixed number of synchronous rounds; ``unroll`` of them share one plan and one write."""
    steps = Steps(state.sparkSession, "rounds")
    for k in range(rounds):
        state = step(state, k)
        if (k + 1) % unroll == 0 and k + 1 < rounds:
            state = steps.put(state)
            steps.drop_before(2)
    return state


def until(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool], rounds: int = 1000) -> DataFrame:
    """Synchronous rounds until ``done(before, after)``."""
    steps = Steps(state.sparkSession, "until")
    state = steps.put(state)
    for k in range(rounds):
        after = steps.put(step(state, k))
        if done(state, after):
            return after
        state = after
        steps.drop_before(2)
    raise NoFixpoint(f"not done in {rounds} rounds")


def retract(base: DataFrame, removed: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts derivable without ``removed``.

    Counting alone keeps cycles that support themselves alive, so what remains is derived
    anew from the remaining base: same result for cyclic and acyclic support.
    """
    return derive(absent(base, removed, base.columns))
