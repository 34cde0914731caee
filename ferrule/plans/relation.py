"""The two kinds of relation: counted sets and multisets of consumable facts.

A persistent relation is a set with a derivation count ``cnt``: deriving a fact again only
raises its count, and it leaves when its count falls to zero.  A linear relation is a
multiset whose facts are used up by the rules that match them; ``fid`` tells equal facts
apart.  The first column of a graph relation is ``node`` by convention, not by force.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CNT, FID = "cnt", "fid"


def absent(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``columns`` are not in ``other``; nulls equal each other, so a fact with a null is known again."""
    right = other.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(columns)])
    return df.join(right, same, "left_anti")


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (CNT, FID)]


def persistent(df: DataFrame) -> DataFrame:
    """Facts with their derivation counts; one shuffle, partial counts before it."""
    keys = payload(df)
    times = F.sum(CNT) if CNT in df.columns else F.count("*")
    return df.groupBy(*keys).agg(times.cast("long").alias(CNT))


def union_counted(*frames: DataFrame) -> DataFrame:
    """Counted set union: counts of equal facts add up."""
    out = None
    for df in frames:
        df = df if CNT in df.columns else df.withColumn(CNT, F.lit(1).cast("long"))
        out = df if out is None else out.unionByName(df)
    return persistent(out)


def subtract_counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counted set difference: counts go down, facts at zero or below are gone."""
    right = right if CNT in right.columns else right.withColumn(CNT, F.lit(1).cast("long"))
    return union_counted(left, right.withColumn(CNT, -F.col(CNT))).where(F.col(CNT) > 0)


def cancel(derivations: DataFrame, sign: str = "sign") -> DataFrame:
    """Positive and negative derivations of one fact cancel before anyone sees them."""
    keys = [c for c in derivations.columns if c != sign]
    return derivations.groupBy(*keys).agg(F.sum(sign).alias(sign)).where(F.col(sign) != 0)


def repeat_by_count(df: DataFrame) -> DataFrame:
    """Each fact as often as its count, as a listing shows it."""
    return df.select(*payload(df), F.explode(F.sequence(F.lit(1), F.col(CNT).cast("int"))).alias("__n")).drop("__n")


def linear(df: DataFrame) -> DataFrame:
    """Facts with an id that depends on their values and their number among equals only.

    Equal facts are counted (partly before the shuffle) and numbered from the count, so many of
    them never meet as rows in one task.
    """
    keys = payload(df)
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else df.agg(F.count("*").alias("__n"))
    text = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return counted.select(*keys, text.alias("__t"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__k")).select(
        *keys, F.concat_ws("#", "__t", F.col("__k").cast("string")).alias(FID)
    )


def consume(facts: DataFrame, used: DataFrame) -> DataFrame:
    """Facts without those whose ids were used."""
    return facts.join(used.select(FID).distinct(), FID, "left_anti")


def produce(facts: DataFrame, *made: DataFrame) -> DataFrame:
    """Facts with new ones added; ids are dealt anew, as equal facts may have come together."""
    out = facts.select(*payload(facts))
    for df in made:
        out = out.unionByName(df.select(*payload(facts)))
    return linear(out)
