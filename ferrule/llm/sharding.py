"""Sharding by longest processing time.

Groups of equal texts stay together.  All groups, sorted by size, go to the least-loaded
shard through a heap.  Groups of one size are interchangeable, so the schedule is made of
(size, number of groups) classes: it says how many groups of a class each shard takes, exactly
as taking them one by one would, and the groups of the class are dealt out by their rank in
it.  Distinct sizes add up to the input's bytes at most, so there are at most the root of
twice those bytes; nothing else about groups reaches the driver.

A group larger than a fair load can't be split by this law; its shard is then the largest.
Ranks and slots are gapless: rows are dealt by a hash into ``LANES`` lanes, and a lane starts
where the ones before it end, so a hot size, group or shard spreads over all lanes.  Null
texts count as empty ones, null ids are ids of their own.  Repeated rows get slots of their
own, ties go to the shard with the lower number, no rows give no rows, and further columns
of the table don't matter.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text_arrays as ta

SHARDS = 40
LANES = 128
OVERHEAD = 16


def longest_first(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, first rank, rank after the last): the largest first, each to the least-loaded shard, ties by number.

    ``classes`` are (size, number of groups).  Of a class with more groups than shards each shard
    offers its loads after 0, 1, 2 .. groups; the smallest offers of all are the ones that a heap
    would take, found by bisection.
    """
    loads, out = [0] * shards, []
    heap = [(0, s) for s in range(shards)]
    for size, n in sorted(classes, reverse=True):
        taken: dict[int, int] = {}
        if n > shards:
            lo, hi = min(loads), max(loads) + size * n  # offers below lo: fewer than n
            while lo < hi:
                mid = (lo + hi) // 2
                if sum(max(0, (mid - x) // size + 1) for x in loads if mid >= x) >= n:
                    hi = mid
                else:
                    lo = mid + 1
            taken = {s: (lo - 1 - x) // size + 1 for s, x in enumerate(loads) if lo - 1 >= x}
            left = n - sum(taken.values())
            for s in [s for s, x in enumerate(loads) if lo >= x and (lo - x) % size == 0][:left]:
                taken[s] = taken.get(s, 0) + 1
            for s, k in taken.items():
                loads[s] += k * size
            heap = [(x, s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
        else:
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                loads[s] += size
                taken[s] = taken.get(s, 0) + 1
        at = 0
        for s in sorted(taken):
            out.append((size, s, at, at + taken[s]))
            at += taken[s]
    return out


def gapless(df: DataFrame, key: str, lane_of: list, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: numbers from 0 inside each ``key``, without one task seeing all of a key."""
    laned = df.withColumn("__lane", F.pmod(F.xxhash64(*lane_of), F.lit(LANES)).cast("int"))
    counts = laned.groupBy(key, "__lane").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__lane").rowsBetween(W.unboundedPreceding, -1))  # LANES rows a key
    starts = counts.select(key, "__lane", F.coalesce(before, F.lit(0)).alias("__start"))
    rank = F.row_number().over(W.partitionBy(key, "__lane").orderBy(*order)) - 1
    return laned.withColumn("__rank", rank).join(starts, [key, "__lane"]).withColumn(name, (F.col("__rank") + F.col("__start")).cast("long")).drop("__lane", "__rank", "__start")


def assign(df: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df``'s id with size, text_crc32, law, shard, slot and grown_shard."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")
    )
    rows = ta.cut(rows, "sizes")  # a few dozen bytes a row: the texts are read once
    groups = gapless(rows.groupBy("digest").agg(F.sum("size").alias("load")), "load", ["digest"], ["digest"], "rank")
    groups = ta.cut(groups, "groups")
    classes = groups.groupBy("load").agg(F.count("*").alias("n")).toArrow()  # one row for each distinct load
    plan = longest_first(list(zip(classes.column(0).to_pylist(), classes.column(1).to_pylist())), shards)
    where = spark.createDataFrame(pa.table([pa.array([p[i] for p in plan], pa.int64()) for i in range(4)], names=["load", "shard", "lo", "hi"]))
    # a class of more than 40 groups has 40 ranges at most
    ranges = where.groupBy("load").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("ranges"))
    mine = F.filter("ranges", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))
    homes = groups.join(ranges, "load").select("digest", mine[0]["shard"].cast("int").alias("shard"))
    placed = ta.cut(rows.join(homes, "digest").select("doc_id", "size", "text_crc32", "shard"), "placed")
    out = gapless(placed, "shard", ["doc_id"], ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(ta.table(spark, sf_dir, "documents"), SHARDS)
