"""Registry of named queries with their SQL twins, and the relations they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` gives the same rows in DuckDB."""

    def wrap(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap


class Tables:
    """The tables of one scale factor, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def rounded(x: Column, digits: int) -> Column:
    """``round`` as SQL engines have it on doubles: what rounds to zero keeps its sign, where Spark's has no -0.0."""
    return F.when(x < 0, -F.round(-x, digits)).when(x == 0, x).otherwise(F.round(x, digits))


def succession(t: Tables) -> DataFrame:
    """Part succession graph: edge(node, dst, w) between parts on consecutive lines of an order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = t.lineitem.select(F.col("l_partkey").alias("node"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").cast("int").alias("w"))
    return pairs.where("dst is not null and node <> dst").groupBy("node", "dst").agg(F.min("w").alias("w"))


SUCCESSION = """select src as node, dst, min(w) as w from (
  select l_partkey as src, lead(l_partkey) over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as dst,
    cast(l_quantity as int) as w from lineitem) t
where dst is not null and src <> dst group by src, dst"""


def first_part(t: Tables) -> DataFrame:
    return t.part.agg(F.min("p_partkey").alias("node"))


def trade(t: Tables) -> DataFrame:
    """Nation trade graph: edge(node, dst, w) from customer nation to supplier nation, w lines modulo 97 plus 1."""
    c = t.customer.select("c_custkey", "c_nationkey")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    joined = lines.join(o, lines.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    edges = joined.groupBy(F.col("c_nationkey").cast("long").alias("node"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    return edges.where("node <> dst").select("node", "dst", (F.col("n") % 97 + 1).cast("int").alias("w"))


TRADE = """select c_nationkey::bigint as node, s_nationkey::bigint as dst, (count(*) % 97 + 1)::int as w
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
where c_nationkey <> s_nationkey group by 1, 2"""


def rounds(first: str, step: str, n: int, last: str, ctes: str = "") -> str:
    """SQL of ``n`` unrolled rounds; ``step`` reads {prev}."""
    parts = [f"r0 as materialized ({first})"]
    parts += [f"r{k + 1} as materialized ({step.format(prev=f'r{k}', k=k)})" for k in range(n)]
    return f"with {ctes + ', ' if ctes else ''}{', '.join(parts)} {last.format(prev=f'r{n}')}"
