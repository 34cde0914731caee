"""Graph and fact sources; every schema is declared, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def axioms(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Facts written in the program."""
    return spark.createDataFrame(rows, schema)


def universal(nodes: DataFrame, **values) -> DataFrame:
    """An axiom for every node."""
    return nodes.select("node", *[F.lit(v).alias(k) for k, v in values.items()])


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A relation stored as Parquet; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def snap(spark: SparkSession, path: str, weighted: bool = False, undirected: bool = False, default_weight: int | None = None) -> DataFrame:
    """Tab-separated edge list with # comments: node, dst and perhaps w."""
    schema = "node long, dst long" + (", w int" if weighted else "")
    edges = spark.read.csv(path, sep="\t", schema=schema, comment="#").where("node is not null and dst is not null")
    if default_weight is not None and not weighted:
        edges = edges.withColumn("w", F.lit(default_weight))
    if undirected:
        back = edges.select(F.col("dst").alias("node"), F.col("node").alias("dst"), *edges.columns[2:])
        edges = edges.unionByName(back).distinct()
    return edges


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id: n1 n2 .. -1``: node, dst."""
    lines = spark.read.text(path).where(F.col("value").contains(":"))
    parts = F.split("value", ":", 2)
    return (
        lines.select(F.trim(parts[0]).cast("long").alias("node"), F.explode(F.split(F.trim(parts[1]), r"\s+")).alias("d"))
        .where("d <> '' and d <> '-1'")
        .select("node", F.col("d").cast("long").alias("dst"))
    )


def tnet(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``src dst w`` separated by blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(parts[0].cast("long").alias("node"), parts[1].cast("long").alias("dst"), parts[2].cast("double").alias("w"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """The node table of an edge relation."""
    return edges.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def typed_nodes(spark: SparkSession, **kinds: DataFrame) -> DataFrame:
    """nodes(node, type) from a frame of nodes for each declared type."""
    out = None
    for kind, df in kinds.items():
        part = df.select("node", F.lit(kind).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def threads(spark: SparkSession, n: int | None = None) -> DataFrame:
    """The thread table: 0 .. n - 1 (default: the session's parallelism)."""
    return spark.range(n or spark.sparkContext.defaultParallelism).select(F.col("id").cast("int").alias("thread"))


def world(nodes: DataFrame) -> int:
    """Number of nodes."""
    return nodes.count()
