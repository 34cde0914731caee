"""Iterative numerics: synchronous rounds with vector expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..operators.aggregates import sum_lists
from ..plans.fixpoint import iterate, until
from ..plans.storage import Steps


def heat_transfer(heat: DataFrame, edges: DataFrame, fixed: DataFrame, rounds: int, digits: int = 9) -> DataFrame:
    """(node, t): inner nodes take the weighted mean of their neighbours, ``fixed`` nodes keep theirs."""
    links = edges.select(F.col("dst").alias("node"), F.col("node").alias("src"), F.col("w").cast("double").alias("w"))
    links = Steps(edges.sparkSession, "links").put(links.repartition("src"))
    kind = "decimal(38,12)"

    def step(state: DataFrame, _: int) -> DataFrame:
        near = links.join(state.select(F.col("node").alias("src"), F.col("t").alias("ts")), "src")
        mean = near.groupBy("node").agg((F.sum((F.col("ts") * F.col("w")).cast(kind)).cast("double") / F.sum(F.col("w").cast(kind)).cast("double")).alias("m"))
        out = state.join(mean, "node", "left").join(fixed.select("node", F.lit(True).alias("keep")), "node", "left")
        return out.select("node", F.when(F.col("keep") | F.col("m").isNull(), F.col("t")).otherwise(F.round("m", digits)).alias("t"))

    return iterate(heat, step, rounds)


def heat_until(heat: DataFrame, edges: DataFrame, fixed: DataFrame, epsilon: float) -> DataFrame:
    def done(a: DataFrame, b: DataFrame) -> bool:
        moved = a.join(b.withColumnRenamed("t", "t2"), "node").agg(F.max(F.abs(F.col("t") - F.col("t2")))).first()[0]
        return moved is None or moved <= epsilon

    return until(heat, lambda s, k: heat_transfer(s, edges, fixed, 1), done)


def belief_propagation(potential: DataFrame, edges: DataFrame, table: list[float], rounds: int, damping: float = 0.0) -> DataFrame:
    """(node, belief): loopy belief propagation in log space.

    ``potential`` (node, p array<double>), ``edges`` (node, dst) both ways, ``table`` the row-major
    compatibility of neighbouring values.  Messages start at zero and are normalised.
    """
    size = int(len(table) ** 0.5)
    zero, matrix = F.array(*[F.lit(0.0)] * size), F.array(*[F.lit(float(x)) for x in table])
    steps = Steps(potential.sparkSession, "bp")
    edges = steps.put(edges.select("node", "dst"))

    def beliefs(messages: DataFrame) -> DataFrame:
        inbox = sum_lists(messages.select(F.col("dst").alias("node"), "m"), ["node"], "m")
        return potential.join(inbox, "node", "left").select("node", B.normalize(B.addfloatlists(F.col("p"), F.coalesce("m", zero))).alias("belief"))

    def step(messages: DataFrame, _: int) -> DataFrame:
        back = messages.select(F.col("dst").alias("node"), F.col("node").alias("dst"), F.col("m").alias("rm"))
        base = edges.join(beliefs(messages), "node").join(back, ["node", "dst"], "left")
        cavity = B.divide(F.col("belief"), F.coalesce("rm", zero))
        out = base.select("node", "dst", cavity.alias("c")).select("node", "dst", B.convolve(matrix, F.col("c")).alias("m"))
        out = out.select("node", "dst", B.normalize(F.col("m")).alias("m"))
        if damping:
            old = messages.select("node", "dst", F.col("m").alias("o"))
            out = out.join(old, ["node", "dst"]).select("node", "dst", B.damp(F.col("m"), F.col("o"), damping).alias("m"))
        return out

    return beliefs(iterate(edges.select("node", "dst", zero.alias("m")), step, rounds))


def neural_forward(weights: DataFrame, inputs: DataFrame, layers: int) -> DataFrame:
    """(node, layer, v): sigmoid of weighted sums, layer by layer; ``weights`` (layer, node, dst, w)."""
    state = inputs.select("node", F.lit(0).alias("layer"), F.col("v").cast("double").alias("v"))
    out = state
    for k in range(layers):
        sums = weights.where(F.col("layer") == k).join(state.select("node", "v"), "node").groupBy(F.col("dst").alias("node")).agg(F.sum((F.col("v") * F.col("w")).cast("decimal(38,12)")).cast("double").alias("z"))
        state = sums.select("node", F.lit(k + 1).alias("layer"), F.round(B.sigmoid(F.col("z")), 9).alias("v"))
        out = out.unionByName(state)
    return out
