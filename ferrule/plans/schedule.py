"""Coordination facts: node priorities and placement, as one table of nodes.

A node has a priority (null: the default), a default of its own, whether it stays where it
is, and its cpu.  Rules of a ``Program`` change them by heads on the reserved predicates of
``EDITS``; a run of a rule that uses facts up then takes the matches at the best nodes only.
That changes the order of work, so only the results of programs that depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reserved predicates and their fields (fixed names of the language).
EDITS = {
    "set-priority": "node long, value double",
    "add-priority": "node long, value double",
    "remove-priority": "node long",
    "set-default-priority": "node long, value double",
    "schedule-next": "node long",
    "set-static": "node long",
    "set-moving": "node long",
    "set-cpu": "node long, value int",
    "set-affinity": "node long, value long",
}
SCHEMA = "node long, priority double, base double, static boolean, cpu int"


@dataclass(frozen=True)
class Order:
    """``asc``: the smallest priority goes first.  ``initial`` is the priority of nodes that none was given."""

    asc: bool = False
    initial: float = 0.0
    cpus: int = 1

    @property
    def first(self) -> float:
        return float("-inf") if self.asc else float("inf")


def current(nodes: DataFrame, order: Order) -> DataFrame:
    """(node, priority) with defaults filled in."""
    return nodes.select("node", F.coalesce("priority", "base", F.lit(order.initial)).alias("priority"))


def place(nodes: DataFrame, cpus: int) -> DataFrame:
    """Nodes in contiguous ranges over so many cpus, as the engine starts."""
    low, high = nodes.agg(F.min("node"), F.max("node")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // cpus))
    return nodes.select(
        "node", F.lit(None).cast("double").alias("priority"), F.lit(None).cast("double").alias("base"), F.lit(False).alias("static"),
        F.floor((F.col("node") - F.lit(low or 0)) / width).cast("int").alias("cpu"),
    )


def edit(nodes: DataFrame, kind: str, edits: DataFrame, order: Order) -> DataFrame:
    """The table of nodes after the edits of one kind; of several for one node the largest counts, added ones add up."""
    value = F.max("value") if kind != "add-priority" else F.sum("value")
    has = "value" in edits.columns
    one = edits.groupBy("node").agg((value if has else F.lit(True)).alias("__v")).withColumn("__hit", F.lit(True))
    if kind == "set-affinity":  # to the cpu of the other node
        one = one.join(nodes.select(F.col("node").alias("__v"), F.col("cpu").alias("__c")), "__v").select("node", F.col("__c").alias("__v"), "__hit")
    now = F.coalesce("priority", "base", F.lit(order.initial))
    new = {
        "set-priority": ("priority", F.col("__v")),
        "add-priority": ("priority", now + F.col("__v")),
        "remove-priority": ("priority", F.lit(None).cast("double")),
        "set-default-priority": ("base", F.col("__v")),
        "schedule-next": ("priority", F.lit(order.first)),
        "set-static": ("static", F.lit(True)),
        "set-moving": ("static", F.lit(False)),
        "set-cpu": ("cpu", F.col("__v")),
        "set-affinity": ("cpu", F.col("__v")),
    }
    column, to = new[kind]
    return nodes.join(one, "node", "left").select(*[F.when(F.col("__hit"), to).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in nodes.columns])


def just_moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node) of those whose cpu changed."""
    was = before.select("node", F.col("cpu").alias("was"))
    return after.join(was, "node").where(~F.col("cpu").eqNullSafe(F.col("was"))).select("node")
