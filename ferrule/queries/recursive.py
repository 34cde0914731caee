"""Recursion, iterative numerics and coordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..algorithms import graphs as G
from ..algorithms import numeric as N
from ..algorithms import search as Q
from ..operators.aggregates import number_from
from ..plans.fixpoint import retract
from ..plans.rules import Atom, Head, Program
from .base import SUCCESSION, TRADE, Tables, first_part, query, rounds, succession, trade

START = "select min(p_partkey) as node, 0::bigint as d from part"
RELAX = "select node, min(d) as d from (select * from {prev} union all select e.dst, r.d + e.w from {prev} r join e on e.node = r.node) t group by 1"
EDGES = f"e as materialized ({SUCCESSION})"
SSSP = rounds(START, RELAX, 40, "select node, d::bigint as d from {prev}", EDGES)


@query(SSSP)
def sssp_min(spark, d):
    """Least cost from the first part over the part succession graph."""
    t = Tables(spark, d)
    return G.shortest_paths(succession(t), first_part(t))


@query(SSSP)
def priority_bucket_sssp(spark, d):
    """The same with the cheapest band of nodes handled first."""
    t = Tables(spark, d)
    return G.shortest_paths(succession(t), first_part(t), bucket=25)


@query(rounds(START, RELAX, 4, "select node, d::bigint as d from {prev}", EDGES))
def bounded_hops(spark, d):
    t = Tables(spark, d)
    return G.bounded_hops(succession(t), first_part(t), 4)


@query(f"with recursive {EDGES}, r as (select min(p_partkey) as node from part union select e.dst from r join e on e.node = r.node) select node from r")
def reachability(spark, d):
    t = Tables(spark, d)
    return G.reachable(succession(t), first_part(t))


@query(rounds("select node as src, dst as node, w::bigint as d from e", "select src, node, min(d) as d from (select * from {prev} union all select r.src, e.dst, r.d + e.w from {prev} r join e on e.node = r.node) t group by 1, 2", 25, "select src, node, d::bigint as d from {prev}", f"e as materialized ({TRADE})"))
def all_pairs_min(spark, d):
    return G.all_pairs(trade(Tables(spark, d)))


@query(rounds("select node as src, dst as node, w::bigint as d from e", "select src, node, min(d) as d from (select * from {prev} union all select r.src, e.dst, r.d + e.w from {prev} r join e on e.node = r.node) t group by 1, 2", 25, "select node, d::bigint as d from {prev} where src = node", f"e as materialized ({TRADE})"))
def shortest_cycle(spark, d):
    return G.shortest_cycle(trade(Tables(spark, d)))


@query(f"with recursive e as materialized ({TRADE}), r as (select node, dst from e union select r.node, e.dst from r join e on e.node = r.dst) select node, dst from r")
def transitive_closure(spark, d):
    return G.transitive_closure(trade(Tables(spark, d)))


@query(f"""with recursive e as materialized ({TRADE}), r as (select node, dst from e union select r.node, e.dst from r join e on e.node = r.dst)
select node, dst, sum(cnt)::bigint as cnt from (select node, dst, 1 as cnt from e union all select r.node, e.dst, 1 from r join e on e.node = r.dst) t group by 1, 2""")
def connectivity_counts(spark, d):
    """Every derivation counts: each path fact extends along each edge once."""
    return G.connectivity_counts(trade(Tables(spark, d)))


UNDIRECTED = f"u as materialized (select node, dst from ({SUCCESSION}) a union select dst, node from ({SUCCESSION}) b)"


@query(rounds("select distinct node, node as label from u", "select node, min(label) as label from (select * from {prev} union all select u.dst, r.label from {prev} r join u on u.node = r.node) t group by 1", 30, "select node, label from {prev}", UNDIRECTED))
def connected_components(spark, d):
    return G.components(succession(Tables(spark, d)))


RANK = """select n.node, round(0.15 / c.n + 0.85 * coalesce(cast(s.i as double), 0), 12) as rank from n cross join c left join
(select l.dst as node, sum(cast(r.rank / l.deg as decimal(38, 16))) as i from l join {prev} r on r.node = l.node group by 1) s on s.node = n.node"""


@query(rounds("select node, round(1.0::double / c.n, 12) as rank from n cross join c", RANK, 5, "select node, round(rank, 9) as rank from {prev}",
              f"e as materialized ({SUCCESSION}), n as materialized (select node from e union select dst from e), c as (select count(*) as n from n), l as materialized (select node, dst, count(*) over (partition by node) as deg from e)"))
def pagerank_sync_k(spark, d):
    return G.pagerank(succession(Tables(spark, d)), 5).select("node", F.round("rank", 9).alias("rank"))


HEAT = """select p.node, case when f.node is not null or m.m is null then p.t else round(m.m, 9) end as t from {prev} p left join f using (node) left join
(select e.dst as node, sum(cast(r.t * e.w as decimal(38, 12)))::double / sum(e.w)::double as m from e join {prev} r on r.node = e.node group by 1) m using (node)"""


@query(rounds("select p_partkey as node, p_size::double as t from part", HEAT, 5, "select node, round(t, 6) as t from {prev}", f"{EDGES}, f as (select p_partkey as node from part where p_size >= 45)"))
def heat_transfer_k(spark, d):
    """Parts of size 45 or more keep their heat; the others take the weighted mean of their predecessors."""
    t = Tables(spark, d)
    heat = t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("t"))
    fixed = t.part.where("p_size >= 45").select(F.col("p_partkey").alias("node"))
    return N.heat_transfer(heat, succession(t), fixed, 5).select("node", F.round("t", 6).alias("t"))


@query("""with i as (select p_partkey as node, p_size / 50.0::double as v from part),
h as (select s_suppkey as node, round(1 / (1 + exp(-sum(cast(v * (l_discount - 0.05) as decimal(38, 12)))::double)), 9) as v from lineitem join i on l_partkey = node join supplier on l_suppkey = s_suppkey group by 1),
o as (select s_nationkey::bigint as node, round(1 / (1 + exp(-sum(cast(v * (s_acctbal / 10000) as decimal(38, 12)))::double)), 9) as v from supplier join h on s_suppkey = node group by 1)
select node, 1 as layer, round(v, 6) as v from h union all select node, 2, round(v, 6) from o""")
def neural_forward_pass(spark, d):
    """Parts feed suppliers, suppliers feed nations, through sigmoids."""
    t = Tables(spark, d)
    first = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").select(F.lit(0).alias("layer"), F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("dst"), (F.col("l_discount") - 0.05).alias("w"))
    second = t.supplier.select(F.lit(1).alias("layer"), F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("dst"), (F.col("s_acctbal") / 10000).alias("w"))
    inputs = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50.0).alias("v"))
    return N.neural_forward(first.unionByName(second), inputs, 2).where("layer > 0").select("node", "layer", F.round("v", 6).alias("v"))


@query()
def label_coloring_greedy(spark, d):
    """Greedy coloring in node order of the nation trade graph; checked as a valid coloring in the tests."""
    return G.greedy_coloring(trade(Tables(spark, d)))


@query()
def belief_propagation_k(spark, d):
    """Three rounds over the nation trade graph; held against plain Python in the tests."""
    t = Tables(spark, d)
    potential = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.array(F.col("n_regionkey") * 0.1, F.lit(0.0)).alias("p"))
    e = trade(t)
    both = e.select("node", "dst").unionByName(e.select(F.col("dst").alias("node"), F.col("node").alias("dst"))).distinct()
    out = N.belief_propagation(potential, both, [0.3, 0.0, 0.0, 0.3], 3, damping=0.1)
    return out.select("node", F.transform("belief", lambda x: F.round(x, 6)).alias("belief"))


@query(f"with recursive e as materialized (select node, dst from ({TRADE}) t where w > 20), r as (select node, dst from e union select r.node, e.dst from r join e on e.node = r.dst) select node, dst from r")
def retraction_recompute(spark, d):
    """Reachability after the light edges are taken away, cyclic support included."""
    e = trade(Tables(spark, d))
    return retract(e.select("node", "dst"), e.where("w <= 20").select("node", "dst"), G.transitive_closure)


@query("select 92::bigint as boards, 8 as n")
def queens_eight(spark, d):
    return Q.queens(spark, 8).agg(F.count("*").alias("boards")).select("boards", F.lit(8).alias("n"))


@query("select unnest([0, 1, 2, 3, 4, 5, 6, 7, 8])::int as move, 0::int as score")
def minimax_open_board(spark, d):
    """Every first move on the empty 3 x 3 board draws."""
    return Q.minimax(spark, [0] * 9)


@query(f"with recursive {EDGES}, r as (select min(p_partkey) as node from part union select e.dst from r join e on e.node = r.node where e.w > 45) select node from r")
def rule_program_visit(spark, d):
    """A program of two persistent rules: visits spread along heavy edges until nothing is new."""
    t = Tables(spark, d)
    p = Program(spark).persistent("edge", "node long, dst long").persistent("visited", "node long").persistent("seed", "node long")
    p.rule([Atom("seed", ("A",))], [Head("visited", ("A",))])
    p.rule([Atom("visited", ("A",)), Atom("edge", ("A", "B"))], [Head("visited", ("B",))])
    facts = {"edge": succession(t).where("w > 45").select("node", "dst"), "seed": first_part(t)}
    return p.run(facts)["visited"]


@query("""select user_id as node, least(count(*) filter (event_type = 'click'), count(*) filter (event_type = 'purchase')) as paid,
count(*) filter (event_type = 'click') - least(count(*) filter (event_type = 'click'), count(*) filter (event_type = 'purchase')) as unpaid from events group by 1""")
def rule_program_consume(spark, d):
    """click(A, X), purchase(A, Y) -o paid(A): one rule that uses up both facts."""
    e = Tables(spark, d).events
    p = Program(spark).linear("click", "node long, x long").linear("purchase", "node long, y long").linear("paid", "node long")
    p.rule([Atom("click", ("A", "X")), Atom("purchase", ("A", "Y"))], [Head("paid", ("A",))])
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "event_id")
    out = p.run({"click": side("click"), "purchase": side("purchase")})
    users = e.select(F.col("user_id").alias("node")).distinct()
    paid = out["paid"].groupBy("node").agg(F.count("*").alias("paid"))
    rest = out["click"].groupBy("node").agg(F.count("*").alias("unpaid"))
    return users.join(paid, "node", "left").join(rest, "node", "left").select("node", F.coalesce("paid", F.lit(0)).alias("paid"), F.coalesce("unpaid", F.lit(0)).alias("unpaid"))


@query("select c_custkey as consumer, true as within from customer")
def power_grid_served(spark, d):
    """All consumers find a generator, and no generator bears more than it has room for."""
    t = Tables(spark, d)
    total = t.customer.count() * 100
    n = max(1, t.supplier.count())
    generators = t.supplier.select(F.col("s_suppkey").alias("generator"), F.lit(total // n * 3 + 100).alias("total"))
    demands = t.customer.select(F.col("c_custkey").alias("consumer"), (F.col("c_custkey") % 100 + 1).alias("power"))
    placed = Q.share_power(generators, demands)
    loads = placed.join(demands, "consumer").groupBy("generator").agg(F.sum("power").alias("load"))
    borne = loads.join(generators, "generator").select("generator", (F.col("load") <= F.col("total")).alias("within"))
    return placed.join(borne, "generator").select("consumer", "within")


@query("select o_orderkey as key, o_totalprice as value from orders")
def tree_lookup(spark, d):
    """Keys looked up by walking a balanced tree over the order keys: as many nodes as there are keys, however far apart."""
    stored = Tables(spark, d).orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    facts = stored.where("key is not null").groupBy("key").agg(F.collect_list(F.struct("value")).alias("value"))
    numbered = number_from(facts, 1, ["key"])
    n = numbered.count()
    if n == 0:
        return stored
    # in key order, node i has all nodes nearer to it than its lowest bit below it; the right side may be cut short by n
    half = F.expr("(id & -id) div 2")
    right = F.col("id") + F.least(half, F.expr(f"shiftleft(1L, length(bin({n}L - id)) - 1)"))
    tree = numbered.select(
        F.col("id").alias("node"), "key", "value", F.when(half > 0, F.col("id") - half).alias("left"), F.when((half > 0) & (F.col("id") < n), right).alias("right"),
    )
    got = Q.tree_lookups(tree, 1 << (n.bit_length() - 1), facts.select("key")).select("key", F.inline("value"))
    return got.unionByName(stored.where("key is null"))  # no walk ends at a missing key
