"""Rule programs: each feature of the rule language in a program of its own, with an SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import builtins as B
from ..operators import aggregates as A
from ..plans.rules import Atom, Head, Program
from .base import SUCCESSION, Tables, query, succession


def clicks(e, kind):
    return e.where(F.col("event_type") == kind).select("user_id", "event_id")


@query("""select user_id as node, count(*) as n, (select count(*) from events s where s.user_id = e.user_id and s.event_type = 'signup') as kept
from events e where event_type = 'click' and user_id in (select user_id from events where event_type = 'signup') group by 1""")
def program_kept_facts(spark, d):
    """$signup(A, X), click(A, Y) -o seen(A, Y): clicks are used up, signups stay for every one of them."""
    e = Tables(spark, d).events
    p = Program(spark).linear("signup", "node long, x long").linear("click", "node long, y long").linear("seen", "node long, y long")
    p.rule([Atom("signup", ("A", "X"), keep=True), Atom("click", ("A", "Y"))], [Head("seen", ("A", "Y"))])
    out = p.run({"signup": clicks(e, "signup"), "click": clicks(e, "click")})
    kept = out["signup"].groupBy("node").agg(F.count("*").alias("kept"))
    return out["seen"].groupBy("node").agg(F.count("*").alias("n")).join(kept, "node")


MINIMA = "select node, x, rn from (select {0} as node, {1} as x, row_number() over (partition by {0} order by {2}) as rn from events where event_type = 'click') t"


@query(f"select node, x, rn = 1 as used from ({MINIMA.format('user_id', 'event_id', 'event_id')}) t")
def program_min_selector(spark, d):
    """go(A), [min X | click(A, X)] -o first(A, X): each node's token takes its smallest click, the others stay."""
    e = Tables(spark, d).events
    p = Program(spark).linear("go", "node long").linear("click", "node long, x long").linear("first", "node long, x long")
    p.rule([Atom("go", ("A",)), Atom("click", ("A", "X"))], [Head("first", ("A", "X"))], select=("min", ("X",)))
    out = p.run({"go": e.select("user_id").distinct(), "click": clicks(e, "click")})
    return out["first"].withColumn("used", F.lit(True)).unionByName(out["click"].withColumn("used", F.lit(False)))


@query(f"select node, x from ({MINIMA.format('user_id', 'event_id', chr(109) + 'd5(' + chr(39) + '0|' + chr(39) + ' || user_id || ' + chr(39) + '|' + chr(39) + ' || event_id), user_id, event_id')}) t where rn = 1")
def program_random_selector(spark, d):
    """go(A), [random | click(A, X)] -o drawn(A, X), drawn by a hash."""
    e = Tables(spark, d).events
    p = Program(spark).linear("go", "node long").linear("click", "node long, x long").linear("drawn", "node long, x long")
    p.rule([Atom("go", ("A",)), Atom("click", ("A", "X"))], [Head("drawn", ("A", "X"))], select=("random", ("X",)))
    return p.run({"go": e.select("user_id").distinct(), "click": clicks(e, "click")})["drawn"]


@query(f"select dst as node, count(*) as n from ({SUCCESSION}) e group by 1")
def program_comprehension(spark, d):
    """token(A) -o {B | !edge(A, B) | got(B, A)}: one firing derives a fact along every edge."""
    t = Tables(spark, d)
    p = Program(spark).persistent("edge", "node long, dst long").linear("token", "node long").linear("got", "node long, from long")
    p.rule([Atom("token", ("A",))], [Head("got", ("B", "A"), over=(Atom("edge", ("A", "B")),))])
    out = p.run({"edge": succession(t).select("node", "dst"), "token": t.part.select("p_partkey")})
    return out["got"].groupBy("node").agg(F.count("*").alias("n"))


@query("select o_custkey as node, count(*) as n, sum(o_orderkey)::bigint as total, list(o_orderkey order by o_orderkey desc) as orders from orders group by 1")
def program_head_aggregates(spark, d):
    """[count, sum X, collect X | placed(A, X)] -o summary(A, ..): several aggregates use the facts up together."""
    o = Tables(spark, d).orders.select("o_custkey", "o_orderkey")
    p = Program(spark).linear("placed", "node long, x long").linear("summary", "node long, n long, total long, orders array<long>")
    aggs = (("N", F.count("*")), ("T", F.sum("X")), ("L", A.collect_desc("X")))
    p.rule([Atom("placed", ("A", "X"))], [Head("summary", ("A", "N", "T", "L"))], aggregates=aggs, group=("A",))
    return p.run({"placed": o})["summary"]


@query("select o_custkey as node, sum(o_orderkey)::bigint as total from orders group by 1 union all select o_custkey, 2 * sum(o_orderkey)::bigint from orders where o_custkey % 2 = 0 group by 1")
def program_rederived_aggregate(spark, d):
    """An aggregate's result is a fact of its own relation again: even customers' sums are doubled by a second rule."""
    o = Tables(spark, d).orders.select("o_custkey", "o_orderkey")
    p = Program(spark).linear("placed", "node long, x long").linear("total", "node long, x long").persistent("known", "node long, x long")
    p.rule([Atom("placed", ("A", "X"))], [Head("total", ("A", "T"))], aggregates=(("T", F.sum("X")),), group=("A",))
    p.rule([Atom("total", ("A", "X"))], [Head("known", ("A", "X")), Head("known", ("A", F.col("X") * 2), when=F.col("A") % 2 == 0)])
    return p.run({"placed": o})["known"].select("node", F.col("x").alias("total"))


@query("select o_orderkey as node, case when o_totalprice > 100000 then 'big' else 'small' end as kind from orders")
def program_conditional_heads(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    p = Program(spark).linear("paid", "node long, x double").linear("kind", "node long, kind string")
    big = F.col("X") > 100000
    p.rule([Atom("paid", ("A", "X"))], [Head("kind", ("A", F.lit("big")), when=big), Head("kind", ("A", F.lit("small")), when=~big)])
    return p.run({"paid": o})["kind"]


@query("select c_custkey as node, 1 as step from customer")
def program_stop(spark, d):
    """The second rule would go on from step to step; a fact of ``done`` stops the program after the first."""
    c = Tables(spark, d).customer.select("c_custkey", F.lit(0).alias("s"))
    p = Program(spark).linear("at", "node long, step int").persistent("done", "node long")
    p.rule([Atom("at", ("A", "S"))], [Head("at", ("A", F.col("S") + 1)), Head("done", ("A",))])
    p.stop_on = "done"
    return p.run({"at": c})["at"]


@query("select c_nationkey::bigint as node, c_custkey as x from customer where c_nationkey = (select max(c_nationkey) from customer where c_nationkey % 7 <> 3)")
def program_priorities(spark, d):
    """wait(A, X) -o ran(A, X), stopped after its first run: the nation of the highest priority has run, and nothing else.

    A rule that goes before it gives some nations the lowest priority.
    """
    c = Tables(spark, d).customer.select(F.col("c_nationkey").cast("long").alias("node"), "c_custkey")
    p = Program(spark).coordinate().linear("wait", "node long, x long").linear("demote", "node long").persistent("ran", "node long, x long")
    p.rule([Atom("wait", ("A", "X"))], [Head("ran", ("A", "X"))])
    p.rule([Atom("demote", ("A",))], [Head("set-priority", ("A", -1.0))], priority=1)
    p.stop_on = "ran"
    nations = c.select("node").distinct()
    facts = {"wait": c, "demote": nations.where("node % 7 = 3"), "set-priority": nations.select("node", F.col("node").cast("double").alias("value"))}
    return p.run(facts)["ran"]


@query("select thread, n::bigint as n, 2 - least(n, 2)::bigint as left_over from (select o_orderkey % 4 as thread, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) t")
def program_thread_tokens(spark, d):
    """Thread-local linear facts: each thread has two tokens, and urgent orders of a thread use them up, sent on by the leader."""
    o = Tables(spark, d).orders.where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") % 4).cast("int").alias("thread"), "o_orderkey")
    p = Program(spark)
    facts = p.thread_facts(4)
    p.linear("start", "thread int").linear("token", "thread int, k int").linear("urgent", "thread int, x long").persistent("served", "thread int, x long")
    p.rule([Atom("start", ("T",)), Atom("leader-thread", ("T",))], [Head("token", ("T", 0)), Head("token", ("T", 1)), Head("token", ("O", 0), over=(Atom("other-thread", ("T", "O")),)), Head("token", ("O", 1), over=(Atom("other-thread", ("T", "O")),))])
    p.rule([Atom("token", ("T", "K")), Atom("urgent", ("T", "X"))], [Head("served", ("T", "X"))])
    out = p.run(facts | {"start": p.frame("start", [(0,)]), "urgent": o})
    left = out["token"].groupBy("thread").agg(F.count("*").alias("left_over"))
    return o.groupBy("thread").agg(F.count("*").alias("n")).join(left, "thread", "left").select("thread", "n", F.coalesce("left_over", F.lit(0)).alias("left_over"))


@query("""select s_suppkey as node, (s_suppkey - (select min(s_suppkey) from supplier)) // (((select max(s_suppkey) - min(s_suppkey) + 1 from supplier) + 3) // 4) as start_cpu,
  case when s_nationkey % 2 = 0 then 3 else (s_suppkey - (select min(s_suppkey) from supplier)) // (((select max(s_suppkey) - min(s_suppkey) + 1 from supplier) + 3) // 4) end as cpu, s_nationkey % 3 = 0 as static from supplier""")
def program_placement(spark, d):
    """Suppliers of even nations move to cpu 3, those of every third nation are pinned."""
    s = Tables(spark, d).supplier.select("s_suppkey", "s_nationkey")
    p = Program(spark).coordinate(cpus=4).linear("home", "node long, nation int").persistent("origin", "node long, cpu int")
    even, third = F.col("N") % 2 == 0, F.col("N") % 3 == 0
    p.rule([Atom("home", ("A", "N")), Atom("placement", ("A", "C"))], [Head("origin", ("A", "C")), Head("set-cpu", ("A", 3), when=even), Head("set-static", ("A",), when=third)])
    out = p.run({"home": s})
    return out["origin"].select("node", F.col("cpu").cast("long").alias("start_cpu")).join(out["nodes"].select("node", F.col("cpu").cast("long").alias("cpu"), "static"), "node")


@query("""select p_partkey as node, p_size::varchar || '.5' as s, p_partkey::int as n, [0.5, 1.5] as demerged, round(exp(-ln(1 + exp(p_size - 50.0))), 9) as norm,
  round(ln(0.25 * exp(p_size / 50.0) + 0.75), 9) as damped, round(abs(exp(p_size / 50.0) - 1) + abs(1 - exp(1.0)), 9) as rest, round(ln(exp(0.5 + p_size / 50.0) + exp(1.0)), 9) as conv from part""")
def builtin_conversions(spark, d):
    x = F.col("p_size") / 50.0
    two = lambda a, b: F.struct(F.lit(a).cast("double").alias("_1") if not hasattr(a, "alias") else a.alias("_1"), F.lit(b).cast("double").alias("_2") if not hasattr(b, "alias") else b.alias("_2"))
    matrix = F.struct(*[F.lit(v).alias(f"_{i + 1}") for i, v in enumerate((0.5, 1.0, 0.0, 0.0))])
    return Tables(spark, d).part.select(
        F.col("p_partkey").alias("node"),
        B.float2str(F.col("p_size") + F.lit(0.5).cast("double")).alias("s"),
        B.node2int(F.col("p_partkey")).alias("n"),
        B.demergemessages(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(0.5))).alias("demerged"),
        F.round(F.exp(B.normalizestruct(two(F.lit(50.0), F.col("p_size").cast("double")), 2)["_1"]), 9).alias("norm"),
        F.round(B.dampstruct(two(0, 0), two(x, 0), 0.25, 2)["_1"], 9).alias("damped"),
        F.round(B.residualstruct(two(x, 0), two(0, 1), 2), 9).alias("rest"),
        F.round(B.convolvestruct(matrix, two(x, 0), 2)["_1"], 9).alias("conv"),
    )


@query("""select cpu, (count(*) filter (p_size % 2 = 0))::int as pinned, (count(*) filter (p_size % 2 = 1))::int as moving, max(p_size / 10.0) as top, count(*)::int as proved, count(*)::int as consumed
from (select *, p_size % 5 as cpu from part) t group by 1""")
def builtin_placement(spark, d):
    """Pinned and moving nodes, priorities and counters over a table of nodes."""
    nodes = Tables(spark, d).part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 5).alias("cpu"), (F.col("p_size") % 2 == 0).alias("static"), (F.col("p_size") / 10.0).cast("double").alias("priority"))
    pinned = B.cpu_static(nodes).withColumnRenamed("cpu_static", "pinned")
    rest = nodes.groupBy("cpu").agg(F.sum(B.is_moving().cast("int")).cast("int").alias("moving"), F.max(B.priority()).alias("top"))
    proved, consumed = B.facts_proved(nodes, "cpu").withColumnRenamed("facts_proved", "proved"), B.facts_consumed(nodes, "cpu").withColumnRenamed("facts_consumed", "consumed")
    return pinned.join(rest, "cpu").join(proved, "cpu").join(consumed, "cpu")
