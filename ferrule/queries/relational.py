"""Scans, patterns, joins, consumption, aggregates, selectors and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import aggregates as A
from ..operators import match as M
from ..plans import relation as R
from ..plans.rules import Atom, Head, Program
from ..sources import graphs as S
from ..sources import sinks
from .base import SUCCESSION, Tables, query, succession


@query("select l_orderkey as node, l_partkey, l_quantity * l_extendedprice as v from lineitem where l_quantity > 30 and l_returnflag = 'R'")
def scan_filter_project(spark, d):
    t = Tables(spark, d).lineitem
    return t.where("l_quantity > 30 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("node"), "l_partkey", (F.col("l_quantity") * F.col("l_extendedprice")).alias("v"))


@query("select o_orderkey as node, o_orderpriority from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def match_constant(spark, d):
    return Tables(spark, d).orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select(F.col("o_orderkey").alias("node"), "o_orderpriority")


@query("select l_orderkey as node from lineitem where l_partkey = l_suppkey")
def match_bound_variable(spark, d):
    return Tables(spark, d).lineitem.where("l_partkey = l_suppkey").select(F.col("l_orderkey").alias("node"))


@query("""select node, xs[1] as head, len(xs) - 1 as rest, case when len(xs) >= 2 then xs[2] end as second
from (select l_orderkey as node, list_sort(list(l_partkey)) as xs from lineitem group by 1) t""")
def list_pattern_match(spark, d):
    xs = F.col("xs")
    lists = Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(F.sort_array(F.collect_list("l_partkey")).alias("xs"))
    return lists.where(P.is_cons(xs)).select("node", P.head(xs).alias("head"), F.size(P.tail(xs)).cast("long").alias("rest"), F.when(P.at_least(xs, 2), P.head(P.tail(xs))).alias("second"))


@query("""select 'big' as kind, o_orderkey as node from orders where o_totalprice > 100000
union all select 'small', o_orderkey from orders where not o_totalprice > 100000""")
def conditional_head(spark, d):
    big, small = M.split_by(Tables(spark, d).orders, F.col("o_totalprice") > 100000)
    return big.select(F.lit("big").alias("kind"), F.col("o_orderkey").alias("node")).unionByName(small.select(F.lit("small").alias("kind"), F.col("o_orderkey").alias("node")))


@query("select p_partkey as node, p_size + 1 as y, (p_size + 1) * 2 as z, case when p_size > 25 then 'large' else 'small' end as kind from part")
def let_expr(spark, d):
    t = Tables(spark, d).part.withColumn("y", F.col("p_size") + 1)
    return t.select(F.col("p_partkey").alias("node"), "y", (F.col("y") * 2).alias("z"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"))


@query("select p_partkey as node from part where (p_size > 40 or p_retailprice < 950) and not p_brand in ('Brand#11', 'Brand#12')")
def boolean_logic(spark, d):
    return Tables(spark, d).part.where(((F.col("p_size") > 40) | (F.col("p_retailprice") < 950)) & ~F.col("p_brand").isin("Brand#11", "Brand#12")).select(F.col("p_partkey").alias("node"))


@query("select c_nationkey as node, c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey")
def node_local_join(spark, d):
    t = Tables(spark, d)
    return M.all_pairs(t.customer.select(F.col("c_nationkey").alias("node"), "c_custkey"), t.supplier.select(F.col("s_nationkey").alias("node"), "s_suppkey"), ["node"])


@query("select c_nationkey as node, c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and s_acctbal < c_acctbal")
def theta_join(spark, d):
    t = Tables(spark, d)
    c = t.customer.select(F.col("c_nationkey").alias("node"), "c_custkey", "c_acctbal")
    s = t.supplier.select(F.col("s_nationkey").alias("node"), "s_acctbal", "s_suppkey")
    return M.all_pairs(c, s, ["node"], F.col("s_acctbal") < F.col("c_acctbal")).select("node", "c_custkey", "s_suppkey")


@query("select c_custkey as node from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def semi_join(spark, d):
    t = Tables(spark, d)
    wanted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(wanted, "c_custkey", "left_semi").select(F.col("c_custkey").alias("node"))


@query("select c_custkey as node from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def rule_order_fallback(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("node"))


@query("""select node, event_id, event_id_2 from (
  select user_id as node, event_id, lead(event_id) over w as event_id_2, row_number() over w as rn
  from events window w as (partition by user_id order by event_id)) t where rn % 2 = 1 and event_id_2 is not null""")
def self_join_no_reuse(spark, d):
    return M.pair_within(Tables(spark, d).events.select(F.col("user_id").alias("node"), "event_id"), ["node"], ["event_id"])


@query("""select o_orderkey as node, l_partkey from (select o_orderkey, l_partkey, row_number() over (partition by o_orderkey order by l_partkey, l_suppkey) as rn
  from orders join lineitem on o_orderkey = l_orderkey) t where rn = 1""")
def first_match_join(spark, d):
    t = Tables(spark, d)
    a, b = t.orders.select(F.col("o_orderkey").alias("node")), t.lineitem.select(F.col("l_orderkey").alias("node"), "l_partkey", "l_suppkey")
    return M.first_match(a, b, ["node"], ["node"], ["l_partkey", "l_suppkey"]).select("node", "l_partkey")


CLICKS = "(select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn from events where event_type = '{}')"


@query(f"select a.user_id as node, a.event_id as click, b.event_id as purchase from {CLICKS.format('click')} a join {CLICKS.format('purchase')} b on a.user_id = b.user_id and a.rn = b.rn")
def linear_consume_pairing(spark, d):
    e = Tables(spark, d).events.select(F.col("user_id").alias("node"), "event_id", "event_type")
    a = e.where("event_type = 'click'").select("node", F.col("event_id").alias("click"))
    b = e.where("event_type = 'purchase'").select("node", F.col("event_id").alias("purchase"))
    return M.pair_by_rank(a, b, ["node"], ["click"], ["purchase"])


@query(f"""select user_id as node, event_id from {CLICKS.format('click')} a where rn > (select count(*) from events b where b.user_id = a.user_id and b.event_type = 'purchase')""")
def linear_consume_rest(spark, d):
    """Click facts that no purchase has used up."""
    e = Tables(spark, d).events.select(F.col("user_id").alias("node"), "event_id", "event_type")
    a = e.where("event_type = 'click'").select("node", F.col("event_id").alias("click"))
    b = e.where("event_type = 'purchase'").select("node", F.col("event_id").alias("purchase"))
    used = M.pair_by_rank(a, b, ["node"], ["click"], ["purchase"]).select("click")
    return a.join(used, "click", "left_anti").select("node", F.col("click").alias("event_id"))


@query("""select c_nationkey as node, c_custkey, (select count(*) from supplier where s_nationkey = c_nationkey) as n
from customer where exists (select 1 from supplier where s_nationkey = c_nationkey)""")
def linear_keep(spark, d):
    """$supply(A, S), asks(A, C) -o met(A, C): customers are used up, suppliers stay for every one of them."""
    t = Tables(spark, d)
    p = Program(spark).linear("supply", "node int, s long").linear("asks", "node int, c_custkey long").linear("met", "node int, c_custkey long")
    p.rule([Atom("supply", ("A", "S"), keep=True), Atom("asks", ("A", "C"))], [Head("met", ("A", "C"))])
    out = p.run({"supply": t.supplier.select("s_nationkey", "s_suppkey"), "asks": t.customer.select("c_nationkey", "c_custkey")})
    return out["met"].join(out["supply"].groupBy("node").agg(F.count("*").alias("n")), "node")


@query("""select c_custkey as node, coalesce(p, c_acctbal) as balance from customer left join
(select o_custkey, o_totalprice as p, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) o on o_custkey = c_custkey and rn = 1""")
def remote_upsert(spark, d):
    t = Tables(spark, d)
    state = t.customer.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("balance"))
    edits = t.orders.select(F.col("o_custkey").alias("node"), F.col("o_totalprice").alias("balance"), "o_orderdate", "o_orderkey")
    return M.remote_upsert(state, edits, ["node"], ["balance"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("select p_partkey as node, p_size + 1 as a, p_retailprice as b from part")
def exchange_update(spark, d):
    """Both facts are used and put back changed at once: a takes the old size plus one."""
    t = Tables(spark, d).part
    a, b = t.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("x")), t.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("y"))
    return M.pair_by_rank(a, b, ["node"], ["x"], ["y"]).select("node", (F.col("x") + 1).alias("a"), F.col("y").alias("b"))


@query("select node, us, event_id from (select user_id as node, epoch_us(ts) as us, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from events) t where rn = 1", name="pred_agg_first")
def pred_agg_first(spark, d):
    e = Tables(spark, d).events.select(F.col("user_id").alias("node"), "ts", "event_id")
    return A.first_of(e, ["node"], ["ts"]).select("node", sinks.epoch_micros(e, "ts").alias("us"), "event_id")


MIN_EDGE = f"select node, w, dst from (select *, row_number() over (partition by node order by w {{0}}, dst) as rn from ({SUCCESSION}) e) t where rn = 1"


@query(MIN_EDGE.format(""))
def pred_agg_min_argmin(spark, d):
    return A.min_of(succession(Tables(spark, d)).select("node", "w", "dst"), ["node"], "w")


@query(MIN_EDGE.format("desc"))
def pred_agg_max(spark, d):
    return A.max_of(succession(Tables(spark, d)).select("node", "w", "dst"), ["node"], "w")


@query("select l_partkey as node, sum(cast(l_quantity as int))::bigint as total from lineitem group by 1")
def pred_agg_sum_counted(spark, d):
    """Sum weighted by derivation counts: equal facts are stored once with their count."""
    facts = R.persistent(Tables(spark, d).lineitem.select(F.col("l_partkey").alias("node"), F.col("l_quantity").cast("int").alias("total")))
    return A.sum_of(facts, ["node"], "total")


@query("""select label, list(s order by pos) as s from (select label, pos, cast(round(sum(cast(x as decimal(20, 6))), 4) as double) as s
  from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) e group by 1, 2) t group by 1""")
def pred_agg_sum_list(spark, d):
    e = Tables(spark, d).embeddings.select("label", F.transform("embedding", lambda x: x.cast("decimal(20,6)")).alias("s"))
    return A.sum_lists(e, ["label"], "s").select("label", F.transform("s", lambda x: F.round(x, 4).cast("double")).alias("s"))


@query("select c_custkey as node, coalesce(sum(cast(o_totalprice * 100 as bigint)), 0)::bigint as cents, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def multi_aggregate(spark, d):
    t = Tables(spark, d)
    nodes = t.customer.select(F.col("c_custkey").alias("node"))
    orders = t.orders.select(F.col("o_custkey").alias("node"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return A.head_aggregate(nodes, orders, ["node"], cents=F.sum("cents"), n=F.count("*"))


@query("select c_custkey as node, coalesce(sum(o_orderkey), 0)::bigint as total from customer left join orders on o_custkey = c_custkey group by 1")
def head_sum(spark, d):
    t = Tables(spark, d)
    return A.head_aggregate(t.customer.select(F.col("c_custkey").alias("node")), t.orders.select(F.col("o_custkey").alias("node"), "o_orderkey"), ["node"], total=F.sum("o_orderkey"))


@query("select l_orderkey as node, min(l_partkey) as least from lineitem group by 1")
def head_min(spark, d):
    return Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(F.min("l_partkey").alias("least"))


@query(f"select p_partkey as node, count(dst) as degree, coalesce(sum(w), 0)::bigint as weight from part left join ({SUCCESSION}) e on node = p_partkey group by 1")
def head_count(spark, d):
    from ..algorithms.graphs import degrees

    t = Tables(spark, d)
    return degrees(t.part.select(F.col("p_partkey").alias("node")), succession(t))


@query("select l_orderkey as node, list(l_partkey order by l_partkey desc) as parts from lineitem group by 1")
def head_collect_desc(spark, d):
    return Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(A.collect_desc("l_partkey").alias("parts"))


@query("""select l_orderkey as node, list_reduce(list_prepend(7::bigint, list(l_partkey order by l_partkey)), lambda a, x: (a * 31 + x) % 1000003) as h from lineitem group by 1""")
def custom_fold(spark, d):
    """A fold that depends on the order, over the ascending list."""
    fold = A.fold(F.collect_list("l_partkey"), F.lit(7).cast("long"), lambda acc, x: (acc * 31 + x) % 1000003)
    return Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(fold.alias("h"))


@query("select l_orderkey as node, count(*) as n from lineitem where l_discount > 0.05 group by 1")
def conditional_aggregate(spark, d):
    return Tables(spark, d).lineitem.where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("node")).agg(F.count("*").alias("n"))


@query(f"select dst as node, p_size from part join ({SUCCESSION}) e on node = p_partkey")
def comprehension_scatter(spark, d):
    t = Tables(spark, d)
    return M.scatter(t.part.select(F.col("p_partkey").alias("node"), "p_size"), succession(t).select("node", "dst"))


@query("select user_id as node, list(event_id order by event_id) as used, count(*) as n from events where event_type = 'click' group by 1")
def comprehension_consume(spark, d):
    """go(A) -o {X | click(A, X) | taken(A, X)}: one firing uses up all clicks of a user; those left over would count against n."""
    e = Tables(spark, d).events.where("event_type = 'click'").select(F.col("user_id").alias("node"), "event_id")
    p = Program(spark).linear("go", "node long").linear("click", "node long, x long").linear("taken", "node long, x long")
    p.rule([Atom("go", ("A",))], [Head("taken", ("A", "X"), over=(Atom("click", ("A", "X")),))])
    out = p.run({"go": e.select("node").distinct(), "click": e})
    left = out["click"].groupBy("node").agg(F.count("*").alias("left"))
    taken = out["taken"].groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("used"), F.count("*").alias("n"))
    return taken.join(left, "node", "left").select("node", "used", (F.col("n") - F.coalesce("left", F.lit(0))).alias("n"))


@query(f"select node, dst, w from (select *, row_number() over (partition by node order by w, dst) as rn from ({SUCCESSION}) e) t where rn = 1")
def selector_min(spark, d):
    return M.select_min(succession(Tables(spark, d)), ["node"], ["w", "dst"])


@query(f"select node, dst, w from (select *, row_number() over (partition by node order by w, dst) as rn from ({SUCCESSION}) e where w > 20 and dst > node) t where rn = 1")
def selector_min_filtered(spark, d):
    return M.select_min(succession(Tables(spark, d)).where("w > 20 and dst > node"), ["node"], ["w", "dst"])


@query(f"select node, dst, w from (select *, row_number() over (partition by node order by md5('5|' || node || '|' || dst), node, dst) as rn from ({SUCCESSION}) e) t where rn = 1")
def selector_hash_random(spark, d):
    return M.select_random(succession(Tables(spark, d)), ["node"], ["node", "dst"], 5)


@query("select c_nationkey as node from customer union select s_nationkey from supplier")
def union_rules(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_nationkey").alias("node")).unionByName(t.supplier.select(F.col("s_nationkey").alias("node"))).distinct()


@query("select node, count(*) as cnt from (select c_nationkey as node from customer union all select s_nationkey from supplier) t group by 1")
def counted_union(spark, d):
    t = Tables(spark, d)
    return R.union_counted(t.customer.select(F.col("c_nationkey").alias("node")), t.supplier.select(F.col("s_nationkey").alias("node")))


@query("""select node, (a - coalesce(b, 0))::bigint as cnt from (select c_nationkey as node, count(*) as a from customer group by 1) x
left join (select s_nationkey as node, count(*) as b from supplier group by 1) y using (node) where a > coalesce(b, 0)""")
def counted_difference(spark, d):
    t = Tables(spark, d)
    return R.subtract_counted(t.customer.select(F.col("c_nationkey").alias("node")), t.supplier.select(F.col("s_nationkey").alias("node")))


@query("""select node, sum(sign)::bigint as sign from (select o_custkey as node, 1 as sign from orders where o_orderstatus = 'O' union all select o_custkey, -1 from orders where o_orderstatus = 'F') t
group by 1 having sum(sign) <> 0""")
def cancel_derivations(spark, d):
    o = Tables(spark, d).orders
    plus = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("node"), F.lit(1).alias("sign"))
    minus = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("node"), F.lit(-1).alias("sign"))
    return R.cancel(plus.unionByName(minus))


@query("""with o as (select o_custkey as node, max(o_totalprice) as m from orders where o_orderdate < timestamp '1996-01-01' group by 1),
n as (select o_custkey as node, max(o_totalprice) as m from orders group by 1)
select node, m, -1 as sign from (select o.* from o left join n using (node) where n.m is distinct from o.m) t
union all select n.node, n.m, 1 from n left join o using (node) where o.m is distinct from n.m""")
def aggregate_changes(spark, d):
    """What a max aggregate retracts and inserts when later facts arrive."""
    o = Tables(spark, d).orders.select(F.col("o_custkey").alias("node"), F.col("o_totalprice").alias("m"), "o_orderdate")
    old = o.where("o_orderdate < timestamp_ntz'1996-01-01'").groupBy("node").agg(F.max("m").alias("m"))
    return A.changes(old, o.groupBy("node").agg(F.max("m").alias("m")), ["node"])


@query("select 100 + row_number() over (order by c_custkey) - 1 as id, c_custkey from customer")
def node_create_ids(spark, d):
    return A.number_from(Tables(spark, d).customer.select("c_custkey"), 100, ["c_custkey"], lanes=8).select(F.col("id").cast("long").alias("id"), "c_custkey")


@query("select p_partkey as node, (select count(*) from part) as world from part")
def world_count(spark, d):
    t = Tables(spark, d).part
    return t.select(F.col("p_partkey").alias("node"), F.lit(S.world(t)).cast("long").alias("world"))


@query("select thread, count(*) as n from orders join (select unnest(range(4))::int as thread) on o_orderkey % 4 = thread group by 1")
def thread_broadcast_join(spark, d):
    """Facts meet the thread-local table, which is small by definition."""
    facts = Tables(spark, d).orders.select((F.col("o_orderkey") % 4).cast("int").alias("thread"))
    return facts.join(F.broadcast(S.threads(spark, 4)), "thread").groupBy("thread").agg(F.count("*").alias("n"))


@query("""select node, event_id, event_type, coalesce(lag(event_type) over (partition by node order by event_id), 'start') as state
from (select user_id as node, event_id, event_type from events) t""")
def event_state_machine(spark, d):
    """One state fact per user is replaced by every event in turn."""
    e = Tables(spark, d).events.select(F.col("user_id").alias("node"), "event_id", "event_type")
    return e.withColumn("state", F.coalesce(F.lag("event_type").over(W.partitionBy("node").orderBy("event_id")), F.lit("start")))


@query("select n_nationkey::bigint as node, '!nation(' || n_name || ', ' || n_regionkey || ')' as fact from nation union all select c_custkey, 'balance(' || c_mktsegment || ')' from customer")
def dump_listing(spark, d):
    t = Tables(spark, d)
    nation = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), "n_name", "n_regionkey")
    return sinks.dump({"nation": (nation, True), "balance": (t.customer.select(F.col("c_custkey").alias("node"), "c_mktsegment"), False)})


@query("select s_suppkey as node, 'generator' as type from supplier union all select c_custkey, 'consumer' from customer")
def typed_nodes(spark, d):
    t = Tables(spark, d)
    return S.typed_nodes(spark, generator=t.supplier.select(F.col("s_suppkey").alias("node")), consumer=t.customer.select(F.col("c_custkey").alias("node")))


@query("select epoch_ms(ts) // 3600000 as slice, event_type, count(*) as n from events group by 1, 2")
def time_slices(spark, d):
    return sinks.slices(Tables(spark, d).events, "ts", 3_600_000, "event_type")


@query("""select node, n, rn from (select user_id as node, event_type as n, count(*) as c, row_number() over (partition by user_id order by count(*) desc, event_type) as rn from events group by 1, 2) t where rn <= 2""")
def selector_top_k(spark, d):
    """The two most frequent event types of each user."""
    c = Tables(spark, d).events.groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("n")).agg(F.count("*").alias("c"))
    return M.ranked(c, ["node"], [F.desc("c"), "n"]).where("rn <= 2").select("node", "n", F.col("rn").cast("long").alias("rn"))


