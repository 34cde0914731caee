"""Every builtin over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import builtins as B
from .base import Tables, query, rounded

LISTS = "(select l_orderkey as node, list(l_partkey order by l_partkey) as xs, list(distinct l_suppkey order by l_suppkey) as ys from lineitem group by 1) t"


def lists(spark, d):
    return Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(F.sort_array(F.collect_list("l_partkey")).alias("xs"), F.sort_array(F.collect_set("l_suppkey")).alias("ys"))


@query(f"select node, len(xs) as n, xs[2] as second, xs[-1] as last, list_reverse(xs) as back, list_concat(xs, ys) as appended, list_count(list_filter(xs, lambda x: x = xs[1])) as firsts from {LISTS}")
def builtin_list_basic(spark, d):
    xs, ys = F.col("xs"), F.col("ys")
    return lists(spark, d).select(
        "node", B.llength(xs).cast("long").alias("n"), B.lnth(xs, 1).alias("second"), B.listlast(xs).alias("last"), B.lreverse(xs).alias("back"),
        B.lappend(xs, ys).alias("appended"), B.listcount(xs, B.lnth(xs, 0)).cast("long").alias("firsts"),
    )


@query(f"select node, xs[1:2] as two, xs[2:3] as sub, list_contains(ys, xs[1]) as has, len(list_filter(xs, lambda x: not list_contains(ys, x))) = 0 as inside, list_sort(list_distinct(xs)) as uniq, list_filter(xs, lambda x, i: i <> 1) as rest, list_prepend(0::bigint, xs) as cons from {LISTS}")
def builtin_list_more(spark, d):
    xs, ys = F.col("xs"), F.col("ys")
    return lists(spark, d).select(
        "node", B.ltake(xs, 2).alias("two"), B.intlistsub(xs, 1, 3).alias("sub"), B.lexists(ys, B.lhead(xs)).alias("has"), B.lexistss(xs, ys).alias("inside"),
        B.lsort(B.lremoveduplicates(xs)).alias("uniq"), B.lremove(xs, B.lhead(xs)).alias("rest"), B.lcons(F.lit(0).cast("long"), xs).alias("cons"),
    )


@query(f"select node, list_sort(list_distinct(list_filter(xs, lambda x: not list_contains(ys, x)))) as diff, case when xs = list_concat(ys, []) then 1 else 0 end as same from {LISTS}")
def builtin_list_compare(spark, d):
    xs, ys = F.col("xs"), F.col("ys")
    return lists(spark, d).select("node", F.sort_array(B.intlistdiff(xs, ys)).alias("diff"), B.intlistequal(xs, ys).alias("same"))


@query(f"select node, [7, 7, 7] as made, xs[1] as got, list_prepend(0::bigint, xs[2:]) as put, list_append(xs, 5::bigint) as added, len(xs) as n, list_contains(xs, 5) as has from {LISTS}")
def builtin_array(spark, d):
    xs = F.col("xs")
    return lists(spark, d).select(
        "node", B.array_init(3, 7).alias("made"), B.array_get(xs, 0).alias("got"), B.array_set(xs, 0, F.lit(0).cast("long")).alias("put"),
        B.array_add(B.array_from_list(xs), F.lit(5).cast("long")).alias("added"), B.array_size(xs).cast("long").alias("n"), B.array_exists(xs, F.lit(5).cast("long")).alias("has"),
    )


@query(f"select node, list_sort(list_distinct(xs)) as s, list_sort(list_distinct(list_append(xs, 3::bigint))) as more, len(list_distinct(xs)) as n, list_contains(xs, 3) as has from {LISTS}")
def builtin_set(spark, d):
    s = B.set_from_list(F.col("xs"))
    three = F.lit(3).cast("long")
    return lists(spark, d).select("node", s.alias("s"), B.set_add(s, three).alias("more"), B.set_size(s).cast("long").alias("n"), B.set_exists(s, three).alias("has"))


@query("""select c_custkey as node, round(1 / (1 + exp(-c_acctbal / 1000)), 6) as sig, abs(c_acctbal) as size, trunc(c_acctbal)::int as whole, (c_custkey::int % 7) ** 3 as cube,
sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10 as cut from customer""")
def builtin_math(spark, d):
    t = Tables(spark, d).customer
    return t.select(
        F.col("c_custkey").alias("node"), F.round(B.sigmoid(F.col("c_acctbal") / 1000), 6).alias("sig"), B.myfabs(F.col("c_acctbal")).alias("size"),
        B.float2int(F.col("c_acctbal")).alias("whole"), B.intpower(F.col("c_custkey").cast("int") % 7, 3).cast("double").alias("cube"), B.truncate(F.col("c_acctbal"), 1).alias("cut"),
    )


@query("""select c_custkey as node, c_name || c_mktsegment as appended, cast(c_custkey as varchar) as text, cast('42' as int) as i, cast('2.5' as double) as f,
[c_nationkey, 7] as parsed, c_nationkey as kept from customer""")
def builtin_string(spark, d):
    t = Tables(spark, d).customer
    return t.select(
        F.col("c_custkey").alias("node"), B.concatenate(F.col("c_name"), F.col("c_mktsegment")).alias("appended"), B.int2str(F.col("c_custkey")).alias("text"), B.str2int("42").alias("i"),
        B.str2float("2.5").alias("f"), B.str2intlist(F.concat_ws(",", F.col("c_nationkey").cast("string"), F.lit("7"))).alias("parsed"), B.wastetime(F.col("c_nationkey")).alias("kept"),
    )


VEC = "(select vec_id as node, list_transform(embedding[1:4], lambda x: x::double) as v from embeddings) t"


@query(f"""select node, list_transform(v, lambda x: round(x - ln(list_sum(list_transform(v, lambda y: exp(y)))), 6)) as norm, list_transform(v, lambda x: round(x + x, 6)) as twice,
round(list_sum(list_transform(v, lambda x: abs(exp(x) - exp(0.0)))), 6) as res, list_transform(v, lambda x: round(ln(0.25 * exp(0.0) + 0.75 * exp(x)), 6)) as damped,
[round(ln(exp(v[1]) + exp(1 + v[2])), 6), round(ln(exp(2 + v[1]) + exp(3 + v[2])), 6)] as conv, [0, 0, 1, 0] as unit from {VEC}""")
def builtin_vector(spark, d):
    r6 = lambda xs: F.transform(xs, lambda x: rounded(x, 6))
    v, zero = F.col("v"), F.array(*[F.lit(0.0)] * 4)
    t = Tables(spark, d).embeddings.select(F.col("vec_id").alias("node"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    matrix = F.array(*[F.lit(x) for x in (0.0, 1.0, 2.0, 3.0)])
    return t.select(
        "node", r6(B.normalize(v)).alias("norm"), r6(B.addfloatlists(v, B.divide(v, zero))).alias("twice"), F.round(B.residual(v, zero), 6).alias("res"),
        r6(B.damp(v, zero, 0.25)).alias("damped"), r6(B.convolve(matrix, F.slice(v, 1, 2))).alias("conv"), B.degeneratevector(4, 2).alias("unit"),
    )


@query("select p_partkey as node, (p_size * 4 / 51)::int as v, [p_size % 10 * 3 // 10, p_size % 10 * 3 // 10] as h, ((p_size // 10) * 3 // 10) * 3 + (p_size % 10) * 3 // 10 as g from part" .replace("(p_size * 4 / 51)::int", "floor(p_size * 4 / 51)::int"))
def builtin_partition(spark, d):
    x, y = F.col("p_size") % 10, F.floor(F.col("p_size") / 10)
    h = B.partition_horizontal(x, 10, 10, 3)
    return Tables(spark, d).part.select(F.col("p_partkey").alias("node"), B.partition_vertical(F.col("p_size"), 51, 51, 4).alias("v"), F.array(h, h).alias("h"), B.partition_grid(x, y, 10, 3).alias("g"))


@query("select user_id as node, count(*)::int as queue_size from events group by 1")
def builtin_queue_size(spark, d):
    return B.queue_size(Tables(spark, d).events.select(F.col("user_id").alias("node")))


@query("select p_partkey as node, ('0x' || substr(md5('3|' || p_partkey), 1, 8))::bigint % 10 as r from part" .replace("% 10 as r", "% 10 as r"))
def builtin_randint(spark, d):
    return Tables(spark, d).part.select(F.col("p_partkey").alias("node"), B.randint(10, F.col("p_partkey"), 3).cast("long").alias("r"))


@query("""select p_partkey as node, p_size % 8 = b0 or abs(p_size % 8 - b0) = 1 or p_size % 8 = b1 or abs(p_size % 8 - b1) = 2 as hit
from (select *, p_size % 5 as b0, p_size % 3 as b1 from part) t""")
def builtin_queens_violation(spark, d):
    s = F.col("p_size")
    return Tables(spark, d).part.select(F.col("p_partkey").alias("node"), B.queens_violation(s % 8, F.array(s % 5, s % 3)).alias("hit"))


@query("""select p_partkey as node, case when m = 1 then 1 when m = 2 then -1 else 0 end as score, (case when m = 0 then 9 else 6 end)::bigint as left_over from (select p_partkey, p_size % 3 as m from part) t""")
def builtin_minimax(spark, d):
    m = (F.col("p_size") % 3).cast("int")
    board = F.concat(F.array(m, m, m), F.array_repeat(F.lit(0), 6))
    return Tables(spark, d).part.select(F.col("p_partkey").alias("node"), B.minimax_score2(board, 1).alias("score"), B.minimax_points2(board).cast("long").alias("left_over"))


@query("""select c_custkey as node, c_acctbal + c_nationkey as a, c_acctbal - c_nationkey as b from customer""")
def builtin_structs(spark, d):
    t = Tables(spark, d).customer
    s, u = F.struct(F.col("c_acctbal").alias("_1"), F.col("c_acctbal").alias("_2")), F.struct(F.col("c_nationkey").cast("double").alias("_1"), F.col("c_nationkey").cast("double").alias("_2"))
    return t.select(F.col("c_custkey").alias("node"), B.addfloatstructs(s, u, 2)["_1"].alias("a"), B.dividestruct(s, u, 2)["_2"].alias("b"))
