"""Rules, relations, builtins and algorithms on small hand-made cases, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ferrule.algorithms import graphs as G
from ferrule.algorithms import numeric as N
from ferrule.algorithms import search as Q
from ferrule.functions import builtins as B
from ferrule.operators import aggregates as A
from ferrule.operators import match as M
from ferrule.plans import fixpoint as X
from ferrule.plans import relation as R
from ferrule.plans.rules import Atom, Head, Program
from ferrule.sources import graphs as S
from ferrule.sources import sinks


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def edges(spark, *pairs):
    return spark.createDataFrame([p if len(p) == 3 else (*p, 1) for p in pairs], "node long, dst long, w int")


def test_min_selector_uses_up_the_smallest(spark):
    p = Program(spark).linear("a", "node long, x int").linear("b", "node long").linear("c", "node long, x int")
    p.rule([Atom("b", ("A",)), Atom("a", ("A", "X"))], [Head("c", ("A", "X"))], select=("min", ("X",)))
    out = p.run({"a": p.frame("a", [(0, 1), (0, 2), (0, 3)]), "b": p.frame("b", [(0,)])})
    assert rows(out["a"]) == [(0, 2), (0, 3)] and rows(out["c"]) == [(0, 1)] and rows(out["b"]) == []


def test_aggregate_collects_and_maps_inputs(spark):
    p = Program(spark).linear("a", "node long, x int").linear("c", "node long, xs array<int>").linear("s", "node long, t int")
    p.rule([Atom("a", ("A", "X"))], [Head("c", ("A", "L")), Head("s", ("A", "T"))], aggregates=(("L", A.collect_desc("X")), ("T", F.sum("X"))), group=("A",))
    out = p.run({"a": p.frame("a", [(0, 1), (0, 2), (0, 3), (5, 9)])})
    assert rows(out["c"]) == [(0, [3, 2, 1]), (5, [9])] and rows(out["s"]) == [(0, 6), (5, 9)] and rows(out["a"]) == []


def test_kept_facts_stay(spark):
    p = Program(spark).linear("a", "node long, x int").linear("b", "node long, x int")
    p.rule([Atom("a", ("A", "X"), keep=True), Atom("b", ("A", 1))], [Head("b", ("A", 5))])
    out = p.run({"a": p.frame("a", [(0, 2)]), "b": p.frame("b", [(0, 1)])})
    assert rows(out["a"]) == [(0, 2)] and rows(out["b"]) == [(0, 5)]


def test_kept_facts_do_not_meet_every_used_one(spark, monkeypatch):
    from ferrule.plans import rules

    tried = []
    monkeypatch.setattr(rules, "select_min", lambda df, *more: tried.append(df.count()) or M.select_min(df, *more))
    p = Program(spark).linear("a", "x int, node long").linear("b", "node long, y int").linear("c", "node long, y int, x int").persistent("e", "node long, z int").linear("d", "y int, x int, z int")
    p.rule([Atom("a", ("X", "A"), keep=True), Atom("b", ("A", "Y"))], [Head("c", ("A", "Y", "X"))])
    p.rule([Atom("c", ("A", "Y", "X")), Atom("e", ("A", "Z"))], [Head("d", ("Y", "X", "Z"))])
    kept = [(x, n) for n in (0, 1) for x in range(n + 3, 20)] + [(None, 2), (1, 2), (7, None)]
    used = [(n, y) for n in (0, 1, 2, 3) for y in range(15)] + [(0, 3), (None, 1)]
    out = p.run({"a": p.frame("a", kept), "b": p.frame("b", used), "e": p.frame("e", [(n, z) for n in (0, 1, 2) for z in range(5, 9)])})
    assert sorted(out["d"].collect(), key=str) == sorted([(y, {0: 3, 1: 4, 2: None}[n], 5) for n, y in used if n in (0, 1, 2)], key=str)
    assert len(rows(out["b"])) == 16 and out["a"].count() == len(kept) and max(tried) == 46


def test_all_pairs_in_blocks(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(40)], "node int, a int")
    right = spark.createDataFrame([(i % 4, i % 9, None if i % 5 else str(i)) for i in range(50)], "node int, b int, c string")
    want = left.join(right, "node")
    assert rows(M.all_pairs(left, right, ["node"], lanes=3, block=4)) == rows(want)
    assert rows(M.all_pairs(left, right, ["node"], F.col("b") < F.col("a"), lanes=3, block=4)) == rows(want.where("b < a"))
    assert M.all_pairs(left, right.limit(0), ["node"]).isEmpty() and M.all_pairs(left.limit(0), right, ["node"]).isEmpty()


def test_two_facts_a_firing_and_equal_facts_count_twice(spark):
    p = Program(spark).linear("one", "node long").linear("ok", "node long")
    p.rule([Atom("one", ("A",)), Atom("one", ("A",))], [Head("ok", ("A",))])
    out = p.run({"one": p.frame("one", [(0,)] * 5 + [(1,)])})
    assert rows(out["ok"]) == [(0,), (0,)] and rows(out["one"]) == [(0,), (1,)]


def test_one_fact_cannot_fill_two_places(spark):
    p = Program(spark).linear("b", "node long, x int").linear("c", "node long")
    p.rule([Atom("b", ("A", "N")), Atom("b", ("A", "X"))], [Head("c", ("A",))])
    out = p.run({"b": p.frame("b", [(0, 1)])})
    assert rows(out["c"]) == [] and rows(out["b"]) == [(0, 1)]


def test_simultaneous_rewrite(spark):
    p = Program(spark).linear("a", "node long, x int, y int").linear("b", "node long, x int, y int").linear("go", "node long")
    p.rule([Atom("go", ("A",)), Atom("a", ("A", "X", "Y")), Atom("b", ("A", "Z", "W"))], [Head("a", ("A", F.col("X") + 2, "Y")), Head("b", ("A", "Z", F.col("W") + 1))])
    out = p.run({"a": p.frame("a", [(0, 1, 1)]), "b": p.frame("b", [(0, 1, 1)]), "go": p.frame("go", [(0,)])})
    assert rows(out["a"]) == [(0, 3, 1)] and rows(out["b"]) == [(0, 1, 2)]


def test_rule_order_is_a_fallback(spark):
    p = Program(spark).linear("a", "node long").linear("b", "node long").linear("out", "node long, how string")
    p.rule([Atom("a", ("A",)), Atom("b", ("A",))], [Head("out", ("A", F.lit("both")))])
    p.rule([Atom("a", ("A",))], [Head("out", ("A", F.lit("alone")))])
    out = p.run({"a": p.frame("a", [(0,), (1,)]), "b": p.frame("b", [(0,)])})
    assert rows(out["out"]) == [(0, "both"), (1, "alone")]


def test_visit_program_with_comprehension(spark):
    p = Program(spark).persistent("edge", "node long, dst long").linear("visit", "node long").persistent("visited", "node long").linear("fresh", "node long")
    p.rule([Atom("visit", ("A",)), Atom("fresh", ("A",))], [Head("visited", ("A",)), Head("visit", ("B",), over=(Atom("edge", ("A", "B")),))])
    p.rule([Atom("visit", ("A",)), Atom("visited", ("A",))], [])
    out = p.run({"edge": p.frame("edge", [(0, 1), (1, 2), (2, 3), (3, 1)]), "visit": p.frame("visit", [(0,)]), "fresh": p.frame("fresh", [(i,) for i in range(5)])})
    assert rows(out["visited"]) == [(0,), (1,), (2,), (3,)] and rows(out["visit"]) == [] and rows(out["fresh"]) == [(4,)]


def test_conditional_heads_actions_and_stop(spark):
    seen = []
    p = Program(spark).linear("a", "node long, x int").linear("big", "node long").linear("small", "node long").action("say", "node long, text string", seen.append)
    p.rule([Atom("a", ("A", "X"))], [Head("big", ("A",), when=F.col("X") > 5), Head("small", ("A",), when=F.col("X") <= 5), Head("say", ("A", F.lit("hi")))])
    p.rule([Atom("big", ("A",))], [Head("small", ("A",))])
    p.stop_on = "big"
    out = p.run({"a": p.frame("a", [(0, 9), (1, 2)])})
    assert rows(out["big"]) == [(0,)] and rows(out["small"]) == [(1,)] and len(seen) == 2
    assert any("linear a" in line for line in p.listing())


def test_list_and_struct_patterns(spark):
    from ferrule.functions import patterns as P

    df = spark.createDataFrame([([1, 2, 3],), ([],), ([4],)], "xs array<int>")
    got = rows(df.select(P.is_nil(F.col("xs")), P.head(F.col("xs")), P.tail(F.col("xs"))))
    assert got == sorted([(False, 1, [2, 3]), (True, None, []), (False, 4, [])], key=repr)
    s = spark.sql("select named_struct('_1', 2, '_2', 3) as s").select(F.struct(F.col("s._2").alias("_1"), F.col("s._1").alias("_2")).alias("r"))
    assert tuple(s.first().r) == (3, 2)
    d = spark.createDataFrame([(-7, 2), (7, -2), (7, 2)], "a int, b int")
    assert [tuple(r) for r in d.select(P.truncating_div(F.col("a"), F.col("b")), P.remainder(F.col("a"), F.col("b"))).collect()] == [(-3, -1), (-3, 1), (3, 1)]


def test_counted_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "node long")
    b = spark.createDataFrame([(1,), (3,)], "node long")
    assert rows(R.union_counted(a, b)) == [(1, 3), (2, 1), (3, 1)]
    assert rows(R.subtract_counted(R.persistent(a), b)) == [(1, 1), (2, 1)]
    assert rows(R.repeat_by_count(R.persistent(a))) == [(1,), (1,), (2,)]


def test_linear_ids_and_conservation(spark):
    facts = R.linear(spark.createDataFrame([(0, 3), (0, 3), (1, 4)], "node long, x int"))
    assert facts.select("fid").distinct().count() == 3
    again = R.linear(facts)
    assert rows(again) == rows(facts)  # ids depend on the facts alone
    left = R.consume(facts, facts.limit(1))
    assert left.count() == 2 and R.produce(left, facts.select("node", "x")).count() == 5


def test_greedy_matching_equals_one_after_another(spark):
    rng = random.Random(4)
    cand = [(i, f"a{rng.randrange(12)}", f"b{rng.randrange(12)}") for i in range(60)]
    used, want = set(), []
    for i, a, b in sorted(cand):
        if a not in used and b not in used:
            want.append((i, a, b))
            used |= {a, b}
    df = spark.createDataFrame(cand, "i int, a string, b string")
    assert rows(M.first_matches(df, ["a", "b"], ["i"])) == sorted(want, key=repr)


def test_pairing(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 9)], "node long, x int")
    assert rows(M.pair_within(df, ["node"], ["x"]), "node", "x", "x_2") == [(0, 1, 2)]
    assert rows(M.pair_by_rank(df, df.withColumnRenamed("x", "y").where("y > 1"), ["node"], ["x"], ["y"]), "node", "x", "y") == [(0, 1, 2), (0, 2, 3), (1, 9, 9)]


def test_aggregates(spark):
    df = spark.createDataFrame([(0, 5, "b"), (0, 2, "z"), (0, 2, "a"), (1, 7, "q")], "node long, x int, tag string")
    assert rows(A.min_of(df, ["node"], "x")) == [(0, 2, "a"), (1, 7, "q")]
    assert rows(A.max_of(df, ["node"], "x")) == [(0, 5, "b"), (1, 7, "q")]
    assert rows(A.first_of(df, ["node"], ["tag"]), "node", "tag") == [(0, "a"), (1, "q")]
    assert rows(A.sum_of(df.select("node", "x"), ["node"], "x")) == [(0, 9), (1, 7)]
    v = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0])], "node long, v array<double>")
    assert rows(A.sum_lists(v, ["node"], "v")) == [(0, [4.0, 6.0])]
    nodes = spark.createDataFrame([(0,), (8,)], "node long")
    assert rows(A.head_aggregate(nodes, df, ["node"], s=F.sum("x"), n=F.count("*"))) == [(0, 9, 3), (8, 0, 0)]
    old, new = A.min_of(df.where("x > 2"), ["node"], "x"), A.min_of(df, ["node"], "x")
    assert rows(A.changes(old, new, ["node"])) == sorted([(0, 5, "b", -1), (0, 2, "a", 1)], key=repr)
    assert rows(A.number_from(nodes, 10, ["node"], lanes=3), "id", "node") == [(10, 0), (11, 8)]


def dijkstra(pairs, start):
    best = {start: 0}
    while True:
        more = {b: min([best[a] + w for a, x, w in pairs if x == b and a in best] + [best.get(b, math.inf)]) for _, b, _ in pairs}
        new = best | {k: v for k, v in more.items() if v < math.inf}
        new[start] = 0
        if new == best:
            return best
        best = new


def random_edges(n=12, m=40, seed=1):
    rng = random.Random(seed)
    return list({(a, b): (a, b, rng.randint(1, 9)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}.values())


def test_paths(spark):
    pairs = random_edges()
    e = edges(spark, *pairs)
    start = spark.createDataFrame([(pairs[0][0],)], "node long")
    want = dijkstra(pairs, pairs[0][0])
    assert dict(rows(G.shortest_paths(e, start))) == want
    assert dict(rows(G.shortest_paths(e, start, bucket=2))) == want
    routes = {r.node: r for r in G.shortest_routes(e, start).collect()}
    cost = {(a, b): w for a, b, w in pairs}
    for node, r in routes.items():
        assert r.d == want[node] == sum(cost[x] for x in zip(r.route, r.route[1:]))
    goal = spark.createDataFrame([(n,) for n in list(want)[-1:]], "node long")
    assert rows(G.a_star(e, start, goal, F.lit(0))) == [(n, want[n]) for n in list(want)[-1:]]
    pair = {(a, b): d for a, b, d in rows(G.all_pairs(e), "src", "node", "d")}
    assert all(pair[a, c] <= pair[a, b] + pair[b, c] for a, b in pair for c in range(12) if (b, c) in pair)
    assert {r[0] for r in rows(G.reachable(e, start))} == set(want)


def test_fixpoint_properties(spark):
    e = edges(spark, (0, 1), (1, 2), (2, 0), (3, 4))
    closure = G.transitive_closure(e)
    again = closure.unionByName(G.transitive_closure(closure.withColumn("w", F.lit(1)))).distinct()
    assert rows(again) == rows(closure)
    assert rows(G.components(e)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    cut = spark.createDataFrame([(2, 0)], "node long, dst long")
    assert rows(X.retract(e.select("node", "dst"), cut, G.transitive_closure)) == [(0, 1), (0, 2), (1, 2), (3, 4)]
    counts = {(a, b): c for a, b, c in rows(G.connectivity_counts(edges(spark, (0, 1), (0, 2), (1, 3), (2, 3), (3, 4))))}
    assert counts[0, 3] == 2 and counts[0, 4] == 1
    with pytest.raises(X.NoFixpoint):
        X.semi_naive(spark.createDataFrame([(0,)], "x int"), lambda d: d.select((F.col("x") + 1).alias("x")), rounds=3)


def test_pagerank(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]
    rank = {i: 0.25 for i in range(4)}
    out = {i: [b for a, b in pairs if a == i] for i in range(4)}
    for _ in range(10):
        rank = {i: 0.15 / 4 + 0.85 * sum(rank[a] / len(out[a]) for a, b in pairs if b == i) for i in range(4)}
    e = edges(spark, *pairs).select("node", "dst")
    got = dict(rows(G.pagerank(e, 10)))
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in rank)
    settled = dict(rows(G.pagerank_until(e, 1e-4)))
    assert abs(sum(settled.values()) - 1) < 1e-3


def test_coloring_and_flow(spark):
    e = edges(spark, *random_edges(10, 30, 3))
    colors = G.greedy_coloring(e)
    assert G.valid_coloring(e, colors) and colors.count() == colors.select("node").distinct().count()
    caps = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)], "node long, dst long, cap int")
    assert G.max_flow(caps, 0, 3) == 5


def test_heat(spark):
    e = edges(spark, (0, 1), (1, 0), (1, 2), (2, 1))
    heat = spark.createDataFrame([(0, 10.0), (1, 0.0), (2, 0.0)], "node long, t double")
    fixed = spark.createDataFrame([(0,), (2,)], "node long")
    assert dict(rows(N.heat_transfer(heat, e, fixed, 3))) == {0: 10.0, 1: 5.0, 2: 0.0}
    assert dict(rows(N.heat_until(heat, e, fixed, 0.001)))[1] == 5.0


def test_belief_propagation_is_exact_on_a_tree(spark):
    table, p = [[0.7, 0.1], [0.1, 0.7]], {0: [0.3, 0.0], 1: [0.0, 0.2], 2: [0.5, 0.1]}
    pairs = [(0, 1), (1, 2)]
    want = {i: [0.0, 0.0] for i in p}
    for x in range(8):
        v = [x >> i & 1 for i in range(3)]
        weight = math.exp(sum(p[i][v[i]] for i in p) + sum(table[v[a]][v[b]] for a, b in pairs))
        for i in p:
            want[i][v[i]] += weight
    potential = spark.createDataFrame(list(p.items()), "node long, p array<double>")
    both = spark.createDataFrame([x for a, b in pairs for x in ((a, b), (b, a))], "node long, dst long")
    got = dict(rows(N.belief_propagation(potential, both, [x for r in table for x in r], 4)))
    for i in p:
        total = sum(want[i])
        assert all(abs(math.exp(g) - w / total) < 1e-9 for g, w in zip(got[i], want[i]))


def test_neural_forward(spark):
    w = spark.createDataFrame([(0, 1, 3, 0.5), (0, 2, 3, -1.0), (1, 3, 4, 2.0)], "layer int, node long, dst long, w double")
    x = spark.createDataFrame([(1, 1.0), (2, 0.5)], "node long, v double")
    got = {(n, k): v for n, k, v in rows(N.neural_forward(w, x, 2))}
    h = 1 / (1 + math.exp(-(0.5 - 0.5)))
    assert abs(got[3, 1] - h) < 1e-9 and abs(got[4, 2] - 1 / (1 + math.exp(-2 * h))) < 1e-9


def test_searches(spark):
    assert Q.queens(spark, 6).count() == 4
    board = [1, 1, 0, 2, 2, 0, 0, 0, 0]
    scores = dict(rows(Q.minimax(spark, board)))
    assert scores[2] == 1 and all(scores[m] < 1 for m in scores if m not in (2,)) or scores[5] >= 0
    lists = spark.createDataFrame([(0, [5, 1, 4, 1]), (1, [2]), (2, [3, 2, 1, 0, -1])], "node long, xs array<int>")
    assert rows(Q.exchange_sort(lists)) == [(0, [1, 1, 4, 5]), (1, [2]), (2, [-1, 0, 1, 2, 3])]
    tree = spark.createDataFrame([(1, 5, "e", 2, 3), (2, 2, "b", None, None), (3, 9, "i", None, None)], "node long, key int, value string, left long, right long")
    asked = spark.createDataFrame([(2,), (9,), (7,)], "key int")
    assert rows(Q.tree_lookups(tree, 1, asked)) == [(2, "b"), (9, "i")]
    gens = spark.createDataFrame([(1, 10), (2, 10)], "generator long, total int")
    need = spark.createDataFrame([(i, 4) for i in range(4)], "consumer long, power int")
    placed = rows(Q.share_power(gens, need))
    assert len(placed) == 4 and all(sum(4 for _, g in placed if g == k) <= 10 for k in (1, 2))


def test_tree_walk_takes_down_bounds_not_queries(spark, monkeypatch):
    put, written = Q.Steps.put, []
    monkeypatch.setattr(Q.Steps, "put", lambda self, df: written.append(put(self, df)) or written[-1])
    # 6 stands where no walk for it gets, 4 is shadowed by 4 above it, 11 hangs on nothing
    nodes = [(1, 5, "e", 2, 3), (2, 2, "b", 4, 5), (3, 9, "i", None, 6), (4, 6, "f", None, None), (5, 4, "d", 7, None), (6, None, "n", None, 8), (7, 4, "x", None, None), (8, 12, "l", None, None), (9, 11, "k", None, None)]
    tree = spark.createDataFrame(nodes, "node long, key int, value string, left long, right long")
    asked = spark.createDataFrame([(k,) for k in range(14)] * 20, "key int")
    assert rows(Q.tree_lookups(tree, 1, asked)) == sorted([(2, "b"), (4, "d"), (5, "e"), (9, "i")] * 20)
    assert sum(df.count() for df in written) <= len(nodes) + 1
    loop = spark.createDataFrame([(1, 5, "e", 1, 2), (2, 9, "i", None, None)], "node long, key int, value string, left long, right long")
    with pytest.raises(ValueError):
        Q.tree_lookups(loop, 1, asked)


def test_builtin_registry(spark):
    assert len(B.NAMES) == 71 == len(set(B.NAMES)) and all(callable(f) for f in B.FUNCTIONS.values())
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    xs = F.array(*[F.lit(x) for x in (3, 1, 3, 2)])
    assert value(B.lnth(xs, 1)) == 1 and value(B.lnth(xs, 9)) is None
    assert value(B.lremove(xs, 3)) == [1, 3, 2] and value(B.lremove(xs, 8)) == [3, 1, 3, 2]
    assert value(B.array_set(xs, 2, 0)) == [3, 1, 0, 2] and value(B.array_set(xs, 9, 0)) == [3, 1, 3, 2]
    assert value(B.str2intlist(F.lit(""))) == [] and value(B.str2intlist(F.lit("1, 2"))) == [1, 2]
    assert abs(value(B.truncate(F.lit(-2.789), 2)) + 2.78) < 1e-9
    assert value(B.queens_violation(2, F.array(F.lit(1)))) and not value(B.queens_violation(3, F.array(F.lit(1))))
    assert value(B.minimax_score(F.array(*[F.lit(x) for x in (1, 0, 0, 1, 0, 0, 1, 0, 0)]), 1)) == 1
    n = B.normalize(F.array(F.lit(1000.0), F.lit(1000.0)))
    assert all(abs(x + math.log(2)) < 1e-9 for x in value(n))
    s = F.struct(F.lit(0.0).alias("_1"), F.lit(0.0).alias("_2"))
    assert all(abs(x + math.log(2)) < 1e-9 for x in value(B.normalizestruct(s, 2)))
    assert abs(value(B.residualstruct(s, s, 2))) < 1e-12 and tuple(value(B.dampstruct(s, s, 0.5, 2))) == (0.0, 0.0)
    m = F.struct(*[F.lit(0.0).alias(f"_{i + 1}") for i in range(4)])
    assert all(abs(x - math.log(2)) < 1e-9 for x in value(B.convolvestruct(m, s, 2)))
    assert value(B.demergemessages(xs, xs)) == [0, 0, 0, 0] and value(B.node2int(F.lit(7))) == 7
    nodes = spark.createDataFrame([(0, 1, True), (1, 1, False), (2, 0, None)], "node long, cpu int, static boolean")
    assert rows(B.cpu_static(nodes)) == [(0, 0), (1, 1)]
    assert rows(nodes.select("node", B.is_static(), B.is_moving())) == [(0, True, False), (1, False, True), (2, False, True)]
    assert rows(B.facts_proved(nodes)) == rows(B.facts_consumed(nodes), "node", "facts_consumed")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "snap.txt").write_text("# c\n0\t1\n1\t2\n")
    (tmp_path / "adj.txt").write_text("0: 1 2 -1\n5: -1\n")
    (tmp_path / "tnet.txt").write_text("1 2 0.5\n2  1 3\n")
    path = str(tmp_path)
    assert rows(S.snap(spark, f"{path}/snap.txt")) == [(0, 1), (1, 2)]
    assert rows(S.snap(spark, f"{path}/snap.txt", undirected=True, default_weight=1), "node", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(S.adjacency(spark, f"{path}/adj.txt")) == [(0, 1), (0, 2)]
    assert rows(S.tnet(spark, f"{path}/tnet.txt")) == [(1, 2, 0.5), (2, 1, 3.0)]
    assert B.filecountwords(spark, f"{path}/tnet.txt").first().n == 6
    facts = spark.createDataFrame([(0, 1.5, [1, 2], 2)], "node long, x double, xs array<int>, cnt long")
    assert rows(sinks.dump({"f": (facts, True)}), "fact") == [("!f(1.5000, [1,2])",)] * 2
    sinks.write(facts, f"{path}/out", ["node"])
    assert S.table(spark, f"{path}/out", ["x"]).count() == 1
    assert sinks.timed(lambda: 1)[1].startswith("Time: ") and "Scan" in sinks.plan_of(S.table(spark, f"{path}/out"))
    assert S.world(S.nodes_of(S.snap(spark, f"{path}/snap.txt"))) == 3 and S.threads(spark, 3).count() == 3
    assert rows(S.universal(S.nodes_of(S.snap(spark, f"{path}/snap.txt")), x=1)) == [(0, 1), (1, 1), (2, 1)]


def test_upsert_and_scatter(spark):
    state = spark.createDataFrame([(0, 1), (1, 2)], "node long, value int")
    edits = spark.createDataFrame([(0, 7, 1), (0, 3, 2), (9, 9, 1)], "node long, value int, n int")
    assert rows(M.remote_upsert(state, edits, ["node"], ["value"], [F.desc("n")])) == [(0, 3), (1, 2)]
    assert rows(M.scatter(state, edges(spark, (0, 1), (0, 2)).select("node", "dst"))) == [(1, 1), (2, 1)]


def test_nulls_lose_in_aggregates_and_end_in_fixpoints(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 3, "a"), (1, 5, "b"), (2, None, "z"), (3, -(2**63), "m")], "node long, x long, tag string")
    assert rows(A.min_of(df, ["node"], "x")) == [(1, 3, "a"), (2, None, "z"), (3, -(2**63), "m")]
    assert rows(A.max_of(df, ["node"], "x")) == [(1, 5, "b"), (2, None, "z"), (3, -(2**63), "m")]
    assert rows(A.max_of(df.select("node", "tag", "x"), ["node"], "tag")) == [(1, "n", None), (2, "z", None), (3, "m", -(2**63))]
    assert rows(A.first_of(df, ["node"], ["x"])) == [(1, 3, "a"), (2, None, "z"), (3, -(2**63), "m")]
    start = spark.createDataFrame([(1, None)], "node long, y long")
    assert rows(X.semi_naive(start, lambda d: d.select("node", "y"), rounds=3)) == [(1, None)]
    p = Program(spark).persistent("a", "node long, y long").persistent("b", "node long, y long")
    p.rule([Atom("a", ("A", "Y"))], [Head("b", ("A", "Y"))])
    p.rule([Atom("b", ("A", "Y"))], [Head("a", ("A", "Y"))])
    assert rows(p.run({"a": start})["b"]) == [(1, None)]


def test_empty_groups_of_head_aggregates(spark):
    groups, facts = spark.createDataFrame([(7,), (8,)], "node long"), spark.createDataFrame([(7, 5)], "node long, x long")
    got = A.head_aggregate(groups, facts, ["node"], least=F.min("x"), total=F.sum("x"), n=F.count("*"))
    assert rows(got) == [(7, 5, 5, 1), (8, None, 0, 0)]


def test_exact_whole_numbers(spark):
    from ferrule.functions import patterns as P

    d = spark.createDataFrame([(9007199254740993, 1), (-9007199254740993, 2)], "a long, b long")
    assert rows(d.select(P.truncating_div(F.col("a"), F.col("b")))) == [(-4503599627370496,), (9007199254740993,)]
    assert rows(d.limit(1).select(B.intpower(3, 19), B.intpower(5, 0), B.intpower(-2, 3))) == [(1162261467, 1, -8)]


def test_power_without_generators(spark):
    none = spark.createDataFrame([], "generator long, total long")
    want = spark.createDataFrame([(1, 5)], "consumer long, power long")
    assert Q.share_power(none, want).count() == 0
    one = spark.createDataFrame([(9, 7)], "generator long, total long")
    two = spark.createDataFrame([(1, 5), (2, 3)], "consumer long, power long")
    assert rows(Q.share_power(one, two)) == [(1, 9)]


def test_lattice_buckets_and_components_of_chains(spark):
    chain = edges(spark, *[(i, i + 1, 2) for i in range(10)], (0, 9, 100), (9, 0, 1))
    start = spark.createDataFrame([(0,)], "node long")
    want = [(i, 2 * i) for i in range(11)]
    assert sorted(rows(G.shortest_paths(chain, start))) == want == sorted(rows(G.shortest_paths(chain, start, bucket=10)))
    apart = edges(spark, *[(i, i + 1) for i in range(60)], (100, 101), (7, 7), (200, 200))
    assert sorted(rows(G.components(apart))) == [(i, 0) for i in range(61)] + [(100, 100), (101, 100), (200, 200)]


def test_priorities_placement_and_threads(spark):
    p = Program(spark).coordinate(asc=True, initial=5.0, cpus=2).linear("w", "node long").persistent("ran", "node long")
    p.rule([Atom("w", ("A",))], [Head("ran", ("A",))])
    p.stop_on = "ran"
    out = p.run({"w": p.frame("w", [(1,), (2,), (3,), (4,)]), "set-priority": p.frame("set-priority", [(1, 9.0), (2, 1.0)]), "add-priority": p.frame("add-priority", [(3, -4.0)])})
    assert rows(out["ran"]) == [(2,), (3,)] and rows(out["w"]) == [(1,), (4,)] and p.consumed == {"w": 2} and p.proved == {"ran": 2}
    assert rows(out["placement"]) == [(1, 0), (2, 0), (3, 1), (4, 1)]
    p = Program(spark).coordinate(cpus=2).linear("w", "node long").persistent("ran", "node long")
    p.rule([Atom("w", ("A",))], [Head("ran", ("A",))])
    p.stop_on = "ran"
    out = p.run({"w": p.frame("w", [(1,), (2,)]), "schedule-next": p.frame("schedule-next", [(1,)]), "set-cpu": p.frame("set-cpu", [(1, 1)]), "set-affinity": p.frame("set-affinity", [(2, 1)]), "set-static": p.frame("set-static", [(2,)])})
    assert rows(out["ran"]) == [(1,)] and rows(out["placement"]) == [(1, 1), (2, 1)] and rows(out["just-moved"]) == [(1,)]
    assert rows(out["nodes"].select("node", "static")) == [(1, False), (2, True)]
    p = Program(spark)
    facts = p.thread_facts(3)
    p.linear("hi", "thread int").persistent("told", "thread int")
    p.rule([Atom("hi", ("T",)), Atom("leader-thread", ("T",))], [Head("told", ("O",), over=(Atom("other-thread", ("T", "O")),))])
    assert rows(p.run(facts | {"hi": p.frame("hi", [(0,), (1,)])})["told"]) == [(1,), (2,)]


def test_rule_priority_goes_before_source_order(spark):
    p = Program(spark).linear("a", "node long").linear("out", "node long, how string")
    p.rule([Atom("a", ("A",))], [Head("out", ("A", F.lit("low")))])
    p.rule([Atom("a", ("A",))], [Head("out", ("A", F.lit("high")))], priority=1)
    assert rows(p.run({"a": p.frame("a", [(0,)])})["out"]) == [(0, "high")]


def test_weighted_snap(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\n1\t2\t7\n2\t3\t9\n")
    assert rows(S.snap(spark, f"file://{tmp_path}/g.txt", weighted=True)) == [(1, 2, 7), (2, 3, 9)]
