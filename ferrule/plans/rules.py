"""Programs of rules: predicates, atoms, constraints, heads; each rule is a DataFrame step.

    p = Program(spark)
    p.persistent("edge", "node", "dst").linear("visit", "node").persistent("visited", "node")
    p.rule([p.atom("visit", "A")], [p.head("visited", "A"), each(p, "edge", ...)])

Semantics: persistent rules run to their fixpoint first; then the first linear rule, in
source order, that has a match runs once over all nodes as snapshot-in, delta-out, and so on
until no rule applies.  Inside a run, greedy matching in canonical order (all columns of
the matched facts, ascending) decides which linear facts are used; a linear fact is used
once, and two atoms never share one fact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import first_matches, pair_by_rank, select_min, select_random
from .fixpoint import NoFixpoint
from . import schedule
from .relation import FID, absent, linear, payload
from .storage import Steps


@dataclass(frozen=True)
class Predicate:
    name: str
    fields: tuple[str, ...]
    types: tuple[str, ...]
    is_linear: bool
    is_action: bool = False


@dataclass(frozen=True)
class Atom:
    """A body literal: a name binds a variable, anything else is a constant to equal; None ignores the field."""

    predicate: str
    terms: tuple
    keep: bool = False  # matched but not used up


@dataclass(frozen=True)
class Head:
    """A derived fact; a term is a variable's name or a Column expression over variables.

    ``when`` makes the head conditional.  ``over`` turns it into a comprehension: the head
    is derived for every match of those further atoms, not just one.
    """

    predicate: str
    terms: tuple
    when: Column | None = None
    over: tuple[Atom, ...] = ()


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...]
    heads: tuple[Head, ...]
    where: Column | None = None
    lets: tuple[tuple[str, Column], ...] = ()
    select: tuple[str, tuple[str, ...]] | None = None  # ("min" | "random", variables)
    aggregates: tuple[tuple[str, Column], ...] = ()  # head aggregates by the variables in ``group``
    group: tuple[str, ...] = ()
    name: str = ""
    priority: int = 0  # rules of a higher one are tried first


@dataclass
class Program:
    spark: SparkSession
    predicates: dict[str, Predicate] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    actions: dict[str, object] = field(default_factory=dict)
    stop_on: str | None = None
    order: schedule.Order | None = None
    consumed: dict[str, int] = field(default_factory=dict)  # facts that runs used up, by predicate
    proved: dict[str, int] = field(default_factory=dict)  # facts that runs derived, by predicate

    def coordinate(self, asc: bool = False, initial: float = 0.0, cpus: int = 1) -> "Program":
        """Let priorities decide which nodes go first; declares the predicates of ``schedule.EDITS``, and
        ``placement`` (node, cpu), which rules may read, and ``just-moved`` (node)."""
        self.order = schedule.Order(asc, initial, cpus)
        for name, schema in schedule.EDITS.items():
            self._add(name, schema, True)
        self._add("just-moved", "node long", True)
        return self._add("placement", "node long, cpu int", False)

    def thread_facts(self, n: int) -> dict[str, DataFrame]:
        """Declares thread-list, other-thread and leader-thread, keyed by thread, and returns their facts.

        Facts of a thread are relations with a first column ``thread``; a head for another
        thread sends them there.
        """
        self.persistent("thread-list", "thread int").persistent("other-thread", "thread int, other int").persistent("leader-thread", "thread int")
        one = self.spark.range(n).select(F.col("id").cast("int").alias("thread"))
        others = one.select("thread", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")).where("thread <> other")
        return {"thread-list": one, "other-thread": others, "leader-thread": one.where("thread = 0")}

    def _add(self, name: str, schema: str, is_linear: bool, is_action: bool = False) -> "Program":
        fields = [x.strip().split(" ", 1) for x in schema.split(",")]
        self.predicates[name] = Predicate(name, tuple(f for f, _ in fields), tuple(t.strip() for _, t in fields), is_linear, is_action)
        return self

    def persistent(self, name: str, schema: str) -> "Program":
        return self._add(name, schema, False)

    def linear(self, name: str, schema: str) -> "Program":
        return self._add(name, schema, True)

    def action(self, name: str, schema: str, run) -> "Program":
        """Facts that cause a side effect on the driver and are gone."""
        self.actions[name] = run
        return self._add(name, schema, True, True)

    def rule(self, body: list[Atom], heads: list[Head], **more) -> "Program":
        self.rules.append(Rule(tuple(body), tuple(heads), name=more.pop("name", f"rule {len(self.rules)}"), **more))
        return self

    def listing(self) -> list[str]:
        """Predicates and rules, as text."""
        out = [f"{'linear ' if p.is_linear else ''}{p.name}({', '.join(f'{f} {t}' for f, t in zip(p.fields, p.types))})" for p in self.predicates.values()]
        return out + [f"{r.name}: {', '.join(('$' if a.keep else '') + a.predicate for a in r.body)} -o {', '.join(h.predicate for h in r.heads)}" for r in self.rules]

    def frame(self, name: str, rows: list[tuple]) -> DataFrame:
        p = self.predicates[name]
        return self.spark.createDataFrame(rows, ", ".join(f"{f} {t}" for f, t in zip(p.fields, p.types)))

    # one rule -----------------------------------------------------------------------

    def _atom_frame(self, facts: dict[str, DataFrame], atom: Atom, at: int) -> DataFrame:
        p = self.predicates[atom.predicate]
        df, named = facts[atom.predicate], {}
        cond: list[Column] = []
        for f, term in zip(p.fields, atom.terms):
            if term is None:
                continue
            if isinstance(term, str):
                if term in named:
                    cond.append(F.col(f) == F.col(named[term]))
                else:
                    named[term] = f
            else:
                cond.append(F.col(f) == term if isinstance(term, Column) else F.col(f) == F.lit(term))
        if cond:
            df = df.where(reduce(lambda a, b: a & b, cond))
        columns = [F.col(f).alias(v) for v, f in named.items()]
        if p.is_linear:
            columns.append(F.col(FID).alias(f"__f{at}"))
        return df.select(*columns)

    def _matches(
        self, facts: dict[str, DataFrame], atoms: tuple[Atom, ...], start: DataFrame | None = None, offset: int = 0,
        places: dict[int, DataFrame] | None = None, least: dict[int, list[str]] | None = None,
    ) -> DataFrame:
        """All combinations: a left-deep chain of equi-joins on shared variables; the optimiser may reorder it.

        ``places`` gives other facts to single atoms, by their position; ``least`` names the atoms of which only
        the first fact of each key takes part, with their keys.
        """
        out = start
        for i, atom in enumerate(atoms):
            right = self._atom_frame({atom.predicate: places[i]} if places and i in places else facts, atom, offset + i)
            if least and i in least:
                rest = [c for c in right.columns if c not in least[i]]
                first = right.groupBy(*least[i]).agg(F.min(F.struct(*rest)).alias("__first"))
                right = first.select(*[F.col("__first")[c].alias(c) if c in rest else F.col(c) for c in right.columns])
            if out is None:
                out = right
                continue
            shared = [c for c in right.columns if c in out.columns]
            if not shared:
                raise ValueError(f"{atom.predicate} shares no variable with the atoms before it")
            out = out.join(right, shared)
            if self.predicates[atom.predicate].is_linear:
                for j, other in enumerate(atoms[:i]):
                    if other.predicate == atom.predicate:
                        out = out.where(F.col(f"__f{offset + j}") != F.col(f"__f{offset + i}"))
        return out

    def _pairs(self, facts: dict[str, DataFrame], rule: Rule) -> DataFrame | None:
        """Matches of a rule whose two facts only have to share their key: the n-th of the one with the n-th
        of the other, which is what greedy matching takes, without making all combinations."""
        names = {a.predicate for a in rule.body}
        plain = self.order is None and len(rule.body) == 2 == len(names) and rule.where is None and not rule.select and not rule.aggregates
        if not plain or not all(self.predicates[a.predicate].is_linear and not a.keep for a in rule.body):
            return None
        left, right = (self._atom_frame(facts, a, i) for i, a in enumerate(rule.body))
        keys = [c for c in left.columns if c in right.columns]
        if not keys:
            return None
        return pair_by_rank(left, right, keys, [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys])

    def _least(self, rule: Rule) -> dict[int, list[str]]:
        """Atoms that use nothing up and of which a run can only take the first fact of each key, with their keys.

        A used fact takes its least match.  Given all other variables, the least match has the least values of those
        that stand in this atom alone, so no other fact of the key is ever taken, and they need not meet at all.
        """
        if self.order or rule.where is not None or rule.select or rule.aggregates:
            return {}
        if not any(self.predicates[a.predicate].is_linear and not a.keep for a in rule.body):
            return {}
        names = [{t for t in a.terms if isinstance(t, str)} for a in rule.body]
        if any(n in set().union(*names) for n, _ in rule.lets):  # a let that takes a variable's name changes the order
            return {}
        out = {}
        for i, a in enumerate(rule.body):
            linear_fact = self.predicates[a.predicate].is_linear
            alone = not linear_fact or [b.predicate for b in rule.body].count(a.predicate) == 1
            keys = names[i] & set().union(*(n for j, n in enumerate(names) if j != i))
            if alone and keys and (a.keep or not linear_fact) and (linear_fact or names[i] - keys):
                out[i] = [t for t in dict.fromkeys(t for t in a.terms if isinstance(t, str)) if t in keys]
        return out

    def apply(self, facts: dict[str, DataFrame], rule: Rule, places: dict[int, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame], dict[str, list[DataFrame]]]:
        """(matches taken, used fact ids by predicate, derived facts by predicate) of one run."""
        paired = self._pairs(facts, rule)
        got = self._matches(facts, rule.body, places=places, least=self._least(rule)) if paired is None else paired
        for name, value in rule.lets:
            got = got.withColumn(name, value)
        if rule.where is not None:
            got = got.where(rule.where)
        if self.order and "__nodes" in facts and self._uses_linear(rule):
            got = self._best_nodes(facts, rule, got)
        ids = [f"__f{i}" for i, a in enumerate(rule.body) if self.predicates[a.predicate].is_linear and not a.keep]
        plain = [c for c in got.columns if not c.startswith("__")]
        used: dict[str, DataFrame] = {}
        if rule.select:
            kind, variables = rule.select
            key = [rule.body[0].terms[0]]
            got = select_min(got, key, [*variables, *plain, *ids]) if kind == "min" else select_random(got, key, plain, 0)
        if rule.aggregates:
            matched = got
            got = matched.groupBy(*rule.group).agg(*[a.alias(n) for n, a in rule.aggregates])
        else:
            if len(ids) == 1 and len(rule.body) > 1:
                got = select_min(got, ids, [*plain, *[c for c in got.columns if c.startswith("__f") and c not in ids]])
            elif len(ids) > 1 and paired is None:
                got = first_matches(got, ids, plain, [rule.body[int(c[3:])].predicate for c in ids])
            matched = got
        for i, a in enumerate(rule.body):
            if f"__f{i}" in ids:
                more = matched.select(F.col(f"__f{i}").alias(FID))
                used[a.predicate] = used[a.predicate].unionByName(more) if a.predicate in used else more
        made: dict[str, list[DataFrame]] = {}
        for h in rule.heads:
            rows = got if h.when is None else got.where(h.when)
            if h.over:
                rows = self._matches(facts, h.over, rows, offset=100)
                for i, a in enumerate(h.over):
                    if self.predicates[a.predicate].is_linear and not a.keep:
                        more = rows.select(F.col(f"__f{100 + i}").alias(FID))
                        used[a.predicate] = used[a.predicate].unionByName(more) if a.predicate in used else more
            p = self.predicates[h.predicate]
            terms = [F.col(t) if isinstance(t, str) else t if isinstance(t, Column) else F.lit(t) for t in h.terms]
            made.setdefault(h.predicate, []).append(rows.select(*[t.cast(kind).alias(f) for t, kind, f in zip(terms, p.types, p.fields)]))
        return matched, used, made

    def _best_nodes(self, facts: dict[str, DataFrame], rule: Rule, got: DataFrame) -> DataFrame:
        """Matches at the nodes whose priority is the best among those that match."""
        key = rule.body[0].terms[0]
        if not isinstance(key, str):
            return got
        ranks = schedule.current(facts["__nodes"], self.order).select(F.col("node").alias(key), F.col("priority").alias("__priority"))
        ranked = got.join(ranks, key, "left").withColumn("__priority", F.coalesce("__priority", F.lit(self.order.initial)))
        best = ranked.agg((F.min if self.order.asc else F.max)("__priority")).first()[0]
        return ranked.where(F.col("__priority") == F.lit(best)).drop("__priority") if best is not None else got

    def _coordinate(self, now: dict[str, DataFrame], steps: Steps) -> dict[str, DataFrame] | None:
        """Take up the edits that have been derived; returns new facts of ``placement``, None if there were no edits."""
        fresh, some = {}, False
        for name in schedule.EDITS:
            if not now[name].isEmpty():
                some = True
                after = steps.put(schedule.edit(now["__nodes"], name, now[name].select(*self.predicates[name].fields), self.order))
                if name in ("set-cpu", "set-affinity"):
                    moved = schedule.just_moved(now["__nodes"], after)
                    now["just-moved"] = steps.put(linear(now["just-moved"].select("node").unionByName(moved)))
                    now["placement"] = fresh["placement"] = steps.put(after.select("node", "cpu"))
                now["__nodes"] = after
                now[name] = steps.put(now[name].limit(0))
        return fresh if some else None

    # the loop -----------------------------------------------------------------------

    def run(self, facts: dict[str, DataFrame], rounds: int = 1000) -> dict[str, DataFrame]:
        """Run to quiescence; returns every relation (linear ones without ids)."""
        steps = Steps(self.spark, "program")
        now: dict[str, DataFrame] = {}
        for name, p in self.predicates.items():
            df = facts.get(name)
            df = self.frame(name, []) if df is None else df.select(*[df[c].cast(t).alias(f) for c, f, t in zip(df.columns, p.fields, p.types)])
            now[name] = steps.put(linear(df) if p.is_linear else df.distinct())
        if self.order:
            keyed = [now[n].select(F.col(p.fields[0]).cast("long").alias("node")) for n, p in self.predicates.items() if p.fields[0] == "node" and n in facts]
            nodes = reduce(DataFrame.unionByName, keyed).distinct() if keyed else self.spark.createDataFrame([], "node long")
            now["__nodes"] = steps.put(schedule.place(nodes, self.order.cpus))
            now["placement"] = steps.put(now["__nodes"].select("node", "cpu"))
            self._coordinate(now, steps)
        fresh = {n: now[n] for n, p in self.predicates.items() if not p.is_linear and not now[n].isEmpty()}
        settled: dict[str, DataFrame] = {}
        rules = sorted((r for r in self.rules if self._uses_linear(r)), key=lambda r: -r.priority)
        for _ in range(rounds):
            self._saturate(now, settled, fresh, steps, rounds)
            if self.stop_on and not now[self.stop_on].isEmpty():
                break
            for rule in rules:
                if not any(now[a.predicate].isEmpty() for a in rule.body):
                    fresh = self._step(now, rule, steps)
                    if fresh is not None:
                        if self.order and (more := self._coordinate(now, steps)):
                            fresh |= more
                        break
            else:
                break
        else:
            raise NoFixpoint(f"the program did not end in {rounds} rule runs")
        return {n: df.select(*payload(df)) for n, df in now.items() if n != "__nodes"} | ({"nodes": now["__nodes"]} if self.order else {})

    def _saturate(self, now: dict[str, DataFrame], settled: dict[str, DataFrame], fresh: dict[str, DataFrame], steps: Steps, rounds: int) -> None:
        """Persistent rules to their fixpoint; every match is made once, when its last fact is new.

        ``settled`` holds the facts that these rules have seen, ``fresh`` those that they haven't.
        """
        rules = [r for r in self.rules if not self._uses_linear(r)]
        for _ in range(rounds):
            if not fresh:
                return
            made: dict[str, list[DataFrame]] = {}
            for rule in rules:
                names = [a.predicate for a in rule.body]
                if not any(n in fresh for n in names) or any(n not in fresh and n not in settled for n in names):
                    continue
                if rule.aggregates or rule.select:
                    plans = [self.apply(now, rule)[2]]
                else:  # atoms before the new fact see old facts, those after it see all
                    spots = [i for i, n in enumerate(names) if n in fresh and all(m in settled for m in names[:i])]
                    plans = [self.apply(now, rule, {j: settled[n] if j < i else fresh[n] if j == i else now[n] for j, n in enumerate(names)})[2] for i in spots]
                for heads in plans:
                    for name, dfs in heads.items():
                        made.setdefault(name, []).extend(dfs)
            for name in fresh:
                settled[name] = now[name]
            fresh = {}
            for name, dfs in sorted(made.items()):
                new = self._absorb(now, name, dfs, steps)
                if new is not None:
                    fresh[name] = new
        raise NoFixpoint(f"the persistent rules did not end in {rounds} rounds")

    def _absorb(self, now: dict[str, DataFrame], name: str, made: list[DataFrame], steps: Steps) -> DataFrame | None:
        """Add derived facts to a relation; returns the new facts of a persistent one."""
        p, rows = self.predicates[name], reduce(DataFrame.unionByName, made)
        if p.is_action:
            for row in steps.put(rows).toLocalIterator():
                self.actions[name](row)
            return None
        if p.is_linear:
            now[name] = steps.put(linear(now[name].select(*p.fields).unionByName(rows)))
            return None
        new = steps.put(absent(rows.distinct(), now[name], list(p.fields)))
        if new.isEmpty():
            return None
        grown = now[name].unionByName(new)
        now[name] = steps.put(grown) if steps.count % 8 == 0 else grown
        return new

    def _uses_linear(self, rule: Rule) -> bool:
        return any(self.predicates[a.predicate].is_linear for a in rule.body)

    def _step(self, now: dict[str, DataFrame], rule: Rule, steps: Steps) -> dict[str, DataFrame] | None:
        """One run of a rule that uses facts up; None if nothing matched, else the new persistent facts."""
        matched, used, made = self.apply(now, rule)
        if steps.put(matched).isEmpty():
            return None
        made = {name: [steps.put(df) for df in dfs] for name, dfs in made.items()}  # heads see the facts before the run
        used = {name: steps.put(ids.distinct()) for name, ids in used.items()}
        for name, ids in used.items():
            self.consumed[name] = self.consumed.get(name, 0) + ids.count()
        for name, dfs in made.items():
            self.proved[name] = self.proved.get(name, 0) + sum(df.count() for df in dfs)
        now.update({name: steps.put(now[name].join(ids, FID, "left_anti")) for name, ids in used.items()})
        fresh = {}
        for name, dfs in sorted(made.items()):
            new = self._absorb(now, name, dfs, steps)
            if new is not None:
                fresh[name] = new
        return fresh
