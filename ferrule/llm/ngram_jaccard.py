"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct five-word shingles (fewer words: the whole sequence as
one; none without words).  Two documents link when 100 * intersection >= 80 * union.

1. Documents with equal sets become one class; only its representative goes on.
2. Representatives with the same minimum hash and about the same size form a group; a
   group that would grow beyond ``GROUP`` members or ``TOKENS`` tokens is split by a hash of
   the class (its load is counted first, so one hot family never meets in one task).
3. The matrix: each group stores the union of its members' tokens, first of the prefix
   tokens alone.  A set's prefix is its n - ceil(0.8 n) + e(n) rarest tokens, where
   e(n) = 1 + n // ``EXTRA``; sets that link share at least e(smaller n) of them, so group
   pairs with fewer common prefix tokens are left out, exactly.  Rarity comes from counters
   over all documents (``CELLS`` of them, a fixed size); any order is right, rare first keeps
   common passages out of the prefixes.
4. Groups that have a partner, or two members, store the union of all their tokens and a
   bit matrix of members by tokens.  For each pair of groups, a member's overlap with the
   other's union bounds its overlap with any member there; only groups with a qualifying
   query are opened, and one matrix product gives all exact overlaps.
5. Links give a forest of edges, never all pairs; components come from contracting it.

Links are counted, so groups of one family of near copies are compared with each other, a
matrix product for each two of them; with groups of GROUP members that is a share of
1 / GROUP^2 of the pairs of documents.  The pairs of groups are dealt out by both groups, and a
token that very many groups hold is a skewed join key that Spark may split.

Tokens are 64-bit hashes of shingles.  Documents without words have component_id = their
own id and no links.  Rows that repeat an id and text are one class; each gets its row, and so
does each text of an id that comes with several.  A row without an id links like any other;
its component_id is null only where no id is in its component.  An empty table gives no rows;
further columns don't matter.  Nothing about all documents is brought to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta

K = 5
NUM, DEN = 80, 100
EXTRA = 10
GROUP, TOKENS = 256, 1 << 17
#: Bits of the map of wanted documents that goes to the scan; a full map passes more rows, loses none.
MAP_BITS = 24
CELL_BITS = 21
CELLS = 1 << CELL_BITS
SLICES = 64
U64 = np.uint64
LINK = U64(0x2545F4914F6CDD1D)


def rarity(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counters of all shingles of all documents on a log scale, one byte each."""
    width = CELLS // SLICES

    def count(batches):
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in ta.chunked(batch, "text"):
                _, h = ta.shingles(ta.words_of(part.column("text")), K)
                cells += np.bincount((h >> U64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS)
        rows = [zlib.compress(np.minimum(cells[i * width : (i + 1) * width], 2**32 - 1).astype("<u4").tobytes(), 1) for i in range(SLICES)]
        spread = int(cells.sum()) % SLICES  # tasks meet in two steps
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([spread] * SLICES, pa.int32()), pa.array(rows, pa.binary())], names=["slice", "part", "cells"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.int64)
        for x in rows.column("cells"):
            total += np.frombuffer(zlib.decompress(x.as_py()), "<u4")
        out = zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)
        return rows.slice(0, 1).select(["slice", "part"]).append_column("cells", pa.array([out], pa.binary()))

    schema = "slice int, part int, cells binary"
    parts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(ta.released(count), schema)
    sums = parts.groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    out = np.zeros(CELLS, dtype=np.float64)
    for r in sums.collect():  # SLICES rows, CELLS counters in all
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(r["cells"]), "<u4")
    return np.minimum(255, 8 * np.log2(1 + out)).astype(np.uint8)


def sorted_sets(texts: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, tokens of each row): distinct tokens, the rarest first in each row."""
    rows, h = ta.shingles(ta.words_of(texts), K)
    rank = ranks[(h >> U64(64 - CELL_BITS)).astype(np.int64)]
    order = np.lexsort((h, rank, rows))
    rows, h = rows[order], h[order]
    if len(h):
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[fresh], h[fresh]
    return rows, h, np.bincount(rows, minlength=len(texts))


def row_sums(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), dtype=U64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[some])
    return out


def summaries(docs: DataFrame, ranks: np.ndarray, text_col: str, id_col: str) -> DataFrame:
    """doc_id, n, the set's 128-bit hash, the group family and the prefix tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def made(texts: pa.Array) -> list[pa.Array]:
        rows, h, n = sorted_sets(texts, shared.value)
        first = np.cumsum(n) - n
        family = np.zeros(len(n), dtype=U64)
        some = n > 0
        if some.any():
            family[some] = np.minimum.reduceat(ta.mix64(h ^ LINK), first[some])
            band = np.floor(np.log(n[some]) / np.log(1.25)).astype(U64)
            family[some] = ta.mix64(family[some] + band * LINK)
        prefix = np.where(some, np.minimum(n, n - -(-NUM * n // DEN) + 1 + n // EXTRA), 0)
        at = np.arange(prefix.sum()) + np.repeat(first - (np.cumsum(prefix) - prefix), prefix)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(prefix))).astype(np.int32)), pa.array(h[at].view(np.int64)))
        longs = [pa.array(x.view(np.int64)) for x in (row_sums(ta.mix64(h), first, n), row_sums(ta.mix64(h ^ LINK), first, n), family)]
        return [pa.array(n.astype(np.int64)), *longs, lists]

    fields = [("n", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("family", T.LongType()), ("prefix", T.ArrayType(T.LongType()))]
    source = docs.select(docs[id_col].alias("doc_id"), *row_key(docs[id_col], docs[text_col]), docs[text_col].cast("string").alias("text"))
    return ta.map_texts(source, made, fields, "text", ["doc_id", "row", "text_hash"])


def row_key(id_, text) -> list:
    """(row, text_hash): what tells a row's text from all others, also where the id is null."""
    hashed = F.xxhash64(text.cast("string"))
    return [F.struct(id_.isNull().alias("anonymous"), F.coalesce(id_.cast("long"), hashed).alias("id")).alias("row"), hashed.alias("text_hash")]


PAYLOAD = "gid long, cids array<long>, sizes array<long>, copies array<long>, tokens binary, bits binary"


def payload_row(gid: int, members: dict[int, tuple[np.ndarray, int]]) -> tuple:
    """A group's union and its bit matrix."""
    cids = sorted(members)
    sets = [members[c][0] for c in cids]
    union = np.unique(np.concatenate(sets))
    bits = np.zeros((len(cids), len(union)), dtype=bool)
    for i, s in enumerate(sets):
        bits[i, np.searchsorted(union, s)] = True
    return gid, cids, [len(s) for s in sets], [members[c][1] for c in cids], union.astype("<u8").tobytes(), np.packbits(bits, axis=1).tobytes()


def only_wanted(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """Texts that may be wanted, by a bit map of fixed size over the rows: fewer rows to shuffle."""
    slot = F.pmod(F.xxhash64("row", "text_hash"), F.lit(1 << MAP_BITS))
    slots = needed.select(slot.alias("slot")).selectExpr("cast(slot div 64 as int) as w", "shiftleft(1L, cast(slot % 64 as int)) as b")
    rows = slots.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)  # as many rows as words at most
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    bits = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
    shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(np.packbits(bits).tobytes(), 1))

    def run(batches):
        wanted = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            slot = batch.column(3).to_numpy()
            on = (wanted[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(on.astype(bool))).columns[:3], names=["row", "text_hash", "text"])

    return texts.withColumn("slot", slot).mapInArrow(ta.released(run), T.StructType(texts.schema.fields))


def payloads(needed: DataFrame, docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``needed``: gid, cid, copies, row, text_hash.  A row for each group, built as its members stream by."""
    texts = only_wanted(docs.select(*row_key(docs[id_col], docs[text_col]), docs[text_col].cast("string").alias("text")), needed)
    rows = needed.join(texts, ["row", "text_hash"]).select("gid", "cid", "copies", "text")
    schema = pa.schema([("gid", pa.int64()), ("cids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("tokens", pa.binary()), ("bits", pa.binary())])

    def build(batches):
        now, members, out, held = None, {}, [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part in ta.chunked(batch, "text"):
                rows, h = ta.shingle_sets(part.column("text"), K)
                n = np.bincount(rows, minlength=part.num_rows)
                first = np.cumsum(n) - n
                gid, cid, copies = (part.column(i).to_numpy() for i in range(3))
                for i in range(part.num_rows):
                    if gid[i] != now:
                        if members:
                            out.append(payload_row(now, members))
                            held += len(out[-1][4]) + len(out[-1][5])
                        now, members = int(gid[i]), {}
                    members[int(cid[i])] = (h[first[i] : first[i] + n[i]].copy(), int(copies[i]))  # again if the row repeats
                    if held > ta.CHUNK_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
        if members:
            out.append(payload_row(now, members))
        if out:
            yield batch_of(out)

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(ta.released(build), PAYLOAD)


def opened(a: dict, b: dict | None) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(links of each member, forest of linked members) between two groups, or inside ``a``."""
    own = b is None
    b = a if own else b
    ta_, tb = np.frombuffer(a["tokens"], "<u8"), np.frombuffer(b["tokens"], "<u8")
    na, nb = np.array(a["sizes"]), np.array(b["sizes"])

    def matrix(x, width):
        return np.unpackbits(np.frombuffer(x["bits"], np.uint8).reshape(len(x["cids"]), -1), axis=1, count=width)

    if own:
        ma = mb = matrix(a, len(ta_)).astype(np.float32)
        rows_a, rows_b = np.arange(len(na)), np.arange(len(nb))
    else:
        _, ia, ib = np.intersect1d(ta_, tb, assume_unique=True, return_indices=True)
        if not len(ia):
            return {}, []
        ma, mb = matrix(a, len(ta_))[:, ia], matrix(b, len(tb))[:, ib]
        # a linked pair shares at least 80 % of the larger set, so of either set
        rows_a = np.flatnonzero(DEN * ma.sum(1, dtype=np.int64) >= NUM * na)
        rows_b = np.flatnonzero(DEN * mb.sum(1, dtype=np.int64) >= NUM * nb)
        if not len(rows_a) or not len(rows_b):
            return {}, []
        ma, mb = ma[rows_a].astype(np.float32), mb[rows_b].astype(np.float32)
    both = np.rint(ma @ mb.T).astype(np.int64)
    linked = DEN * both >= NUM * (na[rows_a][:, None] + nb[rows_b][None, :] - both)
    if own:
        linked &= ~np.eye(len(na), dtype=bool)
    wa, wb = np.array(a["copies"])[rows_a], np.array(b["copies"])[rows_b]
    links: dict[int, int] = {}
    for cids, rows, more in ((a["cids"], rows_a, linked @ wb), *(() if own else ((b["cids"], rows_b, linked.T @ wa),))):
        for r, m in zip(rows.tolist(), more.tolist()):
            if m:
                links[cids[r]] = m
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(linked)):
        x, y = root(a["cids"][rows_a[i]]), root(b["cids"][rows_b[j]])
        if x != y:
            parent[max(x, y)] = min(x, y)
    return links, [(root(x), x) for x in parent if root(x) != x]


def verified(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (a, b, links): an edge a-b where links is null, else a's number of links from one pair of groups."""
    names = ["cids", "sizes", "copies", "tokens", "bits"]

    def side(letter):
        return groups.select(F.col("gid").alias(f"g{letter}"), F.struct(*names).alias(letter))

    joined = pairs.join(side("a"), "ga").join(side("b"), "gb").select("a", "b")
    alone = groups.where(F.size("cids") > 1).select(F.struct(*names).alias("a"))
    both = joined.unionByName(alone, allowMissingColumns=True)

    def run(batches):
        for batch in batches:
            x, y, links = [], [], []
            for at in range(batch.num_rows):
                a, b = (batch.column(i)[at].as_py() for i in (0, 1))
                more, edges = opened(a, b)
                x += [*more, *[e[0] for e in edges]]
                y += [*[None] * len(more), *[e[1] for e in edges]]
                links += [*more.values(), *[None] * len(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x, y, links)], names=["a", "b", "links"])

    return both.mapInArrow(ta.released(run), "a long, b long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, root) of every vertex of ``edges`` (a, b): the same root for all that reach each other.

    Each round hooks every vertex to its least neighbour, follows the hooks until they end at
    roots and contracts the edges; each step is written to the shared folder.  The first round
    compares ids, which settles stars and sorted chains; the others compare hashes that change
    with the round, so half of the vertices or more go on average and rounds are logarithmic.
    """
    steps = ta.Cuts(edges.sparkSession)
    left = steps.put(edges.select("a", "b").distinct(), "edges")
    labels, turn = None, 0
    while not left.isEmpty():  # a round removes one vertex at least from each part with an edge
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, other = (F.xxhash64(c, F.lit(turn)) if turn else F.col(c) for c in "ab")
        hook = ends.groupBy("a").agg(F.min_by("b", other).alias("b"), F.min(other).alias("least"))
        hook = steps.put(hook.select(F.col("a").alias("v"), F.when(F.col("least") < own, F.col("b")).otherwise(F.col("a")).alias("p")), "hooks")
        moving = True
        while moving:  # the distance to the root halves with each hop
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            nearer = steps.put(hook.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "hooks")
            steps.drop(hook)
            hook = nearer
            moving = not hook.where("moved").isEmpty()
        moved = hook.select(F.col("v").alias("root"), F.col("p").alias("to"))
        if labels is None:
            labels = steps.put(hook.select(F.col("v").alias("cid"), F.col("p").alias("root")), "labels")
        else:
            after = steps.put(labels.join(moved, "root", "left").select("cid", F.coalesce("to", "root").alias("root")), "labels")
            steps.drop(labels)
            labels = after
        a, b = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        fewer = left.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        fewer = steps.put(fewer, "edges")
        steps.drop(left, hook)
        left = fewer
        turn += 1
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "cid long, root long")


def join(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (linked documents, copies included), class_id, text_hash and keeper.

    ``keeper`` marks the row (and rows equal to it) that stands for its component: the smallest id's.
    """
    steps = ta.Cuts(df.sparkSession)
    every = steps.put(summaries(df, rarity(df, text_col), text_col, id_col), "summaries")
    first = F.min(F.struct("row", "text_hash")).alias("first")
    classes = every.where("n > 0").groupBy("h1", "h2", "n").agg(first, F.count("*").alias("copies"), F.first("family").alias("family"), F.first("prefix").alias("prefix"))
    classes = steps.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    loads = classes.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    lanes = F.ceil(F.greatest(F.col("members") / F.lit(GROUP * 3 // 4), F.col("tokens") / F.lit(TOKENS * 3 // 4)))
    hot = steps.put(loads.withColumn("lanes", lanes).where("lanes > 1").select("family", "lanes"), "hot")
    placed = classes.join(hot, "family", "left").withColumn("gid", F.xxhash64("family", F.pmod(F.xxhash64("cid"), F.coalesce("lanes", F.lit(1)))))
    placed = steps.put(placed.select("gid", "cid", "n", "copies", "first", "prefix"), "placed")
    tokens = (
        placed.groupBy("gid")
        .agg(F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"))
        .select("gid", "least", "most", F.explode("tokens").alias("token"))
    )
    a, b = (tokens.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("gid", "least", "most")]) for x in "ab")
    near = (F.col("gid_a") < F.col("gid_b")) & (DEN * F.col("most_a") >= NUM * F.col("least_b")) & (DEN * F.col("most_b") >= NUM * F.col("least_a"))
    met = a.hint("merge").join(b, "token").where(near).groupBy(F.col("gid_a").alias("ga"), F.col("gid_b").alias("gb"))
    shared = met.agg(F.count("*").alias("shared"), F.min(F.least("least_a", "least_b")).alias("least"))
    pairs = steps.put(shared.where(F.col("shared") >= 1 + F.floor(F.col("least") / EXTRA)).select("ga", "gb"), "pairs")
    many = placed.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select("gid")
    wanted = pairs.select(F.col("ga").alias("gid")).unionByName(pairs.select(F.col("gb").alias("gid"))).unionByName(many).distinct()
    needed = placed.select("gid", "cid", "copies", "first.row", "first.text_hash").join(wanted, "gid")
    groups = steps.put(payloads(needed, df, text_col, id_col), "groups")
    links = steps.put(verified(pairs, groups), "links")
    steps.drop(groups, pairs, placed, hot)
    joined = components(links.where(F.col("links").isNull()).select("a", "b"))
    degree = links.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("more"))
    named = classes.join(joined, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").join(degree, "cid", "left").select("h1", "h2", "n", "first", "component", "copies", "more")
    out = every.select("doc_id", "row", "text_hash", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    id_of = lambda c: F.when(~F.col(c)["row"]["anonymous"], F.col(c)["row"]["id"])
    linked = F.col("first").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, id_of("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.coalesce("more", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, id_of("first")).otherwise(F.col("doc_id")).alias("class_id"),
        "text_hash",
        (~linked | (F.col("component") == F.struct("row", "text_hash"))).alias("keeper"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(ta.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


ORACLE = """
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from t),
e as (select doc_id, unnest(g) as g from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
k as (select a, b from o join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
d as (select a, b from k union all select b, a from k),
r as (select doc_id as v, doc_id as c from s union select d.b, r.c from r join d on d.a = r.v)
select s.doc_id, len(g)::bigint as n_shingles, (select min(c) from r where r.v = s.doc_id) as component_id,
  (select count(*) from d where d.a = s.doc_id)::bigint as n_links,
  (select min(y.doc_id) from s y where list_sort(y.g) = list_sort(s.g) and (len(s.g) > 0 or y.doc_id = s.doc_id)) as class_id
from s
"""
