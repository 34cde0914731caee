"""Benchmark decontamination: SimHash of item-sized windows, verified exactly.

For each benchmark item, every window of a document with as many words as the item (the
whole document, if it is shorter) is a candidate.  A window's shingles are its runs of five
words; an item of fewer words is one shingle, its whole sequence.  The similarity of a
window and an item is the weighted Jaccard of their shingles, a shingle weighing as often
as it occurs; a leak is a window of at least ``THRESHOLD``.

Windows without any shingle of an item have similarity 0 and are passed over before they
get a fingerprint; that loses nothing.  The others get a 64-bit SimHash over their weighted
shingles.  Fingerprints are looked up in a multi-index of ``BLOCKS`` blocks: if two differ
in at most ``RADIUS`` bits, some block differs in at most RADIUS / BLOCKS, so each block's
buckets list an item under every value within that distance, and the buckets of a window's
blocks hold all items within the radius.  The radius is 3.6 standard deviations beyond what a
window at the threshold differs in; the README has the leaks counted without a radius.
Candidates are then verified by the exact similarity.

Items are broadcast in blocks of at most about ``ITEMS`` items, whatever their number.  A null or empty
text or item leaks nothing.  Repeated rows of either table give repeated results; of windows
that tie, the first counts.  An empty table on either side gives no rows, and further columns of
either table don't matter.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta

K = 5
THRESHOLD = 0.8
BLOCKS = 8
RADIUS = 20
ITEMS = 4096
U64 = np.uint64


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words of one sequence."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    acc = np.zeros(n, dtype=U64)
    for j in range(k):
        acc += hashes[j : j + n] * ta.factor(j)
    return ta.mix64(acc + U64(k))


def bit_sums(g: np.ndarray) -> np.ndarray:
    """Running sums of the bits of each hash, one more row than hashes."""
    bits = np.unpackbits(g.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(g) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each window, as eight bytes."""
    ones = sums[ends] - sums[starts]
    return np.packbits(2 * ones > (ends - starts)[:, None], axis=1)


POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


class Items:
    """The items of a block, by their length in words."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = ta.words_of(pa.array(texts, pa.string()))
        first = np.concatenate(([0], np.cumsum(w.counts)))
        self.ids = ids
        self.size = w.counts
        self.grams: list[np.ndarray] = []
        self.counts: list[dict[int, int]] = []
        prints = np.zeros((len(ids), BLOCKS), dtype=np.uint8)
        of: dict[int, set[int]] = defaultdict(set)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in range(len(ids)):
            h = w.hashes[first[i] : first[i + 1]]
            g = grams(h, min(K, len(h))) if len(h) else np.zeros(0, dtype=U64)
            self.grams.append(g)
            values, times = np.unique(g, return_counts=True)
            self.counts.append(dict(zip(values.tolist(), times.tolist())))
            if len(h) >= K:
                prints[i] = fingerprints(bit_sums(g), np.array([0]), np.array([len(g)]))[0]
                for x in values.tolist():
                    of[x].add(i)
            elif len(h):
                self.short[len(h)][int(g[0])].append(i)
        self.prints = prints
        self.keys = np.array(sorted(of), dtype=U64)
        self.owners = [sorted(of[int(x)]) for x in self.keys]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.keys >> U64(42)] = True
        near = [np.flatnonzero(POPCOUNT[np.arange(256) ^ v] <= RADIUS // BLOCKS) for v in range(256)]
        # for each length and block: the items of each value's bucket, one bucket after the other, and where each begins
        self.buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in np.unique(self.size[self.size >= K]):
            at = np.flatnonzero(self.size == n)
            index = []
            for b in range(BLOCKS):
                values = [near[v] for v in prints[at, b]]
                value, item = np.concatenate(values), np.repeat(at, [len(v) for v in values])
                order = np.argsort(value, kind="stable")
                index.append((item[order], np.searchsorted(value[order], np.arange(257))))
            self.buckets[int(n)] = index

    def candidates(self, n: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) within the radius, by the buckets of the windows' blocks."""
        found = []
        for b, (items, first) in enumerate(self.buckets[n]):
            lo, size = first[prints[:, b]], np.diff(first)[prints[:, b]]
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            found.append(np.repeat(np.arange(len(prints)), size) * len(self.ids) + items[at])
        rows, cols = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        far = POPCOUNT[prints[rows] ^ self.prints[cols]].sum(1, dtype=np.int32)
        ok = far <= RADIUS
        return list(zip(rows[ok].tolist(), cols[ok].tolist()))

    def similarity(self, item: int, window: np.ndarray) -> float:
        values, times = np.unique(window, return_counts=True)
        have = self.counts[item]
        common = sum(min(have.get(v, 0), t) for v, t in zip(values.tolist(), times.tolist()))
        return common / (len(self.grams[item]) + len(window) - common)

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, word after the last, similarity): the best, then first window of each."""
        w = ta.words_of(texts)
        first = np.concatenate(([0], np.cumsum(w.counts)))
        out = []
        for k, wanted in self.short.items():
            g = grams(w.hashes, k)
            keys = np.array(sorted(wanted), dtype=U64)
            seen = set()
            for p in np.flatnonzero(np.isin(g, keys)).tolist():
                row = int(w.doc[p])
                if w.doc[p + k - 1] == row:
                    for item in wanted[int(g[p])]:
                        if (row, item) not in seen:
                            seen.add((row, item))
                            out.append((row, item, int(p - first[row]), int(p - first[row] + k), 1.0))
        if not len(self.keys):
            return out
        g = grams(w.hashes, K)
        hit = np.flatnonzero(self.maybe[g >> U64(42)])
        at = np.minimum(np.searchsorted(self.keys, g[hit]), len(self.keys) - 1)
        good = (self.keys[at] == g[hit]) & (w.doc[hit] == w.doc[hit + K - 1]) if len(hit) else np.zeros(0, dtype=bool)
        hit, at = hit[good], at[good]
        rows = w.doc[hit]
        for lo, hi in zip(np.flatnonzero(np.diff(rows, prepend=-1)), np.append(np.flatnonzero(np.diff(rows)) + 1, len(rows))):
            row = int(rows[lo])
            out += self.in_text(row, w.hashes[first[row] : first[row + 1]], hit[lo:hi] - first[row], at[lo:hi])
        return out

    def in_text(self, row: int, hashes: np.ndarray, places: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        n = len(hashes)
        lengths: dict[int, list[np.ndarray]] = defaultdict(list)
        for place, key in zip(places.tolist(), keys.tolist()):
            for size in {int(self.size[i]) for i in self.owners[key]}:
                lengths[size].append(np.arange(max(0, min(place - size + K, n - size)), max(0, min(place, n - size)) + 1))
        g = grams(hashes, K)
        sums = bit_sums(g)
        best: dict[int, tuple[float, int, int]] = {}
        for size, starts in lengths.items():
            begin = np.unique(np.concatenate(starts))
            wide = min(size, n) - K + 1
            prints = fingerprints(sums, begin, begin + wide)
            for window, item in self.candidates(size, prints):
                s = int(begin[window])
                same = self.similarity(item, g[s : s + wide])
                if same >= THRESHOLD and (item not in best or same > best[item][0]):
                    best[item] = (same, s, s + min(size, n))
        return [(row, item, s, e, same) for item, (same, s, e) in best.items()]


FIELDS = [("start_word", T.IntegerType()), ("end_word", T.IntegerType()), ("similarity", T.DoubleType())]


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: id, item_id, word span and similarity."""
    ta.bounded_batches(df.sparkSession)
    known = benchmark.where("text is not null").groupBy("item_id", F.col("text").cast("string").alias("text")).agg(F.count("*").alias("times"))
    blocks = max(1, -(-known.count() // ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    source = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], benchmark.schema["item_id"], *[T.StructField(n, t) for n, t in FIELDS]])
    found = None
    for b in range(blocks):
        got = known.where(block == b).orderBy("item_id", "text").toArrow()  # about ITEMS items
        shared = df.sparkSession.sparkContext.broadcast((got.column(0).combine_chunks(), got.column(1).to_pylist(), got.column(2).to_pylist()))

        def run(batches, shared=shared):
            ids, texts, times = shared.value
            items = Items(list(range(len(texts))), texts)
            for batch in batches:
                for part in ta.chunked(batch, "text"):
                    rows = [row for row in items.leaks(part.column("text")) for _ in range(times[row[1]])]
                    if rows:
                        r, i, s, e, same = (np.array(x) for x in zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(r)), ids.take(pa.array(i)), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(same, pa.float64())],
                            names=schema.names,
                        )

        made = source.mapInArrow(ta.released(run), schema)
        found = made if found is None else found.unionByName(made)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(ta.table(spark, sf_dir, "documents"), ta.table(spark, sf_dir, "benchmark"))
