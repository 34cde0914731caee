"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

The ids are those of a fixed public byte-level vocabulary, word by word over the folded
text, with one end id.  The ``HEADS`` most frequent ids are classes of their own, the others
fall into bands of equal mass; attention predicts the class of the next id from the ids
before it, and an id's share of its class, given the class of the id before, comes from
counts over the whole training corpus.  So do the classes: a first pass counts all ids, a
second one which class follows which embedded id.  The weights start as the model of these
counts without attention; a third pass trains them in each task on every window of every
training text, once each, and averages them by how much each task trained.  Small corpora are passed
``ROUNDS`` times at most.  Nothing is learned from a sample.  The model's probability of a text is
the product over all its ids.

Scoring cuts a text's ids into windows of ``WINDOW`` that overlap by ``OVERLAP``: the first
scores all its ids, each later one only those after its overlap, so every id is scored
once with at least OVERLAP ids of context where the text has them.  Windows of many texts
go through masked attention in one batch.

The base score is an add-half unigram over words.  Counts of all words of the training
documents are gathered by shuffle; the most frequent travel to the tasks, ``FREQUENT`` at most (a
fixed bound), and all the others are joined by shuffle, so no vocabulary is cut off.

Texts are encoded once: the ids are written beside them in the shared folder, and all passes
read them there.

Null and empty texts consist of the end alone.  Without training documents every count is
0 and ids are equally likely.  Repeated rows get equal scores, one row each; an empty table
gives no rows, ties of frequency go to the lower id, and further columns of the table
don't matter.  A null in the training column means no.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .bpe import load_ranks, pattern, vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
HEADS, BANDS = 72, 24
CLASSES = HEADS + BANDS
EMBEDDED = 2048
WIDTH = 16
WINDOW, OVERLAP = 32, 8
FREQUENT = 1 << 19
ROWS = EMBEDDED + CLASSES
#: Weight of an id's share without context against its counts after a class.
PRIOR = 10.0
#: Nothing is learned from a sample; the name stays for a test that sets it and finds no difference.
SAMPLE = None
STEPS, START_STEPS = 1000, 300
#: Every task takes a step for so many ids of its texts, over all windows that end among them.
IDS_A_STEP = 1 << 12
#: The corpus is passed again until so many ids have been trained on, ROUNDS times at most.
LEAST_IDS, ROUNDS = 1 << 22, 8
BATCH, SCORED = 64, 128
RATE, TASK_RATE = 0.02, 0.002
#: Summed weights are whole numbers, so their sum is the same in any order.
FIXED = 1 << 20
REMEMBER, REMEMBER_BYTES = 400_000, 8 << 20
END_WORD = np.uint64(0xE5D0E5D0E5D0E5D0)
U64 = np.uint64


class Subwords:
    """Ids of distinct words, kept for the tasks of one worker."""

    def __init__(self, path: str):
        import tiktoken

        ranks = load_ranks(path)
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known, self.number = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)  # hashes in order, and the word of each
        self.held = 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = self.lens = np.zeros(0, dtype=np.int64)

    def numbers(self, hashes: np.ndarray, words: ta.Words, first: np.ndarray) -> np.ndarray:
        """Number of each distinct word, by ascending hash (``first``: where it stands first); new ones are encoded."""
        at = np.searchsorted(self.known, hashes)
        fresh = np.flatnonzero((at == len(self.known)) | (np.append(self.known, U64(0))[at] != hashes))
        if len(self.known) + len(fresh) > REMEMBER or self.held > REMEMBER_BYTES:
            self.forget()
            fresh, at = np.arange(len(hashes)), np.zeros(len(hashes), dtype=np.int64)
        if len(fresh):
            data, lo, hi = words.data.tobytes(), words.starts[first[fresh]], words.ends[first[fresh]]
            flat, lens = self.encoded([data[i:j].decode("utf-8", "replace") for i, j in zip(lo.tolist(), hi.tolist())])
            self.number = np.insert(self.number, at[fresh], len(self.known) + np.arange(len(fresh)))
            self.known = np.insert(self.known, at[fresh], hashes[fresh])
            self.held += int((hi - lo).sum())
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
            self.lens = np.concatenate((self.lens, lens))
            self.flat = np.concatenate((self.flat, flat))
        return self.number[np.searchsorted(self.known, hashes)]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words behind a blank, ids of each): a line break, which no word has, stands between them."""
        ids = np.array(self.encoding.encode_ordinary(" " + "\n ".join(words) + "\n"), dtype=np.int32)
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(words):  # an odd space at a word's end has met the line break
            made = [self.encoding.encode_ordinary(f" {w}\n") for w in words]
            made = [m[:-1] if m[-1] == self.line else m for m in made]
            return np.fromiter((x for m in made for x in m), np.int32), np.array([len(m) for m in made], dtype=np.int64)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def streams(self, words: ta.Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with an end after each row, ids of each row)."""
        lens = self.lens[number]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[number] - (ends - lens), lens)
        sizes = np.bincount(words.doc, weights=lens, minlength=len(words.counts)).astype(np.int64)
        stops = np.cumsum(sizes)
        return np.insert(self.flat[at], stops, self.end), sizes + 1


_SUBWORDS: dict[str, Subwords] = {}


def subwords_for(path: str | None) -> Subwords:
    """The worker's subwords (default: the public vocabulary, looked up in the worker)."""
    path = path or vocabulary_path(VOCABULARY)
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


class Layout(NamedTuple):
    classes: np.ndarray  # of each id
    embedded: np.ndarray  # embedding row of each id; ids beyond the first EMBEDDED share a row a class


class Model(NamedTuple):
    layout: Layout
    after: np.ndarray  # log10 share of each row in its class, after each class
    inner: np.ndarray  # log10 share of each id in its row
    weights: dict[str, np.ndarray]


def layout(counts: np.ndarray) -> Layout:
    """Classes and embedding rows by frequency."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    smooth = counts[order] + 0.5
    classes = np.zeros(len(counts), dtype=np.int64)
    heads = min(HEADS, len(counts))
    classes[order[:heads]] = np.arange(heads)
    rest = smooth[heads:]
    if len(rest):
        mass = np.cumsum(rest) - rest
        classes[order[heads:]] = heads + np.minimum(BANDS - 1, (mass / rest.sum() * BANDS).astype(np.int64))
    embedded = EMBEDDED + classes
    top = order[: min(EMBEDDED, len(order))]
    embedded[top] = np.arange(len(top))
    return Layout(classes, embedded)


def shares(at: Layout, ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``after``, ``inner``) of a model from the counts of ids and of (class before, row)."""
    own = ids + 0.5
    by_row = np.bincount(at.embedded, weights=own, minlength=ROWS)
    inner = np.log10(own / by_row[at.embedded])
    class_of = np.zeros(ROWS, dtype=np.int64)
    class_of[at.embedded] = at.classes
    used = by_row > 0
    by_class = np.bincount(class_of[used], weights=by_row[used], minlength=CLASSES)
    plain = np.where(used, by_row / np.maximum(by_class[class_of], 1e-300), 0)
    seen = np.zeros((CLASSES, CLASSES))
    for c in range(CLASSES):
        seen[:, c] = pairs[:, used & (class_of == c)].sum(1)
    after = (pairs + PRIOR * plain) / (seen[:, class_of] + PRIOR)
    return np.log10(np.maximum(after, 1e-300)).astype(np.float32), inner.astype(np.float32)


def classes_before(at: Layout, ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Class of the id before each id; a text starts after an end."""
    before = np.concatenate(([0], at.classes[ids][:-1])) if len(ids) else np.zeros(0, dtype=np.int64)
    before[np.cumsum(sizes) - sizes] = at.classes[end]
    return before


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over windows of the products of their rows."""
    return (a.transpose(0, 2, 1) @ b).sum(0)


CAUSAL = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
#: Sums over rows are products with these, which is faster than a reduction over a short axis.
ONES = {n: np.ones(n, dtype=np.float32) for n in (1, WINDOW, CLASSES)}


def exponents(z: np.ndarray, bound: float, most: np.floating) -> None:
    """exp in place; beyond the bound values are clipped, which is left out where ``most`` says that none can be there."""
    if not most <= bound:
        np.clip(z, -bound, bound, out=z)
    np.exp(z, out=z)


def longest(x: np.ndarray) -> np.floating:
    """Length of the longest vector along the last axis."""
    return np.sqrt(np.einsum("...d,...d->...", x, x).max(initial=0))


def attend(w: dict[str, np.ndarray], tokens: np.ndarray, skip: int = 0) -> tuple[np.ndarray, tuple]:
    """Hidden states of windows of embedding rows, without the first ``skip`` of each; masked causal attention with a residual."""
    x = w["emb"].take(tokens, axis=0)
    x += w["pos"]
    # one product for all windows, not one for each
    qkv = (x.reshape(-1, WIDTH) @ np.concatenate((w["q"], w["k"], w["v"]), axis=1)).reshape(*tokens.shape, 3 * WIDTH)
    q, k, v = (qkv[..., i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    q = q[:, skip:]
    a = q @ k.transpose(0, 2, 1)
    exponents(a, 40.0, longest(q) * longest(k))
    a *= CAUSAL[skip:]
    share = (1 / (a.reshape(-1, WINDOW) @ ONES[WINDOW])).reshape(*q.shape[:2], 1)
    c = a @ v
    c *= share
    h = (c.reshape(-1, WIDTH) @ w["o"]).reshape(c.shape)
    h += x[:, skip:]
    return h, (x, q, k, v, a, share, c)


def class_exponents(w: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden states with a one behind each, exp of their classes' logits, sums of these)."""
    more = np.column_stack((h, ONES[1].repeat(len(h))))
    z = more @ np.vstack((w["out"], w["bias"]))
    exponents(z, 60.0, longest(h) * longest(w["out"].T) + np.abs(w["bias"]).max())
    return more, z, z @ ONES[CLASSES]


SHAPES = {"emb": (ROWS + 1, WIDTH), "pos": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}


class Adam:
    """Adam on the class cross-entropy of windows (target -1: not scored)."""

    def __init__(self, w: dict[str, np.ndarray], rate: float = RATE):
        self.w, self.rate, self.steps = dict(w), rate, 0
        self.m, self.r = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
        self.met = np.zeros(ROWS + 1, dtype=np.int64)  # how many scored ids each embedding row stood before

    def step(self, t: np.ndarray, y: np.ndarray) -> None:
        self.met += np.bincount(t[y >= 0], minlength=ROWS + 1)
        w = self.w
        self.steps += 1
        h, (x, q, k, v, a, share, c) = attend(w, t)
        flat = lambda x: x.reshape(-1, x.shape[-1])
        y = y.ravel()
        on = np.flatnonzero(y >= 0)
        more, e, total = class_exponents(w, flat(h))
        # the gradient of a row of logits is e - total at its class, by 1 / total: products take it so, not a pass over all of them
        e.ravel()[on * CLASSES + y[on]] -= total[on]
        part = np.where(y >= 0, np.float32(1 / max(1, len(on))) / total, np.float32(0))[:, None]
        more *= part
        both = product(more.reshape(*t.shape, -1), e.reshape(*t.shape, -1))
        g = {"out": both[:-1], "bias": both[-1]}
        dh = e @ w["out"].T
        dh *= part
        g["o"] = product(c, dh.reshape(h.shape))
        dc = (dh @ w["o"].T).reshape(h.shape)
        dc *= share
        ds = dc @ v.transpose(0, 2, 1)
        ds -= np.einsum("nid,nid->ni", dc, c)[..., None]
        ds *= a
        d = np.empty((*t.shape, 3 * WIDTH), dtype=np.float32)
        np.matmul(ds, k, out=d[..., :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[..., WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dc, out=d[..., 2 * WIDTH :])
        g |= zip("qkv", np.split(product(x, d), 3, axis=1))
        dx = flat(d) @ np.concatenate((w["q"], w["k"], w["v"]), axis=1).T
        dx += dh
        g["pos"] = dx.reshape(h.shape).sum(0)
        cell = (t.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        g["emb"] = np.bincount(cell, weights=dx.ravel(), minlength=w["emb"].size).reshape(w["emb"].shape).astype(np.float32)
        self.follow(g)

    def follow(self, g: dict[str, np.ndarray]) -> None:
        """One step along the gradients."""
        slow, fast = 1 - 0.99**self.steps, 1 - 0.9**self.steps
        for n, d in g.items():
            m, r = self.m[n], self.r[n]
            m *= 0.9
            m += 0.1 * d
            r *= 0.99
            r += 0.01 * d * d
            by = np.sqrt(r / slow)
            by += 1e-8
            self.w[n] = self.w[n] - (self.rate / fast) * m / by


def train_weights(tokens: np.ndarray, targets: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights after ``steps`` batches of the windows; ``counts`` of the classes give the first bias."""
    rng = np.random.default_rng(seed)
    w = {n: (rng.standard_normal(s) * (0.3 if n == "emb" else 0.1)).astype(np.float32) for n, s in SHAPES.items() if n != "bias"}
    w["bias"] = np.log((counts + 1.0) / (counts + 1.0).sum()).astype(np.float32)
    if not len(tokens):
        return w
    adam = Adam(w)
    for _ in range(steps):
        pick = rng.integers(0, len(tokens), BATCH)
        adam.step(tokens[pick], targets[pick])
    return adam.w


def start_weights(at: Layout, ids: np.ndarray, follow: np.ndarray) -> dict[str, np.ndarray]:
    """The weights without attention that fit the counts of ids and of (row before, class), gathered over all training texts."""
    seen = np.bincount(at.classes, weights=ids, minlength=CLASSES)
    w = fit_weights(at, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), ids)
    w["o"], w["pos"] = np.zeros_like(w["o"]), np.zeros_like(w["pos"])
    adam = Adam(w)
    aim = follow + PRIOR * (seen + 1.0) / (seen + 1.0).sum()
    much = aim.sum(1, keepdims=True)
    aim, much = ((x / much.sum()).astype(np.float32) for x in (aim, much))
    for _ in range(START_STEPS):
        w = adam.w
        adam.steps += 1
        dz = w["emb"] @ w["out"]
        dz += w["bias"]
        np.exp(np.clip(dz, -60.0, 60.0, out=dz), out=dz)
        dz *= much / (dz @ ONES[CLASSES])[:, None]
        dz -= aim
        adam.follow({"emb": dz @ w["out"].T, "out": w["emb"].T @ dz, "bias": dz.sum(0)})
    return adam.w


def windows(sizes: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first id, ids, first scored id) of each window of texts with so many ids."""
    new = WINDOW - overlap
    count = np.where(sizes <= WINDOW, 1, 1 + -(-(sizes - WINDOW) // new))
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = nth * new
    return row, begin, np.minimum(WINDOW, sizes[row] - begin), np.where(nth > 0, overlap, 0)


def window_arrays(at_: Layout, ids: np.ndarray, sizes: np.ndarray, lo: int, hi: int, cut: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows before each id, and the classes to predict (-1: not scored here)."""
    row, begin, length, skip = (x[lo:hi] for x in cut)
    first = np.cumsum(sizes) - sizes
    col = np.arange(WINDOW)
    at = np.minimum((first[row] + begin)[:, None] + col, len(ids) - 1)
    before = np.where((begin[:, None] + col) > 0, at_.embedded[ids[np.maximum(at - 1, 0)]], ROWS)
    on = (col < length[:, None]) & (col >= skip[:, None])
    return before, np.where(on, at_.classes[ids[at]], -1)


def score_ids(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each row's ids."""
    shape = model.layout
    inside = model.after[classes_before(shape, ids, sizes, len(shape.classes) - 1), shape.embedded[ids]] + model.inner[ids]
    out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=inside, minlength=len(sizes))
    cut = windows(sizes)
    w = model.weights
    for skip in (0, OVERLAP):  # first windows score all their ids, later ones those after the overlap
        some = np.flatnonzero(cut[3] == skip)
        for lo in range(0, len(some), SCORED):
            part = tuple(x[some[lo : lo + SCORED]] for x in cut)
            before, y = window_arrays(shape, ids, sizes, 0, SCORED, part)
            y = y[:, skip:].ravel()
            _, e, total = class_exponents(w, attend(w, before, skip)[0].reshape(-1, WIDTH))
            picked = np.log(e.ravel()[np.arange(len(e)) * CLASSES + np.maximum(y, 0)].astype(np.float64) / total)
            picked[y < 0] = 0
            out += np.bincount(part[0], weights=picked.reshape(len(part[0]), -1).sum(1), minlength=len(sizes)) / np.log(10)
    return out


def emit(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"])


def encode(df: DataFrame, path: str | None, text_col: str, id_col: str, learn) -> DataFrame:
    """doc_id, learn, text and ids (bytes of whole numbers) of every row."""

    def make():
        subwords = subwords_for(path)

        def run(texts: pa.Array) -> list[pa.Array]:
            w = ta.words_of(texts)
            keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            stream, sizes = subwords.streams(w, subwords.numbers(keys, w, first)[inverse])
            data = stream.astype(subwords.kind)
            bounds = np.concatenate(([0], np.cumsum(sizes) * data.itemsize)).astype(np.int32)
            return [pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])]

        return run

    source = df.select(df[id_col].alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), df[text_col].cast("string").alias("text"))
    return ta.map_texts(source, make, [("ids", T.BinaryType())], "text", factory=True)


def id_streams(column: pa.BinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, ids of each row)."""
    offsets, raw = ta.buffers(column)
    return raw.view(kind).astype(np.int64), np.diff(offsets) // np.dtype(kind).itemsize


def corpus_counts(train: DataFrame, path: str | None) -> DataFrame:
    """(kind, key, n) over all training texts: words by hash (kind 0) and subword ids (1)."""

    def run(batches):
        subwords = subwords_for(path)
        ids = np.zeros(subwords.size, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            for part in ta.chunked(batch, "text"):
                w = ta.words_of(part.column("text"))
                keys, counts = np.unique(w.hashes, return_counts=True)
                ids += np.bincount(id_streams(part.column("ids"), subwords.kind)[0], minlength=subwords.size)
                held += [(keys, counts), (np.array([END_WORD]), np.array([part.num_rows]))]
                if sum(len(k) for k, _ in held) > 1 << 19:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 18:
                        yield emit(0, *held.pop())
        if held:
            yield emit(0, *merged())
        some = np.flatnonzero(ids)
        yield emit(1, some, ids[some])

    ta.bounded_batches(train.sparkSession)
    return train.select("text", "ids").mapInArrow(ta.released(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def masses(met: np.ndarray, steps: int) -> np.ndarray:
    """What each weight, in the order of SHAPES, counts for in the average."""
    return np.concatenate([np.repeat(met, WIDTH) if n == "emb" else np.full(int(np.prod(s)), steps) for n, s in SHAPES.items()])


def corpus_follow(train: DataFrame, shape: Layout, path: str | None) -> DataFrame:
    """(kind, key, n) over all training texts: pairs of the row before and the class (kind 5)."""
    shared = train.sparkSession.sparkContext.broadcast(shape)

    def run(batches):
        shape, kind = shared.value, subwords_for(path).kind
        pairs = np.zeros((ROWS + 1) * CLASSES, dtype=np.int64)
        for batch in batches:
            for part in ta.chunked(batch, "ids"):
                stream, sizes = id_streams(part.column("ids"), kind)
                before = np.concatenate(([0], shape.embedded[stream][:-1]))
                before[np.cumsum(sizes) - sizes] = ROWS
                pairs += np.bincount(before * CLASSES + shape.classes[stream], minlength=len(pairs))
        some = np.flatnonzero(pairs)
        yield emit(5, some, pairs[some])

    ta.bounded_batches(train.sparkSession)
    return train.select("ids").mapInArrow(ta.released(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def corpus_pass(train: DataFrame, shape: Layout, start: dict[str, np.ndarray], path: str | None) -> DataFrame:
    """(kind, key, n) over all training texts: class-row pairs (kind 2), summed weights (3) and training done (4).

    Each id is trained on once, in the one window without overlap that holds it.
    """
    shared = train.sparkSession.sparkContext.broadcast((shape, start))

    def run(batches):
        shape, start = shared.value
        end, kind = len(shape.classes) - 1, subwords_for(path).kind
        pairs = np.zeros(CLASSES * ROWS, dtype=np.int64)
        adam, rng, met = Adam(start, TASK_RATE), np.random.default_rng(5), 0
        held, due = None, 0  # windows of the step that is not full yet, and its number
        for batch in batches:
            for part in ta.chunked(batch, "ids"):
                stream, sizes = id_streams(part.column("ids"), kind)
                pairs += np.bincount(classes_before(shape, stream, sizes, end) * ROWS + shape.embedded[stream], minlength=CLASSES * ROWS)
                cut = windows(sizes, 0)
                order = rng.permutation(len(cut[0]))
                cut = tuple(x[order] for x in cut)
                step = (met + np.cumsum(cut[2]) - 1) // IDS_A_STEP
                met += len(stream)
                begin = np.flatnonzero(np.diff(step, prepend=-1))
                for lo, hi in zip(begin, np.append(begin[1:], len(step))):
                    made = window_arrays(shape, stream, sizes, lo, hi, cut)
                    if held and step[lo] == due:
                        made = tuple(np.concatenate(x) for x in zip(held, made))
                    elif held:
                        adam.step(*held)
                    held, due = made, step[lo]
        if held:
            adam.step(*held)
        flat = np.concatenate([adam.w[n].ravel() for n in SHAPES]).astype(np.float64)
        done = np.append(adam.met, adam.steps)
        for kind, counts in ((2, pairs), (3, np.rint(flat * masses(adam.met, adam.steps) * FIXED).astype(np.int64)), (4, done)):
            some = np.flatnonzero(counts)
            yield emit(kind, some, counts[some])

    ta.bounded_batches(train.sparkSession)
    return train.select("ids").mapInArrow(ta.released(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def averaged(start: dict[str, np.ndarray], sums: np.ndarray, done: np.ndarray) -> dict[str, np.ndarray]:
    """Mean of the tasks' weights; an embedding row that none trained stays as it started."""
    mass = masses(done[:-1], done[-1])
    flat = np.where(mass > 0, sums / (FIXED * np.maximum(mass, 1)), np.concatenate([start[n].ravel() for n in SHAPES])).astype(np.float32)
    stops = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {n: x.reshape(s) for (n, s), x in zip(SHAPES.items(), np.split(flat, stops[:-1]))}


def fit_weights(shape: Layout, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights from the windows of texts; ``counts`` of all ids, where they are more than these, give the bias."""
    cut = windows(sizes)
    tokens, targets = window_arrays(shape, ids, sizes, 0, len(cut[0]), cut) if len(ids) else (np.zeros((0, WINDOW), np.int64),) * 2
    seen = np.bincount(shape.classes[ids], minlength=CLASSES) if counts is None else np.bincount(shape.classes, weights=counts, minlength=CLASSES)
    return train_weights(tokens, targets, seen.astype(float))


def score(df: DataFrame, learn, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``df``; rows where ``learn`` holds train."""
    spark = df.sparkSession
    vocabulary = max(load_ranks(path or vocabulary_path(VOCABULARY)).values()) + 2
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    encoded = ta.cut(encode(df, path, text_col, id_col, learn), "encoded")
    train = encoded.where("learn")
    counts = ta.cut(corpus_counts(train, path), "counts")
    words = counts.where("kind = 0").select("key", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    tables = {1: np.zeros(vocabulary), 2: np.zeros(CLASSES * ROWS), 3: np.zeros(sum(int(np.prod(x)) for x in SHAPES.values())), 4: np.zeros(ROWS + 2), 5: np.zeros((ROWS + 1) * CLASSES)}

    def fill(got):
        kind, key, many = (got.column(c).to_numpy() for c in ("kind", "key", "n"))
        for k, table in tables.items():
            table[key[kind == k]] = many[kind == k]

    fill(counts.where("kind > 0").toArrow())  # rows for the ids of the vocabulary at most
    shape = layout(tables[1])
    fill(corpus_follow(train, shape, path).toArrow())  # rows for pairs of row and class at most
    weights = start_weights(shape, tables[1], tables[5].reshape(ROWS + 1, CLASSES))
    read = int(tables[1].sum())
    for _ in range(min(ROUNDS, -(-LEAST_IDS // read)) if read else 1):
        tables[3][:], tables[4][:] = 0, 0
        fill(corpus_pass(train, shape, weights, path).toArrow())  # rows for pairs of class and row and for weights at most
        weights = averaged(weights, tables[3], tables[4])
    model = Model(shape, *shares(shape, tables[1], tables[2].reshape(CLASSES, ROWS)), weights)
    # words from a count on travel, the count so chosen that they are FREQUENT at most: no task orders them all
    step = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True):  # a few hundred steps
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["s"]
    top = words.where(step >= least).toArrow()
    keys, freq = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    over = n + 0.5 * (v + 1)
    shared = spark.sparkContext.broadcast((keys[order], freq[order], model))
    complete = v <= FREQUENT

    def run(batches):
        keys, freq, model = shared.value
        logs = np.log10((freq + 0.5) / over) if len(freq) else np.zeros(0)
        unseen = np.log10(0.5 / over)
        for batch in batches:
            for part in ta.chunked(batch, "text"):
                w = ta.words_of(part.column("text"))
                rows = part.num_rows
                mine, inverse = np.unique(w.hashes, return_inverse=True)
                mine = np.append(mine, END_WORD)
                at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                hit = keys[at] == mine if len(keys) else np.zeros(len(mine), dtype=bool)
                value = np.where(hit, logs[at] if len(logs) else 0.0, unseen)
                base = np.bincount(w.doc, weights=value[inverse], minlength=rows) + value[-1]
                known = np.bincount(w.doc, weights=hit[inverse], minlength=rows).astype(np.int64) + int(hit[-1])
                miss = ~hit[inverse]
                if complete:
                    miss &= False
                held = np.bincount(w.doc[miss], minlength=rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), pa.array(w.hashes[miss].view(np.int64)))
                found = score_ids(model, *id_streams(part.column("ids"), kind))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts + 1), pa.array(known), pa.array(base), pa.array(found), lists], names=schema.names)

    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("others", T.ArrayType(T.LongType()))]
    schema = T.StructType([encoded.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]])
    ta.bounded_batches(spark)
    scored = encoded.select("doc_id", "text", "ids").mapInArrow(ta.released(run), schema)
    if complete:
        return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    scored = ta.cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words beyond the frequent ones: what the count adds to the share of an unseen word
    gain = F.log10((F.col("n") + 0.5) / F.lit(0.5))
    rare = scored.select("row", F.explode("others").alias("key")).join(words, "key").groupBy("row").agg(F.sum(gain).alias("gain"), F.count("*").alias("more"))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ta.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = ta.crc_mod(F.col("doc_id"), 5)
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    out = score(docs, F.coalesce(fold != 1, F.lit(True)))
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
