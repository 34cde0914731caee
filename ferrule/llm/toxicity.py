"""Toxicity: a factorization machine over hashed terms.

Terms are the letter-and-digit words of the whole text and their byte prefixes of 4 to 8
bytes (an inflected insult keeps its stem), hashed into ``BUCKETS``; a term counts once a
text.  Besides a linear weight, each term has a small factor vector, so pairs of terms
(an insult with a mention of a group) have a weight of their own.

Labels are learned from a bounded sample, ``per_class`` documents of each class of up to
``SAMPLE_BYTES`` bytes, chosen by a hash.  However many they are, all terms are learned that
differ between the classes by ``TELLING`` (and occur in ``LEAST`` documents) or that a share of
``COMMON`` has, so a term that tells only in a pair is learned too.  Scoring covers every whole text.  A null or
empty text has no terms and gets the model's intercept.  Without labelled documents of both
classes the score is the share of toxic labels (0.0 without any label).  Repeated rows and
ties get equal scores, an empty table gives no rows, and a column named like the result is
replaced by it unless another name is asked for.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
FACTORS = 4
LEAST = 3
#: A term is learned if its counts in the two classes differ by this chi-square, or if so large a share of the sample has it.
TELLING, COMMON = 9.0, 0.02
BATCH, RATE, RATE_V, DECAY = 64, 0.3, 0.02, 0.1
#: Evidence that a term's weight must gather before it leaves zero, by the root of how often the term was seen.
DOUBT = 0.5
#: Bound of the labelled sample: so many documents of each class at most (about), of so many bytes at most.
PER_CLASS, SAMPLE_BYTES = 2500, 1 << 15


class Model(NamedTuple):
    buckets: np.ndarray  # sorted, of the learned terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def term_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the terms of each text, with repeats."""
    w = ta.words_of(texts, separators=ta.NON_TERM)
    rows, out = [w.doc], [ta.mix64(w.hashes + np.uint64(1))]
    size = w.ends - w.starts
    for n in PREFIXES:
        long = size >= n
        starts = w.starts[long]
        rows.append(w.doc[long])
        out.append(ta.head_hashes(w.data, starts, n))
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(44)).astype(np.int32)


def distinct_terms(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows.astype(np.int64) << 20) | terms)
    return key >> 20, (key & (BUCKETS - 1)).astype(np.int32)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 8, seed: int = 7) -> Model:
    """The pair machine over sparse rows of all learned terms, on the logistic loss.

    Weights follow the regularised leader (zero until the evidence exceeds ``DOUBT``), factors Adagrad.
    """
    labels = np.asarray(labels, dtype=np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        bias = -40.0 if share == 0.0 else 40.0
        return Model(np.zeros(0, dtype=np.int32), bias, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    rows, terms = [], []
    for at in range(0, len(texts), 64):
        r, t = distinct_terms(*term_sets(pa.array(texts[at : at + 64], pa.string())))
        rows.append(r + at)
        terms.append(t)
    rows, terms = np.concatenate(rows), np.concatenate(terms)
    n, n1 = len(labels), float(labels.sum())
    seen = np.bincount(terms, minlength=BUCKETS)
    hits = np.bincount(terms[labels[rows] > 0], minlength=BUCKETS)
    want = seen * n1 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((hits - want) ** 2 / (want * (1 - n1 / n) * (1 - seen / n)), nan=0.0, posinf=0.0)
    learned = np.flatnonzero(((chi >= TELLING) & (seen >= min(LEAST, max(1, n // 20)))) | (seen >= COMMON * n))
    where = np.full(BUCKETS, -1, dtype=np.int32)
    where[learned] = np.arange(len(learned))
    used = where[terms] >= 0
    rows, cols = rows[used], where[terms[used]]
    first = np.searchsorted(rows, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, evidence, g_w = (np.zeros(len(learned)) for _ in range(3))
    doubt = DOUBT * np.sqrt(seen[learned])
    v = rng.standard_normal((len(learned), FACTORS)) * 0.02
    g_v, bias, g_bias = np.ones_like(v), float(np.log(n1 / (n - n1))), 1.0
    weight = np.where(labels > 0, 0.5 * n / n1, 0.5 * n / (n - n1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            pick = np.sort(order[at : at + BATCH])
            sizes = first[pick + 1] - first[pick]
            row = np.repeat(np.arange(len(pick)), sizes)
            col = cols[np.arange(sizes.sum()) + np.repeat(first[pick] - (np.cumsum(sizes) - sizes), sizes)]
            z, xv = pair_sums(bias, w, v, row, col, len(pick))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick])
            some, at_ = np.unique(col, return_inverse=True)
            gr = g[row]
            dw = np.bincount(at_, gr, minlength=len(some))
            dv = np.stack([np.bincount(at_, gr * xv[row, f], minlength=len(some)) for f in range(FACTORS)], axis=1) - dw[:, None] * v[some] + DECAY * v[some]
            grown = g_w[some] + dw**2
            evidence[some] += dw - (np.sqrt(grown) - np.sqrt(g_w[some])) / RATE * w[some]
            g_w[some] = grown
            e = evidence[some]
            w[some] = np.where(np.abs(e) <= doubt[some], 0.0, -(e - np.sign(e) * doubt[some]) / ((1.0 + np.sqrt(grown)) / RATE + DECAY))
            g_v[some] += dv**2
            v[some] -= RATE_V * dv / np.sqrt(g_v[some])
            g_bias += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(g_bias)
    return Model(learned.astype(np.int32), bias, w.astype(np.float32), v.astype(np.float32))


def pair_sums(bias: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic function, summed factors) of n rows whose terms are (row, col), each once.

    The sum over pairs is half of the squared sum less the sum of squares, a factor at a time.
    """
    z = bias + np.bincount(row, weights=w[col], minlength=n)
    sums = np.empty((n, v.shape[1]))
    for f in range(v.shape[1]):
        x = v[col, f].astype(np.float64)
        sums[:, f] = np.bincount(row, x, minlength=n)
        z += 0.5 * (sums[:, f] ** 2 - np.bincount(row, x * x, minlength=n))
    return z, sums


def predict(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores from 0 to 1, one a text."""
    n = len(texts)
    rows, terms = term_sets(texts)
    where = np.full(BUCKETS, -1, dtype=np.int32)
    where[model.buckets] = np.arange(len(model.buckets))
    at = where[terms]
    used = at >= 0
    key = np.unique(rows[used].astype(np.int64) * max(1, len(model.buckets)) + at[used])
    rows, at = key // max(1, len(model.buckets)), key % max(1, len(model.buckets))
    z, _ = pair_sums(model.bias, model.linear, model.factors, rows, at, n)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample_by_class(df: DataFrame, class_col: str, per_class: int, classes: int) -> DataFrame:
    """About ``per_class`` distinct rows of each of the ``classes`` most frequent classes, by a hash of the row.

    However rows repeat, twice as many at most come out.
    """
    df = df.where(F.col(class_col).isNotNull())
    found = df.groupBy(class_col).count().orderBy(F.desc("count"), class_col).limit(classes).collect()
    share = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    keep = F.lit(False)
    for value, n in sorted((r[0], r[1]) for r in found):
        keep = keep | ((F.col(class_col) == F.lit(value)) & (share < F.lit(int(min(1.0, per_class / n) * (1 << 20)))))
    return df.where(keep).distinct().orderBy(share, *df.columns).limit(2 * per_class * max(1, len(found)))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """``documents`` (doc_id, text) and ``labels`` (doc_id, toxic), already limited to the rows to learn from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = sample_by_class(known, "toxic", per_class, 2)  # 4 * per_class rows at most
    texts = documents.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
    got = texts.join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "text"), "doc_id", "toxic").limit(4 * per_class).toArrow()
    return fit(got.column("text").to_pylist(), np.array(got.column("toxic").to_pylist(), dtype=np.float32))


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``df`` with ``name``: the probability that a text is toxic."""

    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(predict(shared.value, texts), pa.float64())]

    return ta.map_texts(df, scored, [(name, T.DoubleType())], text_col, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = ta.table(spark, sf_dir, "documents"), ta.table(spark, sf_dir, "labels")
    fold = ta.crc_mod(F.col("doc_id"), 5)
    model = train(docs.where(fold != 0), labels.where(fold != 0))
    out = score_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
