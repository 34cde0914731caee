"""Language ID: unigrams over a fixed public vocabulary, marginalised over segmentations.

Each language has a probability for every vocabulary piece that can stand in a word.  A word
is a run of non-separator bytes with one space before it; its probability is the sum over all
its segmentations, found by a forward pass over its bytes, however long it is; a text's is
the product over its words.  Piece probabilities are learned by expectation maximisation on a
bounded sample of labelled texts (``PER_LANG`` a language, of up to ``SAMPLE_BYTES`` each, for
the ``LANGUAGES`` most frequent languages; words of over ``LEARNED`` bytes are not learned from).

Words of up to ``SHORT`` bytes are summed in doubles, longer ones in extended floats, those of
over ``LEARNED`` bytes with rescaling.  A task remembers the words that it has scored (at most
``REMEMBER``; forgetting them changes no result).

Null texts and texts without a letter get ``und`` and score 0.0; so does every text when
nothing was learned.  Ties go to the first language by name.  Repeated rows get equal scores,
an empty table gives no rows, and a column named like a result is replaced by the result
unless other names are asked for.
"""

from __future__ import annotations

import base64
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .toxicity import sample_by_class

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHORT, LEARNED = 32, 512
#: Bound of the labelled sample: about so many documents a language, of so many bytes at most.
PER_LANG, SAMPLE_BYTES = 500, 1 << 15
LANGUAGES = 64
REMEMBER = 1 << 17
CELLS = 1 << 17
FLOOR = 1e-8
UND = "und"


class Model(NamedTuple):
    languages: list[str]
    keys: np.ndarray  # sorted piece hashes
    prob: np.ndarray  # pieces x languages
    sizes: list[int]  # lengths that pieces have


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_keys(path: str) -> tuple[np.ndarray, list[int]]:
    """(sorted hashes, lengths) of the pieces that can stand in a word, folded like the texts."""
    pieces = {bytes([b]) for b in range(256)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = np.frombuffer(base64.b64decode(line.split()[0]), np.uint8)
            if not ta.SPACE[piece[1:]].any():  # a space may only come first
                pieces.add(ta.LOWER[piece].tobytes())
    flat = sorted(pieces)
    data = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.cumsum([len(p) for p in flat])
    return np.unique(ta.span_hashes(data, np.concatenate(([0], ends[:-1])), ends)), sorted({len(p) for p in flat})


class Lookup:
    """Index of a hash among the sorted keys, -1 where it isn't one."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[keys >> np.uint64(42)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        hit = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        good = self.keys[at] == h[hit]
        out[hit[good]] = at[good]
        return out


class Pieces(NamedTuple):
    """Pieces of a batch of words: by length, the piece's index (-1: none) by word and end."""

    by_size: dict[int, np.ndarray]
    size: np.ndarray


def spans(data: np.ndarray, starts: np.ndarray, size: np.ndarray, lookup: Lookup, sizes: list[int]) -> Pieces:
    """A space stands before each word."""
    wide = int(size.max()) + 1
    at = np.minimum(starts[:, None] + np.arange(-1, wide - 1), len(data) - 1)
    block = np.where(np.arange(-1, wide - 1) < size[:, None], data[at], 0).astype(np.uint8)
    block[:, 0] = 0x20
    up, down = ta.powers(wide)
    sums = np.zeros((len(size), wide + 1), dtype=np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[:, 1:])
    found = {}
    for n in sizes:
        if n > wide:
            break
        h = ta.mix64((sums[:, n:] - sums[:, : wide + 1 - n]) * down[: wide + 1 - n])
        found[n] = lookup(h.ravel()).reshape(h.shape)
    return Pieces(found, size)


def forward(pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Summed probability of each prefix of each word, by language."""
    m, wide = len(pieces.size), int(pieces.size.max()) + 1
    alpha = np.zeros((wide + 1, m, prob.shape[1]), dtype=np.float64 if wide <= SHORT + 1 else np.longdouble)
    alpha[0] = 1
    for end in range(1, wide + 1):
        for n, found in pieces.by_size.items():
            if n > end:
                break
            at = found[:, end - n]
            rows = np.flatnonzero(at >= 0)
            if len(rows) == m:
                alpha[end] += alpha[end - n] * prob[at]
            elif len(rows):
                alpha[end, rows] += alpha[end - n, rows] * prob[at[rows]]
    return alpha


def batches_of(size: np.ndarray, cells: int = CELLS):
    """Indices of words of about the same size, at most ``LEARNED`` bytes, a bounded number of bytes together."""
    order = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[order], [0, SHORT, LEARNED], side="right")
    for lo, hi in zip(bounds, bounds[1:]):
        while lo < hi:
            to = lo + max(1, int(np.searchsorted(size[order[lo:hi]] * np.arange(1, hi - lo + 1), cells, side="right")))
            yield order[lo:to]
            lo = to


def long_word(word: np.ndarray, model: Model, lookup: Lookup) -> np.ndarray:
    """log10 probability of one word of any length: the forward pass with sums scaled to 1 again and again."""
    block = np.concatenate((np.array([0x20], np.uint8), word))
    steps: list[list[tuple[int, int]]] = []
    most, held, scale = max(model.sizes), None, np.zeros(len(model.languages))
    for lo in range(0, len(block), CELLS):  # pieces that end in these bytes
        hi = min(len(block), lo + CELLS)
        steps = [[] for _ in range(hi - lo)]
        for n in model.sizes:
            first = max(0, lo + 1 - n)
            starts = np.arange(first, max(first, hi - n + 1))
            found = lookup(ta.span_hashes(block, starts, starts + n))
            for k in np.flatnonzero(found >= 0).tolist():
                steps[first + k + n - lo - 1].append((n, int(found[k])))
        if held is None:
            held = [np.ones(len(model.languages))]  # sums of the last prefixes, the latest last
        for i, found in enumerate(steps):
            total = np.zeros(len(model.languages))
            for n, piece in found:
                if n <= len(held):
                    total += held[-n] * model.prob[piece]
            held.append(total)
            if i % 16 == 15 or i == len(steps) - 1:
                scale += np.log10(total)
                held = [np.minimum(x / total, 1e250) for x in held[-most:]]
    return scale


def word_log_prob(data: np.ndarray, starts: np.ndarray, size: np.ndarray, model: Model, lookup: Lookup) -> np.ndarray:
    """log10 probability of each word by language."""
    out = np.empty((len(size), len(model.languages)))
    for pick in batches_of(size):
        alpha = forward(spans(data, starts[pick], size[pick], lookup, model.sizes), model.prob)
        out[pick] = np.log10(alpha[size[pick] + 1, np.arange(len(pick))])
    for i in np.flatnonzero(size > LEARNED).tolist():
        out[i] = long_word(data[starts[i] : starts[i] + size[i]], model, lookup)
    return out


def fit(texts: list[str], langs: list[str], rounds: int = 3, path: str | None = None) -> Model:
    """Expected piece counts over all segmentations, ``rounds`` times."""
    languages = sorted(set(langs))
    keys, sizes = piece_keys(path or vocabulary_path())
    n = len(languages)
    prob = np.full((len(keys), n), 1 / len(keys))
    if not languages:
        return Model([], keys, prob, sizes)
    w = ta.words_of(pa.array(texts, pa.string()))
    _, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
    starts, size = w.starts[first], (w.ends - w.starts)[first]
    of = np.array([languages.index(x) for x in langs])
    weight = np.bincount(which * n + of[w.doc], minlength=len(size) * n).reshape(-1, n).astype(float)
    lookup = Lookup(keys)
    for _ in range(rounds):
        counts = np.zeros_like(prob)
        for pick in batches_of(size, CELLS // 2):
            pieces = spans(w.data, starts[pick], size[pick], lookup, sizes)
            alpha = forward(pieces, prob)
            beta = np.zeros_like(alpha)
            last = pieces.size + 1
            rows = np.arange(len(pick))
            beta[last, rows] = weight[pick] / alpha[last, rows]
            for end in range(len(alpha) - 1, 0, -1):
                for k, found in pieces.by_size.items():
                    if k > end:
                        break
                    at = found[:, end - k]
                    r = np.flatnonzero((at >= 0) & (last >= end))
                    if len(r):
                        p = at[r]
                        step = beta[end, r] * prob[p]
                        expected = (alpha[end - k, r] * step).astype(float)
                        for j in range(n):
                            counts[:, j] += np.bincount(p, expected[:, j], minlength=len(keys))
                        beta[end - k, r] += step
        counts += 0.01
        prob = np.maximum(counts / counts.sum(0), FLOOR)
    return Model(languages, keys, prob, sizes)


class Scorer:
    """Scores of words under a model, with those remembered that were met before."""

    def __init__(self, model: Model):
        self.model, self.lookup = model, Lookup(model.keys)
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros((0, len(self.model.languages)))

    def words(self, w: ta.Words) -> np.ndarray:
        """log10 probability of every word of a chunk, by language."""
        mine, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, mine)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == mine if len(self.keys) else np.zeros(len(mine), dtype=bool)
        out = np.empty((len(mine), len(self.model.languages)))
        out[known] = self.values[at[known]]
        fresh = first[~known]
        out[~known] = word_log_prob(w.data, w.starts[fresh], w.ends[fresh] - w.starts[fresh], self.model, self.lookup)
        if len(self.keys) + len(fresh) > REMEMBER:
            self.forget()
            at = np.zeros(len(mine), dtype=np.int64)
        if len(fresh) <= REMEMBER:
            self.keys = np.insert(self.keys, at[~known], mine[~known])
            self.values = np.insert(self.values, at[~known], out[~known], axis=0)
        return out[which]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        rows, languages = len(texts), self.model.languages
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not languages:
            return [UND] * rows, np.zeros(rows)
        w = ta.words_of(texts)
        per_word = self.words(w)
        total = np.stack([np.bincount(w.doc, per_word[:, j], minlength=rows) for j in range(len(languages))], axis=1)
        best = total.argmax(1)
        share = 10.0 ** np.maximum(total - total.max(1, keepdims=True), -300)
        score = np.where(letters, 1 / share.sum(1), 0.0)
        return [languages[b] if ok else UND for b, ok in zip(best, letters)], score


def train(documents: DataFrame, per_lang: int = PER_LANG, path: str | None = None) -> Model:
    """``documents`` (doc_id, text, lang), already limited to the rows to learn from."""
    known = documents.where(F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text", "lang")
    got = sample_by_class(known, "lang", per_lang, LANGUAGES).toArrow()
    order = pc.sort_indices(got, [("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
    got = got.take(order)
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), path=path)


def identify_language(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the language and its posterior, in columns of these ``names``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def run(texts: pa.Array) -> list[pa.Array]:
            found, score = scorer.predict(texts)
            return [pa.array(found, pa.string()), pa.array(score, pa.float64())]

        return run

    return ta.map_texts(df, make, [(names[0], T.StringType()), (names[1], T.DoubleType())], text_col, keep, factory=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ta.table(spark, sf_dir, "documents")
    fold = ta.crc_mod(F.col("doc_id"), 4)
    model = train(docs.where(fold != 2))
    out = identify_language(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
