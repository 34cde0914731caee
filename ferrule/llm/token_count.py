"""Token counts by heap and linked list: merges are counted, ids are never made.

A word's symbols stand in a linked list; a heap gives the lowest-ranked adjacent pair,
the leftmost first.  Each merge takes one symbol away, so a word has as many tokens as
initial symbols less merges.  Words come from the vocabulary's pattern; special strings of
the vocabulary inside a text are one token each, as its library has it by default.

Null and empty texts have no tokens and no bytes.  Repeated rows get equal counts, an empty
table gives no rows, and a column named like the result is replaced by it unless another
name is asked for.  A worker remembers the counts of words (bounded by number and bytes;
forgetting them changes no result).
"""

from __future__ import annotations

import gc
import heapq
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .bpe import pattern, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
REMEMBER, REMEMBER_BYTES = 500_000, 16 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counting:
    """Counts under one byte-level vocabulary file."""

    def __init__(self, path: str, split: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.single = [ids[letters[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(split or pattern())
        self.known: dict[str, int] = {}
        self.held = 0

    def word(self, text: str) -> int:
        """Initial symbols less merges."""
        symbols = [self.single[b] for b in text.encode()]
        n = len(symbols)
        if n == 1:
            return 1
        find = self.merges.get
        heap = [(got[0], i, got[1]) for i in range(n - 1) if (got := find(symbols[i] << 32 | symbols[i + 1]))]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, at, made = pop(heap)
            a = symbols[at]
            right = nxt[at]
            if a < 0 or right >= n:
                continue
            got = find(a << 32 | symbols[right])
            if got is None or got[1] != made:
                continue  # the pair has changed since
            symbols[at], symbols[right] = made, -1
            left -= 1
            after = nxt[at] = nxt[right]
            if after < n:
                prv[after] = at
                if got := find(made << 32 | symbols[after]):
                    push(heap, (got[0], at, got[1]))
            before = prv[at]
            if before >= 0 and (got := find(symbols[before] << 32 | made)):
                push(heap, (got[0], before, got[1]))
        return left

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        known, out = self.known, []
        if len(known) > REMEMBER or self.held > REMEMBER_BYTES:
            known.clear()
            self.held = 0
        for text in texts:
            total = 0
            for part in self.parts(text or ""):
                if part is None:
                    total += 1
                    continue
                words = self.split.findall(part)
                try:
                    total += sum(map(known.__getitem__, words))
                except KeyError:
                    for w in set(words).difference(known):
                        known[w] = self.word(w)
                        self.held += len(w)
                    total += sum(map(known.__getitem__, words))
            out.append(total)
        return out

    def parts(self, text: str) -> list[str | None]:
        """The text between special strings, and None for each of them."""
        if self.special is None or not self.special.search(text):
            return [text]
        pieces = self.special.split(text)
        return list(chain.from_iterable((p, None) for p in pieces))[:-1]


_COUNTING: dict[str, Counting] = {}


def counting_for(path: str | None) -> Counting:
    """The worker's counter for this vocabulary (default: the public one, looked up in the worker): tasks of one
    worker share the words it has seen."""
    path = path or vocabulary_path(VOCABULARY)
    if path not in _COUNTING:
        _COUNTING[path] = Counting(path)
    return _COUNTING[path]


def count_tokens(df: DataFrame, path: str | None = None, text_col: str = "text", name: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the tokens of the whole text."""

    def make():
        counting = counting_for(path)

        def run(texts: pa.Array) -> list[pa.Array]:
            gc.disable()  # no cycles are made here, and all the words would be walked again and again
            try:
                return [pa.array(counting.counts(texts.to_pylist()), pa.int64())]
            finally:
                gc.enable()

        return run

    return ta.map_texts(df, make, [(name, T.LongType())], text_col, keep, factory=True)


def query(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = ta.table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = count_tokens(sized, keep=["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
