"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Encoding splits every whole text into units at single blanks, where the vocabulary's pattern
always splits too, and the units by the pattern into words; texts with other runs of blanks
are split by the pattern alone.  The distinct words of a slice of the corpus are taken as one small corpus.  An inverted index from token pair to word
positions is built once; merges are then replayed in rank order, and applying one touches
only the positions of its pair and their neighbours.  A word that the worker has seen before
keeps its ids (the memory is emptied at ``REMEMBER`` words; that changes no result).

A merge may make a pair of a lower rank than its own.  Words in which that happens take one
merge at a time, the leftmost, and meet the lower rank next; so ids are exact for any rank
table and any word length.

Null and empty texts have no ids and decode to no bytes.  Ids outside the vocabulary
raise KeyError on decoding; a null id list decodes to null.  Repeated rows get equal ids, an
empty table gives no rows, and columns named like a result are replaced by it unless another
name is asked for.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words and units that a worker remembers, by number and by bytes.
REMEMBER, REMEMBER_BYTES = 150_000, 8 << 20
#: Bytes of text whose new words are replayed together.
SLICE = 2 << 20
#: A blank beside another space; re's spaces hold all of the pattern's.
UNEVEN = re.compile(r" \s|\s ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Numbered(dict):
    """Numbers of keys; a key that is looked up for the first time gets the next and waits in ``fresh``.

    Key k has the ids flat[starts[k] : starts[k] + lens[k]].
    """

    def __init__(self):
        super().__init__()
        self.clear()

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def clear(self) -> None:
        super().clear()
        self.held = 0
        self.fresh: list = []
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = self.lens = np.zeros(0, dtype=np.int64)

    def fill(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """Ids of the fresh keys, in their order."""
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.flat = np.concatenate((self.flat, flat))
        self.held += sum(map(len, self.fresh))
        self.fresh = []

    def full(self) -> bool:
        return len(self) > REMEMBER or self.held > REMEMBER_BYTES

    def number(self, lists: list[list], learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lists of keys, offsets of each list); ``learn`` fills in what is fresh."""
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        key = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(sizes.sum()))
        learn()
        lens = self.lens[key]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total)
        at += np.repeat(self.starts[key] - (ends - lens), lens)
        bounds = np.concatenate(([0], ends))
        return self.flat[at], bounds[np.concatenate(([0], np.cumsum(sizes)))]


class Encoder:
    """Ids of words under one rank table."""

    def __init__(self, ranks: dict[bytes, int], split: str | None = None):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.single_ids = np.array(self.single, dtype=np.int64)
        self.split = regex.compile(split or pattern())
        pairs = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.pair_keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.pair_values = np.array([pairs.get(k, -1) for k in self.pair_keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        self.words, self.units = Numbered(), Numbered()

    def rank(self, a: int, b: int) -> int:
        """Id that the pair merges to, which is its rank; -1 if none."""
        return self.pairs.get(a << 32 | b, -1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``rank`` for arrays of symbols; symbols below 0 pair with nothing."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_values[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Every merge, in rank order, over all positions of ``words`` at once.

        Returns the ids of all words, one after the other, and how many each has.
        """
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        whole = np.fromiter(map(self.ranks.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        room = np.where(whole >= 0, 1, size)
        first = np.cumsum(room + 1) - room  # a symbol of -1 stands before each word and after the last
        n = int(room.sum()) + len(words) + 1
        ids = np.full(n, -1, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[first - 1] = inside[-1] = False
        split = np.repeat(whole < 0, room)
        symbols = np.repeat(whole, room)
        symbols[split] = self.single_ids[np.frombuffer(b"".join([w for w, k in zip(words, whole.tolist()) if k < 0]), dtype=np.uint8)]
        ids[inside] = symbols
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        now = np.append(self.pair_ranks(ids[:-1], ids[1:]), -1)  # rank of the pair that begins at each position
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            lo = 0
            for hi, r in zip([*cut.tolist(), len(at)], rank[np.append(0, cut)].tolist()):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)
                lo = hi

        some = np.flatnonzero(now >= 0)
        if len(some):
            note(some, now[some])
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = np.unique(np.concatenate(held) if len(held) > 1 else held[0])
            at = at[now[at] == r]  # others have lost a symbol to a neighbour meanwhile
            if not len(at):
                continue
            right, every = nxt[at], at
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # pairs that overlap: the leftmost first
                keep, gone = [], -1
                for k, (x, y) in enumerate(zip(at.tolist(), right.tolist())):
                    if x != gone:
                        keep.append(k)
                        gone = y
                at, right = at[keep], right[keep]
            after, before = nxt[right], prv[at]
            mine = np.full(len(at), r)
            later, earlier = self.pair_ranks(mine, ids[after]), self.pair_ranks(ids[before], mine)
            early = ((later >= 0) & (later <= r)) | ((earlier >= 0) & (earlier <= r))
            touch = after[:-1] == at[1:]
            touching = touch.any()
            if touching and 0 <= self.rank(r, r) <= r:
                early[:-1] |= touch
            if early.any():
                word = np.searchsorted(first, at, side="right")
                wait = np.isin(word, word[early])
                wait[1:] &= word[1:] == word[:-1]
                wait[0] = False
                if wait.any():
                    word_of = np.searchsorted(first, every, side="right")
                    again = np.isin(word_of, word[wait])
                    note(every[again], np.full(int(again.sum()), r))  # with those that overlapped one that waits
                    at, right, after, before, later, earlier = (x[~wait] for x in (at, right, after, before, later, earlier))
            ids[at], ids[right], now[right] = r, -2, -1
            nxt[at] = after
            prv[after] = at
            if touching:  # neighbours have merged too
                later, earlier = self.pair_ranks(ids[at], ids[after]), self.pair_ranks(ids[before], ids[at])
            now[at] = later
            now[before] = earlier
            spots, ranks = np.concatenate((at, before)), np.concatenate((later, earlier))
            made = ranks >= 0
            if made.any():
                note(spots[made], ranks[made])
        kept = np.concatenate(([0], np.cumsum(ids >= 0)))
        lens = np.diff(kept[np.append(first, n)]) if len(first) else np.zeros(0, dtype=np.int64)
        flat = ids[ids >= 0].astype(np.int32)
        return flat, lens

    def learn_words(self) -> None:
        """Replay the words that have got a number but no ids yet."""
        if self.words.fresh:
            self.words.fill(*self.replay([w.encode() for w in self.words.fresh]))

    def learn_units(self) -> None:
        """Split the new units and put their words' ids together."""
        fresh = self.units.fresh
        if not fresh:
            return
        split = self.split.findall
        parts = [split(u[0]) if type(u) is tuple else split(" " + u) for u in fresh]
        if self.words.full():
            self.words.clear()
        flat, offsets = self.words.number(parts, self.learn_words)
        self.units.fill(flat, np.diff(offsets))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each); the new words of all of them are replayed together."""
        if self.units.full():
            self.units.clear()
        gc.disable()  # no cycles are made here, and all the words would be walked again and again
        try:
            return self.units.number([self.units_of(t) if t else [] for t in texts], self.learn_units)
        finally:
            gc.enable()

    def units_of(self, text: str) -> list:
        """Units of a text: a plain string stands behind a blank, a string in a tuple by itself."""
        if text[-1] == " " or UNEVEN.search(text):
            return [(w,) for w in self.split.findall(text)]
        units = text.split(" ")
        units[0] = (units[0],)
        return units

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, offsets = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, offsets[1:-1])] if texts else []


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str | None) -> Encoder:
    """The worker's encoder for this vocabulary (default: the public one, looked up in the worker): tasks of one
    worker share the words it has seen."""
    key = (path or vocabulary_path(), pattern())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(key[0]))
    return _ENCODERS[key]


def encode(df: DataFrame, path: str | None = None, text_col: str = "text", name: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the ids of the whole text."""

    def make():
        encoder = encoder_for(path)

        def run(texts: pa.Array) -> list[pa.Array]:
            flat, offsets = encoder.encode_flat(texts.to_pylist())
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]

        return run

    return ta.map_texts(df, make, [(name, T.ArrayType(T.IntegerType()))], text_col, keep, factory=True, chunk=SLICE)


class Decoder:
    """Bytes of id lists: each id's bytes are copied from one long buffer."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.lens = np.full(size, -1, dtype=np.int64)
        self.starts = np.zeros(size, dtype=np.int64)
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.data = np.frombuffer(b"".join(b for b, _ in ordered), dtype=np.uint8)
        ids = np.array([i for _, i in ordered])
        self.lens[ids] = [len(b) for b, _ in ordered]
        self.starts[ids] = np.cumsum(self.lens[ids]) - self.lens[ids]

    def __call__(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (lists.flatten().null_count or ids.min() < 0 or ids.max() >= len(self.lens) or self.lens[ids].min() < 0):
            raise KeyError("an id outside the vocabulary")
        ids = ids.astype(np.int64)
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(self.starts[ids] - (ends - lens), lens)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
        out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(self.data[at])])
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary())) if lists.null_count else out


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with ``name``: the bytes that the ids stand for."""
    ta.bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() != name.lower()]
    at = keep.index(ids_col)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.BinaryType())])

    def run(batches):
        decoder = Decoder(load_ranks(path or vocabulary_path()))
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 200):
                part = batch.slice(lo, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder(part.column(at))], names=[*keep, name])

    return df.select(*[df[c] for c in keep]).mapInArrow(ta.released(run), schema)


def round_trip(df: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """``df`` with ids and the bytes decoded from those ids, in columns of these ``names``; both made by one worker."""

    def make():
        encoder, decoder = encoder_for(path), Decoder(load_ranks(path or vocabulary_path()))

        def run(texts: pa.Array) -> list[pa.Array]:
            flat, offsets = encoder.encode_flat(texts.to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            return [ids, decoder(ids)]

        return run

    return ta.map_texts(df, make, [(names[0], T.ArrayType(T.IntegerType())), (names[1], T.BinaryType())], text_col, keep, factory=True, chunk=SLICE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ta.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
