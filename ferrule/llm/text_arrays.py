"""Whole-text word arrays for Arrow batches, and the plumbing the operators share.

Words are found and hashed with numpy over the raw UTF-8 buffer of a batch, so no
operator makes a Python object per word.  Nothing here looks at a prefix of a text:
a chunk always holds whole texts, however long a single text is.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93

#: ASCII letters folded to lower case, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of ``[^\x20\x09-\x0D]+`` words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of letter-and-digit terms; bytes of non-ASCII characters count as letters.
NON_TERM = np.zeros(256, dtype=bool)
NON_TERM[:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    NON_TERM[_lo:_hi] = False

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 4000
BATCH_BYTES = 4 << 20
#: Words are hashed in blocks of so many bytes, so a long text needs no arrays of eight bytes a byte.
BLOCK = 1 << 18


def _powers(base: int) -> np.ndarray:
    powers = np.full(BLOCK + 1, base, dtype=U64)
    powers[0] = 1
    return np.cumprod(powers, dtype=U64)


#: Powers of the hash base and of its inverse.
_UP, _DOWN = _powers(_P), _powers(_P_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, n at most BLOCK + 1."""
    return _UP[:n], _DOWN[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def factor(j: int) -> np.uint64:
    """What the hash of a run's word j is multiplied by."""
    return U64(pow(_Q, j, 1 << 64))


class Words(NamedTuple):
    data: np.ndarray  # folded bytes of the chunk
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # row of each word
    counts: np.ndarray  # words of each row
    hashes: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, bytes) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def weighed(data: np.ndarray) -> np.uint64:
    """Polynomial sum of a run of bytes of any length."""
    total = U64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), BLOCK):
            part = (data[at : at + BLOCK].astype(U64) + U64(1)) * _UP[: min(BLOCK, len(data) - at)]
            total += part.sum(dtype=U64) * U64(pow(_P, at, 1 << 64))
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, starts ascending; equal bytes have equal hashes wherever they stand."""
    out = np.zeros(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + BLOCK, side="left")))
        block = slice(at, to)
        top = int(ends[block].max())
        if top - base > BLOCK:  # the spans that reach beyond the block go alone
            for i in np.flatnonzero(ends[block] > base + BLOCK) + at:
                out[i] = weighed(data[starts[i] : ends[i]])
        sums = np.zeros(min(top - base, BLOCK) + 1, dtype=U64)
        np.cumsum((data[base : base + len(sums) - 1].astype(U64) + U64(1)) * _UP[: len(sums) - 1], out=sums[1:])
        inside = np.flatnonzero(ends[block] <= base + BLOCK) + at
        lo = starts[inside] - base
        out[inside] = (sums[ends[inside] - base] - sums[lo]) * _DOWN[lo]
        at = to
    return mix64(out)


def head_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each start on, in any order; the same that ``span_hashes`` gives."""
    acc = np.zeros(len(starts), dtype=U64)
    for j in range(size):
        acc += (data[starts + j].astype(U64) + U64(1)) * _UP[j]
    return mix64(acc)


def words_of(texts: pa.Array, separators: np.ndarray = SPACE, fold: bool = True) -> Words:
    """Every word of every whole text in ``texts``."""
    offsets, raw = buffers(texts)
    data = LOWER[raw] if fold else raw
    n, rows = len(data), len(offsets) - 1
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, closes = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | edge[1:n]
        closes[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, doc, np.bincount(doc, minlength=rows), span_hashes(data, starts, ends))


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words, in text order.

    A text of 1 to k-1 words has its whole sequence as its one shingle; a text without
    words has none.
    """
    h, n = words.hashes, len(words.hashes)
    first = np.concatenate(([0], np.cumsum(words.counts)))[:-1]
    rows, out = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=U64)
        for j in range(k):
            acc += h[j : n - k + 1 + j] * factor(j)
        whole = words.doc[: n - k + 1] == words.doc[k - 1 :]
        rows, out = words.doc[: n - k + 1][whole], mix64(acc[whole] + U64(k))
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = words.counts[short] > j
            extra[has] += h[first[short[has]] + j] * factor(j)
        extra = mix64(extra + words.counts[short].astype(U64))
        rows, out = np.concatenate((rows, short)), np.concatenate((out, extra))
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by row and then by hash."""
    rows, h = shingles(words_of(texts), k)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[fresh], h[fresh]
    return rows, h


def chunked(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each, one row at least."""
    offsets, _ = buffers(batch.column(text_col))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes that one Arrow batch brings into a Python worker.

    The settings are read when a plan runs, so they stay in the session; they are only ever lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give free memory back: workers are used again by stages with other needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory given back when its task ends."""

    def made(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return made


def map_texts(
    df: DataFrame,
    fn: Callable[[pa.Array], list[pa.Array]] | Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[tuple[str, T.DataType]],
    text_col: str = "text",
    keep: list[str] | None = None,
    factory: bool = False,
    chunk: int = CHUNK_BYTES,
) -> DataFrame:
    """``df``'s columns ``keep`` (default: all) plus ``fields`` computed from whole texts.

    A kept column whose name clashes with a new field is replaced by the field.  With
    ``factory``, ``fn`` makes the function once a task, with whatever tables it needs.
    """
    bounded_batches(df.sparkSession)
    new = {name.lower() for name, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in fields])
    if text_col in keep and df.schema[text_col].dataType == T.StringType():  # the text travels once
        hidden, source = text_col, df.select(*[df[c] for c in keep])
    else:
        hidden = "__text__"
        source = df.select(*[df[c] for c in keep], df[text_col].cast("string").alias(hidden))
    names = [*keep, *[n for n, _ in fields]]

    def run(batches):
        call = fn() if factory else fn
        for batch in batches:
            for part in chunked(batch, hidden, chunk):
                made = call(part.column(hidden))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *made], names=names)

    return source.mapInArrow(released(run), schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Only a local session without the setting uses a folder of the machine; a cluster without it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/ferrule"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here."""
    return Cuts(df.sparkSession).put(df, name)


class Cuts:
    """Tables of one run in the shared folder; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)  # so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column, mod: int):
    """crc32 of the id as text, modulo ``mod``: the folds of the contracts."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
