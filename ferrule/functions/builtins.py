"""The 71 builtin functions as Column expressions.

All but ``filecountwords`` (which reads a file) stay inside the JVM.  Lists, arrays and sets
are arrays; sets are kept sorted and distinct.  Where a contract was open, the one chosen is
in the docstring and covered by a test.  Indices count from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# math ------------------------------------------------------------------------------


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def randint(n, key=None, seed: int = 0) -> Column:
    """Integer in [0, n).  With ``key`` it is a hash of seed and key, so any rerun gives the same."""
    if key is None:
        return F.floor(F.rand(seed) * _c(n)).cast("int")
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string"))), 1, 8), 16, 10).cast("long"), _c(n)).cast("int")


def truncate(x, digits) -> Column:
    """Cut after so many decimals, toward zero."""
    scale = F.pow(F.lit(10.0), _c(digits))
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * scale) / scale


def intpower(a, b) -> Column:
    """Exact power of whole numbers; 1 for an exponent below 1, an overflow raises."""
    return F.aggregate(F.array_repeat(_c(a).cast("long"), _c(b).cast("int")), F.lit(1).cast("long"), lambda acc, x: acc * x).cast("int")


def myfabs(x) -> Column:
    return F.abs(_c(x))


# strings and conversions -------------------------------------------------------------


def concatenate(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def str2float(s) -> Column:
    return _c(s).cast("double")


def str2int(s) -> Column:
    return _c(s).cast("int")


def float2int(x) -> Column:
    """Toward zero."""
    return _c(x).cast("int")


def int2str(x) -> Column:
    return _c(x).cast("string")


def float2str(x) -> Column:
    return _c(x).cast("string")


def str2intlist(s) -> Column:
    """Numbers separated by commas; an empty string is an empty list."""
    parts = F.filter(F.split(_c(s), ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).cast("int"))


def filecountwords(spark: SparkSession, path: str, _unused: int = 0) -> DataFrame:
    """Words of a text file, as one row ``n``; counted where the lines are."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.size(F.split(F.trim("value"), r"\s+")).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def wastetime(n) -> Column:
    """Returns its argument; work without an effect is not repeated."""
    return _c(n)


# lists -----------------------------------------------------------------------------


def llength(xs) -> Column:
    return F.size(xs)


def lnth(xs, i) -> Column:
    """Element i; null behind the end."""
    return F.get(xs, _c(i))


def lappend(a, b) -> Column:
    return F.concat(a, b)


def lreverse(xs) -> Column:
    return F.reverse(xs)


def listlast(xs) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def lhead(xs) -> Column:
    return F.get(xs, F.lit(0))


def ltail(xs) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(0)))


def lcons(x, xs) -> Column:
    return F.concat(F.array(_c(x)), xs)


def lsort(xs) -> Column:
    return F.sort_array(xs)


def lremoveduplicates(xs) -> Column:
    """First occurrences stay, in order."""
    return F.array_distinct(xs)


def lremove(xs, x) -> Column:
    """Without the first occurrence of x."""
    at = F.array_position(xs, _c(x)).cast("int")
    rest = F.concat(F.slice(xs, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(xs, at + 1, F.size(xs)))
    return F.when(at == 0, xs).otherwise(rest)


def ltake(xs, n) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(_c(n), F.lit(0)))


def listcount(xs, x) -> Column:
    return F.size(F.filter(xs, lambda e: e == _c(x)))


def lexists(xs, x) -> Column:
    return F.array_contains(xs, _c(x))


def lexistss(xs, ys) -> Column:
    """Every element of xs is in ys."""
    return F.size(F.array_except(xs, ys)) == 0


def intlistdiff(a, b) -> Column:
    """Distinct elements of a that b lacks, in order."""
    return F.array_except(a, b)


def intlistsub(xs, a, b) -> Column:
    """Elements from a to before b."""
    return F.slice(xs, _c(a) + 1, F.greatest(_c(b) - _c(a), F.lit(0)))


def intlistequal(a, b) -> Column:
    """1 if equal, else 0."""
    return F.when(_c(a) == _c(b), 1).otherwise(0)


# arrays ----------------------------------------------------------------------------


def array_init(n, value) -> Column:
    return F.array_repeat(_c(value), _c(n))


def array_get(a, i) -> Column:
    return F.get(a, _c(i))


def array_set(a, i, value) -> Column:
    """A copy with element i replaced; out of range changes nothing."""
    return F.transform(a, lambda x, k: F.when(k == _c(i), _c(value)).otherwise(x))


def array_add(a, value) -> Column:
    return F.array_append(a, _c(value))


def array_from_list(xs) -> Column:
    return xs


def array_size(a) -> Column:
    return F.size(a)


def array_exists(a, x) -> Column:
    return F.array_contains(a, _c(x))


# sets ------------------------------------------------------------------------------


def set_from_list(xs) -> Column:
    return F.array_sort(F.array_distinct(xs))


def set_add(s, x) -> Column:
    return F.array_sort(F.array_union(s, F.array(_c(x))))


def set_size(s) -> Column:
    return F.size(s)


def set_exists(s, x) -> Column:
    return F.array_contains(s, _c(x))


# vectors, in log space where beliefs are meant -----------------------------------------


def normalize(xs) -> Column:
    """Log vector shifted so that its exponentials sum to one (shifted by its maximum first)."""
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(xs, lambda x: x - top - F.log(total))


def damp(new, old, factor) -> Column:
    """log(factor * exp(old) + (1 - factor) * exp(new)), element by element."""
    return F.zip_with(new, old, lambda a, b: F.log(_c(factor) * F.exp(b) + (1 - _c(factor)) * F.exp(a)))


def divide(a, b) -> Column:
    """Quotient of beliefs: difference of logs."""
    return F.zip_with(a, b, lambda x, y: x - y)


def addfloatlists(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def convolve(matrix, vector) -> Column:
    """Row-major matrix times vector in log space: out[i] = log sum_j exp(m[i * n + j] + v[j])."""
    n = F.size(vector)
    rows = F.sequence(F.lit(0), n - 1)

    def row(i):
        terms = F.zip_with(F.slice(matrix, i * n + 1, n), vector, lambda m, v: m + v)
        return F.log(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.exp(x)))

    return F.transform(rows, row)


def residual(a, b) -> Column:
    """Sum of absolute differences of the exponentials."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.exp(x) - F.exp(y))), F.lit(0.0), lambda acc, x: acc + x)


def degeneratevector(n, k) -> Column:
    """One at k, zero elsewhere, n long."""
    return F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda i: F.when(i == _c(k), 1).otherwise(0))


def demergemessages(a, b) -> Column:
    """Element by element what a has beyond b."""
    return F.zip_with(a, b, lambda x, y: x - y)


def _as_list(s: Column, n: int) -> Column:
    return F.array(*[s[f"_{i + 1}"] for i in range(n)])


def _as_struct(xs: Column, n: int) -> Column:
    return F.struct(*[F.get(xs, F.lit(i)).alias(f"_{i + 1}") for i in range(n)])


def addfloatstructs(a: Column, b: Column, n: int) -> Column:
    return F.struct(*[(a[f"_{i + 1}"] + b[f"_{i + 1}"]).alias(f"_{i + 1}") for i in range(n)])


def dividestruct(a: Column, b: Column, n: int) -> Column:
    return F.struct(*[(a[f"_{i + 1}"] - b[f"_{i + 1}"]).alias(f"_{i + 1}") for i in range(n)])


def normalizestruct(s: Column, n: int) -> Column:
    return _as_struct(normalize(_as_list(s, n)), n)


def dampstruct(a: Column, b: Column, factor, n: int) -> Column:
    return _as_struct(damp(_as_list(a, n), _as_list(b, n), factor), n)


def residualstruct(a: Column, b: Column, n: int) -> Column:
    return residual(_as_list(a, n), _as_list(b, n))


def convolvestruct(matrix: Column, vector: Column, n: int) -> Column:
    return _as_struct(convolve(_as_list(matrix, n * n), _as_list(vector, n)), n)


# nodes, scheduling and placement ---------------------------------------------------------


def node2int(node) -> Column:
    return _c(node).cast("int")


def priority(column: str = "priority") -> Column:
    """A node's priority: a column of the node table, 0 where unset."""
    return F.coalesce(F.col(column), F.lit(0.0))


def cpu_id() -> Column:
    """The partition a row is worked on in."""
    return F.spark_partition_id()


def is_static(column: str = "static") -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def is_moving(column: str = "static") -> Column:
    return ~is_static(column)


def cpu_static(nodes: DataFrame, cpu: str = "cpu", static: str = "static") -> DataFrame:
    """Pinned nodes of each processor."""
    return nodes.groupBy(cpu).agg(F.sum(F.when(F.col(static), 1).otherwise(0)).cast("int").alias("cpu_static"))


def queue_size(pending: DataFrame, node: str = "node") -> DataFrame:
    """Facts that wait at each node."""
    return pending.groupBy(node).agg(F.count("*").cast("int").alias("queue_size"))


def facts_proved(derived: DataFrame, node: str = "node") -> DataFrame:
    return derived.groupBy(node).agg(F.count("*").cast("int").alias("facts_proved"))


def facts_consumed(used: DataFrame, node: str = "node") -> DataFrame:
    return used.groupBy(node).agg(F.count("*").cast("int").alias("facts_consumed"))


def partition_vertical(x, width, height, parts) -> Column:
    """Bands of columns: part of column x of a grid."""
    return F.floor(_c(x) * _c(parts) / _c(width)).cast("int")


def partition_horizontal(y, width, height, parts) -> Column:
    """Bands of rows: part of row y of a grid."""
    return F.floor(_c(y) * _c(parts) / _c(height)).cast("int")


def partition_grid(x, y, side, parts) -> Column:
    """Square blocks: ``parts`` is the number of blocks on a side of a grid ``side`` wide and high."""
    return (F.floor(_c(y) * _c(parts) / _c(side)) * _c(parts) + F.floor(_c(x) * _c(parts) / _c(side))).cast("int")


# board games ---------------------------------------------------------------------------


def queens_violation(column, rows) -> Column:
    """Whether a queen in ``column`` of the next row is attacked by earlier queens.

    ``rows`` holds the columns of the queens placed so far, the latest first.
    """
    near = F.transform(rows, lambda c, i: (c == _c(column)) | (F.abs(c - _c(column)) == i + 1))
    return F.exists(near, lambda x: x)


#: Lines of a 3 x 3 board by cell number (fixed values).
LINES = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6))


def minimax_score(board, player) -> Column:
    """1 if ``player`` has a full line, -1 if another player has, else 0; 0 is an empty cell."""
    cell = lambda i: F.get(board, F.lit(i))
    mine = reduce(lambda a, b: a | b, [(cell(a) == _c(player)) & (cell(b) == _c(player)) & (cell(c) == _c(player)) for a, b, c in LINES])
    full = reduce(lambda a, b: a | b, [(cell(a) != 0) & (cell(a) == cell(b)) & (cell(b) == cell(c)) for a, b, c in LINES])
    return F.when(mine, 1).when(full, -1).otherwise(0)


def minimax_points(board) -> Column:
    """Empty cells that are left."""
    return F.size(F.filter(board, lambda x: x == 0))


def minimax_score2(board, player) -> Column:
    return minimax_score(board, player)


def minimax_points2(board) -> Column:
    return minimax_points(board)


#: Registered names by number (fixed values).
NAMES = (
    "sigmoid", "randint", "normalize", "damp", "divide", "convolve", "addfloatlists", "intlistdiff", "lnth", "concatenate",
    "str2float", "str2int", "lremove", "wastetime", "truncate", "float2int", "int2str", "float2str", "intlistsub", "str2intlist",
    "filecountwords", "residual", "llength", "lappend", "priority", "lreverse", "listlast", "cpu_id", "node2int", "intpower",
    "lsort", "lremoveduplicates", "degeneratevector", "demergemessages", "intlistequal", "addfloatstructs", "normalizestruct",
    "dampstruct", "residualstruct", "dividestruct", "convolvestruct", "cpu_static", "is_moving", "is_static",
    "partition_vertical", "partition_horizontal", "partition_grid", "queue_size", "facts_proved", "facts_consumed",
    "listcount", "lexists", "lexistss", "queens_violation", "minimax_score", "minimax_points", "array_init", "array_get",
    "array_set", "array_add", "array_from_list", "array_size", "minimax_score2", "minimax_points2", "myfabs", "set_size",
    "set_exists", "set_add", "set_from_list", "array_exists", "ltake",
)
FUNCTIONS = {name: globals()[name] for name in NAMES}
