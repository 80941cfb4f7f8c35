"""Vector functions as native Spark expressions (no UDF).

Vectors are ``array<double>`` columns; ML ``VectorUDT`` columns are converted at the
edges with ``vector_to_array`` / ``array_to_vector``. Sums run as a left fold in index
order, the same order a SQL ``list_reduce`` uses, so results are bit-equal across engines.
Sparse vectors are (indices array<int>, values array<double>) pairs, 0-based.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .keys import _as_col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    Catalyst inlines projected expressions into lambdas, where they would be evaluated
    once per array element; binding through a one-element ``transform`` keeps it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double_array(df: DataFrame, col: str) -> Column:
    """The column as array<double>, converting an ML vector column if needed."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, ArrayType):
        return F.col(col).cast("array<double>")
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col), "float64")


def to_ml_vector(c: str | Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(_as_col(c))


def _fold_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: str | Column, y: str | Column) -> Column:
    return _fold_sum(F.zip_with(_as_col(x), _as_col(y), lambda a, b: a * b))


def l2_norm(x: str | Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine_from_parts(d: Column, nx: Column, ny: Column) -> Column:
    """Cosine similarity from a dot product and two norms; 0.0 when a norm is 0."""
    return F.when((nx != 0.0) & (ny != 0.0), d / (nx * ny)).otherwise(F.lit(0.0))


def cosine_similarity(x: str | Column, y: str | Column) -> Column:
    return cosine_from_parts(dot(x, y), l2_norm(x), l2_norm(y))


def euclidean_distance(x: str | Column, y: str | Column) -> Column:
    return F.sqrt(_fold_sum(F.zip_with(_as_col(x), _as_col(y), lambda a, b: (a - b) * (a - b))))


def nonzero_indices(x: str | Column) -> Column:
    """0-based positions of the non-zero entries."""
    marked = F.transform(_as_col(x), lambda v, i: F.when(v != 0.0, i))
    return F.filter(marked, lambda i: i.isNotNull())


def common_indices(a: str | Column, b: str | Column) -> Column:
    """Sorted intersection of two index arrays."""
    return F.sort_array(F.array_intersect(_as_col(a), _as_col(b)))


def union_indices(a: str | Column, b: str | Column) -> Column:
    """Sorted union of two index arrays."""
    return F.sort_array(F.array_union(_as_col(a), _as_col(b)))


def index_value_map(indices: str | Column, values: str | Column) -> Column:
    return F.map_from_arrays(_as_col(indices), _as_col(values))


def sparse_to_dense(size: int | Column, indices: str | Column, values: str | Column) -> Column:
    """Dense array of ``size`` with the given (0-based, distinct) entries, 0.0 elsewhere.

    One pass over the sorted entries: the zeros of each gap, then the value.
    An index that is negative, given twice or not under ``size`` fails the job.
    """
    n = size if isinstance(size, Column) else F.lit(size)
    entries = F.array_sort(F.zip_with(_as_col(indices), _as_col(values), lambda i, v: F.struct(
        i.alias("i"), v.alias("v"))))

    def zeros(count: Column) -> Column:
        return F.when(count >= 0, F.array_repeat(F.lit(0.0), count.cast("int"))).otherwise(
            F.raise_error(F.lit("index out of range or given twice")))

    def dense(own: Column) -> Column:
        before = lambda k: F.when(k == 0, -1).otherwise(F.get(own, k - 1)["i"])
        parts = F.transform(own, lambda p, k: F.concat(zeros(p["i"] - before(k) - 1), F.array(p["v"])))
        last = F.coalesce(F.try_element_at(own, F.lit(-1))["i"], F.lit(-1))
        return F.concat(F.flatten(parts), zeros(n - 1 - last))

    return let(entries, dense)


def dense_to_sparse(x: str | Column) -> tuple[Column, Column]:
    """(indices, values) of the non-zero entries."""
    idx = nonzero_indices(x)
    return idx, F.transform(idx, lambda i: F.element_at(_as_col(x), i + 1))


def interpolate(x: str | Column, y: str | Column,
                gap: Callable[[Column], Column]) -> Column:
    """x + gap(i) * (y - x) per position i (0-based); ``gap`` gives a [0, 1) number."""
    return let(_as_col(y), lambda yc: F.transform(
        _as_col(x), lambda v, i: v + gap(i) * (F.element_at(yc, i + 1) - v)
    ))


def sparse_interpolate(x: tuple[str | Column, str | Column], y: tuple[str | Column, str | Column],
                       gap: Callable[[Column], Column]) -> Column:
    """x + gap(index) * (y - x) of two sparse vectors, as array<struct<i int, v double>>.

    Each is (ascending distinct indices, values). The result holds every index of either, in
    order, and is never made dense: the entries of both are sorted together and neighbours with
    the same index merged; an index that only one has is zero in the other. Null if either
    is null; ``gap`` is asked per index, so it can be the same for a dense twin.
    """

    def entries(sparse: tuple[str | Column, str | Column], side: int) -> Column:
        return F.zip_with(_as_col(sparse[0]), _as_col(sparse[1]), lambda i, v: F.struct(
            i.cast("int").alias("i"), F.lit(side).alias("side"), v.cast("double").alias("v")))

    def merged(both: Column) -> Column:
        def entry(e: Column, k: Column) -> Column:
            after = F.get(both, k + 1)
            second = F.when(after["i"] == e["i"], after["v"]).otherwise(F.lit(0.0))
            one = F.when(e["side"] == 0, e["v"]).otherwise(F.lit(0.0))
            two = F.when(e["side"] == 0, F.coalesce(second, F.lit(0.0))).otherwise(e["v"])
            return F.struct(e["i"].alias("i"), (one + gap(e["i"]) * (two - one)).alias("v"),
                            ((k == 0) | (F.get(both, k - 1)["i"] != e["i"])).alias("first"))

        return F.transform(F.filter(F.transform(both, entry), lambda e: e["first"]),
                           lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v")))

    return let(F.array_sort(F.concat(entries(x, 0), entries(y, 1))), merged)
