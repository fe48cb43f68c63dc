"""Column functions on vectors (arrays of numbers). All are built-in expressions; arithmetic is in double."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*cols: str | Column) -> Column:
    return F.array(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cols))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x being computed once however often f names it: within a lambda nothing else keeps an expression from being repeated."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def cut(x: Column, start: int, end: int) -> Column:
    """x[start:end], counted from 0."""
    return F.slice(x, start + 1, end - start)


def cut_concat(pieces: Sequence[tuple[Column, int, int]]) -> Column:
    """Slices of vectors, one after the other."""
    return F.concat(*(cut(x, a, b) for x, a, b in pieces))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def blend(x: Column, y: Column, weight: Column | float) -> Column:
    """(1 - weight) x + weight y."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.zip_with(x, y, lambda a, b: a * (F.lit(1.0) - w) + b * w)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(x: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(x, lambda v: v.isNotNull() & is_finite(v))


def every(x: Column, y: Column, test: Callable[[Column, Column], Column], size: int | None = None) -> Column:
    """Whether test holds for all pairs of components; of vectors of `size` components by generated code. x and y should be columns: they are named often."""
    out = F.forall(F.zip_with(x, y, test), lambda t: t)
    if not size:
        return out
    each = [test(F.get(x, F.lit(i)), F.get(y, F.lit(i))) for i in range(size)]
    return F.when((F.size(x) == size) & (F.size(y) == size), reduce(lambda a, b: a & b, each)).otherwise(out)


def pad_right(x: Column, size: int | Column, value: Column) -> Column:
    """x and as many values as are missing to size; longer vectors stay."""
    n = size if isinstance(size, Column) else F.lit(size)
    return F.concat(x, F.array_repeat(value, F.greatest(n - F.size(x), F.lit(0))))


def fixed_length(x: Column, size: int, value: Column) -> Column:
    """Padded or cut to size."""
    return F.slice(pad_right(x, size, value), 1, size)


def real_mask(n_real: int | Column, size: int) -> Column:
    """true for the first n_real of size places."""
    n = n_real if isinstance(n_real, Column) else F.lit(n_real)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n)


def keep_masked(x: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(x.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def next_multiple(n: Column, of: int = 8) -> Column:
    return n + F.pmod(-n, F.lit(of))


def multiple_padded(x: Column, of: int, value: Column) -> Column:
    """Padded right to a multiple of `of`."""
    return pad_right(x, next_multiple(F.size(x), of), value)


def shard_of(x: Column, rank: int | Column, n_ranks: int) -> Column:
    """The rank's slice of ceil(size / n_ranks) values."""
    n = F.ceil(F.size(x) / F.lit(float(n_ranks))).cast("int")
    r = rank if isinstance(rank, Column) else F.lit(rank)
    return F.slice(x, r.cast("int") * n + 1, n)


def indices(n: Column) -> Column:
    """[0, ..., n - 1]; empty for 0 (a sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def chunks(x: Column, size: int) -> Column:
    """x cut into slices of size, the last maybe shorter; none for an empty x."""
    n = F.ceil(F.size(x) / F.lit(float(size))).cast("int")
    return F.transform(indices(n), lambda i: F.slice(x, i * size + 1, F.lit(size)))


def cumulative_lengths(lengths: Column) -> Column:
    """[0, l0, l0 + l1, ...]."""
    step = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n.cast("long")))
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), step)


def lengths_from_cumulative(cu: Column) -> Column:
    return F.transform(indices(F.size(cu) - 1), lambda i: F.get(cu, i + 1) - F.get(cu, i))


def position_ids(lengths: Column) -> Column:
    """0, 1, ... for each length."""
    return F.flatten(F.transform(lengths, lambda n: indices(n)))


def starts_from_positions(positions: Column) -> Column:
    """Places where a sequence begins: position 0."""
    return F.filter(indices(F.size(positions)), lambda i: F.get(positions, i) == 0)
