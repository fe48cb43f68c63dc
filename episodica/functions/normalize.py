"""Normalization of vectors by statistics, and its inverses."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what every denominator is raised by.
EPS = 1e-6
KINDS = ("identity", "meanstd", "bounds_99", "minmax")


@dataclass(frozen=True)
class Scaling:
    """kind and, by its needs, statistics for each dimension: mean and std, q01 and q99, or min and max."""

    kind: str
    stats: Mapping[str, Sequence[float]] | None = None

    def bounds(self) -> tuple[Sequence[float], Sequence[float]]:
        low, high = ("q01", "q99") if self.kind == "bounds_99" else ("min", "max")
        return self.stats[low], self.stats[high]


def scaled(kind: str, x: Column, a: Column, b: Column) -> Column:
    """One component: a and b are mean and std, or the low and high bound. Values beyond the bounds are not clipped."""
    if kind == "identity":
        return x
    if kind == "meanstd":
        return (x - a) / (b + EPS)
    if kind in KINDS:
        return (x - a) / (b - a + EPS) * 2 - 1
    raise ValueError(f"unknown normalization {kind}")


def unscaled(kind: str, x: Column, a: Column, b: Column) -> Column:
    if kind == "identity":
        return x
    if kind == "meanstd":
        return x * (b + EPS) + a
    if kind in KINDS:
        return (x + 1) / 2 * (b - a + EPS) + a
    raise ValueError(f"unknown normalization {kind}")


def _vector(x: Column, s: Scaling, one: Callable[[str, Column, Column, Column], Column]) -> Column:
    if s.kind not in KINDS:
        raise ValueError(f"unknown normalization {s.kind}")
    if s.kind == "identity" or s.stats is None:  # no statistics: as it is
        return x
    low, high = (s.stats["mean"], s.stats["std"]) if s.kind == "meanstd" else s.bounds()
    lits = lambda v: F.array(*(F.lit(float(i)) for i in v))
    # vectors of the expected width stay in generated code
    plain = F.array(*(one(s.kind, F.get(x, F.lit(i)), F.lit(float(a)), F.lit(float(b))) for i, (a, b) in enumerate(zip(low, high, strict=True))))
    return F.when(F.size(x) == len(low), plain).otherwise(_zipped(x, s, one, lits(low), lits(high)))


def _zipped(x: Column, s: Scaling, one: Callable[[str, Column, Column, Column], Column], low: Column, high: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), low.alias("a"), high.alias("b")), lambda z: one(s.kind, z["x"], z["a"], z["b"]))


def normalized(x: Column, s: Scaling) -> Column:
    return _vector(x, s, scaled)


def unnormalized(x: Column, s: Scaling) -> Column:
    return _vector(x, s, unscaled)


def each(values: Sequence[Column], s: Scaling, inverse: bool = False) -> list[Column]:
    """The components of one vector, given one by one, normalized or, for inverse, back from that."""
    if s.kind == "identity" or s.stats is None:
        return list(values)
    low, high = (s.stats["mean"], s.stats["std"]) if s.kind == "meanstd" else s.bounds()
    return [(unscaled if inverse else scaled)(s.kind, x, F.lit(float(a)), F.lit(float(b))) for x, a, b in zip(values, low, high, strict=True)]
