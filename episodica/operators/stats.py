"""Inference: t tests, effect sizes, false discovery rates, resampling of whole episodes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.durable import durable
from episodica.operators.ranks import SLICE_DIGITS, array_of, suffix_least


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method, on arrays."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with df degrees: the regularized incomplete beta function at df / (df + t^2). Without a degree there is none."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    df = np.where(df > 0, df, np.nan)
    a, b, x = np.nan_to_num(df, nan=2.0) / 2, np.full_like(df, 0.5), df / (df + t * t)
    x = np.clip(np.nan_to_num(x, nan=0.5), 1e-300, 1 - 1e-16)
    front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    direct = front * _beta_fraction(a, b, x) / a
    other = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return np.where(np.isnan(t) | np.isnan(df), np.nan, np.where(t == 0, 1.0, np.where(low, direct, other)))


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    import numpy as np

    from episodica.operators.stats import two_sided_p

    return pd.Series(two_sided_p(t.to_numpy(np.float64), df.to_numpy(np.float64)))


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null for null."""
    return F.when(t.isNotNull() & df.isNotNull(), _p_value(t.cast("double"), df.cast("double")))


def welch(rows: DataFrame, by: Sequence[str], label: str, value: str) -> DataFrame:
    """t and df of Welch's test of label true against false, with means, variances and counts of both.

    Where both groups are constant t and df are null, and constant_p is 1 if their means are equal, else 0.
    """
    x = F.col(value).cast("double")
    one = lambda flag: F.when(F.col(label) if flag else ~F.col(label), x)
    out = rows.groupBy(*by).agg(*(f(one(s)).alias(f"{n}{k}") for k, s in ((1, True), (2, False)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))))
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    flat = (F.col("var1") == 0) & (F.col("var2") == 0)
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2))
    df = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1))
    return out.withColumn("t", F.when(~flat, t)).withColumn("df", F.when(~flat, df)).withColumn("constant_p", F.when(flat, F.when(F.col("mean1") == F.col("mean2"), 1.0).otherwise(0.0)))


def welch_p() -> Column:
    """p of welch()'s rows: of cells without any variance what their means say, else Student's."""
    return F.coalesce("constant_p", p_value(F.col("t"), F.col("df")))


def one_sample(rows: DataFrame, by: Sequence[str], value: str, mean: float = 0.0) -> DataFrame:
    """t and df of the test that the mean is `mean`."""
    x = F.col(value).cast("double")
    out = rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
    return out.withColumn("t", F.try_divide(F.col("mean") - mean, F.col("sd") / F.sqrt("n"))).withColumn("df", F.col("n") - 1)


def cohen_d(tested: DataFrame, out: str = "d") -> DataFrame:
    """Difference of means over the root of the mean variance, of welch()'s rows; 0 where that is 0."""
    pooled = (F.col("var1") + F.col("var2")) / 2
    return tested.withColumn(out, F.when(pooled > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled)).otherwise(0.0))


def benjamini_hochberg(df: DataFrame, p: str, order: Sequence[str], out: str = "q", family: Sequence[str] = ()) -> DataFrame:
    """q = min over p's not below of p m / rank, at most 1; p that are null or not finite count as 1.

    Without a family the whole table is one, of any size: ranks and minima are found by ranges. A family given by columns is one task.
    """
    df = df.withColumn("__p", F.when(F.col(p).isNull() | F.isnan(p) | (F.abs(F.col(p)) == float("inf")), 1.0).otherwise(F.col(p)))
    if not family:
        least = suffix_least(df, F.col("__p") * F.col("__rows") / F.col("__rank"), ["__p", *order], out)
        return least.withColumn(out, F.least(F.lit(1.0), F.col(out))).drop("__p")
    w = Window.partitionBy(*family)
    df = df.withColumn("__r", F.row_number().over(w.orderBy("__p", *order))).withColumn("__m", F.count("*").over(w))
    q = F.min(F.col("__p") * F.col("__m") / F.col("__r")).over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.least(F.lit(1.0), q)).drop("__p", "__r", "__m")


def normal_interval(rows: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    x = F.col(value).cast("double")
    out = rows.groupBy(*by).agg(F.avg(x).alias("mean"), (F.lit(z) * F.stddev_samp(x) / F.sqrt(F.count(x))).alias("__h"))
    return out.select(*by, "mean", (F.col("mean") - F.col("__h")).alias("low"), (F.col("mean") + F.col("__h")).alias("high"))


def _unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from md5, alike in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def bootstrap_means(units: DataFrame, id_col: str, value: str, reps: int, seed: int) -> DataFrame:
    """rep and mean of `reps` resamples of the units, each weighted by a Poisson(1) number from a hash of (seed, rep, unit).

    Poisson weights stand for multinomial ones, so that no unit has to know how many there are: the sums combine before the shuffle.
    """
    rows = units.select(F.col(id_col).alias("__i"), F.col(value).cast("double").alias("__x"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = _unit(F.lit(seed), F.col("rep"), F.col("__i"))
    cdf, p = [], math.exp(-1)
    acc = p
    for k in range(1, 13):
        cdf.append(acc)
        p /= k
        acc += p
    weight = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    rows = rows.withColumn("__w", weight)
    return rows.groupBy("rep").agg(F.try_divide(F.sum(F.col("__x") * F.col("__w")), F.sum("__w")).alias("mean"))


def bootstrap_interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return means.agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))


#: How far around the share of the first label its border is looked for: standard deviations of an order statistic of uniform hashes.
BORDER_DEVIATIONS = 6


def _relabelled(base: DataFrame, seed: int, reps: Column, k: int, low: str, high: str) -> DataFrame:
    """rep, s and c (sum and count of the values of the k units of the smallest hashes), and found: whether the k-th hash is in [low, high).

    Units outside are counted and summed before the shuffle, those from high on as none; only those between are ranked.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("__i").cast("string")).cast("binary"))
    rows = base.withColumn("rep", F.explode(reps)).withColumn("__u", hashed)
    below, x = F.col("__u") < high, F.when(F.col("__u") < high, F.col("__x"))
    near = below & (F.col("__u") >= low)
    some = rows.groupBy("rep", F.when(near, F.col("__u")).alias("__u"), F.when(near, F.col("__i")).alias("__i")).agg(F.count_if(below).alias("__n"), F.sum(x).alias("__sum"), F.count(x).alias("__count"))
    order = Window.partitionBy("rep").orderBy(F.col("__u").asc_nulls_first(), "__i").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("__to", F.sum("__n").over(order))
    kept = F.col("__to") <= k
    found = (F.max("__to") >= k) & (F.coalesce(F.max(F.when(F.col("__u").isNull(), F.col("__n"))), F.lit(0)) <= k)
    return some.groupBy("rep").agg(F.coalesce(F.sum(F.when(kept, F.col("__sum"))), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(kept, F.col("__count"))), F.lit(0)).alias("c"), found.alias("found"))


def permutation_test(units: DataFrame, id_col: str, label: str, value: str, reps: int, seed: int) -> DataFrame:
    """observed difference of means, and p = (1 + how many of `reps` relabellings reach it) / (reps + 1).

    In each relabelling the units of the first label are those of the smallest hashes, so the groups keep their sizes. Each unit is hashed once
    for each relabelling. The k-th of n uniform hashes lies near k / n: only the units within BORDER_DEVIATIONS of it, some 3 / sqrt(n) of all
    to either side, are ranked. A relabelling whose border isn't there is found by ranking all its units.
    """
    x = F.col(value).cast("double")
    base = durable(units.select(F.col(id_col).alias("__i"), F.col(label).alias("__l"), x.alias("__x")), "units")
    seen = base.agg(F.avg(F.when(F.col("__l"), F.col("__x"))).alias("a"), F.avg(F.when(~F.col("__l"), F.col("__x"))).alias("b"), F.count_if("__l").alias("k"), F.count("*").alias("n"), F.sum("__x").alias("sum"), F.count("__x").alias("count")).first()
    k, n = seen["k"], max(seen["n"], 1)
    wide = BORDER_DEVIATIONS * math.sqrt(k / n * (1 - k / n) / n) + BORDER_DEVIATIONS / n
    slices = 16**SLICE_DIGITS  # the border's ends are whole slices of the hashes
    low, high = math.floor((k / n - wide) * slices), math.ceil((k / n + wide) * slices)
    at = lambda s: "" if s <= 0 else "g" if s >= slices else f"{s:0{SLICE_DIGITS}x}"
    # a unit is small and the work on it is not, so that units are dealt by number, whatever their bytes are
    base = base.select("__i", "__x").repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__i")
    every = F.sequence(F.lit(1), F.lit(reps))
    known = durable(_relabelled(base, seed, every, k, at(low), at(high)), "permutation")
    both = known.filter("found")
    missing = sorted(set(range(1, reps + 1)) - {r[0] for r in both.select("rep").collect()})  # a number for each relabelling
    if missing:
        both = both.unionByName(_relabelled(base, seed, array_of(missing).cast("array<int>"), k, "", "g"))
    lit = lambda c: F.lit(seen[c]).cast("double")
    one, n1 = F.col("s"), F.col("c")
    null = both.select((lit("a") - lit("b")).alias("observed"), (F.try_divide(one, n1) - F.try_divide(lit("sum") - one, lit("count") - n1)).alias("d"))
    return null.groupBy("observed").agg(((1 + F.count_if(F.abs(F.col("d")) >= F.abs(F.col("observed")) - 1e-12)) / F.lit(float(reps + 1))).alias("p"))
