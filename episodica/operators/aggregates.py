"""Aggregations: exact statistics, merges of partial ones, errors, bins. Everything combines before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.durable import durable
from episodica.operators.ranks import with_group_table

#: The quantiles kept in statistics.
QUANTILES = {"q01": 0.01, "q99": 0.99, "q02": 0.02, "q98": 0.98}
#: A sketch's ranks are off by at most one part in so many.
ACCURACY = 10_000
SMALL = 2 * ACCURACY


def long_form(df: DataFrame, vectors: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """feature, dim, value: a row for each component of each vector."""
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(v).alias("__v")) for v in vectors)))
    return df.select(*keep, rows.alias("__f")).select(*keep, "__f.feature", F.posexplode("__f.__v").alias("dim", "value"))


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], others: Sequence[Column] = ()) -> DataFrame:
    """by, a column for each quantile (exact, linear between neighbours) and the other aggregates, named, of each group.

    A first pass aggregates, and brackets each quantile by a sketch of bounded size, whose ranks are off by less than one part in ACCURACY (in
    a group of fewer than SMALL values, where that may be less than a rank, by the least and greatest value). The second counts what lies below a bracket (above it for upper quantiles, whose values change sign for that) and selects within it: of a
    group of n values, a task sees some n / 2,500 distinct ones. A value that repeats is counted before the shuffle. Nulls don't count; a
    group without values has null quantiles.
    """
    x, slack = F.col(value).cast("double"), 2.0 / ACCURACY
    ends = [min(1.0, max(0.0, q + d)) for q in quantiles.values() for d in (-slack, slack)]
    first = rows.groupBy(*by).agg(F.count(x).alias("__n"), F.percentile_approx(x, ends, ACCURACY).alias("__b"), F.min(x).alias("__least"), F.max(x).alias("__most"), *others)
    first = durable(first, "brackets")
    signs = [-1.0 if q > 0.5 else 1.0 for q in quantiles.values()]
    small = F.col("__n") < SMALL
    found = lambda i, k: F.when(small, F.col("__most" if k else "__least")).otherwise(F.get("__b", F.lit(2 * i + k)))
    end = lambda i, k, s: found(i, k if s > 0 else 1 - k) * s
    spans = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("sign"), end(i, 0, s).alias("low"), end(i, 1, s).alias("high")) for i, s in enumerate(signs)))
    named = rows.select(*by, x.alias("__x")).filter("__x is not null")
    near = with_group_table(named, first.select(*by, spans.alias("__s")), by)
    # most values are beyond all brackets: they go before anything is made of the others
    near = near.filter(reduce(lambda a, b: a | b, (F.col("__x") * s <= F.get("__s", F.lit(i))["high"] for i, s in enumerate(signs))))
    # below a bracket only the number counts, so all such values are one
    hit = F.filter("__s", lambda s: F.col("__x") * s["sign"] <= s["high"])
    placed = F.transform(hit, lambda s: F.struct(s["i"].alias("i"), F.when(F.col("__x") * s["sign"] >= s["low"], F.col("__x") * s["sign"]).alias("v")))
    counted = near.select(*by, F.explode(placed).alias("__p")).groupBy(*by, F.col("__p.i").alias("__i"), F.col("__p.v").alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by, "__i").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("__to", F.sum("__c").over(w))
    sizes = first.select(*(F.col(c).alias(f"__h{i}") for i, c in enumerate(by)), "__n")
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__h{i}"))
    counted = counted.join(sizes, on)
    q = F.element_at(F.array(*(F.lit(float(v)) for v in quantiles.values())), F.col("__i") + 1)
    sign, rank = F.when(q > 0.5, -1.0).otherwise(1.0), q * (F.col("__n") - 1)
    rank = F.when(q > 0.5, F.col("__n") - 1 - rank).otherwise(rank)
    at = lambda r: F.min(F.when(F.col("__to") > r, F.col("__v")))
    ends_ = counted.groupBy(*by, "__i").agg(at(F.floor(rank)).alias("__floor"), at(F.ceil(rank)).alias("__ceil"), F.first(rank - F.floor(rank)).alias("__f"), F.first(sign).alias("__sign"))
    between = ends_.withColumn("__q", F.when(F.col("__floor") == F.col("__ceil"), F.col("__floor")).otherwise(F.col("__floor") + (F.col("__ceil") - F.col("__floor")) * F.col("__f")))
    wide = between.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == i, F.col("__q") * F.col("__sign"))).alias(n) for i, n in enumerate(quantiles)))
    wide = wide.select(*(F.col(c).alias(f"__h{i}") for i, c in enumerate(by)), *quantiles)
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & first[c].eqNullSafe(F.col(f"__h{i}"))
    return first.join(wide, on, "left").drop("__n", "__b", "__least", "__most", *(f"__h{i}" for i in range(len(by))))


def exact_stats(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """mean, std (population), min, max, exact quantiles with linear interpolation, count; of groups of any size."""
    x = F.col(value).cast("double")
    plain = [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count")]
    return exact_quantiles(rows, by, value, QUANTILES, plain).select(*by, "mean", "std", "min", "max", *QUANTILES, "count")


def plain_stats(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """mean, std (population), min, max, count: one pass, without quantiles."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count"))


def sketched_stats(rows: DataFrame, by: Sequence[str], value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """As exact_stats, with quantiles from a mergeable sketch of bounded size: for groups of any number of values."""
    x = F.col(value).cast("double")
    qs = F.percentile_approx(x, list(QUANTILES.values()), accuracy)
    out = rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), qs.alias("__q"), F.count(x).alias("count"))
    return out.select(*by, "mean", "std", "min", "max", *(F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)), "count")


def ranks_near(rows: DataFrame, by: Sequence[str], value: str, found: DataFrame, quantiles: Mapping[str, float], slack: float) -> DataFrame:
    """by and near: whether the share of a group's values below each quantile of `found` is at most q + slack, and the share of those not above
    it at least q - slack. Values are counted over all rows; found has a row for each group, and should be durable."""
    near = with_group_table(rows.select(*by, F.col(value).cast("double").alias("__x")).filter("__x is not null"), found.select(*by, *quantiles), by)
    shares = [F.avg(hit.cast("int")) for q in quantiles for hit in (F.col("__x") < F.col(q), F.col("__x") <= F.col(q))]
    within = F.lit(True)
    for i, q in enumerate(quantiles.values()):
        within = within & (shares[2 * i] <= q + slack) & (shares[2 * i + 1] >= q - slack)
    return near.groupBy(*by).agg(within.alias("near"))


def moments(by: Sequence[str], rows: DataFrame, value: str = "value") -> DataFrame:
    """n, s1, s2: what merges exactly."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.min(x).alias("min"), F.max(x).alias("max"))


def from_moments(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact merge of moments: the spread between groups counts."""
    out = df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")), F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.col("s1") / F.col("n")
    return out.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("std"), "min", "max", F.col("n").alias("count"))


def weighted_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge of mean, std, min, max, count by counts: std is the root of the mean variance within groups, what is between them left out.

    If any count of a group is null, means and stds are averaged unweighted and count is null.
    """
    n, all_known = F.col("count").cast("double"), F.count("count") == F.count("*")
    mean = F.when(all_known, F.sum(F.col("mean") * n) / F.sum(n)).otherwise(F.avg("mean"))
    std = F.when(all_known, F.sqrt(F.sum(F.col("std") * F.col("std") * n) / F.sum(n))).otherwise(F.avg("std"))
    return df.groupBy(*by).agg(mean.alias("mean"), std.alias("std"), F.min("min").alias("min"), F.max("max").alias("max"), F.when(all_known, F.sum("count")).alias("count"))


def errors(rows: DataFrame, by: Sequence[str], error: Column) -> DataFrame:
    """mae, mse, rmse, scalar_count from sums that merge."""
    e = error.cast("double")
    out = rows.groupBy(*by).agg(F.sum(F.abs(e)).alias("__a"), F.sum(e * e).alias("__s"), F.count(e).alias("scalar_count"))
    mse = F.col("__s") / F.col("scalar_count")
    return out.select(*by, (F.col("__a") / F.col("scalar_count")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), "scalar_count")


def in_groups(rows: DataFrame, groups: Mapping[str, Sequence[int]], dim: str = "dim", out: str = "group") -> DataFrame:
    """A row for each group that its dimension belongs to: a dimension may be in several."""
    table = rows.sparkSession.createDataFrame([(g, int(d)) for g, ds in groups.items() for d in ds], f"{out} string, __d int")
    return rows.join(F.broadcast(table), F.col(dim) == F.col("__d")).drop("__d")  # a row for each place of a group


def in_bins(rows: DataFrame, value: Column, bins: Sequence[tuple[str, float, float]], out: str = "bin") -> DataFrame:
    """A row for each bin [low, high) that holds the value; bins may overlap. Bins are the caller's, so they become an expression."""
    hits = F.array_compact(F.array(*(F.when((value >= a) & (value < b), F.lit(n)) for n, a, b in bins)))
    return rows.withColumn(out, F.explode(hits))


def joint_errors(rows: DataFrame, by: Sequence[str], error: Column) -> DataFrame:
    """mae, rmse and the 95th percentile of the absolute error, in degrees."""
    e = F.abs(F.degrees(error.cast("double")))
    rows = rows.select(*by, e.alias("__e"))
    e = F.col("__e")
    return exact_quantiles(rows, by, "__e", {"p95": 0.95}, [F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")]).select(*by, "mae", "rmse", "p95")


def summary(rows: DataFrame, by: Sequence[str], value: str, above: float = 1.0) -> DataFrame:
    """count, mean, median, std (population), p95, max and how many are above a bound."""
    x = F.col(value).cast("double")
    plain = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("max"), F.count_if(x > above).alias("above")]
    out = exact_quantiles(rows, by, value, {"median": 0.5, "p95": 0.95}, plain)
    return out.select(*by, "count", "mean", "median", "std", "p95", "max", "above")


def step_bins(rows: DataFrame, step: str, value: str, size: int) -> DataFrame:
    """Means of values over bins of `size` steps, steps from 1."""
    return rows.groupBy(F.floor((F.col(step) - 1) / size).cast("long").alias("bin")).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))


def argmax(rows: DataFrame, by: Sequence[str], value: Column, place: Sequence[str]) -> DataFrame:
    """The greatest absolute value of a group and the first place, in the order of place, that has it; nulls count only where there is nothing else."""
    best = F.min(F.struct(F.coalesce(-F.abs(value), F.lit(float("inf"))).alias("least"), F.abs(value).alias("peak"), *place)).alias("__p")
    return rows.groupBy(*by).agg(best).select(*by, F.col("__p.peak").alias("peak"), *(F.col(f"__p.{p}").alias(p) for p in place))


def two_level_mean(rows: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Mean of the inner groups' means, each of which counts once."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("__m")).groupBy(*outer).agg(F.avg("__m").alias("mean"), F.count("*").alias("groups"))


def contrast(rows: DataFrame, by: Sequence[str], label: str, value: str) -> DataFrame:
    """mean_up, mean_down and their difference for each cell of by."""
    up, down = F.avg(F.when(F.col(label), F.col(value))), F.avg(F.when(~F.col(label), F.col(value)))
    return rows.groupBy(*by).agg(up.alias("mean_up"), down.alias("mean_down")).withColumn("difference", F.col("mean_up") - F.col("mean_down"))


def bin_count(rows: DataFrame, ids: str, n_bins: int) -> DataFrame:
    """How often each id from 0 to n_bins - 1 occurs; 0 for those that don't."""
    all_bins = rows.sparkSession.range(n_bins).withColumnRenamed("id", "bin")
    counted = rows.groupBy(F.col(ids).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return all_bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Sum of value * weight over the sum of weights; 0 where that is 0."""
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias("mean"))


def global_norm(rows: DataFrame, by: Sequence[str], value: str, most: float, p: float = 2.0) -> DataFrame:
    """(sum |x|^p)^(1/p), or the greatest |x| for infinite p, and the factor min(1, most / (norm + 1e-6)) that clips it."""
    x = F.abs(F.col(value).cast("double"))
    n = F.max(x) if p == float("inf") else F.sqrt(F.sum(x * x)) if p == 2 else F.pow(F.sum(F.pow(x, F.lit(p))), F.lit(1 / p))
    return rows.groupBy(*by).agg(n.alias("norm")).withColumn("clip", F.least(F.lit(1.0), F.lit(most) / (F.col("norm") + 1e-6)))


def success_rates(rows: DataFrame, by: str, success: Column) -> DataFrame:
    """Trials, successes and rate of each group and of all (total)."""
    out = rows.rollup(by).agg(F.count("*").alias("trials"), F.count_if(success).alias("successes"), F.grouping(by).alias("__g"))
    return out.select(F.when(F.col("__g") == 1, F.lit("total")).otherwise(F.col(by).cast("string")).alias(by), "trials", "successes", (F.col("successes") / F.col("trials")).alias("rate"))


def latest_complete(files: DataFrame, path: str, pattern: str, required: Sequence[str]) -> DataFrame:
    """The greatest step whose folder has all required files. pattern's first group is the step, its second the file's name."""
    parts = files.select(F.regexp_extract(path, pattern, 1).alias("s"), F.regexp_extract(path, pattern, 2).alias("f")).filter("s <> ''")
    have = parts.groupBy(F.col("s").cast("long").alias("step")).agg(*(F.bool_or(F.col("f") == r).alias(f"__{i}") for i, r in enumerate(required)))
    return have.filter(" and ".join(f"__{i}" for i in range(len(required)))).agg(F.max("step").alias("step"))


def strided_evaluation(rows: DataFrame, keys: Sequence[str], frame: str, stride: int, most: int, error: Column) -> DataFrame:
    """mse and mae of each trajectory over its first `most` windows of `stride` frames."""
    rows = rows.filter(F.floor(F.col(frame) / stride) < most)
    e = error.cast("double")
    return rows.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def pairwise_cosine(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return rows.groupBy(*by).agg(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))


def throughput(rows: DataFrame, by: Sequence[str], tokens: str, samples: str, seconds: str, global_batch: int) -> DataFrame:
    """Tokens a second, tokens of a slot and of a real sample."""
    out = rows.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.sum(samples).alias("samples"), F.sum(seconds).alias("seconds"), F.count("*").alias("batches"))
    return out.select(*by, "tokens", F.try_divide("tokens", "seconds").alias("tokens_per_second"), (F.col("tokens") / (F.col("batches") * global_batch)).alias("mean_slot_length"), F.try_divide("tokens", "samples").alias("mean_sample_length"))
