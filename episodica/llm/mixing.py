"""Mixing sources to target weights by Poisson replication.

A source with target share w of an output of T rows and n rows of its own gets the rate w * T / n. Each row's number of copies is the
Poisson quantile, with that mean, of a uniform number hashed from seed and id; rows are exploded by that number and shuffled globally by a
hash of id and copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import durable, longs, md5_unit

#: A larger mean is the sum of equal parts of at most this: Poisson variables add, and exp(-mean) stays far from underflow.
MOST_MEAN = 16.0
#: Terms of the inverted distribution function; beyond them lies less than 2 ** -60 for a mean of MOST_MEAN.
TERMS = 64
#: Sources up to which their table of rates is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000
#: Parts of a source's rows where the rates have to be joined by a shuffle.
SALTS = 32


def poisson_cdf(mean: Column, terms: int = TERMS) -> Column:
    """[P(X <= 0), ..., P(X <= terms - 1)] for a Poisson variable X; mean at most MOST_MEAN."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, power: float, total: int | None) -> DataFrame:
    """A row for each source, null included: source, rate, parts and cdf of mean rate / parts.

    weights: target share by source, scaled to sum 1 over the sources that exist; a source without one gets 0. Without weights, a source of
    n rows weighs n ** power. total: rows wanted; by default as many as there are.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        n = n.join(known, n["source"].eqNullSafe(known["k"]), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    n = durable(n, "mix-sources")
    wanted, weight = n.agg(F.sum("n"), F.sum("w")).first()
    rate = F.col("w") * F.lit(float(total if total is not None else wanted or 0)) / F.lit(weight or 1.0) / F.col("n")
    rates = n.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN).cast("int")))
    return durable(rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts"))), "mix-rates")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    total: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Rows of docs, each as often as its Poisson number says, with columns copy (from 1), n_copies, rate and mix_key added.

    A null source is a source of its own. A null id draws its number from the empty string. Repeated ids draw alike: replication is by id.
    A source with weight 0 goes. An empty table stays empty. An existing column of an added column's name is overwritten. mix_key is a
    uniform 60-bit long; ascending order of it is the global shuffle (shuffled() makes it the order of the files).
    """
    rates = source_rates(docs, source_col, weights, power, total)
    docs = docs.drop("copy", "n_copies", "rate", "mix_key")
    rates = rates.select(F.col("source").alias("__s"), F.col("rate").alias("__rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        out = docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(F.col("__s")))
    else:  # the rows of a large source are dealt over SALTS parts
        out = docs.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)))
        spread = rates.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.join(spread, F.col(source_col).eqNullSafe(F.col("__s")) & (F.col("__salt") == F.col("__salt2")))
        out = out.drop("__salt", "__salt2")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = lambda part: md5_unit(F.concat_ws("|", F.lit(f"mix{seed}"), ident, part.cast("string")))
    one = lambda part: F.size(F.filter(F.col("__cdf"), lambda c: c <= u(part)))
    first = F.size(F.filter(F.col("__cdf"), lambda c: c <= F.col("__u")))
    rest = F.aggregate(F.sequence(F.lit(2), F.col("__parts")), F.lit(0), lambda acc, part: acc + one(part))
    out = out.withColumn("__u", u(F.lit(1))).withColumn("n_copies", (first + F.when(F.col("__parts") > 1, rest).otherwise(0)).cast("int"))
    out = out.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), ident, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return out.withColumn("rate", F.col("__rate")).withColumn("mix_key", key).drop("__s", "__rate", "__parts", "__cdf", "__u")


def shuffled(mixed: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """mixed in the order of mix_key over all partitions.

    The key is uniform in 60 bits, so equal slices of its range hold about equally many rows, and a row's partition is known without a sample
    of the table.
    """
    n = n_partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("mix_key") / F.lit(2.0**60) * n).cast("int"), F.lit(n - 1))
    return mixed.repartitionById(n, part).sortWithinPartitions("mix_key")


def with_positions(mixed: DataFrame, tie_cols: list[str], slice_bits: int = 10) -> DataFrame:
    """mixed with position, the gapless rank by (mix_key, tie_cols) from 0.

    The 60-bit key's leading bits make 2 ** slice_bits slices of about equal size; ranks are found in each and shifted by the slices' counts.
    """
    sliced = durable(mixed.withColumn("__slice", F.shiftright("mix_key", 60 - slice_bits).cast("int")), "mix-sliced")
    n = {r[0]: r[1] for r in sliced.groupBy("__slice").count().collect()}
    before, seen = [], 0
    for k in range(1 << slice_bits):
        before.append(seen)
        seen += n.get(k, 0)
    rank = F.row_number().over(Window.partitionBy("__slice").orderBy("mix_key", *tie_cols))
    shift = F.element_at(longs(before), F.col("__slice") + 1)
    return sliced.withColumn("position", shift + rank - 1).drop("__slice")
