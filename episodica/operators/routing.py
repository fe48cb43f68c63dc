"""Routing of tokens to experts as relations: top-k choices, places by expert, gathering of rows and their weighted sum back by token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.ranks import numbered


def routes(tokens: DataFrame, token: str, scores: str, k: int, renormalize: bool = True) -> DataFrame:
    """token, choice (from 0), expert and weight: the k experts of the highest scores of each token, ties to the smaller one.

    Weights are a softmax over all scores, divided by the chosen ones' sum if renormalize. A token without scores goes nowhere; null scores are
    no choice. One row of work for each token: nothing is shuffled.
    """
    listed = F.filter(F.transform(scores, lambda s, e: F.struct((-s.cast("double")).alias("low"), e.cast("int").alias("expert"))), lambda x: x["low"].isNotNull())
    ranked = tokens.select(F.col(token), F.array_sort(listed).alias("__r")).filter(F.size("__r") > 0)
    top = -F.col("__r")[0]["low"]
    mass = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(-x["low"] - top))
    chosen = F.slice("__r", 1, k)
    ranked = ranked.select(token, top.alias("__top"), mass(chosen if renormalize else F.col("__r")).alias("__mass"), F.posexplode(chosen).alias("choice", "__c"))
    return ranked.select(token, "choice", F.col("__c.expert").alias("expert"), (F.exp(-F.col("__c.low") - F.col("__top")) / F.col("__mass")).alias("weight"))


def offsets(routed: DataFrame, experts: int) -> DataFrame:
    """expert, n and first (its first place), for all experts from 0, those without tokens too: a table of as many rows as there are experts."""
    counted = routed.groupBy("expert").agg(F.count("*").alias("n"))
    every = routed.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert")).join(counted, "expert", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.withColumn("first", F.sum("n").over(Window.orderBy("expert")) - F.col("n"))


def placed(routed: DataFrame, token: str) -> DataFrame:
    """Routes with place, from 0: experts one after the other, each one's tokens in their order. Ranks by ranges, so an expert may get most tokens."""
    return numbered(routed, ["expert", token, "choice"], "place").withColumn("place", F.col("place") - 1)


def gathered(routed: DataFrame, tokens: DataFrame, token: str, values: Sequence[str]) -> DataFrame:
    """Each route with its token's values: what the experts get. An equi-join on tokens; a token is there as often as it has experts."""
    return routed.join(tokens.select(token, *values), token)


def combined(results: DataFrame, token: str, value: str, size: int, weight: Column | str = "weight") -> DataFrame:
    """token and value: the sum of its experts' vectors of `size` numbers by their weights. Sums by number combine before the shuffle."""
    w = F.col(weight) if isinstance(weight, str) else weight
    sums = results.groupBy(token).agg(*(F.sum(F.get(value, F.lit(i)) * w).alias(f"__{i}") for i in range(size)))
    return sums.select(token, F.array(*(F.col(f"__{i}") for i in range(size))).alias(value))
