"""Named queries on the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from episodica.plans import alignment, building, roundtrips, scalars, sequences, statistics, texts  # noqa: F401
from episodica.plans.base import ORACLES, QUERIES


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["norm_stats_exact"](spark, "/root/testdata/sf0.001")
