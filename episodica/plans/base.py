"""The driver tables seen as episodes, and the registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.vectors import vector
from episodica.operators.windows import frame_numbers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the same views: events as episodes of scalar frames, line items as episodes of vector frames, and those vectors in long form.
FR = "fr as (select user_id as episode, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value, event_type, ts, event_id from events)"
LI = "li as (select l_orderkey as episode, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as frame, l_quantity as v0, l_extendedprice as v1, l_discount as v2, l_tax as v3, l_returnflag as flag from lineitem)"
LONG = "lo as (select episode, frame, flag, 0 as dim, v0 as value from li union all select episode, frame, flag, 1, v1 from li union all select episode, frame, flag, 2, v2 from li union all select episode, frame, flag, 3, v3 from li)"
EP, FRAME = ["episode"], ["frame"]

#: SQL: a string's UTF-8 bytes, and the checksum of a list.
BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::bigint)"
PRINT = "md5(array_to_string({}, ','))"
STRIP = "regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')"

#: SQL of messages packed four conversations to a batch, and of what four ranks get of it.
PACKED = f"c as (select conv_id // 4 as batch, conv_id * 100 + turn as o, strlen(text) as n, {BYTES.format('text')} as ids from conversations where strlen(text) > 0), b as (select batch, flatten(list(ids order by o)) as ids, flatten(list(list_concat([-100::bigint], ids[2:]) order by o)) as rest, flatten(list(range(n) order by o)) as positions, list(n order by o) as ns, first(n order by o) as n1 from c group by 1), p as (select batch, ids, list_concat(ids[1:1], rest[2:]) as labels, positions, list_transform(range(len(ns) + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)::bigint) as cu, (4 - len(ids) % 4) % 4 as pad from b)"
RANKS = "s as (select *, (len(ids) + pad) // 4 as w, list_concat(ids, list_transform(range(pad), lambda i: 0::bigint)) as i2, list_concat(labels[2:], [-100::bigint], list_transform(range(pad), lambda i: -100::bigint)) as l2, list_concat(positions, list_transform(range(pad), lambda i: 0::bigint)) as p2, list_concat(list_transform(ids, lambda i: 1), list_transform(range(pad), lambda i: 1)) as m2, list_concat(cu, list_transform(range(pad), lambda i: cu[-1] + pad)) as c2 from p)"


def steady(sql: str) -> str:
    """sql with each round(x, k) as floor(x * 10^k + 0.5001) / 10^k: halves, which sums in another order miss by a bit, are not borders."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, comma = 1, at
    for i in range(at + 6, len(sql)):
        c = sql[i]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1:
            comma = i
        if not depth:
            break
    x, k = sql[at + 6 : comma], float(10 ** int(sql[comma + 1 : i]))
    return f"{sql[:at]}(floor(({steady(x)}) * {k} + 0.5001) / {k}){steady(sql[i + 1 :])}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL. Whole numbers come as long."""

    def put(f: Query) -> Query:
        def wide(spark: SparkSession, d: str) -> DataFrame:
            df = f(spark, d)
            return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes))

        QUERIES[name] = wide
        if sql:
            ORACLES[name] = steady(sql)
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select(F.col("user_id").alias("episode"), "value", "event_type", "ts", "event_id")
    return frame_numbers(df, EP, ["ts", "event_id"])


def item_frames(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), *cols, vector("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"), F.col("l_returnflag").alias("flag"))
    return frame_numbers(df, EP, cols).select("episode", "frame", "v", "flag")


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without frame numbers: no shuffle."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), vector("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def item_values(spark: SparkSession, d: str) -> DataFrame:
    return item_vectors(spark, d).select("episode", "flag", "status", F.posexplode("v").alias("dim", "value"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("length"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(r6(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def r6(x: Column, digits: int = 6) -> Column:
    """As steady() has it in SQL. floor() gives a long: what is no number, infinite or beyond it stays as it is, all of it whole."""
    k = float(10**digits)
    y = x.cast("double") * k + 0.5001
    return F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y)).otherwise(y) / F.lit(k)


def micros(c: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def printed(ids):
    """The checksum of an array's values."""
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
