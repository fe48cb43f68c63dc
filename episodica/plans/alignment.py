"""Queries on alignment: as-of joins, interpolation, resampling, phases, schedules, guidance weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import closed_forms as C
from episodica.operators import align as L
from episodica.operators import windows as W
from episodica.plans.base import EP, FR, FRAME, event_frames, micros, query, r6, rounded, table
from episodica.plans.sequences import EDGE

SEC = "sm as (select user_id as episode, epoch_us(ts) as t, value from events where event_type <> 'view'), ck as (select user_id as episode, epoch_us(ts) as t from events where event_type = 'view')"
SIDES = f"{SEC}, s as (select ck.episode, ck.t, (select max(sm.t) from sm where sm.episode = ck.episode and sm.t <= ck.t) as t0, (select min(sm.t) from sm where sm.episode = ck.episode and sm.t >= ck.t) as t1 from ck), v as (select s.*, a.value as v0, b.value as v1 from s left join sm a on a.episode = s.episode and a.t = t0 left join sm b on b.episode = s.episode and b.t = t1)"


def _streams(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("episode"), micros("ts").alias("t"), "value", "event_type")
    return e.filter("event_type = 'view'").select("episode", "t"), e.filter("event_type <> 'view'").select("episode", "t", "value")


@query("asof_zoh", f"with {SEC}, a as (select ck.episode, ck.t, sm.value from ck asof left join sm on ck.episode = sm.episode and ck.t >= sm.t), f as (select episode, first(value order by t) as first from sm group by 1) select episode, t, coalesce(value, first) as value from a left join f using (episode)")
def asof_zoh(spark, d):
    clock, samples = _streams(spark, d)
    return L.zero_order_hold(clock, samples, EP, "t", ["value"])


@query("interp_linear", f"with {SIDES} select episode, t, round(case when t1 is null then v0 when t0 is null then v1 when t1 = t0 then v0 else v0 + (v1 - v0) * ((t - t0)::double / (t1 - t0)::double) end, 5) as value from v")
def interp_linear(spark, d):
    clock, samples = _streams(spark, d)
    return rounded(L.interpolate(clock, samples, EP, "t", ["value"]), 5)


@query("nearest_sample", f"with {SIDES} select episode, t, case when t1 is null or (t0 is not null and t - t0 <= t1 - t) then v0 else v1 end as value from v")
def nearest_sample(spark, d):
    clock, samples = _streams(spark, d)
    return L.nearest(clock, samples, EP, "t", ["value"])


@query("stream_fusion", f"with {SIDES}, g as (select sm.episode, sm.t, sm.value from sm) select v.episode, v.t, round(case when t1 is null then v0 when t0 is null then v1 when t1 = t0 then v0 else v0 + (v1 - v0) * ((t - t0)::double / (t1 - t0)::double) end, 5) as joint, coalesce(v0, v1) as gripper from v")
def stream_fusion(spark, d):
    """One stream interpolated and one held, on the clock of a third."""
    clock, samples = _streams(spark, d)
    joint, grip = (samples.withColumnRenamed("value", name) for name in ("joint", "gripper"))
    return rounded(L.fused(clock, [L.Stream(joint, ["joint"]), L.Stream(grip, ["gripper"], "hold")], EP, "t"), 5)


@query("stream_faults", "with e as (select user_id % 50 as k, epoch_us(ts) // 3600000000 as hour, event_type from events), s as (select k, hour from e where event_type = 'error') select k, 'repeated' as fault from s group by 1, hour having count(*) > 1 union select k, 'empty' from e where event_type = 'view' and k not in (select k from s)")
def stream_faults(spark, d):
    """Streams by hour that cannot be put on a clock."""
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), F.floor(micros("ts") / 3600000000).alias("hour"), "event_type")
    return L.stream_faults(e.filter("event_type = 'view'").select("k", "hour"), e.filter("event_type = 'error'").select("k", "hour"), ["k"], "hour")


@query("stream_order_faults", "select user_id as episode, count(*) as faults from (select user_id, ts, lag(ts) over (partition by user_id order by value, event_id) as p from events) where ts <= p group by 1")
def stream_order_faults(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("episode"), "ts", "value", "event_id")
    return L.order_faults(e, EP, "ts", ["value", "event_id"])


RES = "k as (select unnest(range(20)) as k), n as (select episode, count(*) as n from fr group by 1), p as (select episode, k, n, k * (n - 1) / 19.0::double as p, floor(k * (n - 1) / 19.0::double)::bigint as i from n cross join k)"


@query("resample_n", f"with {FR}, {RES} select p.episode, k, round(a.value + (coalesce(b.value, a.value) - a.value) * (p - i), 5) as value from p join fr a on a.episode = p.episode and a.frame = i left join fr b on b.episode = p.episode and b.frame = i + 1")
def resample_n(spark, d):
    return rounded(L.resample(event_frames(spark, d).select("episode", "frame", "value"), "value", 20, EP, FRAME), 5)


@query("resample_phase", f"with {FR.replace('fr as', 'f0 as')}, ed1 as (select episode, frame, value, frame > 5 and frame < 5 + episode % 40 as closed from f0), ed as (select *, closed and not lag(closed) over w as closes, not closed and lag(closed) over w as opens from ed1 window w as (partition by episode order by frame)), ph as (select episode, min(case when closes then frame end) as c, min(case when opens then frame end) as o from ed group by 1 having not first(closed order by frame) and not last(closed order by frame) and sum(cast(closes as int)) = 1 and sum(cast(opens as int)) = 1 and min(case when opens then frame end) - min(case when closes then frame end) >= 15), fr as (select f0.episode, frame - c as frame, value from f0 join ph using (episode) where frame between c and o), {RES} select p.episode, k, round(a.value + (coalesce(b.value, a.value) - a.value) * (p - i), 5) as value from p join fr a on a.episode = p.episode and a.frame = i left join fr b on b.episode = p.episode and b.frame = i + 1")
def resample_phase(spark, d):
    """The one closed phase of an episode, its ends included, at equal steps of its progress: episodes without such a phase have none."""
    fr = event_frames(spark, d)
    closed = ((F.col("frame") > 5) & (F.col("frame") < 5 + F.col("episode") % 40)).cast("double")
    phases = W.single_phase(W.rising_edges(fr.withColumn("x", closed), F.col("x"), EP, FRAME), EP, 15)
    within = fr.join(phases, "episode").filter("frame between close and open").select("episode", "frame", "value")
    return rounded(L.resample(within, "value", 20, EP, FRAME), 5)


@query("sigma_schedule", "select i, round(3.0 * (1 - i / 50.0::double) / (1 + 2.0 * (1 - i / 50.0::double)), 6) as sigma from (select unnest(range(50)) as i)")
def sigma_schedule(spark, d):
    s = 1 - F.col("id") / 50.0
    return spark.range(50).select(F.col("id").alias("i"), r6(C.shifted_sigma(s, 3.0)).alias("sigma"))


@query("nearest_timestep", "with s as (select i, 1000 * 3.0 * (1 - i / 50.0::double) / (1 + 2.0 * (1 - i / 50.0::double)) as t from (select unnest(range(50)) as i)), e as (select event_id, value * 2 as x from events) select event_id, arg_min(i, abs(t - x) + i * 1e-9) as i from e cross join s group by 1")
def nearest_timestep(spark, d):
    """The schedule is a table of 50 fixed rows."""
    s = [(i, 1000 * 3.0 * (1 - i / 50.0) / (1 + 2.0 * (1 - i / 50.0))) for i in range(50)]
    far = F.array(*(F.struct((F.abs(F.lit(t) - F.col("value") * 2) + i * 1e-9).alias("d"), F.lit(i).alias("i")) for i, t in s))
    return table(spark, d, "events").select("event_id", F.array_min(far)["i"].alias("i"))


RTC = "greatest(0.0, least(1.0, ({s} - 1 - i) / ({e} - {s} + 1.0::double) + 1))"


@query("rtc_weights", "with i as (select unnest(range(50)) as i) select 'exp' as schedule, i, round(case when i >= 30 then 0 else {c} * (exp({c}) - 1) / (exp(1) - 1) end, 6) as w from i union all select 'linear', i, round(case when i >= 30 then 0 else {c} end, 6) from i union all select 'ones', i, round(case when i >= 30 then 0.0::double else 1.0 end, 6) from i union all select 'zeros', i, round(case when i < 20 then 1.0::double else 0 end, 6) from i".replace("{c}", RTC.format(s=20, e=30)))
def rtc_weights(spark, d):
    out = None
    for kind in ("exp", "linear", "ones", "zeros"):
        one = spark.range(50).select(F.lit(kind).alias("schedule"), F.col("id").alias("i"), r6(C.prefix_weight(F.col("id"), 20, 30, 50, kind)).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rtc_guidance", "select k, round(case when k = 0 then 5 when k = 20 then 0 else least(5.0, (1 - k / 20.0::double) / (k / 20.0::double) * ((1 - k / 20.0::double) * (1 - k / 20.0::double) + (k / 20.0::double) * (k / 20.0::double)) / ((1 - k / 20.0::double) * (1 - k / 20.0::double))) end, 6) as g from (select unnest(range(21)) as k)")
def rtc_guidance(spark, d):
    return spark.range(21).select(F.col("id").alias("k"), r6(C.guidance(F.col("id") / 20.0, 5.0)).alias("g"))


@query("overlap_metrics", f"""with {FR}, p as (select episode, frame, value as old, lead(value, 2) over w as new, lag(value) over w as before, lag(value, 2) over w as before2 from fr window w as (partition by episode order by frame))
select episode, round(avg(abs(new - old)) filter (where frame < 5), 4) as aligned_mae, round(max(abs(new - before)) filter (where frame = 5), 4) as boundary, round(max(abs(new - 2 * before + before2)) filter (where frame = 5), 4) as acceleration, round(avg(abs(new - old)) filter (where frame between 5 and 30), 4) as future from p group by 1""")
def overlap_metrics(spark, d):
    w = W.episode(EP, FRAME)
    p = event_frames(spark, d).select("episode", "frame", F.col("value").alias("old"), F.lead("value", 2).over(w).alias("new"), F.lag("value").over(w).alias("b1"), F.lag("value", 2).over(w).alias("b2"))
    gap = F.abs(F.col("new") - F.col("old"))
    return p.groupBy("episode").agg(
        r6(F.avg(F.when(F.col("frame") < 5, gap)), 4).alias("aligned_mae"), r6(F.max(F.when(F.col("frame") == 5, F.abs(F.col("new") - F.col("b1")))), 4).alias("boundary"),
        r6(F.max(F.when(F.col("frame") == 5, F.abs(F.col("new") - 2 * F.col("b1") + F.col("b2")))), 4).alias("acceleration"), r6(F.avg(F.when(F.col("frame").between(5, 30), gap)), 4).alias("future"),
    )


@query("segment_rebase", f"{EDGE}, cl as (select episode, coalesce(case when not first(closed order by frame) then min(case when closes then frame end) end, 0) as cut from ed group by 1) select episode, count(*) as frames, round(min(t), 6) as start, round(max(t), 6) as finish from (select episode, frame / 30.0::double - min(frame / 30.0::double) over (partition by episode) as t from fr join cl using (episode) where frame >= cut) group by 1")
def segment_rebase(spark, d):
    """What is left of each episode from its first closing on, or all of it, with times from 0."""
    fr = event_frames(spark, d)
    cuts = W.first_closure(W.rising_edges(fr, F.col("value"), EP, FRAME, 300.0), EP).select("episode", F.coalesce("closure", F.lit(0)).alias("cut"))
    df = fr.join(cuts, "episode").filter("frame >= cut").withColumn("t", F.col("frame") / 30.0)
    df = df.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("episode")))
    return df.groupBy("episode").agg(F.count("*").alias("frames"), r6(F.min("t")).alias("start"), r6(F.max("t")).alias("finish"))


LR = {
    "constant": "1e-4",
    "linear": "greatest(1e-6, 1e-4 * (100 - s) / 90.0::double)",
    "cosine": "case when s > 100 then 1e-6 else 1e-6 + (1e-4 - 1e-6) * 0.5 * (1 + cos(pi() * (s - 10) / 90.0::double)) end",
    "two_stage": "case when s >= 100 then 2e-5 else 1e-4 end",
}


@query("lr_schedules", " union all ".join(f"select '{k}' as kind, s as step, round(1e6 * case when s < 10 then 1e-4 * s / 10 else {x} end, 5) as lr from (select unnest(range(120)) as s)" for k, x in LR.items()))
def lr_schedules(spark, d):
    out = None
    for kind in LR:
        one = spark.range(120).select(F.lit(kind).alias("kind"), F.col("id").alias("step"), r6(1e6 * C.learning_rate(F.col("id"), kind, 1e-4, 10, 100, 1e-6), 5).alias("lr"))
        out = one if out is None else out.unionByName(one)
    return out
