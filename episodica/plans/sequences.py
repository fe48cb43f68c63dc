"""Queries on sequences: chunks, edges, phases, windows, differences, offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import closed_forms as C
from episodica.functions import mapping as M
from episodica.functions import vectors as V
from episodica.operators import aggregates as A
from episodica.operators import routing as Ro
from episodica.operators import windows as W
from episodica.plans.base import EP, FR, FRAME, LI, event_frames, item_frames, lengths, query, r6, rounded, table

EDGE = f"with {FR}, ed as (select *, value > 300 as closed, coalesce(value > 300 and not lag(value > 300) over w, false) as closes, coalesce(value <= 300 and lag(value > 300) over w, false) as opens from fr window w as (partition by episode order by frame))"


@query("chunk_tail_hold", f"""with {FR}, n as (select episode, count(*) as n from fr group by 1), h as (select unnest(range(8)) as h)
select fr.episode, fr.frame, h.h, t.value, fr.frame + h.h >= n.n as is_pad from fr join n using (episode) cross join h
join fr t on t.episode = fr.episode and t.frame = least(fr.frame + h.h, n.n - 1)""")
def chunk_tail_hold(spark, d):
    df = W.future_chunk(event_frames(spark, d).select("episode", "frame", "value"), "value", 8, EP, FRAME)
    zipped = F.posexplode(F.arrays_zip("chunk", "chunk_is_pad"))
    return df.select("episode", "frame", zipped.alias("h", "z")).select("episode", "frame", F.col("h").cast("long").alias("h"), F.col("z.chunk").alias("value"), F.col("z.chunk_is_pad").alias("is_pad"))


@query("delta_chunk_stats", f"""with {LI}, n as (select episode, count(*) as n from li group by 1), h as (select unnest(range(4)) as h),
d as (select h.h, 0::bigint as dim, t.v0 - li.v0 as x from li join n using (episode) cross join h join li t on t.episode = li.episode and t.frame = least(li.frame + h.h, n.n - 1)
union all select h.h, 2, t.v2 - li.v2 from li join n using (episode) cross join h join li t on t.episode = li.episode and t.frame = least(li.frame + h.h, n.n - 1))
select h, dim, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as min, round(max(x), 6) as max, round(quantile_cont(x, 0.01), 6) as q01,
round(quantile_cont(x, 0.99), 6) as q99, round(quantile_cont(x, 0.02), 6) as q02, round(quantile_cont(x, 0.98), 6) as q98, count(*) as count from d group by h, dim""")
def delta_chunk_stats(spark, d):
    df = item_frames(spark, d).select("episode", "frame", F.array(F.get("v", F.lit(0)), F.get("v", F.lit(2))).alias("a"))
    df = W.future_chunk(df, "a", 4, EP, FRAME).select(M.to_delta(F.col("chunk"), F.col("a"), 4, 2).alias("delta"))
    rows = df.select(F.posexplode("delta").alias("h", "x")).select("h", F.posexplode("x").alias("i", "value"))
    return rounded(A.exact_stats(rows, ["h", "i"]).withColumn("dim", F.col("i") * 2).drop("i"))


@query("pad_mask_counts", f"with {FR}, n as (select episode, count(*) as n from fr group by 1) select h, cast(sum(cast(frame + h >= n as int)) as bigint) as padded, count(*) as total from fr join n using (episode) cross join (select unnest(range(8)) as h) group by h")
def pad_mask_counts(spark, d):
    df = W.future_chunk(event_frames(spark, d).select("episode", "frame", "value"), "value", 8, EP, FRAME)
    rows = df.select(F.posexplode("chunk_is_pad").alias("h", "pad"))
    return rows.groupBy("h").agg(F.count_if("pad").alias("padded"), F.count("*").alias("total"))


@query("rising_edges", f"{EDGE} select episode, frame, closes, opens from ed where closes or opens")
def rising_edges(spark, d):
    return W.rising_edges(event_frames(spark, d), F.col("value"), EP, FRAME, 300.0).filter("closes or opens").select("episode", "frame", "closes", "opens")


@query("first_closure", f"{EDGE} select episode, coalesce(case when not first(closed order by frame) then min(case when closes then frame end) end, -1) as closure, count(*) as length from ed group by 1")
def first_closure(spark, d):
    out = W.first_closure(W.rising_edges(event_frames(spark, d), F.col("value"), EP, FRAME, 300.0), EP)
    return out.withColumn("closure", F.coalesce("closure", F.lit(-1)))


@query("single_phase", f"""with {FR}, ed0 as (select *, frame > 5 and frame < 5 + episode % 40 as closed from fr),
ed as (select *, closed and not lag(closed) over w as closes, not closed and lag(closed) over w as opens from ed0 window w as (partition by episode order by frame)),
a as (select episode, first(closed order by frame) as f, last(closed order by frame) as l, sum(cast(closes as int)) as ups, sum(cast(opens as int)) as downs, min(case when closes then frame end) as c, min(case when opens then frame end) as o from ed group by 1)
select episode, c as close, o as open, o - c as duration from a where not f and not l and ups = 1 and downs = 1 and o - c >= 15""")
def single_phase(spark, d):
    df = event_frames(spark, d).withColumn("x", ((F.col("frame") > 5) & (F.col("frame") < 5 + F.col("episode") % 40)).cast("double"))
    return W.single_phase(W.rising_edges(df, F.col("x"), EP, FRAME), EP, 15)


POST = f"{EDGE}, cl as (select episode, case when not first(closed order by frame) then min(case when closes then frame end) end as closure, count(*) as length from ed group by 1)"


@query("post_event_slice", f"{POST} select fr.episode, frame, frame - closure as step, value from fr join cl using (episode) where frame >= closure and frame < closure + 20 and closure + 20 <= length")
def post_event_slice(spark, d):
    fr = event_frames(spark, d)
    cl = W.first_closure(W.rising_edges(fr, F.col("value"), EP, FRAME, 300.0), EP)
    return W.after_event(fr, cl, EP, "closure", 20).select("episode", "frame", "step", "value")


@query("post_event_tail", f"{POST} select fr.episode, count(*) as tail, cast(ceil(count(*) / 8.0) as bigint) as chunks from fr join cl using (episode) where frame >= closure group by 1")
def post_event_tail(spark, d):
    fr = event_frames(spark, d)
    cl = W.first_closure(W.rising_edges(fr, F.col("value"), EP, FRAME, 300.0), EP)
    return W.after_event(fr, cl, EP, "closure", None).groupBy("episode").agg(F.count("*").alias("tail"), F.ceil(F.count("*") / 8.0).cast("long").alias("chunks"))


@query("relative_to_first", f"with {FR} select episode, frame, round(value - first_value(value) over (partition by episode order by frame), 6) + 0.0 as relative from fr")
def relative_to_first(spark, d):
    return rounded(W.relative_to_first(event_frames(spark, d), "value", EP, FRAME).select("episode", "frame", "relative"))


@query("rolling_mean_partial", "select event_id, round(avg(value) over (order by event_id rows 99 preceding), 6) as smooth from events")
def rolling_mean_partial(spark, d):
    return rounded(W.trailing_mean(table(spark, d, "events").select("event_id", "value"), "value", 100, [], ["event_id"]).select("event_id", "smooth"))


@query("rolling_mean_valid", f"with {FR}, r as (select episode, frame, value, count(*) over (partition by episode) as n, avg(value) over (partition by episode order by frame rows 59 preceding) as m from fr) select episode, frame, round(case when n < 60 then value else m end, 6) as smooth from r where n < 60 or frame >= 59")
def rolling_mean_valid(spark, d):
    return rounded(W.trailing_mean(event_frames(spark, d), "value", 60, EP, FRAME, full_only=True).select("episode", "frame", "smooth"))


@query("tumbling_windows", f"with {FR} select episode, frame // 10 as \"window\", round(avg(value), 6) as mean, count(*) as n from fr group by 1, 2")
def tumbling_windows(spark, d):
    return rounded(W.tumbling(event_frames(spark, d), "frame", 10).groupBy("episode", "window").agg(F.avg("value").alias("mean"), F.count("*").alias("n")))


for _n, _sql in ((1, "value - lag(value) over w"), (2, "value - 2 * lag(value) over w + lag(value, 2) over w"), (3, "value - 3 * lag(value) over w + 3 * lag(value, 2) over w - lag(value, 3) over w")):

    @query(f"difference_{_n}", f"with {FR}, q as (select episode, {_sql} as x from fr window w as (partition by episode order by frame)) select episode, round(max(abs(x)), 4) as most, round(avg(abs(x)), 4) as mean from q group by 1")
    def difference_n(spark, d, n=_n):
        df = W.difference(event_frames(spark, d), "value", EP, FRAME, n)
        return rounded(df.groupBy("episode").agg(F.max(F.abs("difference")).alias("most"), F.avg(F.abs("difference")).alias("mean")), 4)


@query("range_and_travel", f"with {FR}, q as (select *, abs(value - lag(value) over (partition by episode order by frame)) as s from fr) select episode, round(max(value) - min(value), 6) as range, round(sum(s), 4) as travel from q group by 1")
def range_and_travel(spark, d):
    df = W.difference(event_frames(spark, d), "value", EP, FRAME)
    return df.groupBy("episode").agg(r6(F.max("value") - F.min("value")).alias("range"), r6(F.sum(F.abs("difference")), 4).alias("travel"))


@query("reindex_offsets", "select c_custkey, row_number() over (order by c_custkey) - 1 as new_index, cast(coalesce(sum(n) over (order by c_custkey rows between unbounded preceding and 1 preceding), 0) as bigint) as from_index, n as length from (select o_custkey as c_custkey, count(*) as n from orders group by 1)")
def reindex_offsets(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("length"))
    return W.running_offsets(per, "c_custkey", "length").withColumnRenamed("offset", "from_index")


@query("ntile_topk", "select * from (select *, row_number() over (partition by stratum order by most desc, user_id) as rank from (select user_id, n, round(most, 6) as most, ntile(10) over (order by n, user_id) as stratum from (select user_id, count(*) as n, max(value) as most from events group by 1))) where rank <= 5")
def ntile_topk(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), r6(F.max("value")).alias("most"))
    return W.top_k(W.strata(per, 10, ["n", "user_id"]), 5, ["stratum"], [F.desc("most"), "user_id"])


@query("anchors", "select user_id as episode, f as fraction, cast(trunc((n - 1) * f) as bigint) as anchor from (select user_id, count(*) as n from events group by 1) cross join (select unnest([0.2::double, 0.5, 0.8]) as f)")
def anchors(spark, d):
    return W.fractional_anchors(lengths(spark, d), "length", [0.2, 0.5, 0.8]).select("episode", "fraction", "anchor")


@query("constant_velocity", f"""with {FR}, s as (select episode, frame, value, (value - case when frame = 0 then value when frame = 1 then lag(value, 1) over w when frame = 2 then lag(value, 2) over w else lag(value, 3) over w end) / greatest(1, least(3, frame)) as slope from fr window w as (partition by episode order by frame))
select episode, frame, k, round(value + k * slope, 4) + 0.0 as prediction from s cross join (select unnest(range(1, 5)) as k)""")
def constant_velocity(spark, d):
    df = W.constant_velocity(event_frames(spark, d), "value", 4, EP, FRAME).select("episode", "frame", F.col("k").cast("long").alias("k"), "prediction")
    return rounded(df, 4)


@query("hold_baseline", f"with {FR} select episode, round(avg(abs(value - held)), 6) as mae from (select *, first_value(value) over (partition by episode, frame // 25 order by frame) as held from fr) group by 1")
def hold_baseline(spark, d):
    df = W.hold(event_frames(spark, d), "value", 25, EP, FRAME)
    return rounded(df.groupBy("episode").agg(F.avg(F.abs(F.col("value") - F.col("held"))).alias("mae")))


@query("expert_slots", "select event_id, event_type, row_number() over (order by event_type, event_id) - 1 as slot from events")
def expert_slots(spark, d):
    return W.slots(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])


_ROUTED = "e as (select vec_id, embedding as v, unnest(range(8)) as expert from embeddings where embedding is not null), s as (select vec_id, v, expert, v[expert + 1]::double as s from e), r as (select *, row_number() over (partition by vec_id order by s desc, expert) as r, exp(s - max(s) over (partition by vec_id)) as x from s where s is not null), c as (select *, x / sum(x) over (partition by vec_id) as w from r where r <= 2)"


def _routed(spark, d):
    v = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", F.slice("embedding", 1, 8).alias("scores"), F.slice("embedding", 9, 4).alias("x"))
    return v, Ro.routes(v, "vec_id", "scores", 2)


@query("expert_routing", f"with {_ROUTED} select vec_id, {', '.join(f'round(sum(w * (expert + 1) * v[{9 + i}]::double), 5) as y{i}' for i in range(4))} from c group by 1")
def expert_routing(spark, d):
    """Two experts a token by its first eight numbers; an expert multiplies the next four by its number. Gathered, worked on, and added up again."""
    tokens, routed = _routed(spark, d)
    rows = Ro.gathered(Ro.placed(routed, "vec_id"), tokens, "vec_id", ["x"])
    done = rows.withColumn("x", F.transform("x", lambda x: x.cast("double") * (F.col("expert") + 1)))
    out = Ro.combined(done, "vec_id", "x", 4)
    return rounded(out.select("vec_id", *(F.get("x", F.lit(i)).alias(f"y{i}") for i in range(4))), 5)


@query("expert_places", f"with {_ROUTED}, p as (select vec_id, r - 1 as choice, expert, row_number() over (order by expert, vec_id, r) - 1 as place from c), o as (select expert, min(place) as first, count(*) as n from p group by 1) select p.*, first, n from p join o using (expert)")
def expert_places(spark, d):
    """Where each route's row stands, experts one after the other, and each expert's first place and rows."""
    routed = _routed(spark, d)[1]
    return Ro.placed(routed, "vec_id").join(F.broadcast(Ro.offsets(routed, 8)), "expert").select("vec_id", "choice", "expert", "place", "first", "n")  # eight rows


@query("block_mask", f"with {FR}, b as (select episode, frame, sum(cast(event_type = 'purchase' as int)) over (partition by episode order by frame) as b from fr), v as (select * from b where frame % 5 <> 4) select q.episode, q.frame as query, max(k.frame) as until, count(*) as allowed from v q join v k on q.episode = k.episode and k.b <= q.b group by 1, 2")
def block_mask(spark, d):
    return W.block_mask(event_frames(spark, d), EP, "frame", F.col("event_type") == "purchase", F.col("frame") % 5 != 4)


@query("latency_lag", f"with {FR} select episode, frame, coalesce(lag(value) over (partition by episode order by frame), -1) as previous from fr")
def latency_lag(spark, d):
    df = W.previous(event_frames(spark, d), "value", EP, FRAME)
    return df.select("episode", "frame", F.coalesce("previous", F.lit(-1.0)).alias("previous"))


@query("recent_delay", f"with {FR} select episode, frame, cast(max(ceil(value / 1000 * 30)) over (partition by episode order by frame rows 9 preceding) as bigint) as delay from fr")
def recent_delay(spark, d):
    df = event_frames(spark, d).withColumn("latency", F.col("value") / 1000)
    return W.recent_delay(df, "latency", 30.0, EP, FRAME).select("episode", "frame", "delay")


@query("cu_seqlens", "with c as (select conv_id, turn, strlen(text) as n from conversations) select conv_id, row_number() over (partition by conv_id order by turn) as place, cast(sum(n) over (partition by conv_id order by turn) as bigint) as cu from c")
def cu_seqlens(spark, d):
    df = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.octet_length("text").alias("n")))), lambda s: s["n"]).alias("lens"))
    df = df.select("conv_id", F.posexplode(V.cumulative_lengths(F.col("lens"))).alias("place", "cu")).filter("place > 0")
    return df.select("conv_id", F.col("place").cast("long").alias("place"), "cu")


@query("cu_seqlens_inverse", "select conv_id, count(*) as sequences, cast(sum(strlen(text)) as bigint) as total, max(strlen(text)) as longest from conversations where strlen(text) > 0 group by 1")
def cu_seqlens_inverse(spark, d):
    """Lengths to positions, to starts, and back to lengths."""
    df = table(spark, d, "conversations").filter(F.octet_length("text") > 0).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.octet_length("text").alias("n")))), lambda s: s["n"]).alias("lens"))
    pos = df.withColumn("pos", V.position_ids(F.col("lens")))
    cu = F.concat(F.transform(V.starts_from_positions(F.col("pos")), lambda x: x.cast("long")), F.array(F.size("pos").cast("long")))
    back = pos.select("conv_id", V.lengths_from_cumulative(cu).alias("lens"))
    return back.select("conv_id", F.size("lens").cast("long").alias("sequences"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("lens").alias("longest"))


@query("delta_timestamps", "select cast(h as bigint) as h, round(h / 30.0::double, 9) as t from (select unnest(range(50)) as h)")
def delta_timestamps(spark, d):
    return spark.range(50).select(F.col("id").alias("h"), F.round(F.col("id") / 30.0, 9).alias("t"))


@query("budget_warmup", "select cast(s as bigint) as step, case when s <= 100 then (2048 - 200) * s // 100 + 200 else 2048 end as budget from (select unnest(range(200)) as s)")
def budget_warmup(spark, d):
    return spark.range(200).select(F.col("id").alias("step"), C.warmed_budget(F.col("id"), 2048, 100, 200).alias("budget"))
