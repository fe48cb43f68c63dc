"""Queries on building and checking datasets: joins, filters with reasons, splits, samples, set checks, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import closed_forms as C
from episodica.operators import align as L
from episodica.operators import batching as B
from episodica.operators import datasets as D
from episodica.operators import quality as Q
from episodica.operators import sampling as P
from episodica.operators import windows as W
from episodica.operators.ranks import numbered
from episodica.plans.base import EP, FR, FRAME, event_frames, lengths, query, r6, rounded, table

HASH = "md5({} || '|{}')"
UINT = "({} * 2654435761 + 42) % 4294967296"


@query("join_metadata", "select o_orderkey, o_orderstatus, count(*) as n, round(sum(l_quantity), 4) as quantity from lineitem join orders on l_orderkey = o_orderkey group by 1, 2")
def join_metadata(spark, d):
    """Frames with their episode's metadata: combined by episode first, so the join moves one row for each."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return per.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderkey", "o_orderstatus", "n", r6(F.col("q"), 4).alias("quantity"))


@query("join_annotations", "select d.doc_id, d.lang, l.quality::bigint as quality, l.toxic::bigint as toxic, d.n_chars from documents d join labels l using (doc_id)")
def join_annotations(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")), "doc_id")


@query("allow_list", "select doc_id, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)")
def allow_list(spark, d):
    return D.allowed(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("deny_list", "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def deny_list(spark, d):
    return D.denied(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").filter("toxic = 1"), "doc_id")


@query("join_unmatched_kept", "select c_custkey, coalesce(n, -1) as n, n is null as unmatched from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def join_unmatched_kept(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return D.with_unmatched(table(spark, d, "customer").select("c_custkey"), per, "c_custkey", "n").select("c_custkey", F.coalesce("n", F.lit(-1)).alias("n"), "unmatched")


@query("remap_frames", f"with {FR}, ep as (select episode, row_number() over (order by episode) - 1 as new_index, coalesce(sum(n) over (order by episode rows between unbounded preceding and 1 preceding), 0)::bigint as f from (select episode, count(*) as n from fr where episode % 4 <> 1 group by 1)) select event_id, new_index as episode_index, f + frame as index from fr join ep using (episode)")
def remap_frames(spark, d):
    """Bad episodes are removed; ids and global indexes become contiguous."""
    fr = event_frames(spark, d).filter("episode % 4 <> 1")
    ep = D.reindexed(lengths(spark, d).filter("episode % 4 <> 1"), "episode", "length")
    return D.remap_frames(fr.select("episode", "frame", "event_id"), ep, "episode", "frame").select("event_id", "episode_index", "index")


@query("merged_tasks", "with t as (select p_size % 3 as source, p_partkey as idx, p_type as task from part), f as (select task, row_number() over (order by min(source * 1000000 + idx)) - 1 as new_index from t group by 1) select source::bigint as source, idx as \"index\", new_index from t join f using (task)")
def merged_tasks(spark, d):
    t = table(spark, d, "part").select((F.col("p_size") % 3).alias("source"), F.col("p_partkey").alias("index"), F.col("p_type").alias("task"))
    return D.merged_tasks(t, "source", "index", "task").select("source", "index", "new_index")


@query("frame_episode_range", "with e as (select o_custkey as episode, sum(n) over (order by o_custkey) - n as lo, sum(n) over (order by o_custkey) as hi from (select o_custkey, count(*) as n from orders group by 1)) select o_orderkey as point, episode from orders join e on o_orderkey >= lo and o_orderkey < hi")
def frame_episode_range(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("episode")).agg(F.count("*").alias("n"))
    spans = W.running_offsets(per, "episode", "n").withColumn("hi", F.col("offset") + F.col("n"))
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("point"))
    return L.range_lookup(points, "point", spans.select("episode", F.col("offset").alias("lo"), "hi"), "lo", "hi", 64).select("point", "episode")


@query("event_segment_position", f"with {FR}, r as (select episode, frame, event_type, row_number() over (partition by episode order by frame) - row_number() over (partition by episode, event_type order by frame) as g from fr), s as (select *, row_number() over (partition by episode, event_type, g order by frame) - 1 as place from r) select episode, frame, event_type, place from s")
def event_segment_position(spark, d):
    """Each frame's position in its run of one event type."""
    w = W.episode(EP, FRAME)
    df = event_frames(spark, d).withColumn("new", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return df.select("episode", "frame", "event_type", (F.col("frame") - F.min("frame").over(W.whole(["episode", "run"]))).alias("place"))


@query("paired_join", "select a.event_id, round(a.value - b.value, 6) as difference from events a join events b on a.user_id = b.user_id and b.event_id = a.event_id + 150 where a.event_type = b.event_type")
def paired_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    b = e.select((F.col("event_id") - 150).alias("event_id"), "user_id", "event_type", F.col("value").alias("other"))
    return e.join(b, ["event_id", "user_id", "event_type"]).select("event_id", r6(F.col("value") - F.col("other")).alias("difference"))


@query("manifest_equality", "with a as (select o_custkey as k from orders), b as (select c_custkey as k from customer) select 'left' as side, k as custkey from (select k from a except all select k from b) union all select 'right', k from (select k from b except all select k from a)")
def manifest_equality(spark, d):
    """Jobs that one list has more often than the other: customers by their orders, and as listed."""
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return D.symmetric_difference(a, b).select("side", "custkey")


@query("interval_overlap", "with a as (select s_suppkey as i, s_nationkey as k, s_suppkey % 50 as lo, s_suppkey % 50 + 10 as hi from supplier) select x.i, y.i as j, least(x.hi, y.hi) - greatest(x.lo, y.lo) as overlap from a x join a y on x.k = y.k and greatest(x.lo, y.lo) < least(x.hi, y.hi) and x.i < y.i")
def interval_overlap(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 50).alias("lo"), (F.col("s_suppkey") % 50 + 10).alias("hi"))
    t = s.select(F.col("i").alias("j"), "k", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return L.overlaps(s, t, ["k"], ("lo", "hi"), ("lo2", "hi2")).filter("i < j").select("i", "j", "overlap")


@query("split_plan", "with a as (select s_suppkey as i, s_nationkey % 4 as src, s_suppkey * 7 as lo, s_suppkey * 7 + 7 as hi from supplier), t as (select (max(hi) + 3) // 4 as w from a), r as (select dst, dst * w as lo2, (dst + 1) * w as hi2 from (select unnest(range(4)) as dst), t) select src::bigint as src, dst, sum(least(hi, hi2) - greatest(lo, lo2))::bigint as tokens from a join r on greatest(lo, lo2) < least(hi, hi2) group by 1, 2")
def split_plan(spark, d):
    """How much of each source's spans each destination gets: four equal ranges of all that there is."""
    spans = table(spark, d, "supplier").select((F.col("s_nationkey") % 4).alias("src"), (F.col("s_suppkey") * 7).alias("lo"), (F.col("s_suppkey") * 7 + 7).alias("hi"), F.lit(1).alias("k"))
    width = (spans.agg(F.max("hi")).first()[0] or 0) + 3 >> 2
    ranks = spark.range(4).select(F.col("id").alias("dst"), (F.col("id") * width).alias("lo2"), ((F.col("id") + 1) * width).alias("hi2"), F.lit(1).alias("k"))
    return L.overlaps(spans, F.broadcast(ranks), ["k"], ("lo", "hi"), ("lo2", "hi2")).groupBy("src", "dst").agg(F.sum("overlap").alias("tokens"))


ANN = "an as (select d.doc_id, n_chars, lang, quality, toxic, case when d.doc_id % 5 = 0 then null else d.doc_id % 2 end as regrasp from documents d left join labels l using (doc_id))"


def _annotated(spark, d):
    df = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return df.withColumn("regrasp", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2))


for _default in (0, 1):

    @query(f"regrasp_filter_{_default}", f"with {ANN} select doc_id from an where coalesce(regrasp, {_default}) = 0")
    def regrasp_filter(spark, d, default=_default):
        return D.without_regrasp(_annotated(spark, d), F.col("regrasp"), default).select("doc_id")


@query("quality_filter", f"with {ANN} select doc_id from an where quality is not null and quality <> 0 and coalesce(regrasp, 1) = 0 and toxic = 0 and n_chars between 500 and 3000")
def quality_filter(spark, d):
    rules = [("quality", F.col("quality").isNull() | (F.col("quality") == 0)), ("regrasp", F.coalesce("regrasp", F.lit(1)) != 0), ("toxic", F.col("toxic") != 0), ("length", ~F.col("n_chars").between(500, 3000))]
    return D.blockers(_annotated(spark, d), rules).filter("eligible").select("doc_id")


@query("eligibility_reasons", f"with {ANN}, r as (select case when coalesce(regrasp, 1) <> 0 then 'regrasp' when quality is null then 'no label' when n_chars < 1000 then 'short' else 'eligible' end as reason, n_chars from an) select reason, count(*) as n, sum(n_chars)::bigint as chars from r group by 1")
def eligibility_reasons(spark, d):
    df = D.reasons(_annotated(spark, d), [("regrasp", F.coalesce("regrasp", F.lit(1)) != 0), ("no label", F.col("quality").isNull()), ("short", F.col("n_chars") < 1000)])
    return df.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("held_out_reasons", f"with {ANN}, r as (select doc_id, case when doc_id in (select item_id from benchmark) then 'train_episode' when coalesce(regrasp, 0) <> 0 then 'regrasp' when quality = 0 then 'quality' end as reason from an) select doc_id, coalesce(reason, 'eligible') as reason from r")
def held_out_reasons(spark, d):
    """The two-valued variant: a missing flag is no fault, and what training has seen is excluded."""
    train = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    rules = [("regrasp", F.coalesce("regrasp", F.lit(0)) != 0), ("quality", F.col("quality") == 0)]
    return D.split_eligible(_annotated(spark, d), rules, train, "doc_id").select("doc_id", F.coalesce("reason", F.lit("eligible")).alias("reason"))


@query("annotation_blockers", f"with {ANN} select doc_id, concat_ws(',', case when lang <> 'en' then 'lang' end, case when quality is null then 'label' end, case when toxic = 1 then 'toxic' end) as blockers, lang = 'en' and quality is not null and coalesce(toxic, 0) <> 1 as eligible from an")
def annotation_blockers(spark, d):
    df = D.blockers(_annotated(spark, d), [("lang", F.col("lang") != "en"), ("label", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1)])
    return df.select("doc_id", F.array_join("blockers", ",").alias("blockers"), "eligible")


@query("boundary_guard", f"with {FR}, n as (select episode, count(*) as n from fr group by 1) select episode, frame from fr join n using (episode) where frame + 25 >= n")
def boundary_guard(spark, d):
    """Requests for a later frame that leave their episode."""
    fr = event_frames(spark, d).withColumn("wanted", F.col("frame") + 25)
    spans = lengths(spark, d).select("episode", F.lit(0).alias("lo"), F.col("length").alias("hi"))
    return Q.crossing(fr, "episode", "wanted", spans, "lo", "hi").select("episode", "frame")


@query("time_range", "select event_id from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-07 12:00:00'")
def time_range(spark, d):
    return table(spark, d, "events").filter(F.col("ts").between(F.to_timestamp(F.lit("2024-01-05 00:00:00")), F.to_timestamp(F.lit("2024-01-07 12:00:00")))).select("event_id")


@query("threshold_counts", "select count(*) filter (where value > 10) as above_10, count(*) filter (where value > 100) as above_100, count(*) filter (where value > 300) as above_300 from events")
def threshold_counts(spark, d):
    return Q.peak_counts(table(spark, d, "events"), F.col("value"), [10, 100, 300])


@query("wildcard_match", "select l_linenumber * 10 + l_suppkey % 10 as k, count(*) as n, min(case when regexp_matches('layers.' || l_suppkey || '.mlp', '^layers\\.([0-9]+)\\.attn$') then 0 when regexp_matches('layers.' || l_suppkey || '.mlp', '^layers\\.([0-9]+)\\.mlp$') then 1 else -1 end)::bigint as hit from lineitem group by 1")
def wildcard_match(spark, d):
    name = F.concat(F.lit("layers."), F.col("l_suppkey"), F.lit(".mlp"))
    df = table(spark, d, "lineitem").select((F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("k"), C.matching_index(name, ["layers.*.attn", "layers.*.mlp"]).alias("h"))
    return df.groupBy("k").agg(F.count("*").alias("n"), F.min("h").alias("hit"))


@query("group_split", f"select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by {HASH.format('c_custkey', 1)}, c_custkey) <= round_even(count(*) over (partition by c_mktsegment) * 0.1, 0) as is_test from customer")
def group_split(spark, d):
    return P.split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], 0.1, 1)


QUOTA = "q0 as (select {g}, count(*) as n from {t} group by 1), q1 as (select *, {total} * n / (select sum(n) from q0) as x from q0), q2 as (select *, floor(x) as b, round(x - floor(x), 9) as rem from q1), q as (select {g}, n, (b + case when row_number() over (order by rem desc, {g}) <= {total} - sum(b) over () then 1 else 0 end)::bigint as quota from q2)"


@query("stratified_split", f"with {QUOTA.format(g='c_mktsegment', t='customer', total='round_even((select count(*) from customer) * 0.1, 0)')} select c_custkey, row_number() over (partition by c_mktsegment order by {HASH.format('c_custkey', 2)}, c_custkey) <= quota as is_test from customer join q using (c_mktsegment)")
def stratified_split(spark, d):
    return P.stratified_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], 0.1, 2).select("c_custkey", "is_test")


@query("stratified_sample", f"with {QUOTA.format(g='o_orderpriority', t='orders', total='64.0')}, r as (select o_orderkey, o_orderpriority, quota, row_number() over (partition by o_orderpriority order by {HASH.format('o_orderkey', 3)}, o_orderkey) as r from orders join q using (o_orderpriority)) select o_orderkey, o_orderpriority from r where r <= quota")
def stratified_sample(spark, d):
    return P.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 64, 3)


@query("balanced_sample", f"select * from (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {HASH.format('o_orderkey', 4)}, o_orderkey) as rank from orders) where rank <= 20")
def balanced_sample(spark, d):
    return P.balanced_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], 20, 4)


@query("interleave", f"select o_orderkey, row_number() over (order by rank, o_orderstatus) as place from (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {HASH.format('o_orderkey', 4)}, o_orderkey) as rank from orders) where rank <= 20")
def interleave(spark, d):
    some = P.balanced_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], 20, 4)
    return numbered(some, ["rank", "o_orderstatus"]).select("o_orderkey", "place")


@query("batch_exclusion", f"with b as (select o_orderkey, o_custkey, (row_number() over (order by {HASH.format('o_orderkey', 5)}, o_orderkey) - 1) // 16 as batch from orders) select batch, count(*) as n, sum(o_orderkey)::bigint as print from b where batch not in (select batch from b where o_custkey in (7, 11, 13)) group by 1")
def batch_exclusion(spark, d):
    b = P.batches(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 16, 5)
    return P.without_batches_of(b, F.col("o_custkey").isin(7, 11, 13)).groupBy("batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("print"))


@query("shard_by_rank", f"select o_orderkey from orders where {UINT.format('o_orderkey')} % 8 = 3")
def shard_by_rank(spark, d):
    return P.shard(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, 8)


@query("worst_ten", "select user_id, round(m, 6) as mae from (select user_id, avg(abs(value - 100)) as m from events group by 1) order by m desc, user_id limit 10")
def worst_ten(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg(F.abs(F.col("value") - 100)).alias("m")).orderBy(F.desc("m"), "user_id").limit(10).select("user_id", r6(F.col("m")).alias("mae"))


@query("sorted_episodes", "select user_id, length, row_number() over (order by length, user_id) as place from (select user_id, count(*) as length from events group by 1)")
def sorted_episodes(spark, d):
    return numbered(lengths(spark, d), ["length", "episode"]).select(F.col("episode").alias("user_id"), "length", "place")


@query("set_difference", "select doc_id from documents except select doc_id from labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("set_checks", "select 0::bigint as in_several, 0::bigint as in_none, 0::bigint as unknown")
def set_checks(spark, d):
    parts = P.split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], 0.1, 1)
    return D.partition_check(table(spark, d, "customer"), {"train": parts.filter("not is_test"), "test": parts.filter("is_test")}, "c_custkey")


@query("key_mismatches", "with a as (select doc_id, 'documents' as t from documents union select doc_id, 'labels' from labels) select doc_id, string_agg(t, ',' order by t) as present from a group by 1 having count(*) < 2")
def key_mismatches(spark, d):
    return D.key_mismatches({"documents": table(spark, d, "documents"), "labels": table(spark, d, "labels")}, "doc_id")


@query("schema_differences", "select 'documents' as a, 'labels' as b, 'lang,n_chars,source,text' as missing, 'quality,toxic' as extra, '' as changed")
def schema_differences(spark, d):
    x = D.schema_differences(table(spark, d, "documents"), table(spark, d, "labels"))
    return spark.createDataFrame([("documents", "labels", *(",".join(x[k]) for k in ("missing", "extra", "changed")))], "a string, b string, missing string, extra string, changed string")


@query("rates_differ", "select count(distinct p_size % 3) as rates, count(distinct p_size % 3) > 1 as differ from part")
def rates_differ(spark, d):
    return D.rates_differ(table(spark, d, "part").select((F.col("p_size") % 3).alias("fps")))


@query("integrity_report", f"with {FR}, x as (select * from fr where not (episode % 10 = 3 and frame = 4)), de as (select episode, count(*) as declared from fr group by 1) select episode, count(*) as rows, declared, count(*) <> declared as bad_length, max(frame) <> count(*) - 1 as bad_index, count(*) filter (where value > 400) as nonfinite from x join de using (episode) group by 1, 3")
def integrity_report(spark, d):
    """Every tenth episode lacks a frame, and large values are made infinite."""
    fr = event_frames(spark, d).filter("not (episode % 10 = 3 and frame = 4)").withColumn("v", F.array(F.when(F.col("value") > 400, F.lit(float("inf"))).otherwise(F.col("value"))))
    return Q.integrity(fr, lengths(spark, d), "episode", "frame", "length", ["v"], 1)


@query("offset_sweep", f"with {FR}, l as (select episode, count(*) as n from fr group by 1), o as (select episode, sum(n) over w - n as lo, sum(n) over w - case when episode % 7 = 3 then 1 else 0 end as hi from l window w as (order by episode)), p as (select *, coalesce(lag(hi) over (order by episode), 0) as expected from o) select episode, lo as from_index, expected from p where lo <> expected")
def offset_sweep(spark, d):
    """Every seventh episode's end is one too low: the episodes after it are found."""
    ep = D.reindexed(lengths(spark, d), "episode", "length").withColumn("to_index", F.col("to_index") - F.when(F.col("episode") % 7 == 3, 1).otherwise(0))
    return Q.offset_violations(ep, "episode", "from_index", "to_index").select("episode", "from_index", "expected")


@query("stat_tolerances", "with c as (select event_type, value, case event_type when 'click' then value + 0.00001 when 'purchase' then greatest(value, 1.0) when 'view' then value + 2 else value end as w from events), a as (select event_type, avg(value) as mean, stddev_pop(value) as std, min(value) as low, max(value) as high from c group by 1), b as (select event_type, avg(w) as mean, stddev_pop(w) as std, min(w) as low, max(w) as high from c group by 1) select event_type from a join b using (event_type) where abs(a.mean - b.mean) > 0.5 + 1e-4 * abs(b.mean) or abs(a.std - b.std) > 0.5 + 1e-4 * abs(b.std) or a.low <> b.low or a.high <> b.high")
def stat_tolerances(spark, d):
    """Statistics of the events and of changed copies: some moved by less than the tolerance, cut at one end, moved by more, or the same."""
    from episodica.operators.aggregates import exact_stats

    e = table(spark, d, "events").select("event_type", "value")
    kind, x = F.col("event_type"), F.col("value")
    changed = F.when(kind == "click", x + 0.00001).when(kind == "purchase", F.greatest(x, F.lit(1.0))).when(kind == "view", x + 2).otherwise(x)
    return Q.stat_differences(exact_stats(e, ["event_type"], "value"), exact_stats(e.withColumn("value", changed), ["event_type"], "value"), ["event_type"], 0.5)


@query("duplicate_keys", "select l_orderkey, l_linenumber::bigint as l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("clock_violations", f"with {FR} select episode, frame from fr where abs(frame / 30.0::double + case when frame % 17 = 5 then 0.001 else 0 end - frame / 30.0::double) > 1e-4")
def clock_violations(spark, d):
    fr = event_frames(spark, d).withColumn("t", F.col("frame") / 30.0 + F.when(F.col("frame") % 17 == 5, 0.001).otherwise(0.0))
    return Q.clock_violations(fr, "frame", "t", 30.0).select("episode", "frame")


@query("task_prompt", "select doc_id, case when quality = 1 then 'lift it' when quality = 0 then 'leave it' else lang end as prompt from documents left join labels using (doc_id)")
def task_prompt(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("up")), "doc_id", "left")
    return df.select("doc_id", D.task_prompt(F.col("up"), "lift it", "leave it", F.col("lang")).alias("prompt"))


@query("shard_plan_next_fit", """with recursive o as (select source, doc_id, n_chars as s, row_number() over (partition by source order by doc_id) as r from documents),
f as (select source, doc_id, r, s as used, 0::bigint as bin from o where r = 1 union all
select o.source, o.doc_id, o.r, case when f.used <> 0 and f.used + o.s > 8000 then o.s else f.used + o.s end, f.bin + case when f.used <> 0 and f.used + o.s > 8000 then 1 else 0 end from f join o on o.source = f.source and o.r = f.r + 1)
select source, doc_id, bin from f""")
def shard_plan_next_fit(spark, d):
    return B.next_fit(table(spark, d, "documents"), "doc_id", "n_chars", ["source"], 8000)


@query("shard_plan_one_sequence", """with recursive o as (select doc_id, n_chars as s, row_number() over (order by doc_id) as r from documents),
f as (select doc_id, r, s as used, 0::bigint as bin from o where r = 1 union all
select o.doc_id, o.r, case when f.used <> 0 and f.used + o.s > 8000 then o.s else f.used + o.s end, f.bin + case when f.used <> 0 and f.used + o.s > 8000 then 1 else 0 end from f join o on o.r = f.r + 1)
select doc_id, bin from f""")
def shard_plan_one_sequence(spark, d):
    """All documents as one sequence of shards, planned by ranges."""
    return B.next_fit(table(spark, d, "documents"), "doc_id", "n_chars", [], 8000)


@query("row_access", "select index as idx, event_id, value from (select event_id * 37 % (select count(*) from events) as index from events) j join events e on e.event_id = j.index")
def row_access(spark, d):
    from episodica.sources.scans import rows_at

    e = table(spark, d, "events")
    jobs = e.select((F.col("event_id") * 37 % max(1, e.count())).alias("index"))
    return rows_at(e.select("event_id", "value", F.col("event_id").alias("index")), "index", jobs, "index").select(F.col("index").alias("idx"), "event_id", "value")


@query("last_row_per_step", "select step, value, event_id from (select event_id // 3 as step, value, event_id, row_number() over (partition by event_id // 3 order by event_id desc) as r from events) where r = 1")
def last_row_per_step(spark, d):
    from episodica.sources.scans import last_of_step

    log = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("step"), "value", "event_id")
    return last_of_step(log, "step", "event_id")


@query("log_mining", "select regexp_extract(l, 'step=([0-9]+) loss=([0-9.]+)', 1)::bigint as step, regexp_extract(l, 'step=([0-9]+) loss=([0-9.]+)', 2)::double as loss from (select case when event_id % 5 = 0 then 'noise' else '[INFO] step=' || event_id || ' loss=' || value end as l from events) where regexp_matches(l, 'step=([0-9]+) loss=([0-9.]+)')")
def log_mining(spark, d):
    from episodica.sources.scans import mined

    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, "noise").otherwise(F.concat(F.lit("[INFO] step="), "event_id", F.lit(" loss="), "value")).alias("l"))
    return mined(lines, "l", r"step=([0-9]+) loss=([0-9.]+)", [("step", "long"), ("loss", "double")])


@query("log_conflicts", "select l_orderkey as step, count(distinct l_quantity) as \"values\" from lineitem group by 1 having count(distinct l_quantity) > 1")
def log_conflicts(spark, d):
    from episodica.sources.scans import conflicts

    return conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), "l_quantity"), ["step"], "l_quantity")


@query("image_times", "select event_id * 1000 as ts from events where event_id % 3 = 0")
def image_times(spark, d):
    from episodica.sources.scans import image_times as times

    names = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/cam/"), (F.col("event_id") * 1000).cast("string"), F.lit(".jpg"))).when(F.col("event_id") % 3 == 1, F.lit("/cam/thumb.jpg")).otherwise(F.concat(F.lit("/cam/"), "event_id", F.lit(".png")))
    return times(table(spark, d, "events").select(names.alias("path")))


@query("rollout_union", "select event_id, value from events where event_id % 2 = 0 union all select event_id, value from events where event_id % 2 = 1")
def rollout_union(spark, d):
    from episodica.sources.scans import rollouts

    e = table(spark, d, "events").select("event_id", "value")
    return rollouts(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1").withColumnRenamed("value", "published"), {"published": "value"})


@query("dummy_tokens", "select cast(i as bigint) as sample_id, 16::bigint as tokens, 16::bigint as ones, true as in_range from (select unnest(range(100)) as i)")
def dummy_tokens(spark, d):
    from episodica.sources.scans import dummy_tokens as dummy

    df = dummy(spark, 100, 16)
    return df.select("sample_id", F.size("input_ids").alias("tokens"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("ones"), F.forall("labels", lambda x: (x >= 0) & (x < 32_768)).alias("in_range"))


@query("thinned_series", "with n as (select count(*) as n from events) select event_id from events, n where event_id % greatest(1, n // 500) = 0 or event_id = n - 1")
def thinned_series(spark, d):
    from episodica.sources.sinks import thinned

    return thinned(table(spark, d, "events").select("event_id"), "event_id")


@query("row_checksums", "select s_suppkey, sha256('{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}') as sha256 from supplier")
def row_checksums(spark, d):
    return Q.checksums(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("lightweight_view", "select count(*) as n from documents where doc_id in (select doc_id from labels where quality = 1)")
def lightweight_view(spark, d):
    from episodica.sources.sinks import view_of

    view_of(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1"), "doc_id", "good_documents")
    return spark.sql("select count(*) as n from good_documents")


@query("merged_dataset", f"with {FR}, x as (select 'a' as source, * from fr where episode % 2 = 0 union all select 'b', * from fr where episode % 2 = 1), e as (select source, episode, count(*) as n from x group by 1, 2), o as (select source, episode, row_number() over (order by source, episode) - 1 as i, (sum(n) over (order by source, episode) - n)::bigint as f from e) select event_id, o.i as episode_index, f + frame as index from x join o on x.source = o.source and x.episode = o.episode")
def merged_dataset(spark, d):
    """Two sources merged: contiguous episodes and indexes."""
    fr, ep = event_frames(spark, d).select("episode", "frame", "event_id"), lengths(spark, d)
    part = lambda k: (ep.filter(F.col("episode") % 2 == k), fr.filter(F.col("episode") % 2 == k))
    return D.merged({"a": part(0), "b": part(1)}, "episode", "frame", "length")[1].select("event_id", "episode_index", "index")


@query("quarantine", "select case when value between 10 and 100 then 'good' else 'bad' end as side, count(*) as n from events group by 1")
def quarantine(spark, d):
    good, bad = D.quarantined(table(spark, d, "events"), F.col("value").between(10, 100))
    one = lambda df, side: df.agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return one(good, "good").unionByName(one(bad, "bad"))


@query("global_index_check", "select count(*) as rows, 0::bigint as misplaced from events")
def global_index_check(spark, d):
    """Rows sorted by index stand at their index: ranks come from ranges, not from one task."""
    e = table(spark, d, "events").select("event_id").withColumn("one", F.lit(1))
    out = W.running_offsets(e, "event_id", "one")
    return out.agg(F.count("*").alias("rows"), F.count_if(F.col("new_index") != F.col("event_id")).alias("misplaced"))


@query("hash_shuffle", f"select o_orderkey, row_number() over (order by {HASH.format('o_orderkey', 9)}, o_orderkey) as place from orders")
def hash_shuffle(spark, d):
    return P.hash_shuffle(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 9)
