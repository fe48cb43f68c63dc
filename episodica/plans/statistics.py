"""Queries on statistics: exact moments and quantiles, merges, errors, bins, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.durable import durable
from episodica.functions import closed_forms as C
from episodica.functions import normalize as N
from episodica.operators import aggregates as A
from episodica.operators import histograms as H
from episodica.operators import stats as S
from episodica.operators import windows as W
from episodica.operators.ranks import numbered
from episodica.plans.base import EP, FR, FRAME, LI, LONG, event_frames, item_values, item_vectors, query, r6, rounded, table
from episodica.shipping import ship_package

VALUES = "lo as (select l_orderkey as episode, l_returnflag as flag, l_linestatus as status, unnest([0::bigint, 1, 2, 3]) as dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem)"
STATS = "round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.99), 6) as q99, round(quantile_cont(value, 0.02), 6) as q02, round(quantile_cont(value, 0.98), 6) as q98, count(*) as count"
RAW = "avg(value) as mean, stddev_pop(value) as std, min(value) as low, max(value) as high, quantile_cont(value, 0.01) as q01, quantile_cont(value, 0.99) as q99"
ERR = "case when status = 'O' then value * 0.01 else value * -0.02 + 0.5 end"


def _error():
    return F.when(F.col("status") == "O", F.col("value") * 0.01).otherwise(F.col("value") * -0.02 + 0.5)


@query("norm_stats_exact", f"with {VALUES} select dim, {STATS} from lo group by dim")
def norm_stats_exact(spark, d):
    return rounded(A.exact_stats(item_values(spark, d), ["dim"]))


@query("norm_stats_by_group", f"with {VALUES} select flag, dim, {STATS} from lo group by flag, dim")
def norm_stats_by_group(spark, d):
    return rounded(A.exact_stats(item_values(spark, d), ["flag", "dim"]))


@query("first_action_stats", f"with {LI}, lo as (select v1 as value from li) select {STATS} from lo")
def first_action_stats(spark, d):
    """Chunk statistics of an action that is not relative: the first action of every frame's chunk, which is the frame's own."""
    rows = item_vectors(spark, d).select(F.get("v", F.lit(1)).alias("value"))
    return rounded(A.exact_stats(rows.withColumn("__a", F.lit(1)), ["__a"]).drop("__a"))


def _stats_lists(spark, d, kind):
    """The statistics a normalization needs, as its caller would have them from a file: lists by dimension."""
    values = item_values(spark, d)
    found = A.exact_quantiles(values, ["dim"], "value", {"q01": 0.01, "q99": 0.99}) if kind == "bounds_99" else A.plain_stats(values, ["dim"])
    rows = sorted(found.collect(), key=lambda r: r["dim"])  # four rows
    return {k: [r[k] for r in rows] for k in found.columns if k != "dim"}


def _by_dim(rows, by, vector, width):
    """mean, min and max of each component: vectors are combined as they are, and only the results are taken apart."""
    parts = [F.struct(F.lit(i).alias("dim"), *(f(F.get(vector, F.lit(i))).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max)))).alias(f"d{i}") for i in range(width)]
    return rows.groupBy(*by).agg(*parts).select(*by, F.inline(F.array(*(f"d{i}" for i in range(width)))))


KIND_SQL = {"meanstd": "(value - mean) / (std + 1e-6)", "bounds_99": "(value - q01) / (q99 - q01 + 1e-6) * 2 - 1", "minmax": "(value - low) / (high - low + 1e-6) * 2 - 1"}
for _kind, _sql in KIND_SQL.items():

    @query(f"norm_apply_{_kind}", f"with {VALUES}, st as (select dim, {RAW} from lo group by dim) select dim, flag, round(avg(x), 6) as mean, round(min(x), 6) as min, round(max(x), 6) as max from (select lo.dim, flag, {_sql} as x from lo join st using (dim)) group by 1, 2")
    def norm_apply(spark, d, kind=_kind):
        s = N.Scaling(kind, _stats_lists(spark, d, kind))
        return rounded(_by_dim(item_vectors(spark, d).select("flag", N.normalized(F.col("v"), s).alias("x")), ["flag"], "x", 4))


@query("norm_roundtrip", f"with {VALUES}, k as (select unnest(['meanstd', 'bounds_99', 'minmax', 'identity']) as kind) select kind, dim, round(avg(value), 4) as mean, round(min(value), 4) as min, round(max(value), 4) as max from lo cross join k group by 1, 2")
def norm_roundtrip(spark, d):
    """What comes back from each kind is what went in."""
    out = None
    for kind in ("meanstd", "bounds_99", "minmax", "identity"):
        s = N.Scaling(kind, _stats_lists(spark, d, kind))
        back = item_vectors(spark, d).select(F.lit(kind).alias("kind"), N.unnormalized(N.normalized(F.col("v"), s), s).alias("x"))
        one = rounded(_by_dim(back, ["kind"], "x", 4), 4)
        out = one if out is None else out.unionByName(one)
    return out


PARTIAL = f"{VALUES}, pa as (select flag, dim, avg(value) as mean, stddev_pop(value) as std, min(value) as min, max(value) as max, count(*) as count from lo group by 1, 2)"


@query("stats_merge", f"with {PARTIAL} select dim, round(sum(mean * count) / sum(count), 6) as mean, round(sqrt(sum(std * std * count) / sum(count)), 6) as std, min(min) as min, max(max) as max, cast(sum(count) as bigint) as count from pa group by 1")
def stats_merge(spark, d):
    return rounded(A.weighted_stats(A.plain_stats(item_values(spark, d), ["flag", "dim"]).drop("flag"), ["dim"]))


@query("stats_merge_unweighted", f"with {PARTIAL} select dim, round(avg(mean), 6) as mean, round(avg(std), 6) as std from pa group by 1")
def stats_merge_unweighted(spark, d):
    parts = A.plain_stats(item_values(spark, d), ["flag", "dim"]).withColumn("count", F.when(F.col("flag") != "A", F.col("count")))
    return rounded(A.weighted_stats(parts, ["dim"]).select("dim", "mean", "std"))


@query("stats_merge_exact", f"with {VALUES} select dim, round(avg(value), 6) as mean, round(stddev_pop(value), 4) as std, min(value) as min, max(value) as max, count(*) as count from lo group by 1")
def stats_merge_exact(spark, d):
    out = A.from_moments(A.moments(["flag", "dim"], item_values(spark, d)), ["dim"])
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std"), 4))


@query("error_metrics", f"with {VALUES}, e as (select flag, {ERR} as e from lo) select flag, round(avg(abs(e)), 4) as mae, round(avg(e * e), 4) as mse, round(sqrt(avg(e * e)), 4) as rmse, count(*) as scalar_count from e group by 1")
def error_metrics(spark, d):
    return rounded(A.errors(item_values(spark, d), ["flag"], _error()), 4)


@query("error_metrics_by_group", f"with {VALUES}, g as (select * from (values ('all', 0), ('all', 1), ('all', 2), ('all', 3), ('money', 1), ('rates', 2), ('rates', 3)) t(\"group\", k)), e as (select \"group\", {ERR} as e from lo join g on dim = k) select \"group\", round(avg(abs(e)), 4) as mae, round(avg(e * e), 4) as mse, round(sqrt(avg(e * e)), 4) as rmse, count(*) as scalar_count from e group by 1")
def error_metrics_by_group(spark, d):
    rows = A.in_groups(item_values(spark, d), {"all": [0, 1, 2, 3], "money": [1], "rates": [2, 3]})
    return rounded(A.errors(rows, ["group"], _error()), 4)


@query("joint_errors", f"with {VALUES}, e as (select dim, degrees({ERR}) as e from lo) select dim, round(avg(abs(e)), 3) as mae, round(sqrt(avg(e * e)), 3) as rmse, round(quantile_cont(abs(e), 0.95), 3) as p95 from e group by 1")
def joint_errors(spark, d):
    return rounded(A.joint_errors(item_values(spark, d), ["dim"], _error()), 3)


BINS = [("first", 0, 1), ("near", 0, 5), ("mid", 5, 20), ("late", 20, 60), ("any", 0, 10_000)]


@query("overlap_bins", f"with {FR}, b as (select * from (values ('first', 0, 1), ('near', 0, 5), ('mid', 5, 20), ('late', 20, 60), ('any', 0, 10000)) t(bin, lo, hi)) select bin, count(*) as n, round(avg(value), 6) as mean from fr join b on frame >= lo and frame < hi group by 1")
def overlap_bins(spark, d):
    rows = A.in_bins(event_frames(spark, d), F.col("frame"), BINS)
    return rounded(rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("loss_summary", "select event_type, count(*) as count, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.95), 6) as p95, max(value) as max, count(*) filter (where value > 100) as above from events group by 1")
def loss_summary(spark, d):
    return rounded(A.summary(table(spark, d, "events"), ["event_type"], "value", 100.0)).withColumn("max", F.col("max"))


@query("step_bins", "select event_id // 1000 as bin, round(avg(value), 6) as mean, count(*) as count from events group by 1")
def step_bins(spark, d):
    df = table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), "value")
    return rounded(A.step_bins(df, "step", "value", 1000))


@query("group_mean", "select event_type, round(avg(value), 6) as mean from events group by 1")
def group_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"))


@query("masked_mean", f"with {VALUES} select flag, round(avg(value) filter (where dim < 3), 6) as mean from lo group by 1")
def masked_mean(spark, d):
    return item_values(spark, d).groupBy("flag").agg(r6(F.avg(F.when(F.col("dim") < 3, F.col("value")))).alias("mean"))


@query("label_counts", "select quality::bigint as quality, toxic::bigint as toxic, count(*) as n from labels group by 1, 2")
def label_counts(spark, d):
    return table(spark, d, "labels").groupBy(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n"))


@query("argmax_location", f"with {LI}, {LONG} select episode, round(abs(value), 6) as peak, frame, dim::bigint as dim from (select *, row_number() over (partition by episode order by abs(value) desc, frame, dim) as r from lo) where r = 1")
def argmax_location(spark, d):
    from episodica.plans.base import item_frames

    rows = item_frames(spark, d).select("episode", "frame", F.posexplode("v").alias("dim", "value"))
    return rounded(A.argmax(rows, EP, F.col("value"), ["frame", "dim"]))


@query("corr_proxy", "select l_returnflag as flag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1")
def corr_proxy(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"))


@query("cosine_by_label", "select l_linestatus as status, round(sum(l_quantity * l_tax) / sqrt(sum(l_quantity * l_quantity) * sum(l_tax * l_tax)), 6) as cosine from lineitem group by 1")
def cosine_by_label(spark, d):
    return rounded(A.pairwise_cosine(table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "status"), ["status"], "l_quantity", "l_tax"))


@query("cosine_vectors", "with e as (select vec_id, label, embedding::double[] as e from embeddings), c as (select label, list(e order by vec_id)[1] as c from e group by 1) select label::bigint as label, count(*) as n, round(avg(list_cosine_similarity(e, c)), 5) as mean from e join c using (label) group by 1")
def cosine_vectors(spark, d):
    from episodica.functions import vectors as V

    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    first = e.groupBy("label").agg(F.min_by("e", "vec_id").alias("c"))
    return e.join(first, "label").groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(V.cosine(F.col("e"), F.col("c"))), 5).alias("mean"))


@query("two_level_mean", "select event_type, round(avg(m), 6) as mean, count(*) as groups from (select event_type, user_id, avg(value) as m from events group by 1, 2) group by 1")
def two_level_mean(spark, d):
    return rounded(A.two_level_mean(table(spark, d, "events"), ["event_type"], ["user_id"], "value"))


@query("group_contrast", f"with {FR}, c as (select frame, avg(value) filter (where event_type = 'purchase') as u, avg(value) filter (where event_type <> 'purchase') as v from fr group by 1) select round(avg(abs(u - v)), 6) as mean_abs, round(sqrt(avg((u - v) * (u - v))), 6) as rms, round(max(u - v), 6) as most from c")
def group_contrast(spark, d):
    fr = event_frames(spark, d).withColumn("up", F.col("event_type") == "purchase")
    c = A.contrast(fr, ["frame"], "up", "value")
    return c.agg(r6(F.avg(F.abs("difference"))).alias("mean_abs"), r6(F.sqrt(F.avg(F.col("difference") * F.col("difference")))).alias("rms"), r6(F.max("difference")).alias("most"))


@query("bin_count", "select b.bin, coalesce(n, 0) as n from (select unnest(range(64)) as bin) b left join (select p_size as bin, count(*) as n from part group by 1) c on b.bin = c.bin")
def bin_count(spark, d):
    return A.bin_count(table(spark, d, "part"), "p_size", 64)


@query("throughput_meter", "select user_id, cast(sum(event_id % 100 + 1) as bigint) as tokens, round(sum(event_id % 100 + 1) / sum(value), 6) as tokens_per_second, round(sum(event_id % 100 + 1) / (count(*) * 8.0::double), 6) as mean_slot_length, round(sum(event_id % 100 + 1) / cast(sum(event_id % 7 + 1) as double), 6) as mean_sample_length from events group by 1")
def throughput_meter(spark, d):
    df = table(spark, d, "events").select("user_id", "value", (F.col("event_id") % 100 + 1).alias("tokens"), (F.col("event_id") % 7 + 1).alias("samples"))
    return rounded(A.throughput(df, ["user_id"], "tokens", "samples", "value", 8))


@query("flops_model", "select lang, round((6.0 * 3e9 * sum(n_chars) + 12.0 * 36 * 16 * 128 * sum(n_chars * n_chars)) / 1e12, 3) as tflops from documents group by 1")
def flops_model(spark, d):
    df = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("s"), F.sum(F.col("n_chars") * F.col("n_chars")).alias("s2"))
    return df.select("lang", r6(C.flops(F.col("s"), F.col("s2"), 3e9, 36, 16, 128) / 1e12, 3).alias("tflops"))


@query("reduce_world", "select event_type, round(sum(m) / 5, 6) as mean, round(sum(m), 6) as sum, round(max(m), 6) as max from (select event_type, user_id % 5 as rank, avg(value) as m from events group by 1, 2) group by 1")
def reduce_world(spark, d):
    df = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("rank")).agg(F.avg("value").alias("m"))
    return df.groupBy("event_type").agg(r6(F.sum("m") / 5).alias("mean"), r6(F.sum("m")).alias("sum"), r6(F.max("m")).alias("max"))


@query("token_weighted_loss", "select event_type, round(sum(value * (event_id % 9)) / sum(event_id % 9), 6) as mean from events group by 1")
def token_weighted_loss(spark, d):
    return rounded(A.weighted_mean(table(spark, d, "events").withColumn("n", F.col("event_id") % 9), ["event_type"], "value", "n"))


@query("global_norm", "select user_id, round(sqrt(sum(value * value)), 6) as norm, round(least(1.0, 2000.0 / (sqrt(sum(value * value)) + 1e-6)), 6) as clip, round(max(abs(value)), 6) as norm_inf from events group by 1")
def global_norm(spark, d):
    df = table(spark, d, "events")
    two, inf = A.global_norm(df, ["user_id"], "value", 2000.0), A.global_norm(df, ["user_id"], "value", 1.0, float("inf"))
    return rounded(two.join(inf.select("user_id", F.col("norm").alias("norm_inf")), "user_id"))


@query("quality_rollup", "select coalesce(lang, 'total') as lang, count(*) as trials, count(*) filter (where quality = 1) as successes, round(count(*) filter (where quality = 1) / count(*), 6) as rate from labels join documents using (doc_id) group by rollup (lang)")
def quality_rollup(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(A.success_rates(df, "lang", F.col("quality") == 1))


@query("latest_checkpoint", "with f as (select o_orderkey as step, unnest(case when o_orderkey % 3 = 0 then ['model.bin', 'optim.bin'] else ['model.bin'] end) as f from orders) select max(step) as step from (select step from f group by 1 having bool_or(f = 'model.bin') and bool_or(f = 'optim.bin'))")
def latest_checkpoint(spark, d):
    names = F.explode(F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("model.bin"), F.lit("optim.bin"))).otherwise(F.array(F.lit("model.bin"))))
    files = table(spark, d, "orders").select("o_orderkey", names.alias("f")).select(F.concat(F.lit("/out/step_"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("f")).alias("path"))
    return A.latest_complete(files, "path", r"step_([0-9]+)/([^/]+)$", ["model.bin", "optim.bin"])


@query("strided_evaluation", f"with {FR} select round(avg(mse), 4) as mse, round(avg(mae), 4) as mae, count(*) as trajectories from (select episode, avg((value - 100) * (value - 100)) as mse, avg(abs(value - 100)) as mae from fr where frame // 8 < 4 group by 1)")
def strided_evaluation(spark, d):
    per = A.strided_evaluation(event_frames(spark, d), EP, "frame", 8, 4, F.col("value") - 100)
    return rounded(per.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.count("*").alias("trajectories")), 4)


@query("smoothness", f"with {FR}, q as (select episode, value - lag(value) over (partition by episode order by frame) as s, value from fr) select episode, round(avg(abs(s)), 4) as mean_step, round(sqrt(avg(s * s)), 4) as rms_step, round(quantile_cont(abs(value - 100), 0.95), 4) as p95 from q group by 1")
def smoothness(spark, d):
    df = W.difference(event_frames(spark, d), "value", EP, FRAME)
    return df.groupBy("episode").agg(r6(F.avg(F.abs("difference")), 4).alias("mean_step"), r6(F.sqrt(F.avg(F.col("difference") * F.col("difference"))), 4).alias("rms_step"), r6(F.percentile(F.abs(F.col("value") - 100), F.lit(0.95)), 4).alias("p95"))


@query("rollout_error", f"with {LI} select flag, round(avg(abs(v1 - v0 * 900)), 4) as mae, round(sqrt(avg((v1 - v0 * 900) * (v1 - v0 * 900))), 4) as rmse, round(max(abs(v1 - v0 * 900)), 4) as most from li group by 1")
def rollout_error(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") - F.col("l_quantity") * 900).alias("e"))
    return df.groupBy("flag").agg(r6(F.avg(F.abs("e")), 4).alias("mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), r6(F.max(F.abs("e")), 4).alias("most"))


@query("overlap_count", "select quality::bigint as quality, count(*) as selected, count(*) filter (where doc_id in (select doc_id from documents where lang = 'en')) as in_train from labels group by 1")
def overlap_count(spark, d):
    train = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.lit(True).alias("t"))
    df = table(spark, d, "labels").join(train, "doc_id", "left")
    return df.groupBy("quality").agg(F.count("*").alias("selected"), F.count_if("t").alias("in_train"))


WELCH = f"with {FR}, g as (select frame, avg(value) filter (where u) as m1, avg(value) filter (where not u) as m2, var_samp(value) filter (where u) as v1, var_samp(value) filter (where not u) as v2, count(*) filter (where u) as n1, count(*) filter (where not u) as n2 from (select *, episode % 2 = 0 as u from fr) group by 1)"


def _tested(spark, d):
    fr = event_frames(spark, d).withColumn("u", F.col("episode") % 2 == 0)
    return S.welch(fr, ["frame"], "u", "value")


@query("welch_t", f"{WELCH} select frame, round((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0), 6) as t, round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / nullif(v1 / n1 * v1 / n1 / nullif(n1 - 1, 0) + v2 / n2 * v2 / n2 / nullif(n2 - 1, 0), 0), 6) as df from g")
def welch_t(spark, d):
    return rounded(_tested(spark, d).select("frame", "t", "df"))


@query("welch_p")
def welch_p(spark, d):
    """p values and their false discovery rates; Student's tail is not SQL."""
    ship_package(spark)
    t = _tested(spark, d).withColumn("p", S.welch_p())
    return rounded(S.benjamini_hochberg(t, "p", ["frame"]).select("frame", "p", "q"))


@query("constant_cells", f"{WELCH.replace('select *, episode', 'select episode, frame, floor(frame / 10) + case when frame % 3 = 0 and episode % 2 = 0 then 1 else 0 end as value, episode')} select frame, case when v1 = 0 and v2 = 0 then case when m1 = m2 then 1.0::double else 0.0::double end end as p from g")
def constant_cells(spark, d):
    """Cells in which both groups are constant: p is 1 where they are equal and 0 where they differ, without a test."""
    ship_package(spark)
    fr = event_frames(spark, d).withColumn("u", F.col("episode") % 2 == 0)
    fr = fr.withColumn("value", F.floor(F.col("frame") / 10) + F.when((F.col("frame") % 3 == 0) & F.col("u"), 1).otherwise(0))
    return S.welch(fr, ["frame"], "u", "value").select("frame", S.welch_p().alias("p"))


@query("cohen_d", f"{WELCH} select frame, round(case when v1 + v2 > 0 then (m1 - m2) / sqrt((v1 + v2) / 2) else 0 end, 6) as d from g")
def cohen_d(spark, d):
    return rounded(S.cohen_d(_tested(spark, d)).select("frame", "d"))


@query("one_sample_t", f"with {FR} select frame, round((avg(value) - 50) / nullif(stddev_samp(value) / sqrt(count(*)), 0), 6) as t, count(*) - 1 as df from fr group by 1")
def one_sample_t(spark, d):
    return rounded(S.one_sample(event_frames(spark, d), ["frame"], "value", 50.0).select("frame", "t", "df"))


@query("one_sample_p")
def one_sample_p(spark, d):
    """p values of the mean's test and their false discovery rates; Student's tail is not SQL."""
    ship_package(spark)
    t = S.one_sample(event_frames(spark, d), ["frame"], "value", 50.0).withColumn("p", S.p_value(F.col("t"), F.col("df")))
    return rounded(S.benjamini_hochberg(t, "p", ["frame"]).select("frame", "p", "q"))


@query("bh_fdr", "with p as (select event_id, value / 500 as p from events), r as (select *, row_number() over (order by p, event_id) as r, count(*) over () as m from p) select event_id, round(least(1.0, min(p * m / r) over (order by r desc)), 6) as q from r")
def bh_fdr(spark, d):
    df = table(spark, d, "events").select("event_id", (F.col("value") / 500).alias("p"))
    return rounded(S.benjamini_hochberg(df, "p", ["event_id"]).select("event_id", "q"))


@query("normal_interval", "select event_type, round(avg(value), 6) as mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) as low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) as high from events group by 1")
def normal_interval(spark, d):
    return rounded(S.normal_interval(table(spark, d, "events"), ["event_type"], "value"))


def _units(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m")).withColumn("u", F.col("user_id") % 2 == 0)


UNIT = "('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double"
_CDF = []
_p = _acc = 0.36787944117144233
for _k in range(1, 13):
    _CDF.append(_acc)
    _p /= _k
    _acc += _p


@query("bootstrap_interval", f"with un as (select user_id, avg(value) as m from events group by 1), r as (select rep, m, {UNIT.format("'7|' || rep || '|' || user_id")} as x from un cross join (select unnest(range(1, 2001)) as rep)), w as (select rep, m, {' + '.join(f'cast(x >= {c!r} as int)' for c in _CDF)} as w from r), b as (select rep, sum(m * w) / sum(w) as mean from w group by 1) select round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from b")
def bootstrap_interval(spark, d):
    return rounded(S.bootstrap_interval(S.bootstrap_means(_units(spark, d), "user_id", "m", 2000, 7)))


@query("permutation_p", "with un as (select user_id, user_id % 2 = 0 as u, avg(value) as m from events group by 1, 2), s as (select avg(m) filter (where u) - avg(m) filter (where not u) as o, count(*) filter (where u) as k from un), r as (select rep, m, row_number() over (partition by rep order by md5('3|' || rep || '|' || user_id), user_id) as r from un cross join (select unnest(range(1, 2000)) as rep)), n as (select rep, avg(m) filter (where r <= k) - avg(m) filter (where r > k) as d from r cross join s group by 1) select round(o, 6) as observed, round((1 + count(*) filter (where abs(d) >= abs(o) - 1e-12)) / 2000.0::double, 6) as p from n cross join s group by o")
def permutation_p(spark, d):
    return rounded(S.permutation_test(_units(spark, d), "user_id", "u", "m", 1999, 3))


@query("stats_sketch", f"with {VALUES} select dim, true as close, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, count(*) as count from lo group by dim")
def stats_sketch(spark, d):
    """Quantiles from a sketch are within a thousandth of the range of the exact ones' ranks, which are counted over all rows."""
    rows = item_values(spark, d)
    y = durable(A.sketched_stats(rows, ["dim"]), "sketch")
    near = A.ranks_near(rows, ["dim"], "value", y, A.QUANTILES, 0.001)
    return y.join(near, "dim").select("dim", F.col("near").alias("close"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "min", "max", "count")


_BIN = "case when high <= low then 0 else least(4999, greatest(0, floor((x - low) / (high - low) * 5000)))::int end"


@query("histogram_stats", f"with {VALUES}, r as (select flag, dim, min(value) as low, max(value) as high, count(*) as n from lo group by 1, 2), b as (select flag, dim, {_BIN.replace('x -', 'value -')} as bin, count(*) as c from lo join r using (flag, dim) group by 1, 2, 3), u as (select flag, dim, bin, sum(c) over (partition by flag, dim order by bin) as upto from b), q as (select flag, dim, any_value(low) as low, any_value(high) as high, any_value(n) as n, {', '.join(f'min(bin) filter (where upto >= {q} * n) as {name}' for name, q in A.QUANTILES.items())} from u join r using (flag, dim) group by 1, 2), m as (select flag, dim, avg(value) as mean, stddev_pop(value) as std from lo group by 1, 2) select flag, dim, n, round(mean, 5) as mean, round(std, 5) as std, low, high, {', '.join(f'round(low + (high - low) * {name} / 5000.0::double, 5) as {name}' for name in A.QUANTILES)} from q join m using (flag, dim)")
def histogram_stats(spark, d):
    """Statistics by a histogram of 5,000 bins over the range of each group's dimension; quantiles are left edges of bins."""
    h = H.histogram(item_values(spark, d), "value", ["flag", "dim"])
    out = rounded(H.statistics(h, A.QUANTILES), 5)
    return out


@query("histogram_merged", f"with {VALUES}, s as (select flag, dim, min(value) as l0, max(value) as h0 from lo group by 1, 2), r as (select dim, min(l0) as low, max(h0) as high from s group by 1), b as (select flag, dim, {_BIN.replace('x -', 'value -').replace('low', 'l0').replace('high', 'h0')} as bin, count(*) as c from lo join s using (flag, dim) group by 1, 2, 3), e as (select b.dim, b.bin, b.c, l0, h0, low, high, l0 + (h0 - l0) * b.bin / 5000.0::double as x from b join s using (flag, dim) join r using (dim)), m as (select dim, case when l0 = low and h0 = high then bin else {_BIN} end as bin, sum(c) as c from e group by 1, 2) select dim, bin // 50 as slice, sum(c)::bigint as n from m group by 1, 2")
def histogram_merged(spark, d):
    """The states of the flags, each over a range of its own, as one: counts by slices of 50 bins."""
    values = item_values(spark, d)
    flags = [r[0] for r in values.select("flag").distinct().collect()]  # three
    one = H.merged([H.histogram(values.filter(F.col("flag") == f), "value", ["dim"]) for f in flags])
    return one.counts.groupBy("dim", F.floor(F.col("bin") / 50).alias("slice")).agg(F.sum("count").alias("n"))


@query("rank_by_peak", "select user_id, round(most, 6) as peak, row_number() over (order by most desc, user_id) as place from (select user_id, max(abs(value - 40)) as most from events group by 1)")
def rank_by_peak(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.max(F.abs(F.col("value") - 40)).alias("most"))
    return numbered(per, [-F.col("most"), "user_id"]).select("user_id", r6(F.col("most")).alias("peak"), "place")


PAIRED = "(select user_id, avg(value) filter (where event_id % 2 = 0) - avg(value) filter (where event_id % 2 = 1) as m from events group by 1)"


@query("paired_bootstrap", f"with un as {PAIRED}, r as (select rep, m, {UNIT.format("'11|' || rep || '|' || user_id")} as x from un cross join (select unnest(range(1, 4001)) as rep)), w as (select rep, m, {' + '.join(f'cast(x >= {c!r} as int)' for c in _CDF)} as w from r), b as (select rep, sum(m * w) / nullif(sum(w) filter (where m is not null), 0) as mean from w group by 1), s as (select avg(m) as mean, count(*) as units from un) select round(s.mean, 6) as mean, round(quantile_cont(b.mean, 0.025), 6) as low, round(quantile_cont(b.mean, 0.975), 6) as high, units from b, s group by s.mean, units")
def paired_bootstrap(spark, d):
    """The mean change between two conditions of the same unit, and its interval."""
    e = table(spark, d, "events")
    per = e.groupBy("user_id").agg((F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) - F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value")))).alias("change"))
    ci = S.bootstrap_interval(S.bootstrap_means(per.filter("change is not null"), "user_id", "change", 4000, 11))
    seen = per.agg(F.avg("change").alias("mean"), F.count("*").alias("units"))
    return rounded(seen.crossJoin(F.broadcast(ci)).select("mean", "low", "high", "units"))  # one row each
