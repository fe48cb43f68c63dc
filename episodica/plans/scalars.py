"""Queries on vectors and scalars: mapping, deltas, padding, masks, rotations, settings, text cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import closed_forms as C
from episodica.functions import mapping as M
from episodica.functions import normalize as N
from episodica.functions import vectors as V
from episodica.operators import windows as W
from episodica.plans.base import EP, FRAME, LI, item_frames, item_vectors, query, r6, rounded, table

KEY = "l_orderkey as episode_index, l_partkey as part"
FEATURES = M.FeatureMap((
    M.Feature("arm", (M.Piece("state", 0, 2), M.Piece("state", 3, 4))),
    M.Feature("effector", (M.Piece("state", 2, 3),)),
    M.Feature("raw", "flag"),
    M.Feature("absent", "nothing"),
))


def _long(df, keys, *vectors):
    """Vectors as rows (name, dim, value): results that any engine can compare."""
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).alias("v")) for v in vectors)))
    return df.select(*keys, rows.alias("r")).select(*keys, "r.name", F.posexplode("r.v").alias("dim", "value"))


def _sums(df, *vectors):
    return _long(df, ["flag"], *vectors).groupBy("flag", "name", "dim").agg(r6(F.sum("value"), 3).alias("total"))


def _sql(rows: str, source: str = "lineitem") -> str:
    parts = [x.split(":", 2) for x in rows.split("; ")]
    union = " union all ".join(f"select l_returnflag as flag, '{n.strip()}' as name, {i}::bigint as dim, {e} as x from {source}" for n, i, e in parts)
    return f"select flag, name, dim, round(sum(x), 3) as total from ({union}) group by 1, 2, 3"


@query("feature_mapping", _sql("arm:0:l_quantity; arm:1:l_extendedprice; arm:2:l_tax; effector:0:l_discount"))
def feature_mapping(spark, d):
    df = item_vectors(spark, d).withColumnRenamed("v", "state").withColumnRenamed("episode", "episode_index")
    return _sums(FEATURES.forward(df).withColumnRenamed("raw", "flag"), "arm", "effector")


@query("feature_reverse", _sql("state:0:l_quantity; state:1:l_extendedprice; state:2:l_discount; state:3:l_tax"))
def feature_reverse(spark, d):
    df = item_vectors(spark, d).withColumnRenamed("v", "state").withColumnRenamed("episode", "episode_index")
    back = M.FeatureMap(FEATURES.features[:3]).backward(FEATURES.forward(df), ["state", "flag"])
    return _sums(back, "state")


@query("delta_actions", f"with {LI}, n as (select episode, count(*) as n from li group by 1) select flag, h, round(sum(t.v0 - li.v0), 3) as d0, round(sum(t.v3 - li.v3), 3) as d3 from li join n using (episode) cross join (select unnest(range(3)) as h) join li t on t.episode = li.episode and t.frame = least(li.frame + h, n - 1) group by 1, 2".replace("select flag, h,", "select li.flag, h,"))
def delta_actions(spark, d):
    df = W.future_chunk(item_frames(spark, d), "v", 3, EP, FRAME)
    df = df.select("flag", F.posexplode(M.to_delta(F.col("chunk"), F.col("v"))).alias("h", "a"))
    return df.groupBy("flag", "h").agg(r6(F.sum(F.get("a", F.lit(0))), 3).alias("d0"), r6(F.sum(F.get("a", F.lit(3))), 3).alias("d3"))


@query("delta_undo", "select count(*) as rows, 0.0::double as worst from lineitem")
def delta_undo(spark, d):
    df = W.future_chunk(item_frames(spark, d), "v", 3, EP, FRAME)
    back = M.from_delta(M.to_delta(F.col("chunk"), F.col("v")), F.col("v"))
    far = F.array_max(F.zip_with(F.flatten(back), F.flatten("chunk"), lambda a, b: F.abs(a - b)))
    return df.agg(F.count("*").alias("rows"), r6(F.max(far)).alias("worst"))


@query("joint_padding", _sql("x:0:l_quantity; x:1:l_extendedprice; x:2:0.0::double; x:3:0.0::double; x:4:0.0::double; x:5:l_discount; x:6:l_tax; x:7:0.0::double"))
def joint_padding(spark, d):
    v = F.col("v")
    x = M.joined_joints([(V.cut(v, 0, 2), 3), (None, 2), (V.cut(v, 2, 4), 3), (None, 0)])
    return _sums(item_vectors(spark, d).withColumn("x", x), "x")


@query("joint_mask", "select dim, real from (select unnest(range(8)) as dim, unnest([true, true, false, false, false, true, true, false]) as real)")
def joint_mask(spark, d):
    return spark.range(1).select(F.posexplode(M.joint_mask([(2, 3), (0, 2), (2, 3)])).alias("dim", "real"))


@query("unpad_split", _sql("a:0:l_quantity; a:1:l_extendedprice; b:0:l_discount; b:1:l_tax"))
def unpad_split(spark, d):
    v = F.col("v")
    x, mask = M.joined_joints([(V.cut(v, 0, 2), 3), (None, 2), (V.cut(v, 2, 4), 3)]), M.joint_mask([(2, 3), (0, 2), (2, 3)])
    a, b = M.split_joints(x, mask, [2, 2])
    return _sums(item_vectors(spark, d).withColumn("a", a).withColumn("b", b), "a", "b")


@query("global_padding", "select l_returnflag as flag, 75::bigint as size, 4::bigint as real, count(*) as rows from lineitem group by 1")
def global_padding(spark, d):
    df = item_vectors(spark, d).withColumn("x", V.fixed_length(F.col("v"), 75, F.lit(0.0))).withColumn("m", V.real_mask(F.size("v"), 75))
    return df.groupBy("flag").agg(F.min(F.size("x")).alias("size"), F.max(F.size(V.keep_masked(F.col("x"), F.col("m")))).alias("real"), F.count("*").alias("rows"))


STATS = {"mean": [25.0, 4e4, 0.05, 0.04], "std": [14.0, 2e4, 0.03, 0.02], "q01": [1.0, 1e3, 0.0, 0.0], "q99": [50.0, 9e4, 0.1, 0.08]}


@query("apply_unapply", "select l_returnflag as flag, count(*) as rows, true as close from lineitem group by 1")
def apply_unapply(spark, d):
    """The whole pipeline and its inverse: relative to the state, normalized, padded, and back to within 2e-5 of the values' scale."""
    s = {"state": N.Scaling("meanstd", STATS), "action": N.Scaling("bounds_99", STATS)}
    df = W.future_chunk(item_frames(spark, d), "v", 3, EP, FRAME)
    state, acts, _ = M.apply(F.col("v"), F.col("chunk"), s, 8, True, 3)
    df = df.select("flag", "v", "chunk", state.alias("state"), acts.alias("acts"))
    back_s, back_a = M.unapply(F.col("state"), F.col("acts"), s, 4, True, 3)
    df = df.select("flag", F.concat(back_s, F.flatten(back_a)).alias("back"), F.concat("v", F.flatten("chunk")).alias("own"))
    close = V.every(F.col("back"), F.col("own"), lambda a, b: F.abs(a - b) <= 2e-5 * (1 + F.abs(b)), 16)
    return df.groupBy("flag").agg(F.count("*").alias("rows"), F.bool_and(close).alias("close"))


@query("column_rewrite", "select event_id, user_id + 100 as episode_index, 1000 + row_number() over (order by user_id, event_id) - 1 as index from events")
def column_rewrite(spark, d):
    """Episodes appended to a set of 100 episodes and 1,000 frames: each row's episode and place in it are written anew."""
    e = table(spark, d, "events").select("user_id", "event_id")
    offsets = W.running_offsets(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n").select("user_id", "offset")
    df = W.frame_numbers(e, ["user_id"], ["event_id"]).join(offsets, "user_id")
    return df.select("event_id", (F.col("user_id") + 100).alias("episode_index"), (F.col("frame") + F.col("offset") + 1000).alias("index"))


@query("prompt_framing", "select conv_id, turn, (case when starts_with(text, '<bos>') then text else '<bos>' || text end) || case when ends_with(text, chr(10)) then '' else chr(10) end as prompt from conversations")
def prompt_framing(spark, d):
    from episodica.functions.text import framed

    return table(spark, d, "conversations").select("conv_id", "turn", framed(F.col("text")).alias("prompt"))


@query("unit_degrees", "select user_id, round(avg(degrees(value / 100)), 4) as mean from events group by 1")
def unit_degrees(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r6(F.avg(F.degrees(F.col("value") / 100)), 4).alias("mean"))


@query("finite_vectors", "select count(*) as rows, count(*) filter (where l_linenumber <> 3) as finite, count(*) filter (where l_linenumber <> 3) as of_length from lineitem")
def finite_vectors(spark, d):
    v = F.when(F.col("l_linenumber") == 3, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")))
    return table(spark, d, "lineitem").select(v.alias("v")).agg(F.count("*").alias("rows"), F.count_if(V.all_finite(F.col("v"))).alias("finite"), F.count_if(F.size("v") == 3).alias("of_length"))


QN = "select event_id, value / 500 as w, sqrt(1 - (value / 500) * (value / 500)) as s from events"


@query("quaternions", f"select event_id, round(s * 0.6 * 2 * acos(w) / s, 5) as x, round(s * 0.8 * 2 * acos(w) / s, 5) as z from ({QN})")
def quaternions(spark, d):
    w = F.col("value") / 500
    s = F.sqrt(1 - w * w)
    a = C.axis_angle(s * 0.6, F.lit(0.0), s * 0.8, w)
    return table(spark, d, "events").select("event_id", r6(F.get(a, F.lit(0)), 5).alias("x"), r6(F.get(a, F.lit(2)), 5).alias("z"))


@query("grippers", "select l_returnflag as flag, round(sum(2 * (l_discount - 0.0) / 0.1 - 1), 4) as scaled, sum(sign(2 * l_quantity / 50 - 1))::double as signs, -sum(sign(2 * l_quantity / 50 - 1))::double as turned from lineitem group by 1")
def grippers(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(r6(F.sum(C.gripper(F.col("l_discount"), 0.0, 0.1, binary=False)), 4).alias("scaled"), F.sum(C.gripper(q, 0.0, 50.0)).alias("signs"), F.sum(C.gripper(q, 0.0, 50.0, invert=True)).alias("turned"))


@query("sinusoids", "with p as (select s_suppkey, s_acctbal / 10000 as t from supplier), i as (select unnest(range(8)) as i) select s_suppkey, i as dim, round(case when i < 4 then sin(t * 2 * pi() / (0.004::double * pow(1000.0::double, i / 3.0::double))) else cos(t * 2 * pi() / (0.004::double * pow(1000.0::double, (i - 4) / 3.0::double))) end, 4) as x from p cross join i")
def sinusoids(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.posexplode(C.sinusoid(F.col("s_acctbal") / 10000, 8, 0.004, 4.0)).alias("dim", "x"))
    return rounded(df, 4)


@query("multiple_of_8", "select p_size::bigint as p_size, (p_size + (8 - p_size % 8) % 8)::bigint as padded, count(*) as n from part group by 1, 2")
def multiple_of_8(spark, d):
    return table(spark, d, "part").groupBy("p_size", V.next_multiple(F.col("p_size")).alias("padded")).agg(F.count("*").alias("n"))


@query("typed_settings", "select k, case when lower(s) in ('yes', 'true', 't', 'y', '1') then 'true' when lower(s) in ('no', 'false', 'f', 'n', '0') then 'false' else 'none' end as flag, case when regexp_full_match(s, '[0-9]+') then 'long' when regexp_full_match(s, '[0-9]+[.][0-9]*|[.][0-9]+') then 'double' when lower(s) in ('true', 'false') then 'bool' else 'text' end as kind from (select unnest(range(9)) as k, unnest(['Yes', 'n', '1', '0', '12', '1.5', 'abc', 'TRUE', '.5']) as s)")
def typed_settings(spark, d):
    df = spark.createDataFrame(list(enumerate(["Yes", "n", "1", "0", "12", "1.5", "abc", "TRUE", ".5"])), "k long, s string")
    t = C.typed(F.col("s"))
    kind = F.when(t["as_bool"].isNotNull(), "bool").when(t["as_long"].isNotNull(), "long").when(t["as_double"].isNotNull(), "double").otherwise("text")
    return df.select("k", F.coalesce(C.truth(F.col("s")).cast("string"), F.lit("none")).alias("flag"), kind.alias("kind"))


@query("html_escape", "select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped from pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", C.html_escaped(F.col("html")).alias("escaped"))


@query("slugs", "select p_partkey, substr(regexp_replace(lower(p_name), '[ \\n.]', '_', 'g'), 1, 50) as slug from part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", C.slug(F.col("p_name")).alias("slug"))


@query("linear_blend", "select user_id, i, round(avg(value * (1 - (i + 1) / 5.0::double) + 100 * (i + 1) / 5.0::double), 5) as mean from events cross join (select unnest(range(5)) as i) group by 1, 2")
def linear_blend(spark, d):
    mixed = F.array(*(F.get(V.blend(F.array("value"), F.array(F.lit(100.0)), (i + 1) / 5.0), F.lit(0)) for i in range(5)))
    return table(spark, d, "events").select("user_id", F.posexplode(mixed).alias("i", "x")).groupBy("user_id", "i").agg(r6(F.avg("x"), 5).alias("mean"))


@query("rank_slices", "select conv_id, turn, r as rank, greatest(0, least(strlen(text), (r + 1) * ceil(strlen(text) / 4.0::double)::bigint) - least(strlen(text), r * ceil(strlen(text) / 4.0::double)::bigint))::bigint as n from conversations cross join (select unnest(range(4)) as r)")
def rank_slices(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", V.indices(F.octet_length("text")).alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"))
    return df.select("conv_id", "turn", "rank", F.size(V.shard_of(F.col("ids"), F.col("rank"), 4)).alias("n"))


@query("batch_arithmetic", "select 8192::bigint as token_micro_batch, 8::bigint as micro_batches, (select count(*) // 256 * 3 from documents) as steps")
def batch_arithmetic(spark, d):
    tokens, micro = C.batch_plan(4, 2048, 256, 8)
    n = table(spark, d, "documents").count()
    return spark.createDataFrame([(tokens, micro, C.train_steps(n, 256, 3))], "token_micro_batch long, micro_batches long, steps long")


@query("token_fixed_length", "select conv_id, turn, 72::bigint as size, least(72, strlen(text)) as real from conversations")
def token_fixed_length(spark, d):
    from episodica.functions.text import byte_ids

    df = table(spark, d, "conversations").withColumn("ids", byte_ids(F.col("text")))
    mask = V.real_mask(F.size("ids"), 72)
    return df.select("conv_id", "turn", F.size(V.fixed_length(F.col("ids"), 72, F.lit(0))).alias("size"), F.size(F.filter(mask, lambda m: m)).alias("real"))


@query("resize_plan", "with s as (select p_partkey, 100 + p_size * 7 as h, 80 + p_size * 11 as w from part), r as (select *, greatest(w / 224.0::double, h / 224.0::double) as r from s) select p_partkey, floor(h / r)::bigint as height, floor(w / r)::bigint as width, 224 - floor(h / r)::bigint as top, 224 - floor(w / r)::bigint as \"left\" from r")
def resize_plan(spark, d):
    df = table(spark, d, "part").select("p_partkey", C.resize_plan(100 + F.col("p_size") * 7, 80 + F.col("p_size") * 11, 224, 224).alias("s"))
    return df.select("p_partkey", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("height", "width", "top", "left")))


CONFIG = [
    {"target": "arm", "origin": "state", "start": 0, "end": 2, "position": 0, "subtract_state": True},
    {"target": "grip", "origin": "state", "start": 2, "end": 3, "position": 0},
    {"target": "arm", "origin": "state", "start": 3, "end": 4, "position": 1, "subtract_state": True},
]


@query("mapping_compile", _sql("arm:0:l_quantity; arm:1:l_extendedprice; arm:2:l_tax; grip:0:l_discount"))
def mapping_compile(spark, d):
    plan, _ = M.from_config([*CONFIG, {"target": "flag", "origin": "flag"}])
    return _sums(plan.forward(item_vectors(spark, d).withColumnRenamed("v", "state")), "arm", "grip")
