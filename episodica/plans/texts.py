"""Queries on text: chunks, chat templates, loss masks, packing, collation, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.durable import new_path
from episodica.functions import closed_forms as C
from episodica.functions import text as X
from episodica.functions import vectors as V
from episodica.operators import batching as B
from episodica.operators import table_functions
from episodica.plans.base import BYTES, PACKED, PRINT, RANKS, STRIP, micros, printed, query, r6, rounded, table
from episodica.shipping import ship_package
from episodica.streaming import monitor as Mo


@query("text_chunks", "select doc_id, i as chunk, least(512, strlen(text) + 1 - i * 512) as n from (select doc_id, text, unnest(range((strlen(text) + 512) // 512)) as i from documents)")
def text_chunks(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n"))
    ids = F.concat(V.indices(F.col("n")), F.array(F.lit(-1)))
    return df.select("doc_id", F.posexplode(V.chunks(ids, 512)).alias("chunk", "ids")).select("doc_id", "chunk", F.size("ids").alias("n"))


@query("text_pieces_lateral", "select doc_id, i as chunk, least(512, strlen(text) + 1 - i * 512) as n from (select doc_id, text, unnest(range((strlen(text) + 512) // 512)) as i from documents)")
def text_pieces_lateral(spark, d):
    """The same by a table function in SQL."""
    table_functions.register(spark)
    table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n")).createOrReplaceTempView("__pieces_of")
    return spark.sql("select doc_id, c.chunk, c.n from __pieces_of, lateral text_pieces(__pieces_of.n, 512) as c")


@query("pack_lateral")
def pack_lateral(spark, d):
    """Greedy batches by source as a table function over ordered partitions; a test compares it with the same packer run sample by sample."""
    table_functions.register(spark)
    table(spark, d, "documents").select("source", "doc_id", "n_chars").createOrReplaceTempView("__packed_of")
    return spark.sql("select key as source, batch, place, id as doc_id, length as n_chars from pack_by_budget(table(__packed_of) partition by (source) order by (doc_id), 4000, 20)")


@query("pretrain_examples", "with b as (select conv_id, turn, text, unnest(range((strlen(text) + 64) // 64)) as i from conversations) select conv_id, turn, i as chunk, least(64, strlen(text) + 1 - i * 64) as n, i = strlen(text) // 64 as has_end from b")
def pretrain_examples(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.pretrain_chunks(F.col("text"), X.byte_ids, 256, 64)).alias("chunk", "ids"))
    return df.select("conv_id", "turn", "chunk", F.size("ids").alias("n"), (F.element_at("ids", -1) == 256).alias("has_end"))


@query("chat_default", f"select conv_id, turn, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || {STRIP} || '</s>' || chr(10) as rendered from conversations")
def chat_default(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.template("default")(F.col("role"), F.col("text")).alias("rendered"))


@query("chat_llama2", f"select conv_id, turn, case role when 'system' then '<<SYS>>' || chr(10) || {STRIP} || chr(10) || '<</SYS>>' || chr(10) || chr(10) when 'user' then '<s>[INST] ' || {STRIP} || ' [/INST]' when 'assistant' then ' ' || {STRIP} || ' </s>' when 'tool' then '<s>[TOOL] ' || {STRIP} || ' [/TOOL]' end as rendered from conversations")
def chat_llama2(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.template("llama2")(F.col("role"), F.col("text")).alias("rendered"))


@query("chat_chatml", f"select conv_id, string_agg('<|im_start|>' || role || chr(10) || {STRIP} || '<|im_end|>' || chr(10), '' order by turn) as rendered from conversations group by 1")
def chat_chatml(spark, d):
    df = table(spark, d, "conversations").withColumn("r", X.template("chatml")(F.col("role"), F.col("text")))
    return df.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda s: s["r"]), "").alias("rendered"))


@query("chat_two_party", f"select conv_id, turn, case when text = '' then role || ':' when contains(role, 'assistant') then 'Assistant: ' || {STRIP} || '<｜end▁of▁sentence｜>' when contains(role, 'user') then 'User: ' || {STRIP} || chr(10) || chr(10) when contains(role, 'system') then {STRIP} || chr(10) || chr(10) end as rendered from conversations")
def chat_two_party(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.template("Janus")(F.col("role"), F.col("text")).alias("rendered"))


@query("chat_generation", f"with c as (select *, row_number() over (partition by conv_id, contains(role, 'assistant') order by turn) = 1 as f, turn = max(turn) over (partition by conv_id) as l from conversations) select conv_id, turn, case when text = '' then role || ':' when contains(role, 'assistant') then case when f then 'Assistant: ' else '' end || {STRIP} || case when l then '<｜end▁of▁sentence｜>' else chr(10) || chr(10) end when contains(role, 'user') then 'User: ' || {STRIP} || chr(10) || chr(10) else {STRIP} || chr(10) || chr(10) end as rendered from c")
def chat_generation(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("f", F.row_number().over(Window.partitionBy("conv_id", F.col("role").contains("assistant")).orderBy("turn")) == 1)
    c = c.withColumn("l", F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id")))
    return c.select("conv_id", "turn", X.two_party(F.col("role"), F.col("text"), "interleave_generation", F.col("f"), F.col("l")).alias("rendered"))


@query("loss_masks", "select conv_id, sum(strlen(text))::bigint as tokens, sum(case when role = 'assistant' then strlen(text) else 0 end)::bigint as counted from conversations group by 1")
def loss_masks(spark, d):
    c = table(spark, d, "conversations").withColumn("ids", X.byte_ids(F.col("text"))).withColumn("labels", X.labels(F.col("ids"), (F.col("role") == "assistant").cast("int")))
    rows = c.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "labels"))), lambda s: s["labels"])).alias("labels"))
    return rows.select("conv_id", F.size("labels").alias("tokens"), F.size(F.filter("labels", lambda x: x != X.IGNORED)).alias("counted"))


@query("keep_tail", "select doc_id, least(n_chars, 200) as kept, right(text, 200) as tail from documents")
def keep_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.least("n_chars", F.lit(200)).alias("kept"), F.right("text", F.lit(200)).alias("tail"))


@query("usable_samples", "select event_id from events where event_id % 4 <> 1 and event_id % 4 <> 2")
def usable_samples(spark, d):
    k = F.col("event_id") % 4
    ids = F.when(k == 1, F.array(F.lit(5))).when(k == 2, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(7)))
    return B.usable(table(spark, d, "events").select("event_id", ids.alias("ids")), "ids").select("event_id")


@query("budget_packing")
def budget_packing(spark, d):
    """Greedy batches of at most 4,000 characters by source; skipping makes them a fold that SQL does not have."""
    ship_package(spark)
    return B.packed_by_budget(table(spark, d, "documents"), "doc_id", "n_chars", "source", 4000, 20)


PACK = f"c as (select conv_id // 4 as batch, conv_id * 100 + turn as o, strlen(text) as n, {BYTES.format('text')} as ids from conversations where strlen(text) > 0)"


def _samples(spark, d):
    c = table(spark, d, "conversations").filter(F.octet_length("text") > 0)
    ids = X.byte_ids(F.col("text"))
    return c.select(F.floor(F.col("conv_id") / 4).alias("batch"), (F.col("conv_id") * 100 + F.col("turn")).alias("o"), ids.alias("ids"), ids.alias("labels"))


@query("pad_collate", f"with {PACK}, m as (select batch, max(n) as m from c group by 1) select batch, o, {PRINT.format('list_concat(ids, list_transform(range(m - n), lambda i: 0::bigint))')} as ids, {PRINT.format('list_concat(ids, list_transform(range(m - n), lambda i: -100::bigint))')} as labels, {PRINT.format('list_concat(list_transform(ids, lambda i: 1), list_transform(range(m - n), lambda i: 0))')} as mask from c join m using (batch)")
def pad_collate(spark, d):
    df = B.pad_collated(_samples(spark, d), "batch", "ids", "labels")
    return df.select("batch", "o", printed("ids").alias("ids"), printed("labels").alias("labels"), printed("attention_mask").alias("mask"))


@query("pack_collate", f"with {PACK} select batch, sum(n)::bigint as tokens, count(*) + 1 as cu, count(*) - 1 as ignored, sum(n * (n - 1) // 2)::bigint as positions from c group by 1")
def pack_collate(spark, d):
    df = B.packed(_samples(spark, d), "batch", "o", "ids", "labels")
    positions = F.aggregate("position_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("batch", F.size("ids").alias("tokens"), F.size("cu_seqlens").alias("cu"), F.size(F.filter("labels", lambda x: x == X.IGNORED)).alias("ignored"), positions.alias("positions"))


@query("stack_collate", "select conv_id // 4 as batch, count(*) as samples, list_sum(list(strlen(text) order by conv_id, turn))::bigint as bytes, list(role order by conv_id, turn)[1] as first_role from conversations group by 1")
def stack_collate(spark, d):
    c = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 4).alias("batch"), (F.col("conv_id") * 100 + F.col("turn")).alias("o"), F.octet_length("text").alias("n"), "role")
    out = B.stacked(c, "batch", "o", ["n", "role"])
    return out.select("batch", "samples", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"), F.get("role", F.lit(0)).alias("first_role"))


@query("micro_batches", f"with {PACK} select batch, (row_number() over (partition by batch order by o) - 1) // 3 as micro_batch, o from c")
def micro_batches(spark, d):
    return B.micro_batches(_samples(spark, d), ["batch"], ["o"], 3).select("batch", "micro_batch", "o")


@query("sequence_shards", f"with {PACKED}, {RANKS} select batch, r as rank, {PRINT.format('i2[r * w + 1:r * w + w]')} as ids, {PRINT.format('l2[r * w + 1:r * w + w]')} as labels, {PRINT.format('p2[r * w + 1:r * w + w]')} as positions from s cross join (select unnest(range(4)) as r)")
def sequence_shards(spark, d):
    df = B.sequence_shards(B.packed(_samples(spark, d), "batch", "o", "ids", "labels"), "ids", "labels", 4, "cu_seqlens", "position_ids")
    return df.select("batch", "rank", printed("ids").alias("ids"), printed("labels").alias("labels"), printed("position_ids").alias("positions"))


@query("sequence_shard_labels", f"with {PACK} select batch, sum(n)::bigint as tokens, count(*)::bigint as ignored from c group by 1")
def sequence_shard_labels(spark, d):
    """Over all ranks, as many labels as tokens; ignored are the last one of each sequence, and padding."""
    df = B.sequence_shards(B.packed(_samples(spark, d), "batch", "o", "ids", "labels"), "ids", "labels", 4, "cu_seqlens", "position_ids")
    per = df.select("batch", F.element_at("cu_seqlens", -1).alias("n"), F.size("labels").alias("k"), F.size(F.filter("labels", lambda x: x == X.IGNORED)).alias("i"))
    return per.groupBy("batch").agg(F.max("n").alias("tokens"), (F.sum("i") - (F.sum("k") - F.max("n"))).alias("ignored"))


@query("shifted_labels", f"with {PACK} select batch, o, {PRINT.format('list_concat(ids[2:], [-100::bigint])')} as labels from c")
def shifted_labels(spark, d):
    return _samples(spark, d).select("batch", "o", printed(X.shifted(F.col("labels"))).alias("labels"))


@query("masked_cross_entropy", "select event_type, round(avg(-ln(value / 500)) filter (where event_id % 3 <> 0), 6) as loss from events group by 1")
def masked_cross_entropy(spark, d):
    df = table(spark, d, "events").withColumn("label", F.when(F.col("event_id") % 3 == 0, X.IGNORED).otherwise(1))
    return df.groupBy("event_type").agg(r6(F.avg(F.when(F.col("label") != X.IGNORED, C.negative_log(F.col("value") / 500)))).alias("loss"))


@query("sequence_lengths", f"with {PACK} select batch, array_to_string(list(n order by o), ',') as lengths, max(n) as longest, count(*) as sequences from c group by 1")
def sequence_lengths(spark, d):
    df = B.packed(_samples(spark, d), "batch", "o", "ids", "labels").withColumn("lens", V.lengths_from_cumulative(F.col("cu_seqlens")))
    return df.select("batch", F.array_join(F.transform("lens", lambda n: n.cast("string")), ",").alias("lengths"), F.array_max("lens").alias("longest"), F.size("lens").alias("sequences"))


@query("event_windows", "select epoch_us(time_bucket(interval '1 hour', ts)) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    return rounded(Mo.tumbling_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour").withColumn("start", micros("start")), 4)


@query("event_windows_stream", "select epoch_us(time_bucket(interval '1 hour', ts)) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows_stream(spark, d):
    """The same as a stream over the table's files, with a watermark, run to the end of what is there."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet" if not _is_dir(spark, f"{d}/events.parquet") else "*.parquet").parquet(d if not _is_dir(spark, f"{d}/events.parquet") else f"{d}/events.parquet")
    agg, path = Mo.tumbling_counts(stream, "ts", ["event_type"], "value", "1 hour"), new_path(spark, "windows")
    Mo.run_whole(agg, f"{path}/checkpoint", f"{path}/out")
    return rounded(spark.read.schema(agg.schema).parquet(f"{path}/out").withColumn("start", micros("start")), 4)


@query("user_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval '12 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from g) select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 43200000000 as \"end\", count(*) as n from s group by user_id, s")
def user_sessions(spark, d):
    out = Mo.sessions(table(spark, d, "events"), "ts", ["user_id"], "12 hours")
    return out.select("user_id", micros("start").alias("start"), micros("end").alias("end"), "n")


@query("stale_users", "select user_id, (epoch(timestamp '2024-02-01 00:00:00')::bigint - floor(epoch(max(ts)))::bigint) as age from events group by 1 having epoch(timestamp '2024-02-01 00:00:00')::bigint - floor(epoch(max(ts)))::bigint > 172800")
def stale_users(spark, d):
    return Mo.stale(table(spark, d, "events"), "ts", ["user_id"], "2024-02-01 00:00:00", 172_800).select("user_id", "age")


@query("finished_runs", "select user_id, max(event_id) as step, max(event_id) >= 9900 as complete from events group by 1")
def finished_runs(spark, d):
    return Mo.finished(table(spark, d, "events"), ["user_id"], "event_id", 9900)


@query("completed_runs", "with s as (select user_id, max(event_id) as step from events group by 1), f as (select c_custkey as user_id, 1 + (c_nationkey % 2) as n from customer) select s.user_id, step, step >= 100 and coalesce(n, 0) = 2 as complete, (2 - coalesce(n, 0))::bigint as missing from s left join f using (user_id)")
def completed_runs(spark, d):
    """Runs whose last step is there, and both files that they should leave."""
    names = F.when(F.col("c_nationkey") % 2 == 1, F.array(F.lit("model.bin"), F.lit("optim.bin"))).otherwise(F.array(F.lit("model.bin")))
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(names).alias("name"))
    return Mo.completed(table(spark, d, "events"), files, ["user_id"], "event_id", 100, "name", ["model.bin", "optim.bin"])


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
