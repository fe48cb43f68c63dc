"""Queries on readers and writers (what is written comes back) and on training examples, compared by their contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.durable import new_path
from episodica.functions import text as X
from episodica.functions import vectors as V
from episodica.operators import aggregates as A
from episodica.operators import batching as B
from episodica.operators import examples as Ex
from episodica.operators import windows as W
from episodica.plans.base import BYTES, EP, FR, FRAME, PACKED, PRINT, RANKS, STRIP, event_frames, item_frames, item_values, lengths, printed, query, r6, rounded, table
from episodica.shipping import ship_package
from episodica.sources import arrays, scans, sinks
from episodica.streaming.monitor import run_to_end
from episodica.streaming.packing import packed_stream


@query("roundtrip_parquet", f"with {FR} select episode, frame, value from fr")
def roundtrip_parquet(spark, d):
    """Episodes written, verified, and read by the scan that goes by extensions."""
    path = new_path(spark, "episodes")
    fr = event_frames(spark, d).select("episode", "frame", "value")
    sinks.write_episodes(fr, path, "episode", "frame", 8)
    if sinks.verify(fr, path):
        raise ValueError("what was written differs")
    return scans.read_files(spark, path)


@query("roundtrip_json_lines", "select conv_id, turn, role, text from conversations")
def roundtrip_json_lines(spark, d):
    path, c = new_path(spark, "lines"), table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_json_lines(c, path)
    return scans.strict_json(spark, path, c.schema)


@query("lenient_lines", "select event_id, value from events where event_id % 7 <> 3")
def lenient_lines(spark, d):
    """Every seventh line is cut off: it is dropped, and the others are read."""
    path = new_path(spark, "lenient")
    line = F.to_json(F.struct("event_id", "value"))
    table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 3, F.concat(F.lit("{\"event_id\": "), F.lit("oops"))).otherwise(line).alias("value")).write.text(path)
    return scans.lenient_json(spark, path, "event_id long, value double")


@query("roundtrip_csv", "select s_suppkey, s_name, case when s_acctbal > 0 then 'True' else 'False' end as positive from supplier")
def roundtrip_csv(spark, d):
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("positive")), path)
    return spark.read.option("header", "true").schema("s_suppkey long, s_name string, positive string").csv(path)


@query("roundtrip_document", "select n_nationkey::bigint as nation, n_name as name from nation")
def roundtrip_document(spark, d):
    """A small table as one JSON document, which a second write must refuse to replace."""
    path = new_path(spark, "document") + "/info.json"
    sinks.write_document(spark, {str(r.n_nationkey): r.n_name for r in table(spark, d, "nation").collect()}, path)
    try:
        sinks.write_document(spark, {}, path)
    except FileExistsError:
        rows = [(int(k), v) for k, v in scans.read_settings(spark, path).items()]
        return spark.createDataFrame(rows, "nation long, name string")
    raise ValueError("a file was replaced")


@query("refuse_overwrite", "select 'folder' as what, true as refused union all select 'new', false")
def refuse_overwrite(spark, d):
    path = new_path(spark, "taken")
    table(spark, d, "region").write.parquet(path)
    out = []
    for what, p in (("folder", path), ("new", f"{path}-new")):
        try:
            sinks.refuse_existing(spark, p)
            out.append((what, False))
        except FileExistsError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


VALUES = "lo as (select unnest([0::bigint, 1, 2, 3]) as dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem)"


@query("roundtrip_stats", f"with {VALUES} select 'v' as feature, dim, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max from lo group by dim")
def roundtrip_stats(spark, d):
    """Statistics as the document that normalization reads, and back."""
    path = new_path(spark, "stats") + "/norm_stats.json"
    stats = A.plain_stats(item_values(spark, d), ["dim"]).withColumn("feature", F.lit("v")).select("feature", "dim", "mean", "std", "min", "max")
    sinks.write_document(spark, sinks.stats_document(stats), path)
    back = sinks.stats_table(spark, scans.read_document(spark, path))
    return back.select("feature", "dim", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "min", "max")


@query("episode_scan", "select o_orderkey as episode_index, o_orderstatus as \"observation.state\" from orders")
def episode_scan(spark, d):
    """Data files of a dataset with dots in their columns' names: only the columns asked for are read."""
    root = new_path(spark, "dataset")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderstatus").alias("observation.state"), F.col("o_totalprice").alias("action")).write.parquet(f"{root}/data")
    return scans.episode_frames(spark, root, ["episode_index", "observation.state"])


@query("episode_metadata", "select user_id as episode_index, count(*) as \"data_chunk_index\" from events group by 1")
def episode_metadata(spark, d):
    """Metadata in files of several folders, slashes in their names made underscores."""
    root = new_path(spark, "metadata")
    ep = lengths(spark, d).select(F.col("episode").alias("episode_index"), F.col("length").alias("data/chunk_index"), (F.col("episode") % 3).alias("chunk"))
    ep.write.partitionBy("chunk").parquet(f"{root}/meta/episodes")
    return scans.episode_metadata(spark, root).select("episode_index", "data_chunk_index")


@query("map_transform", "select event_id, value * 2 + 1 as value from events where event_type = 'click'")
def map_transform(spark, d):
    """Steps of a pipeline, one after the other."""
    steps = (lambda df: df.filter("event_type = 'click'"), lambda df: df.withColumn("value", F.col("value") * 2), lambda df: df.withColumn("value", F.col("value") + 1), lambda df: df.select("event_id", "value"))
    return scans.map_rows(table(spark, d, "events"), *steps)


@query("streaming_scan", "select event_id, user_id, value from events")
def streaming_scan(spark, d):
    """A folder as a stream in two runs: the second goes on where the first one's checkpoint ends, and nothing comes twice."""
    root, e = new_path(spark, "stream"), table(spark, d, "events").select("event_id", "user_id", "value")
    for k in (0, 1):
        e.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{root}/in")
        run_to_end(scans.read_stream(spark, f"{root}/in", "parquet", e.schema), f"{root}/checkpoint", f"{root}/out")
    return spark.read.schema(e.schema).parquet(f"{root}/out")


@query("packed_stream")
def packed_stream_resumed(spark, d):
    """The packer as a stream that is stopped and goes on from its checkpoint. Its greedy choice has no SQL; a test compares it with the batch form."""
    ship_package(spark)
    root = new_path(spark, "packing")
    docs = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("sample_id"), F.col("n_chars").cast("long").alias("length"))
    middle = docs.agg(F.max("sample_id")).first()[0] or 0
    for part in (docs.filter(F.col("sample_id") * 2 <= middle), docs.filter(F.col("sample_id") * 2 > middle)):
        part.write.mode("append").parquet(f"{root}/in")
        run_to_end(packed_stream(spark.readStream.schema(docs.schema).parquet(f"{root}/in"), 8000, 20), f"{root}/checkpoint", f"{root}/out")
    return spark.read.schema("shard long, batch long, place long, sample_id long, length long").parquet(f"{root}/out")


@query("dynamic_batches")
def dynamic_batches(spark, d):
    """60 steps of two greedy batches by source, sources read again as often as it takes. A fold over a buffer; a test runs it sample by sample."""
    ship_package(spark)
    return B.dynamic_batches(table(spark, d, "documents"), "doc_id", "n_chars", "source", 8000, 20, 2, 60)


CHATML = f"'<|im_start|>' || role || chr(10) || {STRIP} || '<|im_end|>' || chr(10)"


@query("sft_examples", f"with m as (select conv_id, turn, role, {BYTES.format(CHATML)} as ids from conversations), l as (select *, case when role = 'assistant' then ids else list_transform(ids, lambda x: -100::bigint) end as labels from m), c as (select conv_id, flatten(list(ids order by turn)) as ids, flatten(list(labels order by turn)) as labels from l group by 1), t as (select conv_id, ids[greatest(1, len(ids) - 511):] as ids, labels[greatest(1, len(labels) - 511):] as labels from c) select conv_id, len(ids) as tokens, {PRINT.format('ids')} as input_ids, {PRINT.format('labels')} as labels, {PRINT.format('list_transform(ids, lambda x: 1)')} as mask from t")
def sft_examples(spark, d):
    """Conversations as token examples: the text under the first key that is there, rendered, encoded, answers counting, the tail kept."""
    rows = Ex.sft_examples(table(spark, d, "conversations"), "conv_id", "turn", "role", ["messages", "text"], "chatml", F.col("role") == "assistant", most=512)
    return rows.select("conv_id", F.size("input_ids").alias("tokens"), printed("input_ids").alias("input_ids"), printed("labels").alias("labels"), printed("attention_mask").alias("mask"))


TWO = f"case when text = '' then role || ':' when contains(role, 'assistant') then 'Assistant: ' || {STRIP} || '<｜end▁of▁sentence｜>' when contains(role, 'user') then 'User: ' || {STRIP} || chr(10) || chr(10) when contains(role, 'system') then {STRIP} || chr(10) || chr(10) end"


@query("image_masks", f"with m as (select conv_id, turn, role, {BYTES.format(TWO)} as ids from conversations), n as (select *, len(list_filter(ids, lambda x: x = 101)) as k from m), l as (select *, case when role <> 'assistant' then list_transform(ids, lambda x: -100::bigint) when k > 0 then list_transform(ids, lambda x: case when x = 101 then x else -100 end) else ids end as labels, list_transform(ids, lambda x: (x = 101)::int) as im, case when k >= 9 then [k] else [] end as emb from n), c as (select conv_id, flatten(list(ids order by turn)) as ids, flatten(list(labels order by turn)) as labels, flatten(list(im order by turn)) as im, flatten(list(emb order by turn)) as emb from l group by 1) select conv_id, {PRINT.format('ids')} as input_ids, {PRINT.format('labels')} as labels, {PRINT.format('im')} as images, array_to_string(emb, ',') as whole from c")
def image_masks(spark, d):
    """The letter e stands for an image token, nine of which make an image."""
    rows = Ex.image_examples(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", F.col("role") == "assistant", 101, most=1 << 30, image_tokens=9)
    whole = F.array_join(F.transform("images_emb_mask", lambda m: F.size(m).cast("string")), ",")
    return rows.select("conv_id", printed("input_ids").alias("input_ids"), printed("labels").alias("labels"), printed(F.transform("images_seq_mask", lambda x: x.cast("int"))).alias("images"), whole.alias("whole"))


@query("cross_entropy", "with e as (select vec_id % 5 as part, embedding::double[] as e, case when vec_id % 3 = 0 then -100 else label end as label from embeddings), l as (select part, case when label <> -100 then ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[label + 1] end as loss from e) select part, round(avg(loss), 6) as loss, count(loss) as labels from l group by 1")
def cross_entropy(spark, d):
    """Vectors as logits; every third label is ignored."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("part"), "embedding", F.when(F.col("vec_id") % 3 == 0, X.IGNORED).otherwise(F.col("label")).alias("label"))
    return rounded(Ex.mean_loss(e, ["part"], "embedding", "label"))


def _packed(spark, d):
    c = table(spark, d, "conversations").filter(F.octet_length("text") > 0)
    ids = X.byte_ids(F.col("text"))
    c = c.select(F.floor(F.col("conv_id") / 4).alias("batch"), (F.col("conv_id") * 100 + F.col("turn")).alias("o"), ids.alias("ids"), ids.alias("labels"))
    return B.packed(c, "batch", "o", "ids", "labels")


@query("packed_contents", f"with {PACKED} select batch, {PRINT.format('ids')} as ids, {PRINT.format('labels')} as labels, {PRINT.format('positions')} as positions, {PRINT.format('cu')} as cu from p")
def packed_contents(spark, d):
    return _packed(spark, d).select("batch", printed("ids").alias("ids"), printed("labels").alias("labels"), printed("position_ids").alias("positions"), printed("cu_seqlens").alias("cu"))


@query("sequence_parallel", f"with {PACKED}, {RANKS} select batch, r as rank, {PRINT.format('i2[r * w + 1:r * w + w]')} as ids, {PRINT.format('l2[r * w + 1:r * w + w]')} as labels, {PRINT.format('p2')} as positions, {PRINT.format('m2')} as mask, {PRINT.format('c2')} as cu from s cross join (select unnest(range(4)) as r)")
def sequence_parallel(spark, d):
    """Slices of packed batches for four ranks, and what all ranks have alike."""
    rows = _packed(spark, d).withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    out = Ex.sequence_parallel(rows, 4, "ids", "labels", "position_ids", "mask", "cu_seqlens")
    return out.select("batch", "rank", printed("ids").alias("ids"), printed("labels").alias("labels"), printed("position_ids").alias("positions"), printed("mask").alias("mask"), printed("cu_seqlens").alias("cu"))


SAMPLED = f"{FR}, n as (select episode, count(*) as n from fr group by 1), w as (select distinct episode, unnest([0, n // 2, n - 1]) as frame, n from n)"


@query("sampled_frames", f"with {SAMPLED} select w.episode, w.frame, a.value as first, b.value as last, true as equal from w join fr a on a.episode = w.episode and a.frame = w.frame join fr b on b.episode = w.episode and b.frame = least(n - 1, w.frame + 9)")
def sampled_frames(spark, d):
    """Chunks as the loader makes them, at the first, middle and last frame, against rows looked up in the source."""
    fr, n = event_frames(spark, d).select("episode", "frame", "value"), lengths(spark, d)
    chunks = W.future_chunk(fr, "value", 10, EP, FRAME)
    loaded = chunks.select("episode", "frame", F.get("chunk", F.lit(0)).alias("first"), F.element_at("chunk", -1).alias("last"))
    at = fr.join(n, "episode").withColumn("__to", F.least(F.col("length") - 1, F.col("frame") + 9))
    ends = fr.select("episode", F.col("frame").alias("__to"), F.col("value").alias("last"))
    source = at.join(ends, ["episode", "__to"]).select("episode", "frame", F.col("value").alias("first"), "last")
    return Ex.sampled_differences(source, loaded, n, EP, "frame", "length", ["first", "last"])


@query("count_mismatches", "with a as (select o_orderkey as k, o_orderkey % 9 + 1 as declared from orders), b as (select l_orderkey as k, count(*) as counted from lineitem group by 1) select coalesce(a.k, b.k) as episode, coalesce(declared, 0) as declared, coalesce(counted, 0) as counted from a full join b on a.k = b.k where coalesce(declared, 0) <> coalesce(counted, 0)")
def count_mismatches(spark, d):
    """Declared sizes against what is there, the comparison that a frame count of videos ends in."""
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode"), (F.col("o_orderkey") % 9 + 1).alias("n"))
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count("*").alias("c"))
    return Ex.count_mismatches(declared, counted, "episode", "n", "c")


@query("cube_cells", "select vec_id, i // 8 as t, i % 8 as dim, embedding[i + 1]::double as value from embeddings cross join (select unnest(range(64)) as i)")
def cube_cells(spark, d):
    """Cubes of eight steps by eight dimensions in long form."""
    cube = F.transform(V.indices(F.lit(8)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    cells = Ex.long_form(table(spark, d, "embeddings").withColumn("cube", cube), ["vec_id"], "cube")
    return cells.withColumn("value", F.col("value").cast("double"))


@query("layered_settings", "select 'model.size' as name, 'large' as value union all select 'model.layers', '4' union all select 'train.rate', '0.5' union all select 'train.steps', '10'")
def layered_settings(spark, d):
    """Settings from defaults, a file and overrides, the later ones first."""
    defaults = {"model": {"size": "small", "layers": 4}, "train": {"rate": 0.1}}
    path = new_path(spark, "settings") + "/settings.json"
    sinks.write_document(spark, {"model": {"size": "large"}, "train": {"steps": 7}}, path)
    found = scans.layered(defaults, scans.read_settings(spark, path), scans.from_dotted({"train.rate": 0.5, "train.steps": 10}))
    return spark.createDataFrame([(k, str(v)) for k, v in scans.dotted(found).items()], "name string, value string")


@query("item_episode_frames", "select l_orderkey as episode, count(*) as frames, round(sum(l_tax), 6) as tax from lineitem group by 1")
def item_episode_frames(spark, d):
    """Vector frames by episode, from the frames' own scan."""
    rows = item_frames(spark, d).groupBy("episode").agg(F.count("*").alias("frames"), F.sum(F.get("v", F.lit(3))).alias("tax"))
    return rounded(rows)


def _written(df, tag, put):
    """A folder of files that tasks write, one for each of their batches: put(path, batch) writes one."""
    spark, folder = df.sparkSession, new_path(df.sparkSession, tag)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, own = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(own)
        for k, b in enumerate(batches):
            path = f"{own}/{TaskContext.get().partitionId()}-{k}"  # a task that runs again writes the same files
            put(store, path, b)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    ship_package(spark)
    df.mapInArrow(run, "path string").collect()  # a path for each file
    return folder


@query("arrow_scan", "select event_type, count(*) as n, round(sum(value), 4) as total, min(event_id) as first, max(event_id) as last from events group by 1")
def arrow_scan(spark, d):
    """Events as Arrow files of small record batches, read back by a data source that gives each run of batches a task."""

    def put(store, path, b):
        import pyarrow as pa

        with store.open_output_stream(path + ".arrow") as f, pa.ipc.new_file(f, b.schema) as w:
            for k in range(0, b.num_rows, 500):
                w.write_batch(b.slice(k, 500))

    folder = _written(table(spark, d, "events").select("event_id", "event_type", "value"), "arrow", put)
    arrays.register(spark)
    rows = spark.read.format("arrow_batches").schema("event_id long, event_type string, value double").option("batches", 4).load(f"{folder}/*.arrow")
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first"), F.max("event_id").alias("last")), 4)


@query("npz_scan", "with x as (select event_id, value from events) select 0::bigint as axis, count(*) as n, round(sum(event_id::double), 4) as total from x union all select 1, count(*), round(sum(value), 4) from x")
def npz_scan(spark, d):
    """Events as arrays of two columns in .npz files, their cells read back by slices."""

    def put(store, path, b):
        import numpy as np

        with store.open_output_stream(path + ".npz") as f:
            np.savez(f, x=np.stack([b.column(0).to_numpy().astype(np.float64), b.column(1).to_numpy()], axis=1))

    folder = _written(table(spark, d, "events").select("event_id", "value"), "npz", put)
    arrays.register(spark)
    cells = spark.read.format("npz_slices").option("rows", 3000).load(f"{folder}/*.npz")
    return rounded(cells.groupBy(F.col("index")[1].alias("axis")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)
