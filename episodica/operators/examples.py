"""Training examples from conversations, losses, and what sequence-parallel ranks need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import text as X
from episodica.functions import vectors as V

#: Fixed value: tokens that stand for one image.
IMAGE_TOKENS = 576


def _encoded(messages: DataFrame, conv: str, turn: str, parts: dict[str, Column], most: int) -> DataFrame:
    """A row for each conversation: the parts of its messages one after the other, in the order of turns, the last `most` values of each."""
    held = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("__t"), *(c.alias(n) for n, c in parts.items())))).alias("__m")
    rows = messages.groupBy(conv).agg(held)
    whole = lambda n: F.flatten(F.transform("__m", lambda m: m[n]))
    return rows.select(conv, *(X.tail(whole(n), most).alias(n) for n in parts))


def sft_examples(
    messages: DataFrame,
    conv: str,
    turn: str,
    role: str,
    keys: Sequence[str],
    template: str,
    counts: Column,
    tokenizer: X.Tokenizer = X.byte_ids,
    most: int = 8192,
) -> DataFrame:
    """input_ids, attention_mask and labels of each conversation.

    keys are names that the text may have; the first that is a column is taken, and none of them there raises. Each message is rendered by the
    named template and made tokens; labels are its tokens where counts is true, else ignored. Of long conversations the tail is kept.
    """
    body = X.first_present(messages.columns, keys)
    df = messages.withColumn("__ids", tokenizer(X.template(template)(F.col(role), body)))
    parts = {"input_ids": F.col("__ids"), "attention_mask": F.transform("__ids", lambda _: F.lit(1)), "labels": X.labels(F.col("__ids"), counts.cast("int"))}
    return _encoded(df, conv, turn, parts, most)


def image_examples(
    messages: DataFrame,
    conv: str,
    turn: str,
    role: str,
    content: str,
    counts: Column,
    image_id: int,
    task: str = "",
    tokenizer: X.Tokenizer = X.byte_ids,
    most: int = 8192,
    image_tokens: int = IMAGE_TOKENS,
) -> DataFrame:
    """As sft_examples for two-party chats that hold image tokens, with images_seq_mask (which tokens are an image's) and images_emb_mask.

    images_emb_mask has an array of true, one for each image token, of each message that holds at least one whole image. Where a message counts
    and holds image tokens, only these are labels, but in generation tasks all are.
    """
    generation = "wikihow_generation" in task or "interleave_generation" in task
    first, last = F.lit(None).cast("boolean"), F.lit(None).cast("boolean")
    if generation:
        from pyspark.sql import Window

        answer = F.col(role).contains("assistant") & (F.col(content) != "")
        messages = messages.withColumn("__a", answer)
        messages = messages.withColumn("__first", F.row_number().over(Window.partitionBy(conv, "__a").orderBy(turn)) == 1)
        messages = messages.withColumn("__last", F.col(turn) == F.max(turn).over(Window.partitionBy(conv)))
        first, last = F.col("__first"), F.col("__last")
    df = messages.withColumn("__ids", tokenizer(X.two_party(F.col(role), F.col(content), task, first, last)))
    is_image = F.transform("__ids", lambda i: i == image_id)
    n = F.size(F.filter("__ids", lambda i: i == image_id))
    images_only = F.transform("__ids", lambda i: F.when(i == image_id, i).otherwise(F.lit(X.IGNORED)))
    labels = X.labels(F.col("__ids"), counts.cast("int"))
    if not generation:
        labels = F.when(counts & (n > 0), images_only).otherwise(labels)
    whole = F.when(n >= image_tokens, F.array(F.array_repeat(F.lit(True), n))).otherwise(F.array().cast("array<array<boolean>>"))
    parts = {"input_ids": F.col("__ids"), "attention_mask": F.transform("__ids", lambda _: F.lit(1)), "labels": labels, "images_seq_mask": is_image, "images_emb_mask": whole}
    return _encoded(df, conv, turn, parts, most)


def cross_entropy(logits: Column, label: Column, ignored: int = X.IGNORED) -> Column:
    """-ln softmax(logits)[label]; null for an ignored or null label. The greatest logit is taken off first, so nothing overflows."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - most))
    return F.when(label != ignored, F.log(total) + most - F.get(logits, label.cast("int")).cast("double"))


def mean_loss(rows: DataFrame, by: Sequence[str], logits: str, label: str, num_items: Column | None = None) -> DataFrame:
    """Mean cross entropy over the labels that are not ignored; with num_items (an aggregate) the sum over that."""
    loss = cross_entropy(F.col(logits), F.col(label))
    rows = rows.withColumn("__loss", loss)
    return rows.groupBy(*by).agg((F.avg("__loss") if num_items is None else F.sum("__loss") / num_items).alias("loss"), F.count("__loss").alias("labels"))


def sequence_parallel(rows: DataFrame, n_ranks: int, ids: str, labels: str | None = None, positions: str | None = None, mask: str | None = None, cu_seqlens: str | None = None) -> DataFrame:
    """A row for each rank: its slice of ids and of labels moved left by one; positions, mask and cumulative lengths whole, padded.

    Padding up to a multiple of the ranks: ids and positions with 0, labels ignored, the mask with 1 where there are positions (they tell
    sequences apart) and else 0, cumulative lengths with as many values, each the last one plus the padding.
    """
    pad = F.pmod(-F.size(ids), F.lit(n_ranks))
    repeat = lambda value: F.array_repeat(value, pad)
    df = rows.withColumn("__i", F.concat(ids, repeat(F.lit(0))))
    if labels:
        df = df.withColumn("__l", F.concat(X.shifted(F.col(labels)), repeat(F.lit(X.IGNORED))))
    if positions:
        df = df.withColumn("__p", F.concat(positions, repeat(F.lit(0))))
    if mask:
        df = df.withColumn("__m", F.concat(mask, repeat(F.lit(1 if positions else 0))))
    if cu_seqlens:
        df = df.withColumn("__c", F.concat(cu_seqlens, repeat(F.element_at(cu_seqlens, -1) + pad)))
    df = df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(n_ranks - 1))))
    df = df.withColumn(ids, V.shard_of(F.col("__i"), F.col("rank"), n_ranks)).drop("__i")
    if labels:
        df = df.withColumn(labels, V.shard_of(F.col("__l"), F.col("rank"), n_ranks)).drop("__l")
    for name, full in ((positions, "__p"), (mask, "__m"), (cu_seqlens, "__c")):
        if name:
            df = df.withColumn(name, F.col(full)).drop(full)
    return df


def long_form(cubes: DataFrame, keys: Sequence[str], cube: str, names: Sequence[str] = ("t", "dim"), value: str = "value") -> DataFrame:
    """A row for each cell of nested arrays, one index for each level."""
    df = cubes.select(*keys, F.col(cube).alias("__c"))
    for n in names[:-1]:
        kept = [c for c in df.columns if c != "__c"]
        df = df.select(*kept, F.posexplode("__c").alias(n, "__c"))
    kept = [c for c in df.columns if c != "__c"]
    return df.select(*kept, F.posexplode("__c").alias(names[-1], value))


Check = Callable[[Column, Column], Column]


def sampled_differences(source: DataFrame, loaded: DataFrame, sizes: DataFrame, keys: Sequence[str], frame: str, size: str, columns: Sequence[str]) -> DataFrame:
    """The first, middle and last frame of each episode, as loaded, with `equal`: whether all columns are there and the same as in the source."""
    wanted = sizes.select(*keys, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col(size) / 2), F.col(size) - 1))).alias(frame))
    other = source.select(*keys, frame, *(F.col(c).alias(f"__{c}") for c in columns))
    both = wanted.join(loaded.select(*keys, frame, *columns), [*keys, frame], "left").join(other, [*keys, frame], "left")
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(c).isNotNull() & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return both.withColumn("equal", equal).drop(*(f"__{c}" for c in columns))


def count_mismatches(declared: DataFrame, counted: DataFrame, key: str, size: str, count: str) -> DataFrame:
    """Keys whose counted rows are not as many as declared; missing on a side counts as 0."""
    both = declared.select(key, F.col(size).cast("long").alias("declared")).join(counted.select(key, F.col(count).cast("long").alias("counted")), key, "full")
    both = both.select(key, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.filter("declared <> counted")
