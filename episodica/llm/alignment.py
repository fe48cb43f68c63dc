"""Alignment of two tokenizers: minimal groups of tokens over the same bytes, links of overlapping tokens, and how often a link's ids meet.

Tokens of both sides are nodes and overlapping ones are joined; the components that union-find makes of this bipartite graph are the minimal
groups, and their members' overlaps are the links. Neither vocabulary has a token that goes on across a space or a line's end after other than
white space, so both cut a text there: it is aligned by its chunks, each distinct one once, and what holds of a text is the sum over its chunks.

Texts are taken in slices. A slice is written as rows of its texts (which chunks, how often) and one row of its distinct links; those are
counted over all slices by a shuffle of one row for each slice and link, and the counts return to their slices, not to texts.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.durable import durable
from episodica.llm.common import ship_package, tidy
from episodica.llm.tokens import gathered, text_slices, vocabulary_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes that chunks remembered by a worker may take, a chunk counting this many besides its own.
MOST_BYTES, CHUNK_COST = 32_000_000, 240
#: Bytes of chunks that are coded as one text.
JOINED_BYTES = 20_000
#: Where a text may be cut: before a space or a line's end after other than white space, but not at its last code point.
CUT = re.compile(r"(?<=\S)(?=[ \n].)", re.DOTALL)
B_BITS = 32
ENCODED = T.StructType(
    [T.StructField("slice", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("chunks", "times", "held")]
    + [T.StructField("pairs", T.ArrayType(T.LongType()))]
)
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())]
)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 and edges (u, v), all edges at once: the smallest node of each one's component. The larger of two
    roots is hung below the smaller, then paths are halved until every node knows its root."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (of A, of B) of all pairs of tokens that share bytes; both sides cover the same bytes without gaps."""
    starts = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts, side="right")
    n = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in order from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Numbers(dict):
    """Chunks to numbers in order of their first look."""

    def __missing__(self, chunk: str) -> int:
        found = self[chunk] = len(self)
        return found


class Aligner:
    """Chunks that a worker has seen, aligned. Attributes are arrays with an entry for each."""

    def __init__(self, a: str = A_VOCABULARY, b: str = B_VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(vocabulary_path(a)), sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b))
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        letter, vocab = _letters(), self.a.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        known = {i: t.encode() if t in special else bytes(letter[c] for c in t) for t, i in vocab.items()}
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in parts], np.int64) for parts in (self.bytes_a, self.bytes_b))
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number, self.cost = _Numbers(), 0
        self.ok = np.zeros(0, bool)
        self.n_a, self.n_b, self.n_groups, self.lens = (np.zeros(0, np.int64) for _ in range(4))
        self.pairs, self.groups = np.zeros(0, np.int64), []

    def chunks(self, text: str) -> list[str]:
        """The chunks of the text after the space that is added: each begins with a space or a line's end."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def numbers(self, text: str) -> np.ndarray:
        found = self.chunks(text)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def align_new(self) -> None:
        """Aligns the chunks numbered since the last time."""
        new = list(self.number)[len(self.ok) :]
        if not new:
            return
        sizes = pc.binary_length(pa.array(new, pa.large_string())).to_numpy().astype(np.int64)
        self.cost += int(sizes.sum()) * 4 + CHUNK_COST * len(new)
        (flat_a, n_a), (flat_b, n_b) = self._coded(new, sizes, self._ids_a, self.bytes_a, self.size_a), self._coded(new, sizes, self._ids_b, self.bytes_b, self.size_b)
        ok = (n_a > 0) & (n_b > 0)
        flat_a, flat_b = flat_a[np.repeat(ok, n_a)], flat_b[np.repeat(ok, n_b)]
        n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        a, b = overlaps(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        group = components(len(flat_a) + len(flat_b), a, b + len(flat_a))
        chunk_of = np.repeat(np.arange(len(new)), n_a)
        lens = np.bincount(chunk_of[a], minlength=len(new)).astype(np.int64)
        first = np.flatnonzero(group[: len(flat_a)] == np.arange(len(flat_a)))  # a group's smallest node is its first token of A
        n_groups = np.bincount(chunk_of[first], minlength=len(new)).astype(np.int64)
        self.groups += self._texts(n_groups, flat_a, flat_b, first, group[len(flat_a) :])
        for name, x in (("ok", ok), ("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("lens", lens), ("pairs", flat_a[a] << B_BITS | flat_b[b])):
            setattr(self, name, np.concatenate([getattr(self, name), x]))

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """B adds a space itself: it takes the place of the one that a text begins with, or is left out again."""
        out = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, out)]

    def _coded(self, chunks: list[str], sizes: np.ndarray, ids_of: Callable, parts: Sequence[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and how many each has: none if its tokens joined are not the chunk. Runs of chunks that end in other
        than white space are coded as one text, which is cut where they end."""
        runs, k, joined = [], 0, [self.cuts and not c[-1].isspace() for c in chunks]
        room_of = sizes.tolist()
        while k < len(chunks):
            to, room = k, JOINED_BYTES
            while to < len(chunks) and room > 0 and joined[to]:
                room -= room_of[to]
                to += 1
            runs.append((k, max(to, k + 1)))
            k = runs[-1][1]
        flat, n = [np.zeros(0, np.int64)], np.zeros(len(chunks), np.int64)
        for (k, to), ids in zip(runs, ids_of(["".join(chunks[k:to]) for k, to in runs])):
            whole = "".join(chunks[k:to]).encode()
            got, to_bytes = np.array(ids, np.int64), np.cumsum(sizes[k:to])
            ends = np.cumsum(size[got])
            last = np.searchsorted(ends, to_bytes)
            if b"".join(map(parts.__getitem__, ids)) == whole and np.array_equal(ends[last], to_bytes):
                flat.append(got)
                n[k:to] = np.diff(last, prepend=-1)
            elif to > k + 1:
                for j, ids in enumerate(ids_of(chunks[k:to]), k):
                    if b"".join(map(parts.__getitem__, ids)) == chunks[j].encode():
                        flat.append(np.array(ids, np.int64))
                        n[j] = len(ids)
        return np.concatenate(flat), n

    @staticmethod
    def _texts(n_groups: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, group_b: np.ndarray) -> list[str]:
        """Each chunk's groups as text. Groups follow one another on both sides; first: their first tokens of A; group_b: the group of each token of B."""
        first_b = np.searchsorted(group_b, first)
        to, to_b = np.append(first[1:], len(a)), np.append(first_b[1:], len(b))
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        one = (to - first == 1) & (to_b - first_b == 1)
        places = zip(one.tolist(), first.tolist(), to.tolist(), first_b.tolist(), to_b.tolist())
        texts = [x[i] + "|" + y[j] if single else ",".join(x[i:k]) + "|" + ",".join(y[j:m]) for single, i, k, j, m in places]
        ends = np.cumsum(n_groups).tolist()
        return [";".join(texts[k:m]) for k, m in zip([0, *ends], ends)]


@functools.lru_cache
def aligner_of(a: str, b: str) -> Aligner:
    """The worker's own, kept from task to task."""
    return Aligner(a, b)


def _summed(of: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, of, x)
    return out


def _slice_rows(aligner: Aligner, number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows of a slice's texts (kind 0: different chunks and how often each occurs), then one (kind 1) of its links: for each chunk how many it has
    (chunks), which (times: places in pairs), and for each different link its ids (pairs) and how many texts have it (held)."""
    found = [aligner.numbers(t) if t else np.zeros(0, np.int64) for t in texts.to_pylist()]
    aligner.align_new()
    found = [x if aligner.ok[x].all() else x[:0] for x in found]
    digests = [hashlib.sha256(";".join(map(aligner.groups.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in found]
    n = len(found)
    doc, flat = np.repeat(np.arange(n), [len(x) for x in found]), np.concatenate([*found, np.zeros(0, np.int64)])
    used, local = np.unique(flat, return_inverse=True)
    key, times = np.unique(doc * max(1, len(used)) + local, return_counts=True)
    doc, chunk = key // max(1, len(used)), key % max(1, len(used))
    lens = aligner.lens[used]
    links = gathered(aligner.pairs, (np.cumsum(aligner.lens) - aligner.lens)[used], lens) if len(used) else np.zeros(0, np.int64)
    pairs, place = np.unique(links, return_inverse=True)
    each = gathered(place, (np.cumsum(lens) - lens)[chunk], lens[chunk]) if len(chunk) else np.zeros(0, np.int64)
    once = np.unique(np.repeat(doc, lens[chunk]) * max(1, len(pairs)) + each)
    held = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
    sums = [np.append(_summed(doc, n, times * c[used][chunk]), 0) for c in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.lens)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32) if n else np.zeros(1, np.int32)
    one = lambda mine, other: pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + len(other)).astype(np.int32)), pa.array(np.concatenate([mine, other]).astype(np.int32)))
    last = lambda x, kind: pa.array([None] * n + [x], pa.list_(kind))
    cols = [
        pa.array(np.full(n + 1, number)), pa.array(np.append(np.zeros(n), 1).astype(np.int32)), pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(1, pa.int64())]), *map(pa.array, sums),
        pa.array([*digests, ""]), one(chunk, lens), one(times, place), last(held.astype(np.int32), pa.int32()), last(pairs, pa.int64()),
    ]
    if aligner.cost > MOST_BYTES:
        aligner.forget()
    return pa.RecordBatch.from_arrays(cols, names=ENCODED.names)


def encoded(docs: DataFrame, a: str, b: str, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = aligner_of(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                yield _slice_rows(aligner, number, batch.column(0).slice(first, len(texts)), texts)
                number += 1
            tidy()
        aligner.forget()  # the worker keeps the vocabularies alone from task to task
        tidy()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ENCODED)


def _counted(rows: pa.Table, links: pa.Table) -> pa.Table:
    """A slice's texts with n_best and count_sum: sums over their chunks' links of whether a link is best, and of its count."""
    is_map = pc.equal(rows.column("kind"), 1)
    texts, about = rows.filter(pc.invert(is_map)).combine_chunks(), rows.filter(is_map)
    place = links.column("place").to_numpy()
    values = np.zeros((2, len(place)), np.int64)
    values[0, place], values[1, place] = links.column("best").to_numpy(), links.column("n").to_numpy()
    lens, at = np.array(about.column("chunks")[0].values.to_numpy(), np.int64), about.column("times")[0].values.to_numpy()
    of_chunk = np.repeat(np.arange(len(lens)), lens)
    per_chunk = [_summed(of_chunk, len(lens), v[at]) for v in values]
    chunk, times = texts.column("chunks"), texts.column("times")
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(chunk).to_numpy())
    chunk, times = (pc.list_flatten(c).to_numpy() for c in (chunk, times))
    n_best, count_sum = (pa.array(_summed(of, len(texts), times * v[chunk])) for v in per_chunk)
    cols = [*(texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), n_best, count_sum, texts.column("groups_sha256")]
    return pa.table(dict(zip(RESULT.names, cols)))


def link_counts(slices: DataFrame) -> DataFrame:
    """a, b, n (texts that hold them linked) and best (whether n is the highest of a) of every link of encoded()."""
    links = slices.filter("kind = 1").select(F.explode(F.arrays_zip("pairs", "held")).alias("l")).select("l.pairs", "l.held")
    n = links.groupBy("pairs").agg(F.sum("held").alias("n"))
    n = n.select("pairs", F.shiftright("pairs", B_BITS).alias("a"), F.col("pairs").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"), "n")
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # at most as many rows as B has ids


def align(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    A (tokenizers, byte-level) encodes a space and the text, B (sentencepiece, which adds a space) the text, without special tokens and with
    their strings as plain text. A link is a pair of token occurrences that share bytes; its count is the number of rows of docs whose
    text holds its two ids linked. n_best has the links whose count is the highest of their A id's, ties included; count_sum adds counts over
    links. groups_sha256 is of the groups as text. A null or empty text, and one of which either side's joined tokens are not the space and the
    text, has no tokens: zeros and ''. Repeated rows count each; a null id is kept; other columns are ignored; an empty table gives no rows.
    """
    slices = durable(encoded(docs, a, b, id_col, text_col), "alignment")
    own = slices.filter("kind = 1").select("slice", F.posexplode(F.arrays_zip("pairs"))).select("slice", F.col("pos").alias("place"), F.col("col.pairs").alias("pairs"))
    links = own.join(link_counts(slices).select("pairs", "n", "best"), "pairs").select(F.col("slice").alias("of"), "place", "n", F.col("best").cast("int").alias("best"))
    rows = slices.select("slice", "kind", *RESULT.names[:5], "groups_sha256", "chunks", "times")
    return rows.groupBy("slice").cogroup(links.groupBy("of")).applyInArrow(_counted, RESULT)
