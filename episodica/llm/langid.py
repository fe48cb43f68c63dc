"""Language ID by a byte convolutional network, trained in numpy.

A text is cut into windows of WINDOW bytes. Bytes are mapped to classes; filters of several widths slide over the windows, their greatest
responses pass a rectifier, and a softmax layer scores the languages. A text's scores are the mean of its windows' log-probabilities,
bounded below and weighted by their letters, made probabilities again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.llm.common import ship_package, tidy
from episodica.llm.tokens import slices

UNKNOWN = "und"
#: Bytes of a window; widths of the filters and their number for each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 24
#: Bounds of the training sample: rows for each language (by hash of the text), rows in all (one for each language at least), characters of a
#: row's excerpt, windows in all.
ROWS_PER_LANGUAGE, MOST_ROWS, EXCERPT, MOST_WINDOWS = 1000, 64_000, 512, 24_000
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
#: No window counts against a language by more than this log-probability, so a passage in another language weighs by its length.
LEAST_LOG = -4.0
#: Windows and bytes of text taken at once by a worker.
ROWS_AT_ONCE, SLICE = 64, 1_000_000
#: Letters that a window has at least to be learned from.
LEAST_LETTERS = 16
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Classes of bytes: 0 padding, 1 white space, 2 digits, 3 other ASCII, 4-29 letters of either case, 30-61 continuation bytes by their low five
#: bits (which joins the cases of Latin-1), 62-68 lead bytes by block.
CLASSES, LEADS = 69, (0xC2, 0xC3, 0xC4, 0xC6, 0xD0, 0xE0, 0xF0)


def _classes() -> np.ndarray:
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = 2
    out[65:91] = out[97:123] = np.arange(4, 30)
    out[128:192] = 30 + np.arange(64) % 32
    for i, lead in enumerate(LEADS):
        out[lead:] = 62 + i
    out[192:194] = 62
    return out


BYTE_CLASS = _classes()


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of byte classes, the last of each padded; and each row's text number. An empty text has none."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    rows = -(-n // size)
    starts = np.cumsum(n) - n
    first = np.cumsum(rows) - rows
    out = np.zeros(int(rows.sum()) * size, np.uint8)
    # every byte moves right by its text's padding so far
    shift = first * size - starts
    classes = BYTE_CLASS[flat]
    for i in range(len(texts)):
        out[starts[i] + shift[i] : starts[i] + shift[i] + n[i]] = classes[starts[i] : starts[i] + n[i]]
    return out.reshape(-1, size), np.repeat(np.arange(len(texts)), rows)


@dataclass
class ByteNet:
    """labels; filters[w]: (w, CLASSES, FILTERS) responses of each byte class at each offset; bias; dense layer."""

    labels: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def random(cls, labels: list[str], rng: np.random.Generator) -> ByteNet:
        n = len(WIDTHS) * FILTERS
        return cls(labels, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, n**-0.5, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.dense, self.dense_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest response of each filter over a window and where it is."""
        tops, places = [], []
        for f in self.filters:
            w, n = f.shape[0], x.shape[1] - f.shape[0] + 1
            r = f[0][x[:, :n]]
            for j in range(1, w):
                r = r + f[j][x[:, j : j + n]]
            at = r.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        return np.concatenate(tops, axis=1) + self.bias, places

    def fast_pooled(self, pairs: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """As pooled, by tables of the responses of pairs of byte classes."""
        p = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        tops, k = [], 0
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            r = pairs[k][p[:, :n]]
            for j in range(2, w, 2):
                k += 1
                r += pairs[k][p[:, j : j + n]] if j + 1 < w else pairs[k][x[:, j : j + n]]
            k += 1
            while n > 1:  # the greatest, by halves that may overlap
                half = (n + 1) // 2
                r, n = np.maximum(r[:, :half], r[:, n - half : n]), half
            tops.append(r[:, 0])
        return np.concatenate(tops, axis=1) + self.bias

    def pair_tables(self) -> list[np.ndarray]:
        out = []
        for f in self.filters:
            for j in range(0, f.shape[0], 2):
                out.append((f[j][:, None] + f[j + 1][None]).reshape(-1, FILTERS) if j + 1 < f.shape[0] else f[j])
        return out

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.dense_bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = SEED) -> ByteNet:
    """A network for windows x of classes y, by Adam on the cross entropy with each language weighted alike."""
    rng = np.random.default_rng(seed)
    net = ByteNet.random(labels, rng)
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(labels)), 1) / len(labels)).astype(np.float32)
    m, v, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            xb, yb = x[rows], y[rows]
            pooled, places = net.pooled(xb)
            hidden = np.maximum(pooled, 0)
            p = np.exp(net.log_probabilities(pooled))
            p[np.arange(len(yb)), yb] -= 1
            g = p * weight[yb][:, None] / len(yb)
            back = (g @ net.dense.T) * (pooled > 0)
            grads = []
            for i, (f, place) in enumerate(zip(net.filters, places, strict=True)):
                d, own = np.zeros_like(f), back[:, i * FILTERS : (i + 1) * FILTERS]
                cols = np.broadcast_to(np.arange(FILTERS), place.shape)
                for j in range(f.shape[0]):
                    np.add.at(d[j], (np.take_along_axis(xb, place + j, 1), cols), own)
                grads.append(d)
            grads += [back.sum(axis=0), hidden.T @ g, g.sum(axis=0)]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for part, grad, a, b in zip(net.parts(), grads, m, v, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                part -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, str]]:
    """Excerpts of EXCERPT characters, from a place set by hash, of about ROWS_PER_LANGUAGE rows a language that are not held out.

    Every label is learned; of more than MOST_ROWS / ROWS_PER_LANGUAGE labels each has a smaller share of MOST_ROWS. A row comes by the hash of
    its text, at a rate set by the number of different texts of its label, so the sample is bounded whatever the table's size, copies of a
    text count once, and a label of which most rows are copies is drawn like any other.
    """
    rows = docs.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(text_col, F.lit(SEED))
    rows = rows.select(F.col(label_col).cast("string").alias("label"), h.alias("h"), F.col(text_col).cast("string").alias("text"))
    texts = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    if not texts:
        return []
    each = max(1, min(ROWS_PER_LANGUAGE, MOST_ROWS // len(texts)))
    shares = docs.sparkSession.createDataFrame([(r["label"], min(1.0, 1.1 * each / max(1, r["n"]))) for r in texts], "label string, share double")
    part = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = (F.pmod(F.shiftright("h", 24), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1)).cast("int") + 1
    small = F.broadcast(shares) if len(texts) <= 50_000 else shares  # a row for each language
    drawn = rows.join(small, "label").filter(part < F.col("share"))
    some = drawn.groupBy("label", "h").agg(F.min(F.substring(F.col("text"), place, F.lit(EXCERPT))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))  # about `each` rows of a label
    got = some.withColumn("r", rank).filter(F.col("r") <= each).collect()
    return sorted((r["label"], r["s"]) for r in got)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteNet | None:
    """A network trained on a bounded sample of the labelled rows that are not held out; none if there is no such row."""
    sample = training_sample(docs, id_col, text_col, label_col)
    labels = sorted({label for label, _ in sample})
    if not labels:
        return None
    x, row = windows_of([s.encode() for _, s in sample])
    y = np.array([labels.index(label) for label, _ in sample])[row]
    letters = (x >= 4).sum(axis=1)
    good = letters >= LEAST_LETTERS
    some = np.bincount(y[good], minlength=len(labels)) > 0
    good |= ~some[y] & (letters > 0)  # a language of short texts alone is learned from these
    x, y = x[good], y[good]
    order = np.random.default_rng(SEED).permutation(len(y))
    nth = np.empty(len(y), np.int64)  # within the language, in random order
    for k in range(len(labels)):
        own = order[y[order] == k]
        nth[own] = np.arange(len(own))
    pick = order[np.argsort(nth[order], kind="stable")][:MOST_WINDOWS]  # languages by turns, so that none is crowded out
    return train(x[pick], y[pick], labels) if len(pick) else None


def has_letter(text: bytes) -> bool:
    """Whether any code point is in one of Unicode's letter categories."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(net: ByteNet, pairs: list[np.ndarray], texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    x, row = windows_of(texts)
    total, weight = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts))
    for at in range(0, len(x), ROWS_AT_ONCE):
        part, of = x[at : at + ROWS_AT_ONCE], row[at : at + ROWS_AT_ONCE]
        letters = (part >= 4).sum(axis=1)
        np.add.at(total, of, np.maximum(net.log_probabilities(net.fast_pooled(pairs, part)), LEAST_LOG) * letters[:, None])
        np.add.at(weight, of, letters)
    z = total / np.maximum(weight, 1)[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    known = np.array([has_letter(t) for t in texts], bool)
    return [net.labels[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def identify(docs: DataFrame, net: ByteNet | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of every row, by the whole text; only the text is looked at.

    lang_pred is `und` with score 0 for a null text, one without letters, or if nothing could be learned. Rows are kept as they are, repeated
    and null ids too; other columns are ignored. A worker holds about a megabyte of text at once, and one text however long.
    """
    net = net or fit(docs, id_col, text_col, label_col)
    marked = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    if net is None:
        return marked.select(id_col, "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pair_tables()
        for batch in batches:
            for first, texts in slices(batch.column(2), SLICE):
                pred, score = predict(net, pairs, texts)
                cols = [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(pred, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()

    return marked.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float = 0.3, net: ByteNet | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of at least `least`; `und` goes.

    Where nothing can be learned, for no row has a label, nothing is known against any document, and all stay.
    """
    net = net or fit(docs, id_col, text_col, label_col)
    if net is None:
        return docs
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pair_tables()
        for batch in batches:
            for first, texts in slices(batch.column(at), SLICE):
                pred, score = predict(net, pairs, texts)
                yield batch.slice(first, len(texts)).filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))
            tidy()

    return docs.mapInArrow(run, docs.schema)
