"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (runs without ASCII white space) with their counts as weights. For each term and each of K samples, a hash of
both gives r and c from Gamma(2, 1) and b from U(0, 1); with weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The term
with the least a is the sample, known by (term, t). Two texts share a sample with the probability of their generalised Jaccard similarity,
sum of min(w) over sum of max(w).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import longs, range_of
from episodica.llm.sharding import boundaries, draw

#: Samples of a fingerprint; bits kept of a sample's identity (four fit a long).
SAMPLES, ID_BITS = 64, 16
#: Bits of the first uniform number, which decides how small a can be; bits of a below 1.
FIRST_BITS, A_BITS = 36, 44
WHITE = r"[\x20\x09-\x0D]+"
#: Ranges of ids for each shuffle partition, and ranges at most; keys drawn for each, which the driver holds; bytes of a row besides its text.
RANGES_PER_PARTITION, MOST_RANGES, KEYS_PER_RANGE, ROW_BYTES = 8, 16_384, 16, 64


def gamma2_quantiles(n: int) -> list[float]:
    """The (i + 1/2) / n quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by Newton's method on its log tail: for tests."""
    out, x = [], 0.05
    for i in range(n):
        target = math.log1p(-(i + 0.5) / n)
        for _ in range(60):
            step = (math.log1p(x) - x - target) * (1 + x) / x
            x, old = max(x + step, x / 10), x
            if abs(x - old) < 1e-14 * x:
                break
        out.append(x)
    return out


def terms(text: Column) -> Column:
    """array<struct<h: hash of the word, lw: ln of its count>>; for a text without words one term that stands for that."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")
    return _counted(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))))


def _none() -> Column:
    return F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("lw")))


def _counted(hashes: Column) -> Column:
    """Runs of equal values in a sorted array, as terms."""
    at = F.get
    ends = lambda hs: F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: ~at(hs, i).eqNullSafe(at(hs, i + 1)))
    log_of = lambda n: F.when(n == 1, F.lit(0.0)).otherwise(F.log(n.cast("double")))
    pair = lambda hs, es: F.transform(es, lambda e, i: F.struct(at(hs, e).alias("h"), log_of(e - F.coalesce(at(es, i - 1), F.lit(-1))).alias("lw")))
    # let-bindings by one-element arrays: the sorted hashes and the ends are each computed once
    bound = F.transform(
        F.array(hashes), lambda hs: F.when(F.size(hs) == 0, _none()).otherwise(F.element_at(F.transform(F.array(ends(hs)), lambda es: pair(hs, es)), 1))
    )
    return F.element_at(bound, 1)


def salt(k: int) -> int:
    """What the hash of a word is mixed with for sample k: an odd multiple, so that no two are alike in the low bits."""
    return (k + 1) * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF


def sample_columns(h: Column, lw: Column, n: int = SAMPLES) -> list[Column]:
    """For each sample a, as a long in units of 2 ** -A_BITS.

    With uniforms u1 to u4, r = -ln(u1 u2) and b = 1 + ln(u1) / r are Gamma(2, 1) and uniform and independent, for a sum of two exponential
    numbers is independent of its parts' shares. Then r (t - b + 1) = r t - ln u1, so a = -ln(u3 u4) u1 exp(-r t): one logarithm if t = 0,
    as it is for all words that occur once. a is below 2^6; a text of W words has its least a near 1 / W. Another term, or another t of a
    term, has another a, so the least a tells which sample it is.
    """
    uniform = lambda x, bits: (x.cast("double") + F.lit(0.5)) * F.lit(2.0**-bits)
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    out = []
    for k in range(n):
        u = F.xxhash64(h.bitwiseXOR(F.lit(salt(k))))
        v = F.xxhash64(u)
        u1, u2 = uniform(F.shiftrightunsigned(u, 64 - FIRST_BITS), FIRST_BITS), uniform(low(u, 64 - FIRST_BITS), 64 - FIRST_BITS)
        u3, u4 = uniform(F.shiftrightunsigned(v, 32), 32), uniform(low(v, 32), 32)
        r = -F.log(u1 * u2)
        t = F.floor(F.lit(1.0) + (lw + F.log(u1)) / r)
        a = -F.log(u3 * u4) * u1 * F.when(lw == 0, F.lit(1.0)).otherwise(F.exp(-r * t))
        out.append((a * F.lit(2.0**A_BITS)).cast("long"))
    return out


def identity(least: Column) -> Column:
    """The bits that are kept of a sample, from its least a."""
    return F.xxhash64(least).bitwiseAND(F.lit((1 << ID_BITS) - 1))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints given as arrays."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return same / F.lit(float(n))


def as_text(ids: Column, n: int = SAMPLES) -> Column:
    """Four samples to each 16 hex digits."""
    def packed(i: int) -> Column:
        x = F.get(ids, F.lit(i))
        for j in range(1, 4):
            x = F.shiftleft(x, ID_BITS).bitwiseOR(F.get(ids, F.lit(i + j)))
        return F.lower(F.lpad(F.hex(x), 16, "0"))

    return F.concat(*(packed(i) for i in range(0, n, 4)))


def fingerprint_rows(rows: DataFrame, keys: list[str], terms_col: str, n: int = SAMPLES) -> DataFrame:
    """keys and fp, the array of samples, for rows of keys and an array of terms. Grouping by keys needs no shuffle if rows are dealt by some of them."""
    flat = rows.select(*keys, F.explode(terms_col).alias("__t")).select(*keys, F.col("__t.h").alias("__h"), F.col("__t.lw").alias("__lw"))
    mins = flat.groupBy(*keys).agg(*(F.min(c).alias(f"__m{k}") for k, c in enumerate(sample_columns(F.col("__h"), F.col("__lw"), n))))
    return mins.select(*keys, F.array(*(identity(F.col(f"__m{k}")) for k in range(n))).alias("fp"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every text: one row for each row of docs, the number of a repeated id's rows kept.

    A null, empty or blank text has the fingerprint of no words. Equal texts have equal fingerprints. Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("__terms"))
    return fingerprint_rows(rows, ["__row", id_col], "__terms").select(id_col, as_text(F.col("fp")).alias("fingerprint"), F.col("fp").alias("samples"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its next document's and its edited text compared by fingerprint.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or all) of the next document, in
    ascending order of id; the last is followed by the first. Null texts count as empty, null ids sort first, rows of one id are ordered by
    a hash of their text, and the only row of a table follows itself. Rows are kept as they are, repeated ones too. Texts are moved once,
    dealt by ranges of (id, hash of the text) that hold about equally many bytes, by size-weighted samples; each range also gets the first
    row of the next range. Only rows that repeat both id and text cannot be parted.
    """
    spark = docs.sparkSession
    id_ = F.col(id_col).cast("long")
    base = docs.select(id_.alias("id"), F.coalesce(id_, F.lit(-(1 << 63)).cast("long")).alias("o"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    n_ranges = min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = base.select(F.col("o").alias("a"), F.col("tie").alias("b"), F.lit(0).cast("long").alias("c"), (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    splitters = sorted({(a, b) for a, b, _ in boundaries(draw(sized, n_ranges * KEYS_PER_RANGE / total, 0), n_ranges)}) if total else []
    cut_o, cut_tie = longs([o for o, _ in splitters]), longs([t for _, t in splitters])

    def at_most(i: Column) -> Column:
        o, tie = F.get(cut_o, i.cast("int")), F.get(cut_tie, i.cast("int"))
        return (o < F.col("o")) | ((o == F.col("o")) & (tie <= F.col("tie")))

    ranged = base.withColumn("range", range_of(len(splitters), at_most))
    found = ranged.groupBy("range").agg(F.min(F.struct("o", "tie")).alias("head")).collect()
    heads = sorted((r["range"], r["head"]["o"], r["head"]["tie"]) for r in found)
    size = len(splitters) + 1
    head_o, head_tie, before = [0] * size, [0] * size, [0] * size  # of ranges without rows: never looked at
    for i, (k, o, tie) in enumerate(heads):
        head_o[k], head_tie[k], before[k] = o, tie, heads[i - 1][0]
    lit = lambda xs: F.element_at(longs(xs), F.col("range") + 1)
    real, ghost = F.struct(F.col("range").cast("long").alias("part"), F.lit(0).alias("ghost")), F.struct(lit(before).alias("part"), F.lit(1).alias("ghost"))
    is_head = (F.col("o") == lit(head_o)) & (F.col("tie") == lit(head_tie))
    spread = ranged.withColumn("__to", F.explode(F.when(is_head, F.array(real, ghost)).otherwise(F.array(real))))
    spread = spread.select("id", "o", "text", F.col("__to.part").alias("part"), F.col("__to.ghost").alias("ghost"), "tie")
    w = Window.partitionBy("part").orderBy("ghost", "o", "tie")
    rows = spread.select("part", "id", "ghost", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next, 1, cast(floor(length(text) / 2) as int))")))
    keys = ["part", "rn", "ghost", "id", "n_chars", "edited_sha256"]
    rows = rows.select("part", "rn", "ghost", "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("edited", F.lit("")), 256).alias("edited_sha256"), "text", "edited")
    both = rows.withColumn("__v", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("s")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("s")))))
    both = both.filter("ghost = 0 or __v.which = 0").select(*keys, F.col("__v.which").alias("which"), terms(F.coalesce(F.col("__v.s"), F.lit(""))).alias("__terms"))
    fps = fingerprint_rows(both, [*keys, "which"], "__terms")
    wide = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    out = wide.withColumn("nfp", F.lead("fp").over(Window.partitionBy("part").orderBy("rn"))).filter("ghost = 0")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
