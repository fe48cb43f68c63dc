import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash

from episodica.llm import fingerprints as P


def edited(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return out


def test_edits_and_likeness(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(P.compare_with_edits(docs).collect())
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == edited(rows)
    by_text = {}
    for r, (_, t) in zip(got, rows):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint

    def jaccard(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    true = np.array([jaccard(t, rows[(k + 1) % len(rows)][1]) for k, (_, t) in enumerate(rows)])
    err = np.array([r.near_next for r in got]) - true
    assert abs(err.mean()) < 0.02 and np.abs(err).max() < 0.35
    halves = []
    for k, (_, t) in enumerate(rows):
        h = len(t) // 2
        halves.append(jaccard(t, t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]))
    err = np.array([r.near_edited for r in got]) - np.array(halves)
    assert abs(err.mean()) < 0.02 and err.std() < 0.09


def test_gamma_quantiles():
    q = np.array(P.gamma2_quantiles(512))
    assert np.allclose(1 - (1 + q) * np.exp(-q), (np.arange(512) + 0.5) / 512, atol=1e-9) and abs(q.mean() - 2) < 0.01


def test_terms_count_words(spark):
    df = spark.createDataFrame([("b a  b\tb",), ("",), (None,), (" \n",)], "s string")
    got = [sorted(round(np.exp(t.lw)) for t in r.t) for r in df.select(P.terms(df.s).alias("t")).collect()]
    assert got == [[1, 3], [1], [1], [1]]


def test_odd_rows(odd_docs, no_docs, spark):
    got = P.compare_with_edits(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    blank = {r.fingerprint for r in got if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1
    assert P.compare_with_edits(no_docs).count() == 0
    one = P.compare_with_edits(spark.createDataFrame([(5, "abcd ef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest()
    assert P.fingerprint_documents(odd_docs).count() == odd_docs.count()


def test_long_texts_of_skewed_counts(spark):
    """Half of 30,000 words are 50 frequent ones, the rest occur once: pairs that share only these, or only those."""
    n, pairs = 15_000, 12
    common = lambda s: [f"c{s}_{i % 50}" for i in range(n)]
    rare = lambda s: [f"r{s}_{i}" for i in range(n)]
    rows = []
    for p in range(pairs):
        for kind, (a, b) in {"common": ((p, p), (p, -p - 1)), "rare": ((p, p), (-p - 1, p))}.items():
            for side, (c, r) in enumerate((a, b)):
                rows.append((f"{kind} {p} {side}", " ".join(common(f"{kind}{c}") + rare(f"{kind}{r}"))))
    got = {r.doc_id: np.array(r.samples) for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for kind in ("common", "rare"):
        same = [np.mean(got[f"{kind} {p} 0"] == got[f"{kind} {p} 1"]) for p in range(pairs)]
        assert abs(np.mean(same) - 1 / 3) < 0.07, (kind, same)  # 768 samples: a deviation of 0.017


def test_draws_are_gamma(spark):
    """A single word's a is exponential with its count as rate, as far out as 20,000 draws reach."""
    for w in (1, 7, 1000):
        rows = spark.range(20_000).selectExpr("xxhash64(id) as h", f"ln({w}D) as lw")
        a = np.sort([r[0] * 2.0**-P.A_BITS for r in rows.select(P.sample_columns(rows.h, rows.lw, 1)[0]).collect()]) * w
        assert abs(a.mean() - 1) < 0.03 and np.abs(1 - np.exp(-a) - (np.arange(len(a)) + 0.5) / len(a)).max() < 0.012
        assert a[0] < 1e-3 and a[-1] > 8


def plain_samples(text):
    """Consistent weighted sampling word by word, as the method is told, in the order r, c, b, t, a."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hash_of = lambda x: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=42)
    words = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w)
    terms = {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)): n for w, n in words.items()} or {0: 1}
    out = []
    for k in range(P.SAMPLES):
        least = None
        for h, n in terms.items():
            u = hash_of((h & (1 << 64) - 1) ^ P.salt(k))
            v = hash_of(u)
            u1, u2 = ((u >> 28) + 0.5) * 2.0**-36, ((u & (1 << 28) - 1) + 0.5) * 2.0**-28
            u3, u4 = ((v >> 32) + 0.5) * 2.0**-32, ((v & (1 << 32) - 1) + 0.5) * 2.0**-32
            r, c, b = -math.log(u1 * u2), -math.log(u3 * u4), 1 + math.log(u1) / -math.log(u1 * u2)
            t = math.floor(math.log(n) / r + b)
            a = c * math.exp(-r * (t - b + 1))
            least = a if least is None else min(a, least)
        out.append(least)
    return out


def test_fingerprints_are_those_of_a_plain_sampler(spark, docs):
    """The least a of every sample, and of two texts the samples they share, for whole texts."""
    rows = docs.limit(40).collect() + [{"text": t} for t in ("", None, "one", "b a  b\tb", "x " * 300 + "y")]
    texts = [r["text"] for r in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    flat = df.select("doc_id", P.F.explode(P.terms(P.F.coalesce("text", P.F.lit("")))).alias("t"))
    least = flat.groupBy("doc_id").agg(*(P.F.min(c).alias(f"m{k}") for k, c in enumerate(P.sample_columns(P.F.col("t.h"), P.F.col("t.lw")))))
    got = {r.doc_id: np.array(r[1:]) * 2.0**-P.A_BITS for r in least.collect()}
    want = {i: np.array(plain_samples(t)) for i, t in enumerate(texts)}
    for i in want:
        assert np.allclose(got[i], want[i], rtol=1e-9, atol=2.0 ** (1 - P.A_BITS)), i
    ids = {r.doc_id: np.array(r.samples) for r in P.fingerprint_documents(df).collect()}
    for i in range(0, len(texts) - 1):
        same = np.isclose(want[i], want[i + 1], rtol=1e-9, atol=0)
        assert ((ids[i] == ids[i + 1]) >= same).all() and ((ids[i] == ids[i + 1]) & ~same).sum() <= 1  # kept bits may agree by chance


def test_rows_of_one_id_are_dealt_apart(spark):
    """A third of the rows share an id, and long texts stand together: every row is still followed by the next one."""
    rows = [(7 if i % 3 == 0 else 1000 + i, f"t{i} " * (400 if 1100 < 1000 + i < 1150 else 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0], (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(r[1].encode(), seed=42)))
    got = P.compare_with_edits(df).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited(sorted(rows, key=key)))
