import zlib

import numpy as np
from pyspark.sql import functions as F

from episodica.llm import langid as G


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet")
    got = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_others_do_not_matter(docs):
    net = G.fit(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(docs, net).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(docs.withColumn("lang", F.lit(None).cast("string")), net).collect()}
    assert a == b


def test_fast_and_plain_responses_agree():
    net = G.ByteNet.random(["a", "b"], np.random.default_rng(1))
    x, _ = G.windows_of(["héllo wörld, this is 1 text".encode() * 30, b"", b"x"])
    assert np.allclose(net.pooled(x)[0], net.fast_pooled(net.pair_tables(), x), atol=1e-5)
    assert x.shape == (8, G.WINDOW)


def test_gradient_steps_lower_the_loss():
    texts = [b"aaa bbb aab " * 12, b"zzz yyy zyz " * 12] * 40
    x, row = G.windows_of(texts)
    y = row % 2
    net = G.train(x, y, ["a", "z"])
    assert (net.log_probabilities(net.pooled(x)[0]).argmax(axis=1) == y).all()


def test_odd_rows(odd_docs, no_docs):
    got = [(r.doc_id, r.lang_pred, r.score) for r in G.identify(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    assert all(p == "und" and s == 0 for i, p, s in got if i in (3, 4, 5, 10)) and all(p != "und" for i, p, _ in got if i in (1, 8, 9, 11))
    assert G.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in G.identify(unlabelled).collect()} == {"und"}
    kept = G.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert {3, 4, 5, 10}.isdisjoint({r.doc_id for r in kept.collect()})


def test_every_label_is_learned(spark):
    """70 labels, each with words of its own; one of them has 40 texts among thousands of copies."""
    word = lambda k, i: "".join(chr(0x4E00 + 40 * k + (i * 7 + j) % 40) for j in range(3))
    text = lambda k, n: " ".join(word(k, n * 13 + i * i) for i in range(60))
    rows = [(k * 1000 + n, text(k, n), f"l{k:02d}") for k in range(70) for n in range(12)]
    rows += [(100_000 + n, "the same old text of copies, over and over again " * 3, "copies") for n in range(4000)]
    rows += [(200_000 + n, f"copies but different {n} {n * 37} words and more of them", "copies") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = G.training_sample(docs, "doc_id", "text", "lang")
    count = {}
    for label, s in sample:
        count[label] = count.get(label, 0) + 1
    assert len(count) == 71 and count["copies"] > 25 and min(count.values()) >= 5
    assert len({s for label, s in sample if label == "copies"}) == count["copies"]  # copies count once
    net = G.fit(docs)
    assert len(net.labels) == 71
    got = [(r.lang_pred, r.lang) for r in G.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id < 100000").collect()]
    assert sum(a == b for a, b in got) / len(got) > 0.9


def test_a_label_of_short_texts_alone(spark):
    docs = spark.createDataFrame([(i, f"long enough text number {i} to be learned from", "long") for i in range(50)] + [(100 + i, "zq", "short") for i in range(20)], "doc_id long, text string, lang string")
    assert G.fit(docs).labels == ["long", "short"]


def test_nothing_to_learn_rejects_nothing(odd_docs):
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert G.keep_identified(unlabelled).count() == odd_docs.count()


def plain_scores(net, text):
    """One window after the other, one filter after the other, by the definitions."""
    raw, total, letters_of_all = text.encode(), np.zeros(len(net.labels)), 0
    for at in range(0, len(raw), G.WINDOW):
        window = [int(G.BYTE_CLASS[b]) for b in raw[at : at + G.WINDOW]]
        letters = sum(c >= 4 for c in window)
        window += [0] * (G.WINDOW - len(window))
        pooled = []
        for f in net.filters:
            width = f.shape[0]
            pooled += [max(sum(float(f[j, window[i + j], k]) for j in range(width)) for i in range(G.WINDOW - width + 1)) for k in range(f.shape[2])]
        hidden = [max(0.0, p + float(b)) for p, b in zip(pooled, net.bias, strict=True)]
        z = np.array([sum(h * float(net.dense[i, c]) for i, h in enumerate(hidden)) + float(net.dense_bias[c]) for c in range(len(net.labels))])
        logs = z - z.max() - np.log(np.exp(z - z.max()).sum())
        total += np.maximum(logs, G.LEAST_LOG) * letters
        letters_of_all += letters
    p = np.exp(total / max(1, letters_of_all))
    return p / p.sum()


def test_predictions_are_those_of_the_plain_network(docs):
    net = G.fit(docs)
    texts = {r.doc_id: r.text for r in docs.limit(12).collect()}
    for r in G.identify(docs.filter(F.col("doc_id").isin(list(texts))), net).collect():
        p = plain_scores(net, texts[r.doc_id][:2000]) if len(texts[r.doc_id]) <= 2000 else None
        if p is not None and r.lang_pred != "und":
            assert r.lang_pred == net.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-3
    text = "The quick brown fox. Ünïcödé " * 9
    pred, score = G.predict(net, net.pair_tables(), [text.encode()])
    p = plain_scores(net, text)
    assert pred == [net.labels[int(p.argmax())]] and abs(score[0] - p.max()) < 1e-3


def test_und_is_for_texts_without_letters(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["12 34 !!", "\U0001F642 \u2603", "7 ß 9", "中", "\u0300", "١٢", "ˀ", "a" * 3])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in G.identify(docs).collect()}
    assert [got[i] == "und" for i in range(8)] == [True, True, False, False, True, True, False, False]
