import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from episodica.llm import alignment as A
from episodica.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path(A.A_VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(A.B_VOCABULARY))


def plain(coders, text):
    """Groups, cut where both sides end, and links, of the whole text encoded at once: lists of ids, and pairs of ids."""
    if not text:
        return [], []
    a, sp = coders
    table = {c: b for c, b in A._letters().items()}
    whole = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = sp.encode(text)
    parts_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return [], []
    spans_a, spans_b, at = [], [], 0
    for parts, spans in ((parts_a, spans_a), (parts_b, spans_b)):
        at = 0
        for p in parts:
            spans.append((at, at + len(p)))
            at += len(p)
    groups, i, j = [], 0, 0
    while i < len(spans_a):
        x, y = [ids_a[i]], [ids_b[j]]
        while spans_a[i][1] != spans_b[j][1]:
            if spans_a[i][1] < spans_b[j][1]:
                i += 1
                x.append(ids_a[i])
            else:
                j += 1
                y.append(ids_b[j])
        groups.append((x, y))
        i, j = i + 1, j + 1
    links, lo = [], 0
    for k, (s, e) in enumerate(spans_a):
        while spans_b[lo][1] <= s:
            lo += 1
        m = lo
        while m < len(spans_b) and spans_b[m][0] < e:
            links.append((ids_a[k], ids_b[m]))
            m += 1
    return groups, links


def brute(coders, table):
    found = [(i, *plain(coders, t)) for i, t in table]
    counts = Counter(p for _, _, links in found for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(*A.RESULT.names).collect()), key=repr)


def test_table_like_brute_force(docs, coders):
    assert result(A.align(docs)) == brute(coders, [(r.doc_id, r.text) for r in docs.collect()])


ODD = [
    "a", " ", "  ", " a", "a ", "a  ", "  a  b  ", "\n", "a\nb", "a \nb", "a\n b", "a\n  b", "a\t b　c d", "don't we'll I'M x's", "a▁b", "▁", "x ▁ y", "\x00", "a\x00 b", "\r\n \r\n",
    "<s> hi </s><unk> <|endoftext|> x<|endoftext|>y <0x41>", "中文字 日本語", "é ́ x", "\U0001f642\U0001f469‍\U0001f680 ok", "ﬁn Ω Ａ", "1234567 12,345.67 $9.99", "x" * 3000,
    "a b  c", "tab\there  and   more    spaces", "\x1c a\x1d b \x85 c", "İstanbul ẞ", "if (x) {\r\n  return;\r\n}", "� ﻿x", " ​ ", "trailing\n ", "trailing \n",
]


def test_odd_texts_like_whole_texts(spark, coders):
    rnd, table = random.Random(3), list(enumerate(ODD))
    alphabet = [*"abc XY  \n\t.,'12", " ", "the", " of", "é", "中", "́", "\U0001f642", " ", " ", "</s>", "'s", "\r"]
    table += [(100 + k, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40)))) for k in range(500)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert result(A.align(df)) == brute(coders, table)


def test_odd_rows(odd_docs, no_docs, coders):
    assert result(A.align(odd_docs)) == brute(coders, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert A.align(no_docs).count() == 0


def test_forgotten_chunks_change_nothing(spark, docs, coders, monkeypatch):
    monkeypatch.setattr(A, "MOST_BYTES", 1)
    monkeypatch.setattr(A, "text_slices", lambda c: ((k, c.slice(k, 3).fill_null("")) for k in range(0, len(c), 3)))
    aligner, got = A.Aligner(), []
    import pyarrow as pa

    table = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    for k in range(0, 60, 3):
        part = table[k : k + 3]
        rows = A._slice_rows(aligner, k, pa.array([i for i, _ in part]), pa.array([t or "" for _, t in part])).to_pylist()
        got += [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows[:-1]]
        assert not aligner.number and sum(rows[-1]["chunks"]) == len(rows[-1]["times"])
    assert sorted(got, key=repr) == sorted(((*r[:5], r[7]) for r in brute(coders, table)), key=repr)


def test_components_like_plain_union_find():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = int(rng.integers(1, 60)), int(rng.integers(0, 60))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v):
                label[a] = label[b] = min(label[a], label[b])
        assert A.components(n, u, v).tolist() == label
    chain = np.arange(20_000)
    assert not A.components(20_001, chain, chain + 1).any()
