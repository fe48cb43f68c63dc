import random
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from episodica.llm import packing, tokens

POOL = "abcdeABZ 'sstrevemlld.,!?<|endoftext|>0123 \n\té́éÉ̈ñĳıİΣσςß“”  中文字가각ᄀ́🙂J̌\x1c\x85\x0b"


@pytest.fixture(scope="module")
def coder():
    return tokens.coder(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def strange():
    rnd = random.Random(1)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["I'll we've they're 'S 'RE it's!'s <|endoftext|>x<|startoftext|>", "", "J̌ ǰ"]


def test_ids_are_the_librarys(coder, strange, docs):
    texts = strange + [r.text for r in docs.limit(50).collect()]
    x = coder.code(pa.array(texts))
    ids, to = x.all_ids(), np.concatenate([[0], np.cumsum(x.lens[x.index])])
    ends = np.cumsum(x.n)
    assert [ids[to[e - k] : to[e]].tolist() for e, k in zip(ends, x.n)] == coder.encode(texts)


def test_counts_of_every_prefix(coder, strange):
    for text in strange[:250]:
        for w in text.split():
            assert coder.prefixes.of_chunk(w) == [len(i) for i in coder.encode([w[: k + 1] for k in range(len(w))])], w


def test_counts_and_fits(coder, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for limit in (7, 2048):
        for r in tokens.count_tokens(docs, limit).collect():
            raw = text[r.doc_id].encode()
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(raw), len(coder.encode([text[r.doc_id]])[0]), r.n_tokens > limit)
            if r.over_limit:
                assert len(coder.encode([raw[: r.fit_bytes].decode()])[0]) <= limit
                longer = raw[: r.fit_bytes].decode() + raw[r.fit_bytes :].decode("utf-8", "ignore")[:1]
                assert len(coder.encode([longer])[0]) > limit
            else:
                assert r.fit_bytes == len(raw)


def test_special_strings_in_mixed_case(spark, coder):
    marks = ["<|EndOfText|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext|>", "<|startoftext|>"]
    texts = [f"{a}{m}{b}" for m in marks for a, b in (("", ""), ("Some WORDS ", " More, Words"), ("aB", "Cd."))] + ["No Mark", "a <| B |> C", " ".join(marks)]
    x = coder.code(pa.array(texts))
    ids, to, ends = x.all_ids(), np.concatenate([[0], np.cumsum(x.lens[x.index])]), np.cumsum(x.n)
    assert [ids[to[e - k] : to[e]].tolist() for e, k in zip(ends, x.n)] == coder.encode(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.count_tokens(df, 3).collect():
        n = len(coder.encode([texts[r.doc_id]])[0])
        assert (r.n_tokens, r.over_limit) == (n, n > 3)


def library_counts(coder, text):
    return [len(x) for x in coder.encode([text[:k] for k in range(len(text) + 1)])]


def test_prefix_tables(coder, docs):
    for r in tokens.prefix_counts(docs.limit(5)).join(docs, "doc_id").collect():
        assert len(r.counts) == len(r.text) + 1 and r.counts[-1] == len(coder.encode([r.text])[0])
        assert r.counts[:400] == library_counts(coder, r.text[:399])
        for k in range(0, len(r.counts), 997):
            assert len(coder.encode([r.text[:k]])[0]) == r.counts[k]


#: First and last code points of scripts whose letters, marks, cases and compositions differ.
SCRIPTS = [
    (0x20, 0x7F), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x45F), (0x5D0, 0x5EA), (0x600, 0x6FF), (0x900, 0x9FF), (0xB80, 0xBFF), (0xC80, 0xCFF), (0xE00, 0xE5B),
    (0x1000, 0x109F), (0x1100, 0x11FF), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x2100, 0x21FF), (0x3040, 0x30FF), (0x4E00, 0x4EFF), (0xAC00, 0xACFF), (0xFB00, 0xFB4F), (0xFF00, 0xFF5F),
    (0x1D400, 0x1D4FF), (0x1F600, 0x1F64F), (0x0, 0x1F),
]


def test_counts_at_every_code_point_in_many_scripts(coder):
    rnd = random.Random(8)
    for n in range(1200):
        some = [rnd.choice(SCRIPTS) for _ in range(rnd.randint(1, 3))]
        text = "".join(chr(rnd.randint(*rnd.choice(some))) for _ in range(rnd.randint(1, 24)))
        if n % 3 == 0:
            text = unicodedata.normalize("NFD", text)
        if n % 5 == 0:
            text = text[:5] + rnd.choice(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|endof<|endoftext|>", "'Ll've"]) + text[5:]
        assert tokens.text_counts(coder.prefixes, text).tolist() == library_counts(coder, text), ascii(text)


def test_last_counts_are_those_of_the_chunks(coder, strange, docs):
    for texts in (strange, [r.text for r in docs.limit(50).collect()]):
        index, n, distinct = tokens.chunked(pa.array(texts))
        assert tokens.PrefixCounter(coder.path).totals(distinct.to_pylist()).tolist() == [len(x) for x in coder.encode(distinct.to_pylist())]


@pytest.mark.parametrize(("name", "unit"), [("thai", "ที่นี่ภาษาไทยเป็นภาษาที่สวยงาม"), ("devanagari", "किताबेंहिन्दीमेंहैं"), ("han", "他们说汉语很难学但是很有意思"), ("hangul", "각나다라마바사아자차카타파하"), ("latin", "abcdefghij"), ("marks", "!?#$%&*")])
def test_long_texts_without_spaces(spark, coder, name, unit):
    """100,000 code points in one chunk, composed and decomposed: work grows with the length, and not with its square."""
    for form in ("NFC", "NFD"):
        text = unicodedata.normalize(form, unit * (100_000 // len(unit) + 1))[:100_000]
        begun = time.monotonic()
        counts = tokens.text_counts(coder.prefixes, text)
        assert time.monotonic() - begun < 40
        for k in (1, 2, 3, 777, 4_321, 100_000):
            assert counts[k] == len(coder.encode([text[:k]])[0])
        r = tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), 500).first()
        assert r.n_tokens == counts[-1] and r.over_limit
        kept = text.encode()[: r.fit_bytes].decode()
        assert len(coder.encode([kept])[0]) <= 500 and (counts[len(kept) + 1 :] > 500).all()


def test_odd_counts(odd_docs, no_docs, coder):
    got = tokens.count_tokens(odd_docs).collect()
    want = sorted((len((r.text or "").encode()), len(coder.encode([r.text or ""])[0])) for r in odd_docs.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert tokens.count_tokens(no_docs).count() == 0 and tokens.prefix_counts(odd_docs).count() == odd_docs.count()


def check(rows, texts, coder, capacity):
    """texts by id; pieces cover their documents, sequences are gapless and small enough."""
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for v in bins.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity
    for i, t in texts.items():
        ids = [*coder.encode([t or ""])[0], 0]
        for r in pieces[i]:
            assert r.start == r.piece * capacity and r.length == len(ids[r.start : r.start + capacity])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + capacity], "<u4").tobytes())
        assert sum(r.length for r in pieces[i]) % len(ids) == 0
    return len(bins)


def test_packs_tightly(docs, coder):
    rows = packing.pack(docs).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, coder, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_packs(odd_docs, no_docs, coder):
    rows = packing.pack(odd_docs, capacity=100).collect()
    check(rows, {r.doc_id: r.text for r in odd_docs.collect()}, coder, 100)
    assert sum(r.doc_id == 2 for r in rows) == 2
    assert packing.pack(no_docs).count() == 0


def best_fit(lengths, capacity):
    """Plain best-fit decreasing, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def test_the_plan_is_best_fit_decreasing():
    rnd = random.Random(6)
    for _ in range(60):
        capacity = rnd.choice([10, 37, 100])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 300))]
        hist = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_slots(hist, capacity)
        n = np.array([k for k in hist for _ in range(hist[k])])
        rank = np.concatenate([np.arange(hist[k]) for k in hist])
        bins, offsets = packing.take_slots(plan, n, rank)
        used = {}
        for b, o, k in sorted(zip(bins.tolist(), offsets.tolist(), n.tolist())):
            assert used.get(b, 0) == o
            used[b] = o + k
        assert sorted(capacity - u for u in used.values()) == best_fit(lengths, capacity)


def test_plan_of_many_is_small():
    plan = packing.plan_slots({k: 10**9 + k for k in range(1, 2049)})
    assert len(plan) < 100_000
    with pytest.raises(ValueError):
        packing.plan_slots({3000: 1})


def test_long_runs_of_marks_take_time_in_proportion(coder):
    """Marks that pile up on a letter, letters that may join the one before, classes by turns: counts as the library's, at the end and at prefixes."""
    c, rnd = coder.prefixes, random.Random(8)
    units = ["\u0301", "\u0316", "\u0323\u0301", "\u0301\u0301\u0307", "\u1161", "\u1100\u1161\u11a8", "\u0345", "\u0344", "\u093c"]
    start = time.process_time()
    for unit in units:
        for base in ("a", "\u1100"):
            text = base + unit * (100_000 // len(unit))
            assert c.totals([text])[0] == len(coder.encode([text])[0]), unit
            if len(set(map(unicodedata.combining, unit))) == 1:
                short = text[:5000]
                every = c._walk(short)
                ends = [1, 2, 3, 50, 1001, 4999, 5000]
                assert len(every) == 5000 and [every[n - 1] for n in ends] == [len(x) for x in coder.encode([short[:n] for n in ends])], unit
    assert time.process_time() - start < 120
    for _ in range(400):  # classes in any order
        text = "".join(rnd.choice(["a", "J", "\u030c", "\u0301", "\u0323", "\u0316", "\u0345", "\u0344", "\u0130", "\u1100", "\u1161", "\u11a8", "e", "\u0338", "="]) for _ in range(rnd.randint(1, 14)))
        if text.split() == [text]:
            assert c.of_chunk(text) == [len(x) for x in coder.encode([text[: n + 1] for n in range(len(text))])], ascii(text)


def test_what_is_remembered_is_bounded_by_bytes(coder, monkeypatch):
    """Chunks of paragraphs: known ones and counts are forgotten by what they take, and results stay."""
    T = tokens
    monkeypatch.setattr(T, "MOST_CHUNK_BYTES", 400_000)
    monkeypatch.setattr(T, "MOST_PIECE_BYTES", 400_000)
    c, rnd = T.PrefixCounter(coder.path), random.Random(2)
    own = T.ChunkCoder(coder.path)
    for _ in range(12):
        texts = ["".join(chr(rnd.randrange(0x4E00, 0x4F00)) for _ in range(3000)) for _ in range(20)]
        index, n, distinct = T.chunked(pa.array(texts))
        assert c.remembered_totals(distinct)[index].tolist() == [len(x) for x in coder.encode(texts)]
        coded = own.code(pa.array(texts))
        assert coded.all_ids().tolist() == [i for x in coder.encode(texts) for i in x]
        assert c.seen.known.nbytes < 800_000 and c.memo_bytes < 1_000_000 and own.seen.known.nbytes < 800_000
