import hashlib
import zlib

from episodica.llm import sharding


def brute(rows, n):
    """Order by (60 bits of md5, id); a row's shard by its middle."""
    def key(r):
        return (-1 if r[1] is None else int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), -(1 << 63) if r[0] is None else r[0])

    rows = sorted(rows, key=key)
    sizes = [len((t or "").encode()) + 8 for _, t in rows]
    total, at, seen, out = sum(sizes), 0, {}, []
    for (i, t), s in zip(rows, sizes):
        shard = min(n - 1, (2 * at + s) * n // (2 * total))
        out.append((i, s, None if t is None else zlib.crc32(t.encode()), "bytes", shard, seen.get(shard, 0), None))
        seen[shard] = seen.get(shard, 0) + 1
        at += s
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:7] for r in df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()), key=repr)


def test_like_brute_force(docs):
    assert result(sharding.shard_by_size(docs, 24)) == brute([(r.doc_id, r.text) for r in docs.collect()], 24)


def test_odd_rows(odd_docs, no_docs):
    assert result(sharding.shard_by_size(odd_docs, 5)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 5)
    assert sharding.shard_by_size(no_docs).count() == 0


def test_hot_text_is_split_and_sizes_are_near(spark):
    df = spark.createDataFrame([(i, "same text again" if i % 3 else f"text {i} " * (i % 40 + 1)) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard_by_size(df, 8).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sums = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 8 and max(sums) - min(sums) <= 2 * max(r.size for r in got)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_equal_rows_all_stay(spark):
    df = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    got = sharding.shard_by_size(df, 4).collect()
    assert len({(r.shard, r.slot) for r in got}) == 500


def test_boundaries_cut_the_weight():
    keys = [((i, 0, 0), 1 + i % 3) for i in range(100)]
    cuts = sharding.boundaries(keys, 10)
    assert cuts == sorted(set(cuts)) and 7 <= len(cuts) <= 9
