import random
import zlib
from bisect import bisect_left, insort

import pytest

from episodica.llm import rolling as R
from episodica.llm.queries import ORACLES, QUERIES
from tests.compare import duck, rows


def brute(table, windows=R.WINDOWS):
    """Every window looked through row by row."""
    timed = [(i, s, la, None if t is None else len(t), None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 1000) // 6)) for i, t, la, s in table]
    out = []
    for i, s, _, _, e in timed:
        for w in windows:
            own = [r for r in timed if e is not None and r[4] is not None and r[1] == s and e - w <= r[4] < e]
            c = sorted(r[3] for r in own if r[3] is not None)
            m = len(c)
            out.append((i, w, e, len(own), sum(c), len({r[2] for r in own if r[2] is not None}), c[-(-m // 2) - 1] if m else None, c[-(-99 * m // 100) - 1] if m else None))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars").collect()), key=repr)


def test_treap_like_a_sorted_list():
    rnd, tree, plain = random.Random(1), R.Treap(), []
    for step in range(20_000):
        x = rnd.randrange(300) if step % 3 else rnd.randrange(10**9)
        if plain and rnd.random() < 0.48:
            x = plain[rnd.randrange(len(plain))]
            n = rnd.randint(1, plain.count(x)) if step % 7 == 0 else 1
            tree.add(x, -n)
            at = bisect_left(plain, x)
            del plain[at : at + n]
        else:
            n = rnd.randint(1, 3)
            tree.add(x, n)
            for _ in range(n):
                insort(plain, x)
        assert len(tree) == len(plain)
        if plain and step % 11 == 0:
            k = rnd.randint(1, len(plain))
            assert tree.select(k) == plain[k - 1]
    assert [tree.select(k + 1) for k in range(len(plain))] == plain
    with pytest.raises(ValueError):
        tree.add(-5, -1)


def test_treap_is_shallow_whatever_the_order():
    for order in (range(20_000), range(20_000, 0, -1)):
        tree = R.Treap()
        for x in order:
            tree.add(x, 1)
        depth, level = 0, [tree.root]
        while level:
            depth, level = depth + 1, [c for i in level for c in (tree.left[i], tree.right[i]) if c]
        assert depth < 50


def test_table_like_brute_force_and_sql(spark, data, docs):
    got = QUERIES["op13_rolling"](spark, data)
    assert result(got) == brute([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    assert rows(got.toPandas()) == rows(duck(data).execute(ORACLES["op13_rolling"]).df())


@pytest.mark.parametrize("cell_rows", [3, 40])
def test_cells_shorter_than_windows(spark, monkeypatch, cell_rows):
    """One source and many rows at few times: cells are parts of the windows, and rows of one time count together."""
    monkeypatch.setattr(R, "CELL_ROWS", cell_rows)
    rnd = random.Random(cell_rows)
    table = [(rnd.randrange(-3000, 6000) * 3, rnd.choice(["a", "bb", "", None, "c" * 40]), rnd.choice(["x", "y", None]), "s" if k % 4 else None) for k in range(600)]
    table += [(7, "same", "x", "s")] * 50
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    assert result(R.rolling_features(df)) == brute(table)
    assert result(R.rolling_features(df, (60, 7, 5000))) == brute(table, (60, 7, 5000))


def test_odd_rows(odd_docs, no_docs):
    assert result(R.rolling_features(odd_docs)) == brute([(r.doc_id, r.text, r.lang, r.source) for r in odd_docs.collect()])
    assert R.rolling_features(no_docs).count() == 0


def test_nothing_is_broadcast(docs):
    plan = R.rolling_features(docs)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoop" not in plan and "SortMergeJoin" in plan
