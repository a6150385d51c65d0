import random

import numpy as np
import plain
import pytest

from tidemark.llm import decontaminate


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(8)
    vocab = ["the", "of", "and", "to", "in"] * 12 + ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(r.randint(8, 45)))) for k in range(30)] + [(90, None), (91, ""), (92, "Solo"), (93, "two words")]
    docs = []
    for d in range(120):
        body = text(r.randint(0, 150))
        if d % 2:
            w = items[d % 30][1].split()
            for _ in range(r.randint(0, int(0.2 * len(w)) + 2)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], ["zzz"], [w[at], "zzz"]])
            body[r.randint(0, len(body)) : 0] = w
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "solo!"), (503, '"Two" words.')]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_recall_and_precision_against_plain(planted):
    docs, items, d, b = planted
    want = plain.held(docs, items)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.98 * len(want) and len(want) > 30
    assert all(v >= want[k] for k, v in got.items())
    assert {k for k, v in want.items() if v == 0} <= set(got)


def test_blocks_of_items_give_the_same(planted, monkeypatch):
    _, _, d, b = planted
    key = lambda df: sorted(map(tuple, df.collect()))
    one = key(decontaminate.contaminated(d, b).select("doc_id", "item_id"))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert key(decontaminate.contaminated(d, b).select("doc_id", "item_id")) == one


def test_clean_drops_exactly_those(planted):
    docs, _, d, b = planted
    bad = {r.doc_id for r in decontaminate.contaminated(d, b).collect()}
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted({i for i, _ in docs} - bad)


def test_empty_tables(planted, empty, spark):
    _, _, d, b = planted
    assert decontaminate.contaminated(empty, b).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, none).count() == 0
    assert decontaminate.clean(d, none).count() == d.count()


def test_clashing_columns_and_long_texts(docs, planted):
    assert decontaminate.contaminated(docs, planted[3]).columns == ["doc_id", "item_id", "distance", "start_word", "item_words"]


def test_edit_distance():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 3, (60, 9)), r.integers(0, 3, (60, 9))
    got = decontaminate.edit_distance(a, b, 4)
    for x, y, d in zip(a, b, got, strict=True):
        true = plain.distance(x.tolist(), y.tolist())
        assert d == true if true <= 4 else d > 4


def test_walks_of_equal_strings_meet_and_of_others_rarely():
    r = np.random.default_rng(1)
    w = r.integers(0, 2**62, (50, 20)).astype(np.uint64)
    assert (decontaminate.walk_keys(w, 5, 20) == decontaminate.walk_keys(w.copy(), 5, 20)).all()
    assert (decontaminate.walk_keys(w, 5, 20) == decontaminate.walk_keys(w[::-1].copy(), 5, 20)).mean() < 0.05


def test_equal_windows_are_compared_once(monkeypatch):
    item = "w " * 30
    index, walked, plain = decontaminate.Index([1], [item]), [], decontaminate.walk_keys
    monkeypatch.setattr(decontaminate, "walk_keys", lambda w, *rest: walked.append(len(w)) or plain(w, *rest))
    texts = ["w " * 500, "", "a b c " + "w " * 40 + "d e f"]
    data = [t.encode() for t in texts]
    h, _, _, first = decontaminate.words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), lower=True, trim=3)
    assert index.search(h, first) == [(0, 0, 0, 0), (2, 0, 0, 3)]
    assert sum(walked) < 30


@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_distance_in_a_band(n):
    r = np.random.default_rng(n)
    a = r.integers(0, 3, (300, n)).astype(np.uint64)
    b = np.where(r.random(a.shape) < 0.7, a, r.integers(0, 3, a.shape).astype(np.uint64))
    b[::3] = np.roll(b[::3], 1, axis=1)
    for most in {0, 1, n // 3, n}:
        table = [[0] * (n + 1) for _ in range(n + 1)]
        got = decontaminate.edit_distance(a, b, most)
        for x, y, d in zip(a.tolist(), b.tolist(), got.tolist()):
            for i in range(n + 1):
                for j in range(n + 1):
                    table[i][j] = max(i, j) if not i * j else min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
            assert d == table[n][n] if table[n][n] <= most else d > most
