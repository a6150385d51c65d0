"""The dictionary's best path against all paths."""

import collections
import hashlib
import itertools
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import segmentation


def all_paths(run, words, cost):
    """Every cut of a run into dictionary words and maximal unknown pieces."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        edge = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(run)]
        for kinds in itertools.product((0, 1), repeat=len(edge) - 1):
            pieces = [run[a:b] for a, b in zip(edge, edge[1:])]
            if any(k and p not in words for k, p in zip(kinds, pieces)) or any(not a and not b for a, b in zip(kinds, kinds[1:])):
                continue
            price = sum(cost[p] if k else segmentation.PIECE + segmentation.LETTER * len(p) for k, p in zip(kinds, pieces))
            way = (price, len(pieces), *(-e for e in edge[1:]))
            if best is None or way[:3] < best[0][:3]:
                best = (way, pieces)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_best_path(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcé") for _ in range(r.randint(1, n)))
    words = {word(4): r.randint(1, 50) for _ in range(10)}
    s = segmentation.Segmenter(words)
    cost = dict(zip(sorted(words), s.cost))
    for _ in range(6):
        run = word(7)
        got = s.split(run)
        want, _ = all_paths(run, words, cost)
        assert "".join(got) == run
        assert (_price(got, cost), len(got)) == want[:2], (run, got, want)


def _price(pieces, cost):
    """The cheapest reading of given pieces."""
    out, before = 0, True
    for p in pieces:
        unknown = segmentation.PIECE + segmentation.LETTER * len(p)
        known = cost.get(p, 10**9)
        out += known if known <= unknown or not before else unknown
        before = known <= unknown or not before
    return out


def test_every_word_is_in_the_double_array():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdefgh한국") for _ in range(r.randint(1, 9))) for _ in range(3000)})
    trie, known = segmentation.DoubleArray(words), set(words)
    for k, w in enumerate(words):
        codes = [trie.code[c] for c in w]
        found = dict(trie.prefixes(codes, 0))
        assert found[len(w)] == k and set(found) == {n for n in range(1, len(w) + 1) if w[:n] in known}


def test_compound_names(spark):
    words = {"삼성": 30, "전자": 20, "삼성전자": 50, "주가": 40, "상승": 30, "sk": 9, "hynix": 5}
    s = segmentation.Segmenter(words)
    assert s.split("삼성전자주가상승") == ["삼성전자", "주가", "상승"]
    assert s.split("SKhynixx") == ["SK", "hynix", "x"] and s.split("전혀") == ["전혀"] and s.split("삼성전") == ["삼성", "전"] and s.split("") == []
    df = spark.createDataFrame([(1, ["삼성전자주가", "x"]), (2, []), (3, None)], "id int, t array<string>")
    got = {r.id: r.p for r in df.select("id", segmentation.segments(F.col("t"), words).alias("p")).collect()}
    assert got == {1: ["삼성전자", "주가", "x"], 2: [], 3: None}


def test_a_dictionary_beyond_the_bound_is_refused(spark, monkeypatch):
    df = spark.createDataFrame([("ab", 2), ("cd", 0), (None, 1)], "w string, n long")
    assert segmentation.dictionary(df, "w", "n") == {"ab": 2}
    monkeypatch.setattr(segmentation, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="bytes"):
        segmentation.dictionary(df, "w", "n")


def test_a_dictionary_of_short_words_is_built_in_seconds():
    r = random.Random(2)
    words = {"".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(r.randint(2, 5))): 2 for _ in range(12_000)}
    began = time.process_time()
    s = segmentation.Segmenter(words)
    assert time.process_time() - began < 20
    assert s.split_all(sorted(words)[:100])[1].sum() == sum(map(len, sorted(words)[:100]))
    assert len(s.trie.base) < 1.5 * (s.trie.check >= 0).sum() + 1000


@pytest.mark.parametrize("seed", range(6))
def test_many_runs_at_once(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcé한") for _ in range(r.randint(1, n)))
    s = segmentation.Segmenter({word(5): r.randint(1, 50) for _ in range(40)} if seed else {})
    runs = ["", *("".join(r.choice("abcé한Bx7İß😀") for _ in range(r.randint(0, 90))) for _ in range(400)), "abc" * 700, "ab" * 32, "x" * 65]
    counts, letters = s.split_all(runs)
    ends = counts.cumsum()
    for run, n, end in zip(runs, counts, ends):
        assert letters[end - n : end].tolist() == [len(p) for p in s.split(run)], run


def test_pieces_in_rows(spark):
    words = {"삼성": 30, "ab": 20, "éa": 9}
    rows = [(k, None if k % 7 == 3 else [["삼성ab", "é", "éab", "😀ab", "", "ab" * 40][(k + i) % 6] for i in range(k % 5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, t array<string>").repartition(3)
    s = segmentation.Segmenter(words)
    got = {r.id: r.p for r in df.select("id", segmentation.segments(F.col("t"), words).alias("p")).collect()}
    assert got == {k: None if t is None else [p for x in t for p in s.split(x)] for k, t in rows}
    none = df.filter("t is null").select(segmentation.segments(F.col("t"), words).alias("p")).collect()
    assert none and all(r.p is None for r in none)


def test_query_against_a_plain_version(spark, tmp_path):
    r = random.Random(7)
    some = ["ab", "cde", "fghij", "𝐀bc", "한국", "x1", "ab2cd", "a", "éa", "fghijk", "abcde한국", "²ab"]
    texts = ["", None, *("".join(r.choice(some) + r.choice([" ", ", ", "-", "", "😀"]) for _ in range(r.randint(1, 60))) for _ in range(60))]
    spark.createDataFrame([(k, t, "en", "src1", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    letter = lambda c: unicodedata.category(c)[0] == "L"
    runs = lambda t: [w for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower()).split(" ") if len(w) > 1]
    count = collections.Counter(w for t in texts for w in runs(t or "") if len(w) < 6 and all(map(letter, w)))
    s = segmentation.Segmenter({w: n for w, n in count.items() if n > 1})
    pieces = [None if t is None else [p for w in runs(t) for p in s.split(w)] for t in texts]
    got = {x.doc_id: (x.pieces, x.digest) for x in catalogue.QUERIES["tokenize_user_dictionary"](spark, str(tmp_path)).collect() if x.digest is not None}
    assert got == {k: (len(p), hashlib.sha256(" ".join(p).encode()).hexdigest()) for k, p in enumerate(pieces) if p is not None}
