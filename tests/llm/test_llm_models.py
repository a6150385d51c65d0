"""Language model, toxicity, language ID: exact parts against plain versions, the rest by held-out quality."""

import math
from collections import Counter

import numpy as np
import plain
import pytest
import regex as re
from pyspark.sql import functions as F

from tidemark.llm import language_id, language_model, queries, toxicity

SF = "/root/testdata/sf0.01"


def kneser_ney(train):
    """The model written plainly: a function of (before, word)."""
    pairs, words = Counter(), Counter()
    for t in train:
        before = "<s>"
        for w in [*plain.WORD.findall(plain.lower(t or "")), "</s>"]:
            pairs[before, w] += 1
            words[w] += 1
            before = w
    contexts, total, classes = Counter(w for _, w in pairs), Counter(), {}
    for (c, _), n in pairs.items():
        total[c] += n
        classes.setdefault(c, [0, 0, 0])[min(n, 3) - 1] += 1

    def disc(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out = [0.0]
        for k in (1, 2, 3):
            v = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
            out.append(min(max(v, 0.05 * k), 0.95 * k))
        return out

    d, e = disc(pairs.values()), disc(contexts.values())
    rest = sum(e[min(v, 3)] for v in contexts.values())

    def p(before, w):
        low = (max(contexts[w] - e[min(contexts[w], 3)], 0) + rest / (len(words) + 1)) / len(pairs)
        if before not in total:
            return low
        n = pairs[before, w]
        free = sum(d[k + 1] * classes[before][k] for k in range(3))
        return (max(n - d[min(n, 3)], 0) + free * low) / total[before]

    return p, words


def test_scores_are_those_of_the_plain_model(spark, docs, corpus):
    train = docs.filter("doc_id % 3 > 0")
    model = language_model.train(train)
    p, words = kneser_ney([t for i, t in corpus if i % 3])
    n, v = sum(words.values()), len(words)
    assert (model.tokens, model.words) == (n, v)
    got = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    for i, t in corpus:
        w = [*plain.WORD.findall(plain.lower(t or "")), "</s>"]
        assert (got[i].n_tokens, got[i].n_known) == (len(w), sum(x in words for x in w))
        assert got[i].base_score == pytest.approx(sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i].score == pytest.approx(sum(math.log10(p(b, x)) for b, x in zip(["<s>", *w], w)), rel=1e-9)


def test_probabilities_add_up(corpus):
    p, words = kneser_ney([t for i, t in corpus[:40]])
    for before in ["<s>", *list(words)[:5], "never-seen"]:
        assert sum(p(before, w) for w in words) + p(before, "never-seen") == pytest.approx(1)


def test_language_model_of_nothing(spark, empty, docs):
    model = language_model.train(empty)
    assert language_model.score(empty, model).count() == 0
    r = language_model.score(docs.filter("doc_id = 3"), model).first()
    assert (r.n_known, r.base_score, r.score) == (0, 0, 0)  # the one class of unknown words is certain


def test_frequent_pairs_keep_their_counts(spark):
    df = spark.createDataFrame([(1, "a b " * 1000), (2, "a c")], "doc_id long, text string")
    p, _ = kneser_ney(["a b " * 1000, "a c"])
    r = language_model.score(df.filter("doc_id = 1"), language_model.train(df)).first()
    w = ["a", "b"] * 1000 + ["</s>"]
    assert r.score == pytest.approx(sum(math.log10(p(b, x)) for b, x in zip(["<s>", *w], w)))


def test_language_model_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    model = language_model.train(df)
    p, words = kneser_ney(["a b c", "a b c", "a b c", None])
    assert (model.tokens, model.words) == (sum(words.values()), len(words))
    got = language_model.score(df, model).collect()
    full = sum(math.log10(p(b, x)) for b, x in zip(["<s>", "a", "b", "c"], ["a", "b", "c", "</s>"]))
    assert sorted((r.doc_id or 0, r.n_tokens, round(r.score, 9)) for r in got) == sorted([(0, 4, round(full, 9)), (1, 4, round(full, 9)), (1, 4, round(full, 9)), (0, 1, round(math.log10(p("<s>", "</s>")), 9))])


def test_op3_beats_the_base_on_held_out_text(spark):
    r = queries.op3_language_model(spark, SF).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_op10_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language_id(spark, SF).filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert got.a > 0.97 and got.lo >= 0 and got.hi <= 1


def test_language_of_odd_texts(spark, docs, empty):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    odd = {r.doc_id for r in docs.collect() if not re.search(r"\p{L}", r.text or "")}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == odd and len(odd) == 4
    assert language_id.predict(docs, model).columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}


def test_one_language_is_always_predicted(spark):
    df = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi", "en"), (3, "x", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predict(df.drop("lang"), language_id.train(df)).collect()] == ["en"] * 3


def test_a_language_of_copies_is_learned(spark):
    df = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("one text that all rows repeat").alias("text"), F.lit("en").alias("lang"))
    for k in range(4):
        model = language_id.train(df.withColumn("text", F.concat("text", F.lit(f" {k}"))), per_language=5)
        assert {r.lang_pred for r in language_id.predict(df.limit(3), model).collect()} == {"en"}


def test_all_labels_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SEEDS", 6)
    monkeypatch.setattr(language_id, "SEED_SIZE", 8)
    word = lambda k: "".join(chr(97 + (k * 7 + j * j * (1 + k // 26)) % 26) for j in range(12))
    df = spark.createDataFrame([(100 * k + j, f"{word(k)} {word(k)} {word(k + j % 2)}", f"x{k:02d}") for k in range(40) for j in range(1 + k % 3)], "doc_id long, text string, lang string")
    model = language_id.train(df, most_rows=20)
    assert sorted(x for names in model.tree.values() for x in names) == sorted({r.lang for r in df.collect()}) and len(model.tree) == 6
    got = language_id.predict(df, model).filter("lang = lang_pred").count()
    assert got > 0.7 * df.count()


def test_number_signs_are_no_letters(spark):
    df = spark.createDataFrame([(1, "abc def", "en"), (2, "² ½ 5", "fr"), (3, "Ⅷ", None), (4, "①", None), (5, "123", None), (6, "é", None), (7, "字", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert [x for names in model.tree.values() for x in names] == ["en"]
    assert {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()} == {1: "en", 2: "und", 3: "und", 4: "und", 5: "und", 6: "en", 7: "en"}


def plain_votes(model, text):
    """Families first, then the languages of the winner, by the votes of all pairs; trigrams counted one by one."""
    b = [x + 32 if 65 <= x <= 90 else 32 if x in (9, 10, 11, 12, 13) else x for x in text.encode()]
    counts = Counter((((p * 0x9E3779B1 + q * 0x85EBCA77 + r * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 20 for p, q, r in zip(b, b[1:], b[2:]))
    norm = math.sqrt(sum(counts.values())) or 1
    margin = lambda w: sum(math.sqrt(n) / norm * float(w[k]) for k, n in counts.items()) + float(w[-1])

    def winner(names):
        votes, sums = Counter(), Counter()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                m = margin(model.machines[a, b])
                votes[a if m > 0 else b] += 1
                sums[a] += math.tanh(m)
                sums[b] -= math.tanh(m)
        return min(names, key=lambda x: (-votes[x], -sums[x]))

    return winner(model.tree[winner(sorted(model.tree))])


def test_predictions_are_the_plain_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, per_language=80)
    got = [(r.text, r.lang_pred) for r in language_id.predict(docs.filter("length(text) < 3000").limit(150), model).collect() if r.lang_pred != "und"]
    assert len({p for _, p in got}) > 2 and all(plain_votes(model, t) == p for t, p in got)


def test_trigrams_of_a_long_text_do_not_depend_on_pieces():
    text = b"Some Text " * 250_000
    buf = np.frombuffer(text, np.uint8)
    whole = language_id.trigrams(buf, np.array([0, len(text)]))
    assert whole.sum() == len(text) - 2


def test_gradients():
    rng = np.random.default_rng(0)
    texts = ["good day to you all here", "you idiot scum", "fine words here", "scum of the earth idiot"] * 3
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    ids, grams, length, back, start, doc, first = toxicity.prepared(buf, offsets)
    net = toxicity.Network(ids[:6])
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    row = net.rows(ids)
    at, mask = toxicity.window_words(back, start, doc, first)
    weight = rng.standard_normal(len(at))

    def loss():
        x = net.inputs(row, grams, length).astype(np.float64)
        return float(weight @ net.run(net.gates(x), at, mask)), x

    x = loss()[1]
    _, held = net.run(net.gates(x), at, mask, keep=True)
    g = net.backward(weight, held, x, at, row, grams, length)
    for name, v in net.p.items():
        for _ in range(4):
            i = tuple(int(rng.integers(s)) for s in v.shape)
            if name == "word" and i[0] == 0:
                continue
            old = v[i]
            v[i] = old + 1e-4
            up = loss()[0]
            v[i] = old - 1e-4
            down = loss()[0]
            v[i] = old
            assert g[name][i] == pytest.approx((up - down) / 2e-4, abs=2e-3), name


def test_windows_cover_every_word_and_overlap():
    first = np.array([0, 0, 3, 30, 100])
    start, doc = toxicity.windows(first)
    for d in range(4):
        own = start[doc == d]
        seen = {w for s in own for w in range(s, min(s + toxicity.WINDOW, first[d + 1]))}
        assert seen == set(range(first[d], first[d + 1]))


def test_op5_on_held_out_text(spark):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    r = {(x.toxic, x.predicted): x["count"] for x in queries.op5_toxicity(spark, SF).filter("held_out").join(lab, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert r.get((0, 0), 0) > 0.88 * (r.get((0, 0), 0) + r.get((0, 1), 0)) and r.get((1, 1), 0) > r.get((1, 0), 0)


def test_op5_on_more_held_out_text(spark):
    large = "/root/testdata/sf0.1"  # some 600 toxic texts; the smaller tables have too few to learn from
    lab = spark.read.parquet(f"{large}/labels.parquet")
    r = {(x.toxic, x.predicted): x["count"] for x in queries.op5_toxicity(spark, large).filter("held_out").join(lab, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert r[1, 1] > 0.88 * (r[1, 1] + r[1, 0]) and r[0, 0] > 0.94 * (r[0, 0] + r[0, 1])


def test_long_runs_are_read_to_their_end():
    run = "lovely" * 40
    data = [run.encode(), (run + "scumidiotscum").encode()]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    ids, grams, length, back, start, doc, first = toxicity.prepared(buf, offsets)
    assert np.diff(first).tolist() == [10, 11] and length.max() <= toxicity.PART  # every byte stands in a part
    assert length[back].sum() == sum(map(len, data))


def test_contradicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"word{k % 3} and some more words", ) for k in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(k, 1 - k % 2) for k in range(40)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len({r.score for r in got}) == 1 and len(got) == 40


def test_toxicity_of_odd_texts(spark, docs, empty):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    net = toxicity.train(empty, lab)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(empty, net).count() == 0


def test_toxicity_of_few_texts(spark):
    """A class whose only text is held back, or has no word, or is one text many times."""
    few = spark.createDataFrame([(k, f"fine words number {k}") for k in range(4)] + [(4, "you idiot scum")], "doc_id long, text string")
    lab = lambda n: spark.createDataFrame([(k, int(k == n)) for k in range(5)], "doc_id long, toxic int")
    for n in range(5):
        assert toxicity.score(few, toxicity.train(few, lab(n))).count() == 5
    blank = few.withColumn("text", F.when(F.col("doc_id") == 4, "").otherwise(F.col("text")))
    assert len({r.score for r in toxicity.score(blank, toxicity.train(blank, lab(4))).filter("doc_id < 4").collect()}) == 1
    clean = [(k, f"fine plain words of text {k} for all to read") for k in range(300)]
    docs = spark.createDataFrame(clean, "doc_id long, text string").unionByName(spark.range(1000, 4000).select(F.col("id").alias("doc_id"), F.lit("you idiot scum of the earth").alias("text")))
    net = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("toxic")), per_class=100)
    got = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id % 500 = 0"), net).collect()}
    assert got[1000] > got[0]


def test_scores_are_those_of_the_plain_network():
    """Window by window and step by step, with plain loops."""
    r = np.random.default_rng(1)
    texts = ["good day to you all here", "You IDIOT scum!", "", " ".join(f"w{k % 7}" for k in range(60)), "é" * 30]
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    ids, *_ = toxicity.prepared(buf, offsets)
    net = toxicity.Network(ids[::2])
    net.p["word"][1:] = r.standard_normal(net.p["word"][1:].shape)
    sig = lambda x: 1 / (1 + math.exp(-x))

    def vector(word):
        b = np.frombuffer(word, np.uint8)
        one = toxicity.prepared(b, np.array([0, len(b)]))
        low = bytes(x + 32 if 65 <= x <= 90 else x for x in word)
        marks = [1, *low, 2]
        bucket = [((((a * 0x9E3779B1 + m * 0x85EBCA77 + z * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 16) % toxicity.CHAR_BUCKETS for a, m, z in zip(marks, marks[1:], marks[2:])]
        at = np.flatnonzero(net.vocabulary == one[0][0])
        return [*net.p["word"][at[0] + 1 if len(at) else 0], *np.mean(net.p["char"][bucket], 0)]

    def window(ws):
        x, h = [vector(w) for w in ws], toxicity.HIDDEN
        states = [[0.0] * (2 * h) for _ in x]
        for side, order, col in (("f", range(len(x)), 0), ("b", range(len(x) - 1, -1, -1), h)):
            w, u, b = net.p[f"w{side}"], net.p[f"u{side}"], net.p[f"b{side}"]
            now = [0.0] * h
            for k in order:
                g = [sum(x[k][i] * w[i, j] for i in range(len(x[k]))) + b[j] for j in range(3 * h)]
                a = [sum(now[i] * u[i, j] for i in range(h)) for j in range(3 * h)]
                z, q = [sig(g[j] + a[j]) for j in range(h)], [sig(g[h + j] + a[h + j]) for j in range(h)]
                c = [math.tanh(g[2 * h + j] + q[j] * a[2 * h + j]) for j in range(h)]
                now = [z[j] * now[j] + (1 - z[j]) * c[j] for j in range(h)]
                states[k][col : col + h] = now
        e = [sum(math.tanh(sum(s[i] * net.p["attend"][i, j] for i in range(2 * h)) + net.p["attend_b"][j]) * net.p["query"][j] for j in range(toxicity.ATTEND)) for s in states]
        m = [math.exp(v - max(e)) for v in e]
        pooled = [sum(v * s[i] for v, s in zip(m, states)) / sum(m) for i in range(2 * h)]
        return sum(p * o for p, o in zip(pooled, net.p["out"])) + float(net.p["bias"][0])

    def pieces(text):
        for w in re.findall(rb"[^\x20\x09-\x0D]+", text):
            for _ in range(3):
                w = w[1:] if len(w) > 1 and w[:1] in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else w
                w = w[:-1] if len(w) > 1 and w[-1:] in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else w
            yield w

    got = toxicity.logits(net, buf, offsets)
    for i in (0, 1, 3):
        w = list(pieces(data[i]))
        starts = range(0, max(1, -(-(len(w) - toxicity.WINDOW) // toxicity.STRIDE) + 1) * toxicity.STRIDE, toxicity.STRIDE)
        assert got[i] == pytest.approx(max(window(w[s : s + toxicity.WINDOW]) for s in starts), abs=1e-3)
    assert got[2] == -np.inf
