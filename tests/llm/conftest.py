import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators use inside or return.
EXTRA = ["id", "b", "g", "n", "kept", "score", "component_id", "digest", "shard", "lang_pred", "text_sha256", "__kept", "__word", "__bits", "__bit", "__maybe", "__kept_id", "__own_id", "__gone", "__row", "row", "own_id", "kept_id", "gone", "key", "pos", "h", "d"]


@pytest.fixture(scope="session")
def corpus():
    """Plain, copied, nearly copied, overlapping, short, empty, null and long texts."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [text(r.randint(30, 120)) for _ in range(60)]
    for k in range(12):  # near copies
        w = docs[k].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [docs[0], docs[0].replace(" ", "\n\t", 3), docs[1].upper()]
    passage = text(45)
    docs += [f"{text(20)} {passage} {text(25)}" for _ in range(8)] + [f"{passage} {passage}"]
    docs += ["", None, " ", "one", "one two three", "One two three", "é" * 10, "a " * 60, text(20_000), "1234 5678 !!", "x" * 5000]
    base = text(60).split()
    for k in range(40):  # a chain of copies of copies
        base = list(base)
        base[(k * 7) % 60] = word()
        docs.append(" ".join(base))
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, None if i % 9 == 0 else "en", None if i % 5 == 0 else "s", 0) for i, t in corpus], DOC).repartition(5)
    return df.select("*", *[F.lit(f"clash-{c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
