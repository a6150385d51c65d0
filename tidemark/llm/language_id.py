"""Language identification in two steps: the language family, then one-versus-one linear support vector machines in it.

Features are hashed byte trigrams of the whole text (A-Z lower-cased), square-rooted and scaled to length one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .numtext import column, let_go

DIMS = 4096
PER_LANGUAGE = 600
SEEDS, SEED_SIZE = 48, 32
MOST_ROWS = 9600
SLICE = 2 << 20
UNKNOWN = "und"
#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indo-aryan": "hi mr ne bn ur",
}
LETTER = regex.compile(r"\p{L}")  # as in the training filter: number signs are no letters
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(buf: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed trigrams of consecutive texts. A long text is taken in pieces that overlap by two bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    at = int(offsets[0])
    while at < offsets[-1]:
        to = min(int(offsets[-1]), at + (1 << 20))
        b = _FOLD[buf[at : min(int(offsets[-1]), to + 2)]]
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
            pos = np.arange(at, at + len(h))
            doc = np.searchsorted(offsets, pos, "right") - 1
            ok = pos + 2 < offsets[doc + 1]
            lo, hi = int(doc[0]), int(doc[-1]) + 1
            flat = (doc[ok] - lo) * dims + (h[ok] % np.uint32(dims)).astype(np.int64)
            out[lo:hi] += np.bincount(flat, minlength=(hi - lo) * dims).reshape(hi - lo, dims)
        at = to
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, classes weighted alike; y is -1 or 1, and x has a last column of ones for the
    bias. Accelerated gradient descent from zero: the result is the same each time."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, rate = w.copy(), 1 / (2 * 2 + penalty)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * ((weight * slack * y) @ x) + penalty * v
        new = v - rate * grad
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class Model:
    """Machines by pair: of families at the top, of languages within each family."""

    tree: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def _vote(self, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of all pairs (ties: larger sum of margins, then first name) and the confidence of its weakest pair."""
        votes, sums = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        low = np.full((len(x), len(names)), np.inf)
        for a, b in combinations(range(len(names)), 2):
            w = self.machines[names[a], names[b]]
            m = x @ w[:-1] + w[-1]
            for k, s in ((a, m), (b, -m)):
                votes[:, k] += s > 0 if k == a else s >= 0
                sums[:, k] += np.tanh(s)
                low[:, k] = np.minimum(low[:, k], s)
        best = np.argmax(votes * 1e3 + sums, 1)
        sure = low[np.arange(len(x)), best]
        return best, np.where(np.isinf(sure), 1.0, 1 / (1 + np.exp(-4 * np.clip(sure, -20, 20))))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = sorted(self.tree)
        top, score = self._vote(families, x)
        out: list[str] = [""] * len(x)
        for k, family in enumerate(families):
            rows = np.flatnonzero(top == k)
            if len(rows):
                best, sure = self._vote(self.tree[family], x[rows])
                score[rows] *= sure
                for r, b in zip(rows, best, strict=True):
                    out[r] = self.tree[family][b]
        return out, score


def families(lang: np.ndarray, x: np.ndarray) -> dict[str, list[str]]:
    """Languages by family. Labels that FAMILIES does not list are families of their own, the SEEDS most frequent of them (ties: by name; more where
    that is less than one in SEED_SIZE); each further one joins the nearest of these by its mean counts, so every label has a place while
    the pairs stay few."""
    known = {code: f"family {name}" for name, codes in FAMILIES.items() for code in codes.split()}
    names, count = np.unique(lang, return_counts=True)
    tree: dict[str, list[str]] = {}
    for k in names.tolist():
        if k in known:
            tree.setdefault(known[k], []).append(k)
    rest = [str(names[i]) for i in np.lexsort((names, -count)) if names[i] not in known]
    cut = max(SEEDS, -(-len(rest) // SEED_SIZE))
    tree |= {f"family of {k}": [k] for k in rest[:cut]}
    if rest[cut:]:
        mean = lambda k: x[lang == k].mean(0)
        seeds = np.stack([mean(k) for k in rest[:cut]])
        for k in rest[cut:]:
            room = np.array([len(tree[f"family of {s}"]) < 2 * SEED_SIZE for s in rest[:cut]])
            tree[f"family of {rest[int(np.argmax(np.where(room, seeds @ mean(k), -np.inf)))]}"].append(k)
    return {f: sorted(v) for f, v in tree.items()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Fits on about per_language different texts of each language, taken by a hash of text and id; their counts of trigrams go to the
    driver, not their texts.

    Rows without language or letters teach nothing; rows that repeat id and text count once. All languages share most_rows, and each has one
    row at least: the bounds of the sample and of its memory. They bound the fit alone, and every label is learned.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    totals = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("different"), F.min(F.pmod("h", F.lit(1 << 20))).alias("least")).collect()  # a row for each language
    if not totals:
        return Model({}, {})
    each = max(1, min(per_language, most_rows // len(totals)))
    below = [(r["lang"], max(r["least"], int(min(1.0, each / max(1, r["different"])) * (1 << 20)) - 1)) for r in totals]
    wanted = docs.sparkSession.createDataFrame(below, "lang string, most long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = column(batch, "text")
            for i in range(len(batch)):
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").slice(i, 1), "h": batch.column("h").slice(i, 1), "counts": [np.minimum(trigrams(buf, offsets[i : i + 2]), 65535).astype("<u2").tobytes()]})

    sample = rows.join(F.broadcast(wanted), "lang").filter(F.pmod("h", F.lit(1 << 20)) <= F.col("most")).groupBy("lang", "h").agg(F.min("text").alias("text"))  # one text of all copies
    got = sorted(((r["lang"], r["h"], bytes(r["counts"])) for r in sample.mapInArrow(run, "lang string, h long, counts binary").toLocalIterator()), key=lambda r: r[:2])
    if not got:
        return Model({}, {})
    lang = np.array([r[0] for r in got])
    x = np.ones((len(got), DIMS + 1), np.float32)
    for k, (_, _, counts) in enumerate(got):
        x[k, :DIMS] = scaled(np.frombuffer(counts, "<u2").astype(np.float32)[None])[0]
    del got
    return fit(x, lang)


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    """The machines of all pairs of families, and of all pairs of languages in each family, from scaled counts with a column of ones."""
    tree = families(lang, x)

    def machine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        own = first | second
        return linear_svm(x if own.all() else x[own], np.where(first, 1, -1)[own].astype(np.float32))

    machines = {(a, b): machine(np.isin(lang, tree[a]), np.isin(lang, tree[b])) for a, b in combinations(sorted(tree), 2)}
    for names in tree.values():
        machines |= {(a, b): machine(lang == a, lang == b) for a, b in combinations(names, 2)}
    return Model(tree, machines)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1).

    Text that is null or has no letter, and every text where the model has learned nothing, gets `und` with score 0. Texts are
    read whole. Clashing columns lang_pred and score of the input are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    held = spark.sparkContext.broadcast(model)  # 4097 numbers of 4 bytes for each pair of families and of languages in one
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        let_go()
        for batch in batches:
            buf, offsets = column(batch, text_col)
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            lang, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            lo = 0
            while lo < len(batch):
                hi = min(len(batch), max(lo + 1, min(lo + 512, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)))
                rows = np.array([i for i in range(lo, hi) if model.tree and texts[i] and LETTER.search(texts[i])], np.int64)
                if len(rows):
                    names, sure = model.predict(scaled(trigrams(buf, offsets[lo : hi + 1]))[rows - lo])
                    lang[rows], score[rows] = names, sure
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
