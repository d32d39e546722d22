"""A quality classifier: naive Bayes support vectors over n-gram indicators.

A document's features are indicators of word unigrams and bigrams (in hashed buckets), of character-class trigrams (upper, lower, digit,
white space, each mark on its own) at three levels (present, at least 2 % and at least 10 % of all trigrams), and of the shares of word bigrams
that repeat a word and of lines that repeat a line. They are scaled by class log-count ratios (multinomial naive Bayes over indicators) and a
linear model with hinge loss is fitted by dual coordinate descent; margins on held-in folds calibrate a logistic score.

Training uses at most max_train_rows labelled rows (a documented bound, chosen by hash); scoring covers every whole text. Null and empty
texts have no features and get the score of the intercept. A document with several labels counts once for each distinct one, and of rows that
share a labelled doc_id one text is learned from, chosen by hash; rows without a label are not used. With fewer than two classes the score is
the constant share of class 1 (0.5 without labels). Repeated rows are scored alike; a score at the threshold is accepted; a null doc_id is not
held out; an empty table gives an empty result. Extra columns are ignored by score() and kept by accepted(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.llm.common import gram_hashes, lower_words, word_hashes

MAX_TRAIN_ROWS = 6000
THRESHOLD = 0.7
_N = 32**3
_LEVELS = (0.0, 0.02, 0.1)
_REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
_WORD_BITS = 17
_WORDS_AT = 3 * _N + 2 * len(_REPEATS)
N_FEATURES = _WORDS_AT + (1 << _WORD_BITS)


def _classes() -> np.ndarray:
    """Byte -> class below 32."""
    out = np.full(256, 31, np.uint16)
    out[128:] = 1
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    for i, c in enumerate(" \n.,!?;:'\"()-|#$%&*@/=+_<[{"):
        out[ord(c)] = 4 + i
    out[ord("\t")] = out[ord("\r")] = 4
    return out


_CLASS = _classes()
# UTF-8 leads of upper-case Latin letters count as lower case: case is told by ASCII letters.


def features(text: str | None) -> np.ndarray:
    """Sorted indices of the indicators that hold."""
    if not text:
        return np.empty(0, np.int32)
    raw = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    out = []
    if len(c) >= 3:
        code = (c[:-2] << np.uint16(10)) | (c[1:-1] << np.uint16(5)) | c[2:]
        counts = np.bincount(code, minlength=_N)
        have = np.nonzero(counts)[0]
        share = counts[have] / len(code)
        out += [have, have[share >= _LEVELS[1]] + _N, have[share >= _LEVELS[2]] + 2 * _N]
    ws = raw.split()
    lines = [x for x in raw.split(b"\n") if len(x) > 3]
    for base, part, whole in ((3 * _N, sum(map(bytes.__eq__, ws, ws[1:])), len(ws) - 1), (3 * _N + len(_REPEATS), len(lines) - len(set(lines)), len(lines))):
        if whole > 0:
            out.append(np.array([base + i for i, t in enumerate(_REPEATS) if part / whole >= t], np.int64))
    h = word_hashes(lower_words(text))
    grams = np.concatenate((gram_hashes(h, 1), gram_hashes(h, 2))) >> np.uint64(64 - _WORD_BITS)
    out.append(np.unique(grams.astype(np.int32)) + _WORDS_AT)
    return np.concatenate(out).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # scaled by the log-count ratios
    bias: float
    slope: float
    offset: float

    def margin(self, f: np.ndarray) -> float:
        return float(self.weight[f].sum() / np.sqrt(max(len(f), 1)) + self.bias)

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.offset, -30, 30))))


def _fit(rows: list[np.ndarray], y: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Log-count ratios, then dual coordinate descent on the hinge loss; classes weigh alike."""
    pos, neg = np.ones(N_FEATURES), np.ones(N_FEATURES)
    for f, t in zip(rows, y, strict=True):
        (pos if t > 0 else neg)[f] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    x = [ratio[f] / np.sqrt(max(len(f), 1)) for f in rows]
    n_pos = max(1, int((y > 0).sum()))
    upper = np.where(y > 0, c, c * min(10.0, n_pos / max(1, len(y) - n_pos)))
    w, b, alpha = np.zeros(N_FEATURES), 0.0, np.zeros(len(rows))
    q = np.array([v @ v + 1 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + b) - 1
            new = min(max(alpha[i] - g / q[i], 0), upper[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[rows[i]] += d * x[i]
                b += d
                alpha[i] = new
    return w * ratio, b


def train(rows: list[np.ndarray], labels: list[int], c: float = 1.0, epochs: int = 12, seed: int = 3) -> Model:
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(N_FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold, margins = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        ins = np.nonzero(fold != k)[0]
        if len(set(y[ins].tolist())) < 2:
            continue
        part = Model(*_fit([rows[i] for i in ins], y[ins], c, max(3, epochs // 2), seed), 1.0, 0.0)
        for i in np.nonzero(fold == k)[0]:
            margins[i] = part.margin(rows[i])
    slope, offset = 1.0, 0.0
    target = np.where(y > 0, (y > 0).sum() + 1.0, 1.0) / (np.where(y > 0, (y > 0).sum(), (y < 0).sum()) + 2.0)
    for _ in range(60):  # Newton steps of Platt's fit
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        e, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[v @ margins**2 + 1e-3, v @ margins], [v @ margins, v.sum() + 1e-3]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(h, np.array([e @ margins, e.sum()]))
    return Model(*_fit(rows, y, c, epochs, seed), max(float(slope), 1e-3), float(offset))


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labels(doc_id, quality) of docs(doc_id, text) whose crc32(doc_id as text) mod 4 is not 2."""
    known = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    chosen = known.select(F.col("doc_id").alias("of"), (F.col("quality") > 0).cast("int").alias("y")).distinct().orderBy(F.xxhash64("of"), "of", "y").limit(max_train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["of", "y", "f"])

    # At most max_train_rows rows of four columns are broadcast, and as many collected, whatever the input.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    one = met.groupBy("of", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = one.mapInArrow(run, "of long, y int, f array<int>").collect()
    rows.sort(key=lambda r: (r["of"], r["y"]))
    return train([np.array(r["f"], np.int32) for r in rows], [r["y"] for r in rows])


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with one more column, the score."""
    at = docs.columns.index("text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # N_FEATURES numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = pa.array([m.score(features(t)) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    model = fit(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns of docs."""
    names = docs.columns
    inner = docs.toDF(*[n if n == "text" else f"c{i}" for i, n in enumerate(names)])
    model = fit(docs, labels)
    kept = _scored(inner, model, "score").where(F.col("score") >= threshold)
    return kept.select(*[F.col("text" if n == "text" else f"c{i}").alias(n) for i, n in enumerate(names)])
