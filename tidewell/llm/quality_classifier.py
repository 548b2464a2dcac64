"""Ordinal quality classifier: cumulative-link regression on hashed text features.

With grades 0..K-1, P(grade > k) = sigmoid(w.x - threshold_k): one weight vector for all grades and ordered thresholds.
x holds 1 for every hashed feature that a text has: its words, their beginnings, and classes of its shape (share of symbols, of separators,
of repeated words and lines, word length, size). Weights are fitted with an L1 penalty by proximal gradient steps, so that most are zero and the
many rare words of a long text add nothing. The expected grade is the sum of P(grade > k), and the probability of
reaching a wanted grade selects.

The fit reads ``max_rows`` labelled rows at most, those whose ids have the least hash, whatever the size of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits, written
from .words import PLAIN, Words, _mix, blocks, shingles

BITS, MAX_ROWS, MIN_DOCS, MIN_Z, L1, STEPS = 20, 16384, 8, 5.0, 1e-4, 600
#: Tasks that the labelled rows' features are made and counted in.
FEATURE_TASKS = 48
#: Beginnings of words that are features too, in bytes.
PREFIX_BYTES = (5, 7)
_SYMBOLS = {"symbols": b"#*$%&", "separators": b"|<>{}[]=/\\_~^", "digits": b"0123456789", "marks": b".,;:!?"}
_TABLES = {}
for _name, _bytes in _SYMBOLS.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True


def _level(share: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 as levels: 0, then one for each power of two above 1/512."""
    return np.where(share <= 0, 0, np.clip(np.floor(np.log2(np.maximum(share, 1e-9))) + 10, 1, 10)).astype(np.int64)


def features(texts: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text, ascending. Null and empty texts have those of their shape."""
    for _, block in blocks(texts):
        raw, w = Words(block), Words(block, PLAIN)
        n_bytes, n_words = np.maximum(np.diff(w.texts), 1), np.diff(raw.of)
        h, ends = [w.hashes(lower=True)], w.end
        for size in PREFIX_BYTES:
            w.end = np.minimum(ends, w.start + size)
            h.append(_mix(w.hashes(lower=True) + np.uint64(size)))
        h = np.stack(h)
        own = raw.hashes()
        shape = [np.minimum(np.floor(np.log2(n_words + 1)), 8).astype(np.int64)]
        chars = np.concatenate([[0], np.cumsum(raw.end - raw.start)])
        shape.append(np.clip(np.diff(chars[raw.of]) / np.maximum(n_words, 1), 0, 24).astype(np.int64))
        for table in _TABLES.values():
            seen = np.concatenate([[0], np.cumsum(table[w.data])])
            shape.append(_level(np.diff(seen[w.texts]) / n_bytes))
        three = shingles(own, 3)
        for k in range(len(w)):
            words, every = h[:, w.of[k] : w.of[k + 1]].ravel(), own[raw.of[k] : raw.of[k + 1]]
            grams = three[raw.of[k] : max(raw.of[k], raw.of[k + 1] - 2)]
            lines = w.data[w.texts[k] : w.texts[k + 1]].tobytes().split(b"\n")
            repeats = [1 - np.unique(every).size / every.size if every.size else 0, 1 - np.unique(grams).size / grams.size if grams.size else 0, 1 - len(set(lines)) / len(lines)]
            kinds = [s[k] for s in shape] + _level(np.array(repeats)).tolist()
            made = _mix(np.array([(i + 1) << 32 | int(v) + 1 for i, v in enumerate(kinds)], np.uint64))
            yield np.unique(np.concatenate([words, made]) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Model:
    bits: int
    thresholds: np.ndarray
    weights: np.ndarray = field(repr=False)

    def score(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def telling(docs: np.ndarray, total: np.ndarray, n: int, mean: float, deviation: float, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> np.ndarray:
    """Features of min_docs rows or more whose mean grade is min_z standard errors or more off the overall mean.

    docs, total: rows and sum of grades by feature. Among hundreds of thousands of features chance alone reaches nearly
    that, and noise summed over a long text would outweigh what tells.
    """
    if not n or deviation <= 0:
        return np.zeros(docs.size, bool)
    z = (total - docs * mean) / np.sqrt(np.maximum(docs, 1)) / deviation
    return (docs >= min_docs) & (np.abs(z) >= min_z)


def fit(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, bits: int = BITS, l1: float = L1, steps: int = STEPS) -> Model:
    """A model from the rows' feature numbers one after another, their counts, and grades 0..n_grades - 1.

    Without rows all weights are zero and every P(grade > k) is a half; with one grade only all weights are zero and the
    thresholds are the grades' log odds, a share of 0 or 1 taken as 0.001 or 0.999.
    """
    n = sizes.size
    share = np.array([(grades > k).mean() if n else 0.5 for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.sort(np.log((1 - share) / share))
    weights = np.zeros(1 << bits)
    used = np.unique(flat)
    if not n or len(np.unique(grades)) < 2 or not used.size:
        return Model(bits, theta, weights)
    column = np.full(1 << bits, -1, np.int32)
    column[used] = np.arange(used.size)
    row, col = np.repeat(np.arange(n, dtype=np.int32), sizes), column[flat]
    # Sums by row and by feature are sums over neighbours, once in the rows' order and once in the features'.
    filled, ends = np.flatnonzero(sizes), np.cumsum(sizes)
    by_feature = np.argsort(col, kind="stable")
    row_of, feature_starts = row[by_feature], np.searchsorted(col[by_feature], np.arange(used.size))

    def of_rows(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[filled] = np.add.reduceat(values[col], (ends - sizes)[filled])
        return out

    def of_features(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[row_of], feature_starts)

    # Each feature in its own scale: rare telling features would be slow otherwise.
    pace = 1 / np.sqrt(np.bincount(col, minlength=used.size) / n)
    w = v = np.zeros(used.size)
    t = u = theta
    along = np.ones(used.size)
    for _ in range(30):
        along = of_features(of_rows(pace * along)) * pace / n
        steepest = float(np.linalg.norm(along))
        along /= max(steepest, 1e-12)
    step, momentum = 2 / max(steepest, 1e-12), 1.0

    def gradient(w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = of_rows(pace * w)
        upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -60, 60))), np.zeros((n, 1))], axis=1)
        # d log P(grade) / d score is 1 - P(>= grade) - P(> grade).
        low, high = upper[np.arange(n), grades], upper[np.arange(n), grades + 1]
        by_score = (low + high - 1) / n
        mass = np.maximum(low - high, 1e-12)
        slope = upper * (1 - upper)
        by_t = np.array([(slope[:, k + 1] * ((grades == k + 1) / mass - (grades == k) / mass)).mean() for k in range(n_grades - 1)])
        return of_features(by_score) * pace, by_t

    for _ in range(steps):
        g, gt = gradient(v, u)
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1 * pace, 0)
        new_t = np.sort(u - 2 * gt)
        if float(((v - new) * (new - w)).sum()) > 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, u = new + (momentum - 1) / following * (new - w), new_t + (momentum - 1) / following * (new_t - t)
        w, t, momentum = new, new_t, following
    weights[used] = pace * w
    return Model(bits, t, weights)


def train(docs: DataFrame, labels: DataFrame, n_grades: int, max_rows: int = MAX_ROWS, text: str = "text", key: str = "doc_id", bits: int = BITS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, **how) -> Model:
    """Fits on labels (doc_id, grade from 0 to n_grades - 1), max_rows labelled rows at most, those of the least hashes.

    Null and other grades, and ids without a document, don't count; of repeated labels or documents every pair is a row,
    but if that makes more than max_rows rows, equal rows count once and again those of the least hashes are taken.
    Features are counted in FEATURE_TASKS tasks; only those that tell come to the driver. No labels: see fit().
    """
    arrow_limits(docs.sparkSession)
    grade, doc = F.col("grade").cast("int"), F.col("doc_id")
    sample = labels.where(grade.between(0, n_grades - 1) & doc.isNotNull()).select(doc.alias("_d"), grade.alias("_g"))
    sample = written(sample.orderBy(F.xxhash64("_d"), "_d", "_g").limit(max_rows), "graded")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x in features(batch.column(1), bits)], pa.list_(pa.int32()))], names=["grade", "x"])

    got = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x")).join(F.broadcast(sample), F.col("_k") == F.col("_d"))
    got = got.select(F.col("_d").cast("long").alias("id"), F.col("_g").alias("grade"), "_x")
    if got.select("id").count() > max_rows:  # only where documents or labels repeat
        order = ["o", "id", "grade", "h"]
        got = got.withColumns({"o": F.xxhash64("id"), "h": F.xxhash64("_x")})
        beyond = got.select(*order).distinct().orderBy(*order).offset(max_rows).limit(1).first()
        if beyond is not None:
            got = got.where(F.struct(*order) < F.struct(*(F.lit(beyond[c]).cast(t) for c, t in zip(order, ("long", "long", "int", "long")))))
        got = got.dropDuplicates(order)
    # A bounded number of rows, in tasks of a few hundred.
    got = got.repartition(FEATURE_TASKS, "id", F.xxhash64("_x")).select("grade", "_x")
    got = written(got.mapInArrow(rows, "grade int, x array<int>"), "graded-features")
    n, mean, deviation = got.agg(F.count("*"), F.avg("grade"), F.stddev_pop("grade")).first()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, total = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
        for batch in batches:
            x, sizes = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            docs_ += np.bincount(x, minlength=1 << bits)
            total += np.bincount(x, weights=np.repeat(batch.column(0).to_numpy(), sizes), minlength=1 << bits)
        used = np.flatnonzero(docs_)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(docs_[used]), pa.array(total[used])], names=["f", "n", "total"])

    # At most one row for each hashed feature, fewer where min_docs already speaks.
    sums = got.mapInArrow(counts, "f int, n long, total double").groupBy("f").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where(F.col("n") >= min_docs).toArrow()
    number, docs_, total = (sums[c].to_numpy() for c in ("f", "n", "total"))
    wanted = np.zeros(1 << bits, bool)
    wanted[number] = telling(docs_, total, n, mean or 0.0, deviation or 0.0, min_docs, min_z)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            flat, sizes = x.flatten().to_numpy(), x.value_lengths().to_numpy()
            keep = wanted[flat]
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[keep]))], names=["grade", "x"])

    lean = got.mapInArrow(told, "grade int, x array<int>").toArrow()
    flat, sizes = lean["x"].combine_chunks().flatten().to_numpy() if n else np.zeros(0, np.int32), lean["x"].combine_chunks().value_lengths().to_numpy() if n else np.zeros(0, np.int64)
    return fit(flat, sizes.astype(np.int64), lean["grade"].to_numpy().astype(np.int64), n_grades, bits, **how)


def classify(docs: DataFrame, model: Model, wanted: int, least: float = 0.5, text: str = "text") -> DataFrame:
    """All columns of docs and a struct ``graded`` (score, expected_grade, p_tail, kept): one row per input row.

    p_tail: the probability of grade ``wanted`` or better; kept: it is ``least`` or more, so a model without labels keeps
    every row at a ``least`` of a half, and one whose labels lack ``wanted`` and better grades none. Null text: as an empty one.
    Null keys and repeated rows are rows like others; a column of docs named ``graded`` is replaced. Empty input: no
    rows.
    """
    arrow_limits(docs.sparkSession)
    bits, thresholds, used = model.bits, model.thresholds, np.flatnonzero(model.weights)
    values = model.weights[used]

    def grade(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.zeros(1 << bits)
        weights[used] = values
        own = Model(bits, thresholds, weights)
        for texts in batches:
            scores = np.array([own.score(x) for x in features(texts, bits)])
            above = own.above(scores)
            tail = above[:, wanted - 1]
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(above.sum(axis=1), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least, pa.bool_())], names=["score", "expected_grade", "p_tail", "kept"])

    return docs.drop("graded").withColumn("graded", F.arrow_udf(grade, "struct<score:double,expected_grade:double,p_tail:double,kept:boolean>")(F.col(text)))
