"""Importance resampling of documents towards a target distribution, in two Arrow passes over hashed features.

First pass: every partition adds its texts' hashed features into one vector of ``buckets`` counts (np.bincount), and
treeReduce adds the vectors up on the executors, so the driver gets a few vectors of a fixed size. Second pass: the
gains of the buckets, a broadcast of the same fixed size, are gathered by feature and summed by document. A score is the
floored mean gain plus Gumbel noise from a hash of the key, so the highest scores are a draw without replacement that
any machine repeats. Ranks come from a range partitioning of the slim scored rows: no task holds all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import arrow_limits, broadcast_if_small, unused, written

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of a text whose words are in memory at once; longer texts are taken in several pieces, words whole.
PIECE = 1 << 20

SUMS = "struct<n_words:bigint,n_features:bigint,gain:bigint>"

#: A-Z to a-z, digits, a-z and bytes of other code points stay; all other bytes become a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)  # a word over the piece's end stays whole
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def feature_buckets(text: bytes, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a UTF-8 text: words, and the buckets of all runs of 1 to max_run words that end in the piece."""
    before: list[bytes] = []
    for words in _pieces(text.translate(_PLAIN)):
        sums = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
        if max_run > 1:
            both = before + words
            for n in range(2, max_run + 1):
                first = max(0, len(before) - n + 1)
                runs = [b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1)]
                sums.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
            before = both[len(both) - max_run + 1 :] if len(both) >= max_run else both
        yield len(words), np.concatenate(sums) % buckets


def _texts(array: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; null: none."""
    for t in array.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _vector(batches: Iterator[pa.RecordBatch], buckets: int, max_run: int) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its counts."""
    out, held, size = np.zeros(buckets, np.int64), [np.zeros(0, np.int64)], 0
    for batch in batches:
        for text in _texts(batch.column(0)):
            for _, at in feature_buckets(text, buckets, max_run):
                held.append(at)
                size += at.size
                if size >= PIECE:
                    out += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [np.zeros(0, np.int64)], 0
    out += np.bincount(np.concatenate(held), minlength=buckets)
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket; the vectors are merged on the executors."""
    arrow_limits(texts.sparkSession)
    vectors = texts.select(F.col(text)).mapInArrow(partial(_vector, buckets=buckets, max_run=max_run), "counts binary")
    none = texts.sparkSession.createDataFrame([(bytes(8 * buckets),)], "counts binary")  # so that an empty table has a sum
    total = vectors.union(none).rdd.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)
    return np.asarray(total)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (smoothed share in the target / smoothed share in the source)) for each bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _summed(gain: np.ndarray, max_run: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = gain.astype(np.float64)  # whole numbers, exact in sums up to 2**53
        for array in batches:
            n = len(array)
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            of, held, size = [], [], 0

            def add(of=of, held=held, features=features, total=total, n=n):
                if held:
                    rows, at = np.repeat(of, [h.size for h in held]), np.concatenate(held)
                    features += np.bincount(rows, minlength=n)
                    total += np.bincount(rows, weights=table[at], minlength=n).astype(np.int64)
                    of.clear(), held.clear()

            for k, text in enumerate(_texts(array)):
                for n_words, at in feature_buckets(text, table.size, max_run):
                    words[k] += n_words
                    of.append(k), held.append(at)
                    size += at.size
                    if size >= PIECE:
                        add()
                        size = 0
            add()
            yield pa.StructArray.from_arrays([pa.array(x) for x in (words, features, total)], names=["n_words", "n_features", "gain"])

    return run


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) from the first 32 bits of sha256("seed:key"); a null key hashes as "seed:"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """rows with out: 1, 2, 3, ... in the given order, which should be total.

    Ranges of the order are sorted by themselves and written with each row's place; a range's start comes from the
    counts of the ranges. rows must be a written table: the range bounds are sampled from it first.
    """
    spark = rows.sparkSession
    part, place = unused(rows, "part", "place")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.shiftrightunsigned(at, 33).cast("int").alias(part), at.bitwiseAND((1 << 33) - 1).alias(place))
    sorted_ = written(sorted_, name)
    counts = sorted_.groupBy(part).agg(F.count("*").alias("n"))
    # One row for each range, as many as there are shuffle partitions.
    starts = counts.select(F.col(part).alias("_p"), F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    got = sorted_.join(F.broadcast(starts), F.col(part) == F.col("_p"))
    return got.withColumn(out, F.col("_start") + F.col(place) + 1).drop(part, place, "_p", "_start")


def importance_scores(docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features, weight, score of every row: the second pass. gain: of gains(), one for each bucket."""
    arrow_limits(docs.sparkSession)
    sums = F.arrow_udf(_summed(gain, max_run), SUMS)(F.col(text))
    got = docs.select(F.col(key).alias("doc_id"), sums.alias("s")).select("doc_id", "s.*")
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("gain div n_features - cast(gain % n_features < 0 as long)"))
    got = got.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return got.select("doc_id", "n_words", "n_features", "weight", "score")


def importance_resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row for each row of docs.

    rank: 1, 2, 3, ... for the floor(percent * N / 100) rows of the highest scores among the N rows of min_words words or
    more, ties to the smaller key; null for the others. Null or empty text: no features, weight 0, never drawn. Null key:
    after the other keys of its score. Repeated rows are rows like others: they tie, and each gets a rank of its own. An
    empty docs gives no rows; an empty target gives gains that only tell rare from frequent. Further columns aren't read.
    """
    gain = gains(bucket_counts(docs, text, buckets, max_run), bucket_counts(target, target_text, buckets, max_run))
    scored = importance_scores(docs, gain, max_run, seed, text, key)
    # The number of a row, fixed once written, splits rows of one key over ranges.
    scored = written(scored.withColumns({"drawable": F.col("n_words") >= min_words, "row": F.monotonically_increasing_id()}), "scored")
    n = scored.where("drawable").count()
    order = [F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    got = ranked(scored, order, "rank", "ranked")
    drawn = F.col("drawable") & (F.col("rank") <= percent * n // 100)
    return got.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def drawn_documents(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, whose key has a rank in importance_resample's result; no null keys."""
    (own,) = unused(docs, "drawn")
    keys = ranks.where("rank is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(broadcast_if_small(keys, 100_000), F.col(key) == F.col(own), "left_semi")

