"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

A document becomes a mask of the filters that it fails, and documents become counts per cell (part, mask, good, toxic):
all further work is on cells, of which a part has 4 * 2**filters at most. Each cell is unpivoted against the steps of all
orders, a running bit-or over the steps before tells whether an earlier filter has removed the cell, and conditional sums
and a total over each filter's rows give the figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import arrow_limits
from .words import Words, blocks

#: Filters in the order of their bits; SAME is the one that compares texts with each other.
FILTERS, SAME = "ABCDE", "E"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_SIGN = np.zeros(256, bool)
_SIGN[list(b"#$%&*|")] = True


def _distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text; of: offsets of the texts."""
    text = np.repeat(np.arange(of.size - 1), np.diff(of))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(h.size, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[fresh], minlength=of.size - 1)


def _mask(texts: pa.Array) -> pa.Array:
    out = [np.zeros(0, np.int64)]
    for _, block in blocks(texts):
        w = Words(block)
        total = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[w.texts])  # noqa: B023, E731
        n, distinct = np.diff(w.of), _distinct(w.hashes(), w.of)
        points, upper, signs = total((w.data & 0xC0) != 0x80), total((w.data >= 65) & (w.data <= 90)), total(_SIGN[w.data])
        fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * points, signs > 0)
        out.append(sum(f.astype(np.int64) << i for i, f in enumerate(fails)))
    return pa.array(np.concatenate(out), pa.int32())


def text_masks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bits of filters A to D for each text."""
    for texts in batches:
        yield _mask(texts)


def mask_cells(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: documents by the filters that they fail.

    Copies meet as counts: rows of one text, part and label are added up before they are shuffled, so a text of any
    number of copies is a few rows in its task. Texts are equal if their SHA-256 digests are.
    """
    arrow_limits(docs.sparkSession)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), digest.alias("digest"), F.arrow_udf(text_masks, "int")(F.col(text)).alias("mask"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # Rows of one id are one before the join, however many there are; null ids meet no label, and their texts spread them.
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = rows.join(marks.withColumn("_no", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (spread == F.col("_no")), "left").withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    # Of each text and label: all rows, those without an id, and those of the smallest id.
    by = ["digest", "part", "mask", "good", "toxic"]
    copies = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"))
    copies = rows_of_least(copies)
    same = 1 << FILTERS.index(SAME)
    cell = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(same)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("cell")
    return copies.select("part", "good", "toxic", cell).select("part", "good", "toxic", "cell.*").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def rows_of_least(copies: DataFrame) -> DataFrame:
    """copies with first: how many of its rows no smaller id's row equals. The window holds a text's parts and labels."""
    own = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    return copies.withColumn("first", F.col("no_id") + F.when(own, F.col("n_least")).otherwise(0))


def order_steps(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """cells unpivoted against the steps of all orders: with filter_order, step (from 1), filter, and its bit.

    The orders are a number that only the filters determine.
    """
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(filters))), " ")
    long = cells.select("*", F.explode(orders).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit = F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)")
    return long.select(*cells.columns, "filter_order", (F.col("at") + 1).alias("step"), "filter", bit.alias("bit"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the figures, from part, mask, good, toxic, n."""
    long = order_steps(cells, filters)
    before = W.partitionBy("part", "filter_order", "mask", "good", "toxic").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumns({"fails": F.col("mask").bitwiseAND(F.col("bit")) != 0, "gone": F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0)) != 0})
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    fails, gone = F.col("fails"), F.col("gone")
    removed = fails & ~gone
    figures = {"kept": ~fails & ~gone, "removed": removed, "redundant": fails & gone, "unique_fails": F.col("mask") == F.col("bit"), "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic")}
    out = long.groupBy("part", "filter_order", "step", "filter").agg(*(count(v).alias(k) for k, v in figures.items()))
    out = out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))
    return out.select("part", "filter_order", "step", "filter", *METRICS)


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order and step, zeros included. Null part: the empty string. Null text: empty. E compares ids:
    a row fails it if a row of a smaller id has its text, so rows of one id don't fail because of each other, and a null
    id neither fails nor makes others fail. Repeated rows count each. A document is good, or toxic, if any label row of
    its id says so; no label: neither. Empty docs: no rows. Further columns aren't read.
    """
    return audit(mask_cells(docs, labels, text, key, part))
