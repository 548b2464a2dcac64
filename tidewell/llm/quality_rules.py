"""Quality rules whose limits come from mergeable quantile sketches per language and source.

Counts per text are taken by one Arrow function. Each rate of a document goes into a sketch: an integer is rounded down
to its seven leading bits, and a sketch is the count per rounded value. Sketches merge by adding counts, so they are a
plain partial aggregation, give the same result in any order, and hold a quantile to within one part in 64. The limits
of a group are Tukey fences on its quartiles; a group of few documents takes the sketch merged over its language, and
failing that over everything. The limits are joined back and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import arrow_limits, broadcast_if_small, written
from .words import Words, blocks, shingles

COUNTS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that a group needs for limits of its own; multiple of the quartile distance; rows of limits to broadcast.
MIN_GROUP, FENCE, BROADCAST_ROWS = 50, 3, 20_000
#: Rate -> least quartile distance that counts, so that groups of nearly equal documents don't reject at random.
SPREAD = {"word_milli": 1000, "symbol_rate": 500, "dup_line_rate": 1000, "repeat_rate": 1000}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _lines(text: bytes, has_word) -> tuple[int, int]:
    seen, n, again = set(), 0, 0
    for line in text.split(b"\n"):
        if has_word(line):
            n += 1
            again += line in seen
            seen.add(line)
    return n, again


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """Words in windows of three that occur at least twice."""
    if windows.size < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    at = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
    covered = np.zeros(n_words, bool)
    for i in range(3):
        covered[at + i] = True
    return int(covered.sum())


def _counts(texts: pa.Array) -> pa.Array:
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for _, block in blocks(texts):
        w = Words(block)
        n = np.diff(w.of)
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        in_words = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
        three = shingles(w.hashes(), 3)
        lines, again, repeated = (np.zeros(len(w), np.int64) for _ in range(3))
        for k in range(len(w)):
            lines[k], again[k] = _lines(w.data[w.texts[k] : w.texts[k + 1]].tobytes(), bytes.split)
            repeated[k] = _repeated(three[w.of[k] : max(w.of[k], w.of[k + 1] - 2)], int(n[k]))
        for a, x in zip(out, (n, np.diff(in_words[w.of]), np.diff(symbols[w.texts]), lines, again, repeated)):
            a.append(x)
    names = [f.split(":")[0] for f in COUNTS[7:-1].split(",")]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in out], names=names)


def text_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _counts(texts)


def sketch_value(v: Column) -> Column:
    """v (a long of at least 0) rounded down to its seven leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(rates: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by..., rate, value, n: one sketch per group and rate."""
    long = rates.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("rate", "v"))
    return long.groupBy(*by, "rate", sketch_value(F.col("v")).alias("value")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rate", "value").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], **at: int) -> DataFrame:
    """by..., rate, total, and for each name=percent the least value with that percent of the rows at or below it.

    The window holds a sketch, whose values are bounded by 64 for each power of two.
    """
    w = W.partitionBy(*by, "rate")
    run = sketch.select(*by, "rate", "value", F.sum("n").over(w.orderBy("value")).alias("upto"), F.sum("n").over(w).alias("total"))
    return run.groupBy(*by, "rate").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("value"))).alias(k) for k, p in at.items()))


def _limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    q = quantiles(sketch, by, q1=25, q3=75)
    spread = F.greatest(F.col("q3") - F.col("q1"), F.create_map(*(F.lit(x) for kv in SPREAD.items() for x in kv))[F.col("rate")].cast("long")) * FENCE
    q = q.select(*by, "rate", "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    return q.groupBy(*by).agg(F.max("total").alias("n_docs"), *(F.max(F.when(F.col("rate") == r, F.col(e))).alias(f"{e}_{r}") for r in SPREAD for e in ("low", "high")))


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per input row: key, the counts, base_failed, lang, source, the rates, the group's limits, and kept.

    Null text: no words, so base_failed. Null language or source: a group of its own. Null key, repeated rows: kept as
    they are, each row counted. Documents that fail the base rules don't enter the sketches. Empty input: no rows.
    Further columns of docs are neither read nor returned.
    """
    arrow_limits(docs.sparkSession)
    base = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.arrow_udf(text_counts, COUNTS)(F.col(text)).alias("c")).select("doc_id", "lang", "source", "c.*")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    share = lambda part, whole, scale: F.coalesce(F.expr(f"({part} * {scale}) div nullif({whole}, 0)"), F.lit(0).cast("long"))
    base = base.withColumns({"word_milli": share("word_chars", "n_words", 1000), "symbol_rate": share("n_symbols", "word_chars", 10_000), "dup_line_rate": share("n_dup_lines", "n_lines", 10_000), "repeat_rate": share("n_repeat_words", "n_words", 10_000)})
    base = written(base, "quality")

    own = sketches(base.where(~F.col("base_failed")), ["lang", "source"], list(SPREAD))
    by_group, by_lang, overall = _limits(own, ["lang", "source"]), _limits(merged(own, ["lang"]), ["lang"]), _limits(merged(own, []), [])
    edges = [f"{e}_{r}" for r in SPREAD for e in ("low", "high")]
    groups = base.select("lang", "source").distinct().alias("k")
    groups = groups.join(by_group.alias("g"), F.expr("k.lang <=> g.lang and k.source <=> g.source"), "left").join(by_lang.alias("l"), F.expr("k.lang <=> l.lang"), "left").join(overall.alias("o"), F.lit(True), "left")
    level = F.when(F.col("g.n_docs") >= MIN_GROUP, 2).when(F.col("l.n_docs") >= MIN_GROUP, 1).otherwise(0)
    picked = [F.when(F.col("level") == 2, F.col(f"g.{e}")).when(F.col("level") == 1, F.col(f"l.{e}")).otherwise(F.col(f"o.{e}")).alias(e) for e in edges]
    limits = written(groups.withColumn("level", level).select(F.col("k.lang").alias("lang"), F.col("k.source").alias("source"), "level", *picked), "limits")

    t = broadcast_if_small(limits, BROADCAST_ROWS).alias("t")
    within = F.lit(True)
    for r in SPREAD:
        within = within & F.col(r).between(F.col(f"low_{r}"), F.col(f"high_{r}"))
    out = base.alias("b").join(t, F.expr("b.lang <=> t.lang and b.source <=> t.source"), "left")
    return out.select("b.*", "level", *edges, (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"))
