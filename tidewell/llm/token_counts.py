"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their number of tokens; everything else is answered by sums over that histogram, whose rows
are the distinct lengths and not the documents. Sums run within ranges of lengths and over the ranges' totals, so no task
has to hold all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import arrow_limits
from .bpe import codec

RANGE_BITS = 12


def length_histogram(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs. Null and empty texts have the length 0; repeated rows count each time; empty input: no rows."""
    arrow_limits(docs.sparkSession)

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            c = codec(path, pattern)
            yield pa.array([c.encode(t).size if t else 0 for t in texts.to_pylist()], pa.int64())

    return docs.select(F.arrow_udf(lengths, "bigint")(F.col(text)).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs: n_docs of that length, docs and tokens in documents of at least L, and
    truncated_tokens, the tokens left when every document is cut to L.

    Between two lengths that occur, docs_at_least of the next larger length holds, and the truncated total grows by it
    for each token of the limit; see at_limits.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_all"), F.shiftright("n_tokens", RANGE_BITS).alias("part"))
    later = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_all").alias("t"))
    all_tokens = h.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("total_tokens"))
    parts = parts.select("part", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"))
    within = W.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = h.join(parts, "part").select("n_tokens", "n_docs", (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_at_least"), (F.sum("n_all").over(within) + F.col("later_tokens")).alias("tokens_at_least"))
    cut = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.crossJoin(F.broadcast(all_tokens)).select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), "total_tokens")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, truncated_tokens for any stated limits, whether or not a document has that length."""
    cut = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens")) for x in limits]
    return sums.agg(F.array(*cut).alias("a")).select(F.inline("a"))


def with_quantiles(sums: DataFrame, percents: list[int]) -> DataFrame:
    """sums with quantile_of, the percents whose quantile the length is (ascending, mostly none), and context_share, the
    share of documents that a context of the length holds whole, to 6 digits. Percents from 1 to 100."""
    n = F.broadcast(sums.agg(F.max("docs_at_least").alias("_n")))  # one row
    above, at_most = F.col("docs_at_least") - F.col("n_docs"), F.col("_n") - F.col("docs_at_least") + F.col("n_docs")
    # The least length that so many percent don't exceed: they reach it, and don't reach the length before.
    is_quantile = lambda p: (at_most * 100 >= F.col("_n") * p) & ((at_most - F.col("n_docs")) * 100 < F.col("_n") * p)
    quantile_of = F.filter(F.array(*(F.when(is_quantile(p), F.lit(p)) for p in percents)), lambda p: p.isNotNull())
    return sums.crossJoin(n).withColumns({"quantile_of": quantile_of, "context_share": F.round((F.col("_n") - above) / F.col("_n"), 6)}).drop("_n")


def length_quantiles(sums: DataFrame, percents: list[int]) -> DataFrame:
    """percent, n_tokens: the least length that at least so many percent of the documents don't exceed; null without documents."""
    total = F.max("docs_at_least")
    upto = sums.select("n_tokens", (F.col("docs_at_least") - F.col("n_docs")).alias("above"))
    n = sums.agg(total.alias("n"))
    picks = [F.struct(F.lit(p).alias("percent"), F.min(F.when((F.col("n") - F.col("above")) * 100 >= F.col("n") * p, F.col("n_tokens"))).alias("n_tokens")) for p in percents]
    return upto.crossJoin(F.broadcast(n)).agg(F.array(*picks).alias("a")).select(F.inline("a"))
