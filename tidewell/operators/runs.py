"""Stretches of one sign in a series: when a balance was positive, when negative, how long, and how far it went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def signed_runs(df: DataFrame, by: list[str], order: str = "date", value: str = "value", cut: str = "month") -> DataFrame:
    """by..., sign (-1, 0, 1), start, end, n, peak, peak_at, open: one row for each stretch of rows of one sign.

    peak: the value furthest from 0, with the earliest date that has it. open: the series ends with the stretch. Nulls of
    value or order don't count, nor do they end a stretch; rows of one date follow each other by value.

    The series is cut by ``cut`` (a unit of trunc). Windows number the stretches within a part; only the first and last
    stretch of each part can go on beyond it, so a window over those, two for each part, joins them. No window holds a
    whole series.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumns({"_part": F.trunc(F.col("_o").cast("date"), cut), "_s": F.signum("_v").cast("int")})
    w = W.partitionBy(*by, "_part").orderBy("_o", "_v")
    rows = rows.withColumn("_new", F.coalesce((F.lag("_s").over(w) != F.col("_s")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    furthest = F.max(F.struct(F.abs("_v").alias("a"), (-F.unix_micros(F.col("_o").cast("timestamp"))).alias("t"), F.col("_v").alias("v"), F.col("_o").alias("o")))
    stats = {"start": F.min("start"), "end": F.max("end"), "n": F.sum("n"), "top": F.max("top")}
    runs = rows.groupBy(*by, "_part", "_run").agg(F.first("_s").alias("sign"), F.min("_o").alias("start"), F.max("_o").alias("end"), F.count("*").alias("n"), furthest.alias("top"))
    runs = runs.withColumn("_last", F.max("_run").over(W.partitionBy(*by, "_part")))

    inner = runs.where((F.col("_run") > 0) & (F.col("_run") < F.col("_last"))).select(*by, "sign", *stats, F.lit(False).alias("open"))
    # Edge stretches in order: a new group begins with another sign, or with the part's second edge.
    edges = runs.where((F.col("_run") == 0) | (F.col("_run") == F.col("_last")))
    along = W.partitionBy(*by).orderBy("_part", "_run")
    starts = F.coalesce((F.lag("sign").over(along) != F.col("sign")) | (F.lag("_part").over(along) == F.col("_part")), F.lit(True))
    edges = edges.withColumn("_g", F.sum(starts.cast("int")).over(along)).withColumn("_end", F.lead("_part").over(along).isNull())
    joined = edges.groupBy(*by, "_g").agg(F.first("sign").alias("sign"), *(v.alias(k) for k, v in stats.items()), F.max("_end").alias("open")).drop("_g")
    return inner.unionByName(joined).select(*by, "sign", "start", "end", "n", F.col("top.v").alias("peak"), F.col("top.o").alias("peak_at"), "open")
