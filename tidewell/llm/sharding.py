"""Shards of equal row counts that keep linked documents together: balanced label propagation on Spark joins.

Documents with equal texts are linked. All that a document's neighbours can tell it is how many of them each shard holds,
and linked documents are alike, so the state of the propagation is the count per (group, shard): a group of any size is
one row per shard. In each round a group's rows move towards the shards that hold most of it, as far as those shards'
quotas allow; quotas are shared out by running sums within buckets. When no row moves, or after the last round, what is
over a quota and the documents without links fill the shards up to counts that differ by one at most. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import running_start, written

SHARDS, ROUNDS, CELL_ROWS = 40, 8, 5_000


def _by_shard(values: list[int], shard: str) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col(shard) + 1).cast("long")


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Rows per shard; the driver gets one number for each shard."""
    got = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def propagate(state: DataFrame, quotas: list[int], buckets: int) -> tuple[DataFrame, int]:
    """One round on state (g, shard, n): the new state, and how many documents moved."""
    room = [q - n for q, n in zip(quotas, _loads(state, len(quotas)))]
    # A group's homes: first a shard that has room for all of it, then those that hold most, as many as have room for it.
    sized = state.withColumns({"free": F.greatest(_by_shard(room, "shard"), F.lit(0)), "whole": F.sum("n").over(W.partitionBy("g"))})
    sized = sized.withColumn("fits", F.col("n") + F.col("free") >= F.col("whole"))
    order = W.partitionBy("g").orderBy(F.desc("fits"), F.desc("n"), "shard")
    holds = F.coalesce(F.sum(F.col("n") + F.col("free")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sized.withColumns({"rank": F.row_number().over(order), "home": holds < F.col("whole")})
    homes = ranked.where("home and free > 0").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("rank", "shard"))).alias("homes"))
    away = ranked.where("not home").join(homes, "g")
    moves = away.withColumn("to", F.element_at("homes", (F.col("rank") % F.size("homes") + 1).cast("int"))["shard"]).withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    moves = running_start(moves, "n", "before", "cell", ["g", "shard"], ["to"])
    moves = written(moves.withColumn("moved", F.greatest(F.least("n", _by_shard(room, "to") - F.col("before")), F.lit(0))).where("moved > 0").select("g", "shard", "to", "moved"), "shard-moves")
    total = moves.agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("n")).first()["n"]
    change = moves.select("g", F.inline(F.array(F.struct("shard", (-F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))))
    return written(state.unionByName(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-state"), int(total)


def _settled(state: DataFrame, quotas: list[int], buckets: int) -> tuple[DataFrame, list[int]]:
    """(g, shard, n) within the quotas exactly, and how many documents without links each shard takes."""
    cells = running_start(state.withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(buckets))), "n", "before", "cell", ["g"], ["shard"])
    stays = F.greatest(F.least("n", _by_shard(quotas, "shard") - F.col("before")), F.lit(0))
    cells = written(cells.select("g", "shard", stays.alias("n"), (F.col("n") - stays).alias("over"), "cell"), "shard-settled")
    left = [q - n for q, n in zip(quotas, _loads(cells, len(quotas)))]
    over = cells.where("over > 0").groupBy("g", "cell").agg(F.sum("over").alias("over"))
    n_over = over.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("n")).first()["n"]
    gaps, at = [], 0
    for s, n in enumerate(left):
        gaps.append((s, at, at + n))
        at += n
    over = running_start(over, "over", "lo", "cell", ["g"])
    spans = F.array(*(F.struct(F.lit(s).alias("shard"), (F.least(F.col("lo") + F.col("over"), F.lit(b)) - F.greatest("lo", F.lit(a))).alias("n")) for s, a, b in gaps))
    placed = over.select("g", F.inline(spans)).where("n > 0")
    state = cells.select("g", "shard", "n").unionByName(placed).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")
    return state, [max(0, b - max(a, n_over)) for _, a, b in gaps]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law): one row per input row.

    Counts of shards differ by one at most. Which of equal rows, or of rows without links, goes to which shard and slot
    depends on how the input is dealt to files: this law doesn't promise the same shard twice. Null text: size 16, the checksum of no bytes, no links. Null keys and
    repeated rows are rows like others, repeated rows being linked by their text. Empty input: no rows. Further columns
    aren't read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"), F.md5(F.col(text).cast("binary")).alias("g"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    buckets = max(1, total // CELL_ROWS)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    groups = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n_group")).where("n_group > 1")
    linked = written(rows.join(groups, "g", "left_semi").select("row", "g"), "shard-linked")
    state = written(linked.groupBy("g", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")), "shard-state")
    for _ in range(rounds):
        state, moved = propagate(state, quotas, buckets)
        if not moved:
            break
    state, free = _settled(state, quotas, buckets)

    ahead = W.partitionBy("g").orderBy("shard")
    ranges = state.select("g", "shard", (F.sum("n").over(ahead) - F.col("n")).alias("lo")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("lo", "shard"))).alias("ranges"))
    cell = F.pmod(F.xxhash64("row"), F.lit(buckets))
    one = F.lit(1).cast("long")
    ranks = _placed(linked.withColumn("cell", cell), ranges)
    bounds, at = [], 0
    for n in free:
        at += n
        bounds.append(at)
    singles = running_start(rows.join(linked, "row", "left_anti").select("row").withColumns({"cell": cell, "one": one}), "one", "rank", "cell", ["row"])
    singles = singles.select("row", F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= F.col("rank"))).alias("shard"))
    shard_of = written(ranks.unionByName(singles), "shard-of").withColumns({"cell": cell, "one": one})
    slots = running_start(shard_of, "one", "slot", "cell", ["row"], ["shard"]).select("row", "shard", "slot")
    return rows.join(slots, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _placed(linked: DataFrame, ranges: DataFrame) -> DataFrame:
    """row, shard: each group's rows dealt out to its ranges by their rank. Joined by (group, cell), which spreads a
    large group over the cells."""
    cells = linked.groupBy("g", "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy("g").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("g", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(ranges, "g")
    local = F.row_number().over(W.partitionBy("g", "cell").orderBy("row")) - 1
    rank = F.col("base") + F.col("local")
    return linked.select("row", "g", "cell", local.alias("local")).join(cells, ["g", "cell"]).select("row", F.element_at(F.filter("ranges", lambda x: x["lo"] <= rank), -1)["shard"].alias("shard"))
