"""The whole update run: fetch what is new, merge it into the facts, bring the kept frames up to date, write a snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.extended import Store
from tidewell.plans.kept import KeptStore
from tidewell.sources import refresh, requests
from tidewell.sources.steps import Step, run_steps

#: Fact tables that frames are made of.
FACTS = ("balance_sheet", "loans")


def facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored fact tables that frames are made of, those that there are."""
    return {t: df for t in FACTS if (df := refresh.stored(spark, folder, t)) is not None}


def frames_updated(spark: SparkSession, folder: str, kept: KeptStore, entities: Iterable[str] | None = None) -> list[str]:
    """Brings kept up to date with the facts below folder; the parts written.

    The kept store's version says which versions of the facts it was made of, so what has changed since is known without
    reading them, and only that is computed again: after a lost driver as well.
    """
    tables = facts(spark, folder)
    if not tables:
        return []
    entities = None if entities is None else list(entities)
    store = Store(tables, entities) if entities is not None else Store(tables)
    parts = {t: refresh.parts_of(spark, folder, t) for t in tables}
    mark = {t: p.manifest()["number"] for t, p in parts.items()}
    made_of = kept.parts.manifest()["mark"]
    if not made_of or set(made_of) != set(mark):
        return kept.build(store, mark)
    months = {m for t, p in parts.items() for m in p.changed_since(made_of[t])}
    return kept.revise(store, [tuple(map(int, m.split("-"))) for m in months], mark)


def update(spark: SparkSession, run: str, folder: str, monthly_url: str, weekly_url: str, tables: Iterable[int], entities: Iterable[str], items: list[tuple[str, str]], today: date, at: datetime, snapshot_to: str | None = None, skip: Iterable[str] = (), tasks: int = 4, get: Callable = requests.opened, first: str = "2020-01-01") -> list[str]:
    """Runs the steps monthly, weekly, frames and snapshot, those not in skip; the names of those that ran.

    Facts, frames (frames/) and the log (log/) lie below folder. A step that fails stops the run; the same run again goes
    on with that step. Steps may be run again at any time: merging the same answers changes nothing.
    """
    folder = folder.rstrip("/")

    def monthly() -> dict[str, int]:
        have = refresh.stored(spark, folder, "balance_sheet")
        months = have.select(F.make_date("year", "month", F.lit(1)).alias("period")) if have is not None else spark.createDataFrame([], "period date")
        answers = refresh.parts_of(spark, folder, "answers").held(requests.monthly_update(months, today, monthly_url, tables, entities, tasks, get, first))
        return {t: len(m) for t, m in refresh.merge_monthly(answers, folder, at).items()}

    def weekly() -> int:
        have = refresh.stored(spark, folder, "weekly_series")
        answers = refresh.parts_of(spark, folder, "answers").held(refresh.weekly_update(have, today, weekly_url, items, tasks, get, spark=spark, first=first))
        return len(refresh.merge_weekly(answers, folder, at))

    steps = [Step("monthly", monthly), Step("weekly", weekly), Step("frames", lambda: len(frames_updated(spark, folder, KeptStore(spark, f"{folder}/frames"))))]
    if snapshot_to:
        steps.append(Step("snapshot", lambda: refresh.snapshot(spark, folder, snapshot_to, [*FACTS, "income_statement", "deposits", "financial_ratios", "other_data", "weekly_series"])))
    return run_steps(spark, run, steps, f"{folder}/log", skip)
