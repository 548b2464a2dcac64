"""Update runs of several steps: each is logged, a failed one stops those behind it, and a later run goes on from there."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.ingest import append_log

LOG = "run string, step string, status string, started timestamp, ended timestamp, detail string"


@dataclass(frozen=True)
class Step:
    """name, and what it does; its result, as text, is kept in the log. optional: its failure doesn't stop the run."""

    name: str
    do: Callable[[], object]
    optional: bool = False


class StepFailed(RuntimeError):
    """A step that stopped its run."""


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """All steps of all runs; without rows before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LOG).parquet(path) if there else spark.createDataFrame([], LOG)


def run_steps(spark: SparkSession, run: str, steps: Iterable[Step], log: str, skip: Iterable[str] = (), now: Callable[[], datetime] = datetime.now) -> list[str]:
    """Runs the steps in order; the names of those that ran. A step that the log has as done for this run, and those named
    in skip, are left out, so a run that broke off goes on behind its last step. Raises StepFailed after logging it."""
    steps, skip = list(steps), set(skip)
    if len({s.name for s in steps}) != len(steps):
        raise ValueError("two steps of one name")
    done = {r["step"] for r in log_of(spark, log).where("status = 'done'").where(f"run = '{run}'").select("step").collect()}
    ran = []
    for s in steps:
        if s.name in done:
            continue
        began = now()
        if s.name in skip:
            status, detail = "skipped", None
        else:
            try:
                status, detail = "done", str(s.do())
                ran.append(s.name)
            except Exception as fault:  # noqa: BLE001 - whatever it is, it is logged before it stops the run
                status, detail = "failed", f"{type(fault).__name__}: {fault}"
        append_log(spark.createDataFrame([(run, s.name, status, began, now(), detail)], LOG), log)
        if status == "failed" and not s.optional:
            raise StepFailed(f"{s.name}: {detail}")
    return ran
