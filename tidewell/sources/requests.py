"""Request plans and staged fetches: a plan is a frame, fetching is a map over it, answers are raw rows to be parsed.

Base addresses are parameters. A failed request is a row with its error, so one series doesn't stop the others.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.ingest import WEEKLY_CODES, missing_months, windows

#: An answer's columns behind those of the plan.
ANSWER = "response_json string, error string, tries int"


def monthly_plan(months: DataFrame, tables: Iterable[int], entities: Iterable[str], url: str, currencies: Iterable[str] = ("TL",)) -> DataFrame:
    """One request for each month of months (period), table, currency and entity: year, month, table_number, currency,
    bank_type_code, url, form."""
    each = lambda name, values: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    plan = months.select(F.year("period").alias("year"), F.month("period").alias("month"), each("table_number", tables))
    plan = plan.select("*", each("currency", currencies)).select("*", each("bank_type_code", entities))
    text = lambda c: F.col(c).cast("string")
    # Field names of the form.
    form = F.create_map(F.lit("tabloNo"), text("table_number"), F.lit("yil"), text("year"), F.lit("ay"), text("month"), F.lit("paraBirimi"), F.col("currency"), F.lit("taraf[0]"), F.col("bank_type_code"))
    return plan.withColumns({"url": F.lit(url), "form": form})


def weekly_plan(anchors: DataFrame, items: Iterable[tuple[str, str]], url: str, entities: Iterable[str] = tuple(WEEKLY_CODES), columns: Iterable[int] = (1, 2, 3)) -> DataFrame:
    """One request for each anchor date, item (id, category), source entity and column: anchor, item_id, category, column,
    currency, source_code, bank_type_code, url, form."""
    each = lambda name, values: F.explode(F.array(*values)).alias(name)
    plan = anchors.select("anchor", each("item", [F.struct(F.lit(i).alias("item_id"), F.lit(c).alias("category")) for i, c in items]))
    plan = plan.select("anchor", "item.*", each("column", map(F.lit, columns))).select("*", each("source_code", map(F.lit, entities)))
    codes = F.create_map(*(F.lit(x) for kv in WEEKLY_CODES.items() for x in kv))
    # What the columns hold, field names of the form and its constants.
    kinds = F.element_at(F.array(F.lit("TL"), F.lit("FX"), F.lit("TOTAL")), F.col("column"))
    form = {"dil": F.lit("tr"), "tarih": F.date_format("anchor", "dd.MM.yyyy"), "id": F.col("item_id"), "parabirimi": F.lit("TRY"), "sutun": F.col("column").cast("string"), "tarafKodu": F.col("source_code"), "gun": F.lit("90")}
    return plan.withColumns({"currency": kinds, "bank_type_code": F.element_at(codes, F.col("source_code")), "url": F.lit(url), "form": F.create_map(*(x for k, v in form.items() for x in (F.lit(k), v)))})


def series_plan(spark: SparkSession, series: dict[str, str], start: date, end: date, url: str, frequency: int | None = None, aggregation: str = "avg") -> DataFrame:
    """One request for each series (label -> code) and part of the range: label, code, start, end, url, no form.

    The end is moved back to a Saturday, so that plans of one week are the same.
    """
    parts = windows(start, end - timedelta(days=(end.weekday() - 5) % 7))
    more = (f"&frequency={frequency}" if frequency is not None else "") + (f"&aggregationTypes={aggregation}" if aggregation else "")
    rows = [(label, code, a, b, f"{url}/series={code}&startDate={a:%d-%m-%Y}&endDate={b:%d-%m-%Y}&type=json{more}") for label, code in series.items() for a, b in parts]
    return spark.createDataFrame(rows, "label string, code string, start date, end date, url string").withColumn("form", F.lit(None).cast("map<string,string>"))


def opened(url: str, form: dict[str, str] | None, timeout: float = 30.0) -> bytes:
    from urllib.request import Request, urlopen

    data = urlencode(form).encode() if form else None
    with urlopen(Request(url, data=data), timeout=timeout) as answer:
        return answer.read()


def passing(fault: Exception) -> bool:
    """Whether a fault may pass: no connection, a timeout, or a server's 500, 502 or 503."""
    code = getattr(fault, "code", None)
    return code in (500, 502, 503) if code is not None else isinstance(fault, OSError)


def answer(get: Callable[[], bytes], tries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(JSON text, error, tries): passing faults are tried again after doubled waits, others not."""
    for i in range(1, tries + 1):
        try:
            text = get().decode()
            json.loads(text)
            return text, None, i
        except Exception as fault:  # noqa: BLE001 - whatever it is, it becomes this request's row
            if i == tries or not passing(fault):
                return None, f"{type(fault).__name__}: {fault}", i
            sleep(wait * 2 ** (i - 1))
    return None, "no tries", 0


def fetched_plan(plan: DataFrame, tasks: int, get: Callable[[str, dict | None], bytes] = opened, tries: int = 5, wait: float = 2.0, pause: float = 0.5) -> DataFrame:
    """The plan's rows with response_json, error and tries, fetched by ``tasks`` tasks, each with a pause between requests.

    Write the result before it is read twice: every reading fetches again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema if f.name not in ("url", "form"))
    columns = [c for c in plan.columns if c not in ("url", "form")]

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for i, (url, form) in enumerate(zip(frame["url"], frame["form"])):
                if i and pause:
                    time.sleep(pause)
                got.append(answer(lambda u=url, f=form: get(u, dict(f) if f is not None else None), tries, wait))
            out = frame[columns].copy()
            out["response_json"], out["error"], out["tries"] = ([g[k] for g in got] for k in range(3))
            yield out

    return plan.repartition(tasks).mapInPandas(fetch, f"{schema}, {ANSWER}")


def published(months: DataFrame, url: str, get: Callable[[str, dict | None], bytes] = opened, table_number: int = 1, entity: str = "10001") -> DataFrame:
    """The months (period) for which one small request answers with rows. Raises OSError if requests fail and none
    answers with rows: then nothing is known, which isn't the same as nothing new."""
    rows = F.get_json_object("response_json", "$.Json.data.rows[0]").isNotNull()
    got = fetched_plan(monthly_plan(months, [table_number], [entity], url), 1, get)
    got = got.select(F.make_date("year", "month", F.lit(1)).alias("period"), rows.alias("there"), "error").collect()  # a row for each month
    failed = [r["error"] for r in got if r["error"] is not None]
    if failed and not any(r["there"] for r in got):
        raise OSError(f"{len(failed)} of {len(got)} requests failed: {failed[0]}")
    return months.sparkSession.createDataFrame([(r["period"],) for r in got if r["there"]], "period date")


def monthly_update(have: DataFrame, today: date, url: str, tables: Iterable[int], entities: Iterable[str], tasks: int, get: Callable[[str, dict | None], bytes] = opened, first: str = "2020-01-01") -> DataFrame:
    """Raw answers for the months after the latest one of have (period) up to today that are published."""
    last = have.agg(F.max("period").alias("p")).first()["p"]
    start = date.fromisoformat(first) if last is None else (last.replace(day=1) + timedelta(days=32)).replace(day=1)
    spark = have.sparkSession
    if start > today:
        return fetched_plan(monthly_plan(have.limit(0).select(F.col("period").cast("date").alias("period")), tables, entities, url), 1, get)
    candidates = missing_months(spark.createDataFrame([], "period date"), start.isoformat(), today.replace(day=1).isoformat())
    return fetched_plan(monthly_plan(published(candidates, url, get), tables, entities, url), tasks, get)


def logged(answers: DataFrame) -> DataFrame:
    """The download log of fetched answers: the plan's columns, status, error_message, tries."""
    status = F.when(F.col("error").isNotNull(), "error").otherwise("success")
    return answers.withColumn("status", status).withColumnRenamed("error", "error_message").drop("response_json")


#: Set to 0, false or no, it turns the cache off for a session.
CACHE_SWITCH = "spark.tidewell.cache"


def cached(spark: SparkSession, folder: str, key: tuple, make: Callable[[], DataFrame], schema: str = "date date, value double", max_age: timedelta | None = None, now: Callable[[], float] = time.time) -> DataFrame:
    """make() once for each key: later calls read the JSON that the first one left in folder/<hash of the key>.

    max_age: an answer that is older is made again; one that can't be made again then stays in use. Only a write that
    ended counts, and an answer is replaced by a new folder, so that readers of the old one aren't disturbed. Snap
    volatile parts of the key, as series_plan does, or every day misses. With CACHE_SWITCH off, make() is called and
    nothing is read or kept.
    """
    if (spark.conf.get(CACHE_SWITCH, None) or "1").lower() in ("0", "false", "no"):
        return make()
    jvm, name = spark._jvm, hashlib.sha256(repr(key).encode()).hexdigest()[:16]
    top = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = [jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS") for f in files.listStatus(top) if f.isDirectory()] if files.exists(top) else []
    ready = sorted((files.getFileStatus(m).getModificationTime() / 1000, m.getParent().toString()) for m in marks if files.exists(m))
    if not ready or max_age is not None and now() - ready[-1][0] > max_age.total_seconds():
        path = f"{folder.rstrip('/')}/{name}/{time.time_ns():020d}"
        try:
            make().write.option("ignoreNullFields", False).json(path)
            ready.append((0, path))
        except Exception:
            if not ready:
                raise
    return spark.read.schema(schema).json(ready[-1][1])
