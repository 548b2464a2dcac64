"""The monthly and the weekly source as Spark data sources, for tables and for streams.

    spark.dataSource.register(MonthlySource)
    spark.read.format("tidewell_monthly").options(url=..., tables="1,2", entities="10001", first="2024-01", last="2024-06").load()
    spark.readStream.format("tidewell_monthly").options(url=..., tables="1,2", entities="10001", first="2024-01").load()

A partition is a group of requests. ``rate`` is the number of requests a second of all tasks together: with g groups each
spaces its own requests, retries among them, by g / rate, and the groups begin 1 / rate after each other. A stream's
offset is the last published month or week, found by small requests from today backwards; it reads what lies after the
offset of the batch before. A request that fails for good is a row with its error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewell.sources.ingest import WEEKLY_CODES, weekly_anchors
from tidewell.sources.requests import answer, opened

DEFAULTS = {"rate": "2", "groups": "4", "tries": "5", "wait": "2", "timeout": "30", "currencies": "TL", "columns": "1,2,3", "probe_months": "24"}


@dataclass
class Group(InputPartition):
    """Requests that one task makes: each the row's leading values, and the form."""

    number: int
    requests: list[tuple[tuple, dict[str, str]]]


class Paced:
    """Calls spaced by an interval, the first one after ``start`` seconds."""

    def __init__(self, interval: float, start: float = 0.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.due = clock() + start

    def wait(self) -> None:
        now = self.clock()
        if now < self.due:
            self.sleep(self.due - now)
        self.due = max(self.due, now) + self.interval


class _Requests:
    """What readers of both sources share: options, groups, and the requests of a group."""

    def __init__(self, options: dict[str, str]):
        missing = [k for k in self.needs if k not in options]
        if missing:
            raise ValueError(f"options missing: {', '.join(missing)}")
        self.options = DEFAULTS | dict(options)
        self.url, self.timeout = self.options["url"], float(self.options["timeout"])
        self.groups, self.rate = int(self.options["groups"]), float(self.options["rate"])
        self.tries, self.wait = int(self.options["tries"]), float(self.options["wait"])
        if self.groups < 1 or self.rate <= 0:
            raise ValueError("groups and rate must be positive")

    def listed(self, name: str) -> list[str]:
        return [x.strip() for x in self.options[name].split(",") if x.strip()]

    def today(self) -> date:
        return date.fromisoformat(self.options["today"]) if "today" in self.options else date.today()

    def dealt(self, requests: list[tuple[tuple, dict[str, str]]]) -> list[Group]:
        """Every g-th request to a group, so that groups are of one length; none without requests."""
        return [Group(k, requests[k :: self.groups]) for k in range(min(self.groups, len(requests)))]

    def read(self, partition: Group) -> Iterator[tuple]:
        pace = Paced(self.groups / self.rate, partition.number / self.rate)

        def get(form: dict[str, str]) -> bytes:
            pace.wait()
            return opened(self.url, form, self.timeout)

        for row, form in partition.requests:
            yield (*row, *answer(lambda f=form: get(f), self.tries, self.wait))

    def probe(self, form: dict[str, str]) -> dict:
        """The answer to one small request; nothing if it fails, as if it weren't published yet."""
        text, _, _ = answer(lambda: opened(self.url, form, self.timeout), self.tries, self.wait)
        return json.loads(text) if text else {}


def months_after(start: str, end: str) -> list[tuple[int, int]]:
    """(year, month) after start up to end, both 'yyyy-mm'."""
    (y, m), last = map(int, start.split("-")), tuple(map(int, end.split("-")))
    out = []
    while (y, m) < last:
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
        out.append((y, m))
    return out


def month_before(text: str) -> str:
    y, m = map(int, text.split("-"))
    return f"{y - (m == 1):04d}-{12 if m == 1 else m - 1:02d}"


class _Monthly(_Requests):
    needs = ("url", "tables", "entities", "first")

    def form(self, table: str, year: int, month: int, currency: str, entity: str) -> dict[str, str]:
        # Field names of the form.
        return {"tabloNo": table, "yil": str(year), "ay": str(month), "paraBirimi": currency, "taraf[0]": entity}

    def of(self, start: str, end: str) -> list[Group]:
        """The requests of the months after start up to end."""
        each = [(t, y, m, c, e) for y, m in months_after(start, end) for t in self.listed("tables") for c in self.listed("currencies") for e in self.listed("entities")]
        return self.dealt([((y, m, int(t), c, e), self.form(t, y, m, c, e)) for t, y, m, c, e in each])

    def published(self, floor: str) -> str:
        """The last month, not after today and after floor, for which the first table has rows; floor if none has."""
        month = f"{self.today():%Y-%m}"
        for _ in range(int(self.options["probe_months"])):
            if month <= floor:
                return floor
            y, m = map(int, month.split("-"))
            got = self.probe(self.form(self.listed("tables")[0], y, m, self.listed("currencies")[0], self.listed("entities")[0]))
            if ((got.get("Json") or {}).get("data") or {}).get("rows"):
                return month
            month = month_before(month)
        return floor


class MonthlyReader(_Monthly, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.of(month_before(self.options["first"]), self.options.get("last") or f"{self.today():%Y-%m}")


class MonthlyStream(_Monthly, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"month": month_before(self.options["first"])}

    def latestOffset(self) -> dict:
        # Never back: a source that is down isn't one that has taken months back.
        floor = getattr(self, "_seen", self.initialOffset()["month"])
        self._seen = self.published(floor)
        return {"month": self._seen}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return self.of(start["month"], end["month"])

    def commit(self, end: dict) -> None:
        self._seen = max(end["month"], getattr(self, "_seen", end["month"]))


class MonthlySource(DataSource):
    """Options: url, tables, entities, first; last, currencies, rate, groups, tries, wait, timeout, today, probe_months."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_monthly"

    def schema(self) -> str:
        return "year int, month int, table_number int, currency string, bank_type_code string, response_json string, error string, tries int"

    def reader(self, schema) -> MonthlyReader:
        return MonthlyReader(self.options)

    def streamReader(self, schema) -> MonthlyStream:
        return MonthlyStream(self.options)


class _Weekly(_Requests):
    needs = ("url", "items", "first")
    #: What the source's columns hold.
    KINDS = {"1": "TL", "2": "FX", "3": "TOTAL"}

    def form(self, anchor: date, item: str, column: str, source_code: str) -> dict[str, str]:
        # Field names of the form and its constants.
        return {"dil": "tr", "tarih": f"{anchor:%d.%m.%Y}", "id": item, "parabirimi": "TRY", "sutun": column, "tarafKodu": source_code, "gun": "90"}

    def of(self, start: str, end: str) -> list[Group]:
        """Windows of 13 weeks back from end until they reach start: the week of start is asked for again, as weeks are
        revised. items: id or id:category."""
        codes = self.listed("entities") if "entities" in self.options else list(WEEKLY_CODES)
        items = [(x.split(":") + [""])[:2] for x in self.listed("items")]
        anchors = [] if end <= start else weekly_anchors(date.fromisoformat(end), date.fromisoformat(start))
        each = [(a, i, k, c, e) for a in anchors for i, k in items for c in self.listed("columns") for e in codes]
        return self.dealt([((a, i, k, self.KINDS[c], WEEKLY_CODES[e]), self.form(a, i, c, e)) for a, i, k, c, e in each])

    def published(self, floor: str) -> str:
        """The last week that the first item has for the sector; floor if that isn't later."""
        got = self.probe(self.form(self.today(), self.listed("items")[0].split(":")[0], "3", "10001")).get("XEkseni") or []
        days = []
        for text in got:
            parts = str(text).split(".")
            if len(parts) == 3 and all(p.isdigit() for p in parts):
                days.append(f"{int(parts[2]):04d}-{int(parts[1]):02d}-{int(parts[0]):02d}")
        return max([floor, *days])


class WeeklyReader(_Weekly, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.of(self.options["first"], self.options.get("last") or self.today().isoformat())


class WeeklyStream(_Weekly, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"week": self.options["first"]}

    def latestOffset(self) -> dict:
        self._seen = self.published(getattr(self, "_seen", self.initialOffset()["week"]))
        return {"week": self._seen}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return self.of((date.fromisoformat(start["week"]) - timedelta(weeks=int(self.options.get("again_weeks", "0")))).isoformat(), end["week"])

    def commit(self, end: dict) -> None:
        self._seen = max(end["week"], getattr(self, "_seen", end["week"]))


class WeeklySource(DataSource):
    """Options: url, items, first; last, entities, columns, again_weeks (weeks before the offset that are asked for again),
    rate, groups, tries, wait, timeout, today."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_weekly"

    def schema(self) -> str:
        return "anchor date, item_id string, category string, currency string, bank_type_code string, response_json string, error string, tries int"

    def reader(self, schema) -> WeeklyReader:
        return WeeklyReader(self.options)

    def streamReader(self, schema) -> WeeklyStream:
        return WeeklyStream(self.options)
