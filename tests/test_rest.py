"""The REST data sources against a local server; runs of steps; the cache."""

import json
import threading
import time
from collections import Counter
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest

from tidewell.sources import requests, rest, steps


class Server:
    """Answers months up to ``published`` and weeks up to ``week``; fails each request ``faults`` times first."""

    def __init__(self):
        self.published, self.week, self.faults, self.broken = (2024, 3), "5.01.2024", 0, set()
        self.times, self.forms, self.tried, self.lock = [], [], Counter(), threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                form = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode(), keep_blank_values=True).items()}
                key = json.dumps(form, sort_keys=True)
                with outer.lock:
                    outer.times.append(time.monotonic())
                    outer.forms.append(form)
                    outer.tried[key] += 1
                    fail = outer.tried[key] <= outer.faults or form.get("tabloNo") in outer.broken
                self.send_response(503 if fail and form.get("tabloNo") not in outer.broken else 404 if fail else 200)
                self.end_headers()
                if not fail:
                    self.wfile.write(json.dumps(outer.body(form)).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def body(self, form):
        if "yil" in form:
            there = (int(form["yil"]), int(form["ay"])) <= self.published
            return {"Json": {"colModels": [{"name": "Ad"}, {"name": "Toplam"}], "colNames": ["", ""], "data": {"rows": [{"cell": ["x", "1"]}] if there else []}}}
        return {"Baslik": "Toplam", "XEkseni": ["29.12.2023", self.week, "odd"], "YEkseni": [1.0, 2.0, 3.0]}


@pytest.fixture
def server():
    s = Server()
    yield s
    s.server.shutdown()


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(rest.MonthlySource)
    spark.dataSource.register(rest.WeeklySource)
    return spark


def monthly(server, **more):
    return {"url": server.url, "tables": "1,4", "entities": "10001,10003", "first": "2024-01", "last": "2024-03", "rate": "200", "wait": "0.01", "today": "2024-04-20"} | more


def test_a_table_of_months(sources, server):
    got = sources.read.format("tidewell_monthly").options(**monthly(server)).load()
    rows = got.collect()
    assert len(rows) == 3 * 2 * 2 and {(r["year"], r["month"]) for r in rows} == {(2024, m) for m in (1, 2, 3)}
    assert all(r["error"] is None and r["tries"] == 1 and json.loads(r["response_json"])["Json"]["data"]["rows"] for r in rows)
    assert got.rdd.getNumPartitions() == 4
    assert {f["taraf[0]"] for f in server.forms} == {"10001", "10003"}


def test_passing_faults_are_tried_again_and_others_are_rows(sources, server):
    server.faults, server.broken = 2, {"4"}
    rows = sources.read.format("tidewell_monthly").options(**monthly(server, last="2024-01")).load().collect()
    assert {(r["table_number"], r["tries"], r["error"] is None) for r in rows} == {(1, 3, True), (4, 1, False)}
    assert all("404" in r["error"] and r["response_json"] is None for r in rows if r["table_number"] == 4)
    with pytest.raises(Exception, match="options missing: entities"):
        sources.read.format("tidewell_monthly").options(url=server.url, tables="1", first="2024-01").load().collect()


def test_the_rate_holds_with_four_tasks(sources, server):
    """24 requests at 20 a second take more than a second, and no stretch of a second has more than the rate."""
    server.faults = 1
    options = monthly(server, rate="20", groups="4", wait="0")
    sources.read.format("tidewell_monthly").options(**options).load().write.format("noop").mode("overwrite").save()
    t = sorted(server.times)
    assert len(t) == 24 and t[-1] - t[0] >= 23 / 20 * 0.9
    assert max(sum(a <= x < a + 1 for x in t) for a in t) <= 20 * 1.25


def test_paced_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    p = rest.Paced(2.0, 1.0, lambda: now[0], sleep)
    p.wait()
    now[0] += 0.5
    p.wait()
    now[0] += 10
    p.wait()
    p.wait()
    assert slept == [1.0, 1.5, 2.0]


def test_months():
    assert rest.months_after("2023-11", "2024-02") == [(2023, 12), (2024, 1), (2024, 2)] and rest.months_after("2024-02", "2024-02") == []
    assert rest.month_before("2024-01") == "2023-12" and rest.month_before("2024-10") == "2024-09"


def run_stream(spark, name, options, out, log):
    options = {k: v for k, v in options.items() if k != "last"}
    q = spark.readStream.format(name).options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out)


def test_a_stream_goes_on_from_its_offset(sources, server, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    got = run_stream(sources, "tidewell_monthly", monthly(server), out, log)
    assert sorted({(r["year"], r["month"]) for r in got.collect()}) == [(2024, 1), (2024, 2), (2024, 3)]  # April isn't published
    n = got.count()
    asked = len(server.forms)
    assert run_stream(sources, "tidewell_monthly", monthly(server), out, log).count() == n
    probes = server.forms[asked:]
    assert 0 < len(probes) <= 4 and {f["tabloNo"] for f in probes} == {"1"}  # probes only
    server.published = (2024, 4)
    asked = len(server.forms)
    got = run_stream(sources, "tidewell_monthly", monthly(server), out, log)
    assert got.count() == n + 4 and got.where("month = 4").count() == 4
    assert {f["ay"] for f in server.forms[asked:] if f["taraf[0]"] == "10003"} == {"4"}


def weekly(server, **more):
    return {"url": server.url, "items": "1.0.1:krediler,4.0.1", "first": "2023-12-01", "entities": "10001,10003", "rate": "200", "wait": "0.01", "today": "2024-01-06"} | more


def test_weeks(sources, server, tmp_path):
    rows = sources.read.format("tidewell_weekly").options(**weekly(server, last="2024-01-05", first="2023-09-01")).load().collect()
    assert len(rows) == 2 * 2 * 3 * 2 and {str(r["anchor"]) for r in rows} == {"2024-01-05", "2023-10-06"}
    assert {(r["item_id"], r["category"]) for r in rows} == {("1.0.1", "krediler"), ("4.0.1", "")}
    assert {r["bank_type_code"] for r in rows} == {"10001", "10007"} and {r["currency"] for r in rows} == {"TL", "FX", "TOTAL"}
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    assert run_stream(sources, "tidewell_weekly", weekly(server), out, log).count() == 12
    assert run_stream(sources, "tidewell_weekly", weekly(server), out, log).count() == 12
    server.week = "12.01.2024"
    got = run_stream(sources, "tidewell_weekly", weekly(server, today="2024-01-13"), out, log)
    assert got.count() == 24 and {str(r["anchor"]) for r in got.collect()} == {"2024-01-05", "2024-01-12"}


def test_steps_stop_at_a_failure_and_go_on_behind_it(spark, tmp_path):
    log, did, broken = str(tmp_path / "log"), [], [True]

    def weekly_step():
        if broken[0]:
            raise OSError("source is down")
        did.append("weekly")

    plan = [steps.Step("monthly", lambda: did.append("monthly") or 7), steps.Step("notify", lambda: 1 / 0, optional=True), steps.Step("weekly", weekly_step), steps.Step("snapshot", lambda: did.append("snapshot"))]
    with pytest.raises(steps.StepFailed, match="weekly: OSError: source is down"):
        steps.run_steps(spark, "2024-05", plan, log)
    assert did == ["monthly"]
    broken[0] = False
    assert steps.run_steps(spark, "2024-05", plan, log, skip=["notify"]) == ["weekly", "snapshot"] and did == ["monthly", "weekly", "snapshot"]
    assert steps.run_steps(spark, "2024-05", plan, log) == []
    told = {(r["step"], r["status"], r["detail"]) for r in steps.log_of(spark, log).collect()}
    assert ("monthly", "done", "None") not in told and ("monthly", "done", "7") in told and ("weekly", "failed", "OSError: source is down") in told and ("notify", "skipped", None) in told
    assert steps.run_steps(spark, "2024-06", plan[:1], log) == ["monthly"]
    with pytest.raises(ValueError, match="one name"):
        steps.run_steps(spark, "x", [plan[0], plan[0]], log)


def test_cache_age_and_switch(spark, tmp_path):
    made, now = [], [0.0]

    def make():
        made.append(1)
        if len(made) == 3:
            raise OSError("down")
        return spark.createDataFrame([("2024-01-01", float(len(made)))], "d string, value double").selectExpr("date(d) as date", "value")

    get = lambda: requests.cached(spark, str(tmp_path), ("k",), make, max_age=timedelta(hours=1), now=lambda: now[0]).first()["value"]
    now[0] = time.time()
    assert get() == 1.0 and get() == 1.0 and len(made) == 1
    now[0] += 7200
    assert get() == 2.0 and len(made) == 2
    now[0] += 7200
    assert get() == 2.0 and len(made) == 3  # the source is down: what there is stays in use
    spark.conf.set(requests.CACHE_SWITCH, "0")
    try:
        assert get() == 4.0 and get() == 5.0
    finally:
        spark.conf.unset(requests.CACHE_SWITCH)
    assert len(list(tmp_path.iterdir())) == 1
