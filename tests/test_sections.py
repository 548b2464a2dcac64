"""Signed stretches, stream windows with late rows, margin parts, and the whole update run."""

import datetime as dt
import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators.runs import signed_runs
from tidewell.plans import extended as X
from tidewell.plans import update as U
from tidewell.plans.kept import KeptStore
from tidewell.queries import core, sections, sheets
from tidewell.sources import refresh, steps
from tidewell.streaming import windows

SF = "/root/testdata/sf0.001"


def slow_runs(rows):
    out = []
    for key in sorted({k for k, _, _ in rows}):
        own = sorted((d, v) for k, d, v in rows if k == key and v is not None and d is not None)
        runs = []
        for d, v in own:
            s = (v > 0) - (v < 0)
            if runs and runs[-1][0] == s:
                runs[-1][1].append((d, v))
            else:
                runs.append((s, [(d, v)]))
        for i, (s, part) in enumerate(runs):
            d, v = max(part, key=lambda x: (abs(x[1]), -x[0].toordinal()))
            out.append((key, s, part[0][0], part[-1][0], len(part), v, d, i == len(runs) - 1))
    return sorted(out, key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.sampled_from([-2.0, -1.0, 0.0, 1.0, 2.0, None])), max_size=60))
def test_signed_runs(spark, rows):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=d), v) for k, d, v in rows] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, date date, value double")
    assert sorted((tuple(r) for r in signed_runs(df, ["k"]).collect()), key=str) == slow_runs(rows)


def test_no_window_holds_a_series(spark):
    """Windows run within a part; over parts only their edge stretches meet."""
    plan = signed_runs(spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, date date, value double"), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    parts = [(line, re.search(r"\], \[([^\[\]]*)\](, \[[^\[\]]*\])?$", line.strip())[1]) for line in plan.splitlines() if "Window [" in line]
    assert len(parts) >= 4
    for line, partition in parts:
        assert "_part#" in partition or "lag(_s#" not in line and "_new#" not in line


def events(spark, rows, path):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), u, "x", v) for i, (h, u, v) in enumerate(rows)], windows.EVENT)
    df.coalesce(1).write.mode("append").option("timestampFormat", windows.TIME).json(path)


def test_windows_with_late_rows(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))

    def run():
        windows.closed_windows(spark, source, out, log)
        return {(r["start"].day, r["n"], r["total"]) for r in spark.read.parquet(out).collect()}

    events(spark, [(1, 1, 1.0), (20, 1, 2.0)], source)
    assert run() == set()  # the day is open
    events(spark, [(3, 1, 4.0), (50, 1, 8.0)], source)  # out of order, but the window is still open
    assert run() == {(1, 3, 7.0)}
    events(spark, [(2, 1, 100.0), (51, 1, 16.0)], source)  # the first row comes after its window was written
    assert run() == {(1, 3, 7.0)}
    events(spark, [(80, 1, 1.0)], source)
    events(spark, [(81, 1, 1.0)], source)
    assert run() == {(1, 3, 7.0), (3, 2, 24.0)} and run() == {(1, 3, 7.0), (3, 2, 24.0)}


def test_sessions_with_late_rows(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    how = lambda e: windows.sessions(e, "2 hours")

    def run():
        windows.closed_windows(spark, source, out, log, how)
        return sorted((r["user_id"], r["start"].hour, r["n"], r["total"]) for r in spark.read.parquet(out).collect())

    events(spark, [(1, 1, 1.0), (2, 1, 2.0), (2, 2, 4.0), (5, 1, 8.0)], source)
    assert run() == [(1, 1, 2, 3.0), (2, 2, 1, 4.0)]  # they end by the watermark, 4 o'clock
    events(spark, [(6, 1, 16.0), (12, 3, 1.0)], source)  # goes on with a session of the batch before
    assert run() == [(1, 1, 2, 3.0), (1, 5, 2, 24.0), (2, 2, 1, 4.0)]
    events(spark, [(3, 2, 100.0), (13, 3, 2.0)], source)  # would have joined a written session
    events(spark, [(40, 4, 1.0)], source)
    events(spark, [(41, 4, 1.0)], source)
    assert run() == [(1, 1, 2, 3.0), (1, 5, 2, 24.0), (2, 2, 1, 4.0), (3, 12, 2, 3.0)]


def test_margin_parts_add_up_to_the_published_yield(spark):
    store = sections._margin_engine(spark, SF)
    rows = store.margin_components().collect()
    by = {}
    for r in rows:
        by.setdefault((r["period"], r["bank_type_code"]), {})[r["label"]] = r["value"]
    yields = {(dt.date(r["year"], r["month"], 1), r["bank_type_code"]): r["ratio_value"] for r in store.tables["financial_ratios"].collect()}
    assert len(by) > 20
    for key, parts in by.items():
        assert sum(parts.get(x, 0) for x in ("Loans", "Securities", "Banks/MM", "Other income")) == pytest.approx(yields[key])
        assert sum(v for k, v in parts.items() if k != "Margin") == pytest.approx(parts["Margin"])


@pytest.mark.parametrize("name", ["latest_snapshot", "comparison_pivot", "corridor_width", "stack_total_latest", "caption_comparison", "preset_6m", "preset_ytd"])
def test_latest_in_one_scan(spark, name):
    plan = core.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count(f"Relation [{c}") for c in ("o_orderkey", "event_id", "l_orderkey")) == 1


def test_all_definitions_scan_each_table_once(spark):
    plan = core.QUERIES["all_metrics_long"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Relation [o_orderkey"), plan.count("Relation [l_orderkey")) == (2, 1)  # balance sheet and deposits are both made of orders
    assert sheets.kept(spark, SF).latest("ldr")._jdf.queryExecution().optimizedPlan().toString().count("o_orderkey") == 0


NAMES = ["TOPLAM AKTİFLER", "Krediler*", "Mevduat (Toplanan Fonlar)", "TOPLAM ÖZKAYNAKLAR"]


class Source:
    """Answers of both sources: months up to ``last``, amounts that a revision changes."""

    def __init__(self, last):
        self.last, self.down, self.asked = last, False, []

    def get(self, url, form):
        if self.down:
            raise ValueError("down")
        self.asked.append(form)
        if "yil" not in form:
            return json.dumps({"Baslik": "Toplam", "XEkseni": ["5.01.2024"], "YEkseni": [1.0]}).encode()
        y, m = int(form["yil"]), int(form["ay"])
        rows = [{"cell": [i, n, "", 10.0 * i + m, 1.0, 100.0 * i + m]} for i, n in enumerate(NAMES, 1)] if (y, m) <= self.last else []
        return json.dumps({"Json": {"colModels": [{"name": c} for c in ("BasitSira", "Ad", "BasitFont", "Tp", "Yp", "Toplam")], "colNames": [""] * 6, "data": {"rows": rows}}}).encode()


def test_update_run(spark, tmp_path):
    folder, source = str(tmp_path / "facts"), Source((2024, 2))
    run = lambda name, today, **more: U.update(spark, name, folder, "http://m", "http://w", [1], ["10001", "10003"], [("1.0.1", "krediler")], dt.date.fromisoformat(today), dt.datetime(2024, 5, 1), tasks=2, get=source.get, first="2023-01-01", **more)
    assert run("a", "2024-02-20", snapshot_to=str(tmp_path / "snapshot")) == ["monthly", "weekly", "frames", "snapshot"]
    kept = KeptStore(spark, f"{folder}/frames")
    assert kept.get("total_assets").count() == 14 * 2 and kept.get("asset_growth_yoy").count() == 2 * 2
    assert spark.read.parquet(str(tmp_path / "snapshot" / "balance_sheet")).count() == 14 * 2 * 4
    # A month more: only it is fetched, and only what it reaches is written.
    source.last, source.down = (2024, 3), True
    with pytest.raises(steps.StepFailed):
        run("b", "2024-03-20", skip=["weekly"])
    source.down = False
    before = kept.parts.manifest()["parts"]
    assert run("b", "2024-03-20", skip=["weekly"]) == ["monthly", "frames"]
    after = kept.parts.manifest()["parts"]
    assert {p.split("@")[1] for p in after if after[p] != before.get(p)} == {"2024"}
    full = KeptStore(spark, str(tmp_path / "full"))
    full.build(X.Store(U.facts(spark, folder)))
    show = lambda k: sorted(map(str, k.long().collect()))
    assert show(kept) == show(full)
    # Nothing new: nothing is written.
    assert U.frames_updated(spark, folder, kept) == [] and kept.parts.manifest()["parts"] == after
    # A revision of an old month reaches a year on.
    old = refresh.parts_of(spark, folder, "balance_sheet")
    rows = old.held(old.read(["2023-02"]).withColumn("amount_total", F.col("amount_total") * random.Random(1).uniform(2, 3)))
    old.replace(rows, ["2023-02"])
    assert {p.split("@")[1] for p in U.frames_updated(spark, folder, kept)} == {"2023", "2024"}
    full.build(X.Store(U.facts(spark, folder)))
    assert show(kept) == show(full)
