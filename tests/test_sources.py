"""Plans of requests, staged fetches, writers, the merge by month, panels and named items, on tiny frames."""

import datetime as dt
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidewell.operators import align
from tidewell.plans import extended, panels
from tidewell.sources import ingest, refresh, registry, requests, writers
from tidewell.streaming import upsert, windows


def d(s):
    return dt.date.fromisoformat(s)


def months(spark, *days):
    return spark.createDataFrame([(d(x),) for x in days], "period date")


def served(url, form):
    """Answers rows for months up to April 2024, an error for table 9."""
    if form is None:
        return json.dumps({"items": [{"Tarih": "01-02-2024", "TP_A": "1.5"}]}).encode()
    if form["tabloNo"] == "9":
        raise urllib.error.HTTPError(url, 404, "none", {}, None)
    rows = [{"cell": ["Sector", 1, "TOPLAM AKTİFLER", "bold", "5", 0, "7"]}] if int(form["ay"]) <= 4 else []
    return json.dumps({"Json": {"colModels": [{"name": n} for n in ("BankaAdi", "BasitSira", "Ad", "BasitFont", "Tp", "Yp", "Toplam")], "colNames": [], "data": {"rows": rows}}}).encode()


def test_monthly_plan_fetch_and_writers(spark):
    plan = requests.monthly_plan(months(spark, "2024-03-01"), [1, 9], ["10001", "10003"], "http://source")
    assert plan.count() == 4 and plan.where("form['taraf[0]'] = bank_type_code and form['ay'] = '3'").count() == 4
    got = requests.fetched_plan(plan, 2, served, pause=0).cache()
    assert {(r["table_number"], r["error"] is None) for r in got.collect()} == {(1, True), (9, False)}
    assert {r["status"] for r in requests.logged(got).where("table_number = 9").collect()} == {"error"}
    sheet = writers.routed(got.where("error is null"))["balance_sheet"].collect()
    assert {(r["bank_type_code"], r["item_order"], r["item_name"], r["is_subtotal"], r["amount_tl"], r["amount_fx"], r["amount_total"]) for r in sheet} == {(c, 1, "TOPLAM AKTİFLER", True, 5.0, 0.0, 7.0) for c in ("10001", "10003")}


def test_update_asks_only_for_what_is_published(spark):
    got = requests.monthly_update(months(spark, "2024-01-01", "2024-02-01"), d("2024-07-15"), "http://source", [1, 2], ["10001"], 2, served)
    assert {(r["month"], r["table_number"]) for r in got.collect()} == {(3, 1), (3, 2), (4, 1), (4, 2)}
    assert requests.monthly_update(months(spark, "2024-07-01"), d("2024-07-15"), "http://source", [1], ["10001"], 1, served).count() == 0


def test_answers():
    fails = iter([TimeoutError("timed out"), urllib.error.HTTPError("u", 503, "busy", {}, None)])

    def flaky():
        for fault in fails:
            raise fault
        return b"[1]"

    waits = []
    assert requests.answer(flaky, sleep=waits.append) == ("[1]", None, 3) and waits == [2.0, 4.0]
    text, error, tries = requests.answer(lambda: b"<html>", sleep=waits.append)
    assert text is None and "JSONDecodeError" in error and tries == 1
    assert requests.answer(lambda: (_ for _ in ()).throw(TimeoutError("x")), tries=3, sleep=waits.append)[2] == 3


def test_weekly_and_series_plans(spark):
    anchors = spark.createDataFrame([(d("2026-01-16"),)], "anchor date")
    plan = requests.weekly_plan(anchors, [("1.0.1", "krediler")], "http://w", ["10001", "10008"])
    assert plan.count() == 6
    assert {(r["source_code"], r["bank_type_code"]) for r in plan.collect()} == {("10001", "10001"), ("10008", "10004")}
    assert plan.where("currency = 'TOTAL'").first()["form"]["tarih"] == "16.01.2026"
    series = requests.series_plan(spark, {"a": "TP.A", "b": "TP.B"}, d("2018-01-01"), d("2026-01-16"), "http://e")
    parts = sorted((r["start"], r["end"]) for r in series.where("label = 'a'").collect())
    assert parts[-1][1] == d("2026-01-10") and all((b[0] - a[1]).days == 1 for a, b in zip(parts, parts[1:])) and series.count() == 2 * len(parts) == 6
    assert requests.fetched_plan(series, 1, served, pause=0).where("error is null").count() == 6


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(d("2024-01-01"), 1.5), (d("2024-01-02"), None)], "date date, value double")

    for _ in range(2):
        got = requests.cached(spark, str(tmp_path), ("TP.A", "2024"), make)
        assert sorted(map(tuple, got.collect())) == [(d("2024-01-01"), 1.5), (d("2024-01-02"), None)]
    assert len(made) == 1
    requests.cached(spark, str(tmp_path), ("TP.B", "2024"), make)
    assert len(made) == 2


def test_merged_tables(spark):
    columns = "year int, month int, currency string, bank_type_code string, item_order int, item_name string, at int"
    a = spark.createDataFrame([(2024, 1, "TL", "10001", 1, "old", 1), (2024, 1, "TL", "10001", 2, "stays", 1)], columns)
    b = spark.createDataFrame([(2024, 1, "TL", "10001", 1, "new", 2)], columns)
    assert {r["item_name"] for r in writers.merged(writers.merged(None, a, "balance_sheet", "at"), b, "balance_sheet", "at").collect()} == {"new", "stays"}
    a, b = (df.withColumn("table_number", F.lit(12)) for df in (a, b))
    one = writers.merged(None, a, "other_data", "at")
    assert writers.merged(one, a, "other_data", "at").count() == a.count() == 2
    assert {r["item_name"] for r in writers.merged(one, b, "other_data", "at").collect()} == {"new"}
    assert writers.merged(writers.merged(None, b, "other_data", "at"), a, "other_data", "at").count() == 1


def test_responses_without_columns(spark):
    body = json.dumps({"Json": {"colModels": [{"name": "Ad"}, {"name": "X"}], "colNames": ["", ""], "data": {"rows": [{"cell": ["a", "1", "2"]}, {"cell": ["b", "7", "", "x"]}, {"cell": ["c", "", None, "y"]}]}}})
    raw = spark.createDataFrame([(16, 2024, 1, "TL", "10001", body), (2, 2024, 1, "TL", "10001", '{"Json": {}}'), (3, 2024, 1, "TL", "10001", None)], "table_number int, year int, month int, currency string, bank_type_code string, response_json string")
    out = writers.routed(raw)
    assert [(r["item_order"], r["item_name"], r["column_name"], r["value_text"], r["value_numeric"]) for r in out["other_data"].collect()] == [(1, "b", "X", "7", 7.0)]
    assert out["income_statement"].count() == 0 and out["loans"].count() == 0


def points(spark, rows, path):
    text = [json.dumps({"period_date": p, "item_id": i, "bank_type_code": "10001", "currency": "TL", "value": v, "downloaded_at": f"2024-05-01T00:00:{at:02d}"}) for p, i, v, at in rows]
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.mode("append").text(path)


def test_stream_rewrites_only_months_of_the_batch(spark, tmp_path):
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    points(spark, [("2024-01-05", "a", 1.0, 1), ("2024-02-02", "a", 2.0, 1), ("2024-02-09", "b", 1e11, 1)], source)
    upsert.merge_files(spark, source, target, log)
    points(spark, [("2024-02-02", "a", 5.0, 2), ("2024-02-16", "a", None, 1)], source)
    upsert.merge_files(spark, source, target, log)
    upsert.merge_files(spark, source, target, log)
    points(spark, [("2024-02-02", "a", 4.0, 1)], source)
    upsert.merge_files(spark, source, target, log)
    got = {(str(r["period_date"]), r["item_id"], r["value"]) for r in upsert.current(spark, target).collect()}
    assert got == {("2024-01-05", "a", 1.0), ("2024-02-02", "a", 5.0), ("2024-02-16", "a", None)}
    assert len(list((tmp_path / "out").glob("data/*/_part=2024-01"))) == 1 and len(list((tmp_path / "out").glob("data/*/_part=2024-02"))) == 3
    points(spark, [("2024-02-02", "a", 7.0, 3)], source)
    upsert.merge_files(spark, source, target, log, keep=1)
    assert len(list((tmp_path / "out").glob("data/*/_part=*"))) == 2
    assert {r["value"] for r in upsert.current(spark, target, ["2024-02"]).collect()} == {7.0, None}


def test_a_batch_that_is_run_again_is_done(spark, tmp_path):
    """A driver lost between the merge and the stream's own commit: the batch runs again and writes nothing."""
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    points(spark, [("2024-01-05", "a", 1.0, 1)], source)
    upsert.merge_files(spark, source, target, log)
    for f in (tmp_path / "log" / "commits").iterdir():
        f.unlink()
    upsert.merge_files(spark, source, target, log)
    assert upsert._parts(spark, target).manifest()["number"] == 1
    points(spark, [("2024-01-05", "a", 2.0, 2)], source)
    upsert.merge_files(spark, source, target, log)
    assert [r["value"] for r in upsert.current(spark, target).collect()] == [2.0]
    # Another stream with numbers of its own isn't taken for this one.
    points(spark, [("2024-01-05", "a", 3.0, 3)], str(tmp_path / "in2"))
    upsert.merge_files(spark, str(tmp_path / "in2"), target, str(tmp_path / "log2"))
    assert [r["value"] for r in upsert.current(spark, target).collect()] == [3.0]


def test_windowed_counts_of_a_table(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "x", 1.0), (dt.datetime(2024, 1, 1, 23), "x", 2.0), (dt.datetime(2024, 1, 2, 1), "x", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted((r["n"], r["total"]) for r in windows.tumbling(e).collect()) == [(1, 4.0), (2, 3.0)]


def test_violations(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1e11,), (-1e10,)], "value double")
    assert tuple(ingest.violations(df).first()) == (4, 2) and ingest.sane(df).count() == 2


@pytest.mark.parametrize("skip", [False, True])
def test_asof_over_months(spark, skip):
    import random

    r = random.Random(4)
    day = lambda: d("2020-01-01") + dt.timedelta(days=r.randrange(700))
    right = {(k, day()): (None if r.random() < 0.2 else float(i)) for i in range(40) for k in ("a", "b", None)}
    left = [(k, day()) for k in ("a", "b", "c", None) for _ in range(60)]
    got = align.asof(spark.createDataFrame(left, "k string, on date"), spark.createDataFrame([(k, x, v) for (k, x), v in right.items()], "k string, on date, v double"), "on", "v", ["k"], skip_null=skip)

    def want(k, x):
        some = [(y, v) for (j, y), v in right.items() if j == k and y <= x and (v is not None or not skip)]
        return max(some, key=lambda p: p[0])[1] if some else None

    key = lambda t: tuple(map(str, t))
    assert sorted(((r["k"], r["on"], r["asof"]) for r in got.collect()), key=key) == sorted(((k, x, want(k, x)) for k, x in left), key=key)


def test_asof_has_no_window_over_a_whole_series(spark):
    df = spark.range(10).select(F.expr("date'2020-01-01' + cast(id as int)").alias("on"), F.col("id").cast("double").alias("v"))
    plan = align.asof(df.select("on"), df, "on", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line and "_month" in line for line in plan.splitlines()) == 2


def standard(spark, rows):
    return spark.createDataFrame([(d(p), c, v) for p, c, v in rows], "period date, bank_type_code string, value double")


def test_sentences(spark):
    df = standard(spark, [("2024-01-01", "10001", 10.0), ("2024-02-01", "10001", 10.25), ("2024-02-01", "10003", 99.0)])
    assert panels.narrative(df, "NPL ratio").first()["sentence"] == "NPL ratio at 10.2% in 2024-02 (+25bps MoM)."
    assert panels.turn(df).first()["direction"] == "steady"
    assert panels.turn(df.limit(1)).count() == 0
    w = spark.createDataFrame([(d("2024-01-05") + dt.timedelta(weeks=i), 10.0 + i) for i in range(6)], "period_date date, value double")
    assert panels.four_week_caption(w, "Growth").first()["caption"] == "Growth at 15.0% in the week of 2024-02-09 (+400bps over four weeks)."
    assert panels.four_week_caption(w.limit(4), "Growth").count() == 0
    values = spark.createDataFrame([("a", 1.25), ("b", -2.0)], "key string, value double")
    assert panels.caption("{a:+.1f} and {b:,.0f}", values, ["a", "b"]).first()["caption"] == "+1.2 and -2"
    assert panels.caption("{a:.1f} {none:.1f}", values, ["a", "b"]).first()["caption"] == "{a:.1f} {none:.1f}"
    got = [r["s"] for r in spark.createDataFrame([(0.0,), (1.4,), (2.1,), (30.0,), (60.0,), (8.0,)], "x double").select(panels.nice_step(F.col("x")).alias("s")).collect()]
    assert got == [1.0, 1.0, 2.0, 25.0, 50.0, 10.0]


def test_panels_take_registry_keys_and_units(spark):
    key = next(k for k, s in registry.SERIES.items() if s.unit_scale != 1.0)
    pts = spark.createDataFrame([(key, d("2024-01-01"), 2e6)], "key string, date date, value double")
    got = panels.panel(pts, {"kind": "evds_trend", "series": [{"key": key}]}).first()
    assert got["value"] == 2e6 / registry.get(key).unit_scale and got["label"] == registry.get(key).label and got["is_last"]
    with pytest.raises(KeyError):
        panels.panel(pts, {"kind": "evds_trend", "series": [{"key": "polcy_rate"}]})
    with pytest.raises(ValueError):
        panels.panel(pts, {"kind": "table", "series": []})


def test_other_items_and_weekly_growth(spark):
    other = spark.createDataFrame([(12, 2024, 1, "10001", "Çekirdek Sermaye Yeterliliği Rasyosu (%)", 13.0), (12, 2024, 1, "10001", "Diğer", 1.0), (11, 2024, 1, "10001", "Çekirdek Sermaye Yeterliliği Rasyosu", 2.0), (12, 2024, 1, "10002", "Çekirdek Sermaye Yeterliliği Rasyosu", 3.0)], "table_number int, year int, month int, bank_type_code string, item_name string, value_numeric double")
    weeks = [(d("2024-01-05") + dt.timedelta(weeks=i), name, 100.0 * 1.01**i) for i in range(16) for name in ("Toplam Krediler (2+10)", "KOBİ Kredileri (Bilgi)", "x")]
    bulletin = spark.createDataFrame([(*w, "krediler") for w in weeks], "period_date date, item_name string, total_value double, category string")
    e = extended.Extended({"other_data": other, "weekly_bulletin": bulletin})
    assert [r["value"] for r in e.cet1().collect()] == [13.0]
    got = {r["metric_id"]: r for r in e.weekly_growth_13w(items_per_week=3).collect()}
    assert set(got) == {"total_loans", "sme_loans"} and got["sme_loans"]["weeks"] == 14
    assert got["sme_loans"]["growth_13w_annualized"] == round((1.01**52 - 1) * 100, 2)
    assert e.weekly_growth_13w(weeks=13, items_per_week=3).count() == 0


def test_presets(spark):
    df = standard(spark, [(f"{2015 + i // 12}-{i % 12 + 1:02d}-01", "10001", float(i)) for i in range(100)])
    n = {p: extended.preset(df, p).count() for p in ("1M", "6M", "YTD", "1Y", "3Y", "5Y", "MAX")}
    assert n == {"1M": 2, "6M": 7, "YTD": 4, "1Y": 13, "3Y": 37, "5Y": 61, "MAX": 100}
    assert extended.filter_from(df, "2023-02").count() == 3


def weekly_served(url, form):
    y = int(form["sutun"]) * 10.0
    return json.dumps({"Baslik": "Toplam Krediler (TRY) [Toplam]", "XEkseni": ["9.01.2026", "16.01.2026", "bad"], "YEkseni": [y, 1e11, 3.0]}).encode()


def test_refresh(spark, tmp_path):
    folder = str(tmp_path / "facts")
    at = dt.datetime(2024, 5, 1)
    answers = requests.monthly_update(months(spark, "2024-02-01"), d("2024-04-15"), "http://source", [1, 9, 12], ["10001"], 2, served).cache()
    for _ in range(2):
        touched = refresh.merge_monthly(answers, folder, at)
        assert {t: len(m) for t, m in touched.items()} == {"balance_sheet": 2, "other_data": 2}
    assert refresh.stored(spark, folder, "balance_sheet").count() == 2 and refresh.stored(spark, folder, "loans") is None
    assert refresh.stored(spark, folder, "other_data").count() == 6
    for _ in range(2):
        weekly = refresh.weekly_update(refresh.stored(spark, folder, "weekly_series"), d("2026-01-17"), "http://w", [("1.0.1", "krediler")], 2, weekly_served, spark=spark, first="2026-01-01")
        refresh.merge_weekly(weekly, folder, at)
    got = refresh.stored(spark, folder, "weekly_series")
    assert {(str(r["period_date"]), r["item_name"], r["currency"], r["value"]) for r in got.where("bank_type_code = '10001'").collect()} == {("2026-01-09", "Toplam Krediler", c, v) for c, v in (("TL", 10.0), ("FX", 20.0), ("TOTAL", 30.0))}
    refresh.snapshot(spark, folder, str(tmp_path / "out"), ["balance_sheet", "weekly_series", "loans"])
    assert spark.read.parquet(str(tmp_path / "out" / "weekly_series")).count() == got.count()
