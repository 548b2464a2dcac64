"""Rules that plain Spark functions don't have, on tiny frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.operators import align, shapes
from tidewell.operators import timeseries as ts
from tidewell.plans import catalog
from tidewell.plans.compiler import Engine, measure
from tidewell.sources import ingest, readers
from tidewell.streaming import upsert


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def d(s):
    return dt.date.fromisoformat(s)


@pytest.mark.parametrize("text,pattern,hit", [("Toplam", "%TOPLAM%", True), ("özkayn", "ÖZKAYN", False), ("İhtiyaç", "i%", False), ("2+3", "%2+3%", True)])
def test_ascii_like(spark, text, pattern, hit):
    assert one(spark, E.ascii_like(F.lit(text), pattern)) is hit


def test_numbers(spark):
    assert one(spark, E.half_even(F.lit(0.125))) == 0.12
    assert one(spark, E.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, E.first_truthy(F.lit(0), F.lit(7), F.lit(9))) == 7
    assert one(spark, E.first_truthy(F.lit(0), F.lit(0), F.lit(0))) == 0
    assert one(spark, E.amount_text(F.lit(23600000.0))) == "23.60T TL"
    assert one(spark, E.amount_text(F.lit(None).cast("double"))) == "—"
    assert one(spark, E.basis_points_text(F.lit(0.25))) == "+25bps"
    assert one(spark, E.delta_text(F.lit(-1.25), 2)) == "-1.25%"
    assert one(spark, E.ratio_category(F.lit("Ticari krediler"))) == "capital"
    assert one(spark, E.last_saturday(F.lit("2026-01-16").cast("date"))) == d("2026-01-10")
    assert one(spark, E.in_range(F.lit(1e10))) is False


def series(spark, values, start=1):
    return spark.createDataFrame([("a", d(f"2020-{start + i:02d}-01"), v, 2020, start + i) for i, v in enumerate(values)], "entity string, period date, value double, year int, month int")


def test_growth_is_positional_and_drops_zero_bases(spark):
    df = series(spark, [0.0, 10.0, 20.0]).unionByName(spark.createDataFrame([("a", d("2020-12-01"), 30.0, 2020, 12)], "entity string, period date, value double, year int, month int"))
    assert [r["growth"] for r in ts.growth(df, 1, ["entity"]).orderBy("period").collect()] == [100.0, 50.0]
    assert [r["growth"] for r in ts.growth(df, 1, ["entity"], calendar_months=True).orderBy("period").collect()] == [100.0]


def test_change_fills_nulls_first(spark):
    assert [r["growth"] for r in ts.change_filled(series(spark, [1.0, None, 3.0]), ["entity"]).orderBy("period").collect()] == [0.0, 200.0]


def test_weekly_growth_needs_positive_values(spark):
    df = series(spark, [1.0, -1.0, 2.0, 4.0])
    assert [r["growth"] for r in ts.growth_annualised(df, 1, ["entity"], "period", per_year=1).collect()] == [100.0]


def test_trailing_year(spark):
    rows = [("a", 2020, 12, 120.0), ("a", 2020, 3, 30.0), ("a", 2021, 3, 50.0), ("a", 2021, 4, 60.0)]
    got = {(r["year"], r["month"]): r["ttm"] for r in ts.trailing_year(spark.createDataFrame(rows, "entity string, year int, month int, value double"), ["entity"]).collect()}
    assert got == {(2020, 12): 120.0, (2021, 3): 140.0}


def test_rolling_needs_enough_values(spark):
    assert [r["mean"] for r in ts.rolling_mean(series(spark, [1.0, 3.0, 5.0]), 2, 2, ["entity"]).orderBy("period").collect()] == [None, 2.0, 4.0]


def test_rate_adjusted_growth_splits_nominal(spark):
    df = spark.createDataFrame([("a", d("2020-01-01"), 50.0, 50.0, 10.0), ("a", d("2020-02-01"), 50.0, 100.0, 20.0)], "entity string, period date, l double, f double, r double")
    got = ts.rate_adjusted_growth(df, 1, ["entity"], "l", "f", "r").first()
    assert (got["growth_nominal"], got["growth_adjusted"], got["rate_effect"]) == (50.0, 0.0, 50.0)


def test_asof_takes_null_values_unless_skipped(spark):
    left = spark.createDataFrame([(d("2020-01-02"),), (d("2020-01-05"),), (d("2019-01-01"),)], "date date")
    right = spark.createDataFrame([(d("2020-01-01"), 1.0), (d("2020-01-04"), None)], "date date, value double")
    assert [r["asof"] for r in align.asof(left, right, "date", "value").orderBy("date").collect()] == [None, 1.0, None]
    assert [r["asof"] for r in align.asof(left, right, "date", "value", skip_null=True).orderBy("date").collect()] == [None, 1.0, 1.0]


def test_fill_daily(spark):
    df = spark.createDataFrame([("a", d("2019-12-31"), 9.0), ("a", d("2020-01-02"), 1.0), ("a", d("2020-01-02"), 5.0), ("a", d("2020-01-04"), None)], "label string, date date, value double").coalesce(1)
    got = align.fill_daily(df, "2020-01-01", "2020-01-05", ["label"]).orderBy("date").collect()
    assert [(str(r["date"]), r["value"]) for r in got] == [("2020-01-02", 1.0), ("2020-01-03", 1.0), ("2020-01-04", 1.0), ("2020-01-05", 1.0)]


def test_shapes(spark):
    df = spark.createDataFrame([("a", d("2020-01-01"), 1.0), ("a", d("2020-02-01"), 2.0), ("b", d("2020-01-01"), 5.0)], "entity string, period date, value double")
    assert [r["entity"] for r in shapes.latest(df).collect()] == ["a"]
    k = {r["entity"]: r for r in shapes.kpi(df, ["entity"]).collect()}
    assert k["a"]["change_percent"] == 100.0 and k["b"]["previous"] is None
    m = df.withColumn("m", F.lit("x"))
    with pytest.raises(Exception, match="more than one value"):
        shapes.comparison(m, ["x"], name="m").collect()
    p = spark.createDataFrame([(1, "x", None), (1, "y", 2.0)], "i int, n string, value double")
    assert shapes.pivot_sum(p, ["i"], "n", ["x", "y", "z"]).first()[1:] == (0.0, 2.0, None)


def sheet(spark):
    cols = "year int, month int, currency string, bank_type_code string, item_order int, item_name string, is_subtotal boolean, amount_tl double, amount_fx double, amount_total double"
    rows = [(2020, m, "TL", b, 1, n, True, v, v / 2, v * 1.5) for m in (1, 2) for b in ("10001", "10002") for n, v in (("Toplam Aktifler", 100.0 * m), ("Krediler", 60.0), ("Takipteki Alacaklar", 3.0), ("Nakit", 1.0), ("Merkez Bankası ve Alacaklar", 2.0))]
    return spark.createDataFrame(rows, cols)


def test_engine(spark):
    e = Engine({"balance_sheet": sheet(spark)})
    got = e.metric("total_assets", "FX").orderBy("month").collect()
    assert [(r["bank_type_code"], r["bank_type"], r["value"]) for r in got] == [("10001", "Sector", 50.0), ("10001", "Sector", 100.0)]
    assert [round(r["value"], 6) for r in e.ratio("npl_ratio").collect()] == [5.0, 5.0]
    assert [r["value"] for r in e.growth("asset_growth_mom").collect()] == [100.0]
    assert e.metric("cash_and_central_bank").agg(F.sum("value")).first()[0] == 9.0
    loose = Engine({"balance_sheet": sheet(spark)}, or_precedence=True).metric("cash_and_central_bank")
    assert {r["bank_type_code"] for r in loose.collect()} == {"10001", "10002"}
    assert e.latest_period().first()["month"] == 2
    assert {r["metric_id"] for r in e.every_metric().collect()} == {"total_assets", "cash_and_central_bank"}
    with pytest.raises(ValueError):
        e.metric("no_such")


def test_catalog():
    assert (len(catalog.METRICS), len(catalog.RATIOS), len(catalog.GROWTH)) == (18, 7, 7)
    assert catalog.operand("a[FX]") == ("a", "FX") and catalog.operand("a") == ("a", "TOTAL")
    assert "npl_ratio" in catalog.by_category("asset_quality") and "| npl_ratio |" in catalog.markdown()
    with pytest.raises(KeyError, match="no metric"):
        catalog.get("x")


def test_multi_column_sum_drops_rows_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    m = catalog.Metric("t", "t", "assets", "t", catalog.Where(), {"TOTAL": ("a", "b")})
    assert df.agg(F.sum(measure(m, "TL"))).first()[0] == 5.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿row_id,item_name,tp_value,yp_value,total_value,date_str,period_id\n1,Krediler,1.5,2,3.5,16 Ocak 2026,629\n2,X,,,,bad,1\n", encoding="utf-8")
    got = readers.bulletin_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()
    assert got[0]["period_date"] == d("2026-01-16") and got[0]["tp_value"] == 1.5 and got[1]["period_date"] is None
    (tmp_path / "b.csv").write_text("row_id,item_name,tp_value,yp_value,total_value,period_id\n1,K,1,2,3,4\n")
    assert readers.bulletin_csv(spark, str(tmp_path / "b.csv")).first()["date_str"] is None
    (tmp_path / "s.json").write_text('[{"date":"2020-01-01","value":null},{"date":"2020-01-02","value":2.5}]')
    assert readers.series_json(spark, str(tmp_path / "s.json")).count() == 2
    body = json.dumps({"items": [{"Tarih": "02-01-2020", "TP_A": "39.5", "UNIXTIME": {"x": "1"}}, {"Tarih": "x", "TP_A": "1"}]})
    raw = spark.createDataFrame([(body,)], "body string")
    assert [tuple(r) for r in readers.series_response(raw, "TP.A").collect()] == [(d("2020-01-02"), 39.5)]
    assert [r["value"] for r in readers.series_response(raw, "TP.B").collect()] == [39.5]
    m = json.dumps({"Json": {"colModels": [{"name": "Ad"}, {"name": "x"}, {"name": "y"}, {"name": "z"}], "data": {"rows": [{"cell": ["A", "0", "7", "t"]}, {"cell": ["B"]}]}}})
    rows = readers.monthly_rows(spark.createDataFrame([(5, m)], "year int, response_json string"))
    assert rows.count() == 1 and rows.select(readers.number(F.col("cells"), "x", "y")).first()[0] == 7.0
    long = {r["column_name"]: (r["value_numeric"], r["value_text"]) for r in readers.unpivoted(rows, ["Ad"]).collect()}
    assert long == {"x": (0.0, "0"), "y": (7.0, "7"), "z": (None, "t")}
    w = json.dumps({"Baslik": "Loans (TRY) x", "XEkseni": ["2.01.2026", "bad"], "YEkseni": [1.5, None]})
    assert [tuple(r) for r in readers.weekly_points(spark.createDataFrame([(w,)], "response_json string")).collect()] == [("Loans", d("2026-01-02"), 1.5)]


def test_ingest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    once = ingest.upsert(None, df, ["k"], "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ingest.upsert(once, df, ["k"], "at").collect())) == [(1, "b", 2), (2, "c", 1)]
    have = spark.createDataFrame([(d("2020-02-01"),)], "period date")
    assert sorted(str(r[0]) for r in ingest.missing_months(have, "2020-01-01", "2020-03-01").collect()) == ["2020-01-01", "2020-03-01"]
    assert ingest.weekly_anchors(d("2020-12-04"), d("2020-06-01")) == [d("2020-12-04"), d("2020-09-04"), d("2020-06-05")]
    assert ingest.windows(d("2020-01-01"), d("2020-01-05"), 2)[-1] == (d("2020-01-05"), d("2020-01-05"))
    waits, answers = [], iter([OSError(), OSError(), b'{"a": 1}'])

    def get():
        x = next(answers)
        if isinstance(x, OSError):
            raise x
        return x

    assert ingest.fetched(get, sleep=waits.append) == {"a": 1} and waits == [2.0, 4.0]


def test_stream_is_a_batch_upsert(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def put(name, *points):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"period_date": p, "item_id": "1", "bank_type_code": "10001", "currency": "TL", "value": v, "downloaded_at": at}) for p, v, at in points) + "\n")

    put("1.json", ("2020-01-03", 1.0, "2020-02-01T00:00:00Z"), ("2020-01-10", 2e10, "2020-02-01T00:00:00Z"))
    upsert.merge_files(spark, src, out, ck)
    put("2.json", ("2020-01-03", 5.0, "2020-03-01T00:00:00Z"), ("2020-01-17", 3.0, "2020-03-01T00:00:00Z"))
    upsert.merge_files(spark, src, out, ck)
    upsert.merge_files(spark, src, out, ck)
    assert sorted((str(r["period_date"]), r["value"]) for r in upsert.current(spark, out).collect()) == [("2020-01-03", 5.0), ("2020-01-17", 3.0)]


def test_registry(spark):
    from tidewell.sources import registry

    assert len(registry.SERIES) == 95
    assert registry.get("cbrt_net_funding").unit_scale == 1e3 and registry.get("r_car").direction == "up_good"
    assert registry.get("w_auto") == registry.Series("w_auto", "weekly", "1.0.5", "Auto")
    with pytest.raises(KeyError, match="usd_try"):
        registry.get("usdtry")
    w = spark.createDataFrame([(d("2020-01-03"), "1.0.5", "10001", "TOTAL", 2.0), (d("2020-01-03"), "1.0.4", "10001", "TL", 3.0)], "period_date date, item_id string, bank_type_code string, currency string, value double")
    assert [tuple(r) for r in registry.from_weekly(w, ["w_auto", "w_housing"]).collect()] == [(d("2020-01-03"), "Auto", 2.0)]


def test_amount_text_ties(spark):
    """Ties go to even, by the double's exact value, as the reference's formatter has it."""
    amounts = [0.5, 1.5, 2.5, 234.5, 999.5, -2.5, 100.0, 1050.0, 1250.0, 1350.0, 1450.0, -1250.0, 2000.0, 1.005e6, 1.125e6, 1.135e6, 1.375e6, -1.125e6]
    got = spark.createDataFrame([(v,) for v in amounts], "v double").select("v", E.amount_text("v").alias("t")).collect()

    def text(v):
        return f"{v / 1e6:.2f}T TL" if abs(v) >= 1e6 else f"{v / 1e3:.1f}B TL" if abs(v) >= 1e3 else f"{v:,.0f}M TL"

    assert {r["v"]: r["t"] for r in got} == {v: text(v) for v in amounts}
