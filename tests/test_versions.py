"""Tables of parts, the kept store, and bulk runs with faults."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.plans import bulk as B
from tidewell.plans.catalog import Growth, Metric, Ratio, Where
from tidewell.plans.compiler import Engine
from tidewell.plans.extended import Store
from tidewell.plans.kept import Derived, KeptStore
from tidewell.sources.versions import Parts, month_part


def day_rows(spark, rows):
    return spark.createDataFrame(rows, "period_date string, v int").withColumn("period_date", F.to_date("period_date"))


def folders(path, part="*"):
    return sorted(str(p) for p in path.glob(f"data/*/_part={part}"))


def test_only_touched_parts_are_written(spark, tmp_path):
    parts = Parts(spark, str(tmp_path), month_part())
    assert parts.read() is None and parts.manifest()["number"] == 0
    assert parts.replace(day_rows(spark, [("2024-01-03", 1), ("2024-02-03", 2)]), ["2024-01", "2024-02"]) == ["2024-01", "2024-02"]
    before = folders(tmp_path, "2024-01")
    assert parts.replace(day_rows(spark, [("2024-02-04", 5)]), ["2024-02"], mark=7) == ["2024-02"]
    assert folders(tmp_path, "2024-01") == before and len(folders(tmp_path, "2024-02")) == 2
    assert sorted(r["v"] for r in parts.read().collect()) == [1, 5] and parts.manifest()["mark"] == 7
    assert sorted(r["v"] for r in parts.read(number=1).collect()) == [1, 2]
    assert [r["v"] for r in parts.read(["2024-02"]).collect()] == [5] and parts.read(["2030-01"]).count() == 0
    assert all("2024-01" not in f for f in parts.read(["2024-02"]).inputFiles())
    # A part without rows goes.
    assert parts.replace(day_rows(spark, []), ["2024-01"]) == []
    assert [r["v"] for r in parts.read().collect()] == [5]


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    parts = Parts(spark, str(tmp_path), month_part())
    parts.replace(day_rows(spark, [("2024-01-03", 1)]), ["2024-01"])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Parts, "_publish", lost)
        with pytest.raises(RuntimeError, match="lost"):
            parts.replace(day_rows(spark, [("2024-01-03", 9)]), ["2024-01"])
    assert [r["v"] for r in parts.read().collect()] == [1] and len(folders(tmp_path)) == 2
    assert parts.drop_unread() == 1 and len(folders(tmp_path)) == 1
    assert [r["v"] for r in parts.read().collect()] == [1]


def test_two_writers_and_odd_parts(spark, tmp_path):
    parts = Parts(spark, str(tmp_path), month_part())
    parts.replace(day_rows(spark, [("2024-01-03", 1)]), ["2024-01"])
    with pytest.raises(RuntimeError, match="another writer"):
        parts._publish(1, {})
    with pytest.raises(Exception, match="unnamed part"):
        parts.replace(day_rows(spark, [("2024-01-03", 1), (None, 2)]), ["2024-01"])
    with pytest.raises(ValueError, match="letters"):
        parts.replace(day_rows(spark, []), ["a/b"])
    for i in range(3):
        parts.replace(day_rows(spark, [("2024-01-03", i)]), ["2024-01"])
    assert parts.drop_unread(keep=2) == 2 and sorted(r["v"] for r in parts.read(number=3).collect()) == [1]


CODES = ["10001", "10003", "10004"]
SHEET = ["TOPLAM AKTİFLER", "Krediler*", "Takipteki Alacaklar", "Mevduat (Toplanan Fonlar)", "TOPLAM ÖZKAYNAKLAR", "TOPLAM YABANCI KAYNAKLAR"]


def sheet(spark, values):
    """values: (year, month, code, item) -> amount."""
    rows = [(y, m, c, i, v * 0.6, v * 0.4, v) for (y, m, c, i), v in values.items()]
    return spark.createDataFrame(rows, "year int, month int, bank_type_code string, item_name string, amount_tl double, amount_fx double, amount_total double")


def loans(spark, values):
    rows = [(4, y, m, c, "Tüketici Kredileri - Konut", v) for (y, m, c, i), v in values.items() if i == "Krediler*"]
    return spark.createDataFrame(rows, "table_number int, year int, month int, bank_type_code string, item_name string, total_amount double")


def content(frames):
    return sorted((r["metric_id"], str(r["period"]), r["bank_type_code"], r["value"]) for r in frames.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_revisions_against_a_full_recompute(spark, tmp_path, seed):
    """Changed, removed and new months in random order, with gaps: the kept store is what a new one would be."""
    r = random.Random(seed)
    derived = [Derived("equity_mean", "total_equity", "mean", 13, 6), Derived("assets_ttm", "total_assets", "trailing"), Derived("loan_mom", "total_loans", "growth", 1)]
    months = [(y, m) for y in range(2018, 2024) for m in range(1, 13)]
    values = {(y, m, c, i): r.uniform(1, 9) for y, m in months if r.random() < 0.9 for c in CODES if r.random() < 0.95 for i in SHEET}
    kept = KeptStore(spark, str(tmp_path / "kept"), derived)
    every = kept.build(Store({"balance_sheet": sheet(spark, values), "loans": loans(spark, values)}, CODES))
    for step in range(2):
        changed = r.sample(months, 2)
        for y, m in changed:
            for c in CODES:
                there = r.random() < 0.6
                for i in SHEET:
                    values.pop((y, m, c, i), None)
                    if there:
                        values[y, m, c, i] = r.uniform(1, 9)
        store = Store({"balance_sheet": sheet(spark, values), "loans": loans(spark, values)}, CODES)
        written = kept.revise(store, changed)
        full = KeptStore(spark, str(tmp_path / f"full{step}"), derived)
        full.build(store)
        assert content(kept.long()) == content(full.long())
        assert 0 < len(written) < 0.7 * len(every)
    assert kept.revise(store, []) == []
    kept.parts.drop_unread()
    kept.parts.clear_work()
    assert content(kept.long()) == content(full.long())


def test_getters_read_their_metric_alone(spark, tmp_path):
    values = {(2023 + k // 12, k % 12 + 1, c, i): 1.0 + k for k in range(14) for c in CODES for i in SHEET}
    store = Store({"balance_sheet": sheet(spark, values), "loans": loans(spark, values)}, CODES)
    kept = KeptStore(spark, str(tmp_path))
    kept.build(store)
    assert set(kept.get("ldr").inputFiles()) and all("ldr@" in f for f in kept.get("ldr").inputFiles())
    for one in (lambda s: s.latest("ldr"), lambda s: s.kpis(), lambda s: s.bank_comparison(), lambda s: s.period_range(), lambda s: s.time_series("npl_ratio", "10001")):
        assert sorted(map(str, one(kept).select(*sorted(one(kept).columns)).drop("year", "month").collect())) == sorted(map(str, one(store).select(*sorted(one(kept).columns)).drop("year", "month").collect()))
    assert kept.latest_value("total_assets") == 14.0 and kept.latest_value("nothing") is None and kept.get("nothing").count() == 0


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def facts(spark, tmp_path):
    values = {(2023 + k // 12, k % 12 + 1, c, i): 1.0 + k + len(i) for k in range(14) for c in CODES for i in SHEET}
    out = {}
    for name, df in (("balance_sheet", sheet(spark, values)), ("loans", loans(spark, values).withColumns({c: F.col("total_amount") for c in ("total_tl", "total_fx", "short_term_tl", "short_term_fx", "short_term_total", "medium_long_tl", "medium_long_fx", "medium_long_total", "npl_amount", "customer_count")}))):
        df.write.parquet(str(tmp_path / name))
        out[name] = spark.read.parquet(str(tmp_path / name))
    return out


def test_one_scan_for_each_table(spark, tmp_path):
    engine = Engine(facts(spark, tmp_path), CODES)
    assert scans(B.bulk(engine)[0]) == 2
    assert scans(Store(engine.tables, CODES).long()) == 2 and scans(Store(engine.tables, CODES).long(["ldr"])) == 1


def test_reports_list_rows_in_order(spark, tmp_path):
    engine = Engine(facts(spark, tmp_path), CODES)
    rows = [(r["year"], r["month"], r["bank_type_code"]) for r in engine.ordered(engine.metric("total_assets")).collect()]
    assert rows == sorted(rows) and len(rows) == 14 * 3


def test_bad_definitions_are_rows_of_their_own(spark, tmp_path):
    engine = Engine(facts(spark, tmp_path), CODES)
    d = B.Definitions()
    total = {"TOTAL": ("amount_total",)}
    bad = {
        "no_table": Metric("no_table", "x", "assets", "nowhere", Where(("%",)), total),
        "no_column": Metric("no_column", "x", "assets", "balance_sheet", Where(("%",)), {"TOTAL": ("amount_eur",)}),
        "no_filter_column": Metric("no_filter_column", "x", "assets", "balance_sheet", Where(equal=(("branch", 1),)), total),
        "no_number": Metric("no_number", "x", "assets", "balance_sheet", Where(("%",)), {"TOTAL": ("item_name",)}),
        "no_sum": Metric("no_sum", "x", "assets", "balance_sheet", Where(("%",)), total, aggregation="median"),
    }
    ratios = {
        "of_ratio": Ratio("of_ratio", "x", "assets", "npl_ratio", "equity_ratio", 1.0),
        "of_bad": Ratio("of_bad", "x", "assets", "no_column", "total_assets"),
        "of_nothing": Ratio("of_nothing", "x", "assets", "nothing", "total_assets"),
        "loop_a": Ratio("loop_a", "x", "assets", "loop_b", "total_assets"),
        "loop_b": Ratio("loop_b", "x", "assets", "total_assets", "loop_a"),
        "own": Ratio("own", "x", "assets", "own", "total_assets"),
    }
    growth = {"of_ratio_mom": Growth("of_ratio_mom", "x", "npl_ratio", 1), "of_loop": Growth("of_loop", "x", "loop_a", 1), "backwards": Growth("backwards", "x", "total_assets", 0)}
    more = B.Definitions({**d.metrics, **bad}, {**d.ratios, **ratios}, {**d.growth, **growth})
    got, faults = B.bulk(engine, more)
    told = {r["metric_id"]: r["fault"] for r in faults.collect()}
    deposits = {"demand_deposits", "time_deposits", "demand_deposit_share"}  # their table isn't there
    assert set(told) == {*bad, "of_bad", "of_nothing", "loop_a", "loop_b", "own", "of_loop", "backwards"} | deposits
    assert told["no_column"] == "no column amount_eur in balance_sheet" and told["of_bad"] == "operand no_column: no column amount_eur in balance_sheet"
    assert told["own"] == "loop: own -> own" and told["loop_a"].startswith("loop: ") and told["no_table"] == "no table nowhere"
    ids = {r["metric_id"] for r in got.select("metric_id").distinct().collect()}
    assert not ids & set(told) and {"of_ratio", "of_ratio_mom", "total_assets", "npl_ratio"} <= ids
    plain = content(B.bulk(engine)[0])
    assert [r for r in content(got) if r[0] not in ("of_ratio", "of_ratio_mom")] == plain
    v = {(r[0], r[1], r[2]): r[3] for r in content(got)}
    for (id, period, code), x in v.items():
        if id == "of_ratio":
            assert x == pytest.approx(v["npl_ratio", period, code] / v["equity_ratio", period, code])
    one, none = B.bulk(engine, more, ids=["own", "unheard of"])
    assert one.count() == 0 and {r["fault"] for r in none.collect()} == {"loop: own -> own", "unknown id"}
