import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from headwater import schemas
from headwater.operators import keys
from headwater.sources import bulletin, files, incremental, payloads

SEEN = dt.datetime(2026, 8, 7, 13, 40)


def level_page(marker="Angat", day="Aug-07", width=13):
    """Two entities, two readings each, in the spans of the real layout."""

    def entity(name, level, rule, high):
        tail = "".join(f'<td rowspan="2">{v}</td>' for v in ("", "", "1,250.5", "-")[: width - 9])
        head = (f'<tr><td rowspan="4">{name}</td><td>08:00 AM</td><td rowspan=2>{level}</td><td rowspan="4">24</td>'
                f'<td rowspan="4">0.64</td><td rowspan="4">{high}</td><td rowspan="2">-51.87</td><td rowspan="2">{rule}</td>'
                f'<td rowspan="2">-22.66</td>{tail}</tr><tr><td>{day}</td></tr>')
        prior = (f'<tr><td>07:30 pm</td><td rowspan="2">157.49</td><td rowspan="2">-52.51</td><td rowspan="2">{rule}</td>'
                 f'<td rowspan="2">-23.19</td>{tail}</tr><tr><td>Aug-06</td></tr>')
        return head + prior

    headers = '<thead><tr><th rowspan="2">Dam Name</th><th colspan="12">x</th></tr><tr>' + "<th>y</th>" * 12 + "</tr></thead>"
    return (f"<html><p>intro</p><table><tr><td>{marker}</td></tr></table><table>{headers}<tbody>{entity(marker, '158.13', '180.79', '210.00')}"
            f"{entity('La  Mesa Dam', '79.40', '0.00', '80.15')}</tbody></table></html>")


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id string, captured_at timestamp_ntz, source string, html string")


def test_level_page(spark):
    raw = bulletin.read_level_pages(pages(spark, ("p", SEEN, "live", level_page())))
    got = {(r.dam, r.obs_datetime): r for r in bulletin.levels(raw).collect()}
    assert set(got) == {(d, t) for d in ("Angat", "La Mesa") for t in (dt.datetime(2026, 8, 7, 8, 0), dt.datetime(2026, 8, 6, 19, 30))}
    a = got[("Angat", dt.datetime(2026, 8, 7, 8, 0))]
    assert (a.rwl_m, a.nhwl_m, a.rule_curve_m, a.dev_rule_curve_m, a.inflow_cms, a.outflow_cms, a.gates) == (158.13, 210.0, 180.79, -22.66, 1250.5, None, None)
    assert got[("Angat", dt.datetime(2026, 8, 6, 19, 30))].rwl_m == 157.49
    m = got[("La Mesa", dt.datetime(2026, 8, 7, 8, 0))]
    assert m.rule_curve_m is None and m.dev_rule_curve_m is None and m.nhwl_m == 80.15


def test_year_rolls_back_and_bad_pages_are_kept(spark):
    raw = bulletin.read_level_pages(pages(
        spark, ("old", dt.datetime(2027, 1, 1, 8), "wayback", level_page(day="Dec-31")),
        ("thin", SEEN, "wayback", level_page(width=12)), ("none", SEEN, "wayback", "<p>nothing</p>"), ("null", SEEN, "wayback", None),
        ("leap", dt.datetime(2027, 3, 1), "wayback", level_page(day="Feb-29")))).cache()
    rows = bulletin.levels(raw).collect()
    stamps = {r.obs_datetime for r in rows if r.page_id == "old"}
    assert dt.datetime(2026, 12, 31, 8) in stamps and all(s.year == 2026 for s in stamps)
    assert {r.obs_datetime.month for r in rows if r.page_id == "leap"} == {8}
    status = {r.status: r.pages for r in bulletin.page_status(raw).collect()}
    assert status == {"parsed": 2, "no 13-column table with Angat": 3}


def test_alert_page(spark):
    html = ("<table><thead><tr><th>18 MAJOR RIVER BASINS</th><th>STATUS</th></tr></thead><tbody>"
            "<tr><td> Pampanga</td><td>\n <a href='x'>Flood Watch</a></td></tr><tr><td>Bicol</td><td><a>Non-Flood Watch</a></td></tr></tbody>"
            "<thead><tr><th>DAMS/RESERVOIR (SUB BASIN)</th><th>STATUS</th></tr></thead><tr><td>Angat Sub-basin</td><td>Flood Watch</td></tr>"
            "<tr><td>DAMS/RESERVOIR</td><td>Flood Watch</td></tr></table>")
    got = {r.basin: r for r in bulletin.alerts(bulletin.read_alert_pages(pages(spark, ("p", SEEN, "live", html)))).collect()}
    assert {k: (v.on_watch, v.kind) for k, v in got.items()} == {
        "Pampanga": (True, "river_basin"), "Bicol": (False, "river_basin"), "Angat Sub-basin": (True, "dam_sub_basin")}
    assert got["Bicol"].date == dt.date(2026, 8, 7)


def test_weather_payload_list_and_object(spark):
    point = lambda a, b: {"daily": {"time": ["2026-01-01", "2026-01-02"], "precipitation_sum": [a, b], "temperature_2m_mean": [1.0, None]}}
    df = spark.createDataFrame([("x", "archive", json.dumps([point(1.0, 2.0), point(3.0, None)])), ("y", "forecast", json.dumps(point(5.0, 6.0)))],
                               "dam string, source string, payload string")
    got = {(r.dam, r.date.day): r for r in payloads.weather_rows(df).collect()}
    assert got[("x", 1)].precipitation_sum == 2.0 and got[("x", 2)].precipitation_sum == 2.0 and got[("x", 1)].n_points == 2
    assert got[("y", 2)].precipitation_sum == 6.0 and got[("y", 1)].n_points == 1 and got[("y", 2)].temperature_2m_mean is None


def test_hourly_leads(spark):
    body = {"hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00", "2026-01-02T00:00"],
                       "precipitation_previous_day1": [1.0, 2.0, None], "precipitation_previous_day3": [None, None, 4.0]}}
    df = spark.createDataFrame([("x", json.dumps(body))], "dam string, payload string")
    got = {(r.date.day, r.lead): r.rain_mm for r in payloads.forecast_rows(df).collect()}
    assert got == {(1, 1): 3.0, (2, 3): 4.0}


def test_snapshot_listing(spark):
    text = json.dumps([["timestamp"], ["20260807120000"], ["20260807093000"], ["20260808000001"]])
    got = payloads.snapshot_index(spark.createDataFrame([("s", text)], "site string, payload string")).orderBy("date").collect()
    assert [r.captured_at for r in got] == [dt.datetime(2026, 8, 7, 9, 30), dt.datetime(2026, 8, 8, 0, 0, 1)]


def test_absent_optional_source_is_an_empty_typed_table(spark, tmp_path):
    empty = files.read_table(spark, str(tmp_path / "none"), schemas.ALERTS, optional=True)
    assert empty.count() == 0 and empty.schema == schemas.ALERTS
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_table(spark, str(tmp_path / "none"), schemas.ALERTS).count()


def test_csv_with_header_and_nan(spark, tmp_path):
    (tmp_path / "r.csv").write_text("dam,date,lead,rain_mm\nx,2026-01-01,2,NaN\ny,2026-01-02,3,1.5\n")
    got = files.read_table(spark, str(tmp_path / "r.csv"), schemas.RAIN_FORECAST, "csv").orderBy("dam").collect()
    assert [tuple(r) for r in got] == [("x", dt.date(2026, 1, 1), 2, None), ("y", dt.date(2026, 1, 2), 3, 1.5)]


def rain(spark, *rows):
    return spark.createDataFrame([("x", dt.date(2026, m, d), lead, float(v)) for m, d, lead, v in rows], schemas.RAIN_FORECAST)


def test_append_ignores_empty_frames(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append(rain(spark, (1, 1, 1, 1)).filter("false"), path)
    assert files.read_table(spark, path, schemas.RAIN_FORECAST, optional=True).count() == 0
    for _ in range(2):
        files.append(rain(spark, (1, 1, 1, 1)), path)
    assert files.read_table(spark, path, schemas.RAIN_FORECAST).count() == 2


def test_replacing_never_shows_half_a_table(spark, tmp_path):
    root = str(tmp_path / "weather")
    assert files.read_current(spark, root, schemas.RAIN_FORECAST).count() == 0
    assert files.replace_table(rain(spark, (1, 1, 1, 1)), root) == 1
    broken = rain(spark, (1, 1, 1, 1)).withColumn("rain_mm", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        files.replace_table(broken, root)
    assert files.read_current(spark, root, schemas.RAIN_FORECAST).count() == 1
    assert files.replace_table(rain(spark, (1, 1, 1, 1), (1, 2, 1, 1)), root) == 2
    assert files.read_current(spark, root, schemas.RAIN_FORECAST).count() == 2


def test_partition_upsert_rewrites_touched_days_only(spark, tmp_path, monkeypatch):
    root, order = str(tmp_path / "p"), [F.col("rain_mm")]
    put = lambda *rows: files.upsert_partitions(rain(spark, *rows), root, ["dam", "date", "lead"], order, "date")
    get = lambda: {(r.date, r.rain_mm) for r in files.read_partitions(spark, root, schemas.RAIN_FORECAST).collect()}
    assert get() == set()
    put((1, 1, 1, 5), (2, 1, 1, 5))
    before = files._live(spark, root)[1]
    put((2, 1, 1, 9), (2, 1, 1, 3), (2, 2, 1, 1))
    want = {(dt.date(2026, 1, 1), 5.0), (dt.date(2026, 2, 1), 9.0), (dt.date(2026, 2, 2), 1.0)}
    assert get() == want
    after = files._live(spark, root)[1]
    assert len(after) == 3 and sum(after.get(part) == folder for part, folder in before.items()) == 1
    # A writer that stops between its data and the manifest changes nothing, and the next one goes on.
    with monkeypatch.context() as broken:
        broken.setattr(files, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            put((1, 1, 1, 70), (3, 1, 1, 1))
    assert get() == want
    put((1, 1, 1, 70))
    put()
    assert get() == {(dt.date(2026, 1, 1), 70.0), *[w for w in want if w[0].month > 1]}


def test_documents_hold_null_not_nan(spark, tmp_path):
    files.write_documents(spark.createDataFrame([(1, float("nan"))], "k int, v double"), str(tmp_path / "d"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "d")).collect())
    assert json.loads(text) == {"k": 1, "v": None}


def test_table_sink_round_trip(spark, tmp_path):
    df = rain(spark, (1, 1, 1, 1), (1, 2, 3, 2))
    files.write_table(df, str(tmp_path / "t"), ["lead"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_upserts(spark):
    new = rain(spark, (1, 1, 1, 1), (1, 1, 1, 2))
    assert keys.first_seen(None, new, ["dam", "date", "lead"], "rain_mm").first().rain_mm == 1.0
    assert keys.first_seen(new, new, ["dam", "date", "lead"], "rain_mm").count() == 0
    w = "dam string, date date, source string, v int"
    day = dt.date(2026, 1, 1)
    stored = spark.createDataFrame([("x", day, "archive", 1), ("y", day, "forecast", 1)], w)
    fresh = spark.createDataFrame([("x", day, "forecast", 2), ("y", day, "forecast", 2)], w)
    got = {r.dam: (r.source, r.v) for r in keys.by_source(stored, fresh, ["dam", "date"], {"archive": 1}).collect()}
    assert got == {"x": ("archive", 1), "y": ("forecast", 2)}
    again = keys.by_source(keys.by_source(stored, fresh, ["dam", "date"], {"archive": 1}), fresh, ["dam", "date"], {"archive": 1})
    assert {r.dam: (r.source, r.v) for r in again.collect()} == got


def test_next_range(spark):
    dams = spark.createDataFrame([("x",)], "dam string")
    start, until = F.lit("2025-01-01").cast("date"), F.lit("2026-02-01").cast("date")
    first = incremental.next_range(None, 10, start, until, dams).first()
    assert (first.start_date, first.end_date) == (dt.date(2025, 1, 1), dt.date(2026, 2, 1))
    later = incremental.next_range(rain(spark, (1, 20, 1, 1)), 10, start, until, dams).first()
    assert later.start_date == dt.date(2026, 1, 10)
    plan = incremental.by_days(incremental.next_range(None, 10, start, until, dams), 180).orderBy("start_date").collect()
    assert [(r.end_date - r.start_date).days for r in plan] == [179, 179, 36]
    years = incremental.by_year(incremental.next_range(None, 10, start, until, dams)).orderBy("start_date").collect()
    assert [tuple(r)[1:] for r in years] == [(dt.date(2025, 1, 1), dt.date(2025, 12, 31)), (dt.date(2026, 1, 1), dt.date(2026, 2, 1))]
