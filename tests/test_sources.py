import gzip
import io
import json
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmaq.operators import matching, spatial
from tarmaq.sources import sinks, tables, tracks, weather

PLACES = {"AAA": (48.0, 11.0), "BBB": (-0.05, 0.02)}


def test_weather(spark, tmp_path):
    head = "station,valid,tmpc,dwpc,vsby,wxcodes,sknt,gust,skyl1,skyc1\n"
    (tmp_path / "a.csv").write_text(head + "X,2025-01-01 00:00,2.0,1.0,M,null,5,M,800,BKN\nX,2025-01-01 05:59,9,1,3,-SN FG,x,1,700,FEW\nX,bad,1,1,1,RA,1,1,1,OVC\nX,2025-01-01 06:00,M,1,1,M,1,1,1,OVC\n")
    w = weather.conditions(weather.scan_reports(spark, str(tmp_path / "*.csv")))
    rows = {r["wx_time"]: r for r in w.collect()}
    a, b, c = (rows[k] for k in sorted(rows))
    assert (a["wx_ceiling_ft"], a["wx_visibility_mi"], a["wx_icing_risk"], a["wx_icing_hours_6h"]) == (800.0, None, 1, 1.0)
    assert (b["wx_ceiling_ft"], b["wx_wind_kt"], b["wx_snow"], b["wx_fog"], b["wx_icing_risk"]) == (99999.0, None, 1, 1, 1)
    assert (c["wx_icing_risk"], c["wx_icing_hours_6h"]) == (None, 1.0)
    flights = spark.createDataFrame([(1, "X", a["wx_time"] + 7_200_000_000), (2, "X", a["wx_time"] + 7_200_000_001), (3, "Y", a["wx_time"])], "id int, apt string, t long")
    assert {r["id"]: r["wx_temp_c"] for r in weather.join_weather(flights, w, "apt", "t").collect()} == {1: 2.0, 2: None, 3: None}


def trace():
    point = lambda dt, lat, lon, alt, flags=0, flight=None: [dt, lat, lon, alt, 12.0, 0, flags, None, {"flight": flight} if flight else None]
    return {"icao": "abc", "timestamp": 1000.0, "trace": [point(0, 48.01, 11.0, "ground"), point(10, 48.01, 11.0, "ground", 0, "DLH1 "), point(20, 48.02, 11.0, 500), point(30, 48.02, 11.0, 9000), point(40, 48.02, 11.0, 700, 2), point(50, 48.02, 11.0, 900, 0, "DLH2"), point(60, 50.0, 20.0, 100), point(70, None, 20.0, 100)]}


def test_tracks(spark, tmp_path):
    raw = json.dumps(trace(), indent=1).encode()
    far = json.dumps(trace() | {"trace": [[0, 10.0, 10.0, 5, 1]]}).encode()
    with tarfile.open(tmp_path / "day.tar", "w") as tar:
        for name, body in (("a/trace_full_1.json", gzip.compress(raw)), ("a/trace_full_2.json", far), ("a/other.json", raw), ("a/trace_full_3.json", b"[1.0,48.01,11.0 broken")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    files = tracks.archive_members(spark, str(tmp_path / "*.tar"))
    assert files.count() == 3
    docs = tracks.documents(files, PLACES)
    points = tracks.decode(docs, PLACES).orderBy("t").collect()
    assert [(r["t"], r["ground"], r["alt"], r["callsign"], r["callsign_next"]) for r in points] == [
        (1000.0, True, None, None, "DLH1"), (1010.0, True, None, "DLH1", "DLH1"), (1020.0, False, 500, "DLH1", None), (1040.0, False, 700, "DLH1", "DLH2"), (1050.0, False, 900, "DLH2", "DLH2"),
    ]
    assert {r["apt"] for r in points} == {"AAA"}


@pytest.mark.parametrize("lat, lon", [(48.1, 11.1), (47.9, 10.9), (0.04, -0.05), (-0.1, 0.1)])
def test_prefilter_keeps_what_is_near(lat, lon):
    assert tracks.prefilter(PLACES).search(f"[0,{lat},{lon},1]".encode())


def test_output(spark, tmp_path):
    template = spark.createDataFrame([(1, None), (2, None), (3, None)], "id long, y int")
    pred = spark.createDataFrame([(1, 2.5), (2, -7.0), (3, 1e9), (4, 1.0)], "id long, pred double")
    with pytest.raises(ValueError, match="1 rows have no prediction"):
        sinks.fill_template(template, pred.where("id <> 2"), "id", "y")
    sinks.write_final(sinks.fill_template(template, pred, "id", "y"), str(tmp_path / "out"))
    out = tables.scan(spark, str(tmp_path / "out"))
    assert {r["id"]: r["y"] for r in out.collect()} == {1: 2, 2: 0, 3: 172800}
    assert sinks.verify_output(out, template, pred, "id", "y", 2.0) == []
    wrong = out.unionByName(out.where("id = 1")).withColumn("y", F.when(F.col("id") == 2, None).otherwise(F.col("y") + 1))
    assert len(sinks.verify_output(wrong, template, pred, "id", "y", 90.0)) == 5
    with pytest.raises(Exception, match="exists"):
        sinks.write_final(out, str(tmp_path / "out"))


def test_names_and_stages(spark, tmp_path):
    assert sinks.next_version([], "t") == "t_v1.parquet"
    assert sinks.next_version(["x/t_v2.parquet", "t_v10.parquet", "u_v99.parquet", "t_vx.parquet"], "t") == "t_v11.parquet"
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.materialise(spark, str(tmp_path / "s"), make).count() == 3
    assert len(calls) == 1
    with pytest.raises(FileNotFoundError):
        tables.scan(spark, str(tmp_path / "none*.parquet"))
    assert tables.missing_columns(spark.range(1), ["id", "x"]) == ["x"]
    days = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02")], "id int, day string")
    sinks.write_days(days, str(tmp_path / "d"))
    sinks.write_days(days.where("id = 1").withColumn("id", F.lit(5)), str(tmp_path / "d"))
    assert sorted(r["id"] for r in tables.scan_days(spark, str(tmp_path / "d"), ["2025-01-01", "2025-01-02"]).collect()) == [2, 5]
    assert tables.scan_days(spark, str(tmp_path / "d"), ["2025-01-02"]).count() == 1


def test_simulator_csv(spark, tmp_path):
    head = "id,phase,wake,runway,off_block_time,unimpeded_taxi_sec,landing_time\n"
    (tmp_path / "ok.csv").write_text(head + "1,DEP,m,09L,0,300,0\n\n2,ARR,H,09L,0,0,290\n")
    (tmp_path / "bad.csv").write_text(head + "1,TAXI,M,09L,0,300,0\n")
    assert sinks.read_movements_csv(spark, str(tmp_path / "ok.csv")).count() == 2
    with pytest.raises(Exception, match="malformed"):
        sinks.read_movements_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_track_reading(spark):
    t0 = 100_000.0
    parked = [(t0 - 3000 + 30 * k, True, 0.0, 48.0, 11.0) for k in range(60)]
    rolling = [(t0 - 1200 + 20 * k, True, 5.0, 48.0 + 0.0005 * k, 11.0) for k in range(1, 58)]
    flown = [(t0 + 10, False, 80.0, 48.1, 11.0)]
    p = pd.DataFrame(parked + rolling + flown, columns=["t", "ground", "gs", "lat", "lon"])
    points = spark.createDataFrame(p).withColumn("vehicle", F.lit("v"))
    match = spark.createDataFrame([(1, "v", t0)], "id long, vehicle string, takeoff double")
    seen = matching.observe(match, points).first()
    assert seen["lift"] == t0 + 10 and seen["first_ground"] == t0 - 3000 and seen["appear"] == t0 - 3000 and seen["stand_dwell"] == 1770.0
    assert seen["move"] == t0 - 1180 and seen["resolution"] == 50.0 and seen["dwell_lat"] == [48.0] and seen["dwell_lon"] == [11.0]
    pad = spark.createDataFrame([(48.0, 11.0002), (10.0, 10.0)], "lat double, lon double")
    barred = matching.observe(match, points, pad).first()
    assert barred["move"] is None and barred["stand_dwell"] is None and barred["dwell_lat"] == [48.0]
    # An earlier flight, a silence, an outlier while parked, and no lift-off: the stay counts from the landing.
    t1 = 50_000.0
    rows = [(t1 - 9000, True, 0.0, 48.0, 11.0), (t1 - 8000, False, 90.0, 48.2, 11.0), (t1 - 5000, True, 9.0, 48.1, 11.0)]
    rows += [(t1 - 4000 + 100 * k, True, 0.0, 48.01 if k == 7 else 48.05, 11.0) for k in range(20)]
    rows += [(t1 - 2000, True, 0.6, 48.05, 11.0), (t1 - 1950, True, 0.7, 48.05, 11.0), (t1 - 1000, True, 8.0, 48.07, 11.0), (t1, True, 30.0, 48.09, 11.0)]
    other = spark.createDataFrame([("w", *r) for r in rows], "vehicle string, t double, ground boolean, gs double, lat double, lon double")
    out = matching.observe(spark.createDataFrame([(2, "w", t1), (3, "none", t1)], "id long, vehicle string, takeoff double"), other).collect()
    assert len(out) == 1 and out[0]["lift"] is None and out[0]["first_ground"] == t1 - 5000
    assert out[0]["appear"] == t1 and out[0]["stand_dwell"] == 2050.0 and out[0]["move"] == t1 - 2000 and out[0]["resolution"] == 100.0
    lifted = matching.lift_offs(points.select("vehicle", "t", "ground"), ["vehicle"]).collect()
    assert [r["t"] for r in lifted] == [t0 + 10]


def test_spatial(spark):
    df = spark.createDataFrame([(48.01, 11.0), (0.0, 0.0), (None, 1.0)], "lat double, lon double")
    got = [r[0] for r in df.select(spatial.nearest_place(F.col("lat"), F.col("lon"), PLACES)).collect()]
    assert [g and g["code"] for g in got] == ["AAA", "BBB", None] and abs(got[0]["km"] - 1.11195) < 1e-9
    spots = spark.createDataFrame([(1, 60.0, 5.0, "a"), (2, 60.0, 5.0005, "b"), (3, 60.0, 5.002, "c"), (4, 60.0, 5.0, None)], "id int, lat double, lon double, label string")
    assert {r["id"]: r["n_labels"] for r in spatial.labels_near(spots, 30.0).collect()} == {1: 2, 2: 2, 3: 1, 4: 2}
