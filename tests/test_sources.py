"""Text sources and sinks on files written by hand."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from swellframe.sources import sinks, tables, texts


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_stdmet(spark, tmp_path):
    p = put(tmp_path, "41001.txt", "#YY  MM DD hh mm WDIR WSPD GST  WVHT   DPD   APD MWD   PRES  ATMP  WTMP  DEWP\n#yr  mo dy hr mn degT m/s  m/s     m   sec   sec degT   hPa  degC  degC  degC\n2020 01 02 03 50 200  5.0 99.0  1.50 99.00  6.1 999 1012.0  20.1 999.0  15.0\n")
    r = texts.stdmet(spark, p).first()
    assert (r["station"], r["time"], r["hs"], r["tp"], r["tm"], r["gust"], r["sst"], r["mslp"]) == ("41001", 1577937000.0, 1.5, None, 6.1, None, None, 1012.0)
    p = put(tmp_path, "46002h.txt", "YY MM DD hh WSPD WVHT\n98 12 31 23 4.0 2.0\n")
    r = texts.stdmet(spark, p).first()
    assert (r["station"], r["time"], r["hs"]) == ("46002", 915145200.0, 2.0)


def test_point_table_and_series(spark, tmp_path):
    block = "  Time : {}\n head\n  units\n\n -80.0 25.0 1.5 60. 6.0 90. 20. 0.125 95. 15.\n -81.0 26.0 0.5 50. 5.0 80. 22. 0.000 85. 12.\n"
    p = put(tmp_path, "tab33.txt", block.format("2020/01/01 00:00:00") + block.format("2020/01/01 03:00:00"))
    got = texts.point_table(spark, p).orderBy("time", "lon").collect()
    assert [(r["time"], r["lon"], r["tp"]) for r in got] == [(1577836800.0, -81.0, None), (1577836800.0, -80.0, 8.0), (1577847600.0, -81.0, None), (1577847600.0, -80.0, 8.0)]
    line = " 2020010103   2.35   0.40   9.10"
    lines = spark.createDataFrame([("a", 0, "header"), ("a", 1, line)], "file string, line_no int, line string")
    r = texts.station_series(lines).first()
    assert (r["time"], r["hs"], r["spread"]) == (1577847600.0, pytest.approx(2.35), pytest.approx(0.40))


def bulletin(rows):
    head = ["Location : 41001      (34.68N  72.66W)", "Model : x", "Cycle : 20200131 12 UTC", "", "", "", ""]
    out = [f"|  {d:2d} {h:2d} |{hs:5.2f} 3   |".ljust(24) + "".join(f"{a:6.2f}{t:4.1f} {p:3d}    " for a, t, p in parts) for d, h, hs, parts in rows]
    return "\n".join(head + out + ["foot"] * 8)


def test_bulletin_month_turns_and_highest_system(spark, tmp_path):
    text = bulletin([(31, 12, 2.5, [(1.0, 9.0, 100), (2.0, 7.0, 200)]), (31, 15, 2.0, [(1.5, 8.0, 90), (1.5, 6.0, 91)]), (1, 0, 1.0, [])])
    got = texts.bulletins(texts.numbered(texts.whole(spark, put(tmp_path, "gfs.41001.bull", text)))).orderBy("time").collect()
    assert [(r["time"], r["hs"], r["tp"], r["dp"]) for r in got] == [(1580472000.0, 2.5, 7.0, 200.0), (1580482800.0, 2.0, 8.0, 90.0), (1580515200.0, 1.0, None, None)]
    assert (got[0]["lat"], got[0]["lon"], got[0]["cycle"]) == (34.68, -72.66, 1580472000.0)


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "x.station_tar", "w") as t:
        for name, n in (("gefs.41001.ts", 3), ("gefs.41002.ts", 2)):
            data = "\n".join(f" 202001010{i}   2.35   0.40   9.10" for i in range(n)).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    rows = texts.station_series(texts.tar_lines(spark, str(tmp_path / "x.station_tar")))
    got = texts.same_length(rows).collect()
    assert sorted((r["file"], r["hs"]) for r in got if r["hs"]) == [("41001", 2.35)] * 3 and sum(r["hs"] is None for r in got) == 2


def test_spectra_text(spark, tmp_path):
    head = "'SPECTRA'     3     2     1 'grid'\n 0.04 0.05 0.06\n 1.571 0.000\n"
    step = "20200101 {}0000\n'41001     '  34.7 -72.7 4000.0 5.0 180.0 0.1 90.0\n"
    p = put(tmp_path, "a.spec", head + step.format("00").replace(" 0.1 90.0", "") + " 1 2 3 4\n 5 6\n" + step.format("03").replace(" 0.1 90.0", "") + " 7 8 9 10 11 12\n")
    got = texts.spectra_text(spark, p).orderBy("time").collect()
    assert [r["efth"] for r in got] == [[[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]], [[7.0, 10.0], [8.0, 11.0], [9.0, 12.0]]]
    assert got[0]["freq"] == [0.04, 0.05, 0.06] and got[0]["station"] == "41001" and got[1]["time"] == 1577847600.0 and got[0]["depth"] == 4000.0


def test_small_lists(spark, tmp_path):
    p = put(tmp_path, "t.dat", "lon lat time\n-80.030  25.793 20200220T141000\n")
    assert [tuple(r) for r in texts.targets(spark, p).collect()] == [(-80.03, 25.793, 1582207800.0)]
    p = put(tmp_path, "s.txt", "41001\n46002\n\n41001\n")
    assert sorted(r[0] for r in texts.station_list(spark, p).collect()) == ["41001", "46002"]
    p = put(tmp_path, "p.inp", "$ comment\n -72.7 34.7 '41001'\n -70.1 30.2 '41002'\n 0.0 0.0 'STOPSTRING'\n")
    assert sorted(r[0] for r in texts.station_list(spark, p).collect()) == ["41001", "41002"]
    p = put(tmp_path, "c.txt", "0.02 -89.98 12.5\n")
    assert tuple(texts.coast_distances(spark, p).first()) == (0.02, -89.98, 12.5)
    p = put(tmp_path, "b.csv", "SID,ISO_TIME,NATURE,LAT,LON\n ,Year, ,deg,deg\nx,1999-12-31 00:00:00,TS,10,10\nx,2020-01-01 03:00:00,TS,10.5,-20.25\n")
    assert [(r["time"], r["nature"], r["lat"], r["lon"]) for r in texts.best_tracks(spark, p).collect()] == [(1577847600.0, "TS", 10.5, 339.75)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", 1577836800, 1.23456, None)], "run_id string, valid_time long, model_hs double, obs_hs double")
    sinks.write_matchups(df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert dict(back.dtypes)["model_hs"] == "float" and back.schema["model_hs"].metadata == {"units": "m"}
    assert sinks.write_altimeter_csv(df.withColumnRenamed("valid_time", "time"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["model_hs"] == "1.235"
    sinks.write_extraction(df.select("run_id", "model_hs", "obs_hs"), str(tmp_path / "x"), ("model_hs", "obs_hs"))
    assert tuple(spark.read.csv(str(tmp_path / "x"), header=True, sep="\t").first()) == ("r", "1.235", "NaN")
    f = spark.createDataFrame([(0, 10, 20, lat, 0.0, 1.239) for lat in (-80.0, 0.0)], "member int, cycle long, valid_time long, lat double, lon double, hs double")
    sinks.write_archive(f, str(tmp_path / "a"), ["member", "cycle", "valid_time", "lat", "lon", "hs"])
    assert [(r["lat"], r["hs"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()] == [(0.0, 1.24)]


def test_alias_tables(spark):
    raw = spark.createDataFrame([("s", 1, [1.0, float("nan"), 3.0], 5.0)], "station string, time long, VHM0 array<double>, WSPD double")
    r = tables.buoys(raw).first()
    assert r["hs"] == 2.0
    assert tables.with_optional(raw, ("depth",)).select(F.col("depth").isNull().alias("n")).first()["n"]
