"""Queries of the text sources, the sinks and what stands behind them (S2, S6 to S14, K1 to K3, T1).

Each writes the driver's tables in the format of the source to the folder that executors share, reads them back by the source, and is held
against SQL over the same tables. Numbers are written from integers, so that both sides have the same decimals.
"""

from __future__ import annotations

import io
import os
import tarfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks, texts
from ..storage import folder
from . import views as v
from .registry import query, rounded


def _put(path: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
    where.create_dir(at, recursive=True)
    with where.open_output_stream(os.path.join(at, name), compression=None) as out:
        out.write(data)


def written(lines: DataFrame, path: str, archive: bool = False) -> str:
    """Files (file, line_no, line; archive: also tar, the archive that the file is a member of), one group each, so files and archives are
    spread over tasks. The path that they are under."""

    def of(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("file", "ascending"), ("line_no", "ascending")])
        members: dict[str, list[str]] = {}
        for name, line in zip(group["file"].to_pylist(), group["line"].to_pylist(), strict=True):
            members.setdefault(name, []).append(line)
        data = {n: "\n".join(own).encode("latin-1") for n, own in members.items()}
        if archive:
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w") as t:
                for n, content in data.items():
                    info = tarfile.TarInfo(f"out/{n}")
                    info.size = len(content)
                    t.addfile(info, io.BytesIO(content))
            data = {key[0].as_py(): buffer.getvalue()}
        for n, content in data.items():
            _put(path, n, content)
        return pa.table({"n": pa.array([len(data)], pa.int32())})

    lines.groupBy("tar" if archive else "file").applyInArrow(of, "n int").agg(F.sum("n")).first()
    return path


def cents(x: str, n: int) -> Column:
    """An integer modulo n as a number with two decimals."""
    return F.format_string("%d.%02d", F.floor(F.expr(x) % n / 100).cast("int"), (F.expr(x) % n % 100).cast("int"))


def stamp(seconds: str, pattern: str) -> Column:
    return F.date_format(F.timestamp_seconds(F.expr(seconds)), pattern)


_BUOY = v.with_views("buoy")
_POINTS = v.with_views("points")


@query(_BUOY + "select station::varchar station, floor(time / 60) * 60.0::double as time, (event_id % 900) / 100 hs, case when event_id % 7 <> 0 then (event_id % 1500) / 100 end tp, (event_id % 361)::double wind_dir, case when event_id % 101 <> 99 then (event_id % 101)::double end wind_spd, (900 + event_id % 200)::double mslp from buoy")
def S2_standard_met(spark, sf_dir):
    """Standard meteorological files by station and day, with minutes, a second header, missing values, and values that are codes elsewhere."""
    b = v.buoy(spark, sf_dir)
    tp = F.when(F.col("event_id") % 7 != 0, cents("event_id", 1500)).otherwise("99.00")
    row = F.concat_ws(" ", stamp("time", "yyyy MM dd HH mm"), cents("event_id", 900), tp, (F.col("event_id") % 361).cast("string"), F.format_string("%d.0", F.col("event_id") % 101), F.format_string("%d.0", 900 + F.col("event_id") % 200))
    b = b.select(F.concat_ws(".", "station", stamp("time", "yyyyMMdd"), F.lit("txt")).alias("file"), (F.col("event_id") + 2).alias("line_no"), row.alias("line"))
    heads = F.array(F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("#YY MM DD hh mm WVHT DPD WDIR WSPD PRES").alias("line")), F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("#yr mo dy hr mn m sec degT m/s hPa").alias("line")))
    lines = b.unionByName(b.select("file").distinct().select("file", F.inline(heads)))
    out = texts.stdmet(spark, written(lines, folder(spark, "stdmet")))
    return rounded(out.select("station", "time", "hs", "tp", "wind_dir", "wind_spd", "mslp"))


def _steps(spark, sf_dir) -> DataFrame:
    """Points with integers behind their values: u of 0 to 899, a number for each station and time."""
    return v.points(spark, sf_dir).withColumn("u", ((F.col("valid_time") / 3600).cast("bigint") * 7 + F.col("station") * 13) % 900)


_STEPS = _POINTS + ", st as (select *, ((valid_time // 3600) * 7 + station * 13)::bigint % 900 u from points) "


@query(_STEPS + "select cycle::varchar || '.tab' file, valid_time::double as time, station::double lon, u / 100 hs, case when u % 50 > 0 then (u % 50) / 100 end fp, case when u % 50 > 0 then round(1 / ((u % 50) / 100.0::double), 6) end tp from st")
def S6_point_table(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumn("file", F.concat("cycle", F.lit(".tab")))
    fp = F.format_string("0.%02d", (F.col("u") % 50).cast("int"))
    row = F.concat_ws("  ", F.format_string("%.1f", F.col("station").cast("double")), F.lit("25.0"), cents("u", 900), F.lit("60. 6.0 90. 20."), fp, F.lit("95. 15."))
    heads = s.select("file", "valid_time").distinct().select("file", (F.col("valid_time") * 100).alias("line_no"), F.concat(F.lit(" Time : "), stamp("valid_time", "yyyy/MM/dd HH:mm:ss")).alias("line"))
    rows = s.select("file", (F.col("valid_time") * 100 + 2 + F.col("station")).alias("line_no"), row.alias("line"))
    units = heads.select("file", F.col("line_no") + 1, F.lit(" lon lat hs"))
    out = texts.point_table(spark, written(heads.union(units).union(rows), folder(spark, "table")))
    return rounded(out.select("file", "time", "lon", "hs", F.when(F.col("fp") > 0, F.col("fp")).alias("fp"), "tp"))


def _bulletin_lines(spark, sf_dir) -> DataFrame:
    """Bulletins by station and cycle: two wave systems a row; the month turns within some."""
    s = _steps(spark, sf_dir).withColumn("file", F.concat(F.lit("gfs."), "station", F.lit("-"), "cycle", F.lit(".bull")))
    system = lambda x: F.concat(F.lpad(cents(x, 600), 6, " "), F.lpad(F.format_string("%d.0", (F.expr(x) % 17 + 2).cast("int")), 4, " "), F.lit(" "), F.lpad((F.expr(x) % 360).cast("string"), 3, " "), F.lit("    "))
    row = F.concat(F.rpad(F.concat(F.lit("|  "), stamp("valid_time", "dd"), F.lit(" "), stamp("valid_time", "HH"), F.lit(" |"), F.lpad(cents("u", 900), 5, " "), F.lit(" 2   |")), 24, " "), system("u * 3"), system("u * 5"))
    rows = s.select("file", (7 + F.col("valid_time") - F.col("cycle")).alias("line_no"), row.alias("line"))
    place = F.concat(F.lit("Location : x      ("), F.format_string("%d.50", F.col("station").cast("int")), F.lit("N  "), F.format_string("%d.25", (F.col("station") + 60).cast("int")), F.lit("W)"))
    files = s.select("file", "station", "cycle").distinct()
    lines = [(0, place), (1, F.lit("Model : x")), (2, F.concat(F.lit("Cycle : "), stamp("cycle", "yyyyMMdd HH"), F.lit(" UTC"))), *[(k, F.lit("")) for k in (3, 4, 5, 6)]]
    heads = files.select("file", F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("line_no"), x.alias("line")) for k, x in lines])))
    return heads.unionByName(rows)


# the highest of two systems, the first of equal ones
_TOP = "case when (u * 5) % 600 > (u * 3) % 600 then u * 5 else u * 3 end"


@query(_STEPS + "select 'gfs.' || station || '-' || cycle || '.bull' file, station + 0.5::double lat, -(station + 60.25::double) lon, cycle::double as cycle, valid_time::double as time, u / 100 hs from st")
def S7_bulletins(spark, sf_dir):
    out = texts.bulletins(texts.lines(spark, written(_bulletin_lines(spark, sf_dir), folder(spark, "bulletins"))))
    return rounded(out.select("file", "lat", "lon", "cycle", "time", "hs"))


@query(_STEPS + f"select station, cycle, valid_time, (x % 17 + 2)::double tp, (x % 360)::double dp from (select *, {_TOP} x from st)")
def T1_highest_system(spark, sf_dir):
    out = texts.bulletins(texts.lines(spark, written(_bulletin_lines(spark, sf_dir), folder(spark, "bulletins"))))
    station = F.regexp_extract("file", r"gfs\.(\d+)-", 1).cast("bigint")
    return rounded(out.select(station.alias("station"), F.col("cycle").cast("bigint").alias("cycle"), F.col("time").cast("bigint").alias("valid_time"), "tp", "dp"))


def _series(spark, sf_dir, name: str) -> DataFrame:
    """`.ts` lines by station and cycle."""
    s = _steps(spark, sf_dir)
    row = F.concat(F.lit(" "), stamp("valid_time", "yyyyMMddHH"), F.lit("  "), *[F.lpad(cents(f"u * {k}", 900), w, " ") for k, w in ((1, 5), (2, 7), (3, 7))])
    return s.select("station", "cycle", F.concat(F.lit(name), "station", F.lit("."), F.lit("ts")).alias("member"), (1 + F.col("valid_time") - F.col("cycle")).alias("line_no"), row.alias("line"))


@query(_STEPS + "select station || '-' || cycle || '.ts' file, valid_time::double as time, u / 100 hs, (u * 2 % 900) / 100 spread, (u * 3 % 900) / 100 tp from st")
def S8_station_series(spark, sf_dir):
    s = _series(spark, sf_dir, "").select(F.concat("station", F.lit("-"), "cycle", F.lit(".ts")).alias("file"), "line_no", "line")
    out = texts.station_series(texts.lines(spark, written(s, folder(spark, "series"))))
    return rounded(out.select("file", "time", "hs", "spread", "tp"))


@query(_STEPS + "select station::varchar file, valid_time::double as time, u / 100 hs, (u * 3 % 900) / 100 tp from st")
def S9_tar_members(spark, sf_dir):
    """An archive for each cycle, with a member for each station."""
    s = _series(spark, sf_dir, "gefs.").select(F.concat("cycle", F.lit(".tar")).alias("tar"), F.col("member").alias("file"), "line_no", "line")
    out = texts.station_series(texts.tar_lines(spark, written(s, folder(spark, "tars"), archive=True)))
    return rounded(out.select("file", "time", "hs", "tp"))


@query(v.with_views("spec") + "select vec_id::varchar station, (vec_id % 50)::double lat, i, f freq, j, radians(dir) d, round(e, 9) e from spec")
def S10_spectra(spark, sf_dir):
    """A spectrum file for each vector."""
    s = v.spectra(spark, sf_dir)
    numbers = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    by_frequency = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("efth")[i][j]))
    lines = F.array(
        F.lit("'SPECTRA'     8     8     1 'grid'"), numbers(F.col("freq")), numbers(F.transform("dir", F.radians)), F.lit("20240101 000000"),
        F.concat(F.lit("'"), F.col("vec_id").cast("string"), F.lit("   '  "), F.format_string("%d.0", (F.col("vec_id") % 50).cast("int")), F.lit(" -72.7 4000.0 5.0 180.0")), numbers(F.flatten(by_frequency)),
    )
    files = s.select(F.concat("vec_id", F.lit(".spec")).alias("file"), F.posexplode(lines).alias("line_no", "line"))
    out = texts.spectra_text(spark, written(files, folder(spark, "spectra")))
    out = out.select("station", "lat", "freq", "dir", F.posexplode("efth").alias("i", "row"))
    out = out.select("station", "lat", "i", F.col("freq")[F.col("i")].alias("freq"), "dir", F.posexplode("row").alias("j", "e"))
    return out.select("station", "lat", "i", "freq", "j", F.col("dir")[F.col("j")].alias("d"), F.round("e", 9).alias("e"))


@query(v.with_views("storms") + "select floor(time)::double as time, nature, floor(lat * 2)::bigint / 2.0::double lat, (floor(lon)::bigint)::double lon from storms where year(make_timestamp((time * 1000000)::bigint)) >= 2000")
def S11_best_tracks(spark, sf_dir):
    s = v.storms(spark, sf_dir)
    lon = F.floor("lon").cast("int")
    east = F.when(lon > 180, lon - 360).otherwise(lon)
    rows = s.select(F.col("row_no").cast("string").alias("SID"), stamp("floor(time)", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"), "nature", (F.floor(F.col("lat") * 2) / 2).cast("string").alias("LAT"), east.cast("string").alias("LON"))
    rows = rows.withColumnRenamed("nature", "NATURE")
    units = spark.createDataFrame([(" ", "Year", " ", "degrees_north", "degrees_east")], rows.schema)
    path = folder(spark, "tracks")
    units.union(rows).write.option("header", True).csv(path)
    return rounded(texts.best_tracks(spark, path).select("time", "nature", "lat", "lon"))


@query(v.with_views("grid") + "select lon, lat, distcoast from grid")
def S12_coast_distances(spark, sf_dir):
    path = folder(spark, "coast")
    v.grid(spark, sf_dir).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("lon", "lat", "distcoast")])).write.text(path)
    return texts.coast_distances(spark, path)


@query(v.with_views("track") + "select floor(lon)::double lon, floor(lat)::double lat, floor(time)::double as time from track")
def S13_targets(spark, sf_dir):
    path = folder(spark, "targets")
    whole = lambda c: F.format_string("%d.0", F.floor(c).cast("int"))
    v.track(spark, sf_dir).select(F.concat_ws(" ", whole("lon"), whole("lat"), stamp("floor(time)", "yyyyMMdd'T'HHmmss"))).write.text(path)
    return texts.targets(spark, path)


@query("select distinct station from (select (user_id % 997)::varchar station from events union all select 'P' || c_nationkey from customer)")
def S14_station_list(spark, sf_dir):
    """Plain lists, and model point files with comments, quoted names and a last line that doesn't count."""
    plain = v.table(spark, sf_dir, "events").select(F.concat(F.lit("plain-"), F.floor(F.col("event_id") / 500), F.lit(".txt")).alias("file"), F.col("event_id").alias("line_no"), (F.col("user_id") % 997).cast("string").alias("line"))
    c = v.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("points-"), F.floor(F.col("c_custkey") / 500), F.lit(".inp")).alias("file")
    points = c.select(name, F.col("c_custkey").alias("line_no"), F.concat(F.lit(" -72.7 34.7 'P"), "c_nationkey", F.lit("'")).alias("line"))
    files = c.select(name).distinct()
    edges = files.select("file", F.inline(F.array(F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.lit("$ comment").alias("line")), F.struct(F.lit(1 << 60).alias("line_no"), F.lit(" 0.0 0.0 'STOPSTRING'").alias("line")))))
    path = written(plain.unionByName(points).unionByName(edges), folder(spark, "stations"))
    return texts.station_list(spark, path)


_PAIRS = v.with_views("pairs")


@query(_PAIRS + "select status run_id, date_trunc('month', valid_time)::date month_start, count(*) n, round(sum(epoch(valid_time::timestamp)) / 86400, 0) as day_sum, round(avg(model_hs::float), 4) model_hs from pairs group by 1, 2")
def K1_matchups(spark, sf_dir):
    p = v.pairs(spark, sf_dir).select(F.col("status").alias("run_id"), F.unix_timestamp(F.col("valid_time").cast("timestamp")).alias("valid_time"), "model_hs", "obs_hs")
    path = folder(spark, "matchups")
    sinks.write_matchups(p, path)
    out = spark.read.parquet(path)
    return rounded(out.groupBy("run_id", "month_start").agg(F.count("*").alias("n"), F.round(F.sum("valid_time") / 86400.0, 0).alias("day_sum"), F.avg(F.col("model_hs").cast("double")).alias("model_hs")), 4)


@query(v.with_views("track") + "select src_id, time, (src_id % 9001)::double / 8 lat, satellite_id, round((src_id % 9001)::double / 8, 3) hs from track")
def K2_altimeter_csv(spark, sf_dir):
    eighths = (F.col("src_id") % 9001).cast("double") / 8
    t = v.track(spark, sf_dir).select("src_id", "time", eighths.alias("lat"), "satellite_id", eighths.alias("hs"))
    path = folder(spark, "csv")
    sinks.write_altimeter_csv(t, path)
    return spark.read.csv(path, header=True, schema="src_id bigint, time double, lat double, satellite_id int, hs double")


@query(v.with_views("track") + "select src_id::varchar src_id, satellite_id::varchar satellite_id, case when src_id % 5 > 0 then printf('%.3f', (src_id % 9001) / 8.0::double) else 'NaN' end hs from track")
def K3_extraction(spark, sf_dir):
    hs = F.when(F.col("src_id") % 5 > 0, (F.col("src_id") % 9001).cast("double") / 8)
    path = folder(spark, "extraction")
    sinks.write_extraction(v.track(spark, sf_dir).select("src_id", "satellite_id", hs.alias("hs")), path, ("hs",))
    return spark.read.csv(path, header=True, sep="\t")
