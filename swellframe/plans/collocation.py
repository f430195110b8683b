"""Queries of the time, space and interpolation operators (J, U, W, A20, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import great_circle_km, lon180
from ..operators import geo, interp, timejoin, windows, zones
from . import views as v
from .registry import query, rounded

G = v.GRID


@query(v.with_views("points", "buoy") + "select p.station, p.valid_time, round(avg(b.hs), 6) hs, round(avg(b.tp), 6) tp, count(*) n from (select distinct station, valid_time from points) p join buoy b on p.station = b.station and abs(b.time - p.valid_time) < 1800 group by all")
def J1_window_average(spark, sf_dir):
    return rounded(timejoin.window_average(v.points(spark, sf_dir), v.buoy(spark, sf_dir), ["station"], ["hs", "tp"]))


_CODES = "codes as (select satellite_id, slot * 10800 as time, max(code) code from (select satellite_id, floor(time / 10800)::bigint slot, (user_id % 6)::int code from track) group by 1, 2)"


def _codes(spark, sf_dir):
    t = v.track(spark, sf_dir)
    return t.groupBy("satellite_id", (F.floor(F.col("time") / 10800) * 10800).alias("time")).agg(F.max((F.col("user_id") % 6).cast("int")).alias("code"))


@query(v.with_views("track") + f", {_CODES} select src_id, code from (select src_id, first(c.code order by c.time) code from track t left join codes c on t.satellite_id = c.satellite_id and abs(t.time - c.time) <= 5400 group by src_id)")
def J2_slot_lookup(spark, sf_dir):
    return timejoin.slot_lookup(v.track(spark, sf_dir), _codes(spark, sf_dir), ["satellite_id"], 5400.0, 10800.0).select("src_id", "code")


def _cells(spark, sf_dir):
    return geo.nearest_cell(v.track(spark, sf_dir), G["lat0"], G["dlat"], G["nlat"], G["lon0"], G["dlon"], G["nlon"])


_CELLS = "cells as (select *, greatest(0, least(ceil((lat + 89) / 2 - 0.5)::int, 89))::int lat_idx, (ceil(lon / 2 - 0.5)::int % 180)::int lon_idx from track)"


@query(v.with_views("track", "grid") + f", {_CELLS} select src_id, lat_idx, lon_idx, z, distcoast from cells left join (select lat_idx, lon_idx, z, distcoast from grid) using (lat_idx, lon_idx)")
def J4_nearest_cell(spark, sf_dir):
    g = v.grid(spark, sf_dir).select("lat_idx", "lon_idx", "z", "distcoast")
    return _cells(spark, sf_dir).join(g, ["lat_idx", "lon_idx"], "left").select("src_id", "lat_idx", "lon_idx", "z", "distcoast")


@query(v.with_views("track", "field") + f", {_CELLS}, s as (select *, floor(time / 21600 + 0.5)::bigint * 21600 valid_time from cells) select src_id, valid_time, lat_idx, lon_idx, round(f.hs, 6) model_hs, round(s.hs, 6) obs_hs, round(f.wnd, 6) model_wnd from s join field f using (valid_time, lat_idx, lon_idx) where abs(time - valid_time) < 1800")
def J3_satellite_matchup(spark, sf_dir):
    f = v.field(spark, sf_dir).select("valid_time", "lat_idx", "lon_idx", F.col("hs").alias("model_hs"), F.col("wnd").alias("model_wnd"))
    m = geo.satellite_matchup(_cells(spark, sf_dir), f, 21600.0, 1800.0)
    return rounded(m.select("src_id", "valid_time", "lat_idx", "lon_idx", "model_hs", F.col("hs").alias("obs_hs"), "model_wnd"))


_TARGETS = "targets as (select src_id point_id, time + 600 as time, lat + 0.1::double lat, lon + 0.1::double lon from track)"


def _targets(spark, sf_dir):
    return v.track(spark, sf_dir).select(F.col("src_id").alias("point_id"), (F.col("time") + 600).alias("time"), (F.col("lat") + 0.1).alias("lat"), (F.col("lon") + 0.1).alias("lon"))


def _extraction(values: str) -> str:
    d = v.great_circle("p.lat", "p.lon", "t.lat", "t.lon")
    means = ", ".join(f"avg(t.{c}) {c}" for c in values.split(", "))
    return (
        v.with_views("track") + f", {_TARGETS}, c as (select p.point_id, {d} <= 50 near, t.* from targets p join track t on abs(t.time - p.time) < 2700), e as (select point_id from c group by 1 having count(*) > 2), "
        f"n as (select point_id, count(*) n, {means.replace('t.', '')}, mode(satellite_id order by satellite_id) satellite_id from c where near and point_id in (from e) group by 1 having count(*) >= 2) "
    )


@query(_extraction("hs, wnd") + "select p.point_id, n, round(hs, 8) hs, round(wnd, 8) wnd from targets p left join n using (point_id)")
def J5_radius_extraction(spark, sf_dir):
    out = geo.radius_extraction(_targets(spark, sf_dir), v.track(spark, sf_dir), ["hs", "wnd"], "point_id", mission=None)
    return rounded(out.select("point_id", "n", "hs", "wnd"), 8)


_DIRS = "(select * exclude (user_id), user_id * 7.0::double % 360 wdir from track)"


@query((_extraction("wnd, wdir").replace("join track t", f"join {_DIRS} t")) + "select p.point_id, n, round(wnd, 8) wnd, round(wdir, 8) wdir from targets p left join n using (point_id)")
def J6_wind_extraction(spark, sf_dir):
    t = v.track(spark, sf_dir).withColumn("wdir", F.col("user_id") * 7.0 % 360)
    return rounded(geo.radius_extraction(_targets(spark, sf_dir), t, ["wnd", "wdir"], "point_id", mission=None).select("point_id", "n", "wnd", "wdir"), 8)


@query(
    _extraction("hs") + ", k as (select point_id, satellite_id, count(*) c from c where near and point_id in (select point_id from n) group by 1, 2) select point_id, arg_min(satellite_id, (-c, satellite_id)) satellite_id from k group by 1"
)
def T2_commonest_mission(spark, sf_dir):
    return geo.radius_means(_targets(spark, sf_dir), v.track(spark, sf_dir), [], "point_id").select("point_id", "satellite_id")


_D = v.great_circle("g.lat", "g.lon", "t.lat", "t.lon")
_NEAR = v.with_views("track", "grid") + (
    f", s as (select * replace (case when src_id % 7 <> 0 then hs end as hs, case when src_id % 11 <> 0 then wnd end as wnd), floor(time / 3600 + 0.5)::bigint slot from track), c as (select slot, g.lat_idx, g.lon_idx, src_id, t.hs, t.wnd, {_D} d from s t, grid g where abs(t.time - slot * 3600) < 1800 and abs(t.lat - g.lat) < 1.5 and {_D} <= 110), "
    "k as (select *, greatest(0, 1 - d / 111.0::double) w from (select *, row_number() over (partition by slot, lat_idx, lon_idx order by d, src_id) r from c) where r <= 8) "
)
_GRIDDED = "select slot, lat_idx, lon_idx, sum(w * hs) / nullif(sum(w) filter (hs is not null), 0) hs, sum(w * wnd) / nullif(sum(w) filter (wnd is not null), 0) wnd, case when count(hs) > 1 then sqrt(greatest(sum(w) filter (hs is not null) / nullif(sum(w) filter (hs is not null) ** 2 - sum(w * w) filter (hs is not null), 0) * (sum(w * hs * hs) - sum(w * hs) ** 2 / sum(w) filter (hs is not null)), 0)) end hs_std, count(*) n, arg_min(hs, (d, src_id)) hs_nearest from k group by 1, 2, 3"


def _gridded(spark, sf_dir):
    """Some rows lack the height, some the wind."""
    t = v.track(spark, sf_dir).withColumns({"hs": F.when(F.col("src_id") % 7 != 0, F.col("hs")), "wnd": F.when(F.col("src_id") % 11 != 0, F.col("wnd"))})
    return geo.gridded(t, v.grid(spark, sf_dir), ["hs", "wnd"], limit=110.0)


@query(_NEAR + f"select slot, lat_idx, lon_idx, round(hs, 5) hs, round(wnd, 5) wnd, round(hs_std, 4) hs_std, n from ({_GRIDDED})")
def J7_gridded_means(spark, sf_dir):
    return rounded(_gridded(spark, sf_dir).drop("hs_nearest"), 5, hs_std=4)


@query(_NEAR + f"select slot, lat_idx, lon_idx, round(hs_nearest, 6) hs_nearest from ({_GRIDDED})")
def J8_nearest_value(spark, sf_dir):
    return rounded(_gridded(spark, sf_dir).select("slot", "lat_idx", "lon_idx", "hs_nearest"))


@query(_NEAR + f"select slot, lat_idx, lon_idx, round(hs, 5) hs, round(wnd, 5) wnd, n from ({_GRIDDED}) where hs > 0.01 and wnd > 0.01 and hs < 20 and wnd < 60 and hs_std > 0.001 and n > 0")
def J9_gridded_qc(spark, sf_dir):
    return rounded(geo.gridded_qc(_gridded(spark, sf_dir)).select("slot", "lat_idx", "lon_idx", "hs", "wnd", "n"), 5)


_IN = "case when {0} between {1} and {2} then {0} end"


@query(
    _NEAR + f", r as (select * from ({_GRIDDED}) where hs > 0.01 and wnd > 0.01 and hs < 20 and wnd < 60 and hs_std > 0.001 and n > 0), f as (select r.*, hs * 1.3::double hs_cal, case when z < 0 then -z end depth, distcoast from r join grid using (lat_idx, lon_idx)) "
    f"select slot, lat_idx, lon_idx, round({_IN.format('hs', 1, 4)}, 5) hs, round({_IN.format('hs_cal', 1, 4)}, 5) hs_cal, round({_IN.format('wnd', 3, 7)}, 5) wnd, depth, distcoast from f where hs >= 1 and hs <= 4 and depth >= 80 and distcoast >= 50"
)
def J9_gridded_final(spark, sf_dir):
    g = v.grid(spark, sf_dir).select("lat_idx", "lon_idx", F.when(F.col("z") < 0, -F.col("z")).alias("depth"), "distcoast")
    r = geo.gridded_qc(_gridded(spark, sf_dir)).join(g, ["lat_idx", "lon_idx"]).withColumn("hs_cal", F.col("hs") * 1.3)
    out = geo.gridded_final(r, hs_range=(1.0, 4.0), wnd_range=(3.0, 7.0))
    return rounded(out.select("slot", "lat_idx", "lon_idx", "hs", "hs_cal", "wnd", "depth", "distcoast"), 5)


_SEG = v.with_views("track") + (
    ", s as (select *, floor(time / 3600 + 0.5)::bigint slot from track), a as (select *, first(lat) over w la, first(lon) over w lo, count(*) over (partition by satellite_id, slot) c from s where abs(time - slot * 3600) < 1800 window w as (partition by satellite_id, slot order by time, src_id)), "
    f"b as (select *, floor({v.great_circle('la', 'lo', 'lat', 'lon')} / 35)::int segment from a where c >= 2), o as (select *, row_number() over (partition by satellite_id, slot, segment order by time, src_id) - 1 r, count(*) over (partition by satellite_id, slot, segment) n from b) "
    "select satellite_id, slot, segment, count(*) n, round(avg(time), 3) as time, round(avg(lat), 6) lat, round(avg(hs), 6) hs, round(avg(wnd), 6) wnd, round(max(lon) filter (r = least(round_even(n / 2, 0)::int, n - 1)), 6) lon from o group by 1, 2, 3"
)


@query(_SEG)
def A20_along_track(spark, sf_dir):
    return rounded(geo.along_track(v.track(spark, sf_dir), ["satellite_id"], ["hs", "wnd"]), time=3)


_FINAL = _SEG.replace("round(avg(wnd), 6) wnd,", "round(avg(wnd), 6) wnd, round(avg(src_id * 7 % 3000), 6) wdepth, round(avg(src_id * 11 % 400), 6) distcoast,").replace(" select satellite_id, slot, segment, count(*) n", ", g as (select satellite_id, slot, segment, count(*) n", 1)


@query(
    _FINAL + "), h as (select * from g where wdepth >= 80 and distcoast >= 50 and hs > 0.1 and hs < 4 and wnd > 0.2 and wnd < 9 and time between 1704153600 and 1706000000) "
    "select satellite_id, slot, segment, n, time, lat, hs, wnd, lon, wdepth, distcoast from h where satellite_id in (select satellite_id from h group by 1 having count(*) > 2)"
)
def A20_final(spark, sf_dir):
    """Segments over deep and open water with plausible heights and winds, of missions that have more than two."""
    t = v.track(spark, sf_dir).withColumns({"wdepth": (F.col("src_id") * 7 % 3000).cast("double"), "distcoast": (F.col("src_id") * 11 % 400).cast("double")})
    segments = geo.along_track(t, ["satellite_id"], ["hs", "wnd", "wdepth", "distcoast"])
    return rounded(geo.along_track_final(segments, ["satellite_id"], (0.1, 4.0), (0.2, 9.0), time=(1704153600, 1706000000)), time=3)


#: Ascending axes without a fixed step, and their values in SQL.
AXES = {"lats": [-89 + 2.0 * i + (i % 3) * 0.4 for i in range(90)], "lons": [2.0 * j + (j % 5) * 0.3 for j in range(180)]}
_LAT, _LON = "(-89 + 2.0::double * i + (i % 3) * 0.4::double)", "(2.0::double * j + (j % 5) * 0.3::double)"
_AXES = v.with_views("track", "field") + f", la as (select i::int i, {_LAT} y from range(0, 90) r(i)), lo as (select j::int j, {_LON} x from range(0, 180) r(j))"


@query(
    _AXES + ", p as (select distinct lat from track), q as (select distinct lon from track), a as (select lat, arg_min(i, (abs(y - lat), i)) lat_idx from p, la group by 1), b as (select lon, arg_min(j, (least(abs(x - lon), 360 - abs(x - lon)), x > lon, j)) lon_idx from q, lo group by 1) "
    "select src_id, lat_idx, lon_idx from track join a using (lat) join b using (lon)"
)
def J4_nearest_on_axes(spark, sf_dir):
    """Latitudes and longitudes without a fixed step; longitudes go on beyond the seam."""
    return geo.nearest_on_axes(v.track(spark, sf_dir), AXES["lats"], AXES["lons"], 360.0).select("src_id", "lat_idx", "lon_idx")


_TIMES = [v.SLOT0 * 21600.0 + 21600.0 * k for k in range(12)] + [v.SLOT0 * 21600.0 + 21600.0 * k for k in range(12, 200, 3)]


@query(
    _AXES + f""", ti as (select row_number() over (order by t) - 1 k, t from (select unnest([{", ".join(map(str, _TIMES))}]::double[]) t)), tf as (select lat_idx, lon_idx, k t_idx, hs from field join ti on valid_time = t),
lb as (select i, y, lead(y) over (order by i) yn from la), ob as (select j, x, coalesce(lead(x) over (order by j), 360 + first(x) over (order by j)) xn from lo), tb as (select k, t, lead(t) over (order by k) tn from ti),
c as (select src_id, i, case when lat = y then 0 else (lat - y) / (yn - y) end a, j, (lon - x) / (xn - x) b, k, case when time = t then 0 else (time - t) / (tn - t) end c from track join lb on lat >= y and (lat < yn or yn is null and lat = y) join ob on lon >= x and lon < xn join tb on time >= t and (time < tn or tn is null and time = t)),
w as (select src_id, i + di i, (j + dj) % 180 j, k + dk k, (case di when 1 then a else 1 - a end) * (case dj when 1 then b else 1 - b end) * (case dk when 1 then c else 1 - c end) w from c, range(0, 2) x(di), range(0, 2) y(dj), range(0, 2) z(dk)),
g as (select src_id, case when count(hs) = count(*) then sum(w * hs) end v from w left join tf on t_idx = k and lat_idx = i and lon_idx = j where w > 0 group by 1)
select src_id, round(v, 6) model_hs from track left join g using (src_id)"""
)
def J10_on_axes(spark, sf_dir):
    """Steps of six hours, then of eighteen; uneven latitudes and longitudes."""
    steps = spark.createDataFrame(list(enumerate(_TIMES)), "t_idx int, valid_time double")
    f = v.field(spark, sf_dir).select("lat_idx", "lon_idx", F.col("valid_time").cast("double").alias("valid_time"), F.col("hs").alias("model_hs")).join(F.broadcast(steps), "valid_time")
    out = interp.on_axes(_inside(spark, sf_dir), f, ["model_hs"], "src_id", AXES["lats"], AXES["lons"], _TIMES, 360.0)
    return rounded(out.select("src_id", "model_hs"))


_STORM = (
    v.with_views("storms")
    + """, s as (select *, unnest(range(ceil((time - 5401) / 10800)::bigint, floor((time + 5401) / 10800)::bigint + 1)) slot, greatest(0, least(ceil((lat + 89) / 2 - 0.5)::int, 89))::int ci, (ceil(lon / 2 - 0.5)::int % 180)::int cj from storms),
t as (select *, -89 + 2.0::double * ci cla, 2.0::double * cj clo, case nature when 'TS' then 5 when 'SS' then 4 when 'ET' then 3 when 'DS' then 2 else 1 end code from s),
u as (select *, case when abs(cla) <= 20 then 500.0 when abs(cla) >= 40 then 1000.0 else 500.0 + (abs(cla) - 20) * 25.0 end::double radius from t),
c as (select slot, row_no, code, i::int lat_idx, j::int lon_idx from u, range(0, 90) a(i), range(0, 180) b(j) where abs(cla - (-89 + 2.0::double * i)) <= 10 and """
    + v.great_circle("cla", "clo", "(-89 + 2.0::double * i)", "(2.0::double * j)")
    + """ <= radius)
select slot, lat_idx, lon_idx, arg_max(code, row_no)::int code from c group by 1, 2, 3"""
)


@query(_STORM)
def J15_storm_footprints(spark, sf_dir):
    return geo.storm_footprints(v.storms(spark, sf_dir), **G)


_OCEAN = "o as (select lat_idx, lon_idx, (z <= 0 and k % 11 <> 0) ocean from grid)"
_STORM_OCEAN = _STORM.replace("with ", f"with {v.with_views('grid').removeprefix('with ').rstrip()}, {_OCEAN}, ", 1)


def _ocean(spark, sf_dir):
    return v.grid(spark, sf_dir).select("lat_idx", "lon_idx", ((F.col("z") <= 0) & (F.col("k") % 11 != 0)).alias("ocean"))


@query(_STORM_OCEAN.replace("from c group by", "from c semi join (from o where ocean) using (lat_idx, lon_idx) group by"))
def J15_over_ocean(spark, sf_dir):
    return geo.storm_footprints(v.storms(spark, sf_dir), **G, cells=_ocean(spark, sf_dir))


@query(
    _STORM_OCEAN.replace("select slot, lat_idx, lon_idx, arg_max", ", f as (select slot, lat_idx, lon_idx, arg_max") + "), m as (select distinct slot from f) "
    "select slot, case when not ocean then -1 else coalesce(f.code, 0) end code, count(*) n from o cross join m left join f using (slot, lat_idx, lon_idx) group by all"
)
def J15_storm_map(spark, sf_dir):
    """Cells of the whole map by class: land is -1."""
    cells, storms = _ocean(spark, sf_dir), v.storms(spark, sf_dir)
    found = geo.storm_footprints(storms, **G, cells=cells)
    slots = geo.storm_footprints(storms, **G).select("slot").distinct()
    return geo.storm_map(found, cells, slots).groupBy("slot", "code").agg(F.count("*").alias("n"))


def _inside(spark, sf_dir):
    return v.track(spark, sf_dir).select("src_id", "time", "lat", "lon", "hs")


@query(
    v.with_views("track", "field") + """, m as (select max(t_idx) mt from field), q as (select src_id, floor((lat + 89) / 2)::int i, floor(lon / 2)::int j, floor((time - 78892 * 21600) / 21600)::int k, (lat + 89) / 2 - floor((lat + 89) / 2) a, lon / 2 - floor(lon / 2) b, (time - 78892 * 21600) / 21600 - floor((time - 78892 * 21600) / 21600) c from track),
w as (select src_id, i + di ii, j + dj jj, k + dk kk, (case when di = 1 then a else 1 - a end) * (case when dj = 1 then b else 1 - b end) * (case when dk = 1 then c else 1 - c end) w from q, range(0, 2) x(di), range(0, 2) y(dj), range(0, 2) z(dk)),
g as (select src_id, w, hs from w left join field on t_idx = kk and lat_idx = ii and lon_idx = jj where w > 0)
select src_id, round(case when count(hs) = count(*) then sum(w * hs) end, 6) model_hs from g group by 1"""
)
def J10_trilinear(spark, sf_dir):
    f = v.field(spark, sf_dir).withColumnRenamed("hs", "model_hs")
    out = interp.trilinear(_inside(spark, sf_dir), f, ["model_hs"], "src_id", G["lat0"], G["dlat"], G["nlat"], G["lon0"], G["dlon"], G["nlon"], v.SLOT0 * 21600.0, 21600.0, 1 << 20)
    return rounded(out.select("src_id", "model_hs"))


@query(v.with_views("track", "slots") + "select src_id, s.step_time, round((time - s.step_time) / 3600, 6) fcst_hr from track t asof left join (select slot * 21600 step_time from slots) s on t.time >= s.step_time")
def J11_as_of(spark, sf_dir):
    steps = v.slots(spark, sf_dir).select((F.col("slot") * 21600).alias("step_time"))
    out = timejoin.as_of(v.track(spark, sf_dir).select("src_id", "time"), steps, [])
    return rounded(out.select("src_id", "step_time", ((F.col("time") - F.col("step_time")) / 3600).alias("fcst_hr")))


@query(
    v.with_views("grid", "track") + """, q as (select src_id, floor((lat + 89) / 2)::int i, floor(lon / 2)::int j, (lat + 89) / 2 - floor((lat + 89) / 2) a, lon / 2 - floor(lon / 2) b from track),
w as (select src_id, i + di ii, (j + dj) % 180 jj, (case when di = 1 then a else 1 - a end) * (case when dj = 1 then b else 1 - b end) w from q, range(0, 2) x(di), range(0, 2) y(dj)), g as (select src_id, w, z, distcoast from w left join grid on lat_idx = ii and lon_idx = jj where w > 0)
select src_id, round(case when count(z) = count(*) then sum(w * z) end, 6) z, round(case when count(distcoast) = count(*) then sum(w * distcoast) end, 6) distcoast from g group by 1"""
)
def J12_bilinear(spark, sf_dir):
    out = interp.bilinear(_inside(spark, sf_dir).select("src_id", "lat", "lon"), v.grid(spark, sf_dir), ["z", "distcoast"], "src_id", **G)
    return rounded(out.select("src_id", "z", "distcoast"))


_MASK = v.with_views("grid") + """, a as (select *, case when z <= 0 then -z end depth, case when z <= 0 then distcoast end dc from grid), b as (select *, case when depth is not null then case when depth >= 80 and dc >= 50 then 1.0 else 0.0 end end::double m from a),
l as (select lat_idx, m lm from b where lon_idx = (select max(lon_idx) from b)), c as (select b.*, case when lon_idx = 0 and l.lat_idx is not null then lm else m end mask from b left join l using (lat_idx)) """


_SPARSE = "slots where slot % 29 < 3"


@query(v.with_views("track", "slots") + f"select src_id, s.step_time from track t asof left join (select slot * 21600 step_time from {_SPARSE}) s on t.time >= s.step_time")
def J11_as_of_gaps(spark, sf_dir):
    """Steps with gaps of a week, longer than a bucket of a day."""
    steps = v.slots(spark, sf_dir).where("slot % 29 < 3").select((F.col("slot") * 21600).alias("step_time"))
    return timejoin.as_of(v.track(spark, sf_dir).select("src_id", "time"), steps, [], width=86400.0).select("src_id", "step_time")


@query(_MASK + "select lat_idx, lon_idx, depth, dc distcoast, mask from c")
def J13_grid_mask(spark, sf_dir):
    return interp.grid_mask(v.grid(spark, sf_dir)).select("lat_idx", "lon_idx", "depth", "distcoast", "mask")


def _polygons(spark, sf_dir):
    n = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("zone_id"), ((F.col("n_nationkey") * 14 % 340).cast("double") + 0.013).alias("x"), ((F.col("n_nationkey") * 4 - 55).cast("double") + 0.03).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat"))
    return n.select("zone_id", F.col("zone_id").alias("zone_order"), F.array(at(0, 0), at(20, 0), at(0, 12)).alias("ring"))


@query(
    v.with_views("track") + """, x as (select nation_id z, ox, oy from (select n_nationkey nation_id, (n_nationkey * 14 % 340)::double + 0.013::double ox, (n_nationkey * 4 - 55)::double + 0.03::double oy from nation))
select src_id, coalesce(max(z), 0)::int zone_id from track left join x on lon > ox and lon < ox + 20 and lat > oy and lat < oy + 12 and (lat - oy) < (12.0::double - (lon - ox) * 0.6::double) group by src_id"""
)
def J14_zones(spark, sf_dir):
    return zones.tagged(v.track(spark, sf_dir).select("src_id", "lat", "lon"), _polygons(spark, sf_dir), "src_id").select("src_id", "zone_id")


@query(
    v.with_views("grid") + """, x as (select nation_id z, ox, oy from (select n_nationkey nation_id, (n_nationkey * 14 % 340)::double + 0.013::double ox, (n_nationkey * 4 - 55)::double + 0.03::double oy from nation))
select lat_idx, lon_idx, case when max(g.z) <= 0 then coalesce(max(x.z), 0)::int end zone_id from grid g left join x on lon > ox and lon < ox + 20 and lat > oy and lat < oy + 12 and (lat - oy) < (12.0::double - (lon - ox) * 0.6::double) group by 1, 2"""
)
def J14_grid_zones(spark, sf_dir):
    """Zones of grid cells; land has none."""
    g = v.grid(spark, sf_dir).select("k", "lat_idx", "lon_idx", "lat", "lon", (F.col("z") > 0).alias("land"))
    return zones.tagged(g, _polygons(spark, sf_dir), "k", land="land").select("lat_idx", "lon_idx", "zone_id")


def _with_holes(spark, sf_dir):
    """Frames that stand across the seam for some nations: a square of 24 degrees with a hole of 8, and an island in it."""
    n = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("zone_id"), ((F.col("n_nationkey") * 14 % 360).cast("double") + 0.013).alias("x"), ((F.col("n_nationkey") * 4 - 55).cast("double") + 0.03).alias("y"))
    wrapped = lambda x: F.when(x > 180, x - 360).otherwise(x)
    at = lambda dx, dy: F.struct(wrapped(F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat"))
    square = lambda a, b: F.array(at(a, a), at(b, a), at(b, b), at(a, b))
    return n.select("zone_id", F.col("zone_id").alias("zone_order"), F.array(square(0, 24), square(8, 16), square(11, 13)).alias("rings"))


_FRAME = " or ".join(f"(lon + s > ox + {a} and lon + s < ox + {b} and lat > oy + {a} and lat < oy + {b})" for a, b in ((0, 24),))
_IN_HOLE, _ON_ISLAND = (_FRAME.replace("+ 0 ", f"+ {a} ").replace("+ 24 ", f"+ {b} ").replace("+ 24)", f"+ {b})") for a, b in ((8, 16), (11, 13)))


@query(
    v.with_views("track") + f""", x as (select n_nationkey z, (n_nationkey * 14 % 360)::double + 0.013::double ox, (n_nationkey * 4 - 55)::double + 0.03::double oy from nation)
select src_id, coalesce(max(z), 0)::int zone_id from track left join (select * from x, (values (0.0::double), (360.0::double)) r(s)) y on ({_FRAME}) and (not ({_IN_HOLE}) or ({_ON_ISLAND})) group by src_id"""
)
def J14_zones_with_holes(spark, sf_dir):
    return zones.tagged(v.track(spark, sf_dir).select("src_id", "lat", "lon"), _with_holes(spark, sf_dir), "src_id").select("src_id", "zone_id")


@query(v.with_views("buoy") + ", a as (select station, time, hs, 'a' source from buoy where station % 3 <> 0), b as (select station, time, tp hs, 'b' source from buoy where station % 2 = 0) select station, source, count(*) n, round(sum(hs), 4) total from (from a union all (from b where station not in (select station from a))) group by all")
def J16_source_fallback(spark, sf_dir):
    b = v.buoy(spark, sf_dir)
    first = b.where("station % 3 <> 0").select("station", "time", "hs", F.lit("a").alias("source"))
    second = b.where("station % 2 = 0").select("station", "time", F.col("tp").alias("hs"), F.lit("b").alias("source"))
    return rounded(timejoin.fallback(first, second, "station").groupBy("station", "source").agg(F.count("*").alias("n"), F.sum("hs").alias("total")), 4)


@query(v.with_views("field") + ", b as (select valid_time, lat_idx, lon_idx, hs * (1 + lat_idx * 0.001::double) hs from field) select valid_time, round(avg(b.hs - a.hs), 6) mean, round(max(abs(b.hs - a.hs)), 6) most from field a join b using (valid_time, lat_idx, lon_idx) group by 1")
def J18_run_difference(spark, sf_dir):
    a = v.field(spark, sf_dir).select("valid_time", "lat_idx", "lon_idx", "hs")
    b = a.select("valid_time", "lat_idx", "lon_idx", (F.col("hs") * (1 + F.col("lat_idx") * 0.001)).alias("other"))
    d = F.col("other") - F.col("hs")
    return rounded(a.join(b, ["valid_time", "lat_idx", "lon_idx"]).groupBy("valid_time").agg(F.avg(d).alias("mean"), F.max(F.abs(d)).alias("most")))


@query(v.with_views("buoy", "points") + "select p.station, floor(p.valid_time / 3600)::bigint as hour, count(*) n, round(avg(b.hs), 6) hs_b from points p join buoy b on p.station = b.station and floor(p.valid_time / 3600) = floor(b.time / 3600) group by all")
def J19_hour_matched(spark, sf_dir):
    p = v.points(spark, sf_dir).select("station", F.col("valid_time").alias("time"))
    out = timejoin.hour_matched(p, v.buoy(spark, sf_dir).select("station", "time", "hs"), ["station"])
    return rounded(out.groupBy("station", "hour").agg(F.count("*").alias("n"), F.avg("hs_b").alias("hs_b")))


@query(v.with_views("buoy", "points") + ", p as (select distinct station, valid_time as time from points) select p.station, p.time, round(arg_min(b.hs, (abs(b.time - p.time), b.time)), 6) hs from p left join buoy b on p.station = b.station and abs(b.time - p.time) <= 1800 group by all")
def J19_nearest_in_time(spark, sf_dir):
    p = v.points(spark, sf_dir).select("station", F.col("valid_time").alias("time")).distinct()
    return rounded(timejoin.nearest_in_time(p, v.buoy(spark, sf_dir).select("station", "time", "hs"), ["station"], ["hs"], 1800.0))


@query(v.with_views("points") + "select station, cycle, count(*) n, min(valid_time) as first from (select * from points where station < 5 union all select * from points where station >= 5) group by all")
def U1_append(spark, sf_dir):
    p = v.points(spark, sf_dir)
    return timejoin.appended(p.where("station < 5"), p.where("station >= 5")).groupBy("station", "cycle").agg(F.count("*").alias("n"), F.min("valid_time").alias("first"))


@query(v.with_views("slots", "track") + "select slot as valid_slot from (select slot from slots intersect select floor(time / 21600)::bigint from track where abs(time - floor(time / 21600 + 0.5) * 21600) < 1800)")
def U2_common_times(spark, sf_dir):
    t = v.track(spark, sf_dir).where(F.abs(F.col("time") - F.floor(F.col("time") / 21600 + 0.5) * 21600) < 1800).select(F.floor(F.col("time") / 21600).alias("slot"))
    return timejoin.common_times(v.slots(spark, sf_dir), t, ["slot"]).withColumnRenamed("slot", "valid_slot")


@query(v.with_views("points") + "select station, cycle_id, valid_time, min(valid_time) over (partition by station, cycle_id) as cycle, valid_time - min(valid_time) over (partition by station, cycle_id) as lead from (select station, cycle cycle_id, valid_time from points)")
def P7_first_time_cycle(spark, sf_dir):
    return timejoin.with_cycle(v.points(spark, sf_dir).select("station", F.col("cycle").alias("cycle_id"), "valid_time"), ["station", "cycle_id"]).select("station", "cycle_id", "valid_time", "cycle", "lead")


@query(v.with_views("points", "track") + ", m as (select valid_time from points where station = 3 and valid_time % 86400 = 0 and valid_time < 1705000000) select src_id from track where time between (select min(valid_time) from m) - 10800 and (select max(valid_time) from m) + 10800")
def A23_within_extent(spark, sf_dir):
    m = v.points(spark, sf_dir).where("station = 3 and valid_time % 86400 = 0 and valid_time < 1705000000")
    return timejoin.within_extent(v.track(spark, sf_dir), m).select("src_id")


@query(v.with_views("points") + "select distinct (valid_time - cycle) lead_s from points")
def U3_unique_leads(spark, sf_dir):
    return v.points(spark, sf_dir).select((F.col("valid_time") - F.col("cycle")).alias("lead_s")).distinct()


@query(v.with_views("track") + "select satellite_id, count(*) n, round(avg(hs), 6) hs from track group by 1")
def U4_stack_missions(spark, sf_dir):
    t = v.track(spark, sf_dir)
    parts = {i: t.where(F.col("satellite_id") == i).drop("satellite_id") for i in range(3)}
    return rounded(timejoin.stacked(parts).groupBy("satellite_id").agg(F.count("*").alias("n"), F.avg("hs").alias("hs")))


#: Rows of the events table (all stations together) whose series are worked on as one part.
SERIES_PART = 200_000


def _gappy(spark, sf_dir):
    return v.buoy(spark, sf_dir).select("station", "event_id", F.when(F.col("event_id") % 10 >= 4, F.col("hs")).alias("hs"))


@query(
    v.with_views("buoy") + """, g as (select station, event_id, case when event_id % 10 >= 4 then hs end hs, row_number() over (partition by station order by event_id) n from buoy),
f as (select *, last_value(case when hs is not null then n end ignore nulls) over (partition by station order by n rows between unbounded preceding and current row) an, last_value(hs ignore nulls) over (partition by station order by n rows between unbounded preceding and current row) ax,
first_value(case when hs is not null then n end ignore nulls) over (partition by station order by n rows between current row and unbounded following) bn, first_value(hs ignore nulls) over (partition by station order by n rows between current row and unbounded following) bx from g)
select station, event_id, round(coalesce(hs, case when n - an <= 3 then case when bn is null then ax else ax + (bx - ax) * (n - an) / (bn - an) end end), 6) hs from f"""
)
def W1_filled_gaps(spark, sf_dir):
    return rounded(windows.filled(_gappy(spark, sf_dir), ["station"], "event_id", "hs", 3, SERIES_PART))


@query(v.with_views("ev") + ", d as (select event_id, user_id % 10 station, (event_id // 40 % 28 + 1)::int as day from ev), l as (select *, case when day < lag(day) over (partition by station order by event_id) then 1 else 0 end f from d) select event_id, sum(f) over (partition by station order by event_id rows unbounded preceding)::bigint as months from l")
def W2_rolled_months(spark, sf_dir):
    d = v.buoy(spark, sf_dir).select("station", "event_id", (F.floor(F.col("event_id") / 40) % 28 + 1).cast("int").alias("day"))
    return windows.rolled_months(d, ["station"], "event_id", "day", SERIES_PART).select("event_id", "months")


@query(_NEAR + "select slot, lat_idx, lon_idx, src_id, r::int as r from k")
def W3_nearest_ranks(spark, sf_dir):
    s = F.floor(F.col("time") / 3600 + 0.5)
    t = v.track(spark, sf_dir).withColumn("slot", s).where(F.abs(F.col("time") - F.col("slot") * 3600) < 1800)
    from pyspark.sql import Window

    from ..functions.columns import cell3, touching

    g = v.grid(spark, sf_dir).select("lat_idx", "lon_idx", F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    near = t.withColumn("cell", cell3(F.col("lat"), F.col("lon"), 110.0)).join(g.withColumn("cell", F.explode(touching(cell3(F.col("glat"), F.col("glon"), 110.0)))), "cell")
    near = near.withColumn("d", great_circle_km(F.col("glat"), F.col("glon"), F.col("lat"), F.col("lon"))).where("d <= 110")
    r = F.row_number().over(Window.partitionBy("slot", "lat_idx", "lon_idx").orderBy("d", "src_id"))
    return near.select("slot", "lat_idx", "lon_idx", "src_id", r.alias("r")).where("r <= 8")


@query(v.with_views("points") + "select station, cycle, valid_time, (row_number() over (partition by station, cycle order by valid_time) - 1)::int lead_idx from points")
def W5_lead_index(spark, sf_dir):
    return windows.lead_index(v.points(spark, sf_dir), ["station", "cycle"]).select("station", "cycle", "valid_time", "lead_idx")


_W = ", ".join(f"({k - 4}, {w!r}::double)" for k, w in enumerate(windows.gaussian_weights(1.0)))
_HOURS = v.with_views("buoy") + ", h as (select station, floor(time / 86400)::bigint as day, avg(hs) hs from buoy group by all), i as (select station, (row_number() over (partition by station order by day) - 1)::int i, hs from h), n as (select station, count(*) n from i group by 1) "


def _daily(spark, sf_dir):
    from pyspark.sql import Window

    d = v.buoy(spark, sf_dir).groupBy("station", F.floor(F.col("time") / 86400).alias("day")).agg(F.avg("hs").alias("hs"))
    return d.withColumn("i", F.row_number().over(Window.partitionBy("station").orderBy("day")) - 1)


@query(_HOURS + f", w(k, w) as (values {_W}), a as (select station, i, w, ((i + k) % (2 * n) + 2 * n) % (2 * n) m, n from i join n using (station), w) select a.station, a.i, round(sum(w * x.hs), 6) smooth from a join i x on x.station = a.station and x.i = case when m < n then m else 2 * n - 1 - m end group by 1, 2")
def W6_smoothed(spark, sf_dir):
    return rounded(windows.smoothed(_daily(spark, sf_dir), ["station"], "i", "hs"))


def _along(source: str, axis: str, other: str, value: str, sigma: float) -> str:
    """Gaussian smoothing of a table (s, i, value) along one of its axes, with mirrored edges."""
    w = windows.gaussian_weights(sigma)
    taps = ", ".join(f"({k - len(w) // 2}, {x!r}::double)" for k, x in enumerate(w))
    return (
        f"(select a.s, a.i, sum(a.w * x.{value}) g from (select t.s, t.i, k.w, (({axis} + k) % (2 * n) + 2 * n) % (2 * n) m, n from {source} t join (select {other}, max({axis}) + 1 n from {source} group by 1) using ({other}), (values {taps}) k(k, w)) a "
        f"join {source} x on x.{other} = a.{other} and x.{axis} = case when a.m < a.n then a.m else 2 * a.n - 1 - a.m end group by 1, 2)"
    )


_2D = _HOURS + ", d as (select station::int s, i, hs from i), " + ", ".join(f"{n}1 as {_along('d', 's', 'i', 'hs', g)}, {n} as {_along(f'{n}1', 'i', 's', 'g', g)}" for n, g in (("wide", 1.0), ("thin", 0.5)))


@query(_2D + " select 0 run, s, i, round(hs, 6) hs, round((hs + wide.g + thin.g) / 3, 6) smooth from d join wide using (s, i) join thin using (s, i)")
def W7_smoothed_2d(spark, sf_dir):
    d = _daily(spark, sf_dir).select(F.lit(0).alias("run"), F.col("station").cast("int").alias("s"), "i", "hs")
    return rounded(windows.smoothed_2d(d, ["run"], "s", "i", "hs"))


@query(v.with_views("track") + "select src_id, round(case when lon > 180 then lon - 360 else lon end, 6) lon from track")
def P2_wrapped_longitude(spark, sf_dir):
    return rounded(v.track(spark, sf_dir).select("src_id", lon180(F.col("lon")).alias("lon")))
