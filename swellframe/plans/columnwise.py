"""Queries of the scalar, quality-control, spectral and source operators (P, F, X, S, K4, J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import spectra as sp
from ..operators import qc
from ..sources import sinks, tables
from . import views as v
from .registry import query, rounded

_TRACK, _BUOY, _GRID, _POINTS = (v.with_views(n) for n in ("track", "buoy", "grid", "points"))


@query(_TRACK + "select src_id, round(src_id * 86400.0 - 631152000.0, 3)::double days_1950, round(src_id * 3600.0 + 473385600.0, 3)::double hours_1985 from track")
def P1_decoded_time(spark, sf_dir):
    n = F.col("src_id").cast("double")
    return v.track(spark, sf_dir).select("src_id", c.decoded_time(n, "days", "1950-01-01T00:00:00").alias("days_1950"), c.decoded_time(n, "hours", "1985-01-01 00:00:00+00:00").alias("hours_1985"))


@query(_TRACK + "select src_id, round(wnd * pow(10 / coalesce(case when user_id % 4 > 0 then 3.0 + user_id % 4 end, 4.0), 0.12::double), 6) wnd10 from track")
def P3_wind_height(spark, sf_dir):
    t = v.track(spark, sf_dir)
    return rounded(t.select("src_id", c.wind_at_height(F.col("wnd"), F.when(F.col("user_id") % 4 > 0, 3.0 + F.col("user_id") % 4)).alias("wnd10")))


@query(_TRACK + "select src_id, round(sqrt(hs * hs + wnd * wnd), 6) speed from track")
def P4_wind_speed(spark, sf_dir):
    return rounded(v.track(spark, sf_dir).select("src_id", c.wind_speed(F.col("hs"), F.col("wnd")).alias("speed")))


@query(_TRACK + "select src_id, case when user_id % 7 > 0 then round(1.0::double / (user_id % 7), 6) end tp from track")
def P5_period(spark, sf_dir):
    return rounded(v.track(spark, sf_dir).select("src_id", c.period((F.col("user_id") % 7).cast("double")).alias("tp")))


@query(_GRID + "select lat_idx, lon_idx, case when z < 0 then -z end depth, case when z < 0 then distcoast end distcoast from grid")
def P6_depth(spark, sf_dir):
    d = c.depth_below(F.col("z"))
    return v.grid(spark, sf_dir).select("lat_idx", "lon_idx", d.alias("depth"), F.when(d.isNotNull(), F.col("distcoast")).alias("distcoast"))


@query(_POINTS + "select station, cycle, valid_time, valid_time - cycle lead_s, month(to_timestamp(valid_time))::int as month from points")
def P7_month_and_lead(spark, sf_dir):
    return v.points(spark, sf_dir).select("station", "cycle", "valid_time", c.lead_seconds(F.col("valid_time"), F.col("cycle")).alias("lead_s"), F.month(F.timestamp_seconds("valid_time")).alias("month"))


@query("select vec_id, round(list_avg(list_filter(list_transform(embedding, lambda x: x::double), lambda x: x > 0)), 6) mean from embeddings")
def P8_depth_mean(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    return rounded(e.select("vec_id", c.mean_of(F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")))).alias("mean")))


@query("select event_id, round(value / 3, 2) q from events")
def P9_quantised(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select("event_id", c.quantised(F.col("value") / 3).alias("q"))


@query(_TRACK + f"select src_id, round({v.great_circle('lat', 'lon', '0.0', '180.0')}, 4) km, round(greatest(0, 1 - {v.great_circle('lat', 'lon', '0.0', '180.0')} / 20001), 6)::double weight from track")
def P10_P11_distance_weight(spark, sf_dir):
    d = c.great_circle_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(180.0))
    return rounded(v.track(spark, sf_dir).select("src_id", d.alias("km"), c.distance_weight(d, 20000.0).alias("weight")), km=4)


@query(_GRID + "select a.lat, b.lon from (select distinct lat from grid) a, (select distinct lon from grid) b")
def P12_grid_points(spark, sf_dir):
    g = v.grid(spark, sf_dir)
    return g.select("lat").distinct().crossJoin(F.broadcast(g.select("lon").distinct()))


@query("select event_id, ['JASON-3', 'SENTINEL-3A', 'CFOSAT'][user_id % 3 + 1] as name, [0, 6, 14][user_id % 3 + 1]::int id from events")
def P13_missions(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("JASON3"), F.lit("SENTINEL3A"), F.lit("CFOSAT")), (F.col("user_id") % 3 + 1).cast("int"))
    return v.table(spark, sf_dir, "events").select("event_id", c.mission_name(raw).alias("name"), c.mission_id(raw).alias("id"))


@query("select event_id, case when value / 10 between 0 and 30 then round(value / 10, 6) end hs, case when value - 50 between -70 and 70 then round(value - 50, 6) end sst, case when value + 450 between 500 and 1500 then round(value + 450, 6) end mslp from events")
def F1_ranged(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("hs"), (F.col("value") - 50).alias("sst"), (F.col("value") + 450).alias("mslp"))
    return rounded(qc.ranged(e))


_ALT = _TRACK + ", alt as (select *, ['JASON3', 'TOPEX', 'CFOSAT'][satellite_id + 1] mission, (src_id * 7 % 3000)::double wdepth, (src_id * 11 % 400)::double distcoast, src_id % 20 / 10.0::double swh_std, src_id % 13 / 13.0::double sig0_std, src_id % 30 n_obs, (src_id % 4)::double qc, hs * 0.98::double hs_cal, wnd * 1.02::double wnd_cal from track) "


def _altimeter(spark, sf_dir):
    t, i = v.track(spark, sf_dir), F.col("src_id")
    mission = F.element_at(F.array(F.lit("JASON3"), F.lit("TOPEX"), F.lit("CFOSAT")), F.col("satellite_id") + 1)
    return t.withColumns({"mission": mission, "wdepth": (i * 7 % 3000).cast("double"), "distcoast": (i * 11 % 400).cast("double"), "swh_std": i % 20 / 10.0, "sig0_std": i % 13 / 13.0, "n_obs": i % 30, "qc": (i % 4).cast("double"), "hs_cal": F.col("hs") * 0.98, "wnd_cal": F.col("wnd") * 1.02})


@query(_ALT + "select src_id, mission, round(hs_cal, 6) hs_cal from alt where wdepth >= 80 and distcoast >= 50 and swh_std <= 1.5 and sig0_std <= 0.8 and (mission = 'CFOSAT' or n_obs >= case mission when 'TOPEX' then 7 else 17 end) and qc <= 2 and hs > 0.1 and hs < 20 and hs_cal > 0.1 and hs_cal < 20 and wnd > 0.2 and wnd < 60 and wnd_cal > 0.2 and wnd_cal < 60")
def F2_altimeter_qc(spark, sf_dir):
    return rounded(qc.altimeter_qc(_altimeter(spark, sf_dir)).select("src_id", "mission", "hs_cal"))


@query(_TRACK + "select src_id, case when hs >= 0.01 and hs <= 10 then round(hs, 6) end hs, case when user_id * 7 - 300 between -180 and 360 then (user_id * 7 - 300)::double end wdir from track")
def F3_extraction_qc(spark, sf_dir):
    t = v.track(spark, sf_dir).select("src_id", "hs", (F.col("user_id") * 7 - 300).cast("double").alias("wdir"))
    return rounded(qc.extraction_qc(t, {"hs": 10.0}, ("wdir",)))


@query(_TRACK + "select src_id, round(lat, 6) lat, round(lon, 6) lon from track where lat between -30 and 30 and lon between 20 and 200 and time between 1704153600 and 1705363200")
def F4_within(spark, sf_dir):
    return rounded(qc.within(v.track(spark, sf_dir), (-30, 30), (20, 200), (1704153600, 1705363200)).select("src_id", "lat", "lon"))


_MATCH = v.with_views("track", "grid") + ", m as (select src_id, t.hs * 1.1::double model_hs, t.hs obs_hs, wnd - 1 model_wnd, wnd obs_wnd, case when z <= 0 then 1.0 else 0.0 end::double mask, distcoast, -z depth from track t join grid g on g.lat_idx = greatest(0, least(ceil((t.lat + 89) / 2 - 0.5)::int, 89)) and g.lon_idx = ceil(t.lon / 2 - 0.5)::int % 180) "


@query(_MATCH + "select src_id, round(model_hs, 6) model_hs, round(obs_hs, 6) obs_hs from m where mask = 1 and distcoast > 0 and depth > 0 and model_hs >= 0 and model_hs < 999 and obs_hs >= 0 and obs_hs < 999 and model_wnd >= 0 and model_wnd < 999 and obs_wnd >= 0 and obs_wnd < 999")
def F6_matchup_qc(spark, sf_dir):
    from ..operators.geo import nearest_cell

    t = nearest_cell(v.track(spark, sf_dir), **v.GRID)
    g = v.grid(spark, sf_dir).select("lat_idx", "lon_idx", "distcoast", (-F.col("z")).alias("depth"), F.when(F.col("z") <= 0, 1.0).otherwise(0.0).alias("mask"))
    m = t.join(g, ["lat_idx", "lon_idx"]).select("src_id", (F.col("hs") * 1.1).alias("model_hs"), F.col("hs").alias("obs_hs"), (F.col("wnd") - 1).alias("model_wnd"), F.col("wnd").alias("obs_wnd"), "mask", "distcoast", "depth")
    return rounded(qc.matchup_qc(m).select("src_id", "model_hs", "obs_hs"))


@query(_POINTS + "select station, cycle, valid_time from (select *, dense_rank() over (partition by station, cycle order by valid_time) - 1 n from points) where n % 3 = 0")
def F9_every_third_time(spark, sf_dir):
    return qc.every_kth(v.points(spark, sf_dir), 3, ["station", "cycle"], "valid_time").select("station", "cycle", "valid_time")


_SPEC = v.with_views("spec")
_FREQ_DIR = "sum(e) * 2 * pi() / 8 * 0.02"


def _power(spark, sf_dir):
    s = v.spectra(spark, sf_dir)
    return s.withColumn("p", sp.power(F.col("efth"), F.array_repeat(F.lit(0.02), 8)))


@query("select vec_id, round(sum(embedding[i + 1]::double * embedding[i + 1]::double * 0.01::double / pi() * (0.5 + 0.5 * cos(radians(t - 10 * i)) + 0.25 * cos(2 * radians(t - 20 * i)))), 6) total, round(max(case when i = 3 and t = 30 then embedding[4]::double * embedding[4]::double * 0.01::double / pi() * (0.5 + 0.5 * cos(radians(0.0)) + 0.25 * cos(2 * radians(-30.0))) end), 6) one from embeddings, range(0, 8) a(i), range(0, 361, 10) b(t) group by vec_id")
def X1_from_moments(spark, sf_dir):
    s = v.spectra(spark, sf_dir)
    i = F.sequence(F.lit(0), F.lit(7))
    d = sp.from_moments(F.col("efth")[0], F.array_repeat(F.lit(0.01), 8), F.transform(i, lambda x: x * 10.0), F.transform(i, lambda x: x * 20.0), F.array_repeat(F.lit(0.5), 8), F.array_repeat(F.lit(0.25), 8))
    return rounded(s.select("vec_id", d.alias("d")).select("vec_id", sp.total(F.transform("d", sp.total)).alias("total"), F.col("d")[3][3].alias("one")))


@query("select vec_id, round(list_sum(list_transform(range(1, 48), lambda i: embedding[i]::double * embedding[i]::double * case when i = 1 then 0.01 when i <= 14 then 0.005 when i <= 40 then 0.01 else 0.02 end)), 8)::double power from embeddings")
def X2_band_widths(spark, sf_dir):
    s = v.spectra(spark, sf_dir).select("vec_id", F.slice(F.flatten("efth"), 1, 47).alias("e"))
    return rounded(s.select("vec_id", sp.total(F.zip_with("e", sp.band_widths_47(), lambda e, w: e * w)).alias("power")), 8)


@query(_SPEC + ", w as (select vec_id, i, f, sum(e) s from spec group by all) select vec_id, round(sum(s * 0.5 * ((0.07::double / 0.05) - 1 / (0.07::double / 0.05)) * f), 6) total from w group by 1")
def X3_log_band_widths(spark, sf_dir):
    s = v.spectra(spark, sf_dir)
    return rounded(s.select("vec_id", sp.total(F.zip_with(F.transform("efth", sp.total), sp.log_band_widths(F.col("freq")), lambda a, b: a * b)).alias("total")))


@query(_SPEC + f"select vec_id, i, round({_FREQ_DIR}, 8) p from spec group by all")
def X4_power(spark, sf_dir):
    return rounded(_power(spark, sf_dir).select("vec_id", F.posexplode("p").alias("i", "p")), 8)


@query(_SPEC + "select vec_id, i, ((dir + 180) % 360)::double d, round(e, 8) v from spec")
def X5_flipped(spark, sf_dir):
    s = v.spectra(spark, sf_dir).select("vec_id", "dir", F.posexplode("efth").alias("i", "row"))
    return rounded(s.select("vec_id", "i", F.inline(sp.flipped(F.col("dir"), F.col("row")))), 8)


@query(_SPEC + ", a as (select vec_id, i, degrees(atan2(sum(e * sin(radians(dir))), sum(e * cos(radians(dir))))) a from spec group by all) select vec_id, i, round(case when a < 0 then a + 360 else a end, 4) direction from a")
def X6_mean_direction(spark, sf_dir):
    s = v.spectra(spark, sf_dir).select("vec_id", "dir", F.posexplode("efth").alias("i", "row"))
    return rounded(s.select("vec_id", "i", sp.mean_direction(F.col("dir"), F.col("row")).alias("direction")), 4)


@query(_SPEC + f"select vec_id, round(4.01 * sqrt({_FREQ_DIR}), 6) hs from spec group by 1")
def X7_height(spark, sf_dir):
    return rounded(_power(spark, sf_dir).select("vec_id", sp.height(F.col("p")).alias("hs")))


# closed over eight equal directions the trapezoid is the plain sum
_RING = ", w as (select vec_id, i, sum(e) * pi() / 4 s, sum(e * cos(radians(dir))) * pi() / 4 sa, sum(e * sin(radians(dir))) * pi() / 4 sb from spec group by all), k as (select vec_id, 2 * pi() * 0.02 * (sum(s) - sum(s) filter (i in (0, 7)) / 2) t, sum(sa) - sum(sa) filter (i in (0, 7)) / 2 a, sum(sb) - sum(sb) filter (i in (0, 7)) / 2 b from w group by 1) "


@query(_SPEC + _RING + "select vec_id, round(4.004 * sqrt(abs(t)) / sqrt(2 * pi()), 6) hs, round((degrees(atan2(b, a)) + 180) % 360, 4) direction from k")
def X8_bulk(spark, sf_dir):
    s, a = v.spectra(spark, sf_dir), (F.col("freq"), F.col("dir"), F.col("efth"))
    return rounded(s.select("vec_id", sp.bulk_height(*a).alias("hs"), sp.bulk_direction(*a).alias("direction")), direction=4)


@query(_SPEC + ", p as (select vec_id, f, sum(e) s from spec group by all), m as (select vec_id, max(s) m from p group by 1) select vec_id, round(min(f), 6) as first, round(avg(f), 6) mean from p join m using (vec_id) where s = m group by 1")
def X9_peak_frequency(spark, sf_dir):
    s = v.spectra(spark, sf_dir).withColumn("p", F.transform("efth", sp.total))
    return rounded(s.select("vec_id", sp.peak_frequency(F.col("freq"), F.col("p")).alias("first"), sp.peak_frequency(F.col("freq"), F.col("p"), "mean").alias("mean")))


@query(_SPEC + ", p as (select vec_id, i, f, sum(e) s from spec group by all), g as (select vec_id, a.f + 0.005::double g, a.s + (b.s - a.s) * 0.25 x from p a join p b using (vec_id) where b.i = a.i + 1) select vec_id, round(g, 6) g, round(x, 6) x from g union all select distinct vec_id, 0.01::double, 0.0::double from p union all select distinct vec_id, 0.5::double, 0.0::double from p")
def X10_interpolated(spark, sf_dir):
    s = v.spectra(spark, sf_dir).withColumn("p", F.transform("efth", sp.total))
    to = F.concat(F.array(F.lit(0.01)), F.transform(F.slice("freq", 1, 7), lambda f: f + 0.005), F.array(F.lit(0.5)))
    z = s.select("vec_id", F.arrays_zip(to.alias("g"), sp.interpolated(F.col("freq"), F.col("p"), to).alias("x")).alias("z"))
    return rounded(z.select("vec_id", F.inline("z")))


@query(v.with_views("buoy") + "select event_id, round(hs * 4.004 / 4, 3) hs from buoy where hs > 0.5")
def X11_jonswap_height(spark, sf_dir):
    """The bulk height of a JONSWAP spectrum is the height it was made for."""
    b = v.buoy(spark, sf_dir).where("hs > 0.5")
    freq, dirs = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: 0.04 + 0.01 * i), F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: i * 15.0)
    b = b.select("event_id", "hs", freq.alias("f"), dirs.alias("d"))
    e = sp.jonswap(F.col("hs"), F.lit(10.0), F.lit(90.0), F.col("f"), F.col("d"))
    return rounded(b.select("event_id", sp.bulk_height(F.col("f"), F.col("d"), e).alias("hs")), 3)


@query(_SPEC + ", p as (select vec_id, i, f, sum(e) s from spec group by all), fine as (select 0.045::double + 0.001::double * k g from range(0, 140) r(k)), b as (select vec_id, g, min(i) i from p, fine where g >= f - 0.01 - 1e-9 and g <= f + 0.01 + 1e-9 group by all) select vec_id, round(g, 6) g, round(100 * s * 0.001::double / 0.02, 6) x from b join p using (vec_id, i)")
def J20_band_overlap(spark, sf_dir):
    from ..operators.spectral import band_overlap

    p = v.spectra(spark, sf_dir).select("vec_id", F.posexplode(F.transform("efth", sp.total)).alias("i", "p"), "freq")
    bands = p.select("vec_id", "i", "p", (F.col("freq")[F.col("i")] - 0.01).alias("lo"), (F.col("freq")[F.col("i")] + 0.01).alias("hi"))
    out = band_overlap(bands, ["vec_id"], 0.045, 0.001, 140)
    return rounded(out)


@query(_POINTS + "select station, valid_time, round(hs, 6) hs, round(1 / (0.05 + station * 0.01), 6) tp from points where station = 3 and hs between 0 and 30")
def S1_model_points(spark, sf_dir):
    raw = v.points(spark, sf_dir).select(F.col("station").cast("string").alias("station"), "valid_time", F.col("hs").alias("swh"), (0.05 + F.col("station") * 0.01).alias("fp"))
    out = tables.model_points(raw, "3")
    return rounded(out.select(F.col("station").cast("bigint").alias("station"), "valid_time", "hs", "tp"))


@query(_BUOY + "select station, event_id as time, case when hs <= 30 then round(hs, 6) end hs, round(tp, 6) tm, round(hs * 2 * pow(10 / 5.0, 0.12::double), 6) wind_spd from buoy")
def S3_buoys(spark, sf_dir):
    b = v.buoy(spark, sf_dir)
    raw = b.select("station", F.col("event_id").alias("time"), F.array(F.col("hs"), F.lit(float("nan")), F.col("hs")).alias("VHM0"), F.array(F.col("tp")).alias("VTM02"), F.array(F.col("hs") * 2).alias("WSPD"))
    st = b.select("station").distinct().withColumn("anemometer_height", F.lit(5.0))
    return rounded(tables.buoys(raw, st).select("station", "time", "hs", "tm", "wind_spd"))


_TILES = _TRACK + ", w as (select *, floor(lat)::int tile_lat, floor(lon)::int tile_lon from track where satellite_id = 1 and time between 1704153600 - 1800 and 1706000000 + 1800), t as (select tile_lat, tile_lon from w group by all having count(*) > 1)"


@query(_TILES + " select src_id, case when tile_lat % 2 = 0 then round(hs, 6) else round(hs * 0.9, 6) end swh, (src_id % 3000)::double wdepth from w semi join t using (tile_lat, tile_lon)")
def S4_altimeter_tiles(spark, sf_dir):
    t = v.track(spark, sf_dir).where("satellite_id = 1").withColumns({"mission": F.lit("JASON3"), "tile_lat": F.floor("lat").cast("int"), "tile_lon": F.floor("lon").cast("int")})
    even = F.col("tile_lat") % 2 == 0
    raw = t.withColumns({"swh_ku": F.when(even, F.col("hs")), "swh_ka": F.col("hs") * 0.9, "id_ku": F.when(even, F.col("src_id")), "id_ka": F.col("src_id"), "bot_depth": -(F.col("src_id") % 3000).cast("double"), "dist2coast": F.lit(1.0), "wspd": F.col("wnd"), "wspd_cal": F.col("wnd")})
    return rounded(tables.altimeter_tiles(raw, "JASON3", 1704153600, 1706000000, least=1).select(F.col("id").alias("src_id"), "swh", "wdepth"))


_CHECKED = _TRACK + ", a as (select *, src_id % 3000 wdepth, src_id * 11 % 400 dc, (src_id % 20) / 10.0::double sd, (src_id % 13) / 13.0::double s0, src_id % 30 nb, src_id % 4 q from track where satellite_id = 1 and time between 1704153600 and 1706000000)"


@query(_CHECKED + " select src_id, round(hs * 0.98::double, 6) hs_cal, round(wnd, 6) wnd from a where wdepth >= 80 and dc >= 50 and sd <= 1.5 and s0 <= 0.8 and nb >= 17 and q <= 2 and hs > 0.1 and hs < 20 and hs * 0.98::double > 0.1 and wnd > 0.2 and wnd < 60 and wnd * 0.97::double > 0.2 and (select count(*) from a) > 2")
def S4_checked_tiles(spark, sf_dir):
    i = F.col("src_id")
    t = v.track(spark, sf_dir).where("satellite_id = 1").withColumns({"mission": F.lit("JASON3"), "tile_lat": F.floor("lat").cast("int"), "tile_lon": F.floor("lon").cast("int"), "bot_depth": -(i % 3000).cast("double"), "dist2coast": (i * 11 % 400).cast("double"), "wspd": F.col("wnd"), "wspd_cal": F.col("wnd") * 0.97})
    made = {"swh": F.col("hs"), "swh_cal": F.col("hs") * 0.98, "swh_std": i % 20 / 10.0, "sig0_std": i % 13 / 13.0, "n_obs": i % 30, "qc": (i % 4).cast("double"), "id": i}
    raw = t.withColumns({f"{k}_{b}": c for k, c in made.items() for b in ("ku", "ka")})
    tiles = tables.altimeter_tiles(raw, "JASON3", 1704153600, 1706000000, least=0)
    return rounded(tables.checked_tiles(tiles, 1704153600, 1706000000).select(F.col("id").alias("src_id"), "hs_cal", "wnd"))


@query("select vec_id, i::int cell, round(embedding[i + 1]::double, 6) wspd_cal, case when i % 5 = 0 then 999.0 else i * 10.0 end::double wnd_dir from embeddings, range(0, 64) r(i) where (vec_id + i) % 3 <> 0")
def S5_scatterometer(spark, sf_dir):
    i = F.sequence(F.lit(0), F.lit(63))
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("time"), F.transform("embedding", lambda x: x.cast("double")).alias("wspd_cal"), F.transform(i, lambda k: k.cast("double")).alias("lat"), F.transform(i, lambda k: k.cast("double")).alias("lon"), F.transform(i, lambda k: F.when((F.col("vec_id") + k) % 3 != 0, 1).otherwise(0)).alias("qc"), F.transform(i, lambda k: F.when(k % 5 != 0, k * 10.0)).alias("wnd_dir"))
    return rounded(tables.scatterometer(e).select(F.col("time").alias("vec_id"), F.col("lat").cast("int").alias("cell"), "wspd_cal", "wnd_dir"))


@query(v.with_views("field") + "select valid_time, lat_idx, lon_idx, round(hs, 6) hs, round(sqrt(hs * hs + wnd * wnd), 6) wind from field")
def S15_model_fields(spark, sf_dir):
    raw = v.field(spark, sf_dir).select("valid_time", "lat_idx", "lon_idx", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("hs").alias("HTSGW_surface"), F.col("hs").alias("UGRD_surface"), F.col("wnd").alias("VGRD_surface"))
    return rounded(tables.model_fields(raw).select("valid_time", "lat_idx", "lon_idx", "hs", "wind"))


@query("select vec_id, label::varchar station, round(avg(vec_id % 90) over (partition by label), 6) mean_lat from embeddings where label::varchar = (select distinct label::varchar from embeddings order by 1 limit 1 offset 2)")
def S16_spectrum_station(spark, sf_dir):
    s = v.spectra(spark, sf_dir).select(F.col("label").cast("string").alias("station"), "vec_id", (F.col("vec_id") % 90).cast("double").alias("lat"))
    return rounded(tables.spectrum_station(s, 2).select("vec_id", "station", "mean_lat"))


@query(_GRID + "select lat_idx, lon_idx, distcoast, null::double zone_id from grid")
def S17_grid_info(spark, sf_dir):
    return tables.with_optional(v.grid(spark, sf_dir), ("distcoast", "zone_id")).select("lat_idx", "lon_idx", "distcoast", "zone_id")


@query(v.with_views("field") + "select valid_time, lat, lon, round(hs, 2) hs, round(wnd, 2) wnd from field where lat between -79 and 90")
def K4_compacted(spark, sf_dir):
    return sinks.compacted(v.field(spark, sf_dir), ["valid_time", "lat", "lon", "hs", "wnd"])


