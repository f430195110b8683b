"""The driver's tables seen as wave data, in Spark and in SQL. Arithmetic only, so that both sides agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Axes of the grid view.
GRID = {"lat0": -89.0, "dlat": 2.0, "nlat": 90, "lon0": 0.0, "dlon": 2.0, "nlon": 180}
#: Slot of the first field time.
SLOT0 = 78892
NATURES = ("TS", "SS", "ET", "DS", "NR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    obs = F.col("l_quantity") / 5
    return l.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_shipdate").alias("valid_time"), F.month("l_shipdate").alias("month"), F.col("l_suppkey").alias("station"),
        F.col("l_returnflag").alias("zone"), F.col("l_linestatus").alias("status"), ((F.col("l_linenumber") - 1) * 24).alias("lead_h"), obs.alias("obs_hs"),
        (obs * (1 + 2 * F.col("l_discount") - 2 * F.col("l_tax"))).alias("model_hs"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(10))))
    p = p.where((F.col("l_orderkey") + F.col("member")) % 17 != 0)
    return p.withColumn("model_hs", F.col("obs_hs") * (1 + (F.col("member") - 5) * 0.02 + F.col("d") - F.col("t")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def buoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("user_id") % 10).alias("station"), "time", (F.col("value") / 20).alias("hs"), (F.col("value") % 17).alias("tp"), "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = buoy(spark, sf_dir).select("station", F.floor(F.col("time") / 3600).alias("hour")).distinct()
    h = h.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    hs = 1 + ((F.col("hour") * 7 + F.col("station") * 13) % 11) * 0.5
    return h.select("station", ((F.floor(F.col("hour") / 24) - F.col("k")) * 86400).alias("cycle"), (F.col("hour") * 3600).alias("valid_time"), hs.alias("hs"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("event_id") % 2400
    return events(spark, sf_dir).select(
        F.col("event_id").alias("src_id"), "time", (F.abs(p - 1200) * 0.1 - 60).alias("lat"), ((F.col("event_id") % 7200) * 0.05).alias("lon"), (F.col("value") / 20).alias("hs"), (F.col("value") / 10).alias("wnd"),
        (F.col("user_id") % 3).cast("int").alias("satellite_id"), "event_type", "user_id",
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    g = c.groupBy((F.col("c_custkey") % 90).cast("int").alias("lat_idx"), (F.floor(F.col("c_custkey") / 90) % 180).cast("int").alias("lon_idx")).agg(F.max("c_custkey").alias("k"))
    return g.select("lat_idx", "lon_idx", "k", (F.col("lat_idx") * 2.0 - 89).alias("lat"), (F.col("lon_idx") * 2.0).alias("lon"), (500.0 - (F.col("k") * 37) % 5000).alias("z"), ((F.col("k") * 13) % 400).cast("double").alias("distcoast"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.floor(F.col("time") / 21600).alias("slot")).distinct()


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = grid(spark, sf_dir).select("lat_idx", "lon_idx", "lat", "lon").crossJoin(F.broadcast(slots(spark, sf_dir)))
    hs = 5 + 0.01 * F.col("lat") + 0.005 * F.col("lon") + 0.01 * (F.col("slot") - SLOT0)
    return f.select("lat_idx", "lon_idx", "lat", "lon", (F.col("slot") * 21600).alias("valid_time"), (F.col("slot") - SLOT0).cast("int").alias("t_idx"), hs.alias("hs"), (2 * hs).alias("wnd"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("e"), "label")
    efth = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("e", i * 8 + 1, 8))
    freq = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 0.05 + 0.02 * i)
    dirs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 45.0 * i)
    return e.select("vec_id", "label", efth.alias("efth"), freq.alias("freq"), dirs.alias("dir"))


def storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nature = F.element_at(F.array(*map(F.lit, NATURES)), (F.col("user_id") % 5 + 1).cast("int"))
    return track(spark, sf_dir).select(F.col("src_id").alias("row_no"), "time", nature.alias("nature"), "lat", "lon")


#: The same views as common table expressions, each after those that it needs.
SQL = {
    "pairs": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate valid_time, month(l_shipdate)::int as month, l_suppkey station, l_returnflag zone, l_linestatus status, (l_linenumber - 1) * 24 lead_h, l_quantity / 5 obs_hs, l_quantity / 5 * (1 + 2 * l_discount - 2 * l_tax) model_hs, l_discount d, l_tax t from lineitem",
    "members": "select p.* exclude (model_hs), m::int as member, obs_hs * (1 + (m - 5) * 0.02 + d - t) model_hs from pairs p, range(0, 11) r(m) where (l_orderkey + m) % 17 <> 0",
    "ev": "select *, epoch_us(ts) / 1e6 as time from events",
    "buoy": "select user_id % 10 station, time, value / 20 hs, value % 17 tp, event_id from ev",
    "points": "select station, ((hour // 24) - k) * 86400 as cycle, hour * 3600 valid_time, 1 + ((hour * 7 + station * 13) % 11) * 0.5::double hs from (select distinct station, floor(time / 3600)::bigint as hour from buoy), (values (0), (1)) v(k)",
    "track": "select event_id src_id, time, abs(event_id % 2400 - 1200) * 0.1::double - 60 lat, (event_id % 7200) * 0.05::double lon, value / 20 hs, value / 10 wnd, (user_id % 3)::int satellite_id, event_type, user_id from ev",
    "grid": "select lat_idx, lon_idx, k, lat_idx * 2.0::double - 89 lat, lon_idx * 2.0::double lon, 500.0::double - (k * 37) % 5000 z, ((k * 13) % 400)::double distcoast from (select (c_custkey % 90)::int lat_idx, ((c_custkey // 90) % 180)::int lon_idx, max(c_custkey) k from customer group by 1, 2)",
    "slots": "select distinct floor(time / 21600)::bigint slot from ev",
    "field": f"select lat_idx, lon_idx, lat, lon, slot * 21600 valid_time, (slot - {SLOT0})::int t_idx, 5 + 0.01::double * lat + 0.005::double * lon + 0.01::double * (slot - {SLOT0}) hs, 2 * (5 + 0.01::double * lat + 0.005::double * lon + 0.01::double * (slot - {SLOT0})) wnd from grid, slots",
    "storms": "select src_id row_no, time, ['TS', 'SS', 'ET', 'DS', 'NR'][user_id % 5 + 1] nature, lat, lon from track",
    "spec": "select vec_id, label, i::int i, j::int j, 0.05::double + 0.02::double * i f, 45.0::double * j dir, embedding[i * 8 + j + 1]::double * embedding[i * 8 + j + 1]::double e from embeddings, range(0, 8) a(i), range(0, 8) b(j)",
}
NEEDS = {"members": ["pairs"], "buoy": ["ev"], "points": ["ev", "buoy"], "track": ["ev"], "slots": ["ev"], "field": ["ev", "grid", "slots"], "storms": ["ev", "track"]}


def with_views(*names: str) -> str:
    """`with` clause of the views and what they need."""
    want = {n for v in names for n in [v, *NEEDS.get(v, [])]}
    return "with " + ", ".join(f"{k} as ({v})" for k, v in SQL.items() if k in want) + " "


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371.0::double * asin(sqrt(least(1.0::double, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2)))))"
