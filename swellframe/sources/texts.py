"""Text sources: fixed columns and white-space tables, parsed by column expressions over lines or whole files."""

from __future__ import annotations

import re
import tarfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import lon360, wind_at_height
from ..operators.qc import RANGES, ranged
from ..operators.windows import carried
from ..storage import stored

#: Columns of the standard meteorological format that are measures, and the names they get.
STDMET = {"WDIR": "wind_dir", "WSPD": "wind_spd", "WSP": "wind_spd", "GST": "gust", "WVHT": "hs", "DPD": "tp", "APD": "tm", "MWD": "dm", "PRES": "mslp", "BAR": "mslp", "ATMP": "air_temp", "WTMP": "sst", "DEWP": "dewpoint"}


#: Ranges of these files, where a measure has none or another one elsewhere; both ends kept.
STDMET_RANGES = RANGES | {"wind_dir": (-180, 360)}
#: Codes of missing values within a measure's range.
STDMET_CODES = {"wind_spd": (99.0,), "gust": (99.0,)}


#: Bytes of a file or archive member that are read at once, and that a task reads as a target.
PIECE, TASK = 8 << 20, 64 << 20
#: Lines (see `line_no` of `pieces_as_lines`) whose order is settled in one part.
LINES = 1 << 22


def _open(uri: str):
    where, at = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))
    return where.open_input_file(at)


def lines_from(source, offset: int, size: int, start: int, piece: int) -> list[bytes]:
    """The lines that begin in the piece at `start` of the bytes from `offset`, the last one whole, wherever it ends."""
    end = min(start + piece, size)
    begin = max(start - 1, 0)  # a line begins here if the byte before ends one
    source.seek(offset + begin)
    data = source.read(end - begin)
    if start:
        skip = data.find(b"\n") + 1
        if not skip:
            return []
        data = data[skip:]
    while data and end < size and not data.endswith(b"\n"):
        more = source.read(min(piece, size - end))
        end += len(more)
        at = more.find(b"\n") + 1
        data += more[:at] if at else more
        if at or not more:
            break
    if not data:
        return []
    lines = data.split(b"\n")
    return lines[:-1] if data.endswith(b"\n") else lines


def pieces_as_lines(index: DataFrame, encoding: str) -> DataFrame:
    """file, line_no, line of stretches of files. index: uri, file, offset, size.

    Stretches are cut into pieces, which are dealt to tasks by place, so that neighbours are read in one go and a large file by many tasks. line_no is a line's number in the
    first piece; in later ones it is larger than any before and grows with the place, with gaps.
    """
    index = index.where("size > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(PIECE).cast("bigint"))))
    total = index.agg(F.sum(F.least(F.lit(PIECE), F.col("size") - F.col("start"))).alias("n")).first()["n"] or 0
    dealt = index.repartitionByRange(max(1, -(-total // TASK)), "uri", F.col("offset") + F.col("start"))

    def read(batches):
        name, source = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["uri"] != name:
                    name, source = r["uri"], _open(r["uri"])
                lines = lines_from(source, r["offset"], r["size"], r["start"], PIECE)
                text = [x.removesuffix(b"\r").decode(encoding, "replace") for x in lines]
                n = len(text)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n, pa.string()), pa.array(range(r["start"], r["start"] + n), pa.int64()), pa.array(text, pa.string())], names=["file", "line_no", "line"])

    return dealt.select("uri", "file", "offset", "size", "start").mapInArrow(read, "file string, line_no bigint, line string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files of any size, see `pieces_as_lines`; compressed ones are read whole, by Spark."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("size"))
    packed = F.col("file").rlike(r"\.(gz|bz2|xz|zst)$")
    out = pieces_as_lines(found.where(~packed), "utf-8")
    names = [r["uri"] for r in found.where(packed).select("uri").limit(10_000).collect()]  # a list of files, as any reader gets
    return out.unionByName(numbered(whole(spark, names)).withColumn("line_no", F.col("line_no").cast("bigint"))) if names else out


def numbered(df: DataFrame, text: str = "value") -> DataFrame:
    """file, line_no, line of whole-text rows."""
    return df.select("file", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def number(s: Column, missing: tuple[float, ...] = ()) -> Column:
    x = s.try_cast("double")
    for m in missing:
        x = F.when(x != m, x)
    return x


def stdmet(spark: SparkSession, path: str, stations: DataFrame | None = None) -> DataFrame:
    """S2. Standard meteorological files of buoys: station, time, measures. The station is the file name up to its first
    dot or h; minutes are optional; years of two digits are of the 1900s. Values out of their range are missing, and so are those codes of missing values
    that a range admits; 99 degrees or 999.0 hPa are values."""
    rows = lines(spark, path).where(F.trim("line") != "")
    head = rows.where("line_no = 0").select("file", F.split(F.trim(F.regexp_replace("line", "#", "")), r"\s+").alias("names"))
    rows = rows.where("line_no > 0 and not startswith(ltrim(line), '#')").join(head, "file").select("file", "names", F.split(F.trim("line"), r"\s+").alias("v"))

    def at(*names: str) -> Column:
        return F.coalesce(*[F.when(F.array_contains("names", n), F.try_element_at("v", F.array_position("names", n).cast("int"))) for n in names])

    year = number(at("YY", "YYYY", "YYY"))
    year = F.when(year < 100, year + 1900).otherwise(year).cast("int")
    parts = [year, *[number(at(n)).cast("int") for n in ("MM", "DD", "hh")], F.coalesce(number(at("mm")).cast("int"), F.lit(0)), F.lit(0)]
    time = F.unix_timestamp(F.make_timestamp(*parts)).cast("double")
    names: dict[str, list[str]] = {}
    for k, v in STDMET.items():
        names.setdefault(v, []).append(k)
    out = rows.select(F.regexp_extract("file", r"^([^.h]+)", 1).alias("station"), time.alias("time"), *[number(at(*k), STDMET_CODES.get(v, ())).alias(v) for v, k in names.items()])
    if stations is not None:
        out = out.join(stations, "station", "left").withColumns({c: wind_at_height(F.col(c), F.col("anemometer_height")) for c in ("wind_spd", "gust")})
    return ranged(out, STDMET_RANGES)


def point_table(spark: SparkSession, path: str) -> DataFrame:
    """S6. Point tables: in each block the line with the time, then a row of ten numbers per point: tp = 1 / fp."""
    stamp = F.regexp_extract("line", r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}(:\d{2})?)", 1)
    rows = carried(lines(spark, path), ["file"], "line_no", F.when(stamp != "", stamp), "stamp", LINES)
    v = rows.withColumn("v", F.split(F.trim("line"), r"\s+")).where(F.size("v") == 10)
    v = v.where(F.forall("v", lambda x: x.try_cast("double").isNotNull()))
    names = ("lon", "lat", "hs", "lm", "tm", "dm", "spr", "fp", "dp", "spr_p")
    time = F.unix_timestamp(F.coalesce(F.try_to_timestamp("stamp", F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp("stamp", F.lit("yyyy/MM/dd HH:mm")))).cast("double")
    out = v.select("file", time.alias("time"), *[F.col("v")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return out.withColumn("tp", F.when(F.col("fp") > 0, 1 / F.col("fp")))


def _position(line: Column) -> tuple[Column, Column]:
    pattern = r"\(\s*([\d.]+)\s*([NS])[ ,]+([\d.]+)\s*([EW])\s*\)"
    part = lambda i: F.regexp_extract(line, pattern, i)
    sign = lambda i, c: F.when(part(i) == c, -1.0).otherwise(1.0)
    return part(1).try_cast("double") * sign(2, "S"), part(3).try_cast("double") * sign(4, "W")


#: Where the layouts of bulletins have their place, cycle, first row, day and hour.
BULLETINS = {"deterministic": (0, 2, 7, 4, 7), "ensemble": (1, 3, 9, 3, 6)}


def bulletins(lines: DataFrame, kind: str = "deterministic") -> DataFrame:
    """S7, W2, T1. Bulletin lines (file, line_no, line) as rows: file, lat, lon, cycle, time, hs, tp, dp.

    Deterministic rows have up to four wave systems: tp and dp are those of the highest, the first of equal ones. Rows carry day and hour; the
    month turns where the day falls. Ensemble rows have hs and tp. The hemisphere's letter decides the sign.
    """
    det = kind == "deterministic"
    place, cycle_at, first, day_at, hour_at = BULLETINS[kind]
    lat, lon = _position(F.col("line"))
    heads = lines.groupBy("file").agg(F.max(F.when(F.col("line_no") == place, F.struct(lat.alias("lat"), lon.alias("lon")))).alias("p"), F.max(F.when(F.col("line_no") == cycle_at, F.regexp_extract("line", r"(\d{8})\D+(\d{1,2})", 0))).alias("c"))
    cycle = F.to_timestamp(F.concat(F.regexp_extract("c", r"(\d{8})", 1), F.lpad(F.regexp_extract("c", r"\d{8}\D+(\d{1,2})", 1), 2, "0")), "yyyyMMddHH")
    heads = heads.select("file", "p.lat", "p.lon", cycle.alias("c"))
    cut = lambda a, b: F.trim(F.substring("line", a + 1, b - a)).try_cast("double")
    rows = lines.where(F.col("line_no") >= first).withColumns({"day": cut(day_at - 1, day_at + 1).cast("int"), "hour": cut(hour_at - 1, hour_at + 1).cast("int"), "hs": cut(10, 15)})
    rows = rows.where("day is not null and hour is not null and hs is not null")
    if det:
        systems = F.array(*[F.struct(cut(24 + 18 * k, 30 + 18 * k).alias("h"), cut(30 + 18 * k, 34 + 18 * k).alias("tp"), cut(35 + 18 * k, 38 + 18 * k).alias("dp")) for k in range(4)])
        rows = rows.withColumn("s", F.filter(systems, lambda x: x.h.isNotNull()))
        top = F.array_max(F.transform("s", lambda x: x.h))
        best = F.filter("s", lambda x: x.h == top)
        rows = rows.withColumns({"tp": F.try_element_at(best, F.lit(1)).tp, "dp": F.try_element_at(best, F.lit(1)).dp})
    else:
        rows = rows.withColumns({"tp": cut(28, 33), "dp": F.lit(None).cast("double")})
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.join(heads, "file").withColumn("_f", F.when(F.col("day") < F.lag("day", 1).over(w), 1).otherwise(0))
    months = F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    month0 = F.trunc("c", "month")
    rows = rows.withColumn("_m", months + F.when(F.first("day").over(w) < F.dayofmonth("c"), 1).otherwise(0))
    day = F.date_add(F.add_months(month0, F.col("_m").cast("int")), F.col("day") - 1)
    time = F.unix_timestamp(day.cast("timestamp")) + F.col("hour") * 3600
    return rows.select("file", "lat", "lon", F.unix_timestamp("c").cast("double").alias("cycle"), time.cast("double").alias("time"), "hs", "tp", "dp")


#: Columns of the layouts of station series.
SERIES = {
    "ensemble": {"hs": (13, 18), "spread": (19, 25), "tp": (27, 32)},
    "lakes": {"hs": (22, 28), "lm": (31, 35), "tr": (37, 42), "dir": (44, 49), "spr": (50, 56), "fp": (57, 64), "p_dir": (66, 71), "p_spr": (72, 78)},
}


def station_series(lines: DataFrame, kind: str = "ensemble") -> DataFrame:
    """S8. `.ts` lines (file, line_no, line): ensemble hs, spread, tp; or the eight variables of the lakes layout, fp under 0.01 as missing."""
    cut = lambda a, b: F.trim(F.substring("line", a + 1, b - a))
    time, layout = (cut(1, 12), SERIES["ensemble"]) if kind == "ensemble" else (cut(2, 13), SERIES["lakes"])
    digits = F.regexp_replace(time, r"\D", "")
    stamp = F.coalesce(F.try_to_timestamp(F.substring(digits, 1, 10), F.lit("yyyyMMddHH")))
    out = lines.select("file", "line_no", F.unix_timestamp(stamp).cast("double").alias("time"), *[cut(*r).try_cast("double").alias(n) for n, r in layout.items()]).where("time is not null")
    if kind != "ensemble":
        out = out.withColumn("fp", F.when(F.col("fp") >= 0.01, F.col("fp"))).withColumn("tp", 1 / F.col("fp"))
    return out


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """uri, member, offset, size of the files in tar archives: their 512-byte headers are read, and what is between them is passed over."""

    def walked(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                found, at, name, length = [], 0, None, None
                with _open(uri) as source:
                    while True:
                        source.seek(at)
                        head = source.read(512)
                        if len(head) < 512 or not head.strip(b"\0"):
                            break
                        info = tarfile.TarInfo.frombuf(head, "latin-1", "surrogateescape")
                        size = length if length is not None and info.isreg() else info.size
                        if info.type == tarfile.GNUTYPE_LONGNAME:
                            name = source.read(info.size).rstrip(b"\0").decode("latin-1")
                        elif info.type == tarfile.XHDTYPE:  # records "length key=value"
                            own = dict(re.findall(r"\d+ ([^=\n]+)=([^\n]*)\n", source.read(info.size).decode("utf-8", "replace")))
                            name, length = own.get("path", name), int(own["size"]) if "size" in own else length
                        else:
                            if info.isreg():
                                found.append((uri, name or info.name, at + 512, size))
                            name, length = None, None
                        at += 512 + -(-size // 512) * 512
                types = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [()] * 4, types, strict=True)], names=["uri", "member", "offset", "size"])

    archives = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"))
    return archives.mapInArrow(walked, "uri string, member string, offset bigint, size bigint")


def tar_lines(spark: SparkSession, path: str) -> DataFrame:
    """S9. file (member's station: its name without folders up to the extension), line_no, line of all members of tar archives of any size.

    Members are found by `tar_index`, and their bytes dealt to tasks, see `pieces_as_lines`.
    """
    index = stored(tar_index(spark, path), "members")
    base = F.regexp_replace("member", r"^.*/", "")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return pieces_as_lines(index.select("uri", F.regexp_replace(stem, r"^.*\.", "").alias("file"), "offset", "size"), "latin-1")


def same_length(rows: DataFrame, key: str = "file") -> DataFrame:
    """S9. Stations with another number of rows than the first (by name) keep their times and lose their values."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    first = n.agg(F.min_by("_n", key).alias("_first"))
    ok = n.join(F.broadcast(first)).select(key, (F.col("_n") == F.col("_first")).alias("_ok"))
    values = [c for c, t in rows.dtypes if t == "double" and c not in ("time", "cycle")]
    out = rows.join(ok, key)
    return out.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in values}).drop("_ok")


def spectra_text(spark: SparkSession, path: str) -> DataFrame:
    """S10. Spectrum files: file, time, station, lat, lon, depth, wnd, wnddir, freq, dir (radians), efth [freq][dir].

    A step begins with a line of its time and is put together from its lines, which carry the number of that line; so files of many steps are read by many tasks.
    """
    stamp = r"^\s*(\d{8}\s+\d{6})\s*$"
    rows = carried(lines(spark, path), ["file"], "line_no", F.when(F.col("line").rlike(stamp), F.col("line_no")), "step", LINES)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    t = rows.groupBy("file", "step").agg(joined.alias("value"))
    head = t.where("step is null")
    nf, nd = (F.regexp_extract("value", rf"^'[^']*'\s+{before}(\d+)", 1).cast("int") for before in ("", r"\d+\s+"))
    body = F.regexp_replace("value", r"^'[^']*'\s+\d+\s+\d+\s+\d+\s*('[^']*')?", "")
    axes = F.filter(F.transform(F.split(F.trim(body), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    head = head.select("file", nf.alias("nf"), nd.alias("nd"), axes.alias("axes"))
    head = head.select("file", "nf", "nd", F.slice("axes", F.lit(1), F.col("nf")).alias("freq"), F.slice("axes", F.col("nf") + 1, F.col("nd")).alias("dir"))
    rows = t.where("step is not null").select("file", F.ltrim("value").alias("step")).join(head, "file")
    time = F.unix_timestamp(F.to_timestamp(F.regexp_replace(F.regexp_extract("step", r"^(\d{8}\s+\d{6})", 1), r"\s+", " "), "yyyyMMdd HHmmss")).cast("double")
    name = F.trim(F.regexp_extract("step", r"'([^']*)'", 1))
    tail = F.split(F.regexp_extract("step", r"(?s)'[^']*'(.*)", 1), r"\s+")
    tail = F.filter(F.transform(tail, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    rows = rows.select("file", "nf", "nd", "freq", "dir", time.alias("time"), name.alias("station"), tail.alias("v"))
    value = lambda i, j: F.element_at("v", F.size("v") - F.col("nf") * F.col("nd") + 1 + j * F.col("nf") + i)  # noqa: E731  after the station's numbers; frequencies run fastest
    efth = F.transform(F.sequence(F.lit(0), F.col("nf") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda j: value(i, j)))
    return rows.select("file", "time", "station", *[F.element_at("v", i + 1).alias(n) for i, n in enumerate(("lat", "lon", "depth", "wnd", "wnddir"))], "freq", "dir", efth.alias("efth"))


def best_tracks(spark: SparkSession, path: str, year: int | None = None, truncated: bool = False) -> DataFrame:
    """S11. Storm rows from best-track CSV with two header rows: row_no, time, nature, lat, lon (0..360); years from 2000 on."""
    raw = spark.read.csv(path, header=True)
    t = F.unix_timestamp(F.try_to_timestamp(F.col("ISO_TIME"), F.lit("yyyy-MM-dd HH:mm:ss")))
    lat, lon = F.col("LAT").try_cast("double"), F.col("LON").try_cast("double")
    if truncated:
        lat, lon = lat.cast("int").cast("double"), lon.cast("int").cast("double")
    out = raw.select(F.monotonically_increasing_id().alias("row_no"), t.cast("double").alias("time"), F.trim("NATURE").alias("nature"), lat.alias("lat"), lon360(lon).alias("lon")).where("time is not null and lat is not null")
    y = F.year(F.timestamp_seconds("time"))
    return out.where((y >= 2000) & ((y == year) if year else F.lit(True)))


def coast_distances(spark: SparkSession, path: str) -> DataFrame:
    """S12. `lon lat km` lines."""
    v = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 3)
    return v.select(*[F.col("v")[i].try_cast("double").alias(n) for i, n in enumerate(("lon", "lat", "distcoast"))]).where("lat is not null")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """S13. `lon lat YYYYMMDDTHHMMSS` lines (UTC); a header line is skipped."""
    v = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 3)
    t = F.unix_timestamp(F.try_to_timestamp(F.col("v")[2], F.lit("yyyyMMdd'T'HHmmss")))
    return v.select(F.col("v")[0].try_cast("double").alias("lon"), F.col("v")[1].try_cast("double").alias("lat"), t.cast("double").alias("time")).where("time is not null")


def station_list(spark: SparkSession, path: str) -> DataFrame:
    """S14. Station ids: one per line, or the quoted names of a model point file ($ comments, its last line left out)."""
    rows = lines(spark, path).where("trim(line) <> '' and not startswith(ltrim(line), '$')")
    quoted = F.regexp_extract("line", r"'([^']*)'", 1)
    files = rows.groupBy("file").agg(F.max(quoted != "").alias("_q"), F.max("line_no").alias("_last"))
    rows = rows.join(F.broadcast(files), "file")  # a list of files
    plain = F.regexp_extract(F.trim("line"), r"^(\S+)", 1)
    out = rows.where("not _q or line_no < _last").select(F.trim(F.when(F.col("_q"), quoted).otherwise(plain)).alias("station"))
    return out.where("station <> ''").distinct()
