"""Scalar column expressions: times, angles, winds, distances. All take and return Columns; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Mission names in the order of their ids.
MISSIONS = ("JASON3", "JASON2", "CRYOSAT2", "JASON1", "HY2", "SARAL", "SENTINEL3A", "ENVISAT", "ERS1", "ERS2", "GEOSAT", "GFO", "TOPEX", "SENTINEL3B", "CFOSAT")
UNIT_SECONDS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def decoded_time(n: Column, unit: str, origin: str) -> Column:
    """P1. `n` units since the origin (a UTC date and time, with or without T and +00:00) as epoch seconds."""
    clean = origin.replace("T", " ").replace("+00:00", "").strip()
    return n * UNIT_SECONDS[unit] + F.unix_timestamp(F.to_timestamp(F.lit(clean))).cast("double")


def lon180(lon: Column) -> Column:
    """P2. Longitude in -180..180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def lon360(lon: Column) -> Column:
    """P2. Longitude in 0..360."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def wind_at_height(v: Column, z1: Column, z2: float = 10.0, alpha: float = 0.12) -> Column:
    """P3. Wind speed moved from height z1 (4 m where unknown) to z2 by a power law."""
    return v * F.pow(F.lit(z2) / F.coalesce(z1, F.lit(4.0)), F.lit(alpha))


def wind_speed(u: Column, v: Column) -> Column:
    """P4."""
    return F.sqrt(u * u + v * v)


def period(frequency: Column, least: float = 0.0) -> Column:
    """P5. 1 / f where f is above `least`."""
    return F.when(frequency > least, F.lit(1.0) / frequency)


def depth_below(elevation: Column) -> Column:
    """P6. Depth, positive downward; null on land."""
    return F.when(elevation < 0, -elevation)


def lead_seconds(valid_time: Column, cycle: Column) -> Column:
    """P7. For files that don't give their cycle, see `operators.timejoin.with_cycle`."""
    return valid_time - cycle


def mean_of(values: Column) -> Column:
    """P8. Mean of an array without its nulls."""
    kept = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def quantised(x: Column, decimals: int = 2) -> Column:
    """P9."""
    return F.round(x, decimals)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """P10. Haversine distance."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ellipsoid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS84 ellipsoid by the Andoyer-Lambert formula (public closed form)."""
    a, f = 6378.137, 1 / 298.257223563
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.try_divide(F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2), F.pow(F.cos(s / 2), 2))
    y = (s + F.sin(s)) * F.try_divide(F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(s / 2), 2))
    return F.when(s == 0, 0.0).otherwise(a * (s - f / 2 * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))))


def distance_weight(d: Column, limit: float) -> Column:
    """P11. Weight that falls from 1 to 0 at limit + 1."""
    return F.greatest(F.lit(0.0), 1 - d / (limit + 1.0))


def mission_name(name: Column) -> Column:
    """P13. A hyphen between the letters and the first digits of a mission."""
    return F.regexp_replace(name, r"^(\D*[A-Za-z])(\d)", "$1-$2")


def mission_id(name: Column) -> Column:
    """P13. Its place in MISSIONS, or null."""
    at = F.array_position(F.array(*map(F.lit, MISSIONS)), F.regexp_replace(F.upper(name), "-", ""))
    return F.when(at > 0, (at - 1).cast("int"))


def cell3(lat: Column, lon: Column, edge_km: float) -> Column:
    """Cell of the unit sphere, cut into cubes of that edge: struct(x, y, z). Points within the edge are in touching cubes."""
    la, lo = F.radians(lat), F.radians(lon)
    axis = lambda c: F.floor(c * EARTH_KM / edge_km).cast("int")
    return F.struct(axis(F.cos(la) * F.cos(lo)).alias("x"), axis(F.cos(la) * F.sin(lo)).alias("y"), axis(F.sin(la)).alias("z"))


def touching(cell: Column) -> Column:
    """The cell and the 26 around it."""
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.flatten(F.flatten(F.transform(three, lambda i: F.transform(three, lambda j: F.transform(three, lambda k: F.struct((cell.x + i).alias("x"), (cell.y + j).alias("y"), (cell.z + k).alias("z")))))))


def sphere_km(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Place on the sphere in km from its centre."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo) * EARTH_KM, F.cos(la) * F.sin(lo) * EARTH_KM, F.sin(la) * EARTH_KM


def cube_number(x: Column, y: Column, z: Column) -> Column:
    """One number of a cube's place on three axes. Places 2**21 cubes apart share theirs, neighbours never do."""
    own = lambda c: F.pmod(c, F.lit(1 << 21))
    return F.shiftleft(own(x), 42) + F.shiftleft(own(y), 21) + own(z)


def slot(t: Column, step: float, origin: float = 0.0) -> Column:
    """Number of the nearest regular time; a time exactly between two belongs to neither when the window is half a step."""
    return F.floor((t - origin) / step + 0.5).cast("bigint")


def nearest_index(x: Column, first: float, step: float, size: int, wrap: bool = False) -> Column:
    """Index of the nearest point of a regular axis; the lower one halfway between two."""
    i = F.ceil((x - first) / step - 0.5).cast("int")
    return F.pmod(i, F.lit(size)) if wrap else F.greatest(F.lit(0), F.least(i, F.lit(size - 1)))


def axis_count(axis: list[float], x: Column) -> Column:
    """How many values of an ascending axis are at most x: a binary search, a step for each bit of the axis' size."""
    values, steps = F.array(*[F.lit(float(a)) for a in axis]), [1 << k for k in reversed(range(len(axis).bit_length()))]
    go = lambda at, step: F.when((at + step <= len(axis)) & (F.get(values, at + step - 1) <= x), at + step).otherwise(at)
    return F.when(x.isNotNull(), F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go))


def axis_bracket(axis: list[float], x: Column) -> tuple[Column, Column]:
    """Index of the axis value at or below x, and the fraction of the way to the next one (0 on the last); null outside the axis."""
    i = axis_count(axis, x) - 1
    values = F.array(*[F.lit(float(a)) for a in axis])
    a, b = F.get(values, i), F.get(values, i + 1)
    inside = (x >= axis[0]) & (x <= axis[-1])
    return F.when(inside, i), F.when(inside, F.coalesce((x - a) / (b - a), F.lit(0.0)))


def axis_nearest(axis: list[float], x: Column, period: float | None = None) -> Column:
    """Index of the nearest value of an ascending axis, the lower one halfway between two. With a period (of longitudes), the axis goes on in both
    directions; x is within it."""
    n = len(axis)
    own = [axis[-1] - period, *axis, axis[0] + period] if period else list(axis)
    values = F.array(*[F.lit(float(a)) for a in own])
    i = F.greatest(axis_count(own, x) - 1, F.lit(0))
    a, b = F.get(values, i), F.get(values, i + 1)
    at = F.when(b - x < x - a, i + 1).otherwise(i)
    return F.when(x.isNotNull(), F.pmod(at - 1, F.lit(n)) if period else at).cast("int")
