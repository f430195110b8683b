"""Zone tagging by polygons with holes, by an index of edges by tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiles begin at multiples of their size and this: where no corner of a polygon in round degrees lies.
OFFSET = 0.0123456789


def edges(polygons: DataFrame) -> DataFrame:
    """zone_id, zone_order, ax, ay, bx, by: the edges of all rings, each ring closed.

    polygons: zone_id, zone_order and rings array<array<struct<lon, lat>>> (an outer ring and holes, or several parts, in any order: the even-odd rule
    tells them apart), or ring, one such array. Where a step in longitude exceeds 180 degrees the ring goes on beyond the seam; rings that
    stand (partly) outside 0..360 are repeated a turn away, where cells are.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    p = polygons.select("zone_id", "zone_order", F.posexplode(rings).alias("_r", "_ring")).where(F.size("_ring") > 2)
    p = p.select("zone_id", "zone_order", "_r", F.posexplode("_ring").alias("_i", "_p"))
    ring = Window.partitionBy("zone_id", "zone_order", "_r").orderBy("_i")
    step = F.col("_p.lon") - F.lag("_p.lon").over(ring)
    turn = F.when(step > 180, -360.0).when(step < -180, 360.0).otherwise(0.0)
    p = p.withColumn("_t", turn).withColumn("x", F.col("_p.lon") + F.sum("_t").over(ring.rowsBetween(Window.unboundedPreceding, 0))).withColumn("y", F.col("_p.lat"))
    whole = Window.partitionBy("zone_id", "zone_order", "_r").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = Window.partitionBy("zone_id", "zone_order", "_r")
    p = p.select(
        "zone_id", "zone_order", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("bx"), F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("by"),
        F.min("x").over(own).alias("_lo"), F.max("x").over(own).alias("_hi"),
    )
    turns = F.filter(F.array(*map(F.lit, (-360.0, 0.0, 360.0))), lambda s: (F.col("_hi") + s >= 0) & (F.col("_lo") + s < 360))
    p = p.withColumn("_s", F.explode(turns))
    return p.select("zone_id", "zone_order", (F.col("ax") + F.col("_s")).alias("ax"), "ay", (F.col("bx") + F.col("_s")).alias("bx"), "by").where("ax <> bx or ay <> by")


def _tile(c: Column, size: float) -> Column:
    return F.floor((c - OFFSET) / size).cast("int")


def _border(n: Column, size: float) -> Column:
    return n * size + OFFSET


def _x_at(y: Column) -> Column:
    return F.col("ax") + F.try_divide((F.col("bx") - F.col("ax")) * (y - F.col("ay")), F.col("by") - F.col("ay"))


def index(polygons: DataFrame, tile: float = 4.0, slab: float = 1.0) -> DataFrame:
    """tx, ty, zone_id, zone_order, inside (of the tile's lower right corner), edges: the tiles that a polygon has a part in, with the edges that touch them.

    An edge is listed in each slab of latitude that it passes, under the tiles between its ends there. Where edges pass the line
    below a row of tiles, running sums from the east give whether each corner is inside; a tile without edges is inside or outside as a whole.
    """
    e = edges(polygons)
    rows = e.withColumn("ty", F.explode(F.sequence(_tile(F.least("ay", "by"), slab), _tile(F.greatest("ay", "by"), slab))))
    low, high = _border(F.col("ty"), slab), _border(F.col("ty") + 1, slab)
    # the part of an edge within the slab, a little widened, lies between these
    clipped = lambda y: F.greatest(F.least(_x_at(y), F.greatest("ax", "bx")), F.least("ax", "bx"))
    ends = [F.when(F.col("ay") == F.col("by"), F.col(c)).otherwise(clipped(F.greatest(F.least(F.col(y), high), low))) for c, y in (("ax", "ay"), ("bx", "by"))]
    rows = rows.withColumns({"_l": F.least(*ends) - 1e-9, "_h": F.greatest(*ends) + 1e-9})
    rows = rows.withColumn("tx", F.explode(F.sequence(_tile(F.col("_l"), tile), _tile(F.col("_h"), tile))))
    listed = rows.groupBy("zone_id", "zone_order", "tx", "ty").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))  # those of a slab of a tile

    key = ["zone_id", "zone_order", "ty"]
    line = e.withColumn("ty", F.explode(F.sequence(_tile(F.least("ay", "by"), slab), _tile(F.greatest("ay", "by"), slab))))
    line = line.where((F.col("ay") > low) != (F.col("by") > low)).select(*key, _tile(_x_at(low), tile).alias("tx")).groupBy(*key, "tx").agg(F.count("*").alias("n"))
    # a corner, at the right of tile tx, is left of the passes in tiles after tx; between two tiles with passes nothing changes
    right = Window.partitionBy(*key).orderBy(F.desc("tx"))
    after = F.coalesce(F.sum("n").over(right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = line.select(*key, "tx", F.lag("tx").over(right).alias("_next"), after.alias("_after"))
    # tiles from the one with passes up to the one before the next one with passes share their corners' parity
    odd = runs.where("_after % 2 = 1").select(*key, F.explode(F.sequence("tx", F.col("_next") - 1)).alias("tx"), F.lit(True).alias("inside"))
    out = listed.join(odd, [*key, "tx"], "full")
    return out.select("tx", "ty", "zone_id", "zone_order", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("edges", F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")).alias("edges"))


def tagged(cells: DataFrame, polygons: DataFrame, key: str, into: str = "zone_id", tile: float = 4.0, slab: float = 1.0, land: str | None = None) -> DataFrame:
    """J14. The zone of each cell: that of the last polygon (by zone_order) that holds it, 0 if none does, null on land (a boolean column).

    A cell meets the entries of its own tile only. Whether it is inside follows from the tile's lower right corner and from how many of the tile's edges
    the way from that corner passes: up the right side to the cell's latitude, then west to the cell. Longitudes may be of -180..180 or 0..360.
    cells: key, lat, lon.
    """
    lon = F.col("lon")
    own = cells.select(key, F.col("lat").alias("_y"), F.when(lon < 0, lon + 360).when(lon >= 360, lon - 360).otherwise(lon).alias("_x"))
    own = own.withColumns({"tx": _tile(F.col("_x"), tile), "ty": _tile(F.col("_y"), slab)})
    met = own.join(index(polygons, tile, slab), ["tx", "ty"])
    x, y, right, low = F.col("_x"), F.col("_y"), _border(F.col("tx") + 1, tile), _border(F.col("ty"), slab)

    def passed(e: Column) -> Column:
        at_y = e.ax + F.try_divide((e.bx - e.ax) * (y - e.ay), e.by - e.ay)
        at_right = e.ay + F.try_divide((e.by - e.ay) * (right - e.ax), e.bx - e.ax)
        west = ((e.ay > y) != (e.by > y)) & (x < at_y) & (at_y <= right)
        up = ((e.ax > right) != (e.bx > right)) & (at_right > low) & (at_right <= y)
        return F.when(west, 1).otherwise(0) + F.when(up, 1).otherwise(0)

    n = F.aggregate("edges", F.col("inside").cast("int"), lambda s, e: s + passed(e))
    found = met.where(n % 2 == 1).groupBy(key).agg(F.max_by("zone_id", "zone_order").alias(into))
    zone = F.coalesce(into, F.lit(0))
    return cells.join(found, key, "left").withColumn(into, F.when(~F.coalesce(land, F.lit(False)), zone) if land else zone)
