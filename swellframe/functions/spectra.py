"""Directional wave spectra in array columns; a spectrum is [frequency][direction]."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def band_widths_47() -> Column:
    """X2. Widths of the 47 bands of a moored buoy."""
    parts = ((0.010, 1), (0.005, 13), (0.010, 26), (0.020, 7))
    return F.flatten(F.array(*[F.array_repeat(F.lit(w), n) for w, n in parts]))


def log_band_widths(freq: Column) -> Column:
    """X3. Widths of bands whose frequencies grow by a constant factor (from the first two)."""
    step = F.element_at(freq, 2) / F.element_at(freq, 1)
    return F.transform(freq, lambda f: 0.5 * (step - 1 / step) * f)


def from_moments(s: Column, width: Column, a1: Column, a2: Column, r1: Column, r2: Column, step: int = 10) -> Column:
    """X1. Density by direction 0, step, ..., 360 from the moments of a buoy: arrays by frequency, angles in degrees."""
    z = F.arrays_zip(s.alias("s"), width.alias("w"), a1.alias("a1"), a2.alias("a2"), r1.alias("r1"), r2.alias("r2"))
    theta = F.sequence(F.lit(0), F.lit(360), F.lit(step))
    return F.transform(z, lambda b: F.transform(theta, lambda t: b.s * b.w / math.pi * (0.5 + b.r1 * F.cos(F.radians(t - b.a1)) + b.r2 * F.cos(2 * F.radians(t - b.a2)))))


def power(efth: Column, width: Column) -> Column:
    """X4. Power by frequency: the sum over directions times their step and the band's width."""
    return F.zip_with(efth, width, lambda row, w: total(row) * (2 * math.pi) / F.size(row) * w)


def flipped(dirs: Column, row: Column) -> Column:
    """X5. (dir, value) pairs in the opposite convention: a direction gets the value of that plus 180, ascending."""
    return F.array_sort(F.transform(F.arrays_zip(dirs.alias("d"), row.alias("v")), lambda x: F.struct(F.pmod(x.d + 180, F.lit(360.0)).alias("d"), x.v.alias("v"))))


def mean_direction(dirs: Column, row: Column) -> Column:
    """X6. Energy-weighted mean direction, 0..360 degrees."""
    s = total(F.zip_with(dirs, row, lambda d, e: e * F.sin(F.radians(d))))
    c = total(F.zip_with(dirs, row, lambda d, e: e * F.cos(F.radians(d))))
    a = F.degrees(F.atan2(s, c))
    return F.when(a < 0, a + 360).otherwise(a)


def height(p: Column) -> Column:
    """X7. Significant height from power by frequency."""
    return 4.01 * F.sqrt(total(p))


def trapezoid(x: Column, y: Column) -> Column:
    def area(z: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(z.x) - 1)
        terms = F.transform(at, lambda i: (F.element_at(z.x, i + 1) - F.element_at(z.x, i)) * (F.element_at(z.y, i + 1) + F.element_at(z.y, i)) / 2)
        return F.when(F.size(z.x) > 1, total(terms)).otherwise(0.0)

    return bound(F.struct(x.alias("x"), y.alias("y")), area)


def _closed(dirs: Column, efth: Column, weight) -> Column:
    """By frequency, the trapezoid over directions (radians) of weight(direction) * E, the first direction repeated at its end."""
    th = F.transform(dirs, lambda d: F.radians(d))
    ring = F.concat(th, F.array(F.element_at(th, 1) + 2 * math.pi))
    closed = lambda r: F.transform(efth, lambda row: trapezoid(r, F.zip_with(F.concat(row, F.array(F.element_at(row, 1))), r, lambda e, t: e * weight(t))))
    return bound(ring, closed)


def bulk_height(freq: Column, dirs: Column, efth: Column) -> Column:
    """X8. Significant height by trapezoids over direction and angular frequency."""
    w = F.transform(freq, lambda f: 2 * math.pi * f)
    return 4.004 * F.sqrt(F.abs(trapezoid(w, _closed(dirs, efth, lambda t: F.lit(1.0))))) / math.sqrt(2 * math.pi)


def bulk_direction(freq: Column, dirs: Column, efth: Column) -> Column:
    """X8. Bulk mean direction, turned by 180 degrees, 0..360."""
    w = F.transform(freq, lambda f: 2 * math.pi * f)
    a, b = (trapezoid(w, _closed(dirs, efth, f)) for f in (F.cos, F.sin))
    return F.pmod(F.degrees(F.atan2(b, a)) + 180, F.lit(360.0))


def peak_frequency(freq: Column, p: Column, ties: str = "first") -> Column:
    """X9. Frequency of the largest power: the first (buoy) or the mean (model) of equal ones."""
    top = F.array_max(p)
    if ties == "first":
        return F.element_at(freq, F.array_position(p, top).cast("int"))
    at = F.filter(F.arrays_zip(freq.alias("f"), p.alias("p")), lambda x: x.p == top)
    return total(F.transform(at, lambda x: x.f)) / F.size(at)


def interpolated(freq: Column, values: Column, to: Column) -> Column:
    """X10. Values interpolated linearly to other frequencies; 0 outside."""
    def at(g: Column, pts: Column) -> Column:
        a = F.try_element_at(F.filter(pts, lambda x: x.f <= g), F.lit(-1))
        b = F.try_element_at(F.filter(pts, lambda x: x.f >= g), F.lit(1))
        inside = a.isNotNull() & b.isNotNull()
        return F.when(inside, F.when(a.f == b.f, a.v).otherwise(a.v + (b.v - a.v) * F.try_divide(g - a.f, b.f - a.f))).otherwise(0.0)

    return bound(F.arrays_zip(freq.alias("f"), values.alias("v")), lambda pts: F.transform(to, lambda g: at(g, pts)))


def jonswap(hs: Column, tp: Column, direction: Column, freq: Column, dirs: Column, gamma: float = 3.3, spread: float = 30.0) -> Column:
    """X11. JONSWAP spectrum with a Gaussian spread over directions, scaled so that it holds (hs / 4)^2."""
    fp = 1.0 / tp

    def shape(f: Column) -> Column:
        sigma = F.when(f <= fp, 0.07).otherwise(0.09)
        r = F.exp(-F.pow(f - fp, 2) / (2 * sigma * sigma * fp * fp))
        return F.pow(f, -5) * F.exp(-1.25 * F.pow(f / fp, -4)) * F.pow(F.lit(gamma), r)

    gap = lambda d: F.pmod(d - direction + 180, F.lit(360.0)) - 180
    by_dir = F.transform(dirs, lambda d: F.exp(-F.pow(gap(d) / spread, 2) / 2))
    by_freq = F.transform(freq, shape)
    step = 2 * math.pi / F.size(dirs)

    def scaled(z: Column) -> Column:
        scale = hs * hs / 16 / (trapezoid(freq, z.f) * total(z.d) * step)
        return bound(F.struct(z.f.alias("f"), z.d.alias("d"), scale.alias("k")), lambda y: F.transform(y.f, lambda s: F.transform(y.d, lambda d: s * d * y.k)))

    return bound(F.struct(by_freq.alias("f"), by_dir.alias("d")), scaled)
