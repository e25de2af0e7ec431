"""Column functions: units, angles, projections, curves, colours and text."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_M = 6371008.8
#: Slope (%) under which a fall line is not defined: for samples, and for bench slopes.
TSA_FLOOR, FALL_FLOOR = 3.0, 4.0

# Metres in each unit, by its accepted spellings.
UNITS = {
    "m": 1.0, "meter": 1.0, "metre": 1.0, "meters": 1.0, "metres": 1.0,
    "ft": 0.3048, "foot": 0.3048, "feet": 0.3048,
    "km": 1000.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "yd": 0.9144,
}


def null_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def slope_pct(gx: Column, gy: Column) -> Column:
    return F.hypot(gx, gy) * 100


def tsa_deg(heading: Column, gx: Column, gy: Column) -> Column:
    """Degrees between the trail and the fall line; null where the slope is under ``TSA_FLOOR``."""
    cosine = F.least(F.abs(F.cos(heading - F.atan2(gy, gx))), F.lit(1.0))
    return F.when(slope_pct(gx, gy) >= TSA_FLOOR, F.degrees(F.acos(cosine)))


@F.arrow_udf(DoubleType())
def _angle(heading: pa.Array, gx: pa.Array, gy: pa.Array) -> pa.Array:
    out = []
    for h, x, y in zip(heading.to_pylist(), gx.to_pylist(), gy.to_pylist(), strict=True):
        a = None if h is None or x is None or y is None else h - math.atan2(y, x)
        cosine = abs(math.cos(a)) if a is not None and math.isfinite(a) else 1.0  # as least() skips null and NaN
        out.append(math.degrees(math.acos(min(cosine, 1.0))))
    return pa.array(out, pa.float64())


def tsa_near(heading: Column, gx: Column, gy: Column) -> Column:
    """``tsa_deg`` by the C library, whose last digit is nearer than that of Java's cos, acos and atan2: a mean that is 45 but for that digit falls on the side where other engines see it."""
    return F.when(slope_pct(gx, gy) >= TSA_FLOOR, _angle(*[c.cast("double") for c in (heading, gx, gy)]))


def fall_tsa(cross: Column, along: Column) -> Column:
    """The same from bench slopes in %; 90 where the side slope is under ``FALL_FLOOR``."""
    return F.when(F.hypot(cross, along) * 100 >= FALL_FLOOR, F.degrees(F.atan2(F.abs(cross), F.abs(along)))).otherwise(90.0)


def equirect_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, F.radians(lat2 - lat1)) * EARTH_M


_NUMBER = r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*"


def length_m(text: Column) -> Column:
    """Metres of '5 ft', '1.2 km' or a bare number; null for anything else, numbers like .5 or 1e3 and other spellings of units too."""
    pattern = _NUMBER + r"([A-Za-z]*)\s*$"
    number, unit = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(number != "", number.try_cast("double") * F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(table, unit)))


def rate_m_per_day(text: Column) -> Column:
    """Metres a day of '10 m/day'; null without a unit of length and "/day"."""
    plain = F.regexp_extract(text, _NUMBER + r"([A-Za-z]+)\s*/\s*day\s*$", 0)
    return F.when(plain != "", length_m(F.regexp_replace(text, r"\s*/\s*day\s*$", "")))


def percent(text: Column) -> Column:
    """The number of '10 %' or '10'; null for anything else."""
    return F.nullif(F.regexp_extract(text, _NUMBER + r"%?\s*$", 1), F.lit("")).try_cast("double")


# --- projections ----------------------------------------------------------------

_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_srid(lon: Column, lat: Column) -> Column:
    """EPSG code of the WGS84 UTM zone: 326xx north of and on the equator, 327xx south of it."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(lon: Column, lat: Column, srid: Column) -> tuple[Column, Column]:
    """(x, y) by Krueger's series to the fourth order."""
    central = ((srid % 100) * 6 - 183).cast("double")
    phi, lam = F.radians(lat), F.radians(lon - central)
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.hypot(t, F.cos(lam)))
    x = eta + reduce(lambda a, b: a + b, [k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(_ALPHA, 1)])
    y = xi + reduce(lambda a, b: a + b, [k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(_ALPHA, 1)])
    return 500000 + _K0 * _RADIUS * x, F.when(srid >= 32700, 1e7).otherwise(0.0) + _K0 * _RADIUS * y


def from_utm(x: Column, y: Column, srid: Column) -> tuple[Column, Column]:
    """(lon, lat): the inverse of ``to_utm``."""
    xi = (y - F.when(srid >= 32700, 1e7).otherwise(0.0)) / (_K0 * _RADIUS)
    eta = (x - 500000) / (_K0 * _RADIUS)
    xi1 = xi - reduce(lambda a, b: a + b, [k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(_BETA, 1)])
    eta1 = eta - reduce(lambda a, b: a + b, [k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(_BETA, 1)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + reduce(lambda a, b: a + b, [k * F.sin(2 * j * chi) for j, k in enumerate(_DELTA, 1)])
    central = ((srid % 100) * 6 - 183).cast("double")
    return central + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def lonlat_to_tile_px(lon: Column, lat: Column, zoom, size: int = 256) -> tuple[Column, Column]:
    """Global web-mercator pixel at a zoom."""
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom) * size
    sin = F.sin(F.radians(lat))
    return (lon + 180) / 360 * n, (0.5 - F.log((1 + sin) / (1 - sin)) / (4 * math.pi)) * n


# --- curves and colours ---------------------------------------------------------


def curve_value(x: Column, curve: list[tuple[float, float]]) -> Column:
    """Log-linear between anchors, flat outside; a value of 0 or less is read as 0.01."""
    points = [(float(a), math.log(b if b > 0 else 0.01)) for a, b in curve]
    out = F.when(x <= points[0][0], math.exp(points[0][1]))
    for (a, u), (b, v) in zip(points, points[1:]):
        if b > a:
            out = out.when(x <= b, F.exp(u + (v - u) * (x - a) / (b - a)))
    return out.when(x.isNotNull(), math.exp(points[-1][1]))


def climb_cost(m: Column, grade: Column) -> Column:
    """Cost of a metre climbed at a grade (a ratio) that costs ``m`` a metre."""
    return m * F.sqrt(1 + grade * grade) / grade


#: Stops of the wetness colours (index value, red, green, blue, alpha).
WET_STOPS = [(6.0, 198, 233, 245, 0), (7.0, 160, 215, 240, 90), (9.0, 79, 163, 217, 150), (12.0, 31, 95, 191, 205), (14.0, 11, 42, 128, 230)]


def colour_ramp(value: Column, stops=WET_STOPS) -> Column:
    """struct(r, g, b, a), piecewise linear over the stops, halves rounded to even; null and values that aren't finite are transparent black."""

    def channel(k: int) -> Column:
        out = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).when(value <= stops[0][0], float(stops[0][k]))
        for p, q in zip(stops, stops[1:]):
            out = out.when(value <= q[0], p[k] + (q[k] - p[k]) * (value - p[0]) / (q[0] - p[0]))
        return F.bround(out.otherwise(float(stops[-1][k]))).cast("int")

    return F.struct(*[channel(k).alias(n) for k, n in enumerate("rgba", 1)])


# --- text -----------------------------------------------------------------------


def slugify(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(t), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def cut(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def length_label(metres: Column) -> Column:
    return F.format_string("%.2f km", metres / 1000)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fmt_coord(x: Column) -> Column:
    return F.format_string("%.7f", x)


def corner_kind(grade: Column) -> Column:
    """A corner's kind by the grade (%) through it."""
    return F.when(grade <= 15, "climbing turn").when(grade >= 25, "switchback").when(grade.isNotNull(), "between")


def classify(value: Column, breaks: list[float]) -> Column:
    """How many breaks the value has reached."""
    return F.when(value.isNotNull(), reduce(lambda a, b: a + b, [(value >= x).cast("int") for x in breaks]))


#: Breaks of the signed grade and of the trail-slope angle.
GRADE_BREAKS, TSA_BREAKS = [-35.0, -18.0, -5.0, 5.0, 18.0, 35.0], [45.0, 60.0, 68.0]
