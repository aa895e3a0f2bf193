"""Column functions of the urban library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State bits of a sampled height: valid, then missing, invalid, outside for terrain and canopy, then overflow.
VALID, A_MISSING, B_MISSING, A_INVALID, B_INVALID, A_OUTSIDE, B_OUTSIDE, OVERFLOW = (1 << k for k in range(8))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. Lambdas over arrays are interpreted, so an expression named inside one runs for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def half_up(x: Column) -> Column:
    """floor(x + 0.5) of the value as a 32-bit float."""
    return F.floor(x.cast("float").cast("double") + F.lit(0.5).cast("double")).cast("long")


def r6(x: Column) -> Column:
    """A reported double: six decimals."""
    return F.round(x.cast("double"), 6)


def inside(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Half-open rectangle: left and bottom edges count, right and top do not."""
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def with_steps(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Add columns one after the other; each may use those before it."""
    for name, e in steps:
        df = df.withColumn(name, F.expr(e))
    return df


def nested_sql(base: str, steps: list[tuple[str, str]]) -> str:
    """The same steps as nested SELECTs."""
    for name, e in steps:
        base = f"SELECT *, {e} AS {name} FROM ({base})"
    return base


#: Ellipsoid and plane zone: semi-major axis, flattening, origin, scale. Fixed values.
AXIS, FLATTENING, LAT0, LON0, SCALE = 6378137.0, 1 / 298.257222101, 36.0, 139 + 50 / 60, 0.9999


def _series() -> tuple[float, list[float], list[float], list[float], float]:
    n = FLATTENING / (2 - FLATTENING)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630, 61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880, 49561 * n**4 / 161280 - 179 * n**5 / 168, 34729 * n**5 / 80640]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105, 17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480, 4397 * n**4 / 161280 - 11 * n**5 / 504, 4583 * n**5 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315, 56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105, 4279 * n**4 / 630 - 332 * n**5 / 35, 4174 * n**5 / 315]
    return n, alpha, beta, delta, AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _north0() -> float:
    import math

    n, alpha, _, _, radius = _series()
    k, s = 2 * math.sqrt(n) / (1 + n), math.sin(math.radians(LAT0))
    xi = math.atan(math.sinh(math.atanh(s) - k * math.atanh(k * s)))
    return SCALE * radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


def _e(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def plane_steps(lat: str, lon: str) -> list[tuple[str, str]]:
    """Longitude and latitude in degrees to plane east and north in metres (Krueger series)."""
    n, alpha, _, _, radius = _series()
    k = 2 * n**0.5 / (1 + n)
    return [
        ("gk_s", f"sin(radians({lat}))"),
        ("gk_t", f"sinh(atanh(gk_s) - {_e(k)} * atanh({_e(k)} * gk_s))"),
        ("gk_d", f"radians({lon} - {_e(LON0)})"),
        ("gk_xi", "atan2(gk_t, cos(gk_d))"),
        ("gk_eta", "atanh(sin(gk_d) / sqrt(1 + gk_t * gk_t))"),
        ("east", f"{_e(SCALE * radius)} * (gk_eta" + "".join(f" + {_e(a)} * cos({2 * j} * gk_xi) * sinh({2 * j} * gk_eta)" for j, a in enumerate(alpha, 1)) + ")"),
        ("north", f"{_e(SCALE * radius)} * (gk_xi" + "".join(f" + {_e(a)} * sin({2 * j} * gk_xi) * cosh({2 * j} * gk_eta)" for j, a in enumerate(alpha, 1)) + f") - {_e(_north0())}"),
    ]


def degree_steps(east: str, north: str) -> list[tuple[str, str]]:
    """Plane east and north in metres back to latitude and longitude in degrees."""
    _, _, beta, delta, radius = _series()
    return [
        ("ig_xi", f"({north} + {_e(_north0())}) / {_e(SCALE * radius)}"),
        ("ig_eta", f"{east} / {_e(SCALE * radius)}"),
        ("ig_x", "ig_xi" + "".join(f" - {_e(b)} * sin({2 * j} * ig_xi) * cosh({2 * j} * ig_eta)" for j, b in enumerate(beta, 1))),
        ("ig_e", "ig_eta" + "".join(f" - {_e(b)} * cos({2 * j} * ig_xi) * sinh({2 * j} * ig_eta)" for j, b in enumerate(beta, 1))),
        ("ig_chi", "asin(sin(ig_x) / cosh(ig_e))"),
        ("lat", "degrees(ig_chi" + "".join(f" + {_e(d)} * sin({2 * j} * ig_chi)" for j, d in enumerate(delta, 1)) + ")"),
        ("lon", f"{_e(LON0)} + degrees(atan2(sinh(ig_e), cos(ig_x)))"),
    ]


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID of version 5 in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
