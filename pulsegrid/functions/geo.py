"""Geographic and transverse Mercator coordinates, as column expressions.

Krüger's series to the sixth order, good to well under a millimetre inside a
zone.  Datum shifts that need grids are not done.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The GRS 80 ellipsoid and the scale of the UTM zones.
A, FLAT, SCALE = 6378137.0, 1 / 298.257222101, 0.9996
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
# Coefficients of the series, forward and back.
ALPHA = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
]
BETA = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
]


def atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def to_utm(points: DataFrame, zone: int, south: bool = False, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with ``x, y`` in metres of a UTM zone, from degrees."""
    e = math.sqrt(FLAT * (2 - FLAT))
    phi, lam = F.radians(lat), F.radians(F.col(lon) - (6 * zone - 183))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi0, eta0 = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    p = points.withColumns({"_xi": xi0, "_eta": eta0})
    xi, eta = F.col("_xi"), F.col("_eta")
    north = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)), F.lit(0.0))
    east = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)), F.lit(0.0))
    return p.withColumns({"x": 500000.0 + SCALE * RADIUS * east, "y": (1e7 if south else 0.0) + SCALE * RADIUS * north}).drop("_xi", "_eta")


def from_utm(points: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """Points with ``lon, lat`` in degrees, from metres of a UTM zone."""
    e2 = FLAT * (2 - FLAT)
    xi, eta = (F.col("y") - (1e7 if south else 0.0)) / (SCALE * RADIUS), (F.col("x") - 500000.0) / (SCALE * RADIUS)
    p = points.withColumns({"_xi": xi, "_eta": eta})
    xi, eta = F.col("_xi"), F.col("_eta")
    xi0 = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA)), F.lit(0.0))
    eta0 = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA)), F.lit(0.0))
    p = p.withColumns({"_tau0": F.sin(xi0) / F.sqrt(F.sinh(eta0) * F.sinh(eta0) + F.cos(xi0) * F.cos(xi0)), "lon": F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (6 * zone - 183)})
    p = p.withColumn("_tau", F.col("_tau0"))
    e = math.sqrt(e2)
    for _ in range(3):  # Newton steps towards the tangent of latitude
        tau = F.col("_tau")
        sigma = F.sinh(e * atanh(e * tau / F.sqrt(1 + tau * tau)))
        got = tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)
        step = (F.col("_tau0") - got) / F.sqrt(1 + got * got) * (1 + (1 - e2) * tau * tau) / ((1 - e2) * F.sqrt(1 + tau * tau))
        p = p.withColumn("_tau", tau + step)
    return p.withColumn("lat", F.degrees(F.atan("_tau"))).drop("_xi", "_eta", "_tau0", "_tau")
