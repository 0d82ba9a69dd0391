"""Leaf angle distributions and the projection of leaves onto a ray's normal plane."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def density(family: str, theta: np.ndarray, *params: float) -> np.ndarray:
    """Density of leaf inclination ``theta`` (radians, 0 to pi / 2)."""
    t = np.asarray(theta, float)
    p = math.pi
    simple = {
        "uniform": lambda: np.full_like(t, 2 / p),
        "spherical": lambda: np.sin(t),
        "planophile": lambda: 2 / p * (1 + np.cos(2 * t)),
        "erectophile": lambda: 2 / p * (1 - np.cos(2 * t)),
        "plagiophile": lambda: 2 / p * (1 - np.cos(4 * t)),
        "extremophile": lambda: 2 / p * (1 + np.cos(4 * t)),
    }
    if family in simple:
        return simple[family]()
    if family == "ellipsoidal":
        (chi,) = params
        if chi < 1:
            e = math.sqrt(1 - chi * chi)
            scale = chi + math.asin(e) / e
        elif chi > 1:
            e = math.sqrt(1 - 1 / chi**2)
            scale = chi + math.log((1 + e) / (1 - e)) / (2 * e * chi)
        else:
            scale = 2.0
        return 2 * chi**3 * np.sin(t) / (scale * (np.cos(t) ** 2 + chi**2 * np.sin(t) ** 2) ** 2)
    if family == "beta":
        mu, nu = params
        x = np.clip(2 * t / p, 1e-12, 1 - 1e-12)
        return 2 / p * (1 - x) ** (mu - 1) * x ** (nu - 1) * math.exp(math.lgamma(mu + nu) - math.lgamma(mu) - math.lgamma(nu))
    raise ValueError(f"unknown leaf angle distribution {family}")


def projections(family: str = "spherical", *params: float, degrees: int = 90) -> np.ndarray:
    """G at each whole degree of zenith from 0 to ``degrees``."""
    nodes, weights = np.polynomial.legendre.leggauss(400)
    leaf = (nodes + 1) * math.pi / 4
    f = density(family, leaf, *params) * weights * math.pi / 4
    f /= f.sum()
    out = []
    for d in range(degrees + 1):
        z = math.radians(min(d, 89.999))
        flat = np.cos(z) * np.cos(leaf)
        ratio = 1 / np.maximum(np.tan(z) * np.tan(leaf), 1e-300)
        psi = np.arccos(np.clip(ratio, -1, 1))
        a = np.where(ratio >= 1, flat, flat * (1 + 2 / math.pi * (np.tan(psi) - psi)))
        out.append(float((f * a).sum()))
    return np.array(out)


def projection(zenith: Column | str, family: str = "spherical", *params: float) -> Column:
    """G at a zenith angle in degrees, linear between whole degrees: a lookup in 91 numbers."""
    z = F.col(zenith) if isinstance(zenith, str) else zenith
    table = F.lit([float(v) for v in projections(family, *params)])
    z = F.least(F.greatest(z, F.lit(0.0)), F.lit(90.0))
    low = F.least(F.floor(z), F.lit(89)).cast("int")
    f = z - low
    return F.get(table, low) * (1 - f) + F.get(table, low + 1) * f
