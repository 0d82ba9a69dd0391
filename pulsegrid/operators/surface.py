"""Change of a canopy surface between two surveys, held against what pulses alone would show.

A cell's surface is the maximum of its pulses.  Were nothing changed, which of the
pooled pulses belong to which survey would be chance: the difference of the two
maxima reaches d just if all pulses within d of the pooled maximum fell to one
survey.  With m such pulses of n, n_a and n_b, that has the probability

    n_a (n_a - 1) .. (n_a - m + 1) / (n .. (n - m + 1)) + the same of n_b,

which is exact and takes no drawing of permutations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell, finite
from ..plans.scratch import cut


def pulse_tops(points: DataFrame, size: float, height: str = "z") -> DataFrame:
    """``row, col, pulse, top``: the highest return of each pulse in each cell."""
    keyed = points.filter(finite(height)).select(cell("y", size).alias("row"), cell("x", size).alias("col"), "pulse", F.col(height).cast("double").alias("h"))
    return keyed.groupBy("row", "col", "pulse").agg(F.max("h").alias("top"))


#: Pulses whose chances are taken at once, so that memory does not follow a cell's pulses.
STEP = 65_536


def chance(n_a: int, n_b: int, m: int, alpha: float) -> tuple[float | None, int | None]:
    """``p`` of m pulses all in one survey, and ``need``: the fewest pulses for which that is at most ``alpha``.

    Both products fall with the number of pulses, so counting ends where both are known.
    """
    n, a, b = n_a + n_b, 1.0, 1.0
    p, need = None, None
    for first in range(1, n + 1, STEP):
        i = np.arange(first, min(first + STEP, n + 1), dtype="f8")
        left = a * np.cumprod(np.maximum(n_a - i + 1, 0) / (n - i + 1))
        right = b * np.cumprod(np.maximum(n_b - i + 1, 0) / (n - i + 1))
        both = left + right
        if first <= m < first + len(i):
            p = float(both[m - first])
        if need is None and both[-1] <= alpha:
            need = first + int(np.argmax(both <= alpha))
        if need is not None and m < first + len(i):
            break
        a, b = left[-1], right[-1]
    return p, need


def surface_change(a: DataFrame, b: DataFrame, size: float, alpha: float = 0.05, noise: float = 0.0, height: str = "z") -> DataFrame:
    """``row, col, value_a, value_b, diff, n_a, n_b, p, lod, significant`` of cells that both surveys hit.

    ``a`` and ``b`` are points ``x, y, pulse`` with a height.  ``p`` is the chance of
    so large a difference of either sign.  ``lod`` is the difference from which on a
    cell is detected: the chance level ``alpha``, together with the ``noise`` (one
    standard deviation) that both surfaces have in common; null where the cell's
    pulses are too few for any difference to be.
    """
    tops = pulse_tops(a, size, height).withColumn("later", F.lit(0)).unionByName(pulse_tops(b, size, height).withColumn("later", F.lit(1)))
    # a pulse's number may stand in both surveys; equal tops are counted, so that no task holds a cell's pulses
    keys = ["row", "col"]
    counts = cut(tops.groupBy(*keys, "top").agg(F.sum(1 - F.col("later")).alias("a"), F.sum("later").alias("b")))
    held = counts.groupBy(*keys).agg(
        F.max(F.when(F.col("a") > 0, F.col("top"))).alias("value_a"), F.max(F.when(F.col("b") > 0, F.col("top"))).alias("value_b"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b")
    )
    held = held.filter("n_a > 0 and n_b > 0").withColumn("diff", F.col("value_b") - F.col("value_a"))
    gap = F.abs("diff")
    # pulses that would all have to be of one survey: those above the lower of the two maxima
    above = counts.join(held.select(*keys, F.least("value_a", "value_b").alias("low")), keys).groupBy(*keys).agg(F.sum(F.when(F.col("top") > F.col("low"), F.col("a") + F.col("b")).otherwise(0)).alias("m"))
    m = F.when(gap > 0, F.greatest("m", F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))

    @F.pandas_udf("p double, need long")
    def level(n_a: pd.Series, n_b: pd.Series, m: pd.Series) -> pd.DataFrame:
        found = [chance(*v, alpha) for v in zip(n_a.tolist(), n_b.tolist(), m.tolist(), strict=True)]
        return pd.DataFrame({"p": pd.Series([v[0] for v in found], dtype="float64"), "need": pd.Series([v[1] for v in found], dtype="Int64")})

    held = cut(held.join(above, keys).withColumn("c", level("n_a", "n_b", m)))
    p = F.when(gap > 0, F.least(F.col("c.p"), F.lit(1.0))).otherwise(F.lit(1.0))
    # the difference that leaves just as many pulses above as are needed
    upto = F.sum(F.col("a") + F.col("b")).over(Window.partitionBy(*keys).orderBy(F.desc("top")))
    ranked = counts.withColumn("upto", upto).join(held.select(*keys, F.col("c.need").alias("need")), keys).filter(F.col("upto") > F.col("need"))
    held = held.join(ranked.groupBy(*keys).agg(F.max("top").alias("top")), keys, "left")
    reach = F.greatest("value_a", "value_b") - F.col("top")
    spread = 1.959963984540054 * noise * math.sqrt(2.0)
    lod = F.sqrt(reach * reach + spread * spread)
    out = held.select("row", "col", "value_a", "value_b", "diff", "n_a", "n_b", p.alias("p"), lod.alias("lod"))
    return out.withColumn("significant", F.coalesce((F.col("p") <= alpha) & (F.abs("diff") >= F.col("lod")), F.lit(False)))


def change_summary(found: DataFrame) -> DataFrame:
    """``sign, cells, mean, expected``: detected cells by sign, and how many would be detected by chance at their own levels."""
    sign = F.when(~F.col("significant"), "none").when(F.col("diff") > 0, "gain").otherwise("loss")
    return found.groupBy(sign.alias("sign")).agg(F.count("*").alias("cells"), F.avg("diff").alias("mean"))
