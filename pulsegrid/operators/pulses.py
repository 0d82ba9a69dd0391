"""Pulses, echoes, trajectories and what the canopy lets through."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell


def echoes(shots: DataFrame) -> DataFrame:
    """A row for each echo with its rank from 1; misses have none."""
    return shots.select("shot_id", "zenith", "azimuth", F.posexplode("echoes").alias("pos", "e")).select("shot_id", "zenith", "azimuth", (F.col("pos") + 1).alias("echo_rank"), "e.*")


def pulses_from_returns(returns: DataFrame, line: str, time: str = "t", order: tuple[str, ...] = ()) -> DataFrame:
    """Returns with ``pulse_no``: consecutive returns of a line with one time are a pulse."""
    w = Window.partitionBy(line).orderBy(time, *order)
    new = F.when(F.lag(time).over(w) == F.col(time), 0).otherwise(1)
    return returns.withColumn("_new", new).withColumn("pulse_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(rows: DataFrame, key: str, time: str, gap: float, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``session``: a new one begins after more than ``gap`` seconds (scan lines, flight lines)."""
    w = Window.partitionBy(key).orderBy(time, *order)
    new = F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def missing_pulses(rows: DataFrame, key: str, time: str, interval: float, most: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Times of the pulses that are missing in gaps of whole intervals, up to ``most`` in a gap."""
    w = Window.partitionBy(key).orderBy(time, *order)
    gap = rows.withColumn("_next", F.lead(time).over(w)).withColumn("_n", F.round((F.col("_next") - F.col(time)) / interval).cast("long"))
    holes = gap.filter((F.col("_n") > 1) & (F.col("_n") - 1 <= most))
    step = (F.col("_next") - F.col(time)) / F.col("_n")
    return holes.select(key, F.col(time).alias("after"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") - 1)).alias("i"), step.alias("_s"), F.col(time).alias("_t")).select(key, "after", "i", (F.col("_t") + F.col("i") * F.col("_s")).alias("t"))


def interpolate_track(times: DataFrame, track: DataFrame, key: str, max_gap: float, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``times(id, key, t)`` with the track's values at t, linear between its neighbours.

    An as-of join by union and windows: the last fix before and the first after
    are carried to each time.  Null outside the track or where the gap between
    the two fixes is larger than ``max_gap``.
    """
    fix = F.struct("t", *values)
    a = track.select(key, "t", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("id"), fix.alias("_fix"))
    b = times.select(key, "t", F.lit(1).alias("_kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast(a.schema["_fix"].dataType).alias("_fix"))
    both = a.unionByName(b)
    before = F.last("_fix", ignorenulls=True).over(Window.partitionBy(key).orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_fix", ignorenulls=True).over(Window.partitionBy(key).orderBy("t", F.desc("_kind")).rowsBetween(0, Window.unboundedFollowing))
    held = both.withColumns({"_a": before, "_b": after}).filter("_kind = 1")
    span = F.col("_b.t") - F.col("_a.t")
    f = F.when(span > 0, (F.col("t") - F.col("_a.t")) / span).otherwise(0.0)
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (span <= max_gap)
    return held.select("id", key, "t", *[F.when(ok, F.col(f"_a.{v}") + f * (F.col(f"_b.{v}") - F.col(f"_a.{v}"))).alias(v) for v in values])


def gps_week_seconds(t: Column | str) -> Column:
    """Seconds of the GPS week of adjusted standard time."""
    c = F.col(t) if isinstance(t, str) else t
    return F.pmod(c + 1e9, F.lit(604800.0))


def direction(zenith: Column | str, azimuth: Column | str) -> dict[str, Column]:
    """Unit vector of angles in degrees; azimuth from north (y) over east (x)."""
    z, a = F.radians(zenith), F.radians(azimuth)
    return {"dx": F.sin(z) * F.sin(a), "dy": F.sin(z) * F.cos(a), "dz": F.cos(z)}


def is_gap(least: float) -> Column:
    return ~F.exists("echoes", lambda e: e["height"] > least)


def gap_fraction(shots: DataFrame, ring: float = 5.0, most: float = 90.0, least: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of pulses in each zenith ring that meet nothing above ``least``."""
    held = shots.filter((F.col("zenith") >= 0) & (F.col("zenith") < most))
    out = held.groupBy(*keys, cell("zenith", ring).alias("ring")).agg(F.count("*").alias("pulses"), F.sum(F.when(is_gap(least), 1).otherwise(0)).alias("gaps"))
    return out.withColumn("p", F.col("gaps") / F.col("pulses"))


def pai_hinge(gaps: DataFrame, ring: float = 5.0) -> DataFrame:
    """Plant area index from the ring that holds 57.5 degrees."""
    p = F.greatest(F.col("p"), F.lit(1e-5))
    hinge = gaps.filter(F.col("ring") == int(57.5 // ring))
    return hinge.select((-F.log(p) * math.cos(math.radians(57.5)) / 0.5).alias("pai"))


def pai_miller(gaps: DataFrame, ring: float = 5.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Miller's integral over the rings."""
    p = F.greatest(F.col("p"), F.lit(1e-5))
    lo, hi = F.radians(F.col("ring") * ring), F.radians((F.col("ring") + 1) * ring)
    term = -F.log(p) * (F.sin(hi) * F.sin(hi) - F.sin(lo) * F.sin(lo))
    return gaps.groupBy(*keys).agg(F.sum(term).alias("pai"))


def clumping(gaps: DataFrame) -> DataFrame:
    """For each ring ln(mean P) / mean(ln P), weighted by pulses over sectors."""
    p = F.greatest(F.col("p"), F.lit(1e-5))
    n = F.sum("pulses")
    return gaps.groupBy("ring").agg((F.log(F.sum(p * F.col("pulses")) / n) / (F.sum(F.log(p) * F.col("pulses")) / n)).alias("clumping"), n.alias("pulses"))


def gap_histogram(shots: DataFrame, ring: float = 5.0, sectors: int = 8, size: float = 1.0) -> DataFrame:
    """Hit weight by ring, sector and height bin; partial results merge by sums.

    Each echo counts its share of the pulse; bin null holds the pulses fired.
    """
    s = shots.withColumns({"ring": cell("zenith", ring), "sector": F.floor(F.pmod(F.col("azimuth"), F.lit(360.0)) / (360.0 / sectors))})
    hits = s.select("ring", "sector", F.size("echoes").alias("n"), F.explode("echoes").alias("e")).groupBy("ring", "sector", cell("e.height", size).alias("bin")).agg(F.sum(1.0 / F.col("n")).alias("weight"))
    fired = s.groupBy("ring", "sector").agg(F.count("*").cast("double").alias("weight")).select("ring", "sector", F.lit(None).cast("long").alias("bin"), "weight")
    return hits.union(fired)


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("ring", "sector", "bin").agg(F.sum("weight").alias("weight"))


def pad_profile(points: DataFrame, size: float, layer: float, least: float = 1.0, clump: float = 1.0) -> DataFrame:
    """Plant area density by contact frequency: columns of ``size``, layers of ``layer``.

    From above, a column is alive in a layer until its first hit; the share of
    alive columns that a layer hits gives its density.
    """
    p = points.filter(F.col("z") > least).select(cell("x", size).alias("cx"), cell("y", size).alias("cy"), cell("z", layer).alias("layer"))
    tops = p.groupBy("cx", "cy").agg(F.max("layer").alias("layer"))
    hits = tops.groupBy("layer").agg(F.count("*").alias("hits"))
    upper = F.sum("hits").over(Window.orderBy(F.desc("layer")).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("hits").over(Window.orderBy(F.desc("layer")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # a row for each layer that is hit: as many as layers, not points
    t = hits.withColumns({"_u": F.coalesce(upper, F.lit(0)), "_all": total})
    share = F.least(F.col("hits") / (F.col("_all") - F.col("_u")), F.lit(1 - 1e-6))
    return t.select("layer", "hits", (F.col("_all") - F.col("_u")).alias("alive"), (-F.log(1 - share) / (0.5 * layer) * clump).alias("pad"))


def als_profile(points: DataFrame, size: float, layer: float, least: float = 1.0, g: float = 0.5) -> DataFrame:
    """Airborne gap profile by cell: weight of first to last returns by layer, from the top.

    Each return weighs one by its pulse's number of returns; transmittance below
    a layer is the weight below it by the weight that reaches it, floored at half
    a pulse; density and the cumulated plant area index follow.
    """
    n = F.count("*").over(Window.partitionBy("pulse"))
    w = points.select("x", "y", "z", (1.0 / n).alias("w"))
    bin_ = F.when(F.col("z") < least, 0).otherwise(F.floor((F.col("z") - least) / layer) + 1)
    held = w.groupBy(cell("y", size).alias("row"), cell("x", size).alias("col"), bin_.cast("long").alias("layer")).agg(F.sum("w").alias("w"))
    below = Window.partitionBy("row", "col").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "col").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("row", "col")
    t = held.withColumns({"below": F.coalesce(F.sum("w").over(below), F.lit(0.0)), "reach": F.sum("w").over(upto), "all": F.sum("w").over(whole)})
    trans = F.greatest(F.col("below") / F.col("reach"), 0.5 / F.greatest(F.col("reach"), F.lit(1.0)))
    pgap = F.greatest(F.col("below") / F.col("all"), 0.5 / F.greatest(F.col("all"), F.lit(1.0)))
    return t.filter("layer > 0").select("row", "col", "layer", "w", (-F.log(trans) / (g * layer)).alias("pad"), (-F.log(pgap) / g).alias("pai"))
