"""Area-based height metrics, per cell, per plot or of a whole cloud."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell, finite
from ..plans.scratch import cut

QUANTILES = tuple(range(5, 100, 5))


def metric_names(threshold: float = 2.0) -> list[str]:
    """Names of the height metrics in the order in which they stand."""
    t = f"{threshold:g}"
    return ["n", "zmax", "zmean", "zsd", "zskew", "zkurt", "zentropy", "pzabovezmean", f"pzabove{t}", *[f"zq{q}" for q in QUANTILES], *[f"zpcum{k}" for k in range(1, 10)], "cover", "gap_fraction"]


def retained(points: DataFrame, height: str, least: float | None, drop_noise: bool) -> DataFrame:
    p = points.filter(finite(height))
    if least is not None:
        p = p.filter(F.col(height) >= least)
    if drop_noise and "classification" in points.columns:
        p = p.filter(~F.coalesce(F.col("classification").isin(7, 18), F.lit(False)))
    return p


def metrics(
    points: DataFrame,
    keys: list[str],
    height: str = "z",
    threshold: float = 2.0,
    entropy_bin: float = 1.0,
    cover_break: float = 2.0,
    least: float | None = None,
    drop_noise: bool = True,
) -> DataFrame:
    """All metrics of the points under each value of ``keys`` (none: one row).

    One aggregation gives counts and moments, another counts equal heights,
    which then give the quantiles and, with the maximum, the bins.  Of metrics
    that a group has no basis for the value is null.
    """
    p = retained(points, height, least, drop_noise).withColumn("_h", F.col(height).cast("double"))
    h = F.col("_h")
    by = keys or ["_all"]
    if not keys:
        p = p.withColumn("_all", F.lit(0))
    first = F.col("return_number") == 1 if "return_number" in points.columns else F.lit(True)
    has = [c for c in ("intensity", "return_number", "classification") if c in points.columns]
    p = p.select(*by, "_h", *has, first.alias("_first"))
    aggs: list[Column] = [
        F.count("*").alias("n"),
        F.max(h).alias("zmax"),
        F.avg(h).alias("zmean"),
        F.stddev_samp(h).alias("zsd"),
        F.skewness(h).alias("zskew"),
        (F.kurtosis(h) + 3.0).alias("zkurt"),
        (100.0 * F.sum(F.when(h > threshold, 1.0).otherwise(0.0)) / F.count("*")).alias("_above"),
        F.sum(F.when(F.col("_first"), 1.0)).alias("_firsts"),
        F.sum(F.when(F.col("_first") & (h > cover_break), 1.0).otherwise(0.0)).alias("_covered"),
        F.min(h).alias("_low"),
    ]
    if "intensity" in has:
        i = F.col("intensity").cast("double")
        aggs += [F.sum(i).alias("itot"), F.max(i).alias("imax"), F.avg(i).alias("imean"), F.stddev_samp(i).alias("isd"), F.skewness(i).alias("iskew"), (F.kurtosis(i) + 3.0).alias("ikurt")]
    if "return_number" in has:
        aggs += [(100.0 * F.sum(F.when(F.col("return_number") == k, 1.0).otherwise(0.0)) / F.count("*")).alias(f"p{k}th") for k in range(1, 6)]
    if "classification" in has:
        aggs.append((100.0 * F.sum(F.when(F.col("classification") == 2, 1.0).otherwise(0.0)) / F.count("*")).alias("pground"))
    # equal heights are counted before they meet; quantiles and bins need no more than the counts
    heights = p.groupBy(*by, "_h").agg(F.count("*").alias("_c"))
    quantiles = heights.groupBy(*by).agg(F.percentile(h, F.array(*[F.lit(q / 100.0) for q in QUANTILES]), F.col("_c")).alias("_q"))
    whole = p.groupBy(*by).agg(*aggs).join(quantiles, by)
    # the bins of a group need its mean and maximum
    joined = heights.join(whole.select(*by, F.col("zmax").alias("_max"), F.col("zmean").alias("_mean")), by)
    tenth = F.floor(h / (F.col("_max") / 10.0))
    bins = joined.groupBy(*by, F.floor(h / entropy_bin).alias("_bin"), F.when((F.col("_max") > 0) & (h >= 0) & (h < F.col("_max")), tenth).when(h < 0, F.lit(-1)).alias("_tenth")).agg(
        F.sum("_c").alias("_c"), F.sum(F.when(h > F.col("_mean"), F.col("_c")).otherwise(0)).alias("_over"), F.max("_max").alias("_max")
    )
    top = F.ceil(F.col("_max") / entropy_bin) - 1
    bins = bins.withColumn("_bin", F.least("_bin", F.greatest(top, F.lit(0))))
    per_bin = bins.groupBy(*by, "_bin").agg(F.sum("_c").alias("_c"), F.sum("_over").alias("_over"), F.max("_max").alias("_max"), *[F.sum(F.when(F.col("_tenth") < k, F.col("_c")).otherwise(0)).alias(f"_t{k}") for k in range(1, 10)], F.sum(F.when(F.col("_tenth").isNotNull(), F.col("_c")).otherwise(0)).alias("_t"))
    share = F.col("_c") / F.sum("_c").over(Window.partitionBy(*by))
    spread = per_bin.withColumn("_p", share).groupBy(*by).agg(
        (-F.sum(F.col("_p") * F.log("_p"))).alias("_entropy"), F.sum("_over").alias("_over"), F.sum("_c").alias("_n"), F.sum("_t").alias("_t"), *[F.sum(f"_t{k}").alias(f"_t{k}") for k in range(1, 10)]
    )
    layers = F.ceil(F.col("zmax") / entropy_bin)
    entropy = F.when((F.col("zmax") >= 2 * entropy_bin) & (F.col("_low") >= 0), F.col("_entropy") / F.log(layers.cast("double")))
    out = whole.join(spread, by)
    cover = F.when(F.col("_firsts") > 0, 100.0 * F.col("_covered") / F.col("_firsts"))
    t = f"{threshold:g}"
    cum = [F.when(F.col("zmax") <= 0, 0.0).when(F.col("_t") > 0, 100.0 * F.col(f"_t{k}") / F.col("_t")).otherwise(0.0).alias(f"zpcum{k}") for k in range(1, 10)]
    extra = [c for c in whole.columns if c not in by and not c.startswith("_") and c not in ("n", "zmax", "zmean", "zsd", "zskew", "zkurt")]
    return out.select(
        *keys, "n", "zmax", "zmean", "zsd", "zskew", "zkurt",
        entropy.alias("zentropy"),
        (100.0 * F.col("_over") / F.col("n")).alias("pzabovezmean"),
        F.col("_above").alias(f"pzabove{t}"),
        *[F.col("_q")[i].alias(f"zq{q}") for i, q in enumerate(QUANTILES)],
        *cum,
        cover.alias("cover"),
        (1.0 - cover / 100.0).alias("gap_fraction"),
        *extra,
    )


def grid_metrics(points: DataFrame, size: float = 20.0, origin=(0.0, 0.0), **options) -> DataFrame:
    keyed = points.withColumns({"row": cell("y", size, origin[1]), "col": cell("x", size, origin[0])})
    return metrics(keyed, ["row", "col"], **options)


def plot_points(points: DataFrame, plots: DataFrame, radius: float) -> DataFrame:
    """Points inside circular plots ``id, x, y``; a point in several stands once for each."""
    from .neighbours import radius_join

    return radius_join(plots.select("id", "x", "y"), points, radius, dims=2)


def grid_aggregates(points: DataFrame, size: float, **aggregates: Column) -> DataFrame:
    """A user's own aggregates by cell: ``row, col`` and a column for each."""
    return points.groupBy(cell("y", size).alias("row"), cell("x", size).alias("col")).agg(*[c.alias(n) for n, c in aggregates.items()])


#: Points of a tile that plots are looked up in.
PLOT_TILE = 200_000


def plot_metrics(points: DataFrame, plots: DataFrame, radius: float, **options) -> DataFrame:
    """All metrics of each plot ``id, x, y``; plots at one place share theirs.

    Tasks look up the points of a tile's plots and hand on how many stand at each
    height, so that what moves follows the points and the plots' heights, not the
    points of every plot.
    """
    from .nearby import Strips, met_in_tiles
    from .neighbours import places

    shared = places(plots, ("x", "y"))
    spots = (plots if shared is None else shared[0]).select("id", *[F.col(c).cast("double").alias(c) for c in "xy"])
    reach = radius * (1 + 1e-9)
    boxes = cut(spots.filter(finite("x") & finite("y")).select("id", "x", "y", *[(F.col(c) + d).alias(f"{c}{k}") for c in "xy" for k, d in enumerate((-reach, reach))]))
    height, cover_break = options.get("height", "z"), options.get("cover_break", 2.0)
    has = [c for c in ("intensity", "return_number", "classification") if c in points.columns]
    held = retained(points, height, options.get("least"), options.get("drop_noise", True))
    held = held.select(*[F.col(c).cast("double").alias(c) for c in "xy"], F.col(height).cast("double").alias("_h"), *[F.col(c).cast("double").alias(c) for c in has])
    kind = plots.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            x, y = left["x"].to_numpy("f8"), left["y"].to_numpy("f8")
            strips = Strips(x, y, radius / 12)
            left = left.iloc[strips.order]
            x, y, h = (left[c].to_numpy("f8") for c in ("x", "y", "_h"))
            n = np.zeros(len(h), "i8")
            turn = left["return_number"].to_numpy("f8") if "return_number" in has else np.ones(len(h))
            ground = left["classification"].to_numpy("f8") == 2 if "classification" in has else n
            traits = ((np.where((turn >= 1) & (turn <= 5), np.nan_to_num(turn), 0).astype("i8") * 2 + (turn == 1)) * 2 + (h > cover_break)) * 2 + ground
            values = {"h": h} | ({"i": left["intensity"].to_numpy("f8")} if "intensity" in has else {})
            codes = {k: np.unique(v, return_inverse=True) for k, v in values.items()}
            for i, px, py in zip(right["id"].tolist(), right["x"].tolist(), right["y"].tolist(), strict=True):
                some = strips.box(px - reach, px + reach, py - reach, py + reach, (px, py, reach))
                dx, dy = x[some] - px, y[some] - py
                some = some[dx * dx + dy * dy <= radius * radius]
                if not len(some):
                    continue
                row = [i, np.bincount(traits[some], minlength=48)]
                for names, at in codes.values():
                    held = at[some]
                    if len(names) <= 4 * len(held):
                        counts = np.bincount(held, minlength=len(names))
                        held = np.flatnonzero(counts)
                        counts = counts[held]
                    else:
                        held, counts = np.unique(held, return_counts=True)
                    row += [names[held], counts]
                rows.append(row)
        return pd.DataFrame(rows, columns=["id", "traits", *[f"{c}{k}" for k in kinds for c in ("v", "c")]])

    kinds = ["h", "i"] if "intensity" in has else ["h"]
    parts = met_in_tiles(held, boxes, run, f"id {kind}, traits array<long>, " + ", ".join(f"v{k} array<double>, c{k} array<long>" for k in kinds), PLOT_TILE)
    names = [c for c in metric_names(options.get("threshold", 2.0)) if c != "n"]
    names += ["itot", "imax", "imean", "isd", "iskew", "ikurt"] if "intensity" in has else []
    names += [f"p{k}th" for k in range(1, 6)] if "return_number" in has else []
    names += ["pground"] if "classification" in has else []
    options = {k: options[k] for k in ("threshold", "entropy_bin") if k in options}

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counted = {}
        for k in kinds:
            v, at = np.unique(np.concatenate(pdf[f"v{k}"].tolist()), return_inverse=True)
            counted[k] = v, np.bincount(at, weights=np.concatenate(pdf[f"c{k}"].tolist()))
        traits = np.sum(pdf["traits"].tolist(), axis=0)
        return pd.DataFrame([[pdf["id"].iloc[0], *counted_metrics(counted, traits, has, **options)]], columns=["id", "n", *names])

    found = parts.groupBy("id").applyInPandas(merge, f"id {kind}, n long, " + ", ".join(f"`{c}` double" for c in names))
    if shared is None:
        return found
    return found.withColumnRenamed("id", "place").join(shared[1], "place").select("id", *[f"`{c}`" for c in found.columns[1:]])


def moments(v: np.ndarray, c: np.ndarray) -> list[float]:
    """Mean, deviation, skewness and kurtosis of values that stand ``c`` times each; NaN without a basis."""
    n = c.sum()
    mean = (v * c).sum() / n
    d = v - mean
    m2, m3, m4 = ((c * d**k).sum() for k in (2, 3, 4))
    flat = len(v) < 2 or m2 == 0
    return [mean, (m2 / (n - 1)) ** 0.5 if n > 1 else np.nan, np.nan if flat else n**0.5 * m3 / m2**1.5, np.nan if flat else n * m4 / (m2 * m2)]


def counted_metrics(counted: dict, traits: np.ndarray, has: list[str], threshold: float = 2.0, entropy_bin: float = 1.0) -> list:
    """The values of ``metrics`` of one group, in their order, from the counts of its heights, intensities and traits (return number, first, above the break, ground)."""
    h, c = counted["h"]
    n, top, low = int(c.sum()), h[-1], h[0]
    mean, *rest = moments(h, c)
    bins = np.minimum(np.floor(h / entropy_bin), max(np.ceil(top / entropy_bin) - 1, 0))
    share = np.bincount(np.unique(bins, return_inverse=True)[1], weights=c) / n
    layers = np.ceil(top / entropy_bin)
    entropy = -(share * np.log(share)).sum() / np.log(layers) if top >= 2 * entropy_bin and low >= 0 else np.nan
    upto = np.cumsum(c)
    quantiles = []
    for q in QUANTILES:
        at = (n - 1) * (q / 100.0)
        a, b = h[np.searchsorted(upto, [np.floor(at), np.ceil(at)], "right")]
        quantiles.append(a if a == b else (np.ceil(at) - at) * a + (at - np.floor(at)) * b)
    tenth = np.floor(h / (top / 10.0)) if top > 0 else np.full(len(h), np.nan)
    tenth = np.where(h < 0, -1, np.where((top > 0) & (h < top), tenth, np.nan))
    whole = c[~np.isnan(tenth)].sum()
    cum = [100.0 * c[tenth < k].sum() / whole if top > 0 and whole > 0 else 0.0 for k in range(1, 10)]
    kinds = np.asarray(traits).reshape(6, 2, 2, 2)
    firsts = kinds[:, 1].sum()
    cover = 100.0 * kinds[:, 1, 1].sum() / firsts if firsts else np.nan
    out = [n, top, mean, *rest, entropy, 100.0 * c[h > mean].sum() / n, 100.0 * c[h > threshold].sum() / n, *quantiles, *cum, cover, 1.0 - cover / 100.0]
    if "intensity" in has:
        v, w = counted["i"]
        v, w = v[~np.isnan(v)], w[~np.isnan(v)]
        out += [(v * w).sum(), v[-1], *moments(v, w)] if len(v) else [np.nan] * 6
    if "return_number" in has:
        out += [100.0 * kinds[k].sum() / n for k in range(1, 6)]
    if "classification" in has:
        out.append(100.0 * kinds[..., 1].sum() / n)
    return out


def height_histogram(points: DataFrame, size: float, keys: tuple[str, ...] = (), height: str = "z") -> DataFrame:
    """Counts by height bin; mergeable by sums."""
    return points.filter(finite(height)).groupBy(*keys, cell(height, size).alias("bin")).agg(F.count("*").alias("n"))


def tree_heights(points: DataFrame, percent: float = 98.0, height: str = "z") -> DataFrame:
    """For each tree the height of nearest rank, and the number of its points.

    The rank is found by counting equal heights, so that no task holds a tree's
    points: counts by height are combined before they meet.
    """
    p = points.filter(F.col("tree_id") >= 0)
    counts = p.groupBy("tree_id", F.col(height).alias("h")).agg(F.count("*").alias("c"))
    good = finite("h")
    total = F.sum(F.when(good, F.col("c")).otherwise(0)).over(Window.partitionBy("tree_id"))
    upto = F.sum(F.when(good, F.col("c")).otherwise(0)).over(Window.partitionBy("tree_id").orderBy("h"))
    every = F.sum("c").over(Window.partitionBy("tree_id"))
    ranked = counts.withColumns({"upto": upto, "total": total, "n_points": every})
    rank = F.floor(F.lit(percent / 100.0) * (F.col("total") - 1) + 0.5)
    return ranked.groupBy("tree_id").agg(F.min(F.when(good & (F.col("upto") > rank), F.col("h"))).alias("height"), F.max("n_points").alias("n_points"))


def basal_area(trees: DataFrame, area: float, least: float = 0.0, dbh: str = "dbh") -> DataFrame:
    """Square metres a hectare of the stems with a finite diameter."""
    d = F.col(dbh)
    held = trees.filter(finite(dbh) & (d >= least))
    return held.agg((F.sum(F.lit(3.141592653589793) * (d / 2) * (d / 2)) / area * 1e4).alias("basal_area"), F.count("*").alias("n_stems"))
