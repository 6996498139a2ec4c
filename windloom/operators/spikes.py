"""Implausible spikes in measurements, judged per source (problem 3).

Each source (rig) repeats a sweep. The angle is the season, the succession of runs the trend.
For a block of consecutive runs of one source the decomposition is

    value = level of the angle in this stretch of runs + offset of the run + remainder

with medians throughout. The level is taken from the runs around, the runs before and the runs
after; each run uses the one that fits it best as a whole, so that a lasting change of settings
is a new level and not a row of spikes. Levels and offsets are fitted again without each other.
The remainders of a block, scaled by their median absolute deviation among the runs and
neighbouring angles, are one sample for the generalised extreme studentised deviate procedure,
whose limits alone decide. Constant rows, impossible values and ratios that contradict lift and
drag are separate checks.

Scale: a source may hold any share of the rows. Its runs are ranked through counts per hour, cut
into blocks of a fixed number of runs, and neighbouring runs are copied into a block as context;
a block has a bounded number of rows whatever the source's size. Points without a run are dealt
out to runs that have each angle once.
"""

from __future__ import annotations

import warnings
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_RUNS = 96
CONTEXT_RUNS = 12
#: Half-width of the stretch of runs that gives a level.
NEAR_RUNS = 10
#: Chance that the sample of a block without outliers has one.
GESD_ALPHA = 0.01
#: Quantile of the sizes of remainders that gives their scatter; the rest may be outliers.
SCALE_QUANTILE = 0.85
#: How often levels and offsets are fitted.
FITS = 2
CONSTANT_ROW = 5
SEASON_STEP = 0.5
#: Sanity range of Cl; Cd must be positive.
LARGEST_LIFT = 10.0
#: Share of the values that a step of rounding must explain.
ROUNDED = 0.95


def gesd_limits(n: int, i: np.ndarray, alpha: float = GESD_ALPHA) -> np.ndarray:
    """Critical values for the ``i``-th outliers among ``n`` values (Student's t by Cornish-Fisher)."""
    p = 1 - alpha / (2 * (n - i + 1))
    df = np.maximum(n - i - 1, 1)
    z = np.array([NormalDist().inv_cdf(float(x)) for x in p])
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    return (n - i) * t / np.sqrt((df + t**2) * (n - i + 1))


def gesd(values: np.ndarray, alpha: float = GESD_ALPHA) -> np.ndarray:
    """Outliers of one sample of remainders around zero, with NaN for missing ones; up to half of it.

    The deviate of a value is its size by the root mean square of itself and all smaller ones. As many
    values are outliers as the last deviate beyond its limit says. Fewer than three values have none.
    """
    out = np.zeros(values.shape, bool)
    there = np.flatnonzero(np.isfinite(values))
    n = len(there)
    if n < 3:  # no degree of freedom is left
        return out
    order = there[np.argsort(-np.abs(values.ravel()[there]), kind="stable")]
    size = np.abs(values.ravel()[order])
    i = np.arange(1, n // 2 + 1)
    spread = np.sqrt(np.cumsum((size**2)[::-1])[::-1][: len(i)] / (n - i))
    deviate = size[: len(i)] / np.maximum(spread, 1e-300)
    worth = np.flatnonzero(deviate > gesd_limits(n, i[-1:], alpha)[0])  # limits fall with i
    beyond = worth[deviate[worth] > gesd_limits(n, i[worth], alpha)] if len(worth) else worth
    if len(beyond):
        out.ravel()[order[: beyond[-1] + 1]] = True
    return out


def median(x: np.ndarray, axis: int) -> np.ndarray:
    """Median without the NaNs, NaN where there is nothing else; faster on small arrays than numpy's."""
    x = np.sort(x, axis=axis)  # NaN last
    n = np.isfinite(x).sum(axis=axis, keepdims=True)
    low = np.take_along_axis(x, np.maximum(n - 1, 0) // 2, axis)
    high = np.take_along_axis(x, np.minimum(n // 2, x.shape[axis] - 1), axis)
    return (0.5 * (low + high)).squeeze(axis)


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """Medians over the runs around, before and after, for each run and angle."""
    runs = len(x)
    width = min(runs, 2 * NEAR_RUNS + 1)
    start = np.clip(np.arange(runs) - NEAR_RUNS, 0, runs - width)  # keeps its width at the ends
    padded = np.pad(x, ((NEAR_RUNS, NEAR_RUNS), (0, 0)), constant_values=np.nan)
    near = np.arange(NEAR_RUNS)
    at = np.arange(runs)[:, None]
    return [median(x[start[:, None] + np.arange(width)], 1), median(padded[at + near], 1), median(padded[at + near + NEAR_RUNS + 1], 1)]


def _scale(r: np.ndarray, floor: float) -> np.ndarray:
    """Scatter of the remainders per angle, over it and its neighbours, not below the rounding.

    Of the angle alone it is the median absolute deviation; with the neighbours it is taken at the
    quantile ``SCALE_QUANTILE`` of the sizes, which is steadier where runs are few.
    """
    size = np.abs(r)
    own = 1.4826 * median(size, 0)
    padded = np.pad(size, ((0, 0), (2, 2)), constant_values=np.nan)
    near = np.lib.stride_tricks.sliding_window_view(padded, 5, axis=1)  # runs, angles, 5
    near = np.sort(near.transpose(1, 0, 2).reshape(r.shape[1], -1), axis=1)
    n = np.isfinite(near).sum(axis=1, keepdims=True)
    at = np.maximum(np.ceil(SCALE_QUANTILE * n).astype(int) - 1, 0)
    wide = np.take_along_axis(near, at, 1)[:, 0] / NormalDist().inv_cdf((1 + SCALE_QUANTILE) / 2)
    return np.maximum(np.maximum(np.nan_to_num(own), np.nan_to_num(wide)), floor)


def rounding(values: np.ndarray) -> float:
    """The coarsest of the steps 5, 2 and 1 times a power of ten that the values are multiples of; 0 without one."""
    for power in range(0, -9, -1):
        for step in (5.0, 2.0, 1.0):
            parts = values / (step * 10.0**power)
            if len(values) and np.mean(np.abs(parts - np.round(parts)) < 1e-4) >= ROUNDED:
                return step * 10.0**power
    return 0.0


def _fit(x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Remainders after the level that fits each run best, and their scale per angle."""
    best, fit, scale = None, None, None
    for level in _levels(x):
        r = x - level
        if scale is None:
            scale = _scale(r, floor)
        miss = median(np.abs(r) / scale, 1)
        miss = np.where(np.isfinite(miss), miss, np.inf)
        if best is None:
            best, fit = r, miss
        else:
            take = miss < 0.7 * fit
            best, fit = np.where(take[:, None], r, best), np.where(take, miss, fit)
    return best, _scale(best, floor)


def remainders(x: np.ndarray) -> np.ndarray:
    """Robust standardised remainders of a runs by angles matrix."""
    valid = np.isfinite(x)
    typical = np.median(np.abs(x[valid])) if valid.any() else 0.0
    floor = max(0.5 * rounding(x[valid]), 1e-3 * typical, 1e-12)
    offset = np.zeros((len(x), 1))
    for _ in range(FITS):
        best, scale = _fit(x - offset, floor)
        z = best / scale
        more = np.nan_to_num(median(z, 1))[:, None]
        offset = offset + more * scale
    z = z - more
    # A run that no level fits (a lone run of other settings) is judged against its own smooth course.
    for r in np.flatnonzero(median(np.abs(z), 1) > 2):
        padded = np.pad(z[r], 4, constant_values=np.nan)
        z[r] -= np.nan_to_num(median(np.lib.stride_tricks.sliding_window_view(padded, 9), 1))
        z[r] /= max(1.0, 1.4826 * float(median(np.abs(z[r]), 0)))
    return z


def _constant(run: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Points that repeat the point before within a row of five or more equal values of one run."""
    n = len(v)
    if not n:
        return np.zeros(0, bool)
    new = np.ones(n, bool)
    new[1:] = (run[1:] != run[:-1]) | (v[1:] != v[:-1]) | ~np.isfinite(v[1:])
    row = np.cumsum(new) - 1
    return ~new & (np.bincount(row)[row] >= CONSTANT_ROW)


def impossible(cl: np.ndarray, cd: np.ndarray) -> np.ndarray:
    """Values that can't exist."""
    with np.errstate(invalid="ignore"):
        return (cd <= 0) | (np.abs(cl) > LARGEST_LIFT) | (cd > LARGEST_LIFT)


def contradictory(cl: np.ndarray, cd: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Ratios that contradict the other two beyond their usual rounding."""
    with np.errstate(all="ignore"):
        expected = cl / cd
        miss = np.abs(ratio - expected)
        usual = np.nanmedian(miss) if np.isfinite(miss).any() else 0.0
        return miss > 0.006 + 6 * usual + 0.003 * np.abs(expected)


def flag_block(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Flags of the points of one block; the rows of context are judged in their own block."""
    warnings.simplefilter("ignore", RuntimeWarning)  # medians of angles without values
    pdf = pdf.drop_duplicates("point_id").sort_values(["began", "run_id", "AoA", "point_id"], kind="stable")
    angle = np.round(pdf["AoA"].to_numpy(float) / SEASON_STEP)
    known = np.isfinite(angle)
    season = np.unique(np.where(known, angle, 0), return_inverse=True)[1]
    run = pd.factorize(pdf["run_id"])[0]
    # an angle that a run has several times gets rows of its own beside the run's
    again = pd.Series(run).groupby([run, season]).cumcount().to_numpy()
    row = np.unique(run.astype(np.int64) * (again.max(initial=0) + 1) + again, return_inverse=True)[1]
    values = {c: pdf[c].to_numpy(float) for c in ("Cl", "Cd", "ClCd")}
    out = {"spike": np.zeros(len(pdf), bool), "constant": np.zeros(len(pdf), bool), "impossible": impossible(values["Cl"], values["Cd"]), "contradictory": contradictory(*values.values())}
    for name, v in values.items():
        x = np.full((row.max(initial=-1) + 1, season.max(initial=-1) + 1), np.nan)
        use = known & np.isfinite(v)
        x[row[use], season[use]] = v[use]
        out["spike"] |= use & gesd(remainders(x))[row, season]
        out["constant"] |= _constant(run, v)
    keep = (pdf["block"] == block).to_numpy()
    return pd.DataFrame({"point_id": pdf["point_id"], **out})[keep]


def _blocks(points: DataFrame, source: str) -> DataFrame:
    """``source, run_id, block`` for every run: its own block, and those that need it as context."""
    runs = points.groupBy(source, "run_id").agg(F.min("run_at").alias("at"))
    hour = F.coalesce((F.unix_timestamp("at") / 3600).cast("long"), F.lit(0))
    runs = runs.withColumn("hour", hour)
    before = Window.partitionBy(source).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = runs.groupBy(source, "hour").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = hours.groupBy(source).agg(F.sum("n").alias("runs"))
    within = F.row_number().over(Window.partitionBy(source, "hour").orderBy("at", "run_id"))
    ranked = (
        runs.withColumn("k", within)
        .join(hours.select(F.col(source).alias("_s"), F.col("hour").alias("_h"), "earlier"), F.col(source).eqNullSafe(F.col("_s")) & (F.col("hour") == F.col("_h")))
        .join(totals.select(F.col(source).alias("_t"), "runs"), F.col(source).eqNullSafe(F.col("_t")))
        .withColumn("rank", F.col("earlier") + F.col("k") - 1)
    )
    last = F.greatest(F.floor(F.col("runs") / BLOCK_RUNS) - 1, F.lit(0))  # the last block takes the remainder
    of = lambda rank: F.least(F.greatest(F.floor(rank / BLOCK_RUNS), F.lit(0)), last)
    return ranked.select(
        F.col(source).alias("_source"),
        F.col("run_id").alias("_run"),
        F.col("at").alias("began"),
        of(F.col("rank")).alias("block"),
        F.explode(F.array_distinct(F.array(of(F.col("rank")), of(F.col("rank") - CONTEXT_RUNS), of(F.col("rank") + CONTEXT_RUNS)))).alias("judged_in"),
    )


def _in_runs(points: DataFrame) -> DataFrame:
    """Points without a run dealt out to runs by source and hour that have each angle once; their ids are negative."""
    hour = F.coalesce((F.unix_timestamp("run_at") / 3600).cast("long"), F.lit(0))
    among = Window.partitionBy("source", hour, F.round(F.col("AoA") / SEASON_STEP)).orderBy("point_id")
    lone = points.filter("run_id is null").withColumn("run_id", -2 - F.pmod(F.xxhash64(hour, F.dense_rank().over(among)), F.lit(1 << 62)))
    return points.filter("run_id is not null").unionByName(lone)


def measurement_flags(points: DataFrame, source: str = "rig") -> DataFrame:
    """``point_id, spike, constant, impossible, contradictory`` for every distinct point.

    Null values of a column are neither flagged nor used; points without angle are only checked
    for constant, impossible and contradictory values. A point delivered twice gives one row. Points
    without source form a source of their own; those without run are spread over runs by the hour. An
    angle that a run has several times is tested each time. An empty table gives no rows; other
    columns are not looked at.
    """
    narrow = _in_runs(points.select("point_id", F.col(source).cast("string").alias("source"), F.col("run_id").try_cast("long").alias("run_id"), "AoA", "Cl", "Cd", "ClCd", "run_at"))
    blocks = _blocks(narrow, "source")
    placed = narrow.join(blocks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("run_id") == F.col("_run")))

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return flag_block(pdf, key[1])

    return (
        placed.select("point_id", "source", "run_id", "AoA", "Cl", "Cd", "ClCd", "began", "block", "judged_in")
        .groupBy("source", "judged_in")
        .applyInPandas(judge, "point_id long, spike boolean, constant boolean, impossible boolean, contradictory boolean")
    )


def found_spikes(points: DataFrame) -> DataFrame:
    flags = measurement_flags(points)
    return flags.filter("spike or constant or impossible or contradictory").select("point_id").distinct()
