"""Aggregation of polars: maxima with the angle where they occur, convergence, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SWEEP_POINTS = 51


def distinct_points(points: DataFrame) -> DataFrame:
    """Each point once; of deliveries that differ the last loaded counts."""
    columns = [c for c in points.columns if c != "point_id"]
    last = F.max_by(F.struct(*columns), F.struct("loaded_at", "run_at")).alias("r")
    return points.groupBy("point_id").agg(last).select("point_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def at_most(value: Column, angle: Column, *others: Column) -> Column:
    """Struct of the row with the largest value, at the least angle of equals."""
    return F.max(F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("v"), (-angle).alias("minus_angle"), *others)))


def summary(points: DataFrame, *keys: str) -> DataFrame:
    """Per key: largest lift and its angle, least drag, best ratio with angle, lift and drag there."""
    cl, cd, aoa = F.col("Cl"), F.col("Cd"), F.col("AoA")
    ratio = F.try_divide(cl, F.when(cd > 0, cd))
    got = points.filter(cl.between(-5, 5)).groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        at_most(cl, aoa).alias("lift"),
        F.min(F.when(cd > 0, cd)).alias("cd_min"),
        at_most(ratio, aoa, cl.alias("cl"), cd.alias("cd")).alias("best"),
    )
    return got.select(
        *keys, "n_points", F.col("lift.v").alias("cl_max"), (-F.col("lift.minus_angle")).alias("aoa_cl_max"), "cd_min",
        F.round("best.v", 6).alias("ratio_max"), (-F.col("best.minus_angle")).alias("aoa_ratio_max"), F.col("best.cl").alias("cl_at_best"), F.col("best.cd").alias("cd_at_best"),
    )


def convergence(points: DataFrame) -> DataFrame:
    """``rig, run_id, n_converged, share``: how much of its sweep each run solved."""
    solved = points.filter("Cl is not null and Cd is not null")
    return solved.groupBy("rig", "run_id").agg(F.count_distinct("AoA").alias("n_converged")).withColumn("share", F.round(F.col("n_converged") / SWEEP_POINTS, 6))


def typical_polar(points: DataFrame) -> DataFrame:
    """``rig, AoA`` and the means of lift and drag among plausible values."""
    good = points.filter("Cl between -5 and 5 and Cd > 0 and Cd < 5")
    return good.groupBy("rig", "AoA").agg(F.count("*").alias("n"), F.round(F.avg("Cl"), 10).alias("cl"), F.round(F.avg("Cd"), 10).alias("cd"))


def best_rig(points: DataFrame) -> DataFrame:
    """``month, rig, ratio_max``: the rig with the best lift to drag ratio of each month."""
    ratio = F.try_divide(F.col("Cl"), F.when(F.col("Cd") > 0.004, F.col("Cd")))
    rows = points.filter("Cl between -5 and 5").select(F.trunc("run_at", "month").alias("month"), "rig", F.round(ratio, 6).alias("ratio")).filter("ratio is not null")
    per = rows.groupBy("month", "rig").agg(F.max("ratio").alias("ratio_max"))
    best = per.groupBy("month").agg(F.max("ratio_max").alias("ratio_max"))
    return per.join(best, ["month", "ratio_max"]).groupBy("month", "ratio_max").agg(F.min("rig").alias("rig"))
