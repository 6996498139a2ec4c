"""Queries over polars, specifications and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators import design, polars
from windloom.operators.spikes import found_spikes, measurement_flags
from windloom.session import table
from windloom.streaming import progress


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "naca6535_xfoil_polar")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return found_spikes(_points(spark, sf))


def p3_flags_by_rig(spark: SparkSession, sf: str) -> DataFrame:
    """How many points of each rig carry which flag."""
    points = _points(spark, sf)
    flags = measurement_flags(points)
    rigs = points.groupBy("point_id").agg(F.min("rig").alias("rig"))
    count = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return flags.join(rigs, "point_id").groupBy("rig").agg(F.count("*").alias("n_points"), *[count(c) for c in ("spike", "constant", "impossible", "contradictory")])


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Points within constant rows and impossible values, the checks that need no statistics."""
    return measurement_flags(_points(spark, sf)).filter("constant or impossible").select("point_id", "constant", "impossible")


def polar_points_once(spark: SparkSession, sf: str) -> DataFrame:
    return polars.distinct_points(_points(spark, sf)).select("point_id", "run_id", "rig", "AoA", "Cl", "Cd", "ClCd", "loaded_at")


def polar_summary(spark: SparkSession, sf: str) -> DataFrame:
    return polars.summary(_points(spark, sf), "rig", "run_id")


def polar_summary_by_rig(spark: SparkSession, sf: str) -> DataFrame:
    return polars.summary(polars.typical_polar(_points(spark, sf)).withColumnsRenamed({"cl": "Cl", "cd": "Cd"}), "rig")


def polar_convergence(spark: SparkSession, sf: str) -> DataFrame:
    return polars.convergence(_points(spark, sf))


def typical_polar(spark: SparkSession, sf: str) -> DataFrame:
    return polars.typical_polar(_points(spark, sf))


def best_rig(spark: SparkSession, sf: str) -> DataFrame:
    return polars.best_rig(_points(spark, sf))


def spec_extract(spark: SparkSession, sf: str) -> DataFrame:
    return design.specification(table(spark, sf, "documents"))


def spec_presize(spark: SparkSession, sf: str) -> DataFrame:
    return design.presize(design.specification(table(spark, sf, "documents")))


def stage_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The largest value seen so far by each user, event after event."""
    return progress.largest_so_far(table(spark, sf, "events"))


def stage_shown(spark: SparkSession, sf: str) -> DataFrame:
    """The progress shown to each user: the share of the largest value there is, 0.97 at most until they purchase."""
    events = table(spark, sf, "events")
    most = events.agg(F.max("value").alias("_most"))  # one row
    done = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("_done"))
    rows = progress.largest_so_far(events).join(events.select("event_id", "ts"), "event_id").join(F.broadcast(most), F.lit(True)).join(done, "user_id", "left")
    share = F.round(F.col("progress") / F.col("_most"), 6)
    return rows.select("event_id", F.when(F.col("ts") >= F.col("_done"), 1.0).otherwise(F.least(share, F.lit(0.97))).alias("shown"))


def console_ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """The last 700 events, a top-k over all of them."""
    return table(spark, sf, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(700).select("event_id", "event_type")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    got = progress.windows(table(spark, sf, "events"), "1 hour")
    return got.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows from a stream over the file, with a watermark."""
    return progress.run_windows_stream(spark, f"{sf}/events.parquet", "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return progress.sessions(table(spark, sf, "events"), 1800)


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the JSON property by event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_flags_by_rig, p3_checks, polar_points_once, polar_summary, polar_summary_by_rig, polar_convergence, typical_polar, best_rig, spec_extract, spec_presize,
        stage_progress, stage_shown, console_ring_buffer, event_windows, event_windows_stream, event_sessions, event_props,
    )
}

_SUMMARY = """
    SELECT {keys}, count(*) AS n_points, max(Cl) AS cl_max, arg_max(AoA, [Cl, -AoA]) FILTER (Cl IS NOT NULL) AS aoa_cl_max, min(Cd) FILTER (Cd > 0) AS cd_min,
        round(max(r), 6) AS ratio_max, arg_max(AoA, [r, -AoA]) FILTER (r IS NOT NULL) AS aoa_ratio_max,
        arg_max(Cl, [r, -AoA, Cl]) FILTER (r IS NOT NULL) AS cl_at_best, arg_max(Cd, [r, -AoA, Cl, Cd]) FILTER (r IS NOT NULL) AS cd_at_best
    FROM (SELECT *, CASE WHEN Cd > 0 THEN Cl / Cd END AS r FROM {source} WHERE Cl BETWEEN -5 AND 5) GROUP BY {keys}
"""
_TYPICAL = "SELECT rig, AoA, count(*) AS n, round(avg(Cl), 10) AS cl, round(avg(Cd), 10) AS cd FROM naca6535_xfoil_polar WHERE Cl BETWEEN -5 AND 5 AND Cd > 0 AND Cd < 5 GROUP BY rig, AoA"
_NUM = "try_cast(nullif(regexp_extract(lower(text), '{0}([0-9]+(?:\\.[0-9]+)?) ?(?:{1})(?:[^a-z0-9/]|$)', 1), '') AS DOUBLE)"
_SPEC = f"""
    SELECT * FROM (SELECT doc_id,
        coalesce({_NUM.format('mass ', 'kg')}, {_NUM.format('mass ', 'lb')} / 2.20462) AS mass_kg,
        round(coalesce({_NUM.format('cruise ', 'km/h')} / 3.6, {_NUM.format('cruise ', 'kt|knots')} * 0.51444, {_NUM.format('cruise ', 'm/s')}), 6) AS speed_ms,
        coalesce({_NUM.format('range ', 'km')}, {_NUM.format('range ', 'nm')} * 1.852, {_NUM.format('range ', 'mi')} * 1.60934) AS range_km,
        {_NUM.format('endurance ', 'h')} AS endurance_h,
        coalesce({_NUM.format('ceiling ', 'm')}, {_NUM.format('ceiling ', 'ft')} * 0.3048) AS altitude_m
    FROM documents) WHERE mass_kg IS NOT NULL AND speed_ms IS NOT NULL
"""
_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

_NEW = ", ".join(f"CASE WHEN {c} IS NOT NULL AND {c} IS NOT DISTINCT FROM lag({c}) OVER w THEN 0 ELSE 1 END AS new_{c}" for c in ("Cl", "Cd", "ClCd"))
_RUN_ROWS = ", ".join(f"sum(new_{c}) OVER w AS row_{c}" for c in ("Cl", "Cd", "ClCd"))
_LONG = " OR ".join(f"(count(*) OVER (PARTITION BY rig, run_id, row_{c}) >= 5 AND row_number() OVER (PARTITION BY rig, run_id, row_{c} ORDER BY AoA, point_id) > 1)" for c in ("Cl", "Cd", "ClCd"))

ORACLE = {
    "p3_checks": f"""
        WITH p AS (SELECT DISTINCT point_id, rig, run_id, AoA, Cl, Cd, ClCd FROM naca6535_xfoil_polar),
        n AS (SELECT *, {_NEW} FROM p WINDOW w AS (PARTITION BY rig, run_id ORDER BY AoA, point_id)),
        r AS (SELECT *, {_RUN_ROWS} FROM n WINDOW w AS (PARTITION BY rig, run_id ORDER BY AoA, point_id)),
        f AS (SELECT point_id, {_LONG} AS constant, coalesce(Cd <= 0 OR abs(Cl) > 10 OR Cd > 10, false) AS impossible FROM r)
        SELECT * FROM f WHERE constant OR impossible
    """,
    "polar_points_once": """
        SELECT point_id, run_id, rig, AoA, Cl, Cd, ClCd, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC, run_at DESC) AS k FROM naca6535_xfoil_polar) WHERE k = 1
    """,
    "polar_summary": _SUMMARY.format(keys="rig, run_id", source="naca6535_xfoil_polar"),
    "polar_summary_by_rig": _SUMMARY.format(keys="rig", source=f"({_TYPICAL})"),
    "polar_convergence": """
        SELECT rig, run_id, count(DISTINCT AoA) AS n_converged, round(count(DISTINCT AoA) / 51, 6) AS share FROM naca6535_xfoil_polar WHERE Cl IS NOT NULL AND Cd IS NOT NULL GROUP BY rig, run_id
    """,
    "typical_polar": _TYPICAL,
    "best_rig": """
        WITH r AS (SELECT date_trunc('month', run_at)::DATE AS month, rig, max(round(Cl / Cd, 6)) AS ratio_max FROM naca6535_xfoil_polar WHERE Cl BETWEEN -5 AND 5 AND Cd > 0.004 GROUP BY ALL)
        SELECT month, ratio_max, min(rig) AS rig FROM r WHERE ratio_max = (SELECT max(ratio_max) FROM r x WHERE x.month = r.month) GROUP BY month, ratio_max
    """,
    "spec_extract": _SPEC,
    "spec_presize": f"""
        WITH s AS ({_SPEC}), d AS (SELECT *, 288.15 - 0.0065 * coalesce(altitude_m, 500.0) AS t FROM s),
        r AS (SELECT *, 101325 * pow(t / 288.15, 5.2561) / (287.058 * t) AS rho FROM d),
        a AS (SELECT *, mass_kg * 9.81 / (0.5 * rho * speed_ms * speed_ms * 0.6) AS area FROM r),
        c AS (SELECT *, 2 * area / (1.45 * sqrt(10 * area)) AS chord FROM a)
        SELECT doc_id, round(rho, 6) AS density, round(area, 5) AS area_m2, round(chord, 5) AS chord_m, round(speed_ms * chord / 1.46e-5, 0) AS reynolds, round(speed_ms / 340.0, 6) AS mach FROM c
    """,
    "stage_progress": "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events",
    "stage_shown": """
        WITH p AS (SELECT event_id, ts, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM events),
        d AS (SELECT user_id, min(ts) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT event_id, CASE WHEN ts >= done THEN 1.0 ELSE least(round(p / (SELECT max(value) FROM events), 6), 0.97) END AS shown FROM p LEFT JOIN d USING (user_id)
    """,
    "console_ring_buffer": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 700",
    "event_windows": _WINDOWS,
    "event_windows_stream": _WINDOWS,
    "event_sessions": """
        WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 1800 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session
    """,
    "event_props": "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type",
}
