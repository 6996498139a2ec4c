"""Numeric specifications read from requirement texts, and the physics that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinematic viscosity of air, m2/s, and the speed of sound, m/s, used for pre-sizing.
VISCOSITY, SOUND = 1.46e-5, 340.0
GRAVITY = 9.81


def number_before(text: Column, units: str, after: str = "") -> Column:
    """The first number that stands before one of ``units``; whole units only ("nm" is not "n")."""
    return _cast(F.regexp_extract(F.lower(text), rf"{after}([0-9]+(?:\.[0-9]+)?) ?(?:{units})(?:[^a-z0-9/]|$)", 1))


def _cast(found: Column) -> Column:
    return F.when(found != "", found).otherwise(F.lit(None)).cast("double")


def specification(docs: DataFrame) -> DataFrame:
    """``doc_id`` with mass (kg), speed (m/s), range (km), endurance (h) and altitude (m), where given."""
    t = F.col("text")
    speed = F.coalesce(number_before(t, "km/h", "cruise ") / 3.6, number_before(t, "kt|knots", "cruise ") * 0.51444, number_before(t, "m/s", "cruise "))
    got = docs.select(
        "doc_id",
        F.coalesce(number_before(t, "kg", "mass "), number_before(t, "lb", "mass ") / 2.20462).alias("mass_kg"),
        F.round(speed, 6).alias("speed_ms"),
        F.coalesce(number_before(t, "km", "range "), number_before(t, "nm", "range ") * 1.852, number_before(t, "mi", "range ") * 1.60934).alias("range_km"),
        number_before(t, "h", "endurance ").alias("endurance_h"),
        F.coalesce(number_before(t, "m", "ceiling "), number_before(t, "ft", "ceiling ") * 0.3048).alias("altitude_m"),
    )
    return got.filter("mass_kg is not null and speed_ms is not null")


def density(altitude: Column) -> Column:
    """Density of the standard atmosphere below 11 km, kg/m3."""
    t = 288.15 - 0.0065 * altitude
    return 101325 * F.pow(t / 288.15, F.lit(5.2561)) / (287.058 * t)


def presize(specs: DataFrame, lift: float = 0.6, aspect: float = 10.0, taper: float = 0.45) -> DataFrame:
    """Wing area, chord, Reynolds and Mach number of every specification."""
    q = 0.5 * density(F.coalesce("altitude_m", F.lit(500.0))) * F.col("speed_ms") * F.col("speed_ms")
    area = F.col("mass_kg") * GRAVITY / (q * lift)
    chord = 2 * area / ((1 + taper) * F.sqrt(aspect * area))
    return specs.select(
        "doc_id",
        F.round(density(F.coalesce("altitude_m", F.lit(500.0))), 6).alias("density"),
        F.round(area, 5).alias("area_m2"),
        F.round(chord, 5).alias("chord_m"),
        F.round(F.col("speed_ms") * chord / VISCOSITY, 0).alias("reynolds"),
        F.round(F.col("speed_ms") / SOUND, 6).alias("mach"),
    )


def naca4(airfoils: DataFrame, points: int = 200) -> DataFrame:
    """``name, seq, x, camber, thickness, x_upper, y_upper, x_lower, y_lower`` of 4-digit sections."""
    d = lambda a, n: F.substring("name", a, n).cast("double")
    m, p, t = d(5, 1) / 100, d(6, 1) / 10, d(7, 2) / 100
    rows = airfoils.filter(F.col("name").rlike("^naca[0-9]{4}$")).select("name", m.alias("m"), p.alias("p"), t.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("seq"))
    x = F.col("seq") / (points - 1)
    ahead = F.col("m") / (F.col("p") * F.col("p")) * (2 * F.col("p") * x - x * x)
    behind = F.col("m") / ((1 - F.col("p")) * (1 - F.col("p"))) * (1 - 2 * F.col("p") + 2 * F.col("p") * x - x * x)
    slope_ahead = 2 * F.col("m") / (F.col("p") * F.col("p")) * (F.col("p") - x)
    slope_behind = 2 * F.col("m") / ((1 - F.col("p")) * (1 - F.col("p"))) * (F.col("p") - x)
    flat = (F.col("m") == 0) | (F.col("p") == 0)
    camber = F.when(flat, 0.0).when(x < F.col("p"), ahead).otherwise(behind)
    angle = F.atan(F.when(flat, 0.0).when(x < F.col("p"), slope_ahead).otherwise(slope_behind))
    rows = rows.select("name", "seq", x.alias("x"), camber.alias("camber"), _half(F.col("t"), x).alias("thickness"), angle.alias("_a"))
    return _surfaces(rows)


def _half(t: Column, x: Column) -> Column:
    """Half the thickness at ``x`` of a section of thickness ``t``."""
    return 5 * t * (0.2969 * F.sqrt(x) - 0.126 * x - 0.3516 * F.pow(x, 2) + 0.2843 * F.pow(x, 3) - 0.1015 * F.pow(x, 4))


def _surfaces(rows: DataFrame) -> DataFrame:
    y, c, s = F.col("thickness"), F.cos("_a"), F.sin("_a")
    return rows.select(
        "name", "seq", "x", "camber", "thickness", (F.col("x") - y * s).alias("x_upper"), (F.col("camber") + y * c).alias("y_upper"), (F.col("x") + y * s).alias("x_lower"), (F.col("camber") - y * c).alias("y_lower")
    )


#: Constant of the 5-digit mean lines by the place of their largest camber.
MEAN_LINES = {0.05: 361.4, 0.10: 51.64, 0.15: 15.957, 0.20: 6.643, 0.25: 3.230}


def naca5(airfoils: DataFrame, points: int = 200) -> DataFrame:
    """The columns of :func:`naca4` for 5-digit sections; reflexed ones and places off the table give no row."""
    d = lambda a, n: F.substring("name", a, n).cast("double")
    p = d(6, 1) / 20
    places = sorted(MEAN_LINES)
    k1 = None
    for a, b in zip(places, places[1:]):  # linear between the places of the table
        value = MEAN_LINES[a] + (p - a) / (b - a) * (MEAN_LINES[b] - MEAN_LINES[a])
        k1 = F.when(p.between(a, b), value) if k1 is None else k1.when(p.between(a, b), value)
    rows = airfoils.filter(F.col("name").rlike("^naca[0-9]{2}[02-9][0-9]{2}$")).select("name", p.alias("p"), k1.alias("k1"), (d(8, 2) / 100).alias("t")).filter("k1 is not null")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("seq"))
    x, p, k1 = F.col("seq") / (points - 1), F.col("p"), F.col("k1")
    camber = F.when(x < p, k1 / 6 * (F.pow(x, 3) - 3 * p * x * x + p * p * (3 - p) * x)).otherwise(k1 * F.pow(p, 3) / 6 * (1 - x))
    slope = F.when(x < p, k1 / 6 * (3 * x * x - 6 * p * x + p * p * (3 - p))).otherwise(-k1 * F.pow(p, 3) / 6)
    return _surfaces(rows.select("name", "seq", x.alias("x"), camber.alias("camber"), _half(F.col("t"), x).alias("thickness"), F.atan(slope).alias("_a")))


def contour(sections: DataFrame) -> DataFrame:
    """``name, seq, x, y``: from the trailing edge over the upper surface to the nose, and back below."""
    upper = sections.select("name", (-F.col("seq")).alias("seq"), F.col("x_upper").alias("x"), F.col("y_upper").alias("y"))
    lower = sections.filter("seq > 0").select("name", "seq", F.col("x_lower").alias("x"), F.col("y_lower").alias("y"))
    return upper.unionByName(lower)


def prepared(points: DataFrame, same: float = 1e-10, closed: float = 1e-6) -> DataFrame:
    """``name, seq, x, y``: a contour without points on the one before, closed, and scaled to its chord.

    A section has a bounded number of points, so its window is small.
    """
    order = Window.partitionBy("name").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    kept = points.withColumn("_step", step).filter("_step is null or _step > %r" % same).drop("_step")
    ends = kept.groupBy("name").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), (F.max("seq") + 1).alias("seq"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    gap = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    whole = kept.unionByName(ends.filter(gap > closed).select("name", "seq", F.col("a.x").alias("x"), F.col("a.y").alias("y")))
    chord = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return whole.join(ends.select("name", "lo", chord.alias("chord")), "name").select("name", "seq", ((F.col("x") - F.col("lo")) / F.col("chord")).alias("x"), (F.col("y") / F.col("chord")).alias("y"))
