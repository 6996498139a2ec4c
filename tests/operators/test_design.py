import math

import pytest
from pyspark.sql import functions as F

from windloom.functions import extract as X
from windloom.functions import text as T
from windloom.operators import design


def test_five_digit_sections_against_brute_force(spark):
    names = spark.createDataFrame([("naca23012",), ("naca24115",), ("naca23112",), ("naca29012",), ("naca2412",), (None,)], "name string")
    got = design.naca5(names, 21).collect()
    assert {r["name"] for r in got} == {"naca23012"} and len(got) == 21  # reflexed ones and places off the table give none
    for r in got:
        x, p, k1, t = r["x"], 0.15, 15.957, 0.12
        camber = k1 / 6 * (x**3 - 3 * p * x**2 + p**2 * (3 - p) * x) if x < p else k1 * p**3 / 6 * (1 - x)
        half = 5 * t * (0.2969 * math.sqrt(x) - 0.126 * x - 0.3516 * x**2 + 0.2843 * x**3 - 0.1015 * x**4)
        assert (r["camber"], r["thickness"]) == pytest.approx((camber, half), abs=1e-12)


def test_contours_are_closed_scaled_and_without_repeats(spark):
    rows = [("a", k, x, y) for k, (x, y) in enumerate([(2.0, 0.0), (1.0, 0.2), (1.0, 0.2), (0.0, 0.0), (1.0, -0.1)])]
    got = design.prepared(spark.createDataFrame(rows, "name string, seq int, x double, y double")).orderBy("seq").collect()
    assert [v for r in got for v in (r["x"], r["y"])] == pytest.approx([1.0, 0.0, 0.5, 0.1, 0.0, 0.0, 0.5, -0.05, 1.0, 0.0])
    section = design.contour(design.naca4(spark.createDataFrame([("naca2412",)], "name string"), 50))
    assert section.count() == 99 and design.prepared(section).count() == 100  # the blunt trailing edge is closed
    assert design.prepared(section.limit(0)).count() == 0


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_quantities_and_parameters(spark):
    assert one(spark, "mass of 100 lbs", lambda t: X.in_si(t, "mass_kg")) == pytest.approx(45.359, abs=1e-3)
    assert one(spark, "300 nm away", lambda t: X.in_si(t, "mass_kg")) is None
    assert one(spark, "at FL120", lambda t: X.in_si(t, "altitude_m")) == pytest.approx(3657.6)
    assert one(spark, "stall should be near 60 kt", X.stall_speed) == pytest.approx(30.8664)
    assert one(spark, "Re=2e6 then re = 3e6", lambda t: X.flow_parameter(t, "Re")) == 3e6
    assert one(spark, "nothing", lambda t: X.flow_parameter(t, "Ncrit")) == 9.0
    assert one(spark, "use NACA 2412 or naca 2412, e387 and S1223", X.section_names) == ["naca2412", "e387", "s1223"]
    assert one(spark, "AR = 50.0, aspect ratio of 9", lambda t: X.reference_number(t, "aspect_ratio")) == 9.0
    assert one(spark, None, X.section_name) is None and one(spark, "", lambda t: X.in_si(t, "range_km")) is None
    got = one(spark, "payload_kg: 5 range_km: 360 endurance_hr: 2", lambda t: F.struct(*[c.alias(n) for n, c in X.specification(t).items()]))
    assert (got["mass_kg"], got["cruise_speed_ms"], got["altitude_m"]) == (20.0, 50.0, 500.0)


def test_questions_and_tables(spark):
    assert one(spark, "Explain the mechanism of flutter", T.question_type) == "why"
    assert one(spark, "the wing", T.question_type) == "general"
    assert one(spark, "What is camber ", T.definition_term) == "camber" and one(spark, "camber", T.definition_term) is None
    assert one(spark, 'Find "Lift Drag" of the wing, \'a b\' How', T.keywords) == ["find", "Lift Drag", "wing,", "a b", "how"]
    md = "intro\n| a | b |\n|---|---|\n| 1<br>x | 2 |\n|  |  |\nend\n| stray |"
    assert one(spark, md, T.markdown_tables) == ["| a | b |\n|---|---|\n| 1 x | 2 |\n|  |  |"]  # a row of blanks reads as a rule
    assert one(spark, md, T.without_tables) == "intro\nend"
    assert one(spark, None, T.markdown_tables) is None and one(spark, "", T.markdown_tables) == []
