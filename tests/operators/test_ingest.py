import datetime as dt

import pytest
from pyspark.sql import functions as F

from windloom.functions import text as T
from windloom.operators import design, ingest, polars


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "qui | cknes | s", T.clean_ocr_pipes) == "qui cknes s"
    assert one(spark, "it is very very good good", T.collapse_repeats) == "it is very good"
    assert one(spark, "\n  a\x00b­c\n\n\n\nd ", T.clean_pdf_text) == "abc\n\nd"
    got = one(spark, "See Fig. 3 for the lift at 2.5 deg. The drag of the wing, i.e. the loss, is small here.", T.protected_sentences)
    assert got == ["See Fig. 3 for the lift at 2.5 deg.", "The drag of the wing, i.e. the loss, is small here."]
    assert one(spark, 'the "tip vortex" of a wing', T.keywords) == ["tip vortex", "wing"]  # what is quoted, without the quotes
    assert one(spark, "| a | b |\n|---|---|\n| 1 |  |", T.table_faults) == ["too few rows", "too few words"]
    assert one(spark, "wing", T.valid_label) and not one(spark, "the", T.valid_label) and not one(spark, "a|bc d", T.valid_label)
    assert one(spark, None, T.text_faults) is None or one(spark, None, T.text_faults) == []


def test_chunk_fold():
    sentences = [f"s{i} " + "w " * 9 for i in range(20)]
    got = ingest.chunk_fold([s.strip() for s in sentences], 30, 40, 1)
    assert all(len(c.split()) <= 40 for c in got)
    assert got[1].startswith("s2 ") and got[0].split()[-10] == "s2"
    assert {w for c in got for w in c.split() if w[0] == "s"} == {f"s{i}" for i in range(20)}
    assert ingest.chunk_fold([], 30, 40, 1) == [] and ingest.chunk_fold(["a b"], 30, 40, 1) == []


def test_chunks_hold_every_word(spark):
    long = " ".join(f"w{i}" for i in range(1282))
    mixed = " ".join(["A " + " ".join(f"a{i}" for i in range(199)) + ".", "B " + " ".join(f"b{i}" for i in range(89)) + ".", "C " + " ".join(f"c{i}" for i in range(399)) + "."])
    docs = spark.createDataFrame([(1, long), (2, mixed)], "doc_id long, text string")
    assert [len(s.split()) for s in one(spark, long, T.protected_sentences)] == [420, 420, 420, 22]
    for target, most, overlap in ((300, 420, 2), (1200, 1500, 1), (50, 60, 2)):
        got = ingest.chunks(docs, "doc_id", "text", target, most, overlap).collect()
        assert all(r["n_words"] == len(r["text"].split()) <= most for r in got)
        for i, text in ((1, long), (2, mixed)):
            assert {w for r in got if r["doc_id"] == i for w in r["text"].split()} == set(text.split())
    assert ingest.chunk_fold(["a b c d e f g"], 3, 5, 1) == ["a b c d e", "f g"]


def test_registry_and_purge(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a.pdf", "h1", 3, at), ("a.pdf", "h2", None, at + dt.timedelta(days=1)), ("b.pdf", None, 1, at)]
    registry = spark.createDataFrame(rows, "filename string, sha256 string, n_pages int, registered_at timestamp")
    assert {tuple(r)[:3] for r in ingest.registry_upsert(registry).collect()} == {("a.pdf", "h2", None), ("b.pdf", None, 1)}
    files = spark.createDataFrame([("c.pdf", "h1"), ("d.pdf", "h9")], "name string, sha256 string")
    assert [r["name"] for r in ingest.not_registered(files, registry).collect()] == ["d.pdf"]
    chunks = spark.createDataFrame([("a.pdf", 1), ("b.pdf", 2)], "source string, n int")
    gone = ingest.purge(chunks, registry.filter("sha256 is null").withColumnRenamed("filename", "source"))
    assert [r["source"] for r in gone.collect()] == ["a.pdf"]


def test_polar_summary_ties_and_nulls(spark):
    rows = [("r", 1, 0.0, 0.5, 0.01), ("r", 1, 1.0, 0.5, 0.01), ("r", 1, 2.0, 0.4, -1.0), ("r", 1, 3.0, None, 0.02), ("r", 1, 4.0, float("nan"), 0.02)]
    got = polars.summary(spark.createDataFrame(rows, "rig string, run_id long, AoA double, Cl double, Cd double"), "rig", "run_id").first()
    assert (got["cl_max"], got["aoa_cl_max"], got["cd_min"], got["ratio_max"], got["aoa_ratio_max"]) == (0.5, 0.0, 0.01, 50.0, 0.0)


def test_physics_fixtures(spark):
    h = spark.createDataFrame([(0.0,), (500.0,), (1500.0,), (3000.0,), (11000.0,)], "h double")
    assert [r[0] for r in h.select(F.round(design.density(F.col("h")), 6)).collect()] == pytest.approx([1.224978, 1.167245, 1.05804, 0.909092, 0.363888])
    specs = spark.createDataFrame([(1, 25.0, 120 / 3.6, 500.0), (2, 350.0, 160 / 3.6, 3000.0)], "doc_id long, mass_kg double, speed_ms double, altitude_m double")
    got = design.presize(specs).orderBy("doc_id").collect()
    assert (got[0]["area_m2"], got[0]["mach"]) == pytest.approx((0.63033, 0.098039), abs=1e-5)
    assert got[0]["chord_m"] == pytest.approx(0.346295, abs=1e-5) and got[0]["reynolds"] == pytest.approx(790627.6, abs=1)
    assert got[1]["chord_m"] == pytest.approx(1.101155, abs=1e-5)
    foil = design.naca4(spark.createDataFrame([("naca2412",), ("naca0012",), ("e387",)], "name string"), 11)
    row = foil.filter("name = 'naca2412' and seq = 3").first()
    assert (row["camber"], row["thickness"], row["x_upper"], row["y_lower"]) == pytest.approx((0.01875, 0.06001727, 0.29850004, -0.04124852), abs=1e-7)
    assert foil.filter("name = 'naca0012' and camber <> 0").count() == 0 and foil.count() == 22


def test_specification_units(spark):
    texts = ["mass 25.5 kg, cruise 120 km/h, range 300 nm, endurance 2.5 h, ceiling 1000 ft.", "mass 10 lb, cruise 60 kt", "mass unknown, cruise 5 km/h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in design.specification(docs).collect()}
    assert set(got) == {0, 1}
    assert (got[0]["range_km"], got[0]["endurance_h"], got[0]["altitude_m"]) == pytest.approx((555.6, 2.5, 304.8))
    assert got[1]["mass_kg"] == pytest.approx(10 / 2.20462) and got[1]["range_km"] is None
