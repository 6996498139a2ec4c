import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from windloom.functions import web
from windloom.operators import graph, layout
from windloom.sources import files
from windloom.streaming import ingest


def test_scan_by_content(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    got = files.scan_files(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["sha256"], r["n_bytes"]) for r in got] == [("a.PDF", hashlib.sha256(b"one").hexdigest(), 3)]


def test_coordinates_round_trip(spark, tmp_path):
    (tmp_path / "foil.dat").write_text("FOIL X\n 61.0 61.0\n\n 1.000000  0.001260\n 0.5 abc\n 0.000000  0.000000\n 0.5 0.1 0.2\n")
    got = files.read_coordinates(spark, str(tmp_path / "foil.dat")).orderBy("seq")
    assert [(r["name"], r["x"], r["y"]) for r in got.collect()] == [("foil", 1.0, 0.00126), ("foil", 0.0, 0.0)]
    content = files.coordinate_lines(got).first()["content"]
    assert content.splitlines() == ["foil", "  1.000000  0.001260", "  0.000000  0.000000"]


def test_solver_and_csv_polars(spark, tmp_path):
    (tmp_path / "p.txt").write_text("head 1 2 3 4 5 6 7\n ---- ----\n 0.0 0.2 0.01 0.005 -0.05 0.6 0.7\n bad\n 0.5 0.3 0.0 0.005 -0.05 0.6 0.7\n")
    got = files.read_solver_polars(spark, str(tmp_path / "p.txt")).orderBy("AoA").collect()
    assert [(r["AoA"], r["ClCd"]) for r in got] == [(0.0, pytest.approx(20.0)), (0.5, None)]
    (tmp_path / "naca1_xfoil_polar.csv").write_text("AoA,Cl,Cd,CDp,Cm,Xtr_top,Xtr_bot,ClCd\n1,0.5,0.01,0.005,-0.1,0.6,0.7,50\n")
    (tmp_path / "naca1_panel_polar.csv").write_text("AoA,Cl,Cd,Cm,ClCd\n1,0.6,0.01,-0.1,60\n")
    both = files.read_polar_csv(spark, str(tmp_path / "naca1_xfoil_polar.csv"), str(tmp_path / "naca1_panel_polar.csv"))
    assert {(r["name"], r["engine"], r["Cl"], r["CDp"]) for r in both.collect()} == {("naca1", "viscous", 0.5, 0.005), ("naca1", "panel", 0.6, None)}
    assert files.read_polar_csv(spark).count() == 0
    (tmp_path / "cp.txt").write_text("a\nb\nc\n 0.0 0.1 1.0\n 0.5 -0.7\n")
    assert [(r["x_c"], r["Cp"]) for r in files.read_pressures(spark, str(tmp_path / "cp.txt")).collect()] == [(0.0, 1.0), (0.5, -0.7)]


def test_versions_of_a_table(spark, tmp_path):
    one = files.replace_table(spark.range(3), str(tmp_path / "t"))
    two = files.replace_table(spark.range(5), str(tmp_path / "t"))
    assert one != two and spark.read.parquet(two).count() == 5


def test_web(spark):
    rows = [("https://www.Who.int/x", None), ("http://a.org/f.PDF?x=1", ""), ("http://a.org/i.png", "s"), ("http://b.org", "hit"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "url string, snippet string")
    got = df.select(web.host(F.col("url")), web.route(F.col("url"), F.col("snippet"))).collect()
    assert [tuple(r) for r in got] == [("who.int", "html"), ("a.org", "pdf"), ("a.org", "skip"), ("b.org", "snippet"), (None, "skip"), (None, "skip")]
    html = "<html><nav><p>one two three four</p></nav><p class=x>Lift &amp; drag of <b>wings</b></p><li>short</li><script>p p p p</script><td>a b c d e</td></html>"
    assert spark.createDataFrame([(html,)], "h string").select(web.visible_text(F.col("h"))).first()[0] == "Lift & drag of wings a b c d e"
    assert spark.createDataFrame([("a\fb",)], "m string").select(web.form_feed_pages(F.col("m"), F.lit(2)), web.form_feed_pages(F.col("m"), F.lit(3))).first() == (["a", "b"], None)


def test_layout(spark):
    spans = spark.createDataFrame([(1, "b c", 100.0, 10.0, 120.0, 20.0, 0.0), (1, "a", 10.0, 11.0, 30.0, 20.0, 0.0), (1, "rot", 5.0, 50.0, 9.0, 90.0, 1.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double, dir_y double")
    f = layout.page_features(spans, "page").first()
    assert (f["n_spans"], f["n_words"], f["kind"]) == (3, 4, "plain") and f["rotated"] == pytest.approx(1 / 3)
    assert layout.reading_order(spans, "page").first()["text"] == "a b c"
    df = spark.createDataFrame([([(0.0, 1.0, "a"), (4.0, 1.0, "b"), (8.0, 1.0, "c"), (9.5, 1.0, "d")], [1.0, 15.0, 30.0, 45.0, 52.0])], f"s {layout.SPANS}, x array<double>")
    got = df.select(F.transform(layout.rows_of(F.col("s")), lambda r: F.transform(r["spans"], lambda s: s["text"])), layout.boundaries(F.col("x"))).first()
    assert got[0] == [["a", "b"], ["c", "d"]] and got[1] == [1.0, 30.0, 52.0]  # distance to the head, not to the last
    table = spark.createDataFrame([([["h", "k"], ["1", None]],)], "r array<array<string>>").select(layout.markdown(F.col("r"))).first()[0]
    assert table == "| h | k |\n|---|---|\n| 1 |  |"


def test_components_against_union_find(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_stream_appends_new_content_once(spark, tmp_path):
    schema = "page_id long, text string, loaded_at timestamp"
    at = dt.datetime(2024, 1, 1)
    for k, rows in enumerate(([(1, "a", at), (2, "a", at), (3, None, at)], [(4, "a", at), (5, "b", at)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), schema)
    assert sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 5]
