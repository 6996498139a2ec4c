from pyspark.sql import functions as F

from windloom.operators import layout

SPANS = "page long, y0 double, x0 double, text string, x1 double, y1 double, dir_y double, s int, rows int, starts int"


def spans(spark, rows):
    return spark.createDataFrame([(p, y, x, t, x + 30, y + 8, 0.0, 1, 2, 3) for p, y, x, t in rows], SPANS)


def test_table_is_rebuilt_from_its_spans(spark):
    rows = [(1, 0.0, 0.0, "a"), (1, 2.0, 90.0, "b"), (1, 14.0, 1.0, "c"), (1, 16.5, 95.0, "d"), (1, 14.0, 100.0, "e"), (1, 30.0, 90.0, "f"), (2, 5.0, 5.0, "alone"), (2, 5.0, 5.0, "alone")]
    got = {r["page"]: r for r in layout.rebuilt(spans(spark, rows), "page").collect()}
    assert got[1]["markdown"] == "| a | b |\n|---|---|\n| c | d e |\n|  | f |" and got[1]["n_columns"] == 2
    assert got[2]["markdown"] == "| alone alone |\n|---|" and got[2]["n_rows"] == 1
    assert layout.rebuilt(spans(spark, rows).limit(0), "page").count() == 0


def test_rows_compare_with_their_head(spark):
    chain = [(1, 4.0 * k, 10.0, str(k)) for k in range(5)]  # each near the one before, not the head
    assert layout.rebuilt(spans(spark, chain), "page").first()["n_rows"] == 3


def test_structural_columns(spark):
    rows = [(1, 20.0 * y, 90.0 * x, "c") for y in range(10) for x in range(3) if x < 1 or (x == 1 and y < 3) or (x == 2 and y < 2)]
    got = layout.structural_columns(spans(spark, rows), "page").first()
    assert (got["n_structural"], got["several_share"]) == (2, 0.3)


def test_first_strategy_that_gives_a_table(spark):
    found = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (2, 1)], "page long, strategy int")
    got = {r["page"]: (r["strategy"], r["n_tables"]) for r in layout.first_strategy(found, "page").collect()}
    assert got == {1: (0, 2), 2: (1, 1)}


def test_null_boxes_do_not_crash(spark):
    rows = spans(spark, [(1, 0.0, 0.0, "a")]).unionByName(spans(spark, [(1, 0.0, 0.0, "a")]).withColumn("text", F.lit(None).cast("string")))
    assert layout.rebuilt(rows, "page").count() == 1
