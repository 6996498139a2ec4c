"""Layout of pages from the boxes of their spans: page features, reading order, rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROTATED = 0.15
SPANS = "array<struct<y:double,x:double,text:string>>"


def page_features(spans: DataFrame, *keys: str) -> DataFrame:
    """Per page: spans, words, share of rotated spans, columns of 80 units, and kind of page."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    got = spans.groupBy(*keys).agg(
        F.count("*").alias("n_spans"),
        F.sum(words).alias("n_words"),
        F.avg((F.abs("dir_y") > ROTATED).cast("int")).alias("rotated"),
        F.count_distinct(F.floor(F.col("x0") / 80)).alias("n_columns"),
        F.max("x1").alias("width"),
        F.max("y1").alias("height"),
    )
    slide = (F.col("width") > 1.5 * F.col("height")) | ((F.col("width") > 800) & (F.col("n_words") < 200))
    return got.withColumn(
        "kind",
        F.when(F.col("n_words") == 0, "blank").when(F.col("rotated") > 0.7, "rotated").when(slide, "slide").when((F.col("n_columns") >= 3) & (F.col("n_spans") >= 6), "columns").otherwise("plain"),
    )


def reading_order(spans: DataFrame, *keys: str) -> DataFrame:
    """Text of each page, spans by line and position; rotated ones left out."""
    upright = spans.filter(F.abs("dir_y") <= ROTATED).withColumn("line", F.bround(F.col("y0") / 12))
    return upright.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "x0", "text"))), lambda s: s["text"]), " ").alias("text"))


def rows_of(spans: Column, gap: float = 5.0) -> Column:
    """Rows of the spans of one page: a span further than ``gap`` from the head of a row opens a new one.

    ``spans`` is an array of ``y, x, text``; the fold compares with the head of the row, not with the span before.
    """
    empty = F.from_json(F.lit("[]"), f"array<struct<head:double,spans:{SPANS}>>")

    def add(rows: Column, s: Column) -> Column:
        last = F.element_at(rows, -1)
        joins = (F.size(rows) > 0) & (F.abs(s["y"] - last["head"]) <= gap)
        grown = F.struct(last["head"].alias("head"), F.concat(last["spans"], F.array(s)).alias("spans"))
        fresh = F.struct(s["y"].alias("head"), F.array(s).alias("spans"))
        return F.when(joins, F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(grown))).otherwise(F.concat(rows, F.array(fresh)))

    return F.aggregate(F.sort_array(spans), empty, add)


def boundaries(xs: Column, gap: float = 20.0) -> Column:
    """Column boundaries: sorted positions that lie further than ``gap`` from the boundary before."""
    return F.aggregate(
        F.sort_array(xs),
        F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.concat(acc, F.array(x))).otherwise(acc),
    )


def markdown(rows: Column) -> Column:
    """A Markdown table of an array of rows of cells; null without a row."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(rows[0])))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.when(F.size(rows) > 1, body).otherwise(F.array().cast("array<string>"))), "\n"))


def _laid(spans: DataFrame, *keys: str) -> DataFrame:
    """``<keys>, rows, starts``: rows of spans and where columns begin.

    The second aggregate has the partitioning of the first; it keeps the folds from being put into the
    expressions that use them, where they would run again for each element.
    """
    every = spans.groupBy(*keys).agg(F.collect_list(F.struct(F.col("y0").cast("double").alias("y"), F.col("x0").cast("double").alias("x"), "text")).alias("s"))
    folded = every.select(*keys, rows_of(F.col("s")).alias("rows"), boundaries(F.transform("s", lambda x: x["x"])).alias("starts"))
    return folded.groupBy(*keys).agg(F.first("rows").alias("rows"), F.first("starts").alias("starts"))


def rebuilt(spans: DataFrame, *keys: str) -> DataFrame:
    """``<keys>, n_rows, n_columns, markdown``: the table that the spans of each page make.

    Spans are gathered to rows by their distance from the head of a row, columns begin where a span
    starts further than the gap from the column before; spans of one cell are joined by a space. The
    spans of a page are bounded by the page.
    """
    laid = _laid(spans, *keys)

    def cells(row: Column) -> Column:
        at = lambda s: F.size(F.filter("starts", lambda b: b <= s["x"]))
        ordered = F.array_sort(F.transform(row["spans"], lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["text"].alias("text"))))
        return F.transform(F.sequence(F.lit(1), F.size("starts")), lambda k: F.array_join(F.transform(F.filter(ordered, lambda s: at(s) == k), lambda s: s["text"]), " "))

    grid = laid.withColumn("grid", F.transform("rows", cells))
    return grid.select(*keys, F.size("rows").alias("n_rows"), F.size("starts").alias("n_columns"), markdown(F.col("grid")).alias("markdown"))


def structural_columns(spans: DataFrame, *keys: str, least: float = 0.3) -> DataFrame:
    """``<keys>, n_structural, several_share``: columns that at least ``least`` of the rows hit, and the share of rows with several cells."""
    laid = _laid(spans, *keys)
    at = lambda s: F.size(F.filter("starts", lambda b: b <= s["x"]))
    hit = F.transform("rows", lambda r: F.array_distinct(F.transform(r["spans"], at)))
    laid = laid.withColumn("hit", hit)
    columns = F.filter(F.sequence(F.lit(1), F.size("starts")), lambda k: F.size(F.filter("hit", lambda h: F.array_contains(h, k))) >= least * F.size("rows"))
    several = F.size(F.filter("hit", lambda h: F.size(h) > 1)) / F.size("rows")
    return laid.select(*keys, F.size(columns).cast("long").alias("n_structural"), F.round(several, 6).alias("several_share"))


def first_strategy(found: DataFrame, key: str) -> DataFrame:
    """``<key>, strategy, n_tables``: of the strategies in their order the first that gave a table."""
    per = found.groupBy(key, "strategy").agg(F.count("*").alias("n_tables"))
    return per.groupBy(key).agg(F.min(F.struct("strategy", "n_tables")).alias("f")).select(key, "f.strategy", "f.n_tables")
