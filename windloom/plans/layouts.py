"""Queries over boxes, web pages and files that are derived from the given tables, with their SQL.

The cells of every Markdown table become spans on a page, every text a web page, every polar a file;
what the operators find again must be what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import text as T
from windloom.functions import web
from windloom.operators import layout
from windloom.plans.documents import table
from windloom.session import checkpointed, shared_folder, stream_source
from windloom.sources import files
from windloom.streaming.ingest import ingest_stream

COLUMN, ROW = 90.0, 14.0


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, item, row, column, cell`` of the tables' rows, each table once; null entries have none."""
    entries = table(spark, sf, "pages_out").select("page_id", F.posexplode("tables").alias("k", "t")).distinct()
    lines = F.filter(T.markdown_lines(F.col("t")), lambda x: ~T.is_rule(x))
    rows = entries.select("page_id", (F.col("k") + 1).alias("item"), F.posexplode(lines).alias("row", "line"))
    return rows.select("page_id", "item", "row", F.posexplode(T.markdown_cells(F.col("line"))).alias("column", "cell"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """The cells as spans: a little off their row, columns 90 units apart; empty cells have none."""
    cells = _cells(spark, sf).filter("cell <> ''")
    off = F.pmod(F.col("row") * 7 + F.col("column") * 3, F.lit(5)).cast("double")
    box = cells.select("page_id", "item", (F.col("row") * ROW + off / 2).alias("y0"), (F.col("column") * COLUMN).alias("x0"), F.col("cell").alias("text"))
    return box.withColumns({"x1": F.col("x0") + 60.0, "y1": F.col("y0") + 10.0, "dir_y": F.lit(0.0)})


def page_features(spark: SparkSession, sf: str) -> DataFrame:
    """Spans, words and kind of the page that each table makes."""
    got = layout.page_features(_spans(spark, sf), "page_id", "item")
    return got.select("page_id", F.col("item").cast("long").alias("item"), "n_spans", "n_words", "n_columns", "kind")


def span_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of each table's spans in reading order."""
    got = layout.reading_order(_spans(spark, sf).withColumn("y0", F.floor(F.col("y0") / ROW) * 12), "page_id", "item")
    return got.select("page_id", F.col("item").cast("long").alias("item"), F.md5("text").alias("digest"))


def rebuilt_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, columns and Markdown of every table put together again from its spans."""
    got = layout.rebuilt(_spans(spark, sf), "page_id", "item")
    return got.select("page_id", F.col("item").cast("long").alias("item"), F.col("n_rows").cast("long").alias("n_rows"), F.col("n_columns").cast("long").alias("n_columns"), F.md5("markdown").alias("digest"))


def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that at least 30 % of a table's rows hit, and the share of rows with several cells."""
    got = layout.structural_columns(_spans(spark, sf), "page_id", "item")
    return got.select("page_id", F.col("item").cast("long").alias("item"), "n_structural", "several_share")


def table_router(spark: SparkSession, sf: str) -> DataFrame:
    """How many valid tables each strategy gives to pages, the first that gives any: given, rebuilt from boxes, or none."""
    entries = table(spark, sf, "pages_out").select("page_id", F.posexplode("tables").alias("k", "t")).distinct()
    valid = lambda c: F.size(T.table_faults(c)) == 0
    given = entries.filter(valid(F.col("t"))).select("page_id", "k", F.lit(0).alias("strategy"))
    boxes = checkpointed(layout.rebuilt(_spans(spark, sf), "page_id", "item")).filter(valid(F.col("markdown"))).select("page_id", (F.col("item") - 1).alias("k"), F.lit(1).alias("strategy"))
    return layout.first_strategy(given.unionByName(boxes), "page_id").select("page_id", F.col("strategy").cast("long").alias("strategy"), "n_tables")


def visible_text(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader sees of each text as a web page with menus and scripts around it."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><nav><p>Home of the site and more</p></nav><script>if (a < b) {}</script><h1 class='t'>Notes on the aircraft at hand</h1><p>two words</p><p id=x>"), escaped, F.lit("</p></html>"))
    return table(spark, sf, "documents").select("doc_id", F.md5(web.visible_text(page)).alias("digest")).filter("digest is not null")


def url_routes(spark: SparkSession, sf: str) -> DataFrame:
    """How the address of each text would be read, by host."""
    source = F.translate(F.lower(F.trim("source")), " _", "--")
    ending = F.when(F.col("doc_id") % 4 == 0, ".PDF?dl=1").when(F.col("doc_id") % 4 == 1, ".html").when(F.col("doc_id") % 4 == 2, ".png").otherwise("")
    url = F.concat(F.lit("https://WWW."), source, F.lit(".org/doc/"), F.col("doc_id").cast("string"), ending)
    snippet = F.when(F.col("doc_id") % 8 == 1, F.col("text"))
    return table(spark, sf, "documents").groupBy(web.host(url).alias("host"), web.route(url, snippet).alias("route")).agg(F.count("*").alias("n"))


def form_feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of texts whose paragraphs are told apart by form feeds, where as many come out as went in."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n\n", "\f").alias("m"))
    pages = web.form_feed_pages(F.col("m"), F.regexp_count("m", F.lit("\f")) + 1)
    return docs.select("doc_id", F.size(pages).cast("long").alias("n_pages")).filter("n_pages > 0")


def polar_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The polar table written as CSV files and read again, by rig."""
    points = table(spark, sf, "naca6535_xfoil_polar").select("rig", "AoA", "Cl", "Cd", "CDp", "Cm", "Xtr_top", "Xtr_bot", "ClCd")
    path = files.write_polar_csv(points, f"{shared_folder(spark)}/polars", "rig")
    got = files.read_polar_csv(spark, viscous=path)
    sums = [F.round(F.sum(F.round(c, 5)), 3).alias(f"{c.lower()}_sum") for c in ("Cl", "Cd")]
    return got.groupBy(F.col("rig")).agg(F.count("*").alias("n"), F.count("Cl").alias("n_lift"), *sums)


def _written(rows: DataFrame, folder: str, head: list[str]) -> str:
    """``name, seq, value`` as one text file for each name, behind the lines of ``head``; returns the folder."""
    path = f"{shared_folder(rows.sparkSession)}/{folder}"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda r: r["value"])
    whole = rows.groupBy("name").agg(F.array_join(F.concat(F.array(*map(F.lit, head)), lines), "\n").alias("value"))  # a file has a bounded number of runs
    whole.write.mode("overwrite").partitionBy("name").text(path)
    return path


#: Runs of a rig whose polars share a file.
FILE_RUNS = 64


def _file_name() -> Column:
    return F.concat_ws("-", "rig", F.floor(F.col("run_id") / FILE_RUNS).cast("long")).alias("name")


def _place() -> Column:
    return (F.col("run_id") * 1000 + F.round(F.col("AoA") * 2)).alias("seq")


def solver_files(spark: SparkSession, sf: str) -> DataFrame:
    """The polars in the solver's own format, some runs of a rig to a file, written and read again."""
    points = table(spark, sf, "naca6535_xfoil_polar").groupBy("point_id").agg(F.min(F.struct("rig", "run_id", "AoA", "Cl", "Cd", "CDp", "Cm", "Xtr_top", "Xtr_bot")).alias("p")).select("p.*")
    line = F.format_string("%8.3f %9.4f %9.5f %9.5f %8.4f %8.4f %8.4f", "AoA", "Cl", "Cd", "CDp", "Cm", "Xtr_top", "Xtr_bot")
    rows = points.dropna().select(_file_name(), _place(), line.alias("value"))
    path = _written(rows, "solver", ["  solver  version 6", "", " alpha CL CD CDp CM Top_Xtr Bot_Xtr", " ------ -------- -------- -------- ------ ------ ------"])
    got = files.read_solver_polars(spark, path, partitioned=True)
    return got.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("Cl"), 4).alias("cl_sum"), F.round(F.sum("Xtr_bot"), 4).alias("xtr_sum"))


def pressure_files(spark: SparkSession, sf: str) -> DataFrame:
    """Transition points in the format of pressure distributions, some runs of a rig to a file, written and read again."""
    points = table(spark, sf, "naca6535_xfoil_polar").groupBy("point_id").agg(F.min(F.struct("rig", "run_id", "AoA", "Xtr_top", "Cm")).alias("p")).select("p.*").dropna()
    rows = points.select(_file_name(), _place(), F.format_string("%10.5f %10.5f %10.5f", "Xtr_top", F.lit(0.0), "Cm").alias("value"))
    got = files.read_pressures(spark, _written(rows, "pressures", ["#", "# x y Cp", "1.0 2.0 3.0"]), partitioned=True)
    return got.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("x_c"), 4).alias("x_sum"), F.round(F.sum("Cp"), 4).alias("cp_sum"))


def ingested_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by content as the incremental ingest stores them, the stream run twice: nothing is stored again."""
    base = shared_folder(spark)
    folder, names = stream_source(spark, f"{sf}/pages_out.parquet")
    for _ in range(2):
        ingest_stream(spark, folder, f"{base}/pages", f"{base}/state", table(spark, sf, "pages_out").schema, names)
    return spark.read.parquet(f"{base}/pages").select("page_id", "sha256")


def coordinate_files(spark: SparkSession, sf: str) -> DataFrame:
    """The least lift of each rig at each angle as a coordinate file, written and read again."""
    points = table(spark, sf, "naca6535_xfoil_polar").filter("abs(Cl) <= 1.5 and abs(AoA) <= 30")
    first = points.groupBy("rig", "AoA").agg(F.min("Cl").alias("y"))
    lines = files.coordinate_lines(first.select(F.col("rig").alias("name"), F.round((F.col("AoA") + 30) * 100).cast("int").alias("seq"), (F.col("AoA") / 20).alias("x"), "y"))
    path = f"{shared_folder(spark)}/coordinates"
    lines.select(F.concat("content", F.lit("\n")).alias("value"), "name").write.mode("overwrite").partitionBy("name").text(path)
    back = files.read_coordinates(spark, path, partitioned=True)
    return back.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x_sum"), F.round(F.sum("y"), 5).alias("y_sum"))


def stored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The registry stored twice under one name; readers see the version that was switched to last."""
    path = f"{shared_folder(spark)}/registry"
    registry = table(spark, sf, "processed_files")
    files.replace_table(registry.limit(0), path)
    files.replace_table(registry, path)
    return files.current_table(spark, path).groupBy("filename").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_features, span_text, rebuilt_tables, table_columns, table_router, visible_text, url_routes, form_feed_pages, polar_csv, coordinate_files, stored_versions, solver_files, pressure_files, ingested_pages,
    )
}

_GRID = """
    e AS (SELECT DISTINCT page_id, i AS item, tables[i] AS t FROM (SELECT page_id, tables, unnest(range(1, len(tables) + 1)) AS i FROM pages_out WHERE tables IS NOT NULL)),
    l AS (SELECT page_id, item, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|') AND NOT regexp_matches(x, '^\\|[-| :]+\\|$')) AS l FROM e WHERE t IS NOT NULL),
    r AS (SELECT page_id, item, i - 1 AS y, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)),
    c AS (SELECT page_id, item, y, i - 1 AS x, trim(w[i]) AS cell FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(regexp_replace(line, '^\\|[ ]*', ''), '[ ]*\\|$', ''), '|') AS w FROM r))),
    full_cells AS (SELECT * FROM c WHERE cell <> '')
"""

_ONE_POINT = """
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY rig, run_id, AoA, Cl, Cd, CDp, Cm, Xtr_top, Xtr_bot) AS k FROM naca6535_xfoil_polar) WHERE k = 1)
"""

ORACLE = {
    "solver_files": f"""
        WITH {_ONE_POINT} SELECT rig || '-' || floor(run_id / 64.0)::BIGINT AS name, count(*) AS n, round(sum(round(Cl, 4)), 4) AS cl_sum, round(sum(round(Xtr_bot, 4)), 4) AS xtr_sum FROM p
        WHERE Cl IS NOT NULL AND Cd IS NOT NULL AND CDp IS NOT NULL AND Cm IS NOT NULL AND Xtr_top IS NOT NULL AND Xtr_bot IS NOT NULL GROUP BY 1
    """,
    "pressure_files": f"""
        WITH {_ONE_POINT} SELECT rig || '-' || floor(run_id / 64.0)::BIGINT AS name, count(*) AS n, round(sum(round(Xtr_top, 5)), 4) AS x_sum, round(sum(round(Cm, 5)), 4) AS cp_sum FROM p WHERE Xtr_top IS NOT NULL AND Cm IS NOT NULL GROUP BY 1
    """,
    "ingested_pages": "SELECT page_id, h AS sha256 FROM (SELECT page_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY loaded_at, page_id) AS k FROM pages_out WHERE text IS NOT NULL) WHERE k = 1",
    "page_features": f"""
        WITH {_GRID}, g AS (SELECT page_id, item, count(*) AS n_spans, sum(len(list_filter(string_split_regex(cell, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')))::BIGINT AS n_words, count(DISTINCT floor(x * 90 / 80)) AS n_columns,
            max(x * 90 + 60) AS width, max(y * 14 + (y * 7 + x * 3) % 5 / 2.0 + 10) AS height FROM full_cells GROUP BY page_id, item)
        SELECT page_id, item, n_spans, n_words, n_columns, CASE WHEN n_words = 0 THEN 'blank' WHEN width > 1.5 * height OR (width > 800 AND n_words < 200) THEN 'slide' WHEN n_columns >= 3 AND n_spans >= 6 THEN 'columns' ELSE 'plain' END AS kind FROM g
    """,
    "span_text": f"WITH {_GRID} SELECT page_id, item, md5(string_agg(cell, ' ' ORDER BY y, x)) AS digest FROM full_cells GROUP BY page_id, item",
    "rebuilt_tables": f"""
        WITH {_GRID}, k AS (SELECT page_id, item, x, dense_rank() OVER (PARTITION BY page_id, item ORDER BY x) AS k FROM (SELECT DISTINCT page_id, item, x FROM full_cells)),
        n AS (SELECT page_id, item, max(k) AS n FROM k GROUP BY ALL), ys AS (SELECT DISTINCT page_id, item, y FROM full_cells),
        g AS (SELECT ys.page_id, ys.item, y, unnest(range(1, n + 1)) AS k FROM ys JOIN n USING (page_id, item)),
        f AS (SELECT g.page_id, g.item, g.y, g.k, coalesce(cell, '') AS cell FROM g LEFT JOIN (SELECT c.*, k.k FROM full_cells c JOIN k USING (page_id, item, x)) z USING (page_id, item, y, k)),
        joined AS (SELECT page_id, item, y, '| ' || string_agg(cell, ' | ' ORDER BY k) || ' |' AS line FROM f GROUP BY page_id, item, y),
        lines AS (SELECT *, row_number() OVER (PARTITION BY page_id, item ORDER BY y) AS i FROM joined)
        SELECT page_id, item, count(*) AS n_rows, any_value(n) AS n_columns, md5(string_agg(CASE WHEN i = 1 THEN line || chr(10) || '|' || repeat('---|', n) ELSE line END, chr(10) ORDER BY y)) AS digest
        FROM lines JOIN n USING (page_id, item) GROUP BY page_id, item
    """,
    "table_columns": f"""
        WITH {_GRID}, s AS (SELECT page_id, item, count(DISTINCT y) AS rows FROM full_cells GROUP BY ALL), h AS (SELECT page_id, item, x, count(DISTINCT y) AS hits FROM full_cells GROUP BY ALL),
        m AS (SELECT page_id, item, count(*) FILTER (n > 1) AS several FROM (SELECT page_id, item, y, count(*) AS n FROM full_cells GROUP BY ALL) GROUP BY ALL)
        SELECT page_id, item, count(*) FILTER (hits >= 0.3 * rows) AS n_structural, round(any_value(several) / any_value(rows), 6) AS several_share FROM s JOIN h USING (page_id, item) JOIN m USING (page_id, item) GROUP BY page_id, item
    """,
    "visible_text": """
        SELECT doc_id, md5(array_to_string(list_filter(['Notes on the aircraft at hand', trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))], lambda x: len(string_split(x, ' ')) >= 4), ' ')) AS digest
        FROM documents WHERE text IS NOT NULL
    """,
    "url_routes": """
        WITH d AS (SELECT doc_id, text, 'www.' || translate(lower(trim(source)), ' _', '--') || '.org' AS h FROM documents)
        SELECT regexp_replace(h, '^www\\.', '') AS host, CASE WHEN h IS NULL THEN 'skip' WHEN doc_id % 4 = 2 THEN 'skip' WHEN doc_id % 8 = 1 AND trim(text) <> '' THEN 'snippet' WHEN doc_id % 4 = 0 THEN 'pdf' ELSE 'html' END AS route, count(*) AS n FROM d GROUP BY 1, 2
    """,
    "form_feed_pages": "SELECT doc_id, len(string_split(text, chr(10) || chr(10))) AS n_pages FROM documents WHERE text IS NOT NULL",
    "polar_csv": "SELECT rig, count(*) AS n, count(Cl) AS n_lift, round(sum(round(Cl, 5)), 3) AS cl_sum, round(sum(round(Cd, 5)), 3) AS cd_sum FROM naca6535_xfoil_polar GROUP BY rig",
    "coordinate_files": """
        WITH f AS (SELECT rig, AoA, min(Cl) AS y FROM naca6535_xfoil_polar WHERE abs(Cl) <= 1.5 AND abs(AoA) <= 30 GROUP BY rig, AoA)
        SELECT rig AS name, count(*) AS n, round(sum(round(AoA / 20, 6)), 6) AS x_sum, round(sum(round(y, 6)), 5) AS y_sum FROM f GROUP BY rig
    """,
    "stored_versions": "SELECT filename, count(*) AS n FROM processed_files GROUP BY filename",
}
