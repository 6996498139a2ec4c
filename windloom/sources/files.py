"""Readers and writers of the domain's files. Schemas are declared, never inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VISCOUS = "AoA double, Cl double, Cd double, CDp double, Cm double, Xtr_top double, Xtr_bot double, ClCd double"
PANEL = "AoA double, Cl double, Cd double, Cm double, ClCd double"


def scan_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """``filename, sha256, n_bytes`` of the files of a folder, by content; the suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = files.filter(F.lower("path").endswith(suffix))
    return wanted.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def _lines(spark: SparkSession, paths: str | list[str], partitioned: bool = False) -> DataFrame:
    """``name, line, value`` of small text files, one file in one row of the scan; named by their file or by the folder ``name=``."""
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    whole = spark.read.text(paths, wholetext=True)
    name = F.col("name").cast("string") if partitioned else F.regexp_replace(file, r"\.[a-zA-Z]+$", "")
    return whole.select(name.alias("name"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def _numbers(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")


def read_coordinates(spark: SparkSession, paths: str | list[str], partitioned: bool = False) -> DataFrame:
    """``name, seq, x, y`` of airfoil coordinate files: the lines of exactly two numbers.

    The count line of the two-surface format has two numbers of which one exceeds 1.5, and isn't a point.
    """
    words = _lines(spark, paths, partitioned).withColumn("w", _numbers(F.col("value")))
    points = words.filter(F.size("w") == 2).select("name", "line", F.get("w", F.lit(0)).try_cast("double").alias("x"), F.get("w", F.lit(1)).try_cast("double").alias("y"))
    return points.filter("x is not null and y is not null and abs(x) <= 1.5 and abs(y) <= 1.5").select("name", F.col("line").alias("seq"), "x", "y")


def read_solver_polars(spark: SparkSession, paths: str | list[str], partitioned: bool = False) -> DataFrame:
    """Polars written by a viscous solver: rows after the first rule of dashes with seven numbers."""
    lines = _lines(spark, paths, partitioned)
    rule = lines.filter(F.trim("value").startswith("---")).groupBy("name").agg(F.min("line").alias("rule"))
    words = lines.join(rule, "name").filter("line > rule").withColumn("w", _numbers(F.col("value"))).filter(F.size("w") >= 7)
    names = ("AoA", "Cl", "Cd", "CDp", "Cm", "Xtr_top", "Xtr_bot")
    got = words.select("name", *[F.get("w", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)]).dropna(subset=list(names))
    return got.withColumn("ClCd", F.try_divide("Cl", "Cd"))


def read_pressures(spark: SparkSession, paths: str | list[str], header: int = 3, partitioned: bool = False) -> DataFrame:
    """``name, x_c, Cp``: pressure distributions after ``header`` lines."""
    words = _lines(spark, paths, partitioned).filter(F.col("line") >= header).withColumn("w", _numbers(F.col("value"))).filter(F.size("w") >= 2)
    return words.select("name", F.get("w", F.lit(0)).try_cast("double").alias("x_c"), F.element_at("w", -1).try_cast("double").alias("Cp")).dropna()


def read_polar_csv(spark: SparkSession, viscous: str | list[str] | None = None, panel: str | list[str] | None = None) -> DataFrame:
    """Polars of both engines in one table with ``name, engine``; columns an engine lacks are null."""
    parts = []
    for engine, paths, schema in (("viscous", viscous, VISCOUS), ("panel", panel, PANEL)):
        if paths:
            rows = spark.read.schema(schema).option("header", True).csv(paths)
            file = F.element_at(F.split(F.input_file_name(), "/"), -1)
            parts.append(rows.select(F.regexp_replace(file, r"(_[a-z]+_polar)?\.csv$", "").alias("name"), F.lit(engine).alias("engine"), "*"))
    if not parts:
        return spark.createDataFrame([], f"name string, engine string, {VISCOUS}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def coordinate_lines(points: DataFrame) -> DataFrame:
    """``name, content`` of coordinate files: a title line, then the points in order."""
    line = F.format_string("  %.6f  %.6f", "x", "y")
    rows = points.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("text")))).alias("rows"))
    return rows.select("name", F.concat_ws("\n", F.concat(F.array("name"), F.transform("rows", lambda r: r["text"]))).alias("content"))


def write_polar_csv(points: DataFrame, path: str, key: str) -> str:
    """Polars as CSV files with a header, one folder for each ``key``; returns ``path``."""
    points.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)
    return path


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its folder.

    :func:`current_table` reads the last version that is whole, so a reader sees the one before or the
    new one, never a part.
    """
    versions = _versions(df.sparkSession, path)
    target = f"{path}/version={int(versions[-1][8:20]) + 1 if versions else 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return target


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version that :func:`replace_table` wrote; None where there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]}") if versions else None


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the versions whose writing ended, in order."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(of(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(of(path))]
    return sorted(n for n in names if n.startswith("version=") and fs.exists(of(f"{path}/{n}/_SUCCESS")))
