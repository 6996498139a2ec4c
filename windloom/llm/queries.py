"""The pN_ queries over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.session import checkpointed, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.quality import found_cases

    return found_cases(*(table(spark, sf, t) for t in ("pages_out", "common_words", "page_labels")))


def p1_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of every text and table entry."""
    from windloom.llm.quality import text_statistics

    return text_statistics(table(spark, sf, "pages_out"), table(spark, sf, "common_words")).dropDuplicates(["page_id", "item"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.encoding import found_wrong

    return found_wrong(table(spark, sf, "pages_out"))


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The affected pages with their restored text."""
    from windloom.llm.encoding import fill_lost, repair_encoding

    pages = table(spark, sf, "pages_out")
    repaired = checkpointed(repair_encoding(pages, "page_id", "text").dropDuplicates(["page_id"]))  # the model runs once
    filled = fill_lost(repaired, "page_id", pages, "text")
    return filled.select("page_id", "text", F.array_join("states", ", ").alias("states"), "places")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.splitting import found_oversized

    return found_oversized(table(spark, sf, "pages_out"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every page, with its size; the texts stay in the operator's output."""
    from windloom.llm.splitting import split_oversized

    got = split_oversized(table(spark, sf, "pages_out"), "page_id", "text", 420, 40)
    return got.select("page_id", "piece", "n_pieces", "start", "overlap_units", F.length("text").alias("n_chars")).distinct()


def p4_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Words and characters of the pieces of every page without their overlap, and whether all are within the limit."""
    from windloom.llm.splitting import split_oversized

    got = split_oversized(table(spark, sf, "pages_out"), "page_id", "text", 420, 40)
    pieces = got.select("page_id", "piece", "own_chars", "overlap_units", F.regexp_count("text", F.lit(r"(?U)\S++")).alias("words")).distinct()
    return pieces.groupBy("page_id").agg(
        F.sum(F.col("words") - F.col("overlap_units")).alias("n_words"), F.sum("own_chars").alias("n_chars"), F.bool_and(F.col("words") <= 420).alias("within"), (F.count("*") > 1).alias("cut")
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.scanned import found_noise

    return found_noise(table(spark, sf, "pages_out"))


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every page that isn't blank as continuous paragraphs, by length and digest; the texts stay in the operator's output."""
    from windloom.llm.scanned import Scanned

    got = Scanned(table(spark, sf, "pages_out")).repaired()
    return got.select("page_id", "furniture", F.length("text").alias("n_chars"), F.md5("text").alias("digest")).distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.packing import found_divided

    return found_divided(table(spark, sf, "documents"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Fill of every container."""
    from windloom.llm.packing import pack_containers

    placed = pack_containers(table(spark, sf, "documents"), "doc_id", "text", 1024)
    return placed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Records and tokens in all containers, whether none is over its capacity, and whether only larger records are divided."""
    from windloom.llm.packing import pack_containers

    placed = pack_containers(table(spark, sf, "documents"), "doc_id", "text", 1024).select("doc_id", "container", "tokens")
    boxes = placed.groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.sum("tokens").alias("n_tokens"), (F.max("tokens") <= 1024).alias("within"))  # one row
    items = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    items = items.agg(F.count("*").alias("n_records"), F.bool_and((F.col("pieces") == 1) | (F.col("tokens") > 1024)).alias("whole"))  # one row
    return items.join(F.broadcast(boxes), F.lit(True)).select("n_records", "n_tokens", "within", "whole")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.mixing import found_short_sources

    return found_short_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.mixing import mix_plan

    return mix_plan(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What each source has, needs and gives by plan, and whether the sample used that but for its longest record."""
    from windloom.llm.mixing import mix_plan

    report, sample = mix_plan(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    longest = sample.agg(F.max("tokens").alias("_longest"))  # one row
    kept = F.abs(F.col("used_tokens") - F.col("planned")) <= F.coalesce("_longest", F.lit(0)) + 0.01 * F.col("planned")
    got = report.join(F.broadcast(longest), F.lit(True))
    return got.select("source", "tokens", F.round("needed", 5).alias("needed"), F.round("planned", 5).alias("planned"), "feasible", kept.alias("kept"))


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.mixing import mix_plan

    return mix_plan(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    from windloom.llm.spans import found_pairs

    return found_pairs(table(spark, sf, "documents"))


def p8_shared_parts(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each text occurs in others."""
    from windloom.llm.spans import SharedSpans

    return SharedSpans(table(spark, sf, "documents"), "doc_id", "text").shared_parts()


def p8_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every shared stretch of every record, copies of a text included, by its place and digest."""
    from windloom.llm.spans import SharedSpans

    return SharedSpans(table(spark, sf, "documents"), "doc_id", "text").passages()


def p8_links(spark: SparkSession, sf: str) -> DataFrame:
    """With how many other records each record shares a span."""
    from windloom.llm.spans import SharedSpans

    return SharedSpans(table(spark, sf, "documents"), "doc_id", "text").links()


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}
