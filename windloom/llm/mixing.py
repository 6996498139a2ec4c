"""Mixing sources to target weights (problem 7).

Tokens are counted per cell (source, language, topic). Iterative proportional fitting rakes the
cells to the target shares of the sources and, as far as these allow, to those of the languages
and topics; a cell's tokens may be used at most ``max_repeats`` times. Each record of a cell of
weight ``w`` is used ``floor(w)`` times, and once more if the hash of its key is below its
probability, the rest of ``w`` times a factor of its source. The factors are calibrated on the
records' tokens, so that the tokens used are those planned whatever the records' lengths.

Scale: records become narrow rows (key, cell, tokens) in one pass and are checkpointed; the
cells, the calibration and what the sample used are Spark aggregates over them. Only the table of
cells visits the driver, to be raked. It has at most (listed sources) x (677 languages) x
(topics) rows, whatever the number of records; there is no join of records with records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.llm.tokens import wordpunct_count
from windloom.session import checkpointed, spread

TOPICS = 8
ROUNDS = 200
#: Steps in which the factor of a source is calibrated, over all factors from 0 to infinity.
FACTOR_STEPS = 8192
#: Parts of a hash.
HASHES = 1 << 40
#: Relative error of the sums of a source's cells.
ROUNDING = 1e-11


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A topic by hashing: the bucket that most of the text's long words fall into.

    Words of nine letters and more carry the subject; the bucket is a hash of their stem.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{9,}+"), F.lit(0))
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(F.substring(w, 1, 6)), F.lit(topics)).cast("int"))
    return F.coalesce(_fullest(buckets, topics), F.lit(-1))


def _fullest(buckets: Column, topics: int) -> Column:
    counts = F.aggregate(
        buckets,
        F.array_repeat(F.lit(0), topics),
        lambda acc, b: F.transform(acc, lambda n, i: F.when(i == b, n + 1).otherwise(n)),
    )
    best = F.array_position(counts, F.array_max(counts)) - 1
    return F.when(F.array_max(counts) > 0, best.cast("int"))


def norm_source(c: Column) -> Column:
    return F.lower(F.trim(c))


def norm_lang(c: Column) -> Column:
    """The two letters of a language code; other names are one language."""
    code = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(code != "", code).otherwise(F.lit("und"))


def records(docs: DataFrame, targets: DataFrame, topics: int = TOPICS) -> DataFrame:
    """One narrow row per distinct ``doc_id`` of a listed source: size and cell."""
    listed = targets.select(norm_source(F.col("source")).alias("source")).distinct()
    # mix_targets has one row per source; both sides are narrow, Spark broadcasts it by its size
    narrow = spread(docs.select("doc_id", "source", "lang", "text")).select(
        "doc_id", norm_source(F.col("source")).alias("source"), norm_lang(F.col("lang")).alias("lang"), F.col("text").alias("_text")
    ).join(listed, "source", "left_semi")
    return (
        narrow.select(
            "doc_id",
            "source",
            "lang",
            F.coalesce(wordpunct_count(F.col("_text")), F.lit(0)).cast("long").alias("tokens"),
            topic_of(F.coalesce("_text", F.lit("")), topics).alias("topic"),
        )
        .groupBy("doc_id")
        .agg(*[F.min(c).alias(c) for c in ("source", "lang", "tokens", "topic")])
    )


def _filled(w: np.ndarray, size: np.ndarray, limit: np.ndarray, goal: float) -> np.ndarray:
    """``w`` times one factor, cut at the limits, so that the tokens are ``goal`` or all that there are."""
    there = (w > 0) & (size > 0)
    if not there.any() or (limit * size)[there].sum() <= goal:
        return np.where(there, limit, w)
    full = np.where(there, limit / np.where(there, w, 1.0), np.inf)  # factor at which a cell is at its limit
    order = np.argsort(full, kind="stable")
    capped = np.concatenate([[0.0], np.cumsum((np.where(there, limit, 0.0) * size)[order])])[:-1]
    open_ = np.cumsum((w * size)[order][::-1])[::-1]
    factor = (goal - capped) / np.where(open_ > 0, open_, 1.0)
    fits = np.flatnonzero(there[order] & (factor <= full[order]))  # the first cell that stays below its limit
    return np.minimum(w * factor[fits[0]], limit) if len(fits) else np.minimum(w, limit)


def rake(cells: pd.DataFrame, target: dict[str, float], cap: dict[str, int], total: float, shares: dict[str, dict] | None = None) -> np.ndarray:
    """Weights of the cells by iterative proportional fitting under the sources' repeat caps.

    Sources come last in each round and are met exactly: what a capped cell can't give falls to the
    source's other cells, and a source beyond all its caps stays at them. ``shares`` has targets of
    the columns ``lang`` and ``topic``, the cells' own shares where it has none.
    """
    size = cells["tokens"].to_numpy(float)
    limit = cells["source"].map(cap).to_numpy(float)
    w = np.minimum(np.ones(len(cells)), limit)
    margins = []
    for c in ("lang", "topic"):
        own = (cells.groupby(c)["tokens"].sum() / max(size.sum(), 1.0)).sort_index()
        goal = own.index.map((shares or {}).get(c) or own.to_dict()).to_numpy(float)
        margins.append((pd.factorize(cells[c], sort=True)[0], np.nan_to_num(goal) * total))
    code, names = pd.factorize(cells["source"], sort=True)
    members = [np.flatnonzero(code == k) for k in range(len(names))]
    for _ in range(ROUNDS):
        last = w.copy()
        for group, goal in margins:
            now = np.bincount(group, w * size, len(goal))
            w = np.minimum(w * np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[group], limit)
        w = np.maximum(w, 1e-9)  # no target of a language or topic may keep a source from its share
        for own, s in zip(members, names):
            w[own] = _filled(w[own], size[own], limit[own], target[s] * total)
        if np.abs(w - last).max(initial=0) < 1e-9:
            break
    return w


def _shares(df: DataFrame | None, column: str) -> dict | None:
    # one row for each language or topic
    return None if df is None else {r[0]: float(r[1]) for r in df.select(column, "target_share").collect()}


def mix_plan(docs: DataFrame, targets: DataFrame, total: int | None = None, topics: int = TOPICS, languages: DataFrame | None = None, topic_shares: DataFrame | None = None):
    """``(report, sample)``.

    ``report``: one row per listed source with ``source, target_share, max_repeats, tokens,
    needed, reachable, planned, feasible, used_tokens, reached_share, actual_share``; ``sample``:
    ``doc_id, source, tokens, copies`` for the records that are used. The mix has ``total`` tokens,
    by default as many as all records of the listed sources. ``reached_share`` is of this total, as
    the target is; ``actual_share`` is of the mix, which is smaller where sources run dry.
    ``languages`` (``lang, target_share``) and ``topic_shares`` (``topic, target_share``) are raked to as far
    as the sources' shares and caps allow; by default they keep the records' own shares.

    Sources compare trimmed and in lower case. A listed source without records needs more than
    it has. Null texts and null sources count nothing. A ``doc_id`` delivered twice counts once.
    With no records at all the report has zero tokens and null shares.
    """
    spark = docs.sparkSession
    rows = checkpointed(records(docs, targets, topics))
    cell = ["source", "lang", "topic"]
    cells = rows.groupBy(*cell).agg(F.sum("tokens").alias("tokens")).toPandas()  # bounded, see the module
    listed = targets.select("source", norm_source(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).dropDuplicates(["key"])
    goals = {r["key"]: r for r in listed.collect()}  # one row for each listed source
    size = float(total if total is not None else cells["tokens"].sum())
    wanted = {"lang": _shares(languages, "lang"), "topic": _shares(topic_shares, "topic")}
    cells["w"] = rake(cells, {k: r["target_share"] for k, r in goals.items()}, {k: r["max_repeats"] for k, r in goals.items()}, size, wanted)
    weights = spark.createDataFrame(cells if len(cells) else [], "source string, lang string, topic int, tokens long, w double").withColumn("base", F.floor(F.col("w") + 1e-9)).withColumn(
        "rest", F.greatest(F.col("w") - F.col("base"), F.lit(0.0))
    )
    plan = weights.groupBy(F.col("source").alias("key")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("w") * F.col("tokens")).alias("planned"), F.sum(F.col("rest") * F.col("tokens")).alias("more"))
    factors = _factors(rows.join(F.broadcast(weights.select(*cell, "rest")), cell), plan)
    placed = rows.join(F.broadcast(weights.select(*cell, "base", "rest")), cell).join(F.broadcast(factors), "source", "left")
    again = (_hash() < F.col("factor") * F.col("rest")).cast("long")
    sample = placed.withColumn("copies", F.col("base") + F.coalesce(again, F.lit(0))).filter("copies > 0").select("doc_id", "source", "tokens", "copies")
    used = sample.groupBy(F.col("source").alias("key")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    report = listed.join(plan.drop("more"), "key", "left").join(used, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "planned", "used_tokens")})
    report = report.withColumn("needed", F.col("target_share") * size).withColumn("reachable", F.col("tokens") * F.col("max_repeats"))
    report = report.withColumn("feasible", ~(F.col("planned") < F.col("needed") * (1 - ROUNDING)))
    everything = report.agg(F.sum("used_tokens").alias("_all"))  # one row
    report = report.join(F.broadcast(everything), F.lit(True)).withColumn("reached_share", F.try_divide(F.col("used_tokens"), F.lit(size))).withColumn("actual_share", F.try_divide("used_tokens", "_all"))
    return report.select("source", "target_share", "max_repeats", "tokens", "needed", "reachable", "planned", "feasible", "used_tokens", "reached_share", "actual_share"), sample


def _hash() -> Column:
    """A number above 0 and up to 1 by the record's key."""
    return (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HASHES)) + 1) / float(HASHES)


def _factors(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, factor``: what the probabilities of a source's records are multiplied with to use ``more`` tokens.

    A record is used once more from the factor ``hash / rest`` on. Its tokens are added up in steps of
    the factor, and the sum nearest to what is planned gives it; a source has ``FACTOR_STEPS`` rows.
    """
    least = _hash() / F.col("rest")
    step = F.floor(least / (1 + least) * FACTOR_STEPS)
    steps = placed.filter("rest > 0").groupBy("source", step.alias("step")).agg(F.sum("tokens").alias("tokens"))
    sums = steps.withColumn("sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("step")))
    off = F.abs(F.col("sum") - F.col("more"))
    near = sums.join(F.broadcast(plan.select(F.col("key").alias("source"), "more")), "source").groupBy("source").agg(F.min(F.struct(off.alias("off"), "step")).alias("best"), F.first("more").alias("more"))
    share = (F.col("best.step") + 1) / FACTOR_STEPS
    return near.select("source", F.when(F.col("best.off") >= F.col("more"), 0.0).otherwise(share / (1 - F.least(share, F.lit(1 - 1e-12)))).alias("factor"))


def found_short_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Listed sources that can't reach their share: the raked and capped plan falls short of it, and the mix that was drawn too."""
    return mix_plan(docs, targets)[0].filter(~F.col("feasible") & (F.col("used_tokens") < F.col("needed"))).select("source").distinct()
