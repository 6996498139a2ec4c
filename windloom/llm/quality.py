"""Text quality statistics per document (problem 1).

Each text and each entry of a page's tables gets statistics of its words, symbols, lines and
common words. To tell prose from lists, tables and junk, a text is cut into stretches of lines
that read alike, gradient-boosted trees judge the statistics of every stretch, and the judged
words are added up: a text is a case if more than half of its words aren't prose. The trees are
trained on stretches that simple rules label beyond doubt (weak labels); their margins are turned
into probabilities on hand-judged pages, no stretch of which is trained on.

Scale: statistics are made in one Arrow pass over the texts, which are never shuffled; what is
written out and aggregated is a few numbers for each stretch. Training looks at ``TRAIN_ROWS``
weakly labelled stretches at most; everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.measures import STATISTICS, Lines, common_hashes
from windloom.llm.packing import slices
from windloom.session import checkpointed, spread

#: Bound on the weakly labelled stretches that the trees are trained on, chosen by a hash.
TRAIN_ROWS = 12_000
TREES, DEPTH = 12, 4
#: Judgements that the trees' own probabilities count for in the calibration.
PRIOR_JUDGED = 4.0

def _passes(rows: DataFrame, common: frozenset[str], whole: bool) -> DataFrame:
    """``_id, item, words, statistics`` of each item, or of each stretch of it; entries of tables are never cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = common_hashes(common)
        for pdf in batches:
            found = []
            for k, (text, tables) in enumerate(zip(pdf["_text"], pdf["_tables"])):
                items = [text, *(tables if tables is not None else ())]
                found += [(k, item, x) for item, x in enumerate(items) if x and not x.isspace()]
            row, item, texts = (pd.Series([f[c] for f in found], dtype=kind) for c, kind in enumerate((int, int, object)))
            for part in slices(texts):
                lines, own = Lines(texts[part].tolist(), known), item[part].to_numpy()
                groups = lines.text if whole else lines.stretches(own > 0)
                owner, words, values = lines.statistics(groups, own > 0)
                yield pd.DataFrame({"_id": pdf["_id"].to_numpy()[row[part].to_numpy()[owner]], "item": own[owner], "words": words, "statistics": list(values)})

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, item int, words int, statistics array<{'double' if whole else 'float'}>")


def _common(words: DataFrame) -> frozenset[str]:
    # the commonest words of each language: a fixed list that no table of texts makes longer
    return frozenset(r[0].lower() for r in words.select("word").distinct().collect() if r[0])


def _narrow(df: DataFrame, id_col: str, text_col: str, tables_col: str | None) -> DataFrame:
    tables = F.col(tables_col) if tables_col else F.lit(None).cast("array<string>")
    return spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), tables.alias("_tables")))


def text_statistics(df: DataFrame, common_words: DataFrame, id_col: str = "page_id", text_col: str = "text", tables_col: str | None = "tables") -> DataFrame:
    """``<id>, item, words`` and a column for each statistic of every text and table entry.

    Item 0 is the text, item k the k-th entry. Null and blank texts and entries give no row. A row
    delivered twice gives two. Other columns are not looked at; an empty table gives no rows.
    """
    got = _passes(_narrow(df, id_col, text_col, tables_col), _common(common_words), True)
    columns = [F.round(F.col("statistics")[k], 6).alias(name) for k, name in enumerate(STATISTICS) if k > 1]
    return got.select(F.col("_id").alias(id_col), "item", "words", *columns)


def weak_label(s: dict) -> F:
    """1.0 for what is no prose (of a table entry: no table) beyond doubt, 0.0 for what is, else null."""
    binding, letters = s["common_word_share"], s["alphabetic_word_share"]
    prose = (binding >= 0.25) & (s["words_per_line"] >= 3) & (s["marked_line_share"] < 0.3) & (s["vowel_share"] >= 0.25)
    listed = (s["marked_line_share"] > 0.4) & (binding <= 0.2)
    structure = (binding <= 0.05) | listed | (s["other_script_share"] > 0.4)
    scrawl = (s["symbol_ratio"] > 0.75) | ((s["vowel_share"] < 0.12) & (s["digit_ratio"] < 0.35)) | (s["other_script_share"] > 0.4)
    table = (binding <= 0.05) & ((s["numeric_word_share"] > 0.15) | ((letters > 0.6) & (s["vowel_share"] > 0.25))) & (s["other_script_share"] < 0.1)
    entry = s["is_entry"] > 0.5
    return (
        F.when(entry & ((binding >= 0.2) | scrawl), 1.0)
        .when(entry & table, 0.0)
        .when(~entry & prose, 0.0)
        .when(~entry & structure, 1.0)
    )


def judged_items(df: DataFrame, common_words: DataFrame, labels: DataFrame, id_col: str = "page_id", text_col: str = "text", tables_col: str | None = "tables", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``<id>, item, words, share``: the share of an item's words that are a case (see the module).

    ``labels`` (``<id>, label`` with prose, list, table or junk) may hold wrong and repeated
    judgements; the majority of a page's counts, and a draw doesn't. They are a holdout: the trees never
    see a stretch of a judged page. Where the rules find only one class to train on, they decide alone. Null and blank
    texts give no row; a row delivered twice is judged once.
    """
    parts = _passes(_narrow(df, id_col, text_col, tables_col), _common(common_words), False)
    named = {name: F.col("statistics")[k] for k, name in enumerate(STATISTICS)}
    parts = checkpointed(parts.withColumn("weak", weak_label(named)))
    vector = array_to_vector(F.col("statistics").cast("array<double>"))
    judged = labels.filter("label is not null").select(F.col(id_col).alias("_id"), "label")
    weak = parts.filter("weak is not null").join(judged.select("_id").distinct(), "_id", "left_anti")
    # an even share of texts and entries, cases and others, by a hash: no task sorts or gathers them all
    entry = F.col("item") > 0
    draw = F.pmod(F.xxhash64("_id", "item", "words", "statistics"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for r in weak.groupBy(entry.alias("e"), "weak").count().collect():  # four rows at most
        chosen = chosen | ((entry == r["e"]) & (F.col("weak") == r["weak"]) & (draw < 0.95 * train_rows / 4 / r["count"]))
    # in an order that no run changes, for the trees look at their rows by partition
    train = weak.filter(chosen).limit(train_rows).select(draw.alias("_k"), vector.alias("features"), F.col("weak").alias("label"))
    train = checkpointed(train.repartition(2, "_k").sortWithinPartitions("_k").drop("_k"))
    classes = {r[0] for r in train.select("label").distinct().collect()}
    if classes == {0.0, 1.0}:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1, stepSize=0.3).fit(train)
        scored = model.transform(parts.withColumn("features", vector)).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")
        slope, shift = _calibration(scored, judged)
    else:
        scored, slope, shift = parts.withColumn("margin", F.coalesce(F.col("weak") - 0.5, F.lit(-0.5))), 1.0, 0.0
    probability = 1 / (1 + F.exp(-(F.col("margin") * slope + shift)))
    sums = scored.withColumn("p", probability).groupBy("_id", "item").agg(
        F.sum("words").alias("words"), F.sum(F.when(F.col("p") > 0.5, F.col("words")).otherwise(0)).alias("case_words"), F.sum(F.col("p") * F.col("words")).alias("expected")
    )
    return sums.select(
        F.col("_id").alias(id_col), "item", "words", (F.col("case_words") / F.greatest("words", F.lit(1))).alias("share"), (F.col("expected") / F.greatest("words", F.lit(1))).alias("probability")
    )


def _calibration(scored: DataFrame, judged: DataFrame) -> tuple[float, float]:
    """Slope and shift of the margins' log odds by the hand-judged pages' stretches, both classes weighing the same.

    The trees' own probability, of slope 2 and shift 0, stands for ``PRIOR_JUDGED`` judgements more.
    """
    case = F.avg(F.when(F.col("label") == "prose", 0.0).otherwise(1.0))
    label = judged.groupBy("_id").agg(F.when(case > 0.5, 1.0).when(case < 0.5, 0.0).alias("label")).filter("label is not null")
    rows = scored.filter("item = 0").join(label, "_id").groupBy("_id", "label").agg((F.sum(F.col("margin") * F.col("words")) / F.sum(F.greatest("words", F.lit(1)))).alias("margin"))
    rows = checkpointed(rows.select("label", "margin"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weights = {k: 0.5 * sum(counts.values()) / n for k, n in counts.items()}
    weight = F.when(F.col("label") == 1.0, weights.get(1.0, 1.0)).otherwise(weights.get(0.0, 1.0))
    own = [(y, float(m), PRIOR_JUDGED / 4 * 2 / (1 + math.exp(-2 * m if y else 2 * m))) for m in (-1, 1) for y in (0.0, 1.0)]
    prior = scored.sparkSession.createDataFrame(own, "label double, margin double, weight double")
    fit = LogisticRegression(regParam=0.01, weightCol="weight").fit(rows.withColumn("weight", weight).unionByName(prior).withColumn("features", array_to_vector(F.array("margin"))))
    slope, shift = float(fit.coefficients[0]), float(fit.intercept)
    return (slope, shift) if slope > 0 else (2.0, 0.0)  # judgements that turn the trees round are no calibration


def found_cases(pages: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    return judged_items(pages, common_words, labels).filter("share > 0.5").select("page_id", "item").distinct()
