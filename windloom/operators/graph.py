"""Entities, similarity edges, groups and expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.functions import text as T
from windloom.operators.retrieval import dense, dense_above, vector_blocks
from windloom.session import checkpointed

#: A name with its number, the entities of this domain.
ENTITY = r"\b[A-Z][a-z]+ [0-9]{1,3}\b"


def mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, entity, n``: the edges between texts and the entities they name."""
    found = F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("entity")
    return docs.select("doc_id", found).filter(T.valid_label(F.col("entity"))).groupBy("doc_id", "entity").agg(F.count("*").alias("n"))


#: Parts that the rows of one name are dealt out to where they meet the asked ones.
SALTS = 16


def sharing(found: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, doc_id, n_shared``: texts that name what the asked ones name, by the number of shared names.

    Both are ``doc_id, entity`` without repeats. The rows of a name are salted, so that a common name
    is no single task.
    """
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    wanted = asked.select(F.col("doc_id").alias("query_id"), "entity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = wanted.join(dealt, ["entity", "salt"]).filter("query_id <> doc_id")
    return pairs.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_shared"))


def centroids(vectors: DataFrame, group: str = "label") -> DataFrame:
    """``<group>, dim, value``: unit mean vector of each group, as rows."""
    long = vectors.select(group, F.posexplode("embedding").alias("dim", "x"))
    mean = long.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    size = mean.groupBy(F.col(group).alias("_g")).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("_norm"))
    return mean.join(size, F.col(group).eqNullSafe(F.col("_g"))).select(group, "dim", F.when(F.col("_norm") > 0, F.col("mean") / F.col("_norm")).otherwise(0.0).alias("value"))


def route(vectors: DataFrame, centers: DataFrame, group: str = "label", least: float = 0.82) -> DataFrame:
    """``vec_id, routed, similarity``: the most similar group, null (a new one) below ``least``.

    Groups meet the vectors in blocks, each a bounded matrix; only the best of a block travels on, and
    with one block nothing is shuffled.
    """
    whole = centers.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("embedding"))
    best = None
    for ids, matrix in vector_blocks(checkpointed(whole.select(F.col(group).alias("vec_id"), "embedding"))):
        part = vectors.select("vec_id", "embedding").mapInPandas(_best_of(ids, matrix), f"vec_id long, routed {whole.schema[group].dataType.simpleString()}, similarity double")
        best = part if best is None else best.unionByName(part).groupBy("vec_id").agg(F.max(F.struct("similarity", (-F.col("routed")).alias("r"))).alias("b")).select("vec_id", (-F.col("b.r")).alias("routed"), "b.similarity")
    if best is None:
        return vectors.select("vec_id", F.lit(None).cast("int").alias("routed"), F.lit(None).cast("double").alias("similarity"))
    return best.select("vec_id", F.when(F.col("similarity") >= least, F.col("routed")).alias("routed"), "similarity")


def _best_of(ids: np.ndarray, matrix: np.ndarray):
    order = np.argsort(ids)  # the least id of equals
    ids, matrix = ids[order], matrix[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            sim = np.round(x @ matrix.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), 6)
            at = sim.argmax(axis=1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "routed": ids[at], "similarity": sim[np.arange(len(sim)), at]})

    return run


def upserted(vectors: DataFrame, new: DataFrame, above: float = 0.75) -> DataFrame:
    """``vec_id, node, similarity``: the stored vector that each new one is merged into, its own id where none is as similar as ``above``.

    One batch against what was stored before it; vectors of a batch aren't merged with each other.
    """
    stored = vectors.join(new.select("vec_id").distinct(), "vec_id", "left_anti")
    best = dense(stored, new, 1).select(F.col("query_id").alias("_q"), F.col("vec_id").alias("_n"), "similarity")
    got = new.select("vec_id").join(best, F.col("vec_id") == F.col("_q"), "left")
    return got.select("vec_id", F.when(F.col("similarity") > above, F.col("_n")).otherwise(F.col("vec_id")).alias("node"), "similarity")


def similarity_edges(vectors: DataFrame, new: DataFrame, above: float = 0.55) -> DataFrame:
    """``src, dst, similarity`` from each new vector to all rows more similar than ``above``."""
    return dense_above(vectors, new, above).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "similarity")


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``seed, node, hop``: nodes within ``depth`` steps either way, with the least number of steps."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct()
    front = reached
    for k in range(1, depth + 1):
        step = front.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(reached, ["seed", "node"], "left_anti").withColumn("hop", F.lit(k)))
        reached = reached.unionByName(front)
    return reached


def degrees(edges: DataFrame) -> DataFrame:
    """``node, n_out, n_in``."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: connected components, named by their least node.

    Labels are shortened by pointer jumping: each round joins edges with labels, takes the least
    label around, then the label of that label; the number of rounds grows with the logarithm of
    the longest path. Every round ends in a reliable checkpoint.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    both = checkpointed(both.filter("a is not null and b is not null").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        moved = least.join(jump, F.col("new") == F.col("_n"), "left").select("node", "component", F.least("new", F.coalesce("_c", "new")).alias("new"))
        moved = checkpointed(moved)
        labels = moved.select("node", F.col("new").alias("component"))
        if moved.filter("new <> component").limit(1).count() == 0:
            return labels


def blend_centroids(old: DataFrame, new: DataFrame, group: str = "label") -> DataFrame:
    """``<group>, dim, value, n``: centroids blended by the number of their members, unit length.

    Both sides are ``<group>, dim, value, n``; a group of one side only keeps its direction.
    """
    both = old.select(group, "dim", "value", "n").unionByName(new.select(group, "dim", "value", "n"))
    mean = both.groupBy(group, "dim").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    size = mean.groupBy(F.col(group).alias("_g")).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("_norm"))
    return mean.join(size, F.col(group).eqNullSafe(F.col("_g"))).select(group, "dim", F.when(F.col("_norm") > 0, F.col("mean") / F.col("_norm")).otherwise(0.0).alias("value"), "n")
