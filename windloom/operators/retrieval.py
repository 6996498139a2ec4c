"""Sparse and dense retrieval, rank fusion and re-ranking.

Queries are a stated part of the rows and are scored against all rows in blocks of bounded size: a
block's postings, or its vectors, meet the rows in Arrow batches, and only the best of each batch
travel on. Texts are never shuffled and words become hashes in the JVM; document frequencies are a
map-side aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windloom.functions import text as T
from windloom.session import checkpointed, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query vectors and postings of query texts that are scored at once.
QUERY_BLOCK, POSTINGS_BLOCK = 2048, 2_000_000
#: Sums of a text and a query, and products that go into them, that a task holds at once.
CELLS = 4_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, term, tf, len`` with the number of terms of the text."""
    words = docs.select(id_col, T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    exploded = words.select(id_col, F.size("_w").alias("len"), F.explode("_w").alias("term"))
    return exploded.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_stats(posts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``term, df, idf``; a negative idf becomes ``EPSILON`` times the mean idf."""
    n = F.broadcast(n_docs.select(F.count("*").alias("_n")))
    idf = posts.groupBy("term").agg(F.count("*").alias("df")).join(n, F.lit(True)).withColumn("raw", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(idf.agg(F.avg("raw").alias("_mean")))
    return idf.join(mean, F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("_mean")).otherwise(F.col("raw")).alias("idf"))


def best_per(df: DataFrame, key: str | list[str], score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key with their ``rank`` from 0; the limited rank also runs before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def _blocks(queries: DataFrame, block: int) -> Iterator[pd.DataFrame]:
    """The stated queries in parts of about ``block`` rows, chosen by hash."""
    total = queries.count()
    parts = max(1, -(-total // block))
    for part in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(queries.columns[0]), F.lit(parts)) == part).toPandas()
        if len(rows):
            yield rows


class _Asked:
    """Postings of a block of query texts: for each term the queries that hold it, with its count and idf weight there."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["term", "doc_id"])
        self.ids, self.query = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
        self.terms, first = np.unique(rows["term"].to_numpy(), return_index=True)
        self.offsets = np.append(first, len(rows))
        self.tf = rows["tf"].to_numpy(float)
        self.weight = rows["tf"].to_numpy(float) * rows["idf"].to_numpy(float)
        self.n_terms = np.bincount(self.query, minlength=len(self.ids))
        self.norm = np.sqrt(np.bincount(self.query, self.tf**2, len(self.ids)))


def _words(docs: DataFrame) -> DataFrame:
    """``doc_id, w``: hashes of the words of each text."""
    words = T.tokens(F.coalesce(F.col("text"), F.lit("")))
    return spread(docs.select("doc_id", "text")).select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("w"))


def _counted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, term, count)`` of the distinct terms of each text."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], flat[at], np.diff(np.append(at, len(flat)))


def _scores(asked: _Asked, lists: list[np.ndarray], mean: float, kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Scores of all texts of a batch for all queries of a block, by kind."""
    shape = (len(lists), len(asked.ids))
    text, term, tf = _counted(lists)
    size = np.array([len(x) for x in lists], float)
    norm = np.sqrt(np.bincount(text, tf.astype(float) ** 2, len(lists)))
    at = np.minimum(np.searchsorted(asked.terms, term), len(asked.terms) - 1)
    known = asked.terms[at] == term
    text, tf, at = text[known], tf[known].astype(float), at[known]
    damped = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[text] / mean))
    fan = asked.offsets[at + 1] - asked.offsets[at]
    shared, bm, dot = (np.zeros(shape[0] * shape[1]) for _ in range(3))
    ends = np.cumsum(fan)
    first = 0
    while first < len(at):  # products in parts of about CELLS
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, side="right")))
        n = fan[first:last]
        entry = np.repeat(np.arange(first, last), n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asked.offsets[at[first:last]], n)
        cell = text[entry] * shape[1] + asked.query[post]
        if "overlap" in kinds or "hybrid" in kinds:
            shared += np.bincount(cell, minlength=len(shared))
        if "bm25" in kinds:
            bm += np.bincount(cell, damped[entry] * asked.weight[post], len(bm))
        if "hybrid" in kinds:
            dot += np.bincount(cell, tf[entry] * asked.tf[post], len(dot))
        first = last
    shared, bm, dot = shared.reshape(shape), bm.reshape(shape), dot.reshape(shape)
    out = {"bm25": bm, "overlap": shared / asked.n_terms}
    if "hybrid" in kinds:
        cosine = dot / np.maximum(np.outer(norm, asked.norm), 1e-300)
        out["hybrid"] = np.where(shared > 0, 0.65 * (cosine + 1) / 2 + 0.35 * out["overlap"], 0.0)
    return {kind: np.round(out[kind], 6) for kind in kinds}


def _search(words: DataFrame, asked: _Asked, mean: float, k: int, kinds: tuple[str, ...]) -> DataFrame:
    """The best ``k`` rows of each batch for each query of a block and each kind of score, ties included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // len(asked.ids))
        for pdf in batches:
            for start in range(0, len(pdf), step):
                own, lists = pdf["doc_id"].to_numpy()[start : start + step], pdf["w"].tolist()[start : start + step]
                for kind, score in _scores(asked, lists, mean, kinds).items():
                    score[own[:, None] == asked.ids[None, :]] = -1
                    enough = np.partition(score, len(own) - k, axis=0)[len(own) - k] if len(own) > k else 0.0
                    d, q = np.nonzero((score > 0) & (score >= enough))
                    yield pd.DataFrame({"kind": kind, "query_id": asked.ids[q], "doc_id": own[d], "score": score[d, q]})

    return words.mapInPandas(run, "kind string, query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int, kinds: tuple[str, ...]) -> DataFrame:
    """``kind, query_id, doc_id, score, rank``: the best texts of each query text, never itself, by several scores in one pass.

    ``bm25``: Okapi BM25 of the query's whole text, query repeats count. ``overlap``: share of the
    query's distinct terms that a text holds. ``hybrid``: 0.65 of the cosine of term frequencies mapped
    to 0..1, and 0.35 of the overlap. Only scores above zero count; ties go by the id. Null texts have no
    words. Postings of the queries visit the driver in blocks of about ``POSTINGS_BLOCK``.
    """
    words = _words(docs)
    asked = _words(queries).select("doc_id", F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    mean = 1.0
    if "bm25" in kinds:
        frequency = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        size = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).first()
        mean = size["mean"] or 1.0
        raw = checkpointed(frequency.select("term", (F.log(F.lit(size["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
        usual = raw.agg(F.avg("raw")).first()[0] or 0.0
        asked = asked.join(raw, "term", "left").withColumn("idf", F.when(F.col("raw") >= 0, F.col("raw")).when(F.col("raw") < 0, EPSILON * usual).otherwise(0.0)).drop("raw")
    else:
        asked = asked.withColumn("idf", F.lit(0.0))
    asked = checkpointed(asked)
    parts = max(1, -(-asked.count() // POSTINGS_BLOCK))
    found = None
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part).toPandas()
        if len(rows):
            best = best_per(_search(words, _Asked(rows), mean, k, kinds), ["kind", "query_id"], "score", "doc_id", k)
            best = checkpointed(best) if parts > 1 else best
            found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.limit(0).select(F.lit("").alias("kind"), F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return found


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank`` by Okapi BM25, see :func:`search`."""
    return search(docs, queries, k, ("bm25",)).drop("kind")


def overlap(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank`` by the overlap of terms, see :func:`search`."""
    return search(docs, queries, k, ("overlap",)).drop("kind")


def hybrid_relevance(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, doc_id, score, rank`` by the hybrid of cosine and overlap, see :func:`search`."""
    return search(docs, queries, k, ("hybrid",)).drop("kind")


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float = 0.65, c: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two rank lists; absent from a list adds nothing."""
    weighted = lambda df, w: df.select("query_id", "doc_id", (F.lit(w) / (c + F.col("rank"))).alias("part"))
    both = weighted(dense, alpha).unionByName(weighted(sparse, 1 - alpha))
    scored = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"))
    return best_per(scored, "query_id", "score", "doc_id", k)


def vector_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the stated queries in blocks, each a bounded matrix."""
    for chosen in _blocks(queries.select("vec_id", "embedding"), block):
        matrix = np.stack(chosen["embedding"].to_numpy()).astype(np.float64)
        yield chosen["vec_id"].to_numpy(), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, similarity, rank`` by cosine, exact.

    Queries meet the rows in blocks of about ``block`` vectors, each a bounded matrix; of every
    batch of rows the best ``k`` for each query are kept before the shuffle.
    """
    result = None
    for ids, matrix in vector_blocks(queries, block):
        found = vectors.select("vec_id", "embedding").mapInPandas(_nearest(ids, matrix, k), "query_id long, vec_id long, similarity double")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    return best_per(result, "query_id", "similarity", "vec_id", k)


def dense_above(vectors: DataFrame, queries: DataFrame, above: float, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, similarity`` of all rows more similar than ``above``, exact and without a limit.

    They come straight from the blocks' matrix products; nothing is ranked or shuffled.
    """
    result = None
    for ids, matrix in vector_blocks(queries, block):
        found = vectors.select("vec_id", "embedding").mapInPandas(_all_above(ids, matrix, above), "query_id long, vec_id long, similarity double")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity"))
    return result


#: Rows that meet a block of query vectors at once where all above a threshold are wanted.
ROW_BLOCK = 1024


def _all_above(ids: np.ndarray, matrix: np.ndarray, above: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), ROW_BLOCK):
                part = pdf.iloc[start : start + ROW_BLOCK]
                own = part["vec_id"].to_numpy()
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sim = np.round(matrix @ x.T, 6)
                q, d = np.nonzero((sim > above) & (ids[:, None] != own[None, :]))
                yield pd.DataFrame({"query_id": ids[q], "vec_id": own[d], "similarity": sim[q, d]})

    return run


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["vec_id"].to_numpy()
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            sim = np.round(matrix @ x.T, 6)
            sim[ids[:, None] == own[None, :]] = -2
            order = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), order.shape[1])
            out = pd.DataFrame({"query_id": ids[rows], "vec_id": own[order.ravel()], "similarity": sim[rows, order.ravel()]})
            yield out[out["similarity"] > -2]

    return run


def mmr(candidates: DataFrame, vectors: DataFrame, weight: float = 0.6, k: int = 5) -> DataFrame:
    """Maximal marginal relevance over each query's few candidates: ``query_id, vec_id, position``.

    ``candidates`` (``query_id, vec_id, similarity``) are the bounded output of a top-k search.
    """
    rows = candidates.select("query_id", "vec_id", "similarity").join(vectors.select("vec_id", "embedding"), "vec_id")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "vec_id"], ascending=[False, True])
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        chosen = [0]
        while len(chosen) < min(k, len(x)):
            value = weight * pdf["similarity"].to_numpy() - (1 - weight) * (x @ x[chosen].T).max(axis=1)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "vec_id": pdf["vec_id"].to_numpy()[chosen], "position": range(len(chosen))})

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, position int")
