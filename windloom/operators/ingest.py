"""Incremental ingest: what is new, the registry of files, purging, and chunks with their parents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.functions import text as T


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def registry_upsert(registry: DataFrame) -> DataFrame:
    """The last registration of each file wins; ``filename, sha256, n_pages, registered_at``."""
    last = F.max(F.struct("registered_at", "sha256", "n_pages")).alias("last")
    return registry.groupBy("filename").agg(last).select("filename", "last.sha256", "last.n_pages", "last.registered_at")


def not_registered(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content isn't registered under any name: a renamed copy isn't new, an edited file is."""
    return files.join(registry.select("sha256").filter("sha256 is not null").distinct(), "sha256", "left_anti")


def purge(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose ``source`` isn't among ``sources``."""
    return df.join(sources.select("source").distinct(), "source", "left_anti")


def audit(pages: DataFrame) -> DataFrame:
    """``source, reason, n_pages``: why texts of a source should be read again."""
    distinct = pages.select("page_id", "source", F.explode(T.text_faults(F.col("text"))).alias("reason")).distinct()
    return distinct.groupBy("source", "reason").agg(F.count("*").alias("n_pages"))


#: Words between ASCII white space, as in :func:`windloom.functions.text.white_split`.
_WORDS = re.compile(r"[^ \t\n\r\f]+")


def chunk_fold(sentences: list[str], target: int, most: int, overlap: int, least: int = 5) -> list[str]:
    """Sentences gathered up to ``target`` words, the last ``overlap`` of them carried over.

    No chunk has more than ``most`` words: less is carried over where it would not fit beside the
    next sentence, and a longer sentence is cut. Together the chunks hold every word, but for a
    text of less than ``least`` words.
    """
    out: list[str] = []
    buffer: list[list[str]] = []
    words = fresh = 0
    for s in sentences:
        every = _WORDS.findall(s)
        for k in range(0, len(every), most):
            piece = every[k : k + most]
            if fresh and words + len(piece) > min(target, most):
                out.append(" ".join(w for x in buffer for w in x))
                buffer = buffer[-overlap:] if overlap else []
                words, fresh = sum(map(len, buffer)), 0
                while buffer and words + len(piece) > most:
                    words -= len(buffer.pop(0))
            buffer.append(piece)
            words += len(piece)
            fresh += 1
    if fresh and (out or words >= least):
        out.append(" ".join(w for x in buffer for w in x))
    return out


def chunks(df: DataFrame, id_col: str, text_col: str, target: int = 300, most: int = 420, overlap: int = 2) -> DataFrame:
    """``<id>, chunk, n_words, text``: sentences accumulated into overlapping chunks.

    The state (buffer, words) of the fold is kept within one text, in Arrow batches. Null texts
    and texts without a sentence give no row.
    """
    rows = df.select(F.col(id_col).alias("_id"), T.protected_sentences(F.col(text_col)).alias("_s")).filter("_s is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, len(_WORDS.findall(c)), c) for i, s in zip(pdf["_id"], pdf["_s"]) for k, c in enumerate(chunk_fold(list(s), target, most, overlap))]
            yield pd.DataFrame(out, columns=["_id", "chunk", "n_words", "text"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, chunk int, n_words int, text string").withColumnRenamed("_id", id_col)


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with the text of their parent, their own where there is none."""
    p = parents.select(F.col("parent_id").alias("_p"), F.col("text").alias("_parent_text")).dropDuplicates(["_p"])
    return children.join(p, F.col("parent_id") == F.col("_p"), "left").withColumn("context", F.coalesce("_parent_text", "text")).drop("_p", "_parent_text")
