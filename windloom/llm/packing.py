"""Filling fixed-capacity containers with items (problem 6).

Each text becomes a hashed vector of its words, projected to three dimensions; the position
along a Hilbert curve through that space is the sort key. Texts are range-partitioned and
sorted by the key, and each partition is packed in one streaming pass: neighbours along the
curve share containers, so a container holds related texts. A window of neighbours is packed
best-fit decreasing into the open containers and new ones; a bounded number of containers
stays open for the following windows. Only ids, sizes and keys are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.llm.tokens import wordpunct_count
from windloom.session import spread

VECTOR = 1024
DIMENSIONS = 3
BITS = 10
WINDOW = 512
OPEN = 256


def word_vectors(texts: list[str], size: int = VECTOR) -> np.ndarray:
    """Hashed word counts, damped by log and normalised; one row per text."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(d) + 1 for d in data])
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    out = np.zeros((len(texts), size), np.float32)
    if not len(raw):
        return out
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return out
    # polynomial hash of a word from prefix sums; the base is odd, so that its powers can be undone
    power = np.cumprod(np.full(len(raw), 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + 1) * power, dtype=np.uint64)])
    undo = np.cumprod(np.full(len(raw), pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), np.uint64), dtype=np.uint64)
    code = (prefix[end] - prefix[start]) * undo[start]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (code >> np.uint64(40)) % np.uint64(size)
    owner = np.searchsorted(np.cumsum(lengths), start, side="right")
    counts = np.bincount(owner * size + bucket.astype(np.int64), minlength=len(texts) * size)
    out = np.log1p(counts.reshape(len(texts), size).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def hilbert_key(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer coordinates (Skilling's transform)."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def slices(texts: pd.Series, chars: int = 500_000) -> Iterator[slice]:
    """Cut a batch where its texts add up to about ``chars`` characters, to bound memory."""
    size, first = 0, 0
    for k, n in enumerate(texts.str.len().tolist()):
        size += n
        if size >= chars:
            yield slice(first, k + 1)
            size, first = 0, k + 1
    if first < len(texts):
        yield slice(first, len(texts))


def curve_position(texts: list[str]) -> np.ndarray:
    projection = np.random.default_rng(20240607).normal(size=(VECTOR, DIMENSIONS)).astype(np.float32)
    points = word_vectors(texts) @ projection
    # each coordinate of a unit vector is about standard normal: its rank under that law is uniform
    grid = np.clip(1 / (1 + np.exp(-1.702 * points)) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(grid)


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in slices(pdf["text"]):
            yield pd.DataFrame({"id": pdf["id"].iloc[part], "tokens": pdf["tokens"].iloc[part], "key": curve_position(pdf["text"].iloc[part].tolist())})


class Containers:
    """Open containers of one partition, by free space."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.free = capacity, first, []  # free: sorted (space, container)

    def place(self, size: int) -> int:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, container = self.free.pop(at)
        else:
            space, container = self.capacity, self.next
            self.next += 1
        if space > size:
            insort(self.free, (space - size, container))
        return container

    def close_fullest(self, most: int) -> None:
        del self.free[: max(0, len(self.free) - most)]


def _packer(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        containers = Containers(capacity, TaskContext.get().partitionId() << 40)
        waiting: list[tuple] = []

        def flush() -> pd.DataFrame:
            waiting.sort(key=lambda r: (-r[2], r[0], r[1]))
            rows = [(i, piece, tokens, containers.place(tokens)) for i, piece, tokens in waiting]
            waiting.clear()
            containers.close_fullest(OPEN)
            return pd.DataFrame(rows, columns=["id", "piece", "tokens", "container"])

        for pdf in batches:
            for i, tokens in zip(pdf["id"].tolist(), pdf["tokens"].tolist()):
                whole, rest = divmod(tokens, capacity)
                sizes = [capacity] * whole + [rest] * (rest > 0 or not whole)
                waiting.extend((i, k, s) for k, s in enumerate(sizes, 1))
                if len(waiting) >= WINDOW:
                    yield flush()
        if waiting:
            yield flush()

    return pack


def pack_containers(docs: DataFrame, id_col: str, text_col: str, capacity: int = 1024, partitions: int | None = None) -> DataFrame:
    """``<id_col>, piece, start_token, tokens, container``: where each item goes.

    Sizes are WordPunct tokens of the text. An item larger than ``capacity`` is divided into full
    containers and a rest; no other item is divided. Null and empty texts have no tokens and
    take no room, but a row all the same. A row delivered twice (same id) is packed once. Null
    ids are left out: what can't be named can't be placed. Other columns are not looked at.
    ``partitions`` are packed apart from each other; each may leave its last containers part full.
    """
    items = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).filter("id is not null")
    sized = items.withColumn("tokens", wordpunct_count(F.col("text")).cast("long"))
    id_type = items.schema["id"].dataType.simpleString()
    keyed = sized.mapInPandas(_positions, f"id {id_type}, tokens long, key long").groupBy("id").agg(F.max("tokens").alias("tokens"), F.min("key").alias("key"))
    by = [F.col("key"), F.col("id")]
    ordered = (keyed.repartitionByRange(partitions, *by) if partitions else keyed.repartitionByRange(*by)).sortWithinPartitions(*by)
    packed = ordered.select("id", "tokens").mapInPandas(_packer(capacity), f"id {id_type}, piece int, tokens long, container long")
    return packed.select(
        F.col("id").alias(id_col), "piece", ((F.col("piece") - 1) * F.lit(capacity)).cast("long").alias("start_token"), "tokens", "container"
    )


def found_divided(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """``doc_id`` of the items that the packer divided."""
    return pack_containers(docs, "doc_id", "text", capacity).filter("piece = 2").select("doc_id").distinct()
