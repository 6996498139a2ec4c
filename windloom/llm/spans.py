"""Long exact spans shared between records (problem 8).

Texts are cut into variable chunks where a gear rolling hash of the last ``GEAR`` characters is
the least of a window of ``WINDOW`` positions, so cuts depend on the text around them alone and
resist shifts. A chunk's digest covers the chunk with a fixed margin on both sides. The sizes
are chosen so that a shared span of ``span`` characters always holds one common chunk with its
margins, whatever stands around it: no shared span is missed.

Digests are aggregated with map-side combination; those of more than one text are kept, and the
chunks meet them in a semi join, so that no task gathers the chunks of a digest. Common chunks of
a pair of texts at one displacement make a stretch that is shared for certain; a stretch that
might or might not reach the required length is settled on the texts themselves.

How much of a text is shared is found without pairs: around its common chunks every window of
``span`` characters gets a digest, and the windows whose digest another text has too cover what
is shared, however many texts have it.

Exact copies are one text: only one record of a group of copies is chunked, so that a large
group makes no hot digest, and pairs are spread to the copies at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windloom.llm.packing import slices
from windloom.session import broadcast_if_small, checkpointed, spread

SPAN = 300
GEAR = 16
#: Least span the chunk sizes can serve.
LEAST_SPAN = 60
_MULTIPLIER = 0x9E3779B97F4A7C15


def sizes(span: int) -> tuple[int, int, int]:
    """``(window, left, right)``: cut window and digest margins that guarantee a common chunk.

    In a shared span, hashes from offset ``GEAR - 1`` on are equal, and cuts from
    ``GEAR - 1 + window - 1`` to ``span - window`` too, for each window over them lies in the
    span. That stretch must hold two windows; the margins then fit on either side.
    """
    if span < LEAST_SPAN:
        raise ValueError(f"span must be at least {LEAST_SPAN}")
    window = (span - GEAR + 2) // 4
    return window, GEAR + window - 2, window - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(_MULTIPLIER)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(code: np.ndarray, owner_end: np.ndarray, window: int) -> np.ndarray:
    """Sorted cut positions in concatenated code points; ``owner_end``: where each text ends."""
    n = len(code)
    gear = (_mix(code.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < GEAR:  # h(i) = sum of gear(i - j) << j for j < GEAR, by doubling
        shifted = np.zeros_like(gear)
        shifted[step:] = gear[:-step] << np.uint32(step)
        gear = gear + shifted
        step *= 2
    # least hash, the rightmost of equals
    key = (gear.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    least, width = key, 1
    while width < window:
        add = min(width, window - width)
        least = np.minimum(least[: len(least) - add], least[add:])
        width += add
    start = np.concatenate([[0], owner_end[:-1]])
    # windows [i, i + window) of hashes that lie in one text
    first, last = start + GEAR - 1, owner_end - window
    mark = np.zeros(n + 1, np.int32)
    there = last >= first
    np.add.at(mark, first[there], 1)
    np.add.at(mark, last[there] + 1, -1)
    inside = np.cumsum(mark[: len(least)]) > 0
    at = (np.uint64(0xFFFFFFFF) - (least[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    if not len(at):
        return at
    return np.unique(at)


class _Digests:
    """Digests of any stretches of code points, from prefix sums of a polynomial."""

    def __init__(self, code: np.ndarray):
        value = _mix(code.astype(np.uint64) + np.uint64(1))
        base = np.uint64(_MULTIPLIER | 1)
        power = np.cumprod(np.full(len(code), base, np.uint64), dtype=np.uint64)
        self.undo = np.cumprod(np.full(len(code), np.uint64(pow(_MULTIPLIER | 1, -1, 1 << 64)), np.uint64), dtype=np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(value * power, dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[hi] - self.prefix[lo]) * self.undo[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def chunk_digests(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, digest, start, length)`` of the chunks with their margins, in code points."""
    window, left, right = sizes(span)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    none = np.zeros(0, np.int64)
    if len(code) < window + GEAR:
        return none, none, none, none
    cut = cuts(code, ends, window)
    if len(cut) < 2:
        return none, none, none, none
    owner = np.searchsorted(ends, cut, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    a, b, o = cut[:-1], cut[1:], owner[:-1]
    lo, hi = a - left, b + right + 1
    keep = (owner[:-1] == owner[1:]) & (lo >= begin[o]) & (hi <= ends[o])
    a, o, lo, hi = a[keep], o[keep], lo[keep], hi[keep]
    return o, _Digests(code).of(lo, hi), lo - begin[o], hi - lo


#: Longer texts are chunked in overlapping stretches of this size, to bound memory.
STRETCH = 1_000_000


def _chunker(span: int):
    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        overlap = 4 * span
        for pdf in batches:
            for part in slices(pdf["text"]):
                own = pdf.iloc[part]
                texts, ids, offsets = [], [], []
                for i, t in zip(own["id"].tolist(), own["text"].tolist()):
                    for offset in range(0, max(1, len(t) - overlap), STRETCH):
                        texts.append(t[offset : offset + STRETCH + overlap])
                        ids.append(i)
                        offsets.append(offset)
                for first in range(0, len(texts), 1 if len(texts) > len(own) else len(texts)):
                    last = first + (1 if len(texts) > len(own) else len(texts))
                    owner, digest, start, length = chunk_digests(texts[first:last], span)
                    start = start + np.array(offsets[first:last], np.int64)[owner]
                    yield pd.DataFrame({"digest": digest, "id": np.array(ids[first:last], np.int64)[owner], "start": start.astype(np.int32), "length": length.astype(np.int32)})

    return chunk


def window_digests(text: str, regions: list[tuple[int, int]], span: int) -> tuple[np.ndarray, np.ndarray]:
    """``(digest, start)`` of every window of ``span`` code points that lies in a union of neighbouring regions."""
    digests, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    merged: list[list[int]] = []
    for lo, hi in sorted(regions):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    for lo, hi in merged:
        lo, hi = max(0, lo), min(len(text), hi)
        for first in range(lo, hi - span + 1, STRETCH):
            part = text[first : min(hi, first + STRETCH + span - 1)]
            at = np.arange(len(part) - span + 1)
            digests.append(_Digests(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)).of(at, at + span))
            starts.append(at + first)
    return np.concatenate(digests), np.concatenate(starts)


def _windows(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text, regions in zip(pdf["id"], pdf["text"], pdf["regions"]):
                digest, start = window_digests(text, [(r["lo"], r["hi"]) for r in regions], span)
                yield pd.DataFrame({"digest": digest, "id": i, "s": start.astype(np.int32)})

    return run


def common_runs(a: str, b: str, shift: int, first: int, last: int) -> np.ndarray:
    """The stretches of ``a`` that touch ``[first, last)`` and equal ``b`` at ``shift``: rows of start and end in ``a``."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    x = np.frombuffer(a[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b[lo - shift : hi - shift].encode("utf-32-le", "surrogatepass"), np.uint32)
    differ = np.concatenate([[-1], np.flatnonzero(x != y), [len(x)]])
    near = (differ[1:] > first - lo) & (differ[:-1] < last - lo)
    return lo + np.stack([differ[:-1][near] + 1, differ[1:][near]], axis=1)


def longest_common(a: str, b: str, shift: int, first: int, last: int) -> tuple[int, int]:
    """The longest of :func:`common_runs`."""
    runs = common_runs(a, b, shift, first, last)
    k = int(np.argmax(runs[:, 1] - runs[:, 0]))
    return int(runs[k, 0]), int(runs[k, 1])


def _verifier(span: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [common_runs(*r) for r in zip(pdf["text_a"], pdf["text_b"], pdf["shift"], pdf["first"], pdf["last"])]
            found = [runs[runs[:, 1] - runs[:, 0] >= span] for runs in found]
            out = pdf[["a", "b", "shift"]].loc[pdf.index.repeat([len(runs) for runs in found])].copy()
            out["start_a"], out["end_a"] = np.concatenate([np.zeros((0, 2), np.int64), *found]).T
            yield out

    return verify


class SharedSpans:
    """Spans of ``span`` or more code points that texts of different records have in common.

    Null ids and null texts are left out; texts shorter than ``span`` can't share one. A row
    delivered twice (same id) counts once. Other columns are not looked at. An empty table
    gives empty results.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, span: int = SPAN):
        self.span = span
        sizes(span)
        self.docs = (
            docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .filter("id is not null and text is not null")
            .filter(F.length("text") >= span)
        )
        keys = self.docs.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.reverse("text"), F.lit(3)).alias("h2"), F.length("text").alias("n"))
        keys = keys.groupBy("id").agg(*[F.min(c).alias(c) for c in ("h1", "h2", "n")])
        groups = keys.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
        #: ``id, rep``: the records whose text is that of others too; ``rep`` is the least id of them.
        self.copies = checkpointed(keys.join(groups, ["h1", "h2", "n"]).select("id", "rep", "copies"))
        others = broadcast_if_small(self.copies.filter("id <> rep").select("id"))
        #: One record of each text.
        self.texts = spread(self.docs).join(others, "id", "left_anti")

    @staticmethod
    def _of_several(rows: DataFrame) -> DataFrame:
        """The rows (``digest, id, ..``) whose digest rows of another id have too.

        Least and largest id are combined on the map side and the rows are only filtered, so a digest
        that very many texts have may be split among tasks. ``rows`` is computed twice.
        """
        digests = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("digest")
        return rows.join(broadcast_if_small(checkpointed(digests)), "digest", "left_semi")

    def common_chunks(self) -> DataFrame:
        """Chunks that occur in more than one text: ``digest, id, start, length``."""
        chunks = self.texts.mapInPandas(_chunker(self.span), "digest long, id long, start int, length int")
        return self._of_several(chunks).distinct()

    def stretches(self) -> DataFrame:
        """Per pair of texts ``a < b`` and displacement: extent of the common chunks in ``a``.

        ``solid`` when the chunks overlap without a gap, so that the extent is shared as a whole.
        """
        c = checkpointed(self.common_chunks())
        x, y = c.alias("x"), c.alias("y")
        pair = x.join(y, (F.col("x.digest") == F.col("y.digest")) & (F.col("x.id") < F.col("y.id")))
        margin = sum(sizes(self.span)[1:]) + 1
        gathered = (
            pair.select(
                F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.start") - F.col("y.start")).alias("shift"), F.col("x.start").alias("s"), F.col("x.length").alias("l")
            )
            .groupBy("a", "b", "shift")
            .agg(F.min("s").alias("first"), F.max(F.col("s") + F.col("l")).alias("last"), F.sum(F.col("l") - margin).alias("cut"))
        )
        # consecutive chunks share a cut: their own lengths and the margins once add up to the extent
        return gathered.withColumn("solid", F.col("cut") + margin == F.col("last") - F.col("first"))

    def spans(self, stretches: DataFrame) -> DataFrame:
        """``a, b, shift, start_a, end_a``: every exact span of each stretch, from the texts."""
        wanted = broadcast_if_small(checkpointed(stretches.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        some = self.texts.join(wanted, "id", "left_semi")
        text = lambda c: some.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
        both = stretches.select("a", "b", "shift", "first", "last").join(text("a"), "a").join(text("b"), "b")
        return both.mapInPandas(_verifier(self.span), "a long, b long, shift int, start_a int, end_a int")

    def text_pairs(self) -> DataFrame:
        """Distinct ``a, b`` of texts that share a span."""
        all_of = checkpointed(self.stretches())
        sure = all_of.filter(F.col("solid") & (F.col("last") - F.col("first") >= self.span)).select("a", "b").distinct()
        # beyond the outer chunks a span reaches less than a window on either side
        window = sizes(self.span)[0]
        open_ = all_of.filter(F.col("last") - F.col("first") + 2 * window >= self.span).join(sure, ["a", "b"], "left_anti")
        return sure.unionByName(self.spans(open_).select("a", "b")).distinct()

    def record_pairs(self) -> DataFrame:
        """Distinct ``doc_a < doc_b`` of records that share a span, copies of a text included."""
        members = self.copies.select(F.col("rep"), F.col("id").alias("member"))
        pairs = self.text_pairs()
        for c in ("a", "b"):
            pairs = pairs.join(members.withColumnsRenamed({"rep": f"rep_{c}", "member": f"member_{c}"}), F.col(c) == F.col(f"rep_{c}"), "left").withColumn(
                f"of_{c}", F.coalesce(f"member_{c}", c)
            )
        across = pairs.select(F.least("of_a", "of_b").alias("doc_a"), F.greatest("of_a", "of_b").alias("doc_b"))
        p, q = members.alias("p"), members.alias("q")
        within = p.join(q, (F.col("p.rep") == F.col("q.rep")) & (F.col("p.member") < F.col("q.member"))).select(
            F.col("p.member").alias("doc_a"), F.col("q.member").alias("doc_b")
        )
        return across.unionByName(within).distinct()

    def shared_windows(self) -> DataFrame:
        """``id, s``: where in a text the windows of ``span`` characters begin that another text has too."""
        window = sizes(self.span)[0]
        # beyond its outer common chunks a shared span reaches less than a window on either side
        region = F.struct((F.col("start") - window).alias("lo"), (F.col("start") + F.col("length") + window).alias("hi"))
        regions = checkpointed(self.common_chunks().groupBy("id").agg(F.collect_set(region).alias("regions")))
        some = self.texts.join(broadcast_if_small(regions.select("id")), "id", "left_semi")
        windows = some.join(regions, "id").mapInPandas(_windows(self.span), "digest long, id long, s int")
        return self._of_several(windows).select("id", "s").distinct()

    def shared_parts(self) -> DataFrame:
        """Per text that shares spans: ``id, copies, n_chars, shared_chars, n_spans``, without forming a pair.

        ``id`` stands for its ``copies``. A text with copies is shared as a whole.
        """
        order = Window.partitionBy("id").orderBy("s")
        reach = F.lag("s").over(order) + self.span
        new = self.shared_windows().withColumn("reach", F.coalesce(reach, F.lit(-1)))
        covered = new.groupBy("id").agg(
            F.sum(F.col("s") + self.span - F.greatest("s", "reach")).alias("covered"), F.count_if(F.col("s") > F.col("reach")).alias("n_spans")
        )
        reps = self.copies.filter("id = rep").select("id", "copies")
        sizes_ = self.texts.select("id", F.length("text").cast("long").alias("n_chars"))
        return (
            sizes_.join(covered.join(reps, "id", "full_outer"), "id")
            .select(
                "id",
                F.coalesce("copies", F.lit(1)).alias("copies"),
                "n_chars",
                F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("covered")).alias("shared_chars"),
                F.when(F.col("copies") > 1, F.lit(1)).otherwise(F.col("n_spans")).alias("n_spans"),
            )
            .distinct()
        )

    def passages(self) -> DataFrame:
        """``id, start, n_chars, digest``: every stretch of every record that other records have too, from character ``start`` on.

        Unlike :meth:`shared_parts` it has the passages themselves, by place and digest, and a row for each
        of the copies of a text, which share it as a whole. Windows that touch or overlap are one stretch.
        """
        order = Window.partitionBy("id").orderBy("s")
        new = self.shared_windows().join(broadcast_if_small(self.copies.select("id")), "id", "left_anti")  # copies are shared as a whole
        new = new.withColumn("k", F.sum(F.coalesce((F.col("s") > F.lag("s").over(order) + self.span).cast("int"), F.lit(1))).over(order))
        parts = new.groupBy("id", "k").agg(F.min("s").alias("start"), (F.max("s") + self.span).alias("end"))
        some = checkpointed(parts.select("id", "start", (F.col("end") - F.col("start")).alias("n_chars")))
        cut = self.docs.join(broadcast_if_small(some), "id").select("id", "start", "n_chars", F.md5(F.substring("text", F.col("start") + 1, F.col("n_chars"))).alias("digest"))
        whole = self.docs.join(broadcast_if_small(self.copies.select("id")), "id", "left_semi")
        whole = whole.select("id", F.lit(0).alias("start"), F.length("text").alias("n_chars"), F.md5("text").alias("digest")).distinct()
        return cut.distinct().unionByName(whole)

    def links(self) -> DataFrame:
        """``id, n_links``: of every record that shares a span, how many other records it shares one with, copies included."""
        pairs = self.record_pairs()
        return pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))


def found_pairs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    return SharedSpans(docs, "doc_id", "text", span).record_pairs()
