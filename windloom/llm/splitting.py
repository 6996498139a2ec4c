"""Splitting oversized texts at natural boundaries (problem 4).

The cut is one regular expression. A unit is a word with the white space after it; alternatives
ordered by boundary strength each consume as many units as the limit allows and then require
their boundary: the whole text, the rest of it, blank line, sentence end, line end, clause mark,
any word. Sizes in characters fall back to any character, and so do words beyond ``word_chars``
where that is given, for text without white space. The pieces' own parts add up to the text
exactly; the overlap is looked back from the part before with array functions.

Everything is one narrow pass in the JVM: texts are never shuffled, and rows don't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.session import spread

#: A word and the white space after it.
WORD = r"\S++\s*+"
CHARACTER = "."
#: Strongest first.
BOUNDARIES = {
    "paragraph": r"(?<=\n[ \t\r]{0,8}\n\s{0,8})",
    "sentence": r"(?<=[.!?…][\"'”’»)\]]{0,2}\s{1,8})",
    "line": r"(?<=\n[ \t]{0,8})",
    "clause": r"(?<=[,;:]\s{1,8})",
}


def cut_pattern(limit: int, overlap: int, unit: str = WORD) -> str:
    """Consumes a text of at most ``limit`` units whole, a longer one in parts that leave room for ``overlap`` units.

    A natural boundary is sought in the later half of a part.
    """
    most = limit - overlap
    least = max(1, most // 2)
    lead = "" if unit == CHARACTER else r"\s*+"
    alternatives = [rf"(?:{unit}){{1,{most}}}\z"]
    alternatives += [rf"(?:{unit}){{{least},{most}}}{mark}" for mark in BOUNDARIES.values()]
    alternatives += [rf"(?:{unit}){{1,{most}}}"]
    return rf"(?Us)\A{lead}(?:{unit}){{0,{limit}}}\z|{lead}(?:{'|'.join(alternatives)})"


def split_oversized(
    df: DataFrame, id_col: str, text_col: str, limit: int = 420, overlap: int = 40, unit: str = "words", word_chars: int | None = None
) -> DataFrame:
    """One row per piece: ``<id_col>, piece, n_pieces, start, own_chars, overlap_units, text``.

    ``unit`` is ``words`` or ``chars`` (code points). Pieces have at most ``limit`` units, of which
    all but the first repeat up to ``overlap`` units from the end of the part before. ``start`` is
    the offset of the part that is new in this piece and ``own_chars`` its length; the new parts add
    up to the text. A word is a run without white space of any length; with ``word_chars`` it is
    at most so long, and longer ones count as several.

    A text within the limit is one piece; an empty or blank one too. Null texts give no row.
    Rows are split one by one, so a row delivered twice gives its pieces twice. Other columns are
    not looked at.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    one = CHARACTER if unit == "chars" else WORD if word_chars is None else rf"\S{{1,{word_chars}}}+\s*+"
    items = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).filter("_text is not null")
    rows = items.select("_id", F.regexp_extract_all("_text", F.lit(cut_pattern(limit, overlap, one)), F.lit(0)).alias("_parts"))
    before = rows.withColumn(
        "_starts",
        F.aggregate(
            F.transform("_parts", F.length),
            F.array(F.lit(0)),
            lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
        ),
    )
    whole = F.lit(f"(?Us){one}")

    def piece(own: Column, k: Column) -> Column:
        tail = F.regexp_extract_all(F.element_at("_parts", F.greatest(k, F.lit(1))), whole, F.lit(0))
        kept = F.when((k > 0) & F.lit(overlap > 0), F.slice(tail, F.greatest(F.size(tail) - overlap + 1, F.lit(1)), overlap)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            (k + 1).alias("piece"),
            F.element_at("_starts", k + 1).alias("start"),
            F.length(own).alias("own_chars"),
            F.size(kept).alias("overlap_units"),
            F.concat(F.array_join(kept, ""), own).alias("text"),
        )

    # pieces are made before the explode, so that no row carries the whole text along
    cut = before.select("_id", F.size("_parts").alias("n_pieces"), F.explode(F.transform("_parts", piece)).alias("p"))
    return cut.select(F.col("_id").alias(id_col), "p.piece", "n_pieces", "p.start", "p.own_chars", "p.overlap_units", "p.text")


def found_oversized(pages: DataFrame, limit: int = 420, overlap: int = 40) -> DataFrame:
    """``page_id`` of the pages that the splitter cuts."""
    return split_oversized(pages, "page_id", "text", limit, overlap).filter("piece = 2").select("page_id").distinct()
