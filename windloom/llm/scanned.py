"""Noise in text from scanned pages (problem 5).

Lines are labelled header, body or break by a hidden Markov model over their layout: the shape of
the line and where it stands on its page. What running headers and page numbers look like is
learned: an edge line that recurs on pages of its source once its digits are masked is a header,
and the rates of the shapes among recurring and other edge lines are the first emissions. The
model then labels all pages, and the counts of what it met there give emissions
and transitions (Viterbi training from the first model as the prior). Labelled pages are put
together again as paragraphs.

Words divided at a line end are joined if the corpus writes the word without a hyphen. A word is
misread if a far commoner word looks the same to a scanner, that is, if both have the same key
after letters and pairs of letters that are taken for each other are made equal.

Scale: texts are read in narrow passes and never shuffled. Word counts are a shuffled aggregate
with map-side combination. The tables of misread and of divided words meet the pages as a
dictionary while they are small by their bytes, and by joins on words beyond.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.llm.encoding import READ_AS, SINGLE, byte_of
from windloom.session import checkpointed, spread

HEADER, BODY, BREAK = range(3)
#: Different pages of one source on which a masked edge line must recur to count as a header in training.
RECURS = 3
#: A misread word is so many times rarer than what it is taken for, which occurs so often at least; parts of a compound are so many times commoner than it is divided.
RARER, COMMON = 20, 20
#: Observations that the first model's odds and moves count for.
PRIOR = 50.0
#: Bound on the bytes of words in a dictionary that is sent to the tasks.
DICTIONARY_BYTES = 32 << 20


def _misread_sign(sign: str) -> set[str]:
    """A sign as the encoding pairs of problem 2 make it look."""
    seen = set()
    for read in READ_AS:
        of = {b: c for c, b in byte_of(read).items()}
        if all(b in of for b in sign.encode()):
            seen.add("".join(of[b] for b in sign.encode()))
    for true, read in SINGLE:
        of = {b: c for c, b in byte_of(read).items()}
        try:
            seen.add(of[sign.encode(true)[0]])
        except (UnicodeEncodeError, KeyError):
            pass
    seen.add(sign.encode().decode("gbk", "replace"))
    return {x for x in seen if not x.isspace()}


#: Marks of division at a line end: hyphens, the soft hyphen, what a scanner takes them for, and what they are when wrongly decoded.
SIGNS = {"-", "\u00ad", "‐", "¬"} | _misread_sign("\u00ad") | _misread_sign("‐")
HYPHENS = "(?:" + "|".join(sorted(map(re.escape, SIGNS), key=lambda x: (-len(x), x))) + "|Â(?=\n))"

_NUMBER = r"(?:[-–—~]\s*)?(?:(?:Page|page|PAGE|p\.|S\.|Seite|pág\.)\s*)?\d{%s}(?:\s*[-–—~])?"
_CAPS = r"(?=[^\na-z]*?[^\W\d_a-z]{2})[^\na-z]{3,}?"
#: Shapes of lines in order of trial; the same patterns serve Python and Java. Page numbers have as many digits as the file needs;
#: where a long one stands alone it is a shape of its own, for it is a measured value in most corpora.
SHAPES = {
    "blank": r"[ \t\r\f]*",
    "number": rf"[ \t]*{_NUMBER % '1,4'}[ \t]*",
    "long_number": rf"[ \t]*{_NUMBER % '5,'}[ \t]*",
    "roman": r"[ \t]*[ivxlc]{1,7}[ \t]*",
    "caps_number": rf"[ \t]*(?:{_CAPS}(?: {{3,}}|\t+)\d+|\d+(?: {{3,}}|\t+){_CAPS})[ \t]*",
    "title_number": r"[ \t]*[^\W\d_a-z][^\n.;:|]{2,}(?: [–—-] \d+| \| [^\n.|]{2,} \d+)[ \t]*",
    "caps": rf"[ \t]*{_CAPS}[ \t]*",
    "sentence": r"[^\n]*[.!?:;,”\"’)][ \t]*",
    "other": r"[^\n]*",
}
FURNITURE = ("number", "long_number", "roman", "caps_number", "title_number", "caps")
PLACES = ("edge", "inside", "column", "decorated")
_LINE = re.compile("(?m)^(?:" + "|".join(f"(?P<{k}>{p})" for k, p in SHAPES.items()) + r")(?:\n|\Z)")
_NUMERIC = re.compile(r"[\d.,;|\s/+-]*")
#: First P(next state | state); a header is followed by text, rarely by another header.
FIRST_MOVES = ((0.02, 0.68, 0.30), (0.01, 0.84, 0.15), (0.03, 0.90, 0.07))
#: First log odds of a header for shapes that no edge line has, and in favour of where headers stand.
UNLIKE_HEADER, STANDS_OUT = -12.0, 3.0
#: A blank line is a break and nothing else is.
NEVER = -1e6


def shape_sql(line: Column) -> Column:
    out = None
    for name, pattern in SHAPES.items():
        rule = line.rlike(f"\\A(?:{pattern})\\z".replace(r"[^\W\d_a-z]", r"[\p{L}&&[^a-z]]"))
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise("other")


def edge_rates(df: DataFrame, source_col: str, text_col: str) -> dict[str, float]:
    """Log odds of each shape among recurring edge lines against other edge lines, over all pages; a text that a source has again and again counts once."""
    text = F.col(text_col)
    first = F.regexp_extract(text, r"\A\s*([^\n]*?)[ \t\r]*(?:\n|\z)", 1)
    last = F.substring_index(F.rtrim(text, F.lit(" \t\r\n\f")), "\n", -1)
    lines = df.filter(text.isNotNull()).select(
        F.col(source_col).alias("source"), F.xxhash64(text).alias("page"), F.explode(F.array(F.struct(F.lit(0).alias("edge"), F.trim(first).alias("line")), F.struct(F.lit(1).alias("edge"), F.trim(last).alias("line")))).alias("x")
    ).select("source", "page", "x.edge", "x.line").filter("length(line) > 0")
    masked = F.regexp_replace(F.regexp_replace("line", r"\d+", "9"), r"\b[ivxlc]+\b", "i")
    # copies of a page make every line of it recur: the more copies, the less a recurring line would tell
    once = lines.groupBy(F.xxhash64("source", F.col("source").isNull()).alias("source"), shape_sql(F.col("line")).alias("shape"), F.xxhash64(masked).alias("masked"), "page", "edge").agg(F.lit(1).alias("one"))
    groups = once.groupBy("source", "shape", "masked").agg(F.count("*").alias("n"))
    rows = groups.groupBy("shape").agg(F.sum(F.when(F.col("n") >= RECURS, F.col("n")).otherwise(0)).alias("again"), F.sum("n").alias("n")).collect()
    again, all_ = sum(r["again"] for r in rows) + 1, sum(r["n"] for r in rows) + 1
    out = {}
    for r in rows:  # at most one row per shape
        out[r["shape"]] = math.log(((r["again"] + 0.5) / again) / ((r["n"] - r["again"] + 0.5) / (all_ - again + 1)))
    return out


class Lines:
    """The hidden Markov model over the lines of a page.

    ``rates`` are log odds of the shapes among edge lines; ``met`` are counts of labelled pages,
    ``(before, state, shape, place)`` to the number of lines.
    """

    def __init__(self, rates: dict[str, float], met: dict[tuple[int, int, str, str], int] | None = None):
        self.rates = {k: rates.get(k, 0.0) if k in FURNITURE else UNLIKE_HEADER for k in SHAPES}
        # bare capitals are headings inside a page, and a header only where the corpus says so
        self.rates["caps"] = min(self.rates["caps"], 0.0)
        moves = [[PRIOR * p for p in row] for row in FIRST_MOVES]
        lines: dict[tuple[str, str], list[int]] = {}
        total = [0, 0]
        for (before, state, shape, place), n in (met or {}).items():
            if before >= 0:
                moves[before][state] += n
            if state != BREAK:
                lines.setdefault((shape, place), [0, 0])[state] += n
                total[state] += n
        self.move = [[math.log(p / sum(row)) for p in row] for row in moves]
        self.odds = {}
        for shape in SHAPES:
            for place in PLACES:
                header, body = lines.get((shape, place), (0, 0))
                seen = math.log((header + 0.5) / (total[0] + 1)) - math.log((body + 0.5) / (total[1] + 1))
                n = header + body
                self.odds[shape, place] = (n * seen + PRIOR * self._first(shape, place)) / (n + PRIOR)

    def _first(self, shape: str, place: str) -> float:
        if place == "column":
            return UNLIKE_HEADER
        odds = self.rates[shape]
        if place == "edge" or shape in ("caps_number", "title_number"):
            odds += STANDS_OUT
        if place == "decorated" or (shape == "roman" and place != "edge"):
            odds += STANDS_OUT
        return odds

    def places(self, text: str) -> list[tuple[int, int, str, str]]:
        """``(start, end, shape, place)`` of every line.

        A place is the ``edge`` of the page or ``inside`` it; a bare number among numbers or not apart
        inside a page is in a ``column``, and one with signs around it inside a page ``decorated``.
        """
        lines = [(m.start(), m.end(), m.lastgroup) for m in _LINE.finditer(text)]
        if lines and lines[-1][0] == lines[-1][1] == len(text) and len(lines) > 1:
            lines.pop()
        full = [k for k, x in enumerate(lines) if x[2] != "blank"]
        edge = {full[0], full[-1]} if full else set()
        out = []
        for j, k in enumerate(full):
            s, e, shape = lines[k]
            place = "edge" if k in edge else "inside"
            if shape in ("roman", "number", "long_number"):
                if shape == "roman" or text[s:e].strip().isdigit():  # a column of numbers is a table; inside a page a number stands apart
                    near = [full[i] for i in (j - 1, j + 1) if 0 <= i < len(full)]
                    apart = (k and lines[k - 1][2] == "blank") or (k + 1 < len(lines) and lines[k + 1][2] == "blank")
                    if any(_NUMERIC.fullmatch(text[lines[i][0] : lines[i][1]]) for i in near) or not (k in edge or apart or shape == "roman"):
                        place = "column"
                elif place == "inside":
                    place = "decorated"
            out.append(place)
        at = iter(out)
        return [(s, e, shape, "blank" if shape == "blank" else next(at)) for s, e, shape in lines]

    def label(self, text: str) -> list[tuple[int, int, int, str]]:
        """``(start, end, state, shape)`` of every line."""
        return [(s, e, state, shape) for s, e, state, shape, _ in self.labelled(text)]

    def labelled(self, text: str) -> list[tuple[int, int, int, str, str]]:
        lines = self.places(text)
        return [(s, e, st, shape, place) for (s, e, shape, place), st in zip(lines, self.states([(x[2], x[3]) for x in lines]))]

    def states(self, kinds: list[tuple[str, str]]) -> list[int]:
        """The likeliest labels of lines of ``(shape, place)``; of equals the first."""
        (hh, hb, hk), (bh, bb, bk), (kh, kb, kk) = self.move
        h, b, k = 0.0, 0.0, -1.0
        back = []
        for kind in kinds:
            x, y, z = h + hh, b + bh, k + kh
            to_h = (0 if x >= z else 2) if x >= y else (1 if y >= z else 2)
            best_h = (x, y, z)[to_h]
            x, y, z = h + hb, b + bb, k + kb
            to_b = (0 if x >= z else 2) if x >= y else (1 if y >= z else 2)
            best_b = (x, y, z)[to_b]
            x, y, z = h + hk, b + bk, k + kk
            to_k = (0 if x >= z else 2) if x >= y else (1 if y >= z else 2)
            best_k = (x, y, z)[to_k]
            if kind[0] == "blank":
                h, b, k = best_h + NEVER, best_b + NEVER, best_k
            else:
                h, b, k = best_h + self.odds[kind], best_b, best_k + NEVER
            back.append((to_h, to_b, to_k))
        state = (0 if h >= k else 2) if h >= b else (1 if b >= k else 2)
        out = []
        for step in reversed(back):
            out.append(state)
            state = step[state]
        return out[::-1]

    @property
    def may_be_header(self) -> re.Pattern:
        """Matches a text with a line of a shape that can be a header; no other text needs labels."""
        best = max(m[HEADER] - m[BODY] for m in self.move) + max(0.0, max(self.move[HEADER][j] - self.move[BODY][j] for j in range(3)))
        shapes = [k for k in SHAPES if k != "blank" and max(self.odds[k, p] for p in PLACES) + best > 0]
        return re.compile("(?m)^(?:" + "|".join(SHAPES[k] for k in shapes) + ")$") if shapes else re.compile(r"(?!)")


_BREAK_MARK = re.compile(rf"{HYPHENS}[ \t]*\n[ \t]*([^\W\d_]{{2,}})")


def divided(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, left part, right part)`` of the words that a line end divides."""
    out = []
    for m in _BREAK_MARK.finditer(text):
        start = m.start()
        while start and text[start - 1].isalpha():
            start -= 1
        left = text[start : m.start()]
        if len(left) > 1 and (m[1][0].islower() or left[0].isupper()):
            out.append((start, m.end(), left, m[1]))
    return out


#: Left and right parts in Java: a word of letters before a mark of division and a line end.
DIVIDED = rf"(?<!\p{{L}})(\p{{L}}{{2,}}+)(?={HYPHENS}[ \t]*\n[ \t]*(\p{{L}}{{2,}}+))"


_OWN_LINE = re.compile(r"[ \t]*(?:[-*•o–]|\(?\w{1,3}[.)]|\[.?\]|\|)[ \t]|.*[ \t]{2,}\S|.*\|")


_LATIN, _DIGITS, _BELOW = re.compile("[A-Za-zÀ-ɏ]+"), re.compile(r"\d+"), re.compile("[\x00-\xff]+")
_NUMERIC_BYTES = bytes(b for b in range(256) if chr(b).isalnum() and not chr(b).isalpha())
_LATIN_BYTES = bytes(b for b in range(256) if _LATIN.match(chr(b)))


def is_junk(text: str) -> bool:
    """Menus, code, dumps, rules, glyphs: nothing to read."""
    words = text.split()
    if len(words) < 4:
        return False
    if len(words) >= 20 and len(set(words[:60])) <= 20 and len(set(words)) <= 20 and sum(w[0].islower() for w in words) < 0.2 * len(words):
        return True  # a menu; few words again and again may be prose too
    solid = "".join(words)
    plain = solid.encode("latin-1", "ignore")
    beyond = "" if len(plain) == len(solid) else _BELOW.sub("", solid)  # signs beyond Latin-1 one by one
    more = len(beyond) - len(_LATIN.sub("", beyond))
    latin = len(plain) - len(plain.translate(None, _LATIN_BYTES)) + more
    most_mixed = len(plain) - len(plain.translate(None, _NUMERIC_BYTES)) + len(beyond) - more  # a mixed word has one of these
    digits = len(plain) - len(plain.translate(None, b"0123456789")) + len(beyond) - len(_DIGITS.sub("", beyond))
    rest = len(solid) - latin
    if latin < 0.35 * len(solid) and digits < 0.3 * len(solid):
        return True
    if sum(map(solid.count, "{}=<>")) > 0.15 * len(words) + 4:
        return True
    if rest - digits > 0.2 * len(solid):  # many signs: a table has numbers between them
        plain = sum(len(w) > 2 and w.strip(".,;:()").isalpha() for w in words)
        numeric = sum(w[0].isdigit() and not any(map(str.isalpha, w)) for w in words)
        if plain < 0.25 * len(words) and numeric < 0.3 * len(words):
            return True
    if most_mixed <= 0.3 * len(words) and max(map(len, words)) < 40:
        return False
    mixed = sum(len(w) >= 7 and w.isalnum() and not w.isalpha() and not w.isdigit() for w in words)
    long = sum(len(w) >= 40 for w in words)
    return mixed + 10 * long > 0.3 * len(words)


def body_of(model: Lines, text: str) -> tuple[str, int]:
    """The text without its furniture, and the number of lines left out."""
    if not model.headers.search(text):
        return text, 0
    kept = []
    labelled = model.label(text)
    for s, e, state, _ in labelled:
        if state != HEADER:
            kept.append(text[s:e])
    return "".join(kept), len(labelled) - len(kept)


def noise_of(body: str) -> tuple[set[str], set[tuple[str, str]]]:
    """``(words, divided)`` of the body of a page, in small letters; a divided word counts as joined."""
    pairs, parts, last = set(), [], 0
    for s, e, a, b in divided(body):
        parts.append(body[last:s])
        pairs.add((a.lower(), b.lower()))
        last = e
    parts.append(body[last:])
    words = {w for w in _TOKEN.findall(" ".join(parts).lower()) if len(w) > 2}
    words.update(a + b for a, b in pairs)
    return words, pairs


#: A word for counting: letters and digits, with inner hyphens.
TOKEN = r"\p{N}*+\p{L}[\p{L}\p{N}]*+(?:-\p{L}++)*+"
_TOKEN = re.compile(r"\d*[^\W\d_][^\W_]*(?:-[^\W\d_]+)*")


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` over all texts, in small letters, for words that hold a letter."""
    words = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN), F.lit(0)))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: Pairs of letters and letters that a scanner takes for each other; fixed by their shapes.
LOOKALIKE_PAIRS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ti", "h"), ("li", "h"))
LOOKALIKES = ("l1i!|", "o0a", "ce", "tf", "hb68", "s5", "gq9", "yv")


def shape_key(word: Column) -> Column:
    """Equal for words that look alike."""
    for a, b in LOOKALIKE_PAIRS:
        word = F.replace(word, F.lit(a), F.lit(b))
    source = "".join(group[1:] for group in LOOKALIKES)
    target = "".join(group[0] * (len(group) - 1) for group in LOOKALIKES)
    return F.translate(word, source, target)


def misread_words(counts: DataFrame) -> DataFrame:
    """``word, meant``: words that look like a far commoner one."""
    keyed = counts.filter(F.length("word") >= 3).withColumn("key", shape_key(F.col("word")))
    best = keyed.groupBy("key").agg(F.max(F.struct("n", "word")).alias("best"))
    pairs = keyed.join(best, "key").filter((F.col("best.n") >= COMMON) & (F.col("n") * RARER <= F.col("best.n")) & (F.col("word") != F.col("best.word")))
    letters = F.length(F.regexp_replace("word", r"\P{L}", ""))
    # in short words only digits and pairs of letters tell
    plain = F.length("word") == F.length("best.word")
    short = (F.length("word") <= 3) & plain & ~F.col("word").rlike(r"\d")
    return pairs.filter((letters >= 2) & (~short | (F.col("n") * 200 <= F.col("best.n")))).select("word", F.col("best.word").alias("meant"))


def divided_words(broken: DataFrame, counts: DataFrame) -> DataFrame:
    """``a, b, joined``: of divided words (``a, b, n``) those that are one word without a hyphen.

    The joined word or the one with a hyphen decides, whichever the corpus writes more often;
    where it knows neither, two parts that both are words are a compound. Parts are words by what they
    occur beyond divided words, measured against how often this one is divided, so that a corpus of any
    size, or one with copies of its pages, decides alike.
    """
    pairs = checkpointed(broken.select("a", "b", "n").withColumn("whole", F.concat("a", "b")).withColumn("hyphenated", F.concat_ws("-", "a", "b")))
    # the parts of divided words were counted as words too
    halves = pairs.select(F.explode(F.array("a", "b")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("in_halves"))
    for column, name in (("whole", "n_whole"), ("hyphenated", "n_hyphenated"), ("a", "n_a"), ("b", "n_b")):
        known = counts.select(F.col("word").alias(f"_{name}"), F.col("n").alias(name))
        pairs = pairs.join(known, F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    for c in ("a", "b"):
        pairs = pairs.join(halves.select(F.col("word").alias(f"_{c}"), F.col("in_halves").alias(f"in_{c}")), F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    # a compound may be misread too
    like = counts.filter(F.col("word").contains("-")).select(shape_key(F.col("word")).alias("_key")).distinct()
    pairs = pairs.join(like, shape_key(F.col("hyphenated")) == F.col("_key"), "left")
    one = F.when((F.col("n_whole") > 0) | (F.col("n_hyphenated") > 0), F.col("n_whole") > F.col("n_hyphenated")).otherwise(
        (F.least(F.col("n_a") - F.col("in_a"), F.col("n_b") - F.col("in_b")) < COMMON * F.col("n")) & F.col("_key").isNull()
    )
    return pairs.filter(one).select("a", "b", F.col("whole").alias("joined"))


def _may_divide(text: Column) -> Column:
    """Whether a line ends in a mark of division; signs beyond Latin-1, slow in a character class, are looked for only where they occur."""
    last = sorted({x[-1] for x in SIGNS | {"Â"}})
    ends = lambda chars: text.rlike(f"[{''.join(map(re.escape, chars))}][ \\t]*\\n")
    beyond = [c for c in last if c > "\u00ff"]
    some = F.lit(False)
    for c in beyond:
        some = some | F.contains(text, F.lit(c))
    return ends([c for c in last if c <= "\u00ff"]) | (some & ends(beyond))


def divided_pairs(df: DataFrame, text_col: str) -> DataFrame:
    """``a, b, n`` in small letters: what stands on either side of a mark of division at a line end, and how often."""
    parts = [F.regexp_extract_all(F.lower(text_col), F.lit(DIVIDED), F.lit(k)) for k in (1, 2)]
    pairs = df.filter(_may_divide(F.col(text_col))).select(F.explode(F.arrays_zip(parts[0].alias("a"), parts[1].alias("b"))).alias("x"))
    return pairs.groupBy("x.a", "x.b").agg(F.count("*").alias("n"))


class Scanned:
    """Labels, noise and repaired text of pages.

    Null and blank texts have no noise and no repaired text. Pages of junk have no noise and come out
    as they are. A page delivered twice gives equal rows twice in :meth:`repaired`, once in
    :meth:`noise`. Null sources are one source. Other columns are not looked at.
    """

    def __init__(self, df: DataFrame, id_col: str = "page_id", source_col: str = "source", text_col: str = "text", most: int = DICTIONARY_BYTES):
        self.id_col = id_col
        rows = spread(df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text")))
        self.pages = rows.select("_id", "_text").filter(F.col("_text").rlike(r"\S"))
        self.rates = edge_rates(rows, "_source", "_text")
        self.met = self._train()
        counts = checkpointed(word_counts(rows, "_text"))
        misread = checkpointed(misread_words(counts))
        joined = checkpointed(divided_words(divided_pairs(rows, "_text"), counts))
        self.misread, self.joined = misread, joined
        size = misread.agg(F.sum(F.octet_length("word") + F.octet_length("meant"))).first()[0] or 0
        size += joined.agg(F.sum(F.octet_length("a") + F.octet_length("b"))).first()[0] or 0
        self.dictionary = None
        if size <= most:
            tables = {r["word"]: r["meant"] for r in misread.collect()}, {(r["a"], r["b"]) for r in joined.collect()}
            self.dictionary = df.sparkSession.sparkContext.broadcast(tables)
        self.kind = rows.schema["_id"].dataType.simpleString()

    def _train(self) -> dict:
        """Counts of the lines of all pages by the label before, label, shape and place."""
        rates = self.rates

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, met = Lines(rates), Counter()
            for pdf in batches:
                for text in pdf["_text"]:
                    if not is_junk(text):
                        kinds = [(shape, place) for _, _, shape, place in model.places(text)]
                        states = model.states(kinds)
                        met.update(zip([-1, *states], states, kinds))
            yield pd.DataFrame([(before, state, *kind, n) for (before, state, kind), n in met.items()], columns=["before", "state", "shape", "place", "n"])

        rows = self.pages.select("_text").mapInPandas(run, "before int, state int, shape string, place string, n long")
        met = rows.groupBy("before", "state", "shape", "place").agg(F.sum("n").alias("n")).collect()  # at most labels x labels x shapes x places
        return {(r["before"], r["state"], r["shape"], r["place"]): r["n"] for r in met}

    def _model(self) -> Lines:
        model = Lines(self.rates, self.met)
        model.headers = model.may_be_header
        return model

    def _found(self) -> DataFrame:
        """``_id, noise, a, b``: furniture, misread words with their meaning and divided words of every page, by joins on words."""
        model = self._model()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for i, text in zip(pdf["_id"], pdf["_text"]):
                    if not is_junk(text):
                        body, furniture = body_of(model, text)
                        words, pairs = noise_of(body)
                        out += [(i, "characters", w, None) for w in words]
                        out += [(i, "hyphenation", a, b) for a, b in pairs]
                        out += [(i, "furniture", None, None)] * (furniture > 0)
                yield pd.DataFrame(out, columns=["_id", "noise", "a", "b"])

        every = self.pages.mapInPandas(run, f"_id {self.kind}, noise string, a string, b string")
        words = every.filter("noise = 'characters'").drop("b").join(self.misread.withColumnsRenamed({"word": "a", "meant": "b"}), "a")
        pairs = every.filter("noise = 'hyphenation'").join(self.joined.select("a", "b"), ["a", "b"])
        columns = ["_id", "noise", "a", "b"]
        return words.select(columns).unionByName(pairs.select(columns)).unionByName(every.filter("noise = 'furniture'"))

    def noise(self) -> DataFrame:
        """Distinct ``<id>, noise``: ``hyphenation``, ``characters`` or ``furniture``."""
        if self.dictionary is None:
            return self._found().select(F.col("_id").alias(self.id_col), "noise").distinct()
        model, dictionary = self._model(), self.dictionary

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            misread, joined = dictionary.value
            for pdf in batches:
                out = []
                for i, text in zip(pdf["_id"], pdf["_text"]):
                    body, furniture = body_of(model, text)
                    words, pairs = noise_of(body)
                    found = [(i, "furniture")] * (furniture > 0)
                    found += [(i, "characters")] * (not misread.keys().isdisjoint(words))
                    found += [(i, "hyphenation")] * (not joined.isdisjoint(pairs))
                    if found and not is_junk(text):
                        out += found
                yield pd.DataFrame(out, columns=["_id", "noise"])

        return self.pages.mapInPandas(run, f"_id {self.kind}, noise string").distinct().withColumnRenamed("_id", self.id_col)

    def repaired(self) -> DataFrame:
        """``<id>, text, furniture``: continuous paragraphs without furniture, division and misreading."""
        model, dictionary = self._model(), self.dictionary
        rows = self.pages
        if dictionary is None:
            own = self._found().filter("noise <> 'furniture'").groupBy("_id").agg(F.collect_set(F.struct("noise", "a", "b")).alias("own"))
            rows = rows.join(own, "_id", "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for k, (i, text) in enumerate(zip(pdf["_id"], pdf["_text"])):
                    if is_junk(text):
                        out.append((i, text, 0))
                        continue
                    if dictionary is not None:
                        misread, joined = dictionary.value
                    else:
                        found = pdf["own"].iloc[k]
                        found = [] if found is None else found
                        misread = {x["a"]: x["b"] for x in found if x["noise"] == "characters"}
                        joined = {(x["a"], x["b"]) for x in found if x["noise"] == "hyphenation"}
                    body, furniture = body_of(model, text)
                    out.append((i, paragraphs(fixed(body, joined, misread)), furniture))
                yield pd.DataFrame(out, columns=["_id", "text", "furniture"])

        return rows.mapInPandas(run, f"_id {self.kind}, text string, furniture int").withColumnRenamed("_id", self.id_col)


_WORD = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")


def _like(word: str, model: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word[:1].upper() + word[1:] if model[:1].isupper() else word


def _put_together(body: str, whole) -> str:
    """Divided words in one piece, the line ending after them; ``whole(a, b)`` says how, or None to leave them."""
    parts, last = [], 0
    for s, e, a, b in divided(body):
        word = whole(a, b)
        if word is not None and s >= last:
            tail = re.match(r"[^\w\s]*", body[e:])[0]  # the line ends after the word and its signs
            parts += [body[last:s], word, tail, "\n"]
            last = e + len(tail)
    return "".join([*parts, body[last:]])


def fixed(body: str, joined: set[tuple[str, str]], misread: dict[str, str]) -> str:
    """The body with the divided words among ``joined`` in one piece and the misread ones as they were meant."""
    body = _put_together(body, lambda a, b: a + b if (a.lower(), b.lower()) in joined else None)
    if not misread:
        return body
    return _WORD.sub(lambda m: _like(misread[m[0].lower()], m[0]) if m[0].lower() in misread else m[0], body)


def paragraphs(body: str) -> str:
    """The lines of a page as paragraphs; rows of lists and tables keep their lines, compounds their hyphen."""
    body = _put_together(body, lambda a, b: f"{a}-{b}")
    out = []
    for part in re.split(r"\n[ \t]*\n\s*", body.strip("\n")):
        lines = part.split("\n")
        sizes = sorted(map(len, lines[:-1] or lines))
        wrapped = sizes[len(sizes) // 2] >= 0.8 * max(map(len, lines))  # lists and headings end their lines early
        text = ""
        for line in lines:
            flows = text and wrapped and not _OWN_LINE.match(line) and line[:1].strip()
            text += (" " if flows else "\n" if text else "") + line.strip()
        out.append(text)
    return "\n\n".join(p for p in out if p.strip())


def found_noise(pages: DataFrame) -> DataFrame:
    return Scanned(pages).noise()
