"""Text decoded with the wrong character encoding (problem 2).

A hidden Markov model labels the characters of a text: one state is clean, every other state is
a pair of encodings (the true one, the one it was read with). ASCII looks alike in all states, so
the chain steps over the other characters. In the state of a pair a character is emitted as part
of a sequence that the pair can produce; it weighs as much as the characters it stands for are
likelier in their surroundings than those seen. How likely a character is between two classes of
neighbours is counted over all texts. Each labelled span gets the inverse of its state.

Scale: one narrow pass counts characters by surroundings (a table bounded by the alphabet, not by
the texts); a second passes every text with a non-ASCII character to the model, which runs in
Arrow batches and remembers the evidence of each run of signs in its surroundings, so that a text
without enough of it costs a look at its signs. Texts are never shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.session import spread

#: (true encoding, encoding it was read with); "utf-8 twice" was read wrongly two times.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
SINGLE = (("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1252"))
LOST = "\ufffd"
#: Logarithms: entering a state, leaving it, and a character that its pair can't produce.
ENTER_MULTI, ENTER_SINGLE, LEAVE, ALIEN = -5.0, -4.0, -2.0, -6.0
#: Off the odds of a single-byte pair where a line may divide a word: a letter's surroundings say little there.
DIVIDED = -4.0
#: Counts that stand for characters never met in some surroundings, as seen and as supposed original.
UNSEEN, UNSEEN_ORIGINAL = 0.5, 0.005
#: Share of an original's other occurrences that it may have in surroundings where it is unknown.
ELSEWHERE = 0.005
#: What the counts can't tell, for they hold the errors too: capitals inside words, mixed scripts.
MISFIT = -8.0
#: Log odds of a replacement sign: it never is text.
LOST_WEIGHT = 30.0


@lru_cache(None)
def byte_of(encoding: str) -> dict[str, int]:
    """Characters of the upper half to bytes; undefined bytes stand as their control characters."""
    out = {}
    for b in range(128, 256):
        out[chr(b)] = b if b < 160 else out.get(chr(b), b if encoding == "cp1252" else -1)
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return {c: b for c, b in out.items() if b >= 0}


def _class(chars: list[str]) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(set(chars))) + "]"


@lru_cache(None)
def utf8_pattern(encoding: str) -> str:
    """Sequences that UTF-8 makes when it is read as ``encoding``, for Python and Java alike."""
    of = byte_of(encoding)
    pick = lambda lo, hi: _class([c for c, b in of.items() if lo <= b <= hi])
    rest = pick(0x80, 0xBF)
    parts = [f"{pick(0xC2, 0xDF)}{rest}", f"{pick(0xE0, 0xEF)}{rest}{rest}", f"{pick(0xF0, 0xF4)}{rest}{rest}{rest}"]
    if encoding == "cp1252":  # the no-break space of a sequence may have become an ordinary one
        parts.append("[\\u00c2\\u00c3](?:[ ](?=\\s)|(?=\\s))")
    return "|".join(parts)


def undo_utf8(s: str, encoding: str) -> str | None:
    of = byte_of(encoding)
    if s[0] in "ÂÃ" and (len(s) == 1 or s[1] == " "):
        return "à" if s[0] == "Ã" else " "
    try:
        return bytes(of[c] for c in s).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(None)
def single_map(true: str, read: str) -> dict[str, str]:
    out = {}
    for c, b in byte_of(read).items():
        try:
            d = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        if d != c and not unicodedata.category(d).startswith("C"):
            out[c] = d
    return out


#: Characters that GBK makes of UTF-8 bytes.
GBK_RUN = "[\\u3400-\\u9fff\\ufe30-\\ufe6f\\uff01-\\uffe5][\\u3000-\\u9fff\\ufe30-\\ufe6f\\uff01-\\uffe5\\ue000-\\uf8ff\\u0391-\\u0451\\u2010-\\u2642\\ufffd]*"


def undo_gbk(s: str, likely) -> str | None:
    """The text whose UTF-8 bytes read as GBK give ``s``; lost last bytes are filled by likelihood."""
    try:
        raw = b"".join(b"\xff" if c == LOST else c.encode("gbk") for c in s)
    except UnicodeEncodeError:
        return None
    text = ""
    while raw:
        try:
            return text + raw.decode("utf-8")
        except UnicodeDecodeError as e:
            text += raw[: e.start].decode("utf-8")
            head = raw[e.start :].split(b"\xff", 1)
            if len(head) == 1 or not 1 <= len(head[0]) <= 2:
                return None
            text += likely(head[0])
            raw = head[1]
    return text


@lru_cache(1 << 16)
def kind(c: str) -> str:
    """Class of a neighbour; the same as in :func:`kind_sql`."""
    if c < "\x80":
        return "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "s" if c in " \t\n\r\x0b\x0c" else "p"
    category = unicodedata.category(c)
    return "s" if category == "Zs" else "e" if category == "Ll" else "E" if category == "Lu" else "o"


def kind_sql(c: Column) -> Column:
    rules = (("l", "[a-z]"), ("u", "[A-Z]"), ("d", "[0-9]"), ("s", r"[ \t\n\r\x0b\x0c\p{Zs}]"), ("p", r"[\x00-\x7f]"), ("e", r"\p{Ll}"), ("E", r"\p{Lu}"))
    for k, (name, rule) in enumerate(rules):
        out = F.when(c.rlike(rule), name) if k == 0 else out.when(c.rlike(rule), name)
    return out.otherwise("o")


def surroundings(df: DataFrame, text_col: str) -> dict[tuple[str, str, str], int]:
    """How often each non-ASCII character stands between which classes of neighbours, over all rows.

    The table has at most (classes x characters x classes) entries, whatever the number of rows.
    """
    padded = F.concat(F.lit(" "), F.col(text_col), F.lit(" "))
    threes = F.regexp_extract_all(padded, F.lit(r"(?s)(?=(.[^\x00-\x7f].))"), F.lit(1))
    rows = df.filter(F.col(text_col).rlike(r"[^\x00-\x7f]")).select(F.explode(threes).alias("t")).groupBy("t").count()
    of = lambda k: F.substring("t", k, 1)
    table = rows.groupBy(kind_sql(of(1)).alias("a"), of(2).alias("c"), kind_sql(of(3)).alias("b")).agg(F.sum("count").alias("n"))
    return {(r["a"], r["c"], r["b"]): r["n"] for r in table.collect()}


@lru_cache(1 << 16)
def misfit(a: str, c: str, b: str) -> bool:
    """A capital between small letters, a Cyrillic or Han letter next to a Latin one, a sign inside a word."""
    if "\u0400" <= c <= "\u04ff" or "\u3400" <= c <= "\u9fff":
        return a in "lud" or b in "lud"
    inside = a in "le" and b in "le"
    return inside and (unicodedata.category(c) == "Lu" or c in "‡·‚„‰ˆ˜¯˘˙˚¸˝˛ˇﬂ")


#: Signs that touch, and the white space that a sequence of UTF-8 read as cp1252 may hold between them.
PART = re.compile(r"[^\x00-\x7f]+(?:(?<=[\u00c2\u00c3]) (?=\s)[^\x00-\x7f]*)*")


def _stand_in(c: str) -> str:
    """One character for the neighbours that :meth:`Model.odds` and the patterns treat alike."""
    return c if not c or c.isspace() or c == "-" else {"l": "a", "u": "A", "d": "0", "p": "."}[kind(c)]


class Model:
    """The hidden Markov model; built once per Python worker from the counted surroundings."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.counts = counts
        self.total = max(1, sum(counts.values()))
        self.common: dict[str, int] = {}
        for (_, c, _), n in counts.items():
            self.common[c] = self.common.get(c, 0) + n
        multi = [(f"utf-8>{e}", e) for e in READ_AS]
        self.states = [n for n, _ in multi] + ["utf-8>cp1252 twice", "utf-8>gbk", *(f"{t}>{r}" for t, r in SINGLE), "lost"]
        self.enter = [ENTER_SINGLE if ">" in s and not s.startswith("utf-8") else ENTER_MULTI for s in self.states]
        self.single_states = range(len(multi) + 2, len(self.states) - 1)
        self.multi = [(re.compile(f"(?:{utf8_pattern(e)})+"), re.compile(utf8_pattern(e))) for _, e in multi]
        self.single = [(re.compile(_class(list(m)) + "+"), m) for m in (single_map(*pair) for pair in SINGLE)]
        one = utf8_pattern("cp1252")
        self.run = re.compile(f"(?:{one}){{2,}}")
        self.one = re.compile(one)
        self.gbk = re.compile(GBK_RUN)
        self.filled: dict[bytes, str] = {}
        self.known: dict[tuple, float] = {}
        self.parts: dict[str, list[tuple[int, float]]] = {}

    def log(self, before: str, s: str, after: str, unseen: float) -> float:
        """Log probability of the non-ASCII characters of ``s`` between two characters."""
        out, s = 0.0, f"{before}{s}{after}"
        for k in range(1, len(s) - 1):
            if s[k] > "\x7f":
                a, b = kind(s[k - 1]), kind(s[k + 1])
                rare = max(unseen, ELSEWHERE * self.common.get(s[k], 0)) if unseen < UNSEEN else unseen
                out += math.log(max(self.counts.get((a, s[k], b), 0), rare) / self.total)
                if misfit(a, s[k], b):
                    out += MISFIT
        return out

    def odds(self, text: str, s: int, e: int, original: str, state: int = 0) -> float:
        """Log odds of ``original`` against what is seen at ``[s, e)``, read by the pair of ``state``."""
        before, after = text[s - 1] if s else " ", text[e] if e < len(text) else " "
        key = (kind(before), text[s:e], original, kind(after))
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self.log(before, original, after, UNSEEN_ORIGINAL) - self.log(before, text[s:e], after, UNSEEN)
        divided = state in self.single_states and (before == "\n" or after == "-")
        return self.known[key] + DIVIDED if divided else self.known[key]

    def likely(self, head: bytes) -> str:
        if head not in self.filled:
            fits = [(n, c) for c, n in self.common.items() if len(c.encode()) == len(head) + 1 and c.encode().startswith(head)]
            self.filled[head] = max(fits)[1] if fits else LOST
        return self.filled[head]

    def candidates(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """``(state, start, end, original)`` of every run of sequences that a pair can have made."""
        for k, (run, one) in enumerate(self.multi):
            for m in run.finditer(text):
                parts = [undo_utf8(x[0], READ_AS[k]) for x in one.finditer(m[0])]
                if None not in parts:
                    yield k, m.start(), m.end(), "".join(parts)
        twice = len(self.multi)
        for m in self.run.finditer(text):
            once = "".join(undo_utf8(x[0], "cp1252") or LOST for x in self.one.finditer(m[0]))
            d = self.one.sub(lambda x: undo_utf8(x[0], "cp1252") or LOST, once)
            if d != once and LOST not in d:
                yield twice, m.start(), m.end(), d
        for m in self.gbk.finditer(text):
            if (d := undo_gbk(m[0], self.likely)) is not None:
                yield twice + 1, m.start(), m.end(), d
        for k, (run, back) in enumerate(self.single, twice + 2):
            for m in run.finditer(text):
                yield k, m.start(), m.end(), "".join(back[c] for c in m[0])

    def part_evidence(self, part: str) -> list[tuple[int, float]]:
        """``(state, sum of positive odds)`` of a run of signs with the character on either side."""
        out: dict[int, float] = {}
        for state, s, e, d in self.candidates(part):
            if (odds := self.odds(part, s, e, d, state)) > 0:
                out[state] = out.get(state, 0.0) + odds
        return list(out.items())

    def live(self, text: str) -> list[int]:
        """States whose evidence can pay for their entry; no other is ever taken.

        No candidate reaches beyond a :data:`PART` and odds depend on what :func:`_stand_in`
        keeps of its neighbours, so the parts add up to what all candidates of the text give.
        """
        evidence = [0.0] * len(self.states)
        for m in PART.finditer(text):
            s, e = m.span()
            before, after = text[s - 1 : s], text[e : e + 1]
            part = f"{_stand_in(before)}{m[0]}{_stand_in(after)}"
            if (known := self.parts.get(part)) is None:
                if len(self.parts) > 200_000:
                    self.parts.clear()
                known = self.parts[part] = self.part_evidence(part)
            for state, odds in known:
                evidence[state] += odds
        evidence[-1] = LOST_WEIGHT * text.count(LOST)
        return [k for k, v in enumerate(evidence) if v + self.enter[k] + LEAVE > 0]

    def label(self, text: str) -> list[tuple[int, int, str, str]]:
        """Spans ``(start, end, state, original)`` of the most likely labelling that aren't clean."""
        live = self.live(text)
        if not live:
            return []
        spots = [i for i, c in enumerate(text) if c > "\x7f"]
        index = {p: k for k, p in enumerate(spots)}
        found = [(state, s, e, d, self.odds(text, s, e, d, state)) for state, s, e, d in self.candidates(text)]
        column = {state: j for j, state in enumerate(live)}
        weight = [[ALIEN] * len(live) for _ in spots]
        spans: dict[tuple[int, int], tuple[int, int, str]] = {}
        for state, s, e, d, odds in found:
            if (j := column.get(state)) is not None:
                inside = [index[p] for p in range(s, e) if p in index]
                for k in inside:
                    weight[k][j] = odds / len(inside)
                    spans[k, j] = (s, e, d)
        for (k, j), (s, e, _) in spans.items():
            # a sign close by that the pair can't have made speaks against it
            for p in (s - 3, s - 2, s - 1, e, e + 1, e + 2):
                if p in index and (index[p], j) not in spans and text[p] != LOST and kind(text[p]) != "s":
                    weight[k][j] += ALIEN
                    break
        lost = column.get(len(self.states) - 1, -1)
        if lost >= 0:
            for k, p in enumerate(spots):
                if text[p] == LOST:
                    weight[k][lost] = LOST_WEIGHT
        enters = [self.enter[k] for k in live]
        states = range(len(live))
        clean, score, back = 0.0, [-1e9] * len(live), []
        for w in weight:
            best = max(states, key=score.__getitem__)
            left = score[best] + LEAVE
            come, new = [], []
            for k in states:
                enter = max(clean, left) + enters[k]
                stay = score[k] >= enter
                come.append(k if stay else best if left > clean else -1)
                new.append((score[k] if stay else enter) + w[k])
            back.append((best if left > clean else -1, come))
            clean, score = max(clean, left), new
        best = max(states, key=score.__getitem__)
        at = best if score[best] + LEAVE > clean else -1
        out: dict[tuple[int, int], tuple[str, str]] = {}
        for k in range(len(spots) - 1, -1, -1):
            if at >= 0:
                if (k, at) in spans:
                    s, e, d = spans[k, at]
                    out[s, e] = (self.states[live[at]], d)
                elif at == lost and text[spots[k]] == LOST:
                    out[spots[k], spots[k] + 1] = ("lost", LOST)
            at = back[k][1][at] if at >= 0 else back[k][0]
        return [(s, e, *v) for (s, e), v in sorted(out.items())]

    def restore(self, text: str) -> tuple[str, list[str], int]:
        """``(restored text, states met, number of sequences)``; repeated while something new comes out, for what was misread again and again."""
        states: list[str] = []
        places = 0
        seen = set()
        while text not in seen:
            seen.add(text)
            spans = self.label(text)
            changed = [s for s in spans if s[2] != "lost"]
            states += [s[2] for s in spans]
            places += len(spans) if not places else 0
            if not changed:
                break
            out, last = [], 0
            for s, e, _, d in changed:
                if s >= last:
                    out += [text[last:s], d]
                    last = e
            text = "".join([*out, text[last:]])
        return text, sorted(set(states)), places


def repair_encoding(df: DataFrame, id_col: str, text_col: str, counts: dict | None = None) -> DataFrame:
    """``<id_col>, text, states, places`` of the rows with a wrongly decoded place.

    ``text`` is restored as far as the model can; ``states`` are the encoding pairs met, ``lost``
    among them where replacement signs stand for characters that are gone (see
    :func:`fill_lost`). Null, empty and all-ASCII texts are clean. Repeated rows give repeated
    rows. Other columns are not looked at; an empty table gives no rows.
    """
    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    counts = counts if counts is not None else surroundings(rows, "_text")
    kind_of_id = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(counts)
        for pdf in batches:
            got = [(i, *model.restore(t)) for i, t in zip(pdf["_id"], pdf["_text"])]
            yield pd.DataFrame([g for g in got if g[2]], columns=["_id", "text", "states", "places"])

    return rows.filter(F.col("_text").rlike(r"[^\x00-\x7f]")).mapInPandas(run, f"_id {kind_of_id}, text string, states array<string>, places int").withColumnRenamed("_id", id_col)


WORD = r"(?U)[\p{L}�]*[^\x00-\x7f\W][\p{L}�]*"


def fill_lost(repaired: DataFrame, id_col: str, df: DataFrame, text_col: str) -> DataFrame:
    """Fill replacement signs in ``repaired`` from the words of ``df`` that fit best.

    A word with replacement signs takes the commonest word of the corpus that equals it but for
    the non-ASCII letters; words without a like stay as they are.
    """
    words = F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"(?U)[\p{L}]*[^\x00-\x7f\W][\p{L}]*"), F.lit(0)))).alias("word")
    known = df.select(words).groupBy("word").agg(F.count("*").alias("n"))
    masked = F.regexp_replace("word", r"[^\x00-\x7f]", LOST)
    best = known.groupBy(masked.alias("lost")).agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    lost = repaired.filter(F.col("text").contains(LOST)).select(
        id_col, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}�]*�[\p{L}�]*"), F.lit(0)))).alias("lost")
    )
    fixes = lost.join(best, "lost").groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct(F.length("lost").alias("n"), "lost", "word")), asc=False).alias("fixes"))
    filled = F.aggregate("fixes", F.col("text"), lambda acc, x: F.replace(acc, x["lost"], x["word"]))
    return repaired.join(fixes, id_col, "left").withColumn("text", F.when(F.col("fixes").isNotNull(), filled).otherwise(F.col("text"))).drop("fixes")


def found_wrong(pages: DataFrame) -> DataFrame:
    return repair_encoding(pages, "page_id", "text").select("page_id").distinct()
