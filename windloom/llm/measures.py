"""Statistics of many texts at once (problem 1): counts of characters, words and lines by arrays.

The texts of a batch are one array of code points. Classes of characters come from a table, words
and lines from where the classes change, and every statistic of a stretch of lines is a quotient
of sums over its lines; only the number of different words needs the words' hashes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

STATISTICS = (
    "is_entry", "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_word_share", "punctuated_line_share", "words_per_line",
    "distinct_word_share", "vowel_share", "alphabetic_word_share", "marked_line_share", "gap_line_share", "cell_marks_per_word", "capital_word_share",
    "sentence_ends_per_word", "numeric_word_share", "other_script_share",
)

#: Signs that end a plain word, beside white space; vowels; signs at line ends; what may stand before and behind a number.
SEPARATORS = ".,;:!?()[]{}\"«»“”„’'|/=<>*•"
VOWELS = "aeouAEOUáàâäãéèêëóòôöõúùûü"
LINE_ENDS = ".!?:;,”\""
BEFORE_NUMBER, BEHIND_NUMBER = "-–−+±(", ".,)%-"
_MARK = re.compile(r"(?:[-*•o–]\s|\[(?:\d{0,3}|[ xX])\]|\(?\w{1,3}[.)]\s)")
SPACE, ALNUM, DIGIT, LATIN, VOWEL, UPPER, ALPHA, APART, ENDS, BEFORE, BEHIND, MARKS = (1 << k for k in range(12))
_ODD = 0x9E3779B97F4A7C15 | 1


def _flags_of(c: str) -> int:
    tests = (
        c.isspace(), c.isalnum(), c.isdecimal(), "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ɏ", c in VOWELS, c.isupper(), c.isalpha(),
        c.isspace() or c in SEPARATORS, c in LINE_ENDS, c in BEFORE_NUMBER, c in BEHIND_NUMBER or c.isdecimal(), c in "-*•o–[(",
    )
    return sum(1 << k for k, t in enumerate(tests) if t)


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes and small letters of the characters below U+10000."""
    chars = [chr(k) for k in range(1 << 16)]
    small = [ord(c.lower()) if len(c.lower()) == 1 else k for k, c in enumerate(chars)]
    return np.array([_flags_of(c) for c in chars], np.int16), np.array(small, np.uint32)


def _classes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flags, small = _tables()
    low = np.minimum(code, 0xFFFF)
    out, lower = flags[low], small[low]
    beyond = np.flatnonzero(code > 0xFFFF)
    for c in np.unique(code[beyond]).tolist():
        at = beyond[code[beyond] == c]
        out[at], lower[at] = _flags_of(chr(c)), ord(chr(c).lower())
    return out, lower


def _sums(mask: np.ndarray) -> np.ndarray:
    """Sums of all beginnings; the sum of a range is a difference."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the hashes and what undoes them."""
    undo = pow(_ODD, -1, 1 << 64)
    return tuple(np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64) for x in (_ODD, undo))


def _hashes(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of ranges of code points, equal for equal ranges."""
    power, undo = _powers(max(1 << 20, len(code)))
    prefix = np.zeros(len(code) + 1, np.uint64)
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= power[: len(code)]
    np.cumsum(mixed, out=prefix[1:])
    return (prefix[hi] - prefix[lo]) * undo[lo]


def _starts_ends(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def common_hashes(words: frozenset[str]) -> np.ndarray:
    """Hashes of words in small letters, for :class:`Lines`."""
    out = []
    for w in words:
        code = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(_hashes(code, np.array([0]), np.array([len(code)]))[0])
    return np.array(out, np.uint64)


class Lines:
    """The lines of some texts that aren't blank, with their counts; ``text`` is the owner of each."""

    def __init__(self, texts: list[str], common: np.ndarray):
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        flags, small = _classes(code)
        has = lambda flag: (flags & flag) != 0
        solid = ~has(SPACE)
        stop = np.flatnonzero(code == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        weight = _sums(solid)
        full = np.flatnonzero(weight[stop] > weight[start])
        start, stop = start[full], stop[full]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, start, side="right")
        over = lambda sums: sums[stop] - sums[start]
        where = np.flatnonzero(solid)
        first, last = where[weight[start]], where[weight[stop] - 1]
        at = lambda k: code[np.minimum(k, len(code) - 1)]

        count = {"solid": over(weight), "lines": np.ones(len(start), np.int32)}
        for name, flag in (("digits", DIGIT), ("latin", LATIN), ("vowels", VOWEL)):
            count[name] = over(_sums(has(flag)))
        count["symbols"] = over(_sums(solid & ~has(ALNUM)))
        count["cells"] = over(_sums((code == ord("|")) | (code == ord(";"))))
        free = np.concatenate([~solid, [True, True]])
        dot = code == ord(".")
        stops = np.flatnonzero(dot | (code == ord("!")) | (code == ord("?")))
        closing = np.isin(at(stops + 1), [ord(c) for c in "\"”»’)"]) & free[stops + 2]
        ending = np.zeros(len(code), bool)
        ending[stops[free[stops + 1] | closing]] = True
        count["ends"] = over(_sums(ending))
        space = code == 32
        gap = code == 9
        gap[:-1] |= space[:-1] & space[1:]
        gap = _sums(gap)
        count["gaps"] = (gap[last] - gap[first] > 0).astype(np.int32)
        count["punctuated"] = ((flags[last] & ENDS) != 0).astype(np.int32)
        signs = _sums((dot | (code == ord(")"))) & free[1:-1])
        maybe = ((flags[first] & MARKS) != 0) | (signs[np.minimum(first + 5, stop)] > signs[first])
        count["marks"] = np.zeros(len(start), np.int32)
        for k in np.flatnonzero(maybe).tolist():
            count["marks"][k] = _MARK.match(joined, int(first[k]), int(last[k]) + 1) is not None

        lo, hi = _starts_ends(solid)
        self.word_line = np.searchsorted(stop, lo)
        line_of = lambda words, lines=None: np.bincount(self.word_line[words], minlength=len(start)).astype(np.int32)
        self.word = _hashes(code, lo, hi)
        count["words"] = line_of(np.ones(len(lo), bool))
        count["capitals"] = line_of((flags[lo] & UPPER) != 0)
        digit = np.flatnonzero(has(DIGIT))
        head = np.append(digit, len(code))[np.searchsorted(digit, lo)]
        numeric = head < hi
        head = np.minimum(head, hi - 1)
        before, behind = _sums(~has(BEFORE)), _sums(~has(BEHIND))
        numeric &= (before[head] == before[lo]) & (behind[hi] == behind[head + 1])
        count["numbers"] = line_of(numeric)

        lo, hi = _starts_ends(~has(APART))
        line = np.searchsorted(stop, lo)
        letters = _sums(~has(ALPHA))
        per = lambda mask: np.bincount(line[mask], minlength=len(start)).astype(np.int32)
        count["plain"] = per(np.ones(len(lo), bool))
        count["letters"] = per(letters[hi] == letters[lo])
        count["common"] = per(np.isin(_hashes(small, lo, hi), common))
        self.count = count

    def stretches(self, whole: np.ndarray) -> np.ndarray:
        """A number for each line, the same for runs of lines of a text that read alike: with or without the words that bind sentences.

        The lines of a text that is ``whole`` have one number.
        """
        c, n = self.count, len(self.text)
        if not n:
            return np.zeros(0, np.int64)
        same_before = np.concatenate([[False], self.text[1:] == self.text[:-1]])
        same_after = np.concatenate([same_before[1:], [False]])

        def around(x: np.ndarray) -> np.ndarray:
            return x + np.where(same_before, np.roll(x, 1), 0) + np.where(same_after, np.roll(x, -1), 0)

        size, bound = around(c["plain"]), around(c["common"])
        binds = c["common"] / np.maximum(c["plain"], 1) >= 0.15
        binds |= (bound >= 0.15 * size) & (c["common"] > 0)
        binds |= (bound >= 0.2 * size) & (c["plain"] <= 4) & (c["marks"] == 0) & (c["gaps"] == 0)
        new = ~same_before
        new[1:] |= (binds[1:] != binds[:-1]) & ~whole[self.text[1:]]
        return np.cumsum(new) - 1

    def statistics(self, group: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, words, statistics)`` of each group of lines; groups are numbered from 0 in the order of their lines."""
        n = int(group[-1]) + 1 if len(group) else 0
        c = {name: np.bincount(group, x, n) for name, x in self.count.items()}
        first = np.searchsorted(group, np.arange(n))
        owner = self.text[first]
        kinds = np.stack([group[self.word_line].astype(np.uint64), self.word], axis=1) if n else np.zeros((0, 2), np.uint64)
        order = np.lexsort((kinds[:, 1], kinds[:, 0]))
        kinds = kinds[order]
        new = np.ones(len(kinds), bool)
        new[1:] = (kinds[1:] != kinds[:-1]).any(axis=1)
        distinct = np.bincount(kinds[new, 0].astype(np.int64), minlength=n)
        words, size, lines, plain = (np.maximum(c[x], 1) for x in ("words", "solid", "lines", "plain"))
        rest = c["solid"] - c["digits"] - c["latin"] - c["symbols"]
        columns = [
            entry[owner].astype(float), np.log1p(c["words"]), size / words, c["symbols"] / size, c["digits"] / size, c["common"] / plain, c["punctuated"] / lines, c["words"] / lines,
            distinct / words, np.where(c["latin"] > 0, c["vowels"] / np.maximum(c["latin"], 1), 0.0), c["letters"] / plain, c["marks"] / lines, c["gaps"] / lines, c["cells"] / words,
            c["capitals"] / words, c["ends"] / words, c["numbers"] / words, np.maximum(rest, 0) / size,
        ]
        return owner, c["words"].astype(np.int64), np.stack([np.asarray(x, float) for x in columns], axis=1)
