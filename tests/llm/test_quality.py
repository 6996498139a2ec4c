import math
import random
import re

import numpy as np
import pytest

from windloom.llm import measures as M
from windloom.llm import quality as Q

_PLAIN = re.compile(r"[^\s.,;:!?()\[\]{}\"«»“”„’'|/=<>*•]+")
_MARK = re.compile(r"\s*(?:[-*•o–]\s|\[(?:\d{0,3}|[ xX])\]|\(?\w{1,3}[.)]\s)")
_SYMBOLS = re.compile(r"[^\W_]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]+")
_DIGITS = re.compile(r"\d+")
_VOWELS = "aeouAEOUáàâäãéèêëóòôöõúùûü"
_NUMERIC = re.compile(r"[-–−+±(]*\d[\d.,)%-]*")
_ENDS = re.compile(r"[.!?][\"”»’)]?(?:\s|$)")
_CELL = re.compile(r"[|;]")


def _gap(line: str) -> bool:
    return "  " in line or "\t" in line


def statistics(text: str, common: frozenset[str], entry: bool, plain: list[str] | None = None) -> list[float]:
    """The statistics of one text in the order of ``STATISTICS``; ``plain`` are its words in small letters, if known."""
    words = text.split()
    n = max(1, len(words))
    solid = "".join(words)
    size = max(1, len(solid))
    symbols = len(_SYMBOLS.sub("", solid))
    no_digits = _DIGITS.sub("", solid)
    digits = len(solid) - len(no_digits)
    rest = _LATIN.sub("", no_digits)
    latin = len(no_digits) - len(rest)
    vowels = sum(map(solid.count, _VOWELS)) if latin else 0
    plain = _PLAIN.findall(text.lower()) if plain is None else plain
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    count = max(1, len(lines))
    return [
        float(entry), math.log1p(len(words)), size / n, symbols / size, digits / size, sum(map(common.__contains__, plain)) / max(1, len(plain)),
        sum(x[-1] in ".!?:;,”\"" for x in lines) / count, len(words) / count, len(set(words)) / n, vowels / max(1, latin),
        sum(map(str.isalpha, plain)) / max(1, len(plain)), sum(_MARK.match(x) is not None for x in lines) / count, sum(map(_gap, lines)) / count,
        len(_CELL.findall(text)) / n, sum(w[0].isupper() for w in words) / n, len(_ENDS.findall(text)) / n,
        sum(not w[0].isalpha() and _NUMERIC.fullmatch(w) is not None for w in words) / n, max(0, len(rest) - symbols) / size,
    ]


def stretches(text: str, common: frozenset[str]) -> list[tuple[str, list[str]]]:
    """Runs of lines that read alike, with or without the words that bind sentences, and their words in small letters."""
    lines = text.split("\n")
    plain = text.lower().split("\n")
    full = [k for k, x in enumerate(lines) if x and not x.isspace()]
    if len(full) < 2:
        return [(text, _PLAIN.findall(text.lower()))]
    size, bound, found = [], [], []
    for k in full:
        words = _PLAIN.findall(plain[k])
        found.append(words)
        size.append(len(words))
        bound.append(sum(map(common.__contains__, words)))
    flags = []
    last = len(full) - 1
    for j, k in enumerate(full):
        lo, hi = max(0, j - 1), min(last, j + 1)
        n, c = sum(size[lo : hi + 1]), sum(bound[lo : hi + 1])
        alone = bound[j] / max(1, size[j])
        flags.append(alone >= 0.15 or (c >= 0.15 * n and bound[j] > 0) or (c >= 0.2 * n and size[j] <= 4 and not _MARK.match(lines[k]) and not _gap(lines[k].strip())))
    starts = [0, *(j for j in range(1, len(full)) if flags[j] != flags[j - 1]), len(full)]
    ends = [*(full[j] for j in starts[1:-1]), len(lines)]
    return [("\n".join(lines[full[a] : end]), [w for x in found[a:b] for w in x]) for a, b, end in zip(starts, starts[1:], ends)]



COMMON = ["the", "of", "and", "a", "in", "is", "to", "at", "by", "for", "with", "that", "it", "on"]
NOUNS = ["wing", "spar", "rudder", "margin", "camber", "radiator", "value", "speed", "boom", "tail"]
SCHEMA = "page_id long, text string, tables array<string>, item int, words string"


def prose(rng, n):
    out = []
    while len(out) < n:
        s = []
        for _ in range(rng.randint(5, 9)):
            s += [rng.choice(COMMON), rng.choice(NOUNS)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    words = out[:n]
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))


def bullets(rng, n):
    return "\n".join(f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)} {rng.random():.3f}" for _ in range(n // 4))


def numbers(rng, n):
    return "\n".join("  ".join(f"{rng.random() * 9:.3f}" for _ in range(5)) for _ in range(n // 5))


def menu(rng, n):
    return " ".join(rng.choice(["Menu", "»", "Next", "[+]", "A-", "0/0"]) for _ in range(n))


def grid(rng, cell):
    return "\n".join(["| case | drag |", "|---|---|", *(f"| {cell()} | {cell()} |" for _ in range(8))])


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(300):
        kind = i % 6
        rest = rng.choice([bullets, numbers, menu])
        n, m = (120, 0) if kind < 3 else (0, 120) if kind == 3 else (140, 60) if kind == 4 else (60, 140)
        text = "\n\n".join(x for x in (prose(rng, n) if n else "", rest(rng, m) if m else "") if x)
        if kind in (3, 5):
            want.add((i, 0))
        tables = []
        for k in range(1, i % 4):
            pick = rng.random()
            if pick < 0.6:
                tables.append(grid(rng, lambda: f"{rng.random():.3f}"))
            elif pick < 0.8:
                tables.append("| " + prose(rng, 60).replace("\n", " |\n| ") + " |")
                want.add((i, k))
            else:
                tables.append(grid(rng, lambda: "".join(rng.choice("■□●▪") for _ in range(5))))
                want.add((i, k))
        rows.append((i, text, tables, 7, "x"))
    rows += [(900, None, None, 1, "x"), (901, " \n ", [], 1, "x"), (902, "", [None, " "], 1, "x"), rows[3]]
    return rows, want


def frames(spark, rows):
    labels = [(i, "prose" if i % 6 < 3 else "table" if i % 2 else "list") for i in range(60) if i % 6 in (0, 1, 2, 3, 5)]
    labels += [(1, "junk"), (3, None), (None, "list")]
    return (
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame([("en", w) for w in COMMON] + [(None, None)], "lang string, word string"),
        spark.createDataFrame(labels, "page_id long, label string"),
    )


def test_planted_cases_are_found(spark, pages):
    rows, want = pages
    got = {tuple(r) for r in Q.found_cases(*frames(spark, rows)).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_statistics(spark, pages):
    rows, _ = pages
    df, words, _ = frames(spark, [(1, "The wing is 2.5 m.\n- a spar", ["| a | 1 |"], 1, "x"), (2, None, None, 1, "x")])
    got = {r["item"]: r for r in Q.text_statistics(df, words).collect()}
    assert set(got) == {0, 1} and got[0]["words"] == 8
    assert got[0]["common_word_share"] == pytest.approx(3 / 9, abs=1e-5) and got[0]["marked_line_share"] == 0.5
    assert got[0]["punctuated_line_share"] == 0.5 and got[0]["words_per_line"] == 4
    df, words, labels = frames(spark, rows)
    assert {r[0] for r in Q.text_statistics(df, words).select("page_id").collect()} == set(range(300))


def of_arrays(texts, whole):
    lines = M.Lines(texts, M.common_hashes(frozenset(COMMON)))
    return lines.statistics(lines.text if whole else lines.stretches(np.zeros(len(texts), bool)), np.full(len(texts), whole))


def test_arrays_equal_one_text_at_a_time():
    rng = random.Random(1)
    odd = ["x", "  a\n\n\tb  c\n", "Ístanbul Ⅷ ½ a_b\u00a0c", "a.\u201d b? \u201cC.\u201d)\n(12) -3.5 +4 3rd 1,000 5%", "𝔘𝔫 😀 the 字字\n[x] of\n1. the\n(a) b", "-", ".", "a\r\nthe\x0bof\u2003the", "the " * 50]
    texts = odd + [bullets(rng, 40) + "\n\n" + prose(rng, 80) + "\n" + numbers(rng, 50) for _ in range(20)] + [menu(rng, 60), grid(rng, lambda: "1.5")]
    common = frozenset(COMMON)
    for whole in (True, False):
        want = [(k, len(p.split()), statistics(p, common, whole, w)) for k, t in enumerate(texts) for p, w in ([(t, None)] if whole else stretches(t, common))]
        owner, words, values = of_arrays(texts, whole)
        assert owner.tolist() == [x[0] for x in want] and words.tolist() == [x[1] for x in want]
        assert np.allclose(values, np.array([x[2] for x in want]), atol=1e-12)
    assert len(of_arrays(["  ", "\n"], True)[0]) == 0


def test_stretches_tell_lists_from_prose():
    rng = random.Random(1)
    text = bullets(rng, 40) + "\n\n" + prose(rng, 80) + "\n" + numbers(rng, 50)
    assert of_arrays([text], False)[1].sum() == len(text.split()) and len(of_arrays([text], False)[1]) == 3


def test_numeric_words():
    at = M.STATISTICS.index("numeric_word_share")
    assert of_arrays(["-3.5 (12) +4 1,000 5%"], True)[2][0, at] == 1.0
    assert of_arrays(["3rd 2x wing x2 --"], True)[2][0, at] == 0.0


def test_majority_of_the_judgements_and_none(spark, pages):
    rows, want = pages
    df, words, labels = frames(spark, rows)
    turned = labels.unionByName(labels).unionByName(labels.withColumn("label", Q.F.when(Q.F.col("label") == "prose", "junk").otherwise("prose")))
    for judged in (turned, labels.limit(0)):
        got = {tuple(r) for r in Q.found_cases(df, words, judged).collect()}
        assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_one_class_and_empty(spark):
    rows = [(i, prose(random.Random(i), 50), None, 1, "x") for i in range(5)]
    df, words, labels = frames(spark, rows)
    assert Q.found_cases(df, words, labels).count() == 0
    assert Q.judged_items(df.limit(0), words, labels.limit(0)).count() == 0
