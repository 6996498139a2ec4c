import random

import pytest

from windloom.llm import scanned as S

WORDS = "the wing carries half of the load and its margin remains small during the approach because lift falls with speed near stall".split()
COLUMNS = "page_id long, source string, text string, noise string, body string"


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 14))).capitalize() + "."


def wrapped(rng, n=6, width=60):
    lines, line = [], ""
    for w in " ".join(sentence(rng) for _ in range(n)).split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


@pytest.fixture(scope="module")
def corpus():
    """Pages and the noise planted in them."""
    rng = random.Random(7)
    rows, want = [], set()
    for i in range(400):
        lines = wrapped(rng)
        lines.insert(len(lines) // 2, "")
        plan = rng.random()
        if plan < 0.2:
            lines.insert(0, f"LIGHT AIRCRAFT NOTES    {i}")
            want.add((i, "furniture"))
        elif plan < 0.3:
            lines += ["", f"— {i} —"]
            want.add((i, "furniture"))
        elif plan < 0.4:
            lines.insert(0, "LOAD FACTORS")  # a heading
        k = next((k for k, x in enumerate(lines[:-1]) if x and lines[k + 1][:3] == "the"), None)
        if rng.random() < 0.3:
            mark = rng.choice(["-", "\xad", "‐", "¬"])
            lines[1] = f"{lines[1]} mar{mark}"
            lines[2] = f"gin {lines[2]}"
            want.add((i, "hyphenation"))
        elif rng.random() < 0.2 and k is not None:
            lines[k] += " wind-"
            lines[k + 1] = "tunnel " + lines[k + 1]
        lines[3] += " wind-tunnel"
        if rng.random() < 0.3:
            bad = rng.choice(["mcrgin", "rernains", "1oad", "approacb"]) if i != 5 else "rernains"
            if bad != "mcrgin":
                want.add((i, "characters"))
                lines[4] += f" {bad}"
        rows.append((i, f"s{i % 7}", "\n".join(lines), "x", "y"))
    rows += [(900, None, None, "", ""), (901, "s1", "  \n ", "", ""), (902, "s1", " ".join(["Menu", "Home", "|", "Next"] * 30) + "\n\n12", "", ""), rows[3]]
    rows += [(903, "s2", "1.23\n4.567\n12\n9.1\n77", "", "")]
    return rows, want


def test_noise_equals_planted(spark, corpus):
    rows, want = corpus
    got = {tuple(r) for r in S.found_noise(spark.createDataFrame(rows, COLUMNS)).collect()}
    for kind in ("furniture", "hyphenation", "characters"):
        a, b = {i for i, n in got if n == kind}, {i for i, n in want if n == kind}
        assert len(a & b) >= 0.97 * len(b) and len(a - b) <= 0.02 * len(b), kind


def test_copies_of_the_pages_change_nothing(spark, corpus):
    rows = [r for r in corpus[0] if r[0] < 250]
    for k, (a, b) in enumerate((("stif", "fener"), ("gus", "ty"), ("fla", "nge"), ("riv", "eted"))):  # joined nowhere else
        rows.append((500 + k, "s1", f"The {a}-\n{b} carries the load of the wing.", "", ""))
    once = {tuple(r) for r in S.found_noise(spark.createDataFrame(rows, COLUMNS)).collect()}
    again = [(i + 1000 * k, *rest) for k in range(30) for i, *rest in rows]
    got = {tuple(r) for r in S.found_noise(spark.createDataFrame(again, COLUMNS)).collect()}
    assert {(500 + k, "hyphenation") for k in range(4)} <= once and sum(n == "furniture" for _, n in once) > 50
    assert got == {(i + 1000 * k, n) for k in range(30) for i, n in once}


def test_repaired_text(spark, corpus):
    rows, want = corpus
    got = {r["page_id"]: r["text"] for r in S.Scanned(spark.createDataFrame(rows, COLUMNS)).repaired().collect()}
    for i, _, text, *_ in rows[:400]:
        assert "LIGHT AIRCRAFT" not in got[i] and "—" not in got[i]
        assert "mar-gin" not in got[i] and "windtunnel" not in got[i] and "rernains" not in got[i]
        assert got[i].count("\n\n") <= 2 and "wind-tunnel" in got[i]
    assert got[902] == dict((r[0], r[2]) for r in rows)[902] and 900 not in got


def test_tables_beyond_the_dictionary_are_joined(spark, corpus):
    pages = spark.createDataFrame(corpus[0], COLUMNS)
    small, large = S.Scanned(pages), S.Scanned(pages, most=-1)
    assert small.dictionary is not None and large.dictionary is None
    assert set(map(tuple, small.noise().collect())) == set(map(tuple, large.noise().collect()))
    assert sorted(map(tuple, small.repaired().collect())) == sorted(map(tuple, large.repaired().collect()))


def test_every_page_is_counted(spark, corpus):
    pages = [r for r in corpus[0] if r[0] < 400]
    many = [(i + 1000 * k, *rest) for k in range(10) for i, *rest in pages]
    once, ten = (S.Scanned(spark.createDataFrame(rows, COLUMNS)).met for rows in (pages, many))
    lines = sum(r[2].count("\n") + 1 for r in pages)
    assert sum(once.values()) == lines and ten == {k: 10 * n for k, n in once.items()}


def test_prose_of_few_words_is_no_junk():
    words = "the wing carries the load and the tail carries the rest".split()
    assert not S.is_junk(" ".join(words[k % 11] for k in range(44)) + ".")
    assert S.is_junk(" ".join(["Menu", "Home", "|", "Next"] * 30))


def test_training_keeps_the_first_model_without_lines_and_learns_from_them():
    first = S.Lines({"number": 3.0})
    assert first.odds["number", "edge"] == pytest.approx(6.0) and first.odds["sentence", "inside"] == -12
    met = {(S.BODY, S.BODY, "caps", "inside"): 9000, (S.BODY, S.BODY, "sentence", "inside"): 90_000, (S.BREAK, S.HEADER, "number", "edge"): 1000, (S.BODY, S.BREAK, "blank", "blank"): 5000}
    learned = S.Lines({"number": 3.0}, met)
    assert learned.odds["number", "edge"] > 6 and learned.odds["caps", "inside"] < first.odds["caps", "inside"]
    assert learned.move[S.BREAK][S.HEADER] > first.move[S.BREAK][S.HEADER]
    assert sum(map(lambda x: 2.718281828 ** x, learned.move[S.BODY])) == pytest.approx(1)


@pytest.mark.parametrize("first", [7, 9_960, 123_456])
def test_page_numbers_of_any_length_are_furniture(spark, first):
    rng = random.Random(5)
    rows = []
    for i in range(first, first + 80):
        head = (f"CHAPTER {i // 40}    {i}", f"{i}    LIGHT AIRCRAFT NOTES", f"Wing Notes - {i}", f"Wing Notes | Page {i}", f"- {i} -", f"{i}")[i % 6]
        rows.append((i, "s", "\n".join([head, "", *wrapped(rng)] if i % 6 < 4 else [*wrapped(rng), "", head]), "", ""))
        rows.append((i + 10**7, "s", "\n".join([*wrapped(rng), "", "The counter shows", str(rng.randrange(10**5, 10**7)), "cycles of load and the wing holds."]), "", ""))
    got = {tuple(r) for r in S.found_noise(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {i for i, n in got if n == "furniture"} == set(range(first, first + 80))


def test_labels():
    model = S.Lines({"caps_number": 3.3, "roman": 3.1, "title_number": 2.7, "number": 3.1, "caps": -4.0})
    page = "CHAPTER 3    40\n\nText of the page that runs on\nand ends here.\n\nDRAG\nmore text\n\n- 7 -"
    assert [st for *_, st, _ in model.label(page)] == [0, 2, 1, 1, 2, 1, 1, 2, 0]
    assert S.HEADER not in [st for *_, st, _ in model.label("1.5\n2.5\n12\n3.5\n44")]
    assert model.label("") == [] or all(st == S.BREAK for *_, st, _ in model.label(""))
    text = "a\n\nb\n"
    assert "".join(text[s:e] for s, e, *_ in model.label(text)) == text


def test_empty_table(spark):
    assert S.found_noise(spark.createDataFrame([], COLUMNS)).count() == 0
