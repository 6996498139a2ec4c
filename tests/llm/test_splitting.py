import random

from pyspark.sql import functions as F

from windloom.llm.splitting import found_oversized, split_oversized

WORDS = ["alpha", "beta,", "gamma.", "delta;", "x", "naïve", "端", "e.g."]
GAPS = [" ", "  ", "\n", "\n\n", " ", "\t", " "]


def text(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(n))


def pieces(spark, rows, **kw):
    got = split_oversized(spark.createDataFrame(rows, "id long, body string, text int"), "id", "body", **kw)
    out = {}
    for r in got.collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece"]) for k, v in out.items()}


def test_round_trip_limit_and_overlap(spark):
    rows = [(i, text(n, i), 0) for i, n in enumerate([1, 29, 30, 31, 75, 400, 2000])]
    for kw in ({"limit": 30, "overlap": 5}, {"limit": 30, "overlap": 0}, {"limit": 60, "overlap": 20, "unit": "chars"}):
        got = pieces(spark, rows, **kw)
        size = len if kw.get("unit") == "chars" else lambda s: len(s.split())
        for i, body, _ in rows:
            own = ""
            for r in got[i]:
                assert size(r["text"]) <= kw["limit"]
                assert r["start"] == len(own)
                if r["piece"] > 1:
                    assert 0 < r["overlap_units"] <= kw["overlap"] or kw["overlap"] == 0
                cut = 0
                while own and not (body.startswith(r["text"][cut:], len(own))):
                    cut += 1
                assert own.endswith(r["text"][:cut])
                own += r["text"][cut:]
            assert own == body
            assert (len(got[i]) > 1) == (size(body) > kw["limit"])


def test_prefers_paragraph_then_sentence(spark):
    body = "one two three. four five\n\nsix seven eight nine ten eleven twelve"
    got = pieces(spark, [(1, body, 0)], limit=8, overlap=0)[1]
    assert got[0]["text"] == "one two three. four five\n\n"
    body = "one two three, four five. six seven eight nine ten eleven twelve"
    assert pieces(spark, [(1, body, 0)], limit=8, overlap=0)[1][0]["text"] == "one two three, four five. "


def test_null_empty_repeated_and_unspaced(spark):
    wide = "字" * 5000
    got = pieces(spark, [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b c", 0), (4, "a b c", 0), (5, wide, 0), (None, "a", 0)], limit=4, overlap=1, word_chars=400)
    assert 1 not in got and [r["text"] for r in got[2]] == [""] and len(got[3]) == 1 and len(got[4]) == 2
    assert len(got[5]) > 1 and got[5][-1]["start"] < 5000 and len(got[None]) == 1
    assert split_oversized(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0


def test_a_long_word_is_one_word(spark):
    rows = [(1, "w " * 419 + "x" * 900), (2, "w " * 420 + "x" * 900), (3, "x" * 100000)]
    got = pieces(spark, [(i, t, 0) for i, t in rows])
    assert {i: len(p) > 1 for i, p in got.items()} == {1: False, 2: True, 3: False}
    assert [r[0] for r in found_oversized(spark.createDataFrame(rows, "page_id long, text string")).collect()] == [2]


def test_cuts_where_the_text_pauses(spark):
    rng = random.Random(5)
    sentences = [" ".join(["word"] * rng.randint(5, 30)) + ". " for _ in range(2000)]
    body = "".join(s + ("\n\n" if rng.random() < 0.1 else "") for s in sentences)
    cuts = [r["text"] for r in pieces(spark, [(1, body, 0)])[1]][:-1]
    assert len(cuts) > 50 and all(t.rstrip().endswith(".") for t in cuts)


def test_found_counts_words(spark):
    rows = [(1, "w " * 420), (2, "w " * 421), (2, "w " * 421), (3, None), (4, "字" * 200000), (5, "w " * 421), (6, "w​" * 500)]
    got = found_oversized(spark.createDataFrame(rows, "page_id long, text string"))
    assert sorted(r[0] for r in got.select(F.col("page_id")).collect()) == [2, 5]
