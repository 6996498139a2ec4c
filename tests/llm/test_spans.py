import hashlib
import random

import numpy as np

from windloom.llm.spans import SharedSpans, chunk_digests, cuts, found_pairs, longest_common, sizes

LETTERS = "abcdefghij klmn\néß漢😀"


def words(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def brute(rows, span):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            seen.setdefault(t[k : k + span], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def test_chunk_of_a_shared_span_is_always_common():
    rng = random.Random(3)
    for span in (60, 100, 300):
        for _ in range(150):
            shared = words(rng, span) if rng.random() < 0.8 else (words(rng, rng.randint(1, 9)) * span)[:span]
            a, b = (words(rng, rng.randint(0, 90)) + shared + words(rng, rng.randint(0, 90)) for _ in "ab")
            da, db = (set(chunk_digests([t], span)[1].tolist()) for t in (a, b))
            assert da & db


def test_batches_do_not_change_chunks():
    rng = random.Random(4)
    texts = [words(rng, n) for n in (0, 10, 299, 300, 301, 5000)]
    got = chunk_digests(texts, 300)
    for k, t in enumerate(texts):
        own = chunk_digests([t], 300)
        assert (got[1][got[0] == k] == own[1]).all() and (got[2][got[0] == k] == own[2]).all()


def test_long_texts_in_stretches(monkeypatch):
    import pandas as pd

    from windloom.llm import spans

    rng = random.Random(8)
    text = words(rng, 9000)
    want = set(zip(*(x.tolist() for x in chunk_digests([text], 60)[1:])))
    monkeypatch.setattr(spans, "STRETCH", 1000)
    got = pd.concat(spans._chunker(60)(iter([pd.DataFrame({"id": [5], "text": [text]})])))
    assert want <= set(zip(got.digest, got.start, got.length)) and len(got) < 1.5 * len(want)


def test_longest_common():
    assert longest_common("xxhello", "hello there", 2, 3, 4) == (2, 7)
    assert longest_common("abcdef", "abXdef", 0, 4, 5) == (3, 6)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    parts = [words(rng, n) for n in (59, 60, 61, 75, 90, 150, 400)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice([words(rng, rng.randint(1, 60)), rng.choice(parts)]) for _ in range(rng.randint(0, 4)))
        rows.append((i, t))
    rows += [(200 + k, rows[7][1] + "tail") for k in range(3)] + [(300 + k, words(rng, 70) if k < 2 else parts[5]) for k in range(5)]
    rows += [(400, "a" * 500), (401, "b" + "a" * 80), (402, None), (403, "")]
    want = brute(rows, 60)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + rows[:20]], "doc_id long, text string, id int, rep string")
    got = {tuple(r) for r in found_pairs(docs, 60).select("doc_a", "doc_b").collect()}
    assert got == want and len(want) > 50


def test_shared_parts_equal_brute_force(spark):
    rng = random.Random(6)
    p, q = words(rng, 100), words(rng, 130)
    rows = [(1, "aa" + p + "zz"), (2, "b" + p + "yyyy" + q), (3, q + "c"), (4, words(rng, 200)), (5, "copy" * 40), (6, "copy" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["copies"], r["shared_chars"], r["n_spans"]) for r in SharedSpans(docs, "doc_id", "text", 80).shared_parts().collect()}
    assert got == {1: (1, 100, 1), 2: (1, 230, 2), 3: (1, 130, 1), 5: (2, 160, 1)}


def test_passages_and_links_of_every_record(spark):
    rng = random.Random(16)
    p, q = words(rng, 100), words(rng, 130)
    rows = [(1, "aa" + p + "zz"), (2, "b" + p + "yyyy" + q), (3, q + "c"), (4, words(rng, 200)), (5, "copy" * 40), (6, "copy" * 40), (7, q + "tail"), (8, q + "tail")]
    spans = SharedSpans(spark.createDataFrame(rows + rows[:3], "doc_id long, text string"), "doc_id", "text", 80)
    text = dict(rows)
    got = sorted(map(tuple, spans.passages().collect()))
    want = [(1, 2, 100), (2, 1, 100), (2, 105, 130), (3, 0, 130), (5, 0, 160), (6, 0, 160), (7, 0, 134), (8, 0, 134)]
    assert got == [(i, s, n, hashlib.md5(text[i][s : s + n].encode()).hexdigest()) for i, s, n in want]
    assert {tuple(r) for r in spans.links().collect()} == {(1, 1), (2, 4), (3, 3), (5, 1), (6, 1), (7, 3), (8, 3)}


def test_near_copy_shares_both_sides_of_a_change(spark):
    rng = random.Random(7)
    p, q, r = words(rng, 240), words(rng, 160), words(rng, 50)
    docs = spark.createDataFrame([(1, p + "X" + q + "X" + r), (2, p + "Y" + q + "Y" + r)], "doc_id long, text string")
    got = {tuple(x) for x in SharedSpans(docs, "doc_id", "text", 80).shared_parts().select("id", "shared_chars", "n_spans").collect()}
    assert got == {(1, 400, 2), (2, 400, 2)}


def test_shared_chars_of_many_texts_equal_brute_force(spark):
    rng = random.Random(9)
    parts = [words(rng, n) for n in (79, 80, 81, 95, 150, 400)]
    rows = [(i, "".join(rng.choice([words(rng, rng.randint(1, 60)), rng.choice(parts)]) for _ in range(rng.randint(1, 5)))) for i in range(150)]
    rows = list({t: (i, t) for i, t in rows}.values())
    seen = {}
    for i, t in rows:
        for k in range(len(t) - 79):
            seen.setdefault(t[k : k + 80], set()).add(i)
    want = {}
    for i, t in rows:
        covered = {c for k in range(len(t) - 79) if len(seen[t[k : k + 80]]) > 1 for c in range(k, k + 80)}
        if covered:
            want[i] = len(covered)
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    got = {r["id"]: r["shared_chars"] for r in SharedSpans(docs, "doc_id", "text", 80).shared_parts().collect()}
    assert got == want and len(want) > 50


def test_one_passage_in_very_many_texts_forms_no_pairs(spark):
    rng = random.Random(10)
    passage = words(rng, 120)
    docs = spark.createDataFrame([(i, f"{i * 7919:09d} {passage} {i * 104729:011d}") for i in range(5000)], "doc_id long, text string")
    parts = SharedSpans(docs, "doc_id", "text", 80).shared_parts()
    assert parts.filter("shared_chars between 122 and 140").count() == 5000


def test_empty(spark):
    assert found_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sizes(300)[0] == 71 and len(cuts(np.zeros(0, np.uint32), np.zeros(1, np.int64), 5)) == 0
