import re

import numpy as np
import pandas as pd

from windloom.llm.mixing import found_short_sources, mix_plan, rake
from windloom.llm.tokens import bpe_count, wordpunct_count

DOCS = "doc_id long, text string, lang string, source string, tokens long, _text int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        src = rng.choice(["big", " Big ", "BIG", "mid", "small", "other"], p=[0.4, 0.1, 0.1, 0.25, 0.05, 0.1])
        text = " ".join(rng.choice(["aerodynamics", "stabilization", "word", "x.", "propellers,"], rng.integers(1, 60)))
        rows.append((i, text, str(rng.choice(["en", "EN", "de"])), str(src), 1, 0))
    return rows


def test_rake_meets_source_shares_and_caps():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(50, 500))) for s in "abc" for l in ("en", "de") for t in range(3)], columns=["source", "lang", "topic", "tokens"])
    total = cells.tokens.sum()
    w = rake(cells, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 4, "b": 4, "c": 4}, total)
    got = (w * cells.tokens).groupby(cells.source).sum() / total
    assert np.allclose(got[["a", "b", "c"]], [0.5, 0.3, 0.2], atol=1e-6)
    tight = cells[cells.source == "a"].tokens.sum() / total * 0.999  # all but one part in a thousand of its cap
    w = rake(cells, {"a": tight, "b": 0.1, "c": 0.1}, {"a": 1, "b": 4, "c": 4}, total)
    assert abs((w * cells.tokens)[cells.source == "a"].sum() / total - tight) < 1e-12
    w = rake(cells, {"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 1, "b": 1, "c": 1}, total)
    assert w.max() <= 1 and np.allclose(w[cells.source == "a"], 1)


def test_shares_caps_and_short_sources(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame(rows + rows[:200], DOCS)
    targets = spark.createDataFrame([("big", 0.3, 1), ("Mid", 0.5, 3), ("small", 0.15, 2), ("none", 0.05, 9)], TARGETS)
    report, sample = mix_plan(docs, targets)
    got = report.toPandas().set_index("source")
    size = {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t, *_ in rows}
    true = {}
    for i, _, _, s, *_ in rows:
        true[s.strip().lower()] = true.get(s.strip().lower(), 0) + size[i]
    total = true["big"] + true["mid"] + true["small"]
    assert got.tokens.to_dict() == {"big": true["big"], "Mid": true["mid"], "small": true["small"], "none": 0}
    short = {s for s, r in got.iterrows() if r.tokens * r.max_repeats < r.target_share * total}
    assert {r[0] for r in found_short_sources(docs, targets).collect()} == short == set(got.index[~got.feasible])
    chosen = sample.toPandas()
    assert chosen.doc_id.is_unique and (chosen.copies <= chosen.source.map({"big": 1, "mid": 3, "small": 2})).all()
    used = (chosen.copies * chosen.doc_id.map(size)).groupby(chosen.source).sum()
    assert used["big"] == got.used_tokens["big"]
    assert abs(got.used_tokens["big"] / total - 0.3) < 0.01 and abs(got.used_tokens["Mid"] / total - 0.5) < 0.01
    assert abs(got.actual_share.sum() - 1) < 1e-9


def test_languages_are_raked_and_short_sources_used_up(spark):
    docs = spark.createDataFrame(corpus(spark), DOCS)
    targets = spark.createDataFrame([("big", 0.6, 4), ("mid", 0.2, 4), ("small", 0.2, 2)], TARGETS)
    languages = spark.createDataFrame([("en", 0.3), ("de", 0.7)], "lang string, target_share double")
    report, sample = mix_plan(docs, targets, languages=languages)
    got = report.toPandas().set_index("source")
    assert not got.feasible["small"] and got.used_tokens["small"] == got.reachable["small"]
    assert abs(got.reached_share["big"] - 0.6) < 0.006 and abs(got.reached_share["mid"] - 0.2) < 0.002
    lang = {r["doc_id"]: r["lang"].lower() for r in docs.collect()}
    used = sample.toPandas()
    assert 0.67 < (used.tokens * used.copies)[used.doc_id.map(lang) == "de"].sum() / (used.tokens * used.copies).sum() < 0.73
    assert mix_plan(docs, targets, total=1000)[0].toPandas().used_tokens.sum() < 1100


def test_nulls_and_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    docs = spark.createDataFrame([(1, None, None, "a", 1, 0), (2, "", "en", None, 1, 0), (None, "x", "zz-weird", "a", 1, 0)], DOCS)
    report, sample = mix_plan(docs, targets)
    assert report.first()["tokens"] == 1
    report, sample = mix_plan(docs.limit(0), targets)
    assert report.first()["actual_share"] is None and sample.count() == 0
    assert mix_plan(docs, targets.limit(0))[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("a_b c3-- d!é €5", 1), (None, 2), ("x y", 3)], "t string, k int")
    assert [r[0] for r in df.orderBy("k").select(wordpunct_count(df.t)).collect()] == [8, None, 2]
    got = [r[0] for r in df.orderBy("k").select(bpe_count("/opt/tokenizers/byte_bpe_50k.json")("t")).collect()]
    assert got[0] > 5 and got[1] is None
