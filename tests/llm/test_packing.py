import re

import numpy as np

from windloom.llm.packing import curve_position, found_divided, hilbert_key, pack_containers


def test_hilbert_neighbours_are_adjacent():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = hilbert_key(grid, 3)
    assert sorted(key) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_similar_texts_get_the_same_place():
    a, b = curve_position(["Lift and drag of the wing, lift and drag", "lift AND drag of the wing lift and drag!"])
    assert a == b


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["wing"] * int(n)), 0) for i, n in enumerate(rng.integers(1, 700, 3000))]
    rows += [(90001, " ".join(["w"] * 2500), 0), (90002, "", 0), (90003, None, 0), (90004, " ".join(["w"] * 1024), 0), (90005, " ".join(["w"] * 2048), 0)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, tokens int")
    got = pack_containers(docs, "doc_id", "text", 1024, partitions=2).toPandas()
    size = {i: len(re.findall(r"\w+|[^\w\s]+", t or "")) for i, t, _ in rows}
    assert got.groupby("doc_id").tokens.sum().to_dict() == size
    fill = got.groupby("container").tokens.sum()
    assert fill.max() <= 1024 and fill.sum() / (1024 * len(fill)) > 0.97
    pieces = got.groupby("doc_id").piece.count()
    assert set(pieces.index[pieces > 1]) == {90001, 90005} == {r[0] for r in found_divided(docs).collect()}
    assert (got.start_token == (got.piece - 1) * 1024).all()


def test_empty_table(spark):
    assert pack_containers(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
