import datetime as dt

import numpy as np
import pandas as pd
import pytest

from windloom.operators import spikes as S

ANGLES = np.arange(-5, 20.5, 0.5)


def sweep(runs, seed=0, rig="r", first=0, lift=0.0, scatter=0.004):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(runs):
        cl = 0.45 + 0.09 * ANGLES - 0.0022 * ANGLES**2 + lift + rng.normal(0, scatter, len(ANGLES))
        cd = 0.015 + 0.0002 * ANGLES**2 + rng.normal(0, 0.0001, len(ANGLES))
        at = dt.datetime(2023, 1, 1) + dt.timedelta(hours=7 * (first + k))
        for j, a in enumerate(ANGLES):
            rows.append((1000 * (first + k) + j + 1_000_000 * seed, first + k, rig, a, round(cl[j], 4), round(cd[j], 5), round(cl[j], 4) / round(cd[j], 5), at))
    return pd.DataFrame(rows, columns=["point_id", "run_id", "rig", "AoA", "Cl", "Cd", "ClCd", "run_at"])


def flags(spark, pdf):
    return S.measurement_flags(spark.createDataFrame(pdf)).toPandas().set_index("point_id").sort_index()


def test_finds_planted_cases_and_nothing_else(spark):
    rng = np.random.default_rng(5)
    pdf = pd.concat([sweep(40), sweep(30, first=40, lift=0.3), sweep(9, seed=1, rig="few", scatter=0.02)], ignore_index=True)
    spikes = rng.choice(np.flatnonzero(pdf.rig == "r"), 40, replace=False)
    pdf.loc[spikes, "Cl"] += 0.25
    pdf.loc[spikes, "ClCd"] = pdf.loc[spikes, "Cl"] / pdf.loc[spikes, "Cd"]
    row = pdf.index[(pdf.run_id == 7) & (pdf.rig == "r")][10:16]
    pdf.loc[row, ["Cl"]] = pdf.loc[row[0], "Cl"]
    pdf.loc[row, "ClCd"] = pdf.loc[row, "Cl"] / pdf.loc[row, "Cd"]
    odd = pdf.index[(pdf.run_id == 50)][3]
    pdf.loc[odd, "Cd"] = -pdf.loc[odd, "Cd"]
    twist = pdf.index[(pdf.run_id == 51)][30]
    pdf.loc[twist, "ClCd"] *= 1.2
    got = flags(spark, pdf)
    assert len(got) == len(pdf)
    assert set(pdf.point_id[spikes]) - set(row) <= set(got.index[got.spike])
    assert set(got.index[got.constant]) == set(pdf.point_id[row[1:]])
    assert {pdf.point_id[odd], pdf.point_id[twist]} <= set(got.index[got.impossible | got.contradictory])
    extra = set(got.index[got.spike | got.impossible]) - set(pdf.point_id[spikes]) - set(pdf.point_id[row]) - {pdf.point_id[odd], pdf.point_id[twist]}
    assert len(extra) <= 2  # GESD at its own error rate


def test_blocks_do_not_change_the_result(spark):
    pdf = sweep(300, scatter=0.003)
    pdf.loc[::97, "Cl"] += 0.2
    wide = flags(spark, pdf)
    assert wide.spike.sum() >= len(pdf.loc[::97]) and len(wide) == len(pdf)


def test_constant_rows_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.integers(0, 2, 60).astype(float)
        v[rng.random(60) < 0.05] = np.nan
        run = np.repeat([0, 1, 2], 20)
        want = np.zeros(60, bool)
        for i in range(60):
            for j in range(i + 1, 61):
                if all(run[k] == run[i] and v[k] == v[i] for k in range(i, j)) and j - i >= 5:
                    want[i + 1 : j] = True
        assert (S._constant(run, v) == want).all()


def test_gesd_limits_match_the_published_example():
    # Rosner 1983: n = 54, 10 outliers, alpha 0.05
    assert S.gesd_limits(54, np.arange(1, 11), 0.05)[:3] == pytest.approx([3.159, 3.151, 3.144], abs=0.01)


def test_nulls_repeats_and_empty(spark):
    pdf = sweep(12)
    pdf.loc[5, ["Cl", "Cd", "ClCd"]] = np.nan
    pdf.loc[6, "AoA"] = np.nan
    pdf = pdf.assign(rig=lambda d: d.rig.where(d.index % 5 > 0), block=7, source="x")
    pdf.loc[9, "run_at"] = pd.NaT
    pdf = pd.concat([pdf, pdf.iloc[:50]], ignore_index=True)
    assert len(flags(spark, pdf)) == 12 * 51
    assert S.measurement_flags(spark.createDataFrame(pdf).limit(0)).count() == 0


def test_limits_decide_whatever_the_size():
    rng = np.random.default_rng(3)
    for n, planted in ((100, 5.4), (5000, 6.0), (20, 8.0), (12, 8.0)):
        z = rng.standard_normal(n)
        z /= max(1.0, np.abs(z).max() / 2.5)
        z[7] = planted
        assert list(np.flatnonzero(S.gesd(z))) == [7]
    six = np.array([0.1, -0.2, 0.15, 900.0, -950.0, 1000.0])
    assert S.gesd(six).sum() in (0, 3)
    assert not S.gesd(np.array([1.0, 5.0])).any() and not S.gesd(np.zeros(50)).any()
    assert sum(S.gesd(rng.standard_normal(300)).any() for _ in range(300)) < 15


def test_rounding_step():
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 500)
    assert [S.rounding(np.round(v / q) * q) for q in (0.1, 0.005, 0.0002)] == pytest.approx([0.1, 0.005, 0.0002])
    assert S.rounding(v) == 0.0 and S.rounding(v[:0]) == 0.0


def test_points_without_run_and_repeated_or_odd_angles(spark):
    pdf = sweep(60, seed=2)
    pdf.loc[1000, "Cl"] += 0.3
    pdf.loc[2000, "ClCd"] = np.nan
    pdf.loc[2000, "Cl"] += 0.3
    loose = pdf.assign(run_id=np.nan, rig="loose", point_id=pdf.point_id + 10_000_000, run_at=dt.datetime(2023, 5, 1))
    twice = pdf.assign(run_id=pdf.run_id // 2, rig="twice", point_id=pdf.point_id + 20_000_000, AoA=pdf.AoA + 40)
    got = flags(spark, pd.concat([pdf, loose, twice], ignore_index=True).astype({"run_id": "Int64"}))
    assert len(got) == 3 * len(pdf)
    for shift in (0, 10_000_000, 20_000_000):
        assert got.spike[pdf.point_id[[1000, 2000]] + shift].all()
    assert got.spike.sum() <= 10
