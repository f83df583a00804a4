"""Operator 6's minimum-covariance-determinant estimate against numpy, and clumps that try to draw it away."""

from __future__ import annotations

import numpy as np
import pytest

from missive.llm import outliers
from missive.session import materialise

SCALE = np.array([0.5, 0.6, 0.1, 0.3])
CENTRE = np.array([6.0, 5.0, 0.3, 0.9])


def frame(spark, groups):
    rows = [("g", name, *map(float, x)) for name, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "glang string, gsource string, x0 double, x1 double, x2 double, x3 double")


def numpy_mcd(x, starts=60, seed=1):
    """Least determinant over many random starts of plain concentration steps, scaled like the operator's."""
    rng = np.random.default_rng(seed)
    floor = np.diag([outliers.FLOOR[s] ** 2 for s in outliers.STATS])
    h, best = len(x) // 2, None
    for _ in range(starts):
        pick = rng.choice(len(x), 6, replace=False)
        for _ in range(100):
            centre, cov = x[pick].mean(0), np.cov(x[pick].T, bias=True) + floor
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            new = np.argsort(d2, kind="stable")[:h]
            if set(new) == set(pick):
                break
            pick = new
        det = np.linalg.det(cov)
        if best is None or det < best[0]:
            best = (det, centre, cov)
    _, centre, cov = best
    d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    return centre, d2 / max(np.median(d2) / outliers.CHI2_MEDIAN, 1.0)


def distances(spark, df):
    est = materialise(outliers.mcd(df), "test-mcd")
    got = outliers._distance(df, est).collect()
    return {r["gsource"]: r for r in est.collect()}, {tuple(r[s] for s in ("gsource", *outliers.STATS)): r["d2"] for r in got}


def test_centre_and_distances_match_numpy(spark):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    groups = {
        "plain": rng.normal(CENTRE, SCALE, (700, 4)),
        "leaning": CENTRE + (rng.normal(size=(500, 4)) * [3, 1, 0.5, 0.3]) @ turn * SCALE,
        "with outliers": np.concatenate([rng.normal(CENTRE, SCALE, (400, 4)), rng.normal(CENTRE + 9 * SCALE, SCALE, (120, 4))]),
    }
    est, got = distances(spark, frame(spark, groups))
    for name, x in groups.items():
        centre, d2 = numpy_mcd(x)
        mine = np.array([got[(name, *map(float, r))] for r in x])
        assert np.abs(np.array([est[name][f"m_{s}"] for s in outliers.STATS]) - centre).max() < 0.25 * SCALE.max(), name
        near = d2 < 20
        assert np.median(np.abs(np.sqrt(mine[near]) - np.sqrt(d2[near]))) < 0.25, name
        assert ((mine > outliers.CUTOFF) == (d2 > outliers.CUTOFF)).mean() > 0.99, name


@pytest.mark.parametrize("share", [0.2, 1 / 3, 0.4])
@pytest.mark.parametrize("spread", [0.0, 0.1])
def test_a_clump_does_not_draw_the_estimate(spark, share, spread):
    """Copies of one junk row, or a tight clump, 9 and more deviations off: all rejected, good rows kept."""
    rng = np.random.default_rng(4)
    good = rng.normal(CENTRE, SCALE, (600, 4))
    n = round(600 * share / (1 - share))
    bad = CENTRE + np.array([9, 9, 9, 9]) * np.maximum(SCALE, list(outliers.FLOOR.values())) + rng.normal(size=(n, 4)) * spread * SCALE
    _, got = distances(spark, frame(spark, {"s": np.concatenate([good, bad])}))
    assert all(got[("s", *map(float, x))] > outliers.CUTOFF for x in bad)
    assert np.mean([got[("s", *map(float, x))] > outliers.CUTOFF for x in good]) < 0.01


def test_a_clump_six_deviations_off_leaves_the_centre(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(CENTRE, SCALE, (600, 4))
    bad = CENTRE + 6 * np.maximum(SCALE, list(outliers.FLOOR.values())) * [1, 1, 1, 1] + np.zeros((300, 4))
    est, got = distances(spark, frame(spark, {"s": np.concatenate([good, bad])}))
    assert np.abs(np.array([est["s"][f"m_{s}"] for s in outliers.STATS]) - CENTRE).max() < 0.3
    assert got[("s", *map(float, bad[0]))] > outliers.CUTOFF


def test_equal_rows_and_two_rows(spark):
    est, got = distances(spark, frame(spark, {"same": np.tile(CENTRE, (80, 1)), "two": np.array([CENTRE, CENTRE + SCALE])}))
    assert got[("same", *map(float, CENTRE))] < 1e-6 and set(est) == {"same", "two"}
    assert outliers.mcd(frame(spark, {})).count() == 0
