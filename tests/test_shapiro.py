"""The test of normality against published values and a plain reading of the method."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from quern.operators import statistics

#: Weights of eleven men, the published example: W 0.79, p 0.0067.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def plain(x):
    x = sorted(x)
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = (m**2).sum(), 1 / math.sqrt(n)
    up = lambda parts, v: sum(c * v**k for k, c in enumerate(parts))
    a = np.zeros(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        last = up(statistics._LAST, u) + m[-1] / math.sqrt(mm)
        if n > 5:
            second = up(statistics._LAST_BUT_ONE, u) + m[-2] / math.sqrt(mm)
            a = m / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
            a[1], a[-2] = -second, second
        else:
            a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[0], a[-1] = -last, last
    w = (a @ np.array(x)) ** 2 / ((np.array(x) - np.mean(x)) ** 2).sum()
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(1 - w)
    if n <= 11:
        y = -math.log(up(statistics._GAMMA, n) - y)
        mean, spread = up(statistics._SMALL_MEAN, n), math.exp(up(statistics._SMALL_SPREAD, n))
    else:
        mean, spread = up(statistics._MEAN, math.log(n)), math.exp(up(statistics._SPREAD, math.log(n)))
    return w, 1 - NormalDist().cdf((y - mean) / spread)


def test_quantiles():
    p = np.concatenate([np.linspace(0.0005, 0.9995, 999), [1e-12, 1e-40, 1e-300, 1 - 1e-12]])
    assert np.allclose(statistics.normal_quantile(p), [NormalDist().inv_cdf(float(x)) for x in p], rtol=1e-13, atol=1e-14)


def test_published_and_plain_values(spark):
    rng = np.random.default_rng(3)
    groups = {"men": [float(x) for x in MEN], "none": [1.0, 2.0], "same": [4.0] * 6}
    groups |= {f"n{n}": rng.normal(5, 2, n).tolist() for n in (3, 4, 5, 6, 7, 11, 12, 30, 200)} | {"skew": rng.exponential(1, 150).tolist(), "tied": [float(v) for v in rng.integers(0, 5, 60)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("men", None), ("men", float("nan"))]
    got = {r.g: r for r in statistics.shapiro_wilk(spark.createDataFrame(rows, "g string, x double").repartition(3), "x", "g").collect()}
    assert (round(got["men"].w, 5), round(got["men"].p_value, 4)) == (0.78881, 0.0067)
    assert got["none"].w is None and got["same"].p_value is None and got["men"].n == 11
    for g, xs in groups.items():
        if g not in ("none", "same"):
            assert np.allclose([got[g].w, got[g].p_value], plain(xs), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(None, 1.0), (None, 2.0), (None, 4.0)]])
def test_no_rows_and_a_null_group(spark, rows):
    out = statistics.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()
    assert len(out) == (1 if rows else 0) and all(abs(r.w - plain([1, 2, 4])[0]) < 1e-9 for r in out)
