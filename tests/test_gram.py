"""Cross products in one scan: correlations with nulls, constants and offsets; linear models of all folds and alphas."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import gram, models as m, profile as prof, regression as reg


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40))
    x[:, 3] = 7.1  # constant
    x[:, 5] = 1e9 + x[:, 0] * 1e-3
    x[:, 6] = x[:, 1] * 2 + rng.normal(size=500)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 8] = np.nan
    return x


def frame(spark, values, parts=5):
    rows = [(i, i % 3, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(values)]
    names = [f"c{i}" for i in range(values.shape[1])]
    return spark.createDataFrame(rows, "id long, fold int, " + ", ".join(f"{c} double" for c in names)).repartition(parts), names


@pytest.mark.parametrize("fan", [2, 32])
def test_correlations_are_pairwise_complete(spark, values, fan, monkeypatch):
    monkeypatch.setattr(gram, "FAN_IN", fan)
    df, names = frame(spark, values, 9)
    got = {(r["a"], r["b"]): r["r"] for r in prof.correlations(df, names).collect()}
    assert len(got) == 40 * 39 // 2
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            a, b = values[both, i], values[both, j]
            want = np.corrcoef(a, b)[0, 1] if both.sum() > 1 and np.ptp(a) > 0 and np.ptp(b) > 0 else None
            r = got[names[i], names[j]]
            assert (r is None) == (want is None) and (r is None or r == pytest.approx(want, abs=1e-6 if 5 in (i, j) else 1e-9))


def test_one_scan_for_many_columns(spark, values):
    scans = spark.sparkContext.accumulator(0)
    df, names = frame(spark, values)

    def seen(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    gram.pair_moments(df.mapInArrow(seen, df.schema), names)
    assert scans.value == len(values)


def test_normal_equations(spark, values):
    full = np.nan_to_num(values[:, [0, 1, 2, 4]])
    df, names = frame(spark, full)
    n, means, c = reg.cross_products(df, names)
    assert n == 500 and means == pytest.approx(full.mean(axis=0)) and c == pytest.approx((full - full.mean(axis=0)).T @ (full - full.mean(axis=0)))
    model = gram.linear_of(gram.pair_moments(df, names, True), names[:3], "linear", 0.0)
    want = np.linalg.lstsq(np.c_[np.ones(500), full[:, :3]], full[:, 3], rcond=None)[0]
    assert [model.intercept, *model.slopes] == pytest.approx(want)
    assert gram.linear_of(gram.pair_moments(df, names, True), names[:3], "lasso", 0.0).slopes == pytest.approx(want[1:])


def plain_lasso(x, y, alpha):
    """Subgradient conditions hold at the minimum."""
    b = np.zeros(x.shape[1])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    for _ in range(3000):
        for j in range(len(b)):
            rest = xc[:, j] @ (yc - xc @ b + xc[:, j] * b[j]) / len(y)
            b[j] = np.sign(rest) * max(abs(rest) - alpha, 0) / (xc[:, j] @ xc[:, j] / len(y))
    return b, y.mean() - x.mean(axis=0) @ b


def test_alpha_by_folds(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 5)) + 1000
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=240)
    df, names = frame(spark, np.c_[x, y])
    alphas = [0.01, 0.1, 0.5, 3.0]
    rows, model, best = gram.cross_validated(df, names[:5], names[5], "fold", alphas)
    fold = np.arange(240) % 3
    want = {}
    for a in alphas:
        errors = []
        for f in range(3):
            b, b0 = plain_lasso(x[fold != f], y[fold != f], a)
            errors.append(((y[fold == f] - b0 - x[fold == f] @ b) ** 2).mean())
        want[a] = (np.mean(errors), np.std(errors, ddof=1))
    assert {r[0]: r[1:] for r in rows} == {a: pytest.approx(w, rel=1e-6) for a, w in want.items()}
    assert best == min(want, key=lambda a: want[a][0])
    assert model.slopes == pytest.approx(plain_lasso(x, y, best)[0], abs=1e-7)
    again, _, _ = gram.cross_validated(df.repartition(7), names[:5], names[5], "fold", alphas)
    assert [r[1] for r in again] == pytest.approx([r[1] for r in rows], rel=1e-9)
    path, _, _ = gram.cross_validated(df, names[:5], names[5], "fold")
    assert len(path) == 100 and gram.linear_of(gram.pair_moments(df, names, True), names[:5], "lasso", path[0][0]).slopes == pytest.approx(np.zeros(5), abs=1e-9)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    assert prof.correlations(df, ["a", "b"]).first()["r"] is None
    assert prof.correlations(df.limit(0), ["a", "b"]).first()["r"] is None
    assert gram.pair_moments(df, ["a", "b"], complete=True).n[0, 0] == 0
