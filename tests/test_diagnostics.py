import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import regression as reg, series as ts


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(4)
    a = np.cumsum(rng.normal(size=120))
    b = rng.normal(size=80)
    return {"a": a, "b": b}


@pytest.fixture(scope="module")
def rows(spark, walk):
    data = [(k, i * 10, float(v), float(v * v)) for k, s in walk.items() for i, v in enumerate(s)]
    return spark.createDataFrame(data, "k string, t long, v double, w double").repartition(4).cache()


LIMITS = [11, 10**9]


@pytest.mark.parametrize("chunk", LIMITS)
def test_autocorrelation(rows, walk, chunk):
    got = {(r["k"], r["lag"]): r["acf"] for r in ts.autocorrelation(rows, ["k"], "t", "v", 8, chunk).collect()}
    for k, s in walk.items():
        x = s - s.mean()
        for h in range(9):
            assert got[k, h] == pytest.approx((x[h:] * x[: len(x) - h]).sum() / (x * x).sum(), abs=1e-10)


def test_partial_autocorrelation_solves_yule_walker(rows, walk):
    acf = ts.autocorrelation(rows, ["k"], "t", "v", 5)
    got = {(r["k"], r["lag"]): r["pacf"] for r in ts.partial_autocorrelation(acf, ["k"]).collect()}
    table = {(r["k"], r["lag"]): r["acf"] for r in acf.collect()}
    for k in walk:
        r = [table[k, h] for h in range(6)]
        for p in range(1, 6):
            system = np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)])
            assert got[k, p] == pytest.approx(np.linalg.solve(system, r[1 : p + 1])[-1], abs=1e-9)


@pytest.mark.parametrize("chunk", LIMITS)
def test_cross_correlation_of_a_series_with_itself(rows, walk, chunk):
    got = {(r["k"], r["lag"]): r["ccf"] for r in ts.cross_correlation(rows.withColumn("u", F.col("v")), ["k"], "t", "v", "u", 4, chunk).collect()}
    for k, s in walk.items():
        assert got[k, 0] == pytest.approx((len(s) - 1) / len(s))
        assert got[k, 3] == pytest.approx(got[k, -3])


@pytest.mark.parametrize("chunk", LIMITS)
def test_dickey_fuller_equals_least_squares(rows, walk, chunk):
    got = {r["k"]: r for r in ts.dickey_fuller(rows, ["k"], "t", "v", 2, chunk).collect()}
    for k, s in walk.items():
        d = np.diff(s)
        y = d[2:]
        x = np.column_stack([np.ones(len(y)), s[2:-1], d[1:-1], d[:-2]])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        s2 = ((y - x @ beta) ** 2).sum() / (len(y) - 4)
        t = beta[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
        assert got[k]["statistic"] == pytest.approx(t, abs=1e-8)
        assert got[k]["n"] == len(y)


@pytest.mark.parametrize("chunk", LIMITS)
def test_kpss(rows, walk, chunk):
    got = {r["k"]: r["statistic"] for r in ts.kpss(rows, ["k"], "t", "v", 4, chunk).collect()}
    for k, s in walk.items():
        n = len(s)
        e = s - np.polyval(np.polyfit(np.arange(1, n + 1), s, 1), np.arange(1, n + 1))
        spread = (e * e).sum() + 2 * sum((1 - j / 5) * (e[j:] * e[:-j]).sum() for j in range(1, 5))
        assert got[k] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / (spread / n), abs=1e-9)


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 2)) + [5, -3]
    y = 1 + x @ [2.0, -0.5] + rng.normal(size=150) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    return df.cache(), np.column_stack([np.ones(150), x]), y


def test_ols_against_least_squares(design):
    df, x, y = design
    model = reg.ols(df, ["a", "b"], "y")
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = ((y - x @ beta) ** 2).sum() / 147
    se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
    rows = reg.coefficient_summary(df, model).collect()
    assert [r["coef"] for r in rows] == pytest.approx(beta.tolist(), abs=1e-9)
    assert [r["std_err"] for r in rows] == pytest.approx(se.tolist(), abs=1e-9)
    assert reg.fit_summary(df, model).first()["r2"] == pytest.approx(1 - s2 * 147 / ((y - y.mean()) ** 2).sum())


def test_influence_against_refits(design):
    df, x, y = design
    model = reg.ols(df, ["a", "b"], "y")
    rows = {r["id"]: r for r in reg.influence(df, model, "y", ["id"]).collect()}
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    for i in (0, 17, 149):
        keep = np.arange(150) != i
        b = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        s2 = ((y[keep] - x[keep] @ b) ** 2).sum() / 146
        want = (beta - b) / np.sqrt(s2 * np.diag(inv))
        assert [rows[i][f"dfbetas_{c}"] for c in ("intercept", "a", "b")] == pytest.approx(want.tolist(), abs=1e-9)
        assert rows[i]["leverage"] == pytest.approx(x[i] @ inv @ x[i])


def test_condition_number(design):
    df, x, _ = design
    got = reg.condition_number(df, ["a", "b"]).first()
    unit = x / np.r_[1.0, np.linalg.norm(x[:, 1]), np.linalg.norm(x[:, 2])]
    assert got["raw"] == pytest.approx(np.linalg.cond(x))
    assert got["scaled"] == pytest.approx(np.linalg.cond(unit))


def test_durbin_watson_and_goldfeld_quandt(design):
    df, x, y = design
    model = reg.ols(df, ["a", "b"], "y")
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert reg.durbin_watson(df, model, "y", "id").first()[0] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    halves = []
    for part in (slice(0, 75), slice(75, 150)):
        r = y[part] - x[part] @ np.linalg.lstsq(x[part], y[part], rcond=None)[0]
        halves.append((r**2).sum())
    assert reg.goldfeld_quandt(df, ["a", "b"], "y", "id").first()["f"] == pytest.approx(halves[1] / halves[0])


def test_joint_test_of_one_coefficient_is_its_t_squared(design):
    df, _, _ = design
    t = {r["term"]: r for r in reg.coefficient_summary(df, reg.ols(df, ["a", "b"], "y")).collect()}["b"]
    joint = reg.joint_f_test(df, ["a", "b"], ["b"], "y").first()
    assert joint["f"] == pytest.approx(t["t"] ** 2)
    assert joint["p"] == pytest.approx(t["p"])


def test_prediction_interval_covers(design):
    df, _, _ = design
    out = reg.prediction_interval(df, reg.ols(df, ["a", "b"], "y"))
    share = out.agg(F.avg(((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high"))).cast("int"))).first()[0]
    assert 0.88 <= share <= 1.0


def brute_level_test(v, lag, first):
    """(t of the level, log-likelihood) of the regression with so many lagged changes, on changes from `first` on."""
    d = np.diff(v)
    rows = range(first, len(d))
    x = np.array([[1.0, v[t], *[d[t - k] for k in range(1, lag + 1)]] for t in rows])
    y = np.array([d[t] for t in rows])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    sse, n = ((y - x @ b) ** 2).sum(), len(y)
    se = np.sqrt(sse / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return b[1] / se, -n / 2 * (np.log(2 * np.pi) + np.log(sse / n) + 1)


@pytest.mark.parametrize("chunk", [13, 100_000])
@pytest.mark.parametrize("criterion", ["aic", "bic"])
def test_lag_is_the_one_of_brute_force_refits(spark, chunk, criterion):
    rng = np.random.default_rng(3)
    made, rows = {}, []
    for s, memory in (("a", 0.3), ("b", 1.0), ("c", 0.8)):
        v = np.zeros(120)
        for t in range(3, 120):
            v[t] = memory * v[t - 1] + 0.4 * (v[t - 2] - v[t - 3]) + rng.normal()
        made[s] = v
        rows += [(s, t, float(x)) for t, x in enumerate(v)]
    rows += [("flat", t, 1.0) for t in range(50)] + [("short", 0, 1.0), ("a", 500, None)]
    df = spark.createDataFrame(rows, "s string, t int, v double").repartition(3)
    got = {r["s"]: r for r in ts.dickey_fuller_by_criterion(df, ["s"], "t", "v", 5, criterion, chunk=chunk).collect()}
    for s, v in made.items():
        n = len(v) - 1 - 5
        worth = {k: -2 * brute_level_test(v, k, 5)[1] + (2 if criterion == "aic" else np.log(n)) * (k + 2) for k in range(6)}
        lag = min(worth, key=worth.get)
        assert got[s]["lag"] == lag and got[s]["statistic"] == pytest.approx(brute_level_test(v, lag, lag)[0], rel=1e-8)
        assert got[s]["n"] == len(v) - 1 - lag
    assert got["a"]["p"] < 0.01 < 0.2 < got["b"]["p"]
    assert got["flat"]["statistic"] is None and got["short"]["p"] is None


def test_unit_root_p_is_monotone():
    from tabloom.functions import tails

    grid = np.linspace(-20, 4, 500)
    p = [tails.unit_root_p(float(t)) for t in grid]
    assert all(a <= b + 1e-3 for a, b in zip(p, p[1:])) and p[0] == 0.0 and p[-1] == 1.0
    # published critical values at 1, 5 and 10 %
    assert [tails.unit_root_p(t) for t in (-3.43, -2.86, -2.57)] == pytest.approx([0.01, 0.05, 0.10], abs=0.002)


def test_formula_equals_hand_built_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.random() + 0.5), float(rng.random()), "uvw"[i % 3], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y double, a double, c string, k int")
    got = reg.formula_design(df, "log(y) ~ a + log(1 + a) + I(a * (y - 1)) + C(k):a")
    hand = df.withColumns({"ly": F.ln("y"), "la": F.ln(1 + F.col("a")), "m": F.col("a") * (F.col("y") - 1), "ck": F.col("k").cast("string")})
    want = reg.formula_design(hand, "ly ~ a + la + m + ck:a")
    assert got.columns == [*df.columns, "features", "label"]
    pairs = zip(got.orderBy("id").collect(), want.orderBy("id").collect())
    assert all(g["label"] == w["label"] and g["features"] == w["features"] for g, w in pairs)
    assert reg.formula_columns("np.log(y) ~ a")[0] == "term_0 ~ a"
    with pytest.raises(ValueError):
        reg.formula_design(df, "log(y ~ a")


def test_density_without_a_spread_is_empty(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert ts.density_grid(df, "v").count() == 0 and ts.density_grid(df.limit(0), "v").count() == 0
    assert ts.density_grid(df, "v", 5, bandwidth=1.0).count() == 5
