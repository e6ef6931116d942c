"""Time-series and regression diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as m, regression as reg, series as ts
from ..operators.encode import OneHot
from ..operators.profile import histogram
from ..operators.windows import rolling
from ..sources.tables import table
from .registry import fixture, query, rnd

XS = ["q", "n", "d"]


def series(spark, sf):
    # one value per series and day, rounded so that both engines start from the same numbers
    return fixture(spark, sf, "fx_series").withColumn("v", rnd("v"))


ROWS = """s AS (SELECT series, day, RND(v) AS v, n FROM fx_series),
    c AS (SELECT series, day, v, v - avg(v) OVER (PARTITION BY series) AS x, n - avg(n) OVER (PARTITION BY series) AS z,
                 row_number() OVER (PARTITION BY series ORDER BY day) AS t, count(*) OVER (PARTITION BY series) AS m FROM s)"""
ACF = f"""{ROWS}, a AS (SELECT a.series, k.range AS lag, sum(a.x * b.x) / min(d.s0) AS acf, min(d.m) AS m
      FROM range(0, 11) k, c a JOIN c b ON a.series = b.series AND a.t = b.t + k.range
      JOIN (SELECT series, sum(x * x) AS s0, count(*) AS m FROM c GROUP BY series) d ON d.series = a.series GROUP BY a.series, k.range)"""


def acf(spark, sf):
    return ts.autocorrelation(series(spark, sf), ["series"], "day", "v", 10)


@query(
    "s01_autocorrelation",
    f"WITH {ACF} SELECT series, CAST(lag AS INTEGER) AS lag, RND(acf) AS acf, RND(1.959963984540054 / sqrt(m)) AS band, m AS size FROM a",
)
def _(spark, sf):
    return acf(spark, sf).withColumns({"acf": rnd("acf"), "band": rnd("band")})


@query(
    "s02_partial_autocorrelation",
    f"""WITH RECURSIVE {ACF}, l AS (SELECT series, list(acf ORDER BY lag) AS r FROM a GROUP BY series),
        dl(series, r, k, phi) AS (
          SELECT series, r, 1, [r[2]] FROM l
          UNION ALL
          SELECT series, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - tail * phi[k + 1 - j]), [tail])
          FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
                          / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS tail FROM dl WHERE k < 10) s)
        SELECT series, k AS lag, RND(phi[k]) AS pacf FROM dl""",
)
def _(spark, sf):
    return ts.partial_autocorrelation(acf(spark, sf), ["series"]).withColumn("pacf", rnd("pacf"))


@query(
    "s03_ljung_box",
    f"WITH {ACF} SELECT series, RND(min(m) * (min(m) + 2) * sum(acf * acf / (m - lag))) AS statistic FROM a WHERE lag BETWEEN 1 AND 6 GROUP BY series",
)
def _(spark, sf):
    return ts.ljung_box(acf(spark, sf), ["series"], 6).select("series", rnd("statistic").alias("statistic"))


@query(
    "s04_cross_correlation",
    f"""WITH {ROWS}, d AS (SELECT series, count(*) AS m, stddev_samp(v) AS sv, stddev_samp(n) AS sn FROM s GROUP BY series)
        SELECT a.series, CAST(k.range AS INTEGER) AS lag, RND(sum(a.x * b.z) / (min(d.m) * min(d.sv) * min(d.sn))) AS ccf
        FROM range(-5, 6) k, c a JOIN c b ON a.series = b.series AND a.t = b.t + k.range JOIN d ON d.series = a.series GROUP BY a.series, k.range""",
)
def _(spark, sf):
    return ts.cross_correlation(series(spark, sf), ["series"], "day", "v", "n", 5).withColumn("ccf", rnd("ccf"))


@query(
    "s05_stationarity_view",
    """WITH s AS (SELECT series, day, n, count(*) OVER (PARTITION BY series) AS m FROM fx_series)
       SELECT series, day, CASE WHEN count(n) OVER w = 10 THEN RND(avg(n) OVER w) END AS rolling_mean,
              CASE WHEN count(n) OVER w = 10 THEN RND(stddev_samp(n) OVER w) END AS rolling_std
       FROM s WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_series")
    longest = df.groupBy("series").count().agg(F.max("count")).first()[0]
    out = rolling(df, ["series"], "day", "n", max(longest // 20, 10))
    return out.select("series", "day", rnd("rolling_mean").alias("rolling_mean"), rnd("rolling_std").alias("rolling_std"))


@query(
    "s06_dickey_fuller_no_lag",
    f"""WITH {ROWS}, g AS (SELECT series, v - lag(v) OVER w AS dv, lag(v) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY series ORDER BY t)),
        f AS (SELECT series, regr_slope(dv, v1) AS b, regr_syy(dv, v1) * (1 - regr_r2(dv, v1)) / (regr_count(dv, v1) - 2) AS s2,
                     regr_sxx(dv, v1) AS sxx, CAST(regr_count(dv, v1) AS BIGINT) AS n FROM g GROUP BY series)
        SELECT series, RND(b / sqrt(s2 / sxx)) AS statistic, n FROM f""",
)
def _(spark, sf):
    out = ts.dickey_fuller(series(spark, sf), ["series"], "day", "v", lags=0)
    return out.withColumn("statistic", rnd("statistic"))


@query(
    "s06_dickey_fuller",
    f"""WITH {ROWS}, g AS (SELECT series, v - lag(v) OVER w AS dv, lag(v) OVER w AS v1, lag(v) OVER w - lag(v, 2) OVER w AS d1 FROM c WINDOW w AS (PARTITION BY series ORDER BY t)),
        f AS (SELECT series, count(*) AS n, var_pop(v1) * count(*) AS s11, var_pop(d1) * count(*) AS s22, covar_pop(v1, d1) * count(*) AS s12,
                     covar_pop(v1, dv) * count(*) AS s1y, covar_pop(d1, dv) * count(*) AS s2y, var_pop(dv) * count(*) AS syy FROM g WHERE d1 IS NOT NULL GROUP BY series),
        b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM f)
        SELECT series, RND(b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / (s11 * s22 - s12 * s12))) AS statistic, n FROM b""",
)
def _(spark, sf):
    return ts.dickey_fuller(series(spark, sf), ["series"], "day", "v", lags=1).withColumn("statistic", rnd("statistic"))


@query("s06_lag_by_criterion")
def _(spark, sf):
    """The number of lags by Akaike's criterion, the statistic with it and its p-value."""
    return ts.dickey_fuller_by_criterion(series(spark, sf), ["series"], "day", "v", max_lag=6)


@query(
    "s07_kpss",
    f"""WITH {ROWS}, f AS (SELECT series, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM c GROUP BY series),
        e AS (SELECT c.series, t, v - a - b * t AS e FROM c JOIN f ON c.series = f.series),
        p AS (SELECT series, t, e, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3
              FROM e WINDOW w AS (PARTITION BY series ORDER BY t))
        SELECT series, RND(sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + 2 * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3))) / count(*))) AS statistic
        FROM p GROUP BY series""",
)
def _(spark, sf):
    return ts.kpss(series(spark, sf), ["series"], "day", "v", 3).withColumn("statistic", rnd("statistic"))


@query(
    "s08_normality",
    """WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events),
            k AS (SELECT event_type, count(*) AS n, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS s,
                         avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 AS k FROM m GROUP BY event_type)
       SELECT event_type, n, RND(s) AS skewness, RND(k) AS kurtosis, RND2(n / 6.0 * (s * s + k * k / 4)) AS jarque_bera FROM k""",
)
def _(spark, sf):
    out = ts.normality(table(spark, sf, "events"), "value", ["event_type"])
    return out.withColumns({"skewness": rnd("skewness"), "kurtosis": rnd("kurtosis"), "jarque_bera": rnd("jarque_bera", 2)})


DENSITY = """WITH e AS (SELECT stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS a, max(value) AS b, count(*) AS n FROM events),
    g AS (SELECT range AS i, a - 3 * h + (b - a + 6 * h) * range / 39 AS x FROM e, range(40))
    SELECT CAST(i AS INTEGER) AS point, RND(x) AS x, RND6(sum(exp(-0.5 * pow((x - value) / h, 2))) / (min(n) * min(h) * sqrt(2 * pi()))) AS density
    FROM g, e, events GROUP BY i, x"""


@query("s09_density_grid", DENSITY)
def _(spark, sf):
    out = ts.density_grid(table(spark, sf, "events"), "value", 40)
    return out.select("point", rnd("x").alias("x"), rnd("density", 6).alias("density"))


@query(
    "s09_series_histogram",
    """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 15 AS w FROM events),
            c AS (SELECT CAST(least(floor((value - lo) / w), 14) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1)
       SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(15) LEFT JOIN c ON bin = range""",
)
def _(spark, sf):
    return histogram(table(spark, sf, "events"), "value", 15).select("bin", "n")


# ---------------------------------------------------------------- regression


@query(
    "t01_ols_summary",
    """WITH f AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a, regr_r2(p, q) AS r2, count(*) AS n, regr_sxx(p, q) AS sxx, avg(q) AS mq,
                         regr_syy(p, q) * (1 - regr_r2(p, q)) / (count(*) - 2) AS s2 FROM fx_num)
       SELECT 'intercept' AS term, RND(a) AS coef, RND(sqrt(s2 * (1.0 / n + mq * mq / sxx))) AS std_err, RND(a / sqrt(s2 * (1.0 / n + mq * mq / sxx))) AS t, RND(r2) AS r2, RND2(b * b * sxx / s2) AS f FROM f
       UNION ALL SELECT 'q', RND(b), RND(sqrt(s2 / sxx)), RND(b / sqrt(s2 / sxx)), RND(r2), RND2(b * b * sxx / s2) FROM f""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    model = reg.ols(df, ["q"], "p")
    coefs = reg.coefficient_summary(df, model).select("term", *[rnd(c).alias(c) for c in ("coef", "std_err", "t")])
    whole = reg.fit_summary(df, model).first()
    return coefs.withColumns({"r2": rnd(F.lit(whole["r2"])), "f": rnd(F.lit(whole["f"]), 2)})


@query("t01_ols_many")
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    return reg.coefficient_summary(df, reg.ols(df, XS, "p"))


@query(
    "t01_fit_summary",
    """WITH f AS (SELECT regr_r2(p, q) AS r2, CAST(count(*) AS DOUBLE) AS n, regr_syy(p, q) * (1 - regr_r2(p, q)) AS sse FROM fx_num),
            g AS (SELECT *, -n / 2 * (ln(2 * pi()) + ln(sse / n) + 1) AS ll FROM f)
       SELECT CAST(n AS BIGINT) AS n, RND(1 - (1 - r2) * (n - 1) / (n - 2)) AS adj_r2, RND2(4 - 2 * ll) AS aic, RND2(2 * ln(n) - 2 * ll) AS bic FROM g""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    out = reg.fit_summary(df, reg.ols(df, ["q"], "p"))
    return out.select("n", rnd("adj_r2").alias("adj_r2"), rnd("aic", 2).alias("aic"), rnd("bic", 2).alias("bic"))


def with_dummies(spark, sf):
    df = fixture(spark, sf, "fx_label")
    wide = OneHot(["label2"], drop="first").fit(df).transform(df)
    return wide, [c for c in wide.columns if c.startswith("label2_")]


@query(
    "t02_joint_f_test",
    """WITH g AS (SELECT count(*) AS k, avg(y) AS m, var_pop(y) AS v FROM fx_label GROUP BY label2)
       SELECT RND((sum(k * pow(m - (SELECT avg(y) FROM fx_label), 2)) / (count(*) - 1)) / (sum(k * v) / (sum(k) - count(*)))) AS f,
              CAST(count(*) - 1 AS INTEGER) AS df_num, CAST(sum(k) - count(*) AS INTEGER) AS df_den FROM g""",
)
def _(spark, sf):
    wide, dummies = with_dummies(spark, sf)
    return reg.joint_f_test(wide, dummies, dummies, "y").select(rnd("f").alias("f"), "df_num", "df_den")


@query("t02_joint_f_test_with_size")
def _(spark, sf):
    wide, dummies = with_dummies(spark, sf)
    return reg.joint_f_test(wide, ["size", *dummies], dummies, "y")


@query(
    "t03_durbin_watson",
    """WITH f AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a FROM fx_num),
            e AS (SELECT id, p - a - b * q AS e FROM fx_num, f), l AS (SELECT e, lag(e) OVER (ORDER BY id) AS e1 FROM e)
       SELECT RND(sum(pow(e - e1, 2)) / sum(e * e)) AS durbin_watson FROM l""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    out = reg.durbin_watson(df, reg.ols(df, ["q"], "p"), "p", "id")
    return out.select(rnd("durbin_watson").alias("durbin_watson"))


EIGEN = "sqrt(({a} + {c} + sqrt(pow({a} - {c}, 2) + 4 * {b} * {b})) / ({a} + {c} - sqrt(pow({a} - {c}, 2) + 4 * {b} * {b})))"


@query(
    "t04_condition_number",
    f"""WITH g AS (SELECT CAST(count(*) AS DOUBLE) AS a, sum(n) AS b, sum(n * n) AS c FROM fx_num)
        SELECT RND2({EIGEN.format(a='a', b='(b / sqrt(c))', c='1')}) AS scaled, RND2({EIGEN.format(a='a', b='b', c='c')}) AS raw FROM g""",
)
def _(spark, sf):
    out = reg.condition_number(fixture(spark, sf, "fx_num"), ["n"])
    return out.select(rnd("scaled", 2).alias("scaled"), rnd("raw", 2).alias("raw"))


@query("t04_condition_number_many")
def _(spark, sf):
    return reg.condition_number(fixture(spark, sf, "fx_num"), XS)


@query(
    "t05_influence",
    """WITH f AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a, count(*) AS m, avg(q) AS mq, regr_sxx(p, q) AS sxx,
                         regr_syy(p, q) * (1 - regr_r2(p, q)) AS sse FROM fx_num),
            e AS (SELECT id, p - a - b * q AS e, 1.0 / m + pow(q - mq, 2) / sxx AS h, q - mq AS x, sxx, m, sse FROM fx_num, f),
            g AS (SELECT id, e, h, x / sxx * e / (1 - h) / sqrt((sse - e * e / (1 - h)) / (m - 3)) * sqrt(sxx) AS db FROM e)
       SELECT id, RND2(e) AS residual, RND6(h) AS leverage, RND(db) AS dfbetas_q FROM g""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    out = reg.influence(df, reg.ols(df, ["q"], "p"), "p", ["id"])
    return out.select("id", rnd("residual", 2).alias("residual"), rnd("leverage", 6).alias("leverage"), rnd("dfbetas_q").alias("dfbetas_q"))


@query(
    "t06_coefficient_change",
    """WITH a AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a FROM fx_num),
            k AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a FROM fx_num WHERE split = 'train')
       SELECT 'q' AS term, RND(a.b) AS "full", RND(k.b) AS part, RND((k.b / a.b - 1) * 100) AS percent FROM a, k
       UNION ALL SELECT 'intercept', RND(a.a), RND(k.a), RND((k.a / a.a - 1) * 100) FROM a, k""",
)
def _(spark, sf):
    out = reg.coefficient_change(fixture(spark, sf, "fx_num"), F.col("split") == "train", ["q"], "p")
    return out.select("term", *[rnd(c).alias(c) for c in ("full", "part", "percent")])


@query("t07_prediction_interval")
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    return reg.prediction_interval(df, reg.ols(df, XS, "p")).select("id", "p", "fitted", "low", "high")


@query(
    "t07_interval_of_a_line",
    # the t quantile by its expansion in 1 / dof around the normal one, exact to more digits than are shown
    """WITH f AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a, regr_syy(p, q) * (1 - regr_r2(p, q)) / (count(*) - 2) AS s2, avg(q) AS mq,
                         regr_sxx(p, q) AS sxx, CAST(count(*) AS DOUBLE) AS k, CAST(count(*) - 2 AS DOUBLE) AS v, 1.959963984540054 AS z FROM fx_num),
       c AS (SELECT *, z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
                       + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)) AS t FROM f)
       SELECT id, RND2(a + b * q) AS fitted, RND2(a + b * q - t * sqrt(s2 * (1 + 1 / k + (q - mq) ** 2 / sxx))) AS low,
              RND2(a + b * q + t * sqrt(s2 * (1 + 1 / k + (q - mq) ** 2 / sxx))) AS high FROM fx_num, c""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    out = reg.prediction_interval(df, reg.ols(df, ["q"], "p"))
    return out.select("id", *[rnd(c, 2).alias(c) for c in ("fitted", "low", "high")])


@query(
    "t08_breusch_pagan",
    """WITH f AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a FROM fx_num), e AS (SELECT q, pow(p - a - b * q, 2) AS e2 FROM fx_num, f)
       SELECT RND2(count(*) * regr_r2(e2, q)) AS lm, RND2(regr_r2(e2, q) / (1 - regr_r2(e2, q)) * (count(*) - 2)) AS f FROM e""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    out = reg.breusch_pagan(df, reg.ols(df, ["q"], "p"), "p")
    return out.select(rnd("lm", 2).alias("lm"), rnd("f", 2).alias("f"))


@query(
    "t09_goldfeld_quandt",
    """WITH r AS (SELECT p, q, row_number() OVER (ORDER BY q, id) AS k, count(*) OVER () AS m FROM fx_num),
            h AS (SELECT CASE WHEN k <= floor(m / 2) THEN 0 ELSE 1 END AS half, regr_syy(p, q) * (1 - regr_r2(p, q)) / (count(*) - 2) AS s2 FROM r GROUP BY 1)
       SELECT RND((SELECT s2 FROM h WHERE half = 1) / (SELECT s2 FROM h WHERE half = 0)) AS f""",
)
def _(spark, sf):
    out = reg.goldfeld_quandt(fixture(spark, sf, "fx_num").select("id", "p", "q"), ["q"], "p", "q", ["id"])
    return out.select(rnd("f").alias("f"))


@query("t10_formula")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    design = reg.formula_design(table(spark, sf, "orders"), "log(o_totalprice) ~ o_custkey + C(o_orderstatus)")
    model = m.learner("linear").fit(design)
    return model.transform(design).select("o_orderkey", vector_to_array("features").alias("features"), "label", "prediction")


@query(
    "t10_formula_design",
    """WITH k AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS r, count(*) OVER () AS labels FROM orders GROUP BY 1)
       SELECT o_orderkey, RND(ln(o_totalprice)) AS label, RND(sqrt(o_custkey)) AS root, RND(o_custkey * week / 100.0) AS product,
              CAST(CASE WHEN r = 1 THEN 1 ELSE 0 END AS DOUBLE) AS first_label, CAST(CASE WHEN r = 2 THEN 1 ELSE 0 END AS DOUBLE) AS second_label
       FROM (SELECT *, o_orderkey % 7 AS week FROM orders) o JOIN k ON o_orderstatus = s""",
)
def _(spark, sf):
    """Functions on both sides, arithmetic and labels; the last of the labels by frequency is the base."""
    from pyspark.ml.functions import vector_to_array

    df = table(spark, sf, "orders").withColumn("week", F.col("o_orderkey") % 7)
    design = reg.formula_design(df, "log(o_totalprice) ~ sqrt(o_custkey) + I(o_custkey * week / 100) + C(o_orderstatus)")
    x = design.select("o_orderkey", rnd("label").alias("label"), vector_to_array("features").alias("x"))
    names = ("root", "product", "first_label", "second_label")
    return x.select("o_orderkey", "label", *[(rnd(F.col("x")[i]) if i < 2 else F.col("x")[i]).alias(n) for i, n in enumerate(names)])


@query(
    "t11_simple_regressions",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, RND(b) AS slope, RND(a) AS intercept, RND0(avg(pow(p - a - b * {c}, 2))) AS mse, RND(avg(p - a - b * {c})) AS mean_error,
                   RND(stddev_samp(p - a - b * {c})) AS std_error
            FROM fx_num, (SELECT regr_slope(p, {c}) AS b, regr_intercept(p, {c}) AS a FROM fx_num WHERE split = 'train') f WHERE split <> 'train' GROUP BY a, b"""
        for c in ("q", "n")
    ),
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    lines = reg.simple_regressions(df.where("split = 'train'"), ["q", "n"], "p")
    out = reg.simple_regression_errors(lines, df.where("split <> 'train'"), "p")
    return out.select("variable", rnd("mse", 0).alias("mse"), *[rnd(c).alias(c) for c in ("slope", "intercept", "mean_error", "std_error")])
