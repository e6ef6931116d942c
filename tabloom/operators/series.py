"""Time-series diagnostics, many series at once. Lag products are formed in ordered
chunks with a halo, so one very long series is spread over many tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import tails
from .ordered import CHUNK_ROWS, join_on, running_by_position, with_halo
from .windows import in_order

# two-sided 95 % point of the standard normal
Z95 = 1.959963984540054


def _centred(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = join_on(df, means, by)
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def autocorrelation(
    df: DataFrame, by: Sequence[str], order: str, value: str, max_lag: int, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """(by..., lag, acf, band, size): lag products over the total sum of squares, with
    the +-1.96 / sqrt(T) band."""
    rows = _centred(df.where(F.col(value).isNotNull()).select(*by, order, value), by, [value])
    ordered, w = in_order(rows, by, order, max_lag, chunk=chunk)
    x = F.col(value)
    lagged = ordered.withColumns({f"_l{k}": F.lag(value, k).over(w) for k in range(1, max_lag + 1)}).where("own = 1")
    sums = lagged.groupBy(*by).agg(
        F.count(x).alias("size"),
        F.sum(x * x).alias("_s0"),
        *[F.sum(x * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)],
    )
    lags = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_s0")).alias("acf"))
        for k in range(max_lag + 1)
    ]
    return (
        sums.select(*by, "size", F.explode(F.array(*lags)).alias("e"))
        .select(*by, "e.*", (F.lit(Z95) / F.sqrt("size")).alias("band"), "size")
        .where("acf is not null")
    )


def _durbin_levinson(acf: Sequence[float]) -> list[float]:
    """Partial autocorrelations of lags 1.. from autocorrelations of lags 0.."""
    out: list[float] = []
    phi: list[float] = []
    for k in range(1, len(acf)):
        up = acf[k] - sum(p * acf[k - 1 - j] for j, p in enumerate(phi))
        down = 1.0 - sum(p * acf[j + 1] for j, p in enumerate(phi))
        last = up / down if down else float("nan")
        phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
        out.append(last)
    return out


def partial_autocorrelation(acf: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., lag, pacf) from an autocorrelation table: a handful of numbers per series."""

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series) -> pd.Series:
        return a.map(lambda v: _durbin_levinson(list(v)))

    lists = acf.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("l"))
    solved = lists.select(*by, solve(F.col("l.acf")).alias("p"))
    return solved.select(*by, F.posexplode("p").alias("i", "pacf")).select(*by, (F.col("i") + 1).alias("lag"), "pacf")


def ljung_box(acf: DataFrame, by: Sequence[str], lags: int) -> DataFrame:
    """(by..., statistic, p) over the first ``lags`` autocorrelations."""

    @F.pandas_udf("double")
    def tail(q: pd.Series) -> pd.Series:
        return q.map(lambda v: tails.chi2_upper(v, lags))

    t = F.col("size")
    terms = acf.where((F.col("lag") >= 1) & (F.col("lag") <= lags))
    stat = terms.groupBy(*by).agg(
        F.sum(t * (t + 2) * F.col("acf") * F.col("acf") / (t - F.col("lag"))).alias("statistic")
    )
    return stat.withColumn("p", tail("statistic"))


def cross_correlation(
    df: DataFrame, by: Sequence[str], order: str, x: str, y: str, max_lag: int, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """(by..., lag, ccf) for lags -L..L: products of x at t + lag with y at t over T,
    divided by the sample standard deviations, so lag 0 of a series with itself is (T - 1) / T."""
    rows = _centred(df.select(*by, order, x, y).dropna(), by, [x, y])
    ordered, w = in_order(rows, by, order, max_lag, chunk=chunk)
    shifted = ordered.withColumns(
        {f"_y{k}": F.lag(y, k).over(w) for k in range(1, max_lag + 1)}
        | {f"_x{k}": F.lag(x, k).over(w) for k in range(1, max_lag + 1)}
    ).where("own = 1")
    aggs = [F.sum(F.col(x) * F.col(y)).alias("_0")]
    for k in range(1, max_lag + 1):
        aggs += [F.sum(F.col(x) * F.col(f"_y{k}")).alias(f"_p{k}"), F.sum(F.col(y) * F.col(f"_x{k}")).alias(f"_n{k}")]
    sums = shifted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("t"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), *aggs
    )
    lags = [
        F.struct(F.lit(h).alias("lag"), F.col(f"_{'p' if h > 0 else 'n'}{abs(h)}" if h else "_0").alias("s"))
        for h in range(-max_lag, max_lag + 1)
    ]
    long = sums.select(*by, "t", "sx", "sy", F.explode(F.array(*lags)).alias("e"))
    ccf = F.try_divide(F.col("e.s"), F.col("t") * F.col("sx") * F.col("sy"))
    return long.select(*by, F.col("e.lag").alias("lag"), ccf.alias("ccf"))


def dickey_fuller(
    df: DataFrame, by: Sequence[str], order: str, value: str, lags: int = 1, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """(by..., statistic, n): t-statistic of the level in the regression of the change on
    the previous level, lagged changes and a constant. Cross products are summed per
    series on the JVM; only the small systems are solved in Python."""
    rows = _centred(df.where(F.col(value).isNotNull()).select(*by, order, value), by, [value])
    ordered, w = in_order(rows, by, order, lags + 1, chunk=chunk)
    ordered = ordered.withColumns({f"_x{k}": F.lag(value, k).over(w) for k in range(1, lags + 2)}).where("own = 1")
    levels = [F.col(value), *[F.col(f"_x{k}") for k in range(1, lags + 2)]]
    change = [a - b for a, b in zip(levels, levels[1:])]
    design = [F.lit(1.0), levels[1], *change[1:]]
    size = len(design)
    goal = change[0]
    used = ordered.where(F.col(f"_x{lags + 1}").isNotNull())
    sums = [F.sum(design[i] * design[j]) for i in range(size) for j in range(size)]
    sums += [F.sum(d * goal) for d in design] + [F.sum(goal * goal)]
    gram = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"))

    @F.pandas_udf("double")
    def solve(n: pd.Series, g: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for rows, v in zip(n, g):
            v = np.asarray(v, dtype=float)
            a, b, yy = v[: size * size].reshape(size, size), v[size * size : -1], v[-1]
            if rows <= size or np.linalg.matrix_rank(a) < size:
                out.append(None)
                continue
            inv = np.linalg.inv(a)
            beta = inv @ b
            s2 = (yy - beta @ b) / (rows - size)
            out.append(float(beta[1] / math.sqrt(s2 * inv[1, 1])) if s2 > 0 else None)
        return pd.Series(out, dtype="float64")

    return gram.select(*by, solve("n", "g").alias("statistic"), "n")


def _gram_of_lags(df: DataFrame, by: Sequence[str], order: str, value: str, max_lag: int, chunk: int) -> DataFrame:
    """(by..., lag, n, g): for each number of lags the cross products of (1, level, lagged changes..., change) over all
    rows that have them, in one pass."""
    rows = _centred(df.where(F.col(value).isNotNull()).select(*by, order, value), by, [value])
    ordered, w = in_order(rows, by, order, max_lag + 1, chunk=chunk)
    ordered = ordered.withColumns({f"_x{k}": F.lag(value, k).over(w) for k in range(1, max_lag + 2)}).where("own = 1")
    names = [value, *[f"_x{k}" for k in range(1, max_lag + 2)]]
    fields = [ordered.schema[b] for b in by]
    schema = T.StructType([*fields, T.StructField("lag", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for _, part in batch.groupby(list(by), dropna=False, sort=False) if by else [((), batch)]:
                x = part[names].to_numpy(float)
                change = x[:, :-1] - x[:, 1:]
                out = []
                for lag in range(max_lag + 1):
                    design = np.column_stack([np.ones(len(x)), x[:, 1], change[:, 1 : lag + 1], change[:, 0]])
                    design = design[~np.isnan(design).any(axis=1)]
                    out.append((lag, len(design), (design.T @ design).ravel().tolist()))
                made = pd.DataFrame(out, columns=["lag", "n", "g"])
                for i, b in enumerate(by):
                    made.insert(i, b, [part[b].iloc[0]] * len(made))
                yield made

    parts = ordered.select(*by, *names).mapInPandas(run, schema)
    size = (max_lag + 3) ** 2  # shorter rows are padded with nulls
    sums = F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(size)])
    return parts.groupBy(*by, "lag").agg(F.sum("n").alias("n"), sums.alias("g"))


def _level_test(gram: np.ndarray, n: int) -> tuple[float | None, float | None]:
    """(t of the level, log-likelihood) of the regression of the last column on the others."""
    a, b, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    k = len(a)
    if n <= k or np.linalg.matrix_rank(a) < k:
        return None, None
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    sse = float(yy - beta @ b)
    if sse <= 0:
        return None, None
    return float(beta[1] / math.sqrt(sse / (n - k) * inverse[1, 1])), -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)


def dickey_fuller_by_criterion(
    df: DataFrame, by: Sequence[str], order: str, value: str, max_lag: int, criterion: str = "aic", chunk: int = CHUNK_ROWS
) -> DataFrame:
    """(by..., lag, statistic, p, n): the number of lagged changes that minimises the criterion ("aic", "bic") over the
    rows that have the most lags, then the test with that many over all its rows; the p-value by MacKinnon's surface.

    The regressions with fewer lags are parts of the one with most, so one matrix a series holds them all."""
    grams = _gram_of_lags(df, by, order, value, max_lag, chunk)
    rows = grams.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lag", "n", "g"))).alias("_grams"))  # a row for each lag

    @F.pandas_udf("lag int, statistic double, p double, n long")
    def solve(series: pd.Series) -> pd.DataFrame:
        out = []
        for found in series:
            grams = {r["lag"]: (np.array(r["g"][: (r["lag"] + 3) ** 2], float).reshape(r["lag"] + 3, -1), r["n"]) for r in found}
            most, n = grams[max_lag]
            best = None
            for lag in range(max_lag + 1):
                keep = [*range(lag + 2), max_lag + 2]
                _, likelihood = _level_test(most[np.ix_(keep, keep)], n)
                if likelihood is not None:
                    k = lag + 2
                    worth = -2 * likelihood + (2 if criterion == "aic" else math.log(n)) * k
                    if best is None or worth < best[0]:
                        best = worth, lag
            if best is None:
                out.append((None, None, None, n))
                continue
            gram, n = grams[best[1]]
            t, _ = _level_test(gram, n)
            out.append((best[1], t, None if t is None else tails.unit_root_p(t), n))
        return pd.DataFrame(out, columns=["lag", "statistic", "p", "n"])

    return rows.select(*by, solve("_grams").alias("_solved")).select(*by, "_solved.*")


def kpss(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(by..., statistic): KPSS statistic around a linear trend with a Bartlett window."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, value)
    ranked, _ = in_order(rows, by, order, 0, chunk=chunk)
    trend = ranked.groupBy(*by).agg(
        F.regr_slope(F.col(value), F.col("pos").cast("double")).alias("_b"),
        F.regr_intercept(F.col(value), F.col("pos").cast("double")).alias("_a"),
    )
    resid = (
        join_on(ranked.select(*by, "pos", value), trend, by)
        .select(*by, "pos", (F.col(value) - F.col("_a") - F.col("_b") * F.col("pos")).alias("e"))
    )
    cumulated = running_by_position(resid, by, {"e": F.col("e")}).withColumnRenamed("cum_e", "s")
    chunks = with_halo(cumulated, by, lags, max(chunk, lags + 1))
    w = Window.partitionBy(*by, "chunk").orderBy("pos")
    lagged = chunks.withColumns({f"_l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)}).where("own = 1")
    e, t = F.col("e"), F.count(F.lit(1))
    spread = F.sum(e * e)
    for k in range(1, lags + 1):
        spread = spread + F.lit(2.0 * (1.0 - k / (lags + 1.0))) * F.sum(e * F.col(f"_l{k}"))
    return lagged.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("s") * F.col("s")) / (t * t), spread / t).alias("statistic")
    )


def normality(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic."""
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    return df.groupBy(*by).agg(
        n.alias("n"), s.alias("skewness"), k.alias("kurtosis"), (n / 6.0 * (s * s + k * k / 4.0)).alias("jarque_bera")
    )


def density_grid(df: DataFrame, value: str, points: int = 50, bandwidth: float | None = None) -> DataFrame:
    """(x, density): Gaussian kernel density on an even grid, Scott's bandwidth by default.
    Every row meets the grid inside its task and is summed before the shuffle. Without a spread (fewer than two values,
    or equal ones) there is no density to speak of: the result is empty unless a bandwidth is given."""
    row = df.agg(
        F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"), F.stddev_samp(value).alias("s")
    ).first()
    if not row["n"] or not (bandwidth or row["s"]):
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    h = bandwidth or row["s"] * row["n"] ** -0.2
    lo, hi = row["a"] - 3 * h, row["b"] + 3 * h
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("x")) for i, g in enumerate(grid)])
    z = (F.col("g.x") - F.col(value)) / F.lit(h)
    kernel: Column = F.exp(-0.5 * z * z) / F.lit(row["n"] * h * math.sqrt(2 * math.pi))
    return (
        df.where(F.col(value).isNotNull())
        .select(value, F.explode(spots).alias("g"))
        .groupBy(F.col("g.i").alias("point"), F.col("g.x").alias("x"))
        .agg(F.sum(kernel).alias("density"))
    )
