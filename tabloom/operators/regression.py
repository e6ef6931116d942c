"""Ordinary least squares and its diagnostics from one pass of cross products.

The k x k normal equations are all that reaches the driver. Products are those of deviations
from the means, which keeps them well conditioned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import RFormula
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tails
from .core import held
from .gram import pair_moments
from .models import rows_table
from .ordered import positions
from .windows import in_order


@dataclass
class Ols:
    """Fitted regression with an intercept."""

    features: list[str]
    n: int
    means: np.ndarray  # of the features
    target_mean: float
    slopes: np.ndarray
    centred_inverse: np.ndarray  # inverse of the centred cross products
    sse: float
    sst: float

    @property
    def k(self) -> int:
        return len(self.features)

    @property
    def intercept(self) -> float:
        return self.target_mean - float(self.means @ self.slopes)

    @property
    def dof(self) -> int:
        return self.n - self.k - 1

    @property
    def s2(self) -> float:
        return self.sse / self.dof

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.sst

    def std_errors(self) -> np.ndarray:
        """Of the intercept, then of each slope."""
        slope = np.sqrt(self.s2 * np.diag(self.centred_inverse))
        const = math.sqrt(self.s2 * (1.0 / self.n + self.means @ self.centred_inverse @ self.means))
        return np.concatenate([[const], slope])

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.slopes):
            out = out + F.lit(float(b)) * F.col(c)
        return out

    def leverage(self) -> Column:
        moved = [F.col(c) - F.lit(float(m)) for c, m in zip(self.features, self.means)]
        out = F.lit(1.0 / self.n)
        for i, a in enumerate(moved):
            for j, b in enumerate(moved):
                out = out + F.lit(float(self.centred_inverse[i, j])) * a * b
        return out


def cross_products(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross-product matrix of complete rows, from one scan."""
    found = pair_moments(df, cols, complete=True)
    return int(found.n[0, 0]), np.diag(found.mean).copy(), found.c


def ols(df: DataFrame, features: Sequence[str], target: str) -> Ols:
    n, means, gram = cross_products(df, [*features, target])
    k = len(features)
    xx, xy, yy = gram[:k, :k], gram[:k, k], float(gram[k, k])
    # collinear columns share their effect
    inverse = np.linalg.pinv(xx, hermitian=True) if k else np.zeros((0, 0))
    slopes = inverse @ xy
    return Ols(list(features), n, means[:k], float(means[k]), slopes, inverse, max(0.0, yy - float(slopes @ xy)), yy)


def coefficient_summary(df: DataFrame, model: Ols) -> DataFrame:
    """(term, coef, std_err, t, p)."""
    coefs = [model.intercept, *model.slopes.tolist()]
    rows = []
    for term, b, se in zip(["intercept", *model.features], coefs, model.std_errors().tolist()):
        t = b / se if se else float("inf")
        rows.append((term, b, se, t, tails.t_two_sided(t, model.dof) if se else 0.0))
    return rows_table(df, rows, "term string, coef double, std_err double, t double, p double")


def fit_summary(df: DataFrame, model: Ols) -> DataFrame:
    """One row: n, R2, adjusted R2, F and its p, log-likelihood, AIC, BIC."""
    n, k = model.n, model.k
    f = (model.sst - model.sse) / k / model.s2
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(model.sse / n) + 1)
    row = (
        n,
        model.r2,
        1 - (1 - model.r2) * (n - 1) / model.dof,
        f,
        tails.f_upper(f, k, model.dof),
        ll,
        2 * (k + 1) - 2 * ll,
        math.log(n) * (k + 1) - 2 * ll,
    )
    schema = "n long, r2 double, adj_r2 double, f double, f_p double, log_likelihood double, aic double, bic double"
    return rows_table(df, [row], schema)


def joint_f_test(df: DataFrame, full: Sequence[str], dropped: Sequence[str], target: str) -> DataFrame:
    """(f, df_num, df_den, p) of the hypothesis that the dropped coefficients are all 0."""
    whole = ols(df, full, target)
    part = ols(df, [c for c in full if c not in set(dropped)], target)
    f = (part.sse - whole.sse) / len(dropped) / whole.s2
    row = (f, len(dropped), whole.dof, tails.f_upper(f, len(dropped), whole.dof))
    return rows_table(df, [row], "f double, df_num int, df_den int, p double")


def with_residuals(df: DataFrame, model: Ols, target: str) -> DataFrame:
    return df.withColumn("fitted", model.prediction()).withColumn("residual", F.col(target) - F.col("fitted"))


def durbin_watson(df: DataFrame, model: Ols, target: str, order: str) -> DataFrame:
    resid = with_residuals(df, model, target).select(order, "residual")
    rows, w = in_order(resid, [], order, 1)
    step = F.col("residual") - F.col("_prev")
    out = rows.withColumn("_prev", F.lag("residual", 1).over(w)).where("own = 1")
    return out.agg((F.sum(step * step) / F.sum(F.col("residual") * F.col("residual"))).alias("durbin_watson"))


def condition_number(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(scaled, raw): square root of the ratio of the extreme eigenvalues of the cross
    products, with the columns (but not the constant) at unit length, and as they are."""
    n, means, gram = cross_products(df, features)
    full = np.zeros((len(features) + 1, len(features) + 1))
    full[0, 0] = n
    full[0, 1:] = full[1:, 0] = n * means
    full[1:, 1:] = gram + n * np.outer(means, means)
    length = np.concatenate([[1.0], np.sqrt(np.diag(full))[1:]])
    ratio = [math.sqrt(e[-1] / e[0]) for e in (np.linalg.eigvalsh(full / np.outer(length, length)), np.linalg.eigvalsh(full))]
    return rows_table(df, [(float(ratio[0]), float(ratio[1]))], "scaled double, raw double")


def influence(df: DataFrame, model: Ols, target: str, key: Sequence[str]) -> DataFrame:
    """Leverage and DFBETAS per row; ``flagged`` marks any |DFBETAS| above 2 / sqrt(n)."""
    rows = with_residuals(df, model, target).withColumn("leverage", model.leverage())
    e, h = F.col("residual"), F.col("leverage")
    loo_var = (F.lit(model.sse) - e * e / (1 - h)) / F.lit(float(model.dof - 1))
    moved = [F.col(c) - F.lit(float(m)) for c, m in zip(model.features, model.means)]
    errors = model.std_errors() / math.sqrt(model.s2)
    inv = model.centred_inverse
    betas = {}
    slopes = []
    for j, c in enumerate(model.features):
        weight = F.lit(0.0)
        for i, x in enumerate(moved):
            weight = weight + F.lit(float(inv[j, i])) * x
        slopes.append(weight)
        betas[f"dfbetas_{c}"] = weight
    const = F.lit(1.0 / model.n)
    for m, wgt in zip(model.means, slopes):
        const = const - F.lit(float(m)) * wgt
    betas = {"dfbetas_intercept": const} | betas
    change = {
        name: wgt * e / (1 - h) / (F.sqrt(loo_var) * F.lit(float(se))) for (name, wgt), se in zip(betas.items(), errors)
    }
    out = rows.select(*key, "residual", "leverage", *[c.alias(n) for n, c in change.items()])
    limit = 2.0 / math.sqrt(model.n)
    flagged = F.lit(False)
    for n in change:
        flagged = flagged | (F.abs(F.col(n)) > limit)
    return out.withColumn("flagged", flagged)


def coefficient_change(df: DataFrame, kept, features: Sequence[str], target: str) -> DataFrame:
    """(term, full, part, percent): coefficients on all rows and on the kept rows."""
    a, b = ols(df, features, target), ols(df.where(kept), features, target)
    rows = [
        (t, x, y, (y / x - 1) * 100 if x else None)
        for t, x, y in zip(
            ["intercept", *features], [a.intercept, *a.slopes.tolist()], [b.intercept, *b.slopes.tolist()]
        )
    ]
    return rows_table(df, rows, "term string, full double, part double, percent double")


def prediction_interval(df: DataFrame, model: Ols, level: float = 0.95) -> DataFrame:
    """Adds fitted, low, high of a new observation."""
    t = tails.t_critical(1 - level, model.dof)
    half = F.lit(t * math.sqrt(model.s2)) * F.sqrt(1 + model.leverage())
    out = df.withColumn("fitted", model.prediction())
    return out.withColumns({"low": F.col("fitted") - half, "high": F.col("fitted") + half})


def breusch_pagan(df: DataFrame, model: Ols, target: str) -> DataFrame:
    """(lm, lm_p, f, f_p) from the regression of squared residuals on the features."""
    squared = with_residuals(df, model, target).withColumn("_e2", F.col("residual") * F.col("residual"))
    aux = ols(squared, model.features, "_e2")
    lm = aux.n * aux.r2
    f = (aux.sst - aux.sse) / aux.k / aux.s2
    row = (lm, tails.chi2_upper(lm, aux.k), f, tails.f_upper(f, aux.k, aux.dof))
    return rows_table(df, [row], "lm double, lm_p double, f double, f_p double")


def goldfeld_quandt(
    df: DataFrame, features: Sequence[str], target: str, order: str, ties: Sequence[str] = ()
) -> DataFrame:
    """(f, p): residual variance of the later half over that of the earlier half."""
    ranked = positions(df, [], order, ties)
    half = F.floor(F.col("size") / 2)
    with held(ranked.select(*features, target, (F.col("pos") <= half).alias("_early"))) as (rows,):
        low = ols(rows.where("_early"), features, target)
        high = ols(rows.where("not _early"), features, target)
    f = high.s2 / low.s2
    return rows_table(df, [(f, tails.f_upper(f, high.dof, low.dof))], "f double, p double")


#: Functions of a formula in Spark SQL's words; others are taken as they are. I(...) is plain arithmetic.
FORMULA_FUNCTIONS = {"log": "ln", "I": "", "np.log": "ln", "np.sqrt": "sqrt", "np.exp": "exp", "np.log1p": "log1p"}


def formula_columns(formula: str) -> tuple[str, dict[str, Column]]:
    """The formula with a column name in place of each function term, and the columns: log(b), I(a * b) and other
    expressions of Spark SQL, and C(c), a column taken as labels."""
    out, columns, at = [], {}, 0
    for call in re.finditer(r"[A-Za-z_][A-Za-z_0-9.]*\(", formula):
        if call.start() < at:
            continue  # inside a term that is taken as a whole
        depth, end = 1, call.end()
        while depth:
            if end == len(formula):
                raise ValueError(f"a bracket stays open in {formula!r}")
            depth += {"(": 1, ")": -1}.get(formula[end], 0)
            end += 1
        name, inner = call[0][:-1], formula[call.end() : end - 1]
        if name == "C":
            column = F.expr(inner).cast("string")
        else:
            for alias, own in FORMULA_FUNCTIONS.items():
                inner = re.sub(rf"(?<![\w.]){re.escape(alias)}\(", f"{own}(", inner)
            column = F.expr(f"{FORMULA_FUNCTIONS.get(name, name)}({inner})")
        made = f"term_{len(columns)}"
        columns[made] = column
        out += [formula[at : call.start()], made]
        at = end
    return "".join([*out, formula[at:]]), columns


def formula_design(df: DataFrame, formula: str) -> DataFrame:
    """``features`` and ``label`` columns of an R-style formula, which may hold functions of columns on either side:
    `log(y) ~ a + log(b) + C(c):d`. Spark ML's RFormula builds the design."""
    plain, columns = formula_columns(formula)
    if set(columns) & set(df.columns):
        raise ValueError("the table has a column named like a term of the formula")
    wide = df.withColumns(columns) if columns else df
    return RFormula(formula=plain).fit(wide).transform(wide).drop(*columns)


def simple_regressions(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(variable, slope, intercept) of every one-feature regression from one aggregate."""
    aggs = []
    for c in features:
        y, x = F.col(target).cast("double"), F.col(c).cast("double")
        aggs += [F.regr_slope(y, x).alias(f"{c}__slope"), F.regr_intercept(y, x).alias(f"{c}__intercept")]
    row = df.agg(*aggs).first()
    rows = [(c, row[f"{c}__slope"], row[f"{c}__intercept"]) for c in features]
    return rows_table(df, rows, "variable string, slope double, intercept double")


def simple_regression_errors(lines: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Test error of each line: (variable, slope, intercept, mse, mean_error, std_error)."""
    fitted = lines.collect()
    aggs = []
    for r in fitted:
        e = F.col(target) - F.lit(r["intercept"]) - F.lit(r["slope"]) * F.col(r["variable"])
        v = r["variable"]
        aggs += [F.avg(e * e).alias(f"{v}__mse"), F.avg(e).alias(f"{v}__m"), F.stddev_samp(e).alias(f"{v}__s")]
    row = test.agg(*aggs).first()
    rows = [
        (r["variable"], r["slope"], r["intercept"], row[f"{r['variable']}__mse"], row[f"{r['variable']}__m"], row[f"{r['variable']}__s"])
        for r in fitted
    ]
    schema = "variable string, slope double, intercept double, mse double, mean_error double, std_error double"
    return rows_table(test, rows, schema)
