"""Feature selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bst, models as m, select as sel
from ..operators.ordered import hash_uniform
from ..sources.tables import table
from .registry import auc_sql, fixture, query, rnd, tree_sql

FEATURES = ["q", "p", "n", "d", "const", "quasi", "dup_q", "corr_p"]
PLAIN = ["q", "n", "d", "quasi"]


def names(spark, found):
    return spark.createDataFrame([(c,) for c in found], "feature string")


def parts(spark, sf, name="fx_sel", label="y"):
    df = fixture(spark, sf, name)
    return df.where("split = 'train'"), df.where("split <> 'train'")


def per_column(cond: str, cols=FEATURES, src="fx_sel") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature FROM {src} HAVING {cond.format(c=c)}" for c in cols)


@query("n01_constant_columns", per_column("min({c}) = max({c})"))
def _(spark, sf):
    return names(spark, sel.constant_columns(fixture(spark, sf, "fx_sel"), FEATURES))


@query(
    "n02_constant_labels",
    "SELECT 'kind' AS feature FROM orders HAVING count(DISTINCT 'same') = 1 UNION ALL SELECT 'o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) = 1",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", F.lit("same").alias("kind"))
    return names(spark, sel.constant_labels(df, ["kind", "o_orderstatus"]))


@query("n03_low_variance", per_column("var_pop({c}) <= 0.01"))
def _(spark, sf):
    return names(spark, sel.low_variance_columns(fixture(spark, sf, "fx_sel"), FEATURES, 0.01))


@query(
    "n04_predominant_share",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, RND((SELECT max(k) FROM (SELECT count(*) AS k FROM fx_sel GROUP BY {c}) t) / (SELECT count(*) FROM fx_sel)) AS share"
        for c in ("const", "quasi", "n", "q")
    ),
)
def _(spark, sf):
    return sel.predominant_shares(fixture(spark, sf, "fx_sel"), ["const", "quasi", "n", "q"]).withColumn("share", rnd("share"))


@query(
    "n04_predominant_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM (SELECT max(k) AS top, sum(k) AS n FROM (SELECT count(*) AS k FROM fx_sel GROUP BY {c}) t) s WHERE top > 0.9 * n"
        for c in ("const", "quasi", "n", "q")
    ),
)
def _(spark, sf):
    return names(spark, sel.predominant_columns(fixture(spark, sf, "fx_sel"), ["const", "quasi", "n", "q"], 0.9))


@query(
    "n05_duplicate_columns_loose_key",
    " UNION ALL ".join(
        f"SELECT '{a}' AS kept, '{b}' AS duplicate FROM fx_sel HAVING count(*) FILTER ({a} IS DISTINCT FROM {b}) = 0"
        for i, a in enumerate(("q", "n", "const"))
        for b in ("q", "n", "const", "dup_q")[i + 1 :]
    ),
)
def _(spark, sf):
    """The key names several rows: equal rows must not cancel."""
    pairs = sel.duplicate_columns(fixture(spark, sf, "fx_sel"), ["q", "n", "const", "dup_q"], ["y"])
    return spark.createDataFrame(pairs, "kept string, duplicate string")


@query(
    "n05_duplicate_columns",
    " UNION ALL ".join(
        f"SELECT '{a}' AS kept, '{b}' AS duplicate FROM fx_sel HAVING count(*) FILTER ({a} IS DISTINCT FROM {b}) = 0"
        for i, a in enumerate(("q", "n", "const", "quasi", "dup_q"))
        for b in ("q", "n", "const", "quasi", "dup_q")[i + 1 :]
    ),
)
def _(spark, sf):
    found = sel.duplicate_columns(fixture(spark, sf, "fx_sel"), ["q", "n", "const", "quasi", "dup_q"], ["id"])
    return spark.createDataFrame(found, "kept string, duplicate string")


CORR = ["q", "p", "n", "d", "corr_p"]
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]


@query(
    "n06_correlated_columns",
    "SELECT DISTINCT feature FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS feature FROM fx_sel HAVING abs(corr({a}, {b})) > 0.8" for a, b in PAIRS) + ") t",
)
def _(spark, sf):
    return names(spark, sel.correlated_columns(fixture(spark, sf, "fx_sel"), CORR, 0.8))


@query(
    "n07_collinear_table",
    " UNION ALL ".join(
        f"SELECT '{b}' AS drop, '{a}' AS because_of, RND(corr({a}, {b})) AS r FROM fx_sel HAVING abs(corr({a}, {b})) > 0.9" for a, b in PAIRS
    ),
)
def _(spark, sf):
    return sel.collinear_table(fixture(spark, sf, "fx_sel"), CORR, 0.9).withColumn("r", rnd("r"))


@query(
    "n08_correlated_groups",
    "WITH RECURSIVE pairs AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM fx_sel" for a, b in PAIRS)
    + """), mates AS (SELECT a AS f, b AS other, r FROM pairs WHERE r >= 0.8 AND r < 1 UNION ALL SELECT b, a, r FROM pairs WHERE r >= 0.8 AND r < 1),
       visit AS (SELECT f, row_number() OVER (ORDER BY max(r) DESC, f) AS k, list_sort(list(other)) AS others FROM mates GROUP BY f),
       walk(k, taken, head, others) AS (
         SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR[])
         UNION ALL
         SELECT v.k, CASE WHEN list_contains(w.taken, v.f) THEN w.taken ELSE list_concat(list_concat(w.taken, [v.f]), v.others) END,
                CASE WHEN NOT list_contains(w.taken, v.f) THEN v.f END, v.others
         FROM walk w JOIN visit v ON v.k = w.k + 1)
       SELECT head, array_to_string(others, ', ') AS members FROM walk WHERE head IS NOT NULL""",
)
def _(spark, sf):
    found = sel.correlated_groups(fixture(spark, sf, "fx_sel"), CORR, 0.8)
    return spark.createDataFrame([(h, ", ".join(g)) for h, g in found], "head string, members string")


@query("n09_best_of_group")
def _(spark, sf):
    train, _ = parts(spark, sf)
    forest = m.learner("forest", numTrees=10, maxDepth=3)
    return sel.best_of_groups(train, [["q", "n", "p"], ["d", "quasi"]], "y", forest)


MI = """cells AS (SELECT variable, bin, y, CAST(count(*) AS DOUBLE) AS k FROM binned GROUP BY variable, bin, y),
    t AS (SELECT variable, k / sum(k) OVER (PARTITION BY variable) * ln(k * sum(k) OVER (PARTITION BY variable)
            / (sum(k) OVER (PARTITION BY variable, bin) * sum(k) OVER (PARTITION BY variable, y))) AS v FROM cells)
    SELECT variable, RND(sum(v)) AS mutual_information FROM t GROUP BY variable"""
DECILE_LIST = "[" + ", ".join(f"{i}/10.0" for i in range(11)) + "]"


def cut_list(c):
    return f"list_sort(list_distinct(quantile_cont({c}, {DECILE_LIST}))) AS {c}_cut"


def binned_sql(cols, goal="y", more=""):
    cuts = ", ".join(cut_list(c) for c in cols) + more
    pick = "greatest(len(list_filter({c}_cut, lambda x: x < {c})) - 1, 0)"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS variable, {pick.format(c=c)} AS bin, {goal} AS y FROM fx_num, e" for c in cols)
    return f"e AS (SELECT {cuts} FROM fx_num), binned AS ({rows})"


@query("n10_mutual_information", f"WITH {binned_sql(('q', 'n', 'd'))}, {MI}")
def _(spark, sf):
    out = sel.mutual_information(fixture(spark, sf, "fx_num"), ["q", "n", "d"], "y")
    return sel.best_k(out, "mutual_information", 3).withColumn("mutual_information", rnd("mutual_information"))


@query(
    "n10_mutual_information_regression",
    f"""SELECT variable, mutual_information FROM (
          WITH {binned_sql(('q', 'n', 'd'), 'greatest(len(list_filter(yr_cut, lambda x: x < yr)) - 1, 0)', ', ' + cut_list('yr'))}, {MI}) t
        ORDER BY mutual_information DESC LIMIT 2""",
)
def _(spark, sf):
    out = sel.mutual_information(fixture(spark, sf, "fx_num"), ["q", "n", "d"], "yr", regression=True)
    return sel.best_percent(out, "mutual_information", 70).withColumn("mutual_information", rnd("mutual_information"))


@query(
    "n11_chi_square",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, RND(sum(pow(o - e, 2) / e)) AS chi2 FROM (
              SELECT sum({c}) AS o, count(*) / (SELECT count(*) FROM fx_num) * (SELECT sum({c}) FROM fx_num) AS e FROM fx_num GROUP BY y) t"""
        for c in ("q", "n", "d")
    ),
)
def _(spark, sf):
    out = sel.chi2_scores(fixture(spark, sf, "fx_num"), ["q", "n", "d"], "y")
    return out.select("variable", rnd("chi2").alias("chi2"))


@query(
    "n12_anova",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, RND((sum(k * pow(m - (SELECT avg({c}) FROM fx_num), 2)) / (count(*) - 1)) / (sum(k * v) / (sum(k) - count(*)))) AS f
            FROM (SELECT count(*) AS k, avg({c}) AS m, var_pop({c}) AS v FROM fx_num GROUP BY y) t"""
        for c in ("q", "n", "d")
    ),
)
def _(spark, sf):
    out = sel.anova_scores(fixture(spark, sf, "fx_num"), ["q", "n", "d"], "y")
    return out.select("variable", rnd("f").alias("f"))


@query(
    "n13_regression_f_constant",
    "SELECT 'const' AS variable, CAST(NULL AS DOUBLE) AS f UNION ALL SELECT 'q', RND2(pow(corr(q, p), 2) / (1 - pow(corr(q, p), 2)) * (count(*) - 2)) FROM fx_sel",
)
def _(spark, sf):
    out = sel.regression_f_scores(fixture(spark, sf, "fx_sel"), ["const", "q"], "p")
    return out.select("variable", rnd("f", 2).alias("f"))


@query(
    "n13_regression_f",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, RND2(pow(corr({c}, yr), 2) / (1 - pow(corr({c}, yr), 2)) * (count(*) - 2)) AS f FROM fx_num" for c in ("q", "n", "d")
    ),
)
def _(spark, sf):
    out = sel.regression_f_scores(fixture(spark, sf, "fx_num"), ["q", "n", "d"], "yr")
    return out.select("variable", rnd("f", 2).alias("f"))


def tree_scores_sql(metric: str, cols, source: str, y: str) -> str:
    """The test metric of a tree of depth 3 on each column."""
    train = f"(SELECT * FROM {source} WHERE split = 'train')"
    trees = ", ".join(tree_sql(f"t_{c}", train, c, y, 3) for c in cols)
    scored = ", ".join(
        f"s_{c} AS (SELECT value AS s, {y} AS y FROM {source} r JOIN t_{c}_leaves ON r.{c} > lo AND r.{c} <= hi WHERE split <> 'train')" for c in cols
    )
    value = {"mse": "SELECT avg((y - s) * (y - s)) FROM s_{c}", "auc": "{auc}"}[metric]
    rows = [f"SELECT '{c}' AS variable, ({value.format(c=c, auc=auc_sql('s', f's_{c}'))}) AS value" for c in cols]
    shown = "RND(value) AS value" if metric == "auc" else "RND0(value) AS value"
    return f"WITH {trees}, {scored} SELECT variable, {shown} FROM ({' UNION ALL '.join(rows)}) r" + (" WHERE value > 0.5" if metric == "auc" else "")


@query("n14_single_feature_auc", tree_scores_sql("auc", PLAIN, "fx_tree", "y"))
def _(spark, sf):
    train, test = parts(spark, sf, "fx_tree")
    return sel.single_feature_scores(train, test, PLAIN, "y", "auc", depth=3).where("value > 0.5").withColumn("value", rnd("value"))


@query("n15_single_feature_mse", tree_scores_sql("mse", ["q", "n", "d"], "fx_tree", "yr"))
def _(spark, sf):
    train, test = parts(spark, sf, "fx_tree")
    return sel.single_feature_scores(train, test, ["q", "n", "d"], "yr", "mse", depth=3).withColumn("value", rnd("value", 0))


@query(
    "n16_label_mean_auc",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, RND(({auc_sql('v', f"(SELECT t.yb AS y, s.v FROM fx_label t JOIN (SELECT {c}, avg(yb) AS v FROM fx_label WHERE split = 'train' GROUP BY {c}) s ON t.{c} = s.{c} WHERE t.split = 'test') j")})) AS auc"""
        for c in ("label", "label2")
    ),
)
def _(spark, sf):
    return sel.label_mean_auc(fixture(spark, sf, "fx_label"), ["label", "label2"], "yb").withColumn("auc", rnd("auc"))


@query(
    "n17_binned_mean_auc",
    f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(w, {DECILE_LIST}))) AS cuts, list_sort(list_distinct(quantile_cont(x, {DECILE_LIST}))) AS xcuts FROM fx_miss WHERE split = 'train'),
             b AS (SELECT y, split, CAST(greatest(least(len(list_filter(cuts, lambda k: k < w)) - 1, 9), 0) AS VARCHAR) AS wb,
                          CASE WHEN x IS NULL THEN 'Missing' ELSE CAST(greatest(least(len(list_filter(xcuts, lambda k: k < x)) - 1, 9), 0) AS VARCHAR) END AS xb FROM fx_miss, e)
        """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, RND(({auc_sql('v', f"(SELECT t.y, s.v FROM b t JOIN (SELECT {c}b, avg(y) AS v FROM b WHERE split = 'train' GROUP BY {c}b) s ON t.{c}b = s.{c}b WHERE t.split = 'test') j")})) AS auc"""
        for c in ("w", "x")
    ),
)
def _(spark, sf):
    return sel.binned_mean_auc(fixture(spark, sf, "fx_miss"), ["w", "x"], "y").withColumn("auc", rnd("auc"))


# ---------------------------------------------------------------- wrappers


def folded(spark, sf, k=2):
    return m.add_folds(fixture(spark, sf, "fx_sel"), ["id"], k, strata=["y"])


def wrapped():
    """The learner of the wrapper searches: a forest of 100 trees, grown as deep as Spark ML lets them. Rows keep the
    node they have come to: the forest is the same, but no level walks all trees from their roots again."""
    return m.learner("forest", numTrees=100, maxDepth=30, cacheNodeIds=True)


@query("n18_step_forward")
def _(spark, sf):
    return sel.step_forward(folded(spark, sf), ["q", "n", "d"], "y", wrapped(), "auc", 2)


@query("n19_step_backward")
def _(spark, sf):
    return sel.step_backward(folded(spark, sf), ["q", "n", "d"], "y", wrapped(), "auc", 2)


@query("n20_exhaustive")
def _(spark, sf):
    return sel.exhaustive(folded(spark, sf), ["q", "n", "d"], "y", wrapped(), "auc", 1, 2)


@query("n21_l1_logistic")
def _(spark, sf):
    train, _ = parts(spark, sf)
    lasso = m.learner("logistic", elasticNetParam=1.0, regParam=0.05, maxIter=20)
    return sel.nonzero_features(sel.coefficient_table(train, PLAIN, "y", lasso))


@query("n22_lasso")
def _(spark, sf):
    train, _ = parts(spark, sf, "fx_num")
    return sel.nonzero_features(sel.coefficient_table(train, ["q", "n", "d"], "yr", m.learner("lasso", regParam=100.0)))


@query("n23_coefficient_above_mean")
def _(spark, sf):
    train, _ = parts(spark, sf)
    coefs = sel.coefficient_table(train, PLAIN, "y", m.learner("logistic", regParam=0.001, maxIter=20))
    return sel.above_mean_features(coefs, "coefficient")


@query("n24_linear_coefficient_above_mean")
def _(spark, sf):
    train, _ = parts(spark, sf, "fx_num")
    return sel.above_mean_features(sel.coefficient_table(train, ["q", "n", "d"], "yr", m.learner("linear")), "coefficient")


@query("n25_coefficient_path")
def _(spark, sf):
    train, _ = parts(spark, sf)
    return sel.coefficient_path(train, PLAIN, "y", lambda r: m.learner("logistic", regParam=r, maxIter=10), [0.001, 0.1, 1.0])


@query("n26_forest_above_mean")
def _(spark, sf):
    train, _ = parts(spark, sf)
    return sel.above_mean_features(sel.importance_table(train, PLAIN, "y", m.learner("forest", numTrees=10, maxDepth=4)), "importance")


@query("n27_boosting_above_mean")
def _(spark, sf):
    train, _ = parts(spark, sf)
    # up to 200 rounds, stopped on a tenth of the rows
    rows = train.withColumn("valid", hash_uniform(["id"], 5) < 0.1)
    (model,) = bst.boost(rows, PLAIN, "y", bst.Settings(rounds=200, rate=0.5, patience=3), valid="valid")
    return sel.above_mean_features(m.rows_table(train, model.importances(), "feature string, importance double"), "importance")


@query("n28_recursive_elimination")
def _(spark, sf):
    train, _ = parts(spark, sf)
    return sel.recursive_elimination(train, PLAIN, "y", m.learner("forest", numTrees=5, maxDepth=3), 2)


@query("n28_recursive_elimination_cv")
def _(spark, sf):
    train, _ = parts(spark, sf)
    folds = m.add_folds(train, ["id"], 3, seed=4, strata=["y"])
    return sel.recursive_elimination_cv(folds, PLAIN, "y", m.learner("tree", maxDepth=3), "auc")


@query("n29_shuffle_selection")
def _(spark, sf):
    train, test = parts(spark, sf)
    return sel.shuffle_selection(train, test, PLAIN, "y", ["id"], m.learner("forest", numTrees=5, maxDepth=3), "auc")


@query("n29_shuffle_selection_regression")
def _(spark, sf):
    train, test = parts(spark, sf, "fx_num")
    return sel.shuffle_selection(train, test, ["q", "n", "d"], "yr", ["id"], m.learner("linear"), "rmse")


@query("n30_hybrid_elimination")
def _(spark, sf):
    train, test = parts(spark, sf)
    return sel.hybrid_elimination(train, test, PLAIN, "y", m.learner("forest", numTrees=5, maxDepth=3), "auc", 0.001)


@query("n31_hybrid_addition")
def _(spark, sf):
    train, test = parts(spark, sf)
    return sel.hybrid_addition(train, test, PLAIN, "y", m.learner("forest", numTrees=5, maxDepth=3), "auc", 0.001)


@query("n32_zero_importance")
def _(spark, sf):
    train, _ = parts(spark, sf)
    out = sel.mean_importance(train, [*PLAIN, "const"], "y", lambda s: m.learner("boosted", maxIter=15, maxDepth=3, seed=s), ["id"])
    return out.withColumn("dropped", F.col("importance") == 0)


@query("n33_importance_above_percent")
def _(spark, sf):
    train, _ = parts(spark, sf)
    out = sel.importance_table(train, PLAIN, "y", m.learner("forest", numTrees=10, maxDepth=4))
    return out.withColumn("importance", F.col("importance") * 100).where("importance > 1")


@query(
    "n34_cumulative_importance",
    """WITH i AS (SELECT p_brand AS feature, round(sum(p_retailprice), 0) AS importance FROM part GROUP BY p_brand),
            c AS (SELECT feature, importance / sum(importance) OVER () AS share,
                         sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance) OVER () AS cum_share FROM i)
       SELECT feature, RND(share) AS share, RND(cum_share) AS cum_share, cum_share - share <= 0.9 AS needed FROM c""",
)
def _(spark, sf):
    table_ = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.sum("p_retailprice"), 0).alias("importance"))
    out = sel.features_to_reach(table_, 0.9)
    return out.select("feature", rnd("share").alias("share"), rnd("cum_share").alias("cum_share"), "needed")


@query("n35_selection_funnel")
def _(spark, sf):
    train, test = parts(spark, sf)
    return sel.selection_funnel(train, test, FEATURES, "y", ["id"], m.learner("forest", numTrees=5, maxDepth=3))


@query("n36_compare_feature_lists")
def _(spark, sf):
    train, test = parts(spark, sf)
    lists = {"all": FEATURES, "plain": PLAIN, "few": ["q", "n"]}
    learners = {"logistic": m.learner("logistic"), "forest": m.learner("forest", numTrees=5, maxDepth=3)}
    return sel.compare_feature_lists(train, test, lists, "y", learners, "auc")
