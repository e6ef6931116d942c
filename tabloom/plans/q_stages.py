"""Imputers, outliers, rare labels, encoders, discretisers, scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths
from ..operators import discretise as disc, encode as enc, impute, outliers, profile as prof, rare, scale
from ..operators.column_trees import counted_values, grow
from ..operators.ordered import quantiles
from ..operators.relational import merge_labels
from ..operators.stages import Chain
from ..sources.tables import table
from .registry import auc_sql, fixture, hash_sql, query, rnd, tree_sql

TRAIN = "split = 'train'"


def parts(spark, sf, name):
    df = fixture(spark, sf, name)
    return df.where(TRAIN), df


def scalar(expr: str, src: str) -> str:
    return f"(SELECT {expr} FROM {src} WHERE split = 'train')"


# ---------------------------------------------------------------- imputers


@query(
    "h01_mean_median",
    f"""SELECT id, RND(coalesce(x, {scalar('avg(x)', 'fx_miss')})) AS x_mean, RND(coalesce(x, {scalar('median(x)', 'fx_miss')})) AS x_median FROM fx_miss""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    a = impute.MeanMedian("mean", ["x"]).fit(train)
    b = impute.MeanMedian("median", ["x"]).fit(train)
    both = a.transform(df.withColumn("raw", F.col("x"))).withColumn("x_mean", F.col("x")).withColumn("x", F.col("raw"))
    return b.transform(both).select("id", rnd("x_mean").alias("x_mean"), rnd("x").alias("x_median"))


@query("h02_fixed_number", "SELECT id, coalesce(x, -999) AS x FROM fx_miss")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.FixedNumber(-999, ["x"]).fit(train).transform(df).select("id", "x")


def donor_sql(column: str, drawn: str) -> str:
    """Nulls of a column replaced by the donor row that a hash picks."""
    pick = hash_sql(7, f"'{column}'", drawn)
    return f"""coalesce(t.{column}, (SELECT d.{column} FROM donors_{column} d WHERE d.pos = 1 + {pick} % (SELECT count(*) FROM donors_{column})))"""


def donors_sql(column: str) -> str:
    return f"donors_{column} AS (SELECT {column}, row_number() OVER (ORDER BY {hash_sql(7, 'id')}, id) AS pos FROM fx_miss WHERE split = 'train' AND {column} IS NOT NULL)"


@query("h03_random_sample", f"WITH {donors_sql('x')}, {donors_sql('c')} SELECT id, {donor_sql('x', 't.id')} AS x, {donor_sql('c', 't.id')} AS c FROM fx_miss t")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.RandomSample(["x", "c"], ["id"], seed=7).fit(train).transform(df).select("id", "x", "c")


@query("h04_row_seeded_sample", f"WITH {donors_sql('c')} SELECT id, w, {donor_sql('c', 't.w')} AS c FROM fx_miss t")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.RandomSample(["c"], ["id"], seed=7, row_seed="w").fit(train).transform(df).select("id", "w", "c")


@query("h05_missing_flag", "SELECT id, x, c, CAST(x IS NULL AS INTEGER) AS x_na, CAST(c IS NULL AS INTEGER) AS c_na FROM fx_miss")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.MissingFlag(["x", "c"]).fit(train).transform(df).select("id", "x", "c", "x_na", "c_na")


@query("h06_gaussian_tail", f"SELECT id, RND(coalesce(x, {scalar('avg(x) + 3 * stddev_samp(x)', 'fx_miss')})) AS x FROM fx_miss")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.EndOfTail("gaussian", "right", 3, ["x"]).fit(train).transform(df).select("id", rnd("x").alias("x"))


@query(
    "h07_skewed_tail",
    f"""SELECT id, RND(coalesce(x, {scalar('quantile_cont(x, 0.25) - 3 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))', 'fx_miss')})) AS x FROM fx_miss""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.EndOfTail("skewed", "left", 3, ["x"]).fit(train).transform(df).select("id", rnd("x").alias("x"))


TOP_LABEL = "(SELECT c FROM fx_miss WHERE split = 'train' AND c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)"


@query("h08_frequent_label", f"SELECT id, coalesce(c, {TOP_LABEL}) AS c FROM fx_miss")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.FrequentLabel(["c"]).fit(train).transform(df).select("id", "c")


@query("h09_missing_label", "SELECT id, coalesce(c, 'Missing') AS c FROM fx_miss")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return impute.MissingLabel(["c"]).fit(train).transform(df).select("id", "c")


@query(
    "h10_numeric_mode",
    """WITH s AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE n END AS n, split FROM fx_num)
       SELECT id, coalesce(n, (SELECT n FROM s WHERE split = 'train' AND n IS NOT NULL GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)) AS n,
              CAST(n IS NULL AS INTEGER) AS n_na FROM s""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num").withColumn("n", F.when(F.col("id") % 6 != 0, F.col("n")))
    return impute.NumericMode(["n"]).fit(df.where(TRAIN)).transform(df).select("id", "n", "n_na")


@query("h11_complete_cases", "SELECT id, x, c FROM fx_miss WHERE x IS NOT NULL AND c IS NOT NULL")
def _(spark, sf):
    return fixture(spark, sf, "fx_miss").select("id", "x", "c").dropna()


@query(
    "h12_null_only_in_score",
    """WITH s AS (SELECT id, split, p, CASE WHEN split = 'test' AND id % 4 = 0 THEN NULL ELSE q END AS q FROM fx_num)
       SELECT id, RND(p) AS p, RND(coalesce(q, (SELECT median(q) FROM s WHERE split = 'train'))) AS q FROM s""",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_num").withColumn("q", F.when(~((F.col("split") == "test") & (F.col("id") % 4 == 0)), F.col("q")))
    train, score = df.where(TRAIN), df.where("split <> 'train'")
    cols = impute.null_only_in_score(train, score, ["q", "p"])
    return impute.MeanMedian("median", cols).fit(train).transform(df).select("id", rnd("p").alias("p"), rnd("q").alias("q"))


@query("h13_zero_fill", "SELECT id, coalesce(x, 0) AS x, w FROM fx_miss")
def _(spark, sf):
    return fixture(spark, sf, "fx_miss").select("id", "x", "w").na.fill(0)


# ---------------------------------------------------------------- outliers

G_LOW, G_HIGH = "avg(p) - {k} * stddev_samp(p)", "avg(p) + {k} * stddev_samp(p)"
Q_LOW = "quantile_cont(p, 0.25) - {k} * (quantile_cont(p, 0.75) - quantile_cont(p, 0.25))"
Q_HIGH = "quantile_cont(p, 0.75) + {k} * (quantile_cont(p, 0.75) - quantile_cont(p, 0.25))"


def bounds_table(spark, df, cols, distribution, folds):
    rows = []
    for k in folds:
        for c, (low, high) in outliers.tail_bounds(df, cols, distribution, k).items():
            rows.append((c, float(k), low, high))
    out = spark.createDataFrame(rows, "variable string, fold double, low double, high double")
    return out.withColumns({"low": rnd("low"), "high": rnd("high")})


@query("i01_gaussian_bounds", f"SELECT 'p' AS variable, CAST(3 AS DOUBLE) AS fold, RND({G_LOW.format(k=3)}) AS low, RND({G_HIGH.format(k=3)}) AS high FROM fx_num WHERE split = 'train'")
def _(spark, sf):
    return bounds_table(spark, parts(spark, sf, "fx_num")[0], ["p"], "gaussian", [3])


@query(
    "i02_quartile_fences",
    " UNION ALL ".join(
        f"SELECT 'p' AS variable, CAST({k} AS DOUBLE) AS fold, RND({Q_LOW.format(k=k)}) AS low, RND({Q_HIGH.format(k=k)}) AS high FROM fx_num WHERE split = 'train'"
        for k in (1.5, 3)
    ),
)
def _(spark, sf):
    return bounds_table(spark, parts(spark, sf, "fx_num")[0], ["p"], "skewed", [1.5, 3])


@query(
    "i03_outside_shares",
    f"""WITH b AS (SELECT {Q_LOW.format(k=1.5)} AS lo, {Q_HIGH.format(k=1.5)} AS hi FROM fx_num WHERE split = 'train')
        SELECT 'p' AS variable, RND(min(lo)) AS low, RND(min(hi)) AS high, RND(avg(CASE WHEN p < lo THEN 1.0 ELSE 0.0 END)) AS below_share,
               RND(avg(CASE WHEN p > hi THEN 1.0 ELSE 0.0 END)) AS above_share FROM fx_num, b""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    out = outliers.outside_shares(df, outliers.tail_bounds(train, ["p"], "skewed", 1.5))
    return out.select("variable", *[rnd(c).alias(c) for c in out.columns[1:]])


@query("i04_clip", "SELECT id, CASE WHEN x > 400000 THEN 400000 WHEN x < 50000 THEN 50000 ELSE x END AS x FROM fx_miss")
def _(spark, sf):
    return fixture(spark, sf, "fx_miss").select("id", outliers.clip(F.col("x"), 50000.0, 400000.0).alias("x"))


@query(
    "i05_windsorize",
    f"""WITH b AS (SELECT {Q_LOW.format(k=0.5)} AS qlo, {Q_HIGH.format(k=0.5)} AS qhi, {G_LOW.format(k=1)} AS glo, {G_HIGH.format(k=1)} AS ghi FROM fx_num WHERE split = 'train')
        SELECT id, RND(CASE WHEN p > qhi THEN qhi WHEN p < qlo THEN qlo ELSE p END) AS skewed,
               RND(CASE WHEN p > ghi THEN ghi ELSE p END) AS gaussian FROM fx_num, b""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    both = outliers.Windsorizer("skewed", "both", 0.5, ["p"]).fit(train)
    right = outliers.Windsorizer("gaussian", "right", 1.0, ["gaussian"]).fit(train.withColumn("gaussian", F.col("p")))
    out = both.transform(right.transform(df.withColumn("gaussian", F.col("p"))))
    return out.select("id", rnd("p").alias("skewed"), rnd("gaussian").alias("gaussian"))


@query("i06_fixed_caps", "SELECT id, least(q, 150) AS q, RND(greatest(least(p, 300000), 20000)) AS p, greatest(n, 2) AS n FROM fx_num")
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    out = outliers.FixedCaps({"q": 150, "p": 300000}, {"p": 20000, "n": 2}).fit(df).transform(df)
    return out.select("id", "q", rnd("p").alias("p"), "n")


@query(
    "i07_trim",
    f"""WITH b AS (SELECT {Q_LOW.format(k=1.5)} AS lo, {Q_HIGH.format(k=1.5)} AS hi FROM fx_num WHERE split = 'train')
        SELECT id, RND(p) AS p FROM fx_num, b WHERE p >= lo AND p <= hi""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return outliers.Windsorizer("skewed", "both", 1.5, ["p"]).fit(train).trim(df).select("id", rnd("p").alias("p"))


@query("i08_zero_values", "SELECT count(*) FILTER (l_discount = 0) AS n_zero, min(l_discount) FILTER (l_discount <> 0) AS smallest FROM lineitem")
def _(spark, sf):
    x = F.col("l_discount")
    return table(spark, sf, "lineitem").agg(F.count_if(x == 0).alias("n_zero"), F.min(F.when(x != 0, x)).alias("smallest"))


# ---------------------------------------------------------------- rare labels

SHARES = "(SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM fx_label WHERE split = 'train') AS share FROM fx_label WHERE split = 'train' GROUP BY label)"
KEPT = f"(SELECT label FROM {SHARES} s WHERE share >= 0.04)"
FREQUENT = f"(SELECT label FROM {SHARES} s ORDER BY n DESC, label LIMIT 1)"


@query("j01_rare_labels", f"SELECT 'label' AS variable, label, n, RND(share) AS share FROM {SHARES} s WHERE share < 0.04")
def _(spark, sf):
    return rare.rare_labels(parts(spark, sf, "fx_label")[0], ["label"], 0.04).withColumn("share", rnd("share"))


def grouped(spark, sf, **kw):
    train, df = parts(spark, sf, "fx_label")
    return rare.RareLabels(variables=["label"], **kw).fit(train).transform(df).select("id", "label")


@query("j02_rare_to_label", f"SELECT id, CASE WHEN label IN {KEPT} THEN label ELSE 'Rare' END AS label FROM fx_label")
def _(spark, sf):
    return grouped(spark, sf, tol=0.04)


@query("j03_rare_to_frequent", f"SELECT id, CASE WHEN label IN {KEPT} THEN label ELSE {FREQUENT} END AS label FROM fx_label")
def _(spark, sf):
    return grouped(spark, sf, tol=0.04, into=None)


@query(
    "j04_keep_list",
    f"SELECT id, label IN (SELECT label FROM fx_label WHERE split = 'train') AS seen, CASE WHEN label IN {KEPT} THEN label ELSE 'Rare' END AS label FROM fx_label",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_label")
    seen = train.select("label").distinct().withColumn("seen", F.lit(True))
    tagged = df.join(seen, "label", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return rare.RareLabels(0.04, 0, ["label"]).fit(train).transform(tagged).select("id", "seen", "label")


@query(
    "j05_rare_encoder",
    f"SELECT id, CASE WHEN label IN {KEPT} THEN label ELSE 'Rare' END AS label, label2 FROM fx_label",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_label")
    return rare.RareLabels(0.04, 10, ["label", "label2"]).fit(train).transform(df).select("id", "label", "label2")


@query(
    "j06_dominated_columns",
    """SELECT variable, label, n, RND(n / (SELECT count(*) FROM lineitem)) AS share, count(*) OVER (PARTITION BY variable) AS n_labels FROM (
         SELECT 'l_linestatus' AS variable, l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY l_linestatus) t""",
)
def _(spark, sf):
    return rare.dominated_columns(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag"]).withColumn("share", rnd("share"))


@query(
    "j07_group_many_labels",
    """WITH s AS (SELECT label2, count(*) / (SELECT count(*) FROM fx_label WHERE split = 'train') AS share FROM fx_label WHERE split = 'train' GROUP BY label2)
       SELECT id, 'rare' AS label, CASE WHEN label2 IN (SELECT label2 FROM s WHERE share >= 0.1) THEN label2 ELSE 'rare' END AS label2 FROM fx_label""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_label")
    return rare.RareLabels(0.1, 0, ["label", "label2"], "rare").fit(train).transform(df).select("id", "label", "label2")


@query("j08_replace_listed", f"SELECT id, CASE WHEN label IN ('Brand#1', 'Brand#2') THEN {FREQUENT} ELSE label END AS label FROM fx_label")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_label")
    top = prof.modes(train, ["label"]).first()["mode"]
    return df.select("id", merge_labels(F.col("label"), ["Brand#1", "Brand#2"], top).alias("label"))


# ---------------------------------------------------------------- encoders

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def dummies_sql(labels, col="label2", src="fx_label"):
    return "SELECT id, " + ", ".join(f"CAST({col} = '{x}' AS INTEGER) AS \"{col}_{x}\"" for x in labels) + f" FROM {src}"


def dummies(spark, sf, **kw):
    train, df = parts(spark, sf, "fx_label")
    return enc.OneHot(["label2"], **kw).fit(train).transform(df.select("id", "label2")).drop("label2")


@query("k01_one_hot", dummies_sql(TYPES))
def _(spark, sf):
    return dummies(spark, sf)


@query("k02_one_hot_less_one", dummies_sql(TYPES[1:]))
def _(spark, sf):
    return dummies(spark, sf, drop="first")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "k03_one_hot_null",
    "SELECT id, CAST(c IS NULL AS INTEGER) AS c_nan, "
    + ", ".join(f"CAST(coalesce(c = '{x}', false) AS INTEGER) AS \"c_{x}\"" for x in PRIORITIES)
    + " FROM fx_miss",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    return enc.OneHot(["c"], null_column=True).fit(train).transform(df.select("id", "c")).drop("c")


@query(
    "k04_one_hot_top",
    """WITH top AS (SELECT label2, row_number() OVER (ORDER BY count(*) DESC, label2) AS r FROM fx_label WHERE split = 'train' GROUP BY label2)
       SELECT id, CAST(label2 IN (SELECT label2 FROM top WHERE r <= 2) AS INTEGER) AS in_top FROM fx_label""",
)
def _(spark, sf):
    out = dummies(spark, sf, top=2)
    return out.select("id", sum(F.col(f"`{c}`") for c in out.columns[1:]).alias("in_top"))


@query(
    "k05_given_order",
    "SELECT o_orderkey, CASE dayname(o_orderdate) " + " ".join(
        f"WHEN '{d}' THEN CAST({i} AS DOUBLE)" for i, d in enumerate(("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"), 1)
    ) + " END AS day_number FROM orders",
)
def _(spark, sf):
    days = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("day"))
    stage = enc.GivenOrder({"day": {d: i for i, d in enumerate(days, 1)}}, "_number")
    return stage.fit(df).transform(df).select("o_orderkey", "day_number")


def encoded(spark, sf, method, target=None, **kw):
    train, df = parts(spark, sf, "fx_label")
    out = enc.LabelNumbers(method, ["label", "label2"], target, suffix="_code", **kw).fit(train).transform(df)
    return out.select("id", rnd("label_code").alias("label_code"), rnd("label2_code").alias("label2_code"))


def encoded_sql(expr: str) -> str:
    state = "(SELECT {c}, {e} AS v FROM fx_label WHERE split = 'train' GROUP BY {c})"
    return (
        "SELECT id, RND(a.v) AS label_code, RND(b.v) AS label2_code FROM fx_label f "
        f"LEFT JOIN {state.format(c='label', e=expr.replace('{c}', 'label'))} a ON f.label = a.label "
        f"LEFT JOIN {state.format(c='label2', e=expr.replace('{c}', 'label2'))} b ON f.label2 = b.label2"
    )


@query("k06_integer_labels", encoded_sql("row_number() OVER (ORDER BY {c}) - 1"))
def _(spark, sf):
    return encoded(spark, sf, "integer")


@query("k07_count", encoded_sql("count(*)"))
def _(spark, sf):
    return encoded(spark, sf, "count")


@query("k08_frequency", encoded_sql("count(*) / (SELECT count(*) FROM fx_label WHERE split = 'train')"))
def _(spark, sf):
    return encoded(spark, sf, "frequency")


@query("k09_target_ordered", encoded_sql("row_number() OVER (ORDER BY avg(yb), {c}) - 1"))
def _(spark, sf):
    return encoded(spark, sf, "ordered", "yb")


@query("k10_target_mean", encoded_sql("avg(y)"))
def _(spark, sf):
    return encoded(spark, sf, "mean", "y")


@query("k11_probability_ratio", encoded_sql("greatest(avg(yb), 1e-5) / greatest(1 - avg(yb), 1e-5)"))
def _(spark, sf):
    return encoded(spark, sf, "ratio", "yb")


@query("k12_weight_of_evidence", encoded_sql("ln(greatest(avg(yb), 1e-5) / greatest(1 - avg(yb), 1e-5))"))
def _(spark, sf):
    return encoded(spark, sf, "woe", "yb")


@query(
    "k14_crossed_one_hot",
    "SELECT o_orderkey, " + ", ".join(
        f"CAST(o_orderstatus = '{s}' AND o_orderpriority = '{p}' AS INTEGER) AS \"crossed_{s}_{p}\"" for s in "FOP" for p in PRIORITIES
    ) + " FROM orders",
)
def _(spark, sf):
    from ..functions.text import cross

    df = table(spark, sf, "orders").select("o_orderkey", cross(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("crossed"))
    return enc.OneHot(["crossed"], drop_source=True).fit(df).transform(df)


@query(
    "k15_unseen_labels",
    """WITH s AS (SELECT label, avg(y) AS v FROM fx_label WHERE split = 'train' GROUP BY label)
       SELECT id, RND(v) AS as_null, RND(coalesce(v, 0)) AS as_zero, RND(coalesce(v, (SELECT avg(y) FROM fx_label WHERE split = 'train'))) AS as_mean
       FROM fx_label f LEFT JOIN s ON f.label = s.label""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_label")
    whole = train.agg(F.avg("y")).first()[0]
    for suffix, other in (("_null", None), ("_zero", 0.0), ("_mean", whole)):
        df = enc.LabelNumbers("mean", ["label"], "y", other, suffix).fit(train).transform(df)
    return df.select("id", *[rnd(f"label_{k}").alias(f"as_{k}") for k in ("null", "zero", "mean")])


# ---------------------------------------------------------------- discretisers


def cut_sql(edges: str, col: str, n: int, low: str = "NULL", high: str = "NULL") -> str:
    chain = " ".join(f"WHEN {col} <= {edges}[{i + 2}] THEN {i}" for i in range(n))
    return f"CASE WHEN {col} < {edges}[1] THEN {low} {chain} ELSE {high} END"


DECILES = "e AS (SELECT quantile_cont(p, [" + ", ".join(f"{i}/10.0" for i in range(11)) + "]) AS cuts FROM fx_num WHERE split = 'train')"
P_BIN = cut_sql("cuts", "p", 10)


@query("l01_equal_frequency", f"WITH {DECILES} SELECT id, {P_BIN} AS p_bin FROM fx_num, e")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return disc.EqualFrequency(10, ["p"]).fit(train).transform(df).select("id", "p_bin")


@query(
    "l02_duplicate_edges",
    "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(n, ["
    + ", ".join(f"{i}/10.0" for i in range(11))
    + """]))) AS cuts FROM fx_num WHERE split = 'train')
     SELECT id, CASE WHEN n < cuts[1] OR n > cuts[len(cuts)] THEN NULL
                     ELSE CAST(greatest(len(list_filter(cuts, lambda x: x < n)) - 1, 0) AS INTEGER) END AS n_bin FROM fx_num, e""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return disc.EqualFrequency(10, ["n"], duplicates="drop").fit(train).transform(df).select("id", "n_bin")


@query(
    "l03_integer_width",
    """WITH a AS (SELECT floor(min(q)) AS lo, ceil(max(q)) AS hi FROM fx_num WHERE split = 'train'),
            b AS (SELECT lo, hi, greatest(1, round_even((hi - lo) / 10, 0)) AS step FROM a),
            c AS (SELECT lo, step, lo + (ceil((hi + step - lo) / step) - 1) * step AS top FROM b)
       SELECT id, CASE WHEN q < lo OR q > top THEN NULL ELSE CAST(greatest(ceil((q - lo) / step) - 1, 0) AS INTEGER) END AS q_bin FROM fx_num, c""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return disc.EqualWidth(10, ["q"], whole=True).fit(train).transform(df).select("id", "q_bin")


WIDTHS = "e AS (SELECT [" + ", ".join(f"min(p) + {i} * ((max(p) - min(p)) / 10)" for i in range(10)) + ", max(p)] AS cuts FROM fx_num WHERE split = 'train')"


@query("l04_equal_width", f"WITH {WIDTHS} SELECT id, {P_BIN} AS p_bin FROM fx_num, e")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return disc.EqualWidth(10, ["p"]).fit(train).transform(df).select("id", "p_bin")


@query(
    "l05_domain_buckets",
    "SELECT id, CASE WHEN size < 0 OR size > 50 THEN NULL WHEN size <= 10 THEN '0-10' WHEN size <= 25 THEN '10-25' WHEN size <= 40 THEN '25-40' ELSE '>40' END AS size_bin FROM fx_label",
)
def _(spark, sf):
    df = fixture(spark, sf, "fx_label")
    stage = disc.GivenBuckets("size", [0, 10, 25, 40, 50], ["0-10", "10-25", "25-40", ">40"])
    return stage.fit(df).transform(df).select("id", "size_bin")


def chosen_trees_sql(cols=("q", "d"), depths=(1, 2, 3), folds=3) -> str:
    """Trees on single columns whose depth has the best mean AUC over folds: every fold's tree, its AUC on the fold, the
    best depth, and the leaf of each row in the tree of that depth on all folds."""
    parts = [f"folds AS (SELECT id, q, d, y, (row_number() OVER (ORDER BY {hash_sql(0, 'id')}, id) - 1) % {folds} AS fold FROM fx_tree WHERE split = 'train')"]
    for c in cols:
        scores = []
        for depth in depths:
            parts.append(tree_sql(f"{c}{depth}", "folds", c, "y", depth))
            for k in range(folds):
                name = f"{c}{depth}_{k}"
                parts.append(tree_sql(name, f"(SELECT * FROM folds WHERE fold <> {k})", c, "y", depth))
                parts.append(f"{name}_s AS (SELECT value AS s, y FROM folds r JOIN {name}_leaves ON r.{c} > lo AND r.{c} <= hi WHERE fold = {k})")
                scores.append(f"SELECT {depth} AS depth, ({auc_sql('s', f'{name}_s')}) AS auc")
        parts.append(f"{c}_best AS (SELECT depth FROM ({' UNION ALL '.join(scores)}) a GROUP BY depth ORDER BY round(avg(auc), 12) DESC, depth LIMIT 1)")
        every = " UNION ALL ".join(f"SELECT {depth} AS depth, lo, hi, value FROM {c}{depth}_leaves" for depth in depths)
        parts.append(f"{c}_tree AS (SELECT lo, hi, value FROM ({every}) e JOIN {c}_best USING (depth))")
    joins = " ".join(f"JOIN {c}_tree ON f.{c} > {c}_tree.lo AND f.{c} <= {c}_tree.hi" for c in cols)
    shown = ", ".join(f"f.{c}, RND({c}_tree.value) AS {c}_tree" for c in cols)
    return f"WITH {', '.join(parts)} SELECT f.id, {shown} FROM fx_tree f {joins}"


@query("l06_tree_bins", chosen_trees_sql())
def _(spark, sf):
    train, df = parts(spark, sf, "fx_tree")
    stage = disc.TreeBins("y", ["q", "d"], depths=(1, 2, 3), regression=False, key=["id"])
    return stage.fit(train).transform(df).select("id", "q", rnd("q_tree").alias("q_tree"), "d", rnd("d_tree").alias("d_tree"))


TRAIN_ROWS = "(SELECT * FROM fx_tree WHERE split = 'train')"
FIXED_TREES = [(c, d) for c in ("q", "n", "d") for d in (1, 2)]


@query(
    "l06_fixed_depths",
    f"WITH {', '.join(tree_sql(f'{c}{d}', TRAIN_ROWS, c, 'y', d) for c, d in FIXED_TREES)} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {d} AS depth, position, RND(CASE WHEN isinf(hi) THEN NULL ELSE hi END) AS hi, RND(value) AS value, n FROM {c}{d}_leaves" for c, d in FIXED_TREES
    ),
)
def _(spark, sf):
    """Leaves of the trees of three columns at two depths, grown together."""
    train, _ = parts(spark, sf, "fx_tree")
    leaves = grow(counted_values(train, ["q", "n", "d"], "y"), [1, 2])
    hi = F.when(F.col("hi") < float("inf"), F.col("hi"))
    return leaves.select("variable", "depth", F.col("position").cast("long").alias("position"), rnd(hi).alias("hi"), rnd("value").alias("value"), "n")


@query(
    "l07_leaf_bounds",
    f"""WITH {tree_sql("t", TRAIN_ROWS, "q", "y", 3)}
        SELECT RND(value) AS q_tree, min(q) AS q_min, max(q) AS q_max, count(*) AS n FROM fx_num JOIN t_leaves ON q > lo AND q <= hi GROUP BY value""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    out = disc.TreeBins("y", ["q"], depths=(3,)).fit(train).transform(df)
    bounds = out.groupBy("q_tree").agg(F.min("q").alias("q_min"), F.max("q").alias("q_max"), F.count(F.lit(1)).alias("n"))
    return bounds.withColumn("q_tree", rnd("q_tree"))


@query(
    "l08_ordered_bins",
    f"""WITH {DECILES}, b AS (SELECT id, y, split, {P_BIN} AS bin FROM fx_num, e),
             r AS (SELECT bin, row_number() OVER (ORDER BY avg(y), CAST(bin AS VARCHAR)) - 1 AS v FROM b WHERE split = 'train' GROUP BY bin)
        SELECT id, CAST(v AS DOUBLE) AS p_bin FROM b LEFT JOIN r ON b.bin = r.bin""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    bins = disc.EqualFrequency(10, ["p"]).fit(train)
    return enc.LabelNumbers("ordered", ["p_bin"], "y").fit(bins.transform(train)).transform(bins.transform(df)).select("id", "p_bin")


@query(
    "l09_bin_target_mean",
    f"""WITH {DECILES}, b AS (SELECT id, y, split, {P_BIN} AS bin FROM fx_num, e),
             r AS (SELECT bin, avg(y) AS v FROM b WHERE split = 'train' GROUP BY bin)
        SELECT id, RND(v) AS p_bin FROM b LEFT JOIN r ON b.bin = r.bin""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    bins = disc.EqualFrequency(10, ["p"]).fit(train)
    out = enc.LabelNumbers("mean", ["p_bin"], "y").fit(bins.transform(train)).transform(bins.transform(df))
    return out.select("id", rnd("p_bin").alias("p_bin"))


@query("l10_clamped_bins", f"WITH {DECILES} SELECT id, {cut_sql('cuts', 'p', 10, '0', '9')} AS p_bin FROM fx_num, e")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return disc.EqualFrequency(10, ["p"], clamp=True).fit(train).transform(df).select("id", "p_bin")


@query(
    "l11_bin_shares",
    f"""WITH {DECILES}, b AS (SELECT split, {P_BIN} AS bin FROM fx_num, e)
        SELECT bin AS p_bin, RND(count(*) FILTER (split = 'train') / (SELECT count(*) FROM b WHERE split = 'train')) AS train_share,
               RND(count(*) FILTER (split <> 'train') / (SELECT count(*) FROM b WHERE split <> 'train')) AS test_share FROM b GROUP BY bin""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    out = prof.split_shares(disc.EqualFrequency(10, ["p"]).fit(train).transform(df), "p_bin")
    return out.withColumns({c: rnd(c) for c in ("train_share", "test_share")})


@query(
    "l12_distinct_bins",
    f"""WITH {DECILES}, b AS (SELECT p, {P_BIN} AS bin FROM fx_num, e)
        SELECT count(DISTINCT round(p, 2)) AS n_raw, count(DISTINCT round(ln(p), 1)) AS n_log, count(DISTINCT bin) AS n_bins FROM b""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    return disc.EqualFrequency(10, ["p"]).fit(train).transform(df).agg(
        F.count_distinct(F.round("p", 2)).alias("n_raw"),
        F.count_distinct(F.round(F.ln("p"), 1)).alias("n_log"),
        F.count_distinct("p_bin").alias("n_bins"),
    )


# ---------------------------------------------------------------- scaling


def scaled_sql(centre: str, spread: str) -> str:
    def s(e):
        return scalar(e, "fx_num")

    return "SELECT id, " + ", ".join(
        f"RND(({c} - {s(centre.format(c=c))}) / {s(spread.format(c=c))}) AS {c}" for c in ("q", "p")
    ) + " FROM fx_num"


def scaled(spark, sf, method):
    train, df = parts(spark, sf, "fx_num")
    return scale.Scale(method, ["q", "p"]).fit(train).transform(df).select("id", rnd("q").alias("q"), rnd("p").alias("p"))


@query("m01_standard", scaled_sql("avg({c})", "stddev_pop({c})"))
def _(spark, sf):
    return scaled(spark, sf, "standard")


@query("m02_min_max", scaled_sql("min({c})", "(max({c}) - min({c}))"))
def _(spark, sf):
    return scaled(spark, sf, "minmax")


@query("m02_min_max_inverse", "SELECT id, RND(q) AS q, RND(p) AS p FROM fx_num")
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    fitted = scale.Scale("minmax", ["q", "p"]).fit(train)
    return fitted.inverse(fitted.transform(df)).select("id", rnd("q").alias("q"), rnd("p").alias("p"))


@query("m03_robust", scaled_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def _(spark, sf):
    return scaled(spark, sf, "robust")


@query(
    "m04_scaled_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS n, RND(avg(z)) AS mean, RND(stddev_samp(z)) AS std, RND(min(z)) AS min, RND(max(z)) AS max "
        f"FROM (SELECT ({c} - {scalar(f'avg({c})', 'fx_num')}) / {scalar(f'stddev_pop({c})', 'fx_num')} AS z FROM fx_num) t"
        for c in ("q", "p")
    ),
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_num")
    out = prof.describe(scale.Scale("standard", ["q", "p"]).fit(train).transform(df), ["q", "p"])
    return out.select("variable", "n", *[rnd(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("m05_polynomial", "SELECT id, CAST(1 AS DOUBLE) AS poly_1, q AS poly_q, n AS poly_n, q * q AS poly_q_q, q * n AS poly_q_n, n * n AS poly_n_n FROM fx_num")
def _(spark, sf):
    out = scale.polynomial(fixture(spark, sf, "fx_num").select("id", "q", "n"), ["q", "n"])
    return out.drop("q", "n")


@query("m06_transform_set", "SELECT id, RND(ln(p)) AS p_log, RND(1 / nullif(q, 0)) AS q_inv, RND(pow(n, 0.3)) AS n_pow FROM fx_num")
def _(spark, sf):
    df = fixture(spark, sf, "fx_num")
    for stage in (
        scale.Transform("log", ["p"], suffix="_log"),
        scale.Transform("reciprocal", ["q"], suffix="_inv"),
        scale.Transform("power", ["n"], exponent=0.3, suffix="_pow"),
    ):
        df = stage.fit(df).transform(df)
    return df.select("id", *[rnd(c).alias(c) for c in ("p_log", "q_inv", "n_pow")])


@query("m07_log_positive_only", "SELECT id, RND(ln(p)) AS p, RND(ln(q)) AS q, RND(d) AS d FROM fx_num")
def _(spark, sf):
    df = fixture(spark, sf, "fx_num").select("id", "p", "q", "d")
    out = scale.Transform("log", ["p", "q", "d"], positive_only=True).fit(df).transform(df)
    return out.select("id", *[rnd(c).alias(c) for c in ("p", "q", "d")])


def horner(x, coefs):
    out = repr(coefs[0])
    for k in coefs[1:]:
        out = f"({out} * {x} + CAST({k!r} AS DOUBLE))"
    return out.replace(repr(coefs[0]), f"CAST({coefs[0]!r} AS DOUBLE)", 1)


def tail_sql(q):
    r = f"sqrt(-2 * ln({q}))"
    return f"({horner(r, maths.INV_NORMAL_C)} / {horner(r, (*maths.INV_NORMAL_D, 1.0))})"


def inverse_normal_sql(p):
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    mid = f"(({p} - 0.5) * {horner(r, maths.INV_NORMAL_A)} / {horner(r, (*maths.INV_NORMAL_B, 1.0))})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail_sql(p)} WHEN {p} > 1 - 0.02425 THEN -{tail_sql(f'(1 - {p})')} ELSE {mid} END"


SPOTS = """r AS (SELECT id, x, row_number() OVER (ORDER BY x, id) AS pos, count(*) OVER () AS m FROM fx_miss WHERE x IS NOT NULL),
             s AS (SELECT *, CASE WHEN pos = m THEN pow(0.5, 1.0 / m) WHEN pos = 1 THEN 1 - pow(0.5, 1.0 / m)
                   ELSE (pos - CAST(0.3175 AS DOUBLE)) / (m + CAST(0.365 AS DOUBLE)) END AS u FROM r)"""


@query("m08_qq_table", f"WITH {SPOTS} SELECT id, pos, x AS sample, RND({inverse_normal_sql('u')}) AS theoretical FROM s")
def _(spark, sf):
    out = scale.qq_table(fixture(spark, sf, "fx_miss"), "x", "id")
    return out.withColumn("theoretical", rnd("theoretical")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "m08_qq_fit",
    f"""WITH {SPOTS}, t AS (SELECT x AS sample, {inverse_normal_sql('u')} AS theoretical FROM s)
        SELECT RND2(regr_slope(sample, theoretical)) AS slope, RND2(regr_intercept(sample, theoretical)) AS intercept, RND(corr(sample, theoretical)) AS r FROM t""",
)
def _(spark, sf):
    """The line through the Q-Q points, and how straight they lie."""
    out = scale.qq_fit(scale.qq_table(fixture(spark, sf, "fx_miss"), "x", "id"))
    return out.select(rnd("slope", 2).alias("slope"), rnd("intercept", 2).alias("intercept"), rnd("r").alias("r"))


@query(
    "m09_stage_chain",
    """WITH base AS (SELECT f.id, f.split, f.x, f.c, f.y FROM fx_miss f),
       med AS (SELECT median(x) AS m FROM base WHERE split = 'train'),
       a AS (SELECT id, split, y, CAST(x IS NULL AS INTEGER) AS x_na, coalesce(x, m) AS x, coalesce(c, 'Missing') AS c FROM base, med),
       shares AS (SELECT c, count(*) / (SELECT count(*) FROM a WHERE split = 'train') AS s FROM a WHERE split = 'train' GROUP BY c),
       b AS (SELECT id, split, y, x_na, x, CASE WHEN c IN (SELECT c FROM shares WHERE s >= 0.16) THEN c ELSE 'Rare' END AS c FROM a),
       enc AS (SELECT c, avg(y) AS v FROM b WHERE split = 'train' GROUP BY c),
       cap AS (SELECT quantile_cont(x, 0.25) - 0.2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo,
                      quantile_cont(x, 0.75) + 0.2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi FROM b WHERE split = 'train'),
       d AS (SELECT id, split, x_na, least(greatest(x, lo), hi) AS x, v AS c FROM b LEFT JOIN enc ON b.c = enc.c, cap),
       mm AS (SELECT min(x) AS lo, max(x) AS hi FROM d WHERE split = 'train')
       SELECT id, x_na, RND((x - lo) / (hi - lo)) AS x, RND(c) AS c FROM d, mm""",
)
def _(spark, sf):
    train, df = parts(spark, sf, "fx_miss")
    chain = Chain(
        [
            impute.MissingFlag(["x"]),
            impute.MeanMedian("median", ["x"]),
            impute.MissingLabel(["c"]),
            rare.RareLabels(0.16, 1, ["c"]),
            enc.LabelNumbers("mean", ["c"], "y"),
            outliers.Windsorizer("skewed", "both", 0.2, ["x"]),
            scale.Scale("minmax", ["x"]),
        ]
    )
    return chain.fit(train).transform(df).select("id", "x_na", rnd("x").alias("x"), rnd("c").alias("c"))
