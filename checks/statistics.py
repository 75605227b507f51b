"""Correlation, chronological split, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import DAILY_MEASURES, Tables
from checks.registry import check, rounded
from loadcurve.operators import correlation, regression
from loadcurve.session import scratch_path
from loadcurve.sources.sinks import read_back, write_table

MATRIX = " UNION ALL ".join(
    f"""SELECT {i} AS i, {j} AS j, '{a}' AS column_i, '{b}' AS column_j, round(corr({a}, {b}), 6) AS r FROM daily_raw"""
    for i, a in enumerate(DAILY_MEASURES) for j, b in enumerate(DAILY_MEASURES)
)


@check("x02_correlation_matrix", MATRIX)
def _(t: Tables):
    return rounded(correlation.correlation_matrix(t.daily_raw), 6)


RELATED = ["o_totalprice", "l_extendedprice", "l_quantity", "l_discount", "net"]
RELATED_SQL = """, x AS (SELECT o_totalprice, l_extendedprice, l_quantity, l_discount, l_extendedprice * (1 - l_discount) AS net
                         FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """


@check(
    "x03_strong_pairs",
    RELATED_SQL + " UNION ALL ".join(
        f"SELECT '{a}' AS column_i, '{b}' AS column_j, round(corr({a}, {b}), 6) AS r FROM x HAVING abs(corr({a}, {b})) > 0.8"
        for i, a in enumerate(RELATED) for b in RELATED[i + 1:]
    ),
)
def _(t: Tables):
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    related = lines.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).select(*RELATED)
    return rounded(correlation.strong_pairs(correlation.correlation_matrix(related, RELATED)), 6)


X4 = """, x AS (SELECT d.y, w.temperature_2m, w.relative_humidity_2m, w.precipitation, w.wind_speed_10m
            FROM orders_demand d JOIN metadata m ON d.unique_id = m.unique_id
            JOIN daily w ON w.location_id = m.location_id AND w."timestamp" = d."timestamp"
            WHERE d.y IS NOT NULL {ids}) """ + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, round(corr(y, {m}), 6) AS r FROM x" for m in DAILY_MEASURES
)


@check("x04_demand_weather_correlation", X4.format(ids=""))
def _(t: Tables):
    return rounded(
        correlation.demand_weather_correlation(
            t.orders_demand, t.metadata, t.daily, DAILY_MEASURES, n_ids=None, size_bound=t.daily_raw
        ),
        6,
    )


@check(
    "x04_demand_weather_correlation_of_sample",
    X4.format(ids="""AND d.unique_id IN (SELECT unique_id FROM metadata ORDER BY md5('42:' || CAST(unique_id AS VARCHAR)), unique_id LIMIT 50)"""),
)
def _(t: Tables):
    sampled = correlation.demand_weather_correlation(
        t.orders_demand, t.metadata, t.daily, DAILY_MEASURES, n_ids=50, size_bound=t.daily_raw
    )
    return rounded(sampled, 6)


X_FEATURES = ["cluster_size", *DAILY_MEASURES]


@check(
    "x01_skipped_rows",
    "SELECT count(*) AS n_rows, count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in X_FEATURES) + ") AS n_skipped FROM merged",
)
def _(t: Tables):
    return regression.skipped_rows(t.merged, X_FEATURES)


@check(
    "x01_feature_vectors",
    'SELECT "timestamp", ' + ", ".join(X_FEATURES) + ", y AS label FROM merged WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in X_FEATURES),
)
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    rows = regression.assemble(t.merged, X_FEATURES).withColumn("a", vector_to_array("features"))
    return rows.select("timestamp", *(F.col("a")[i].alias(c) for i, c in enumerate(X_FEATURES)), "label")


SPLIT = """, b AS (SELECT epoch_us(min("timestamp")) AS lo, epoch_us(max("timestamp")) AS hi FROM readings),
    p AS (SELECT make_timestamp(CAST(lo + round((hi - lo) * 0.8) AS BIGINT)) AS cut FROM b) """


@check("x05_training_part", SPLIT + """SELECT r.* FROM readings r, p WHERE r."timestamp" < p.cut""")
def _(t: Tables):
    return regression.split_by_time(t.readings)[0]


@check("x05_test_part", SPLIT + """SELECT r.* FROM readings r, p WHERE r."timestamp" >= p.cut""")
def _(t: Tables):
    return regression.split_by_time(t.readings)[1]


@check("f08_before_instant", """SELECT * FROM readings WHERE "timestamp" < TIMESTAMP '2024-01-20 12:00:00'""")
def _(t: Tables):
    return t.readings.filter(F.col("timestamp") < F.lit("2024-01-20 12:00:00").cast("timestamp"))


@check("f08_from_instant", """SELECT * FROM readings WHERE "timestamp" >= TIMESTAMP '2024-01-20 12:00:00'""")
def _(t: Tables):
    return t.readings.filter(F.col("timestamp") >= F.lit("2024-01-20 12:00:00").cast("timestamp"))


# Ordinary least squares of the line price on the quantity, trained on the first 80 % of the time span.
OLS = """, r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    b AS (SELECT epoch_us(min(l_shipdate)) AS lo, epoch_us(max(l_shipdate)) AS hi FROM r),
    p AS (SELECT make_timestamp(CAST(lo + round((hi - lo) * 0.8) AS BIGINT)) AS cut FROM b),
    m AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM r, p WHERE l_shipdate < p.cut),
    s AS (SELECT l_shipdate AS "timestamp", y AS label, slope * x + intercept AS prediction FROM r, p, m WHERE l_shipdate >= p.cut) """


def _lines(t: Tables):
    from loadcurve.functions.times import as_timestamp

    lines = t.raw("lineitem").select(F.col("l_shipdate").alias("timestamp"), "l_quantity", F.col("l_extendedprice").alias("y"))
    return regression.split_by_time(regression.assemble(as_timestamp(lines), ["l_quantity"]))


@check(
    "x06_linear_regression",
    OLS + 'SELECT l_shipdate AS "timestamp", y AS label, round(slope * x + intercept, 3) AS fitted FROM r, p, m WHERE l_shipdate < p.cut',
)
def _(t: Tables):
    train, _ = _lines(t)
    fitted = regression.score(regression.fit_linear(train), train, "fitted")
    return rounded(fitted.select("timestamp", "label", "fitted"), 3, "fitted")


@check("x08_scored_test_rows", OLS + 'SELECT "timestamp", label, round(prediction, 3) AS prediction FROM s')
def _(t: Tables):
    train, test = _lines(t)
    scored = regression.score(regression.fit_linear(train), test)
    return rounded(scored.select("timestamp", "label", "prediction"), 3, "prediction")


@check("x11_saved_model_scores_alike", OLS + 'SELECT "timestamp", label, round(prediction, 3) AS prediction FROM s')
def _(t: Tables):
    train, test = _lines(t)
    path = scratch_path(t.spark, "model")
    regression.save_model(regression.fit_linear(train), path)
    scored = regression.score(regression.load_linear(path), test)
    return rounded(scored.select("timestamp", "label", "prediction"), 3, "prediction")


@check(
    "x09_error_metrics",
    """SELECT 'flat' AS prediction, count(*) AS n, round(sqrt(avg(power(30000.0 - l_extendedprice, 2))), 3) AS rmse,
              round(avg(abs(30000.0 - l_extendedprice)), 3) AS mae FROM lineitem
       UNION ALL
       SELECT 'by_quantity', count(*), round(sqrt(avg(power(1500.0 * l_quantity - l_extendedprice, 2))), 3),
              round(avg(abs(1500.0 * l_quantity - l_extendedprice)), 3) FROM lineitem""",
)
def _(t: Tables):
    scored = t.raw("lineitem").select(
        F.col("l_extendedprice").alias("label"), F.lit(30000.0).alias("flat"), (1500.0 * F.col("l_quantity")).alias("by_quantity")
    )
    return rounded(regression.evaluate(scored, ["flat", "by_quantity"]), 3)


# One tree of depth one on a 0/1 feature predicts the class means of the training part.
STUMP = """, r AS (SELECT l_shipdate, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS x, l_extendedprice AS y FROM lineitem),
    b AS (SELECT epoch_us(min(l_shipdate)) AS lo, epoch_us(max(l_shipdate)) AS hi FROM r),
    p AS (SELECT make_timestamp(CAST(lo + round((hi - lo) * 0.8) AS BIGINT)) AS cut FROM b),
    m AS (SELECT x, avg(y) AS prediction FROM r, p WHERE l_shipdate < p.cut GROUP BY x),
    s AS (SELECT r.x, r.y, m.prediction FROM r JOIN m ON r.x = m.x, p WHERE l_shipdate >= p.cut) """


def binary_lines(t: Tables):
    from loadcurve.functions.times import as_timestamp

    x = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)
    lines = t.raw("lineitem").select(F.col("l_shipdate").alias("timestamp"), x.alias("x"), F.col("l_extendedprice").alias("y"))
    return as_timestamp(lines)


@check("x07_boosted_stump", STUMP + "SELECT CAST(x AS DOUBLE) AS x, count(*) AS n, round(avg(prediction), 3) AS prediction FROM s GROUP BY x")
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    train, test = regression.split_by_time(regression.assemble(binary_lines(t), ["x"]))
    scored = regression.score(regression.fit_boosted_trees(train, max_iter=1, max_depth=1), test)
    by_class = scored.groupBy(vector_to_array("features")[0].alias("x"))
    return rounded(by_class.agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction")), 3, "prediction")


def _stored_training_rows(t: Tables):
    # tree training passes over its rows many times, so they are read from storage
    path = scratch_path(t.spark, "training")
    write_table(t.merged.dropna(subset=["y"]), path, inputs=[t.dir])
    return regression.split_by_time(regression.assemble(read_back(t.spark, path), X_FEATURES))


def _errors_hold(rows: list[dict], t: Tables) -> bool:
    """Every complete test row is measured, and no error is far beyond the spread of the labels."""
    test = regression.split_by_time(regression.assemble(t.merged.dropna(subset=["y"]), X_FEATURES))[1]
    n, spread = test.agg(F.count(F.lit(1)), F.coalesce(F.stddev_pop("label"), F.lit(0.0))).first()
    return len(rows) == 1 and all(r["n"] == n and 0 <= r["mae"] <= r["rmse"] <= 1.5 * spread for r in rows)


@check("x07_boosted_trees", holds=_errors_hold)
def _(t: Tables):
    train, test = _stored_training_rows(t)
    return rounded(regression.evaluate(regression.score(regression.fit_boosted_trees(train), test)), 4)


@check(
    "x07_step_target",
    "SELECT CAST(l_linenumber AS DOUBLE) AS x, count(*) AS n, true AS learned FROM lineitem GROUP BY 1",
)
def _(t: Tables):
    """Twenty trees of depth five learn a step of the line number exactly."""
    from pyspark.ml.functions import vector_to_array

    rows = regression.assemble(_step_lines(t), ["x", "noise"])
    scored = regression.score(regression.fit_boosted_trees(rows), rows)
    x = vector_to_array("features")[0].alias("x")
    return scored.groupBy(x).agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("prediction") - F.col("label"))) < 1e-6).alias("learned")
    )


def _step_lines(t: Tables):
    """The target is a step of x alone; noise has one value."""
    x = F.col("l_linenumber").cast("double")
    return t.raw("lineitem").select(
        F.col("l_shipdate").alias("timestamp"), x.alias("x"), F.lit(1.0).alias("noise"),
        F.when(x > 3, 100.0).otherwise(-100.0).alias("y"),
    )


@check(
    "x10_importance_of_step_target",
    "SELECT 'x' AS feature, CAST(1 AS DOUBLE) AS importance UNION ALL SELECT 'noise', CAST(0 AS DOUBLE)",
)
def _(t: Tables):
    rows = regression.assemble(_step_lines(t), ["x", "noise"])
    return rounded(regression.feature_importance(regression.fit_boosted_trees(rows), ["x", "noise"], rows), 6)


@check(
    "x11_saved_trees_score_alike",
    STUMP + """SELECT "timestamp", label, true AS alike FROM
               (SELECT l_shipdate AS "timestamp", y AS label FROM r, p WHERE l_shipdate >= p.cut)""",
)
def _(t: Tables):
    train, test = regression.split_by_time(regression.assemble(binary_lines(t), ["x"]))
    model, path = regression.fit_boosted_trees(train), scratch_path(t.spark, "model")
    regression.save_model(model, path)
    both = regression.score(regression.load_boosted_trees(path), regression.score(model, test, "kept"), "loaded")
    return both.select("timestamp", "label", (F.col("kept") == F.col("loaded")).alias("alike"))


def _importances_hold(rows: list[dict], t: Tables) -> bool:
    shares = [r["importance"] for r in rows]
    return (
        {r["feature"] for r in rows} == set(X_FEATURES)
        and abs(sum(shares) - 1) < 1e-4 and min(shares) >= 0 and shares == sorted(shares, reverse=True)
    )


@check("x10_feature_importance", holds=_importances_hold)
def _(t: Tables):
    train, _ = _stored_training_rows(t)
    return rounded(regression.feature_importance(regression.fit_boosted_trees(train), X_FEATURES, train), 6)
