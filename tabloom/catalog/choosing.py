"""Feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import ORDERS_N, Catalog, orders_with_nulls, rounded, sql_hash, table
from tabloom.operators import folds, selection as ops
from tabloom.plans import selection

CAT = Catalog()

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*NUM, "l_returnflag", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("double_quantity"))


WIDE = [*NUM, "double_quantity"]
SQL_LINE = f"li AS (SELECT {', '.join(NUM)}, l_returnflag, l_quantity * 2 + l_tax AS double_quantity FROM lineitem)"


def _each(template: str, source: str = "li", columns: list[str] | None = None) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, {template.format(c=c)} FROM {source}" for c in (columns or WIDE)
    )


CAT.add(
    "f1_prepare",
    lambda spark, d: ops.prepare(
        orders_with_nulls(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("y")),
        ["o_totalprice", "o_orderpriority"], "y",
    ).select("o_orderkey", "o_totalprice", "o_orderpriority", "y"),
    f"""WITH {ORDERS_N}, m AS (SELECT median(o_totalprice) AS med FROM orders_n),
 mode AS (SELECT o_orderpriority AS v FROM orders_n WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 f AS (SELECT o_orderkey, o_orderstatus, coalesce(o_totalprice, med) AS p, coalesce(o_orderpriority, v) AS c FROM orders_n, m, mode),
 codes AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM f GROUP BY c)
SELECT o_orderkey, p AS o_totalprice, CAST(code AS DOUBLE) AS o_orderpriority, o_orderstatus AS y FROM f JOIN codes USING (c) WHERE o_orderkey % 13 <> 0""",
)
CAT.add(
    "f2_variance_filter",
    lambda spark, d: rounded(ops.variance_filter(_line(spark, d), WIDE, 0.01).select("feature", "variance"), 2, "variance"),
    f"WITH {SQL_LINE} SELECT feature, round(v, 2) AS variance FROM ({_each('var_pop({c}) AS v')}) WHERE v > 0.01",
)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    df = _line(spark, d)
    left = ops.correlation_filter(df, WIDE, 0.95)
    return ops.variances(df, left).select("feature", F.round("variance", 2).alias("variance"))


CAT.add(
    "f3_correlation_filter", _kept,
    f"""WITH {SQL_LINE}, r AS ({' UNION ALL '.join(f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS r FROM li" for i, b in enumerate(WIDE) for a in WIDE[:i])}),
 bad AS (SELECT DISTINCT feature FROM r WHERE r > 0.95)
SELECT feature, round(v, 2) AS variance FROM ({_each('var_pop({c}) AS v')}) WHERE feature NOT IN (SELECT feature FROM bad)""",
)
SQL_CLASS = f"""WITH {SQL_LINE}, cs AS ({_each('l_returnflag AS label, count(*) AS n, sum({c}) AS s, avg({c}) AS m, var_pop({c}) AS w').replace(' FROM li', ' FROM li GROUP BY l_returnflag')}),
 t AS (SELECT feature, sum(s) AS total, sum(n) AS nn, sum(s) / sum(n) AS grand, count(*) AS k FROM cs GROUP BY 1)"""
SQL_CHI2 = "SELECT feature, round(sum((s - n / nn * total) * (s - n / nn * total) / (n / nn * total)), 4) AS score FROM cs JOIN t USING (feature) GROUP BY 1"
CAT.add("f4_score_chi2", lambda spark, d: rounded(ops.score_chi2(_line(spark, d), WIDE, "l_returnflag").select("feature", "score"), 4, "score"),
        f"{SQL_CLASS} {SQL_CHI2}")
CAT.add(
    "f5_score_anova_f",
    lambda spark, d: rounded(ops.score_anova_f(_line(spark, d), WIDE, "l_returnflag").select("feature", "score"), 6, "score"),
    f"""{SQL_CLASS} SELECT feature, round((sum(n * (m - grand) * (m - grand)) / (max(k) - 1)) / (sum(n * w) / (max(nn) - max(k))), 6) AS score
FROM cs JOIN t USING (feature) GROUP BY 1""",
)
REG = [c for c in WIDE if c != "l_extendedprice"]
CAT.add(
    "f6_score_regression_f",
    lambda spark, d: rounded(ops.score_regression_f(_line(spark, d), REG, "l_extendedprice").select("feature", "score"), 3, "score"),
    f"WITH {SQL_LINE}, r AS ({_each('corr({c}, l_extendedprice) AS r, count(*) AS n', columns=REG)}) SELECT feature, round(r * r / (1 - r * r) * (n - 2), 3) AS score FROM r",
)
CAT.add(
    "f7_select_k_best",
    lambda spark, d: ops.select_k_best(ops.score_chi2(_line(spark, d), WIDE, "l_returnflag"), 4).select("feature", "rank"),
    f"{SQL_CLASS}, sc AS ({SQL_CHI2}) SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM sc QUALIFY rank <= 4",
)
CAT.add(
    "f13_score_ranking",
    lambda spark, d: ops.rank_scores(ops.score_anova_f(_line(spark, d), WIDE, "l_returnflag")).select("feature", "rank"),
    f"""{SQL_CLASS}, sc AS (SELECT feature, (sum(n * (m - grand) * (m - grand)) / (max(k) - 1)) / (sum(n * w) / (max(nn) - max(k))) AS score FROM cs JOIN t USING (feature) GROUP BY 1)
SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM sc""",
)


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """Three methods' choices: three highest chi-square, ANOVA F and regression F scores."""
    df = _line(spark, d)
    parts = [
        ("chi2", ops.select_k_best(ops.score_chi2(df, REG, "l_returnflag"), 3)),
        ("anova", ops.select_k_best(ops.score_anova_f(df, REG, "l_returnflag"), 2)),
        ("regression", ops.select_k_best(ops.score_regression_f(df, REG, "l_extendedprice"), 2)),
    ]
    return ops.union_all([p.select(F.lit(m).alias("method"), "feature", "position") for m, p in parts])


SQL_PICKS = f"""{SQL_CLASS}, c1 AS (SELECT 'chi2' AS method, feature, sum((s - n / nn * total) * (s - n / nn * total) / (n / nn * total)) AS score FROM cs JOIN t USING (feature) WHERE feature <> 'l_extendedprice' GROUP BY 2
 QUALIFY row_number() OVER (ORDER BY score DESC, feature) <= 3),
 c2 AS (SELECT 'anova' AS method, feature, (sum(n * (m - grand) * (m - grand)) / (max(k) - 1)) / (sum(n * w) / (max(nn) - max(k))) AS score FROM cs JOIN t USING (feature) WHERE feature <> 'l_extendedprice' GROUP BY 2
 QUALIFY row_number() OVER (ORDER BY score DESC, feature) <= 2),
 rr AS ({_each('corr({c}, l_extendedprice) AS r', columns=REG)}),
 c3 AS (SELECT 'regression' AS method, feature, r * r / (1 - r * r) AS score FROM rr QUALIFY row_number() OVER (ORDER BY score DESC, feature) <= 2),
 picks AS (SELECT method, feature FROM c1 UNION ALL SELECT method, feature FROM c2 UNION ALL SELECT method, feature FROM c3)"""
CAT.add("f10_combine_union", lambda spark, d: ops.combine_union(_picks(spark, d)).select("feature"), SQL_PICKS + " SELECT DISTINCT feature FROM picks")
CAT.add("f11_combine_vote", lambda spark, d: ops.combine_vote(_picks(spark, d), 3).select("feature"),
        SQL_PICKS + " SELECT feature FROM picks GROUP BY 1 HAVING count(DISTINCT method) >= 2")
CAT.add("f11_combine_vote_compat", lambda spark, d: ops.combine_vote(_picks(spark, d), 3, compat=True).select("feature"),
        SQL_PICKS + " SELECT feature FROM picks GROUP BY 1 HAVING count(DISTINCT method) >= 1")
CAT.add("f12_combine_best", lambda spark, d: ops.combine_best(_picks(spark, d)).select("feature"),
        SQL_PICKS + " SELECT feature FROM picks WHERE method = (SELECT method FROM picks GROUP BY 1 ORDER BY count(*) DESC, method LIMIT 1)")


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    df = _line(spark, d)
    left = ops.fallback_select(df, WIDE, 3)
    return ops.variances(df, left, sample=True).select("feature", F.round("variance", 2).alias("variance"))


CAT.add(
    "f16_fallback_select", _fallback,
    f"""WITH {SQL_LINE}, v AS ({_each('var_samp({c}) AS v')}),
 r AS ({' UNION ALL '.join(f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS r FROM li" for i, b in enumerate(WIDE) for a in WIDE[:i])})
SELECT feature, round(v, 2) AS variance FROM v WHERE v >= 0.01 AND feature NOT IN (SELECT feature FROM r WHERE r > 0.95)
ORDER BY {sql_hash('feature')}, feature LIMIT 3""",
)
CONFIG = selection.SelectionConfig(max_features=5)


def _report(spark: SparkSession, d: str) -> DataFrame:
    df = _line(spark, d)
    return selection.select_features(df, WIDE, "l_returnflag", selection.SelectionConfig(max_features=5, enable_model_based=False)).steps


CAT.add(
    "f17_selection_report", _report,
    f"""WITH {SQL_LINE}, v AS (SELECT count(*) FILTER (WHERE v > 0.01) AS a FROM ({_each('var_pop({c}) AS v')})),
 kept AS (SELECT feature FROM ({_each('var_pop({c}) AS v')}) WHERE v > 0.01),
 r AS ({' UNION ALL '.join(f"SELECT '{b}' AS f2, '{a}' AS f1, abs(corr({a}, {b})) AS r FROM li" for i, b in enumerate(WIDE) for a in WIDE[:i])}),
 c AS (SELECT count(DISTINCT f2) AS gone FROM r WHERE r > 0.95 AND f1 IN (SELECT feature FROM kept) AND f2 IN (SELECT feature FROM kept))
SELECT CAST(0 AS BIGINT) AS position, 'variance_filter' AS step, CAST(7 AS BIGINT) AS before, a AS after, 7 - a AS removed FROM v
UNION ALL SELECT 1, 'correlation_filter', a, a - gone, gone FROM v, c
UNION ALL SELECT 2, 'combination', a - gone, least(5, a - gone), a - gone - least(5, a - gone) FROM v, c""",
)


def _model_scores(spark: SparkSession, d: str) -> DataFrame:
    df = _line(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    rows = selection.model_scores(selection.assembled(df, WIDE, "y"), WIDE, "classification")
    return spark.createDataFrame(rows, "feature string, position int, score double")


CAT.add("f8_model_scores", _model_scores)


def _elimination(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.dayofmonth("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("urgency"),
    )
    names = ["o_custkey", "year", "month", "day", "urgency"]
    left = selection.recursive_elimination(folds.kfold(o, "o_orderkey", 3), names, "o_totalprice", "regression", step=1)
    return ops.variances(o, left)


CAT.add("f9_recursive_elimination", _elimination)
CAT.add("f14_importance", lambda spark, d: selection.importance(_line(spark, d), REG, "l_extendedprice", trees=20))
CAT.add("f15_select_by_importance",
        lambda spark, d: ops.select_by_importance(selection.importance(_line(spark, d), REG, "l_extendedprice", trees=20), 0.01, 3))


def _whole_selection(spark: SparkSession, d: str) -> DataFrame:
    result = selection.select_features(_line(spark, d), WIDE, "l_returnflag", CONFIG)
    return ops.variances(_line(spark, d), result.selected)


CAT.add("select_features", _whole_selection)
