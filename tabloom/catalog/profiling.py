"""Profiling, type rules, targets and domain tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.catalog.common import ORDERS_N, Catalog, orders_with_nulls, rounded, table
from tabloom.operators import context, domains, infer, profile, selection
from tabloom.session import spread

CAT = Catalog()

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def sql_each(columns: list[str], template: str, source: str) -> str:
    """One row per column: the template with {c} replaced, over the source."""
    return "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", {template.format(c=c)} FROM {source}" for c in columns)


CAT.add("p1_shape", lambda spark, d: profile.shape(table(spark, d, "orders")),
        "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders")
CAT.add(
    "p2_null_counts",
    lambda spark, d: profile.null_counts(orders_with_nulls(spark, d)),
    f"WITH {ORDERS_N} " + sql_each(ORDER_COLUMNS, "count(*) - count({c}) AS nulls, count(*) AS n, (count(*) - count({c})) / count(*) AS null_pct", "orders_n"),
)
CAT.add(
    "p3_duplicate_rows",
    lambda spark, d: profile.duplicate_rows(table(spark, d, "documents").select("text", "lang")),
    "SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)",
)
CAT.add(
    "p4_missing_pct",
    lambda spark, d: rounded(profile.missing_cells(orders_with_nulls(spark, d)), 6, "missing_percentage"),
    f"""WITH {ORDERS_N}, s AS (SELECT count(*) AS n, 3 * count(*) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority) AS m FROM orders_n)
SELECT m AS missing_cells, round(m * 100.0 / (n * 6), 6) AS missing_percentage FROM s""",
)
CAT.add(
    "p6_distinct_stats",
    lambda spark, d: profile.distinct_stats(orders_with_nulls(spark, d)),
    f"WITH {ORDERS_N} " + sql_each(
        ORDER_COLUMNS, 'count(DISTINCT {c}) AS "distinct", count(*) AS n, count(DISTINCT {c}) / count(*) AS distinct_pct', "orders_n"
    ),
)


def _wide_text(spark: SparkSession, d: str) -> DataFrame:
    """Columns of every kind the type rules tell apart, from the orders table."""
    o = orders_with_nulls(spark, d)
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        (F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("seen_epoch"),
        (F.col("o_orderkey") * 7 + 3).alias("strided"),
        (F.col("o_orderkey") % 2 == 0).alias("is_even"),
        (F.col("o_orderkey") % 8).cast("int").alias("small_code"),
        F.concat(F.lit("AB"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("ticket"),
        F.lit(None).cast("double").alias("nothing"),
    )


SQL_WIDE = f"""{ORDERS_N}, w AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day_text, CAST(epoch(o_orderdate) AS BIGINT) AS seen_epoch,
 o_orderkey * 7 + 3 AS strided, o_orderkey % 2 = 0 AS is_even, CAST(o_orderkey % 8 AS INTEGER) AS small_code,
 'AB' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS ticket, CAST(NULL AS DOUBLE) AS nothing FROM orders_n)"""
# (column, kind, is whole number, has an id word, has a count word)
WIDE_COLUMNS = [
    ("o_orderkey", "numeric", True, False), ("o_custkey", "numeric", True, False), ("o_orderstatus", "string", False, False),
    ("o_totalprice", "numeric", False, False), ("o_orderdate", "temporal", False, False), ("o_orderpriority", "string", False, False),
    ("day_text", "string", False, False), ("seen_epoch", "numeric", True, False), ("strided", "numeric", True, False),
    ("is_even", "boolean", False, False), ("small_code", "numeric", True, False), ("ticket", "string", False, False),
    ("nothing", "numeric", False, False),
]


def _sql_facts() -> str:
    """The profile facts the rules need, one row per column, written out per kind."""
    parts = []
    for c, kind, whole, _ in WIDE_COLUMNS:
        num = f"CAST({c} AS DOUBLE)" if kind in ("numeric", "boolean") else "CAST(NULL AS DOUBLE)"
        txt = c if kind == "string" else "CAST(NULL AS VARCHAR)"
        steady = (
            f"(count(DISTINCT {c}) = count({c}) AND count({c}) >= 2 AND (max({c}) - min({c})) % (count({c}) - 1) = 0 AND "
            f"(SELECT count(*) FROM w WHERE ({c} - (SELECT min({c}) FROM w)) % "
            f"(SELECT greatest((max({c}) - min({c})) // greatest(count({c}) - 1, 1), 1) FROM w) <> 0) = 0)"
            if whole else "false"
        )
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS kind, {str(whole).lower()} AS whole, count(*) AS n, count({c}) AS present,
 count(DISTINCT {c}) AS d, min({num}) AS lo, max({num}) AS hi, {steady} AS sequential,
 avg(CASE WHEN abs({num}) BETWEEN 1e8 AND 4.1e9 THEN 1.0 WHEN {num} IS NOT NULL THEN 0.0 END) AS epoch_s,
 avg(length({txt})) AS mean_len, avg(len(regexp_extract_all({txt}, '[^ \\t\\n\\r]+'))) AS mean_words,
 avg(CAST(contains({txt}, ' ') AS INTEGER)) AS space_share,
 avg(CAST(regexp_matches({txt}, '[-/:]') AS INTEGER)) AS sep_share, avg(CAST(regexp_matches({txt}, '^[0-9]{{7,}}$') AS INTEGER)) AS dig_share,
 avg(CAST(regexp_matches({txt}, '^[A-Za-z0-9]{{8,}}$|^[A-Z]{{2,3}}[0-9]{{4,}}$') AS INTEGER)) AS idt_share,
 avg(CASE WHEN {txt} IS NOT NULL THEN CAST(try_strptime({txt}, '%Y-%m-%d') IS NOT NULL AS INTEGER) END) AS date_share FROM w""")
    return "facts AS (" + "\nUNION ALL ".join(parts) + ")"


SQL_RULES = """rules AS (SELECT *, coalesce(d / nullif(present, 0), 0) AS u, coalesce(d / nullif(n, 0), 0) AS dp,
 coalesce(kind IN ('numeric', 'boolean') AND d BETWEEN 1 AND 15 AND hi - lo <= greatest(50, d * 4), false) AS small_range FROM facts),
 marks AS (SELECT *,
  present > 0 AND NOT small_range AND u >= 0.98 AND d = present AND (sequential OR (kind = 'string' AND idt_share >= 0.1)) AS is_id,
  CASE WHEN kind = 'string' AND (sep_share >= 0.3 OR dig_share >= 0.3) AND date_share > 0.8 THEN date_share
       WHEN kind = 'temporal' THEN 1.0 WHEN kind = 'numeric' AND epoch_s > 0.8 THEN epoch_s END AS date_conf,
  CASE WHEN kind = 'string' THEN (CASE WHEN u > 0.8 THEN 1 ELSE 0 END) + (CASE WHEN space_share >= 0.02 AND mean_words > 1 THEN 2 ELSE 0 END)
       + (CASE WHEN mean_len > 20 THEN 1 ELSE 0 END) ELSE 0 END AS text_score,
  CASE WHEN kind = 'boolean' THEN true WHEN d <= 2 THEN true WHEN NOT whole THEN false WHEN hi - lo >= 10 AND d >= 4 THEN false
       WHEN u >= 0.2 THEN false WHEN d <= 10 THEN true WHEN u < 0.05 AND d < 50 THEN true WHEN d < 50 THEN true ELSE false END AS cat_num FROM rules),
 typed AS (SELECT *, CASE WHEN present = 0 THEN 'empty' WHEN is_id THEN 'id' WHEN date_conf IS NOT NULL THEN 'datetime'
  WHEN text_score >= 2 THEN 'text' WHEN kind IN ('numeric', 'boolean') THEN CASE WHEN cat_num THEN 'categorical' ELSE 'numerical' END
  WHEN dp < 0.05 THEN 'categorical' ELSE 'text' END AS detected_type,
  CASE WHEN present = 0 THEN 1.0 WHEN is_id THEN 0.9 WHEN date_conf IS NOT NULL THEN date_conf WHEN text_score >= 2 THEN least(0.9, text_score * 0.3)
  WHEN kind IN ('numeric', 'boolean') THEN CASE WHEN cat_num THEN 0.8 ELSE 0.9 END WHEN dp < 0.05 THEN 0.8 ELSE 0.7 END AS confidence FROM marks)"""
SQL_TYPED = f"WITH {SQL_WIDE}, {_sql_facts()}, {SQL_RULES} "


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return infer.typed_profile(_wide_text(spark, d))


CAT.add(
    "p7_detect_id",
    lambda spark, d: _typed(spark, d).select("column", infer.is_id().alias("is_id")),
    SQL_TYPED + 'SELECT "column", is_id FROM typed',
)
CAT.add(
    "p8_is_sequential",
    lambda spark, d: profile.equal_steps(_wide_text(spark, d)),
    SQL_TYPED + 'SELECT "column", sequential FROM typed WHERE whole',
)
CAT.add(
    "p8_gap_stats",
    lambda spark, d: rounded(profile.gap_stats(table(spark, d, "orders"), "o_custkey"), 6, "mean_gap", "std_gap"),
    """SELECT count(g) AS gaps, round(avg(g), 6) AS mean_gap, round(stddev_samp(g), 6) AS std_gap, bool_and(g = 1) AS unit_step
FROM (SELECT CAST(o_custkey AS DOUBLE) - lag(CAST(o_custkey AS DOUBLE)) OVER (ORDER BY o_custkey) AS g FROM orders)""",
)
CAT.add(
    "p9_id_pattern",
    lambda spark, d: rounded(_typed(spark, d).where("kind = 'string'").select("column", "id_text_share"), 6, "id_text_share"),
    SQL_TYPED + """SELECT "column", round(idt_share, 6) AS id_text_share FROM typed WHERE kind = 'string'""",
)
CAT.add(
    "p10_detect_datetime",
    lambda spark, d: _typed(spark, d).select("column", F.round(infer.datetime_confidence(), 6).alias("confidence"), "epoch_unit")
    .where("confidence IS NOT NULL"),
    SQL_TYPED + """SELECT "column", round(date_conf, 6) AS confidence, CASE WHEN kind = 'numeric' THEN 's' END AS epoch_unit
FROM typed WHERE date_conf IS NOT NULL""",
)
CAT.add(
    "p11_detect_text",
    lambda spark, d: _typed(spark, d).select("column", infer.text_score().alias("score"), F.round("mean_len", 6).alias("mean_len"))
    .where("score > 0"),
    SQL_TYPED + 'SELECT "column", CAST(text_score AS BIGINT) AS score, round(mean_len, 6) AS mean_len FROM typed WHERE text_score > 0',
)
CAT.add(
    "p12_categorical_numeric",
    lambda spark, d: _typed(spark, d).where("kind IN ('numeric', 'boolean')").select("column", infer.categorical_numeric().alias("is_code")),
    SQL_TYPED + """SELECT "column", cat_num AS is_code FROM typed WHERE kind IN ('numeric', 'boolean')""",
)
CAT.add(
    "p13_small_int_range",
    lambda spark, d: _typed(spark, d).select("column", F.coalesce(infer.small_int_range(), F.lit(False)).alias("small_range")),
    SQL_TYPED + 'SELECT "column", small_range FROM typed',
)
CAT.add(
    "p14_classify_columns",
    lambda spark, d: _typed(spark, d).select("column", "detected_type", F.round("confidence", 6).alias("confidence")),
    SQL_TYPED + 'SELECT "column", detected_type, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM typed',
)
CAT.add(
    "p15_type_overrides",
    lambda spark, d: infer.typed_profile(
        _wide_text(spark, d), overrides={"small_code": "categorical", "o_orderpriority": "categorical", "ticket": "colour", "absent": "id"}
    ).select("column", "detected_type", F.round("confidence", 6).alias("confidence"), F.array_contains("patterns", "manual_override").alias("forced")),
    SQL_TYPED + """SELECT "column", CASE WHEN "column" IN ('small_code', 'o_orderpriority') THEN 'categorical' ELSE detected_type END AS detected_type,
 CASE WHEN "column" IN ('small_code', 'o_orderpriority') AND detected_type <> 'categorical' THEN 1.0 ELSE round(CAST(confidence AS DOUBLE), 6) END AS confidence,
 "column" IN ('small_code', 'o_orderpriority') AND detected_type <> 'categorical' AS forced FROM typed""",
)
CAT.add(
    "p16_target_candidates",
    lambda spark, d: infer.target_candidates(_typed(spark, d)).select("column"),
    SQL_TYPED + """SELECT "column" FROM typed WHERE detected_type = 'categorical' AND d BETWEEN 2 AND 10""",
)
CAT.add(
    "p19_target_pick",
    lambda spark, d: infer.pick_target(_typed(spark, d)),
    SQL_TYPED + """SELECT "column" FROM typed WHERE detected_type = 'categorical' AND d BETWEEN 2 AND 10
ORDER BY list_position(['o_orderkey', 'o_custkey', 'o_orderstatus'], "column") NULLS LAST LIMIT 1""",
)
CAT.add(
    "p17_recommendations",
    lambda spark, d: infer.recommendations(_typed(spark, d)),
    SQL_TYPED + """SELECT 'preprocessing' AS kind, "column", 'More than a tenth is null in ''' || "column" || ''' (' ||
 printf('%.1f', (n - present) * 100.0 / n) || '% null)' AS message FROM typed WHERE (n - present) / n > 0.1
UNION ALL SELECT 'feature_engineering', '*', 'Free text is present: term weights and word counts can be derived from it'
 WHERE (SELECT count(*) FROM typed WHERE detected_type = 'text') > 0
UNION ALL SELECT 'feature_engineering', '*', 'Dates are present: calendar parts can be derived from them'
 WHERE (SELECT count(*) FROM typed WHERE detected_type = 'datetime') > 0
UNION ALL SELECT 'feature_engineering', '*', 'There are several numbers: products and powers of them may help'
 WHERE (SELECT count(*) FROM typed WHERE detected_type = 'numerical') > 3
UNION ALL SELECT 'warnings', '*', 'Identifiers are present; they carry nothing to learn from'
 WHERE (SELECT count(*) FROM typed WHERE detected_type = 'id') > 0""",
)


def _schema_target(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "orders")
    found = infer.target_from_schemas(train, train.drop("o_orderstatus"))
    return train.groupBy(F.col(found).alias("target_value")).agg(F.count("*").alias("n")).withColumn("target", F.lit(found))


CAT.add("p18_target_from_schema_diff", _schema_target,
        "SELECT o_orderstatus AS target_value, count(*) AS n, 'o_orderstatus' AS target FROM orders GROUP BY 1")


def _feature_columns(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    keep = infer.feature_columns(infer.typed_profile(o), "o_orderstatus")
    return o.select(*keep).drop("o_orderdate")


CAT.add("a0_feature_columns", _feature_columns, "SELECT o_custkey, o_totalprice, o_orderpriority FROM orders")


def _problem(name: str, tab: str, col: str | None = None, expr: Column | None = None, sql_col: str | None = None) -> None:
    y = sql_col or col
    CAT.add(
        name,
        lambda spark, d: rounded(
            infer.problem_type(table(spark, d, tab).select((expr if expr is not None else F.col(col)).alias("y")), "y"), 8, "ratio"
        ),
        f"""WITH s AS (SELECT count(DISTINCT {y}) AS d, count({y}) AS n, bool_and(abs(v - round(v)) <= 1e-8 + 1e-5 * abs(round(v))) AS w
 FROM (SELECT {y}, TRY_CAST({y} AS DOUBLE) AS v FROM {tab})),
 t AS (SELECT *, d / n AS r, coalesce(w, false) AS i FROM s)
SELECT d AS "distinct", n, round(r, 8) AS ratio, i AS integer_like,
 CASE WHEN d <= 20 THEN 'classification' WHEN r < 0.05 AND i THEN 'classification' WHEN r > 0.1 THEN 'regression'
  WHEN NOT i THEN 'regression' ELSE 'classification' END AS problem_type,
 CASE WHEN d <= 20 THEN 'high' WHEN r < 0.05 AND i THEN 'medium' WHEN r > 0.1 THEN 'high' WHEN NOT i THEN 'medium' ELSE 'low' END AS confidence FROM t""",
    )


_problem("p20_problem_type_class", "orders", "o_orderstatus")
_problem("p20_problem_type_codes", "orders", "o_custkey")
_problem("p20_problem_type_amount", "orders", "o_totalprice")
CAT.add(
    "p28_target_stats_class",
    lambda spark, d: rounded(infer.target_shares(table(spark, d, "orders"), "o_orderstatus"), 8, "share"),
    "SELECT o_orderstatus AS value, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM orders), 8) AS share FROM orders GROUP BY 1",
)
CAT.add(
    "p28_target_stats_moments",
    lambda spark, d: rounded(infer.target_moments(table(spark, d, "orders"), "o_totalprice"), 4, "mean", "std"),
    "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders",
)


def _top_nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_counts(orders_with_nulls(spark, d)).where("nulls > 0").orderBy(F.desc("null_pct"), "column").limit(5).select(
        F.lit("missing").alias("kind"), F.col("column").alias("feature"), F.round("null_pct", 8).alias("value")
    )


def _top_variance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return selection.variances(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"], sample=True).orderBy(
        F.desc("variance"), "feature"
    ).limit(5).select(F.lit("variance").alias("kind"), "feature", F.round("variance", 2).alias("value"))


CAT.add(
    "p21_dataset_profile",
    lambda spark, d: _top_nulls(spark, d).unionByName(_top_variance(spark, d)).unionByName(
        infer.target_shares(table(spark, d, "orders"), "o_orderstatus").orderBy(F.desc("share"), "value").limit(10).select(
            F.lit("class").alias("kind"), F.col("value").alias("feature"), F.round("share", 8).alias("value")
        )
    ),
    f"""WITH {ORDERS_N}, nulls AS ({sql_each(ORDER_COLUMNS, "round((count(*) - count({c})) / count(*), 8) AS value", "orders_n")}),
 vars AS ({sql_each(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"], "round(var_samp({c}), 2) AS value", "lineitem")})
(SELECT 'missing' AS kind, "column" AS feature, value FROM nulls WHERE value > 0 ORDER BY value DESC, "column" LIMIT 5)
UNION ALL (SELECT 'variance', "column", value FROM vars ORDER BY value DESC, "column" LIMIT 5)
UNION ALL (SELECT 'class', o_orderstatus, round(count(*) / (SELECT count(*) FROM orders), 8) FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
)
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    top = selection.top_correlations(spark, selection.correlation_matrix(li, LI), LI, 15)
    return top.select("feature_a", "feature_b", F.round("abs_correlation", 6).alias("abs_correlation"))


CAT.add(
    "p27_correlation_pairs", _pairs,
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 6) AS abs_correlation FROM lineitem"
        for i, a in enumerate(LI) for b in LI[i + 1:]
    ),
)


def _target_corr(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    wide = li.agg(*[F.corr(c, "l_extendedprice").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.abs(c), 6).alias("r")) for c in wide.columns])).alias("e")).select("e.*")


CAT.add(
    "p27_target_correlations", _target_corr,
    "\nUNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
)
CAT.add(
    "p27_group_means",
    lambda spark, d: rounded(
        table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_extendedprice").alias("l_extendedprice")),
        4, "l_quantity", "l_extendedprice",
    ),
    "SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1",
)


CONTEXT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_returnflag"]


def _context(spark: SparkSession, d: str) -> DataFrame:
    return context.derived_context(table(spark, d, "lineitem").select(*CONTEXT), "l_extendedprice", top=3).select("kind", "name", "other", F.round("value", 5).alias("value"))


_NUMBERS = [c for c in CONTEXT if c not in ("l_extendedprice", "l_returnflag")]
CAT.add(
    "p27_derived_context", _context,
    f"""WITH vars AS ({sql_each(_NUMBERS, "var_samp({c}) AS value", "lineitem")}), best AS (SELECT "column", value, row_number() OVER (ORDER BY value DESC, "column") AS k FROM vars),
pairs AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :])}),
aim AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, abs(corr({c}, l_extendedprice)) AS r FROM lineitem" for c in _NUMBERS)})
SELECT 'variance' AS kind, "column" AS name, NULL AS other, round(value, 5) AS value FROM best WHERE k <= 4
UNION ALL (SELECT 'pair', p."column", q."column", NULL FROM best p JOIN best q ON p.k < q.k WHERE q.k <= 4 ORDER BY p.k, q.k LIMIT 3)
UNION ALL (SELECT 'correlation', a, b, round(r, 5) FROM pairs ORDER BY r DESC LIMIT 3)
UNION ALL (SELECT 'target_correlation', c, NULL, round(r, 5) FROM aim ORDER BY r DESC LIMIT 3)""",
)
CAT.add(
    "p28_target_stats",
    lambda spark, d: rounded(context.target_stats(table(spark, d, "orders"), "o_totalprice").unionByName(context.target_stats(table(spark, d, "orders"), "o_orderstatus")).select("kind", "name", "value"), 4, "value"),
    """SELECT 'moment' AS kind, unnest(['mean', 'std', 'min', 'max']) AS name, unnest([round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4), round(min(o_totalprice), 4), round(max(o_totalprice), 4)]) AS value FROM orders
UNION ALL SELECT 'share', o_orderstatus, round(count(*) / (SELECT count(*) FROM orders), 4) FROM orders GROUP BY o_orderstatus""",
)


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """A catalog that grows with the data: words of the documents serve as column names of their source."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))))
    docs = spread(table(spark, d, "documents").select("source", "text"))
    return docs.select(F.col("source").alias("table"), words.alias("column")).distinct()


SQL_CATALOG = """cat AS (SELECT DISTINCT source AS "table", unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS "column" FROM documents)"""


def _sql_dictionary(name: str, dictionary: dict[str, list[str]], weight: int) -> str:
    rows = ", ".join(f"('{g}', '{w}', {weight})" for g, ws in dictionary.items() for w in ws)
    return f"{name}(grp, word, weight) AS (VALUES {rows})"


SQL_MATCHES = (
    f"WITH {SQL_CATALOG}, {_sql_dictionary('kw', domains.DOMAIN_KEYWORDS, 2)}, {_sql_dictionary('pt', domains.DOMAIN_PATTERNS, 1)}, "
    """hit AS (SELECT "table", "column", grp AS domain, word, weight FROM cat JOIN (SELECT * FROM kw UNION ALL SELECT * FROM pt) ON contains("column", word)) """
)
CAT.add("p22_domain_keywords", lambda spark, d: domains.domain_scores(_catalog(spark, d)),
        SQL_MATCHES + 'SELECT "table", domain, CAST(sum(weight) AS BIGINT) AS score FROM hit GROUP BY 1, 2')
CAT.add(
    "p23_semantic_groups",
    lambda spark, d: domains.semantic_groups(_catalog(spark, d)),
    f"""WITH {SQL_CATALOG}, {_sql_dictionary('sg', domains.SEMANTIC_GROUPS, 1)}
SELECT DISTINCT "table", "column", grp AS semantic_group FROM cat JOIN sg ON contains("column", word)""",
)


def _typed_catalog(spark: SparkSession, d: str) -> DataFrame:
    size = F.char_length("column")
    return _catalog(spark, d).withColumn("detected_type", F.when(size > 12, "text").when(size == 9, "datetime").otherwise("numerical"))


CAT.add(
    "p24_rank_domains",
    lambda spark, d: domains.rank_domains(_typed_catalog(spark, d)),
    SQL_MATCHES + """, extra AS (SELECT "table", CASE WHEN length("column") > 12 THEN 'text_analysis' ELSE 'time_series' END AS domain,
 CASE WHEN length("column") > 12 THEN 1 ELSE 2 END AS weight FROM cat WHERE length("column") > 12 OR length("column") = 9)
SELECT "table", domain, CAST(sum(weight) AS BIGINT) AS score FROM (SELECT "table", domain, weight FROM hit UNION ALL SELECT * FROM extra)
GROUP BY 1, 2 HAVING sum(weight) > 0""",
)
CAT.add("p25_domain_columns", lambda spark, d: domains.domain_columns(_catalog(spark, d)),
        SQL_MATCHES + 'SELECT DISTINCT "table", domain, "column" FROM hit')


def _sql_advice() -> str:
    parts = []
    for domain, entries in domains.DOMAIN_ADVICE.items():
        for word, message in entries:
            test = "true" if not word else f"\"column\" = '{word[1:]}'" if word.startswith("=") else f"regexp_matches(\"column\", '{word}')"
            parts.append(f"SELECT \"table\", domain, '{message}' AS message FROM hit WHERE domain = '{domain}' AND {test}")
    return " UNION ".join(parts)


CAT.add("p25_domain_advice", lambda spark, d: domains.domain_advice(_catalog(spark, d)), SQL_MATCHES + _sql_advice())
