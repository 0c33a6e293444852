"""Numeric, categorical, text, date and derived features, assembly and target transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.catalog.common import ORDERS_N, Catalog, orders_with_nulls, rounded, scratch, sql_hash, table
from tabloom.functions import derived, numeric, temporal, text
from tabloom.functions.hashing import bucket
from tabloom.operators import target, tfidf, vocab
from tabloom.operators.quantiles import exact_medians, exact_quantiles
from tabloom.plans import engine
from tabloom.session import spread

CAT = Catalog()

def _numeric_params(df: DataFrame, column: str, n_bins: int = 5) -> numeric.NumericParams:
    x = numeric.to_numeric(F.col(column))
    s = df.agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.count_distinct(x).alias("d"), F.count_if(F.col(column).isNull()).alias("nulls"),
    ).first()
    edges = numeric.usable_edges(numeric.equal_width_edges(s["lo"], s["hi"], s["d"], n_bins))
    return numeric.NumericParams(column, exact_medians(df, {column: x})[column], s["mean"], s["std"], s["lo"], s["hi"], s["lo"] > 0, s["nulls"] > 0, edges)


def _price_feature(name: str, config: numeric.NumericConfig, digits: int | None, sql: str) -> None:
    """One feature of orders.o_totalprice with nulls filled by the median."""
    def query(spark: SparkSession, d: str) -> DataFrame:
        o = orders_with_nulls(spark, d)
        made = numeric.numeric_features(_numeric_params(o, "o_totalprice"), config)
        feature = name.split(":")[1]
        out = o.select("o_orderkey", made[f"o_totalprice_{feature}"].alias("value"))
        return rounded(out, digits, "value") if digits is not None else out

    CAT.add(
        name.split(":")[0], query,
        f"""WITH {ORDERS_N}, s AS (SELECT median(o_totalprice) AS med, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std,
 min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders_n),
 f AS (SELECT o_orderkey, o_totalprice AS raw, coalesce(o_totalprice, med) AS x, s.* FROM orders_n, s)
SELECT o_orderkey, {sql} AS value FROM f""",
    )


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).alias("code"))


CAT.add(
    "n1_to_numeric",
    lambda spark, d: _mixed(spark, d).select("o_orderkey", numeric.to_numeric(F.col("code")).alias("value")),
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS value FROM orders""",
)
_price_feature("n2_impute_median:original", numeric.NumericConfig(enable_scaling=False), None, "x")
_price_feature("n3_scale_standard:scaled", numeric.NumericConfig(), 6, "round((x - mean) / std, 6)")
_price_feature("n4_passthrough:original", numeric.NumericConfig(enable_scaling=False, enable_binning=False), None, "x")
_price_feature(
    "n7_bin_apply:bin", numeric.NumericConfig(), None,
    "CAST(" + " + ".join(f"CASE WHEN x > lo + {i} * (hi - lo) / 5 THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS BIGINT)",
)
_price_feature("n8_log1p:log", numeric.NumericConfig(), 6, "round(ln(1 + x), 6)")
_price_feature("n9_squared:squared", numeric.NumericConfig(enable_polynomial=True), None, "x * x")
_price_feature("n11_above_median:above_median", numeric.NumericConfig(), None, "CAST(x > med AS BIGINT)")
_price_feature("n12_was_missing:was_missing", numeric.NumericConfig(), None, "CAST(raw IS NULL AS BIGINT)")
CAT.add(
    "n10_cubed",
    lambda spark, d: table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        numeric.numeric_features(
            numeric.NumericParams("l_quantity", 25.0, 25.0, 1.0, 1.0, 50.0, True, False), numeric.NumericConfig(enable_polynomial=True, polynomial_degree=3)
        )["l_quantity_cubed"].alias("value"),
    ),
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_quantity * l_quantity * l_quantity AS value FROM lineitem",
)
BINNED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    facts = li.agg(*[e for c in BINNED for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count_distinct(c).alias(f"d_{c}"))]).first()
    rows = [
        (c, i, float(e)) for c in BINNED
        for i, e in enumerate(numeric.equal_width_edges(facts[f"lo_{c}"], facts[f"hi_{c}"], facts[f"d_{c}"], 5))
    ]
    return rounded(spark.createDataFrame(rows, "column string, idx bigint, edge double"), 6, "edge")


CAT.add(
    "n5_bin_equal_width_fit", _edges,
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", i AS idx, round(lo + i * (hi - lo) / k - CASE WHEN i = 0 THEN 0.001 * (hi - lo) ELSE 0 END, 6) AS edge
FROM (SELECT min({c}) AS lo, max({c}) AS hi, least(5, greatest(2, count(DISTINCT {c}))) AS k FROM lineitem), range(0, 6) t(i) WHERE i <= k"""
        for c in BINNED
    ),
)


def _quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    found = exact_quantiles(li, {c: F.col(c) for c in BINNED}, [i / 5 for i in range(6)])
    rows = [(c, i, float(e)) for c in BINNED for i, e in enumerate(numeric.quantile_edges([round(q, 9) for q in found[c]]))]
    return rounded(spark.createDataFrame(rows, "column string, idx bigint, edge double"), 6, "edge")


CAT.add(
    "n6_bin_quantile_fit", _quantile_edges,
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY e) - 1 AS idx, round(e, 6) AS edge FROM (SELECT DISTINCT round(unnest(quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])), 9) AS e FROM lineitem)"""
        for c in BINNED
    ),
)

# -- categorical --------------------------------------------------------------------------------------

CATS = ["p_brand", "p_type", "p_name"]
SQL_VC = "vc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt FROM part WHERE {c} IS NOT NULL GROUP BY 2" for c in CATS) + ")"
CAT.add("c1_value_counts", lambda spark, d: vocab.value_counts(table(spark, d, "part"), CATS), f"WITH {SQL_VC} SELECT * FROM vc")
CAT.add(
    "c2_top_k_other",
    lambda spark, d: vocab.top_categories(vocab.value_counts(table(spark, d, "part"), CATS), 20),
    f"""WITH {SQL_VC}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rn, count(*) OVER (PARTITION BY "column") AS size FROM vc)
SELECT "column", value, cnt FROM r WHERE size <= 20 OR rn < 20
UNION ALL SELECT "column", 'OTHER', CAST(sum(cnt) AS BIGINT) FROM r WHERE size > 20 AND rn >= 20 GROUP BY 1""",
)
CAT.add(
    "c3_label_encode",
    lambda spark, d: vocab.label_codes(vocab.value_counts(table(spark, d, "part"), CATS)).select("column", "value", "code"),
    f"""WITH {SQL_VC} SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM vc""",
)
CAT.add(
    "c3_label_encode_range_split",
    lambda spark, d: vocab.label_codes(vocab.value_counts(table(spark, d, "customer"), ["c_name"]), bound=100, chunks=8).select("value", "code"),
    "SELECT c_name AS value, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer",
)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on priorities without '5-LOW', applied to all orders: unknown values and nulls appear."""
    o = orders_with_nulls(spark, d).select("o_orderkey", "o_orderpriority")
    fit_rows = o.where(F.coalesce(F.col("o_orderpriority") != "5-LOW", F.lit(True)))
    model = engine.FeatureEngine(
        engine.EngineConfig(keep=("o_orderkey",), type_hints={"o_orderpriority": "categorical"})
    ).fit(fit_rows)
    return model.transform(o)


SQL_ENC = f"""WITH {ORDERS_N}, v AS (SELECT o_orderpriority AS value, count(*) AS cnt, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
 FROM orders_n WHERE o_orderpriority <> '5-LOW' GROUP BY 1), n AS (SELECT count(*) AS size FROM v),
 j AS (SELECT o_orderkey, o_orderpriority, cnt, code, size FROM n, orders_n LEFT JOIN v ON o_orderpriority = value) """
CAT.add(
    "c4_unseen_category",
    lambda spark, d: _encoded(spark, d).select("o_orderkey", "o_orderpriority_encoded"),
    SQL_ENC + "SELECT o_orderkey, CAST(CASE WHEN o_orderpriority IS NULL THEN size + 1 ELSE coalesce(code, size) END AS DOUBLE) AS o_orderpriority_encoded FROM j",
)
CAT.add(
    "c4_unseen_report",
    lambda spark, d: vocab.unseen_values(
        orders_with_nulls(spark, d), vocab.value_counts(orders_with_nulls(spark, d).where("o_orderpriority <> '5-LOW'"), ["o_orderpriority"]), ["o_orderpriority"]
    ),
    f"""WITH {ORDERS_N} SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS cnt FROM orders_n WHERE o_orderpriority = '5-LOW' GROUP BY 2""",
)
CAT.add("c5_frequency", lambda spark, d: _encoded(spark, d).select("o_orderkey", "o_orderpriority_frequency"),
        SQL_ENC + "SELECT o_orderkey, CAST(coalesce(cnt, 0) AS DOUBLE) AS o_orderpriority_frequency FROM j")
CAT.add("c6_is_rare", lambda spark, d: _encoded(spark, d).select("o_orderkey", "o_orderpriority_is_rare"),
        SQL_ENC + "SELECT o_orderkey, CAST(coalesce(cnt, 0) < 2 AS DOUBLE) AS o_orderpriority_is_rare FROM j")
CAT.add("c7_was_missing", lambda spark, d: _encoded(spark, d).select("o_orderkey", "o_orderpriority_was_missing"),
        SQL_ENC + "SELECT o_orderkey, CAST(o_orderpriority IS NULL AS DOUBLE) AS o_orderpriority_was_missing FROM j")


def _shuffled_join(spark: SparkSession, d: str) -> DataFrame:
    """The same codes through the shuffle join, as for a vocabulary too large to broadcast."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    words = vocab.label_codes(vocab.value_counts(li, ["l_partkey"]))
    return vocab.join_vocabulary(li, words, "l_partkey", F.col("l_partkey").cast("string"), ["code", "cnt"], "v_", 1, broadcast_bytes=0).groupBy(
        "l_returnflag"
    ).agg(F.sum("v_code").alias("codes"), F.sum("v_cnt").alias("counts"), F.count("*").alias("n"))


CAT.add(
    "c5_frequency_shuffle_join", _shuffled_join,
    """WITH v AS (SELECT l_partkey, count(*) AS cnt, row_number() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS code FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(sum(code) AS BIGINT) AS codes, CAST(sum(cnt) AS BIGINT) AS counts, count(*) AS n FROM lineitem JOIN v USING (l_partkey) GROUP BY 1""",
)
CAT.add(
    "c8_onehot",
    lambda spark, d: engine.FeatureEngine(
        engine.EngineConfig(keep=("p_partkey",), type_hints={"p_type": "categorical"}, categorical=vocab.CategoricalConfig(encoding_method="onehot"))
    ).fit(table(spark, d, "part").select("p_partkey", "p_type")).transform(table(spark, d, "part").select("p_partkey", "p_type"))
    .select("p_partkey", *[f"p_type_is_{i}" for i in range(6)]),
    "WITH v AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS l FROM part) SELECT p_partkey, "
    + ", ".join(f"CAST(p_type = l[{i + 1}] AS DOUBLE) AS p_type_is_{i}" for i in range(6)) + " FROM part, v",
)
CAT.add(
    "c8_target_encoding",
    lambda spark, d: rounded(
        vocab.target_encoding(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", bucket("o_orderkey", 5)), 4, "encoded"
    ),
    f"""WITH f AS (SELECT o_orderpriority AS value, {sql_hash('o_orderkey')} % 5 AS fold, o_totalprice AS y FROM orders),
 g AS (SELECT value, fold, sum(y) AS s, count(y) AS n FROM f GROUP BY 1, 2)
SELECT value, fold, round((sum(s) OVER (PARTITION BY value) - s) / (sum(n) OVER (PARTITION BY value) - n), 4) AS encoded FROM g""",
)

# -- text -----------------------------------------------------------------------------------------------


def _text(name: str, make: Callable[[Column], Column], sql: str, digits: int | None = None, tab: str = "documents", key: str = "doc_id", col: str = "text") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = table(spark, d, tab).select(key, make(F.col(col)).alias("value"))
        return rounded(out, digits, "value") if digits is not None else out

    CAT.add(name, query, f"SELECT {key}, {sql} AS value FROM {tab}")


_text("t1_length", text.char_length, "length(text)")
_text("t2_word_count", text.word_count, r"CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT)")
_text("t3_uppercase_ratio", text.uppercase_ratio, "round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1), 8)", 8)
_text("t4_digit_count", text.digit_count, "CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT)")
_text("t5_special_char_count", text.special_char_count, r"CAST(len(regexp_extract_all(text, '[^a-zA-Z0-9 \t\n\x0B\f\r]')) AS BIGINT)")
_text("t6_has_email", text.has_email, "CAST(regexp_matches(text, '" + text.EMAIL + "') AS BIGINT)")
_text("t7_has_url", text.has_url, "CAST(regexp_matches(url, '" + text.URL + "') AS BIGINT)", tab="pages", key="page_id", col="url")
_text("t7_has_url_html", text.has_url, "CAST(regexp_matches(html, '" + text.URL + "') AS BIGINT)", tab="pages", key="page_id", col="html")
_text("t8_has_phone", text.has_phone, "CAST(regexp_matches(text, '" + text.PHONE + "') AS BIGINT)")
_text("t9_has_title", lambda name: text.has_title(F.concat(F.when(F.col("c_custkey") % 4 == 0, "Dr. ").otherwise(""), name)),
      "CAST(regexp_matches(CASE WHEN c_custkey % 4 = 0 THEN 'Dr. ' ELSE '' END || c_name, '" + text.TITLE + "') AS BIGINT)",
      tab="customer", key="c_custkey", col="c_name")
CAT.add(
    "t11_was_missing",
    lambda spark, d: table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 9 != 0, F.col("text"))).select(
        "doc_id", text.text_features(text.TextParams("text", True), text.TextConfig())["text_was_missing"].alias("value")
    ),
    "SELECT doc_id, CAST(doc_id % 9 = 0 AS BIGINT) AS value FROM documents",
)
STOP = ("the", "and", "of", "to", "in", "is", "it", "that", "was", "for", "on", "as", "with", "by", "at", "le", "la", "les", "der", "die", "das")
TFIDF = text.TextConfig(enable_tfidf=True, max_tfidf_features=50, stop_words=STOP)
SQL_TERMS = r"""w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: NOT list_contains([%s], x)) AS words FROM documents),
 t AS (SELECT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM w),
 dt AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY 1, 2),
 g AS (SELECT term, sum(c) AS tf, count(*) AS df FROM dt GROUP BY 1),
 top AS (SELECT term, tf, df FROM g ORDER BY tf DESC, term LIMIT 50),
 v AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx, CAST(tf AS BIGINT) AS tf, df,
  ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM top)""" % ", ".join(f"'{s}'" for s in STOP)
CAT.add(
    "t10_tfidf_terms",
    lambda spark, d: rounded(tfidf.fit_terms(table(spark, d, "documents"), "text", TFIDF).drop("column"), 6, "idf"),
    f"WITH {SQL_TERMS} SELECT term, idx, tf, df, round(idf, 6) AS idf FROM v",
)


def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = [(r["term"], r["idf"]) for r in tfidf.fit_terms(docs, "text", TFIDF).orderBy("idx").collect()]
    from pyspark.ml.functions import vector_to_array

    vectors = tfidf.tfidf_vectors(spread(docs), "text", words, TFIDF, "v").select("doc_id", vector_to_array("v").alias("v"))
    # the outer form keeps the optimizer from testing the vector's size first, which would build every vector twice
    return vectors.select("doc_id", F.posexplode_outer("v").alias("idx", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 6))


CAT.add(
    "t10_tfidf", _tfidf,
    f"""WITH {SQL_TERMS}, x AS (SELECT doc_id, idx, c * idf AS wt FROM dt JOIN v USING (term))
SELECT doc_id, idx, round(wt / sqrt(sum(wt * wt) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
)

# -- dates ----------------------------------------------------------------------------------------------

def _dates(name: str, make: Callable[[Column], dict[str, Column]], sql: str, digits: int | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        made = make(F.col("ts").cast("timestamp"))
        out = table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in made.items()])
        return rounded(out, digits, *made) if digits is not None else out

    CAT.add(name, query, f"SELECT event_id, {sql} FROM events")


CAT.add(
    "d1_parse",
    lambda spark, d: table(spark, d, "orders").select(
        "o_orderkey",
        F.unix_seconds(temporal.parse_text(
            F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("not a date")
        )).alias("seconds"),
    ),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS seconds FROM orders",
)
CAT.add(
    "d1_parse_epoch",
    lambda spark, d: table(spark, d, "orders").select(
        "o_orderkey", F.year(temporal.parse(F.unix_millis(F.col("o_orderdate").cast("timestamp")), "epoch", "ms")).alias("year")
    ),
    "SELECT o_orderkey, year(o_orderdate) AS year FROM orders",
)
_dates("d2_components", temporal.components,
       "year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS dayofweek, "
       "dayofyear(ts) AS dayofyear, quarter(ts) AS quarter")
_dates("d3_cyclical", temporal.cyclical, ", ".join(
    f"round({fn}(2 * pi() * {part} / {k}), 6) AS {name}_{fn}"
    for name, part, k in (("month", "month(ts)", 12), ("dow", "(isodow(ts) - 1)", 7), ("hour", "hour(ts)", 24)) for fn in ("sin", "cos")
), 6)
_dates("d4_is_weekend", lambda ts: {"is_weekend": temporal.boundaries(ts)["is_weekend"]}, "CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend")
CAT.add(
    "d5_boundaries",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", *[
        v.alias(k) for k, v in temporal.boundaries(F.col("o_orderdate").cast("timestamp")).items() if k != "is_weekend"
    ]),
    """SELECT o_orderkey, CAST(day(o_orderdate) = 1 AS BIGINT) AS is_month_start, CAST(CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS BIGINT) AS is_month_end,
 CAST(CAST(o_orderdate AS DATE) = date_trunc('quarter', o_orderdate) AS BIGINT) AS is_quarter_start, CAST(dayofyear(o_orderdate) = 1 AS BIGINT) AS is_year_start FROM orders""",
)


def _days_since(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    low = ev.agg(F.min(F.col("ts").cast("timestamp"))).first()[0]
    made = temporal.datetime_features(temporal.TemporalParams("ts", "timestamp", None, low, False), temporal.DateTimeConfig())
    return ev.select("event_id", made["ts_days_since_min"].alias("days"))


CAT.add("d6_days_since_min", _days_since,
        "SELECT event_id, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000) AS BIGINT) AS days FROM events")
CAT.add(
    "d7_was_missing",
    lambda spark, d: orders_with_nulls(spark, d).select(
        "o_orderkey",
        temporal.datetime_features(temporal.TemporalParams("o_orderdate", "timestamp", None, None, True), temporal.DateTimeConfig())["o_orderdate_was_missing"].alias("value"),
    ),
    f"WITH {ORDERS_N} SELECT o_orderkey, CAST(o_orderdate IS NULL AS BIGINT) AS value FROM orders_n",
)

# -- derived --------------------------------------------------------------------------------------------

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SQL_LINE = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


def _line(name: str, spec: dict, sql: str, digits: int | None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = table(spark, d, "lineitem").select(*LINE, derived.spec_column(derived.feature_spec({"name": "value", **spec})).alias("value"))
        return rounded(out, digits, "value") if digits is not None else out

    CAT.add(name, query, f"SELECT {SQL_LINE}, {sql} AS value FROM lineitem")


def _interaction(spark: SparkSession, d: str) -> DataFrame:
    o = orders_with_nulls(spark, d)
    fills = exact_medians(o, {"a": F.col("o_totalprice"), "b": F.col("o_custkey")})
    return o.select("o_orderkey", derived.interaction(F.col("o_totalprice"), F.col("o_custkey").cast("double"), fills["a"], fills["b"]).alias("value"))


CAT.add("x1_interaction", _interaction, f"""WITH {ORDERS_N}, m AS (SELECT median(o_totalprice) AS a FROM orders_n)
SELECT o_orderkey, coalesce(o_totalprice, a) * o_custkey AS value FROM orders_n, m""")
_line("x2_ratio", {"operation": "ratio", "inputs": ["l_extendedprice", "l_discount"]},
      "l_extendedprice / CASE WHEN l_discount = 0 THEN 1e-6 ELSE l_discount END", None)
_line("x3_difference", {"operation": "difference", "inputs": ["l_discount", "l_tax"]},
      "l_discount - l_tax", None)
_line("x4_product", {"operation": "product", "inputs": ["l_quantity", "l_extendedprice", "l_tax"]},
      "l_quantity * l_extendedprice * l_tax", None)
_line("x5_sum", {"operation": "sum", "inputs": ["l_quantity", "l_discount", "l_tax"]},
      "l_quantity + l_discount + l_tax", None)
_line("x6_log", {"operation": "log", "inputs": ["l_tax"]},
      "round(ln(abs(CASE WHEN l_tax = 0 THEN 1e-6 ELSE l_tax END)), 6)", 6)
_line("x7_binary_threshold",
      {"operation": "binary_threshold", "inputs": ["l_quantity"], "parameters": {"threshold": 25}},
      "CAST(l_quantity > 25 AS BIGINT)", None)
SPECS = [
    {"name": "unit price", "operation": "ratio", "inputs": ["l_extendedprice", "l_quantity"]},
    {"name": "unit price", "operation": "difference", "inputs": ["l_extendedprice", "l_quantity"]},
    {"name": "broken", "operation": "ratio", "inputs": ["l_extendedprice"]},
    {"name": "absent", "operation": "log", "inputs": ["nowhere"]},
]


def _apply_specs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(*LINE, "l_extendedprice", "l_quantity")
    early, late = li.where("l_linenumber <= 4"), li.where("l_linenumber > 4")
    train, test, summary = derived.apply_specs(early, late, SPECS)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select(*LINE, "part", "unit_price", "unit_price_2").withColumn(
        "failed", F.lit(len(summary["failed_features"]))
    )


CAT.add("x10_apply_specs", _apply_specs,
        f"""SELECT {SQL_LINE}, CASE WHEN l_linenumber <= 4 THEN 'train' ELSE 'test' END AS part, l_extendedprice / l_quantity AS unit_price,
 l_extendedprice - l_quantity AS unit_price_2, CAST(2 AS BIGINT) AS failed FROM lineitem""")


def _spec_use(spark: SparkSession, d: str) -> DataFrame:
    """X8 and X9: which formulas are valid, under which names, with the rows their inputs cover."""
    li = table(spark, d, "lineitem")
    plan = derived.plan_specs(SPECS, set(li.columns), set())
    wide = li.agg(*[F.count(c).alias(n) for n, c in plan.columns.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("present")) for n in plan.columns])).alias("e")).select("e.*")


CAT.add("x8_feature_spec", _spec_use, "SELECT unnest(['unit_price', 'unit_price_2']) AS feature, count(*) AS present FROM lineitem")



def _unique_names(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(*LINE, "l_quantity", "l_tax")
    same = [{"name": "l_tax", "operation": "sum", "inputs": ["l_quantity", "l_tax"]}] * 2
    return derived.apply_specs(li, li, same)[0].drop("l_quantity")


CAT.add("x9_unique_name", _unique_names,
        f"SELECT {SQL_LINE}, l_tax, l_quantity + l_tax AS l_tax_2, l_quantity + l_tax AS l_tax_3 FROM lineitem")

# -- engine and assembly --------------------------------------------------------------------------------


def _orders_model(spark: SparkSession, d: str) -> tuple[DataFrame, engine.FeatureModel]:
    o = orders_with_nulls(spark, d)
    config = engine.EngineConfig(
        keep=("o_orderkey",), type_hints={"o_orderpriority": "categorical"}, interactions=(("o_totalprice", "o_custkey"),),
        specs=({"name": "per_customer", "operation": "ratio", "inputs": ["o_totalprice", "o_custkey"]},),
    )
    return o, engine.FeatureEngine(config, target="o_orderstatus").fit(o)


SQL_MODEL = f"""WITH {ORDERS_N}, s AS (SELECT median(o_totalprice) AS med, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std,
 min(epoch_us(o_orderdate)) AS t0 FROM orders_n),
 v AS (SELECT o_orderpriority AS value, count(*) AS cnt, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders_n WHERE o_orderpriority IS NOT NULL GROUP BY 1),
 f AS (SELECT o_orderkey, o_orderstatus, round((coalesce(o_totalprice, med) - mean) / std, 6) AS o_totalprice_scaled,
 CAST(coalesce(o_totalprice, med) > med AS DOUBLE) AS o_totalprice_above_median, CAST(o_totalprice IS NULL AS DOUBLE) AS o_totalprice_was_missing,
 CAST(coalesce(code, 6) AS DOUBLE) AS o_orderpriority_encoded, CAST(coalesce(cnt, 0) AS DOUBLE) AS o_orderpriority_frequency,
 CAST(coalesce(month(o_orderdate), 0) AS DOUBLE) AS o_orderdate_month,
 CAST(coalesce(floor((epoch_us(o_orderdate) - t0) / 86400000000), 0) AS DOUBLE) AS o_orderdate_days_since_min,
 coalesce(o_totalprice / CASE WHEN o_custkey = 0 THEN 1e-6 ELSE o_custkey END, 0) AS per_customer
 FROM s, orders_n LEFT JOIN v ON o_orderpriority = value)
"""
MODEL_COLUMNS = [
    "o_totalprice_above_median", "o_totalprice_was_missing", "o_orderpriority_encoded", "o_orderpriority_frequency",
    "o_orderdate_month", "o_orderdate_days_since_min",
]


def _matrix(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderkey", "o_orderstatus", F.round("o_totalprice_scaled", 6).alias("o_totalprice_scaled"), *MODEL_COLUMNS, "per_customer"
    )


def _feature_model(spark: SparkSession, d: str) -> DataFrame:
    o, model = _orders_model(spark, d)
    return _matrix(model.transform(o))


CAT.add("x11_feature_model", _feature_model, SQL_MODEL + "SELECT * FROM f")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    o, model = _orders_model(spark, d)
    return model.select(["o_orderpriority_encoded", "o_orderdate_month", "unknown_feature"]).transform(o)


CAT.add("a4_project_selected", _selected, SQL_MODEL + "SELECT o_orderkey, o_orderstatus, o_orderpriority_encoded, o_orderdate_month FROM f")


def _reloaded(spark: SparkSession, d: str) -> DataFrame:
    o, model = _orders_model(spark, d)
    path = scratch(spark, "model")
    model.save(path, spark)
    return _matrix(engine.FeatureModel.load(path, spark).transform(o))


CAT.add("s6_persist_state", _reloaded, SQL_MODEL + "SELECT * FROM f")


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    o, model = _orders_model(spark, d)
    sizes = o.agg(*[F.count(c).alias(c) for c in o.columns]).first().asDict()
    counts = model.lineage(spark).where("feature IS NOT NULL").groupBy("source", "processor").agg(F.count("*").alias("features"))
    present = spark.createDataFrame(list(sizes.items()), "source string, present bigint")
    return counts.join(present, "source").select("source", "processor", "features", "present")


CAT.add(
    "a8_feature_map", _lineage,
    f"""WITH {ORDERS_N} SELECT * FROM (VALUES ('o_custkey', 'numeric', 3), ('o_totalprice', 'numeric', 5), ('o_orderdate', 'datetime', 21),
 ('o_orderpriority', 'categorical', 4)) t(source, processor, features0) JOIN (SELECT 'o_custkey' AS source, count(o_custkey) AS present FROM orders_n
 UNION ALL SELECT 'o_totalprice', count(o_totalprice) FROM orders_n UNION ALL SELECT 'o_orderdate', count(o_orderdate) FROM orders_n
 UNION ALL SELECT 'o_orderpriority', count(o_orderpriority) FROM orders_n) USING (source)""".replace("SELECT * FROM (VALUES", "SELECT source, processor, CAST(features0 AS BIGINT) AS features, present FROM (VALUES"),
)


def _concat(spark: SparkSession, d: str) -> DataFrame:
    made = {**numeric.numeric_features(numeric.NumericParams("p_size", 25.0, 25.0, 1.0, 1.0, 50.0, True, False), numeric.NumericConfig(enable_scaling=False, enable_log_transform=False)),
            **text.text_features(text.TextParams("p_name", False), text.TextConfig(enable_patterns=False))}
    return table(spark, d, "part").select("p_partkey", *[engine.coerce_fill_zero(c).alias(n) for n, c in made.items()]).drop("p_name_uppercase_ratio")


CAT.add("a1_concat_features", _concat,
        r"""SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size_original, CAST(p_size > 25 AS DOUBLE) AS p_size_above_median, CAST(length(p_name) AS DOUBLE) AS p_name_length,
 CAST(len(regexp_extract_all(p_name, '[^ ]+')) AS DOUBLE) AS p_name_word_count, CAST(length(p_name) AS DOUBLE) AS p_name_char_count,
 CAST(len(regexp_extract_all(p_name, '[0-9]')) AS DOUBLE) AS p_name_digit_count, CAST(len(regexp_extract_all(p_name, '[^a-zA-Z0-9 ]')) AS DOUBLE) AS p_name_special_char_count FROM part""")
CAT.add(
    "a2_coerce_fill_zero",
    lambda spark, d: _mixed(spark, d).select("o_orderkey", engine.coerce_fill_zero(F.col("code")).alias("value")),
    """SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE), 0) AS value FROM orders""",
)
CAT.add(
    "a3_constant_fallback",
    lambda spark, d: engine.FeatureEngine(engine.EngineConfig(keep=("c_custkey",))).fit(
        table(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("empty"))
    ).transform(table(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("empty"))),
    'SELECT c_custkey, CAST(1 AS DOUBLE) AS "__constant__" FROM customer',
)
CAT.add(
    "a5_align_test",
    lambda spark, d: engine.align_test(table(spark, d, "part"), ["p_size", "p_retailprice", "p_weight"], ["p_partkey"]),
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(0 AS DOUBLE) AS p_weight FROM part",
)


def _stack(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    both = engine.stack_tables(o.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 4 = 0").select("o_orderkey"))
    train, test = engine.split_stacked(both)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


CAT.add("a6_union_split", _stack,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 4 <> 0 THEN 'train' ELSE 'test' END AS part FROM orders""")
CAT.add(
    "a7_feature_stats",
    lambda spark, d: rounded(engine.feature_stats(table(spark, d, "lineitem"), BINNED), 4, "mean", "std"),
    "\nUNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem" for c in BINNED),
)
CAT.add(
    "a9_align_rows",
    lambda spark, d: table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id"),
    "SELECT doc_id, n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id)",
)

# -- target ---------------------------------------------------------------------------------------------


def _bounded(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    top = li.agg(F.max("l_extendedprice")).first()[0]
    return li.select(*LINE, (F.col("l_extendedprice") / F.lit(top)).alias("y"))


def _logit(spark: SparkSession, d: str) -> DataFrame:
    b = _bounded(spark, d)
    return rounded(target.apply_target(b, "y", target.fit_target(b, "y")), 6, "y")


SQL_BOUNDED = f"b AS (SELECT {SQL_LINE}, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS y FROM lineitem)"
CAT.add("y1_logit_target", _logit,
        f"""WITH {SQL_BOUNDED}, c AS (SELECT * REPLACE (least(greatest(y, 1e-7), 1 - 1e-7) AS y) FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(y / (1 - y)), 6) AS y FROM c""")
CAT.add(
    "y2_inverse_logit",
    lambda spark, d: table(spark, d, "events").select("event_id", F.round(target.inverse_logit(F.col("value") - 50), 8).alias("p")),
    "SELECT event_id, round(least(greatest(1 / (1 + exp(-(value - 50))), 1e-7), 1 - 1e-7), 8) AS p FROM events",
)
CAT.add(
    "y3_target_distribution",
    lambda spark, d: rounded(target.target_distribution(table(spark, d, "orders"), "o_totalprice"), 4, "mean", "std"),
    "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders",
)


def _class_like(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    out = None
    for c in ("l_discount", "l_extendedprice", "l_partkey", "l_returnflag"):
        row = target.classification_like(li, c).select(F.lit(c).alias("column"), "distinct", "integer_like", "classification_like")
        out = row if out is None else out.unionByName(row)
    return out


CAT.add(
    "y4_classification_like", _class_like,
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct", {'false' if c == 'l_returnflag' else f'bool_and(abs({c} - round({c})) <= 1e-8 + 1e-5 * abs(round({c})))'} AS integer_like,
 {'true' if c == 'l_returnflag' else f'count(DISTINCT {c}) <= 20 OR (count(DISTINCT {c}) / count(*) <= 0.05 AND bool_and(abs({c} - round({c})) <= 1e-8 + 1e-5 * abs(round({c}))))'} AS classification_like FROM lineitem"""
        for c in ("l_discount", "l_extendedprice", "l_partkey", "l_returnflag")
    ),
)
