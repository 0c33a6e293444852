"""Sources, sinks and ingest shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import ORDERS_N, Catalog, orders_with_nulls, scratch, sql_hash, table
from tabloom.operators import folds
from tabloom.sources import readers, shaping, writers

CAT = Catalog()


def _pair(spark: SparkSession, d: str) -> DataFrame:
    train, test = readers.load_pair(spark, f"{d}/orders.parquet", f"{d}/lineitem.parquet", fmt="parquet")
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n_rows"), F.max("o_orderkey").alias("max_key")).unionByName(
        test.agg(F.lit("test").alias("part"), F.count("*").alias("n_rows"), F.max("l_orderkey").alias("max_key"))
    )


CAT.add("s1_scan_pair", _pair, """
SELECT 'train' AS part, count(*) AS n_rows, max(o_orderkey) AS max_key FROM orders
UNION ALL SELECT 'test', count(*), max(l_orderkey) FROM lineitem""")

CAT.add(
    "s2_scan_source",
    lambda spark, d: readers.scan_source(
        spark, readers.SourceConfig("parquet", f"{d}/customer.parquet", where="c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
    ).select("c_custkey", "c_name", "c_acctbal"),
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
)
CAT.add(
    "s3_source_filter",
    lambda spark, d: readers.source_filter(table(spark, d, "orders").orderBy("o_orderkey"), "o_orderstatus = 'F'", 500)
    .select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500",
)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "predictions")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 200000).cast("int").alias("prediction"))
    main, copy = writers.write_predictions(o, path, run_id="r1")
    return spark.read.option("header", True).schema("id bigint, prediction int").csv(copy)


CAT.add("s4_write_predictions", _predictions,
        "SELECT o_orderkey AS id, CAST(o_totalprice > 200000 AS BIGINT) AS prediction FROM orders")


def _report(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "report")
    rep = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    writers.write_report(rep, path)
    return spark.read.schema("o_orderstatus string, n bigint, top double").json(path)


CAT.add("s5_write_report", _report, "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")


def _cv_results(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "cv")
    board = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.max("value").alias("mean"), F.min("value").alias("std")
    )
    writers.write_cv_results(board, path)
    return spark.read.option("header", True).schema("Model string, Mean_Score double, Std_Score double").csv(path)


CAT.add("s7_write_cv_results", _cv_results,
        'SELECT event_type AS "Model", max(value) AS "Mean_Score", min(value) AS "Std_Score" FROM events GROUP BY 1')
CAT.add(
    "s8_preview",
    lambda spark, d: readers.preview(table(spark, d, "part"), ["p_partkey"], 10),
    "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part ORDER BY p_partkey LIMIT 10",
)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "matrix")
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type")
    writers.write_matrix(part, path, ["p_partkey"], ["p_size", "p_retailprice"], "p_type")
    return spark.read.parquet(path)


CAT.add("s9_write_matrix", _matrix, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_type FROM part")

CAT.add(
    "i1_drop_dups",
    lambda spark, d: shaping.drop_dups(table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")),
    "SELECT DISTINCT l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem",
)
CAT.add(
    "i2_missing_strategy_auto",
    lambda spark, d: shaping.fill_missing(
        orders_with_nulls(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority"), "auto"
    ),
    f"""WITH {ORDERS_N}, m AS (SELECT median(o_totalprice) AS med FROM orders_n),
 c AS (SELECT o_orderpriority AS v FROM orders_n WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_totalprice, m.med) AS o_totalprice, coalesce(o_orderpriority, c.v) AS o_orderpriority
FROM orders_n, m, c""",
)
CAT.add(
    "i2_missing_strategy_drop",
    lambda spark, d: shaping.fill_missing(orders_with_nulls(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority"), "drop"),
    f"""WITH {ORDERS_N} SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders_n
WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""",
)
CAT.add(
    "i3_fill_values",
    lambda spark, d: shaping.fill_values(
        orders_with_nulls(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority"), {"o_totalprice": 0.0, "o_orderpriority": "Unknown"}
    ),
    f"""WITH {ORDERS_N} SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice,
 coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM orders_n""",
)
CAT.add(
    "i4_require_columns",
    lambda spark, d: shaping.require_columns(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"]).groupBy("c_mktsegment").agg(
        F.count("c_custkey").alias("n")
    ),
    "SELECT c_mktsegment, count(c_custkey) AS n FROM customer GROUP BY 1",
)


def _typed_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).alias("code"))


CAT.add(
    "i5_check_types",
    lambda spark, d: shaping.check_types(_typed_text(spark, d), {"code": "int"})[1],
    """SELECT o_orderkey, code FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority
 ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders) WHERE code IS NOT NULL AND TRY_CAST(code AS BIGINT) IS NULL""",
)
CAT.add(
    "i6_drop_columns",
    lambda spark, d: shaping.drop_columns(table(spark, d, "supplier"), ["s_name", "s_acctbal"]),
    "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier",
)
CAT.add(
    "i7_rename_columns",
    lambda spark, d: shaping.rename_columns(table(spark, d, "supplier"), {"s_suppkey": "supplier_id", "s_name": "supplier_name"}),
    "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
)
CAT.add(
    "i8_split_random",
    lambda spark, d: shaping.split_random(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42),
    f"SELECT o_orderkey, ({sql_hash(chr(39) + '42:' + chr(39) + ' || CAST(o_orderkey AS VARCHAR)')} % 10000) < 2000 AS is_test FROM orders",
)


def sql_cutoffs(source: str, group: str, key: str, shares: str) -> str:
    """Per group the smallest hash at or below which the share of rows lies."""
    return f"""h AS (SELECT *, {sql_hash(key)} AS h FROM {source}),
 r AS (SELECT {group} AS grp, h, count(*) OVER (PARTITION BY {group} ORDER BY h) AS upto, count(*) OVER (PARTITION BY {group}) AS total FROM h),
 cut AS (SELECT grp, s AS share, min(h) AS cutoff FROM r, (SELECT unnest({shares}) AS s) WHERE upto >= ceil(round(s * total, 6)) GROUP BY 1, 2)"""


CAT.add(
    "i9_split_stratified",
    lambda spark, d: shaping.split_stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2),
    f"""WITH {sql_cutoffs('orders', 'o_orderstatus', 'o_orderkey', '[0.2::DOUBLE]')}
SELECT o_orderkey, o_orderstatus, h <= cutoff AS is_test FROM h JOIN cut ON o_orderstatus = grp""",
)
CAT.add(
    "i10_split_time",
    lambda spark, d: shaping.split_time(table(spark, d, "events").select("event_id", "ts"), "ts", 0.2).select("event_id", "is_test"),
    """SELECT event_id, epoch_us(ts) > (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.8) FROM events) AS is_test FROM events""",
)
CAT.add(
    "i11_split_custom",
    lambda spark, d: shaping.split_custom(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.year("o_orderdate") >= 2000)
    .select("o_orderkey", "is_test"),
    "SELECT o_orderkey, year(o_orderdate) >= 2000 AS is_test FROM orders",
)
CAT.add(
    "ingest_all_steps",
    lambda spark, d: shaping.ingest(
        orders_with_nulls(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"),
        shaping.IngestConfig(
            drop_duplicates=True, missing_strategy="drop", required_columns=("o_orderkey",), column_types={"o_orderkey": "int"},
            drop_columns=("o_orderstatus",), rename_columns={"o_totalprice": "price"},
        ),
    )[0],
    f"""WITH {ORDERS_N} SELECT DISTINCT o_orderkey, o_totalprice AS price, o_orderpriority FROM orders_n
WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""",
)
CAT.add(
    "m6_kfold",
    lambda spark, d: folds.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5),
    f"SELECT o_orderkey, {sql_hash('o_orderkey')} % 5 AS fold FROM orders",
)
CAT.add(
    "m7_stratified_kfold",
    lambda spark, d: folds.stratified_kfold(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5),
    f"""WITH {sql_cutoffs('orders', 'o_orderstatus', 'o_orderkey', '[0.2::DOUBLE, 0.4, 0.6, 0.8]')}
SELECT o_orderkey, o_orderstatus, CAST(count(*) FILTER (WHERE cutoff < h) AS BIGINT) AS fold
FROM h JOIN cut ON o_orderstatus = grp GROUP BY o_orderkey, o_orderstatus""",
)
