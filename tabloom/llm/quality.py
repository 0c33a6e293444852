"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

`features` measures every text. `thresholds` selects, per stratum and rule, the value above which a document is
rejected. Labelled documents are the holdout: of a stratum's good documents, k of n lie above a cutoff; the cutoff is
admissible if the exact binomial bound keeps the false rejections of the rule at or below `alpha / rules` with
confidence: P(Binomial(n, alpha / rules) <= k) <= delta / (strata * rules * cutoffs), Bonferroni over everything that is
tried, so the choice among admissible cutoffs needs no further correction. Together the rules of a stratum then reject
at most a share `alpha` of its good documents with confidence 1 - delta over all strata. Of the admissible cutoffs the
one with the most bad rejections less `price` times the good ones is taken, the highest of equal ones; if none gains,
the rule rejects nothing there. A stratum without enough labels has no admissible cutoff and rejects nothing.

Null, empty and wordless texts have zero counts and fail the base rule (fewer than `min_words` words). A null stratum
is a stratum of its own. A document with several labels is good if one says so; null labels and ids count for nothing.
Repeated rows are measured and judged each; an empty table gives no rows; other columns pass through `judged_rows` as
they are, whatever their names. Long texts are measured whole, in time n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.llm.common import stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Rules as (numerator, denominator): the higher the share, the worse.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "word_chars"),
}
#: Shares are compared in steps of 1 / STEPS.
STEPS = 40
MIN_WORDS, REPEAT_PERCENT = 10, 20


def features(docs: DataFrame, window: int = 5) -> DataFrame:
    """Add COUNTS to rows with a column `text`."""
    blank = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({
        "_words": F.filter(F.split(blank, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(blank, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace(blank, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_upper": F.length(F.regexp_replace(blank, r"[^A-Z]+", "")).cast("bigint"),
    })
    words = F.col("_words")
    keys = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    df = df.withColumn("_windows", F.when(F.size(words) >= window, keys).otherwise(F.array().cast("array<bigint>")))
    windows = F.col("_windows")
    sortable = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window; only the others are sorted
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), sortable).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    order = F.col("_sorted")

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(other["h"] == x["h"], F.lit(False))

    repeated = F.filter(order, lambda x, k: same(x, F.get(order, k - 1)) | same(x, F.get(order, k + 1)))
    df = df.withColumn("_at", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
    return df.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("bigint"),
    }).drop("_words", "_lines", "_windows", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def levels() -> Column:
    """One number of steps per rule: the share rounded up to the next step, STEPS at most. A share is above k steps if and only if its level is above k."""
    def level(over: str, under: str) -> Column:
        return F.when(F.col(under) > 0, F.least(F.lit(STEPS), F.expr(f"({over} * {STEPS} + {under} - 1) div {under}"))).otherwise(0).cast("int")
    return F.array(*[level(*rule) for rule in RULES.values()])


def log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by 8: exact to 13 digits for x >= 1."""
    y = x + 8
    low = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - low


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), by the ratios of neighbouring terms from the k-th term down; 1 above the mean, where no cutoff is admissible."""
    lead = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    down = F.when(k > 0, F.sequence(k, F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("term"), (acc["sum"] + acc["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(lead * total)


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, price: int = 10) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_above, bad_above, p_value): the chosen cutoffs, in steps. measured: doc_id, stratum and COUNTS."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    holdout = measured.filter(~base_failed()).withColumn("levels", levels()).select("doc_id", "stratum", "levels").join(good, "doc_id")
    counts = holdout.select("stratum", "good", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level").agg(
        F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad"))
    spread = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("level", "good", "bad")).alias("bars")).withColumn("strata", F.count("*").over(Window.partitionBy("rule")))
    above = lambda what, cutoff: F.aggregate("bars", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["level"] > cutoff, x[what]).otherwise(0))
    tried = spread.withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).withColumns({"good_above": above("good", F.col("cutoff")), "bad_above": above("bad", F.col("cutoff"))})
    tried = tried.withColumn("p_value", binomial_tail(F.col("good_above"), F.col("n_good"), alpha / len(RULES)))
    admissible = tried.filter((F.col("n_good") > 0) & (F.col("p_value") <= delta / (F.col("strata") * len(RULES) * STEPS)))
    gain = F.col("bad_above") - price * F.col("good_above")
    fields = ["cutoff", "n_good", "good_above", "bad_above", "p_value"]
    best = admissible.filter(gain > 0).groupBy("stratum", "rule").agg(F.max_by(F.struct(*fields), F.struct(gain, F.col("cutoff"))).alias("best"))
    return best.select("stratum", F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("rule") + 1).alias("rule"), "best.*")


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed, broken (rules that reject) and kept. Strata with a cutoff have hundreds of labels each, so their
    table is a small fraction of the labels; it is broadcast after its rows are counted, and joined by Spark's choice beyond."""
    table = stored(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")).withColumnRenamed("stratum", "_stratum"), "quality-cutoffs")
    table = F.broadcast(table) if table.count() <= 10_000 else table
    broken = F.filter(F.arrays_zip(F.array(*[F.lit(r) for r in RULES]).alias("rule"), levels().alias("level")), lambda x: F.coalesce(x["level"] > F.element_at("limits", x["rule"]), F.lit(False)))
    joined = measured.join(table, measured["stratum"].eqNullSafe(table["_stratum"]), "left")
    out = joined.withColumns({"base_failed": base_failed(), "broken": F.transform(broken, lambda x: x["rule"])})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("_stratum", "limits")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and COUNTS of every row, as a stored table: filters on counts must not be pushed into the measuring
    expressions, which would then be computed once for each use."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{stratum_col}`").alias("stratum"))
    return stored(features(rows).drop("text"), "quality-measures")


def judged_rows(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """The whole rows of `docs` as a struct `row`, with doc_id, stratum, COUNTS and verdict."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.col("lang").alias("stratum"))
    measured = stored(features(rows).drop("text"), "quality-rows", compression="zstd")
    return judged(measured, thresholds(measured.drop("row"), labels, **settings))
