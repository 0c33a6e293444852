"""Training on large tables in a fixed number of passes: weighted cells for trees, moments per fold for linear models.

Trees see a feature only by its bins (32 of them, as in MLlib). Rows with the same bins are one cell, which is fitted as one
row with a weight; a cell's mean label decides the same splits as its rows, since the spread inside a cell is on neither
side of a split. Least squares sees only means, squares and products, so a few weighted rows with these same moments
give the same model. Every row is read and counted; MLlib does the fitting.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import OneVsRest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tables of up to this many rows are fitted row by row.
LARGE_ROWS = 1_000_000
#: Bins of a feature, MLlib's own default, and the features up to which rows are put into cells.
BINS, MAX_FEATURES = 32, 64
#: Where a method draws rows, a cell is drawn in bundles of about a 250,000th of all rows.
BUNDLES = 250_000
CELL_TASK_ROWS = 50_000
#: Bits of a bin number and the features whose bins share a whole number while cells are counted and kept.
BIN_BITS, WORD = 5, 12
#: Rows that place the cuts (MLlib places its own by 10,000 rows); every row is counted in its cell.
CUT_ROWS = 100_000


def feature_count(data: DataFrame) -> int:
    known = data.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    if known:
        return known
    first = data.select("features").first()
    return first["features"].size if first else 0


def _bin(x: Column, cuts: list[float], low: int = 0) -> Column:
    """The number of cuts below x, by bisection."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x <= F.lit(cuts[mid]), _bin(x, cuts[:mid], low)).otherwise(_bin(x, cuts[mid + 1 :], low + mid + 1))


def _with_bins(wide: DataFrame, cuts: list[list[float]]) -> tuple[DataFrame, list[Column]]:
    """The bins of `_bin` for all x0, x1, ..., looked up by MLlib's `Bucketizer`, whose buckets begin where they do, not after."""
    starts = [[math.nextafter(c, math.inf) for c in own if c < math.inf] for own in cuts]
    some = [i for i, own in enumerate(starts) if own]
    if some:
        names = {"inputCols": [f"x{i}" for i in some], "outputCols": [f"y{i}" for i in some]}
        wide = Bucketizer(splitsArray=[[-math.inf, *starts[i], math.inf] for i in some], handleInvalid="keep", **names).transform(wide)
    # what has no value or is no number lies above all cuts
    return wide, [F.least(F.col(f"y{i}").cast("int"), F.lit(len(own))) if starts[i] else F.lit(0) for i, own in enumerate(cuts)]


def _packed(bins: list[Column]) -> list[Column]:
    """Bin numbers, up to ``WORD`` of them in a whole number."""
    words = [bins[k : k + WORD] for k in range(0, len(bins), WORD)]
    return [functools.reduce(Column.bitwiseOR, [F.shiftleft(b.cast("long"), BIN_BITS * j) for j, b in enumerate(word)]) for word in words]


def find_cuts(data: DataFrame, size: int, bins: int = BINS) -> list[list[float]]:
    """Cuts per feature: between all values where there are at most ``bins`` of them, else at quantiles."""
    wide = data.select(vector_to_array("features").alias("x")).select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(size)])
    shares = [i / bins for i in range(1, bins)]
    facts = wide.agg(
        *[F.approx_count_distinct(f"x{i}").alias(f"d{i}") for i in range(size)], *[F.percentile_approx(f"x{i}", shares, 10_000).alias(f"q{i}") for i in range(size)],
        *[F.max(f"x{i}").alias(f"m{i}") for i in range(size)],
    ).first()
    few = [i for i in range(size) if facts[f"d{i}"] <= 2 * bins]  # the estimate is off by a twentieth
    values = wide.agg(*[F.collect_set(f"x{i}").alias(f"v{i}") for i in few]).first() if few else {}
    cuts = []
    for i in range(size):
        seen = sorted(values[f"v{i}"]) if i in few else []
        if i in few and len(seen) <= bins:
            cuts.append(sorted({(a + b) / 2 for a, b in zip(seen, seen[1:])}))
        else:
            cuts.append(sorted({q for q in facts[f"q{i}"] or [] if q < facts[f"m{i}"]}))
    return cuts


class BinnedModel(Model, MLWritable, MLReadable):
    """A tree model learnt on bin numbers, applied to the features themselves."""

    def __init__(self, model: Model, cuts: list[list[float]]):
        super().__init__()
        self.model, self.cuts = model, cuts

    @property
    def featureImportances(self):
        return self.model.featureImportances

    def _transform(self, data: DataFrame) -> DataFrame:
        wide = data.withColumnRenamed("features", "__raw").withColumn("__x", vector_to_array("__raw"))
        binned = F.array(*[_bin(F.get("__x", F.lit(i)), c).cast("double") for i, c in enumerate(self.cuts)])
        scored = self.model.transform(wide.withColumn("features", array_to_vector(binned)))
        made = [c for c in scored.columns if c not in (*data.columns, "__raw", "__x")]
        return scored.select(*[F.col("__raw").alias("features") if c == "features" else F.col(f"`{c}`") for c in data.columns], *made)

    def write(self) -> MLWriter:
        return _BinnedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BinnedReader()


class _BinnedWriter(MLWriter):
    def __init__(self, binned: BinnedModel):
        super().__init__()
        self.binned = binned

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.binned, path, self.sparkSession, extraMetadata={"cuts": json.dumps(self.binned.cuts)})
        self.binned.model.write().save(f"{path}/model")


class _BinnedReader(MLReader):
    def load(self, path: str) -> BinnedModel:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        binned = BinnedModel(DefaultParamsReader.loadParamsInstance(f"{path}/model", self.sparkSession), json.loads(facts["cuts"]))
        binned._resetUid(facts["uid"])
        return binned


@dataclass
class Cells:
    """A row per cell and fold, for regression with the mean label and the sum of squares inside the cell, else per class.
    Kept as packed bin numbers; vectors are made where they are read."""

    stored: DataFrame
    cuts: list[list[float]]
    rows: int
    regression: bool

    @staticmethod
    def of(data: DataFrame, regression: bool, rows: int) -> Cells:
        size = feature_count(data)
        few = data.sample(CUT_ROWS / rows, seed=42).persist() if rows > CUT_ROWS else data
        cuts = find_cuts(few, size)
        if few is not data:
            few.unpersist()
        folds = ["fold"] if "fold" in data.columns else []
        wide = data.withColumn("__x", vector_to_array("features")).select("label", *folds, *[F.get("__x", F.lit(i)).alias(f"x{i}") for i in range(size)])
        wide, bins = _with_bins(wide, cuts)
        words = _packed(bins)
        names = [f"w{k}" for k in range(len(words))]
        binned = wide.select("label", *folds, *[w.alias(n) for w, n in zip(words, names, strict=True)])
        known = [*names, *([] if regression else ["label"])]
        # a missing label stays missing, which MLlib refuses
        mean = F.when(F.count("label") == F.count(F.lit(1)), F.avg("label"))
        label = [mean.alias("label"), (F.var_pop("label") * F.count("label")).alias("within")] if regression else []
        grouped = binned.groupBy(*known, *folds).agg(F.count(F.lit(1)).alias("weight"), *label).persist()
        # as many parts as a fit's cells need, in one order, so that a seed draws the same
        cells = grouped.count() if regression else grouped.agg(F.approx_count_distinct(F.xxhash64(*known))).first()[0]
        parts = max(1, math.ceil(cells / CELL_TASK_ROWS))
        stored = grouped.repartition(parts, *names).sortWithinPartitions(*known, *folds).persist()
        stored.count()
        grouped.unpersist()
        return Cells(stored, cuts, rows, regression)

    @property
    def words(self) -> list[str]:
        return [f"w{k}" for k in range(math.ceil(len(self.cuts) / WORD))]

    def vectors(self, cells: DataFrame) -> DataFrame:
        """Packed cells with their bin numbers as features."""
        names = [f"b{i}" for i in range(len(self.cuts))]
        places = [F.shiftright(f"w{i // WORD}", BIN_BITS * (i % WORD)).bitwiseAND(F.lit((1 << BIN_BITS) - 1)).alias(n) for i, n in enumerate(names)]
        rest = [c for c in cells.columns if c not in self.words and c != "weight"]
        wide = cells.select(*rest, F.col("weight").cast("double").alias("weight"), *places)
        return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)

    @property
    def frame(self) -> DataFrame:
        """(features as bin numbers, label, fold, weight, within)."""
        return self.vectors(self.stored if self.regression else self.stored.withColumn("within", F.lit(0.0)))

    def without(self, folds: tuple = ()) -> DataFrame:
        """(packed bins, label, weight) of all rows but those of ``folds``. The same cell of several folds is one row for a class,
        so that there are no more of them than bins and classes allow, whatever the number of rows; mean labels aren't
        averaged again, which would round them."""
        left = self.stored.where(~F.col("fold").isin(*folds)) if folds else self.stored
        if self.regression or "fold" not in left.columns:
            return left.select(*self.words, "label", "weight")
        return left.groupBy(*self.words, "label").agg(F.sum("weight").alias("weight"))

    def fit(self, estimator: Estimator, folds: tuple = ()) -> BinnedModel:
        """The estimator fitted on all rows but those of ``folds``."""
        tree = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
        # the stored parts hold whole cells, so this moves no rows
        kept = self.without(folds).repartition(self.stored.rdd.getNumPartitions(), *self.words).sortWithinPartitions(*self.words, "label").persist()
        try:
            data = self.vectors(kept)
            if tree.hasParam("bootstrap") or tree.getSubsamplingRate() < 1.0:  # rows are drawn
                bundle = max(1, self.rows // BUNDLES)
                count = F.ceil(F.col("weight") / bundle).cast("int")
                part = F.floor(F.col("weight") / F.col("__n"))
                data = data.withColumn("__n", count).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
                data = data.withColumn("weight", part + (F.col("__i") <= F.col("weight") - part * F.col("__n")).cast("double")).drop("__n", "__i")
            least = tree.getMinInstancesPerNode()
            if least > 1:  # counted in rows, not in cells
                total = kept.agg(F.sum("weight")).first()[0]
                tree.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(0.49, least / total))
            return BinnedModel(estimator.setWeightCol("weight").fit(data), self.cuts)
        finally:
            kept.unpersist()

    def score(self, model: BinnedModel, fold: int) -> float | None:
        """The metric of `training.metric` over a fold's rows: all rows of a cell have one prediction."""
        scored = model.model.transform(self.frame.where(F.col("fold") == fold))
        gap = F.col("prediction") - F.col("label")
        good = -(F.col("weight") * gap * gap + F.col("within")) if self.regression else F.col("weight") * (gap == 0).cast("double")
        return scored.agg(F.sum(good) / F.sum("weight")).first()[0]

    def close(self) -> None:
        self.stored.unpersist()


def fit_trees(estimator: Estimator, data: DataFrame, regression: bool, large: int = LARGE_ROWS) -> Model:
    """A tree estimator fitted on assembled rows, by cells if there are many."""
    rows = data.count()
    if rows <= large or feature_count(data) > MAX_FEATURES:
        return estimator.fit(data)
    cells = Cells.of(data.select("features", "label"), regression, rows)
    try:
        return cells.fit(estimator)
    finally:
        cells.close()


@dataclass
class Moments:
    """Number of rows, means and centred products of (features..., label)."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n, self.products + other.products + np.outer(gap, gap) * self.n * other.n / n)

    def only(self, places: list[int]) -> Moments:
        """The same for some of the columns."""
        return Moments(self.n, self.mean[places], self.products[np.ix_(places, places)])

    @staticmethod
    def total(parts: dict[int, Moments], without: tuple = ()) -> Moments:
        kept = [m for f, m in parts.items() if f not in without]
        out = kept[0]
        for m in kept[1:]:
            out = out + m
        return out

    @property
    def label_std(self) -> float:
        return math.sqrt(max(self.products[-1, -1], 0.0) / self.n)

    def table(self, spark: SparkSession) -> DataFrame:
        """A few weighted rows (features, label, weight) with the same number, means and products."""
        scale = np.sqrt(np.clip(np.diag(self.products), 0.0, None) / self.n)
        safe = np.where(scale > 0, scale, 1.0)
        # of values in their own deviation, so that columns of small numbers keep their digits
        values, vectors = np.linalg.eigh(self.products / np.outer(safe, safe))
        weight = self.n / (2 * len(values))
        steps = [np.where(scale > 0, math.sqrt(max(v, 0.0) / (2 * weight)) * vectors[:, k] * safe, 0.0) for k, v in enumerate(values)]
        made = [self.mean + sign * step for step in steps for sign in (1, -1)]
        names = [f"x{i}" for i in range(len(self.mean) - 1)]
        values = ", ".join("(" + ", ".join(f"double('{v!r}')" for v in [*r.tolist(), weight]) + ")" for r in made)
        rows = spark.sql(f"SELECT * FROM VALUES {values} AS t ({', '.join([*names, 'label', 'weight'])})").coalesce(1)
        return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label", "weight")

    def squared_error(self, coefficients: np.ndarray, intercept: float) -> float:
        """Mean squared error of a linear model on these rows."""
        off = np.append(-np.asarray(coefficients), 1.0)
        bias = off @ self.mean - intercept
        return max(float(off @ self.products @ off) / self.n, 0.0) + float(bias * bias)


def moments(data: DataFrame, by: str | None = None) -> dict[int, Moments]:
    """Moments of (features, label) per value of ``by``, in one pass; products are centred while they are summed."""
    size = feature_count(data)
    names = [f"x{i}" for i in range(size)] + ["label"]
    wide = data.withColumn("__x", vector_to_array("features")).select(*[F.get("__x", F.lit(i)).alias(f"x{i}") for i in range(size)], F.col("label").cast("double").alias("label"), *([by] if by else []))
    return column_moments(wide, names, by)


def column_moments(df: DataFrame, names: list[str], by: str | None = None) -> dict[int, Moments]:
    """The same for columns of numbers, the label last."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    made = df.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n"), F.least(*[F.count(c) for c in names], F.count(F.lit(1))).alias("known"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )
    out = {}
    for r in made.collect():
        if r["known"] < r["n"]:
            raise ValueError("features and labels must not be null")
        products = np.zeros((len(names), len(names)))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"c{i}_{j}"] * r["n"]
        if not np.isfinite(products).all():
            raise ValueError("features and labels must be finite numbers")
        out[r[by] if by else 0] = Moments(r["n"], np.array([r[f"m{i}"] for i in range(len(names))]), products)
    return out


#: Columns up to which all products are made in one aggregate.
MAX_PRODUCTS = 32
