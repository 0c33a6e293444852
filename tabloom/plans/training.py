"""Candidates, cross-validation, search, stacking, leaderboard and error analysis with MLlib.

The assembled matrix is written once and read by every fit. Candidates, parameter sets and folds are
independent Spark jobs, sent from a small pool of driver threads.
"""

from __future__ import annotations

import math
import random
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tabloom.plans import cells as compact
from tabloom.session import cut_lineage, is_scan, spread

LINEAR, RIDGE, LOGISTIC, FOREST, BOOSTING = (
    "Linear Regression", "Ridge", "Logistic Regression", "Random Forest", "Gradient Boosting",
)
STACK = "Stacking Ensemble"

# Type and bounds of every parameter a user may override.
PARAMETER_LIMITS = {
    "Random Forest": {
        "n_estimators": ("int", 100, 1000),
        "max_depth": ("int", 5, 25),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
    },
    "Gradient Boosting": {
        "n_estimators": ("int", 100, 2000),
        "learning_rate": ("float", 0.01, 0.3),
        "max_depth": ("int", 3, 12),
        "subsample": ("float", 0.3, 1.0),
    },
    "Logistic Regression": {"C": ("float", 0.0001, 100.0)},
    "Linear Regression": {"fit_intercept": ("bool", None, None)},
}
# Search ranges (kind, low, high); "log" draws on a logarithmic scale.
SEARCH_SPACES = {
    "Random Forest": {
        "n_estimators": ("int", 50, 100),
        "max_depth": ("int", 5, 15),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", ["sqrt", "log2", "all"], None),
    },
    "Gradient Boosting": {
        "n_estimators": ("int", 20, 100),
        "max_depth": ("int", 3, 12),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.5, 1.0),
    },
    "Ridge": {"alpha": ("log", 1e-4, 10.0)},
    "Logistic Regression": {"alpha": ("log", 1e-4, 10.0)},
}
# Rows up to which a data set counts as small, and the trials it gets.
BASE_TRIALS, BASE_SECONDS = 100, 600
SMALL_BUDGETS = [(2_000, 25, 240), (5_000, 40, 360)]
SMALL_BOOSTING = {25: (15, 180), 40: (20, 240)}
MAX_FOLDS, MAX_DEPTH = 1000, 30


def tree_depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"max_depth {depth}: trees have at most {MAX_DEPTH} levels")
    return depth


def build_model(
    name: str, problem: str, params: dict | None = None, classes: int = 2, rows: int = 1, label_std: float = 1.0, seed: int = 42
) -> Estimator:
    """An MLlib estimator from a candidate name and parameters in the usual tabular names.

    ``rows`` and ``label_std`` of the training rows scale the penalty: ``alpha`` weighs against a sum of
    squared errors, ``regParam`` against their mean over a standardised label.
    """
    p = dict(params or {})
    if name == LINEAR:
        return LinearRegression(fitIntercept=p.get("fit_intercept", True), solver="auto")
    if name == RIDGE:
        return LinearRegression(regParam=p.get("alpha", 1.0) * label_std / max(rows, 1), elasticNetParam=0.0)
    if name == LOGISTIC:
        strength = 1.0 / p["C"] if "C" in p else p.get("alpha", 0.0)
        return LogisticRegression(maxIter=p.get("max_iter", 1000), regParam=strength / max(rows, 1), tol=1e-6)
    if name == FOREST:
        subset = {"sqrt": "sqrt", "log2": "log2", "all": "all"}.get(p.get("max_features", "auto"), "auto")
        make = RandomForestRegressor if problem == "regression" else RandomForestClassifier
        return make(
            numTrees=p.get("n_estimators", 100), maxDepth=tree_depth(p.get("max_depth", 10)), seed=seed,
            minInstancesPerNode=p.get("min_samples_leaf", 1), featureSubsetStrategy=subset,
        )
    if name == BOOSTING:
        shared = dict(
            maxIter=p.get("n_estimators", 20), stepSize=p.get("learning_rate", 0.1), maxDepth=tree_depth(p.get("max_depth", 5)),
            subsamplingRate=p.get("subsample", 1.0), seed=seed,
        )
        if problem == "regression":
            return GBTRegressor(**shared)
        boosted = GBTClassifier(**shared)
        return boosted if classes <= 2 else OneVsRest(classifier=boosted)
    raise ValueError(f"unknown model '{name}'")


class Trainer:
    """Fits candidates on assembled rows (features, label, fold), with or without some of the folds.

    Small tables are fitted row by row. Above ``large`` rows trees are fitted on weighted cells and least squares on moments,
    both made once, on first use, for all fits and folds (see `cells`); ``close`` frees them.
    """

    def __init__(self, data: DataFrame, problem: str, classes: int = 2, large: int | None = None):
        self.data, self.problem, self.classes = data, problem, classes
        self.large = compact.LARGE_ROWS if large is None else large
        self._lock, self._rows, self._cells, self._moments, self._folds = threading.RLock(), None, None, None, None

    def __enter__(self) -> Trainer:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def rows(self) -> int:
        with self._lock:
            if self._rows is None:
                self._rows = self.data.count()
            return self._rows

    def folds(self, expected: int | None = None) -> list[int]:
        with self._lock:
            if self._folds is None:
                self._folds = fold_values(self.data if self._cells is None else self._cells.stored)
        if expected is not None and expected != len(self._folds):
            raise ValueError(f"{expected} folds expected, the data has {len(self._folds)}")
        return self._folds

    def cells(self, name: str) -> compact.Cells | None:
        if name not in (FOREST, BOOSTING) or self.rows <= self.large or compact.feature_count(self.data) > compact.MAX_FEATURES:
            return None
        with self._lock:
            if self._cells is None:
                self._cells = compact.Cells.of(self.data, self.problem == "regression", self.rows)
            return self._cells

    def moments(self, name: str) -> dict[int, compact.Moments] | None:
        if name not in (LINEAR, RIDGE) or self.rows <= self.large or compact.feature_count(self.data) >= compact.MAX_PRODUCTS:
            return None
        with self._lock:
            if self._moments is None:
                self._moments = compact.moments(self.data, "fold" if "fold" in self.data.columns else None)
            return self._moments

    def prepare(self, names: list[str]) -> None:
        for name in names:
            self.cells(name), self.moments(name)

    def fit(self, name: str, params: dict | None = None, without: tuple = ()) -> Model:
        if (cells := self.cells(name)) is not None:
            return cells.fit(build_model(name, self.problem, params, self.classes), without)
        if (parts := self.moments(name)) is not None:
            facts = compact.Moments.total(parts, without)
            model = build_model(name, self.problem, params, self.classes, facts.n, facts.label_std or 1.0)
            return model.setWeightCol("weight").fit(facts.table(self.data.sparkSession))
        rest = self.data.where(~F.col("fold").isin(*without)) if without else self.data
        if name not in (RIDGE, LOGISTIC):
            return build_model(name, self.problem, params, self.classes).fit(rest)
        facts = rest.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("std")).first()
        return build_model(name, self.problem, params, self.classes, facts["n"], facts["std"] or 1.0).fit(rest)

    def score(self, model: Model, name: str, fold: int) -> float | None:
        if (cells := self.cells(name)) is not None:
            return cells.score(model, fold)
        if (parts := self.moments(name)) is not None:
            return -parts[fold].squared_error(model.coefficients.toArray(), model.intercept)
        return model.transform(self.data.where(F.col("fold") == fold)).agg(metric(self.problem)).first()[0]

    def close(self) -> None:
        with self._lock:
            if self._cells is not None:
                self._cells.close()
            self._cells = None


def fit_model(data: DataFrame, name: str, problem: str, params: dict | None = None, classes: int = 2) -> Model:
    """Fit a candidate on assembled rows."""
    with Trainer(data, problem, classes) as trainer:
        return trainer.fit(name, params)


def candidates(problem: str) -> list[str]:
    return [LINEAR, RIDGE, FOREST, BOOSTING] if problem == "regression" else [LOGISTIC, FOREST, BOOSTING]


def candidate_order(names: list[str], recommended: list[str], excluded: list[str], tunable: list[str]) -> tuple[list[str], list[str]]:
    """(models in order, models to tune): recommended first, excluded out; all models if none would be left."""
    order = [n for n in dict.fromkeys([*recommended, *names]) if n in names and n not in excluded]
    if not order:
        return list(names), list(tunable)
    return order, [n for n in (recommended or order) if n in tunable and n in order]


def order_candidates(models: DataFrame, guidance: DataFrame) -> DataFrame:
    """The same on tables: models (scope, model, position), guidance (scope, model, kind, position).

    ``scope`` separates independent decisions. A scope whose models are all excluded keeps them all.
    """
    wanted = guidance.where(F.col("kind") == "recommended").groupBy("scope", "model").agg(F.min("position").alias("wish"))
    banned = guidance.where(F.col("kind") == "excluded").select("scope", "model").distinct().withColumn("banned", F.lit(True))
    joined = models.join(wanted, ["scope", "model"], "left").join(banned, ["scope", "model"], "left").withColumn(
        "banned", F.coalesce("banned", F.lit(False))
    )
    left = joined.groupBy("scope").agg(F.count_if(~F.col("banned")).alias("left"))
    kept = joined.join(left, "scope").where(~F.col("banned") | (F.col("left") == 0))
    # a scope holds each candidate model once, so its window is as small as the list of models
    by_wish = Window.partitionBy("scope").orderBy(
        F.when(F.col("left") > 0, F.col("wish")).asc_nulls_last(), F.asc("position"), F.asc("model")
    )
    return kept.select("scope", "model", F.row_number().over(by_wish).alias("rank"))


def clamp_overrides(suggestions: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Suggestions (model, parameter, value double, ...) kept within the limits; unsupported ones are dropped."""
    rows = [
        (m, p, kind, None if low is None else float(low), None if high is None else float(high))
        for m, params in PARAMETER_LIMITS.items() for p, (kind, low, high) in params.items()
    ]
    limits = suggestions.sparkSession.createDataFrame(rows, "model string, parameter string, type string, low double, high double")
    v = F.col("value")
    rounded = F.when(F.col("type") == "int", F.rint(v)).when(F.col("type") == "bool", (v != 0).cast("double")).otherwise(v)
    inside = F.when(F.col("type") == "bool", rounded).otherwise(F.greatest(F.least(rounded, F.col("high")), F.col("low")))
    final = F.when(F.col("type") == "float", F.round(inside, 6)).otherwise(inside)
    return suggestions.join(F.broadcast(limits), ["model", "parameter"]).where(v.isNotNull()).select(
        *suggestions.columns, final.alias("clamped")
    )


@dataclass(frozen=True)
class Budget:
    trials: int
    seconds: int
    boosting_trials: int
    boosting_seconds: int


def search_budget(rows: int) -> Budget:
    """Trials and seconds for `search_within`: small tables get fewer trials. A search always reads all rows."""
    for limit, trials, seconds in SMALL_BUDGETS:
        if 0 < rows <= limit:
            return Budget(trials, seconds, *SMALL_BOOSTING[trials])
    return Budget(BASE_TRIALS, BASE_SECONDS, BASE_TRIALS, BASE_SECONDS)


def metric(problem: str) -> Column:
    """Aggregate to be maximised: accuracy, or the negative mean squared error."""
    error = F.col("prediction") - F.col("label")
    return -F.avg(error * error) if problem == "regression" else F.avg((F.col("prediction") == F.col("label")).cast("double"))


def training_frame(data: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Assembled rows on all cores and kept for the many fits; the caller unpersists.

    If all models that will be fitted (``names``) are trees, the rows of a large scan are not kept: a few passes make the cells
    of all fits, and kept vectors take several times the room of the table.
    """
    frame = spread(data)
    trees = names and set(names) <= {FOREST, BOOSTING} and compact.feature_count(data) <= compact.MAX_FEATURES
    if trees and frame is data and is_scan(data) and data.count() > compact.LARGE_ROWS:
        return frame
    return frame.persist()


@dataclass
class CvResult:
    model: str
    scores: list[float]
    params: dict = field(default_factory=dict)
    tuned: bool = False
    status: str = "ok"

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else float("nan")

    @property
    def std(self) -> float:
        return math.sqrt(sum((s - self.mean) ** 2 for s in self.scores) / len(self.scores)) if self.scores else float("nan")


def fold_values(data: DataFrame, folds: int | None = None) -> list[int]:
    """The folds that the data has, so that every row is in one of them; an expected number that differs is an error."""
    found = sorted(r["fold"] for r in data.select("fold").where("fold IS NOT NULL").distinct().limit(MAX_FOLDS + 1).collect())
    if len(found) < 2 or len(found) > MAX_FOLDS or data.where("fold IS NULL").limit(1).count():
        raise ValueError(f"every row needs one of 2 to {MAX_FOLDS} folds")
    if folds is not None and folds != len(found):
        raise ValueError(f"{folds} folds expected, the data has {len(found)}")
    return found


def cross_validate(
    data: DataFrame | Trainer, name: str, problem: str, folds: int | None = None, params: dict | None = None, classes: int = 2, trainer: Trainer | None = None,
) -> CvResult:
    """Score per fold on assembled data (features, label, fold); all folds of the data. A trainer of the same data, after it or
    in its place, keeps what it has prepared for further calls."""
    if isinstance(data, Trainer):
        data, trainer = data.data, data
    if trainer is None:
        with Trainer(data, problem, classes) as own:
            return cross_validate(data, name, problem, folds, params, classes, own)
    scores = []
    trainer.cells(name)
    for f in trainer.folds(folds):
        value = trainer.score(trainer.fit(name, params, (f,)), name, f)
        if value is not None:
            scores.append(float(value))
    return CvResult(name, scores, params or {})


def draw_params(name: str, trials: int, seed: int = 42) -> list[dict]:
    """Parameter sets drawn from the model's search space, the same for the same seed."""
    rng = random.Random(f"{name}:{seed}")
    space = SEARCH_SPACES.get(name, {})
    drawn = []
    for _ in range(trials if space else 0):
        params = {}
        for key, (kind, low, high) in space.items():
            if kind == "int":
                params[key] = rng.randint(low, high)
            elif kind == "float":
                params[key] = rng.uniform(low, high)
            elif kind == "log":
                params[key] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                params[key] = rng.choice(low)
        drawn.append(params)
    return drawn


def search(
    data: DataFrame, name: str, problem: str, trials: int, folds: int | None = None, seed: int = 42,
    classes: int = 2, workers: int = 2, on_trial: Callable[[str, int, float], None] | None = None, trainer: Trainer | None = None,
) -> CvResult:
    """Random search; trials run as concurrent Spark jobs. Failed trials are counted in the result's status with the last
    reason; if all fail, the default parameters are scored and the status says so."""
    if trainer is None:
        with Trainer(data, problem, classes) as own:
            return search(data, name, problem, trials, folds, seed, classes, workers, on_trial, own)
    drawn = draw_params(name, trials, seed)

    def run(item: tuple[int, dict]) -> CvResult:
        number, params = item
        try:
            result = cross_validate(data, name, problem, folds, params, classes, trainer)
        except Exception as problem_found:  # a trial's own failure must not end the search; it is recorded
            return CvResult(name, [], params, status=f"{type(problem_found).__name__}: {problem_found}"[:300])
        if on_trial:
            on_trial(name, number, result.mean)
        return result

    tried = _in_threads(data.sparkSession, run, list(enumerate(drawn)), workers)
    results, failed = [r for r in tried if r.scores], [r for r in tried if not r.scores]
    best = max(results, key=lambda r: r.mean) if results else cross_validate(data, name, problem, folds, None, classes, trainer)
    best.tuned = bool(results)
    if failed:
        best.status = f"ok, {len(failed)} of {len(tried)} trials failed, last: {failed[-1].status}"
    return best


#: Shares of a trial's trees or rounds at which successive halving looks at it, and of the trials that go on each time.
RUNGS, KEPT = (1 / 9, 1 / 3, 1.0), 1 / 3


class Deadline:
    """Jobs started under it carry its tag; when the time is up they are cancelled and no further ones are started."""

    def __init__(self, spark: SparkSession, seconds: float):
        self.sc, self.tag = spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
        self.end = time.monotonic() + seconds
        self._done = threading.Event()
        self._watch = threading.Thread(target=self._cancel, daemon=True)

    def _cancel(self) -> None:
        """From the deadline on, again and again: a fit is many jobs, and the next one may start between two looks."""
        self._done.wait(max(self.end - time.monotonic(), 0))
        while not self._done.wait(0.2):
            self.sc.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Deadline:
        self._watch.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._done.set()

    @property
    def over(self) -> bool:
        return time.monotonic() >= self.end

    def run(self, work: Callable):
        """The work's result, or None if the time ran out before or during it."""
        if self.over:
            return None
        self.sc.addJobTag(self.tag)
        try:
            return work()
        except Exception:
            if self.over:
                return None
            raise
        finally:
            self.sc.removeJobTag(self.tag)


def search_within(
    data: DataFrame, name: str, problem: str, trials: int, seconds: float, folds: int | None = None, seed: int = 42, classes: int = 2, workers: int = 2,
    trainer: Trainer | None = None,
) -> CvResult:
    """Random search by successive halving under a deadline; every trial covers all rows and all folds. What a trainer
    prepares once for all trials of a large table is made before the clock starts.

    All trials of a forest or a boosting run with a ninth of their trees or rounds first, the best third goes on to a third,
    the best third of those to all; other models have one rung. At the deadline running trials are cancelled. The result is the
    best trial of the highest rung that any trial finished, with its parameters at full size; its status counts what
    happened. If no trial finished at all, the default parameters are scored, deadline or not.
    """
    if trainer is None:
        with Trainer(data, problem, classes) as own:
            return search_within(data, name, problem, trials, seconds, folds, seed, classes, workers, own)
    trainer.prepare([name])
    sized = "n_estimators" in SEARCH_SPACES.get(name, {})
    drawn = draw_params(name, trials, seed)
    left, best, failures, unfinished, finished = list(enumerate(drawn)), None, [], 0, 0
    with Deadline(data.sparkSession, seconds) as deadline:

        def attempt(item: tuple[int, dict, float]) -> CvResult | None:
            number, params, share = item
            now = {**params, "n_estimators": max(1, round(params["n_estimators"] * share))} if sized else params
            try:
                found = deadline.run(lambda: cross_validate(trainer, name, problem, folds, now, classes))
            except Exception as problem_found:  # a trial's own failure must not end the search; it is recorded
                return CvResult(name, [], params, status=f"{type(problem_found).__name__}: {problem_found}"[:300])
            return found and CvResult(name, found.scores, params)

        for share in RUNGS if sized else (1.0,):
            tried = _in_threads(data.sparkSession, attempt, [(n, p, share) for n, p in left], workers)
            done = [(item, r) for item, r in zip(left, tried, strict=True) if r is not None and r.scores]
            failures += [r.status for r in tried if r is not None and not r.scores]
            unfinished, finished = unfinished + sum(r is None for r in tried), finished + len(done)
            if not done:
                break
            done.sort(key=lambda d: (-d[1].mean, d[0][0]))
            best = done[0][1]
            left = [item for item, _ in done[: max(1, math.ceil(len(done) * KEPT))]]
            if deadline.over:
                break
    best = best or cross_validate(trainer, name, problem, folds, None, classes)
    best.tuned = finished > 0
    notes = [f"{finished} runs"] + ([f"{len(failures)} failed, last: {failures[-1]}"] if failures else []) + ([f"{unfinished} cut by the deadline"] if unfinished else [])
    best.status = "ok, " + ", ".join(notes)
    return best


def _in_threads(spark: SparkSession, run: Callable, items: list, workers: int) -> list:
    if workers <= 1 or len(items) <= 1:
        return [run(i) for i in items]
    pool = ThreadPool(min(workers, len(items)))
    try:
        return pool.map(inheritable_thread_target(spark)(run), items)
    finally:
        pool.close()


def run_candidates(
    data: DataFrame, names: list[str], problem: str, folds: int | None = None, tune: list[str] | None = None, trials: int = 10,
    classes: int = 2, workers: int = 3, params: dict[str, dict] | None = None, budget: Budget | None = None,
) -> list[CvResult]:
    """Cross-validate (and search) all candidates concurrently, each in its own scheduler pool (they share the cluster
    evenly under ``spark.scheduler.mode=FAIR``). With a budget, searches take its trials and keep its deadlines."""
    sc = data.sparkSession.sparkContext

    def run(name: str) -> CvResult:
        sc.setLocalProperty("spark.scheduler.pool", name)
        try:
            if tune and name in tune and budget:
                own = (budget.boosting_trials, budget.boosting_seconds) if name == BOOSTING else (budget.trials, budget.seconds)
                return search_within(data, name, problem, *own, folds, classes=classes, workers=1, trainer=trainer)
            if tune and name in tune:
                return search(data, name, problem, trials, folds, classes=classes, workers=1, trainer=trainer)
            return cross_validate(data, name, problem, folds, (params or {}).get(name), classes, trainer)
        except Exception as problem_found:  # recorded in the leaderboard, the other candidates go on
            return CvResult(name, [], status=f"failed: {type(problem_found).__name__}: {problem_found}"[:500])
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with Trainer(data, problem, classes) as trainer:
        return _in_threads(data.sparkSession, run, names, workers)


# -- stacking -----------------------------------------------------------------------------------------


def _predict_into(model: Model, df: DataFrame, out: str, problem: str, classes: int) -> DataFrame:
    """Adds the model's meta-features to the row; no join is needed."""
    scored = model.transform(df)
    if problem == "classification" and "probability" in scored.columns:
        value = vector_to_array(F.col("probability"))
        made = {f"{out}_{i}": F.get(value, F.lit(i)) for i in range(1 if classes == 2 else 0, max(classes, 2))}
    elif problem == "classification" and classes > 2:
        # only the class is known: one flag per class
        made = {f"{out}_{i}": (F.col("prediction") == i).cast("double") for i in range(classes)}
    else:
        made = {f"{out}_1": F.col("prediction")}
    return scored.withColumns(made).select(*df.columns, *made)


def _meta_columns(members: list, classes: int, problem: str) -> list[str]:
    if problem == "classification" and classes > 2:
        return [f"m{i}_{c}" for i in range(len(members)) for c in range(classes)]
    return [f"m{i}_1" for i in range(len(members))]


def _fit_meta(data: DataFrame, problem: str) -> Model:
    model = fit_model(data.withColumn("features", F.col("meta")), RIDGE if problem == "regression" else LOGISTIC, problem)
    return model.setFeaturesCol("meta")


def out_of_fold(data: DataFrame, members: list[CvResult], problem: str, classes: int, trainer: Trainer | None = None, without: tuple = ()) -> DataFrame:
    """Every row with the predictions of members fitted without its fold; rows of ``without`` take no part."""
    if trainer is None:
        with Trainer(data, problem, classes) as own:
            return out_of_fold(data, members, problem, classes, own, without)
    slices = []
    for f in trainer.folds():
        if f in without:
            continue
        held = data.where(F.col("fold") == f)
        for i, m in enumerate(members):
            model = trainer.fit(m.model, m.params, (*without, f))
            held = _predict_into(model, held, f"m{i}", problem, classes)
        slices.append(held)
    result = slices[0]
    for part in slices[1:]:
        result = result.unionByName(part)
    return result


class StackedModel(Model, MLWritable, MLReadable):
    """Base models chained on the same rows, then the meta-learner. A stage like any other: it can stand in a
    PipelineModel and is written and read with it."""

    def __init__(self, bases: list[Model], meta: Model, problem: str, classes: int):
        super().__init__()
        self.bases, self.meta, self.problem, self.classes = bases, meta, problem, classes

    def _transform(self, data: DataFrame) -> DataFrame:
        columns = data.columns
        for i, base in enumerate(self.bases):
            data = _predict_into(base, data, f"m{i}", self.problem, self.classes)
        metas = _meta_columns(self.bases, self.classes, self.problem)
        scored = self.meta.transform(VectorAssembler(inputCols=metas, outputCol="meta").transform(data))
        extra = ["probability"] if "probability" in scored.columns else []
        return scored.select(*columns, "prediction", *extra)

    def write(self) -> MLWriter:
        return _StackWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StackReader()


class _StackWriter(MLWriter):
    """The stack's own facts as stage metadata, each model in a folder of its own."""

    def __init__(self, stack: StackedModel):
        super().__init__()
        self.stack = stack

    def saveImpl(self, path: str) -> None:
        facts = {"problem": self.stack.problem, "classes": self.stack.classes, "members": len(self.stack.bases)}
        DefaultParamsWriter.saveMetadata(self.stack, path, self.sparkSession, extraMetadata=facts)
        for i, model in enumerate([*self.stack.bases, self.stack.meta]):
            model.write().save(f"{path}/stages/{i}")


class _StackReader(MLReader):
    def load(self, path: str) -> StackedModel:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        *bases, meta = [DefaultParamsReader.loadParamsInstance(f"{path}/stages/{i}", self.sparkSession) for i in range(facts["members"] + 1)]
        stack = StackedModel(bases, meta, facts["problem"], facts["classes"])
        stack._resetUid(facts["uid"])
        return stack


def fit_stack(data: DataFrame, members: list[CvResult], problem: str, classes: int = 2, trainer: Trainer | None = None, without: tuple = ()) -> StackedModel:
    if trainer is None:
        with Trainer(data, problem, classes) as own:
            return fit_stack(data, members, problem, classes, own, without)
    metas = _meta_columns(members, classes, problem)
    oof = out_of_fold(data, members, problem, classes, trainer, without)
    if trainer.rows <= trainer.large or problem != "regression":
        oof = cut_lineage(oof)  # read by several passes; least squares on a large table takes one
    meta = _fit_meta(VectorAssembler(inputCols=metas, outputCol="meta").transform(oof), problem)
    bases = [trainer.fit(m.model, m.params, without) for m in members]
    return StackedModel(bases, meta, problem, classes)


def stack_scores(data: DataFrame, members: list[CvResult], problem: str, folds: int | None = None, classes: int = 2) -> CvResult:
    """Nested evaluation: the stack is fitted anew without each fold and scored on it."""
    scores = []
    with Trainer(data, problem, classes) as trainer:
        for f in trainer.folds(folds):
            stacked = fit_stack(data, members, problem, classes, trainer, (f,))
            value = stacked.transform(data.where(F.col("fold") == f)).agg(metric(problem)).first()[0]
            if value is not None:
                scores.append(float(value))
    return CvResult(STACK, scores, {"members": [m.model for m in members]})


# -- leaderboard --------------------------------------------------------------------------------------

LEADERBOARD_SCHEMA = "run_id string, model string, params map<string,string>, mean double, std double, tuned boolean, status string"


def leaderboard(spark: SparkSession, run_id: str, results: list[CvResult]) -> DataFrame:
    rows = [
        (run_id, r.model, {k: str(v) for k, v in r.params.items()}, None if not r.scores else r.mean, None if not r.scores else r.std, r.tuned, r.status)
        for r in results
    ]
    return spark.createDataFrame(rows, LEADERBOARD_SCHEMA).orderBy(F.desc_nulls_last("mean"), "model")


def fold_scores_board(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, model, mean, std, folds) from one row per run, model and fold."""
    return scores.groupBy(run, "model").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("folds")
    )


def best_model(board: DataFrame, run: str = "run_id") -> DataFrame:
    """Best model per run by mean; a stack wins only if it is strictly better than every single model."""
    order = F.struct(
        F.col("mean"), (F.col("model") != STACK).cast("int").alias("single"),
        # on equal means the first name wins: max over the negated order is not possible for text, so min_by below
    )
    top = board.where(F.col("mean").isNotNull()).groupBy(run).agg(F.max(order).alias("top"))
    tied = board.join(top, run).where((F.col("mean") == F.col("top.mean")) & ((F.col("model") != STACK).cast("int") == F.col("top.single")))
    return tied.groupBy(run).agg(F.min("model").alias("model"), F.max("mean").alias("mean"))


# -- error analysis -----------------------------------------------------------------------------------


def error_stats(df: DataFrame, y: str, prediction: str) -> DataFrame:
    error = F.col(y).cast("double") - F.col(prediction).cast("double")
    return df.agg(
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.max(F.abs(error)).alias("max_error"),
    )


def largest_errors(df: DataFrame, key: list[str], y: str, prediction: str, n: int = 100) -> DataFrame:
    error = F.abs(F.col(y).cast("double") - F.col(prediction).cast("double")).alias("abs_error")
    return df.select(*key, y, prediction, error).orderBy(F.desc("abs_error"), *key).limit(n)


def error_correlations(df: DataFrame, features: list[str], y: str, prediction: str) -> DataFrame:
    """(feature, r): correlation of each feature with the absolute error, one aggregate."""
    error = F.abs(F.col(y).cast("double") - F.col(prediction).cast("double"))
    wide = df.agg(*[F.corr(F.col(f).cast("double"), error).alias(f"r{i}") for i, f in enumerate(features)])
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r")) for i, f in enumerate(features)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("r").isNotNull() & ~F.isnan("r"))
