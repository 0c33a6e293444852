"""Fit a feature transformation once, apply it to any batch or stream.

Fitting reads the table a fixed number of times, whatever the number of columns: one wide profile
aggregate, one count of values, one or two passes for exact medians. What is fitted is one small row per
column, which becomes literals in the transform, and a vocabulary table, which is joined. The transform is
one projection plus a join per encoded column, so Catalyst prunes features nobody selects.
"""

from __future__ import annotations

import json
import sys
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tabloom.functions import derived
from tabloom.functions.hashing import bucket
from tabloom.functions.numeric import (
    NumericConfig, NumericParams, equal_width_edges, filled_value, numeric_features, quantile_edges, to_numeric, usable_edges,
)
from tabloom.functions.temporal import DateTimeConfig, TemporalParams, datetime_features, day_first_votes, parse
from tabloom.functions.text import TextConfig, TextParams, text_features
from tabloom.operators import tfidf, vocab as vocabulary
from tabloom.operators.folds import broadcast_if_small
from tabloom.operators.infer import typed_profile
from tabloom.operators.quantiles import exact_medians, exact_quantiles
from tabloom.operators.vocab import CategoricalConfig
from tabloom.session import cut_lineage

CONSTANT = "__constant__"
MAX_DOUBLE = sys.float_info.max


@dataclass(frozen=True)
class EngineConfig:
    numeric: NumericConfig = NumericConfig()
    categorical: CategoricalConfig = CategoricalConfig()
    text: TextConfig = TextConfig()
    datetime: DateTimeConfig = DateTimeConfig()
    interactions: tuple[tuple[str, str], ...] = ()
    specs: tuple[dict, ...] = ()
    type_hints: dict = field(default_factory=dict)
    keep: tuple[str, ...] = ()
    exclude_ids: bool = True
    compat: bool = False
    exact_distinct: bool | str = "auto"
    broadcast_bytes: int = vocabulary.BROADCAST_BYTES


@dataclass(frozen=True)
class CategoryParams:
    column: str
    size: int
    bytes: int
    other_code: int | None
    has_null: bool
    categories: tuple[str, ...] = ()
    rest_mean: float | None = None  # target mean of the values outside the vocabulary, of all rows where there are none
    null_mean: float | None = None  # target mean of the rows without a value, of all rows where there are none


def coerce_fill_zero(col: Column) -> Column:
    """A finite double: nulls, NaN and infinities become 0."""
    return F.coalesce(to_numeric(col), F.lit(0.0))


def finite_doubles(df: DataFrame, features: list[str]) -> DataFrame:
    """All features as finite doubles, 0 where there is no value. Whole numbers and flags need no test for infinity."""
    types = {f.name: f.dataType for f in df.schema.fields}
    done = {}
    for name in features:
        col = F.col(f"`{name}`")
        fractional = isinstance(types[name], (T.FloatType, T.DoubleType))
        # NaN compares above infinity, so one range test takes out both
        value = F.when(col.between(-MAX_DOUBLE, MAX_DOUBLE), col) if fractional else col.try_cast("double")
        done[name] = F.coalesce(value, F.lit(0.0))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in done], *[done[n].alias(n) for n in features])


class FeatureEngine(Estimator):
    """``fit`` a table; the result is a ``FeatureModel`` with the same output columns for every later batch."""

    def __init__(self, config: EngineConfig = EngineConfig(), target: str | None = None):
        super().__init__()
        self.config = config
        self.target = target

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        cfg = self.config
        source = dataset.drop(*[c for c in cfg.keep if c != self.target])
        profiled = typed_profile(source, cfg.compat, cfg.exact_distinct, cfg.type_hints)
        rows = {r["column"]: r for r in sorted(profiled.collect(), key=lambda r: r["position"])}
        used = {
            c: r for c, r in rows.items()
            if c != self.target and r["detected_type"] != "empty" and not (cfg.exclude_ids and r["detected_type"] == "id")
        }
        by_type: dict[str, list[str]] = {"numerical": [], "text": [], "datetime": [], "categorical": []}
        for c, r in used.items():
            by_type[r["detected_type"] if r["detected_type"] in by_type else "categorical"].append(c)
        pairs = [(a, b) for a, b in cfg.interactions if a in source.columns and b in source.columns]
        measured = list(dict.fromkeys(by_type["numerical"] + [c for p in pairs for c in p]))
        medians = exact_medians(
            source, {c: to_numeric(F.col(c)) for c in measured},
            # the profile has counted the numeric columns; texts must be counted after conversion
            sizes={c: rows[c]["present"] for c in measured} if all(rows[c]["kind"] == "numeric" for c in measured) else None,
        )
        numeric = self._fit_numeric(source, by_type["numerical"], used, medians)
        temporal = self._fit_temporal(source, by_type["datetime"], used)
        categories, vocab = self._fit_categories(source, by_type["categorical"], used)
        texts = {c: TextParams(c, used[c]["nulls"] > 0) for c in by_type["text"]}
        terms = self._fit_terms(source, by_type["text"])
        fills = {c: (medians[c] if medians[c] is not None else 0.0) for p in pairs for c in p}
        roles = {c: r["detected_type"] for c, r in rows.items()}
        return FeatureModel(
            cfg, self.target, list(used), roles, numeric, temporal, categories, texts, terms, pairs, fills,
            sorted(set(source.columns)), vocab,
        )

    def _fit_numeric(self, df: DataFrame, columns: list[str], rows: dict, medians: dict) -> dict[str, NumericParams]:
        cfg = self.config.numeric
        textual = [c for c in columns if rows[c]["kind"] not in ("numeric", "boolean")]
        cast = {}
        if textual:  # numbers given as text: their statistics are those of the converted values
            cast = df.agg(
                *[e for i, c in enumerate(textual) for e in (
                    F.avg(to_numeric(F.col(c))).alias(f"mean{i}"), F.stddev_pop(to_numeric(F.col(c))).alias(f"std{i}"),
                    F.min(to_numeric(F.col(c))).alias(f"min{i}"), F.max(to_numeric(F.col(c))).alias(f"max{i}"),
                )]
            ).first().asDict()
        facts, bins = {}, {}
        for c in columns:
            r = rows[c]
            if c in textual:
                i = textual.index(c)
                mean, std, low, high = (cast[f"{k}{i}"] for k in ("mean", "std", "min", "max"))
            else:
                mean, std = r["mean"], (r["var_pop"] ** 0.5 if r["var_pop"] is not None else None)
                low, high = r["min"], r["max"]
            edges: tuple[float, ...] = ()
            if cfg.enable_binning and low is not None:
                edges = usable_edges(equal_width_edges(low, high, r["distinct"], cfg.n_bins))
                if not edges:
                    k = min(cfg.n_bins, max(2, r["distinct"]))
                    bins[c] = [i / k for i in range(k + 1)]
            facts[c] = (mean, std, low, high, edges)
        found = exact_quantiles(df, {c: to_numeric(F.col(c)) for c in bins}, bins)
        out = {}
        for c, (mean, std, low, high, edges) in facts.items():
            if found.get(c):
                edges = usable_edges(quantile_edges(found[c]))
            out[c] = NumericParams(c, medians[c], mean, std, low, high, low is not None and low > 0, rows[c]["nulls"] > 0, edges)
        return out

    def _fit_temporal(self, df: DataFrame, columns: list[str], rows: dict) -> dict[str, TemporalParams]:
        if not columns:
            return {}
        kinds = {c: "epoch" if rows[c]["kind"] == "numeric" else "string" if rows[c]["kind"] == "string" else "timestamp" for c in columns}
        units = {c: rows[c]["epoch_unit"] or "s" for c in columns}
        # texts are read both ways in the one pass; the column's own values decide which way holds
        lows = df.agg(*[e for i, c in enumerate(columns) for e in (
            F.min(parse(F.col(c), kinds[c], units[c])).alias(f"m{i}"),
            *([F.min(parse(F.col(c), "string", None, True)).alias(f"d{i}"), *(v.alias(f"{w}{i}") for w, v in zip("ab", day_first_votes(F.col(c))))] if kinds[c] == "string" else []),
        )]).first().asDict()
        out = {}
        for i, c in enumerate(columns):
            day_first = kinds[c] == "string" and lows[f"a{i}"] > lows[f"b{i}"]
            out[c] = TemporalParams(c, kinds[c], units[c] if kinds[c] == "epoch" else None, lows[f"d{i}" if day_first else f"m{i}"], rows[c]["nulls"] > 0, day_first)
        return out

    def _fit_categories(self, df: DataFrame, columns: list[str], rows: dict) -> tuple[dict[str, CategoryParams], DataFrame | None]:
        if not columns:
            return {}, None
        cfg = self.config.categorical
        vocab = vocabulary.fit_vocabulary(df, columns, cfg)
        fallback: dict[str, tuple[float | None, float | None]] = {}
        if cfg.encoding_method == "target" and self.target:
            vocab = cut_lineage(self._with_target_means(df, vocab, columns))
            fallback = self._fallback_means(df, vocab, columns)
        sizes = vocabulary.vocabulary_size(vocab)
        others = {
            r["column"]: r["code"]
            for r in vocab.where("value IS NULL").select("column", "code").collect()
        } if cfg.limit_codes else {}
        listed: dict[str, tuple[str, ...]] = {}
        if cfg.encoding_method == "onehot":
            # at most max_categories rows per column by construction
            tops = vocabulary.top_categories(vocab.select("column", F.coalesce("value", F.lit(vocabulary.OTHER)).alias("value"), "cnt").groupBy("column", "value").agg(F.sum("cnt").alias("cnt")), cfg.max_categories)
            for r in tops.orderBy("column", "value").collect():
                listed[r["column"]] = listed.get(r["column"], ()) + (r["value"],)
        params = {
            c: CategoryParams(c, *sizes.get(c, (0, 0)), others.get(c), rows[c]["nulls"] > 0, listed.get(c, ()), *fallback.get(c, (None, None))) for c in columns
        }
        return params, vocab

    def _with_target_means(self, df: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
        y = F.col(self.target).cast("double")
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        means = (
            df.select(F.explode(entries).alias("e"), y.alias("y")).groupBy("e.column", "e.value").agg(F.avg("y").alias("target_mean"), F.count("y").alias("target_n"))
        )
        return vocab.join(means, ["column", "value"], "left")

    def _fallback_means(self, df: DataFrame, vocab: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
        """Per column the target means of the values outside the vocabulary and of the nulls; one pass and a sum over the vocabulary."""
        y = F.col(self.target).cast("double")
        sums = df.agg(
            F.avg(y).alias("mean"),
            *[e for i, c in enumerate(columns) for e in (
                F.sum(F.when(F.col(c).isNotNull(), y)).alias(f"s{i}"), F.count(F.when(F.col(c).isNotNull(), y)).alias(f"n{i}"), F.avg(F.when(F.col(c).isNull(), y)).alias(f"z{i}"))],
        ).first()
        inside = {r["column"]: (r["s"] or 0.0, r["n"] or 0) for r in vocab.groupBy("column").agg(F.sum(F.col("target_mean") * F.col("target_n")).alias("s"), F.sum("target_n").alias("n")).collect()}
        out = {}
        for i, c in enumerate(columns):
            s, n = (sums[f"s{i}"] or 0.0) - inside.get(c, (0.0, 0))[0], sums[f"n{i}"] - inside.get(c, (0.0, 0))[1]
            out[c] = (s / n if n else sums["mean"], sums["mean"] if sums[f"z{i}"] is None else sums[f"z{i}"])
        return out

    def _fit_terms(self, df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, float]]]:
        if not self.config.text.enable_tfidf:
            return {}
        # at most max_tfidf_features rows per text column
        return {
            c: [(r["term"], r["idf"]) for r in tfidf.fit_terms(df, c, self.config.text).orderBy("idx").collect()]
            for c in columns
        }

    def fit_transform(self, df: DataFrame, key: str | None = None) -> tuple[FeatureModel, DataFrame]:
        """Target encodings of the training rows come from the other folds; ``key`` (kept in the result) deals the folds."""
        model = self.fit(df)
        features = model.transform(df)
        if self.config.categorical.encoding_method != "target" or not model.categories:
            return model, features
        if key is None or key not in features.columns:
            raise ValueError("target encodings of training rows need a key among the kept columns")
        return model, model.encode_out_of_fold(df, features, key)


class FeatureModel(Model):
    """Fitted transformation. ``transform`` keeps the ``keep`` columns and the target where the batch has them."""

    def __init__(
        self, config: EngineConfig, target: str | None, columns: list[str], roles: dict[str, str],
        numeric: dict[str, NumericParams], temporal: dict[str, TemporalParams], categories: dict[str, CategoryParams],
        texts: dict[str, TextParams], terms: dict[str, list[tuple[str, float]]], pairs: list[tuple[str, str]],
        fills: dict[str, float], available: list[str], vocab: DataFrame | None, selected: list[str] | None = None,
    ):
        super().__init__()
        self.config = config
        self.target = target
        self.columns = columns
        self.roles = roles
        self.numeric = numeric
        self.temporal = temporal
        self.categories = categories
        self.texts = texts
        self.terms = terms
        self.pairs = pairs
        self.fills = fills
        self.available = available
        self.vocab = vocab
        self.selected = selected
        plan = derived.plan_specs(list(config.specs), set(available), set())
        self.spec_columns, self.spec_report = plan.columns, {"created": plan.created, "failed": plan.failed}

    # -- what comes out -------------------------------------------------------------------------

    def _outputs(self) -> list[tuple[str, str, str, Column]]:
        """(source, processor, feature, expression) in output order."""
        cfg = self.config
        out: list[tuple[str, str, str, Column]] = []
        for c in self.columns:
            if c in self.numeric:
                made, processor = numeric_features(self.numeric[c], cfg.numeric, F.col(f"__n_{c}")), "numeric"
            elif c in self.temporal:
                made, processor = datetime_features(self.temporal[c], cfg.datetime, F.col(f"__t_{c}")), "datetime"
            elif c in self.texts:
                made, processor = text_features(self.texts[c], cfg.text), "text"
            else:
                made, processor = self._category_features(self.categories[c]), "categorical"
            out += [(c, processor, name, expr) for name, expr in made.items()]
            for i in range(len(self.terms.get(c, []))):
                out.append((c, "tfidf", f"{c}_tfidf_{i}", F.get(F.col(f"__tfidf_{c}"), F.lit(i))))
        for a, b in self.pairs:
            expr = derived.interaction(to_numeric(F.col(a)), to_numeric(F.col(b)), self.fills[a], self.fills[b])
            out.append((f"{a},{b}", "interaction", f"{a}_x_{b}", expr))
        taken = {name for _, _, name, _ in out}
        for name, expr in self.spec_columns.items():
            unique = derived.unique_name(name, taken)
            taken.add(unique)
            out.append(("*", "derived", unique, expr))
        return out or [("*", "constant", CONSTANT, F.lit(1.0))]

    def _category_features(self, p: CategoryParams) -> dict[str, Column]:
        cfg, c = self.config.categorical, p.column
        raw, code, cnt = F.col(c), F.col(f"__v_{c}_code"), F.col(f"__v_{c}_cnt")
        # reserved codes after the vocabulary: unknown values, then nulls
        unknown = p.other_code if p.other_code is not None else p.size
        out = {
            f"{c}_encoded": F.when(raw.isNull(), F.lit(p.size + 1)).otherwise(F.coalesce(code, F.lit(unknown)))
        }
        frequency = F.coalesce(F.when(F.col(f"__v_{c}_kept"), cnt), F.lit(0))
        if cfg.enable_frequency:
            out[f"{c}_frequency"] = frequency
        if cfg.enable_rarity:
            out[f"{c}_is_rare"] = (frequency < cfg.min_frequency).cast("int")
        if cfg.encoding_method == "onehot":
            out.update(vocabulary.one_hot(raw.cast("string"), list(p.categories), c))
        if cfg.encoding_method == "target" and self.target:
            out[f"{c}_target"] = F.when(raw.isNull(), F.lit(p.null_mean)).otherwise(F.coalesce(F.col(f"__v_{c}_target_mean"), F.lit(p.rest_mean)))
        if p.has_null:
            out[f"{c}_was_missing"] = raw.isNull().cast("int")
        return out

    @property
    def feature_names(self) -> list[str]:
        names = [name for _, _, name, _ in self._outputs()]
        if self.selected:
            kept = [n for n in names if n in set(self.selected)]
            return kept or names
        return names

    def lineage(self, spark: SparkSession) -> DataFrame:
        """(source, processor, feature, position, selected); columns that gave no feature have a null feature."""
        chosen = set(self.feature_names)
        rows = [(s, p, n, i, n in chosen) for i, (s, p, n, _) in enumerate(self._outputs())]
        rows += [(c, role, None, -1, False) for c, role in self.roles.items() if c not in self.columns and c != self.target]
        return spark.createDataFrame(rows, "source string, processor string, feature string, position int, selected boolean")

    def select(self, features: list[str]) -> FeatureModel:
        """The same fitted state with only these features in the output."""
        return FeatureModel(
            self.config, self.target, self.columns, self.roles, self.numeric, self.temporal, self.categories, self.texts,
            self.terms, self.pairs, self.fills, self.available, self.vocab, list(features),
        )

    # -- transform ------------------------------------------------------------------------------

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wanted = set(self.feature_names)
        outputs = [o for o in self._outputs() if o[2] in wanted]
        sources = {s for s, _, _, _ in outputs}
        df = self._aligned(dataset)
        fields = ["code", "cnt", "kept"] + (["target_mean"] if self.vocab is not None and "target_mean" in self.vocab.columns else [])
        for c, p in self.categories.items():
            if c in sources:
                df = vocabulary.join_vocabulary(
                    df, self.vocab, c, F.col(c).cast("string"), fields, f"__v_{c}_", p.bytes, self.config.broadcast_bytes
                )
        # values all features of a column share are computed once, in a projection of their own
        shared = {f"__n_{c}": filled_value(p) for c, p in self.numeric.items() if c in sources}
        shared.update({f"__t_{c}": parse(F.col(c), p.kind, p.epoch_unit, p.day_first) for c, p in self.temporal.items() if c in sources})
        df = df.withColumns(shared) if shared else df
        for c, terms in self.terms.items():
            if c in sources and terms:
                df = tfidf.tfidf_vectors(df, c, terms, self.config.text, f"__tfidf_{c}")
                df = df.withColumn(f"__tfidf_{c}", vector_to_array(F.col(f"__tfidf_{c}")))
        kept = [c for c in dict.fromkeys([*self.config.keep, *([self.target] if self.target else [])]) if c in dataset.columns]
        return finite_doubles(df.select(*kept, *[expr.alias(name) for _, _, name, expr in outputs]), [o[2] for o in outputs])

    def _aligned(self, dataset: DataFrame) -> DataFrame:
        """A batch may lack columns the model was fitted on: they arrive as nulls."""
        needed = set(self.columns) | {c for p in self.pairs for c in p} | {c for s in self.spec_report["created"] for c in s["inputs"]}
        absent = [c for c in self.available if c in needed and c not in dataset.columns]
        return dataset.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else dataset

    def encode_out_of_fold(self, df: DataFrame, features: DataFrame, key: str, k: int = 5) -> DataFrame:
        """Replace the target encodings of training rows by means taken outside each row's fold."""
        fold = bucket(key, k)
        rows = df.select(F.col(key), fold.alias("__fold"), *[F.col(c).cast("string").alias(f"__c_{c}") for c in self.categories])
        for c in self.categories:
            encoded = vocabulary.target_encoding(df, c, self.target, fold).select(
                F.col("value").alias("__value"), F.col("fold").alias("__f"), F.col("encoded").alias(f"{c}_target")
            )
            # a small table of means is broadcast after counting it; a large one joins by shuffle, where
            # adaptive execution splits the partition of a hot value
            match = F.col(f"__c_{c}").eqNullSafe(F.col("__value")) & (F.col("__fold") == F.col("__f"))
            rows = rows.join(broadcast_if_small(encoded), match, "left").drop("__value", "__f")
        # a value that no other fold has gets what the transform gives an unknown one
        gaps = {c: F.when(F.col(f"__c_{c}").isNull(), F.lit(p.null_mean)).otherwise(F.lit(p.rest_mean)) for c, p in self.categories.items()}
        made = rows.select(key, *[F.coalesce(F.col(f"{c}_target"), gaps[c], F.lit(0.0)).alias(f"{c}_target") for c in self.categories])
        return features.drop(*[f"{c}_target" for c in self.categories]).join(made, key, "left")

    # -- persistence ----------------------------------------------------------------------------

    def save(self, path: str, spark: SparkSession) -> None:
        """State as small tables: one JSON document for the literals, Parquet for vocabulary and lineage."""
        state = {
            "config": asdict(self.config), "target": self.target, "columns": self.columns, "roles": self.roles,
            "numeric": {c: asdict(p) for c, p in self.numeric.items()},
            "temporal": {c: {**asdict(p), "min_ts": round(p.min_ts.timestamp() * 1_000_000) if p.min_ts else None} for c, p in self.temporal.items()},
            "categories": {c: asdict(p) for c, p in self.categories.items()},
            "texts": {c: asdict(p) for c, p in self.texts.items()},
            "terms": self.terms, "pairs": self.pairs, "fills": self.fills, "available": self.available, "selected": self.selected,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        self.lineage(spark).write.mode("overwrite").parquet(f"{path}/feature_lineage")
        if self.vocab is not None:
            self.vocab.write.mode("overwrite").parquet(f"{path}/category_vocab")

    @staticmethod
    def load(path: str, spark: SparkSession) -> FeatureModel:
        from datetime import datetime

        s = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        c = s["config"]
        config = EngineConfig(
            NumericConfig(**c["numeric"]), CategoricalConfig(**c["categorical"]),
            TextConfig(**{**c["text"], "ngram_range": tuple(c["text"]["ngram_range"]),
                          "stop_words": tuple(c["text"]["stop_words"]) if c["text"]["stop_words"] is not None else None}),
            DateTimeConfig(**c["datetime"]), tuple(tuple(p) for p in c["interactions"]), tuple(c["specs"]), c["type_hints"],
            tuple(c["keep"]), c["exclude_ids"], c["compat"], c["exact_distinct"], c["broadcast_bytes"],
        )
        # microseconds since 1970 in UTC, so that the instant is the same wherever the model is loaded
        stamp = lambda v: None if v is None else datetime.fromtimestamp(v // 1_000_000).replace(microsecond=v % 1_000_000)
        return FeatureModel(
            config, s["target"], s["columns"], s["roles"],
            {k: NumericParams(**{**p, "bin_edges": tuple(p["bin_edges"])}) for k, p in s["numeric"].items()},
            {k: TemporalParams(**{**p, "min_ts": stamp(p["min_ts"])}) for k, p in s["temporal"].items()},
            {k: CategoryParams(**{**p, "categories": tuple(p["categories"])}) for k, p in s["categories"].items()},
            {k: TextParams(**p) for k, p in s["texts"].items()},
            {k: [tuple(t) for t in v] for k, v in s["terms"].items()}, [tuple(p) for p in s["pairs"]], s["fills"],
            s["available"], spark.read.parquet(f"{path}/category_vocab") if s["categories"] else None, s["selected"],
        )


# -- assembly of foreign tables ---------------------------------------------------------------------


def align_test(test: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """The training feature columns in training order; absent ones are 0."""
    present = set(test.columns)
    return test.select(
        *(keep or []), *[coerce_fill_zero(F.col(f)).alias(f) if f in present else F.lit(0.0).alias(f) for f in features]
    )


def stack_tables(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both tables in one, with ``is_train``; columns one side lacks are null."""
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)), allowMissingColumns=True)


def split_stacked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("is_train")).drop("is_train"), df.where(~F.col("is_train")).drop("is_train")


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) with the population deviation, in one aggregate."""
    wide = df.agg(*[e for i, f in enumerate(features) for e in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}"))])
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, f in enumerate(features)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
