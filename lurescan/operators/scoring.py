"""Decision rules on scores, Spark ML scorers and the plug-in for external models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: rule for generated answers ------------------------------------------------------
ANSWER_PROBABILITY = 0.95


def threshold_pred(proba: Column, threshold: Column | float) -> Column:
    """1 (benign) if the probability of class 1 reaches the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (proba >= limit).cast("int")


def evaluation_pred(proba: Column) -> Column:
    return (proba > 0.5).cast("int")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda w: w / total)


def argmax_pred(logits: Column) -> tuple[Column, Column]:
    """Class of the largest probability (the first on a tie) and that probability."""
    probabilities = softmax(logits)
    best = F.array_max(probabilities)
    return (F.array_position(probabilities, best) - 1).cast("int"), best


def answer_pred(answer: Column) -> tuple[Column, Column]:
    """Class and probability from a generated answer."""
    text = F.trim(F.regexp_replace(F.lower(F.trim(answer)), "[.?]", ""))
    phishing, benign = text.startswith("ph"), text.startswith("ben")
    return (
        F.when(benign, 1).otherwise(0),
        F.when(phishing | benign, F.lit(ANSWER_PROBABILITY)).otherwise(F.lit(0.0)),
    )


# --- Spark ML scorers on a vector column -----------------------------------------------------------


def _fit(estimator, df: DataFrame, vector: str, weight: str | None):
    prepared = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    if weight:
        estimator = estimator.setWeightCol(weight)
    return estimator.fit(prepared)


def fit_random_forest(df: DataFrame, vector: str = "vector", weight: str | None = None):
    estimator = RandomForestClassifier(numTrees=30, maxDepth=6, seed=42)
    return _fit(estimator, df, vector, weight)


def fit_boosted_trees(df: DataFrame, vector: str = "vector", weight: str | None = None):
    return _fit(GBTClassifier(maxIter=10, maxDepth=4, seed=42), df, vector, weight)


def fit_linear_margin(df: DataFrame, vector: str = "vector", weight: str | None = None):
    return _fit(LinearSVC(maxIter=20), df, vector, weight)


def score_with(model, df: DataFrame, vector: str = "vector", threshold: float = 0.5) -> DataFrame:
    """Add proba (class 1) and pred; a model without probabilities gives its margin's logistic."""
    prepared = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    scored = model.transform(prepared)
    if "probability" in scored.columns:
        proba = vector_to_array("probability")[1]
    else:
        proba = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.withColumn("proba", proba).withColumn(
        "pred", threshold_pred(F.col("proba"), threshold)
    ).drop("features", "rawPrediction", "probability", "prediction")


def feature_importances(model, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """feature, importance of a tree model (one row per input dimension)."""
    values = [float(v) for v in model.featureImportances.toArray()]
    labels = list(names) if names else [f"v{i}" for i in range(len(values))]
    return df.sparkSession.createDataFrame(
        list(zip(labels, values, strict=True)), "feature string, importance double"
    )


def save_model(model, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path).stages[0]


# --- external models and several models ------------------------------------------------------------


def score_external(
    df: DataFrame,
    make_predict_fn: Callable,
    inputs: Sequence[str],
    shapes: Sequence[list[int] | None] | None = None,
    batch_size: int = 512,
) -> DataFrame:
    """Add ``proba`` from a user model that is loaded once per Python worker.

    ``make_predict_fn`` loads the model and returns a function from numpy batches to probabilities.
    ``shapes`` gives the length of each array input, None for a scalar one.
    """
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=list(shapes) if shapes else None,
    )
    return df.withColumn("proba", predict(*[F.col(c) for c in inputs]))


def score_external_models(
    df: DataFrame,
    make_predict_fns: dict[str, Callable],
    models: Sequence[str],
    inputs: Sequence[str],
    shapes: Sequence[list[int] | None] | None = None,
    batch_size: int = 512,
) -> DataFrame:
    """``proba`` and ``model`` for every row and requested user model, in one pass over the rows.

    A Python worker loads each model once and every batch goes to it once, for all models together.
    Model names are those of :func:`score_models`; the loaders those of :func:`score_external`.
    """
    _known(models, make_predict_fns)
    loaders = [make_predict_fns[m] for m in models]
    names = [f"m{i}" for i in range(len(models))]

    def load() -> Callable:
        loaded = [make() for make in loaders]
        return lambda *batch: {name: predict(*batch) for name, predict in zip(names, loaded)}

    predict = predict_batch_udf(
        load,
        return_type=T.StructType([T.StructField(name, T.DoubleType()) for name in names]),
        batch_size=batch_size,
        input_tensor_shapes=list(shapes) if shapes else None,
    )
    columns = [c for c in df.columns if c not in ("proba", "model")]
    scored = df.select(*[F.col(f"`{c}`") for c in columns], predict(*[F.col(c) for c in inputs]).alias("_scores"))
    each = [F.struct(F.col(f"_scores.{n}").alias("proba"), F.lit(m).alias("model")) for n, m in zip(names, models)]
    return scored.select(*[F.col(f"`{c}`") for c in columns], F.inline(F.array(*each)))


def _known(models: Sequence[str], scorers: dict) -> None:
    unknown = [m for m in models if m not in scorers]
    if unknown:
        raise ValueError(f"unknown models {unknown}; known: {sorted(scorers)}")


def score_models(
    df: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], models: Sequence[str]
) -> DataFrame:
    """Rows scored by every requested model, with the model's name.

    The scorers add their columns to the same rows one after the other, so the input is read and its
    features are computed once. A scorer keeps the rows and columns it gets; all add the same columns.
    """
    _known(models, scorers)
    own = [c for c in df.columns if c not in ("proba", "model")]
    scored, each = df.select(*[F.col(f"`{c}`") for c in own]), []
    for i, model in enumerate(models):
        before = set(scored.columns)
        scored = scorers[model](scored)
        added = sorted(c for c in scored.columns if c not in before)
        scored = scored.withColumnsRenamed({c: f"_{i}_{c}" for c in added})
        each.append(F.struct(*[F.col(f"`_{i}_{c}`").alias(c) for c in added], F.lit(model).alias("model")))
    return scored.select(*[F.col(f"`{c}`") for c in own], F.inline(F.array(*each)))
