"""Discrete-time hazard models: fit, continue fitting, predict."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.columns import EPOCHS, HIDDEN_UNITS, PANEL, TIMES, PanelColumns
from hazardloom.functions import linear_hazards, survival_curve
from hazardloom.functions.curves import as_arrays, as_matrix, fillable, linear_fill
from hazardloom.operators.trainer import Batches, Network, train

TIME_INPUT = "time_to_event"
BATCHES = 4  # parts of the rows, with a step after each
_ARRAY = T.ArrayType(T.DoubleType())


def feature_columns(df: DataFrame, cols: PanelColumns = PANEL) -> list[str]:
    """Every column that is no key, time or label."""
    return [c for c in df.columns if c not in cols.not_features() | {TIME_INPUT}]


def training_rows(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """All rows but each device's last one, with the days left until it."""
    left = F.col(cols.lifetime) - F.col(cols.time)
    return df.where(F.col(cols.time) != F.col(cols.lifetime)).withColumn(TIME_INPUT, left)


def scoring_rows(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """All rows but each device's last one, with the true remaining duration and outcome."""
    left = F.col(cols.lifetime) - F.col(cols.time)
    return (
        df.where(F.col(cols.time) != F.col(cols.lifetime))
        .withColumn("duration", left).withColumn(cols.label, F.col(cols.label) == 1)
    )


def inference_rows(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """All rows; no label is needed."""
    return df.drop(cols.label, cols.lifetime)


def assemble(df: DataFrame, inputs: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=inputs, outputCol=output).transform(df)


@dataclass
class HazardModel:
    """A fitted classifier of (features, time) and what is needed to apply it.

    ``time_unit`` divides the time input, so that a network sees it on the scale of its other inputs. ``fitted`` is a ``Network`` of
    the trainer, which also holds its optimiser's state, or a pyspark.ml model. ``version`` is its number once
    it is stored, ``parent`` that of the model it continues.
    """

    features: list[str]
    fitted: object
    time_unit: float = 1.0
    loss: list[float] = field(default_factory=list)
    fit_seconds: float = 0.0
    parent: str | None = None
    version: str | None = None

    @property
    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, bias) of a network's layers, weights as inputs x outputs."""
        if isinstance(self.fitted, Network):
            return self.fitted.layers()
        sizes, flat, at, out = self.fitted.getLayers(), self.fitted.weights.toArray(), 0, []
        for n_in, n_out in zip(sizes, sizes[1:]):
            w = flat[at:at + n_in * n_out].reshape(n_in, n_out)
            at += n_in * n_out
            out.append((w, flat[at:at + n_out]))
            at += n_out
        return out

    @property
    def linear(self) -> tuple[np.ndarray, float] | None:
        """Coefficients and intercept, where the model is linear in its inputs."""
        if isinstance(self.fitted, LogisticRegressionModel):
            return self.fitted.coefficients.toArray(), float(self.fitted.intercept)
        if isinstance(self.fitted, Network) and len(self.fitted.sizes) == 2:
            return self.fitted.theta[:-1], float(self.fitted.theta[-1])
        if isinstance(self.fitted, MultilayerPerceptronClassificationModel) and len(self.fitted.getLayers()) == 2:
            (w, b), = self.layers
            return w[:, 1] - w[:, 0], float(b[1] - b[0])
        return None

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        facts = {"features": self.features, "time_unit": self.time_unit, "loss": self.loss, "fit_seconds": self.fit_seconds,
                 "kind": type(self.fitted).__name__, "parent": self.parent}
        if isinstance(self.fitted, Network):
            facts["network"] = self.fitted.facts()  # text holds doubles exactly
        else:
            self.fitted.write().overwrite().save(os.path.join(path, "model"))
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "facts"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "HazardModel":
        f = json.loads(spark.read.text(os.path.join(path, "facts")).first()[0])
        fitted = Network(**f["network"]) if "network" in f else DefaultParamsReader.loadParamsInstance(os.path.join(path, "model"), spark)
        return HazardModel(f["features"], fitted, f["time_unit"], f["loss"], f["fit_seconds"], f.get("parent"))


def logistic_regression(**params) -> LogisticRegression:
    """Log loss with a small L2 penalty."""
    return LogisticRegression(**{"maxIter": 100, "regParam": 1e-4, "standardization": False, **params})


def neural_network(n_inputs: int, hidden_dim: int = HIDDEN_UNITS, **params) -> MultilayerPerceptronClassifier:
    """Two hidden layers; sigmoid units and a softmax output, fitted by L-BFGS."""
    return MultilayerPerceptronClassifier(
        **{"layers": [n_inputs, hidden_dim, hidden_dim, 2], "maxIter": 100, "seed": 42, "blockSize": 256, **params}
    )


def fit(df: DataFrame, model: str | Estimator = "logistic_regression", features: list[str] | None = None,
        time_unit: float | None = None, cols: PanelColumns = PANEL, epochs: int | None = None, lr: float | None = None,
        solver: str | None = None, **params) -> HazardModel:
    """Fit on prepared rows. ``model`` is 'logistic_regression', 'NN' or any estimator that emits ``probability``.

    ``solver`` is 'adam' or 'sgd', which take steps of ``lr`` after each of ``batches`` parts of the rows, for ``epochs`` passes (see
    ``trainer``); for a logistic regression also 'newton'; or 'l-bfgs', of pyspark.ml, with ``epochs`` iterations at most. A network is
    fitted by 'adam', a logistic regression by 'l-bfgs', unless ``lr`` is given, which means 'adam', or ``maxIter``, which means
    'l-bfgs'. Networks have two hidden layers of ``hidden_dim`` units: ReLU units and one sigmoid output, with 'l-bfgs' sigmoid
    units. ``regParam`` is the L2 penalty (1e-4 for a logistic regression, 0 for a network).
    """
    features = features or feature_columns(df, cols)
    if isinstance(model, Estimator):
        return _run(model, training_rows(df, cols), features, time_unit or 1.0, cols)
    if model not in ("logistic_regression", "NN"):
        raise ValueError("only 'logistic_regression' and 'NN' are named; pass an estimator for others")
    linear = model == "logistic_regression"
    if solver is None:
        solver = "l-bfgs" if "maxIter" in params else "adam" if lr is not None or not linear else "l-bfgs"
    if solver == "l-bfgs":
        if epochs is not None:
            params["maxIter"] = epochs
        estimator = logistic_regression(**params) if linear else neural_network(len(features) + 1, **params)
        return _run(estimator, training_rows(df, cols), features, time_unit or (1.0 if linear else float(max(TIMES))), cols)
    net = Network.new(
        len(features) + 1, None if linear else params.pop("hidden_dim", HIDDEN_UNITS), params.pop("seed", 42), solver=solver,
        lr=1e-3 if lr is None else lr, l2=params.pop("regParam", 1e-4 if linear else 0.0), batches=params.pop("batches", BATCHES),
    )
    if params:
        raise TypeError(f"unknown parameters: {sorted(params)}")
    return _train(net, df, features, time_unit or float(max(TIMES)), epochs or EPOCHS, cols)


def _train(net: Network, df: DataFrame, features: list[str], unit: float, epochs: int, cols: PanelColumns) -> HazardModel:
    inputs = [*[F.col(f"`{c}`") for c in features], F.col(TIME_INPUT) / F.lit(unit)]
    batches = Batches(training_rows(df, cols), inputs, F.col(cols.label), [cols.id, cols.time], net.batches)
    started = time.monotonic()
    try:
        loss = train(batches, net, epochs)
    finally:
        batches.discard()
    return HazardModel(features, net, unit, loss, time.monotonic() - started)


def _run(estimator: Estimator, rows: DataFrame, features: list[str], unit: float, cols: PanelColumns) -> HazardModel:
    timed = rows.select(
        *features, (F.col(TIME_INPUT) / F.lit(unit)).alias(TIME_INPUT), F.col(cols.label).cast("double").alias("label")
    )
    examples = assemble(timed, [*features, TIME_INPUT]).select("features", "label")
    # the optimizer reads its input once per iteration; a lost block is recomputed from the plan
    examples.persist()
    started = time.monotonic()
    try:
        fitted = estimator.fit(examples)
    finally:
        examples.unpersist()
    summary = getattr(fitted, "summary", None)
    summary = summary() if callable(summary) else summary
    history = [float(x) for x in getattr(summary, "objectiveHistory", [])]
    return HazardModel(features, fitted, unit, history, time.monotonic() - started)


def fine_tune(model: HazardModel, df: DataFrame, epochs: int | None = None, lr: float | None = None, max_iter: int = 100,
              cols: PanelColumns = PANEL, **params) -> HazardModel:
    """Continue from the model's weights on new rows, with the same penalty.

    A trained network goes on with its solver's state for ``epochs`` passes (EPOCHS by default), at another ``lr`` if one is given. A
    logistic regression of pyspark.ml goes on by Newton steps, a network of it by L-BFGS; both take at most ``epochs`` or
    ``max_iter`` passes. The given model is left as it is.
    """
    tuned = _continued(model, df, epochs, lr, max_iter, cols, **params)
    tuned.parent = model.version
    return tuned


def _continued(model: HazardModel, df: DataFrame, epochs: int | None, lr: float | None, max_iter: int, cols: PanelColumns, **params) -> HazardModel:
    linear = model.linear
    if isinstance(model.fitted, Network):
        net = Network(**model.fitted.facts())
        net.epoch_seconds, net.lr = [], net.lr if lr is None else lr
        if params:
            raise TypeError(f"unknown parameters: {sorted(params)}")
        return _train(net, df, model.features, model.time_unit, epochs or EPOCHS, cols)
    if linear is not None:
        coef, intercept = linear
        penalty = params.pop("regParam", model.fitted.getOrDefault("regParam") if model.fitted.hasParam("regParam") else 0.0)
        net = Network([len(coef), 1], np.append(coef, intercept), solver="newton", l2=penalty, batches=1, **params)
        return _train(net, df, model.features, model.time_unit, epochs or max_iter, cols)
    if not isinstance(model.fitted, MultilayerPerceptronClassificationModel):
        raise ValueError("only logistic regressions and networks can be continued")
    estimator = MultilayerPerceptronClassifier(
        **{"layers": model.fitted.getLayers(), "maxIter": epochs or max_iter, "blockSize": 256,
           "initialWeights": Vectors.dense(model.fitted.weights.toArray()), **params}
    )
    return _run(estimator, training_rows(df, cols), model.features, model.time_unit, cols)


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """intercept + sum of weight * column."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in weights.items()], F.lit(float(intercept)))


def network_fill(layers, time_unit: float, times, relu: bool = False) -> Callable[[pa.Array], np.ndarray]:
    """The function from inputs to the hazards of a network on the time grid, one matrix product per layer and batch.

    Hidden units are sigmoid units, or ``relu``; the output is a softmax over two units or one sigmoid unit.
    """
    grid = np.asarray(times, dtype=float) / time_unit
    width = layers[0][0].shape[0] - 1

    def hazards(inputs: pa.Array) -> np.ndarray:
        x = as_matrix(inputs, width)
        w, b = layers[0]
        z = (x @ w[:-1] + b)[:, None, :] + grid[None, :, None] * w[-1]
        with np.errstate(over="ignore"):
            for w, b in layers[1:]:
                z = (np.maximum(z, 0) if relu else 1.0 / (1.0 + np.exp(-z))) @ w + b
            return 1.0 / (1.0 + np.exp(z[..., 0] - z[..., 1] if z.shape[-1] == 2 else -z[..., 0]))

    return hazards


def network_hazards(inputs: Column, layers, time_unit: float, times, relu: bool = False) -> Column:
    """Hazards of a network on the time grid, see ``network_fill``."""
    fill = network_fill(layers, time_unit, times, relu)

    @F.arrow_udf(_ARRAY)
    def hazards(inputs: pa.Array) -> pa.Array:
        return as_arrays(fill(inputs))

    return hazards(inputs)


def _in_place(model: HazardModel, df: DataFrame, times) -> tuple[Column, Callable[[pa.Array], np.ndarray]] | None:
    """The column that hazards follow from and the function that computes them, for models that need no row per grid point."""
    linear = model.linear
    if any(isinstance(df.schema[c].dataType, VectorUDT) for c in model.features):
        return None
    if linear is not None:
        coef, intercept = linear
        return linear_score(dict(zip(model.features, coef)), intercept), linear_fill(coef[-1] / model.time_unit, times)
    if isinstance(model.fitted, (Network, MultilayerPerceptronClassificationModel)):
        inputs = F.array(*[F.col(c).cast("double") for c in model.features])
        return inputs, network_fill(model.layers, model.time_unit, times, isinstance(model.fitted, Network))
    return None


def predict_hazard(model: HazardModel, df: DataFrame, times=TIMES, output: str = "hazards") -> DataFrame:
    """Add the array of h(t), t on the grid.

    Linear models and networks over plain columns fill the array in place. Other classifiers, and those with a vector among their
    features, see one row per device, day and grid point
    and are gathered again inside their partition.
    """
    linear = model.linear
    if any(isinstance(df.schema[c].dataType, VectorUDT) for c in model.features):
        return _predict_by_rows(model, df, times, output)
    if linear is not None:
        coef, intercept = linear
        score = linear_score(dict(zip(model.features, coef)), intercept)
        return df.withColumn(output, linear_hazards(score, coef[-1] / model.time_unit, times))
    if isinstance(model.fitted, (Network, MultilayerPerceptronClassificationModel)):
        inputs = F.array(*[F.col(c).cast("double") for c in model.features])
        return df.withColumn(output, network_hazards(inputs, model.layers, model.time_unit, times, isinstance(model.fitted, Network)))
    return _predict_by_rows(model, df, times, output)


def _predict_by_rows(model: HazardModel, df: DataFrame, times, output: str) -> DataFrame:
    """Hazards of any classifier: it sees one row per input row and grid point, which stay together in their partition.

    The input row travels with its first point only, and the points are put together where they are: no shuffle, no join, so
    missing or repeated keys do no harm.
    """
    points = len(times)
    grid = F.posexplode(F.array(*[F.lit(float(t)) for t in times])).alias("_i", "_t")
    row = F.when(F.col("_i") == 0, F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_row")
    long = df.select("*", grid).select(row, *model.features, (F.col("_t") / F.lit(model.time_unit)).alias(TIME_INPUT))
    scored = model.fitted.transform(assemble(long, [*model.features, TIME_INPUT]))
    flat = scored.select("_row", vector_to_array("probability")[1].alias("_h"))

    def gather(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            n = t.num_rows // points
            rest = t.slice(n * points)
            if n:
                first = t.column("_row").combine_chunks().take(pa.array(np.arange(n) * points))
                flat_h = t.column("_h").slice(0, n * points).combine_chunks()
                hazards = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * points, pa.int32()), flat_h)
                yield pa.RecordBatch.from_arrays([first, hazards], names=["_row", "_hazards"])

    kind = T.StructType([T.StructField("_row", df.schema), T.StructField("_hazards", _ARRAY)])
    return flat.mapInArrow(gather, kind).select("_row.*", F.col("_hazards").alias(output))


def predict(model: HazardModel, df: DataFrame, times=TIMES, mode: str = "score", cols: PanelColumns = PANEL) -> DataFrame:
    """(device, time, surv) and, in mode ``score``, the truth (duration, failure) in the same row.

    Mode ``infer`` keeps all rows and needs no label. Curves that are scored as they come from here are computed where they are scored.
    """
    rows = scoring_rows(df, cols) if mode == "score" else inference_rows(df, cols)
    truth = ["duration", cols.label] if mode == "score" else []
    hazards = predict_hazard(model, rows, times)
    curves = hazards.select(cols.id, cols.time, *truth, survival_curve(F.col("hazards"), len(times)).alias("surv"))
    source = _in_place(model, rows, times)
    return fillable(curves, rows.select(cols.id, cols.time, *truth, source[0].alias("surv")), source[1]) if source else curves


def wide(predictions: DataFrame, times=TIMES, cols: PanelColumns = PANEL) -> DataFrame:
    """One column per grid point."""
    return predictions.select(cols.id, cols.time, *[F.col("surv")[i].alias(str(t)) for i, t in enumerate(times)])


def log_loss(label: Column, probability: Column) -> Column:
    """Mean log loss as an aggregate."""
    tiny = 1e-15
    p = F.least(F.greatest(probability, F.lit(tiny)), F.lit(1 - tiny))
    return F.avg(-F.when(label, F.log(p)).otherwise(F.log(1 - p)))
