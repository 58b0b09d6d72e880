"""Training of hazard classifiers in passes over the rows: logistic regressions and networks with two hidden layers of ReLU units.

A step is one Spark job: tasks add up the gradients of their Arrow batches, the sums meet by parameter, and the driver, which holds the
parameters anyway, takes the step. Sums are added as whole multiples of 2^-32, so the order in which tasks end changes nothing.
The optimiser's state stays with the parameters: two fits of five epochs are one of ten, bit for bit.
"""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.curves import as_arrow, as_numpy
from hazardloom.session import delete, scratch_path

ROWS, UNIT = 10_000, 2.0**32  # rows multiplied at once; sums are whole multiples of 1 / UNIT
SOLVERS = ("adam", "sgd", "newton")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Network:
    """Parameters, settings and optimiser state. ``sizes`` are the units of the layers, the last one a single sigmoid unit."""

    sizes: list[int]
    theta: np.ndarray
    solver: str = "adam"
    lr: float = 1e-3
    l2: float = 0.0
    batches: int = 4
    steps: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    epoch_seconds: list[float] = field(default_factory=list)

    def __post_init__(self):
        if self.solver not in SOLVERS or self.solver == "newton" and len(self.sizes) > 2:
            raise ValueError(f"the solver must be one of {SOLVERS}, 'newton' only without hidden units")
        self.theta = np.array(self.theta, dtype=float)
        self.m, self.v = (np.zeros_like(self.theta) if s is None else np.array(s, dtype=float) for s in (self.m, self.v))

    @staticmethod
    def new(n_inputs: int, hidden_dim: int | None = None, seed: int = 42, **settings) -> "Network":
        """Without hidden units all starts at 0, else uniformly within 1 / sqrt(inputs of the layer)."""
        sizes = [n_inputs, 1] if hidden_dim is None else [n_inputs, hidden_dim, hidden_dim, 1]
        r = np.random.default_rng(seed)
        parts = [r.uniform(-1, 1, (i + 1) * o) / np.sqrt(i) for i, o in zip(sizes, sizes[1:])]
        return Network(sizes, np.zeros(n_inputs + 1) if hidden_dim is None else np.concatenate(parts), **settings)

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights as inputs x outputs, bias) of every layer."""
        flat, at, out = self.theta if flat is None else flat, 0, []
        for i, o in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + i * o].reshape(i, o), flat[at + i * o : at + (i + 1) * o]))
            at += (i + 1) * o
        return out

    def penalised(self) -> np.ndarray:
        """1 for weights, 0 for biases."""
        mark = np.ones_like(self.theta)
        for _, bias in self.layers(mark):
            bias[:] = 0
        return mark

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the log losses of the rows and of their gradients, without penalty."""
        layers, held = self.layers(), [x]
        for i, (w, b) in enumerate(layers):
            z = held[-1] @ w + b
            held.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
        z = held[-1][:, 0]
        back = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)[:, None]
        parts = []
        for i in reversed(range(len(layers))):
            parts[:0] = [(held[i].T @ back).ravel(), back.sum(axis=0)]
            if i:
                back = (back @ layers[i][0].T) * (held[i] > 0)
        return float((np.logaddexp(0, z) - y * z).sum()), np.concatenate(parts)

    def curvature(self, x: np.ndarray) -> np.ndarray:
        """Sum of the second derivatives of a model without hidden units, flat."""
        one = np.column_stack([x, np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(one @ self.theta, -700, 700)))
        return ((one * (p * (1 - p))[:, None]).T @ one).ravel()

    def penalty(self) -> float:
        return float(self.l2 / 2 * (self.penalised() * self.theta**2).sum())

    def step(self, gradient: np.ndarray) -> None:
        """One step of the solver along the mean gradient of a batch."""
        g = gradient + self.l2 * self.penalised() * self.theta
        self.steps += 1
        if self.solver == "sgd":
            self.theta = self.theta - self.lr * g
            return
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.theta = self.theta - self.lr * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)

    def facts(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}


def _whole(parts: list) -> np.ndarray:
    values = np.rint(np.concatenate([np.atleast_1d(p) for p in parts]) * UNIT)
    if not np.isfinite(values).all() or np.abs(values).max() >= 2.0**62:
        raise ArithmeticError("sums are not finite or too large: values are missing, or the fit diverges and needs a smaller lr")
    return values.astype(np.int64)


def total(rows: DataFrame, net: Network, curvature: bool = False) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(rows, loss, gradient, second derivatives) summed over rows whose columns are the inputs and, last, the label."""

    def each(batches):
        held = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = np.column_stack([as_numpy(c) for c in b.columns])
                loss, gradient = net.sums(x[:, :-1], x[:, -1])
                new = _whole([float(len(x)), loss, gradient, *([net.curvature(x[:, :-1])] if curvature else [])])
                if len(held) and (np.abs(held) + np.abs(new)).max() >= 2**62:
                    yield _numbered(held)
                    held = np.zeros(0, dtype=np.int64)
                held = new if not len(held) else held + new
        if len(held):
            yield _numbered(held)

    # one row per task and parameter; one row per parameter comes back
    sums = rows.mapInArrow(each, "i int, v bigint").groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("v")).collect()
    if not sums:
        return 0, 0.0, np.zeros_like(net.theta), np.zeros(0)
    flat = np.zeros(len(sums))
    for r in sums:
        flat[r.i] = float(r.v) / UNIT
    end = 2 + len(net.theta)
    return round(flat[0]), flat[1], flat[2:end], flat[end:]


def _numbered(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([as_arrow(np.arange(len(values), dtype=np.int32)), as_arrow(values)], names=["i", "v"])


class Batches:
    """The rows of a fit, written once: inputs, label, and the number of the batch that they belong to, by a hash of ``key``.

    Rows lie sorted in their files, so that sums inside a task come out alike in every fit over the same rows.
    """

    def __init__(self, rows: DataFrame, inputs: list, label, key: list, n: int):
        self.spark, self.n = rows.sparkSession, n
        self.names = [f"x{i}" for i in range(len(inputs))] + ["y"]
        self.path = scratch_path(self.spark, "batches")
        cols = [c.cast("double").alias(x) for c, x in zip([*inputs, label], self.names, strict=True)]
        dealt = rows.select(*cols, F.pmod(F.xxhash64(*key), F.lit(n)).alias("batch"))
        dealt.sortWithinPartitions("batch", *self.names).write.partitionBy("batch").parquet(self.path)
        self.table = self.spark.read.parquet(self.path)
        self.present = sorted(r.batch for r in self.table.select("batch").distinct().collect())  # n at most

    def batch(self, i: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={i}").select(*self.names)

    def all(self) -> DataFrame:
        return self.table.select(*self.names)

    def discard(self) -> None:
        delete(self.spark, self.path)


def train(batches: Batches, net: Network, epochs: int) -> list[float]:
    """Change ``net`` by ``epochs`` passes over the batches; the mean loss with penalty of each pass, as its steps saw it."""
    if net.solver == "newton":
        return _newton(batches, net, epochs)
    history = []
    for _ in range(epochs):
        started, seen, loss = time.monotonic(), 0, 0.0
        for i in batches.present:
            n, l, gradient, _ = total(batches.batch(i), net)
            loss, seen = loss + l + n * net.penalty(), seen + n
            net.step(gradient / n)
        history.append(float(loss / seen) if seen else 0.0)
        net.epoch_seconds.append(time.monotonic() - started)
    return history


def _newton(batches: Batches, net: Network, epochs: int, tiny: float = 1e-9) -> list[float]:
    """Newton steps over all rows, halved where one raised the loss; ends early once steps are tiny."""
    history, before = [], None
    mark = net.penalised()
    for _ in range(epochs):
        started = time.monotonic()
        n, loss, gradient, second = total(batches.all(), net, curvature=True)
        if not n:
            break
        now = loss / n + net.penalty()
        history.append(float(now))
        net.epoch_seconds.append(time.monotonic() - started)
        if before is not None and now > before[0] + 1e-12:
            net.theta = (net.theta + before[1]) / 2
            continue
        before = now, net.theta
        size = len(net.theta)
        steep = second.reshape(size, size) / n + np.diag(net.l2 * mark)
        step = np.linalg.lstsq(steep, gradient / n + net.l2 * mark * net.theta, rcond=None)[0]
        if np.abs(step).max() < tiny:
            break
        net.theta, net.steps = net.theta - step, net.steps + 1
    if before is not None and history[-1] > before[0]:
        net.theta = before[1]
    return history
