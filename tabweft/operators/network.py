"""Multilayer networks on NumPy arrays, and their training by Spark.

A network's parameters are one vector. Tasks compute on the rows of their partitions with whole-batch matrix products; the driver
holds a few vectors of the size of the parameters, whatever the number of rows. Two ways of training:

* ``average``: each round every task takes Adam steps on the mini-batches of its rows, starting from the common
  state, and the states are averaged by rows. A round reads the table once, so large tables take few rounds.
* ``sum``: each round reads one of the batches that rows were dealt to, sums the exact gradient over all tasks, and takes one step.
  The result does not depend on partitioning, but for the order of sums.

Vectors of many tasks are joined in a tree of tasks before the driver adds the last ``FAN_IN``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import materialize, ship_package
from tabweft.functions.counter import uniforms

#: Vectors that one task, or the driver, adds up.
FAN_IN = 16
#: Bytes of a state that may be sent to the tasks.
STATE_BYTES = 256 << 20
_STATE = "rows double, loss double, steps double, state binary"


class Dense:
    """A network of named matrices in one vector: ``shapes`` of (name, shape); vectors of one axis are biases and start at 0."""

    def __init__(self, shapes: list[tuple[str, tuple[int, ...]]]):
        self.shapes, self.size, self.places = shapes, 0, {}
        for name, shape in shapes:
            end = self.size + math.prod(shape)
            self.places[name] = (self.size, end, shape)
            self.size = end

    def start(self, seed: int) -> np.ndarray:
        out = np.zeros(self.size)
        for k, (name, shape) in enumerate(self.shapes):
            if len(shape) == 2:
                bound = 1 / math.sqrt(shape[0])
                self.view(out, name)[:] = bound * (2 * uniforms(seed, k, np.arange(shape[0]), shape[1]) - 1)
        return out

    def view(self, vector: np.ndarray, name: str) -> np.ndarray:
        a, b, shape = self.places[name]
        return vector[a:b].reshape(shape)


def silu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times its logistic function, and the derivative."""
    s = 0.5 * (1 + np.tanh(0.5 * x))
    return x * s, s * (1 + x * (1 - s))


def _by_kind(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Sums of the rows of each kind; kinds are numbered from 0 without gaps."""
    if not len(x):
        return x
    order = np.argsort(kind, kind="stable")
    return np.add.reduceat(x[order], np.searchsorted(kind[order], np.arange(kind.max() + 1)))


class Denoiser(Dense):
    """What a noised row was before: a projection of the row plus embeddings of step and class, then hidden layers.

    Embeddings are computed once for each step and class that a batch holds.

    ``forward`` gives the output and what ``backward`` needs for the gradient of the parameters.
    """

    def __init__(self, width: int, embedding: int = 128, hidden: int = 256, layers: int = 3, classes: int = 0):
        if embedding % 2:
            raise ValueError("the width of the embedding must be even")
        self.width, self.embedding, self.layers, self.classes = width, embedding, layers, classes
        shapes: list[tuple[str, tuple[int, ...]]] = [("in", (width, embedding)), ("in_b", (embedding,)), ("t1", (embedding, embedding)), ("t1_b", (embedding,)), ("t2", (embedding, embedding)), ("t2_b", (embedding,))]
        if classes:
            shapes.append(("y", (classes, embedding)))
        below = embedding
        for k in range(layers):
            shapes += [(f"h{k}", (below, hidden)), (f"h{k}_b", (hidden,))]
            below = hidden
        super().__init__([*shapes, ("out", (below, width)), ("out_b", (width,))])

    def waves(self, t: np.ndarray) -> np.ndarray:
        """Cosines and sines of the step."""
        half = self.embedding // 2
        at = t[:, None] * np.exp(-math.log(10_000) / half * np.arange(half))
        return np.concatenate([np.cos(at), np.sin(at)], axis=1)

    def forward(self, p: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        v = lambda name: self.view(p, name)
        steps, at = np.unique(t, return_inverse=True)
        waves = self.waves(steps)
        a, da = silu(waves @ v("t1") + v("t1_b"))
        h = x @ v("in") + v("in_b") + (a @ v("t2") + v("t2_b"))[at]
        found, of, dy = None, None, None
        if self.classes:
            found, of = np.unique(y, return_inverse=True)
            e, dy = silu(v("y")[found])
            h += e[of]
        inputs = []
        for k in range(self.layers):
            inputs.append(h)
            h = np.maximum(h @ v(f"h{k}") + v(f"h{k}_b"), 0)
        return h @ v("out") + v("out_b"), {"x": x, "waves": waves, "a": a, "da": da, "at": at, "found": found, "of": of, "dy": dy, "inputs": inputs, "last": h}

    def backward(self, p: np.ndarray, kept: dict, out: np.ndarray) -> np.ndarray:
        """The gradient, of ``out``, the gradient of the output."""
        grad = np.zeros(self.size, p.dtype)

        def layer(name: str, below: np.ndarray, d: np.ndarray) -> np.ndarray:
            self.view(grad, name)[:] = below.T @ d
            self.view(grad, f"{name}_b")[:] = d.sum(0)
            return d @ self.view(p, name).T

        h, d = kept["last"], layer("out", kept["last"], out)
        for k in reversed(range(self.layers)):
            below = kept["inputs"][k]
            d = layer(f"h{k}", below, d * (h > 0))
            h = below
        if self.classes:
            self.view(grad, "y")[kept["found"]] = _by_kind(d, kept["of"]) * kept["dy"]
        layer("t1", kept["waves"], layer("t2", kept["a"], _by_kind(d, kept["at"])) * kept["da"])
        layer("in", kept["x"], d)
        return grad


@dataclass
class Adam:
    """AdamW: moments of the gradient, and decay of the parameters apart from it. ``state``: parameters and both moments."""

    rate: float = 0.002
    decay: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999

    def step(self, state: np.ndarray, grad: np.ndarray, steps: float, rate: float) -> None:
        p, m, v = state
        m += (1 - self.beta1) * (grad - m)
        v += (1 - self.beta2) * (grad * grad - v)
        p *= 1 - rate * self.decay
        p -= rate * (m / (1 - self.beta1**steps)) / (np.sqrt(v / (1 - self.beta2**steps)) + 1e-8)


@dataclass
class Trainer:
    """Fits a model's parameters to the rows of a table.

    A model has ``columns``, ``arrays(batch)`` and ``gradient(p, arrays, seed, stream)``, which gives the sums of loss and gradient over
    the rows. The learning rate falls linearly; the result is a running mean of the parameters that keeps ``mean_rate`` of
    itself at each step (0: the last parameters). ``seconds`` ends the training early, after a round.
    """

    rounds: int = 30
    how: str = "average"
    batch: int = 1024
    passes: int = 1
    batches: int = 8
    optimizer: Adam = field(default_factory=Adam)
    mean_rate: float = 0.999
    seed: int = 0
    seconds: float | None = None

    def fit(self, rows: DataFrame, model, start: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """(parameters, mean loss of each round) of a model on ``rows`` (``id`` long, and the model's columns)."""
        if self.how not in ("average", "sum"):
            raise ValueError("how is average or sum")
        if 3 * start.nbytes > STATE_BYTES:
            raise ValueError(f"{3 * start.nbytes} bytes of state are too many to send to the tasks; the limit is {STATE_BYTES}")
        spark, began = rows.sparkSession, time.monotonic()
        ship_package(spark)
        rows = rows.select("id", *model.columns)
        if self.how == "sum":  # one folder for each batch, so that a round reads its own
            dealt = F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(self.batches)).cast("int")
            rows = materialize(rows.withColumn("__batch", dealt), "network-batches", partition_by="__batch")
        state = np.stack([start, np.zeros_like(start), np.zeros_like(start)])
        mean, weight, steps, losses = np.zeros_like(start), 0.0, 0.0, []
        for k in range(self.rounds):
            rate = self.optimizer.rate * (1 - k / self.rounds)
            shared = spark.sparkContext.broadcast(state)  # three vectors of at most STATE_BYTES together
            some = rows.where(F.col("__batch") == k % self.batches).drop("__batch") if self.how == "sum" else rows
            n, loss, taken, vector = self._joined(some.mapInArrow(self._work(model, shared, k, steps, rate), _STATE), state.size if self.how == "average" else start.size)
            shared.destroy()
            if not n:
                losses.append(math.nan)
                continue
            losses.append(loss / n)
            if self.how == "sum":
                steps += 1
                self.optimizer.step(state, vector / n, steps, rate)
                taken = 1
            else:
                state = (vector / n).reshape(state.shape)
                taken = max(1, round(taken / n))
                steps += taken
            kept = self.mean_rate**taken
            mean, weight = kept * mean + (1 - kept) * state[0], kept * weight + (1 - kept)
            if self.seconds is not None and time.monotonic() - began > self.seconds:
                break
        return (mean / weight if weight else state[0]), losses

    def _work(self, model, shared, k: int, steps: float, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        how, size, passes, seed, optimizer = self.how, self.batch, self.passes, self.seed, self.optimizer

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = shared.value.copy()
            total, loss, rows, at = np.zeros(state.shape[1]), 0.0, 0, 0
            for batch in batches:
                arrays = model.arrays(batch)
                n = batch.num_rows
                if how == "sum":
                    for a in range(0, n, size):
                        one, grad = model.gradient(state[0], [x[a : a + size] for x in arrays], seed, k * 64)
                        total, loss = total + grad, loss + one
                else:
                    for p in range(passes):
                        order = np.argsort(uniforms(seed, k * 64 + p, arrays[0], 1)[:, 0])
                        for a in range(0, n, size):
                            some = order[a : a + size]
                            one, grad = model.gradient(state[0], [x[some] for x in arrays], seed, k * 64 + p)
                            at += 1
                            optimizer.step(state, grad / len(some), steps + at, rate)
                            loss += one / passes
                rows += n
            if rows:
                out = total if how == "sum" else (state * rows).ravel()
                yield pa.RecordBatch.from_pydict({"rows": [float(rows)], "loss": [loss], "steps": [float(at * rows)], "state": [out.tobytes()]})

        return work

    @staticmethod
    def _joined(parts: DataFrame, size: int) -> tuple[float, float, float, np.ndarray]:
        """Sums of rows, loss, steps and vectors, in a tree of tasks."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, vector = np.zeros(3), np.zeros(size)
            for batch in batches:
                for r, x, s, raw in zip(*(batch.column(c).to_pylist() for c in ("rows", "loss", "steps", "state")), strict=True):
                    sums += (r, x, s)
                    vector += np.frombuffer(raw)
            if sums[0]:
                yield pa.RecordBatch.from_pydict({"rows": [sums[0]], "loss": [sums[1]], "steps": [sums[2]], "state": [vector.tobytes()]})

        tasks = parts.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            parts = parts.repartition(tasks).mapInArrow(add, _STATE)
        out, vector = np.zeros(3), np.zeros(size)
        for r in parts.collect():  # FAN_IN vectors at most
            out += (r["rows"], r["loss"], r["steps"])
            vector += np.frombuffer(r["state"])
        return out[0], out[1], out[2], vector
