"""Denoising diffusion of mixed tables: normal noise on numbers, multinomial noise on categories, one network for both."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import materialize, ship_package
from tabweft.functions.counter import normals, uniforms
from tabweft.functions.normal import cdf
from tabweft.functions.randomness import uniform
from tabweft.generators.boosted import picked
from tabweft.generators.base import BaseGenerator, level_at, level_lists
from tabweft.operators.network import STATE_BYTES, Adam, Denoiser, Trainer
from tabweft.operators.preprocess import QuantileMap
from tabweft.spec import as_level, as_number

#: Size of the normal scores of a column's ends; what is predicted to lie beyond is drawn back to it.
LARGEST = 5.2
#: Rows that go back from noise together: their arrays stay in the processor's cache.
SAMPLED = 1_024


def bars(steps: int, kind: str = "cosine") -> tuple[np.ndarray, np.ndarray]:
    """alpha and its running product for t = 0 .. steps - 1, of the ``cosine`` or ``linear`` schedule."""
    t = np.arange(steps, dtype=float)
    if kind == "linear":
        beta = np.linspace(0.1, 20.0, steps) / steps
    elif kind == "cosine":
        bar = lambda x: np.cos((x / steps + 0.008) / 1.008 * (math.pi / 2)) ** 2
        beta = np.minimum(1 - bar(t + 1) / bar(t), 0.999)
    else:
        raise ValueError("scheduler is cosine or linear")
    return 1 - beta, np.exp(np.cumsum(np.log(1 - beta)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class MixedDiffusion:
    """Losses, gradients and reverse steps of rows (numbers, codes, class).

    The network sees the noised numbers and categories (as indicators), the step and the class. For numbers it predicts the
    noise; for categories the shares of the levels at the start, which the posterior turns into shares one step back.
    A category's loss is the divergence of these from the true posterior, divided by the number of categories.
    """

    columns = ("x", "c", "y")

    def __init__(self, numbers: int, sizes: list[int], classes: int, steps: int, scheduler: str, embedding: int, hidden: int, layers: int):
        self.numbers, self.sizes, self.steps = numbers, sizes, steps
        self.alpha, self.bar = bars(steps, scheduler)
        self.before = np.append(1.0, self.bar[:-1])
        ends = np.cumsum([numbers, *sizes]).tolist()
        self.slots = list(zip(ends[:-1], ends[1:], strict=True))
        self.network = Denoiser(ends[-1], embedding, hidden, layers, classes)

    def arrays(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """ids, numbers, codes and classes."""
        flat = lambda c, width: np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, width)
        return [batch.column("id").to_numpy(), flat("x", self.numbers), flat("c", len(self.sizes)), batch.column("y").to_numpy()]

    def noised(self, x: np.ndarray, c: np.ndarray, t: np.ndarray, noise: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Numbers and indicators after step ``t``."""
        bar = self.bar[t][:, None]
        out = np.zeros((len(x), self.network.width))
        out[:, : self.numbers] = np.sqrt(bar) * x + np.sqrt(1 - bar) * noise
        for k, ((a, b), size) in enumerate(zip(self.slots, self.sizes, strict=True)):
            shares = np.repeat((1 - bar) / size, size, axis=1)
            shares[np.arange(len(x)), c[:, k]] += bar[:, 0]
            out[np.arange(len(x)), a + picked(shares, u[:, k])] = 1.0
        return out

    def posterior(self, now: np.ndarray, start: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unscaled shares of a category's levels before step ``t``, from indicators now and shares at the start; and the factor of the first kind."""
        size = now.shape[1]
        alpha, before = self.alpha[t][:, None], self.before[t][:, None]
        step = alpha * now + (1 - alpha) / size
        return step * (before * start + (1 - before) / size), step

    def gradient(self, p: np.ndarray, arrays: list[np.ndarray], seed: int, stream: int) -> tuple[float, np.ndarray]:
        """Sums of loss and gradient; steps and noise come from the rows' ids."""
        ids, x, c, y = arrays
        u = uniforms(seed, 2 * stream, ids, 1 + len(self.sizes))
        t = np.minimum((u[:, 0] * self.steps).astype(int), self.steps - 1)
        noise = normals(seed, 2 * stream + 1, ids, self.numbers)
        z = self.noised(x, c, t, noise, u[:, 1:])
        out, kept = self.network.forward(p, z, t.astype(float), y)
        d, loss = np.zeros_like(out), 0.0
        if self.numbers:
            gap = out[:, : self.numbers] - noise
            loss += float((gap * gap).mean(1).sum())
            d[:, : self.numbers] = 2 * gap / self.numbers
        for k, (a, b) in enumerate(self.slots):
            size = b - a
            true = np.zeros((len(ids), size))
            true[np.arange(len(ids)), c[:, k]] = 1.0
            q, _ = self.posterior(z[:, a:b], true, t)
            q /= q.sum(1, keepdims=True)
            said = softmax(out[:, a:b])
            r, step = self.posterior(z[:, a:b], said, t)
            total = r.sum(1, keepdims=True)
            safe = np.maximum(q, 1e-300)
            loss += float((q * (np.log(safe) - np.log(np.maximum(r / total, 1e-300)))).sum()) / len(self.sizes)
            before = self.before[t][:, None]
            g = before * (step / total - q / np.maximum(before * said + (1 - before) / size, 1e-12))
            d[:, a:b] = said * (g - (g * said).sum(1, keepdims=True)) / len(self.sizes)
        return loss, self.network.backward(p, kept, d)

    def sample(self, p: np.ndarray, ids: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and codes of new rows, by ancestral steps from noise."""
        n = len(ids)
        z = np.zeros((n, self.network.width))
        z[:, : self.numbers] = normals(seed, 1 << 32, ids, self.numbers)
        u = uniforms(seed, (1 << 32) + 1, ids, max(1, len(self.sizes)))
        for k, ((a, _), size) in enumerate(zip(self.slots, self.sizes, strict=True)):
            z[np.arange(n), a + np.minimum((u[:, k] * size).astype(int), size - 1)] = 1.0
        for s in reversed(range(self.steps)):
            out, _ = self.network.forward(p, z, np.full(n, float(s)), y)
            bar, alpha, before = self.bar[s], self.alpha[s], self.before[s]
            x = z[:, : self.numbers]
            start = np.clip((x - math.sqrt(1 - bar) * out[:, : self.numbers]) / math.sqrt(bar), -LARGEST, LARGEST)
            mean = (math.sqrt(before) * (1 - alpha) * start + math.sqrt(alpha) * (1 - before) * x) / (1 - bar)
            deviation = math.sqrt((1 - alpha) * (1 - before) / (1 - bar))
            after = np.zeros_like(z)
            after[:, : self.numbers] = mean + deviation * normals(seed, (1 << 33) + s, ids, self.numbers) if s else mean
            u = uniforms(seed, (1 << 34) + s, ids, max(1, len(self.sizes)))
            for k, (a, b) in enumerate(self.slots):
                shares, _ = self.posterior(z[:, a:b], softmax(out[:, a:b]), np.full(n, s))
                after[np.arange(n), a + picked(shares, u[:, k])] = 1.0
            z = after
        return z[:, : self.numbers], np.stack([z[:, a:b].argmax(1) for a, b in self.slots], 1) if self.slots else np.zeros((n, 0), np.int64)


class TabDDPMGenerator(BaseGenerator):
    """Numbers as normal scores, categories as levels, denoised together; a discrete target is drawn first and the rest given it.

    The network is trained by Spark (:class:`Trainer`): ``epochs`` rounds over the table, or ``training_steps`` mini-batches in
    all; ``training`` is ``average`` or ``sum``. Rows are sampled in tasks, each row from its number. Dropout is not supported.
    """

    flags_missing = True

    def __init__(
        self, target_column: str | None = None, epochs: int = 1000, lr: float = 0.002, weight_decay: float = 1e-4, batch_size: int = 1024, num_timesteps: int = 1000, scheduler: str = "cosine",
        model_params: dict | None = None, embedding_dim: int = 128, cap_train_time: float | None = None, random_state: int = 0, training_steps: int | None = None, training: str = "average",
    ):
        super().__init__(random_state)
        known = {"n_layers_hidden": 3, "n_units_hidden": 256, "dropout": 0.0}
        if odd := set(model_params or {}) - set(known):
            raise ValueError(f"unknown model parameters {sorted(odd)}")
        self.shape = known | (model_params or {})
        if self.shape["dropout"]:
            raise ValueError("dropout is not supported")
        self.target, self.epochs, self.training_steps, self.training = target_column, epochs, training_steps, training
        self.lr, self.weight_decay, self.batch_size, self.num_timesteps, self.scheduler = lr, weight_decay, batch_size, num_timesteps, scheduler
        self.embedding_dim, self.cap_train_time = embedding_dim, cap_train_time

    def _model(self) -> MixedDiffusion:
        sizes = [len(v) for v in self.levels.values()]
        return MixedDiffusion(len(self.spec.numerical), sizes, len(self.labels), self.num_timesteps, self.scheduler, self.embedding_dim, self.shape["n_units_hidden"], self.shape["n_layers_hidden"])

    def _fit(self, df: DataFrame) -> None:
        if self.target is not None and self.target not in df.columns:
            raise ValueError(f"columns not found: {[self.target]}")
        given = self.target if self.target in self.spec.discrete else None
        found = level_lists(df, self.spec.discrete)
        self.labels = found.pop(given) if given else []
        self.levels = {c: [v for v, _ in rows] for c, rows in found.items()}
        self.maps = {c: QuantileMap.fit(df.where(as_number(df, c).isNotNull()), c, QuantileMap.default_count(df.count())) for c in self.spec.numerical}
        rows = df.select(*[as_number(df, c).alias(c) for c in self.spec.numerical], *[as_level(c).alias(c) for c in self.spec.discrete])
        for i, c in enumerate(self.spec.numerical):
            rows = self.maps[c].with_normal(rows, F.col(c), f"__x{i}")
        code = lambda c, levels: (F.array_position(F.array(*map(F.lit, levels)), F.col(c)) - 1).cast("long")
        packed = rows.select(
            F.monotonically_increasing_id().alias("id"),
            F.array(*[F.col(f"__x{i}") for i in range(len(self.spec.numerical))]).cast("array<double>").alias("x"),
            F.array(*[code(c, v) for c, v in self.levels.items()]).cast("array<bigint>").alias("c"),
            (code(given, [v for v, _ in self.labels]) if given else F.lit(0).cast("long")).alias("y"),
        )
        train, model = materialize(packed, "tabddpm"), self._model()
        rounds = self.epochs
        if self.training_steps is not None:
            rounds = math.ceil(self.training_steps / max(1, train.count() // self.batch_size)) if self.training == "average" else self.training_steps
        batches = max(1, min(64, train.count() // self.batch_size)) if self.training == "sum" else 1
        trainer = Trainer(rounds, self.training, self.batch_size, batches=batches, optimizer=Adam(self.lr, self.weight_decay), mean_rate=0.0, seed=self.random_state, seconds=self.cap_train_time)
        fitted, self.losses = trainer.fit(train, model, model.network.start(self.random_state))
        self.parameters = fitted.tolist()

    def _generate(self, n: int) -> DataFrame:
        model, seed = self._model(), self.random_state
        parameters = np.array(self.parameters)
        if parameters.nbytes > STATE_BYTES:
            raise ValueError("too many parameters to send to the tasks")
        ship_package(self.spark)
        shared = self.spark.sparkContext.broadcast(parameters)  # STATE_BYTES at most
        counts = np.array([k for _, k in self.labels], float)
        numbers, codes = len(self.spec.numerical), len(self.levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column("id").to_numpy()
                    y = picked(np.tile(counts, (len(ids), 1)), batch.column("u").to_numpy()) if len(counts) else np.zeros(len(ids), np.int64)
                    some = [model.sample(shared.value, ids[a : a + SAMPLED], y[a : a + SAMPLED], seed) for a in range(0, len(ids), SAMPLED)]
                    x, c = (np.concatenate(parts) for parts in zip(*some, strict=True))
                    listed = lambda a, width: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), width).cast(pa.list_(pa.from_numpy_dtype(a.dtype))) if width else pa.array([[]] * len(a), pa.list_(pa.from_numpy_dtype(a.dtype)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), listed(x.astype(float), numbers), listed(c.astype(np.int64), codes), pa.array(y.astype(np.int64))], names=["id", "x", "c", "y"])

        rows = self.spark.range(n).withColumn("u", uniform(seed, "class", "id")).mapInArrow(run, "id long, x array<double>, c array<bigint>, y long")
        out = {c: level_at(v, F.col("c")[i]) for i, (c, v) in enumerate(self.levels.items())}
        if self.labels:
            out[self.target] = level_at([v for v, _ in self.labels], F.col("y"))
        rows = rows.withColumns({f"__u{i}": cdf(F.col("x")[i]) for i in range(numbers)}) if numbers else rows
        out |= {c: self.maps[c].value(F.col(f"__u{i}")) for i, c in enumerate(self.spec.numerical)}
        return self._typed(rows.select("id", *[out[c].alias(c) for c in self.columns]))
