"""Diffusion of mixed tables with boosted trees as denoisers.

One model for each column (and step, with ``model_per_timestep``), with the label as one of its inputs; those of a step are fitted together
(:mod:`tabweft.operators.boosting`) on rows that the tasks noise, with random numbers that depend on the row's number only. Rows are sampled in tasks: a row's whole way back from noise runs on the
trees' arrays, with random numbers that depend on the row's number only.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import materialize, ship_package, shuffle_partitions
from tabweft.functions.counter import normals, uniforms
from tabweft.generators.base import BaseGenerator, level_at, level_lists
from tabweft.operators.boosting import Blocks, Group, Judged, grow
from tabweft.operators.forests import Forest
from tabweft.spec import as_level, as_number

#: Levels of a category of which every row asks the model at fitting; of wider ones it asks for its own and as many hashed others, weighted.
CANDIDATES = 16


def picked(shares: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The level of every row at ``u`` of its shares."""
    upto = np.cumsum(shares, 1)
    return np.minimum((upto <= u[:, None] * upto[:, -1:]).sum(1), shares.shape[1] - 1)


def category_posterior(now: np.ndarray, start: np.ndarray, size: int, alpha: float, before: float) -> np.ndarray:
    """Unscaled shares of ``size`` levels one step back, of codes now and at the start, this step's alpha and the product of those before."""
    rows = np.arange(len(now))
    step, prior = np.full((len(now), size), (1 - alpha) / size), np.full((len(now), size), (1 - before) / size)
    step[rows, now] += alpha
    prior[rows, start] += before
    return step * prior


def candidates(code: np.ndarray, size: int, u: np.ndarray | None) -> np.ndarray:
    """The levels of which each row asks: all, or its own and as many others as make CANDIDATES."""
    if size <= CANDIDATES:
        return np.tile(np.arange(size), (len(code), 1))
    # steps of a drawn width that has no factor in common with the number of levels lead to different ones
    widths = np.array([w for w in range(1, size) if math.gcd(w, size) == 1])
    width = widths[np.minimum((u * len(widths)).astype(np.int64), len(widths) - 1)]
    return (code[:, None] + np.arange(CANDIDATES) * width[:, None]) % size


class _Boosted(BaseGenerator):
    """Numbers scaled to [-1, 1]; categories as codes; a discrete target is drawn first and the rest given it."""

    flags_missing = True

    def __init__(
        self, target_column: str | None = None, num_timesteps: int = 50, noise_samples_per_row: int = 1, max_iter: int = 10, max_depth: int = 4,
        step_size: float = 0.3, model_per_timestep: bool = True, clip_extremes: bool = True, random_state: int = 0,
    ):
        super().__init__(random_state)
        if min(num_timesteps, noise_samples_per_row) < 1:
            raise ValueError("timesteps and noise samples must be positive")
        self.target, self.steps, self.copies, self.max_iter, self.max_depth = target_column, num_timesteps, noise_samples_per_row, max_iter, max_depth
        self.per_step, self.clip, self.step_size = model_per_timestep, clip_extremes, step_size

    def _fit(self, df: DataFrame) -> None:
        from tabweft.functions.binning import ranges

        if self.target is not None and self.target not in df.columns:
            raise ValueError(f"columns not found: {[self.target]}")
        given = self.target if self.target in self.spec.discrete else None
        found = level_lists(df, self.spec.discrete)
        self.labels = found.pop(given) if given else []
        self.levels = {c: [v for v, _ in rows] for c, rows in found.items()}
        self.sizes = [len(v) for v in self.levels.values()]
        self.limits = ranges([df], list(self.spec.numerical), as_number) if self.spec.numerical else {}
        code = lambda c, levels: (F.array_position(F.array(*map(F.lit, levels)), as_level(c)) - 1).cast("int")
        scaled = [(2 * (as_number(df, c) - lo) / ((hi - lo) or 1.0) - 1).alias(f"x{i}") for i, (c, (lo, hi)) in enumerate(self.limits.items())]
        codes = [code(c, v).alias(f"k{i}") for i, (c, v) in enumerate(self.levels.items())]
        label = code(given, [v for v, _ in self.labels]) if given else F.lit(0)
        rows = df.select(F.monotonically_increasing_id().alias("row"), *scaled, *codes, label.alias("y"))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1)))) if self.copies > 1 else rows.withColumn("copy", F.lit(0))
        rows = rows.select((F.col("row") * self.copies + F.col("copy")).alias("id"), *[F.col(c) for c in rows.columns if c not in ("row", "copy")])
        rows = materialize(rows.repartition(shuffle_partitions(df.sparkSession)), "boosted")  # noised and cut by tasks of the same size
        self.models = [grow(rows, self._blocks(k), self._groups(), self.max_iter, self.step_size, self.max_depth, self._judged(), self._kept()) for k in (range(self.steps) if self.per_step else [None])]

    def _groups(self) -> list[Group]:
        """What the fits of a step are of; a category with one level has no target."""
        raise NotImplementedError

    def _blocks(self, k: int | None) -> Blocks:
        """Makes noised inputs and targets of step ``k``, or of a step for each row, in the tasks."""
        light = copy.copy(self)  # what the tasks need besides
        light.spark = light.models = None
        return lambda data: light._noised(data, k)

    def _noised(self, data: dict[str, np.ndarray], k: int | None):
        raise NotImplementedError

    def _judged(self) -> Judged | None:
        return None

    def _kept(self) -> list[str]:
        """Columns that :meth:`_judged` reads."""
        return []

    def _stream(self, k: int | None, i: int) -> int:
        """Number of a stream of random numbers for fitting."""
        return (1 << 36) + 8 * (0 if k is None else k + 1) + i

    def _step_of(self, ids: np.ndarray, k: int | None) -> np.ndarray:
        if k is not None:
            return np.full(len(ids), k)
        return (uniforms(self.random_state, self._stream(k, 0), ids, 1)[:, 0] * self.steps).astype(np.int64)

    def _given(self) -> list[tuple[str, int]]:
        """The inputs besides the columns that are noised."""
        return [("y", max(1, len(self.labels))), *([] if self.per_step else [("t", 0)])]

    def _features(self, z: np.ndarray, codes: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray | int]:
        return [*np.ascontiguousarray(z.T), *np.ascontiguousarray(codes.T), y, *([] if self.per_step else [k])]

    def _sampled(self, models: list[list[Forest | None]], ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _generate(self, n: int) -> DataFrame:
        ship_package(self.spark)
        shared = self.spark.sparkContext.broadcast(self.models)  # MAX_NODES of each model at most
        light = copy.copy(self)  # what the tasks need besides
        light.spark = light.models = None
        seed, sampled, counts = self.random_state, light._sampled, np.array([k for _, k in self.labels], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column("id").to_numpy()
                    y = picked(np.tile(counts, (len(ids), 1)), uniforms(seed, 1 << 40, ids, 1)[:, 0]) if len(counts) else np.zeros(len(ids), np.int64)
                    x, c = sampled(shared.value, ids, y)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, *x.T.astype(float), *c.T.astype(np.int64), y.astype(np.int64))], names=names)

        numbers, codes = [f"x{i}" for i in range(len(self.limits))], [f"c{i}" for i in range(len(self.levels))]
        names = ["id", *numbers, *codes, "y"]
        rows = self.spark.range(0, n, 1, max(self.spark.sparkContext.defaultParallelism, shuffle_partitions(self.spark))).mapInArrow(run, ", ".join(["id long", *[f"{c} double" for c in numbers], *[f"{c} long" for c in codes], "y long"]))
        out = {c: level_at(v, F.col(f"c{i}")) for i, (c, v) in enumerate(self.levels.items())}
        if self.labels:
            out[self.target] = level_at([v for v, _ in self.labels], F.col("y"))
        for i, (c, (lo, hi)) in enumerate(self.limits.items()):
            z = F.least(F.greatest(F.col(f"x{i}"), F.lit(-1.0)), F.lit(1.0)) if self.clip else F.col(f"x{i}")
            out[c] = (z + 1) / 2 * (hi - lo) + lo
        return self._typed(rows.select("id", *[out[c].alias(c) for c in self.columns]))


class BoostedDiffusionGenerator(_Boosted):
    """Normal diffusion of numbers by boosted regressions, multinomial diffusion of categories by boosted classifiers.

    ``objective``: the regressions predict ``x`` (the start), ``epsilon`` (the noise) or ``v`` (the velocity). A category's
    classifier judges (row, level) pairs: whether the row had the level at the start. A start is drawn from its answers for all levels, and
    the level one step back from the posterior of that start.
    """

    def __init__(self, *args, objective: str = "v", deterministic_sampler: bool = True, **kwargs):
        super().__init__(*args, **kwargs)
        if objective not in ("x", "epsilon", "v"):
            raise ValueError("objective is x, epsilon or v")
        self.objective, self.deterministic = objective, deterministic_sampler

    def _bars(self) -> list[float]:
        from tabweft.generators.diffusion import cosine_angle_bars

        return cosine_angle_bars(self.steps)

    def _groups(self) -> list[Group]:
        inputs = [*[(f"z{i}", 0) for i in range(len(self.limits))], *[(f"d{i}", s) for i, s in enumerate(self.sizes)], *self._given()]
        return [Group(inputs, len(self.limits), "squared"), *[Group([*inputs, ("level", s)], 1, "logistic") for s in self.sizes if s > 1]]

    def _noised(self, data, k):
        seed, ids, sizes = self.random_state, data["id"], self.sizes
        n, numbers, t = len(ids), len(self.limits), self._step_of(ids, k)
        bar = np.array(self._bars())[t]
        a, s = np.sqrt(bar), np.sqrt(1 - bar)
        x, noise = [data[f"x{i}"] for i in range(numbers)], normals(seed, self._stream(k, 1), ids, max(1, numbers))
        u = uniforms(seed, self._stream(k, 2), ids, 3 * max(1, len(sizes)))
        inputs = [a * x[i] + s * noise[:, i] for i in range(numbers)]
        inputs += [np.where(u[:, 3 * i] < bar, data[f"k{i}"], np.minimum((u[:, 3 * i + 1] * size).astype(np.int64), size - 1)) for i, size in enumerate(sizes)]
        inputs += [data["y"], *([] if self.per_step else [t])]
        goals = [{"x": x[i], "epsilon": noise[:, i], "v": a * noise[:, i] - s * x[i]}[self.objective] for i in range(numbers)]
        return inputs, goals, {**{f"k{i}": data[f"k{i}"] for i in range(len(sizes))}, **{f"u{i}": u[:, 3 * i + 2] for i, size in enumerate(sizes) if size > CANDIDATES}}

    def _kept(self):
        return [*[f"k{i}" for i in range(len(self.sizes))], *[f"u{i}" for i, size in enumerate(self.sizes) if size > CANDIDATES]]

    def _judged(self):
        sizes = self.sizes

        def run(data):
            out = []
            for i, size in enumerate(sizes):
                if size < 2:
                    continue
                code = data[f"k{i}"].astype(np.int64)
                at = candidates(code, size, data.get(f"u{i}"))
                goal = np.where(at == code[:, None], 1.0, -1.0)
                out.append((at, goal, None if size <= CANDIDATES else np.where(goal > 0, 1.0, (size - 1) / (CANDIDATES - 1))))
            return out

        return run

    def _sampled(self, models, ids, y):
        seed, n, numbers, sizes = self.random_state, len(ids), len(self.limits), self.sizes
        bars = self._bars()
        x = normals(seed, 1 << 32, ids, numbers) if numbers else np.zeros((n, 0))
        u = uniforms(seed, (1 << 32) + 1, ids, max(1, len(sizes)))
        codes = np.stack([np.minimum((u[:, i] * s).astype(np.int64), s - 1) for i, s in enumerate(sizes)], 1) if sizes else np.zeros((n, 0), np.int64)
        for k in reversed(range(self.steps)):
            of_step = iter(models[k if self.per_step else 0])
            inputs = self._features(x, codes, y, k)
            bar, before = bars[k], bars[k - 1] if k else 1.0
            a, s, alpha = math.sqrt(bar), math.sqrt(1 - bar), bar / before
            after_x, after_codes = x.copy(), codes.copy()
            for i in range(numbers):
                said = next(of_step).said(inputs)
                start = said if self.objective == "x" else (x[:, i] - s * said) / a if self.objective == "epsilon" else a * x[:, i] - s * said
                start = np.clip(start, -1, 1)
                if not k:
                    after_x[:, i] = start
                elif self.deterministic:
                    after_x[:, i] = math.sqrt(before) * start + math.sqrt(1 - before) * (x[:, i] - a * start) / s
                else:
                    mean = (math.sqrt(before) * (1 - alpha) * start + math.sqrt(alpha) * (1 - before) * x[:, i]) / (1 - bar)
                    after_x[:, i] = mean + math.sqrt((1 - alpha) * (1 - before) / (1 - bar)) * normals(seed, (1 << 33) + k * 1000 + i, ids, 1)[:, 0]
            u = uniforms(seed, (1 << 34) + k, ids, 2 * max(1, len(sizes)))
            for i, size in enumerate(sizes):
                if size < 2:
                    continue
                shares, judge = np.empty((n, size)), next(of_step)
                for level in range(size):
                    shares[:, level] = 1 / (1 + np.exp(-2 * judge.said([*inputs, level])))
                start = picked(shares, u[:, 2 * i])  # drawn before the posterior, which is one for each start
                after_codes[:, i] = picked(category_posterior(codes[:, i], start, size, alpha, before), u[:, 2 * i + 1])
            x, codes = after_x, after_codes
        return x, codes


class BoostedFlowGenerator(_Boosted):
    """Numbers, and categories as indicators of all levels but the first, are moved together from noise to data.

    ``flow``: the regressions predict data minus noise, Euler steps lead from noise to data; ``vp``: they predict the score of the
    variance-preserving process, Euler-Maruyama steps lead back from its end, and a last step takes away the noise that is left at
    ``eps``. A category is its largest indicator, or the first level if none reaches 1/2.
    """

    def __init__(self, *args, diffusion_type: str = "flow", beta_min: float = 0.1, beta_max: float = 8.0, eps: float = 1e-3, **kwargs):
        super().__init__(*args, **kwargs)
        if diffusion_type not in ("flow", "vp"):
            raise ValueError("diffusion_type is flow or vp")
        self.kind, self.beta_min, self.beta_max, self.eps = diffusion_type, beta_min, beta_max, eps

    def _bar(self, t: float) -> float:
        return math.exp(-0.5 * t * t * (self.beta_max - self.beta_min) - t * self.beta_min)

    def _times(self) -> list[float]:
        """Time of each step's model; of a flow from noise (0) to data, else from the end (1) down to ``eps``."""
        if self.kind == "flow":
            return [k / self.steps for k in range(self.steps)]
        return [1.0 - k * (1.0 - self.eps) / self.steps for k in range(self.steps)] + [self.eps]

    @property
    def _width(self) -> int:
        return len(self.limits) + sum(max(0, s - 1) for s in self.sizes)

    def _groups(self) -> list[Group]:
        return [Group([*[(f"z{j}", 0) for j in range(self._width)], *self._given()], self._width, "squared")]

    def _noised(self, data, k):
        ids, t = data["id"], self._step_of(data["id"], k)
        start = [data[f"x{i}"] for i in range(len(self.limits))] + [(data[f"k{i}"] == level).astype(float) for i, s in enumerate(self.sizes) for level in range(1, s)]
        noise, at = normals(self.random_state, self._stream(k, 1), ids, max(1, self._width)), np.array(self._times()[: self.steps])[t]
        if self.kind == "flow":
            keep, add = at, 1 - at
        else:
            bar = np.exp(-0.5 * at * at * (self.beta_max - self.beta_min) - at * self.beta_min)
            keep, add = np.sqrt(bar), np.sqrt(1 - bar)
        inputs = [keep * x + add * noise[:, j] for j, x in enumerate(start)]
        goals = [x - noise[:, j] if self.kind == "flow" else -noise[:, j] / add for j, x in enumerate(start)]
        return [*inputs, data["y"], *([] if self.per_step else [t])], goals, {}

    def _sampled(self, models, ids, y):
        seed, n, width, times = self.random_state, len(ids), self._width, self._times()
        none = np.zeros((n, 0))
        x = normals(seed, 1 << 32, ids, width) if width else np.zeros((n, 0))

        def said(x: np.ndarray, k: int) -> np.ndarray:
            inputs = self._features(x, none, y, k)
            return np.stack([m.said(inputs) for m in models[k if self.per_step else 0]], 1) if width else x

        for k in range(self.steps):
            if self.kind == "flow":
                x = x + said(x, k) / self.steps
            else:
                h, beta = times[k] - times[k + 1], self.beta_min + times[k] * (self.beta_max - self.beta_min)
                x = x + (0.5 * beta * x + beta * said(x, k)) * h + math.sqrt(beta * h) * (normals(seed, (1 << 33) + k, ids, width) if width else 0)
        if self.kind == "vp":
            x = x + (1 - self._bar(self.eps)) * said(x, self.steps - 1)
        codes, at = np.zeros((n, len(self.sizes)), np.int64), len(self.limits)
        for i, s in enumerate(self.sizes):
            shown = x[:, at : at + s - 1]
            codes[:, i] = np.concatenate([np.full((n, 1), 0.5), shown], axis=1).argmax(1)
            at += max(0, s - 1)
        return x[:, : len(self.limits)], codes
