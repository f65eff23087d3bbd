"""Differentially private logistic regression by data-parallel gradient descent on Poisson samples.

Each step draws every row by itself with one probability, clips the drawn rows' gradients to norm 1 inside the tasks, adds the
clipped sums with a Spark aggregation, and adds Gaussian noise once on the driver, to d + 1 numbers. The accountant composes the
Renyi divergence of the sampled Gaussian mechanism, so that a row that is seldom drawn costs less.

Several budgets are trained side by side: a step draws its rows once, and one job adds the sums of all models. Rows are drawn by
a hash of their number, the seed and the step; whoever knows the seed knows who was drawn, so it must stay as secret as the noise.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import sigmoid, standardise
from tallyrisk.landing import land
from tallyrisk.operators.report import full_report

# Clipping norm, the budgets of the utility curve, orders of the accountant.
CLIP = 1.0
EPSILONS = (None, 8.0, 3.0, 1.0, 0.5)
ORDERS = [1 + x / 10 for x in range(1, 100)] + list(range(12, 64)) + [128, 256, 512]
# Steps of a fit and the share of rows that each draws.
STEPS, SHARE = 40, 0.25


def renyi(order: float, noise: float, share: float = 1.0) -> float:
    """Renyi divergence of one step at an order; a sampled step is accounted at whole orders only (others: infinite).

    For a share below one: log of sum over k of C(order, k) (1 - share)^(order - k) share^k exp((k^2 - k) / (2 noise^2)), over
    order - 1.
    """
    if share >= 1.0:
        return order / (2 * noise * noise)
    if share <= 0.0:
        return 0.0
    if order != int(order):
        return math.inf
    n = int(order)
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (n - k) * math.log1p(-share) + k * math.log(share)
             + (k * k - k) / (2 * noise * noise) for k in range(n + 1)]
    top = max(terms)
    return max(0.0, top + math.log(math.fsum(math.exp(t - top) for t in terms))) / (n - 1)


def epsilon_spent(noise: float, steps: int, delta: float, share: float = 1.0) -> float:
    """Budget of `steps` Gaussian releases at noise multiplier `noise`, each of a Poisson sample of `share` of the rows."""
    best = math.inf
    for a in ORDERS:
        best = min(best, steps * renyi(a, noise, share) - (math.log(delta) + math.log(a)) / (a - 1) + math.log((a - 1) / a))
    return max(best, 0.0)


def noise_for(epsilon: float, steps: int, delta: float, share: float = 1.0) -> float:
    """Smallest noise multiplier (to 1e-4) that stays within `epsilon`."""
    low, high = 1e-3, 1.0
    while epsilon_spent(high, steps, delta, share) > epsilon:
        high *= 2
    while high - low > 1e-4:
        middle = (low + high) / 2
        low, high = (low, middle) if epsilon_spent(middle, steps, delta, share) <= epsilon else (middle, high)
    return high


@dataclass
class PrivateModel:
    features: list[str]
    means: list[float]
    deviations: list[float]
    weights: np.ndarray
    epsilon_target: float | None
    epsilon: float | None
    delta: float | None
    noise_multiplier: float | None
    fit_seconds: float

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        logit = F.lit(float(self.weights[-1]))
        for c, m, s, w in zip(self.features, self.means, self.deviations, self.weights):
            logit = logit + F.lit(float(w)) * standardise(F.col(c), m, s)
        return df.withColumn(name, sigmoid(logit))


def _clipped_sums(weights: np.ndarray, positive_weight: float, clips: Sequence[float | None]):
    """Arrow batches of (features.., label) to one row of gradient sums per task: those of every model (a row of `weights`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, y = np.column_stack([*columns[:-1], np.ones(batch.num_rows)]), columns[-1]
            length = np.sqrt((x * x).sum(axis=1))
            for i, clip in enumerate(clips):
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights[i], -500, 500)))
                slope = (p - y) * np.where(y == 1, positive_weight, 1.0)
                if clip is not None:
                    slope /= np.maximum(1.0, np.abs(slope) * length / clip)
                total[i] += slope @ x
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.ravel()], names=[f"g{i}" for i in range(total.size)])

    return run


def drawn(rows: DataFrame, share: float, seed: int, step: int) -> DataFrame:
    """A Poisson sample of the written rows: each by itself, with probability `share`."""
    if share >= 1.0:
        return rows
    cell = F.pmod(F.xxhash64("_row", F.lit(seed), F.lit(step)), F.lit(1 << 53))
    return rows.filter(cell < F.lit(int(share * (1 << 53))))


def dp_train(train: DataFrame, features: Sequence[str], label: str = "label", epsilon: float | None = None, steps: int = STEPS,
             rate: float = 2.0, clip: float = CLIP, seed: int = 0, share: float = SHARE) -> PrivateModel:
    """Fit at one target budget; epsilon=None trains without clipping or noise."""
    return dp_train_all(train, features, label, [epsilon], steps, rate, clip, seed, share)[0]


def dp_train_all(train: DataFrame, features: Sequence[str], label: str = "label", epsilons: Sequence[float | None] = EPSILONS,
                 steps: int = STEPS, rate: float = 2.0, clip: float = CLIP, seed: int = 0, share: float = SHARE) -> list[PrivateModel]:
    """One model a budget, each with a noise of its own, from the same drawn rows.

    Every step reads the written, standardised rows; its driver part is (budgets x features) numbers. Rows with a missing feature
    are refused: one would spoil all weights. Means, deviations, the class weight and the number of rows count as public.
    """
    began = time.perf_counter()
    missing = F.count_if(F.array_contains(F.array(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features]), True))
    row = train.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"), missing.alias("missing"),
                    *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    if row["missing"]:
        raise ValueError(f"{row['missing']} training rows have a NULL or NaN feature")
    n, positives = row["n"], row["p"] or 0
    means, deviations = [row[f"m_{c}"] for c in features], [row[f"s_{c}"] or 1.0 for c in features]
    positive_weight = (n - positives) / max(1.0, positives)
    table = standardised_rows(train, features, label, means, deviations)
    delta = 1.0 / n
    noise = [None if e is None else noise_for(e, steps, delta, share) for e in epsilons]
    clips = [None if e is None else clip for e in epsilons]
    rngs = [np.random.default_rng([seed, i]) for i in range(len(epsilons))]
    width = len(features) + 1
    weights, speed = np.zeros((len(epsilons), width)), np.zeros((len(epsilons), width))
    names = [f"g{i}" for i in range(weights.size)]
    schema = ", ".join(f"{g} double" for g in names)
    # Without clipping both classes weigh n - positives together; clipped rows weigh at most 1 each.
    scale = np.array([share * (2.0 * (n - positives) if s is None else n) for s in noise])[:, None]
    for step in range(steps):
        rows = drawn(table, share, seed, step).drop("_row")
        task = _clipped_sums(weights, positive_weight, clips)
        sums = np.array([v or 0.0 for v in rows.mapInArrow(task, schema).agg(*[F.sum(g) for g in names]).first()]).reshape(weights.shape)
        for i, s in enumerate(noise):
            if s is not None:
                sums[i] += rngs[i].normal(0.0, s * clip, width)
        speed = 0.9 * speed + sums / scale
        weights = weights - rate * speed
    seconds = round(time.perf_counter() - began, 2)
    return [PrivateModel(list(features), means, deviations, w, e, None if e is None else epsilon_spent(s, steps, delta, share),
                         None if e is None else delta, s, seconds) for w, e, s in zip(weights, epsilons, noise)]


def standardised_rows(train: DataFrame, features: Sequence[str], label: str, means: Sequence[float],
                      deviations: Sequence[float]) -> DataFrame:
    """The training rows as the steps read them, written and numbered once."""
    columns = [standardise(F.col(c), m, s).alias(c) for c, m, s in zip(features, means, deviations)]
    return land(train.select(*columns, F.col(label).cast("double").alias("_label"), F.monotonically_increasing_id().alias("_row")), "dp-rows")


def privacy_curve(table: DataFrame, features: Sequence[str], label: str = "label", epsilons: Sequence[float | None] = EPSILONS,
                  steps: int = STEPS, seed: int = 0, share: float = SHARE) -> DataFrame:
    """Report on test for every budget; None stands for training without privacy. `fit_seconds` is that of all budgets together."""
    train, test = table.filter("split = 'train'"), table.filter("split = 'test'")
    models = dp_train_all(train, features, label, epsilons, steps, seed=seed, share=share)
    facts, wide, names = [], test, []
    for i, (target, model) in enumerate(zip(epsilons, models)):
        name = "inf" if target is None else str(target)
        wide = model.score(wide, f"_eps_{i}")
        names.append((f"_eps_{i}", name))
        facts.append((name, model.epsilon, model.delta, model.noise_multiplier, model.fit_seconds))
    scores = F.explode(F.array(*[F.struct(F.lit(n).alias("epsilon_target"), F.col(c).alias("score")) for c, n in names]))
    long = wide.select(F.col(label).alias("label"), scores.alias("s")).select("label", "s.*")
    report = full_report(long, by=["epsilon_target"])
    known = table.sparkSession.createDataFrame(
        facts, "epsilon_target string, epsilon_spent double, delta double, noise_multiplier double, fit_seconds double")
    return known.join(report, "epsilon_target")
