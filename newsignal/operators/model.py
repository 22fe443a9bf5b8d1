"""Splits, scaling and linear classifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce
from operator import add, and_
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.operators.metrics import binary_metrics
from newsignal.session import at_once

# Last training day and first test day of the split by time.
TRAIN_END = "2025-11-12"
TEST_START = "2025-11-13"

TEST_BELOW = "33"  # first two hex digits: 51 of 256 values, one fifth of the keys


def hash_split(df: DataFrame, *keys: str, below: str = TEST_BELOW) -> DataFrame:
    """Adds `is_test`. All rows of a key fall on one side, on every run."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.withColumn("is_test", F.substring(F.md5(text), 1, 2) < below)


def time_split(df: DataFrame, train_end: str = TRAIN_END, test_start: str = TEST_START, date: str = "date") -> DataFrame:
    """Adds `is_test` by date; rows between the two days go."""
    day = F.col(date)
    train, test = day <= F.lit(train_end).cast("date"), day >= F.lit(test_start).cast("date")
    return df.where(train | test).withColumn("is_test", test)


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column: two numbers each."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Centres and scales; a constant column is only centred."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scales all rows with the statistics of the training rows."""
    return scale(df, fit_scaler(df.where(~F.col("is_test")), columns))


class LinearSvm(NamedTuple):
    """Weights by feature, intercept, the Newton steps taken and whether they came to rest."""

    weights: dict[str, float]
    intercept: float
    steps: int
    converged: bool


def _number(value) -> Column:
    return F.lit(float(value))


def fit_linear_svm(
    train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, max_iter: int = 100, tol: float = 1e-10
) -> LinearSvm:
    """Squared-hinge linear SVM by Newton steps; `c` weighs the loss against the norm.

    Minimises |w|^2 / 2 + c * sum(max(0, 1 - y * (w, x))^2) with y = -1 or 1, where
    a constant 1 among the x makes the intercept part of w. The optimum is unique.
    Where the rows with a loss stay the same, the objective is quadratic, so a
    step solves one small linear system. Each step is one aggregate: the loss
    and the sums of x * x' and y * x over the rows with a loss, a number per pair
    of features. A step that does not lower the objective is halved.

    Rows with a missing feature or label are left out; a table without others is
    an error. If the gradient is not within `tol` of zero, relative to the data,
    after `max_iter` steps, the model says so in `converged`.
    """
    n = len(features) + 1
    xs = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    y = 2 * F.col(label).cast("double") - 1
    known = reduce(and_, [x.isNotNull() & ~F.isnan(x) for x in [*xs, y]])
    ready = train.where(known).select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], y.alias("y"))
    x = [F.col(f"x{i}") for i in range(n)]
    upper = [(i, j) for i in range(n) for j in range(i, n)]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, Hessian and right side of the Newton system at w."""
        slack = 1 - F.col("y") * reduce(add, [_number(v) * k for v, k in zip(w, x)])
        here = ready.withColumn("slack", slack)
        active = F.col("slack") > 0

        def total(value: Column) -> Column:
            return F.coalesce(F.sum(F.when(active, value)), F.lit(0.0))

        row = here.agg(
            F.count("*"),
            total(F.col("slack") * F.col("slack")),
            *[total(F.col("y") * k) for k in x],
            *[total(x[i] * x[j]) for i, j in upper],
        ).first()
        if not row[0]:
            raise ValueError("no rows to train on")
        hessian, right = np.eye(n), 2 * c * np.array(row[2 : 2 + n])
        for (i, j), v in zip(upper, row[2 + n :]):
            hessian[i, j] += 2 * c * v
            hessian[j, i] = hessian[i, j]
        return float(w @ w / 2 + c * row[1]), hessian, right

    w = np.zeros(n)
    value, hessian, right = at(w)
    steps, step = 0, 1.0
    scale = 1 + np.abs(right).max()
    while steps < max_iter and np.abs(hessian @ w - right).max() > tol * scale:
        target = w + step * (np.linalg.solve(hessian, right) - w)
        found = at(target)
        steps += 1
        if found[0] < value or step < 1e-9:
            w, step = target, 1.0
            value, hessian, right = found
        else:
            step /= 2
    converged = bool(np.abs(hessian @ w - right).max() <= tol * scale)
    return LinearSvm(dict(zip(features, w[:-1].tolist())), float(w[-1]), steps, converged)


def predict(df: DataFrame, model: LinearSvm) -> DataFrame:
    """Adds `decision` (signed distance times the norm) and `prediction` (0/1); NULL where a feature is missing."""
    decision = reduce(add, [_number(w) * F.col(f) for f, w in model.weights.items()], _number(model.intercept))
    return df.withColumn("decision", decision).withColumn("prediction", (F.col("decision") > 0).cast("int"))


def train_and_predict(split: DataFrame, features: Sequence[str], label: str, max_iter: int = 100) -> DataFrame:
    """Predictions for the test rows of a table with `is_test`, and `converged`."""
    scaled = standardize(split.na.drop(subset=[*features, label]), features)
    model = fit_linear_svm(scaled.where(~F.col("is_test")), features, label, max_iter=max_iter)
    return predict(scaled.where("is_test"), model).withColumn("converged", F.lit(model.converged))


def model_report(
    split: DataFrame, feature_sets: Mapping[str, Sequence[str]], label: str, max_iter: int = 100
) -> DataFrame:
    """(model, accuracy, auc, converged): one classifier per feature set."""

    def one(name: str, features: Sequence[str]) -> DataFrame:
        scaled = standardize(split.na.drop(subset=[*features, label]), features)
        fitted = fit_linear_svm(scaled.where(~F.col("is_test")), features, label, max_iter=max_iter)
        found = binary_metrics(predict(scaled.where("is_test"), fitted), label, "decision")
        return found.withColumns({"model": F.lit(name), "converged": F.lit(fitted.converged)})

    rows = at_once(split.sparkSession, [partial(one, n, f) for n, f in feature_sets.items()])
    return reduce(DataFrame.unionByName, rows).select("model", "accuracy", "auc", "converged")
