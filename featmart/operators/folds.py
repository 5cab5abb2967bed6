"""All folds of a cross-validated logistic model in one pass a step (M2, M4, M5).

The k models of a k-fold run differ in which fold they leave out. What each needs of the data before
training - the mean and spread of a number, the levels of a category and their counts - is kept per fold, and
"all but fold f" is the merge of the others, so one aggregate fits the preprocessing of all models. Training takes
Newton steps: a step needs gradient and Hessian sums, to which a row of fold g adds for every model but g. One
pass a step therefore serves all models, each with coefficients of its own; a task sums its Arrow batches as
matrix products and hands on k small sums. One more pass scores every row: with the model that left its fold out,
or with the mean of all models where it has no label.

The model is that of ``model.logistic`` behind ``model.preprocess_pipeline``: mean imputation, an indicator per level
(an unseen level is none), columns scaled by the sample deviation of the training rows, an intercept without
penalty, and a ridge term 1 / (C n). A step's sums are of size (columns)^2 per model, so the number of columns is
bounded; ``model.oof_scores`` fits one model after the other beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmart.operators.encode import unpivot_values

MAX_COLUMNS = 200
STEPS = 25
TOLERANCE = 1e-9


@dataclass
class Design:
    """Columns of the k models: numbers first, then (feature, level). ``mean``, ``scale``: (model, column); ``fill``: (model,
    number); scale 0 where a column does not vary in the model's training rows."""
    numeric: list[str]
    levels: list[tuple[str, str]]
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def matrix(self, numbers: list[np.ndarray], categories: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        """Raw columns of some rows, NaN where a number is missing, and which numbers are."""
        rows = len(numbers[0]) if numbers else len(next(iter(categories.values())))
        x = np.zeros((rows, len(self.numeric) + len(self.levels)))
        for i, v in enumerate(numbers):
            x[:, i] = v
        at = {f: {} for f in categories}
        for j, (f, level) in enumerate(self.levels):
            at[f][level] = len(self.numeric) + j
        for f, values in categories.items():
            cols = np.array([at[f].get(v, -1) for v in values])
            hit = np.flatnonzero(cols >= 0)
            x[hit, cols[hit]] = 1.0
        return x, np.isnan(x[:, :len(self.numeric)])

    def scaled(self, x: np.ndarray, missing: np.ndarray, model: int) -> np.ndarray:
        """The model's own columns, with the intercept's ones last."""
        z = x.copy()
        n = len(self.numeric)
        z[:, :n] = np.where(missing, self.fill[model], z[:, :n])
        return np.hstack(((z - self.mean[model]) * self.scale[model], np.ones((len(x), 1))))


def _merged(parts: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """(n, mean, sum of squares about it) of several groups together."""
    n, mean, m2 = 0.0, 0.0, 0.0
    for k, m, s in parts:
        if k:
            d = m - mean
            m2 += s + d * d * n * k / (n + k)
            mean += d * k / (n + k)
            n += k
    return n, mean, m2


def design(d: DataFrame, fold: str, numeric: Sequence[str], categorical: Sequence[str], k: int, max_columns: int = MAX_COLUMNS) -> Design | None:
    """The columns of all models from one aggregate per fold and one count per (fold, feature, level); None if there are
    more than ``max_columns``."""
    stats = {}
    if numeric:
        one = d.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), *[e for i, c in enumerate(numeric) for e in (
            F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))])
    else:
        one = d.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"))
    for r in one.collect():                                   # k rows
        stats[r[fold]] = r
    counts: dict[tuple[str, str], dict[int, int]] = {}
    if categorical:
        c = unpivot_values(d, categorical, extra=[fold]).filter(F.col("value").isNotNull()).groupBy("feature", "value", fold).agg(F.count(F.lit(1)).alias("n"))
        got = c.limit(k * max_columns + 1).collect()
        if len(got) > k * max_columns:
            return None
        for r in got:
            counts.setdefault((r["feature"], r["value"]), {})[r[fold]] = r["n"]
    levels = sorted(counts, key=lambda f: (list(categorical).index(f[0]), f[1]))
    p = len(numeric) + len(levels)
    if p > max_columns:
        return None
    fill, mean, scale = np.zeros((k, len(numeric))), np.zeros((k, p)), np.zeros((k, p))
    for f in range(k):
        rest = [s for g, s in stats.items() if g != f]
        rows = sum(s["rows"] for s in rest)
        spread = np.zeros(p)
        for i in range(len(numeric)):
            n, m, m2 = _merged([(s[f"n{i}"], s[f"m{i}"] or 0.0, (s[f"v{i}"] or 0.0) * s[f"n{i}"]) for s in rest])
            fill[f, i] = mean[f, i] = m          # imputed rows lie on the mean
            spread[i] = m2
        for j, key in enumerate(levels):
            n = sum(v for g, v in counts[key].items() if g != f)
            share = n / rows if rows else 0.0
            mean[f, len(numeric) + j] = share
            spread[len(numeric) + j] = n * (1 - share)
        deviation = np.sqrt(spread / max(rows - 1, 1))
        scale[f] = np.divide(1.0, deviation, out=np.zeros(p), where=deviation > 0)
    return Design(list(numeric), levels, fill, mean, scale)


def _inputs(b: pa.RecordBatch, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[list[np.ndarray], dict[str, list]]:
    numbers = [b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(numeric))]
    return numbers, {c: b.column(f"c{i}").to_pylist() for i, c in enumerate(categorical)}


def _narrow(d: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *more) -> DataFrame:
    return d.select(*more, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)],
                    *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)])


def _sums(rows: DataFrame, des: Design, categorical: Sequence[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian sums of every model at its coefficients ``w``: one pass."""
    k, p = w.shape
    upper = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, 1 + p + len(upper[0])))
        for b in batches:
            x, missing = des.matrix(*_inputs(b, des.numeric, categorical))
            fold, y = b.column("fold").to_numpy(), b.column("y").to_numpy()
            for f in range(k):
                own = fold != f
                if not own.any():
                    continue
                z, t = des.scaled(x[own], missing[own], f), y[own]
                m = z @ w[f]
                pr = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                out[f, 0] += np.logaddexp(0, m).sum() - (t * m).sum()
                out[f, 1:1 + p] += z.T @ (pr - t)
                out[f, 1 + p:] += ((z * (pr * (1 - pr))[:, None]).T @ z)[upper]
        yield pa.record_batch([pa.array(np.repeat(np.arange(k, dtype=np.int32), out.shape[1])), pa.array(np.tile(np.arange(out.shape[1], dtype=np.int32), k)),
                               pa.array(out.ravel())], names=["model", "at", "v"])

    parts = rows.mapInArrow(run, "model int, at int, v double")
    got = parts.groupBy("model", "at").agg(F.sum("v").alias("v")).toArrow()           # k * (columns squared) numbers
    out = np.zeros((k, 1 + p + len(upper[0])))
    out[got.column("model").to_numpy(), got.column("at").to_numpy()] = got.column("v").to_numpy()
    hess = np.zeros((k, p, p))
    hess[:, upper[0], upper[1]] = out[:, 1 + p:]
    hess = hess + hess.transpose(0, 2, 1) - np.stack([np.diag(np.diag(h)) for h in hess])
    return out[:, 0], out[:, 1:1 + p], hess


def newton(rows: DataFrame, des: Design, categorical: Sequence[str], n_fold: dict[int, int], ridge: float, k: int,
           steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, int]:
    """(coefficients (model, column + intercept), passes). A model whose step raises its loss takes half of it next."""
    p = len(des.numeric) + len(des.levels) + 1
    n = np.array([max(sum(v for g, v in n_fold.items() if g != f), 1) for f in range(k)], float)
    pen = np.append(np.full(p - 1, ridge), 0.0)
    w, move, last = np.zeros((k, p)), np.zeros((k, p)), np.full(k, np.inf)
    passes, done = 0, np.zeros(k, bool)
    while passes < steps and not done.all():
        loss, grad, hess = _sums(rows, des, categorical, w + move)
        passes += 1
        for f in np.flatnonzero(~done):
            here = w[f] + move[f]
            value = loss[f] / n[f] + 0.5 * (pen * here * here).sum()
            if value > last[f] + 1e-12 * max(1.0, abs(last[f])):
                move[f] /= 2
                continue
            w[f], last[f] = here, value
            g = grad[f] / n[f] + pen * here
            # a column that does not vary in this model has no curvature and keeps 0; the tiny term makes it solvable
            move[f] = -np.linalg.solve(hess[f] / n[f] + np.diag(pen + 1e-13), g)
            done[f] = np.abs(move[f]).max() < tolerance
    return w + np.where(done[:, None], move, 0.0), passes


def score(d: DataFrame, des: Design, categorical: Sequence[str], w: np.ndarray, fold: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``score``: by the model that left the row's fold out, or the mean of all for a null fold."""
    src = _narrow(d, des.numeric, categorical, *keep, F.col(fold).alias("fold_of_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, missing = des.matrix(*_inputs(b, des.numeric, categorical))
            of = b.column("fold_of_row").to_numpy(zero_copy_only=False).astype(float)
            each = np.stack([1 / (1 + np.exp(-np.clip(des.scaled(x, missing, f) @ w[f], -500, 500))) for f in range(len(w))])
            s = each.mean(axis=0)
            known = np.flatnonzero(~np.isnan(of))
            s[known] = each[of[known].astype(int), known]
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(s)], names=[*keep, "score"])

    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in keep], T.StructField("score", T.DoubleType())]))


@dataclass
class FoldModels:
    design: Design
    weights: np.ndarray
    passes: int


def fit(d: DataFrame, label: str, fold: str, numeric: Sequence[str], categorical: Sequence[str], k: int, C: float = 1.0,
        max_columns: int = MAX_COLUMNS) -> FoldModels | None:
    """The k models over the labelled rows of ``d`` (a fold 0..k-1 in the column ``fold``); None if there are too many columns."""
    lab = d.filter(F.col(label).isNotNull())
    des = design(lab, fold, numeric, categorical, k, max_columns)
    if des is None:
        return None
    n_fold = {r[fold]: r["n"] for r in lab.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}         # k rows
    rows = _narrow(lab, numeric, categorical, F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"))
    w, passes = newton(rows, des, categorical, n_fold, 1.0 / (C * max(sum(n_fold.values()), 1)), k)
    return FoldModels(des, w, passes)
