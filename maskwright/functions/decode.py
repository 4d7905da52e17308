"""Decoders: per-token argmax as a column expression, constrained best path as an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from maskwright.plans.labels import FORBIDDEN, Moves


def _number(v: Column) -> Column:
    return F.when(F.isnan(v) | v.isNull(), F.lit(float("-inf")).cast("float")).otherwise(v)


def argmax_label(scores: Column) -> Column:
    """Class of the greatest score; the first of equals, never a NaN, 0 if all are NaN."""
    clean = F.transform(scores, _number)
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def log_softmax(scores: Column) -> Column:
    """Scores minus the logarithm of the sum of their exponentials, in double."""
    top = F.array_max(scores).cast("double")
    total = F.ln(F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top)))
    return F.transform(scores, lambda v: v.cast("double") - top - total)


def top_labels(scores: Column, k: int) -> Column:
    """The k best classes as structs (label_id, score); equal scores keep the lower class first."""
    ranked = F.array_sort(F.transform(scores, lambda v, i: F.struct((-_number(v)).alias("neg"), i.alias("label_id"), v.alias("score"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["label_id"].alias("label_id"), s["score"].alias("score")))


def argmax_path(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), -np.inf, scores).argmax(1)


def best_path(scores: np.ndarray, m: Moves) -> np.ndarray:
    """The best legal label sequence of float32 scores [tokens, classes].

    Ties go to the lower class. A step whose every candidate is forbidden keeps the forbidden score
    and points at class 0. If no end state is within reach, the argmax of each token stands.
    """
    t = len(scores)
    if t == 0:
        return np.zeros(0, np.int64)
    scores = scores.astype(np.float32)
    # NaN never wins a comparison.
    at = scores[0] + m.start
    back = np.zeros((t, len(at)), np.int64)
    columns = np.arange(len(at))
    for k in range(1, t):
        candidate = at[:, None] + m.matrix
        ranked = np.where(np.isnan(candidate), -np.inf, candidate)
        best = ranked.argmax(0)
        value = ranked[best, columns]
        lost = ~(value > FORBIDDEN)
        back[k] = np.where(lost, 0, best)
        at = np.where(lost, FORBIDDEN, value).astype(np.float32) + scores[k]
    final = at + m.end
    if not (np.isfinite(final) & (final > FORBIDDEN / 2)).any():
        return argmax_path(scores)
    path = np.empty(t, np.int64)
    path[-1] = np.where(np.isnan(final), -np.inf, final).argmax()
    for k in range(t - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float32) for r in rows], np.float32) if rows is not None and len(rows) else np.zeros((0, 0), np.float32)


def viterbi_udf(m: Moves):
    """array<array<float>> -> array<int>, one document a row."""

    @F.pandas_udf("array<int>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda rows: best_path(matrix(rows), m).astype(np.int32))

    return decode
