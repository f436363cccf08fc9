"""Small dense algebra for rows that hold one aggregated matrix each."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# tasks get these helpers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANK_TOLERANCE = 1e-12


def _square(rows: pd.Series) -> np.ndarray:
    flat = np.stack([np.asarray(r, dtype=float) for r in rows])
    size = int(round(np.sqrt(flat.shape[1])))
    return flat.reshape(len(flat), size, size)


def least_squares(covariances: pd.Series, with_target: pd.Series) -> pd.Series:
    """Least-squares coefficients from centred second moments, one fit per row.

    Features are scaled to unit variance before solving. Where columns are dependent, the answer is
    the one with the smallest norm in the original units.
    """
    if len(covariances) == 0:
        return pd.Series([], dtype=object)
    gram = _square(covariances)
    target = np.stack([np.asarray(r, dtype=float) for r in with_target])
    spread = np.sqrt(np.clip(np.einsum("kii->ki", gram), 0.0, None))
    varies = spread > 0
    scale = np.where(varies, spread, 1.0)
    correlation = gram / (scale[:, :, None] * scale[:, None, :])
    values, vectors = np.linalg.eigh(correlation)
    kept = values > RANK_TOLERANCE * np.maximum(values[:, -1:], 1e-300)
    projected = np.einsum("kij,ki->kj", vectors, target / scale)
    weights = np.where(kept, projected / np.where(kept, values, 1.0), 0.0)
    coefficients = np.einsum("kij,kj->ki", vectors, weights) / scale
    for k in np.flatnonzero(~kept.all(axis=1)):
        free = vectors[k][:, ~kept[k]] / scale[k][:, None]
        basis, _ = np.linalg.qr(free)
        coefficients[k] -= basis @ (basis.T @ coefficients[k])
    coefficients = np.where(varies, coefficients, 0.0)
    return pd.Series(list(coefficients))


def log_determinant(correlations: pd.Series) -> pd.Series:
    """ln det of each correlation matrix, NaN where it is singular."""
    if len(correlations) == 0:
        return pd.Series([], dtype=float)
    matrices = _square(correlations)
    complete = np.isfinite(matrices).all(axis=(1, 2))
    safe = np.where(complete[:, None, None], matrices, np.eye(matrices.shape[1]))
    sign, value = np.linalg.slogdet(safe)
    usable = complete & (sign > 0) & (np.linalg.eigvalsh(safe)[:, 0] > RANK_TOLERANCE)
    return pd.Series(np.where(usable, value, np.nan))


def partial_correlations(correlations: pd.Series) -> pd.Series:
    """Flattened matrix of partial correlations (pseudo-inverse), NaN where input is incomplete."""
    if len(correlations) == 0:
        return pd.Series([], dtype=object)
    matrices = _square(correlations)
    complete = np.isfinite(matrices).all(axis=(1, 2))
    safe = np.where(complete[:, None, None], matrices, np.eye(matrices.shape[1]))
    inverse = np.linalg.pinv(safe, hermitian=True)
    diagonal = np.sqrt(np.clip(np.einsum("kii->ki", inverse), 1e-300, None))
    partial = -inverse / (diagonal[:, :, None] * diagonal[:, None, :])
    partial[:, np.arange(partial.shape[1]), np.arange(partial.shape[1])] = 1.0
    partial[~complete] = np.nan
    return pd.Series(list(partial.reshape(len(partial), -1)))


# ---- orthogonal factors --------------------------------------------------------------------------

# below this share of its length a column is rounding: constant, or dependent on others
NO_LENGTH = 1e-13


def factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of a tall matrix, which stands for its rows in every least-squares fit; few rows stay."""
    return rows if len(rows) <= rows.shape[1] else np.linalg.qr(rows, mode="r")


def merge_factors(lists: pd.Series, width: int) -> pd.Series:
    """One flattened factor for each list of flattened factors of ``width`` columns."""
    stacked = (np.concatenate([np.asarray(r, dtype=float) for r in rows]).reshape(-1, width) for rows in lists)
    return pd.Series([factor(rows).ravel() for rows in stacked], dtype=object)


def solve_factors(flat: pd.Series, width: int) -> pd.Series:
    """Coefficients from flattened factors of the columns (1, features, target).

    What is left of a factor without its first row and column is the factor of the columns about their means. Columns
    are scaled to one length before the rank is judged. Where they are dependent, the answer is the one with the
    smallest norm in the original units; a constant column has zero.
    """
    return pd.Series([_solve(np.asarray(r, dtype=float).reshape(-1, width)) for r in flat], dtype=object)


def _solve(rows: np.ndarray) -> np.ndarray:
    whole = np.linalg.qr(rows, mode="r")
    features, target = whole[1:, 1:-1], whole[1:, -1]
    length = np.linalg.norm(features, axis=0)
    varies = length > NO_LENGTH * np.linalg.norm(whole[:, 1:-1], axis=0)
    scale = np.where(varies, length, 1.0)
    if not len(features):
        return np.zeros(features.shape[1])
    left, values, right = np.linalg.svd(np.where(varies, features / scale, 0.0), full_matrices=False)
    kept = values > NO_LENGTH * max(values[0], 1e-300)
    weights = np.where(kept, left.T @ target, 0.0) / np.where(kept, values, 1.0)
    coefficients = right.T @ weights / scale
    dependent = varies.sum() - kept.sum()
    if dependent:
        # the directions no row tells anything about
        free = np.linalg.svd(np.where(varies, features / scale, 0.0))[2][kept.sum() :] / scale
        basis, _ = np.linalg.qr(np.where(varies, free, 0.0).T)
        coefficients = coefficients - basis @ (basis.T @ coefficients)
    return np.where(varies, coefficients, 0.0)
