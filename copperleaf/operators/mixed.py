"""Mixed-effects logistic regression with crossed random intercepts: correct ~ precision * contaminated + (1|item) + (1|model).

The estimator is this library's own: penalised Newton steps for all effects together, with variances of the
random effects renewed from their conditional modes and variances (Laplace approximation). Estimates are close
to, and not the same as, those of variational Bayes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "interaction double, interaction_sd double, n long, converged boolean"
TERMS = ("intercept", "precision", "contaminated", "precision:contaminated")


def fit_glmm(item: np.ndarray, model: np.ndarray, precision: np.ndarray, contaminated: np.ndarray, correct: np.ndarray, *, rounds: int = 60) -> dict:
    """Fixed effects with standard deviations, in the order of TERMS, and the variances of both random effects."""
    x = np.column_stack([np.ones(len(correct)), precision, contaminated, precision * contaminated]).astype(float)
    groups = [np.unique(g, return_inverse=True) for g in (item, model)]
    at = [g[1] for g in groups]
    sizes = [len(g[0]) for g in groups]
    beta, u = np.zeros(4), [np.zeros(s) for s in sizes]
    var = [1.0, 0.3]
    prior = 1 / 2.0**2  # of fixed effects: a standard deviation of 2
    converged = False
    for step in range(rounds):
        for _ in range(15):
            eta = x @ beta + u[0][at[0]] + u[1][at[1]]
            p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            w, r = np.maximum(p * (1 - p), 1e-9), correct - p
            # items are a diagonal block: they are taken out first, what is left is small
            d = np.bincount(at[0], w, sizes[0]) + 1 / var[0]
            z = np.column_stack([x, np.eye(sizes[1])[at[1]]])
            zw = z * w[:, None]
            c = np.zeros((sizes[0], z.shape[1]))
            np.add.at(c, at[0], zw)
            penalty = np.concatenate([np.full(4, prior), np.full(sizes[1], 1 / var[1])])
            g_z = z.T @ r - penalty * np.concatenate([beta, u[1]])
            g_u = np.bincount(at[0], r, sizes[0]) - u[0] / var[0]
            h = z.T @ zw + np.diag(penalty) - c.T @ (c / d[:, None])
            move = np.linalg.solve(h, g_z - c.T @ (g_u / d))
            move_u = (g_u - c @ move) / d
            beta, u[1], u[0] = beta + move[:4], u[1] + move[4:], u[0] + move_u
            if max(np.abs(move).max(), np.abs(move_u).max()) < 1e-6:
                break
        cov = np.linalg.inv(h)
        spread = 1 / d + np.einsum("ij,jk,ik->i", c / d[:, None], cov, c / d[:, None])
        new = [float(np.mean(u[0] ** 2 + spread)), float(np.mean(u[1] ** 2 + np.diag(cov)[4:]))]
        new = [min(max(v, 1e-3), 25.0) for v in new]
        change = max(abs(a - b) / b for a, b in zip(new, var))
        var = new
        if change < 1e-3:
            converged = True
            break
    return {"effects": dict(zip(TERMS, beta.tolist())), "sd": dict(zip(TERMS, np.sqrt(np.diag(cov)[:4]).tolist())), "variances": var, "converged": converged}


def interaction_by(df: DataFrame, group: str) -> DataFrame:
    """(group, interaction, interaction_sd, n, converged) of each contrast: rows item_id, model, precision (0/1), contaminated, correct.

    One contrast, a few thousand rows by design (items x models x 2), is one task; rows with a null don't count.
    """
    from pyspark.sql import functions as F

    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fit_glmm(*(pdf[c].to_numpy() for c in ("item_id", "model")), *(pdf[c].to_numpy(float) for c in ("precision", "contaminated", "correct")))
        row = [pdf[group].iloc[0], got["effects"][TERMS[3]], got["sd"][TERMS[3]], len(pdf), got["converged"]]
        return pd.DataFrame([row], columns=[group, "interaction", "interaction_sd", "n", "converged"])

    rows = df.select(group, "item_id", "model", *[F.col(c).cast("double").alias(c) for c in ("precision", "contaminated", "correct")]).dropna()
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, {SCHEMA}")
