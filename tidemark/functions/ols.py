"""Least squares on dummies with cluster-robust errors, from sums that Spark makes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tails


#: Share of the largest singular value below which a direction counts as none.
SINGULAR = 1e-9


def clustered_ols(rows: DataFrame, y: str, group: str, fixed: str, cluster: str) -> dict[str, float]:
    """y on dummies of ``group`` and ``fixed``: joint F of the group terms with errors clustered by ``cluster``.

    Rows are summed by (cluster, group, fixed) cell in Spark; a design has as many columns as labels, so only the normal
    equations and one score a cluster come to the driver.
    """
    kept = rows.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(group).alias("g"), F.col(fixed).alias("f"), F.col(cluster).alias("c"))
    cells = kept.groupBy("c", "g", "f").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")).collect()
    gs, fs = sorted({r.g for r in cells}), sorted({r.f for r in cells})
    width = len(gs) + len(fs) - 1

    def row(g: str, f: str) -> np.ndarray:
        x = np.zeros(width)
        x[0] = 1
        if g != gs[0]:
            x[gs.index(g)] = 1
        if f != fs[0]:
            x[len(gs) - 1 + fs.index(f)] = 1
        return x

    xtx, xty, n, syy, sy = np.zeros((width, width)), np.zeros(width), 0, 0.0, 0.0
    for r in cells:
        x = row(r.g, r.f)
        xtx += r.n * np.outer(x, x)
        xty += r.sy * x
        n, syy, sy = n + r.n, syy + r.syy, sy + r.sy
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    scores: dict[str, np.ndarray] = {}
    for r in cells:
        x = row(r.g, r.f)
        scores[r.c] = scores.get(r.c, 0) + (r.sy - r.n * (x @ beta)) * x
    k, m = len(scores), np.array(list(scores.values()))
    cov = inverse @ (m.T @ m) @ inverse * (k / (k - 1)) * ((n - 1) / (n - width))
    b, cov = beta[1 : len(gs)], cov[1 : len(gs), 1 : len(gs)]
    # a group with one row has no error of its own: as many terms are tested as the covariance has directions
    q = int(np.linalg.matrix_rank(cov, tol=SINGULAR * np.linalg.norm(cov, 2), hermitian=True))
    f_value = float(b @ np.linalg.pinv(cov, rcond=SINGULAR, hermitian=True) @ b / q)
    rss = syy - beta @ xty
    return {"F": f_value, "df1": q, "df2": k - 1, "p": tails.f_sf(f_value, q, k - 1), "n": n, "r_squared": float(1 - rss / (syy - sy * sy / n))}
