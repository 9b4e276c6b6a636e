"""Small panels and slow, plain reference computations."""

from __future__ import annotations

import datetime as dt

import numpy as np

START = dt.datetime(2020, 1, 1)


def panel(spark, series: dict, step=dt.timedelta(days=1), column="Value"):
    """{(station, feature): [values]} -> long panel."""
    rows = [(START + i * step, s, f, None if v is None else float(v)) for (s, f), vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"Date timestamp_ntz, Station string, Feature string, {column} double")


def values(df, column="Value") -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["Date"]):
        out.setdefault((r["Station"], r["Feature"]), []).append(r[column])
    return out


def random_matrix(rows: int, cols: int, gaps: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 2)) @ rng.normal(size=(2, cols)) + 0.1 * rng.normal(size=(rows, cols))
    base[rng.random(base.shape) < gaps] = np.nan
    return base


def matrix_panel(spark, x: np.ndarray, column="Value"):
    return panel(spark, {(f"s{j:02d}", "f"): [None if np.isnan(v) else v for v in x[:, j]] for j in range(x.shape[1])}, column=column)


def matrix_of(df, column="Value") -> np.ndarray:
    got = values(df, column)
    return np.array([[np.nan if v is None else v for v in got[k]] for k in sorted(got)]).T


def knn_reference(x: np.ndarray, k: int, weights: str) -> np.ndarray:
    out = x.copy()
    for i in range(len(x)):
        for j in range(x.shape[1]):
            if not np.isnan(x[i, j]):
                continue
            near = []
            for d in range(len(x)):
                shared = ~np.isnan(x[i]) & ~np.isnan(x[d])
                if not np.isnan(x[d, j]) and shared.any():
                    near.append((np.sqrt(x.shape[1] / shared.sum() * ((x[i] - x[d])[shared] ** 2).sum()), d))
            near = sorted(near)[:k]
            if not near:
                out[i, j] = np.nanmean(x[:, j]) if (~np.isnan(x[:, j])).any() else 0.0
            elif weights == "uniform":
                out[i, j] = np.mean([x[d, j] for _, d in near])
            elif near[0][0] == 0:
                out[i, j] = np.mean([x[d, j] for c, d in near if c == 0])
            else:
                out[i, j] = np.average([x[d, j] for _, d in near], weights=[1 / c for c, _ in near])
    return out


def dtw_reference(x, y, band: int) -> float:
    n = len(x)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            d[i, j] = abs(x[i - 1] - y[j - 1]) + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[n, n]


def ssim_reference(x: np.ndarray, y: np.ndarray) -> float:
    r = max(x.max(), y.max()) - min(x.min(), y.min())
    c1, c2, out = (0.01 * r) ** 2, (0.03 * r) ** 2, []
    for i in range(3, x.shape[0] - 3):
        for j in range(3, x.shape[1] - 3):
            a, b = x[i - 3:i + 4, j - 3:j + 4].ravel(), y[i - 3:i + 4, j - 3:j + 4].ravel()
            cov = np.cov(a, b)
            out.append((2 * a.mean() * b.mean() + c1) * (2 * cov[0, 1] + c2)
                       / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    return float(np.mean(out))


def ridge_reference(x: np.ndarray, rounds: int, tol: float = 1e-3) -> np.ndarray:
    """Chained regressions on explicit design matrices, with the evidence iteration written on residuals."""
    miss = np.isnan(x)
    cur = np.where(miss, np.nanmean(x, axis=0), x)
    order = [j for j in np.argsort(miss.sum(axis=0), kind="stable") if miss[:, j].any()]
    for _ in range(rounds):
        before = cur.copy()
        for j in order:
            others = [c for c in range(x.shape[1]) if c != j]
            a, b = cur[~miss[:, j]][:, others], x[~miss[:, j], j]
            a0, b0 = a.mean(axis=0), b.mean()
            a, b = a - a0, b - b0
            noise, weight, old = 1 / (b.var() + np.finfo(float).eps), 1.0, None
            solve = lambda: np.linalg.solve(a.T @ a + weight / noise * np.eye(a.shape[1]), a.T @ b)
            eig = np.linalg.eigvalsh(a.T @ a)
            for _ in range(300):
                w = solve()
                eff = np.sum(noise * eig / (weight + noise * eig))
                weight = (eff + 2e-6) / ((w ** 2).sum() + 2e-6)
                noise = (len(b) - eff + 2e-6) / (((b - a @ w) ** 2).sum() + 2e-6)
                if old is not None and np.abs(old - w).sum() < 1e-3:
                    break
                old = w
            w = solve()
            cur[miss[:, j], j] = (cur[miss[:, j]][:, others] - a0) @ w + b0
        if np.abs(cur - before).max() < tol * np.abs(x[~miss]).max():
            break
    return cur
