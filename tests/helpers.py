"""Deterministic fixture panels."""

import numpy as np

from panelweave.operators.panel import LONG_SCHEMA


def default_rows(n=4, d=4, t=3, labels=("ctrl", "treat"), elapsed=None, onset=None):
    """Closed panel with values (7 i mod 97) + 1 in column-major order."""
    elapsed = elapsed or [7.0 * k for k in range(t)]
    onset = t if onset is None else onset
    x = np.array([(7 * i) % 97 + 1 for i in range(1, n * d * t + 1)], float).reshape((n, d, t), order="F")
    x /= x.sum(axis=1, keepdims=True)
    return [
        (f"sample_{i + 1:03d}", f"time_{k + 1:03d}", float(elapsed[k]), f"feature_{j + 1:03d}", float(x[i, j, k]), labels[i % len(labels)], k + 1 >= onset)
        for k in range(t)
        for i in range(n)
        for j in range(d)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, LONG_SCHEMA).repartition(3)


def causal_array(seed=11, n=20, n_treated=5, t=9, t0=5, beta=(0.8, -0.5, 0.2)):
    """(values, treated): unit and time effects plus a known shift."""
    rng = np.random.default_rng(seed)
    d = len(beta)
    x = np.array([1.0, 2.0, 0.5])[:d][None, :, None] + rng.normal(0, 0.5, (n, d, 1)) + rng.normal(0, 0.3, (1, d, t)) + rng.normal(0, 0.2, (n, d, t))
    treated = np.arange(n) < n_treated
    x[treated, :, t0 - 1 :] += np.array(beta)[None, :, None]
    return x, treated


def causal_rows(x, treated, t0, labels=None):
    n, d, t = x.shape
    labels = labels or ["treat" if f else "ctrl" for f in treated]
    return [
        (f"s{i:02d}", f"time_{k + 1:03d}", float(3 * k), f"f{j}", float(x[i, j, k]), labels[i], k + 1 >= t0) for i in range(n) for j in range(d) for k in range(t)
    ]
