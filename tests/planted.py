"""Planted count tables and their frames, for the tests of the fits."""

import numpy as np


def planted(n=60, s=30, k=3, own=3.0, rest=0.1, draws=400, seed=42):
    """Counts with one block of features per group, and the true labels."""
    rng = np.random.default_rng(seed)
    alpha = np.full((k, s), rest)
    for g in range(k):
        alpha[g, g * (s // k):(g + 1) * (s // k)] = own
    labels = rng.integers(k, size=n)
    x = np.array([rng.multinomial(draws, rng.dirichlet(alpha[g])) for g in labels], float)
    return x, labels


def as_counts(spark, x):
    rows = [(int(i), f"f{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "sample_id bigint, feature_id string, x double")


def as_labels(spark, labels):
    return spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(labels)], "sample_id bigint, label int")
