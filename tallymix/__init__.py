"""Dirichlet-multinomial clustering of large sparse count tables on Spark.

The package keeps one row per nonzero cell, ``counts(sample_id, feature_id, x)``,
and expresses every model as joins and sums over those rows:

* sums by sample give expected log-likelihoods and soft memberships,
* sums by feature give group profiles and feature selection.

Everything else (mixture weights, objectives, pruning decisions) works on tables
of K rows or one row per model.
"""

__version__ = "0.1.0"
