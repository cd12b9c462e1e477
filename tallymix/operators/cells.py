"""The count table in the layout every pass uses.

``CountData`` keeps the nonzero cells hash-partitioned on disk by sample, so that a
pass over them never shuffles cells: sums by sample aggregate in place, memberships
travel to the cells, and sums by feature move only partial sums.

One sample or one feature may hold a large share of all cells. Keys with more than
``slice_rows`` cells are cut into slices (by a hash of the other key). Slices of a
hot sample live in different buckets and tables keyed by it are repeated once per
slice, so no task ever owns a hot key as a whole and every row is still matched
exactly once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.workspace import Workspace

BROADCAST_BYTES = 128 << 20  # largest table sent to every executor
MAX_HEAVY = 100_000  # at most this many keys are ever listed as hot
MAX_BUCKETS = 100_000  # Spark's own limit for bucketed tables


@dataclass
class CountData:
    ws: Workspace
    cells: DataFrame  # sample_id, feature_id, x (+ slice columns where there are hot keys)
    samples: DataFrame  # sample_id, n_i, nnz
    features: DataFrame  # feature_id, colsum, nnz
    n_samples: int
    n_features: int
    nnz: int
    total: float
    buckets: int
    heavy_samples: DataFrame | None = None  # sample_id, n_slices
    heavy_features: DataFrame | None = None
    empty_samples: DataFrame | None = None  # samples without any count
    broadcast_bytes: int = BROADCAST_BYTES
    packed: object = None  # the same cells by whole samples, once a fit has asked for them (operators.packed)

    @property
    def spark(self):
        return self.ws.spark

    @property
    def sample_key(self) -> list[str]:
        return ["sample_id"] + (["s_slice"] if self.heavy_samples is not None else [])

    @property
    def feature_key(self) -> list[str]:
        return ["feature_id"] + (["f_slice"] if self.heavy_features is not None else [])

    @property
    def cell_columns(self) -> list[str]:
        return self.sample_key + self.feature_key + ["x"]

    def feature_rows_fit(self, width: int, models: int = 1) -> bool:
        """Is a feature-keyed table of ``width`` numbers per row small enough to broadcast?"""
        return self.n_features * models * (width * 8 + 64) <= self.broadcast_bytes

    def with_features(self, cells: DataFrame, table: DataFrame, width: int, models: int = 1,
                      keys: list[str] | None = None) -> DataFrame:
        """Cells joined to a feature-keyed table: broadcast within the bound, sliced join beyond it."""
        keys = keys or []
        if self.feature_rows_fit(width, models):
            return cells.join(F.broadcast(table), keys + ["feature_id"])
        return cells.join(repeat_slices(table, self.heavy_features, "feature_id", "f_slice"), keys + self.feature_key)

    def with_samples(self, cells: DataFrame, table: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Cells joined to a sample-keyed table; only the table is shuffled."""
        sliced = repeat_slices(table, self.heavy_samples, "sample_id", "s_slice")
        return cells.join(sliced.hint("shuffle_hash"), self.sample_key + (keys or []))

    def add_empty_samples(self, per_sample: DataFrame, ids: list[int], zero: list[str]) -> DataFrame:
        """Rows for samples that have no cells, with 0 in the given columns."""
        if self.empty_samples is None:
            return per_sample
        listed = ", ".join(f"cast({int(i)} as int)" for i in ids)
        rows = self.empty_samples.selectExpr(f"explode(array({listed})) as model_id", "sample_id")
        return per_sample.unionByName(rows.select("*", *[F.lit(0.0).alias(c) for c in zero]))


def repeat_slices(table: DataFrame, heavy: DataFrame | None, key: str, slice_col: str) -> DataFrame:
    """Repeat the row of each hot key once per slice; all other rows get slice 0."""
    if heavy is None:
        return table
    marked = table.join(F.broadcast(heavy), key, "left")
    return marked.withColumn(
        slice_col, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_slices") - 1, F.lit(0))))
    ).drop("n_slices")


def _heavy(stats: DataFrame, key: str, limit: int) -> DataFrame:
    return stats.where(F.col("nnz") > limit).select(key, F.ceil(F.col("nnz") / limit).cast("int").alias("n_slices"))


def prepare(
    counts: DataFrame,
    ws: Workspace,
    samples: DataFrame | None = None,
    features: DataFrame | None = None,
    slice_rows: int = 1_000_000,
    bucket_rows: int = 4_000_000,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> CountData:
    """Lay out ``counts(sample_id, feature_id, x)`` for repeated passes.

    ``samples`` / ``features`` list ids that must count even without any cell.
    Raises on missing, negative or non-finite counts.
    """
    cells = counts.select("sample_id", "feature_id", F.col("x").cast("double").alias("x")).where("x is null or x != 0")
    cells = given = ws.put(cells, "counts")  # read twice below: what makes them runs once
    both = ws.put(
        cells.groupingSets([["sample_id"], ["feature_id"]], "sample_id", "feature_id").agg(
            F.grouping("sample_id").alias("by_feature"),
            F.sum("x").alias("total"),
            F.count("x").alias("nnz"),
            F.min("x").alias("low"),
            F.count_if(F.col("x").isNull()).alias("missing"),
        ),
        "margins",
    )
    sample_stats = both.where("by_feature = 0").select("sample_id", F.col("total").alias("n_i"), "nnz")
    feature_stats = both.where("by_feature = 1").select("feature_id", F.col("total").alias("colsum"), "nnz")

    empty = None
    if samples is not None:
        empty = ws.put(samples.select("sample_id").distinct().join(sample_stats, "sample_id", "left_anti"), "empty")
        sample_stats = sample_stats.unionByName(
            empty.select("sample_id", F.lit(0.0).alias("n_i"), F.lit(0).cast("bigint").alias("nnz"))
        )
    if features is not None:
        feature_stats = (
            features.select("feature_id")
            .distinct()
            .join(feature_stats, "feature_id", "full")
            .select(
                "feature_id",
                F.coalesce("colsum", F.lit(0.0)).alias("colsum"),
                F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"),
            )
        )

    size = sample_stats.agg(F.count("*"), F.sum("nnz"), F.sum("n_i"), F.max("nnz")).first()
    width = feature_stats.agg(F.count("*"), F.max("nnz")).first()
    low, missing = both.agg(F.min("low"), F.max("missing")).first()
    n_samples, nnz, total = size[0], size[1] or 0, size[2] or 0.0
    if missing or low is not None and low < 0 or not math.isfinite(total):
        raise ValueError("counts must be given, finite and not negative")

    limit = max(slice_rows, math.ceil(nnz / MAX_HEAVY))  # keeps the list of hot keys within MAX_HEAVY
    heavy_s = _heavy(sample_stats, "sample_id", limit) if (size[3] or 0) > limit else None
    heavy_f = _heavy(feature_stats, "feature_id", limit) if (width[1] or 0) > limit else None
    for heavy, key, other, col in (
        (heavy_s, "sample_id", "feature_id", "s_slice"),
        (heavy_f, "feature_id", "sample_id", "f_slice"),
    ):
        if heavy is not None:
            cells = (
                cells.join(F.broadcast(heavy), key, "left")
                .withColumn(col, F.pmod(F.xxhash64(other), F.coalesce("n_slices", F.lit(1))).cast("int"))
                .drop("n_slices")
            )

    parallel = ws.spark.sparkContext.defaultParallelism
    buckets = max(math.ceil(nnz / bucket_rows), min(parallel, math.ceil(nnz / 50_000)), 1)
    buckets = min(buckets, MAX_BUCKETS)
    key = ["sample_id"] + (["s_slice"] if heavy_s is not None else [])
    laid_out = ws.put(cells.repartition(buckets, *key), "cells", bucket_by=key, buckets=buckets)
    ws.release(given)
    return CountData(
        ws, laid_out, sample_stats, feature_stats, n_samples, width[0], nnz, total, buckets,
        heavy_s, heavy_f, empty, broadcast_bytes,
    )


def sums_by_sample(joined: DataFrame, aggregates: list[Column], keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """One row per (model, sample); partial sums are formed before anything moves."""
    return joined.groupBy(*keys, "sample_id").agg(*aggregates)


def sums_by_feature(joined: DataFrame, aggregates: list[Column], keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """One row per (model, feature); partial sums are formed before anything moves."""
    return joined.groupBy(*keys, "feature_id").agg(*aggregates)
