"""Preparation of count tables and labels.

Joins here carry no broadcast hints: adaptive execution broadcasts a side once its
measured size is small and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.functions.special import hash_uniform, hash_uniform_value, num
from tallymix.workspace import Workspace


def filter_features(counts: DataFrame, min_total: float) -> DataFrame:
    """Cells of features whose total over all samples reaches ``min_total``."""
    kept = counts.groupBy("feature_id").agg(F.sum("x").alias("total")).where(F.col("total") >= min_total)
    return counts.join(kept.select("feature_id"), "feature_id", "left_semi").select(*counts.columns)


def align(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Label rows of samples that occur in the count table."""
    return labels.join(counts.select("sample_id").distinct(), "sample_id", "left_semi").select(*labels.columns)


def encode_labels(labels: DataFrame, order: str) -> DataFrame:
    """Add ``label_id``: 0, 1, .. in order of first appearance along the numeric column ``order``."""
    first = labels.groupBy("label").agg(F.min(order).alias("first_seen"))
    return labels.join(dense_codes(first, "label", "first_seen"), "label").select(*labels.columns, "label_id")


def dense_codes(rows: DataFrame, key: str, order: str, parts: int = 200) -> DataFrame:
    """Dense ranks from 0 along ``order``: ``key, label_id``.

    Rows are cut at approximate quantiles, ranked inside their part and shifted by the
    number of values before it.
    """
    cuts = sorted(set(rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)))
    part = " + ".join(["0", *(f"cast({order} > {num(c)} as int)" for c in cuts)])
    cut = rows.selectExpr(key, order, f"{part} as _part")
    sizes = {r["_part"]: r["n"] for r in cut.groupBy("_part").agg(F.countDistinct(order).alias("n")).collect()}
    before, total = [], 0
    for i in range(len(cuts) + 1):  # one number per part
        before.append(total)
        total += sizes.get(i, 0)
    shift = f"get(array({', '.join(f'{v}L' for v in before)}), _part)"
    rank = f"dense_rank() over (partition by _part order by {order}) - 1"
    return cut.selectExpr(key, f"cast({shift} + {rank} as int) as label_id")


def map_label(labels: DataFrame, codes: dict[str, int], other: int, column: str = "label") -> DataFrame:
    """Recode labels by ``codes``; everything else becomes ``other``."""
    out = F.lit(other)
    for value, code in codes.items():
        out = F.when(F.col(column) == value, F.lit(code)).otherwise(out)
    return labels.withColumn("code", out)


def log1p_counts(counts: DataFrame) -> DataFrame:
    """ln(1+x); absent zero cells stay zero."""
    return counts.withColumn("x", F.log1p("x"))


def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg(F.sum("x").alias("n_i"))


def sparsity(counts: DataFrame) -> DataFrame:
    """Share of zero cells in the full table, as one row."""
    sizes = counts.where("x != 0").agg(
        F.count("*").alias("nnz"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.countDistinct("feature_id").alias("n_features"),
    )
    return sizes.selectExpr("nnz", "n_samples", "n_features", "1D - nnz / (n_samples * n_features) as sparsity")


def as_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric codes as category strings."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def annotate_tips(tips: DataFrame, set_a: DataFrame, set_b: DataFrame) -> DataFrame:
    """Symbol '+' for tips of A, '*' for tips of B (B wins), else empty. Sets hold ``feature_id``."""
    a = set_a.selectExpr("feature_id as tip").distinct().withColumn("in_a", F.lit(True))
    b = set_b.selectExpr("feature_id as tip").distinct().withColumn("in_b", F.lit(True))
    marked = tips.join(a, "tip", "left").join(b, "tip", "left")
    symbol = "case when in_b then '*' when in_a then '+' else '' end as symbol"
    return marked.selectExpr(*tips.columns, symbol)


def tip_colours(annotated: DataFrame) -> DataFrame:
    colour = "case symbol when '+' then 'red' when '*' then 'blue' else 'black' end as colour"
    return annotated.selectExpr("*", colour)


def band_by_range(df: DataFrame, index: str, ranges: list[tuple[int, int, str]], default: str) -> DataFrame:
    """Label rows by the range their index falls in; the last matching range wins."""
    label = F.lit(default)
    for low, high, name in ranges:
        label = F.when(F.col(index).between(low, high), F.lit(name)).otherwise(label)
    return df.withColumn("band", label)


def mask_cells(counts: DataFrame, rate: float, seed: int) -> DataFrame:
    """Drop cells at random, the same ones for the same seed."""
    return counts.where(f"{hash_uniform('sample_id', 'feature_id', seed=seed)} >= {num(rate)}")


def shuffled_places(samples: DataFrame, seed: int, ws: Workspace) -> DataFrame:
    """(sample_id, place): a fixed random order of the samples, places from 0 without gaps.

    One sort spread over ranges of the draw; a place is the row's number in its range plus the sizes of the ranges
    before it.
    """
    rows = samples.select("sample_id", F.expr(hash_uniform("sample_id", seed=seed)).alias("_u"))
    rows = rows.orderBy("_u", "sample_id").select("sample_id", F.monotonically_increasing_id().alias("_at"))
    rows = ws.put(rows, "shuffled").selectExpr("sample_id", "shiftright(_at, 33) as _part", "_at & 8589934591L as _at")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").select("sample_id", (F.col("_before") + F.col("_at")).alias("place"))


def batch_window(n: int, size: int, iteration: int, seed: int) -> list[tuple[int, int]]:
    """The places [from, to) of one batch: ``size`` in a row from a drawn one on, past the end from the front."""
    first, size = int(n * hash_uniform_value("batch", iteration, seed=seed)), min(size, n)
    whole = [(first, min(first + size, n)), (0, first + size - n)]
    return [(a, b) for a, b in whole if a < b]


def in_window(window: list[tuple[int, int]], column: str = "place") -> str:
    """The condition of a window, as comparisons that reach the files."""
    return " or ".join(f"({column} >= {a}L and {column} < {b}L)" for a, b in window) or "false"


def mini_batch(places: DataFrame, n: int, size: int, iteration: int, seed: int) -> DataFrame:
    """``size`` of the ``n`` samples of ``shuffled_places`` without replacement, the same ones for the same iteration
    and seed. Each sample is as likely as any other; neighbours of the order share batches more often."""
    return places.where(in_window(batch_window(n, size, iteration, seed))).select("sample_id")
