"""Readers and writers: wide count tables, labels, feature lists, trees, models, trials."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from tallymix.plans.mixture import Fit

TIP_PATTERN = r"[(,]([A-Za-z_0-9.]+):"  # Fixed value: a leaf name in Newick text stands between ( or , and :


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.option("sep", sep).csv(path).limit(1).first()
    return [c if c is not None else "" for c in first]


def read_counts(spark: SparkSession, path: str, sep: str = ",", features_in_rows: bool = False) -> DataFrame:
    """A wide count table as ``counts(sample_id, feature_id, x)`` without zero cells.

    The first column names the rows. With ``features_in_rows`` rows are features and the
    header names the samples; the long form needs no transposition for that.
    """
    names = _header(spark, path, sep)
    row, column = ("feature_id", "sample_id") if features_in_rows else ("sample_id", "feature_id")
    # positional names: headers may hold characters that mean something in SQL
    fields = [T.StructField("id", T.StringType())] + [
        T.StructField(f"c{i}", T.DoubleType()) for i in range(1, len(names))
    ]
    wide = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).schema(
        T.StructType(fields)).csv(path)
    return long_counts(wide, "id", {f"c{i}": n for i, n in enumerate(names) if i > 0}, row, column)


def long_counts(wide: DataFrame, id_col: str, columns: dict[str, str], row: str = "sample_id",
                column: str = "feature_id") -> DataFrame:
    """Unpivot the listed columns (column -> name in the result) and drop zero cells."""
    long = wide.unpivot([id_col], list(columns), "_c", "x").where("x != 0")
    renamed = {c: n for c, n in columns.items() if c != n}
    if renamed:
        # a wide table is at most some thousand columns: the header is the bound of this list
        names = F.broadcast(long.sparkSession.createDataFrame(list(columns.items()), "_c string, _name string"))
        long = long.join(names, "_c").withColumn("_c", F.col("_name"))
    return long.select(
        F.col(id_col).alias(row), F.col("_c").alias(column), F.col("x").cast("double").alias("x")
    ).select("sample_id", "feature_id", "x")


def read_labels(spark: SparkSession, path: str, id_col: str = "Index", label_col: str = "Label") -> DataFrame:
    """Sample metadata as ``labels(sample_id, label)``."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(f"`{id_col}`").alias("sample_id"), F.col(f"`{label_col}`").alias("label"))


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """Ranked feature scores ``(feature_id, score)``."""
    schema = "feature_id string, score double"
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_ordination(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Two-dimensional coordinates with label columns; ``schema`` names the columns in file order."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def tip_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """Leaf names of Newick text in order: ``tips(tip_index, tip)``, index from 1 per line."""
    names = F.regexp_extract_all(F.col(text), F.lit(TIP_PATTERN), F.lit(1))
    keys = [c for c in lines.columns if c != text]
    return lines.select(*keys, F.posexplode(names).alias("pos", "tip")).select(
        *keys, (F.col("pos") + 1).alias("tip_index"), "tip"
    )


def tree_tips(spark: SparkSession, path: str) -> DataFrame:
    return tip_rows(spark.read.text(path, wholetext=True))


def validate_counts(counts: DataFrame, raise_errors: bool = False) -> DataFrame:
    """One row: cells, samples, features, and how many cells are negative, not finite or duplicated."""
    cells = counts.groupBy("sample_id", "feature_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x") < 0).alias("negative"),
        F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).alias("bad"),
    )
    report = cells.agg(
        F.sum("n").alias("cells"),
        F.countDistinct("sample_id").alias("samples"),
        F.countDistinct("feature_id").alias("features"),
        F.sum("negative").alias("negative"),
        F.sum("bad").alias("not_finite"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
    )
    if raise_errors:
        row = report.first()
        if row["negative"] or row["not_finite"] or row["duplicates"]:
            raise ValueError(f"invalid counts: {row.asDict()}")
    return report


def counts_from_events(events: DataFrame, sample: str, feature: str, weight: str | None = None) -> DataFrame:
    """Counts (or sums of ``weight``) per sample and feature of any event or fact table."""
    value = F.sum(weight) if weight else F.count("*")
    return (
        events.groupBy(F.expr(sample).alias("sample_id"), F.expr(feature).alias("feature_id"))
        .agg(value.cast("double").alias("x"))
        .where("x != 0")
    )


def save_trials(trials: DataFrame, path: str) -> None:
    """All trial records as JSON lines."""
    trials.write.mode("overwrite").json(path)


def save_model(fit: Fit, path: str) -> None:
    """Fitted tables below ``path``: profiles, memberships, per-cell selection where there is one, and numbers."""
    fit.state.params.write.mode("overwrite").parquet(f"{path}/params")
    fit.state.resp.write.mode("overwrite").parquet(f"{path}/resp")
    if fit.state.cells is not None:
        fit.state.cells.drop("s_slice", "f_slice").write.mode("overwrite").parquet(f"{path}/cells")
    rows = [(i, fit.spec.name, fit.spec.selection, json.dumps(vars(m))) for i, m in fit.models.items()]
    spark = fit.data.spark
    table = spark.createDataFrame(rows, "model_id int, spec string, selection string, numbers string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/models")


def load_model(spark: SparkSession, path: str, data) -> Fit:
    """A model written by ``save_model``, ready to predict or to go on fitting on ``data``."""
    from dataclasses import replace

    from tallymix.plans.mixture import Fit, Model, State
    from tallymix.plans.specs import FITS

    models, spec = {}, None
    for r in spark.read.parquet(f"{path}/models").collect():  # one row per model
        numbers = json.loads(r["numbers"])
        numbers["history"] = [tuple(h) for h in numbers["history"]]
        models[r["model_id"]] = Model(**numbers)
        spec = replace(FITS[r["spec"]], selection=r["selection"])
    params, resp = spark.read.parquet(f"{path}/params"), spark.read.parquet(f"{path}/resp")
    cells = None
    if spec.selection == "sample":
        stored = spark.read.parquet(f"{path}/cells").select("model_id", "sample_id", "feature_id", "f")
        cells = data.cells.join(stored, ["sample_id", "feature_id"]).select("model_id", *data.cell_columns, "f")
    return Fit(data, spec, State(models, params, resp, cells))
