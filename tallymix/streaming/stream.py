"""Keep a mini-batch model current from a stream of counts.

Each micro-batch of ``(sample_id, feature_id, x)`` makes one step. The state after a
batch is written below ``state_path/batch=<id>`` with a marker as the last file, so a
replayed batch finds its result and changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.operators.cells import prepare
from tallymix.operators.profiles import with_models
from tallymix.plans.stochastic import BatchModel, batch_step, read_totals, start_sticks
from tallymix.sources.tables import counts_from_events
from tallymix.workspace import Workspace


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def batch_path(state_path: str, batch_id: int) -> str:
    return f"{state_path}/batch={batch_id:010d}"


def latest_before(spark: SparkSession, state_path: str, batch_id: int) -> int | None:
    """Last finished batch before ``batch_id``."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return None
    done = []
    for status in fs.listStatus(jpath):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < batch_id and _exists(spark, f"{state_path}/{name}/model"):
            done.append(int(name[6:]))
    return max(done, default=None)


def load_state(spark: SparkSession, state_path: str, batch_id: int) -> tuple[DataFrame, dict[int, BatchModel], dict]:
    path = batch_path(state_path, batch_id)
    row = spark.read.json(f"{path}/model").first()
    models = {int(i): BatchModel(**m) for i, m in json.loads(row["models"]).items()}
    return spark.read.parquet(f"{path}/params"), models, json.loads(row["counters"])


def save_state(spark: SparkSession, state_path: str, batch_id: int, params: DataFrame, models: dict[int, BatchModel],
               counters: dict) -> None:
    path = batch_path(state_path, batch_id)
    params.write.mode("overwrite").parquet(f"{path}/params")
    row = [(json.dumps({i: vars(m) for i, m in models.items()}), json.dumps(counters))]
    # written last: its presence marks the batch as done
    spark.createDataFrame(row, "models string, counters string").coalesce(1).write.mode("overwrite").json(f"{path}/model")


def update_from_batch(counts: DataFrame, batch_id: int, state_path: str, p: dict, seed: int = 42) -> bool:
    """Apply one micro-batch; returns False where the batch was already applied or is empty."""
    spark = counts.sparkSession
    if _exists(spark, f"{batch_path(state_path, batch_id)}/model"):
        return False
    last = latest_before(spark, state_path, batch_id)
    if counts.isEmpty():
        return False
    data = prepare(counts, Workspace(spark))
    if last is None:
        models = {0: BatchModel(0, p, p["k_max"])}
        start_sticks(models[0])
        params, counters = None, {"steps": 0, "samples": 0}
    else:
        params, models, counters = load_state(spark, state_path, last)
    known = data.features.select("feature_id")
    if params is not None:
        known = known.join(params.select("feature_id").distinct(), "feature_id", "left_anti")
    # unseen features start at the prior, with a small draw so that groups can part
    fresh = with_models(known, sorted(models)).selectExpr(
        "model_id", "feature_id",
        f"transform(sequence(0, {models[0].k - 1}), k -> 1D + pmod(xxhash64(feature_id, k, {seed}), 1000) / 1000D) as lam",
        "1D as iota", f"transform(sequence(0, {models[0].k - 1}), k -> 0.5D) as phi",
    )
    params = fresh if params is None else params.unionByName(fresh)
    params = data.ws.put(params, "params")
    data.n_features = params.where("model_id = 0").count()
    read_totals(data, params, models)
    counters = {"steps": counters["steps"] + 1, "samples": counters["samples"] + data.n_samples}
    params, models = batch_step(data, params, models, float(counters["samples"]), counters["steps"])
    for m in models.values():
        m.n_iter = counters["steps"]
    save_state(spark, state_path, batch_id, params, models, counters)
    data.ws.release(params)
    return True


def fit_stream(stream: DataFrame, state_path: str, p: dict, checkpoint: str, seed: int = 42,
               sample: str | None = None, feature: str | None = None, available_now: bool = True):
    """Start the streaming fit. ``stream`` carries counts, or events to be counted by ``sample`` and ``feature``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        counts = counts_from_events(batch, sample, feature) if sample else batch
        update_from_batch(counts.select("sample_id", "feature_id", F.col("x")), batch_id, state_path, p, seed)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
