"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import id_long, id_text, KEY_BITS, gram_hashes, order_key, summed_arrays, word_hashes
from tallymix.workspace import Workspace

BUCKETS = 10_000
TARGET_DOCS = 20_000  # labelled documents that the target model is fitted on, at most
_TOKENS = re.compile(r"\w+|[^\w\s]+")


def buckets(text: str | None, n_buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and pairs of words of a text; runs of signs are words too."""
    h = word_hashes(_TOKENS.findall(text.lower()) if text else [])
    return (np.concatenate([gram_hashes(h, 1), gram_hashes(h, 2)]) % np.uint64(n_buckets)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TARGET_DOCS, seed: int = 5,
        n_buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) by bucket, each with one added to every count.

    Raw text is all of ``docs`` (doc_id, text). Target text is those with quality 1 in ``labels`` (doc_id, quality),
    of the first ``max_docs`` such ids in seeded hash order. Without any, all ratios are 0.
    """
    good = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.distinct().withColumn("key", order_key(seed, "doc_id")).orderBy("key", "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(good.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left")  # at most max_docs rows

    def count(batches):
        total = np.zeros((2, n_buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"]):
                found = np.bincount(buckets(text, n_buckets), minlength=n_buckets)
                total[0] += found
                if target:
                    total[1] += found
        yield pd.DataFrame({"v": [total.astype("<i8").tobytes()]})

    total = summed_arrays(rows.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInPandas(count, "v binary"), "<i8")
    if not len(total) or not total[n_buckets:].any():
        return np.zeros(n_buckets)
    raw, target = total.reshape(2, n_buckets) + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def resample(docs: DataFrame, log_ratio: np.ndarray, share: float, seed: int = 13, ws: Workspace | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_grams, log_ratio, key, kept.

    ``key`` is the text's log ratio plus Gumbel noise from the seeded hash of its doc_id; the ceil(share * rows)
    greatest keys are kept, which draws without replacement in proportion to the importance weights. Ties go to the
    smaller doc_id, null first. A text without words (or null) has log ratio 0. Repeated rows have equal keys, and as
    many stay as fit. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    ws = ws or Workspace(docs.sparkSession)
    weights = log_ratio

    def score(batches):
        for batch in batches:
            found = [buckets(t, len(weights)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_grams": [len(b) for b in found],
                                "log_ratio": [float(weights[b].sum()) for b in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = id_long(id_text(rows).mapInPandas(score, "doc_id string, n_grams bigint, log_ratio double"))
    uniform = (order_key(seed, "doc_id") + 0.5) / float(1 << KEY_BITS)
    rows = rows.withColumn("key", F.col("log_ratio") - F.log(-F.log(uniform)))
    rows = ws.put(rows, "keys").withColumn("whole", F.floor("key")).withColumn("part", F.floor(F.col("key") * 1024))
    # Rows above: of greater whole keys, then of greater 1024ths, then inside one 1024th.
    parts = rows.groupBy("whole", "part").agg(F.count("*").alias("c"))
    wholes = parts.groupBy("whole").agg(F.sum("c").alias("c"))
    up = Window.orderBy(F.desc("whole")).rowsBetween(Window.unboundedPreceding, -1)
    wholes = wholes.select("whole", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("base"),
                           F.sum("c").over(Window.partitionBy()).alias("rows"))
    up = Window.partitionBy("whole").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inner", F.coalesce(F.sum("c").over(up), F.lit(0))).join(wholes, "whole").select(
        "part", (F.col("base") + F.col("inner")).alias("above"), "rows")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("key"), "doc_id"))
    return rows.join(parts, "part").select(
        "doc_id", "n_grams", "log_ratio", "key", (F.col("above") + rank <= F.ceil(F.col("rows") * share)).alias("kept"))


def good_share(labels: DataFrame) -> float:
    """The share of quality 1 among the labelled rows; 1 without labels."""
    found = labels.where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    return 1.0 if found is None else float(found)
