"""Starting memberships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import hash_uniform, normalised, num
from tallymix.operators.cells import CountData, sums_by_feature, sums_by_sample
from tallymix.operators.profiles import per_model, with_models


@dataclass(frozen=True)
class Start:
    """One clustering to start: which model, how many groups, which seed."""

    model_id: int
    k: int
    seed: int


def one_hot(label: str, k: str) -> str:
    """Array of length k with 1 at the label's place."""
    return f"transform(sequence(0, {k} - 1), i -> if(i = {label}, 1D, 0D))"


def init_from_labels(labels: DataFrame, k: int, model_id: int = 0, label: str = "label") -> DataFrame:
    """One-hot memberships from ``(sample_id, label)``."""
    return labels.selectExpr(f"cast({model_id} as int) as model_id", "sample_id", f"{one_hot(label, str(k))} as r")


def init_random(samples: DataFrame, starts: list[Start]) -> DataFrame:
    """Uniform draws scaled to sum to one, repeatable per (sample, model, seed)."""
    rows = with_models(samples.select("sample_id"), [s.model_id for s in starts])
    rows = rows.withColumn("_k", F.expr(f"cast({per_model({s.model_id: s.k for s in starts})} as int)"))
    rows = rows.withColumn("_seed", F.expr(f"cast({per_model({s.model_id: s.seed for s in starts})} as bigint)"))
    rows = rows.withColumn("_u", F.expr(f"transform(sequence(0, _k - 1), i -> {hash_uniform('sample_id', '_seed', 'i')})"))
    return normalised(rows, "_u", "r").select("model_id", "sample_id", "r")


def add_noise(resp: DataFrame, seed: int, scale: float = 0.01) -> DataFrame:
    """Small repeatable noise on memberships, scaled to sum to one again."""
    noise = f"{num(scale)} * {hash_uniform('sample_id', 'model_id', 'i', seed=seed)}"
    rows = resp.withColumn("_u", F.expr(f"transform(r, (v, i) -> v + {noise})")).drop("r")
    return normalised(rows, "_u", "r").select("model_id", "sample_id", "r")


def kmeans(
    data: CountData,
    starts: list[Start],
    n_init: int = 10,
    max_iter: int = 100,
    log1p: bool = True,
    members: DataFrame | None = None,
    tol: float = 1e-4,
) -> DataFrame:
    """Lloyd's k-means over the cells: ``(model_id, sample_id, label)`` of the best start per model.

    Distances come from sums by sample and centres from sums by feature, so rows are
    never assembled into dense vectors. All starts of all models run in the same jobs.
    Seeds are drawn one after the other with probability proportional to the squared
    distance to the nearest seed so far. ``members(model_id, sample_id)`` restricts
    each model to its own samples.
    """
    ws = data.ws
    tries = {s.model_id * n_init + t: Start(s.model_id * n_init + t, s.k, s.seed * 1009 + t)
             for s in starts for t in range(n_init)}
    width = max(s.k for s in starts)
    value = F.expr("log1p(x)" if log1p else "x")
    ids = sorted(tries)

    if members is None:
        cells = data.cells.withColumn("v", value)
        norms = cells.groupBy("sample_id").agg(F.expr("sum(v * v) as sq"))
        if data.empty_samples is not None:
            norms = norms.unionByName(data.empty_samples.select("sample_id", F.lit(0.0).alias("sq")))
        points = ws.put(with_models(norms, ids), "points")
        keys = []
    else:
        tried = members.selectExpr(
            "sample_id", f"explode(sequence(model_id * {n_init}, model_id * {n_init} + {n_init - 1})) as model_id"
        )
        cells = data.with_samples(data.cells, tried).withColumn("v", value)
        norms = cells.groupBy("model_id", "sample_id").agg(F.expr("sum(v * v) as sq"))
        points = ws.put(
            tried.join(norms, ["model_id", "sample_id"], "left").selectExpr(
                "sample_id", "coalesce(sq, 0D) as sq", "model_id"), "points")
        keys = ["model_id"]

    def dots(centers: DataFrame, k: int, prefix: str) -> DataFrame:
        joined = data.with_features(cells, centers, k, len(ids), keys)
        return sums_by_sample(joined, [F.expr(f"sum(v * c{i}) as {prefix}{i}") for i in range(k)])

    # --- seeds -------------------------------------------------------------------------
    # Draws depend on the start's seed, not on its model's number: a trial alone starts as it does among others.
    seed_of = f"cast({per_model({m: tries[m].seed for m in ids})} as bigint)"
    first = points.groupBy("model_id").agg(F.expr(f"min_by(sample_id, xxhash64(sample_id, {seed_of}))").alias("seed"))
    chosen = [{r["model_id"]: r["seed"] for r in first.collect()}]
    nearest = points.withColumn("d2", F.lit(float("inf")))
    base_cells = data.cells.withColumn("v", value).select("sample_id", "feature_id", "v")
    previous = None
    for step in range(1, width):
        last = data.spark.createDataFrame(
            [(m, s) for m, s in chosen[-1].items()], f"model_id int, sample_id {_id_type(data)}"
        )
        seed_cells = base_cells.join(F.broadcast(last), "sample_id").select(
            "model_id", "feature_id", F.col("v").alias("c0")
        )
        seed_sq = {r["model_id"]: r["sq"] for r in points.join(F.broadcast(last), ["model_id", "sample_id"]).collect()}
        near = dots(seed_cells, 1, "dot")
        d2 = f"greatest(sq - 2D * coalesce(dot0, 0D) + {per_model(seed_sq)}, 0D)"
        nearest = ws.put(
            nearest.join(near, ["model_id", "sample_id"], "left").selectExpr(
                "sample_id", "sq", "model_id", f"least(d2, {d2}) as d2"
            ), "nearest")
        ws.release(previous)
        previous = nearest
        u = hash_uniform("sample_id", str(step), seed_of, seed=17)
        key = f"ln(greatest({u}, 1e-300D)) / greatest(d2, 1e-12D)"
        picked = nearest.groupBy("model_id").agg(F.expr(f"max_by(sample_id, {key}) as seed"))
        chosen.append({r["model_id"]: r["seed"] for r in picked.collect()})
    ws.release(previous)
    seeds = data.spark.createDataFrame(
        [(m, k, chosen[k][m]) for m in ids for k in range(tries[m].k)],
        f"model_id int, k int, sample_id {_id_type(data)}",
    )
    centers = ws.put(
        base_cells.join(F.broadcast(seeds), "sample_id").groupBy("model_id", "feature_id").agg(
            *[F.expr(f"coalesce(max(if(k = {k}, v, null)), 0D) as c{k}") for k in range(width)]
        ), "centers")

    # --- Lloyd -------------------------------------------------------------------------
    inertia: dict[int, float] = {}
    labelled = None
    sizes = per_model({m: tries[m].k for m in ids})
    for _ in range(max_iter):
        norm_rows = centers.groupBy("model_id").agg(*[F.expr(f"sum(c{k} * c{k}) as n{k}") for k in range(width)])
        scored = points.join(dots(centers, width, "dot"), ["model_id", "sample_id"], "left").join(
            F.broadcast(norm_rows), "model_id"  # one row per start
        )
        dist = ", ".join(f"greatest(sq - 2D * coalesce(dot{k}, 0D) + n{k}, 0D)" for k in range(width))
        scored = scored.withColumn("dist", F.expr(f"slice(array({dist}), 1, cast({sizes} as int))"))
        fresh = ws.put(
            scored.selectExpr(
                "model_id", "sample_id", "cast(array_position(dist, array_min(dist)) - 1 as int) as label",
                "array_min(dist) as d2",
            ), "labels")
        ws.release(labelled)
        labelled = fresh
        now = {r["model_id"]: r["d2"] or 0.0 for r in
               labelled.groupBy("model_id").agg(F.sum("d2").alias("d2")).collect()}
        done = all(m in inertia and abs(inertia[m] - now[m]) <= tol * max(now[m], 1e-12) for m in now)
        inertia = now
        if done:
            break
        counted = labelled.groupBy("model_id").agg(
            *[F.expr(f"count_if(label = {k}) as n{k}") for k in range(width)]
        )
        sums = sums_by_feature(
            data.with_samples(cells, labelled, keys),
            [F.expr(f"sum(if(label = {k}, v, 0D)) as s{k}") for k in range(width)],
        )
        old = centers
        moved = old.join(sums, ["model_id", "feature_id"], "full").join(F.broadcast(counted), "model_id")
        centers = ws.put(
            moved.selectExpr(
                "model_id", "feature_id",
                *[f"if(n{k} > 0, coalesce(s{k}, 0D) / greatest(n{k}, 1), coalesce(c{k}, 0D)) as c{k}"
                  for k in range(width)],
            ), "centers")
        ws.release(old)
    ws.release(centers, points)

    best = [min((t for t in ids if t // n_init == s.model_id and t in inertia), key=lambda t: (inertia[t], t), default=None)
            for s in starts]
    keep = [b for b in best if b is not None]
    return labelled.where(F.col("model_id").isin(keep)).selectExpr(
        f"cast(model_id div {n_init} as int) as model_id", "sample_id", "label"
    )


def _id_type(data: CountData) -> str:
    return data.samples.schema["sample_id"].dataType.simpleString()


def init_kmeans(data: CountData, starts: list[Start], n_init: int = 10, max_iter: int = 100,
                log1p: bool = True) -> DataFrame:
    """One-hot memberships from k-means on log1p counts (or raw counts)."""
    labels = kmeans(data, starts, n_init, max_iter, log1p)
    size = f"cast({per_model({s.model_id: s.k for s in starts})} as int)"
    return labels.selectExpr("model_id", "sample_id", f"{one_hot('label', size)} as r")
