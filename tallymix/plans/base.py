"""The first-order model with one selection value per sample and feature.

Its selection varies over zero cells too, so the work is samples x features x groups by
nature. Samples are cut into chunks and features into blocks; one row holds one tile
(a chunk meeting a block) with the nonzero cells inside, laid out by chunk. A kernel evaluates
tiles and returns sums by sample or by feature. Selection is never stored: it follows from the
previous memberships and profiles and is recomputed inside the tile. Between rounds there is
one row per model and chunk (memberships of this round and the one before) and one per model
and feature (profiles, and the scores the round before had used).

Where one block holds all features, a tile has all that its samples need: a round is then one
pass, and the numbers of the block's features stay on the driver between rounds.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import (
    digamma, digamma_array, digamma_value, hash_uniform, lgamma_array, num, with_softmax)
from tallymix.operators import weights as wt
from tallymix.operators.cells import CountData
from tallymix.operators.initial import Start, init_from_labels, init_kmeans, init_random
from tallymix.operators.likelihood import unfold
from tallymix.operators.packed import summed
from tallymix.operators.profiles import with_models

CHUNK, BLOCK = 256, 4096  # samples and features of one tile
MAX_BUCKETS = 20_000


@dataclass
class BaseModel:
    model_id: int
    k: int
    prior: float  # weight prior
    select_prior: float
    a: list[float] = field(default_factory=list)
    b: list[float] = field(default_factory=list)
    gamma_sum: list[float] = field(default_factory=list)
    iota_sum: float = 0.0
    log_norm: float = 0.0  # mean log normaliser of the last memberships, the bound starts are compared by
    n_iter: int = 0


@dataclass
class Tiles:
    """The static part: chunks of samples, blocks of features, nonzero cells per tile."""

    cells: DataFrame  # chunk, block, s, p, x (arrays), bucketed by chunk
    samples: DataFrame  # sample_id, chunk, pos, n_i
    features: DataFrame  # feature_id, block, pos
    chunks: int
    blocks: int


def make_tiles(data: CountData, chunk: int = CHUNK, block: int = BLOCK) -> Tiles:
    """Cut the table into tiles; every (chunk, block) pair is present, also without cells."""
    ws = data.ws
    chunks, blocks = max(1, math.ceil(data.n_samples / chunk)), max(1, math.ceil(data.n_features / block))
    place = "row_number() over (partition by {0} order by {1}) - 1 as pos"
    samples = ws.put(
        data.samples.selectExpr("sample_id", "n_i", f"cast(pmod(xxhash64(sample_id), {chunks}) as int) as chunk")
        .selectExpr("*", place.format("chunk", "sample_id")), "tile-samples")
    features = ws.put(
        data.features.selectExpr("feature_id", f"cast(pmod(xxhash64(feature_id), {blocks}) as int) as block")
        .selectExpr("*", place.format("block", "feature_id")), "tile-features")
    placed = data.with_features(data.cells, features.selectExpr("feature_id", "block", "pos as p"), 2)
    placed = data.with_samples(placed, samples.selectExpr("sample_id", "chunk", "pos as s"))
    packed = placed.groupBy("chunk", "block").agg(  # at most chunk * block cells
        F.collect_list(F.struct("s", "p", "x")).alias("c")
    )
    grid = samples.select("chunk").distinct().selectExpr("chunk", f"explode(sequence(0, {blocks - 1})) as block")
    tiles = grid.join(packed, ["chunk", "block"], "left").selectExpr(
        "chunk", "block", *[f"coalesce(transform(c, v -> v.{n}), array()) as {n}" for n in ("s", "p", "x")]
    )
    parallel = ws.spark.sparkContext.defaultParallelism  # every core gets tiles, whatever the size
    buckets = min(chunks, max(8, parallel, math.ceil(chunks * blocks / 512)), MAX_BUCKETS)
    laid_out = ws.put(tiles.repartition(buckets, "chunk"), "tiles", bucket_by=["chunk"], buckets=buckets)
    return Tiles(laid_out, samples, features, chunks, blocks)


def cells_of(tiles: Tiles) -> DataFrame:
    """The tiles as rows again, zero cells included: ``sample_id, feature_id, x``."""
    pairs = tiles.samples.select("chunk", "pos", "sample_id").join(tiles.features.selectExpr("feature_id", "block", "pos as p"))
    found = tiles.cells.selectExpr("chunk", "block", "inline(arrays_zip(s, p, x))").withColumnRenamed("s", "pos")
    return pairs.join(found, ["chunk", "block", "pos", "p"], "left").selectExpr("sample_id", "feature_id", "coalesce(x, 0D) as x")


_SCALARS, _ARRAYS = ("mb", "ab", "p1", "p2"), ("m", "a")


def _scored(data: CountData, params: DataFrame, models: dict[int, BaseModel]) -> DataFrame:
    """Per feature: means m, slopes a of the groups and the background, prior log rates; the scores before stay beside."""
    rows = [(i, [digamma_value(s) for s in m.gamma_sum], m.gamma_sum, digamma_value(m.iota_sum), float(m.iota_sum))
            for i, m in models.items()]
    table = data.spark.createDataFrame(
        pd.DataFrame(rows, columns=["model_id", "psi_g", "g_sum", "psi_i", "i_sum"]),
        "model_id int, psi_g array<double>, g_sum array<double>, psi_i double, i_sum double",
    )
    staged = params.join(F.broadcast(table), "model_id")
    staged = staged.withColumn("m", F.expr("transform(gamma, (v, k) -> v / get(g_sum, k))")).withColumn(
        "mb", F.expr("iota / i_sum"))
    slope = f"transform(gamma, (v, k) -> get(m, k) * ({digamma('v')} - get(psi_g, k) - ln(get(m, k))))"
    return staged.selectExpr(
        "model_id", "block", "pos", "feature_id", "m", f"{slope} as a", "mb",
        f"mb * ({digamma('iota')} - psi_i - ln(mb)) as ab",
        f"{digamma('xi1')} - {digamma('xi1 + xi2')} as p1", f"{digamma('xi2')} - {digamma('xi1 + xi2')} as p2",
        *[c for c in params.columns if c.endswith("_old")],
    )


def _blocks(scores: DataFrame) -> DataFrame:
    """One row per (model, block) with the block's features as flat arrays."""
    names = [c for c in scores.columns if c not in ("model_id", "block", "pos", "feature_id")]
    packed = scores.groupBy("model_id", "block").agg(  # at most BLOCK features, up to hash spread
        F.sort_array(F.collect_list(F.struct("pos", "feature_id", *names))).alias("f")
    )
    wide = [n for n in names if n.removesuffix("_old") in _ARRAYS]
    return packed.selectExpr(
        "model_id", "block", "transform(f, v -> v.feature_id) as features",
        *[f"{'flatten(' if n in wide else '('}transform(f, v -> v.{n})) as {n}" for n in names])


def _packed(rows: DataFrame, extra: tuple = ()) -> DataFrame:
    """One row per (model, chunk): samples, totals, memberships now and before as flat arrays."""
    names = ("sample_id", "n_i", "r", "r_before", *extra)
    packed = rows.groupBy("model_id", "chunk").agg(  # at most CHUNK samples, up to hash spread
        F.sort_array(F.collect_list(F.struct("pos", *names))).alias("s_"))
    return packed.selectExpr(
        "model_id", "chunk", "transform(s_, v -> v.sample_id) as samples", "transform(s_, v -> v.n_i) as n_i",
        "flatten(transform(s_, v -> v.r)) as r", "flatten(transform(s_, v -> v.r_before)) as r_before",
        *[f"transform(s_, v -> v.{n}) as {n}" for n in extra])


def _tile_rows(data: CountData, tiles: Tiles, state: DataFrame, blocks: DataFrame, width: int, n_models: int) -> DataFrame:
    """Tiles with everything their kernel needs; the cells stay where they lie."""
    # never a broadcast: one row per chunk holds all memberships, which grow with the samples
    rows = tiles.cells.join(state.hint("shuffle_hash"), "chunk")
    keys = ["model_id", "block"] if "model_id" in blocks.columns else ["block"]
    if data.feature_rows_fit(width, n_models):
        return rows.join(F.broadcast(blocks), keys)
    salts = max(1, tiles.chunks // 1024)  # many tiles share a block: repeat blocks, spread tiles
    spread = rows.withColumn("salt", F.expr(f"chunk % {salts}"))
    repeated = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "salt"])


class _Tile:
    """One tile in NumPy."""

    def __init__(self, row, suffix: str = ""):
        self.n_i = np.asarray(row["n_i"], float)
        self.s, self.p = np.asarray(row["s"], int), np.asarray(row["p"], int)
        self.x = np.asarray(row["x"], float)
        self.d = digamma_array(np.ones(1))[0] - digamma_array(self.n_i + 1.0)
        n_features = len(row["mb" + suffix])
        self.m = np.asarray(row["m" + suffix], float).reshape(n_features, -1)
        self.a = np.asarray(row["a" + suffix], float).reshape(n_features, -1)
        self.mb, self.ab, self.p1, self.p2 = (np.asarray(row[n + suffix], float) for n in _SCALARS)

    def gains(self):
        """lgamma and digamma differences at the nonzero cells, per group and for the background."""
        p, x = self.p, self.x[:, None]
        m, mb = self.m[p], self.mb[p]  # the terms of a feature alone are evaluated once per feature, not once per cell
        lg = lgamma_array(x + m) - lgamma_array(self.m)[p]
        ps = digamma_array(x + m) - digamma_array(self.m)[p]
        return (lg, ps, lgamma_array(self.x + mb) - lgamma_array(self.mb)[p],
                digamma_array(self.x + mb) - digamma_array(self.mb)[p])

    def selection(self, r: np.ndarray, gains=None) -> np.ndarray:
        lg, ps, lgb, psb = gains or self.gains()
        yes = self.d[:, None] * (r @ self.a.T) + self.p1
        no = self.d[:, None] * self.ab + self.p2
        yes[self.s, self.p] += (r[self.s] * (lg + self.a[self.p] * ps)).sum(1)
        no[self.s, self.p] += lgb + self.ab[self.p] * psb
        with np.errstate(over="ignore", invalid="ignore"):
            yes, no = np.nan_to_num(np.exp(yes), posinf=1.0), np.nan_to_num(np.exp(no), posinf=1.0)
        return (yes + 1e-6) / (yes + no + 1e-6)

    def loglik(self, sel: np.ndarray, gains) -> np.ndarray:
        """The tile's part of every sample's log-likelihood per group."""
        lg, ps, _, _ = gains
        ll = self.d[:, None] * (sel @ self.a) - (sel.sum(1) * lgamma_array(self.n_i + 1.0))[:, None]
        np.add.at(ll, self.s, sel[self.s, self.p][:, None] * (lg + self.a[self.p] * ps))
        return ll

    def feature_sums(self, sel: np.ndarray, r: np.ndarray, gains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the tile's samples: selection, profile gains weighted by the memberships, background gains."""
        _, ps, _, psb = gains
        g = (sel * self.d[:, None]).T @ r
        np.add.at(g, self.p, r[self.s] * sel[self.s, self.p][:, None] * ps)
        out = 1.0 - sel
        i = (out * self.d[:, None]).sum(0)
        np.add.at(i, self.p, out[self.s, self.p] * psb)
        return sel.sum(0), g, i


_WORD = 1 << 32


def _draws(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A uniform draw per pair of a sample's and a feature's 32-bit code (an integer hash that SQL repeats)."""
    h = (codes[:, None] + others[None, :]) % _WORD
    for _ in range(2):
        h = ((h >> 16) ^ h) * 0x45D9F3B % _WORD
    return ((h >> 16) ^ h) / _WORD


def first_selection(codes, first, second) -> np.ndarray:
    """Repeatable start: share of the first of two uniform draws."""
    codes, first, second = (np.asarray(v, dtype=np.int64) for v in (codes, first, second))
    u, v = _draws(codes, first), _draws(codes, second)
    return u / np.maximum(u + v, 1e-300)


def _code(*keys: str, seed: int) -> str:
    return f"cast({hash_uniform(*keys, seed=seed)} * {_WORD}D as bigint)"


def _first_blocks(tiles: Tiles, seed: int) -> DataFrame:
    """One row per block: its features and their two codes."""
    coded = tiles.features.selectExpr("block", "pos", "feature_id", f"{_code('feature_id', '0', seed=seed)} as t0",
                                      f"{_code('feature_id', '1', seed=seed)} as t1")
    packed = coded.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "feature_id", "t0", "t1"))).alias("f"))
    return packed.selectExpr("block", "transform(f, v -> v.feature_id) as features",
                             "transform(f, v -> v.t0) as t0", "transform(f, v -> v.t1) as t1")


def _first_state(tiles: Tiles, resp: DataFrame, seed: int) -> DataFrame:
    """Packed starting memberships with the samples' codes for the first selection."""
    rows = resp.join(tiles.samples, "sample_id").selectExpr(
        "model_id", "chunk", "pos", "sample_id", "n_i", "r", "r as r_before",
        f"{_code('model_id', 'sample_id', seed=seed)} as code")
    return _packed(rows, ("code",))


def start_selection(data: CountData, tiles: Tiles, models: list[int], seed: int = 42) -> DataFrame:
    """The random first selection of every cell: ``model_id, sample_id, feature_id, selection``."""
    sample_type, feature_type = _types(data)
    state = _first_state(tiles, with_models(data.samples.selectExpr("sample_id", "array(1D) as r"), models), seed)

    def run(batches):
        for row in _rows(batches):
            sel = first_selection(row["code"], row["t0"], row["t1"])
            yield _cell_frame(row, sel)

    rows = _tile_rows(data, tiles, state, _first_blocks(tiles, seed), 2, 1)
    return rows.mapInPandas(
        run, f"model_id int, sample_id {sample_type}, feature_id {feature_type}, selection double")


def _rows(batches):
    for pdf in batches:
        for _, row in pdf.iterrows():
            yield row


def _cell_frame(row, sel: np.ndarray) -> pd.DataFrame:
    n, s = sel.shape
    return pd.DataFrame({"model_id": row["model_id"], "sample_id": np.repeat(row["samples"], s),
                         "feature_id": np.tile(row["features"], n), "selection": sel.ravel()})


def _sample_kernel(first: bool):
    """Log-likelihoods per sample of a tile, from the selection that the round before left."""

    def run(batches):
        for row in _rows(batches):
            tile, n = _Tile(row), len(row["n_i"])
            r = np.asarray(row["r"], float).reshape(n, -1)
            if first:
                sel = first_selection(row["code"], row["t0"], row["t1"])
            else:
                sel = _Tile(row, "_old").selection(np.asarray(row["r_before"], float).reshape(n, -1))
            ll = tile.loglik(sel, tile.gains())
            yield pd.DataFrame({"model_id": row["model_id"], "chunk": row["chunk"], "pos": np.arange(n, dtype=np.int32),
                                "sample_id": row["samples"], "n_i": tile.n_i, "r": list(r), "ll": list(ll)})

    return run


def _feature_kernel(batches):
    """Sums per feature of a tile: selection, profile gains weighted by the new memberships, background gains."""
    for row in _rows(batches):
        tile, n = _Tile(row), len(row["n_i"])
        gains = tile.gains()
        sel = tile.selection(np.asarray(row["r_before"], float).reshape(n, -1), gains)
        r = np.asarray(row["r"], float).reshape(n, -1)
        total, g, i = tile.feature_sums(sel, r, gains)
        yield pd.DataFrame({"model_id": row["model_id"], "feature_id": row["features"], "sel": total, "g": list(g), "i": i})


def _cell_kernel(batches):
    for row in _rows(batches):
        yield _cell_frame(row, _Tile(row).selection(np.asarray(row["r_before"], float).reshape(len(row["n_i"]), -1)))


def _round_kernel(numbers: dict[int, dict], elogs: dict[int, np.ndarray], first: dict | None):
    """Both steps of a round over tiles that hold all features: the chunk's new memberships, then the task's sums.

    ``sums`` of a model lists, one after the other: selection, background gains and profile gains by feature (in
    the order of their places), mass by group, number of samples, sum of the log normalisers.
    """
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for row in _rows(batches):
            model = int(row["model_id"])
            given, n = {**row, **numbers[model]}, len(row["n_i"])
            tile, before = _Tile(given), np.asarray(row["r"], float).reshape(n, -1)
            if first is not None:
                sel = first_selection(row["code"], first["t0"], first["t1"])
            else:
                sel = _Tile(given, "_old").selection(np.asarray(row["r_before"], float).reshape(n, -1))
            gains = tile.gains()
            logit = elogs[model] + tile.loglik(sel, gains)
            top = logit.max(1, keepdims=True)
            e = np.exp(logit - top)
            total = e.sum(1, keepdims=True)
            r, log_norm = e / total, (top + np.log(total))[:, 0]
            chosen, g, i = tile.feature_sums(tile.selection(before, gains), r, gains)
            part = np.concatenate([chosen, i, g.ravel(), r.sum(0), [n, log_norm.sum()]])
            sums[model] = sums[model] + part if model in sums else part
            yield pd.DataFrame({"model_id": [model], "chunk": [row["chunk"]], "samples": [row["samples"]], "n_i": [tile.n_i],
                                "r": [r.ravel()], "r_before": [before.ravel()], "log_norm": [log_norm], "sums": [None]})
        for model, part in sums.items():
            yield pd.DataFrame({"model_id": [model], "chunk": [None], "samples": [None], "n_i": [None], "r": [None],
                                "r_before": [None], "log_norm": [None], "sums": [part]})

    return run


@dataclass
class BaseFit:
    data: CountData
    tiles: Tiles
    models: dict[int, BaseModel]
    params: DataFrame  # model_id, block, pos, feature_id, gamma, iota, xi1, xi2 and the scores before
    state: DataFrame  # packed memberships: the last ones, and those the last selection follows from

    @property
    def resp(self) -> DataFrame:
        """``model_id, sample_id, r, log_norm`` of the last memberships."""
        return _unpacked(self.state, self.models)


def _types(data: CountData) -> tuple[str, str]:
    return (data.samples.schema["sample_id"].dataType.simpleString(),
            data.features.schema["feature_id"].dataType.simpleString())


def _unpacked(state: DataFrame, models: dict[int, BaseModel]) -> DataFrame:
    k = max(m.k for m in models.values())
    rows = state.selectExpr("model_id", "r as _r", "log_norm as _l", "posexplode(samples) as (_i, sample_id)")
    return rows.selectExpr("model_id", "sample_id", f"slice(_r, _i * {k} + 1, {k}) as r", "get(_l, _i) as log_norm")


def _read_sums(params: DataFrame, models: dict[int, BaseModel]) -> None:
    width = max(m.k for m in models.values())
    flat = params.selectExpr("model_id", "iota", *unfold("gamma", "g", width))
    names = ["iota", *[f"g{k}" for k in range(width)]]
    for r in flat.groupBy("model_id").agg(*[F.expr(f"sum({n}) as {n}") for n in names]).collect():
        m = models[r["model_id"]]
        m.iota_sum, m.gamma_sum = r["iota"], [r[f"g{k}"] for k in range(m.k)]


def _read_weights(state: DataFrame, models: dict[int, BaseModel]) -> None:
    """Stick parameters from the masses; the mean log normaliser where the table has it."""
    k = max(m.k for m in models.values())
    at = "aggregate(sequence(0, size(samples) - 1), 0D, (acc, i) -> acc + get(r, i * {0} + {1}))"
    logs = "aggregate(log_norm, 0D, (acc, v) -> acc + v)" if "log_norm" in state.columns else "0D"
    flat = state.selectExpr("model_id", "size(samples) as n", f"{logs} as l", *[f"{at.format(k, j)} as r{j}" for j in range(k)])
    names = ["n", "l", *[f"r{j}" for j in range(k)]]
    for row in flat.groupBy("model_id").agg(*[F.expr(f"sum({n}) as {n}") for n in names]).collect():
        m = models[row["model_id"]]
        mass = [row[f"r{j}"] + 10 * np.finfo(float).eps for j in range(m.k)]
        m.a, m.b = wt.update("dp", mass, {"nu": m.prior})
        m.log_norm = row["l"] / row["n"]


def _memberships(data: CountData, tiles: Tiles, models: dict[int, BaseModel], state: DataFrame, scores: DataFrame,
                 first: DataFrame | None) -> DataFrame:
    """The next packed state, from the selection before this round."""
    k = max(m.k for m in models.values())
    blocks = _blocks(scores)
    if first is not None:
        blocks = blocks.join(first.drop("features"), "block")
    rows = _tile_rows(data, tiles, state, blocks, 4 * k + 8, len(models))
    sample_type, _ = _types(data)
    parts = rows.mapInPandas(
        _sample_kernel(first is not None),
        f"model_id int, chunk int, pos int, sample_id {sample_type}, n_i double, r array<double>, ll array<double>")
    keys = ["model_id", "chunk", "pos", "sample_id", "n_i"]
    sums = parts.selectExpr(*keys, *unfold("r", "b", k), *unfold("ll", "l", k)).groupBy(*keys).agg(
        *[F.expr(f"max(b{j}) as b{j}") for j in range(k)], *[F.expr(f"sum(l{j}) as l{j}") for j in range(k)])
    table = F.broadcast(data.spark.createDataFrame(
        pd.DataFrame([(i, wt.elog(m.a, m.b)) for i, m in models.items()], columns=["model_id", "elog_pi"]),
        "model_id int, elog_pi array<double>"))
    logit = f"zip_with(elog_pi, array({', '.join(f'l{j}' for j in range(k))}), (e, v) -> e + v)"
    staged = sums.join(table, "model_id").selectExpr(
        *keys, f"array({', '.join(f'b{j}' for j in range(k))}) as r_before", f"{logit} as logit")
    return _packed(with_softmax(staged, "logit", "r", None, "log_norm"), ("log_norm",))


def fit_base(data: CountData, k: int = 1, max_iter: int = 100, init: str | DataFrame = "kmeans", seed: int = 42,
             n_init: int = 1, weight_prior: float | None = None, select_prior: float = 1.0,
             floor: float | None = 1e-10, tiles: Tiles | None = None, history_path: str | None = None,
             history_every: int = 10) -> BaseFit:
    """Fixed number of rounds of the first-order model; each start is a model of its own.

    ``init`` is ``kmeans``, ``random``, memberships, or labels ``(sample_id, label)``, which every start then shares; the
    random first selection differs between starts. ``floor`` keeps the concentrations positive, which the plain
    update does not ensure. ``history_path`` keeps memberships and the selection of every cell of every
    ``history_every``-th round (samples x features rows each).
    """
    ws = data.ws
    tiles = tiles or make_tiles(data)
    models = {i: BaseModel(i, k, 1.0 / k if weight_prior is None else weight_prior, select_prior) for i in range(n_init)}
    starts = [Start(i, k, seed + i) for i in models]
    if isinstance(init, DataFrame):
        resp = init if "r" in init.columns else reduce(DataFrame.unionByName, [init_from_labels(init, k, i) for i in models])
    elif init == "kmeans":
        resp = init_kmeans(data, starts, n_init=1, log1p=False)
    else:
        resp = init_random(data.samples, starts)
    state = ws.put(_first_state(tiles, resp.select("model_id", "sample_id", "r"), seed), "chunks")
    _read_weights(state, models)
    # the random first selection enters the rates through its sums, one pass over the tiles
    n, ones = num(data.n_samples), ", ".join(["1D"] * k)
    rates = (f"{num(select_prior)} + sel as xi1", f"{num(select_prior)} + {n} - sel as xi2")
    first = ws.put(_first_blocks(tiles, seed), "first")
    params = ws.put(
        tiles.features.join(_first_sums(data, tiles, state, first), "feature_id").selectExpr(
            "model_id", "block", "pos", "feature_id", f"array({ones}) as gamma", "1D as iota", *rates), "params")
    _read_sums(params, models)
    whole = tiles.blocks == 1 and data.n_features <= BLOCK and data.feature_rows_fit(4 * k + 8, n_init)
    numbers = _numbers(params, models) if whole and max_iter else {}
    written = state
    if numbers and all(numbers.values()):
        models, state, params, written = _whole_rounds(
            data, tiles, models, state, params, numbers, first, max_iter, select_prior, floor, history_path, history_every)
    else:
        numbers = {}
    for t in range(1, 1 if numbers else max_iter + 1):
        scores = _scored(data, params, models)
        new_state = ws.put(_memberships(data, tiles, models, state, scores, first if t == 1 else None), "chunks")
        blocks = _blocks(scores)
        rows = _tile_rows(data, tiles, new_state, blocks, 4 * k + 8, len(models))
        parts = rows.mapInPandas(
            _feature_kernel, f"model_id int, feature_id {_types(data)[1]}, sel double, g array<double>, i double")
        flat = parts.selectExpr("model_id", "feature_id", "sel", "i", *unfold("g", "g", k))
        sums = flat.groupBy("model_id", "feature_id").agg(
            F.expr("sum(sel) as sel"), F.expr("sum(i) as i"), *[F.expr(f"sum(g{j}) as g{j}") for j in range(k)])
        listed = ", ".join(f"g{j}" for j in range(k))
        low = (lambda e: f"greatest({e}, {num(floor)})") if floor else (lambda e: e)
        used = [*_ARRAYS, *_SCALARS]
        updated = scores.select("model_id", "block", "pos", "feature_id", *used).join(sums, ["model_id", "feature_id"])
        new_params = ws.put(
            updated.selectExpr(
                "model_id", "block", "pos", "feature_id",
                f"zip_with(m, array({listed}), (v, g) -> {low('1D + v * g')}) as gamma", f"{low('1D + mb * i')} as iota",
                *rates, *[f"{c} as {c}_old" for c in used]),
            "params")
        if history_path and t % history_every == 0:
            _save_round(data, tiles, new_state, blocks, models, history_path, t)
        ws.release(state, params)
        models = copy.deepcopy(models)
        state, params, written = new_state, new_params, new_state
        _read_weights(state, models)
        _read_sums(params, models)
        for m in models.values():
            m.n_iter = t
    # one more membership step, as the rounds end with the profiles
    final = ws.put(
        _memberships(data, tiles, models, state, _scored(data, params, models), None if max_iter else first), "chunks")
    for r in _unpacked(final, models).groupBy("model_id").agg(F.avg("log_norm").alias("v")).collect():
        models[r["model_id"]].log_norm = r["v"]
    ws.release(written, first)
    return BaseFit(data, tiles, models, params, final)


def _numbers(params: DataFrame, models: dict[int, BaseModel]) -> dict[int, dict]:
    """Per model, the parameters of a single block's features as arrays in the order of their places."""
    out = {i: [] for i in models}
    for row in params.select("model_id", "pos", "gamma", "iota", "xi1", "xi2").collect():  # at most BLOCK features
        out[row["model_id"]].append(row[1:])
    return {i: dict(zip(("pos", "gamma", "iota", "xi1", "xi2"), (np.array(c) for c in zip(*sorted(rows)))))
            for i, rows in out.items()}


def _scored_numbers(v: dict) -> dict:
    """What ``_scored`` computes, from one model's arrays."""
    psi, g_sum, i_sum = digamma_array, v["gamma"].sum(0), v["iota"].sum()
    m, mb, both = v["gamma"] / g_sum, v["iota"] / i_sum, psi(v["xi1"] + v["xi2"])
    return {"m": m, "a": m * (psi(v["gamma"]) - psi(g_sum) - np.log(m)), "mb": mb,
            "ab": mb * (psi(v["iota"]) - psi(i_sum) - np.log(mb)), "p1": psi(v["xi1"]) - both, "p2": psi(v["xi2"]) - both}


def _params_table(data: CountData, tiles: Tiles, numbers: dict[int, dict]) -> DataFrame:
    """The arrays of a single block's features as the table of parameters."""
    types = {"model_id": "int", "pos": "int"}
    parts = []
    for i, v in numbers.items():
        part = pd.DataFrame({n: c.tolist() for n, c in v.items()})
        part.insert(0, "model_id", i)
        types |= {n: "array<double>" if c.ndim == 2 else "double" for n, c in v.items() if n != "pos"}
        parts.append(part)
    table = data.spark.createDataFrame(pd.concat(parts, ignore_index=True), ", ".join(f"{n} {t}" for n, t in types.items()))
    rest = [n for n in types if n not in ("model_id", "pos")]
    return tiles.features.join(F.broadcast(table), "pos").select("model_id", "block", "pos", "feature_id", *rest)


def _whole_rounds(data: CountData, tiles: Tiles, models: dict[int, BaseModel], state: DataFrame, params: DataFrame,
                  numbers: dict[int, dict], first: DataFrame, max_iter: int, select_prior: float, floor: float | None,
                  history_path: str | None, history_every: int) -> tuple[dict[int, BaseModel], DataFrame, DataFrame, DataFrame]:
    """All rounds where one block holds every feature: one pass over the tiles a round.

    The features' sums, at most BLOCK rows of K + 2 numbers a model, come to the driver; memberships don't.
    """
    ws, (sample_type, _), n = data.ws, _types(data), data.n_samples
    codes, written = first.select("t0", "t1").first().asDict(), state
    schema = (f"model_id int, chunk int, samples array<{sample_type}>, n_i array<double>, r array<double>, "
              "r_before array<double>, log_norm array<double>, sums array<double>")
    for t in range(1, max_iter + 1):
        scores = {i: _scored_numbers(v) for i, v in numbers.items()}
        for i, v in numbers.items():
            scores[i] |= {c: x for c, x in v.items() if c.endswith("_old")}
        elogs = {i: np.array(wt.elog(m.a, m.b)) for i, m in models.items()}
        rows = tiles.cells.join(state.hint("shuffle_hash"), "chunk")  # never a broadcast, as in _tile_rows
        fresh = ws.put(rows.mapInPandas(_round_kernel(scores, elogs, codes if t == 1 else None), schema), "round")
        new_state = fresh.where("chunk is not null").drop("sums")
        if history_path and t % history_every == 0:
            table = _params_table(data, tiles, numbers)
            _save_round(data, tiles, new_state, _blocks(_scored(data, table, models)), models, history_path, t)
        found = summed(fresh.where("chunk is null"))
        models = copy.deepcopy(models)
        for i, m in models.items():
            v, used = numbers[i], scores[i]
            size = len(v["pos"])
            sel, back, g, mass = np.split(found[i], [size, 2 * size, (2 + m.k) * size])
            gamma, iota = 1.0 + used["m"] * g.reshape(size, m.k), 1.0 + used["mb"] * back
            if floor:
                gamma, iota = np.maximum(gamma, floor), np.maximum(iota, floor)
            numbers[i] = {"pos": v["pos"], "gamma": gamma, "iota": iota, "xi1": select_prior + sel, "xi2": select_prior + n - sel,
                          **{f"{c}_old": used[c] for c in (*_ARRAYS, *_SCALARS)}}
            *mass, members, logs = mass.tolist()  # plain floats: frames are also made where Arrow is off
            m.a, m.b = wt.update("dp", [v + 10 * float(np.finfo(float).eps) for v in mass], {"nu": m.prior})
            m.log_norm, m.iota_sum, m.gamma_sum = logs / members, float(iota.sum()), gamma.sum(0).tolist()
            m.n_iter = t
        ws.release(written)
        state, written = new_state, fresh
    ws.release(params)
    return models, state, ws.put(_params_table(data, tiles, numbers), "params"), written


def _first_sums(data: CountData, tiles: Tiles, state: DataFrame, first: DataFrame) -> DataFrame:
    """Sums by feature of the random first selection."""
    def run(batches):
        for row in _rows(batches):
            sel = first_selection(row["code"], row["t0"], row["t1"])
            yield pd.DataFrame({"model_id": row["model_id"], "feature_id": row["features"], "sel": sel.sum(0)})

    rows = _tile_rows(data, tiles, state, first, 2, 1)
    parts = rows.mapInPandas(run, f"model_id int, feature_id {_types(data)[1]}, sel double")
    return parts.groupBy("model_id", "feature_id").agg(F.sum("sel").alias("sel"))


def _cells(data: CountData, tiles: Tiles, state: DataFrame, blocks: DataFrame, models: dict[int, BaseModel]) -> DataFrame:
    sample_type, feature_type = _types(data)
    rows = _tile_rows(data, tiles, state, blocks, 4 * max(m.k for m in models.values()) + 8, len(models))
    return rows.mapInPandas(
        _cell_kernel, f"model_id int, sample_id {sample_type}, feature_id {feature_type}, selection double")


def _save_round(data, tiles, state, blocks, models, path: str, t: int) -> None:
    """Append memberships and selection of one round below ``path``."""
    resp = _unpacked(state, models).select("model_id", "sample_id", "r", F.lit(t).alias("iter"))
    resp.write.mode("append").partitionBy("iter").parquet(f"{path}/resp")
    cells = _cells(data, tiles, state, blocks, models).withColumnRenamed("selection", "f").withColumn("iter", F.lit(t))
    cells.write.mode("append").partitionBy("iter").parquet(f"{path}/cell_selection")


def cell_selection(fit: BaseFit) -> DataFrame:
    """Selection of every (sample, feature) after the last step; samples x features rows."""
    return _cells(fit.data, fit.tiles, fit.state, _blocks(_scored(fit.data, fit.params, fit.models)), fit.models)


def mean_selection(fit: BaseFit) -> DataFrame:
    """Mean selection per feature after the last step: ``model_id, feature_id, selection``."""
    rows = _tile_rows(fit.data, fit.tiles, fit.state, _blocks(_scored(fit.data, fit.params, fit.models)),
                      4 * max(m.k for m in fit.models.values()) + 8, len(fit.models))
    parts = rows.mapInPandas(
        _feature_kernel, f"model_id int, feature_id {_types(fit.data)[1]}, sel double, g array<double>, i double")
    return parts.groupBy("model_id", "feature_id").agg((F.sum("sel") / F.lit(float(fit.data.n_samples))).alias("selection"))


def best_start(fit: BaseFit) -> BaseFit:
    """The fit reduced to the start with the largest mean log normaliser (ties: lowest id)."""
    best = max(sorted(fit.models), key=lambda i: (fit.models[i].log_norm, -i))
    mine = F.col("model_id") == best
    return BaseFit(fit.data, fit.tiles, {best: fit.models[best]}, fit.params.where(mine), fit.state.where(mine))
