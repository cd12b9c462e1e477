"""One pass over whole samples for fits with one selection value per feature.

Their memberships follow from the sample's own cells and a small table of scores, so a sample
that lies in one row gives its memberships and its part of the sums by feature at once:
nothing is written, exchanged or joined by sample between the two. The sums of a sweep, at most
``PASS_NUMBERS`` of them, come to the driver; memberships don't.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import EPS
from tallymix.operators.cells import CountData

PASS_NUMBERS = 1 << 16  # largest number of sums that a pass brings to the driver
ROW_CELLS = 1 << 12  # cells of one row, or one sample
STEP_ROWS = 1 << 5  # rows taken at once by a kernel
TASK_CELLS = 1_000_000
COLUMNS = {"counted": np.bool_, "lengths": np.int32, "codes": np.int32, "x": np.float64}
ID_TYPES = ("string", "int", "bigint")  # features of other types go on in joins


@dataclass
class PackedCells:
    data: CountData
    rows: DataFrame  # runs of whole samples as bytes: counted and length of each sample, code and count of each cell
    ids: list  # feature of each code
    empty: int  # samples without cells

    def scores(self, table: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
        """Score columns ``c0..`` of a feature table as one matrix (code, group) per model."""
        place, width = {f: j for j, f in enumerate(self.ids)}, max(sizes.values())
        out = {i: np.zeros((len(self.ids), k)) for i, k in sizes.items()}
        for row in table.select("model_id", "feature_id", *[f"c{k}" for k in range(width)]).collect():
            if row[1] is not None:
                out[row[0]][place[row[1]]] = row[2:2 + sizes[row[0]]]
        return out

    def table(self, sums: dict[int, np.ndarray]) -> DataFrame:
        """Sums by feature ``model_id, feature_id, rx ARRAY`` from one matrix (code, group) per model."""
        kind = self.data.features.schema["feature_id"].dataType.simpleString()
        rows = [(i, f, v) for i, m in sums.items() for f, v in zip(self.ids, m.tolist())]
        return self.data.spark.createDataFrame(
            pd.DataFrame(rows, columns=["model_id", "feature_id", "rx"]), f"model_id int, feature_id {kind}, rx array<double>")


def packed_cells(data: CountData, width: int, n_models: int) -> PackedCells | None:
    """The table by whole samples, laid out once; None where the sums are too many or a sample is cut into slices."""
    kind = data.features.schema["feature_id"].dataType.simpleString()
    if data.heavy_samples is not None or kind not in ID_TYPES or not data.feature_rows_fit(width, n_models):
        return None
    if n_models * (data.n_features + 1) * width > PASS_NUMBERS:
        return None
    if data.packed is None:
        data.packed = _lay_out(data)
    return data.packed


def _lay_out(data: CountData) -> PackedCells:
    features = data.features.where("feature_id is not null")
    ids = sorted(r[0] for r in features.select("feature_id").collect())  # at most PASS_NUMBERS
    kind = data.features.schema["feature_id"].dataType.simpleString()
    codes = data.spark.createDataFrame(
        pd.DataFrame({"feature_id": pd.Series(ids, dtype=object), "code": np.arange(len(ids))}), f"feature_id {kind}, code int")
    placed = data.cells.join(F.broadcast(codes), "feature_id")
    samples = placed.groupBy("sample_id").agg(F.collect_list(F.struct("code", "x")).alias("c"))  # at most slice_rows cells
    parallel = data.spark.sparkContext.defaultParallelism
    tasks = min(parallel, math.ceil(data.nnz / 50_000)) * math.ceil(data.nnz / (parallel * TASK_CELLS))
    rows = samples.repartition(max(1, tasks), "sample_id").selectExpr(
        "sample_id is not null as counted", "transform(c, v -> v.code) as codes", "transform(c, v -> v.x) as x")
    packed = rows.mapInArrow(_runs(ROW_CELLS), ", ".join(f"{c} binary" for c in COLUMNS))
    empty = 0 if data.empty_samples is None else data.empty_samples.count()
    return PackedCells(data, data.ws.put(packed, "packed"), ids, empty)


def floored_memberships(logit: np.ndarray) -> np.ndarray:
    """Rows of ``logit`` as memberships, lifted to the floor and made to sum to one again."""
    e = np.exp(logit - logit.max(1, keepdims=True))
    r = np.maximum(e / e.sum(1, keepdims=True), EPS)
    return r / r.sum(1, keepdims=True)


def _plogp(r: np.ndarray) -> float:
    return (r * np.log(np.maximum(r, EPS))).sum()


def _runs(row_cells: int):
    """Samples as rows of at most ``row_cells`` cells, at least one sample each."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            offsets = np.asarray(batch.column("codes").offsets).astype(np.int64)
            offsets, edges = offsets - offsets[0], [0]
            while edges[-1] < batch.num_rows:
                high = int(np.searchsorted(offsets, offsets[edges[-1]] + row_cells, side="right")) - 1
                edges.append(max(high, edges[-1] + 1))
            values = {"counted": np.asarray(batch.column("counted")), "lengths": np.diff(offsets),
                      "codes": np.asarray(batch.column("codes").flatten()), "x": np.asarray(batch.column("x").flatten())}
            places = {"counted": edges, "lengths": edges, "codes": offsets[edges], "x": offsets[edges]}
            yield pa.RecordBatch.from_pydict({
                c: pa.array([values[c][a:b].astype(kind).tobytes() for a, b in zip(places[c], places[c][1:])], pa.binary())
                for c, kind in COLUMNS.items()})

    return run


def sample_sums(s: np.ndarray, p: np.ndarray, x: np.ndarray, counted: np.ndarray, scores: dict[int, np.ndarray],
                elogs: dict[int, np.ndarray], beta: float) -> dict[int, np.ndarray]:
    """Per model, for cells (sample, code, count): sums by feature and group, masses, sum of r ln r, in one row of numbers."""
    n, size, out = len(counted), len(next(iter(scores.values()))), {}
    dense = n * size <= 8 * len(x)
    if dense:
        whole = np.bincount(s * size + p, weights=x, minlength=n * size).reshape(n, size)
    for i, c in scores.items():
        if dense:
            ll = whole @ c
        else:
            ll = np.stack([np.bincount(s, weights=x * c[p, k], minlength=n) for k in range(c.shape[1])], 1)
        r = floored_memberships(beta * (elogs[i] + ll))
        own = r * counted[:, None]  # cells of a missing sample id belong to no sample
        if dense:
            rx = whole.T @ own
        else:
            rx = np.stack([np.bincount(p, weights=x * own[s, k], minlength=size) for k in range(c.shape[1])], 1)
        out[i] = np.concatenate([rx.ravel(), r.sum(0), [_plogp(r)]])
    return out


def _kernel(scores: dict[int, np.ndarray], elogs: dict[int, np.ndarray], beta: float, step_rows: int):
    def run(batches):
        import pyarrow as pa

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, step_rows):
                step = batch.slice(low, step_rows)
                counted, lengths, p, x = (np.frombuffer(b"".join(step.column(c).to_pylist()), kind) for c, kind in COLUMNS.items())
                s = np.repeat(np.arange(len(lengths)), lengths)
                part = sample_sums(s, p, x, counted, scores, elogs, beta)
                found = {i: found[i] + v if i in found else v for i, v in part.items()}
        if found:
            yield pa.RecordBatch.from_pydict(
                {"model_id": pa.array(list(found), pa.int32()),
                 "sums": pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))})

    return run


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays ``sums`` place by place, one array per model."""
    rows = parts.selectExpr("model_id", "posexplode(sums) as (j, v)").groupBy("model_id", "j").agg(F.expr("sum(v) as v")).collect()
    placed: dict[int, dict] = {}
    for r in rows:
        placed.setdefault(r["model_id"], {})[r["j"]] = r["v"]
    return {i: np.array([mine[j] for j in range(len(mine))]) for i, mine in placed.items()}


def one_pass(packed: PackedCells, scores: DataFrame, elogs: dict[int, list[float]],
             beta: float) -> dict[int, tuple[np.ndarray, list[float], float]]:
    """Per model: sums of membership times count by (code, group), group masses, sum of r ln r."""
    sizes, logs = {i: len(e) for i, e in elogs.items()}, {i: np.array(e) for i, e in elogs.items()}
    matrices = packed.scores(scores, sizes)
    found = summed(packed.rows.mapInArrow(_kernel(matrices, logs, beta, STEP_ROWS), "model_id int, sums array<double>"))
    out = {}
    for i, k in sizes.items():
        v = found.get(i, np.zeros(len(packed.ids) * k + k + 1))
        rx, mass, plogp = v[:-k - 1].reshape(-1, k), v[-k - 1:-1], v[-1]
        if packed.empty:
            r = floored_memberships(beta * logs[i][None])[0]
            mass, plogp = mass + packed.empty * r, plogp + packed.empty * _plogp(r)
        out[i] = rx, [float(m) for m in mass], float(plogp)
    return out
